from pyspark.sql import functions as F

from rostrum.functions import match as M
from rostrum.functions import people as P
from rostrum.functions import relevance as R
from rostrum.functions import text as T
from rostrum.functions import urls as U


def ev(spark, rows, schema, **exprs):
    df = spark.createDataFrame(rows, schema)
    return [r.asDict(recursive=True) for r in df.select(*[e.alias(k) for k, e in exprs.items()]).collect()]


def vals(spark, values, fn):
    out = ev(spark, [(i, v) for i, v in enumerate(values)], "i int, v string", i=F.col("i"), o=fn(F.col("v")))
    return [r["o"] for r in sorted(out, key=lambda r: r["i"])]


def test_company_names(spark):
    assert vals(spark, ["ABC PRIVATE LIMITED", "ABC Pvt. Ltd.", "The Ácme Industries Group RXIL", "Mahindra & Mahindra Ltd", None],
                T.company_key) == ["abc", "abc", "acme", "mahindra & mahindra", ""]
    assert vals(spark, ["Tata Consultancy Services Ltd", "Mahindra & Mahindra Ltd", "Foo Bar - rxil"], T.brand_tokens) == [
        ["tata", "consultancy", "services"], ["mahindra", "mahindra"], ["foo", "bar"]]
    assert vals(spark, ["Blue Tokai Coffee Roasters Private Limited"], T.comparable_tokens) == [["blue", "tokai", "coffee", "roaster"]]
    assert vals(spark, ["industries", "sons", "boxes", "gas", "glass"], T.singular) == ["industry", "son", "box", "gas", "glass"]
    assert vals(spark, ["ﬁrst ＡＢ é"], T.strip_accents) == ["first AB e"]
    assert vals(spark, ["a&amp;b &#8211; &#39;x&#39; &lt;", "x&nbsp;y"], T.decode_entities) == ["a&b – 'x' <", "x y"]
    assert vals(spark, ["Profilenethttps://in.profiles.example › in › falguni-nayar Falguni Nayar - Nykaa"], T.clean_title) == ["Falguni Nayar - Nykaa"]
    got = ev(spark, [("ABC Technologies", "abc ltd"), ("Foo", "Bar")], "a string, b string", s=T.same_company(F.col("a"), F.col("b")))
    assert [r["s"] for r in got] == [True, False]


def test_urls(spark):
    assert vals(spark, ["abc.tech", "abc.biz", "abc.co.in", "tcs.com", "in.abc.com"], U.domain_core) == ["abc", "abc", "abc", "tcs", "abc"]
    assert vals(spark, ["https://vertex.com/", "https://sunshine.com/", "https://x.com/foo", "https://www.profiles.example/in/foo",
                        "https://www.zaubacorp.com/company/x", "https://www.amazon.in/x"], U.is_blocked_host) == [False, False, True, True, True, True]
    assert vals(spark, ["https://example.com/Team?member=AbC&utm_source=google", "javascript:alert(1)", "https://u:p@x.test/",
                        "https://www.google.com/url?q=https%3A%2F%2Fa.test%2FB", "HTTP://A.test:80#x"], U.result_url) == [
        "https://example.com/Team?member=AbC", None, None, "https://a.test/B", "http://a.test/"]
    assert vals(spark, ["https://r.search.yahoo.com/x/RU=https%3a%2f%2fa.test%2fb%2f/RK=2", "https://duckduckgo.com/l/?uddg=https%3A%2F%2Fa.test%2Fq%3Fz%3D1",
                        "https://www.bing.com/ck/a?u=a1aHR0cHM6Ly9hLnRlc3QveA", "https://s.test/r?url=https%3A%2F%2Fb.test", "https://bing.com/x",
                        "https://a.test/x/?k=1#f"], U.unwrap_url) == [
        "https://a.test/b", "https://a.test/q", "https://a.test/x", "https://b.test", None, "https://a.test/x"]
    assert vals(spark, ["https://www.zaubacorp.com/ACME-FOODS-PRIVATE-LIMITED-U12345AA2000PTC123456", "https://zaubacorp.com/company/acme-foods-private-limited/u12345aa2000ptc123456",
                        "https://www.zaubacorp.com/ACME-FOODS-LLP-AAK-7453", "https://www.zaubacorp.com/ASHA-RAO-00001234", "https://zaubacorp.test/A-U12345AA2000PTC123456",
                        "https://www.zaubacorp.com/%ZZ-U12345AA2000PTC123456"], lambda c: U.registry_record(c)["cin"]) == [
        "U12345AA2000PTC123456", "U12345AA2000PTC123456", "AAK-7453", None, None, None]
    assert vals(spark, ["https://in.profiles.example/in/Asha-Rao", "/in/asha", "https://profiles.example:444/in/asha", "https://x.test/in/a"],
                U.canonical_profile_url) == ["https://www.profiles.example/in/Asha-Rao", "https://www.profiles.example/in/asha", "", ""]
    got = ev(spark, [("bhel", "Bharat Heavy Electricals Limited"), ("koel", "Kirloskar Oil Engines Limited"), ("tcsion", "Tata Consultancy Services"),
                     ("tatamotors", "Tata Consultancy Services")], "c string, n string", s=U.domain_score(F.col("c"), T.brand_tokens(F.col("n"))))
    assert [(r["s"]["kind"], r["s"]["score"]) for r in got] == [("acronym-prefix", 12), ("acronym-prefix", 12), ("none", -6), ("partial(1/3)", -3)]
    got = ev(spark, [("../b/./c?x=1#y", "https://www.a.test/p/q/r"), ("/team", "https://a.test"), ("//a.test/x.pdf", "https://a.test/"), ("team/", "https://a.test/x")],
             "h string, b string", o=U.page_link(F.col("h"), F.col("b")))
    assert [r["o"] for r in got] == ["https://www.a.test/p/b/c?x=1", "https://a.test/team", None, "https://a.test/team/"]


def test_person_names(spark):
    rows = [("M.K. Sharma", "", True), ("N.R. Narayana Murthy", "", True), ("Krithivasan K.", "", True), ("Ramesh B.", "", True),
            ("Rajiv Bajaj", "Bajaj Auto Limited", True), ("Anand Mahindra", "Mahindra & Mahindra Ltd", True), ("Bajaj Auto", "Bajaj Auto Limited", False),
            ("Nykaa Falguni Nayar", "Nykaa", False), ("Nykaa Beauty", "Nykaa", False), ("A. B.", "", False), ("Jose van der Berg", "", True),
            ("Al-Noor Ramji", "", True), ("Mark Rose", "", True), ("MUKESH AMBANI", "", True), ("Board Of Directors", "", False), ("Quick Links", "", False),
            ("Annual Report", "", False), ("Visit our", "", False), ("Search", "", False), ("FSN E-commerce", "", False)]
    got = ev(spark, rows, "n string, c string, want boolean", n=F.col("n"), want=F.col("want"),
             ok=P.is_person_name(P.clean_name(F.col("n")), T.company_words(F.col("c"))))
    assert [r for r in got if r["ok"] != r["want"]] == []
    assert vals(spark, ["Mr. Anil B. Gupta", "Vedika Bhandarkar Non-Executive", "K. Krithivasan K. Krithivasan", "Asha Rao (DIN: 0123)", "Shri Dr", "", None],
                P.clean_name) == ["Anil B. Gupta", "Vedika Bhandarkar Non-Executive".replace(" Non-Executive", ""), "K. Krithivasan", "Asha Rao", "Dr", "", ""]
    assert vals(spark, ["K. Krithivasan", "Rao Asha Rao", "É. Rao"], P.name_key) == ["krithivasan", "asha-rao", "rao"]


def test_roles(spark):
    assert vals(spark, ["Founder & CFO Bio Nikhil Is An Astute and", "managing director", "co-founder and ceo", "cto", "Director - Strategy & Ops of all things"],
                P.normalize_role) == ["Founder & CFO", "Managing Director", "Co-Founder and CEO", "CTO", "Director - Strategy & Ops of"]
    assert vals(spark, ["ácto", "a director", "directors", "ahead of"], P.find_roles) == [["cto"], ["director"], ["directors"], []]
    assert vals(spark, ["Whole-time director", "", "Peon"], P.registry_role) == ["Whole-Time Director", "Director", "Director"]
    assert vals(spark, ["Managing Director", "Rajesh Kumar Sharma Managing Director", "Co-Founder & CEO", "hello"], P.is_role_label) == [True, False, True, False]
    assert vals(spark, ["ex-Director at Acme", "Director at Acme", "ex- "], P.is_past_clause) == [True, False, False]
    assert vals(spark, ["Managing Director, Acme; Advisor, Foo, Director at Bar and CEO at Baz"], P.clauses) == [
        ["Managing Director, Acme", "Advisor, Foo", "Director at Bar", "CEO at Baz"]]


def test_relevance(spark):
    rows = [("Blue Tokai Coffee Roasters", "https://a.test", "Blue - Color", "", False), ("Blue Tokai Coffee Roasters", "https://a.test", "Blue Tokai Coffee Roasters", "", True),
            ('site:zaubacorp.com "Times Comtrade Private Limited"', "https://www.zaubacorp.com/x", "Times Comtrade Private Limited", "", True),
            ('site:zaubacorp.com "Times Comtrade Private Limited"', "https://www.zaubacorp.com/x", "Times Green Power", "", False),
            ("site:profiles.example/in Asha Rao", "https://profiles.example.evil.test/in/asha", "Asha Rao", "", False),
            ("site:profiles.example/in Asha Rao", "https://evil.test/profiles.example/in/asha", "Asha Rao", "", False),
            ("site:profiles.example/in Asha Rao", "https://profiles.example/industry/asha", "Asha Rao", "", False),
            ("site:profiles.example/in Asha Rao", "https://in.profiles.example/in/asha", "Asha Rao", "", True)]
    got = ev(spark, rows, "q string, u string, t string, s string, want boolean", t=F.col("t"), want=F.col("want"),
             ok=R.is_relevant(F.col("u"), F.col("t"), F.col("s"), R.query_constraints(F.col("q")), min_coverage=0.6))
    assert [r for r in got if r["ok"] != r["want"]] == []


def test_company_matching(spark):
    rows = [("TIMES COMTRADE", "TIMES GREEN POWER PRIVATE LIMITED", False), ("Times Comtrade Pvt Ltd", "TIMES COMTRADE PRIVATE LIMITED", True),
            ("Blue Tokai Cofee Roaster", "Blue Tokai Coffee Roasters Private Limited", True), ("India Services", "India Services Ltd", False)]
    got = ev(spark, rows, "a string, b string, want boolean", v=M.company_verdict(F.col("a"), F.col("b")), want=F.col("want"))
    assert [r["v"]["accepted"] for r in got] == [r["want"] for r in got]


def test_profile_score(spark):
    title = "Vinod Nahar - Chairman and Director - Plasmagen Biosciences Pvt. Ltd. | Profilenet"
    co, vn = "Plasmagen Biosciences Pvt Ltd", "Vinod Nahar"
    b = "https://in.profiles.example/in/"
    rows = [(b + "vinod-nahar", title, vn, co, "", True), (b + "vinod-n-8a4b21", title, vn, co, "", True), (b + "vn-472913", title, vn, co, "", True),
            (b + "vn-472913", "Dr. Vinod Nahar - Chairman - Plasmagen Biosciences | Profilenet", vn, co, "", True),
            (b + "rk-9182", "Rajesh Kumar Sharma - MD - Acme Foods | Profilenet", "Rajesh Kumar Sharma", "Acme Foods Ltd", "", True),
            (b + "vinod-x-1122", "Vinod Nahar - Founder - Unrelated Ltd | Profilenet", vn, co, "", False),
            (b + "vinod-gupta", "Vinod Gupta - CEO - Other Corp | Profilenet", vn, co, "", False),
            (b + "someone-else-99", "Top leaders at Plasmagen Biosciences: Vinod Nahar, Asha Rao | Profilenet", vn, co, "", False),
            ("https://www.profiles.example/company/plasmagen", title, vn, co, "", False),
            (b + "aj-77", "Arnav Jain | Profilenet", "Arnav Jain", co, "Experience: Plasmagen Biosciences.", True), (b + "aj-77", "Arnav Jain | Profilenet", "Arnav Jain", co, "", False)]
    got = ev(spark, rows, "u string, t string, p string, c string, s string, want boolean", u=F.col("u"), want=F.col("want"),
             ok=M.profile_score(F.col("u"), F.col("t"), F.col("p"), F.col("c"), F.col("s")) >= 10)
    assert [r for r in got if r["ok"] != r["want"]] == []


def test_small_helpers(spark):
    assert vals(spark, ["https://www.zaubacorp.com/X?y=1#d", "https://u:p@zaubacorp.com/", "ftp://zaubacorp.com/", "https://zaubacorp.com.evil.test/"],
                U.registry_source_url) == ["https://www.zaubacorp.com/X?y=1#d", None, None, None]
    assert vals(spark, ["https://in.profiles.example/in/asha-rao", "https://profiles.example/in/ab", "https://www.profiles.example/posts/asha", "https://profiles.example/in/x/posts/"],
                U.is_profile_url) == [True, False, False, False]
    assert vals(spark, ["https://in.profiles.example/in/Jos%C3%A9-X/", "https://a.test/"], U.profile_slug) == ["josé-x", ""]
    assert vals(spark, ["www.a.test/x", "https://www.a.test/x"], U.display_url) == ["a.test/x", "a.test/x"]
    assert vals(spark, ["a < b & c > d"], T.escape_html) == ["a &lt; b &amp; c &gt; d"]
    assert vals(spark, ["Asha Kumar Rao", "Asha Rao"], P.short_name) == ["Asha Rao", "Asha Rao"]
    assert vals(spark, ["Foo Bar Pvt Ltd", "Ltd"], T.brand_text) == ["foo bar", "ltd"]
