import re

from rostrum.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    wins = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    rep = {j for i, x in enumerate(wins) if wins.count(x) > 1 for j in range(i, i + 3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep))


TEXTS = [None, "", " \t\n", "a", "a a", "a a a", "a a a a b", "x y z\nx y z\n\n x y z \nq", "é ß 🙂 é ß 🙂", "# | <a> $5 &amp; 5% *b*\x0b\x0cend",
         "a b c d a b c e a b", "line\r\nline\r\n", "The end of it. " * 40, " ".join(f"w{i}" for i in range(3000)), "    x"]


def test_same_as_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS)] + [(None, "a", "k"), (3, "a", "k")], "doc_id long, text string, words string")
    got = quality_rules.measured(docs).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        t = TEXTS[r.doc_id] if r.doc_id is not None else "a"
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t
    assert quality_rules.measured(docs.where("false")).count() == 0


def test_rules(spark):
    good = "\n".join(f"The way{i} to town{i} is by road{i} of stone{i} and it{i} was long{i} number{i * i}" for i in range(10))
    cases = {0: (good, []), 1: (None, ["words", "stop_words"]), 2: (good.replace(" of ", " ############ "), ["symbols"]),
             3: ("\n".join([good.split("\n")[0]] * 9), ["repeated_lines", "repeated_words"]),
             4: (" ".join(f"zq{i}" for i in range(60)), ["stop_words"]), 5: ("\n".join("- " + x + "..." for x in good.split("\n")), ["bullet_lines", "cut_lines"])}
    docs = spark.createDataFrame([(i, t) for i, (t, _) in cases.items()], "doc_id long, text string")
    for r in quality_rules.judged(quality_rules.measured(docs)).collect():
        assert r.broken_rules == cases[r.doc_id][1] and r.passes == (not r.broken_rules), r
