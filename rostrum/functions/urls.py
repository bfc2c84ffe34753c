"""Web-address expressions (Column -> Column).

Addresses are taken apart with plain regular expressions instead of
``parse_url`` so that an odd character never turns a usable address into NULL.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rostrum import vocab
from rostrum.functions.text import decode_entities, in_words, let

URL_RE = r"^(?i)(https?)://(?:[^/?#@]*@)?([^/?#:@\s]+)(?::(\d*))?(/[^?#]*)?(\?[^#]*)?(#.*)?$"
HOST_RE = r"^(?i)https?://(?:[^/?#@]*@)?([^/?#:@\s]+)(?:[:/?#].*)?$"
PATH_RE = r"^(?i)https?://[^/?#\s]+(/[^?#]*)"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, URL_RE, i)


def is_web(url: Column) -> Column:
    return url.rlike(URL_RE)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST_RE, 1))


def has_credentials(url: Column) -> Column:
    return url.rlike(r"^(?i)https?://[^/?#]*@")


def path(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(url, PATH_RE, 1), F.lit("")), F.lit("/"))


def origin(url: Column) -> Column:
    """Scheme and host, lower case, without user and default port."""
    base = F.lower(F.regexp_replace(F.regexp_extract(url, r"^(?i)(https?://[^/?#\s]+)", 1), "//[^@]*@", "//"))
    return F.regexp_replace(base, r"^(http://[^:]*):(?:80)?$|^(https://[^:]*):(?:443)?$", "$1$2")


def query_param(url: Column, name: str) -> Column:
    """Decoded value of the first parameter called ``name``; NULL when absent."""
    found = F.regexp_extract(url, rf"^[^?#]*\?(?:[^#]*&)??({name}(?:=[^&#]*)?)(?:[&#].*)?$", 1)
    return F.when(url.contains("?"), let(found, lambda f: F.when(f != "", F.try_url_decode(
        F.substring(f, len(name) + 2, 1 << 30)))))


def domain(url: Column) -> Column:
    """U1. Empty string when the address cannot be read."""
    return F.regexp_replace(host(F.coalesce(url, F.lit(""))), r"^www\.", "")


def domain_core(dom: Column) -> Column:
    """U2."""
    return let(F.filter(F.split(dom, r"\."), lambda x: x != ""), lambda p: _core(p, dom))


def _core(parts: Column, dom: Column) -> Column:
    n = F.size(parts)
    pair = F.concat_ws(".", F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1)))
    return (F.when(n <= 1, F.coalesce(F.try_element_at(parts, F.lit(1)), dom))
            .when((n >= 3) & in_words(pair, vocab.TWO_LABEL_SUFFIXES), F.try_element_at(parts, F.lit(-3)))
            .otherwise(F.try_element_at(parts, F.lit(-2))))


def strip_url(url: Column) -> Column:
    """U3."""
    flat = let(F.concat(origin(url), path(url)),
               lambda f: F.when(F.length(f) > 9, F.regexp_replace(f, "/$", "")).otherwise(f))
    return F.when(is_web(url) & ~host(url).rlike(vocab.ENGINE_HOST), flat)


def unwrap_url(href: Column) -> Column:
    """U4. Redirect wrappers of the known engines, then ``strip_url``."""
    return let(let(decode_entities(href), _unwrapped), strip_url)


def _unbase64(c: Column) -> Column:
    bare = F.regexp_replace(F.translate(c, "-_", "+/"), "=+$", "")
    padded = let(bare, lambda b: F.rpad(b, (F.ceil(F.length(b) / 4) * 4).cast("int"), F.lit("=")))
    return F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))


def _unwrapped(clean: Column) -> Column:
    ru = F.try_url_decode(F.regexp_extract(clean, "/RU=([^/]+)", 1))
    u = query_param(clean, "u")
    opened = F.when(u.rlike("^a1[A-Za-z0-9+/=_-]+$"), _unbase64(F.substring(u, 3, 1 << 30)))
    web = r"^(?i)https?://"
    generic = [query_param(clean, k) for k in ("url", "q", "target")]
    wrapped = F.coalesce(*[F.when(g.rlike(web), g) for g in generic])
    # an address of an engine itself is refused by ``strip_url``
    return (F.when(ru.rlike(web), ru)
            .when(query_param(clean, "uddg").isNotNull(), query_param(clean, "uddg"))
            .when(opened.rlike(web), opened)
            .otherwise(F.coalesce(wrapped, clean)))


def _without_tracking(url: Column) -> Column:
    q = F.regexp_replace(_part(url, 5), r"^\?", "")
    kept = F.filter(F.split(q, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).rlike(vocab.TRACKING_PARAM))
    return let(F.array_join(kept, "&"), lambda k: F.when(k == "", "").otherwise(F.concat(F.lit("?"), k)))


def result_url(href: Column, base: Column | None = None) -> Column:
    """U5. Keeps path case and meaningful parameters; NULL when unusable."""
    url = resolve(href, base) if base is not None else href

    def target(x: Column) -> Column:
        h, u = host(x), query_param(x, "u")
        opened = let(u, lambda v: F.when(v.startswith("a1"), _unbase64(F.substring(v, 3, 1 << 30))).otherwise(v))
        return (F.when(~h.rlike(vocab.REDIRECT_HOST), x)
                .when(h.rlike(r"(?:^|\.)duckduckgo\.com$") & query_param(x, "uddg").isNotNull(), query_param(x, "uddg"))
                .when(h.rlike(r"(?:^|\.)google\.com$") & (path(x) == "/url"),
                      F.coalesce(F.nullif(query_param(x, "q"), F.lit("")), query_param(x, "url")))
                .when(h.rlike(r"(?:^|\.)bing\.com$") & (path(x) == "/ck/a"), opened)
                .otherwise(x))

    def tidy(x: Column) -> Column:
        ok = is_web(x) & ~has_credentials(x) & ~host(x).rlike(vocab.REDIRECT_HOST)
        return F.when(ok, F.concat(origin(x), path(x), _without_tracking(x)))

    return let(let(url, target), tidy)


def merge_key(url: Column) -> Column:
    """U13."""
    profile = F.concat(F.lit(vocab.PROFILE_HOST), F.lower(F.regexp_replace(path(url), "/$", "")))
    return (F.when(host(url).rlike(rf"(?:^|\.){vocab.PROFILE_HOST_RE}$"), profile)
            .otherwise(F.regexp_replace(url, "/$", "")))


def is_blocked_host(url: Column) -> Column:
    """U6. Whole hosts and whole labels only; unreadable addresses are blocked."""
    return let(domain(url), is_blocked_domain)


def is_blocked_domain(dom: Column) -> Column:
    """U6 on a U1 result.  Last labels of an ASCII domain are looked up; ``$`` also
    stands before a line separator beyond ASCII, which is left to the pattern."""
    hosts = "|".join(h.replace(".", r"\.") for h in vocab.BLOCKED_HOSTS)
    labels = rf"(?:^|\.)(?:{'|'.join(vocab.BLOCKED_LABELS)})(?:\.|$)"
    listed = dom == ""
    for dots in sorted({h.count(".") for h in vocab.BLOCKED_HOSTS}):
        listed |= F.substring_index(dom, ".", -dots - 1).isin([h for h in vocab.BLOCKED_HOSTS if h.count(".") == dots])
    return F.when(F.length(dom) == F.octet_length(dom), listed | dom.rlike(labels)).otherwise(dom.rlike(rf"^$|(?:^|\.)(?:{hosts})$|{labels}"))


def brand_forms(brand: Column) -> Column:
    """What U7 compares of S6 tokens -> STRUCT<words, joined, acronym>."""
    return F.struct(brand.alias("words"), F.array_join(brand, "").alias("joined"),
                    F.array_join(F.transform(brand, lambda t: F.substring(t, 1, 1)), "").alias("acronym"))


def domain_score(core: Column, brand: Column) -> Column:
    """U7 -> STRUCT<score, kind>."""
    return domain_score_of(core, brand_forms(brand))


def domain_score_of(core: Column, forms: Column) -> Column:
    """U7 on forms that are already worked out, as once for all hits of a company."""
    return let({"core": core, "forms": forms}, lambda x: _domain_score(x["core"], x["forms"]))


def _domain_score(core: Column, forms: Column) -> Column:
    brand, joined, acronym = forms["words"], forms["joined"], forms["acronym"]
    hit = F.filter(brand, lambda t: (F.length(t) >= 3) & core.contains(t))

    def cut_first(left: Column, t: Column) -> Column:
        at = F.instr(left, t)
        return F.when(at == 0, left).otherwise(
            F.concat(left.substr(F.lit(1), at - 1), left.substr(at + F.length(t), F.length(left))))

    n = F.size(brand)

    def by_words(x: Column) -> Column:
        n_hit, rest = x["n"], x["rest"]
        partial = (n_hit * 5 + F.when(n_hit == n, 5).otherwise(0)
                   - F.when(rest >= 4, 8).when(rest >= 2, 2).otherwise(0))
        return F.when(n_hit == 0, out(-6, "none")).otherwise(out(partial, F.concat(
            F.lit("partial("), n_hit.cast("string"), F.lit("/"), n.cast("string"), F.lit(")"))))

    n_acr = F.length(acronym)

    def out(score, kind):
        score = F.lit(score) if isinstance(score, int) else score
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(score.cast("int").alias("score"), kind.alias("kind"))

    return (F.when(core == joined, out(18, "exact"))
            .when((n >= 2) & (core == acronym), out(14, "acronym"))
            .when((n_acr >= 3) & core.startswith(acronym) & (F.length(core) <= n_acr + 2),
                  out(12, "acronym-prefix"))
            .when(joined.startswith(core) & (F.length(core) >= 4), out(13, "prefix"))
            .when(core.startswith(joined), out(12, "startswith"))
            .otherwise(let(hit, lambda h: let(
                {"n": F.size(h), "rest": F.length(F.aggregate(h, core, cut_first))}, by_words))))


def profile_slug(url: Column) -> Column:
    """U9."""
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    return F.lower(F.coalesce(F.try_url_decode(F.try_element_at(parts, F.lit(2))), F.lit("")))


def is_profile_url(url: Column) -> Column:
    """U8."""
    low = F.lower(F.coalesce(url, F.lit("")))
    bad = "|".join(vocab.NON_PROFILE_PATHS)
    return (low.rlike(rf"^https?://(?:[a-z]{{2,3}}\.)?{vocab.PROFILE_HOST_RE}/(?:in|pub)/[^/]+")
            & ~low.rlike(bad) & (F.length(profile_slug(url)) >= 3))


def canonical_profile_url(raw: Column) -> Column:
    """U10. Empty string when it is not a profile address."""
    url = F.when(raw.rlike("^/[^/]"), F.concat(F.lit(f"https://www.{vocab.PROFILE_HOST}"), raw)).otherwise(raw)
    slug = F.regexp_extract(path(url), r"^(?i)/in/([^/]+)/?$", 1)
    decoded = F.try_url_decode(slug)
    ok = (is_web(url) & ~has_credentials(url) & host(url).rlike(rf"(?:^|\.){vocab.PROFILE_HOST_RE}$")
          & (F.regexp_extract(url, URL_RE, 3) == "") & (slug != "")
          & decoded.isNotNull() & ~decoded.rlike(r"[\\/\s?#]"))
    return F.when(ok, F.concat(F.lit(f"https://www.{vocab.PROFILE_HOST}/in/"), slug)).otherwise("")


_REG_ID = r"[A-Za-z][A-Za-z0-9-]{7,30}"
_REG_NAME = r"[A-Za-z0-9&'.\-%]+"


#: An address as the registry itself prints it, which is its own canonical form.
_CIN_CHARS = 21
_REG_PLAIN = rf"^https://www\.{vocab.REGISTRY_HOST.replace('.', chr(92) + '.')}/[A-Z0-9]+(?:-[A-Z0-9]+)*-[A-Z]\d{{5}}[A-Z]{{2}}\d{{4}}[A-Z]{{3}}\d{{6}}\z"


def registry_record(url: Column) -> Column:
    """U11 -> STRUCT<url, cin, name> or NULL.  A canonical address is only cut."""
    head = len(f"https://www.{vocab.REGISTRY_HOST}/")
    name = F.translate(url.substr(F.lit(head + 1), F.length(url) - (head + _CIN_CHARS + 1)), "-", " ")
    plain = F.struct(url.alias("url"), F.right(url, F.lit(_CIN_CHARS)).alias("cin"), name.alias("name"))
    return F.when(url.rlike(_REG_PLAIN), plain).otherwise(let(url, _registry_record))


def _registry_record(url: Column) -> Column:
    new, old = rf"^/({_REG_NAME})-({_REG_ID})/?$", rf"^(?i)/company/({_REG_NAME})/({_REG_ID})/?$"

    def cut(p: Column) -> Column:
        modern = p.rlike(new)
        return F.struct(F.when(modern, F.regexp_extract(p, new, 1)).otherwise(F.regexp_extract(p, old, 1)).alias("slug"),
                        F.when(modern, F.regexp_extract(p, new, 2)).otherwise(F.regexp_extract(p, old, 2)).alias("ident"))

    def build(x: Column) -> Column:
        valid = x["ident"].rlike(r"^(?:[A-Za-z]\d{5}[A-Za-z]{2}\d{4}[A-Za-z]{3}\d{6}|[A-Za-z]{3}-?\d{4})$")
        return F.when(valid & x["name"].isNotNull() & (x["name"] != ""), F.struct(
            F.concat(F.lit(f"https://www.{vocab.REGISTRY_HOST}/"), F.upper(x["name"]), F.lit("-"), F.upper(x["ident"])).alias("url"),
            F.upper(x["ident"]).alias("cin"),
            F.trim(F.regexp_replace(x["name"], r"[-\s]+", " ")).alias("name")))

    parts = let(path(url), lambda p: let(cut(p), lambda x: F.struct(
        F.try_url_decode(F.replace(x["slug"], F.lit("+"), F.lit("%2B"))).alias("name"), x["ident"].alias("ident"))))
    return F.when(domain(url) == vocab.REGISTRY_HOST, let(parts, build))


def registry_source_url(v: Column) -> Column:
    """U12."""
    ok = is_web(v) & ~has_credentials(v) & host(v).rlike(r"(?:^|\.)zaubacorp\.com$")
    return F.when(ok, F.concat(origin(v), path(v), _part(v, 5), _part(v, 6)))


def display_url(u: Column, width: int = 48) -> Column:
    """U14."""
    full = F.when(u.rlike(r"^(?i)https?://"), u).otherwise(F.concat(F.lit("https://"), u))
    return F.substring(F.regexp_replace(full, r"^(?i)https?://(?:www\.)?", ""), 1, width)


def resolve(href: Column, base: Column) -> Column:
    """U15 first half: absolute form of a link, dot segments folded."""
    return let(_joined(href, base), _folded)


def _joined(href: Column, base: Column) -> Column:
    scheme = F.regexp_extract(base, r"^([A-Za-z]+):", 1)
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    return (F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
              .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
              .when(href.startswith("/"), F.concat(origin(base), href))
              .when(href.startswith("?"), F.concat(origin(base), path(base), href))
              .when(href.startswith("#"), F.concat(origin(base), path(base), _part(base, 5), href))
              .when(href == "", base)
              .otherwise(F.concat(origin(base), folder, href)))


def _folded(url: Column) -> Column:
    def step(acc: Column, seg: Column) -> Column:
        return (F.when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
                .when(seg == ".", acc).otherwise(F.concat(acc, F.array(seg))))

    segs = F.split(F.regexp_replace(path(url), "^/", ""), "/")
    flat = F.concat(F.lit("/"), F.array_join(F.aggregate(segs, F.expr("cast(array() as array<string>)"), step), "/"))
    dotted = path(url).rlike(r"/\.\.?(?:/|$)")
    return F.when(is_web(url) & dotted, F.concat(origin(url), flat, _part(url, 5), _part(url, 6))).otherwise(url)


def page_link(href: Column, base: Column) -> Column:
    """U15. Same-site document link without fragment; NULL when not usable."""
    usable = ~((href == "") | href.startswith("javascript:") | href.startswith("#"))

    def check(url: Column) -> Column:
        p = path(url)
        home = p.rlike(r"^/?(?:/index\.(?:php|html?)/?)?$")
        ok = usable & is_web(url) & (domain(url) == domain(base)) & ~p.rlike(f"(?i){vocab.DOCUMENT_PATH}") & ~home
        return F.when(ok, F.concat(origin(url), p, _part(url, 5)))

    return let(resolve(href, base), check)
