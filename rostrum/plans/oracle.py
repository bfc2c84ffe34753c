"""The same results in plain SQL, for checking with another engine."""
from __future__ import annotations

from rostrum import vocab
from rostrum.plans.inputs import with_views

ORACLE: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = with_views(sql)


def lst(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def arr(words) -> str:
    return "[" + lst(words)[1:-1] + "]"


def alt(words) -> str:
    return "|".join(w.replace(".", r"\.").replace(" ", r"\s+") for w in words)


# --- expressions ----------------------------------------------------------------------
def squash(x):
    return f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


def host(u):
    return f"lower(regexp_extract({u}, '^https?://([^/?#:@]+)', 1))"


def domain(u):
    return f"regexp_replace({host(u)}, '^www\\.', '')"


def path(u):
    return f"coalesce(nullif(regexp_extract({u}, '^https?://[^/?#]+(/[^?#]*)', 1), ''), '/')"


def origin(u):
    return f"regexp_extract({u}, '^(https?://[^/?#]+)', 1)"


def strip(u):
    return (f"CASE WHEN NOT regexp_matches({host(u)}, '{vocab.ENGINE_HOST}') THEN regexp_replace({origin(u)} || {path(u)}, '/$', '') END")


def result(u):
    q = f"list_filter(string_split(regexp_extract({u}, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(split_part(p, '=', 1)), '{vocab.TRACKING_PARAM}'))"
    return f"{origin(u)} || {path(u)} || CASE WHEN len({q}) = 0 THEN '' ELSE '?' || array_to_string({q}, '&') END"


def merge_key(u):
    return (f"CASE WHEN regexp_matches({host(u)}, '(^|\\.)profiles\\.example$') THEN 'profiles.example' || lower(regexp_replace({path(u)}, '/$', '')) "
            f"ELSE regexp_replace({u}, '/$', '') END")


def core(d):
    parts = f"string_split({d}, '.')"
    pair = f"{parts}[-2] || '.' || {parts}[-1]"
    return f"CASE WHEN len({parts}) <= 1 THEN {d} WHEN len({parts}) >= 3 AND {pair} IN {lst(vocab.TWO_LABEL_SUFFIXES)} THEN {parts}[-3] ELSE {parts}[-2] END"


def blocked(d):
    hosts = "|".join(h.replace(".", r"\.") for h in vocab.BLOCKED_HOSTS)
    return f"({d} = '' OR regexp_matches({d}, '(^|\\.)({hosts})$') OR regexp_matches({d}, '(^|\\.)({'|'.join(vocab.BLOCKED_LABELS)})(\\.|$)'))"


def clean(x):
    return squash(f"regexp_replace(strip_accents(lower({x})), '[^a-z0-9_\\s&]', ' ', 'g')")


def searched(x):
    return f"trim(regexp_replace({squash(x)}, '(?i)\\s+(?:[-|]\\s*)?{vocab.LIST_LABEL}$', ''))"


def _cut(x, suffixes):
    return f"regexp_replace({clean(searched(x))}, '(?:\\s+(?:{alt(sorted(suffixes, key=len, reverse=True))}))+$', '')"


def key(x):
    s = _cut(x, vocab.LEGAL_SUFFIXES + vocab.DESCRIPTIVE_SUFFIXES)
    return f"array_to_string(list_filter(string_split({s}, ' '), lambda t: t <> '' AND t NOT IN {lst(vocab.NAME_STOPWORDS)}), ' ')"


def brand(x):
    s = _cut(x, vocab.LEGAL_SUFFIXES + vocab.BRAND_ONLY_SUFFIXES)
    return f"list_filter(string_split({s}, ' '), lambda t: t <> '' AND t NOT IN {lst(vocab.NAME_STOPWORDS + ['&'])})"


def brand_text(x):
    return f"coalesce(nullif(array_to_string({brand(x)}, ' '), ''), {x})"


def singular(t):
    return (f"CASE WHEN length({t}) <= 3 THEN {t} WHEN regexp_matches({t}, '[^aeiou]ies$') THEN left({t}, length({t}) - 3) || 'y' "
            f"WHEN regexp_matches({t}, '(ses|xes|zes|ches|shes)$') THEN left({t}, length({t}) - 2) WHEN regexp_matches({t}, '[^s]s$') THEN left({t}, length({t}) - 1) ELSE {t} END")


def comparable(x):
    b = f"list_transform({brand(x)}, lambda t: regexp_replace(t, '[^a-z0-9]', '', 'g'))"
    return f"list_transform(list_filter({b}, lambda t: t <> '' AND t NOT IN {lst(vocab.EXTRA_LEGAL_TOKENS)}), lambda t: {singular('t')})"


NON_NAMES = lst(vocab.non_name_words())


def words(x):
    return f"list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^a-z\\s]', ' ', 'g'), '\\s+'), lambda t: length(t) >= 3 AND t NOT IN {NON_NAMES})"


ROLE = rf"(?i)\b(?:{alt(vocab.ROLE_KEYWORDS)})s?\b"
SENIOR = rf"(?i)\b(?:{vocab.SENIOR_ROLE})\b"


def roles(x):
    return f"regexp_extract_all({x}, '{ROLE}')"


def covered(x):
    return f"coalesce(list_sum(list_transform({roles(x)}, lambda m: length(m))), 0)"


def quality(x):
    return f"CASE WHEN trim({x}) = '' THEN -1 WHEN {covered(x)} = 0 THEN 0 ELSE {covered(x)} * 3 - length(trim({x})) END"


def name_key(x):
    return f"array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace(lower({x}), '[^a-z ]', '', 'g'), ' '), lambda t: length(t) > 1))), '-')"


def bare(t):
    return f"regexp_replace(lower({t}), '[^a-z]', '', 'g')"


def norm_role(x):
    """Expected form of the fixed role words used in the inputs."""
    return f"CASE WHEN lower({x}) = 'whole-time director' THEN 'Whole-Time Director' ELSE {x} END"


def slug(u):
    return f"lower(coalesce(string_split(ltrim({path(u)}, '/'), '/')[2], ''))"


def is_profile(u):
    return (f"(regexp_matches(lower({u}), '^https?://([a-z]{{{{2,3}}}}\\.)?profiles\\.example/(in|pub)/[^/]+') AND NOT regexp_matches(lower({u}), '{'|'.join(vocab.NON_PROFILE_PATHS)}') "
            f"AND length({slug(u)}) >= 3)")


CLEAN_CTE = r"""
c0 AS (SELECT id, company, trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '\(.*?\)', ' ', 'g'), '\[.*?\]', ' ', 'g'),
  '(?i)\bDIN\s*[:\-]?\s*\d+', ' ', 'g'), '\s+', ' ', 'g')), '^[^A-Za-z]+', ''), '[^A-Za-z.''’\-]+$', '')) AS n FROM src),
c1 AS (SELECT id, company, list_filter(string_split(n, ' '), lambda t: t <> '') AS toks FROM c0),
c2 AS (SELECT id, company, toks, coalesce(list_position(list_transform(toks, lambda t: @BARE@ IN @HON@), false), 0) AS f FROM c1),
c3 AS (SELECT id, company, CASE WHEN f = 0 THEN toks[greatest(len(toks), 1):] ELSE toks[f:] END AS toks FROM c2),
c4 AS (SELECT id, company, toks, coalesce(list_position(list_transform(list_reverse(toks), lambda t: @BARE@ = '' OR @BARE@ IN @STOP@), false), 0) AS f FROM c3),
c5 AS (SELECT id, company, CASE WHEN f = 0 THEN toks[1:least(len(toks), 1)] ELSE toks[1:len(toks) - f + 1] END AS toks FROM c4),
c6 AS (SELECT id, company, CASE WHEN len(toks) >= 2 AND len(toks) % 2 = 0 AND lower(array_to_string(toks[1:len(toks) // 2], ' ')) = lower(array_to_string(toks[len(toks) // 2 + 1:], ' '))
  THEN toks[1:len(toks) // 2] ELSE toks END AS toks FROM c5),
cleaned AS (SELECT id, company, trim(regexp_replace(array_to_string(toks, ' '), '[\-–—,;:.]+$', '')) AS name FROM c6)
""".replace("@BARE@", bare("t")).replace("@HON@", lst(vocab.HONORIFICS)).replace("@STOP@", lst(vocab.TRAILING_JOINERS + vocab.ROLE_FRAGMENTS)).replace("{", "{{").replace("}", "}}")

_BANNED = lst(vocab.non_name_words() + vocab.HONORIFICS + vocab.ROLE_FRAGMENTS)
VALID_CTE = r"""
p1 AS (SELECT id, company, name, string_split(name, ' ') AS toks FROM cleaned),
p2 AS (SELECT id, company, name, toks, list_transform(toks, lambda t, i: struct_pack(t := t, b := regexp_replace(lower(t), '[^a-z'']', '', 'g'), mid := i > 1 AND i < len(toks))) AS info FROM p1),
p3 AS (SELECT id, company, name, toks, list_transform(info, lambda x: struct_pack(inner_ := x.b IN @PART@ AND x.mid,
   ok := x.b <> '' AND ((x.b IN @PART@ AND x.mid) OR (regexp_matches(x.t, @SHAPE@) AND x.b NOT IN @BANNED@)),
   real_ := CASE WHEN (x.b IN @PART@ AND x.mid) OR regexp_matches(x.t, '^(?:[A-Z]\.){1,3}$') OR length(x.b) < 2 THEN 0 ELSE length(x.b) END)) AS info FROM p2),
valid AS (SELECT id, company, name, coalesce(length(name) BETWEEN 5 AND 50 AND NOT regexp_matches(name, '[0-9@#$%^*_=+<>{}\[\]/\\|~`"]') AND NOT regexp_matches(name, @ROLE@)
   AND len(toks) BETWEEN 2 AND 5 AND len(list_filter(info, lambda x: NOT x.ok)) = 0
   AND (len(list_filter(info, lambda x: x.real_ > 0)) >= 2 OR (len(list_filter(info, lambda x: x.real_ > 0)) = 1 AND len(list_filter(info, lambda x: x.real_ >= 3)) = 1
        AND len(list_filter(info, lambda x: NOT x.inner_ AND x.real_ = 0)) > 0))
   AND NOT (len(@WORDS@) > 0 AND (list_contains(@WORDS@, @FIRST@) OR len(list_filter(toks, lambda t: NOT list_contains(@WORDS@, @BARE@))) = 0)), false) AS valid FROM p3)
""".replace("@PART@", lst(vocab.NAME_PARTICLES)).replace("@BANNED@", _BANNED).replace("@ROLE@", f"'{ROLE}'").replace("@WORDS@", words("company")).replace(
    "@FIRST@", bare("toks[1]")).replace("@BARE@", bare("t")).replace(
    "@SHAPE@", r"'^(?:[A-Z][A-Za-z''’\-]*\.?|(?:[A-Z]\.){1,3}|[A-Z]\.?|[A-Z]{2,})$'").replace("{", "{{").replace("}", "}}")


def esc(s: str) -> str:
    """Braces of a finished expression, protected from view substitution."""
    return s.replace("{", "{{").replace("}", "}}")


# --- addresses ------------------------------------------------------------------------------
oracle("url_canonical", f"""SELECT page_id, {result('url')} AS result_url, {strip('url')} AS plain_url, {domain('url')} AS domain,
  {merge_key('r')} AS merge_key, substr(regexp_replace(url, '^https?://(www\\.)?', ''), 1, 48) AS shown FROM (SELECT *, {result('url')} AS r FROM {{pages}})""")
oracle("url_unwrap", f"SELECT page_id, {strip('url')} AS url FROM {{pages}}")
oracle("domain_core_rollup", f"""SELECT {core('d')} AS core, {blocked('d')} AS blocked, count(*) AS pages, count(DISTINCT d) AS domains
  FROM (SELECT {domain('url')} AS d FROM {{pages}}) GROUP BY 1, 2""")
oracle("host_variants", f"""WITH f AS (SELECT page_id, [url, 'https://www.' || d || '/', 'https://' || d || '/', 'http://www.' || d || '/'] AS l FROM (SELECT page_id, url, {domain('url')} AS d FROM {{pages}})),
  g AS (SELECT page_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM f)
  SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS variant_no, unnest(l) AS variant_url FROM g""")

# --- results -----------------------------------------------------------------------------------
_MERGED = f"""n AS (SELECT query_id, pos, {result('url')} AS url, {squash('title')} AS title, {squash('snippet')} AS snippet, source FROM {{v_result}}),
k AS (SELECT *, {merge_key('url')} AS mk FROM n),
m AS (SELECT query_id, mk, arg_min(url, pos) AS url, arg_max(title, struct_pack(a := length(title), b := -pos)) AS title,
  coalesce(list_reduce(list(snippet ORDER BY pos) FILTER (WHERE snippet <> ''), lambda acc, s: CASE WHEN contains(acc, s) THEN acc ELSE trim(acc || ' ' || s) END), '') AS snippet,
  list(source ORDER BY pos) AS src, min(pos) AS first_pos FROM k GROUP BY query_id, mk)"""
oracle("result_merge", f"""WITH {_MERGED} SELECT query_id, url, title, snippet, array_to_string(list_filter(src, lambda x, i: list_position(src, x) = i), ',') AS sources, first_pos FROM m""")
_CRUMB = r"(?i)^.{{0,90}}?https?://\S+(?:\s*[›»>]\s*[^\s›»>]+)*\s*"


def title_clean(x):
    return squash(f"regexp_replace(coalesce({x}, ''), '{_CRUMB}', '')")


oracle("result_merge_fuller_title", f"""WITH n AS (SELECT query_id, pos, lower({strip('url')}) AS url, {title_clean('title')} AS title, {title_clean('snippet')} AS snippet FROM {{v_result}}),
  w AS (SELECT *, len(list_filter(string_split(title, ' '), lambda t: t <> '')) AS words FROM n WHERE url IS NOT NULL)
  SELECT query_id, url, arg_max(title, struct_pack(a := words, b := length(title), c := -pos)) AS title,
  coalesce(list_reduce(list(snippet ORDER BY pos) FILTER (WHERE snippet <> ''), lambda acc, s: CASE WHEN contains(acc, s) THEN acc WHEN contains(s, acc) THEN s ELSE acc || ' ' || s END), '') AS snippet,
  min(pos) AS first_pos FROM w GROUP BY query_id, url""")
_QTOK = f"list_filter(regexp_split_to_array(regexp_replace(lower(replace(q, '\"', ' ')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda t: length(t) >= 3 AND t NOT IN {lst(vocab.QUERY_STOPWORDS)})"
oracle("relevance_filter", f"""WITH q AS (SELECT query_id, {_QTOK} AS toks, regexp_extract_all(q, '"([^"]+)"', 1) AS phrases FROM {{v_query}}),
  h AS (SELECT r.query_id, pos, source, toks, phrases, lower(url || ' ' || title || ' ' || snippet) AS hay FROM {{v_result}} r JOIN q USING (query_id)),
  s AS (SELECT *, len(list_filter(toks, lambda t: contains(hay, t) OR contains(regexp_replace(hay, '[^a-z0-9]', '', 'g'), t))) AS hits FROM h)
  SELECT query_id, pos, source FROM s WHERE len(toks) = 0 OR (hits > 0 AND hits / len(toks) >= CASE WHEN source = 'b' THEN 0.6 ELSE 0.3 END)""")
oracle("accepted_first_topn", f"""WITH {_MERGED}, r AS (SELECT *, contains(snippet, 'the') AS accepted, row_number() OVER (PARTITION BY query_id ORDER BY contains(snippet, 'the') DESC, first_pos) AS position FROM m)
  SELECT query_id, CAST(position AS INT) AS position, url, accepted FROM r WHERE position <= 5""")
oracle("search_response", f"""WITH {_MERGED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_pos) AS position FROM m)
  SELECT query_id, CAST(count(*) AS INT) AS num, arg_min(url, position) AS first_link, arg_min(title, position) AS first_title FROM r WHERE position <= 10 GROUP BY query_id""")
_STOP = """f AS (SELECT query_id, url, min(variant_no) AS v FROM {v_variant_hit} @W@ GROUP BY 1, 2), p AS (SELECT query_id, v, count(*) AS n FROM f GROUP BY 1, 2),
  c AS (SELECT query_id, v, sum(n) OVER (PARTITION BY query_id ORDER BY v) AS seen FROM p), s AS (SELECT query_id, min(v) AS stop FROM c WHERE seen >= @K@ GROUP BY 1),
  kept AS (SELECT h.* FROM {v_variant_hit} h LEFT JOIN s USING (query_id) WHERE stop IS NULL OR variant_no <= stop)"""
oracle("variant_early_stop", f"""WITH {_STOP.replace('@W@', 'WHERE accepted').replace('@K@', '2')},
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY accepted DESC, CASE WHEN accepted THEN 0 ELSE length(title || ' ' || snippet) END DESC, variant_no, pos) AS rn FROM kept)
  SELECT query_id, url, variant_no, pos, accepted FROM r WHERE rn = 1""")
oracle("variant_stop_any", f"""WITH {_STOP.replace('@W@', '').replace('@K@', '5')} SELECT query_id, count(*) AS rows_kept, max(variant_no) AS last_variant FROM kept GROUP BY 1""")
oracle("longest_snippet", "SELECT url, arg_max(pos, struct_pack(a := length(snippet), b := -pos)) AS pos, arg_max(snippet, struct_pack(a := length(snippet), b := -pos)) AS snippet FROM {v_profile_hit} GROUP BY url")
oracle("request_checks", """SELECT conv_id, turn, CASE WHEN trim(text) = '' OR length(text) > 1000 THEN 'q must contain 1 to 1000 characters'
  WHEN turn * 13 NOT BETWEEN 1 AND 50 THEN 'num must be an integer from 1 to 50' WHEN turn % 2 <> 0 THEN 'unsupported parameter' END AS error FROM {conversations}""")

# --- input lists ---------------------------------------------------------------------------------
_ROWS = f"""r AS (SELECT row_no, {squash('company')} AS company, {squash('person')} AS person, {squash('role')} AS role FROM {{v_sheet}}),
  u AS (SELECT row_no, company, CASE WHEN length(person) BETWEEN 2 AND 150 AND NOT regexp_matches(lower(person), '^(null|n/?a|not found)$') THEN person END AS person, role FROM r WHERE length(company) BETWEEN 2 AND 150),
  s AS (SELECT row_no, company, person, CASE WHEN person IS NOT NULL THEN role END AS role FROM u)"""
oracle("input_header_ingest", f"WITH {_ROWS} SELECT * FROM s")
_GROUP = f"""{_ROWS}, names AS (SELECT lower(company) AS company_key, arg_min(company, row_no) AS company_name, max(person) IS NOT NULL AS has FROM s GROUP BY 1),
  people AS (SELECT lower(company) AS company_key, lower(person) AS person_key, min(row_no) AS pos, arg_min(person, row_no) AS person_name,
    coalesce(arg_min(role, row_no) FILTER (WHERE role <> ''), '') AS designation FROM s GROUP BY 1, 2),
  grouped AS (SELECT company_key, company_name, person_key, pos, person_name, CASE WHEN person_key IS NOT NULL THEN designation END AS designation FROM people JOIN names USING (company_key) WHERE person_key IS NOT NULL OR NOT has)"""
oracle("company_group_people", f"WITH {_GROUP} SELECT * FROM grouped")
oracle("supplied_people", f"""WITH {_GROUP} SELECT company_key, company_name, CAST(row_number() OVER (PARTITION BY company_key ORDER BY pos) - 1 AS INT) AS person_pos, person_name, designation
  FROM grouped WHERE person_key IS NOT NULL""")

# --- names ------------------------------------------------------------------------------------------
oracle("company_keys", f"""WITH k AS (SELECT company_id, {key('company_name')} AS key, array_to_string({brand('company_name')}, ' ') AS brand, array_to_string({comparable('company_name')}, ' ') AS comparable,
  array_to_string({words('company_name')}, ' ') AS words, {key('p_name')} AS other FROM {{v_company}}),
  s AS (SELECT *, list_distinct(string_split(key, ' ')) AS a, list_distinct(string_split(other, ' ')) AS b FROM k)
  SELECT company_id, key, brand, comparable, words, CASE WHEN key = '' OR other = '' THEN false WHEN key = other THEN true
    ELSE len(list_intersect(a, b)) >= 1 AND len(list_intersect(a, b)) / least(len(a), len(b)) >= 0.8 END AS same FROM s""")
_PQ = {
    "site": ["'\"' || b || '\" official website'", "'\"' || b || '\" company official site'", "n || ' official website'", "n || ' homepage'"],
    "registry": ["'site:zaubacorp.com \"' || s || '\"'", "'site:zaubacorp.com \"' || b || '\"'", "'zaubacorp \"' || n || '\" directors'", "'zaubacorp ' || b || ' company directors'"],
    "profile": ["p || ' ' || n", "p || ' ' || s", "b || ' ' || p || ' Profilenet'", "'site:profiles.example/in \"' || p || '\" \"' || b || '\"'", "'site:profiles.example/in ' || p || ' ' || b",
                "'site:profiles.example/in \"' || p || '\" ' || b", "'\"' || p || '\" ' || b || ' profilenet'", "'\"' || p || '\" \"' || b || '\" profilenet profile'",
                "'site:profiles.example/in \"' || p || '\" ' || d", "'\"' || p || '\" \"' || d || '\" ' || b || ' profilenet profile'", "'\"' || p || '\" profiles.example/in ' || b", "'site:profiles.example/in \"' || p || '\"'"],
    "verify": ["p || ' ' || n", "p || ' ' || s", "sh || ' ' || s", "b || ' ' || p || ' Profilenet'", "b || ' ' || sh || ' Profilenet'", "'site:profiles.example/in \"' || p || '\" \"' || b || '\"'",
               "'site:profiles.example/in \"' || sh || '\" \"' || b || '\"'", "'site:profiles.example/in ' || p || ' ' || b", "'site:profiles.example/in ' || sh || ' ' || b",
               "'\"' || sh || '\" ' || b || ' ' || coalesce(d, 'Director') || ' Profilenet'", "'\"' || sh || '\" \"' || n || '\" Profilenet'", "'site:profiles.example/in \"' || p || '\"'", "'site:profiles.example/in \"' || sh || '\"'"],
    "titles": ["'site:profiles.example/in \"' || n || '\" (director OR founder OR CEO OR chairman)'", "'site:profiles.example/in \"' || n || '\" \"managing director\"'", "'site:profiles.example/in \"' || n || '\" founder'"],
    "snippets": ["'\"' || b || '\" \"managing director\" OR \"chief executive officer\"'", "'\"' || b || '\" board of directors names'", "'\"' || b || '\" leadership team chairman founder'"],
    "people": ["p || ' ' || b", "sh || ' ' || b"],
    "slug": ["substr(regexp_replace(regexp_replace(upper(b), '[^A-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80)"],
}
_PLAN = " UNION ALL ".join(f"SELECT person_id, '{k}' AS kind, list_filter([{', '.join(v)}], lambda x: x IS NOT NULL) AS l FROM base" for k, v in _PQ.items())
oracle("query_plan_table", f"""WITH base AS (SELECT person_id, company_name AS n, {searched('company_name')} AS s, {brand_text('company_name')} AS b, fn || ' Kumar ' || ln AS p, fn || ' ' || ln AS sh,
    CASE WHEN person_id % 2 = 0 THEN role END AS d FROM {{v_person}}),
  plan AS ({_PLAN}), g AS (SELECT person_id, kind, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM plan)
  SELECT person_id, kind, CAST(generate_subscripts(l, 1) AS INT) AS variant_no, unnest(l) AS q FROM g""")
_SRC = "src AS (SELECT person_id AS id, company_name AS company, raw_name AS raw FROM {v_raw_name})"
oracle("person_name_clean", f"WITH {_SRC}, {CLEAN_CTE} SELECT id AS person_id, name FROM cleaned")
oracle("person_name_filter", f"""WITH {_SRC}, {CLEAN_CTE}, {VALID_CTE} SELECT id AS person_id, valid, {name_key('name')} AS name_key,
  CASE WHEN len(string_split(name, ' ')) > 2 THEN string_split(name, ' ')[1] || ' ' || string_split(name, ' ')[-1] ELSE name END AS short_name FROM valid""")
oracle("role_normalise", f"""SELECT person_id, {norm_role('role')} AS role, regexp_matches(raw, '{SENIOR}') AS senior, CAST({quality('raw')} AS INT) AS quality, CAST(len({roles('raw')}) AS INT) AS n_roles, true AS label
  FROM (SELECT person_id, role, lower(role) || ' bio of ' || fn AS raw FROM {{v_person}})""")

# --- company matching -----------------------------------------------------------------------------------
oracle("site_candidates_best", f"""WITH b AS (SELECT company_id, {brand('company_name')} AS toks FROM {{v_company}}),
  h AS (SELECT *, row_number() OVER (PARTITION BY company_id, variant_no ORDER BY pos) AS rn FROM {{v_hit}}),
  d AS (SELECT h.*, toks, {domain('url')} AS dom, lower(title || ' ' || snippet) AS txt FROM h JOIN b USING (company_id) WHERE rn <= 12 AND len(toks) > 0),
  c AS (SELECT *, {core('dom')} AS core, array_to_string(toks, '') AS joined, array_to_string(list_transform(toks, lambda t: left(t, 1)), '') AS acr,
    len(list_filter(toks, lambda t: length(t) >= 3 AND contains(txt, t))) AS hits FROM d WHERE NOT {blocked('dom')}),
  m AS (SELECT *, list_filter(toks, lambda t: length(t) >= 3 AND contains(core, t)) AS hit FROM c),
  l AS (SELECT *, length(list_reduce(list_concat([core], hit), lambda acc, t: CASE WHEN instr(acc, t) = 0 THEN acc ELSE left(acc, instr(acc, t) - 1) || substr(acc, instr(acc, t) + length(t)) END)) AS rest FROM m),
  k AS (SELECT *, CASE WHEN core = joined THEN 'exact' WHEN len(toks) >= 2 AND core = acr THEN 'acronym' WHEN length(acr) >= 3 AND starts_with(core, acr) AND length(core) <= length(acr) + 2 THEN 'acronym-prefix'
      WHEN starts_with(joined, core) AND length(core) >= 4 THEN 'prefix' WHEN starts_with(core, joined) THEN 'startswith' WHEN len(hit) = 0 THEN 'none'
      ELSE 'partial(' || len(hit) || '/' || len(toks) || ')' END AS kind FROM l),
  s AS (SELECT *, CAST(CASE kind WHEN 'exact' THEN 18 WHEN 'acronym' THEN 14 WHEN 'acronym-prefix' THEN 12 WHEN 'prefix' THEN 13 WHEN 'startswith' THEN 12 WHEN 'none' THEN -6
      ELSE len(hit) * 5 + CASE WHEN len(hit) = len(toks) THEN 5 ELSE 0 END - CASE WHEN rest >= 4 THEN 8 WHEN rest >= 2 THEN 2 ELSE 0 END END
      + CASE WHEN contains(txt, 'official') THEN 3 ELSE 0 END + least(hits, 3) * 2 - CASE WHEN starts_with(kind, 'acronym') AND hits = 0 THEN 8 ELSE 0 END
      + CASE WHEN regexp_replace({path('url')}, '/$', '') = '' THEN 2 ELSE 0 END
      - CASE WHEN len(string_split(dom, '.')) > 2 AND NOT regexp_matches(dom, '^(www|in|us|uk|global|corp)\\.') THEN 3 ELSE 0 END AS INT) AS score FROM k),
  best AS (SELECT *, row_number() OVER (PARTITION BY company_id, variant_no ORDER BY score DESC, pos) AS r FROM s),
  ok AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY variant_no) AS v FROM best WHERE r = 1 AND (score >= 8 OR (len(toks) = 1 AND score >= 4)))
  SELECT company_id, variant_no, 'https://' || dom || '/' AS url, dom AS domain, kind, score FROM ok WHERE v = 1""")


def tmatch(a, b):
    return (f"({a} = {b} OR (least(length({a}), length({b})) >= 5 AND (starts_with({a}, {b}) OR starts_with({b}, {a}))) "
            f"OR levenshtein({a}, {b}) <= CASE WHEN greatest(length({a}), length({b})) <= 5 THEN 1 ELSE 2 END)")


def similarity_ctes(pairs: str, out: str) -> str:
    """M3 over distinct token-list pairs ``(a, b)``: one recursion step per token of ``a``."""
    return f"""{out}_w AS (SELECT a, b, 0 AS i, CAST([] AS INT[]) AS used, false AS dist FROM (SELECT DISTINCT a, b FROM {pairs})
    UNION ALL SELECT a, b, i + 1, CASE WHEN hit IS NULL THEN used ELSE list_append(used, CAST(hit AS INT)) END,
      dist OR (hit IS NOT NULL AND length(a[i + 1]) >= 4 AND a[i + 1] NOT IN {lst(vocab.GENERIC_TOKENS)})
    FROM (SELECT *, list_filter(range(1, len(b) + 1), lambda j: NOT list_contains(used, j) AND {tmatch('a[i + 1]', 'b[j]')})[1] AS hit FROM {out}_w WHERE i < len(a))),
  {out} AS (SELECT a, b, dist, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(used) / len(a) * 0.65 + len(used) / len(b) * 0.35 END AS sim FROM {out}_w WHERE i = len(a))"""


def dedupe(x):
    return f"list_filter({x}, lambda t, i: list_position({x}, t) = i)"


oracle("company_registry_link", f"""WITH RECURSIVE h AS (SELECT company_id, pos, url, trim(regexp_replace(title, '(?i)\\s*[|-]\\s*Zauba.*$', '')) AS t,
    regexp_extract({path('url')}, '^/(.+)-(U12345AA2000PTC[0-9]+)/?$', 1) AS slug, regexp_extract({path('url')}, '^/(.+)-(U12345AA2000PTC[0-9]+)/?$', 2) AS cin FROM {{v_candidate_hit}}),
  r AS (SELECT *, trim(regexp_replace(slug, '[-\\s]+', ' ', 'g')) AS alt_name, row_number() OVER (PARTITION BY company_id, cin ORDER BY pos) AS rn FROM h),
  c AS (SELECT company_id, pos, cin, alt_name, CASE WHEN length(t) >= 4 THEN t ELSE alt_name END AS candidate_name FROM r WHERE rn = 1),
  names AS (SELECT DISTINCT candidate_name AS nm FROM c UNION SELECT DISTINCT alt_name FROM c UNION SELECT company_name FROM {{v_company}}),
  tok0 AS (SELECT nm, {comparable('nm')} AS l FROM names), tok AS (SELECT nm, {dedupe('l')} AS l FROM tok0),
  j AS (SELECT c.*, k.l AS a, n.l AS b1, s.l AS b2 FROM c JOIN {{v_company}} v USING (company_id) JOIN tok k ON k.nm = v.company_name JOIN tok n ON n.nm = candidate_name JOIN tok s ON s.nm = alt_name),
  pairs AS (SELECT a, b1 AS b FROM j UNION SELECT a, b2 FROM j), {similarity_ctes('pairs', 'm')},
  x AS (SELECT j.*, floor(m1.sim * 100 + 0.5) / 100 AS r1, floor(m2.sim * 100 + 0.5) / 100 AS r2, m1.sim AS s1, m2.sim AS s2, m1.dist AS d1, m2.dist AS d2
    FROM j JOIN m m1 ON m1.a = j.a AND m1.b = j.b1 JOIN m m2 ON m2.a = j.a AND m2.b = j.b2),
  y AS (SELECT company_id, pos, cin, candidate_name, CASE WHEN r2 > r1 THEN r2 ELSE r1 END AS score, CASE WHEN r2 > r1 THEN s2 ELSE s1 END AS sim, CASE WHEN r2 > r1 THEN d2 ELSE d1 END AS dist FROM x),
  z AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY score DESC, pos) AS rn FROM y WHERE dist AND sim >= {vocab.MATCH_ACCEPT})
  SELECT company_id, cin, candidate_name, score, CASE WHEN sim >= {vocab.MATCH_HIGH} THEN 'high' ELSE 'medium' END AS confidence FROM z WHERE rn = 1""")

# Every company name against every registry name.
_WHOLE = f"""mine AS (SELECT DISTINCT company_name AS nm FROM {{v_company}}), theirs AS (SELECT DISTINCT registry_name AS nm FROM {{v_registry}}),
  t0 AS (SELECT nm, {comparable('nm')} AS l FROM (SELECT nm FROM mine UNION SELECT nm FROM theirs)), t AS (SELECT nm, {dedupe('l')} AS l FROM t0),
  pairs AS (SELECT x.l AS a, y.l AS b FROM (SELECT DISTINCT l FROM mine JOIN t USING (nm)) x, (SELECT DISTINCT l FROM theirs JOIN t USING (nm)) y
    WHERE len(x.l) > 0 AND len(y.l) > 0 AND least(len(x.l), len(y.l)) * (0.65 / len(x.l) + 0.35 / len(y.l)) >= {vocab.MATCH_ACCEPT} - 0.001), {similarity_ctes('pairs', 'm')},
  ok AS (SELECT a, b, floor(sim * 100 + 0.5) / 100 AS score, CASE WHEN sim >= {vocab.MATCH_HIGH} THEN 'high' ELSE 'medium' END AS confidence FROM m WHERE dist AND sim >= {vocab.MATCH_ACCEPT})"""
oracle("registry_name_pairs", f"""WITH RECURSIVE {_WHOLE} SELECT array_to_string(a, ' ') AS key, array_to_string(b, ' ') AS other_key, score, confidence FROM ok""")
oracle("company_registry_whole", f"""WITH RECURSIVE {_WHOLE},
  f AS (SELECT l AS b, min(struct_pack(i := registry_id, n := registry_name)) AS e FROM {{v_registry}} r JOIN t ON t.nm = r.registry_name GROUP BY l),
  c AS (SELECT a, arg_min(struct_pack(e := e, s := score, c := confidence), struct_pack(s := -score, e := e)) AS x, count(*) AS n_names FROM ok JOIN f USING (b) GROUP BY a)
  SELECT company_id, x.e.i AS registry_id, x.e.n AS registry_name, x.s AS score, x.c AS confidence, n_names FROM {{v_company}} v JOIN t ON t.nm = v.company_name JOIN c ON c.a = t.l""")

# --- pages -------------------------------------------------------------------------------------------------
_A_RE = '(?i)<a[^>]+href="([^"]*)"[^>]*>([\\s\\S]{{0,400}}?)</a>'.replace("\\\\", "\\")
_EXCL = rf"(?i)\b(?:{vocab.LINK_EXCLUDE})\b"


def ents(x):
    for a, b in (("&amp;", "&"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def link_ctes(html: str) -> str:
    return f"""a0 AS (SELECT page_id, url AS base, regexp_extract_all({html}, '{_A_RE}', 1) AS hs, regexp_extract_all({html}, '{_A_RE}', 2) AS ts FROM {{v_page}}),
  a1 AS (SELECT page_id, base, unnest(hs) AS href, unnest(ts) AS inner_, generate_subscripts(hs, 1) AS pos FROM a0),
  a2 AS (SELECT page_id, base, pos, href, lower({squash(ents("regexp_replace(inner_, '<[^>]+>', ' ', 'g')"))}) AS text FROM a1),
  a3 AS (SELECT page_id, base, pos, text, regexp_replace(CASE WHEN starts_with(href, '/') THEN {origin('base')} || href ELSE {origin('base')} || regexp_replace({path('base')}, '[^/]*$', '') || href END, '#.*$', '') AS url
    FROM a2 WHERE NOT regexp_matches(text, '{_EXCL}') AND href <> '' AND NOT starts_with(href, '#')),
  a4 AS (SELECT *, list_position(list_transform({arr(vocab.LINK_KEYWORDS)}, lambda k: contains(text || ' ' || lower({path('url')}), k)), true) - 1 AS score FROM a3
    WHERE NOT regexp_matches({path('url')}, '{_EXCL}') AND NOT regexp_matches({path('url')}, '(?i){vocab.DOCUMENT_PATH}') AND regexp_replace({path('url')}, '/$', '') <> ''),
  links AS (SELECT page_id, url, min(pos) AS pos, arg_min(text, pos) AS text, CAST(arg_min(score, pos) AS INT) AS score FROM a4 WHERE score >= 0 GROUP BY page_id, url)"""


_EXTRA = '<li><a href="/our-team/">Our Team</a></li><li><a href="leadership?x=1#top">Leadership</a></li><li><a href="/blog/board">Board news</a></li></ul></nav>'
oracle("page_links_ranked", f"""WITH {link_ctes(f"replace(html, '</ul></nav>', '{_EXTRA}')")}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score, pos) AS rank FROM links)
  SELECT page_id, CAST(rank AS INT) AS rank, url, substr(text, 1, 80) AS text, score FROM r WHERE rank <= 5""")
oracle("guessed_links", f"""WITH {link_ctes('html')}, n AS (SELECT page_id, count(*) AS n FROM links GROUP BY 1),
  g AS (SELECT page_id, 'https://' || {host('url')} AS h, unnest({arr(vocab.GUESSED_PATHS[:8])}) AS p FROM {{v_page}} LEFT JOIN n USING (page_id) WHERE coalesce(n, 0) < 2)
  SELECT page_id, h || p AS url, 'guess:' || p AS text, 99 AS score FROM g WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.page_id = g.page_id AND regexp_replace(l.url, '/$', '') = g.h || g.p)""")
_TXT = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
_TXT = f"regexp_replace({_TXT}, '(?i)<br\\s*/?>', ' | ', 'g')"
_TXT = f"regexp_replace({_TXT}, '(?i)</(p|div|h[1-6]|li|tr|td|th|section|article|span|strong|b|em|a|figcaption|dt|dd)\\s*>', ' </\\1> ', 'g')"
for _t in ("script", "style", "noscript", "svg", "iframe", "head"):
    _TXT = f"regexp_replace({_TXT}, '(?is)<{_t}(?:\\s[^>]*)?>.*?</{_t}\\s*>', '', 'g')"
_TXT = f"regexp_replace({_TXT}, '<[^>]*>', '', 'g')"
for _e, _c in (("&copy;", "©"), ("&middot;", "·")):
    _TXT = f"replace({_TXT}, '{_e}', '{_c}')"
oracle("page_text_blocked", f"""WITH t AS (SELECT page_id, {squash(ents(_TXT))} AS txt, len(regexp_extract_all(html, '(?i)<a[\\s>]')) AS links FROM {{pages}})
  SELECT page_id, length(txt) AS n_chars, md5(txt) AS digest, length(txt) = 0 OR (length(txt) < 500 AND regexp_matches(txt, '(?i){vocab.BLOCK_PHRASES.replace("'", "''")}')) OR (length(txt) < 200 AND links = 0) AS blocked FROM t""")
oracle("anchor_snippets", """SELECT page_id, 0 AS pos, url AS href, 'Team page ' || page_id AS title, 'Team page ' || page_id || ' Who runs the company, who sits on its board and since when they do so' AS snippet FROM {v_page}""")
_TITLES = f"""p AS (SELECT company_id, pos, len(list_filter(list_transform(regexp_split_to_array(title, '\\s+[-–—|]\\s+'), lambda t: trim(t)), lambda t: t <> '')) AS n FROM {{v_title_hit}})"""
oracle("richest_page", f"WITH {_TITLES} SELECT company_id, arg_max(pos, struct_pack(a := n, b := -pos)) AS page_id, max(n) AS n FROM p WHERE n > 0 GROUP BY 1")
oracle("name_variant_merge", f"""WITH {_SRC}, {CLEAN_CTE},
  k AS (SELECT r.company_id, c.id AS ord, c.name, v.role, {name_key('c.name')} AS name_key FROM cleaned c JOIN {{v_raw_name}} r ON r.person_id = c.id JOIN {{v_person}} v ON v.person_id = c.id),
  q AS (SELECT *, {quality('role')} AS q FROM k WHERE name_key <> ''),
  g AS (SELECT company_id, name_key, arg_max(name, struct_pack(a := length(name), b := -ord)) AS name, arg_max(role, struct_pack(a := q, b := length(role), c := -ord)) AS role,
    3 * count(*) AS score, min(ord) AS ord, string_split(name_key, '-') AS toks FROM q GROUP BY company_id, name_key),
  sub AS (SELECT a.company_id, a.name_key AS member, b.name_key AS host, len(b.toks) AS n, b.score, b.ord FROM g a JOIN g b ON a.company_id = b.company_id AND len(b.toks) > 1 AND len(b.toks) < len(a.toks)
    AND len(list_intersect(a.toks, b.toks)) = len(b.toks)),
  h AS (SELECT company_id, member, arg_min(host, struct_pack(a := n, b := -score, c := ord)) AS host FROM sub s WHERE NOT EXISTS (SELECT 1 FROM sub t WHERE t.company_id = s.company_id AND t.member = s.host) GROUP BY 1, 2),
  f AS (SELECT g.*, coalesce(h.host, g.name_key) AS host, {quality('role')} AS q FROM g LEFT JOIN h ON g.company_id = h.company_id AND g.name_key = h.member)
  SELECT company_id, host AS name_key, max(name) FILTER (WHERE host = name_key) AS name,
    arg_max(role, struct_pack(a := q, b := length(role), o := host = name_key, d := -len(toks), e := score, f := -ord)) AS role, CAST(sum(score) AS BIGINT) AS score FROM f GROUP BY company_id, host""")

_TRUTH = f"""t AS (SELECT page_id, name, {norm_role('role')} AS role, 10 - row_number() OVER (PARTITION BY page_id ORDER BY ord) AS k, CASE ord WHEN 0 THEN 9 WHEN 1 THEN 4 ELSE 3 END AS score FROM {{v_leader_truth}})"""
oracle("page_leaders", f"""WITH {_TRUTH} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC) AS INT) AS rank, name, role, CAST(score AS BIGINT) AS score FROM t""")
oracle("company_leaders", f"""WITH {_TRUTH}, v AS (SELECT t.*, floor(page_id / 5.0) AS company_id, page_id % 5 AS visit_no FROM t), n AS (SELECT company_id, visit_no, count(*) AS n FROM v GROUP BY 1, 2),
  c AS (SELECT company_id, visit_no, sum(n) OVER (PARTITION BY company_id ORDER BY visit_no) AS seen FROM n), s AS (SELECT company_id, min(visit_no) AS stop FROM c WHERE seen >= 12 GROUP BY 1)
  SELECT CAST(company_id AS BIGINT) AS company_id, name, role, CAST(score + CASE WHEN visit_no > 0 THEN 2 ELSE 0 END AS BIGINT) AS score FROM v LEFT JOIN s USING (company_id) WHERE stop IS NULL OR visit_no <= stop""")

# --- registry ------------------------------------------------------------------------------------------------
from rostrum.plans.inputs import _full, role as role_sql  # noqa: E402


def _officer(k):
    return f"upper({_full(k)}) AS person_name, {norm_role(role_sql(k))} AS designation, lpad(CAST({k} AS VARCHAR), 8, '0') AS din, '17/03/2015' AS appointment_date"


oracle("registry_officers", f"""SELECT c_custkey AS page_id, {_officer('c_custkey * 2')} FROM {{customer}} WHERE c_custkey % 3 = 2
  UNION ALL SELECT c_custkey, {_officer('c_custkey * 2 + 1')} FROM {{customer}} WHERE c_custkey % 3 = 2 AND c_custkey % 4 <> 0""")
oracle("registry_summary", f"""SELECT c_custkey AS page_id, upper({_full('c_custkey * 2')}) AS person_name, 'Director' AS designation FROM {{customer}} WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_custkey, upper({_full('c_custkey * 2 + 1')}), 'Director' FROM {{customer}} WHERE c_custkey % 3 = 0""")
oracle("registry_index", f"""WITH h AS (SELECT i.*, o.o_orderkey % 9 AS k, p.fn || ' ' || p.ln AS nm, lpad(CAST(p.person_id AS VARCHAR), 8, '0') AS id FROM {{v_index_hit}} i JOIN {{orders}} o ON i.pos = o.o_orderkey JOIN {{v_person}} p ON o.o_custkey = p.person_id),
  f AS (SELECT company_id, 0 AS late, pos, 0 AS j, nm AS person_name, 'Director' AS designation, NULL AS din, NULL AS appointment_date, url AS source_url FROM h WHERE k = 0
    UNION ALL SELECT company_id, 0, pos, 1, 'Zoya Lobo', 'Director', NULL, NULL, url FROM h WHERE k = 0
    UNION ALL SELECT company_id, 1, pos, 0, upper(nm), 'Director', id, '20-Sep-2006', url FROM h WHERE k = 1
    UNION ALL SELECT company_id, 1, pos, 0, upper(nm), 'Managing Director', id, NULL, url FROM h WHERE k = 5),
  r AS (SELECT *, row_number() OVER (PARTITION BY company_id, {name_key('person_name')} ORDER BY late, pos, j) AS rn FROM f)
  SELECT company_id, person_name, designation, din, appointment_date, source_url FROM r WHERE rn = 1""")
oracle("registry_cascade", """WITH b AS (SELECT c_custkey AS company_id, c_custkey % 5 = 0 AS other, CASE c_custkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 2 END END AS n FROM {customer})
  SELECT company_id, NOT other AND n > 0 AS ok, CASE WHEN other THEN 'Company match confidence too low' WHEN n = 0 THEN 'Directors unavailable' ELSE '' END AS reason,
  CASE WHEN other THEN 'none' ELSE 'high' END AS confidence, CASE WHEN other THEN 0 ELSE n END AS officers,
  CASE WHEN other THEN 'zauba_low_confidence' WHEN n = 0 THEN 'zauba_no_directors' ELSE 'profile_unverified' END AS status FROM b""")

oracle("registry_rows", """WITH b AS (SELECT c_custkey AS company_id, c_custkey % 7 = 0 AS lost, c_custkey % 5 = 0 AS other, c_custkey % 11 = 0 AS shut,
    CASE c_custkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 2 END END AS n FROM {customer}),
  s AS (SELECT company_id, CASE WHEN lost THEN 'ZaubaCorp page not found' WHEN other THEN 'Company match confidence too low'
      WHEN shut THEN 'ZaubaCorp page could not be loaded; indexed results did not identify directors' WHEN n = 0 THEN 'Directors unavailable' END AS reason, n FROM b),
  p AS (SELECT company_id, (company_id + unnest(range(1, n + 1))) % 4 AS turn FROM s WHERE reason IS NULL),
  r AS (SELECT company_id, CASE turn WHEN 0 THEN 'ok' WHEN 1 THEN 'ok_medium' WHEN 2 THEN 'profile_unverified' ELSE 'search_unavailable' END AS status, 1 AS person,
      CASE WHEN turn < 2 THEN 1 ELSE 0 END AS profile, CASE WHEN turn = 3 THEN 'search down' END AS reason FROM p
    UNION ALL SELECT company_id, CASE WHEN reason LIKE '%not found' THEN 'zauba_not_found' WHEN reason LIKE '%too low' THEN 'zauba_low_confidence'
      WHEN reason LIKE 'Directors%' THEN 'zauba_no_directors' ELSE 'zauba_unreachable' END, 0, 0, reason FROM s WHERE reason IS NOT NULL)
  SELECT company_id, status, count(*) AS n, sum(person) AS people, sum(profile) AS profiles, min(reason) AS reason FROM r GROUP BY ALL""")

oracle("registry_stages", f"""WITH c AS (SELECT company_id, CAST(sum(c_nationkey) AS BIGINT) AS w FROM {{v_person}} GROUP BY 1),
  l AS (SELECT c.*, w % 7 AS luck, company_id + 1 AS page, w % 11 < 6 AND company_id + 1 IN (SELECT c_custkey FROM {{customer}}) AS opened,
    company_id IN (SELECT company_id FROM {{v_index_hit}} WHERE pos % 3 = 0) AS linked FROM c),
  o AS (SELECT *, w % 3 = 0 AS no_officers, CASE WHEN luck = 5 THEN 'web limited' END AS no_web, CASE WHEN luck = 6 OR (luck = 5 AND w % 2 = 1) THEN 'site limited' END AS no_site FROM l),
  m AS (SELECT *, linked AND (luck < 4 OR (luck = 5 AND no_site IS NULL)) AS matched, opened AND page % 3 > 0 AS section FROM o),
  onpage AS (SELECT company_id, {_officer('page * 2')}, 1 AS stage FROM m WHERE opened AND page % 3 = 2
    UNION ALL SELECT company_id, {_officer('page * 2 + 1')}, 1 FROM m WHERE opened AND page % 3 = 2 AND page % 4 <> 0
    UNION ALL SELECT company_id, upper({_full('page * 2')}), 'Director', NULL, NULL, 1 FROM m WHERE opened AND page % 3 = 0 AND w % 11 < 5
    UNION ALL SELECT company_id, upper({_full('page * 2 + 1')}), 'Director', NULL, NULL, 1 FROM m WHERE opened AND page % 3 = 0 AND w % 11 < 5),
  h AS (SELECT i.*, o.o_orderkey % 9 AS k, p.fn || ' ' || p.ln AS nm, lpad(CAST(p.person_id AS VARCHAR), 8, '0') AS id FROM {{v_index_hit}} i JOIN {{orders}} o ON i.pos = o.o_orderkey JOIN {{v_person}} p ON o.o_custkey = p.person_id),
  f AS (SELECT company_id, 0 AS late, pos, 0 AS j, nm AS person_name, 'Director' AS designation, NULL AS din FROM h WHERE k = 0 UNION ALL SELECT company_id, 0, pos, 1, 'Zoya Lobo', 'Director', NULL FROM h WHERE k = 0
    UNION ALL SELECT company_id, 1, pos, 0, upper(nm), CASE k WHEN 1 THEN 'Director' ELSE 'Managing Director' END, id FROM h WHERE k IN (1, 5)),
  ix AS (SELECT f.*, m.* EXCLUDE (company_id), row_number() OVER (PARTITION BY f.company_id, {name_key('person_name')} ORDER BY late, f.pos, j) AS rn FROM f JOIN m ON f.company_id = m.company_id WHERE w % 5 < 4),
  told AS (SELECT company_id, person_name, designation, din, stage FROM onpage
    UNION ALL SELECT company_id, person_name, designation, din, CASE WHEN luck < 3 THEN 2 ELSE 3 END FROM ix WHERE rn = 1 AND NOT section AND (luck < 3 OR (luck IN (3, 4, 6) AND NOT no_officers))),
  best AS (SELECT company_id, min(stage) AS stage FROM told GROUP BY 1),
  t AS (SELECT m.*, b.stage, coalesce(CASE WHEN matched THEN CASE WHEN b.stage IS NOT NULL THEN '' WHEN NOT section AND no_officers THEN 'ZaubaCorp company matched, but director information could not be recovered: officers limited'
      WHEN opened THEN 'Directors unavailable' ELSE 'ZaubaCorp page could not be loaded; indexed results did not identify directors' END END,
    'ZaubaCorp company search could not recover after: ' || no_web || coalesce('; ZaubaCorp site search could not be loaded: ' || no_site, ''), 'ZaubaCorp site search could not be loaded: ' || no_site,
    CASE WHEN luck = 4 AND linked THEN 'Company match confidence too low' ELSE 'ZaubaCorp page not found' END) AS why FROM m LEFT JOIN best b ON m.company_id = b.company_id),
  kp AS (SELECT DISTINCT company_id, {name_key("fn || ' ' || ln")} AS nk FROM {{v_person}})
  SELECT t.company_id, x.person_name, x.designation, x.din, CASE WHEN kp.nk IS NULL THEN 'profile_unverified' ELSE 'ok' END AS status, CASE WHEN t.stage = 1 THEN 'ZaubaCorp' ELSE 'ZaubaCorp (search result)' END AS source, NULL AS reason
    FROM t JOIN told x ON t.company_id = x.company_id AND t.stage = x.stage LEFT JOIN kp ON kp.company_id = t.company_id AND kp.nk = {name_key('x.person_name')} WHERE t.matched
  UNION ALL SELECT company_id, NULL, NULL, NULL, CASE WHEN why LIKE '%recover%' THEN 'search_unavailable' WHEN why LIKE '%not found' THEN 'zauba_not_found' WHEN why LIKE '%too low' THEN 'zauba_low_confidence'
      WHEN why LIKE 'Directors%' THEN 'zauba_no_directors' ELSE 'zauba_unreachable' END, 'ZaubaCorp', why FROM t WHERE why <> ''""")

# --- profiles -----------------------------------------------------------------------------------------------------
_EVID = f"""fb AS (SELECT company_name, {brand('company_name')} AS br FROM (SELECT DISTINCT company_name FROM {{v_person}})),
  fw AS (SELECT company_name, br, {words("array_to_string(br, ' ')")} AS dw FROM fb), ft AS (SELECT company_name, list_distinct(CASE WHEN len(dw) > 0 THEN dw ELSE br END) AS toks,
    CASE WHEN len(dw) > 0 THEN {dedupe('dw')} ELSE {dedupe('br')} END AS ord_toks FROM fw)"""
_HITS = """h0 AS (SELECT h.person_id, h.pos, h.url, h.title, h.snippet, p.company_name, [lower(p.fn), lower(p.ln)] AS toks FROM {v_profile_hit} h JOIN {v_person} p ON h.person_id = p.person_id)"""


def score_ctes(src: str) -> str:
    """M5 for two-word names: ``src(url, title, snippet, company_name, toks)``."""
    return f"""s1 AS (SELECT *, {slug('url')} AS slug, lower(title) AS low FROM {src} WHERE {is_profile('url')}),
  s2 AS (SELECT *, regexp_replace(slug, '[^a-z]', '', 'g') AS tight, list_filter(regexp_split_to_array(slug, '[-_.0-9]+'), lambda x: x <> '') AS parts,
    trim(regexp_replace(low, '[^a-z]+', ' ', 'g')) AS flat, {words('company_name')} AS cw FROM s1),
  s3 AS (SELECT *, len(list_filter(cw, lambda t: contains(low || ' ' || lower(snippet), t) OR contains(tight, t))) > 0 AS co,
    (instr(flat, toks[1] || ' ' || toks[2]) BETWEEN 1 AND 25 OR instr(flat, toks[2] || ' ' || toks[1]) BETWEEN 1 AND 25) AS named,
    len(list_filter(toks, lambda t: contains(low, t))) AS n_title FROM s2),
  scored AS (SELECT *, CASE WHEN NOT (list_contains(parts, toks[2]) OR contains(tight, toks[2])) THEN CASE WHEN named AND co THEN 12 ELSE 0 END
    ELSE 6 + CASE WHEN list_contains(parts, toks[1]) OR contains(tight, toks[1]) THEN 6 WHEN starts_with(tight, left(toks[1], 3)) THEN 2 ELSE 0 END
      + CASE WHEN low = '' THEN 0 ELSE CASE WHEN n_title = 2 THEN 5 ELSE n_title * 2 END + CASE WHEN co THEN 4 ELSE 0 END END
      - CASE WHEN regexp_matches(slug, '[0-9]{{{{4,}}}}') THEN 3 ELSE 0 END END AS score FROM s3)""".replace("{{{{", "{{").replace("}}}}", "}}")


_F4 = f"""f4 AS (SELECT s.*, list_filter(string_split_regex(strip_accents(lower(title || ' ' || snippet || ' ' || slug)), '[^a-z0-9]+'), lambda w: w <> '') AS ws, ft.toks AS need, ft.ord_toks FROM scored s JOIN ft USING (company_name)),
  proven AS (SELECT * FROM f4 WHERE len(need) > 0 AND (len(list_filter(need, lambda t: NOT list_contains(ws, t))) = 0 OR contains(array_to_string(ws, ''), array_to_string(ord_toks, ''))))"""
_SCORED = f"{_EVID}, {_HITS}, {score_ctes('h0')}, {_F4}"
oracle("profile_link_best", f"""WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY score DESC, pos) AS rn FROM proven WHERE score >= 10)
  SELECT person_id, url, CAST(score AS INT) AS score, pos FROM r WHERE rn = 1""")
oracle("profile_shortlist", f"""WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY pos) AS item FROM proven) SELECT person_id, CAST(item AS INT) AS item, url FROM r WHERE item <= 8""")
oracle("model_picks", f"""WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY pos) AS item FROM proven) SELECT person_id, arg_min(url, pos) AS url FROM r WHERE item <= 8 AND score > 0 GROUP BY 1""")
_ET0 = f"list_filter({comparable('company_name')}, lambda t: length(t) >= 3 AND t NOT IN {lst(vocab.GENERIC_TOKENS)})"


def _seen(x):
    ws = f"list_transform(list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: w <> ''), lambda t: {singular('t')})"
    return f"(len(et) > 0 AND (len(list_filter(et, lambda t: NOT list_contains({ws}, t))) = 0 OR contains(array_to_string({ws}, ''), array_to_string(et, ''))))"


oracle("officer_verification", f"""WITH e0 AS (SELECT company_name, {_ET0} AS l FROM (SELECT DISTINCT company_name FROM {{v_person}})), e AS (SELECT company_name, {dedupe('l')} AS et FROM e0), {_HITS}, {score_ctes('h0')},
  v AS (SELECT s.*, {_seen('title')} OR {_seen('url')} AS in_title, {_seen('snippet')} AS in_snippet FROM scored s JOIN e USING (company_name)),
  b AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY in_title DESC, score DESC, pos) AS rn FROM v WHERE score >= 10 AND (in_title OR in_snippet)),
  t AS (SELECT person_id, arg_max(score, struct_pack(a := in_title, b := score, c := -pos)) AS top FROM v GROUP BY 1)
  SELECT p.person_id, b.url, CASE WHEN b.url IS NULL THEN 'none' WHEN b.in_title THEN 'high' ELSE 'medium' END AS confidence,
    CASE WHEN b.url IS NOT NULL THEN '' WHEN t.top IS NULL THEN 'Profilenet verification failed: no profile in results'
      WHEN t.top >= 10 THEN 'Profilenet verification failed: name matched but company did not' ELSE 'Profilenet verification failed: no confident name match' END AS reason
  FROM {{v_person}} p LEFT JOIN b ON p.person_id = b.person_id AND b.rn = 1 LEFT JOIN t ON p.person_id = t.person_id""")
_TH = "th AS (SELECT h.*, o.o_orderkey % 6 AS tf, o.o_orderkey % 5 AS sf, p.fn || ' ' || p.ln AS nm, p.role FROM {v_title_hit} h JOIN {orders} o ON h.pos = o.o_orderkey JOIN {v_person} p ON o.o_custkey = p.person_id)"
oracle("title_leaders", f"""WITH {_TH}, r AS (SELECT *, CASE WHEN tf IN (0, 4) THEN role WHEN sf = 0 THEN 'Founder' WHEN sf IN (1, 2, 3) THEN role END AS found FROM th WHERE tf IN (0, 1, 2, 4)
    AND len(list_filter({words('company_name')}, lambda t: contains(lower(title || ' ' || snippet), t))) > 0),
  k AS (SELECT *, {name_key('nm')} AS name_key FROM r WHERE found IS NOT NULL), f AS (SELECT *, row_number() OVER (PARTITION BY company_id, name_key ORDER BY pos) AS rn FROM k)
  SELECT company_id, name_key, nm AS name, {norm_role('found')} AS role, url, pos FROM f WHERE rn = 1""")
oracle("profile_leaders", f"""WITH {_TH} SELECT company_id, pos, url, nm AS name, {norm_role('role')} AS role FROM th WHERE tf = 0 OR (tf IN (1, 2, 4) AND sf IN (1, 2))""")
oracle("model_output_people", f"""SELECT conv_id * 1000 + turn AS answer_id, 0 AS pos, {_full('conv_id * 7 + turn')} AS person_name, {norm_role(role_sql('conv_id + turn'))} AS designation
  FROM {{conversations}} WHERE (conv_id + turn) % 4 < 3""")
oracle("result_cards", f"""SELECT page_id, CASE WHEN page_id % 6 < 4 THEN 0 ELSE -1 END AS pos, CASE page_id % 6 WHEN 4 THEN 'empty' WHEN 5 THEN 'blocked' ELSE 'results' END AS status,
  CASE WHEN page_id % 6 < 4 THEN {result('url')} END AS url, CASE WHEN page_id % 6 < 4 THEN {squash('title')} END AS title, CASE WHEN page_id % 6 < 4 THEN {squash('head')} END AS snippet FROM {{v_page}}""")
oracle("result_cards_beside", f"""SELECT page_id, CASE page_id % 6 WHEN 1 THEN 'card' WHEN 2 THEN 'heading' WHEN 3 THEN 'feed' ELSE 'list' END AS layout, CASE WHEN page_id % 6 < 4 THEN 0 ELSE -1 END AS pos,
  CASE page_id % 6 WHEN 4 THEN 'empty' WHEN 5 THEN 'blocked' ELSE 'results' END AS status, CASE WHEN page_id % 6 < 4 THEN {squash('title')} END AS title, CASE WHEN page_id % 6 < 4 THEN true END AS same_url FROM {{v_page}}""")
_FIVE, _THREE = "din/dpin|name of director|designation|date of appointment|date of cessation", "din|name|designation"


def _raw_officer(k, ceased):
    return f"lpad(CAST({k} AS VARCHAR), 8, '0') || '|' || upper({_full(k)}) || '|' || {role_sql(k)} || '|17/03/2015|' || {ceased}"


oracle("registry_tables", f"""WITH b AS (SELECT c_custkey AS page_id, c_custkey, c_custkey % 3 AS k, 'Kestrel Foods Private Limited' AS company_name FROM {{customer}})
  SELECT page_id, company_name, -1 AS table_no, true AS section_present, '' AS heading, -1 AS row_no, '' AS headers, '' AS cells FROM b WHERE k > 0
  UNION ALL SELECT page_id, company_name, 0, false, 'Other contacts', 1, 'phone', '1' FROM b WHERE k = 0
  UNION ALL SELECT page_id, company_name, 0, true, 'Current Directors & Key Managerial Personnel', 1, '{_FIVE}', {_raw_officer('c_custkey * 2', "'-'")} FROM b WHERE k = 2
  UNION ALL SELECT page_id, company_name, 0, true, 'Current Directors & Key Managerial Personnel', 2, '{_FIVE}',
    {_raw_officer('c_custkey * 2 + 1', "CASE WHEN c_custkey % 4 = 0 THEN '01/01/2020' WHEN c_custkey % 4 = 1 THEN 'N/A' ELSE '-' END")} FROM b WHERE k = 2
  UNION ALL SELECT page_id, company_name, 1, true, 'Past Directors', 1, '{_THREE}', '00001111|Zubin Past|Director' FROM b WHERE k = 2
  UNION ALL SELECT page_id, company_name, 2, true, 'Other Directorships', 1, 'cin|company name|designation', 'U1|Another Foods|Director' FROM b WHERE k = 2""")
oracle("people_cards", f"""SELECT person_id AS page_id, CASE person_id % 7 WHEN 1 THEN 'empty' WHEN 2 THEN 'rate_limited' WHEN 3 THEN 'not_connected' WHEN 4 THEN 'verification_required' WHEN 5 THEN 'unexpected' WHEN 6 THEN 'unavailable' ELSE 'results' END AS page_class,
  CASE WHEN person_id % 7 IN (0, 6) THEN 'https://www.profiles.example/in/' || lower(fn) || '-' || lower(ln) END AS profile_url, CASE WHEN person_id % 7 IN (0, 6) THEN fn || ' ' || ln END AS name,
  CASE WHEN person_id % 7 IN (0, 6) THEN role || ' at ' || company_name END AS headline, CASE WHEN person_id % 7 IN (0, 6) THEN {norm_role('role')} END AS designation FROM {{v_person}}""")

oracle("workspace_cards", f"""SELECT person_id AS page_id, CASE WHEN person_id % 6 IN (0, 4, 5) THEN 'results' ELSE 'unexpected' END AS page_class, CASE WHEN person_id % 6 IN (0, 5) THEN 'https://www.profiles.example/in/' || lower(fn) || '-' || lower(ln) END AS profile_url,
  CASE WHEN person_id % 6 IN (0, 5) THEN fn || ' ' || ln END AS name, CASE WHEN person_id % 6 IN (0, 5) THEN role || ' at ' || company_name END AS headline, CASE WHEN person_id % 6 IN (0, 5) THEN {norm_role('role')} END AS designation,
  CASE WHEN person_id % 6 IN (0, 5) THEN fn || ' ' || ln || ' · 2nd' || chr(10) || role || ' at ' || company_name || chr(10) || 'Current: ' || role || chr(10) || 'Past: Analyst' END AS snippet FROM {{v_person}}""")

# --- stored responses ---------------------------------------------------------------------------------------
oracle("search_json_a", """SELECT page_id AS query_id, 0 AS pos, url AS href, 'T' AS title, 'd' AS snippet FROM {v_page}
  UNION ALL SELECT page_id, 1, url, title, para FROM {v_page} UNION ALL SELECT page_id, 2, url || '/s', 'S', '' FROM {v_page}""")
oracle("search_json_b", """SELECT page_id AS query_id, CASE page_id % 4 WHEN 1 THEN 'quota' WHEN 2 THEN 'empty' ELSE 'results' END AS status, CASE WHEN page_id % 4 IN (0, 3) THEN 4 END AS hits,
  CASE WHEN page_id % 4 IN (0, 3) THEN 3 END AS last_pos, CASE WHEN page_id % 4 IN (0, 3) THEN 'A' END AS first_title FROM {v_page}""")
oracle("search_json_c", """SELECT page_id AS query_id, url AS href, title, para AS snippet, 'bing,google' AS engines, 'brave' AS down, CASE WHEN page_id % 2 = 0 THEN 'CAPTCHA' ELSE 'too many requests' END AS reason,
  CASE WHEN page_id % 2 = 0 THEN 3600.0 ELSE 180.0 END AS pause FROM {v_page}""")

# --- rows and events ---------------------------------------------------------------------------------------------
oracle("source_priority", f"""WITH r AS (SELECT company_id, {name_key('person_name')} AS name_key, CAST(pos % 4 AS INT) AS source_rank, pos, person_name, designation FROM {{v_row}} WHERE person_name IS NOT NULL),
  o AS (SELECT *, row_number() OVER (PARTITION BY company_id, name_key ORDER BY source_rank, pos) AS rn FROM r WHERE name_key <> '')
  SELECT company_id, name_key, source_rank, pos, person_name, designation FROM o WHERE rn = 1""")
_DIRECT = f"""b AS (SELECT *, fn || ' ' || ln AS name, person_id AS pos, company_id % 4 AS k FROM {{v_person}}), kb AS (SELECT *, {name_key('name')} AS name_key FROM b),
  look AS (SELECT company_id, name_key, max(CASE WHEN pos % 3 = 0 THEN 'https://in.profiles.example/in/' || name_key END) AS url, max(CASE WHEN pos % 7 = 1 THEN 'limited' END) AS outage FROM kb GROUP BY 1, 2),
  sup AS (SELECT company_id, name_key, pos, name, role, NULL AS source FROM kb WHERE k = 0),
  low AS (SELECT company_id, min(pos % 2) AS r FROM kb WHERE k = 2 GROUP BY 1),
  fb0 AS (SELECT kb.*, row_number() OVER (PARTITION BY kb.company_id, name_key ORDER BY pos) AS rn FROM kb JOIN low ON kb.company_id = low.company_id AND pos % 2 = r WHERE k = 2),
  fb AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY pos) AS n FROM fb0 WHERE rn = 1),
  asked AS (SELECT * FROM sup UNION ALL SELECT company_id, name_key, pos, name, role, CASE WHEN pos % 2 = 0 THEN 'ZaubaCorp' ELSE 'SearXNG' END FROM fb WHERE n <= 8),
  al AS (SELECT a.*, look.url AS url0, look.outage AS out0 FROM asked a JOIN look USING (company_id, name_key)),
  st AS (SELECT company_id, min(pos) AS stop, arg_min(out0, pos) AS why FROM al WHERE out0 IS NOT NULL GROUP BY 1),
  done AS (SELECT al.*, CASE WHEN coalesce(pos > stop, false) THEN NULL ELSE url0 END AS url, coalesce(pos > stop, false) AS later, why FROM al LEFT JOIN st USING (company_id)),
  res AS (SELECT *, CASE WHEN url IS NULL THEN CASE WHEN later THEN why ELSE out0 END END AS reason FROM done)"""
oracle("direct_cascade", f"""WITH {_DIRECT}, {_TH}, own0 AS (SELECT company_id, pos, nm, role, url, {name_key('nm')} AS nk FROM th WHERE company_id % 4 = 1 AND (tf = 0 OR (tf IN (1, 2, 4) AND sf IN (1, 2)))),
  own AS (SELECT *, row_number() OVER (PARTITION BY company_id, nk ORDER BY pos) AS rn FROM own0),
  o AS (SELECT company_id, pos, name AS person_name, role AS designation, url AS profile_url, CASE WHEN url IS NOT NULL THEN 'ok' WHEN reason IS NOT NULL THEN 'search_unavailable' ELSE 'no_profile' END AS status,
      coalesce(source, 'Profilenet Direct') AS source, reason FROM res
    UNION ALL SELECT company_id, pos, nm, {norm_role('role')}, url, 'ok', 'Profilenet Direct', NULL FROM own WHERE rn = 1)
  SELECT * FROM o UNION ALL SELECT DISTINCT company_id, 0, NULL, NULL, NULL, 'profile_unverified', 'Profilenet Direct',
    'No source names a person of this company; list known people in the input to search for them.' FROM {{v_person}} p WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.company_id = p.company_id)""")
oracle("cascade_outages", f"""WITH r AS (SELECT *, CASE WHEN person_name IS NOT NULL THEN {name_key('person_name')} END AS nk FROM {{v_row}}),
  c AS (SELECT DISTINCT company_id, company_id % 4 > 0 AS site FROM r),
  p AS (SELECT company_id, nk, CASE WHEN pos % 23 = 0 AND company_id % 4 > 0 THEN 0 WHEN pos % 23 < 2 THEN 1 ELSE 2 END AS rk, pos, person_name, CASE WHEN pos % 5 > 0 THEN designation END AS role,
    pos % 9 AS score, CASE WHEN pos % 13 = 0 THEN profile_url END AS url FROM r WHERE nk IS NOT NULL),
  p1 AS (SELECT *, row_number() OVER (PARTITION BY company_id, nk ORDER BY rk, pos) AS rn FROM p),
  look AS (SELECT company_id, nk, CASE WHEN pos % 2 = 0 AND pos % 17 > 0 THEN 'https://in.profiles.example/in/' || nk END AS found, pos % 17 = 0 AS limited, pos % 34 = 0 AS blocks FROM p1 WHERE rn = 1),
  dn AS (SELECT company_id, pos % 3 AS step, pos % 2 = 0 AS b FROM r WHERE person_name IS NULL AND status IN ('search_unavailable', 'other')),
  d AS (SELECT company_id, bool_or(step = 0) AS s, bool_or(step = 1) AS t, bool_or(step = 1 AND b) AS tb, bool_or(step = 2) AS n, bool_or(step = 2 AND b) AS nb FROM dn GROUP BY 1),
  cnt AS (SELECT company_id, count(*) FILTER (WHERE rk = 0 AND role IS NOT NULL) AS n0, count(*) FILTER (WHERE rk = 1 AND role IS NOT NULL) AS n1 FROM p1 WHERE rn = 1 GROUP BY 1),
  g AS (SELECT c.company_id, c.site, coalesce(d.s, false) AS s, coalesce(d.t AND coalesce(n0, 0) < 2, false) AS no_t, coalesce(d.tb, false) AS tb, coalesce(d.n, false) AS n, coalesce(d.nb, false) AS nb,
    coalesce(n0, 0) AS n0, coalesce(n1, 0) AS n1 FROM c LEFT JOIN d ON c.company_id = d.company_id LEFT JOIN cnt ON c.company_id = cnt.company_id),
  g2 AS (SELECT *, n0 = 0 AND (no_t OR n1 = 0) AND NOT (no_t AND tb) AND n AS no_n FROM g),
  g3 AS (SELECT *, CASE WHEN no_n THEN 'snippets limited' WHEN no_t THEN 'titles limited' END AS late, CASE WHEN no_n THEN nb WHEN no_t THEN tb ELSE false END AS ends FROM g2),
  q AS (SELECT p.*, g3.* EXCLUDE (company_id, n0, n1), row_number() OVER (PARTITION BY p.company_id, nk ORDER BY rk, p.pos) AS rn FROM p JOIN g3 ON p.company_id = g3.company_id
    WHERE NOT (rk = 1 AND no_t) AND NOT (rk = 2 AND (no_n OR (no_t AND tb)))),
  q1 AS (SELECT *, count(*) FILTER (WHERE rk = 0 AND role IS NOT NULL) OVER w AS m0, count(*) FILTER (WHERE rk = 1 AND role IS NOT NULL) OVER w AS m1, count(*) FILTER (WHERE rk = 2 AND role IS NOT NULL) OVER w AS m2
    FROM q WHERE rn = 1 WINDOW w AS (PARTITION BY company_id)),
  q2 AS (SELECT * FROM q1 WHERE (rk = 0 OR (rk = 1 AND m0 < 2) OR (rk = 2 AND m0 + m1 = 0)) AND (role IS NOT NULL OR m0 + CASE WHEN m0 < 2 THEN m1 ELSE 0 END + CASE WHEN m0 + m1 = 0 THEN m2 ELSE 0 END = 0)),
  q3 AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY url IS NULL, role IS NULL, score DESC, rk, pos) AS rank FROM q2),
  reg0 AS (SELECT company_id, pos, person_name || ' Senior' AS person_name, designation, status, source, reason, row_number() OVER (PARTITION BY company_id, nk ORDER BY pos) AS rn FROM r
    WHERE source = 'ZaubaCorp' AND (status = 'profile_unverified' OR person_name IS NULL)),
  reg AS (SELECT * FROM reg0 WHERE rn = 1 OR person_name IS NULL),
  ans AS (SELECT company_id, bool_or(person_name IS NOT NULL OR status = 'search_unavailable') AS answered, min(CASE WHEN person_name IS NULL AND status = 'search_unavailable' THEN pos END) AS lost_pos FROM reg GROUP BY 1),
  q4 AS (SELECT q3.*, look.found, look.limited, look.blocks FROM q3 JOIN look ON q3.company_id = look.company_id AND q3.nk = look.nk WHERE rank <= 8 AND (site OR NOT s)),
  stp AS (SELECT company_id, min(rank) AS halt FROM q4 WHERE url IS NULL AND limited AND blocks GROUP BY 1),
  seen AS (SELECT q4.*, coalesce(url, CASE WHEN NOT ends AND rank <= coalesce(halt, 99) THEN found END) AS address, halt IS NOT NULL OR ends AS stopped,
    CASE WHEN ends THEN late WHEN rank > coalesce(halt, 99) OR limited THEN 'captcha' END AS said FROM q4 LEFT JOIN stp ON q4.company_id = stp.company_id),
  st AS (SELECT company_id, bool_or(address IS NULL) AS open, bool_or(stopped) AS stopped FROM seen GROUP BY 1),
  way AS (SELECT g3.company_id, late, answered, lost_pos, CASE WHEN NOT site AND coalesce(answered, false) THEN 'registry' WHEN NOT site AND s THEN 'site' WHEN open IS NULL AND late IS NOT NULL AND (ends OR NOT coalesce(answered, false)) THEN 'search'
      WHEN open IS NULL THEN 'registry' WHEN open AND NOT st.stopped THEN 'merge' ELSE 'rows' END AS way
    FROM g3 LEFT JOIN ans ON g3.company_id = ans.company_id LEFT JOIN st ON g3.company_id = st.company_id)
  SELECT s.company_id, CAST(rank AS BIGINT) AS pos, s.person_name, coalesce(role, 'Director') AS designation, address AS profile_url,
    CASE WHEN address IS NOT NULL THEN 'ok' WHEN said IS NOT NULL OR (way = 'merge' AND lost_pos IS NOT NULL) THEN 'search_unavailable' ELSE 'no_profile' END AS status, 'Official Website' AS source,
    CASE WHEN address IS NULL THEN CASE WHEN way = 'merge' AND lost_pos IS NOT NULL THEN (SELECT x.reason FROM reg x WHERE x.company_id = way.company_id AND x.pos = lost_pos) ELSE said END END AS reason
  FROM seen s JOIN way ON s.company_id = way.company_id WHERE way IN ('merge', 'rows')
  UNION ALL SELECT reg.company_id, pos, person_name, designation, NULL, status, source, reason FROM reg JOIN way ON reg.company_id = way.company_id WHERE way = 'registry' OR (way = 'merge' AND person_name IS NOT NULL)
  UNION ALL SELECT company_id, 0, NULL, NULL, NULL, 'search_unavailable', CASE way WHEN 'site' THEN 'ZaubaCorp' ELSE 'Official Website' END, CASE way WHEN 'site' THEN 'site limited' ELSE late END FROM way WHERE way IN ('site', 'search')
  UNION ALL SELECT company_id, 0, NULL, NULL, NULL, 'error', 'Official Website', NULL FROM way WHERE way = 'registry' AND company_id NOT IN (SELECT company_id FROM reg)""")

oracle("direct_cascade_whole", f"""WITH kb AS (SELECT *, {name_key('name')} AS name_key FROM (SELECT *, fn || ' ' || ln AS name, person_id AS pos FROM {{v_person}})),
  look AS (SELECT company_id, name_key, max(CASE WHEN pos % 3 = 0 THEN 'https://in.profiles.example/in/' || name_key END) AS url, max(CASE WHEN pos % 7 = 1 THEN 'limited' END) AS outage FROM kb GROUP BY 1, 2),
  sup AS (SELECT company_id, name_key, pos, name, role, NULL AS source FROM kb WHERE c_nationkey < 2),
  th AS (SELECT h.company_id, h.pos, h.url, o.o_orderkey % 6 AS tf, o.o_orderkey % 5 AS sf, p.person_id % 7 IN (0, 6) AND o.o_orderkey % 4 <> 0 AS carded, p.fn || ' ' || p.ln AS nm, p.role
    FROM {{v_title_hit}} h JOIN {{orders}} o ON h.pos = o.o_orderkey JOIN {{v_person}} p ON o.o_custkey = p.person_id),
  own0 AS (SELECT *, {name_key('nm')} AS nk FROM th WHERE (carded OR tf = 0 OR (tf IN (1, 2, 4) AND sf IN (1, 2))) AND company_id NOT IN (SELECT company_id FROM sup)
    AND company_id NOT IN (SELECT company_id FROM {{v_person}} WHERE c_nationkey > 22)),
  own AS (SELECT *, row_number() OVER (PARTITION BY company_id, nk ORDER BY pos) AS rn FROM own0),
  last AS (SELECT * FROM kb WHERE company_id NOT IN (SELECT company_id FROM sup) AND company_id NOT IN (SELECT company_id FROM own)),
  low AS (SELECT company_id, min(pos % 2) AS r FROM last GROUP BY 1),
  fb0 AS (SELECT last.*, row_number() OVER (PARTITION BY last.company_id, name_key ORDER BY pos) AS rn FROM last JOIN low ON last.company_id = low.company_id AND pos % 2 = r),
  fb AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY pos) AS n FROM fb0 WHERE rn = 1),
  asked AS (SELECT * FROM sup UNION ALL SELECT company_id, name_key, pos, name, role, CASE WHEN pos % 2 = 0 THEN 'ZaubaCorp' ELSE 'SearXNG' END FROM fb WHERE n <= 8),
  al AS (SELECT a.*, look.url AS url0, look.outage AS out0 FROM asked a JOIN look USING (company_id, name_key)),
  st AS (SELECT company_id, min(pos) AS stop, arg_min(out0, pos) AS why FROM al WHERE out0 IS NOT NULL GROUP BY 1),
  done AS (SELECT al.*, CASE WHEN coalesce(pos > stop, false) THEN NULL ELSE url0 END AS url, coalesce(pos > stop, false) AS later, why FROM al LEFT JOIN st USING (company_id)),
  res AS (SELECT *, CASE WHEN url IS NULL THEN CASE WHEN later THEN why ELSE out0 END END AS reason FROM done)
  SELECT company_id, pos, name AS person_name, role AS designation, url AS profile_url, CASE WHEN url IS NOT NULL THEN 'ok' WHEN reason IS NOT NULL THEN 'search_unavailable' ELSE 'no_profile' END AS status,
    coalesce(source, 'Profilenet Direct') AS source, reason FROM res
  UNION ALL SELECT company_id, pos, nm, {norm_role('role')}, url, 'ok', 'Profilenet Direct', NULL FROM own WHERE rn = 1""")
_LABEL = "coalesce(CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.STATUS_LABELS.items()) + " END, nullif(status, ''), 'NULL')"
oracle("report_rows", f"""SELECT coalesce(company_name, 'NULL') AS company_name, coalesce(person_name, 'NULL') AS person_name, coalesce(designation, 'NULL') AS designation, coalesce(profile_url, 'NULL') AS profile_url,
  coalesce(source, 'Official Website') AS source, {_LABEL} AS status, coalesce(din, 'NULL') AS din, coalesce(appointment_date, 'NULL') AS appointment_date, coalesce(source_url, 'NULL') AS source_url,
  coalesce(reason, '') AS reason FROM {{v_row}}""")
oracle("report_workbooks", f"""SELECT coalesce(company_name, 'NULL') AS company_name, coalesce(person_name, 'NULL') AS person_name, coalesce(designation, 'NULL') AS designation, coalesce(profile_url, 'NULL') AS profile_url,
  coalesce(source, 'Official Website') AS source, {_LABEL} AS status, coalesce(din, 'NULL') AS din, coalesce(appointment_date, 'NULL') AS appointment_date, coalesce(source_url, 'NULL') AS source_url,
  coalesce(reason, '') AS reason FROM {{v_row}}""")
oracle("report_as_input", f"""WITH r AS (SELECT {squash("coalesce(company_name, 'NULL')")} AS company, {squash("coalesce(person_name, 'NULL')")} AS p, {squash("coalesce(designation, 'NULL')")} AS d FROM {{v_row}}),
  u AS (SELECT *, length(p) BETWEEN 2 AND 150 AND NOT regexp_matches(p, '^(?i)(?:null|n/?a|not found)$') AS usable FROM r WHERE length(company) BETWEEN 2 AND 150)
  SELECT company, CASE WHEN usable THEN p END AS person, CASE WHEN usable THEN d END AS role FROM u""")
oracle("report_summary", f"""WITH t AS (SELECT 'totals' AS section, 'Total Companies' AS metric, count(DISTINCT company_name) AS value, 1 AS ord FROM {{v_row}}
  UNION ALL SELECT 'totals', 'Rows With People Found', count(person_name), 2 FROM {{v_row}}
  UNION ALL SELECT 'totals', 'Rows With Profilenet Found', count(*) FILTER (WHERE person_name IS NOT NULL AND profile_url IS NOT NULL), 3 FROM {{v_row}}),
  o AS (SELECT 'outcome' AS section, {_LABEL} AS metric, count(*) AS value, min(pos) AS f FROM {{v_row}} GROUP BY 2),
  s AS (SELECT 'people by source' AS section, coalesce(source, 'Official Website') AS metric, count(*) AS value, min(pos) AS f FROM {{v_row}} WHERE person_name IS NOT NULL GROUP BY 2)
  SELECT * FROM t UNION ALL SELECT section, metric, value, row_number() OVER (ORDER BY value DESC, f) FROM o UNION ALL SELECT section, metric, value, row_number() OVER (ORDER BY value DESC, f) FROM s""")


def timeline(cool: str, empty: str, keys: str, limit: int = 0) -> str:
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"e.{k} = w.{k}" for k in ks)
    cols = ", ".join(f"e.{k}" for k in ks)
    skip = "w.until > e.t"
    opens = f"(e.cool > 0 OR (e.empty AND {limit} > 0 AND w.streak + 1 >= {limit}))"
    nxt = f"""CASE WHEN {skip} THEN w.until WHEN e.cool > 0 THEN e.t + e.cool WHEN {opens} THEN e.t + {float(vocab.ENGINE_COOLDOWN)} ELSE -1.0 END,
      CASE WHEN {skip} THEN w.streak WHEN {opens} THEN 0 WHEN e.empty AND {limit} > 0 THEN w.streak + 1 ELSE 0 END, {skip}"""
    return f"""ev AS (SELECT *, epoch(ts) AS t, {cool} AS cool, {empty} AS empty, row_number() OVER (PARTITION BY {keys} ORDER BY ts, event_id) AS rn FROM {{v_health}}),
  walk AS (SELECT {keys}, CAST(0 AS BIGINT) AS rn, CAST(-1 AS BIGINT) AS event_id, CAST(-1.0 AS DOUBLE) AS until, 0 AS streak, false AS skipped FROM (SELECT DISTINCT {keys} FROM ev)
    UNION ALL SELECT {cols}, e.rn, e.event_id, {nxt} FROM walk w JOIN ev e ON {on} AND e.rn = w.rn + 1)"""


_PAUSE = "CASE WHEN outcome <> 'error' THEN 0.0 WHEN regexp_matches(reason, '(?i)captcha|429|403|202') THEN 300.0 ELSE 60.0 END"
_SUSP = "CASE WHEN outcome <> 'error' THEN 0.0 WHEN regexp_matches(reason, '(?i)captcha') THEN 3600.0 WHEN regexp_matches(reason, '(?i)too many requests|access denied|HTTP 4[02][39]') THEN 180.0 ELSE 60.0 END"
oracle("engine_cooldown", f"""WITH RECURSIVE {timeline("CASE WHEN outcome = 'error' THEN 90.0 ELSE 0.0 END", "outcome = 'empty'", 'engine', 3)} SELECT event_id, engine, skipped, streak FROM walk WHERE rn > 0""")
oracle("source_cooldown", f"""WITH RECURSIVE {timeline(_PAUSE, 'false', 'instance, engine')} SELECT event_id, instance, engine, skipped FROM walk WHERE rn > 0""")
oracle("engine_suspension", f"""WITH RECURSIVE {timeline(_SUSP, 'false', 'engine')} SELECT engine, count(*) FILTER (WHERE skipped) AS skipped, count(*) AS events FROM walk WHERE rn > 0 GROUP BY engine""")
oracle("health_snapshot", f"""WITH RECURSIVE {timeline(_PAUSE, 'false', 'engine')}, j AS (SELECT w.engine, w.rn, w.until, w.skipped, e.ts, e.outcome FROM walk w JOIN ev e ON w.event_id = e.event_id)
  SELECT engine, CASE WHEN arg_max(until, rn) > epoch(TIMESTAMP '2024-01-31') THEN 'cooldown' WHEN max(ts) FILTER (WHERE NOT skipped AND outcome = 'ok') IS NOT NULL THEN 'available' ELSE 'untested' END AS status,
  max(ts) FILTER (WHERE NOT skipped AND outcome = 'ok') AS last_success FROM j GROUP BY engine""")
oracle("cache_ttl", f"""WITH RECURSIVE {timeline("CASE WHEN n_results > 0 THEN CASE WHEN degraded THEN 30.0 ELSE 600.0 END ELSE 0.0 END", 'false', 'engine')} SELECT event_id, engine AS cache_key, skipped AS hit FROM walk WHERE rn > 0""")
oracle("warn_once", "SELECT instance AS job_id, engine, reason, min(ts) AS ts FROM {v_health} WHERE reason IS NOT NULL GROUP BY 1, 2, 3")
oracle("run_sets", """SELECT instance, array_to_string(list_sort(list(DISTINCT CAST(engine AS VARCHAR))), ',') AS providers,
  array_to_string(list_sort(list(DISTINCT reason) FILTER (WHERE reason IS NOT NULL)), ',') AS warnings FROM {v_health} GROUP BY 1""")
oracle("first_accepted_cutoff", """WITH m AS (SELECT query_id, min(arrived_at) AS missed FROM {v_arrival} WHERE source = 'searxng' AND NOT accepted GROUP BY 1),
  a AS (SELECT v.* FROM {v_arrival} v LEFT JOIN m USING (query_id) WHERE source = 'searxng' OR arrived_at >= least(asked_at + INTERVAL 60 SECOND, missed)),
  d AS (SELECT * FROM a WHERE arrived_at <= asked_at + INTERVAL 900 SECOND), c AS (SELECT query_id, min(arrived_at) AS cut FROM d WHERE accepted GROUP BY 1)
  SELECT query_id, event_id, source, accepted FROM d LEFT JOIN c USING (query_id) WHERE cut IS NULL OR arrived_at <= cut""")
oracle("missing_sources", """WITH d AS (SELECT * FROM {v_arrival} WHERE arrived_at <= asked_at + INTERVAL 600 SECOND), c AS (SELECT query_id, min(arrived_at) AS cut FROM d WHERE accepted GROUP BY 1),
  k AS (SELECT query_id, source FROM d LEFT JOIN c USING (query_id) WHERE cut IS NULL OR arrived_at <= cut)
  SELECT DISTINCT query_id, source FROM {v_arrival} v WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.query_id = v.query_id AND k.source = v.source)""")
oracle("job_state", """WITH a AS (SELECT job_id, coalesce(arg_max(status, struct_pack(a := ts, b := event_id)) FILTER (WHERE status IN ('done', 'error', 'cancelled')),
    arg_max(status, struct_pack(a := ts, b := event_id)) FILTER (WHERE type = 'state'), 'queued') AS status,
    coalesce(arg_max(done, struct_pack(a := ts, b := event_id)) FILTER (WHERE type = 'progress'), 0) AS done, max(total) AS total,
    count(*) FILTER (WHERE type = 'row' AND person IS NOT NULL) AS people_rows, count(*) FILTER (WHERE type = 'row' AND person IS NOT NULL AND url IS NOT NULL) AS profile_rows FROM {v_job_event} GROUP BY 1)
  SELECT *, CAST(CASE WHEN status = 'done' THEN 100 ELSE least(99, round(coalesce(done / total, 0.0) * 100)) END AS INT) AS percent FROM a""")
oracle("job_event_payloads", """WITH e AS (SELECT job_id, {struct_ts} AS o, CASE event_id % 11 WHEN 0 THEN NULL WHEN 1 THEN 'progress' ELSE type END AS type, CASE WHEN event_id % 11 > 1 THEN status END AS status,
    CASE WHEN event_id % 11 > 1 THEN done END AS done, CASE WHEN event_id % 11 > 1 THEN total END AS total, CASE WHEN event_id % 11 > 1 THEN person END AS person, CASE WHEN event_id % 11 > 1 THEN url END AS url FROM {v_job_event}),
  a AS (SELECT job_id, coalesce(arg_max(status, o) FILTER (WHERE type = 'state' AND status IN ('done', 'error', 'cancelled')), arg_max(status, o) FILTER (WHERE type = 'state'), 'queued') AS status,
    coalesce(arg_max_null(done, o) FILTER (WHERE type = 'progress'), 0) AS done, max(total) FILTER (WHERE type = 'progress') AS total,
    count(*) FILTER (WHERE type = 'row' AND person IS NOT NULL) AS people_rows, count(*) FILTER (WHERE type = 'row' AND person IS NOT NULL AND url IS NOT NULL) AS profile_rows FROM e GROUP BY 1)
  SELECT *, CAST(CASE WHEN status = 'done' THEN 100 ELSE least(99, round(coalesce(done / total, 0.0) * 100)) END AS INT) AS percent FROM a""".replace("{struct_ts}", "struct_pack(a := ts, b := event_id)"))
oracle("job_log_tail", """WITH l AS (SELECT job_id, event_id, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS back FROM {v_job_event} WHERE type = 'log')
  SELECT job_id, event_id, CAST(back AS INT) AS back FROM l WHERE back <= 5""")
oracle("partial_run", """WITH c AS (SELECT job_id, min(ts) AS cut FROM {v_job_event} WHERE status = 'cancelled' GROUP BY 1)
  SELECT job_id, event_id FROM {v_job_event} LEFT JOIN c USING (job_id) WHERE type = 'row' AND (cut IS NULL OR ts <= cut)""")
