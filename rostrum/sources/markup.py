"""Saved HTML -> flat tables.

``_Page`` turns one page into numbered elements; each job below streams pages
through ``mapInPandas`` and emits rows.  Everything that decides *what the rows
mean* happens afterwards with DataFrame operators.
"""
from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rostrum import vocab
from rostrum.functions import text as T

# --- fixed values: HTML element classes ------------------------------------------
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4",
            "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SIBLING_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
               "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "select", "html", "body", "template"}
DROPPED = {"script", "style", "noscript", "svg", "iframe", "form", "select", "option", "textarea", "button", "nav", "header",
           "footer", "aside", "template"}
NOISE = re.compile(r"nav|menu|breadcrumb|cookie|sidebar|newsletter|search", re.I)
NOISE_ID = re.compile(r"nav|menu|search", re.I)
NOISE_ROLE = {"navigation", "banner", "contentinfo", "search"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
TABLE_HEADINGS = HEADINGS | {"p", "strong", "b"}
NAME_TAGS = HEADINGS | {"strong", "b", "a", "span", "p", "div", "td", "figcaption", "dt"}
CARD_CHARS = 400
#: Elements whose content is no part of the page for a browser that runs scripts.
INERT = frozenset({"script", "style", "template", "noscript", "textarea", "iframe"})
#: An open anchor in one of these is not closed by an anchor inside it.
ANCHOR_SCOPE = {"td", "th", "caption", "object", "button", "template", "html", "body"}
P_SCOPE = SCOPE | {"td", "th", "li"}
BODY_SCOPE = SCOPE - {"table"}
#: Tags in their plain spelling, which need none of the parser's care for broken markup.
PLAIN_START = re.compile(r'<([a-z][a-z0-9]*)((?: [a-z][a-z0-9-]*="[^"<>&]*")*)>', re.A)
PLAIN_END = re.compile(r"</([a-z][a-z0-9]*)>", re.A)
PLAIN_ATTR = re.compile(r' ([a-z][a-z0-9-]*)="([^"<>&]*)"', re.A)
#: Elements after whose start tag the parser reads on in another mode.
RAW_TEXT = frozenset({"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"})
#: Pages worked on at once: what they become is sent on before the next ones are read.
CHUNK = 64


class _Page(HTMLParser):
    """Elements in document order with parent, text range and attributes."""

    def __init__(self, html: str, dropped=frozenset({"script", "style", "template"}), noisy: bool = False):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.attrs, self.start, self.end, self.last = [], [], [], [], [], []
        self.text, self.owner, self.stack, self.skip = [], [], [], 0
        self.dropped, self.noisy = dropped, noisy
        self.feed(html or "")
        self.close()
        while self.stack:
            self._pop()

    # --- plain tags, without the parser's care for places and broken markup ---
    def updatepos(self, i, j):
        return j

    def parse_starttag(self, i):
        plain = PLAIN_START.match(self.rawdata, i)
        if plain is None or plain[1] in RAW_TEXT:
            return super().parse_starttag(i)
        self.lasttag = plain[1]
        self.handle_starttag(plain[1], PLAIN_ATTR.findall(plain[2]) if plain[2] else ())
        return plain.end()

    def parse_endtag(self, i):
        plain = PLAIN_END.match(self.rawdata, i) if self.cdata_elem is None else None
        if plain is None:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1])
        return plain.end()

    def _unwanted(self, tag, attrs):
        if tag in self.dropped:
            return True
        return self.noisy and (NOISE.search(attrs.get("class", "")) or NOISE_ID.search(attrs.get("id", ""))
                               or attrs.get("role", "") in NOISE_ROLE)

    def _pop(self):
        i = self.stack.pop()
        self.end[i], self.last[i] = len(self.text), len(self.tag) - 1

    def _end_open(self, tags, stop):
        for i in reversed(self.stack):
            if self.tag[i] in tags:
                while self.stack and self.stack[-1] >= i:
                    self._pop()
                return
            if self.tag[i] in stop:
                return

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        if self.skip:
            self.skip += tag == self.skipping
            return
        if self._unwanted(tag, attrs):
            if tag not in VOID:
                self.skip, self.skipping = 1, tag
            return
        if tag in CLOSES_P:
            self._end_open({"p"}, P_SCOPE)
        if tag == "a":
            self._end_open({"a"}, ANCHOR_SCOPE)
        if tag in SIBLING_END:
            self._end_open(SIBLING_END[tag], BODY_SCOPE if tag == "tbody" else SCOPE)
        self.tag.append(tag)
        self.parent.append(self.stack[-1] if self.stack else -1)
        self.attrs.append(attrs)
        self.start.append(len(self.text))
        self.end.append(len(self.text))
        self.last.append(len(self.tag) - 1)
        if tag not in VOID:
            self.stack.append(len(self.tag) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.skip:
            self.skip -= tag == self.skipping
            return
        if self.stack and self.tag[self.stack[-1]] == tag:
            self._pop()
        elif any(self.tag[i] == tag for i in self.stack):
            while self.tag[self.stack[-1]] != tag:
                self._pop()
            self._pop()

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)
            self.owner.append(self.stack[-1] if self.stack else -1)

    # --- reading ---
    def raw(self, i):
        return "".join(self.text[self.start[i]:self.end[i]])

    def flat(self, i):
        return re.sub(r"\s*\|\s*", " | ", " ".join(self.raw(i).split())).strip()

    def own(self, i):
        return " ".join("".join(t for t, o in zip(self.text[self.start[i]:self.end[i]], self.owner[self.start[i]:self.end[i]]) if o == i).split())

    def inside(self, i):
        return range(i + 1, self.last[i] + 1)

    def classes(self, i):
        return self.attrs[i].get("class", "").split()

    def up(self, i):
        while i >= 0:
            yield i
            i = self.parent[i]

    def children(self, i):
        return [j for j in self.inside(i) if self.parent[j] == i]


def _chunks(batches):
    """Arrow batches in pieces of a few pages, so that the rows and blocks of a
    whole batch of pages are never held at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            yield batch.slice(at, CHUNK)


def _pages_to(df: DataFrame, rows, schema: str, keep: list[str]) -> DataFrame:
    """Shared ``mapInArrow`` loop: only the key columns and the markup travel."""
    made = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for chunk in _chunks(batches):
            out = [tuple(rec[k] for k in keep) + r for rec in chunk.to_pylist() for r in rows(rec)]
            columns = zip(*out) if out else [()] * len(made)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, made)], schema=made)

    return df.mapInArrow(run, schema)


def with_separators(html: Column) -> Column:
    """Block ends become spaces, line breaks a bar (SRC9/SRC10 preparation)."""
    br = F.regexp_replace(html, r"(?i)<br\s*/?>", " | ")
    return F.regexp_replace(
        br, r"(?i)</(p|div|h[1-6]|li|tr|td|th|section|article|span|strong|b|em|a|figcaption|dt|dd)\s*>", " </$1> ")


def page_text(html: Column, max_chars: int | None = None) -> Column:
    """SRC9, JVM-side. ``max_chars`` is for prompt building; default is the whole text."""
    s = with_separators(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", ""))
    for tag in ("script", "style", "noscript", "svg", "iframe", "head"):
        s = F.regexp_replace(s, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", "")
    s = F.regexp_replace(s, r"<[^>]*>", "")
    for name, ch in (("&copy;", "©"), ("&middot;", "·"), ("&reg;", "®"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…")):
        s = F.replace(s, F.lit(name), F.lit(ch))
    text = T.squash(T.decode_entities(s))
    return F.substring(text, 1, max_chars) if max_chars else text


def anchors(pages: DataFrame) -> DataFrame:
    """SRC8: every ``<a>`` with an address, with its plain text; tags inside it
    count as spaces.  An anchor ends at its end tag, at the next anchor, with the
    element around it or with the page, so unclosed and nested ones all count."""
    def rows(rec):
        page = _Page(rec["html"], INERT)
        found = (i for i, tag in enumerate(page.tag) if tag == "a" and "href" in page.attrs[i])
        for pos, i in enumerate(found):
            yield pos, page.attrs[i]["href"].strip(), " ".join(" ".join(page.text[page.start[i]:page.end[i]]).split())

    return _pages_to(pages.select("page_id", F.col("url").alias("base"), "html"), rows, "page_id BIGINT, base STRING, pos INT, href STRING, text STRING", ["page_id", "base"])


def anchor_snippets(pages: DataFrame, snippet_chars: int | None = None, title_chars: tuple[int, int] = (6, 200)) -> DataFrame:
    """SRC8, ancestor form: snippet from the nearest of four ancestors whose text
    is over forty characters longer than the title.  Titles have a length within
    ``title_chars``; ``snippet_chars`` cuts the snippet, which is whole by default."""
    def rows(rec):
        page, pos = _Page(rec["html"]), 0
        for i, tag in enumerate(page.tag):
            href = page.attrs[i].get("href", "")
            if tag != "a" or not re.match("https?:", href, re.I):
                continue
            title = " ".join(page.raw(i).split())
            if not title_chars[0] <= len(title) <= title_chars[1]:
                continue
            near = (" ".join(page.raw(j).split()) for j in list(page.up(page.parent[i]))[:4])
            yield pos, href, title, next((t[:snippet_chars] for t in near if len(t) > len(title) + 40), "")
            pos += 1

    html = with_separators(F.regexp_replace("html", r"(?i)<br\s*/?>", " "))
    return _pages_to(pages.select("page_id", html.alias("html")), rows, "page_id BIGINT, pos INT, href STRING, title STRING, snippet STRING", ["page_id"])


BLOCK = ("STRUCT<pos: INT, tag: STRING, depth: INT, parent: INT, sib: INT, n_children: INT, own_text: STRING, text: STRING, "
         "parent_text: STRING, alt: STRING, img_title: STRING, name_seq: INT, "
         "cards: ARRAY<STRUCT<pos: INT, parent: INT, sib: INT, name_seq: INT>>>")
PARENT_CHARS = 200


def page_blocks(pages: DataFrame) -> DataFrame:
    """SRC10 on ``(page_id, company_name, html)``: one row per page with the array
    ``blocks`` of elements left after removing navigation and other furniture.

    ``text`` is the full text of elements up to card size (larger containers keep
    only their own text, so a page is never repeated per nesting level);
    ``cards`` lists the enclosing card-sized ancestors, nearest first.  Keeping a
    page's blocks in its row lets the later passes run without a shuffle.
    """
    def describe(html):
        page = _Page(html, DROPPED, noisy=True)
        n = len(page.tag)
        texts, seq, sib, kids, seen = [None] * n, [0] * n, [0] * n, [0] * n, 0
        for i, tag in enumerate(page.tag):
            p = page.parent[i]
            if p >= 0:
                sib[i] = kids[p]
                kids[p] += 1
            seen += tag in NAME_TAGS
            seq[i] = seen
            if sum(len(t.strip()) for t in page.text[page.start[i]:page.end[i]]) <= CARD_CHARS:
                flat = page.flat(i)
                texts[i] = flat if len(flat) <= CARD_CHARS else None
        out = []
        for i, tag in enumerate(page.tag):
            cards = []
            for j in page.up(page.parent[i]):
                if texts[j] is None:
                    break
                cards.append({"pos": j, "parent": page.parent[j], "sib": sib[j], "name_seq": seq[j]})
            own, up = page.own(i), texts[page.parent[i]] if page.parent[i] >= 0 else None
            if texts[i] == "" and tag != "img":
                continue
            image = page.attrs[i] if tag == "img" else {}
            out.append({"pos": i, "tag": tag, "depth": sum(1 for _ in page.up(page.parent[i])), "parent": page.parent[i], "sib": sib[i],
                        "n_children": kids[i], "own_text": own, "text": texts[i],
                        "parent_text": up if up is not None and len(up) <= PARENT_CHARS else None,
                        "alt": image.get("alt"), "img_title": image.get("title"), "name_seq": seq[i], "cards": cards})
        return out

    schema = f"page_id BIGINT, company_name STRING, blocks ARRAY<{BLOCK}>"
    made = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for chunk in _chunks(batches):
            blocks = pa.array([describe(h) for h in chunk.column("html").to_pylist()], made.field("blocks").type)
            yield pa.RecordBatch.from_arrays([chunk.column("page_id"), chunk.column("company_name"), blocks], schema=made)

    return pages.select(F.col("page_id").cast("bigint"), "company_name", with_separators(F.col("html")).alias("html")).mapInArrow(run, schema)


def flat_blocks(paged: DataFrame) -> DataFrame:
    """SRC10 as a plain table."""
    return paged.select("page_id", F.explode("blocks").alias("b")).select("page_id", "b.*").drop("cards")


RESULT_CARD = "pos INT, status STRING, href STRING, title STRING, snippet STRING"


def _box(page, i, names):
    return next((j for j in page.up(i) if set(page.classes(j)) & names), -1)


def _first_of(page, i, names):
    return next((j for j in page.inside(i) if set(page.classes(j)) & names), -1) if i >= 0 else -1


def _squashed(page, i):
    return " ".join(page.raw(i).split()) if i >= 0 else ""


def _found_cards(layout, html):
    if layout == "feed":
        for item in re.findall(r"(?is)<item\b.*?</item>", html):
            part = {t: " ".join(_Page("".join(re.findall(rf"(?is)<{t}>(.*?)</{t}>", item))).text) for t in ("link", "title", "description")}
            yield part["link"].strip(), " ".join(part["title"].split()), " ".join(part["description"].split())
        return
    page = _Page(html)
    for i, tag in enumerate(page.tag):
        cls = set(page.classes(i))
        if layout == "list" and "result" in cls and "result--ad" not in cls:
            a = _first_of(page, i, {"result__a"})
            yield (page.attrs[a].get("href") if a >= 0 else None), _squashed(page, a), _squashed(page, _first_of(page, i, {"result__snippet"}))
        elif layout == "card" and "snippet" in cls:
            t = _first_of(page, i, {"search-snippet-title", "title"})
            a = next((j for j in page.up(t) if page.tag[j] == "a" and "href" in page.attrs[j]), -1) if t >= 0 else -1
            yield (page.attrs[a].get("href") if a >= 0 else None), _squashed(page, t), _squashed(page, _first_of(page, i, {"generic-snippet", "snippet-description"}))
        elif layout == "heading" and tag == "h3":
            a = next((j for j in page.up(i) if page.tag[j] == "a" and "href" in page.attrs[j]), -1)
            yield (page.attrs[a].get("href") if a >= 0 else None), _squashed(page, i), _squashed(
                page, _first_of(page, _box(page, i, {"MjjYud", "g", "Gx5Zad"}), {"VwiC3b", "IsZvec", "aCOpRe"}))


def result_card_rows(layout: str, html: str):
    """SRC7 for one page."""
    n = 0
    for href, title, snippet in _found_cards(layout, html):
        if href and title:
            yield n, "results", href, title, snippet
            n += 1
    if n == 0:
        body = " ".join("".join(_Page(html).text).split())
        if re.search("no results found|did not match any documents|there are no results|no web results found", body, re.I):
            yield -1, "empty", None, None, None
        elif re.search("captcha|verify you are human|unusual traffic|anomaly-modal|enablejs|challenge-form", html, re.I):
            yield -1, "blocked", None, None, None
        else:
            yield -1, "unreadable", None, None, None


def result_cards(pages: DataFrame) -> DataFrame:
    """SRC7. Saved result pages ``(page_id, layout, html)`` -> hits plus one
    ``status`` row (results / empty / blocked / unreadable) with NULL href."""
    return _pages_to(pages.select("page_id", "layout", "html"), lambda rec: result_card_rows(rec["layout"], rec["html"] or ""), f"page_id BIGINT, {RESULT_CARD}", ["page_id"])


REGISTRY_CELLS = "table_no INT, section_present BOOLEAN, heading STRING, row_no INT, headers ARRAY<STRING>, cells ARRAY<STRING>"


def _header(page: _Page, t: int):
    trs = [j for j in page.inside(t) if page.tag[j] == "tr"]
    heads = [j for j in page.inside(t) if page.tag[j] in ("th", "td") and any(page.tag[k] == "thead" for k in page.up(j) if k > t)]
    cells = heads or ([j for j in page.inside(trs[0]) if page.tag[j] in ("th", "td")] if trs else [])
    return [" ".join(page.raw(j).split()).lower() for j in cells], trs


def _heads_before(page: _Page) -> list[int]:
    """For each element its nearest earlier sibling that can head a table, or -1."""
    last, out = {}, []
    for j, up in enumerate(page.parent):
        out.append(last.get(up, -1))
        if page.tag[j] in TABLE_HEADINGS:
            last[up] = j
    return out


def _heading_above(page: _Page, headed: list[int], t: int, levels: int = 6) -> str:
    """Text of the nearest heading before the table or one of the elements around it."""
    node = t
    for _ in range(levels):
        if node < 0:
            break
        if headed[node] >= 0:
            return " ".join(page.raw(headed[node]).split())
        node = page.parent[node]
    return ""


def registry_cell_rows(html: str):
    """SRC11, markup half, for one page; a table's heading is looked up once."""
    page = _Page(html)
    headed = _heads_before(page)
    section = next((i for i in range(len(page.tag)) if page.attrs[i].get("id") == vocab.REGISTRY_SECTION), -1)
    tables = [i for i, tag in enumerate(page.tag) if tag == "table"]
    if section >= 0:
        spans = [(section, page.last[section])]
        if page.tag[section] in HEADINGS | {"a"}:
            for j in range(page.last[section] + 1, page.last[page.parent[section]] + 1 if page.parent[section] >= 0 else len(page.tag)):
                if page.parent[j] == page.parent[section]:
                    if page.tag[j] in HEADINGS | {"section"}:
                        break
                    spans.append((j, page.last[j]))
        tables = [t for t in tables if any(a <= t <= b for a, b in spans)]
        yield -1, True, "", -1, [], []
    for n, t in enumerate(tables):
        heads, trs = _header(page, t)
        heading = _heading_above(page, headed, t)
        for r, tr in enumerate(trs):
            cells = [" ".join(page.raw(j).split()) for j in page.children(tr) if page.tag[j] == "td"]
            if cells:
                yield n, section >= 0, heading, r, heads, cells


def registry_rows(pages: DataFrame) -> DataFrame:
    """SRC11, markup half: table rows as arrays with their headers and the heading
    above; one row with ``table_no = -1`` marks a page whose section is present."""
    return _pages_to(pages.select("page_id", "html"), lambda rec: registry_cell_rows(rec["html"] or ""), f"page_id BIGINT, {REGISTRY_CELLS}", ["page_id"])


# fixed values: card selectors of the people-search layouts (class names, attribute values)
CARD_CLASSES = {"reusable-search__result-container", "entity-result", "search-result__occluded-item"}
CARD_VIEW = "people-search-result"
TITLE_CLASSES = {"entity-result__title-text"}
TITLE_VIEW = "search-result-lockup-title"
HEADLINE_CLASSES = {"entity-result__primary-subtitle", "search-result__snippets"}
HEADLINE_VIEW = "search-result-lockup-subtitle"
HIDDEN_CLASSES = {"visually-hidden", "sr-only", "entity-result__badge", "entity-result__insights"}
#: The generated-class layout is known by its ancestors only: (attribute, value), outermost first.
WORKSPACE_PATH = [("id", "workspace"), ("data-testid", "lazy-column"), ("role", "list"), ("role", "listitem")]
LINE_TAGS = {"p", "div", "li", "h1", "h2", "h3", "h4"}


class _Lines:
    """Visible text of any element as lines, from tables made once a page:
    ``hider`` is the nearest hidden element at or above each one, ``ends`` maps
    a text position where a line ends to the least hider of what ends it there."""

    def __init__(self, page: _Page):
        self.page, self.hider, self.ends = page, [], {}
        for j, up in enumerate(page.parent):
            hidden = set(page.classes(j)) & HIDDEN_CLASSES or "hidden" in page.attrs[j]
            self.hider.append(j if hidden else self.hider[up] if up >= 0 else -1)
            for at in (page.start[j], page.end[j]) if page.tag[j] in LINE_TAGS or page.tag[j] == "br" else ():
                self.ends[at] = min(self.ends.get(at, len(page.tag)), self.hider[j])

    def of(self, i: int) -> list[str]:
        """Different lines in order, without what is hidden inside ``i``."""
        page, out = self.page, [""]
        for t in range(page.start[i], page.end[i]):
            if self.ends.get(t, i + 1) <= i:
                out.append("")
            if page.owner[t] < 0 or self.hider[page.owner[t]] <= i:
                out[-1] += page.text[t]
        flat = (" ".join(x.split()) for part in out for x in re.split("[\r\n]+", part))
        return list(dict.fromkeys(x for x in flat if x))


def _outermost(page: _Page) -> list[tuple[int, bool]]:
    """Cards that are in no other card, and whether they are of the workspace
    layout; one pass over the elements in document order."""
    found, level, end = [], [], -1
    for j, up in enumerate(page.parent):
        above, attrs = level[up] if up >= 0 else 0, page.attrs[j]
        key, value = WORKSPACE_PATH[above]
        fits = attrs.get(key) == value and (above or page.tag[j] == "main")
        workspace = fits and above == len(WORKSPACE_PATH) - 1
        level.append(above + 1 if fits and not workspace else above)
        card = workspace or set(page.classes(j)) & CARD_CLASSES or attrs.get("data-view-name") == CARD_VIEW or re.match(
            "urn:li:(member|fsd_profile):", attrs.get("data-chameleon-result-urn", ""))
        if card and j > end:
            found.append((j, bool(workspace)))
            end = page.last[j]
    return found


PEOPLE_CARD = """card_no INT, workspace BOOLEAN, hidden BOOLEAN,
    options ARRAY<STRUCT<href: STRING, name: STRING, headline: STRING, root: INT, titled: BOOLEAN>>, roots ARRAY<STRUCT<evidence: STRING, hrefs: ARRAY<STRING>>>, hrefs ARRAY<STRING>"""


def _shown_name(page, lines, j):
    return " ".join(lines.of(next((k for k in page.inside(j) if page.tag[k] == "span" and page.attrs[k].get("aria-hidden") == "true"), j)))


def people_card_rows(html: str):
    """SRC14, markup half, for one page."""
    page = _Page(html, frozenset({"script", "style", "button", "svg", "template"}))
    lines = _Lines(page)
    for n, (c, workspace) in enumerate(_outermost(page)):
        links = [j for j in page.inside(c) if page.tag[j] == "a" and "href" in page.attrs[j]]
        options, roots = [], {}
        if workspace:
            heads = {}
            for j in links:
                p = next((k for k in page.up(j) if page.tag[k] == "p" or k <= c), c)
                if p <= c:
                    continue
                if p not in heads:  # the paragraph of the division right behind the name
                    behind = page.last[p] + 1
                    is_next = behind < len(page.tag) and page.parent[behind] == page.parent[p] and page.tag[behind] == "div"
                    head = next((k for k in page.inside(behind) if page.tag[k] == "p"), -1) if is_next else -1
                    heads[p] = " ".join(lines.of(head)) if head >= 0 else ""
                root = roots.setdefault(page.parent[p], len(roots))
                options.append({"href": page.attrs[j]["href"], "name": _shown_name(page, lines, j), "headline": heads[p], "root": root, "titled": False})
        else:
            roots[c] = 0
            head = next((j for j in page.inside(c) if set(page.classes(j)) & HEADLINE_CLASSES or page.attrs[j].get("data-view-name") == HEADLINE_VIEW), -1)
            headline = " ".join(lines.of(head)) if head >= 0 else ""
            title = next((j for j in links if page.attrs[j].get("data-view-name") == TITLE_VIEW or any(
                set(page.classes(k)) & TITLE_CLASSES or page.attrs[k].get("data-view-name") == TITLE_VIEW for k in page.up(j) if k >= c)), None)
            options = [{"href": page.attrs[j]["href"], "name": _shown_name(page, lines, j), "headline": headline, "root": 0, "titled": titled}
                       for j, titled in [(title, True)] * (title is not None) + [(j, False) for j in links]]
        parts = [{"evidence": "\n".join(lines.of(r)), "hrefs": [page.attrs[j]["href"] for j in links if r < j <= page.last[r]]} for r in roots]
        hidden = bool(re.search(rf"{re.escape(vocab.PROFILE_NAME)}\s+member", page.raw(c), re.I))
        yield n, workspace, hidden, options, parts, [page.attrs[j]["href"] for j in links]


def people_cards(pages: DataFrame) -> DataFrame:
    """SRC14, markup half: one row per outermost result card.  ``options`` are
    the links that may name the person, ``roots`` the parts of the card that
    may be evidence for one (``options.root`` counts into them), ``hrefs`` all links
    of the card; ``hidden`` marks a member without a name.  Work grows with the
    page; evidence comes from inside the card only."""
    return _pages_to(pages.select("page_id", "html"), lambda rec: people_card_rows(rec["html"] or ""), f"page_id BIGINT, {PEOPLE_CARD}", ["page_id"])
