"""Main text of web pages by template deduction from equivalence classes.

Method. The tokens of a page are its elements, each with its path of tags and classes, and
its blocks of text, each with the path around it. Tokens of one host with the same
occurrence vector (how often in which page) form an equivalence class; vectors are compared
by a fingerprint, the exclusive-or over the pages of a hash of page and count, which is
built by partial aggregation, so a host with a third of all pages is never gathered in one
task. Pages of a host with the same html count once, in vectors and page counts. A class is
valid if it is large (CLASS tokens) and frequent (SHARE of the host's distinct pages, and
PAGES of them at least, for two pages that share a line are no evidence of a template),
and its tokens follow each other in one order in all of these pages. The elements of valid
classes nest by their paths: this tree is the host's template, and what lies in an element of
it, outside the elements nested there, is a slot. What a slot is is decided once per host,
from the text that isn't fixed of all its distinct pages: from the root, the child with more
than MOST of an element's text is entered while there is one; the last is the main slot. Beside
that way a subtree, or the rest of an element, is no article if most of its characters are
links, or if it has less than SHORT of the main slot's characters; headings, what holds an
<h1>, and all in <article> and <main> stay. These slots go from every page that has the main
slot. Of the other slots, menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and comments of readers go where a tag, class, id or role tells them (names; with
names=False the template alone decides). Fixed text is removed only outside the main slot and
outside <article> and <main>: a line that every article has, such as its author, belongs to
the articles. A page whose own text is template throughout keeps it: template is removed
beside other text only.

Scale: where templates are too large to broadcast, pages meet them by host; those of a host
with more than one task's share of the pages are dealt to several tasks by a hash of the row,
so only rows alike in key, url and html stay together.

A host too small or too mixed for a template still has its pages read by the same rules
from the whole body.

Defined cases: null html is empty and gives an empty text; a null url is a host of its own;
unclosed and misnested elements close as browsers close them; an unfinished tag at the end
is text. Repeated rows give repeated results. An empty table gives none.
"""

from __future__ import annotations

import html as entities
import re
import struct
from collections import Counter
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, parts

#: Least tokens of a class, least share of the host's distinct pages and least of them that it is on.
CLASS, SHARE, PAGES = 3, 0.9, 3

# The names of HTML elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
OUTSIDE = frozenset("head title nav footer aside form button select option textarea input label script style noscript template iframe object embed canvas svg menu dialog".split())
#: Words of a class, id or role that mark what isn't the article: tops of pages, lists and readers' texts, all others.
TOPS = frozenset("header masthead banner topbar".split())
LISTS = frozenset("comment comments commentlist disqus respond reply replies related recommended".split())
MARKS = (
    frozenset("nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside widget ad ads promo cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup share sharing social form search login pagination pager toolbar skip contentinfo complementary".split())
    | TOPS
    | LISTS
)
_STEMS = re.compile(r"(?:advert|sponsor|promo)\w*")
#: Words that may stand beside a mark in one name: of any mark, and of all but TOPS (an article has a header of its own).
BESIDE = frozenset("site global top bottom left right primary secondary mobile desktop container wrapper wrap inner outer bar".split())
BESIDE_OTHERS = BESIDE | frozenset(
    "page main post posts entry article articles story stories content section area block box panel list item items group row zone slot unit space link links icon icons button buttons btn title label text body thread count toggle dropdown".split()
)
#: Elements that can be a main slot.
CONTAINERS = frozenset("article main section div td form center".split())
#: Elements that are text or its layout: their names say what is in them, not where they stand.
PLAIN = frozenset("html body h1 h2 h3 h4 h5 h6 table thead tbody tfoot tr td th caption".split())
#: Where no <article> or <main> tells, an element with more than this share of a page's text isn't outside by its name.
MOST = 0.5
#: A slot beside the main one with less than this share of its characters is no part of the article.
SHORT = 0.05


def marked(value: str, article: bool) -> str:
    """What a class, id or role says of an element: "" nothing, "list" readers' texts or lists, "other".

    A name marks as a whole: each of its words is a mark, a number or may stand beside one;
    so no-sidebar, has-sidebar, header-fixed, category-social and article-header don't.
    In an article (article) names of TOPS don't mark.
    """
    kind = ""
    for name in value.lower().split():
        words = [w for w in re.split("[-_]+", name) if w and not w.isdigit()]
        marks = {w for w in words if w in MARKS or _STEMS.fullmatch(w)}
        if not marks or (marks <= TOPS and article):
            continue
        if all(w in marks or w in (BESIDE if marks & TOPS else BESIDE_OTHERS) for w in words):
            if not marks & LISTS:
                return "other"
            kind = "list"
    return kind


_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)


class Walk:
    """One pass over a page: calls element(path, at) at each element, then block(path, text, outside, at, links) for each block in order.

    at counts the elements before; links: characters of the block in links. Without names nothing is outside.
    """

    def __init__(self, page: str, element, block, names: bool = True):
        self.stack, self.buffer, self.element, self.names = [], [], element, names
        self.at = self.links = 0
        self.linked = False
        self.blocks, self.marks = [], []  # marks: kind, characters, holds <main>, number of <article>s
        self.articles = self.mains = 0
        at, n = 0, len(page)
        for m in _TOKEN.finditer(page):
            if m.start() < at:  # inside a raw element
                continue
            if m.start() > at:
                self.buffer.append(page[at : m.start()])
                self.links += self.linked * (m.start() - at)
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                self._close(name)
                continue
            self._open(name, m[3])
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
                self._close(name)
        if at < n:
            self.buffer.append(page[at:])
        self._flush()
        size = sum(len(text) for _, text, outside, *_ in self.blocks if not outside)
        out = {i for i, x in enumerate(self.marks) if not self._holds_article(*x, size)}
        for path, text, outside, marks, place, links in self.blocks:
            block(path, text, outside or not out.isdisjoint(marks), place, min(links, len(text)))

    def _holds_article(self, kind, chars, main, articles, size) -> bool:
        """Whether a marked element is around the page's article, so that its name means something else."""
        if kind == "list":  # readers' texts can be longer than the article, and be <article>s themselves
            return main or chars == size > 0
        if self.articles or self.mains:  # however short the article is beside this element
            return main or 0 < self.articles == articles
        return chars > MOST * size

    def _flush(self):
        if self.buffer:
            text = " ".join(entities.unescape("".join(self.buffer)).split())
            self.buffer.clear()
            if text:
                path, outside, _, marks = self.stack[-1][1:] if self.stack else ("", False, False, ())
                self.blocks.append((path, text, outside, marks, self.at, self.links))
                if not outside:
                    for i in marks:
                        self.marks[i][1] += len(text)
        self.links = 0

    def _open(self, name, attributes):
        if name in BLOCK:
            self._flush()
            self._imply(name)
        elif name == "br":
            self.buffer.append(" ")
        if name in VOID:
            return
        names = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes else {}
        path, outside, article, marks = self.stack[-1][1:] if self.stack else ("", False, False, ())
        if not outside and self.names:
            if name in ("article", "main"):
                self.articles += name == "article"
                self.mains += name == "main"
                for i in marks:
                    self.marks[i][2] |= name == "main"
                    self.marks[i][3] += name == "article"
            elif names and name not in PLAIN:
                if article:  # an id names a place to jump to there
                    names.pop("id", None)
                kinds = {marked(v, article) for v in names.values()} - {""}
                if kinds:
                    marks = (*marks, len(self.marks))
                    self.marks.append(["other" if "other" in kinds else "list", 0, False, 0])
            outside = name in OUTSIDE or (name == "header" and not article)
        label = name + ("." + ".".join(sorted(names["class"].split())) if "class" in names else "")
        path = f"{path}>{label}"
        self.stack.append((name, path, outside, article or name in ("article", "main"), marks))
        self.linked = self.linked or name == "a"
        self.element(path, self.at)
        self.at += 1

    def _imply(self, name):
        """Close what the start of this element closes: an open paragraph, or a sibling of its kind."""
        if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            kinds = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",)}.get(name, (name,))
            stops = ("ul", "ol", "dl", "table", "select", "menu") + (("tr",) if name in ("td", "th") else ())
        else:
            kinds, stops = ("p",), ("article", "section", "div", "table", "td", "th", "li", "blockquote", "body", "button", "aside", "nav", "footer", "header", "main", "form")
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in kinds:
                del self.stack[i:]
                return
            if self.stack[i][0] in stops:
                return

    def _close(self, name):
        if name in BLOCK or name in RAW:
            self._flush()
        if name == "a" or name in BLOCK:
            self.linked = False
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == name:
                if i < len(self.stack) - 1 and any(s[0] in BLOCK for s in self.stack[i + 1 :]):
                    self._flush()
                del self.stack[i:]
                return
            if name not in BLOCK and self.stack[i][0] in BLOCK:
                return  # an inline end tag doesn't close blocks


def _hash(text: str) -> int:
    return struct.unpack("<q", blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest())[0]


_TOKENS = pa.list_(pa.struct([("role", pa.int64()), ("c", pa.int64()), ("at", pa.int32()), ("is_text", pa.bool_()), ("path", pa.string()), ("chars", pa.int64()), ("own", pa.int64()), ("links", pa.int64())]))
_TOKENS_SQL = "array<struct<role: bigint, c: bigint, at: int, is_text: boolean, path: string, chars: bigint, own: bigint, links: bigint>>"


def _roles(names: bool):
    """Per page: a hash of its html, and its tokens, each with role, count, first place, whether it is text, path, and characters: all, not outside, in links."""

    def run(batches):
        for b in batches:
            contents, tokens = [], []
            for page in b.column(1).to_pylist():
                seen = {}

                def add(role, at, path, text=None, outside=True, links=0):
                    t = seen.setdefault(role, {"role": role, "c": 0, "at": at, "is_text": text is not None, "path": path, "chars": 0, "own": 0, "links": 0})
                    t["c"] += 1
                    n = len(text or "")
                    t["chars"] += n
                    t["own"] += 0 if outside else n
                    t["links"] += links

                def element(path, at):
                    add(_hash(path), 2 * at, path)  # noqa: B023

                def block(path, text, outside, at, links):
                    add(_hash(f"{path}\n{text}"), 2 * at - 1, path, text, outside, links)  # noqa: B023

                Walk(page or "", element, block, names)
                contents.append(blake2b((page or "").encode("utf-8", "surrogatepass"), digest_size=16).digest())
                tokens.append(list(seen.values()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(contents, pa.binary()), pa.array(tokens, _TOKENS)], names=["host", "content", "tokens"])

    return run


_ARTICLE = re.compile(r">(?:article|main)(?:[.>]|$)").search
_HEADING = re.compile(r">h[1-6](?:\.[^>]*)?$").search
_TITLE = re.compile(r">h1(?:\.[^>]*)?$").search


def _above(path: str):
    """The path's elements, innermost first: itself and all around it."""
    while path:
        yield path
        path = path.rpartition(">")[0]
    yield ""


def article_slots(nodes: list[tuple[str, int, int, int, bool]]) -> tuple[str | None, list[tuple[str, bool]]]:
    """(main slot, (path, whether it goes) of the elements beside and on the way to it) of a host's template.

    nodes: path, characters that aren't fixed, those not outside by name, those in links, all with what is nested there,
    and whether the element is once on each page. No main slot below the body: (None, []).
    """
    known = {p for p, *_ in nodes}
    chars, links = {p: n for p, n, *_ in nodes}, {p: n for p, _, _, n, _ in nodes}
    named = any(own for _, _, own, *_ in nodes)
    weight = {p: own if named else n - link for p, n, own, link, _ in nodes}
    children = {}
    for p in sorted(known):
        children.setdefault(next((x for x in _above(p.rpartition(">")[0]) if x in known), ""), []).append(p)
    for sums in (chars, links, weight):
        sums[""] = sum(sums[p] for p in children.get("", ()))
    can = {p for p, *_, once in nodes if once and p.rpartition(">")[2].split(".")[0] in (CONTAINERS | {"html", "body"})}
    way = [""]
    while True:
        best = max((p for p in children.get(way[-1], ()) if p in can), key=lambda p: weight[p], default=None)
        if best is None or weight[best] <= MOST * weight[way[-1]]:
            break
        way.append(best)
    main = way[-1]
    if main.rpartition(">")[2].split(".")[0] in ("", "html", "body"):
        return None, []

    def goes(path, n, link, w, inside):
        if _ARTICLE(path) or any(_ARTICLE(p) or _TITLE(p) for p in inside):
            return False
        return link > MOST * n or w < SHORT * weight[main]

    slots = [(main, False)]
    for p, entered in zip(way, way[1:]):
        own = children[p]
        slots += [(c, not _HEADING(c) and goes(c, chars[c], links[c], weight[c], [x for x in known if x == c or x.startswith(f"{c}>")])) for c in own if c != entered]
        slots.append((p, goes(p, *(sums[p] - sum(sums[c] for c in own) for sums in (chars, links, weight)), ())))
    return main, slots


def _decide(batches):
    """Per host: the roles of its fixed text, its main slot and its other slots."""
    for b in batches:
        made = [article_slots([tuple(n.values()) for n in nodes or ()]) for nodes in b.column(2).to_pylist()]
        kind = pa.list_(pa.struct([("path", pa.string()), ("gone", pa.bool_())]))
        slots = pa.array([[{"path": p, "gone": g} for p, g in x] for _, x in made], kind)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([m for m, _ in made], pa.string()), slots], names=["_sl_host", "_sl_template", "_sl_main", "_sl_slots"])


_OF_HOST = ("_sl_template", "_sl_main", "_sl_slots")


def _extract(names: bool):
    def run(batches):
        for b in batches:
            texts = []
            for page, template, main, slots in zip(*(b.column(c).to_pylist() for c in ("_sl_html", *_OF_HOST))):
                fixed, own, seen = set(template or ()), [], Counter()
                Walk(page or "", lambda path, at: seen.update((path,)), lambda path, text, outside, *_: outside or own.append((path, text)), names)  # noqa: B023
                main = main if main and seen[main] == 1 else None
                gone = {x["path"]: x["gone"] for x in slots} if main else {"": False}
                inside = lambda path: _ARTICLE(path) or (main and (path == main or path.startswith(f"{main}>")))  # noqa: E731, B023
                slot = lambda path: next(gone[p] for p in _above(path) if p in gone)  # noqa: E731, B023
                blocks = [text for path, text in own if inside(path) or not (slot(path) or _hash(f"{path}\n{text}") in fixed)]
                texts.append("\n".join(blocks or [text for _, text in own]))
            kept = [n for n in b.schema.names if n != "_sl_html" and n not in _OF_HOST]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in kept], pa.array(texts, pa.string())], names=[*kept, "text"])

    return run


def valid_classes(distinct: DataFrame, stats: DataFrame) -> DataFrame:
    """The tokens of large, frequent and ordered classes: _sl_host, vector, role, is_text, path, c."""
    frequent = stats.filter((F.col("pages") >= F.col("_sl_pages") * SHARE) & (F.col("pages") >= PAGES))
    large = frequent.groupBy("_sl_host", "vector").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= CLASS).drop("n")
    classes = cut(frequent.join(large, ["_sl_host", "vector"]).select("_sl_host", "vector", "role", "is_text", "path", "c"))
    # a class's tokens on one page are together, never those of a host
    placed = distinct.select(F.col("host").alias("_sl_host"), F.xxhash64("host", "content").alias("page"), F.explode("tokens").alias("t")).select("_sl_host", "page", "t.role", "t.at")
    found = placed.join(classes.select("_sl_host", "role", "vector"), ["_sl_host", "role"]).select(F.xxhash64("_sl_host", "vector").alias("class"), "page", "at", "role")
    orders = found.groupBy("class", "page").agg(F.xxhash64(F.transform(F.sort_array(F.collect_list(F.struct("at", "role"))), lambda t: t["role"])).alias("o"))
    ordered = orders.groupBy("class").agg(F.min("o").alias("low"), F.max("o").alias("high")).filter("low = high").select("class")
    return classes.withColumn("class", F.xxhash64("_sl_host", "vector")).join(ordered, "class", "left_semi").drop("class")


def deduce(pages: DataFrame, url_col: str = "url", html_col: str = "html", names: bool = True) -> DataFrame:
    """One row per host with a template: _sl_host, _sl_template (roles of its fixed text), _sl_main (path of its main slot), _sl_slots (of other slots, whether they go)."""
    slim = pages.select(_host(url_col).alias("_sl_host"), F.col(html_col).alias("_sl_html"))
    read = slim.mapInArrow(_roles(names), f"host string, content binary, tokens {_TOKENS_SQL}")
    # tokens are packed, a row per page, until copies of a page are one
    distinct = cut(read.groupBy("host", "content").agg(F.first("tokens").alias("tokens")))
    per_host = distinct.groupBy(F.col("host").alias("_sl_host")).agg(F.count(F.lit(1)).alias("_sl_pages"))
    tokens = distinct.select("host", "content", F.explode("tokens").alias("t")).select("host", "t.*", F.xxhash64("content", "t.c").alias("h"))
    sums = [F.sum(c).alias(c) for c in ("chars", "own", "links")]
    stats = tokens.groupBy("host", "role").agg(F.bit_xor("h").alias("vector"), F.count(F.lit(1)).alias("pages"), F.max("is_text").alias("is_text"), F.max("path").alias("path"), F.max("c").alias("c"), *sums)
    stats = cut(stats.join(per_host, stats["host"] == per_host["_sl_host"]).drop("host"))
    valid = cut(valid_classes(distinct, stats))
    fixed = valid.filter("is_text").select("_sl_host", "role")
    elements = valid.filter("not is_text").select("_sl_host", "path", (F.col("c") == 1).alias("once"))
    # characters by path, then by each element of the template around it: a host's rows are added up before they meet
    by_path = stats.filter("is_text").join(fixed, ["_sl_host", "role"], "left_anti").groupBy("_sl_host", "path").agg(*sums)
    around = F.transform(F.sequence(F.lit(2), F.size("names")), lambda k: F.array_join(F.slice("names", 1, k), ">"))
    spread = by_path.withColumn("names", F.split("path", ">")).filter(F.size("names") > 1).select("_sl_host", F.explode(around).alias("path"), "chars", "own", "links").groupBy("_sl_host", "path").agg(*sums)
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("chars", "own", "links")]
    nodes = elements.join(spread, ["_sl_host", "path"], "left").groupBy("_sl_host").agg(F.collect_list(F.struct("path", *zero, "once")).alias("nodes"))
    texts = fixed.groupBy("_sl_host").agg(F.collect_list("role").alias("_sl_template"))
    kind = "_sl_host string, _sl_template array<bigint>, _sl_main string, _sl_slots array<struct<path: string, gone: boolean>>"
    return texts.join(nodes, "_sl_host", "full").select("_sl_host", "_sl_template", "nodes").mapInArrow(_decide, kind)


def _host(url_col: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def _salts(slim: DataFrame, total: int, n_tasks: int) -> DataFrame:
    """(host, tasks) of each host with more pages than one task's share: fewer than n_tasks rows."""
    counts = slim.groupBy("_sl_host").agg(F.count(F.lit(1)).alias("c"))
    hot = counts.filter(F.col("c") * n_tasks > total).select("_sl_host", F.ceil(F.col("c") * n_tasks / total)).collect() if total else []
    return slim.sparkSession.createDataFrame([tuple(r) for r in hot], "_sl_host string, _sl_salts bigint")


def extract(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", html_col: str = "html", names: bool = True) -> DataFrame:
    """One row per page: key, url, text, n_chars. names: whether names of elements tell what is outside, too."""
    templates = cut(deduce(pages, url_col, html_col, names))
    slim = pages.select(F.col(key_col).alias("_sl_key"), F.col(url_col).alias("_sl_url"), _host(url_col).alias("_sl_host"), F.col(html_col).alias("_sl_html"))
    # pages of a hot host go to as many tasks as they need; only such a host's template is repeated
    hot, one = F.broadcast(_salts(slim, pages.count(), parts(pages.sparkSession))), F.lit(1)
    spread = slim.join(hot, "_sl_host", "left").withColumn("_sl_salt", F.pmod(F.xxhash64("_sl_key", "_sl_url", "_sl_html"), F.coalesce("_sl_salts", one))).drop("_sl_salts")
    templates = templates.join(hot, "_sl_host", "left").withColumn("_sl_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_sl_salts", one) - 1))).drop("_sl_salts")
    joined = spread.join(templates, ["_sl_host", "_sl_salt"], "left").select("_sl_key", "_sl_url", "_sl_html", *_OF_HOST)
    kind = pages.schema[key_col].dataType.simpleString()
    done = joined.mapInArrow(_extract(names), f"_sl_key {kind}, _sl_url string, text string")
    return done.select(F.col("_sl_key").alias(key_col), F.col("_sl_url").alias(url_col), "text", F.char_length("text").cast("bigint").alias("n_chars"))
