"""Main text of web pages by equivalence-class template deduction.

1. A page is a sequence of tokens: paths of block elements with their classes and ids, and the texts of its blocks.  Each path's
   occurrence vector over the pages of a host (how often it stands in each page) is kept as an order-free fingerprint, sums of
   one hash per (page, count), with its support, total, and the text below it.  Tasks sum these up before the shuffle, so a
   host of any size is a few rows a task.
2. Paths of a host with equal vectors form an equivalence class.  Classes that are frequent, have several tokens and stand
   once a page are valid; as tokens are paths, they nest by prefix into a template, whose slots are the text under a token and
   under none deeper.  Constant texts are of the template too: those that most of a host's different pages have, each time
   beside another text (copies of one article repeat all of it, and that is no template).
3. A page is cut along its host's template.  Slots of navigation, page headers and footers, asides, notices, adverts, forms,
   scripts, styles and comments go, by element, role, class and id, and so do constant texts.  A form, or a class or id that may
   name a wrapper (``sidebar``, ``widget``), is evidence only: a slot with it stays if it holds half of what the page's articles
   say (without articles, half of its running text); one that names an advert or notice stays only for an article.  And a slot goes for a host if it goes in half of the pages that have it.
   Names in class and id count as wholes: ``has-sidebar`` and ``share-price`` name no sidebar and no sharing.  The text is the deepest slot with
   most of the host's running text, where a slot that is an article or main element goes before others; inside it one article
   that holds most of the slot, or several that hold half of it, narrow it.  A page whose host has no template, or that has
   nothing in that slot, is judged by itself in the same way.

A host's template is deduced once and joined to its pages; a hot host is split by adaptive execution in that join.  Defined
results: null and empty html give an empty text; a page that is cut off ends where it is cut; an unknown host has no template;
repeated rows are separate (and count once as different pages); where constant texts are all that a page has, they stay.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import apart, importable
from attesta.scratch import written

# ---- fixed values --------------------------------------------------------------------------------------------------
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody tfoot thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "svg", "math", "iframe", "object", "canvas", "audio", "video")
GONE = frozenset("head title nav aside footer menu dialog select option optgroup button search legend".split())
#: Elements that go unless they hold the page's running text: some servers put whole pages in a form.
FORMS = frozenset(("form", "fieldset"))
ARTICLE = {"article": 2, "main": 1}
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar tablist".split())
#: Names in class and id: of readers' words, of what else isn't the text, and of what may also wrap it.
READERS = frozenset("comment comments commentlist respond disqus replies reply".split())
NEVER = frozenset("ad ads adv advert adverts advertisement advertising advertorial adsense banner promo promotion promoted sponsor sponsored sponsors consent cookie cookies gdpr notice notices notification alert share sharing social subscribe subscription newsletter signup login popup modal pagination pager paging copyright".split())
MARKS = frozenset("breadcrumb breadcrumbs menu nav navbar navigation navi sidebar aside widget widgets footer foot related recommended recommendations overlay toolbar form search skip".split())
#: Names that say where or how large, not what: beside these a name above still means itself.
PLACES = frozenset("site page main post entry article blog top bottom left right first second primary secondary global sticky fixed box boxes bar block section area region container wrapper wrap inner outer holder panel slot unit list lists links link button buttons icon icons posts articles stories items body row group zone".split())
#: Marks that mean the page's own head unless they stand inside the article.
HEADS = frozenset(("header", "head", "topbar", "masthead"))
# --------------------------------------------------------------------------------------------------------------------

#: A class is valid if so much of a host's pages, and two at least, have it.
SUPPORT = 0.5
#: A text is constant if so many of a host's different pages, and SUPPORT of them, have it: two may share a quotation.
CONSTANT = 3
#: A slot holds the main text if it has so much of the running text.
MASS = 0.7

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|[!?][^>]*>?)", re.S)
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_]+")
_END = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in RAW}
_LEAF = re.compile(r"(?:p|h[1-6]|li|pre|blockquote)\b")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Block(NamedTuple):
    """A run of text in one block element: its path's tokens from the outermost on."""

    text: str
    links: int  # characters of it inside links
    path: tuple[str, ...]
    elements: tuple[int, ...]  # which elements of the page these are
    gone_from: int  # the level of the path from which it goes; -1 if it stays
    article: int  # 2 inside an article, 1 inside main only

    @property
    def gone(self) -> bool:
        return self.gone_from >= 0


def attributes(raw: str) -> dict[str, str]:
    """The attributes of a tag, names in lower case; of equal names the first counts.  A value is read as a whole, so that nothing inside it
    is taken for an attribute."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def marked(names: str, of: frozenset[str]) -> bool:
    """Whether one of the names in class or id is of a set as a whole: all its parts are, or say only where it stands."""
    for name in names.split():
        parts = {x.lower() for x in _PART.findall(name)}
        if parts & of and parts <= of | READERS | NEVER | MARKS | HEADS | PLACES:
            return True
    return False


class Kind(NamedTuple):
    token: str
    goes: bool  # its text goes
    doubtful: bool  # its text goes unless it is the running text of the page
    never: bool  # its text goes unless it holds the page's article
    head: bool  # its text goes unless it stands inside the article
    article: int


@lru_cache(maxsize=20_000)
def _kind(name: str, raw: str) -> Kind:
    found = attributes(raw) if raw else {}
    names = f"{found.get('class', '')} {found.get('id', '')}"
    label = re.sub(r"\d+", "0", " ".join(sorted(names.split()))).replace("/", "\\")
    role = found.get("role", "").strip().lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or bool(_HIDDEN.search(found.get("style", "")))
    whole = name in ("html", "body", "main")
    readers = not whole and marked(names, READERS)
    never = not whole and marked(names, NEVER)
    goes = hidden or name in GONE or role in ROLES - {"banner", "form", "search"} or readers
    doubtful = name in FORMS or role in ("form", "search") or (not whole and name not in ARTICLE and marked(names, MARKS))
    head = name == "header" or role == "banner" or (not whole and name not in ARTICLE and marked(names, HEADS))
    return Kind(f"{name}.{label}" if label else name, goes, doubtful, never, head, 0 if readers or never else ARTICLE.get(name, 0))


def _settled(found: list[Block], doubts: dict[int, int], never: set[int]) -> list[Block]:
    """The blocks, those under a doubtful element (-> its level) as gone unless it holds half of what runs inside the page's
    articles, or without articles half of what runs in the page and isn't under one of ``never``."""
    if not doubts:
        return found
    top = max((b.article for b in found if not b.gone and _running(b)), default=0)
    mass: Counter[int] = Counter()
    total = 0
    for b in found:
        if not b.gone and b.article == top and (top == 2 or never.isdisjoint(b.elements)):
            total += _running(b)
            for e in b.elements:
                if e in doubts and (e not in never or any(_name(t) == "article" for t in b.path[doubts[e] + 1 :])):
                    mass[e] += _running(b)
    goes = {e for e in doubts if 2 * mass[e] < total or not total}
    return [b._replace(gone_from=min(x for x in (level, b.gone_from) if x >= 0)) if (level := next((doubts[e] for e in b.elements if e in goes), -1)) >= 0 else b for b in found]


def _running(b: Block) -> int:
    return max(0, len(b.text) - b.links)


def blocks(page: str) -> list[Block]:
    """Blocks of text of a page in their order."""
    out: list[Block] = []
    # (name, path, elements, level from which it goes, inside an article) of open block elements
    open_: list[tuple[str, tuple[str, ...], tuple[int, ...], int, int]] = [("", (), (), -1, 0)]
    opened = 0
    text: list[str] = []
    doubts: dict[int, int] = {}
    never: set[int] = set()
    inline_gone: list[tuple[str, int]] = []  # (name, open block elements) of inline elements that go, and what is open of their name inside
    link, linked = 0, 0
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if text:
            words = " ".join("".join(text).split())
            if words:
                _, path, elements, gone, article = open_[-1]
                out.append(Block(words, min(linked, len(words)), path, elements, gone, article))
            text.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not inline_gone:
            t = html.unescape(raw) if "&" in raw else raw
            text.append(t)
            if link:
                linked += len(t)

    def close(name: str) -> bool:
        for i in range(len(open_) - 1, 0, -1):
            if open_[i][0] == name:
                del open_[i:]
                while inline_gone and inline_gone[-1][1] > i:  # it ends with the block that it began in
                    inline_gone.pop()
                return True
        return False

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            rest = page[at:]
            cut = rest.rfind("<")
            add(rest if cut < 0 or not re.match(r"<[/!A-Za-z]", rest[cut:]) else rest[:cut])  # a tag that is cut off
            break
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name in _END and not m[1]:
            if not m[3].endswith("/"):
                e = _END[name].search(page, at)
                at = e.end() if e else n
            text.append(" ")
        elif name == "br":
            flush()
        elif name in BLOCKS:
            flush()
            if m[1]:
                close(name)
            elif name not in VOID:
                if name == "p" or name[0] != "l" and name not in ("tbody", "tr"):
                    if open_[-1][0] == "p":
                        open_.pop()
                elif name == "li":
                    for i in range(len(open_) - 1, 0, -1):
                        if open_[i][0] == "li":
                            del open_[i:]
                            break
                        if open_[i][0] in ("ul", "ol", "menu"):
                            break
                kind = _kind(name, m[3])
                _, path, elements, was, article = open_[-1]
                if not m[3].endswith("/"):
                    opened += 1
                    if was < 0 and (kind.goes or (kind.head and not article)):
                        was = len(path)
                    elif was < 0 and (kind.doubtful or kind.never):
                        doubts[opened] = len(path)
                        if kind.never:
                            never.add(opened)
                    open_.append((name, (*path, kind.token), (*elements, opened), was, max(article, kind.article if was < 0 else 0)))
        elif name in ("td", "th"):
            text.append(" ")
        elif name == "a":
            link = 0 if m[1] else 1
        if name not in BLOCKS and name not in VOID and name not in _END:
            if m[1]:
                if inline_gone and inline_gone[-1][0] == name:
                    inline_gone.pop()
            elif not m[3].endswith("/") and (inline_gone[-1][0] == name if inline_gone else name == "button" or (m[3] and ((k := _kind(name, m[3])).goes or k.never))):
                inline_gone.append((name, len(open_)))
    flush()
    return _settled(out, doubts, never)


# ---- occurrence vectors --------------------------------------------------------------------------------------------


def _hash(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def text_at(b: Block) -> tuple[int, int]:
    """Hashes of a block's text at its place, and of the place."""
    path = "/".join(b.path)
    return _hash(path, b.text), _hash(path)


class Seen(NamedTuple):
    """What one page adds: token -> [count, characters of running text below, whether it goes], the token "" for the page; text at
    its place -> [the longest other text of the page, hash of the place, characters of running text]; and a hash of all its text."""

    tokens: dict[str, list[int]]
    texts: dict[int, list[int]]
    whole: int


def occurrences(page: str) -> Seen:
    found: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
    found[""][0] = 1
    seen: set[int] = set()
    texts: dict[int, list[int]] = {}
    sizes: dict[int, int] = {}
    every = []
    for b in blocks(page):
        mass = 0 if b.gone else len(b.text) - b.links
        for i, element in enumerate(b.elements):
            own = found["/".join(b.path[: i + 1])]
            own[0] += element not in seen
            own[1] += mass
            own[2] |= 0 <= b.gone_from <= i
        seen.update(b.elements)
        if not b.gone:
            h, place = text_at(b)
            sizes[h] = len(b.text)
            texts.setdefault(h, [0, place, 0])[2] += mass
            every.append(b.text)
    longest = sorted(sizes, key=lambda h: (-sizes[h], h))[:2]
    for h, own in texts.items():
        own[0] = next((x for x in longest if x != h), 0)
    return Seen(found, texts, _hash(*every))


_PARTS = "host string, token string, support long, total long, one long, two long, mass long, gone long, text long, beside long, place long"
_SUMS = ("support", "total", "one", "two", "mass", "gone")


def host() -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(pages: DataFrame) -> DataFrame:
    """(host, main, constant) of each host whose pages have a template: the path of the slot of the main text, and hashes of
    texts at their places that most of its pages have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list[int]] = {}
        texts: list[tuple[str, int, int, int, int]] = []

        def rows() -> pa.RecordBatch:
            nothing = [None] * len(texts)
            columns = [[k[0] for k in held] + [x[0] for x in texts], [k[1] for k in held] + nothing]
            columns += [[v[i] for v in held.values()] + ([x[4] for x in texts] if i == 4 else nothing) for i in range(6)]
            columns += [[None] * len(held) + [x[i] for x in texts] for i in (1, 2, 3)]
            types = [pa.string()] * 2 + [pa.int64()] * 9
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in _PARTS.split(", ")])

        for batch in batches:
            for h, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                seen = occurrences(page.as_py())
                seed = _hash(page)
                for token, (count, mass, gone) in seen.tokens.items():
                    own = held.setdefault((h, token), [0, 0, 0, 0, 0, 0])
                    key = hash((seed, count))
                    for i, x in enumerate((1, count, key & 0x7FFFFFFF, key >> 31 & 0x7FFFFFFF, mass)):
                        own[i] += x
                    own[5] += gone
                texts += [(h, t, *own) for t, own in seen.texts.items()]
                texts.append((h, 0, seen.whole, 0, 0))
            if len(held) + len(texts) > 200_000:
                yield rows()
                held, texts = {}, []
        yield rows()

    some = pages.select(host().alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).where("host <> ''")
    parts = written(some.mapInArrow(run, _PARTS), "occurrences")
    found = parts.where("token is not null").groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in _SUMS)).where("support > 1")
    texts = parts.where("text is not null").groupBy("host", "text", "place").agg(F.count_distinct("beside").alias("support"), F.sum("mass").alias("mass")).where("support > 1")
    found = written(found.unionByName(texts, allowMissingColumns=True), "tokens")
    roots = found.where("token = '' or text = 0").groupBy("host").agg(F.max(F.when(F.col("token") == "", F.col("support"))).alias("pages"), F.max(F.when(F.col("text") == 0, F.col("support"))).alias("different"))
    least = lambda n, of: F.greatest(F.lit(n), F.ceil(F.col(of) * SUPPORT))
    often = found.join(roots, "host").where(F.col("support") >= F.when(F.col("token").isNull(), least(CONSTANT, "different")).otherwise(least(2, "pages"))).where("text is null or text <> 0")  # at most 1 / SUPPORT times the tokens of a page
    rows = often.groupBy("host").agg(F.collect_list(F.struct("token", *_SUMS, "text", "place")).alias("tokens"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [deduce(x.as_py()) for x in batch.column("tokens")]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([t.main for t in made], pa.string()), pa.array([sorted(t.constant) for t in made], pa.list_(pa.int64()))], ["host", "main", "constant"])

    return rows.select(apart("host"), "tokens").mapInArrow(solve, "host string, main string, constant array<long>").where("main is not null")


class Template(NamedTuple):
    slots: frozenset[str]  # tokens of valid classes
    main: str | None  # the slot of the running text
    constant: frozenset[int]  # texts at their places that most pages have


def _name(token: str) -> str:
    return token.rpartition("/")[2].partition(".")[0]


def _heaviest(mass: dict[str, float]) -> str | None:
    """Of the tokens with at least MASS of what the heaviest has the deepest article, else the deepest main, else the deepest."""
    best = max(mass.values(), default=0)
    some = [t for t, m in mass.items() if m >= MASS * best] if best > 0 else []
    return max(some, key=lambda t: (ARTICLE.get(_name(t), 0), t.count("/"), mass[t], t), default=None)


def deduce(tokens: list[dict]) -> Template:
    """The template of a host from its frequent tokens."""
    classes: dict[tuple[int, ...], list[dict]] = defaultdict(list)
    for t in tokens:
        if t["token"]:
            classes[t["support"], t["total"], t["one"], t["two"]].append(t)
    valid: dict[str, dict] = {}
    # outer classes first; a class nests if each of its tokens stands under a token of the template or at the top
    for (support, total, *_), members in sorted(classes.items(), key=lambda x: (-x[0][0], min(m["token"].count("/") for m in x[1]))):
        names = {m["token"] for m in members}
        nested = all((p := m["token"].rpartition("/")[0]) == "" or p in valid or p in names for m in members)
        if len(members) > 1 and total == support and nested:
            valid |= {m["token"]: m for m in members}
    constant = [t for t in tokens if t["token"] is None]
    places = {_hash(t["token"]): t["token"] for t in tokens if t["token"]}
    mass = Counter({k: v["mass"] for k, v in valid.items()})
    for t in constant:  # what is constant is no running text
        place = places.get(t["place"], "")
        while place:
            mass[place] -= t["mass"]
            place = place.rpartition("/")[0]
    main = _heaviest({k: mass[k] for k, v in valid.items() if 2 * v["gone"] < v["support"] and not _LEAF.match(_name(k))})
    return Template(frozenset(valid), main, frozenset(t["text"] for t in constant))


def _under(found: list[Block], token: str | None) -> list[Block]:
    """The blocks under a token, and the headings before them that stand beside it."""
    paths = ["/".join(b.path) + "/" for b in found]
    inside = [token is not None and p.startswith(token + "/") for p in paths]
    first = inside.index(True) if True in inside else 0
    beside = (token or "").rpartition("/")[0]
    if _name(token or "") in ARTICLE:
        first = 0  # an article has its own headings
    return [b for i, b in enumerate(found) if inside[i] or (i < first and re.match(r"h[12]\b", b.path[-1] if b.path else "") and paths[i].startswith(f"{beside}/" if beside else ""))]


def narrowed(found: list[Block]) -> list[Block] | None:
    """The blocks of the article that holds most of the running text of ``found``, or of several that hold half of it; else the
    same of main elements; None without any."""
    total = sum(map(_running, found))
    for name in ARTICLE:
        own = [next((e for e, t in zip(b.elements, b.path, strict=True) if _name(t) == name), 0) for b in found]
        mass: Counter[int] = Counter()
        for b, e in zip(found, own, strict=True):
            if e:
                mass[e] += _running(b)
        if mass:
            best = max(mass, key=lambda e: (mass[e], -e))
            if mass[best] >= MASS * total:
                return [b for b, e in zip(found, own, strict=True) if e == best]
            if 2 * mass.total() >= total:
                return [b for b, e in zip(found, own, strict=True) if e]
    return None


def main_text(page: str, template: Template | None) -> tuple[str, bool]:
    """(the text, whether the template told where it is)."""
    found = [b for b in blocks(page) if not b.gone]
    if template and template.main:
        kept = [b for b in found if text_at(b)[0] not in template.constant] if template.constant else found
        if inside := _under(kept, template.main):
            return "\n".join(b.text for b in narrowed(inside) or inside), True
    if (own := narrowed(found)) is not None:
        return "\n".join(b.text for b in own), False
    mass: Counter[str] = Counter()
    for b in found:
        for i in range(len(b.path)):
            if i + 1 < len(b.path) or not _LEAF.match(b.path[i]):
                mass["/".join(b.path[: i + 1])] += _running(b)
    best = _heaviest(mass)
    kept = found if best is None else _under(found, best)
    return "\n".join(b.text for b in kept if b.links < 0.8 * len(b.text)), False


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, by_template) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Template | None] = {}
        for batch in batches:
            texts, told = [], []
            hosts, mains, constants = batch.column("host").to_pylist(), batch.column("main").to_pylist(), batch.column("constant")
            for i, page in enumerate(batch.column("html")):
                h = hosts[i]
                if h not in known:
                    if len(known) > 2000:
                        known.clear()
                    known[h] = Template(frozenset(), mains[i], frozenset(constants[i].as_py())) if mains[i] is not None else None
                text, by = main_text(page.as_py(), known[h])
                texts.append(text)
                told.append(by)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(told, pa.bool_())], ["page_id", "url", "text", "n_chars", "by_template"])

    own = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host().alias("host"))
    joined = own.join(templates(pages), "host", "left").select("page_id", "url", "host", "html", "main", "constant")
    kind = own.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, by_template boolean")


def op3_template_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    importable(spark)
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
