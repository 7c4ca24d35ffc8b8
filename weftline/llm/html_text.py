"""Main text of web pages by site style trees (operator 1).

Every page is parsed once, to blocks of text under a tree of style nodes: an element's node is its parent's node and its own
style (tag, classes, id; digits folded). Pages of a host are merged to its style tree; pages of equal content count once, and a feature
counts once a page. Over the m pages that have a node, its

* presentation importance is the entropy of the layouts of its children, logarithms to the base m,
* content importance is 1 - the mean entropy of its block texts: a text that stands on n of the m pages has entropy log n / log m,
* importance is (1 - GAMMA) * presentation + GAMMA * content, or the one of both that it has; 1 if m is 1,
* composite importance is the mean of the importance of all nodes of its branch, weighted by their pages and by DECAY per level.

A branch is noise if it stands on LEAST_PAGES different pages at least and neither its root nor any node in it reaches LOW. Noise is
cut from every page. Besides, elements whose tag, role or whole class name says what they are go (menus, headers, footers,
sidebars, notices, adverts, forms, comments, scripts, styles). Names that only hold such a word ("content-sidebar-wrap") decide
nothing; the tree does. A class name does not hide an article or main that its element holds; articles below names
of other articles (comments, related) are read where the page has none but these.

An article's mark (article, main, their roles, articleBody) is evidence, not a way round the tree: only what is marked is read, and noise in it is cut
where an element with a class or an id between the mark and the text makes it a part of its own. Its bare headings and paragraphs stay, and so
does an article of which noise would take more than half, or an unmarked page of which it would take all: these are repeated pages, and no frame of others.

The tree is made by aggregations with map-side combination over (host, page digest), (host, node, feature) and (host, node), so a host with a
third of all pages is no single task. A node is aggregated to its ancestors directly, without a round per level. Noise is counted, and
broadcast up to MOST_BROADCAST rows; beyond, the nodes that a page may lose are joined with it. Page lists are never made.

Defined results: null and empty html, and html without text, give an empty text; pages that repeat an id are kept, each with its text; a
null or odd url is the host ''; broken markup is read as far as it goes (a quote that is never closed ends with its tag); an empty table gives no
rows; other columns are ignored. No part of a page is capped; elements below DEPTH levels of style belong to the node at that depth.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import written

#: A branch is judged from so many pages of its host on, and cut below this importance.
LEAST_PAGES, LOW, GAMMA, DECAY, DEPTH = 8, 0.3, 0.9, 0.9, 64
#: Rows (host, node) of noise that are counted and then broadcast; more are joined with the pages that may lose them.
MOST_BROADCAST = 200_000

#: An attribute as the HTML tokeniser has it: a name, and perhaps a value in double, single or no quotes; a quote inside an unquoted value or a name is one of its characters.
_NAME, _VALUE = r"[^\s/>][^\s/>=]*+", r"\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]++"
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?:>|[^a-zA-Z>][^>]*+(?:>|\Z))"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_NAME}(?:\s*+=\s*+(?:{_VALUE})?+)?+)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(rf"({_NAME})(?:\s*+=\s*+({_VALUE})?+)?+")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - frozenset(["td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"])
_SKIP = frozenset(
    "script style head title nav header footer aside form noscript template iframe object svg canvas button select option textarea input"
    " label dialog menu math audio video map noembed noframes".split()
)
_SKIP_ROLE = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog toolbar".split())
#: Class names and ids that say frame, as whole names: every part between hyphens is of these words or of the neutral ones.
_FRAME_WORD = (
    r"(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|footer|header|masthead"
    r"|cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|signup|login|search|share|sharing|social|comments?|disqus|respond|reply"
    r"|related|recommended|widget|pagination|pager|copyright|legal|toolbar)"
)
_SKIP_NAME = re.compile(rf"(?<!\S)(?:skip-link|{_FRAME_WORD}(?:[-_]+(?:{_FRAME_WORD}|list|box|bar|links?|buttons?|form|items?|slot|unit|block|area|top|bottom|\d+))*)(?!\S)", re.I)
#: Of these, the ones whose elements hold other articles than the page's own: answers, teasers, adverts.
_OTHERS_NAME = re.compile(r"(?<!\S)(?:ad|ads|advert|sponsor|promo|comments?|disqus|respond|reply|related|recommended|widget)", re.I)
_COMMENT_NAME = re.compile(r"(?<!\S)(?:comments?|reply)(?:[-_]+(?:body|content|item|list|box|\d+))*(?!\S)", re.I)
#: Whether an element is skipped: no; by what it is; by a name, of the layout or of other articles.
_KEPT, _FRAME, _NAMED, _OTHERS = range(4)
_MAIN = frozenset(["article", "main"])
_IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
            "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _attributes(text: str) -> dict[str, str]:
    """Of a name that is repeated, the first counts."""
    found = _ATTRIBUTE.findall(text) if text.strip(" /") else ()
    return {k.lower(): entities.unescape(v[1:-1] if v[:1] in ("'", '"') else v) for k, v in reversed(found)}


class _Element:
    """An open element: its node (key and keys of the nodes above), what is decided about it, and the styles of its child blocks."""

    __slots__ = ("tag", "nodes", "skipped", "inside", "own", "children")

    def __init__(self, tag: str, nodes: tuple[int, ...], skipped: int, inside: int, own: bool):
        self.tag, self.nodes, self.skipped, self.inside, self.own = tag, nodes, skipped, inside, own
        self.children: list[str] = []


def _key(text: str, above: int = 0) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), above & (1 << 63) - 1) - (1 << 63)


class Block(NamedTuple):
    """nodes from the root to the block's own; inside: 1 in a marked article, 2 in one of other articles, else 0; own: below a named part of an article."""

    nodes: tuple[int, ...]
    text: str
    inside: int
    own: bool


def parse(page: str | None) -> tuple[list[Block], dict[tuple[int, ...], str]]:
    """(blocks, {nodes: layout of the children}) outside of frames."""
    text = page or ""
    stack = [_Element("", (0,), _KEPT, 0, False)]
    blocks: list[Block] = []
    layouts: dict[tuple[int, ...], str] = {}
    run: list[str] = []
    opened: dict[str, int] = defaultdict(int)

    def flush() -> None:
        nonlocal run
        if run:
            words = _SPACE.sub(" ", entities.unescape("".join(run))).strip()
            if words:
                owner = next((e for e in reversed(stack) if e.tag in _BLOCK), stack[0])
                blocks.append(Block(owner.nodes, words, owner.inside, owner.own))
            run = []

    def pop() -> None:
        e = stack.pop()
        opened[e.tag] -= 1
        if e.tag in _BLOCK and not e.skipped and e.children:
            layouts.setdefault(e.nodes, ",".join(e.children))

    at, size = 0, len(text)
    while at < size:
        m = _TOKEN.search(text, at)
        if m is None:
            if not stack[-1].skipped:
                run.append(text[at:])
            break
        if m.start() > at and not stack[-1].skipped:
            run.append(text[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in _BLOCK:
                flush()
            if opened[tag]:
                while stack[-1].tag != tag:
                    pop()
                pop()
            elif tag == "p":
                flush()
            continue
        if tag in _BLOCK or tag == "br":
            if tag == "br":
                run.append(" ")
            else:
                flush()
        if tag in _VOID:
            continue
        if tag in _CLOSES_P and opened["p"]:
            scope = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in ("p", "td", "th", "button", "object")), 0)
            if stack[scope].tag == "p":
                while len(stack) > scope:
                    pop()
        if tag in _IMPLIED:
            ends, scope = _IMPLIED[tag]
            for i in range(len(stack) - 1, 0, -1) if any(opened[t] for t in ends) else ():
                if stack[i].tag in scope:
                    break
                if stack[i].tag in ends:
                    while len(stack) > i:
                        pop()
                    break
        a = _attributes(m[3])
        names = f"{a.get('class', '')} {a.get('id', '')}"
        top = stack[-1]
        style = tag + _DIGITS.sub("0", "".join("." + c for c in sorted(a.get("class", "").split())) + ("#" + a["id"] if a.get("id") else "")) if a else tag
        frame = (
            tag in _SKIP
            and not (tag == "header" and top.inside)
            or a.get("role", "").lower() in _SKIP_ROLE
            or tag == "article" and _COMMENT_NAME.search(names) is not None
            or "hidden" in a
            or a.get("aria-hidden") == "true"
            or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")) is not None
        )
        marks = tag in _MAIN or a.get("role", "").lower() in ("main", "article") or a.get("itemprop") == "articleBody"
        skipped, inside = top.skipped, top.inside or int(marks)
        if frame:
            skipped = _FRAME
        elif skipped >= _NAMED and marks and not opened["article"]:  # a name does not hide an article that its element holds
            skipped, inside = _KEPT, 2 if skipped == _OTHERS and tag == "article" else inside
        elif not skipped and not marks and tag not in ("body", "html"):
            named = [n for n in _SKIP_NAME.findall(names) if not (top.inside and n.lower() == "header")]
            if named:
                skipped = _OTHERS if any(_OTHERS_NAME.match(n) for n in named) else _NAMED
        if tag in _BLOCK and not top.skipped:
            if not top.children or top.children[-1] != style:
                top.children.append(style)
        if skipped and not top.skipped and tag not in _BLOCK:
            run.append(" ") if tag not in ("script", "style") else None
        if tag in _RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(text, at)
            if not skipped and end:
                run.append(text[at : end.start()])
            at = text.find(">", end.start()) + 1 or size if end else size
            continue
        if m[3].rstrip().endswith("/") and tag in ("svg", "path", "use"):
            continue
        nodes = top.nodes
        if tag in _BLOCK and len(nodes) < DEPTH:
            nodes = (*nodes, _key(style, nodes[-1]))
        own = top.own or bool(inside and not marks and names.strip())
        opened[tag] += 1
        stack.append(_Element(tag, nodes, skipped, inside, own))
    flush()
    while stack:
        pop()
    return blocks, layouts


_SCHEMA = (
    "page_id long, url string, host string, marked boolean, digest long, blocks array<struct<node:bigint,text:string,own:boolean>>,"
    " nodes array<struct<node:bigint,above:array<bigint>>>, features array<struct<node:bigint,kind:int,feature:bigint>>"
)


def _row(page_id: int | None, url: str | None, page: str | None) -> tuple:
    """A row of _SCHEMA: the blocks to read, and every node and feature of the page once."""
    blocks, layouts = parse(page)
    read = [b for b in blocks if b.inside == 1] or [b for b in blocks if b.inside]
    marked = bool(read)
    features = dict.fromkeys((b.nodes[-1], 0, _key(b.text)) for b in blocks)
    features |= dict.fromkeys((n[-1], 1, _key(x)) for n, x in layouts.items())
    nodes = {n[-1]: n for n in (*(b.nodes for b in blocks), *layouts)}
    for n in list(nodes.values()):  # inner nodes too: they are parts of branches
        for i in range(len(n) - 1, 0, -1):
            if n[i - 1] in nodes:
                break
            nodes[n[i - 1]] = n[:i]
    return (
        page_id,
        url,
        host_of(url),
        marked,
        _key("\0".join(f"{b.nodes[-1]} {b.text}" for b in blocks)),
        [{"node": b.nodes[-1], "text": b.text, "own": b.own or not marked} for b in (read or blocks)],
        [{"node": k, "above": list(n)} for k, n in nodes.items()],
        [{"node": n, "kind": k, "feature": f} for n, k, f in features],
    )


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, block = pa.int64(), pa.struct([("node", pa.int64()), ("text", pa.string()), ("own", pa.bool_())])
    node, feature = pa.struct([("node", key), ("above", pa.list_(key))]), pa.struct([("node", key), ("kind", pa.int32()), ("feature", key)])
    kinds = (key, pa.string(), pa.string(), pa.bool_(), key, pa.list_(block), pa.list_(node), pa.list_(feature))
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            rows = [_row(*x) for x in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True)]
            names = ["page_id", "url", "host", "marked", "digest", "blocks", "nodes", "features"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def parsed_pages(pages: DataFrame) -> DataFrame:
    """One row a page: what is read of it (own: whether noise is cut there), and the nodes and features that it adds to the host's tree."""
    held = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return held.mapInArrow(_parsed, _SCHEMA)


def style_tree(parsed: DataFrame) -> DataFrame:
    """host, node, above (nodes from the root to it), pages, importance, composite, branch (largest composite in its branch) of every style node."""
    once = parsed.groupBy("host", "digest").agg(F.first("nodes").alias("nodes"), F.first("features").alias("features"))
    pages = once.select("host", F.explode("nodes").alias("n")).groupBy("host", F.col("n.node").alias("node")).agg(F.count(F.lit(1)).alias("pages"), F.first("n.above").alias("above"))
    counts = once.select("host", F.explode("features").alias("f")).groupBy("host", "f.node", "f.kind", "f.feature").agg(F.count(F.lit(1)).alias("n"))
    content, layout = F.col("kind") == 0, F.col("kind") == 1
    sums = counts.groupBy("host", "node").agg(
        F.sum(F.when(content, F.col("n"))).alias("texts"),
        F.sum(F.when(content, F.col("n") * F.log("n"))).alias("h"),
        F.sum(F.when(layout, F.col("n"))).alias("layouts"),
        F.sum(F.when(layout, F.col("n") * F.log("n"))).alias("l"),
    )
    base = F.log(F.greatest("pages", F.lit(2)).cast("double"))
    content_part = 1 - F.col("h") / F.col("texts") / base
    # Layouts are counted once a page, so their entropy over pages is log m less the mean of log n.
    presentation = (F.log(F.col("layouts").cast("double")) - F.col("l") / F.col("layouts")) / base
    both = (1 - GAMMA) * presentation + GAMMA * content_part
    own = F.when(F.col("pages") == 1, F.lit(1.0)).otherwise(F.coalesce(both, content_part, presentation, F.lit(0.0)))
    nodes = pages.join(sums, ["host", "node"], "left").select("host", "node", "above", "pages", own.alias("importance"))
    up = nodes.select("host", "pages", "importance", F.size("above").alias("depth"), F.posexplode("above").alias("level", "top"))
    weight = F.col("pages") * F.pow(F.lit(DECAY), F.col("depth") - 1 - F.col("level"))
    composite = up.groupBy("host", F.col("top").alias("node")).agg((F.sum(weight * F.col("importance")) / F.sum(weight)).alias("composite"))
    scored = nodes.join(composite, ["host", "node"])
    branch = scored.select("host", "composite", F.explode("above").alias("node")).groupBy("host", "node").agg(F.max("composite").alias("branch"))
    return scored.join(branch, ["host", "node"])


def main_texts(pages: DataFrame, least_pages: int = LEAST_PAGES, low: float = LOW, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages; low = 0 switches the tree off."""
    parsed = written(parsed_pages(pages).withColumn("_row", F.monotonically_increasing_id()))
    noise = written(style_tree(parsed).where((F.col("pages") >= least_pages) & (F.col("branch") < low)).select("host", "node"))
    safe = ~F.exists("blocks", lambda b: b["own"])
    held = parsed.select("_row", "page_id", "url", "host", "marked", "blocks")
    if noise.count() <= most_broadcast:
        by_host = noise.groupBy("host").agg(F.collect_set("node").alias("_cut"))
        joined = held.join(F.broadcast(by_host), "host", "left")
    else:
        asked = held.select("_row", "host", F.explode(F.array_distinct(F.transform(F.filter("blocks", lambda b: b["own"]), lambda b: b["node"]))).alias("node"))
        cut = asked.join(noise, ["host", "node"]).groupBy("_row").agg(F.collect_set("node").alias("_cut"))  # some of a page's own nodes
        joined = held.where(~safe).join(cut, "_row", "left").unionByName(held.where(safe).withColumn("_cut", F.lit(None).cast("array<bigint>")))
    stays = F.filter("blocks", lambda b: ~(b["own"] & F.array_contains("_cut", b["node"])))

    def chars(blocks) -> Column:
        return F.aggregate(blocks, F.lit(0), lambda n, b: n + F.length(b["text"]))

    repeated = F.when(F.col("marked"), 2 * chars(F.col("_stays")) < chars(F.col("blocks"))).otherwise(F.size("_stays") == 0)
    judged = joined.withColumn("_stays", F.when(F.col("_cut").isNull(), F.col("blocks")).otherwise(stays))
    read = F.when(F.col("_cut").isNotNull() & repeated, F.col("blocks")).otherwise(F.col("_stays"))
    texts = judged.select("page_id", "url", F.array_join(F.transform(read, lambda b: b["text"]), "\n\n").alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
