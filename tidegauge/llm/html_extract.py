"""Main text of web pages by wrapper induction.

1. Every page is parsed into a DOM tree, and the whole tree, menus and notices included, into its
   skeleton: labels (tag and classes, digits folded), with equal sisters merged.
2. The skeletons of a host, each with the varying text of all of its pages as masses, are aligned by
   simple tree matching and merged into one wrapper tree, in rounds of bounded size. As equal
   sisters are one node, an aligned node is known by its label path: its slot.
3. Slots that hold the same text in most of a host's different articles (in all of them on hosts of
   a few) are constant nodes: template. Slots that vary are content. Near-copies, pages that differ
   in under a fifth of their text, are one article. The wrapper's content root is the article or
   main node, or else the smallest node that holds every varying slot.
4. Each page is read again with its host's wrapper: blocks under the content root that are not
   template, and of the varying ones those of no kind that is never article text (navigation,
   forms, scripts, ...).
5. Classes, ids and roles that are mostly found on adverts, comments and the like only mark a node.
   A mark does not hold for html, body, article, main and what encloses a page's article or main,
   nor where the varying text under it outweighs the host's varying text under no mark.

All pages count in 1 to 3. Wrappers are broadcast while their number is under a checked bound,
and joined by host (a skewed join, which Spark splits) beyond it.

Defined cases: null html gives an empty text; a null or odd url has the empty host; unclosed and
cut-off markup is closed at the end, and markup may be nested to any depth; a page without its host's content root is read from the
body; one without article or main whose text is all marked is read without the marks; pages alike in all of their text are one article in 2, so copies never make themselves
template; repeated rows give repeated results; further columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage

MERGED_AT_ONCE = 500  # skeletons
TEMPLATE_SHARE, FEW = 0.5, 8  # of a host's different articles; all of them where they are few, from two on
NEAR_SHARE = 0.2  # of a page's text: near-copies differ in less
BROADCAST_HOSTS = 10_000
LONGEST_WRAPPER = 4_000  # bytes of a wrapper that may be broadcast

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEEPS = {"ul", "ol", "dl", "table", "div", "article", "section", "body", "main"}
NEVER = set("head nav footer aside form script style noscript template svg button select textarea iframe dialog menu input canvas object math".split())
ODD = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer "
    "gdpr masthead menu modal nav navbar navigation newsletter notice notices pager pagination paywall popup promo promoted related reply replies "
    "respond share sharing sidebar social sponsor sponsored subscribe toolbar widget widgets".split()
)
ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
MAIN = {"article", "main"}
UNMARKED = MAIN | {"html", "body"}
MARK = "!"  # ends the label of a marked node
OUT = "-"  # ends the label of what is never article text
SILENT = {"head", "template", "svg", "canvas", "math", "object"}  # never read


class Element:
    __slots__ = ("tag", "label", "parent", "children", "odd", "marked")

    def __init__(self, tag: str, label: str, parent: Element | None, odd: bool, marked: bool) -> None:
        self.tag, self.label, self.parent, self.odd, self.marked = tag, label + MARK * marked, parent, odd, marked
        self.children: list[Element | str] = []


def _element(tag: str, rest: str, parent: Element) -> Element:
    attrs = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(rest)} if rest.strip(" /") else {}
    names = re.findall(r"[a-z#]+", re.sub(r"\d+", "#", f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()))
    odd = (
        tag in NEVER
        or "hidden" in attrs
        or attrs.get("aria-hidden", "").lower() == "true"
        or re.search(r"display\s*:\s*none", attrs.get("style", "").lower()) is not None
    )
    marked = tag not in UNMARKED and (bool(ODD.intersection(names)) or attrs.get("role", "").lower() in ROLES)
    return Element(tag, ".".join([tag, *sorted(set(names))[:4]]), parent, odd, marked)


def parse(source: str) -> Element:
    """A DOM tree, close to how browsers repair one."""
    top = Element("#", "#", None, False, False)
    now, at = top, 0
    while m := TOKEN.search(source, at):
        if m.start() > at:
            now.children.append(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            node = now
            while node is not top and node.tag != tag:
                node = node.parent
            if node is not top:
                now = node.parent
            continue
        if tag in BLOCK or tag in CLOSES:
            closing = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCK else set())
            node = now
            while node is not top and node.tag not in KEEPS:
                if node.tag in closing:
                    now = node.parent
                node = node.parent
        node = _element(tag, m[3], now)
        now.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
            node.children.append(source[at : end.start() if end else len(source)])
            at = end.end() if end else len(source)
        elif tag not in VOID and not m[3].endswith("/"):
            now = node
        elif tag not in VOID and tag in BLOCK:
            now = node
    if at < len(source):
        now.children.append(source[at:])
    _unmark(top)
    return top


def _unmark(top: Element) -> None:
    """Takes the marks off what encloses a page's only article or main nodes."""

    def reach(scope: Element, through: bool) -> tuple[bool, list[Element]]:
        todo, marked = [c for c in scope.children if not isinstance(c, str)], []
        while todo:
            node = todo.pop()
            if node.odd:
                continue
            if node.tag in MAIN:
                return True, []
            if node.marked and not through:
                marked.append(node)
            else:
                todo += [c for c in node.children if not isinstance(c, str)]
        return False, marked

    scopes = [top]
    while scopes:
        for node in reach(scopes.pop(), False)[1]:
            if reach(node, True)[0]:
                node.marked, node.label = False, node.label.removesuffix(MARK)
                scopes.append(node)


def _dropped(node: Element, inside_main: bool) -> bool:
    return node.odd or (node.tag == "header" and not inside_main) or node.tag in RAW


def _number(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


TOP = _number("")


def child_place(place: int, label: str) -> int:
    """A slot's number: that of the label path to it, made link by link, whatever the depth."""
    return _number(f"{place}/{label}")


class Node:
    """A node of a skeleton or wrapper: label, its place's number, mass of varying text, children."""

    __slots__ = ("label", "place", "mass", "children")

    def __init__(self, label: str, place: int, mass: int = 0) -> None:
        self.label, self.place, self.mass = label, place, mass
        self.children: list[Node] = []

    def walk(self) -> list[Node]:
        """All nodes, parents before their children."""
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            out.append(node)
            todo += reversed(node.children)
        return out


class Block(NamedTuple):
    place: int
    text: str
    out: bool  # under what is never article text
    marked: bool
    main: bool


def blocks(top: Element) -> tuple[list[Block], dict[int, tuple[int, str]]]:
    """All blocks of the whole page in order, and for each place its parent's place and its label."""
    out: list[Block] = []
    text: list[str] = []
    places: dict[int, tuple[int, str]] = {}
    where = [(TOP, False, False, False)]

    def flush() -> None:
        if joined := " ".join(html.unescape("".join(text)).split()):
            out.append(Block(where[0][0], joined, *where[0][1:]))
        text.clear()

    todo: list[tuple] = [(top, (TOP, False, False, False))]
    while todo:
        node, here = todo.pop()
        if node is None:
            flush()
            continue
        if isinstance(node, str):
            if not text:
                where[0] = here
            text.append(node)
            continue
        place, never, marked, main = here
        if node.tag in RAW or node.tag in SILENT:
            if node.tag in BLOCK:
                flush()
            continue
        if node.tag == "br":
            text.append(" ")
            continue
        dropped = _dropped(node, main)
        if node.tag in BLOCK or node.marked or dropped:
            flush()
            label = node.label + OUT * dropped
            parent, place = place, child_place(place, label)
            places.setdefault(place, (parent, label))
            todo.append((None, None))
        here = (place, never or dropped, marked or node.marked, main or node.tag in MAIN)
        todo += [(c, here) for c in reversed(node.children)]
    flush()
    return out, places


def skeleton(found: list[Block], places: dict[int, tuple[int, str]]) -> Node:
    """The page's tree of the places that hold text, equal sisters merged."""
    used: set[int] = set()
    for block in found:
        place = block.place
        while place != TOP and place not in used:
            used.add(place)
            place = places[place][0]
    nodes = {TOP: Node("", TOP)}
    for place, (parent, label) in places.items():  # parents come first
        if place in used:
            nodes[place] = Node(label, place)
            nodes[parent].children.append(nodes[place])
    return nodes[TOP]


def dumped(tree: Node) -> str:
    """A tree as a flat list, so that no depth is too much: depth, label, place, mass of each node in order."""
    rows, todo = [], [(tree, 0)]
    while todo:
        node, depth = todo.pop()
        rows.append([depth, node.label, node.place, node.mass])
        todo += [(c, depth + 1) for c in reversed(node.children)]
    return json.dumps(rows)


def loaded(rows: str, masses: dict[int, int] | None = None) -> Node:
    trail: list[Node] = []
    for depth, label, place, mass in json.loads(rows):
        node = Node(label, place, mass if masses is None else masses.get(place, 0))
        del trail[depth:]
        if trail:
            trail[-1].children.append(node)
        trail.append(node)
    return trail[0]


def align(a: Node, b: Node) -> tuple[int, dict[tuple[int, int], list[tuple[int, int]]]]:
    """Simple tree matching: the most nodes that two trees have in common, order kept, and for each
    pair of nodes alike the children that match in it. Children come before their parents in a list
    of pairs to do, so no depth is too much."""
    if a.label != b.label:
        return 0, {}
    score: dict[tuple[int, int], int] = {}
    pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}
    todo = [(a, b, False)]
    while todo:
        x, y, ready = todo.pop()
        if not ready:
            todo.append((x, y, True))
            todo += [(c, d, False) for c in x.children for d in y.children if c.label == d.label]
            continue
        n, m = len(x.children), len(y.children)
        gain = [[score.get((id(c), id(d)), 0) for d in y.children] for c in x.children]
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n):
            for j in range(m):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + gain[i][j])
        score[id(x), id(y)] = best[n][m] + 1
        chosen, i, j = [], n, m
        while i and j:
            if gain[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + gain[i - 1][j - 1]:
                i, j = i - 1, j - 1
                chosen.append((i, j))
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i -= 1
        pairs[id(x), id(y)] = chosen[::-1]
    return score[id(a), id(b)], pairs


def match(a: Node, b: Node) -> int:
    return align(a, b)[0]


def merge(a: Node, b: Node) -> Node:
    """The union of two trees along their simple tree matching; masses add up."""
    pairs = align(a, b)[1]
    out = Node(a.label, a.place, a.mass + b.mass)
    todo = [(a, b, out)]
    while todo:
        x, y, node = todo.pop()
        i = j = 0
        for p, q in pairs[id(x), id(y)]:
            one, two = x.children[p], y.children[q]
            both = Node(one.label, one.place, one.mass + two.mass)
            node.children += [*x.children[i:p], *y.children[j:q], both]
            todo.append((one, two, both))
            i, j = p + 1, q + 1
        node.children += [*x.children[i:], *y.children[j:]]
    return out


def _totals(tree: Node) -> dict[int, int]:
    """Mass under each node, by id."""
    order = tree.walk()
    total = {id(n): n.mass for n in order}
    for node in reversed(order):
        total[id(node)] += sum(total[id(c)] for c in node.children)
    return total


def _pruned(tree: Node, drop: Callable[[Node], bool]) -> Node:
    """The tree without the subtrees to drop."""
    out = Node(tree.label, tree.place, tree.mass)
    todo = [(tree, out)]
    while todo:
        node, copy = todo.pop()
        for c in node.children:
            if not drop(c):
                copy.children.append(Node(c.label, c.place, c.mass))
                todo.append((c, copy.children[-1]))
    return out


def kept_marks(tree: Node) -> list[int]:
    """Places of the marked nodes whose mass outweighs that under no mark."""
    inside = _pruned(tree, lambda n: n.label.endswith(OUT))
    least = _totals(plain := _pruned(inside, lambda n: n.label.endswith(MARK)))[id(plain)]
    total, out, todo = _totals(inside), set(), [inside]
    while todo:
        node = todo.pop()
        if node.label.endswith(MARK):
            if total[id(node)] <= least:
                continue
            out.add(node.place)
        todo += node.children
    return sorted(out)


def without_marks(tree: Node, kept: set[int]) -> Node:
    """The tree without what is never article text, and without marked nodes but those kept."""
    return _pruned(tree, lambda n: n.label.endswith(OUT) or (n.label.endswith(MARK) and n.place not in kept))


def content_root(tree: Node) -> int | None:
    """Place of the outermost article or main node, else of the smallest node that holds all of the mass; None for the top."""
    total = _totals(tree)
    mains, todo = [], [tree]
    while todo:
        node = todo.pop()
        if node.label.split(".")[0] in MAIN:
            if total[id(node)] >= 0.2 * max(1, total[id(tree)]):
                mains.append(node)
        else:
            todo += node.children
    if mains:
        return mains[0].place if len(mains) == 1 else None
    node = tree
    while not node.mass and len(full := [c for c in node.children if total[id(c)]]) == 1 and full[0].children:
        node = full[0]
    return None if node is tree else node.place


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Host and skeleton of each whole page, a number for its text, and its blocks: number, place, mass, whether never article text."""
    for batch in batches:
        rows = []
        for host, source in zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True):
            found, places = blocks(parse(source or ""))
            inner = [b.text for b in found if not b.out and not b.marked] or [b.text for b in found if not b.out]
            listed = [{"block": _number(f"{b.place}\n{b.text}"), "place": b.place, "mass": len(b.text), "out": b.out} for b in found]
            rows.append((host, dumped(skeleton(found, places)), _number("\n".join(inner)), listed))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        block = pa.struct([("block", pa.int64()), ("place", pa.int64()), ("mass", pa.int64()), ("out", pa.bool_())])
        kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(block)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "shape", "whole", "blocks"])


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Skeletons with the masses of their places."""
    for batch in batches:
        both = zip(batch["shape"].to_pylist(), batch["masses"].to_pylist(), strict=True)
        trees = [dumped(loaded(s, {m["place"]: m["mass"] for m in ms})) for s, ms in both]
        yield pa.RecordBatch.from_arrays([batch["host"], pa.array(trees, pa.string())], names=["host", "tree"])


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    trees = [loaded(t) for t in group["tree"].sort_values()]
    return pd.DataFrame({"host": [group["host"].iloc[0]], "tree": [dumped(reduce(merge, trees))]})


def _rooted(group: pd.DataFrame) -> pd.DataFrame:
    out = _merged(group)
    tree = loaded(out["tree"].iloc[0])
    kept = kept_marks(tree)
    root = pd.array([content_root(without_marks(tree, set(kept)))], "Int64")
    return pd.DataFrame({"host": out["host"], "root": root, "kept": [kept]})


def _on_hosts(df: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Each row with its host's wrapper; broadcast while that is small."""
    size = 20 * (1 + F.greatest(F.size("kept"), F.lit(0)) + F.greatest(F.size("template"), F.lit(0)))
    sizes = wrappers.agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("longest")).first()
    small = sizes["n"] <= BROADCAST_HOSTS and (sizes["longest"] or 0) <= LONGEST_WRAPPER  # 40 MB at most
    wrappers = wrappers.withColumnRenamed("host", "h2")
    return df.join(F.broadcast(wrappers) if small else wrappers, F.col("host") == F.col("h2"), "left").drop("h2")


def _frequent(articles: DataFrame) -> DataFrame:
    """host, template: blocks in most of a host's articles (host, blocks), or in all of a few."""
    totals = articles.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    counts = articles.select("host", F.explode("blocks").alias("block")).groupBy("host", "block").agg(F.count(F.lit(1)).alias("n"))
    least = F.when(F.col("total") < FEW, F.col("n") == F.col("total")).otherwise(F.col("n") > TEMPLATE_SHARE * F.col("total"))
    constant = counts.where(F.col("n") > 1).join(totals, "host").where(least)
    return constant.groupBy("host").agg(F.collect_list("block").alias("template"))  # under 1/TEMPLATE_SHARE of an article's blocks


def constants(seen: DataFrame) -> DataFrame:
    """host, template: the numbers of its constant blocks, near-copies counted once.

    A page is known by its text, or, where all but a little of its text is frequent, by its frequent blocks."""
    pages = seen.dropDuplicates(["host", "whole"])
    first = stage(_frequent(pages.select("host", F.array_distinct("blocks.block").alias("blocks"))), "wrap-frequent")
    known = _on_hosts(pages, first.withColumns({"root": F.lit(None).cast("long"), "kept": F.array().cast("array<long>")}))
    known = known.withColumn("template", F.coalesce("template", F.array().cast("array<long>")))
    # pages are told apart by what may be article text
    known = known.withColumn("inner", F.filter("blocks", lambda b: ~b["out"]))
    mass = lambda bs: F.aggregate(bs, F.lit(0).cast("long"), lambda a, b: a + b["mass"])
    rare = F.filter("inner", lambda b: ~F.array_contains("template", b["block"]))
    shared = F.array_sort(F.array_intersect("template", F.array_distinct("inner.block")))
    near = mass(rare) < NEAR_SHARE * mass(F.col("inner"))
    known = known.withColumn("article", F.when(near, F.xxhash64(shared)).otherwise(F.col("whole")))
    articles = known.select("host", "article", F.array_distinct("blocks.block").alias("blocks")).groupBy("host", "article").agg(F.min("blocks").alias("blocks"))
    return _frequent(articles)


def _in_rounds(trees: DataFrame) -> DataFrame:
    """Merge until no host has more than MERGED_AT_ONCE trees; no task merges more than about so many."""
    while True:
        counts = trees.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        if (counts.agg(F.max("n").alias("n")).first()["n"] or 0) <= MERGED_AT_ONCE:
            return trees
        part = F.pmod(F.xxhash64("tree"), F.ceil(2 * F.col("n") / MERGED_AT_ONCE)).alias("part")
        dealt = trees.join(counts, "host").select("host", part, "tree")
        trees = stage(dealt.groupBy("host", "part").applyInPandas(_merged, "host string, tree string"), "wrap-merged")


def induce(pages: DataFrame) -> DataFrame:
    """One wrapper for each host: host, root, marked nodes that are content, and the numbers of its constant blocks."""
    kinds = "host string, shape string, whole long, blocks array<struct<block: long, place: long, mass: long, out: boolean>>"
    seen = stage(pages.select("host", "html").mapInArrow(_shapes, kinds), "wrap-pages")
    constant = stage(constants(seen), "wrap-constant")
    known = _on_hosts(seen, constant.withColumns({"root": F.lit(None).cast("long"), "kept": F.array().cast("array<long>")})).withColumn("template", F.coalesce("template", F.array().cast("array<long>")))
    each = known.select("host", "shape", "template", F.explode_outer("blocks").alias("b"))
    varying = F.when(F.array_contains("template", F.col("b.block")), 0).otherwise(F.coalesce("b.mass", F.lit(0)))
    masses = each.groupBy("host", "shape", F.coalesce("b.place", F.lit(TOP)).alias("place")).agg(F.sum(varying).alias("mass"))
    shapes = masses.groupBy("host", "shape").agg(F.collect_list(F.struct("place", "mass")).alias("masses"))
    trees = shapes.mapInArrow(_weighed, "host string, tree string")
    roots = _in_rounds(stage(trees, "wrap-trees")).groupBy("host").applyInPandas(_rooted, "host string, root long, kept array<long>")
    return stage(roots.join(constant, "host", "left"), "wrappers")


def extract_text(source: str | None, root: int | None, kept: frozenset[int], template: set[int]) -> str:
    """The main text of one page under its host's wrapper."""
    found, places = blocks(parse(source or ""))
    under: dict[int, tuple[bool, bool]] = {TOP: (False, True)}  # by place: under the root, under kept marks only
    for place, (parent, label) in places.items():
        inside, allowed = under[parent]
        under[place] = (inside or place == root, allowed and (place in kept or not label.removesuffix(OUT).endswith(MARK)))
    inner = [b for b in found if not b.out]
    unmarked = [b for b in inner if under[b.place][1]]
    chosen = [b for b in unmarked if under[b.place][0]] if root is not None else []
    chosen = chosen or unmarked or ([] if re.search(r"<(?:article|main)\b", source or "", re.I) else inner)
    chosen = [b for b in chosen if b.main] or chosen
    return "\n".join(b.text for b in chosen if _number(f"{b.place}\n{b.text}") not in template)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = (batch[c].to_pylist() for c in ("html", "root", "kept", "template"))
        texts = [extract_text(h, r, frozenset(k or ()), set(t or ())) for h, r, k, t in zip(*parts, strict=True)]
        sizes = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    hosted = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))
    joined = _on_hosts(hosted, induce(hosted))
    return joined.select("page_id", "url", "html", "root", "kept", "template").mapInArrow(_read, "page_id long, url string, text string, n_chars long")
