"""Main text of web pages by wrapper induction over the pages of a host.

Each host gets two different pages as references, by hash, and so does each layout of a host, the pages
with the same elements around the content. Every page is aligned with the references of its host and of
its layout, whose evidence is kept apart: what either finds is template. So a layout's texts are found
on its own pages, whatever part of the host they are. Alignment: simple tree matching pairs the nodes of two DOM trees from the root down, in order, so that most nodes
match. A text that stays the same at its place in at least half of the host's pages that differ is
template; texts that vary are content. Pairs of pages that are mostly the same are no evidence, so
copies of an article don't turn it into a template. Evidence is summed over all pages of a host or
layout; no task sees a whole host.

Inside an <article> or <main> a text is template only if its place varies on no page that has the place,
and at least half of the host's pages that differ have it.

What stays is judged block by block: a page's <article> or <main>, if it has one, is its content,
less template texts and the parts that markup names as something else (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, comments; by element, role, class or id). Without these elements the
whole body counts, less template texts and blocks that are mostly links.

Defined results: NULL or empty html gives an empty text. A host with one page has no template. A url
that is NULL or has no host is a host of its own. Unclosed elements, stray end tags, unterminated
comments and cut-off tags are read as browsers read them, nearly. Repeated rows give equal rows.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.shared import salted_lookup, stage
from seriesloom.llm.urls import host_of

LAYOUT_DEPTH = 5  # levels of elements that tell layouts apart
SAME_PAGE = 0.5
TEMPLATE_SHARE = 0.5
LEAST_INSIDE = 4  # equal pairs, so at least three pages, before a text inside <article> or <main> is template
LINK_SHARE = 0.7
WIDEST = 4_000_000  # cells of one alignment; wider ones give the same pairs from a few rows of cells at a time
ALIKE = 32  # children of one shape that are weighed together in a wide alignment

# Elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp template svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre search "
    "section select summary table tbody td tfoot th thead tr ul caption".split()
)
ENDS_P = BLOCK - frozenset("html body td th tr tbody thead tfoot option optgroup caption".split())
_ENDS = {
    "li": ("li", "ul ol menu"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "option": ("option", "select"),
    "tbody": ("tbody thead tfoot tr td th", "table"),
    "tfoot": ("tbody thead tfoot tr td th", "table"),
}
ENDS = {tag: (frozenset(a.split()), frozenset(b.split())) for tag, (a, b) in _ENDS.items()}
NO_CONTENT = frozenset("head nav footer aside form button select dialog menu search".split())
NO_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
NO_CONTENT_NAMES = frozenset(
    "nav navbar navigation menu menus topbar breadcrumb breadcrumbs pagination pager sidebar aside footer masthead "
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices alert disclaimer popup modal overlay "
    "comment comments disqus respond reply replies discussion share sharing social related recommended "
    "newsletter subscribe subscription signup login search widget toolbar".split()
)

_TOKEN = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)"
    r"""|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>"""
    r"|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))",
    re.S,
)
_NAMES = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|[\s"'])(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_PART = re.compile(r"[\s_\-]+|(?<=[a-z])(?=[A-Z])")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for tag in RAW}


class Node:
    """A block element or, with ``text``, a run of text in one."""

    __slots__ = ("label", "kids", "text", "path", "linked", "inside", "dropped")

    def __init__(self, label: str, path: str) -> None:
        self.label, self.path = label, path
        self.kids: list[Node] = []
        self.text: str | None = None
        self.linked, self.inside, self.dropped = 0, False, False


def _names(attributes: str) -> tuple[str, bool]:
    """(label part, whether these attributes name something that is no content)."""
    if not attributes or "=" not in attributes:
        return "", bool(attributes) and bool(_HIDDEN.search(attributes))
    label, out = "", bool(_HIDDEN.search(attributes))
    for kind, *values in _NAMES.findall(attributes):
        value = next((v for v in values if v), "")
        if kind.lower() == "role":
            out |= value.strip().lower() in NO_CONTENT_ROLES
        else:
            label = label or "." + re.sub(r"\d+", "", value.strip())
            out |= any(p.lower() in NO_CONTENT_NAMES for p in _PART.split(value))
    return label, out


class _Open:
    """An element that is open."""

    __slots__ = ("tag", "node", "dropped", "inside", "link")

    def __init__(self, tag: str, node: Node, dropped: bool, inside: bool, link: bool) -> None:
        self.tag, self.node, self.dropped, self.inside, self.link = tag, node, dropped, inside, link


class Page:
    """A parsed page: its tree of blocks and its texts in order."""

    def __init__(self, html: str) -> None:
        self.root = Node("#page", "")
        self.texts: list[Node] = []
        self._run: list[str] = []
        self._linked = 0
        self._open = [_Open("#page", self.root, False, False, False)]
        self._read(html)
        self.has_main = any(t.inside and not t.dropped for t in self.texts)

    def _flush(self) -> None:
        if self._run:
            text = "".join(self._run)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                top = self._open[-1]
                leaf = Node("#text", top.node.path)
                leaf.text, leaf.inside, leaf.dropped = text, top.inside, top.dropped
                leaf.linked = self._linked
                top.node.kids.append(leaf)
                self.texts.append(leaf)
            self._run, self._linked = [], 0

    def _add(self, text: str) -> None:
        if text:
            self._run.append(text)
            if self._open[-1].link:
                self._linked += len(text)

    def _pop_to(self, depth: int) -> None:
        if self._run:
            kept = self._open[depth - 1].dropped
            for x in self._open[depth:]:
                if x.tag in BLOCK or x.dropped != kept:
                    self._flush()
                    break
        del self._open[depth:]

    def _find(self, tags: frozenset[str], stop: frozenset[str]) -> int:
        stack = self._open
        for i in range(len(stack) - 1, 0, -1):
            tag = stack[i].tag
            if tag in tags:
                return i
            if tag in stop:
                return 0
        return 0

    def _start(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            if tag in BLOCK:
                self._flush()
            elif tag == "br":
                self._add(" ")
            return
        block = tag in BLOCK
        if block:
            if tag in ENDS_P and (i := self._find(_P, _P_STOPS)):
                self._pop_to(i)
            if tag in ENDS and (i := self._find(*ENDS[tag])):
                self._pop_to(i)
            if tag in _ONCE:
                if any(x.tag == tag for x in self._open):
                    return
                if i := self._find(_HEAD, frozenset()):
                    self._pop_to(i)
            self._flush()
        elif tag == "a" and (i := self._find(_A, BLOCK)):
            self._pop_to(i)
        top = self._open[-1]
        label, out = _names(attributes) if attributes else ("", False)
        inside = top.inside or tag in _MAIN
        if tag in _MAIN or tag in _ONCE:
            out = False
        elif tag in NO_CONTENT or tag == "header" and not top.inside:
            out = True
        dropped = top.dropped or out
        if block or tag == "head":
            node = Node(tag + label, f"{top.node.path}/{tag}{label}")
            top.node.kids.append(node)
        else:
            node = top.node
            if dropped != top.dropped:
                self._flush()
        link = tag == "a" or (top.link and not block)
        self._open.append(_Open(tag, node, dropped, inside, link))

    def _end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        stop = _NONE if tag in BLOCK else BLOCK
        if i := self._find(frozenset((tag,)), stop if tag != "p" else _P_STOPS):
            self._pop_to(i)

    def _read(self, html: str) -> None:
        at = 0
        while found := _TOKEN.search(html, at):
            self._add(html[at : found.start()])
            at = found.end()
            tag = found[2] or found[5]
            if not tag:
                continue
            tag, closing = tag.lower(), found[1] or found[4]
            if closing:
                self._end(tag)
            elif tag in RAW:
                end = _RAW_END[tag].search(html, at)
                at = end.end() if end else len(html)
                self._add(" ")
            elif not found[0].endswith(">"):
                break  # a tag cut off by the end of the page
            else:
                self._start(tag, found[3] or found[6] or "")
        else:
            rest = html[at:]
            cut = re.search(r"</?[a-zA-Z]*\Z", rest)
            self._add(rest[: cut.start()] if cut else rest)
        self._flush()


_P, _A, _HEAD, _NONE = frozenset(("p",)), frozenset(("a",)), frozenset(("head",)), frozenset()
_MAIN, _ONCE = frozenset(("article", "main")), frozenset(("html", "body"))
_P_STOPS = frozenset("table td th li dd dt article section div aside nav header footer main form blockquote body button".split())


# --- simple tree matching -------------------------------------------------------------------


class Matching:
    """Pairs of texts of two pages at the same place."""

    def __init__(self, a: Page, b: Page) -> None:
        self._known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
        self.pairs: list[tuple[Node, Node]] = []
        todo = [(a.root, b.root)]
        while todo:
            x, y = todo.pop()
            if x.text is not None:
                self.pairs.append((x, y))
            else:
                todo += [(x.kids[i], y.kids[j]) for i, j in self._aligned(x, y)[1]]

    def _weight(self, x: Node, y: Node) -> int:
        """Nodes that match, equal texts counting twice."""
        if x.label != y.label:
            return 0
        if x.text is not None:
            return 1 + (x.text == y.text)
        if len(x.kids) == 1 == len(y.kids) and x.kids[0].text is not None and y.kids[0].text is not None:
            return 2 + (x.kids[0].text == y.kids[0].text)
        return 1 + self._aligned(x, y)[0]

    def _aligned(self, x: Node, y: Node) -> tuple[int, list[tuple[int, int]]]:
        """The best weight of pairing the children in order, and the pairs."""
        key = (id(x), id(y))
        if key in self._known:
            return self._known[key]
        m, n = len(x.kids), len(y.kids)
        if m * n > WIDEST:
            best, pairs = _align_wide(self._wide_weights(x, y), m, n)
        else:
            weights = [[self._weight(p, q) for q in y.kids] for p in x.kids]
            best, pairs = _align(weights, m, n)
        self._known[key] = best, pairs
        return best, pairs

    def _wide_weights(self, x: Node, y: Node) -> Callable[[int], np.ndarray]:
        """The weights of a child of ``x`` with all children of ``y``, those of one shape together."""
        groups: dict[tuple, list[int]] = {}
        for j, q in enumerate(y.kids):
            groups.setdefault(_shape(q), []).append(j)
        names: dict[str, int] = {}
        alike = []
        for shape, at in groups.items():
            leaves = [[names.setdefault(t, len(names)) for t in _leaves(y.kids[j])] for j in at] if len(at) >= ALIKE else None
            alike.append((shape, np.array(at), np.array(leaves) if leaves else None))

        def row(i: int) -> np.ndarray:
            p, out = x.kids[i], np.zeros(len(y.kids), np.int32)
            kept, self._known = self._known, {}  # of a wide list only the chosen pairs are kept
            for shape, at, leaves in alike:
                if shape[0] != p.label:
                    continue
                if leaves is None:
                    out[at] = [self._weight(p, y.kids[j]) for j in at]
                else:
                    out[at] = _weights(p, shape, iter(leaves.T), names)
            self._known = kept
            return out

        return row


def _shape(node: Node) -> tuple:
    return node.label, None if node.text is not None else tuple(map(_shape, node.kids))


def _leaves(node: Node) -> Iterator[str]:
    if node.text is not None:
        yield node.text
    for kid in node.kids:
        yield from _leaves(kid)


def _weights(x: Node, shape: tuple, leaves: Iterator[np.ndarray], names: dict[str, int]) -> np.ndarray:
    """The weights of ``x`` with nodes of one shape; ``leaves``: the numbers of their texts, text by text."""
    return _weigh(x, _numbered(shape, leaves), names)


def _numbered(shape: tuple, leaves: Iterator[np.ndarray]) -> tuple:
    label, kids = shape
    return (label, None, next(leaves)) if kids is None else (label, [_numbered(k, leaves) for k in kids], None)


def _weigh(x: Node, like: tuple, names: dict[str, int]) -> np.ndarray | int:
    label, kids, texts = like
    if x.label != label:
        return 0
    if x.text is not None:
        return 1 + (texts == names.get(x.text, -1))
    if len(x.kids) == 1 == len(kids) and x.kids[0].text is not None and kids[0][1] is None:
        return 2 + (kids[0][2] == names.get(x.kids[0].text, -1))
    row: list[np.ndarray | int] = [0] * (len(kids) + 1)
    for p in x.kids:
        above, row = row, [0]
        for j, q in enumerate(kids):
            row.append(np.maximum(np.maximum(above[j + 1], row[j]), above[j] + _weigh(p, q, names)))
    return 1 + row[-1]


def _align_wide(weights: Callable[[int], np.ndarray], m: int, n: int) -> tuple[int, list[tuple[int, int]]]:
    """What ``_align`` gives: some rows of its table are kept, and those between them made again on the way back."""

    def after(above: np.ndarray, w: np.ndarray) -> np.ndarray:
        best = np.maximum(above[1:], np.where(w > 0, above[:-1] + w, 0))
        return np.r_[np.int32(0), np.maximum.accumulate(best)]

    step, kept, row = math.isqrt(max(m, 1)), [], np.zeros(n + 1, np.int32)
    for i in range(m):
        if i % step == 0:
            kept.append(row)
        row = after(row, weights(i))
    best, pairs, j, end = int(row[-1]), [], n, m
    while kept and j:
        table, start = [kept.pop()], len(kept) * step
        for i in range(start, end):
            table.append(after(table[-1], weights(i)))
        i, end = end - start, start
        while i and j:
            here = table[i][j]
            if here == table[i - 1][j]:
                i -= 1
            elif here == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((start + i, j))
    return best, pairs[::-1]


def _align(weights: list[list[int]], m: int, n: int) -> tuple[int, list[tuple[int, int]]]:
    if not m or not n:
        return 0, []
    table = [[0] * (n + 1)]
    for row in weights:
        above, left, out = table[-1], 0, [0]
        for j, w in enumerate(row):
            best = above[j] + w if w else 0
            if above[j + 1] > best:
                best = above[j + 1]
            if left > best:
                best = left
            out.append(best)
            left = best
        table.append(out)
    pairs, i, j = [], m, n
    while i and j:
        here = table[i][j]
        if here == table[i - 1][j]:
            i -= 1
        elif here == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return table[m][n], pairs[::-1]


# --- jobs -----------------------------------------------------------------------------------


def _code(node: Node) -> int:
    return xxhash.xxh3_64_intdigest(f"{node.path}\0{node.text}") >> 1


def layout_of(page: Page) -> int:
    """A hash of the elements outside <article> and <main>, down to LAYOUT_DEPTH, whatever their number."""
    paths, todo = set(), [(page.root, 0)]
    while todo:
        node, depth = todo.pop()
        paths.add(node.path)
        if depth < LAYOUT_DEPTH and not node.label.startswith(("article", "main")):
            todo += [(x, depth + 1) for x in node.kids if x.text is None]
    return xxhash.xxh3_64_intdigest("\0".join(sorted(paths))) >> 1


def _content(page: Page) -> list[Node]:
    return [t for t in page.texts if not t.dropped and (t.inside or not page.has_main)]


def _blocks(page: Page) -> list[dict]:
    """The blocks that may be content, with their codes."""
    kept = (n for n in _content(page) if n.inside or n.linked <= LINK_SHARE * len(n.text))
    return [{"text": n.text, "code": _code(n)} for n in kept]


READ = "page_id long, url string, host string, place long, blocks array<struct<text string, code long>>, code long, inside boolean, compared long, met long, equal long"
READ_SCHEMA = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("host", pa.string()),
        ("place", pa.int64()),
        ("blocks", pa.list_(pa.struct([("text", pa.string()), ("code", pa.int64())]))),
        ("code", pa.int64()),
        ("inside", pa.bool_()),
        ("compared", pa.int64()),
        ("met", pa.int64()),
        ("equal", pa.int64()),
    ]
)


def _compared(page: Page, reference: Page) -> Counter | None:
    """(code, inside, seen) of the reference's texts: seen 2 is equal on the page, 1 has a partner, 0 has none.

    None if the pages are mostly the same.
    """
    pairs = Matching(reference, page).pairs
    same = [p for r, p in pairs if r.text == p.text]
    size = sum(len(t.text) for t in _content(page)) or 1
    if sum(len(p.text) for p in same if not p.dropped and (p.inside or not page.has_main)) > SAME_PAGE * size:
        return None
    seen = {id(r): 1 + (r.text == p.text) for r, p in pairs}
    return Counter((_code(r), r.inside, seen.get(id(r), 0)) for r in reference.texts)


HOSTED = "page_id long, url string, host string, code long, html string, layout long"


def _with_layout(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "host", "code", "html"]
    for batch in batches:
        layouts = [layout_of(Page(t)) for t in (x.as_py() or "" for x in batch.column("html"))]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(layouts, pa.int64())], [*names, "layout"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages beside the references of host and layout, to rows with the page's blocks, and rows of evidence.

    Evidence of a layout has its place, that of a host has none.
    """
    known: dict[int, Page] = {}
    sums: dict[tuple, list[int]] = {}

    def out(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, READ_SCHEMA)

    def evidence() -> pa.RecordBatch:
        rows = [
            {"host": h, "place": at, "code": c, "inside": i, "compared": n, "met": m, "equal": e}
            for (h, at, c, i), (n, m, e) in sums.items()
        ]
        sums.clear()
        return out(rows)

    for batch in batches:
        rows, held = [], 0
        columns = [batch.column(c) for c in ("page_id", "url", "host", "place", "code", "html", "references", "nearest")]
        for page_id, url, host, place, code, text, refs, nearest in zip(*columns, strict=True):
            host, place, code = host.as_py(), place.as_py(), code.as_py()
            html = text.as_py() or ""
            page = Page(html)
            rows.append({"page_id": page_id.as_py(), "url": url.as_py(), "host": host, "place": place, "blocks": _blocks(page)})
            held += len(html)
            met: dict[int, Counter | None] = {}
            for at, listed in ((None, refs), (place, nearest)):
                for one in listed if listed.is_valid and page.texts else ():
                    other = one["code"].as_py()
                    if other == code:
                        continue
                    if other not in met:
                        if other not in known:
                            if len(known) >= 64:
                                known.clear()
                            known[other] = Page(one["html"].as_py())
                        met[other] = _compared(page, known[other])
                    for (text_code, inside, seen), n in (met[other] or {}).items():
                        total = sums.setdefault((host, at, text_code, inside), [0, 0, 0])
                        for k in range(seen + 1):
                            total[k] += n
            if held > 4 << 20:
                yield out(rows)
                rows, held = [], 0
        if rows:
            yield out(rows)
        if len(sums) > 50_000:
            yield evidence()
    if sums:
        yield evidence()


def main_text(html: str, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The content blocks of one page, one a line."""
    return "\n".join(b["text"] for b in _blocks(Page(html)) if b["code"] not in template)


def _ends_of(code: str, html: str) -> list[Column]:
    """The pages with the least and the largest hash: two different ones, if there are."""
    page, order = F.struct(code, html), F.xxhash64(F.lit(0), code)
    return [F.min_by(page, order).alias("r0"), F.max_by(page, order).alias("r1")]


def references(pages: DataFrame, on: str = "host") -> DataFrame:
    """``on`` and two different pages of it, chosen by hash, as ``references``; one if all are copies."""
    picked = pages.where(F.col("html").isNotNull() & F.col(on).isNotNull()).groupBy(on).agg(*_ends_of("code", "html"))
    return picked.select(on, F.array_distinct(F.array("r0", "r1")).alias("references"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row of ``pages`` (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    hosted = rows.withColumn("host", host_of(F.col("url"))).withColumn("code", F.xxhash64("html"))
    hosted = hosted.select("page_id", "url", "host", "code", "html").mapInArrow(_with_layout, HOSTED)
    hosted = hosted.withColumn("place", F.when(F.col("host").isNotNull(), F.xxhash64("host", "layout"))).drop("layout")
    # A layout's pages first, so that a host's are chosen among few and html is parsed once for both.
    by_place = hosted.where("html is not null and place is not null").groupBy("place").agg(
        F.first("host").alias("host"), *_ends_of("code", "html")
    )
    by_place = stage(by_place, "layouts")
    ends = by_place.select("host", F.explode(F.array("r0", "r1")).alias("one")).select("host", "one.code", "one.html")
    chosen = stage(references(ends), "references")
    nearest = by_place.select("place", F.array_distinct(F.array("r0", "r1")).alias("nearest"))
    met = salted_lookup(hosted, chosen, "host", ["page_id", "code"])
    met = salted_lookup(met, nearest, "place", ["page_id", "code"])
    met = met.select("page_id", "url", "host", "place", "code", "html", "references", "nearest")
    read = stage(met.mapInArrow(_read, READ), "read-pages")
    added = [F.sum(c).alias(c) for c in ("compared", "met", "equal")]
    sums = read.where("blocks is null").groupBy("host", "place", "code", "inside").agg(*added)
    often = (F.col("equal") >= 2) & (F.col("equal") >= F.col("met") * TEMPLATE_SHARE)
    always = (F.col("equal") >= LEAST_INSIDE) & (F.col("equal") == F.col("met")) & (F.col("equal") >= F.col("compared") * TEMPLATE_SHARE)
    fixed = stage(sums.where(F.when(F.col("inside"), always).otherwise(often)).select("host", "place", "code"), "templates")
    of_host = fixed.where("place is null").groupBy("host").agg(F.collect_set("code").alias("codes"))
    of_place = fixed.where("place is not null").groupBy("place").agg(F.collect_set("code").alias("more"))
    pages_read = read.where("blocks is not null").select("page_id", "url", "host", "place", "blocks")
    told = salted_lookup(pages_read, of_host, "host", ["page_id", "url"])
    told = salted_lookup(told, of_place, "place", ["page_id", "url"])
    found = lambda codes, b: F.coalesce(F.array_contains(codes, b["code"]), F.lit(False))
    kept = F.filter("blocks", lambda b: ~(found("codes", b) | found("more", b)))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return told.select("page_id", "url", text.alias("text"))
