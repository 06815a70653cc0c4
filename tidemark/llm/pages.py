"""Main text of web pages by wrapper induction per host.

Pages become trees of block elements. Up to ``REFERENCES`` pages of different text per host (those with the smallest
text hashes of all its pages that have text) give the wrapper's nodes; every page of the
host is aligned to each by simple tree matching (the largest order-preserving matching of nodes with equal tags whose
parents match too). Each matched pair of text nodes is a vote: equal text in nearly all pages makes the node part of
the template, varying text makes it a slot. The text of a page is what no reference's template holds, in page order.

Alignment alone cannot tell a menu whose words change from page to page from content, so elements that mark
menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments (by tag, role, class or id) are
cut first, and where a page marks its article, only the article counts. Copies of a reference (all texts of the page
equal) do not vote on it, so a repeated article is not taken for a template, however much of a page is boilerplate.

Votes are sums per (host, reference, node) that tasks add up before they are shuffled; wrappers are one short row per host,
joined to pages as a broadcast only if their measured size is small. Whole pages are never gathered by host.

Defined results: a null page is empty; a null url, or one without a host, belongs to the host ''; hosts with fewer than
``VOTES`` voting pages have no template; repeated rows give the same text; other columns are carried.
"""

from __future__ import annotations

import html as htmllib
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_batches, store

#: Pages that must have voted on a node, and the share of equal votes from which it is template.
VOTES, EQUAL = 5, 0.9
#: Reference pages per host; null, empty and repeated pages take no place.
REFERENCES = 5
#: Wrappers of all hosts together are broadcast up to this many characters.
BROADCAST_CHARS = 16_000_000
#: Blocks nested deeper than this belong to the block around them; their texts stay blocks of their own.
DEEPEST = 200
#: Cells of a table over two lists of children; longer lists are halved at a place of some largest matching until they fit.
CELLS = 1 << 20
#: Pairs of children a task remembers by the shapes of their parents.
PAIRS_HELD = 1_000_000

# HTML elements by role.
BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure "
                   "figcaption address hgroup details summary center nav header footer aside form fieldset dialog menu search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head nav header footer aside form fieldset dialog menu search script style noscript template svg math canvas object iframe button select "
                    "textarea option datalist audio video title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MARKS = frozenset("ad ads advert adverts advertisement adsbygoogle sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
                  "header masthead footer sidebar aside widget cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe signup login share "
                  "sharing social related recommended comment comments reply replies respond disqus pagination pager skip".split())
STARTS = ("advert", "banner", "breadcrumb", "comment", "cookie", "footer", "masthead", "newsletter", "popup", "sidebar", "sponsor")
LAYOUT = frozenset("no has with without wrap wrapper container layout page".split())  # a class about the page's frame, not a part of it
CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "li", "dt", "dd"}
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|(?<![\w-])(hidden)(?![\w=-])", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")


def dropped(tag: str, attrs: str) -> bool:
    """Whether the element holds no main text."""
    if tag in DROPPED:
        return True
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return False
    for name, value, bare in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if bare or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            for word in value.split():
                parts = [p.lower() for p in _PART.findall(word)]
                if not LAYOUT.intersection(parts) and any(p in MARKS or p.startswith(STARTS) for p in parts):
                    return True
    return False


class Node:
    """A block element: tag, children in order (nodes), and for text nodes (tag '#') their text."""

    __slots__ = ("tag", "kids", "text", "main", "number", "shape", "size")

    def __init__(self, tag: str, text: str = "", main: bool = False):
        self.tag, self.kids, self.text, self.main, self.number, self.shape, self.size = tag, [], text, main, -1, 0, 1


def parse(page: str | None) -> Node:
    """The tree of block elements, without what ``dropped`` cuts; text blocks are its leaves ('#')."""
    root = Node("#root")
    stack: list[tuple[str, Node]] = [("#root", root)]  # open elements and the block that holds their text
    text: list[str] = []
    page = page or ""
    skip, at, raw = 0, 0, ""  # skip: size of the stack at which dropping began

    def flush() -> None:
        line = " ".join(htmllib.unescape("".join(text)).split())
        if line:
            stack[-1][1].kids.append(Node("#", line, stack[-1][1].main))
        text.clear()

    def close(to: int) -> None:
        nonlocal skip
        if any(t in BLOCKS for t, _ in stack[to:]) and not skip:
            flush()
        del stack[to:]
        if skip and len(stack) < skip:
            skip = 0

    def find(names: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in stop:
                return 0
        return 0

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if not skip and m.start() > at:
            text.append(page[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if (i := find({tag}, {"article", "main", "body", "td", "th"} - {tag} if tag not in ("html", "body", "main", "article") else set())):
                close(i)
            continue
        if tag in VOID:
            if tag in ("br", "hr", "wbr") and not skip:
                text.append("" if tag == "wbr" else " ")
                if tag == "hr":
                    flush()
            continue
        if tag in CLOSES_P and (i := find({"p"}, BLOCKS - {"p"})):
            close(i)
        if tag in ENDS and (i := find(*ENDS[tag])):
            close(min(i, next((k for k in range(i, 0, -1) if stack[k][0] == tag), i)) if tag == "tr" else i)
        attrs = m[3] or m[6] or ""
        holder = stack[-1][1]
        if not skip:
            cut = dropped(tag, attrs)
            if tag in BLOCKS or cut:
                flush()
            if cut:
                skip = len(stack) + 1
            elif tag in BLOCKS and len(stack) < DEEPEST:
                main = holder.main or tag in ("article", "main") or "main" in attrs and bool(re.search(r"\brole\s*=\s*[\"']?main\b", attrs))
                holder.kids.append(node := Node(tag, "", main))
                holder = node
        if tag in RAW:
            end = re.compile(f"</{tag}\\b[^>]*>", re.I).search(page, at)
            stack.append((tag, holder))
            if not skip:
                text.append(page[at:end.start() if end else len(page)])
            at = end.end() if end else len(page)
            close(len(stack) - 1)
        elif not attrs.endswith("/") or tag in BLOCKS:
            stack.append((tag, holder))
        elif skip == len(stack) + 1:
            skip = 0
    if not skip:
        text.append(page[at:])
        flush()
    return root


def number(root: Node) -> list[Node]:
    """All nodes in page order, numbered, with a hash of the tags below them and the number of nodes there."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        node.number = len(out)
        out.append(node)
        stack += reversed(node.kids)
    for node in reversed(out):
        node.shape = hash((node.tag, *[k.shape for k in node.kids]))
        node.size = 1 + sum(k.size for k in node.kids)
    return out


def _prefixes(rows: np.ndarray, cols: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Weight of the largest matching of all ``rows`` with the first j of ``cols``, for every j, in one line of memory."""
    best = np.zeros(len(cols) + 1, np.int64)
    for r in rows:
        best[1:] = np.maximum(best[1:], best[:-1] + gain[r][cols])
        np.maximum.accumulate(best, out=best)
    return best


def _trace(rows: np.ndarray, cols: np.ndarray, gain: np.ndarray) -> list[tuple[int, int]]:
    """Places of ``rows`` and ``cols`` in a largest matching, from the whole table."""
    best = np.zeros((len(rows) + 1, len(cols) + 1), np.int64)
    for i, r in enumerate(rows):
        best[i + 1, 1:] = np.maximum(best[i, 1:], best[i, :-1] + gain[r][cols])
        np.maximum.accumulate(best[i + 1], out=best[i + 1])
    out, i, j = [], len(rows), len(cols)
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out


def _ends(p: list[Node], q: list[Node]) -> tuple[int, int]:
    """How many subtrees of equal shape two lists begin with, and how many others they end with; in some largest matching
    these belong together."""
    lo, hi, most = 0, 0, min(len(p), len(q))
    while lo < most and p[lo].shape == q[lo].shape:
        lo += 1
    while hi < most - lo and p[-1 - hi].shape == q[-1 - hi].shape:
        hi += 1
    return lo, hi


class Matcher:
    """Simple tree matching. Weights and pairs depend on shapes alone and are remembered by them.

    Two lists of n and m children take n x m steps of array arithmetic and memory in proportion to n + m."""

    def __init__(self):
        self.weights: dict[tuple[int, int], int] = {}
        self.pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.held = 0

    def weight(self, x: Node, y: Node) -> int:
        """Nodes of the largest matching of two subtrees whose roots match."""
        if x.shape == y.shape:
            return x.size
        if not x.kids or not y.kids:
            return 1
        key = x.shape, y.shape
        if key not in self.weights:
            p, q = x.kids, y.kids
            lo, hi = _ends(p, q)
            equal = sum(k.size for k in p[:lo]) + sum(k.size for k in p[len(p) - hi:])
            self.weights[key] = 1 + equal + int(_prefixes(*self.gains(p[lo:len(p) - hi], q[lo:len(q) - hi]))[-1])
        return self.weights[key]

    def gains(self, p: list[Node], q: list[Node]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The kind of every node of both lists by shape, and the weights of all kinds of one with those of the other."""
        kinds: tuple[dict[int, tuple[int, Node]], ...] = ({}, {})
        rows, cols = (np.array([own.setdefault(k.shape, (len(own), k))[0] for k in nodes], np.int64) for own, nodes in zip(kinds, (p, q), strict=True))
        gain = [[self.weight(x, y) if x.tag == y.tag else 0 for _, y in kinds[1].values()] for _, x in kinds[0].values()]
        return rows, cols, np.array(gain, np.int64).reshape(len(kinds[0]), len(kinds[1]))

    def children(self, x: Node, y: Node) -> list[tuple[int, int]]:
        """Places of the children of two matched nodes that belong together."""
        key = x.shape, y.shape
        if key not in self.pairs:
            p, q = x.kids, y.kids
            lo, hi = _ends(p, q)
            out = [(i, i) for i in range(lo)] + [(len(p) - 1 - i, len(q) - 1 - i) for i in range(hi)]
            rows, cols, gain = self.gains(p[lo:len(p) - hi], q[lo:len(q) - hi])
            todo = [(0, len(rows), 0, len(cols))]
            while todo:
                a, b, c, d = todo.pop()
                if b - a <= 1 or (b - a) * (d - c) <= CELLS:
                    out += [(lo + a + i, lo + c + j) for i, j in _trace(rows[a:b], cols[c:d], gain)]
                    continue
                half = (a + b) // 2
                before = _prefixes(rows[a:half], cols[c:d], gain)
                behind = _prefixes(rows[half:b][::-1], cols[c:d][::-1], gain)[::-1]
                cut = c + int(np.argmax(before + behind))
                todo += [(a, half, c, cut), (half, b, cut, d)]
            self.pairs[key] = out
            self.held += len(out) + 1
        return self.pairs[key]

    def match(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """Pairs of the largest matching of two numbered trees with equal roots."""
        if self.held + len(self.weights) > PAIRS_HELD:
            self.__init__()
        out, todo = [], [(a, b)]
        while todo:
            x, y = todo.pop()
            out.append((x, y))
            if x.kids and y.kids:
                todo += [(x.kids[i], y.kids[j]) for i, j in self.children(x, y)]
        return out


def content(root: Node) -> int | None:
    """Hash of all texts of a page; None if it has none."""
    texts = [n.text for n in number(root) if n.tag == "#"]
    return xxhash.xxh64_intdigest("\0".join(texts).encode("utf-8", "replace")) >> 1 if texts else None


def skeleton(root: Node) -> str:
    """The tree as JSON, texts as hashes."""
    def pack(node: Node):
        return xxhash.xxh64_intdigest(node.text.encode("utf-8", "replace")) if node.tag == "#" else [node.tag, *map(pack, node.kids)]

    return json.dumps(pack(root), separators=(",", ":"))


def unpack(spec: str) -> tuple[Node, dict[int, int]]:
    """The tree of a skeleton, numbered, and the text hash by node number."""
    def build(x) -> Node:
        if isinstance(x, int):
            node = Node("#")
            node.text = x
            return node
        node = Node(x[0])
        node.kids = [build(k) for k in x[1:]]
        return node

    root = build(json.loads(spec))
    return root, {n.number: n.text for n in number(root) if n.tag == "#"}


def aligned(root: Node, wrapper: tuple[Node, dict[int, int]], matcher: Matcher) -> list[tuple[Node, int, bool]]:
    """(text node of the page, number of the wrapper's node, equal texts) for all matched text nodes."""
    number(root)
    return [(x, y.number, xxhash.xxh64_intdigest(x.text.encode("utf-8", "replace")) == wrapper[1][y.number]) for x, y in matcher.match(root, wrapper[0]) if x.tag == "#"]


def main_text(root: Node, template: set[int] | None = None) -> str:
    """Texts in page order, of the marked article if the page has one, less nodes (page numbers) of the template."""
    texts = [n for n in number(root) if n.tag == "#" and not (template and n.number in template)]
    if any(n.main for n in texts):
        texts = [n for n in texts if n.main]
    return "\n".join(n.text for n in texts)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every row of ``df`` without its html, plus text and n_chars."""
    host = F.coalesce(F.regexp_extract(F.lower(url_col), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit(""))
    carried = [c for c in df.columns if c not in (html_col, "text", "n_chars")]
    pages = df.select(F.struct(*carried).alias("row"), host.alias("_host"), F.col(html_col).alias("_html"))

    # the wrapper's nodes: per host the outlines of the pages with the smallest text hashes
    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, dict[int, str]] = {}
        for batch in batches:
            for name, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = best.setdefault(name, {})
                if (text := content(root := parse(page))) is not None and (len(own) < REFERENCES or text <= max(own)):
                    spec = skeleton(root)
                    own[text] = min(own.get(text, spec), spec)
                    if len(own) > REFERENCES:
                        del own[max(own)]
            if len(best) > 5000:
                yield outlined(best)
                best.clear()
        yield outlined(best)

    def outlined(best: dict[str, dict[int, str]]) -> pa.RecordBatch:
        rows = [(name, text, spec) for name, own in best.items() for text, spec in own.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["_host", "text", "wrapper"])

    found = map_batches(pages.select("_host", "_html"), outline, "_host string, text long, wrapper string")
    found = found.groupBy("_host", "text").agg(F.min("wrapper").alias("wrapper"))
    place = F.row_number().over(Window.partitionBy("_host").orderBy("text"))
    wrappers = store(found.withColumn("ref", place).where(F.col("ref") <= REFERENCES), "wrappers")
    chars = wrappers.agg(F.coalesce(F.sum(F.length("wrapper") + F.length("_host") + 40), F.lit(0))).first()[0]
    sized = (lambda x: F.broadcast(x)) if chars <= BROADCAST_CHARS else (lambda x: x)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes: Counter = Counter()
        trees: dict[str, tuple] = {}
        matcher = Matcher()
        for batch in batches:
            for name, page, refs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (text := content(root := parse(page))) is None:
                    continue
                if len(trees) > 5000:
                    trees.clear()
                for ref in refs:
                    if ref["text"] != text:
                        if ref["wrapper"] not in trees:
                            trees[ref["wrapper"]] = unpack(ref["wrapper"])
                        for _, node, same in aligned(root, trees[ref["wrapper"]], matcher):
                            votes[name, ref["ref"], node, same] += 1
            if len(votes) > 100_000:
                yield counted(votes)
                votes.clear()
        yield counted(votes)

    def counted(votes: Counter) -> pa.RecordBatch:
        keys = list(votes)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array([votes[k] for k in keys], pa.int64()), pa.array([votes[k] if k[3] else 0 for k in keys], pa.int64())], ["_host", "ref", "node", "pages", "same"])

    by_host = wrappers.groupBy("_host").agg(F.collect_list(F.struct("ref", "text", "wrapper")).alias("refs"))
    joined = pages.select("_host", "_html").join(sized(by_host), "_host").select("_host", "_html", "refs")
    votes = map_batches(joined, vote, "_host string, ref int, node int, pages long, same long").groupBy("_host", "ref", "node").agg(F.sum("pages").alias("pages"), F.sum("same").alias("same"))
    constant = votes.where((F.col("pages") >= VOTES) & (F.col("same") >= EQUAL * F.col("pages"))).groupBy("_host", "ref").agg(F.collect_list("node").alias("nodes"))
    templates = wrappers.join(constant, ["_host", "ref"]).groupBy("_host").agg(F.collect_list(F.struct("wrapper", "nodes")).alias("refs"))
    learned = store(templates, "templates")  # hosts with a template only

    schema = T.StructType([pages.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def pull(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, tuple] = {}
        matcher = Matcher()
        for batch in batches:
            texts = []
            for page, refs in zip(*(batch.column(c).to_pylist() for c in ("_html", "refs")), strict=True):
                root, template = parse(page), set()
                if len(trees) > 5000:
                    trees.clear()
                for ref in refs or []:
                    if ref["wrapper"] not in trees:
                        trees[ref["wrapper"]] = unpack(ref["wrapper"])
                    constant = set(ref["nodes"])
                    template |= {x.number for x, node, same in aligned(root, trees[ref["wrapper"]], matcher) if same and node in constant}
                texts.append(main_text(root, template))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema.names)

    joined = pages.select("row", "_html", "_host").join(sized(learned), "_host", "left").select("row", "_html", "refs")
    return map_batches(joined, pull, schema).select("row.*", "text", "n_chars")
