"""Main text of web pages by wrapper induction.

Pages of one host and layout are aligned with a reference page by simple tree matching. Reference blocks whose text is the
same on most of those pages, versions of one article counted out, are the template; an aligned block that repeats template
text is dropped, and what varies is content. Elements that by tag, role or class are menus, headers, footers, sidebars,
notices, adverts, forms or comments never count as content. Every page takes part in the induction: pages send counts for
the reference's nodes, not their text.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridix.llm.common import materialize, small

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Least pages for a template, least share of them that repeat a node's text, pages from which a layout has a reference of its own, most bytes of references that are broadcast.
LEAST_PAGES, LEAST_SHARE, LAYOUT_PAGES, BROADCAST_BYTES = 3, 0.5, 6, 32 << 20
#: A page is a version of the reference, and proves nothing, if its main text shares COPY_SHARE of what lies between the least share that any page has (the template's) and all; shares are counted in SHARES steps. From MANY_PAGES pages on, what MOST_SHARE of all pages repeat is template too.
COPY_SHARE, SHARES, MANY_PAGES, MOST_SHARE = 0.5, 20, 20, 0.9
#: Elements deeper than this become siblings, but their end tags and furniture count; child lists whose product is larger are cut at anchors.
MOST_DEPTH, MOST_PAIRS = 150, 40_000

# Element names of the HTML standard, and words that name page furniture in classes, ids and roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("script style title noscript iframe template head nav aside footer form button select textarea input dialog menu svg canvas embed audio video map option xmp noembed noframes".split())
# Words that may stand beside one of NAMES in the class of a container, as in ad-slot or comment-list.
STRUCTURE = frozenset("slot box container wrap wrapper list section area widget block unit bar panel inner outer item items group site page".split())
NAMES = frozenset("nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead banner footer sidebar aside notice notices cookie cookies consent ad ads advert adverts advertisement sponsor sponsored promo form search login newsletter signup comment comments commentlist respond reply replies".split())
#: Elements that a name makes furniture by a part of a class or id; inside an article and for other elements a whole class must consist of names.
CONTAINERS = frozenset("div section ul ol dl table nav aside header footer form figure fieldset details menu iframe".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "summary", "figcaption"} | {"p"}
IMPLIED = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

# A tag ends at the next > outside quotes, or stops without one before the next < outside them; its last group tells which.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/><]*)((?>[^>"'<]+|"[^"]*"|'[^']*'|["'])*+)(>?)""", re.S)
UNQUOTED = re.compile(TOKEN.pattern.replace(r"""(?>[^>"'<]+|"[^"]*"|'[^']*'|["'])*+""", "[^<>]*"), re.S)
ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")


class Node:
    """An element: its tag, the label that matching compares, whether it is furniture, and its children (elements and texts)."""

    __slots__ = ("tag", "label", "furniture", "children", "shape", "number", "own")

    def __init__(self, tag: str, label: str, furniture: bool):
        self.tag, self.label, self.furniture = tag, label, furniture
        self.children: list = []
        self.own = ""


def _element(tag: str, attrs: str, inside_article: bool) -> Node:
    names, label, furniture = (), tag, tag in NEVER or tag == "header" and not inside_article
    if attrs and "=" in attrs or attrs.strip() == "hidden":
        got = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTR.findall(attrs)}
        marks = f"{got.get('class', '')} {got.get('id', '')}".lower()
        names = re.findall(r"[a-z]+", marks)
        label = f"{tag}.{got.get('class', '').strip().lower()}" if got.get("class") else tag
        if tag not in ("html", "body", "main", "article") or "comment" in names or "comments" in names:
            if tag not in ("html", "body", "main", "article") and (inside_article or tag not in CONTAINERS):
                parts = [set(re.split(r"[-_]+", c.strip("-_"))) for c in got.get("class", "").lower().split()]
                if tag in CONTAINERS:
                    furniture |= any(NAMES & p and p <= NAMES | STRUCTURE for p in parts) or got.get("id", "").lower() in ("comments", "respond")
                elif not inside_article:
                    furniture |= any(p <= NAMES for p in parts)
            else:
                furniture |= not NAMES.isdisjoint(names)
        furniture |= got.get("role", "").lower() in ROLES or "hidden" in got or got.get("aria-hidden", "").lower() == "true" or "display:none" in got.get("style", "").replace(" ", "").lower()
    return Node(tag, label, furniture)


def _token(text: str, at: int, tried: int) -> tuple[re.Match | None, int]:
    """The next comment, declaration or tag from ``at`` on. Text up to ``tried`` had its quotes followed in vain already: there, tags are read without them, so that no stretch is followed twice."""
    at = text.find("<", at)
    while at >= 0:
        m = (UNQUOTED if at < tried else TOKEN).match(text, at)
        if m and m[2] and not m[4] and at >= tried:
            tried = m.end()
            m = UNQUOTED.match(text, at)
        if m and (m[4] or not m[2]):
            return m, tried
        at = text.find("<", m.end() if m else at + 1)
    return None, tried


def parse(html: str | None) -> Node:
    """The element tree of a page, with the standard's implied end tags for paragraphs, list items and table cells; broken markup never fails."""
    root = Node("", "", False)
    stack, at, text, articles = [root], 0, html or "", 0
    # Open elements below the stack, each with the node that takes what it holds.
    below: list[tuple[Node, Node]] = []
    open_below: Counter = Counter()
    into = lambda: below[-1][1] if below else stack[-1]
    tried = 0
    while True:
        m, tried = _token(text, at, tried)
        if not m:
            break
        if m.start() > at:
            into().children.append(text[at : m.start()])
        at = m.end()
        tag, closing, attrs = (m[2] or "").lower(), m[1], m[3] or ""
        if not tag:
            continue
        if closing:
            depth = -1
            if open_below[tag]:
                depth = next(k for k in range(len(below) - 1, -1, -1) if below[k][0].tag == tag)
                gone = Counter(n.tag for n, _ in below[depth:])
                articles -= gone["article"]
                open_below.subtract(gone)
                del below[depth:]
            if depth >= 0:
                if tag in BLOCKS:
                    into().children.append(Node(tag, tag, False))
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    articles -= sum(n.tag == "article" for n in stack[depth:]) + sum(n.tag == "article" for n, _ in below)
                    below.clear()
                    open_below.clear()
                    del stack[depth:]
                    break
            continue
        if not below and tag in CLOSES_P and any(n.tag == "p" for n in stack[-8:]):
            depth = max(k for k in range(max(0, len(stack) - 8), len(stack)) if stack[k].tag == "p")
            if not any(n.tag in ("article", "div", "section", "td", "li", "body") for n in stack[depth + 1 :]):
                del stack[depth:]
        if not below and tag in IMPLIED:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in STOPS[tag]:
                    break
                if stack[depth].tag in IMPLIED[tag]:
                    del stack[depth:]
                    break
        node = _element(tag, attrs, articles > 0)
        into().children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^<>]*>", re.I).search(text, at)
            at = end.end() if end else len(text)
        elif tag not in VOID and not attrs.rstrip().endswith("/"):
            if len(stack) < MOST_DEPTH:
                stack.append(node)
            else:
                below.append((node, node if node.furniture and not (below and below[-1][1].furniture) else into()))
                open_below[tag] += 1
            articles += tag == "article"
    if at < len(text):
        into().children.append(text[at:])
    _finish(root)
    return root


def _finish(root: Node) -> None:
    """Preorder number, shape (of the labels below) and, for blocks, the text of every node: its own and that of inline elements in it."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        node.number = len(order)
        order.append(node)
        todo.extend(c for c in reversed(node.children) if type(c) is not str)
    inline: dict[int, str] = {}
    for node in reversed(order):
        text = "".join(unescape(c) if type(c) is str else " " if c.tag in BLOCKS or c.tag == "br" else inline[id(c)] for c in node.children if type(c) is str or not c.furniture)
        if node.tag in BLOCKS or not node.tag:
            node.own = " ".join(text.split())
        inline[id(node)] = text
        node.shape = hash((node.label, *(c.shape for c in node.children if type(c) is not str)))


def anchors(x: list[Node], y: list[Node]) -> list[tuple[int, int]]:
    """Places of equal nodes (shape and text), the first with the first and so on, and of those the longest run that keeps their order."""
    where: dict[tuple[int, str], tuple[list[int], list[int]]] = {}
    for side, nodes in enumerate((x, y)):
        for k, n in enumerate(nodes):
            where.setdefault((n.shape, n.own), ([], []))[side].append(k)
    pairs = sorted(pair for i, j in where.values() for pair in zip(i, j, strict=False))
    # Longest increasing run of the second places, by the smallest end of a run of each length.
    ends, at, before = [], [], []
    for k, (_, q) in enumerate(pairs):
        n = bisect_left(ends, q)
        ends[n : n + 1], at[n : n + 1] = [q], [k]
        before.append(at[n - 1] if n else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def in_order(x: list[Node], y: list[Node]) -> list[tuple[Node, Node]]:
    """Each node with the next free one of its label; one pass."""
    places: dict[str, list[int]] = {}
    for k in range(len(y) - 1, -1, -1):
        places.setdefault(y[k].label, []).append(k)
    out, least = [], 0
    for p in x:
        free = places.get(p.label, [])
        while free and free[-1] < least:
            free.pop()
        if free:
            least = free.pop() + 1
            out.append((p, y[least - 1]))
    return out


def matched(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Aligned nodes of two trees by simple tree matching: the most pairs with equal labels that keep order and ancestry.

    Child lists whose product is over MOST_PAIRS are cut at anchors first (equal nodes) and
    matched between them; what lies between two anchors and is still too long pairs in order."""
    memo: dict[tuple[int, int], int] = {}

    def weight(p: Node, q: Node) -> int:
        if p.label != q.label:
            return 0
        key = (p.shape, q.shape)
        if key not in memo:
            x, y = ([c for c in n.children if type(c) is not str] for n in (p, q))
            memo[key] = 1 + sum(weight(c, d) for c, d in aligned(x, y))
        return memo[key]

    def aligned(x: list[Node], y: list[Node]) -> list[tuple[Node, Node]]:
        if len(x) * len(y) > MOST_PAIRS:
            return between(x, y, anchors(x, y))
        best = [[0] * (len(y) + 1)]
        for p in x:
            above, row = best[-1], [0]
            for k, q in enumerate(y):
                w = weight(p, q)
                row.append(max(above[k + 1], row[k], above[k] + w) if w else max(above[k + 1], row[k]))
            best.append(row)
        i, j, found = len(x), len(y), []
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append((x[i], y[j]))
        return found

    def between(x: list[Node], y: list[Node], fixed: list[tuple[int, int]]) -> list[tuple[Node, Node]]:
        out, i, j = [], 0, 0
        for p, q in [*fixed, (len(x), len(y))]:
            gap = x[i:p], y[j:q]
            out += aligned(*gap) if len(gap[0]) * len(gap[1]) <= MOST_PAIRS else in_order(*gap)
            if p < len(x):
                out.append((x[p], y[q]))
            i, j = p + 1, q + 1
        return out

    out, todo = [], [(a, b)]
    while todo:
        p, q = todo.pop()
        out.append((p, q))
        x, y = ([c for c in n.children if type(c) is not str] for n in (p, q))
        todo += aligned(x, y)
    return out


class References:
    """Reference pages of a task, parsed once each; the oldest gives way beyond MOST."""

    MOST = 256

    def __init__(self):
        self.trees: dict[str, Node] = {}

    def __call__(self, html: str) -> Node:
        if html not in self.trees:
            if len(self.trees) >= self.MOST:
                self.trees.pop(next(iter(self.trees)))
            self.trees[html] = parse(html)
        return self.trees[html]


def _size(node: Node) -> int:
    return len(node.own) + sum(_size(c) for c in node.children if type(c) is not str and not c.furniture)


def _numbers(area: Node) -> dict[int, int]:
    """Numbers of an area's blocks without furniture, and the lengths of their texts."""
    found, todo = {}, [area]
    while todo:
        node = todo.pop()
        found[node.number] = len(node.own)
        todo += [c for c in node.children if type(c) is not str and not c.furniture]
    return found


def _main(root: Node) -> Node:
    """The largest outermost article that isn't furniture, if it holds most of the text of the largest main element; else that element, else the page."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    todo = [root]
    while todo:
        node = todo.pop()
        if node.furniture:
            continue
        if node.tag in found:
            found[node.tag].append(node)
        if node.tag != "article":
            todo += [c for c in reversed(node.children) if type(c) is not str]
    article, main = (max(found[tag], key=_size, default=None) for tag in ("article", "main"))
    if article and (not main or 2 * _size(article) > _size(main)):
        return article
    return main or root


def blocks_of(node: Node, dropped: set[int]) -> list[str]:
    """The text blocks below a node in page order, without furniture and template nodes; white space inside a block is one space."""
    out, run = [], []

    def end():
        block = " ".join("".join(run).split())
        run.clear()
        if block:
            out.append(block)

    def walk(n: Node, block: Node):
        for c in n.children:
            if type(c) is str:
                if id(block) not in dropped:
                    run.append(unescape(c))
            elif c.tag == "br":
                run.append(" ")
            elif c.furniture:
                if c.tag in BLOCKS:
                    end()
            elif c.tag in BLOCKS:
                end()
                walk(c, c)
                end()
            else:
                walk(c, block)

    walk(node, node)
    end()
    return out


def main_text(html: str | None, reference: Node | None = None, template: frozenset[int] | set[int] = frozenset()) -> str:
    """Main text of a page; ``template`` numbers the nodes of the reference whose text belongs to the template. A page that holds nothing else has no text."""
    page = parse(html)
    dropped: set[int] = set()
    if reference and template:
        dropped = {id(p) for p, r in matched(page, reference) if r.number in template and p.own and p.own == r.own}
    return "\n\n".join(blocks_of(_main(page), dropped))


def _layout(html):
    """A number for the classes of the page's containers, digits aside, and for whether it has an article or a main element."""
    classes = F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?i)<(?:body|div|section|main|article|table|ul|ol)\b[^>]*?\bclass\s*=\s*[\x22']?([^\x22'>]*)"), F.lit(1)))
    return F.xxhash64(F.array_sort(F.array_distinct(F.transform(classes, lambda c: F.regexp_replace(c, "[0-9]+", "0")))), F.contains(html, F.lit("<article")), F.contains(html, F.lit("<main")))


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars.

    Null and empty html has an empty text; broken markup is read as far as it goes. Pages without a url form one host. A
    layout (_layout) with LAYOUT_PAGES pages of a host has a reference page of its own, the host's other pages share one;
    fewer than LEAST_PAGES pages have no template. Of equal pages each keeps its row; null ids stay null; other columns are
    ignored; an empty table gives no rows."""
    host = F.coalesce(F.lower(F.try_parse_url(F.col("url"), F.lit("HOST"))), F.lit(""))
    p = pages.select(F.col("page_id").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("host", host).withColumn("layout", _layout(F.col("html")))
    own = materialize(p.groupBy("host", "layout").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LAYOUT_PAGES).select("host", "layout", F.lit(True).alias("own")), "html-layouts")
    p = p.join(small(own, own.count()), ["host", "layout"], "left").withColumn("layout", F.when(F.col("own"), F.col("layout")).otherwise(F.lit(0).cast("long"))).drop("own")
    chosen = p.groupBy("host", "layout").agg(F.min_by("html", F.xxhash64("html", "url")).alias("reference"), F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    refs = materialize(chosen, "html-references")

    def near(table: DataFrame) -> DataFrame:
        # Beyond that size the join is shuffled, and Spark splits the pages of a skewed host, since each has one reference.
        bytes_ = refs.agg(F.sum(F.octet_length("reference"))).first()[0] or 0
        return F.broadcast(table) if bytes_ <= BROADCAST_BYTES else table

    def compare(batches):
        # Counts of pages by node and by the share of main text that they have in common with the reference; node -1 counts pages.
        same: dict[tuple[str, int, int, int], int] = {}
        trees = References()
        for batch in batches:
            for host, layout, html, reference in zip(*(batch.column(c).to_pylist() for c in ("host", "layout", "html", "reference")), strict=True):
                page, model = parse(html), trees(reference)
                alike = [(a, b) for a, b in matched(page, model) if b.own and a.own == b.own]
                inside, outside = _numbers(_main(model)), _numbers(_main(page))
                common = sum(len(b.own) for a, b in alike if b.number in inside and a.number in outside)
                share = SHARES * common // max(1, min(sum(inside.values()), sum(outside.values())))
                for number in [-1, *(b.number for _, b in alike)]:
                    key = (host, layout, number, share)
                    same[key] = same.get(key, 0) + 1
            if len(same) > 200_000:
                yield _counted(same)
                same = {}
        yield _counted(same)

    group = ["host", "layout"]
    seen = p.join(near(refs.select(*group, "reference")), group).select(*group, "html", "reference").mapInArrow(compare, "host string, layout long, node int, share int, same long").groupBy(*group, "node", "share").agg(F.sum("same").alias("same"))
    seen = materialize(seen, "html-support")
    least = seen.where("node < 0").groupBy(*group).agg(F.min("share").alias("least"))
    far = F.col("share") < F.col("least") + COPY_SHARE * (SHARES - F.col("least"))
    seen = seen.join(least, group).groupBy(*group, "node").agg(F.sum("same").alias("same"), F.coalesce(F.sum(F.when(far, F.col("same"))), F.lit(0)).alias("far"))
    others = seen.where("node < 0").select(*group, F.col("far").alias("others"))
    # The reference is one page more.
    independent = (F.col("far") + 1 >= LEAST_SHARE * (F.col("others") + 1)) & (F.col("far") + 1 >= LEAST_PAGES)
    everywhere = (F.col("pages") >= MANY_PAGES) & (F.col("same") >= MOST_SHARE * F.col("pages"))
    constant = seen.where("node >= 0").join(refs.select(*group, "pages"), group).join(others, group).where(independent | everywhere).groupBy(*group).agg(F.collect_list("node").alias("template"))
    wrappers = materialize(refs.join(constant, group).select(*group, "reference", "template"), "html-wrappers")

    def text_of(batches):
        trees = References()
        for batch in batches:
            texts = [main_text(h, r and trees(r), set(t or ())) for h, r, t in zip(*(batch.column(c).to_pylist() for c in ("html", "reference", "template")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return p.join(near(wrappers), group, "left").select("page_id", "url", "html", "reference", "template").mapInArrow(text_of, f"page_id {kind}, url string, text string, n_chars long")


def _counted(same: dict) -> pa.RecordBatch:
    columns = list(zip(*((*k, n) for k, n in same.items()), strict=True)) or [()] * 5
    types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["host", "layout", "node", "share", "same"])
