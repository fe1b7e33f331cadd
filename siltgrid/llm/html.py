"""Main text of web pages by wrapper induction.

Pages of a host share a layout. Each page's DOM is reduced to its skeleton: block elements by tag and
first class, runs of equal siblings as one node. A host's most frequent skeleton is the pivot, and
each page's skeleton is aligned with it by simple tree matching. Over all pages of the host, a pivot
node whose own text is (nearly) always the same is template; one whose text varies is a slot. What the
elements themselves declare comes first: menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments are never content, though their text may vary from page to page (as
menus and adverts do); a header inside an article holds its title and is. Then slots are content and
template nodes are not. An article stays whole, with headings that stand in every article, if anything in it
varies, and text beside it counts only where it is longer than the article; an article that never varies is
template. Where the wrapper has no verdict (a node has no counterpart, or too few pages have it) or leaves
nothing of a page, a page that names its article gives what is in it, and else everything.

Only skeletons and hashes of node texts are shuffled, with counts summed before they travel; a host of
any size is one wrapper row. The wrappers are broadcast when a count shows that they are few, and else
joined by host.

A null html gives an empty text, as does a page without content. Ill-formed markup is read as browsers
do in the common cases: paragraphs close each other, end tags without a start are skipped. Pages of any
length and depth are read whole and once, without recursion. Long lists of children are matched row by row
in little memory; the time grows with the product of what two lists have between their equal ends. Repeated rows are extracted one by one, also where
they share an id. Other columns, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .urls import split_url

START = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
#: The rest of a tag up to its end; nothing is read twice.
REST = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
CLASS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript iframe template svg".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math semantics mrow mi mn mo ms mtext mstyle mfrac msqrt mroot msub msup msubsup mover munder munderover".split())
#: The open elements that a start tag closes.
CLOSES = {"li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "tr": ("p", "td", "th", "tr"), "option": ("option",)}
#: Elements, and words of a class, id or role, that are never content.
CHROME_TAGS = frozenset("nav header footer aside form menu dialog head button select option".split()) | RAW
CHROME_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header footer sidebar aside ad ads advert advertisement adverts sponsor sponsored promo banner cookie cookies consent notice notices alert popup modal newsletter subscribe share sharing social related comment comments commentlist disqus respond pagination pager search toolbar widget masthead contentinfo complementary".split()
)
#: Words that may stand beside those in the name of what is chrome; with any other word, the name says something else.
NEUTRAL_WORDS = frozenset(
    "site page main global top bottom left right primary secondary inner outer box block bar list item items link links wrap wrapper container content section area slot unit button buttons icons form row col panel post posts article articles story stories entry the and a".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A class that begins so tells what the page has beside the element.
MODIFIERS = frozenset("no not has with without hide".split())
#: What makes an element chrome: a class, id or role, which gives way where it holds the page's only main element, or its tag.
BY_CLASS, BY_TAG = 1, 2
MAIN_TAGS = frozenset(("article", "main"))
#: A pivot node is template if at least so many pages have it and so large a part of them the same text.
TEMPLATE_PAGES, TEMPLATE_SHARE = 4, 0.8
#: Wrappers are broadcast up to so many hosts.
BROADCAST_HOSTS = 5000


class Node:
    """A block element. shown, named: whether a main element is in it, outside all chrome or outside what its tag makes chrome."""

    __slots__ = ("label", "tag", "chrome", "main", "children", "number", "shown", "named")

    def __init__(self, label: str, tag: str, chrome: int, main: bool):
        self.label, self.tag, self.chrome, self.main = label, tag, chrome, main
        self.children: list[Node | str] = []
        self.number = -1
        self.shown = self.named = False


def says_chrome(token: str) -> bool:
    """Whether a class, id or role names chrome: site-footer and share-box do, no-sidebar, page-header-fixed and share-price don't."""
    words = [w for w in re.split(r"[^a-z]+", token) if w]
    if not words or words[0] in MODIFIERS or CHROME_WORDS.isdisjoint(words):
        return False
    return all(w in CHROME_WORDS or w in NEUTRAL_WORDS for w in words)


def new_node(tag: str, attributes: str, in_main: bool = False) -> Node:
    """A node of a start tag; the header of an article holds its title and is not chrome."""
    values = [(k.lower(), (a or b or c).lower()) for k, a, b, c in CLASS.findall(attributes)] if attributes else []
    first = next((re.sub(r"[^a-z0-9_-]", "", v.split()[0]) for k, v in values if k == "class" and v.split()), "")
    main = tag in MAIN_TAGS or any("articlebody" in re.split(r"[^a-z0-9]+", v) for _, v in values)
    chrome = 0
    if tag in CHROME_TAGS and not (tag == "header" and in_main):
        chrome = BY_TAG
    elif tag not in HEADINGS and tag not in MAIN_TAGS and tag not in ("html", "body") and any(says_chrome(w) for _, v in values for w in v.split()):
        chrome = BY_CLASS
    return Node(f"{tag}.{first}" if first else tag, tag, chrome, main)


def tokens(html: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, tag, attributes) of each tag; comments and declarations have no tag. A value sent is where to go on.

    The page is read once: where no `>` follows, the rest is text up to the next comment; where the quotes of a tag never
    close, tags from there on end at the first `>`.
    """
    at, loose = 0, False
    while (m := START.search(html, at)) is not None:
        if m[1]:
            end = html.find("-->", m.end())
            at = len(html) if end < 0 else end + 3
            yield m.start(), at, "", "", ""
            continue
        rest = None if loose else REST.match(html, m.end())
        end = rest.end() if rest else html.find(">", m.end()) + 1
        if not end:
            comment = html.find("<!--", m.end())
            if comment >= 0:
                yield comment, len(html), "", "", ""
            return
        loose = loose or rest is None
        at = end
        moved = yield m.start(), end, m[2] or "", (m[3] or "").lower(), (rest[1] if rest else html[m.end() : end - 1]) if m[3] else ""
        if moved is not None:
            at = moved


class Names:
    """For each name the places of its tags, found in one pass when first asked for."""

    def __init__(self, html: str) -> None:
        self.html = html
        self.at: dict[str, tuple[list[int], list[bool]]] | None = None

    def closed_later(self, tag: str, at: int) -> bool:
        """Whether the element that a self-closing start tag would open is closed: then it is open, as browsers read it."""
        if self.at is None:
            self.at = {}
            for m in NAME.finditer(self.html):
                places, ends = self.at.setdefault(m[2].lower(), ([], []))
                places.append(m.start())
                ends.append(bool(m[1]))
        places, ends = self.at.get(tag, ([], []))
        next_ = bisect.bisect_left(places, at)
        return next_ < len(places) and ends[next_]


def _sent(found: Iterator, at: int):
    """The next token from a place on, or None."""
    try:
        return found.send(at)
    except StopIteration:
        return None


def parse(html: str) -> Node:
    """The tree of block elements; inline elements leave their text where it stands."""
    root = Node("#", "#", 0, False)
    stack, at, n = [root], 0, len(html)
    open_tags = {"#": 1}  # how many open elements have a tag: an end tag without a start is skipped at once
    made, names = [root], Names(html)
    mains = 0  # open main elements

    def close(above: int) -> None:
        nonlocal mains
        for node in stack[above:]:
            open_tags[node.tag] -= 1
            mains -= node.main
        del stack[above:]

    found = tokens(html)
    token = next(found, None)
    while token is not None:
        start, end, slash, tag, attributes = token
        if start > at:
            stack[-1].children.append(html[at:start])
        at = end
        if tag in RAW and not slash:
            if not (attributes.endswith("/") and (tag == "svg" or not names.closed_later(tag, at))):
                closing = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = closing.end() if closing else n
            token = None if at == n else _sent(found, at)
            continue
        token = next(found, None)
        if not tag or tag in RAW and not slash:
            continue
        if slash:
            if open_tags.get(tag):
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        empty = attributes.endswith("/") and not names.closed_later(tag, at)
        if tag == "br":
            stack[-1].children.append(" ")
        if tag in VOID or tag in INLINE or empty:
            continue
        closes = CLOSES.get(tag, ("p",))
        while len(stack) > 1 and stack[-1].tag in closes:
            close(len(stack) - 1)
        node = new_node(tag, attributes, bool(mains))
        made.append(node)
        stack[-1].children.append(node)
        stack.append(node)
        mains += node.main
        open_tags[tag] = open_tags.get(tag, 0) + 1
    if at < n:
        stack[-1].children.append(html[at:])
    for node in reversed(made):  # parents are made before their children
        inside = [c for c in node.children if isinstance(c, Node)]
        node.shown = node.chrome < BY_CLASS and (node.main or any(c.shown for c in inside))
        node.named = node.chrome < BY_TAG and (node.main or any(c.named for c in inside))
    return root


def number(root: Node) -> tuple[str, list[list[Node]]]:
    """The skeleton as text, and the page's nodes behind each skeleton node in its order; nodes get its numbers."""
    behind: list[list[Node]] = []
    out: list[str] = []
    todo: list[list[Node] | str] = [[root]]
    while todo:
        group = todo.pop()
        if isinstance(group, str):
            out.append(group)
            continue
        runs: list[list[Node]] = []
        for node in group:
            node.number = len(behind)
            for child in node.children:
                if isinstance(child, Node):
                    if runs and runs[-1][0].label == child.label:
                        runs[-1].append(child)
                    else:
                        runs.append([child])
        behind.append(group)
        out.append(group[0].label)
        if runs:
            out.append("(")
            todo.append(")")
            for i in range(len(runs) - 1, -1, -1):
                todo.append(runs[i])
                if i:
                    todo.append(",")
    return "".join(out), behind


def read_skeleton(text: str) -> list[tuple[str, list[int]]]:
    """Labels and children of a skeleton's nodes, in order."""
    nodes: list[tuple[str, list[int]]] = []
    stack: list[int] = []
    for label, mark in re.findall(r"([^(),]*)([(),]|$)", text):
        if label:
            if stack:
                nodes[stack[-1]][1].append(len(nodes))
            nodes.append((label, []))
            if mark == "(":
                stack.append(len(nodes) - 1)
        if mark == ")":
            stack.pop()
    return nodes


def shapes(nodes: list[tuple[str, list[int]]], known: dict[tuple, int], sizes: list[int]) -> list[int]:
    """A number for each node's subtree, equal for equal ones; sizes gets the nodes of each new one."""
    out = [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        label, children = nodes[i]
        key = (label, *(out[c] for c in children))
        if key not in known:
            known[key] = len(sizes)
            sizes.append(1 + sum(sizes[out[c]] for c in children))
        out[i] = known[key]
    return out


#: Cells of a table of a match that are kept for the way back; longer lists are halved.
CELLS = 1_000_000


def _longest(left: list[int], n: int, equal: np.ndarray) -> np.ndarray:
    """The last row where each match weighs one: the zeros of a bit vector over right are where the row rises."""
    masks = [int.from_bytes(np.packbits(row, bitorder="little").tobytes(), "little") for row in equal]
    full = (1 << n) - 1
    bits = full
    for x in left:
        both = bits & masks[x]
        bits = (bits + both | bits - both) & full
    rises = 1 - np.unpackbits(np.frombuffer(bits.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n].astype(np.int64)
    return np.append(0, np.cumsum(rises))


def _scores(left: list[int], right: list[int], weight: np.ndarray, columns: np.ndarray, back: bool = False) -> np.ndarray:
    """Rows of the greatest weight of order-keeping matches of left's beginnings (all of them if back, else the last) with right's."""
    if not back and weight.max() <= 1:
        return _longest(left, len(right), weight[:, columns] > 0)
    row = np.zeros(len(right) + 1, np.int64)
    rows = [row]
    for x in left:
        row = np.append(0, np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weight[x, columns])))
        if back:
            rows.append(row)
    return np.array(rows) if back else row


def best_pairs(left: list[int], right: list[int], weight: np.ndarray) -> list[tuple[int, int]]:
    """Places of the heaviest order-keeping match of two lists; weight is by kinds. In memory of one row and CELLS cells, whatever the lengths."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(left), 0, len(right))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        columns = np.array(right[c:d])
        if (b - a) * (d - c) <= CELLS or b - a == 1:
            table = _scores(left[a:b], right[c:d], weight, columns, back=True)
            x, y = b - a, d - c
            while x and y:
                if table[x, y] == table[x - 1, y]:
                    x -= 1
                elif table[x, y] == table[x, y - 1]:
                    y -= 1
                else:
                    x, y = x - 1, y - 1
                    found.append((a + x, c + y))
            continue
        half = (a + b) // 2
        upper = _scores(left[a:half], right[c:d], weight, columns)
        lower = _scores(left[half:b][::-1], right[c:d][::-1], weight, columns[::-1])
        cut = c + int((upper + lower[::-1]).argmax())
        todo += [(a, half, c, cut), (half, b, cut, d)]
    return found


@lru_cache(maxsize=4000)
def match_trees(a_text: str, b_text: str) -> tuple[int, ...]:
    """Simple tree matching: for each node of a, the node of b that the largest order-keeping match of equal labels gives it, or -1.

    Equal subtrees match as they are, and equal ones at both ends of two lists of children match each other, which no other
    match can better. What is left between them is compared by kinds of subtrees, each two kinds once.
    """
    a, b = read_skeleton(a_text), read_skeleton(b_text)
    if not a or not b or a[0][0] != b[0][0]:
        return (-1,) * len(a)
    known, sizes = {}, []
    kind_a, kind_b = shapes(a, known, sizes), shapes(b, known, sizes)
    kinds = [()] * len(sizes)
    for key, number_ in known.items():
        kinds[number_] = key

    def trimmed(p: int, q: int) -> tuple[int, int, int]:
        """Equal children at the beginning and at the end of two kinds, and where q's end begins less where p's does."""
        left, right = kinds[p][1:], kinds[q][1:]
        most = min(len(left), len(right))
        start = next((i for i in range(most) if left[i] != right[i]), most)
        end = next((i for i in range(most - start) if left[-1 - i] != right[-1 - i]), most - start)
        return start, end, len(right) - len(left)

    weights: dict[tuple[int, int], int] = {}
    wanted = [(kind_a[0], kind_b[0])]
    for p, q in wanted:  # grows: kinds that may match if their parents do
        if p == q or (p, q) in weights:
            continue
        weights[p, q] = 0
        start, end, _ = trimmed(p, q)
        left, right = set(kinds[p][1 + start : len(kinds[p]) - end]), set(kinds[q][1 + start : len(kinds[q]) - end])
        by_label: dict[str, list[int]] = {}
        for y in right:
            by_label.setdefault(kinds[y][0], []).append(y)
        wanted += [(x, y) for x in left for y in by_label.get(kinds[x][0], ()) if x != y and (x, y) not in weights]

    def middle(p: int, q: int) -> tuple[int, int, list[int], list[int], np.ndarray]:
        start, end, _ = trimmed(p, q)
        left, right = kinds[p][1 + start : len(kinds[p]) - end], kinds[q][1 + start : len(kinds[q]) - end]
        at_left, at_right = ({k: i for i, k in enumerate(dict.fromkeys(x))} for x in (left, right))
        table = np.zeros((max(1, len(at_left)), max(1, len(at_right))), np.int64)
        for x, i in at_left.items():
            for y, j in at_right.items():
                if kinds[x][0] == kinds[y][0]:
                    table[i, j] = sizes[x] if x == y else weights[x, y]
        return start, end, [at_left[x] for x in left], [at_right[y] for y in right], table

    for p, q in sorted(weights, key=lambda x: sizes[x[0]]):  # children are smaller
        start, end, left, right, table = middle(p, q)
        ends = sum(sizes[x] for x in kinds[p][1 : 1 + start]) + sum(sizes[x] for x in kinds[p][len(kinds[p]) - end :])
        short = (left, right, table) if len(left) >= len(right) else (right, left, table.T)
        weights[p, q] = 1 + ends + int(_scores(short[0], short[1], short[2], np.array(short[1], np.int64))[-1])

    found = [-1] * len(a)
    memo: dict[tuple[int, int], list[tuple[int, int]]] = {}
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        p, q = kind_a[i], kind_b[j]
        if p == q:
            found[i : i + sizes[p]] = range(j, j + sizes[p])
            continue
        found[i] = j
        if (p, q) not in memo:
            start, end, left, right, table = middle(p, q)
            n, m = len(kinds[p]) - 1, len(kinds[q]) - 1
            memo[p, q] = [(x, x) for x in range(start)] + [(start + x, start + y) for x, y in best_pairs(left, right, table)] + [(n - x, m - x) for x in range(end, 0, -1)]
        todo += [(a[i][1][x], b[j][1][y]) for x, y in memo[p, q]]
    return tuple(found)


def plain(text: str) -> str:
    return " ".join(unescape(text).split())


def own_text(nodes: list[Node]) -> str:
    return plain(" ".join(c for node in nodes for c in node.children if isinstance(c, str)))


def content(root: Node, template: frozenset[int] = frozenset(), slots: frozenset[int] = frozenset()) -> list[str]:
    """Texts of content blocks in page order. template, slots: numbers of skeleton nodes whose own text is template or varies.

    An article of which something varies is content as a whole, and what varies beside it is content only if it is the longer
    text; an article that is the same on all pages is template, and what varies beside it is content. Without an article, all is
    content that is not template.
    """
    blocks: list[tuple[str, bool, int]] = []  # text, whether in an article, number of the node
    run: list[str] = []
    around = not root.shown and root.named  # a class alone does not make chrome of what holds the only main element
    within = root.shown or around
    own = (False, -1)

    def flush() -> None:
        text = plain("".join(run))
        if text:
            blocks.append((text, *own))
        run.clear()

    todo: list[tuple[Node | str | None, bool, int]] = [(root, False, -1)]  # what comes next; for a text, its node's number
    while todo:
        item, inside, at = todo.pop()
        if isinstance(item, str):
            own = (inside, at)
            run.append(item)
            continue
        flush()
        if item is None or (item.chrome and not (around and not inside and item.named)):
            continue
        inside = inside or item.main
        todo.append((None, False, -1))
        todo += [(child, inside, item.number) for child in reversed(item.children)]
    flush()
    if not within:
        return [text for text, _, at in blocks if at not in template]
    varies = any(inside and at in slots for _, inside, at in blocks)
    words = lambda wanted: sum(len(text.split()) for text, inside, at in blocks if inside == wanted and (inside or at in slots))
    beside = not varies or words(False) > words(True)
    kept = [text for text, inside, at in blocks if (inside and (varies or at not in template)) or (not inside and beside and at in slots)]
    return kept if kept or not (template or slots) else content(root)


def layouts(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(host, skeleton, texts): of each page, the hash of the own text of each skeleton node."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hosts, skeletons, hashes = [], [], []
        for link, text in zip(*(c.to_pylist() for c in batch.columns)):
            skeleton, behind = number(parse(text or ""))
            hosts.append(split_url(link)[0])
            skeletons.append(skeleton)
            hashes.append([xxhash.xxh64_intdigest(own_text(g).encode("utf-8", "replace"), 0) - (1 << 63) for g in behind])
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(skeletons, pa.string()), pa.array(hashes, pa.list_(pa.int64()))], ["host", "skeleton", "texts"])

    return common.map_batches(pages.select(url, html), run, "host string, skeleton string, texts array<long>")


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, pivot, template, slots): each host's pivot skeleton and the numbers of its template nodes and of those that vary."""
    found = common.saved(layouts(pages, url, html), "layouts")
    order = Window.partitionBy("host").orderBy(F.desc("n"), "skeleton")
    pivots = found.groupBy("host", "skeleton").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(order)).filter("r = 1").select("host", F.col("skeleton").alias("pivot"))
    # equal layouts with equal texts are counted before they meet their pivot
    alike = found.groupBy("host", "skeleton", "texts").agg(F.count("*").alias("n"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for host, skeleton, texts, n, pivot in zip(*(c.to_pylist() for c in batch.columns)):
            match = match_trees(skeleton, pivot)
            rows += [(host, match[i], h, n) for i, h in enumerate(texts) if match[i] >= 0]
        columns = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["host", "node", "text", "n"])

    votes = common.map_batches(alike.join(pivots, "host").select("host", "skeleton", "texts", "n", "pivot"), run, "host string, node int, text long, n long")
    by_text = votes.groupBy("host", "node", "text").agg(F.sum("n").alias("n"))
    nodes = by_text.groupBy("host", "node").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    same = F.col("most") >= TEMPLATE_SHARE * F.col("all")
    fixed = nodes.filter(F.col("all") >= TEMPLATE_PAGES).groupBy("host").agg(F.sort_array(F.collect_list(F.when(same, F.col("node")))).alias("template"), F.sort_array(F.collect_list(F.when(~same, F.col("node")))).alias("slots"))
    return pivots.join(fixed, "host", "left")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page."""
    made = common.saved(wrappers(pages, url, html), "wrappers")
    few = made.count() <= BROADCAST_HOSTS

    def with_host(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([split_url(u)[0] for u in batch.column(1).to_pylist()], pa.string())], [key, "url", "html", "host"])

    kind = pages.schema[key].dataType.simpleString()
    rows = common.map_batches(pages.select(key, url, html), with_host, f"{key} {kind}, url string, html string, host string")
    joined = rows.join(F.broadcast(made) if few else made, "host", "left").select(key, "url", "html", "pivot", "template", "slots")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for html_text, pivot, template, slots in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5))):
            root = parse(html_text or "")
            skeleton, _ = number(root)
            match = match_trees(skeleton, pivot) if pivot and (template or slots) else ()
            own, varying = (frozenset(i for i, j in enumerate(match) if j in found) for found in (set(template or ()), set(slots or ())))
            texts.append("\n\n".join(content(root, own, varying)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, "url", "text", "n_chars"])

    return common.map_batches(joined, run, f"{key} {kind}, url string, text string, n_chars long")


def op2_wrapper_induction(spark, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))


_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '<br>', ' ', 'g') AS body FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(body, '</?(p|h1)>'), lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&amp$', '&amp;'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS parts FROM a)
SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10)) AS text, length(array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10)))::BIGINT AS n_chars FROM b"""


QUERIES = {"op2_wrapper_induction": op2_wrapper_induction}
ORACLES = {"op2_wrapper_induction": _SQL}
