"""HTML extraction by wrapper induction: same-host pages are aligned, recurring nodes are template."""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import Scratch, set_batches

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)\s*(=?)\s*")
_UNQUOTED = re.compile(r"[^\s>]*")
_PARTS = re.compile(r"[a-z]+|\d+")
# Element names of the HTML standard by how they behave here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noscript".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
TEXT = set("p h1 h2 h3 h4 h5 h6 li td th tr dt dd blockquote pre figcaption caption".split())
CLOSES_P = TEXT - {"td", "th", "tr"} | set("div section article main header footer nav aside form ul ol dl table hr address fieldset figure".split())
#: Elements that end an open one of their kind, and those beyond which that one is not looked for.
KINDS = {"p": "p", "li": "li", "dt": "d", "dd": "d", "tr": "row", "td": "cell", "th": "cell", "option": "option", "select": "select", "head": "head"}
BOUNDS = {k: {"p", "select"} for k in ("td", "th", "li", "div", "article", "section", "body")} | {"ul": {"li"}, "ol": {"li"}, "dl": {"d"}, "select": {"option"}, "table": {"row", "cell", "li", "d", "p"}, "tr": {"cell"}, "tbody": {"row", "cell"}, "thead": {"row", "cell"}}
#: Elements that hold no article, and words in class, id or role that say the same.
OUTSIDE = set("nav footer aside form button dialog menu head svg math object select canvas video audio template".split())
SAYS_OUTSIDE = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar"
    " breadcrumb breadcrumbs sidebar aside rail widget footer foot copyright masthead topbar cookie cookies consent gdpr notice alert popup modal overlay"
    " comment comments disqus respond reply replies discussion share sharing social related recommended newsletter subscribe signup login search pagination pager toolbar"
    " complementary contentinfo skip hidden".split()
)
#: Words that may stand beside those in an article, where a name has to say nothing else.
BESIDE = set("area bar block bottom box button buttons container form group holder icon icons inline inner item items left links list outer panel right row section slot thread top unit wrap wrapper".split())
SAYS_ARTICLE = {"article", "post", "entry", "story", "content", "main"}
#: States of an element: outside of the article, nothing known, a name that says article, in main, in article.
OUT, NONE, NAMED, MAIN, ARTICLE = -1, 0, 1, 2, 3


class Node:
    __slots__ = ("label", "children", "kinds", "state", "id")

    def __init__(self, label: str, state: int):
        self.label, self.state, self.id = label, state, 0
        self.children: list[Node] = []
        self.kinds: dict[str, Node] = {}


@lru_cache(1 << 14)
def _state(tag: str, names: tuple[tuple[str, str], ...], above: int) -> tuple[str, int]:
    """An element's label (its tag, class, id and role) and its state, given that of its parent."""
    words, label, hidden = [], tag, False
    for kind, value in names:
        hidden |= kind == "hidden" or (kind == "style" and "display:none" in value.replace(" ", ""))
        if kind in ("class", "id", "role"):
            words += [_PARTS.findall(x) for x in value.split()]
            label += ("." if kind == "class" else "#" if kind == "id" else "@") + re.sub(r"\d+", "0", value)
    if above == OUT or hidden or tag in OUTSIDE or (tag == "header" and above < ARTICLE):
        return label, OUT
    flat = {x for own in words for x in own}
    if above == ARTICLE:
        # An article's part is only out if a whole name says so: "ad-slot-1" does, "notice-of-award" does not.
        said = any(SAYS_OUTSIDE & set(own) and all(x in SAYS_OUTSIDE or x in BESIDE or x.isdigit() for x in own) for own in words)
        return label, OUT if said else above
    if tag == "article":
        return label, OUT if flat & {"comment", "comments", "ad", "promo", "related"} else ARTICLE
    if tag == "main":
        return label, MAIN
    if tag not in ("body", "html") and (flat & SAYS_OUTSIDE or ("header" in flat and above < NAMED)):
        return label, OUT
    return label, max(above, NAMED) if flat & SAYS_ARTICLE else above


class Page:
    """A parsed page: its tree of merged block elements, and its blocks of text in order. Time is linear in the source."""

    def __init__(self, source: str):
        self.root = Node("", NONE)
        self.blocks: list[tuple[Node, str, float, int]] = []  # node, text, share of it in links, state
        # Tag, node, state, and where the innermost open element of each kind is.
        self._stack: list[tuple[str, Node, int, dict[str, int]]] = [("", self.root, NONE, {})]
        self._open_tags: dict[str, int] = {}
        self._text: list[str] = []
        self._linked = self._links = self._depth = 0
        self._lost: set[str] = set()  # quotes and end tags that do not come any more
        self._read(source)

    def _flush(self) -> None:
        if self._text:
            text = " ".join(entities.unescape("".join(self._text)).split())
            if text:
                _, node, state, _ = self._stack[-1]
                self.blocks.append((node, text, self._linked / max(len(text), 1) if self._links > 1 else 0.0, state))
            self._text = []
        self._linked = self._links = 0

    def _pop(self, to: int) -> None:
        if 0 < to < len(self._stack):
            self._flush()
            for x in self._stack[to:]:
                self._open_tags[x[0]] -= 1
            del self._stack[to:]

    def _say(self, text: str) -> None:
        self._text.append(text)
        if self._depth:
            self._linked += len(text)

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            start = source.find("<", at)
            if start < 0:
                self._say(source[at:])
                break
            if start > at:
                self._say(source[at:start])
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                at = end + 3 if end >= 0 else n
            elif source.startswith(("<!", "<?"), start):
                end = source.find(">", start)
                at = end + 1 if end >= 0 else n
            elif m := _NAME.match(source, start + 2) if source.startswith("/", start + 1) else None:
                end = source.find(">", m.end())
                at = end + 1 if end >= 0 else n
                if end >= 0:
                    self._end(m[0].lower())
            elif m := _NAME.match(source, start + 1):
                at = self._begin(m[0].lower(), source, m.end())
            else:
                self._say("<")
                at = start + 1
        self._pop(1)
        self._flush()

    def _begin(self, tag: str, source: str, at: int) -> int:
        """Reads a start tag's attributes; where the text after it begins."""
        names, closed = [], False
        while True:
            m = _ATTRIBUTE.match(source, at)
            if not m:
                end = source.find(">", at)
                if end < 0:
                    return len(source)  # a tag without an end is no text
                closed = source.startswith("/", end - 1) and end > at
                at = end + 1
                break
            at, value = m.end(), ""
            if m[2]:
                quote = source[at : at + 1]
                end = source.find(quote, at + 1) if quote in ("'", '"') and quote not in self._lost else -1
                if end >= 0:
                    value, at = source[at + 1 : end], end + 1
                else:
                    if quote in ("'", '"'):
                        self._lost.add(quote)
                    unquoted = _UNQUOTED.match(source, at)
                    value, at = unquoted[0], unquoted.end()
            name = m[1].lower()
            if name in ("class", "id", "role", "hidden", "style"):
                names.append((name, value.lower()))
        if tag in RAW:
            self._text.append(" ")
            return self._after(tag, source, at)
        if tag in INLINE:
            if tag == "a":
                self._depth, self._links = 1, self._links + 1
            elif tag == "br":
                self._text.append(" ")
            if tag != "span" or not names or _state(tag, tuple(names), NONE)[1] != OUT:
                return at
        if tag in VOID:
            self._flush()
        elif not closed:
            self._push(tag, tuple(names))
        return at

    def _after(self, tag: str, source: str, at: int) -> int:
        """Behind the end tag of an element whose text is no markup. Without one, a script goes on to the end, others have no text."""
        if tag not in self._lost:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            if close:
                return close.end()
            self._lost.add(tag)
        return len(source) if tag in ("script", "style") else at

    def _end(self, tag: str) -> None:
        if tag == "a":
            self._depth = 0
        if not self._open_tags.get(tag):
            if tag == "p":
                self._flush()
            return
        k = len(self._stack) - 1
        while self._stack[k][0] != tag:
            k -= 1
        self._pop(k)

    def _push(self, tag: str, names: tuple[tuple[str, str], ...]) -> None:
        self._flush()
        self._depth = 0
        within = self._stack[-1][3]
        ends = [KINDS[tag]] if tag in KINDS else []
        if tag in CLOSES_P or tag == "body":
            ends += ["p", "select", "head"]
        if tag == "tr":
            ends.append("cell")
        found = [within[k] for k in ends if k in within]
        if found:
            self._pop(min(found))
        _, parent, above, within = self._stack[-1]
        label, state = _state(tag, names, above) if sum(len(x) for _, x in names) < 1000 else _state.__wrapped__(tag, names, above)
        node = parent.kinds.get(label)
        if node is None or (tag not in TEXT and label == tag and tag not in ("html", "body", "head", "article", "main")):
            node = parent.kinds[label] = Node(label, state)
            parent.children.append(node)
        if tag in KINDS or tag in BOUNDS:
            lost = BOUNDS.get(tag, ())
            within = {k: at for k, at in within.items() if k not in lost}
            if tag in KINDS:
                within[KINDS[tag]] = len(self._stack)
        self._open_tags[tag] = self._open_tags.get(tag, 0) + 1
        self._stack.append((tag, node, state, within))

    def tree(self) -> str:
        """The tree as text, label(child,child); nodes are numbered in preorder."""
        out, count, stack = [], 0, [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
                continue
            node.id, count = count, count + 1
            out.append(re.sub("[(),]", "", node.label))
            if node.children:
                out.append("(")
                stack.append(")")
                for k, x in enumerate(reversed(node.children)):
                    if k:
                        stack.append(",")
                    stack.append(x)
        return "".join(out)


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


#: Pairs of children that are all compared, of one pair of nodes and of a whole pair of trees.
PAIRS, ALL_PAIRS = 1 << 14, 1 << 19


def read_tree(text: str) -> tuple[list[str], list[list[int]]]:
    """Labels and children of the nodes of a tree that was written as text, in preorder."""
    labels, children, stack = [""], [[]], [0]
    new = False
    for x in re.findall(r"[(),]|[^(),]+", text):
        if x == ")":
            if new:
                children[stack[-1]].append(len(labels))
                labels.append("")
                children.append([])
            stack.pop()
            new = False
        elif x == "(":
            if new:
                children[stack[-1]].append(len(labels))
                labels.append("")
                children.append([])
            stack.append(len(labels) - 1)
            new = True
        elif x == ",":
            if new:
                children[stack[-1]].append(len(labels))
                labels.append("")
                children.append([])
            new = True
        elif len(stack) == 1:
            labels[0] = x
        else:
            children[stack[-1]].append(len(labels))
            labels.append(x)
            children.append([])
            new = False
    return labels, children


def _in_place(xs: list[int], ys: list[int], labels: tuple[list[str], list[str]]) -> list[tuple[int, int]]:
    """The first child of a label with the first one of it, the second with the second, and so on."""
    a, b = labels
    seen: dict[str, deque[int]] = {}
    for y in ys:
        seen.setdefault(b[y], deque()).append(y)
    return [(x, seen[a[x]].popleft()) for x in xs if seen.get(a[x])]


def _chosen(xs: list[int], ys: list[int], worth: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """Pairs of children, in order on both sides, that are worth most together."""
    best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for p, x in enumerate(xs, 1):
        row, above = best[p], best[p - 1]
        for q, y in enumerate(ys, 1):
            row[q] = max(above[q], row[q - 1], above[q - 1] + worth.get((x, y), 0))
    p, q, out = len(xs), len(ys), []
    while p and q:
        own = worth.get((xs[p - 1], ys[q - 1]), 0)
        if own and best[p][q] == best[p - 1][q - 1] + own:
            out.append((xs[p - 1], ys[q - 1]))
            p, q = p - 1, q - 1
        elif best[p][q] == best[p - 1][q]:
            p -= 1
        else:
            q -= 1
    return out


@lru_cache(1 << 9)
def align(mine: str, reference: str) -> tuple[int, ...]:
    """Simple tree matching: for each node of `mine`, in preorder, the node of `reference` it matches, or -1.

    Nodes match if their labels are equal and their parents match; children keep their order, and
    the matching has as many nodes as it can. Children of which there are more than PAIRS pairs, and those met after
    ALL_PAIRS pairs, match by label and place, which keeps the time of very large trees linear.
    """
    (a, xs), (b, ys) = read_tree(mine), read_tree(reference)
    out = [-1] * len(a)
    if mine == reference:
        return tuple(range(len(a)))
    if a[0] != b[0]:
        return tuple(out)

    pairs, worth, placed, cost = [(0, 0)], {}, {}, 0
    for i, j in pairs:  # grows: parents come before children
        cost += len(xs[i]) * len(ys[j])
        if len(xs[i]) * len(ys[j]) > PAIRS or cost > ALL_PAIRS:
            placed[i, j] = _in_place(xs[i], ys[j], (a, b))
            pairs += placed[i, j]
        else:
            pairs += [(x, y) for x in xs[i] for y in ys[j] if a[x] == b[y]]
    for i, j in reversed(pairs):
        own = placed.get((i, j))
        worth[i, j] = 1 + sum(worth[p] for p in (_chosen(xs[i], ys[j], worth) if own is None else own))
    front = [(0, 0)]
    while front:
        i, j = front.pop()
        out[i] = j
        own = placed.get((i, j))
        front += _chosen(xs[i], ys[j], worth) if own is None else own
    return tuple(out)


@lru_cache(1 << 9)
def slots_of(mine: str, reference: str) -> tuple[int, ...]:
    """For each node of `mine`, in preorder, its slot: the node of `reference` it matches or, where there is none, a
    negative hash of its path (labels from the root and, of children with equal ones, the place)."""
    labels, children = read_tree(mine)
    paths = [0] * len(labels)
    for i, own in enumerate(children):
        seen: dict[str, int] = {}
        for x in own:
            k = seen[labels[x]] = seen.get(labels[x], -1) + 1
            paths[x] = text_hash(f"{paths[i]}/{labels[x]}:{k}")
    return tuple(at if at >= 0 else -1 - (path & (1 << 63) - 1) for at, path in zip(align(mine, reference), paths, strict=True))


def candidates(page: Page) -> list[tuple[Node, str, int]]:
    """The blocks that are not outside of the article by name: node, text, state.

    Where nothing says article, blocks that are mostly links, other than paragraphs and headings, are menus."""
    return [(node, text, state) for node, text, linked, state in page.blocks if state != OUT and (state != NONE or linked < 0.6 or node.label[:1] in "ph")]


def content(page: Page, template: set[tuple[int, int]], slots: tuple[int, ...]) -> str:
    """The blocks that are not template (slot and hash of the text) and not outside of the article, one a line."""
    page.tree()
    kept = [(text, state) for node, text, state in candidates(page) if not slots or (slots[node.id], text_hash(text)) not in template]
    for least in (MAIN, NAMED):
        inside = [text for text, state in kept if state >= least]
        if inside:
            return "\n".join(inside)
    return "\n".join(text for text, _ in kept)


def _columns(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types.values())], names=list(types))


def extract(pages: DataFrame, scratch: Scratch, *, recurring: float = 0.5, least: int = 4, known: int = 16 << 20) -> DataFrame:
    """page_id, url, text, n_chars of each page: its main text.

    A page's block elements form a tree, in which equal text elements of one parent (paragraphs,
    items) are merged. A host's most frequent tree is its reference; simple tree matching aligns
    each page's tree with it. A slot is a node of the reference or, for nodes it lacks, a path of labels.
    The host's main slot is the one with most different text; pages that agree there (mirrored articles) count once.
    A block is template, in its slot, if its own text is on the share `recurring` of the slot's pages, which are
    `least` or more; outside of the main slot also if it is on two pages or more and the slot has few texts, one for `least` pages on
    average. A text that does not recur is never template. Elements
    that are by name or class no part of an article (menus, forms, adverts, comments ...) go too, and
    where there is an article or main region, only its blocks stay. Character references are
    decoded, white space in a block is one space, blocks are joined by a newline.

    The host is taken from url as in urls.host_and_path(); pages without one share the empty host. A host's reference and template
    texts come from counts over all its pages; up to `known` bytes of them are sent to the scans, more are joined
    by host. Parsing is linear in the source and nothing recurses, so deep nesting and tags that never end are only long. A null or empty html gives an empty text. Rows with equal ids are extracted one by one; pages of
    equal texts count once. Columns other than page_id, url and html are not read.
    """
    from .urls import host_and_path

    spark = pages.sparkSession
    set_batches(spark)
    read = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_and_path(F.col("url"))[0].alias("host"))

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees, nodes, texts, sizes = [], [], [], []
            for source in W.column_of(batch, "html").to_pylist():
                page = Page(source or "")
                trees.append(page.tree())
                own = candidates(page)
                nodes.append([node.id for node, _, _ in own])
                texts.append([text_hash(text) for _, text, _ in own])
                sizes.append([len(text) for _, text, _ in own])
            yield pa.RecordBatch.from_arrays([W.column_of(batch, "host"), pa.array(trees, pa.string()), pa.array(nodes, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))], names=["host", "tree", "nodes", "texts", "sizes"])

    outlines = scratch.save(read.select("host", "html").mapInArrow(outline, "host string, tree string, nodes array<int>, texts array<long>, sizes array<int>"), "outlines")
    counted = outlines.groupBy("host", "tree").agg(F.count("*").alias("n"))
    references = scratch.save(counted.groupBy("host").agg(F.max(F.struct("n", "tree")).alias("m")).select("host", F.col("m.tree").alias("reference")), "references")
    different = scratch.save(outlines.distinct().join(references, "host"), "different")

    def in_slots(batch: pa.RecordBatch) -> Iterator[tuple[dict, dict[int, list[int]], dict[int, int]]]:
        """Each row, the hashes of its texts by slot, and the letters by slot."""
        for row in batch.to_pylist():
            slots = slots_of(row["tree"], row["reference"])
            texts, sizes = {}, {}
            for node, text, size in zip(row["nodes"], row["texts"], row["sizes"], strict=True):
                texts.setdefault(slots[node], []).append(text)
                sizes[slots[node]] = sizes.get(slots[node], 0) + size
            yield row, texts, sizes

    def whole(texts: list[int]) -> int:
        return text_hash(" ".join(map(str, texts)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(row["host"], slot, whole(own), sizes[slot]) for row, texts, sizes in in_slots(batch) for slot, own in texts.items()]
            yield _columns(rows, {"host": pa.string(), "slot": pa.int64(), "value": pa.int64(), "size": pa.int64()})

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, texts, _ in in_slots(batch):
                page = whole(texts[row["main"]]) if row["main"] in texts else whole([x for own in texts.values() for x in own])
                rows += [(row["host"], slot, text, page) for slot, own in texts.items() for text in dict.fromkeys(own)]
            yield _columns(rows, {"host": pa.string(), "slot": pa.int64(), "value": pa.int64(), "page": pa.int64()})

    weights = different.mapInArrow(weigh, "host string, slot long, value long, size long").distinct().groupBy("host", "slot").agg(F.sum("size").alias("size"))
    main = scratch.save(weights.groupBy("host").agg(F.max(F.struct("size", "slot")).alias("m")).select("host", F.col("m.slot").alias("main")), "main")
    votes = scratch.save(different.join(main, "host").mapInArrow(vote, "host string, slot long, value long, page long").distinct(), "votes")
    values = votes.groupBy("host", "slot", "value").agg(F.count("*").alias("n"))
    pages_of = votes.select("host", "slot", "page").distinct().groupBy("host", "slot").agg(F.count("*").alias("pages")).where(F.col("pages") >= least)
    few = values.groupBy("host", "slot").agg((F.sum("n") >= least * F.count("*")).alias("few"))
    judged = values.where("n > 1").join(pages_of, ["host", "slot"]).join(few, ["host", "slot"]).join(main, "host")
    often = (F.col("n") >= recurring * F.col("pages")) | (F.col("few") & (F.col("slot") != F.col("main")))
    template = scratch.save(judged.where(often).select("host", "slot", "value"), "template")
    wrappers = scratch.save(references.join(template.groupBy("host").agg(F.collect_list(F.struct("slot", "value")).alias("slots")), "host"), "wrappers")
    scratch.drop("outlines", "different", "votes")
    size = wrappers.agg(F.coalesce(F.sum(F.octet_length("reference") + 24 * F.size("slots") + 64), F.lit(0))).first()[0]
    if size <= known:
        sent = spark.sparkContext.broadcast({r["host"]: (r["reference"], {(x["slot"], x["value"]) for x in r["slots"]}) for r in wrappers.toLocalIterator()})
        read = read.withColumn("reference", F.lit(None).cast("string")).withColumn("slots", F.lit(None).cast("array<struct<slot:long,value:long>>"))
    else:
        sent, read = None, read.join(wrappers, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, host, reference, slots in zip(*(W.column_of(batch, c).to_pylist() for c in ("html", "host", "reference", "slots")), strict=True):
                page = Page(source or "")
                reference, slots = sent.value.get(host, (None, ())) if sent else (reference, {(x["slot"], x["value"]) for x in slots or ()})
                own = slots_of(page.tree(), reference) if slots else ()
                texts.append(content(page, slots, own))
            yield pa.RecordBatch.from_arrays([W.column_of(batch, "page_id"), W.column_of(batch, "url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return read.select("page_id", "url", "html", "host", "reference", "slots").mapInArrow(run, "page_id long, url string, text string, n_chars long")
