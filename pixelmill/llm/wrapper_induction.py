"""Main text of web pages: DOM trees of one host are aligned by simple tree matching; constant nodes are template."""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.batches import bound_batches
from pixelmill.llm.text import present
from pixelmill.session import work_table

#: Elements and names that mark parts which are not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe svg textarea select canvas head annotation annotation-xml".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math mrow mi mn mo ms mtext msub msup msqrt mfrac".split())
ASIDE_TAGS = frozenset("nav footer aside form button dialog menu".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
#: Roles that an article may give to its own parts.
OWN_ROLES = frozenset("alert banner contentinfo".split())
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement adbox adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login comment comments reply replies respond disqus share sharing social related recommended widget toolbar pager pagination skip".split()
)
#: Names of what readers write: an article inside is one of their comments.
READER_NAMES = frozenset("comment comments reply replies respond disqus".split())
#: Words that say nothing beside such a name: "share-buttons" is an aside, "share-price" is not.
PLAIN_NAMES = frozenset("area bar block box button buttons container form icons inner item items link links list outer post posts section slot text thread top unit wrap wrapper".split())
#: Words that say nothing outside an article only.
SITE_NAMES = frozenset("bottom column content fixed global group left main page panel primary right secondary site sticky".split())
#: What an element is: no aside; one by a name; one for good, by its element, role, or as the readers' part.
NO, NAMED_ASIDE, ASIDE = range(3)
CLOSED_BY_SAME = frozenset("li dt dd tr td th option".split())
#: Elements inside which an open paragraph or item of outside is out of reach.
SCOPES = {"ul": ("li",), "ol": ("li",), "dl": ("dt", "dd"), "table": ("tr", "td", "th", "p"), "td": ("p",), "th": ("p",), "caption": ("p",)}
#: Elements that articles hold or lack at will; they tell no layout.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote figure figcaption pre hr address details summary".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/><]*)((?:[^>"']++|"[^"<]*+"|'[^'<]*+'|["'])*+)>""", re.S)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
RAW_END = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}
WORD = re.compile(r"[a-z]+")


def aside_kind(tag: str, attributes: str, inside: bool) -> int:
    """Whether an element is a menu, header, footer, sidebar, notice, advert, form or comment.

    A class or id tells only as a whole: it must consist of such names and words without meaning of their own, so
    "has-sidebar" and "comments-open" tell nothing. What holds the page or its article is never an aside, whatever its
    attributes say; an article inside another may be a comment.
    """
    if tag in ASIDE_TAGS or (tag in ("header", "noscript") and not inside):
        return ASIDE
    if tag in ("html", "body", "main") or (tag == "article" and not inside):
        return NO
    kind = NO
    for name, value in NAMED.findall(attributes):
        name = name.lower()
        if name == "hidden":
            return ASIDE
        if name == "role":
            roles = ASIDE_ROLES - OWN_ROLES if inside else ASIDE_ROLES
            if not roles.isdisjoint(WORD.findall(value.lower())):
                return ASIDE
        else:
            for token in value.strip("\"'").lower().split():
                parts = set(WORD.findall(token))
                names = parts & ASIDE_NAMES
                if names and parts <= ASIDE_NAMES | PLAIN_NAMES | (frozenset() if inside else SITE_NAMES):
                    kind = max(kind, ASIDE if names & READER_NAMES else NAMED_ASIDE)
    return kind


class Page:
    """Block elements of a page outside its asides, as a tree, and the text blocks in page order."""

    def __init__(self, source: str):
        self.label, self.parent, self.text = ["root"], [-1], [""]
        # node, whether in an article or main, whether that stands in an element with an aside's name, text
        self.blocks: list[tuple[int, bool, bool, str]] = []
        pieces: list[str] = []
        # tag, node, kind of aside, in an article or main, where in the stack the open paragraph and items are, and
        # whether the article stands in an element with an aside's name
        stack: list[tuple] = [("root", 0, NO, False, {}, False)]
        self._open_tags: Counter = Counter()
        at, end = 0, len(source)
        while at < end:
            found = TAG.search(source, at)
            if not found:
                pieces.append(source[at:])
                break
            if found.start() > at:
                pieces.append(source[at : found.start()])
            at = found.end()
            tag = found[2]
            if tag is None:
                continue
            tag = tag.lower()
            if tag == "br":
                pieces.append(" ")
                continue
            if tag not in INLINE:
                self._flush(stack[-1], pieces)
            if found[1]:
                self._close(tag, stack, pieces)
            elif tag in RAW:
                stop = RAW_END[tag].search(source, at)
                if stop:
                    at = stop.start()
                elif tag not in ("head", "select"):
                    at = end
            elif tag not in VOID and not (tag in INLINE and "class" not in found[3] and "hidden" not in found[3]):
                self._open(tag, found[3], stack, pieces)
        self._flush(stack[-1], pieces)

    def _flush(self, top: tuple, pieces: list[str]) -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split()) if not top[2] else ""
            pieces.clear()
            if text:
                node = top[1]
                self.text[node] = f"{self.text[node]} {text}" if self.text[node] else text
                self.blocks.append((node, top[3], top[5], text))

    def _pop(self, stack: list, at: int) -> None:
        for entry in stack[at:]:
            self._open_tags[entry[0]] -= 1
        del stack[at:]

    def _push(self, stack: list, entry: tuple) -> None:
        self._open_tags[entry[0]] += 1
        stack.append(entry)

    def _open(self, tag: str, attributes: str, stack: list, pieces: list[str]) -> None:
        if tag in INLINE:
            if aside_kind(tag, attributes, stack[-1][3]):
                self._flush(stack[-1], pieces)
                self._push(stack, (tag, stack[-1][1], ASIDE, *stack[-1][3:]))
            return
        if tag in CLOSED_BY_SAME:
            if (at := stack[-1][4].get(tag)) is not None:
                self._pop(stack, at)
        if (at := stack[-1][4].get("p")) is not None:
            self._pop(stack, at)
        _, parent, aside, inside, marks, lost = stack[-1]
        frame = tag in ("article", "main") or "role=\"main\"" in attributes
        if frame and aside == NAMED_ASIDE and not inside:
            aside, lost = NO, lost or tag == "article"  # the name was that of the layout, if this is the only article
        aside = max(aside, aside_kind(tag, attributes, inside))
        inside = inside or frame and not aside
        node = parent
        if not aside:
            node = len(self.label)
            self.label.append(tag)
            self.parent.append(parent)
            self.text.append("")
        if tag in SCOPES:
            marks = {k: v for k, v in marks.items() if k not in SCOPES[tag]}
        if tag == "p" or tag in CLOSED_BY_SAME:
            marks = marks | {tag: len(stack)}
        self._push(stack, (tag, node, aside, inside, marks, lost))

    def _close(self, tag: str, stack: list, pieces: list[str]) -> None:
        if self._open_tags[tag] > 0:
            at = len(stack) - 1
            while stack[at][0] != tag:
                at -= 1
            if stack[at][2] and not stack[at - 1][2]:
                self._flush(stack[-1], pieces)  # what an inline aside held goes with it
            self._pop(stack, at)

    def content(self) -> list[tuple[int, str]]:
        """Node and text of the blocks in articles and main, else of the articles in elements with an aside's name,
        else of all that is no aside."""
        ranks = [2 if inside and not lost else 1 if inside else 0 for _, inside, lost, _ in self.blocks]
        best = max(ranks, default=0)
        return [(node, text) for rank, (node, _, _, text) in zip(ranks, self.blocks, strict=True) if rank == best]


def hashed(text: str) -> int:
    """64 bits of a text as a signed number."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


@dataclass
class Tree:
    """Nodes in page order, parents first: the parent's place, the hash of the labels from the root down, and
    the hash of these and the node's text (0 without text)."""

    parents: np.ndarray
    paths: np.ndarray
    marks: np.ndarray

    def pruned(self, marks: set[int]) -> tuple[Tree, np.ndarray]:
        """The nodes with one of the marks and their ancestors, and where they stood."""
        keep = np.fromiter((m in marks for m in self.marks.tolist()), bool, len(self.marks)) & (self.marks != 0)
        for node in range(len(keep) - 1, 0, -1):
            if keep[node]:
                keep[self.parents[node]] = True
        at = np.flatnonzero(keep)
        place = np.cumsum(keep) - 1
        parents = np.where(self.parents[at] >= 0, place[np.maximum(self.parents[at], 0)], -1)
        return Tree(parents, self.paths[at], self.marks[at]), at

    def children(self) -> list[list[int]]:
        below: list[list[int]] = [[] for _ in self.parents]
        for node, parent in enumerate(self.parents.tolist()):
            if parent >= 0:
                below[parent].append(node)
        return below

    def subtrees(self, below: list[list[int]]) -> list[int]:
        """Equal numbers for equal subtrees."""
        found = [0] * len(self.parents)
        for node in range(len(found) - 1, -1, -1):
            found[node] = hash((int(self.paths[node]), int(self.marks[node]), *[found[x] for x in below[node]]))
        return found


class Side:
    """The nodes from ``low`` to ``high`` of a tree by their labels from the root down, with the children of all nodes of
    the same labels in one row, those of a node from the last to the first."""

    def __init__(self, tree: Tree, low: int, high: int):
        paths, parents = tree.paths[low:high], tree.parents[low:high] - low
        order = np.argsort(paths, kind="stable")
        cuts = np.flatnonzero(np.diff(paths[order])) + 1
        self.nodes = {int(paths[g[0]]): g for g in np.split(order, cuts)}
        self.place = np.empty(len(paths), np.int64)
        for g in self.nodes.values():
            self.place[g] = np.arange(len(g))
        self.paths, self.parents, self.marks = paths, parents, tree.marks[low:high]
        self.rows: dict[int, Row | None] = {}

    def row(self, path: int) -> Row | None:
        if path not in self.rows:
            held = self.nodes[path]
            child = np.flatnonzero(np.isin(self.parents, held)) if len(held) < 8 else np.flatnonzero((self.parents >= 0) & (self.paths[np.maximum(self.parents, 0)] == path))
            self.rows[path] = Row(self, child, len(held)) if len(child) else None
        return self.rows[path]


class Row:
    def __init__(self, side: Side, child: np.ndarray, owners: int):
        owner = side.place[side.parents[child]]
        order = np.lexsort((-child, owner))
        child, owner = child[order], owner[order]
        self.first = np.flatnonzero(np.diff(owner, prepend=-1))
        self.last = np.full(owners, -1)
        self.last[owner] = np.arange(len(child))
        self.base = owner * (1 << 32)
        paths = side.paths[child]
        self.of = {int(p): (at := np.flatnonzero(paths == p), side.place[child[at]]) for p in np.unique(paths)}
        self.size = len(child)


def simple_tree_matching(page: Tree, ref: Tree) -> dict[int, int]:
    """The largest order-preserving match of two trees by labels, as page node -> reference node.

    A pair of nodes counts one, or two if both have the same text, so that constant nodes find each other
    among equal labels. Only nodes with the same labels from the root down can match. Equal subtrees at both ends of two
    lists of children are matched at once; what is between is aligned. A page node is scored against all reference
    nodes of its labels together, in arrays, from the last node to the first, and its scores go into the alignment of its
    parent as soon as they are there: so the work is one row of numbers a node, and only open rows are kept.
    """
    if not len(page.paths) or not len(ref.paths) or page.paths[0] != ref.paths[0]:
        return {}
    below_a, below_b = page.children(), ref.children()
    tree_a, tree_b = page.subtrees(below_a), ref.subtrees(below_b)
    ends = [np.arange(1, len(t.paths) + 1) for t in (page, ref)]
    for end, t in zip(ends, (page, ref), strict=True):
        for node in range(len(end) - 1, 0, -1):
            end[t.parents[node]] = max(end[t.parents[node]], end[node])

    def aligned(xs: list[int], ys: list[int]) -> list[tuple[int, int]]:
        """The pairs of the best alignment of two runs of siblings."""
        low, high = xs[0], int(ends[0][xs[-1]])
        start = ys[0]
        side = Side(ref, start, int(ends[1][ys[-1]]))
        top: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        back = np.array(ys[::-1]) - start
        for p in np.unique(side.paths[back]):
            at = np.flatnonzero(side.paths[back] == p)
            top[int(p)] = at, side.place[back[at]]
        best, steps = np.zeros(len(ys), np.int64), []
        open_rows: dict[int, np.ndarray] = {}
        for x in range(high - 1, low - 1, -1):
            path, parent = int(page.paths[x]), int(page.parents[x])
            outer = parent < low
            row = None if outer else side.row(up) if (up := int(page.paths[parent])) in side.nodes else None
            targets = top.get(path) if outer else row and row.of.get(path)
            held = open_rows.pop(x, None)
            if targets is None:
                if outer:
                    steps.append(None)
                continue
            nodes = side.nodes[path]
            score = np.ones(len(nodes), np.int64)
            if page.marks[x]:
                score += side.marks[nodes] == page.marks[x]
            if held is not None:
                last = side.row(path).last
                score += np.where(last >= 0, held[np.maximum(last, 0)], 0)
            at, place = targets
            before = best if outer else open_rows.get(parent)
            if before is None:
                before = np.zeros(row.size, np.int64)
            moved = np.empty_like(before)
            moved[1:], moved[0] = before[:-1], 0
            if not outer:
                moved[row.first] = 0
            taken = np.full(len(before), -1, np.int64)
            taken[at] = moved[at] + score[place]
            if outer:
                after = np.maximum.accumulate(np.maximum(before, taken))
                steps.append((np.packbits(taken == after), np.packbits(before == after)))
                best = after
            else:
                open_rows[parent] = np.maximum.accumulate(np.maximum(before, taken) + row.base) - row.base
        pairs, i, j = [], len(steps) - 1, len(ys) - 1
        while i >= 0 and j >= 0:
            if steps[i] is None:
                i -= 1
                continue
            diagonal, up = (bits[j >> 3] >> (7 - (j & 7)) & 1 for bits in steps[i])
            if up:
                i -= 1
            elif diagonal:
                pairs.append((xs[len(xs) - 1 - i], ys[len(ys) - 1 - j]))
                i, j = i - 1, j - 1
            else:
                j -= 1
        return pairs

    match: dict[int, int] = {}
    todo = [(0, 0)]
    while todo:
        a, b = todo.pop()
        match[a] = b
        xs, ys = below_a[a], below_b[b]
        first, last_x, last_y = 0, len(xs), len(ys)
        while first < min(last_x, last_y) and tree_a[xs[first]] == tree_b[ys[first]]:
            todo.append((xs[first], ys[first]))
            first += 1
        while last_x > first and last_y > first and tree_a[xs[last_x - 1]] == tree_b[ys[last_y - 1]]:
            last_x, last_y = last_x - 1, last_y - 1
            todo.append((xs[last_x], ys[last_y]))
        xs, ys = xs[first:last_x], ys[first:last_y]
        if len(xs) == len(ys) == 1:
            todo += [(xs[0], ys[0])] if page.paths[xs[0]] == ref.paths[ys[0]] else []
        elif xs and ys:
            todo += aligned(xs, ys)
    return match


def constant_nodes(page: Tree, ref: Tree) -> list[int]:
    """Reference nodes that the alignment matches with a node of the same text.

    A node whose labels and text the other tree has nowhere is a slot; it is left out of the alignment.
    """
    shared = (set(page.marks.tolist()) & set(ref.marks.tolist())) - {0}
    if not shared:
        return []
    (a, _), (b, places) = page.pruned(shared), ref.pruned(shared)
    if np.array_equal(a.paths, b.paths) and np.array_equal(a.marks, b.marks):
        return places[b.marks != 0].tolist()  # the same tree
    match = simple_tree_matching(a, b)
    return [int(places[y]) for x, y in match.items() if a.marks[x] and a.marks[x] == b.marks[y]]


def parsed(source: str) -> tuple[list[str], list[int], Tree, int]:
    """Content texts of a page, the tree node of each, the tree of the nodes that hold them with their
    ancestors, and the layout: the hash of the set of label paths of its containers."""
    page = Page(source)
    paths, in_flow = [hashed("root")], [False]
    for node in range(1, len(page.label)):
        label, parent = page.label[node], page.parent[node]
        paths.append(hashed(f"{paths[parent]}/{label}"))
        in_flow.append(in_flow[parent] or label in FLOW)
    blocks = page.content()
    layout = hashed(",".join(map(str, sorted({p for p, flow in zip(paths, in_flow, strict=True) if not flow}))))
    keep = [False] * len(paths)
    keep[0] = True
    marks = [0] * len(paths)
    for node, _ in blocks:
        marks[node] = hashed(f"{paths[node]}\n{page.text[node]}") or 1
        keep[node] = True
    for node in range(len(paths) - 1, 0, -1):
        if keep[node]:
            keep[page.parent[node]] = True
    place = np.cumsum(keep) - 1
    kept = np.flatnonzero(keep)
    parents = np.array([-1 if x == 0 else place[page.parent[x]] for x in kept], np.int32)
    tree = Tree(parents, np.array(paths, np.int64)[kept], np.array(marks, np.int64)[kept])
    return [text for _, text in blocks], [int(place[node]) for node, _ in blocks], tree, layout


def meet(rows: DataFrame, table: DataFrame, keys: list[str], spread: list[str], small: bool, how: str = "inner", parts: int = 64) -> DataFrame:
    """Join rows to a table with one row per key. A small table is broadcast; otherwise the rows of each key are
    dealt to ``parts`` parts, and the table's row goes to those parts that the key has."""
    if small:
        return rows.join(F.broadcast(table), keys, how)
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(*spread), F.lit(parts)))
    copies = dealt.select(*keys, "salt").distinct().join(table, keys)
    return dealt.join(copies, [*keys, "salt"], how).drop("salt")


def templates(contents: DataFrame, host_share: float, least_pages: int, ref_bytes: int) -> DataFrame:
    """host, scope and constant, the marks of template nodes, of each host (scope "*") and each of its layouts."""
    sized = contents.groupBy("host", "layout").agg(F.count(F.lit(1)).alias("n_contents"))
    sized = work_table(sized, "layouts")
    scopes = sized.select("host", F.col("layout").cast("string").alias("scope"), "n_contents").union(
        sized.groupBy("host").agg(F.sum("n_contents").alias("n_contents")).select("host", F.lit("*").alias("scope"), "n_contents")
    )
    scopes = work_table(scopes.where(F.col("n_contents") >= least_pages), "scopes")
    small = scopes.agg(F.sum(F.octet_length("host") + 32)).first()[0]
    small = (small or 0) <= ref_bytes
    by_scope = F.explode(F.array(F.col("layout").cast("string"), F.lit("*"))).alias("scope")

    # marks that enough contents hold anywhere choose the reference: the content with most of them, of those the smallest
    votes = contents.select("host", "layout", F.explode(F.array_distinct("marks")).alias("mark")).where("mark <> 0").groupBy("host", "layout", "mark").agg(F.count(F.lit(1)).alias("n"))
    votes = votes.select("host", by_scope, "mark", "n").groupBy("host", "scope", "mark").agg(F.sum("n").alias("n")).where(F.col("n") >= host_share * least_pages)
    often = meet(votes, scopes, ["host", "scope"], ["mark"], small).where(F.col("n") >= host_share * F.col("n_contents"))
    wanted = work_table(often.groupBy("host", "scope", "n_contents").agg(F.collect_list("mark").alias("wanted")), "wanted-marks")
    held = wanted.agg(F.sum(F.size("wanted") * 8 + F.octet_length("host") + 32)).first()[0] or 0
    scoped = contents.select("host", by_scope, "content", "tree")
    judged = meet(scoped, wanted, ["host", "scope"], ["content"], held <= ref_bytes)
    order = F.struct(F.size(F.array_intersect("tree.marks", "wanted")).alias("score"), (-F.size("tree.marks")).alias("minus"), "content")
    refs = judged.groupBy("host", "scope", "n_contents").agg(F.max_by("tree", order).alias("ref"))
    refs = work_table(refs, "references")
    held = refs.agg(F.sum(F.size("ref.marks") * 20 + F.octet_length("host") + 32)).first()[0] or 0
    pairs = meet(scoped, refs, ["host", "scope"], ["content"], held <= ref_bytes)
    pairs = pairs.select("host", "scope", *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("tree", "ref") for c in ("parents", "paths", "marks")])

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            trees = ([Tree(*map(np.asarray, x)) for x in zip(*[batch[f"{side}_{c}"] for c in ("parents", "paths", "marks")], strict=True)] for side in ("tree", "ref"))
            yield pd.DataFrame({"host": batch["host"], "scope": batch["scope"], "nodes": [constant_nodes(a, b) for a, b in zip(*trees, strict=True)]})

    matched = pairs.mapInPandas(align, "host string, scope string, nodes array<int>").select("host", "scope", F.explode("nodes").alias("node"))
    counted = matched.groupBy("host", "scope", "node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= host_share * least_pages)
    constant = meet(counted, refs, ["host", "scope"], ["node"], held <= ref_bytes).where(F.col("n") >= host_share * F.col("n_contents"))
    return constant.groupBy("host", "scope").agg(F.collect_set(F.get("ref.marks", F.col("node"))).alias("constant"))


def extract(pages: DataFrame, host_share: float = 0.8, least_pages: int = 5, ref_bytes: int = 32 << 20) -> DataFrame:
    """page_id, url, text, n_chars of every page (columns page_id, url, html).

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments go by element,
    role and class names. The tree of what is left is aligned by simple tree matching with a reference of the
    page's host and with one of those of the host's pages that share its layout. A reference node that finds
    the same text in at least ``host_share`` of the pages is constant, so template; all other nodes are varying
    slots, the content. Pages of equal content count once, and ``least_pages`` of them are needed: what fewer
    pages share may be their own text, so smaller hosts lose only what elements, roles and names mark. The
    reference is the page with most of the nodes that enough pages hold, so no single bad page decides.

    Reference trees and templates are broadcast as long as all of them fit ``ref_bytes``; beyond that they are
    joined by host and layout, the pages of one host dealt to parts. Null or broken html, also unclosed tags,
    gives what text there is, or the empty text; urls without a host and null urls are one host; every row
    gives one row.
    """
    bound_batches(pages.sparkSession)
    source = pages.select("page_id", "url", present(F.col("html")).alias("html"), F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1)), F.lit("")).alias("host"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [parsed(html) for html in batch["html"]]
            trees = [{"parents": t.parents, "paths": t.paths, "marks": t.marks} for _, _, t, _ in found]
            columns = {"texts": [x[0] for x in found], "nodes": [x[1] for x in found], "tree": trees, "layout": [x[3] for x in found]}
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "host": batch["host"], **columns})

    tree = "struct<parents: array<int>, paths: array<bigint>, marks: array<bigint>>"
    blocks = source.mapInPandas(run, f"page_id long, url string, host string, texts array<string>, nodes array<int>, tree {tree}, layout long")
    blocks = work_table(blocks, "page-blocks")
    content = F.xxhash64("tree.paths", "tree.marks").alias("content")
    contents = blocks.select("host", "layout", content, "tree").groupBy("host", "layout", "content").agg(F.first("tree").alias("tree"))
    contents = work_table(contents.select("host", "layout", "content", "tree", F.col("tree.marks").alias("marks")), "page-contents")
    found = work_table(templates(contents, host_share, least_pages, ref_bytes), "templates")
    none = F.array().cast("array<long>")
    on_host = found.where("scope = '*'").select("host", F.col("constant").alias("on_host"))
    on_layout = found.where("scope <> '*'").select("host", F.col("scope").cast("long").alias("layout"), F.col("constant").alias("on_layout"))
    template = contents.select("host", "layout").distinct().join(on_host, "host", "left").join(on_layout, ["host", "layout"], "left")
    template = template.select("host", "layout", F.array_union(F.coalesce("on_host", none), F.coalesce("on_layout", none)).alias("constant")).where(F.size("constant") > 0)
    template = work_table(template, "page-templates")
    held = template.agg(F.sum(F.size("constant") * 8 + F.octet_length("host") + 8)).first()[0] or 0
    rows = blocks.select("page_id", "url", "host", "layout", "texts", "nodes", F.col("tree.marks").alias("marks"))
    judged = meet(rows, template, ["host", "layout"], ["page_id", "url"], held <= ref_bytes, "left")
    varying = F.filter(F.arrays_zip("texts", "nodes"), lambda x: ~F.coalesce(F.array_contains("constant", F.get("marks", x["nodes"])), F.lit(False)))
    text = F.array_join(F.transform(varying, lambda x: x["texts"]), " ")
    return judged.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
