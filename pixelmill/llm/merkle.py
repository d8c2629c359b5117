"""A Merkle manifest of a dataset: digests per document, source and dataset, with proofs, in SQL blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.ranks import ranked
from pixelmill.session import broadcast_if_small, work_table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes that become one.
ARITY = 3
#: Levels that one block collapses: its arrays hold ``ARITY ** HEIGHT`` = 729 nodes at most.
HEIGHT = 6
PATH = "array<struct<before:string,after:string>>"


def leaf(values: list[Column]) -> Column:
    """SHA-256 over the values in order: ``-`` for a null, else the count of its UTF-8 bytes, a colon and itself."""
    written = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in written]), 256)


def joined(nodes: Column) -> Column:
    return F.array_join(nodes, "")


def floor_div(a: Column, b: Column | int) -> Column:
    return F.floor(a / b).cast("int")


def collapsed(level: Column) -> Column:
    """The level above: every ``ARITY`` consecutive nodes become the digest of all of them."""
    runs = F.sequence(F.lit(0), floor_div(F.size(level) - 1, ARITY))
    return F.transform(runs, lambda i: F.sha2(joined(F.slice(level, i * ARITY + 1, ARITY)), 256))


def levels(nodes: Column, depth: Column) -> Column:
    """The nodes and the ``depth`` levels above them, lowest first."""
    grown = F.aggregate(F.sequence(F.lit(1), depth), F.array(nodes), lambda all_, _: F.array_append(all_, collapsed(F.element_at(all_, -1))))
    return F.when(depth == 0, F.array(nodes)).otherwise(grown)


def siblings(levels: Column, place: Column, depth: Column) -> Column:
    """What stands before and after the path from ``place`` in each run on the way up, lowest level first."""

    def around(d: Column) -> Column:
        level, at = F.get(levels, d), F.floor(place / F.pow(F.lit(float(ARITY)), d)).cast("int")
        run = floor_div(at, ARITY) * ARITY
        return F.struct(joined(F.slice(level, run + 1, at - run)).alias("before"), joined(F.slice(level, at + 2, run + ARITY - 1 - at)).alias("after"))

    return F.when(depth == 0, F.array().cast(PATH)).otherwise(F.transform(F.sequence(F.lit(0), depth - 1), around))


def folded(node: Column, path: Column) -> Column:
    """The root that a node and its path give."""
    return F.aggregate(path, node, lambda below, s: F.sha2(F.concat(s["before"], below, s["after"]), 256))


def proof_text(path: Column) -> Column:
    """All sibling digests of a path, level by level, left to right."""
    return joined(F.transform(path, lambda s: F.concat(s["before"], s["after"])))


def blocks(nodes: DataFrame, name: str) -> DataFrame:
    """Stored blocks of consecutive nodes (tree, rank, node, tree_nodes, carry) with all levels inside the block.

    A tree of one block ends with its root; the blocks of a larger tree all collapse ``HEIGHT`` levels, so that their
    tops are the nodes of one level of the tree.
    """
    size = ARITY**HEIGHT
    n = F.size("members")
    gathered = nodes.groupBy("tree", F.floor(F.col("rank") / size).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "node", "carry"))).alias("members"), F.ceil(F.max("tree_nodes") / size).cast("long").alias("tree_blocks")
    )
    needed = F.size(F.filter(F.array(*[F.lit(ARITY**i) for i in range(HEIGHT)]), lambda x: x < n))
    deep = gathered.withColumn("depth", F.when(F.col("tree_blocks") > 1, F.lit(HEIGHT)).otherwise(needed))
    grown = deep.withColumn("levels", levels(F.transform("members", lambda m: m["node"]), F.col("depth")))
    return work_table(grown, name).withColumn("top", F.get(F.element_at("levels", -1), F.lit(0)))


def above(stored: DataFrame, name: str) -> DataFrame:
    """Per block its path to the root of its tree, and that root: the tops are collapsed in blocks again until every
    tree is one node."""
    most = stored.agg(F.max("tree_blocks")).first()[0] or 0
    if most <= 1:
        return stored.select("tree", "block", F.array().cast(PATH).alias("above"), F.col("top").alias("root"))
    tops = stored.select("tree", F.col("block").alias("rank"), F.col("top").alias("node"), F.col("tree_blocks").alias("tree_nodes"), F.lit(None).cast("string").alias("carry"))
    upper = blocks(tops, name)
    return unblocked(upper, above(upper, name)).select("tree", F.col("rank").alias("block"), F.col("path").alias("above"), "root")


def unblocked(stored: DataFrame, paths: DataFrame) -> DataFrame:
    """Per node: tree, rank, node, carry, its whole path, and the further columns of ``paths``."""
    paths = work_table(paths, "merkle-paths")
    full = stored.join(broadcast_if_small(paths, paths.count(), 20_000), ["tree", "block"])
    each = F.transform(
        "members",
        lambda m, i: F.struct(m["rank"].alias("rank"), m["node"].alias("node"), m["carry"].alias("carry"), F.concat(siblings(F.col("levels"), i, F.col("depth")), F.col("above")).alias("path")),
    )
    return full.select("tree", *[c for c in paths.columns if c not in ("tree", "block", "above")], F.inline(each))


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = FIELDS, shown: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: doc_id, leaf, subroot of its source, root of the dataset, and ``path``, the digests that
    prove the document (per level those before and after it, from the leaf's run to the root's).

    ``shown`` names fields with the values that somebody presents instead of the stored ones; ``shown_leaf`` is the
    leaf of those, so ``folded("shown_leaf", "path")`` is the root that they prove.

    Leaves of a source stand in the order of doc_id (null first; rows that share it in the order of their digests, so
    repeated rows need no order). A null source is a source of its own and comes first, an empty one is another. A lone leaf is its source's subroot, a lone
    subroot the root. An empty table gives an empty manifest. Further columns of any name are ignored.

    Only digests are shuffled. Ranks come from ranges of (source, doc_id), so a source may hold any share of the rows;
    blocks of 729 nodes collapse six levels by array functions, and their tops are blocks again, so 10^10 documents
    take four rounds.
    """
    value = {f: F.col(f"`{f}`") for f in fields}
    source = F.col(f"`{source_col}`").cast("string")
    rows = docs.select(
        F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source)).alias("tree"),  # null first
        F.col(f"`{id_col}`").alias("doc_id"),
        leaf(list(value.values())).alias("node"),
        leaf(list((value | (shown or {})).values())).alias("shown_leaf"),
    )
    rows = work_table(rows, "merkle-leaves")
    leaves = ranked(rows, "tree", ["doc_id", "node"], "merkle-ranges").select("tree", "rank", "node", F.col("key_rows").alias("tree_nodes"), F.struct("doc_id", "shown_leaf").alias("carry"))
    stored = blocks(leaves, "merkle-blocks")
    inside = work_table(above(stored, "merkle-upper"), "merkle-above")

    subroots = work_table(inside.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("carry"), F.col("root").alias("node")), "merkle-subroots")
    sources = ranked(subroots, "tree", ["carry"], "merkle-sources").withColumnRenamed("key_rows", "tree_nodes")
    over = blocks(sources, "merkle-source-blocks")
    of_source = unblocked(over, above(over, "merkle-source-upper")).select(F.col("carry").alias("tree"), F.col("path").alias("source_path"), "root")
    of_source = work_table(of_source, "merkle-source-paths")
    whole = inside.withColumnRenamed("root", "subroot").join(broadcast_if_small(of_source, of_source.count(), 20_000), "tree")
    whole = whole.withColumn("above", F.concat("above", "source_path")).drop("source_path")
    return unblocked(stored, whole).select("carry.doc_id", F.col("node").alias("leaf"), "carry.shown_leaf", "subroot", "root", "path")
