"""The trie of conversation prefixes, with sums over subtrees by pointer jumping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.batches import bound_batches
from pixelmill.llm.ranks import dealt, numbered, starts
from pixelmill.llm.text import present
from pixelmill.session import work_table

#: Turns whose running digests are made in one row.
BLOCK = 256
#: Bits of a conversation number inside one list of ends: 4,096 of them at most.
END_BITS = 12
#: A pointer that more than this share of all nodes have in common is hot; there are 10,000 such at most.
HOT_SHARE = 10_000
ROOT = b""


def digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def turns_of(conversations: DataFrame) -> DataFrame:
    """Stored turns with ``rank`` in their conversation: conv_id, rank, digest of role and text, bytes of the text.

    Turns stand in the order of ``turn`` (null first); those that share it by role, then by digest. A null role or
    text is empty. Rows without a conv_id belong to no conversation. Only digests are shuffled.
    """
    role, text = present(F.col("role")), present(F.col("text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("role"),
        digest(F.octet_length(role).cast("string"), F.lit(":"), role, text).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    return dealt(work_table(rows, "trie-turns"), "conv_id", ["turn", "role", "digest"], "trie-ranges")


def reopened(conversations: DataFrame, family: int = 5, opening: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on shared openings: conversation c begins with the first h turns of conversation
    c - c % ``family`` (all of them if it has fewer, none if it is absent) and goes on with its own after its first h.

    ``opening`` is h as a function of conv_id, by default crc32 of the decimal number, modulo 9.
    Result: the turns (conv_id, position, digest, bytes, total) and the conversations (conv_id, total), also those
    left without turns.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9 if opening is None else opening
    stored = turns_of(conversations)
    begun = starts(stored, "conv_id")
    sizes = work_table(begun.groupBy("conv_id").agg(F.max("key_rows").alias("n")), "trie-sizes")
    info = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    of_base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    info = info.join(of_base, "base", "left").withColumn("shift", F.least(F.col("h"), F.coalesce("base_n", F.lit(0))))
    info = work_table(info.withColumn("total", F.col("shift") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).drop("base_n"), "trie-conversations")

    # what a turn must know of its conversation joins the starts of the ranges: a long conversation has few of those
    order = ["turn", "role", "digest"]
    ranks = work_table(numbered(stored, begun.join(info.select("conv_id", "h", "shift", "total"), "conv_id"), "conv_id", order).drop(*order[:2]), "trie-ranks")
    own = ranks.where("rank >= h").select("conv_id", (F.col("rank") - F.col("h") + F.col("shift")).alias("position"), "digest", "bytes", "total")
    most = info.agg(F.max("h")).first()[0] or 0
    openings = ranks.where(F.col("rank") < most).select(F.col("conv_id").alias("base"), "rank", "digest", "bytes")
    shared = info.select("conv_id", "base", "h", "total").join(openings, "base").where("rank < h").select("conv_id", F.col("rank").alias("position"), "digest", "bytes", "total")
    return own.unionByName(shared), info.select("conv_id", "total")


def running_blocks(turns: DataFrame, name: str) -> DataFrame:
    """Stored blocks of ``BLOCK`` consecutive turns with their running digests; ``before``, the digest of all earlier
    blocks (null in the first), made from the blocks' last digests in the same way; and ``last``, the prefix that ends
    with the turn before the block."""
    item = F.struct("position", "digest", *[c for c in ("bytes", "total") if c in turns.columns])
    blocks = turns.groupBy("conv_id", F.floor(F.col("position") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    run = F.aggregate("items", F.array(F.lit(ROOT)), lambda all_, x: F.array_append(all_, digest(F.element_at(all_, -1), x["digest"])))
    blocks = work_table(blocks.withColumn("running", run), name)
    if (blocks.agg(F.max("block")).first()[0] or 0) == 0:
        return blocks.withColumns({"before": F.lit(None).cast("binary"), "last": F.lit(ROOT)})
    ends = blocks.select("conv_id", F.col("block").alias("position"), F.element_at("running", -1).alias("digest"))
    upper = prefixes(running_blocks(ends, f"{name}-upper"), "digest")
    last = F.when(F.col("parent") == F.lit(ROOT), F.col("digest")).otherwise(digest(F.col("parent"), F.col("digest")))
    upper = upper.select("conv_id", F.col("depth").alias("block"), F.col("node").alias("before"), last.alias("last"))
    return blocks.join(upper, ["conv_id", "block"], "left").withColumn("last", F.coalesce("last", F.lit(ROOT)))


def prefixes(blocks: DataFrame, *carry: str) -> DataFrame:
    """Per turn: conv_id, depth, the digest of the prefix that ends with it (node) and of the one before it (parent).

    Equal sequences of turns have equal digests: how a digest is put together depends on the depth alone.
    """

    def whole(run: Column) -> Column:
        before = F.col("before")
        return F.when(before.isNull(), run).otherwise(digest(before, run))

    def turn(x: Column, i: Column) -> Column:
        running = F.col("running")
        parent = F.when(i == 0, F.col("last")).otherwise(whole(F.get(running, i)))
        return F.struct((x["position"] + 1).alias("depth"), whole(F.get(running, i + 1)).alias("node"), parent.alias("parent"), *[x[c].alias(c) for c in carry])

    return blocks.select("conv_id", F.inline(F.transform("items", turn)))


def end_digests(ends: DataFrame) -> DataFrame:
    """Per node: SHA-256 of the decimal numbers of the conversations (node, conv_id) that end there, ascending and
    joined by commas.

    Numbers are gathered in lists of at most 4,096; a node's lists are hashed one after another, so its
    conversations are never held together.
    """
    bound_batches(ends.sparkSession)
    chunks = ends.groupBy("node", F.shiftright("conv_id", END_BITS).alias("chunk")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("numbers")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_node, sha = None, hashlib.sha256()
        for batch in batches:
            done = []
            for node, numbers in zip(map(bytes, batch["node"]), batch["numbers"], strict=True):
                if node == open_node:
                    sha.update(b",")
                else:
                    if open_node is not None:
                        done.append((open_node, sha.hexdigest()))
                    open_node, sha = node, hashlib.sha256()
                sha.update(numbers.encode())
            yield pd.DataFrame(done, columns=["node", "ends_sha256"])
        if open_node is not None:
            yield pd.DataFrame([(open_node, sha.hexdigest())], columns=["node", "ends_sha256"])

    return chunks.repartition("node").sortWithinPartitions("node", "chunk").select("node", "numbers").mapInPandas(run, "node binary, ends_sha256 string")


def look_up(edges: DataFrame, found: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """``edges`` (node, ptr) with columns of the node that ptr names; ``wanted`` maps those to new names.

    A pointer that more than 1 of ``HOT_SHARE`` edges have in common would fill one task: such pointers, 10,000 at most,
    are broadcast; the others are joined by shuffle.
    """
    total = edges.count()
    looked = found.select(F.col("node").alias("ptr"), *[F.col(a).alias(b) for a, b in wanted.items()])
    often = edges.groupBy("ptr").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(1000, total // HOT_SHARE)).select("ptr")
    hot = F.broadcast(work_table(looked.join(F.broadcast(often), "ptr"), "trie-hot"))
    rare = edges.join(hot.select("ptr"), "ptr", "left_anti").join(looked, "ptr")
    return edges.join(hot, "ptr").unionByName(rare)


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """Sums of ``values`` over each node's subtree, its top included, by pointer jumping.

    ``nodes`` (node, parent, values) is stored; the root's parent is null. Before round j every node has the sum over its
    descendants at a distance under 2^j and a pointer to its ancestor at distance 2^j. A round adds each node's
    sums to that ancestor and lets it point to where the ancestor points: as many rounds as the depth has binary digits.
    """
    sums = nodes.select("node", *values)
    edges = nodes.where("parent is not null").select("node", F.col("parent").alias("ptr"))
    while True:
        given = edges.join(sums, "node").groupBy("ptr").agg(*[F.sum(v).alias(f"{v}_below") for v in values])
        grown = sums.join(given, sums["node"] == given["ptr"], "left").select("node", *[(F.col(v) + F.coalesce(f"{v}_below", F.lit(0))).alias(v) for v in values])
        sums = work_table(grown, "trie-sums")
        inner = edges.where(F.col("ptr") != F.lit(ROOT))  # the others have reached the top
        edges = work_table(look_up(inner, edges, {"ptr": "next"}).select("node", F.col("next").alias("ptr")), "trie-edges")
        if edges.isEmpty():
            return sums


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """All distinct prefixes of the conversations as nodes of a trie, the empty one as its root.

    ``turns`` (conv_id, position from 0, digest, bytes, total turns) and ``conversations`` (conv_id, total), one row
    each, are as ``reopened`` gives them. Result per node: node (digest), parent, depth, conv_id (smallest member),
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Without conversations there are no nodes.
    """
    rows = work_table(prefixes(running_blocks(turns, "trie-blocks"), "bytes", "total"), "trie-prefixes")
    conversations = work_table(conversations, "trie-totals")
    met = rows.groupBy("node").agg(F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_convs"))
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), "n_convs")
    nodes = work_table(met.unionByName(root), "trie-nodes")

    children = nodes.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("parent", "of")
    nodes = nodes.join(children, nodes["node"] == children["of"], "left").drop("of").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")})
    nodes = work_table(nodes, "trie-children")
    sums = subtree_sums(nodes, ["n_leaves", "saved_tokens"])

    top = nodes.where("depth = 0").first()
    deep = look_up(nodes.where("depth > 1").select("node", F.col("parent").alias("ptr")), nodes, {"conv_id": "parent_conv_id"}).select("node", "parent_conv_id")
    high = nodes.where("depth = 1").select("node", F.lit(top and top.conv_id).cast("long").alias("parent_conv_id"))
    ends = rows.where("depth = total").select("node", "conv_id").unionByName(conversations.where("total = 0").select(F.lit(ROOT).alias("node"), "conv_id"))
    return (
        nodes.drop("n_leaves", "saved_tokens", "bytes")
        .join(sums, "node")
        .join(deep.unionByName(high), "node", "left")
        .join(end_digests(ends), "node", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    )
