"""Shards of near-equal bytes by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.llm.batches import bound_batches
from pixelmill.llm.text import present
from pixelmill.session import work_table

ROW_OVERHEAD = 16


def differencing(sizes: list[int], k: int) -> list[int]:
    """Shard of each item. The two partial partitions of largest spread are combined again and again,
    the fullest bin of one with the emptiest of the other; only differences to the emptiest bin are kept.
    """
    if not sizes:
        return []
    first, second = [], []  # the two halves of every joined bin; items come before joins
    empty = (0, -1)
    heap = [(-size, i, [(size, i), *[empty] * (k - 1)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    n = made = len(sizes)

    def joined(a: int, b: int) -> int:
        if a < 0 or b < 0:
            return max(a, b)
        first.append(a)
        second.append(b)
        return n + len(first) - 1

    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        bins = sorted(((x[0] + y[0], joined(x[1], y[1])) for x, y in zip(a, reversed(b), strict=True)), key=itemgetter(0), reverse=True)
        if low := bins[-1][0]:
            bins = [(size - low, node) for size, node in bins]
        made += 1
        heapq.heappush(heap, (-bins[0][0], made, bins))
    shard = [0] * n
    for place, (_, node) in enumerate(heap[0][2]):
        stack = [node] if node >= 0 else []
        while stack:
            x = stack.pop()
            if x < n:
                shard[x] = place
            else:
                stack += (first[x - n], second[x - n])
    return shard


def shard_by_bytes(
    docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", bundles: int = 8192, heavy: int = 128, cell_rows: int = 10_000
) -> DataFrame:
    """Put all rows into ``shards`` shards of near-equal bytes; rows of equal text stay together.

    Items of the differencing are every text group of at least 1/(``shards`` x ``heavy``) of all bytes
    and ``bundles`` hash bundles of the lighter groups: at most shards x heavy + bundles of them however
    many rows there are, so one task holds them and both lookups can be broadcast. A group larger than
    a fair shard has a shard to itself as far as the others allow. The place inside a shard is counted in
    cells of about ``cell_rows`` rows, so no task sorts a whole shard.

    Result per row: doc_id, size (UTF-8 bytes plus 16; null: 16), text_crc32, law, shard, slot, grown_shard.
    Null and empty texts are one group; repeated ids and null ids are placed row by row; an empty table
    gives an empty result.
    """
    bound_batches(docs.sparkSession)
    text = present(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("content"),
    )
    rows = work_table(rows, "shard-rows").withColumn("bundle", F.pmod(F.xxhash64("content"), F.lit(bundles)).cast("int"))
    n_rows, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    groups = rows.groupBy("content", "bundle").agg(F.sum("size").alias("size"))
    is_heavy = F.col("size") * (shards * heavy) >= F.lit(total or 0)
    items = (
        groups.withColumn("content", F.when(is_heavy, F.col("content"))).groupBy("content", "bundle").agg(F.sum("size").alias("size"))
    )

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            item = pd.concat(parts)
            item["content"] = item["content"].map(lambda x: None if x is None else bytes(x))
            item = item.assign(tie=item["content"].map(lambda x: x or b"")).sort_values(["size", "bundle", "tie"], ascending=[False, True, True])
            yield item.assign(shard=differencing(item["size"].tolist(), shards))[["content", "bundle", "shard"]]

    placed = work_table(items.repartition(1).mapInPandas(place, "content binary, bundle int, shard int"), "shard-items")
    of_heavy = placed.where("content is not null").select("content", F.col("shard").alias("own_shard"))
    of_bundle = placed.where("content is null").select("bundle", F.col("shard").alias("bundle_shard"))
    cells = max(1, -(-n_rows // cell_rows))
    located = (
        rows.join(F.broadcast(of_heavy), "content", "left")
        .join(F.broadcast(of_bundle), "bundle", "left")
        .withColumn("shard", F.coalesce("own_shard", "bundle_shard"))
        .withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(cells)).cast("int"))
    )
    before = (
        located.groupBy("shard", "cell")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("start", F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n"))
        .drop("n")
    )
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "content")
    return (
        located.withColumn("rank", F.row_number().over(inside))
        .join(before, ["shard", "cell"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
