"""Exact histogram of encoded lengths, and what its suffix sums answer for every context limit."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, partial
from pathlib import Path

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.llm.batches import bound_batches

#: The pattern that splits text before the merges of the public rank files, and the special token
#: that the same vocabulary has beside the ranks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = {"<|endoftext|>": 50256}


@lru_cache(maxsize=2)
def encoder(content: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def token_lengths(docs: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of every whole text; null and empty texts have none.

    A special token's name in a text counts as that one token, as when texts are encoded.
    """
    content = docs.sparkSession.sparkContext.broadcast(Path(rank_path).read_bytes())
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = partial(encoder(content.value).encode, allowed_special="all")
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [len(encode(x)) if x else 0 for x in batch["text"]]})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame, block: int = 64) -> DataFrame:
    """One row per encoded length: n_docs and n_tokens of that length, and sums over it and all longer ones.

    ``docs_from`` and ``tokens_from`` are suffix sums. ``truncated_tokens`` is what remains of the whole
    corpus under the context limit ``n_tokens``: all shorter documents whole, the others cut to the limit.
    ``overflow_tokens`` is what the limit cuts off. ``quantile`` is the share of documents of at most this
    length. Sums run inside blocks of ``block`` lengths and over block totals, so no task orders them all.
    Any limit between two lengths follows from the next longer row, see ``total_at``.
    An empty table has an empty histogram; documents without text count at length 0.
    """
    bars = (
        lengths.groupBy("n_tokens")
        .agg(F.count(F.lit(1)).alias("n_docs"))
        .withColumns({"tokens": F.col("n_docs") * F.col("n_tokens"), "block": F.floor(F.col("n_tokens") / block)})
    )
    totals = bars.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "block",
        F.coalesce(F.sum("block_docs").over(later), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("block_tokens").over(later), F.lit(0)).alias("tokens_after"),
        F.sum("block_docs").over(everything).alias("all_docs"),
        F.sum("block_tokens").over(everything).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc())
    return (
        bars.join(totals, "block")
        .withColumns({"docs_from": F.sum("n_docs").over(inside) + F.col("docs_after"), "tokens_from": F.sum("tokens").over(inside) + F.col("tokens_after")})
        .withColumn("truncated_tokens", F.col("all_tokens") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens"))
        .select(
            "n_tokens",
            "n_docs",
            "tokens",
            "docs_from",
            "tokens_from",
            "truncated_tokens",
            (F.col("all_tokens") - F.col("truncated_tokens")).alias("overflow_tokens"),
            ((F.col("all_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
        )
    )


def total_at(histogram: DataFrame, limit: int) -> DataFrame:
    """Tokens of the corpus when every document is cut to ``limit``: one row, truncated_tokens."""
    return histogram.agg(F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("truncated_tokens"))


def length_at(histogram: DataFrame, share: float) -> DataFrame:
    """The smallest length that ``share`` of the documents do not exceed: one row, n_tokens."""
    return histogram.where(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))
