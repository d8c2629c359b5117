"""Exact deduplication by a distributed content sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.llm.text import ascii_lower, present
from pixelmill.session import broadcast_if_small, work_table


def content_sort(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", hot_rows: int = 256, hot_bytes: int = 64 << 20, carry: bool = False
) -> DataFrame:
    """Group equal texts by sorting their normalised content.

    Sampled splitters range-partition the texts (A-Z lower-cased, whole, null as empty) by their first 32
    characters and a hash of the whole; an external sort inside each range puts equal texts side by side
    and the window compares neighbours in full.
    A text with more than ``hot_rows`` rows or ``hot_bytes`` bytes in all its copies is salted by a hash of the
    row's other columns, so that several ranges share its rows whatever the size of the table; more than ``hot_rows``
    rows alike in every column are dealt over further salts by their place in the input. Totals, and which id and row
    hash stay, are pre-aggregated before the shuffle; of rows alike one salt's stays. Hashes of hot
    texts are broadcast while they are few, else joined.

    Result: one row per input row with doc_id, keep_id (the id that stays), group_size, kept, text_sha256;
    with ``carry`` a struct ``row`` of all input columns besides. ``keep`` is "max" or "min" of the ids.
    Null and empty texts form one group. A null id never stays while another id is there. Of rows that
    share both text and id, also a null id, one stays, however many they are. An empty table gives an empty result.
    """
    if keep == "max":
        best, order = F.max(F.struct("doc_id", "mixed", "seat")), [F.col("doc_id").desc_nulls_last(), F.col("mixed").desc()]
    elif keep == "min":
        best, order = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mixed", "seat")), [F.col("doc_id").asc_nulls_last(), F.col("mixed").asc()]
    else:
        raise ValueError("keep is max or min")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("rest")] if carry else []),
        F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if f.name != text_col and "map<" not in f.dataType.simpleString()]).alias("mixed"),
        F.monotonically_increasing_id().alias("seat"),
    ).withColumn("coarse", F.xxhash64(F.lower(present(F.col("text")))))
    norm = ascii_lower(present(F.col("text")))
    alike = rows.groupBy("coarse", "mixed").agg(F.count(F.lit(1)).alias("copies"), F.sum(F.octet_length(present(F.col("text")))).alias("held"))
    alike = work_table(alike, "alike-rows")
    counted = alike.groupBy("coarse").agg(F.sum("copies").alias("copies"), F.sum("held").alias("held"))
    parts = F.greatest(F.ceil(F.col("copies") / hot_rows), F.least(F.ceil(F.col("held") / hot_bytes), F.col("copies")))
    hot = work_table(counted.select("coarse", parts.alias("parts")).where("parts > 1"), "hot-texts")
    crowds = work_table(alike.select("coarse", "mixed", F.ceil(F.col("copies") / hot_rows).alias("seats")).where("seats > 1"), "hot-rows")
    marked = rows.join(broadcast_if_small(hot, hot.count()), "coarse", "left").join(broadcast_if_small(crowds, crowds.count()), ["coarse", "mixed"], "left").drop("coarse")
    salted = marked.withColumns(
        {
            "salt": F.when(F.col("parts").isNull(), 0).otherwise(F.pmod("mixed", "parts")).cast("int"),
            "seat": F.when(F.col("seats").isNull(), 0).otherwise(F.pmod(F.xxhash64("seat"), F.col("seats"))).cast("int"),
        }
    )

    hot_groups = (
        salted.where("parts is not null")
        .groupBy(F.sha2(norm, 256).alias("text_sha256"))
        .agg(best.alias("hot_best"), F.count(F.lit(1)).alias("hot_size"))
        .select("text_sha256", F.col("hot_best.doc_id").alias("hot_keep"), F.col("hot_best.mixed").alias("hot_mixed"), F.col("hot_best.seat").alias("hot_seat"), "hot_size")
    )
    hot_groups = work_table(hot_groups, "hot-groups")
    # splitters are sampled to the driver: a short head and a hash order the texts, whatever their length
    salted = salted.withColumns({"head": F.substring(norm, 1, 32), "mark": F.xxhash64(norm)})
    run = Window.partitionBy("head", "mark", "salt", "seat", "norm").orderBy(*order)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # a text travels once, and is normalised again where it arrives
    compared = salted.repartitionByRange("head", "mark", "salt", "seat").withColumn("norm", norm).select(
        *["doc_id", "mixed", "seat", *(["text", "rest"] if carry else [])],
        F.sha2("norm", 256).alias("text_sha256"),
        F.row_number().over(run).alias("place"),
        F.first("doc_id").over(whole).alias("run_keep"),
        F.count(F.lit(1)).over(whole).alias("run_size"),
    )
    settled = compared.join(broadcast_if_small(hot_groups, hot_groups.count()), "text_sha256", "left")
    cold = F.col("hot_size").isNull()
    keep_id = F.when(cold, F.col("run_keep")).otherwise(F.col("hot_keep"))
    chosen = cold | (F.col("doc_id").eqNullSafe(F.col("hot_keep")) & (F.col("mixed") == F.col("hot_mixed")) & (F.col("seat") == F.col("hot_seat")))
    return settled.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("hot_size", "run_size").alias("group_size"),
        ((F.col("place") == 1) & chosen).alias("kept"),
        "text_sha256",
        *([F.struct(*[(F.col("text") if c == text_col else F.col("rest").getField(c)).alias(c) for c in docs.columns]).alias("row")] if carry else []),
    )


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with their own columns."""
    return content_sort(docs, carry=True, **options).where("kept").select("row.*")
