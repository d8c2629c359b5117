"""Deterministic sampling: ranks by a keyed digest, compared with a quota per class.

``md5(seed|id)`` orders rows alike on every run and every machine, so a sample is a property of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.session import sized, work_table


def digest(id_col: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))


def numbered(df: DataFrame, order: list[str], name: str = "polygon_id") -> DataFrame:
    """Adds 1, 2, ... in the order of a stable key (W1), counted inside sampled ranges and over the ranges before."""
    ranged = work_table(df.repartitionByRange(*order).withColumn("id_range", F.spark_partition_id()), "id-ranges")
    sizes = ranged.groupBy("id_range").agg(F.count(F.lit(1)).alias("n"))
    # one row per range
    starts = sizes.select("id_range", (F.sum("n").over(Window.orderBy("id_range")) - F.col("n")).alias("id_start"))
    place = F.row_number().over(Window.partitionBy("id_range").orderBy(*order))
    return ranged.withColumn("id_place", place).join(F.broadcast(starts), "id_range").select(*df.columns, (F.col("id_start") + F.col("id_place")).alias(name))


def ranked(df: DataFrame, class_col: str, id_col: str, seed: int) -> DataFrame:
    """With rn, the random rank within the class, and class_n, the size of the class.

    A class is ranked in up to 4,096 slices of the digest, each in its own window, and the sizes of the
    slices before are added; so a class that holds most rows is still spread over many tasks.
    """
    mark = digest(id_col, seed)
    slices = df.groupBy(F.col(class_col).alias("slice_class"), F.substring(mark, 1, 3).alias("slice")).agg(F.count(F.lit(1)).alias("slice_n"))
    of_class = Window.partitionBy("slice_class")  # one row per slice
    starts = slices.select(
        "slice_class",
        "slice",
        (F.sum("slice_n").over(of_class.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("slice_n")).alias("slice_start"),
        F.sum("slice_n").over(of_class).alias("class_n"),
    )
    marked = df.withColumns({"mark": mark, "slice": F.substring(mark, 1, 3)})
    # at most 4,096 rows per class, however many classes
    starts = sized(starts.withColumnRenamed("slice", "start_slice"), "class-slices")
    joined = marked.join(starts, F.col(class_col).eqNullSafe(F.col("slice_class")) & (F.col("slice") == F.col("start_slice")))
    inside = F.row_number().over(Window.partitionBy(class_col, "slice").orderBy("mark", id_col))
    return joined.withColumn("rn", F.col("slice_start") + inside).select(*df.columns, "rn", "class_n")


def stratified_cap(df: DataFrame, class_col: str, id_col: str, most: int = 2000, seed: int = 50) -> DataFrame:
    """At most ``most`` rows per class (W2); each task passes on no more than ``most`` rows of a class."""
    rank = F.row_number().over(Window.partitionBy(class_col).orderBy(digest(id_col, seed), id_col))
    return df.withColumn("rn", rank).where(F.col("rn") <= most).drop("rn")


def train_split(df: DataFrame, class_col: str, id_col: str, share: float = 0.7, seed: int = 50) -> DataFrame:
    """Adds ``part``: train for the first ceil(share * n) of each class, else validation."""
    first = F.col("rn") <= F.ceil(F.lit(share) * F.col("class_n"))
    return ranked(df, class_col, id_col, seed).withColumn("part", F.when(first, "train").otherwise("validation")).drop("rn", "class_n")


def stratified_fraction(df: DataFrame, class_col: str, id_col: str, share: float, seed: int = 50) -> DataFrame:
    """max(1, round(n * share)) rows per class, halves to even."""
    quota = F.greatest(F.lit(1.0), F.rint(F.col("class_n") * share))
    return ranked(df, class_col, id_col, seed).where(F.col("rn") <= quota).drop("rn", "class_n")


def folds(df: DataFrame, class_col: str, id_col: str, k: int = 5, seed: int = 50) -> DataFrame:
    """Adds ``fold`` 1..k: each class is dealt round robin after shuffling."""
    return ranked(df, class_col, id_col, seed).withColumn("fold", F.pmod(F.col("rn") - 1, F.lit(k)) + 1).drop("rn", "class_n")


def proportional_quota(df: DataFrame, class_col: str, id_col: str, most: int = 15_000, seed: int = 50) -> DataFrame:
    """About ``most`` rows in all, max(1, round(most * n_class / n)) per class; all rows if there are fewer."""
    sizes = df.groupBy(class_col).agg(F.count(F.lit(1)).alias("held"))
    # one row per class
    quota = sizes.withColumn("total", F.sum("held").over(Window.partitionBy(F.lit(0)))).select(
        F.col(class_col).alias("quota_class"),
        F.when(F.col("total") <= most, F.col("held").cast("double")).otherwise(F.greatest(F.lit(1.0), F.rint(F.lit(float(most)) * F.col("held") / F.col("total")))).alias("quota"),
    )
    joined = ranked(df, class_col, id_col, seed).join(sized(quota, "class-quota"), F.col(class_col).eqNullSafe(F.col("quota_class")))
    return joined.where(F.col("rn") <= F.col("quota")).drop("rn", "class_n", "quota", "quota_class")


def simple_sample(df: DataFrame, id_col: str, n: int, seed: int = 50) -> DataFrame:
    """``n`` rows of the smallest digests, a top-k without a full sort."""
    return df.orderBy(digest(id_col, seed), id_col).limit(n)


def case_weights(df: DataFrame, class_col: str) -> DataFrame:
    """Adds ``case_weight``: inverse class frequency, scaled to a mean of one over rows."""
    sizes = df.groupBy(class_col).agg(F.count(F.lit(1)).alias("held"))
    all_classes = Window.partitionBy(F.lit(0))  # one row per class
    weight = F.sum("held").over(all_classes) / (F.count(F.lit(1)).over(all_classes) * F.col("held"))
    weights = sizes.select(F.col(class_col), weight.alias("case_weight"))
    return df.join(sized(weights, "class-weights"), class_col)
