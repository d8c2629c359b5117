"""Arrow batches of bounded size for the operators that run numpy or Python inside tasks."""

from __future__ import annotations

from pyspark.sql import SparkSession

from pixelmill.session import ship_package

BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Limit a batch by bytes, so that very long texts never meet thousands of rows in one batch, and
    make this package known to the executors."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def smallest_hashes(n: int, sample: int) -> int:
    """A bound on 64-bit hashes below which well over ``sample`` of ``n`` rows lie, so that the smallest ones are
    found without every task sending ``sample`` rows: six standard deviations more than are wanted."""
    share = (sample + 6 * sample**0.5 + 20) / max(n, 1)
    return (1 << 63) - 1 if share >= 1 else int(share * (1 << 64)) - (1 << 63)
