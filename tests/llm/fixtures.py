"""Small document tables with every awkward case."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, size int, n int, label string, gone string, probability double"


def documents(spark: SparkSession, rows: list[tuple[int | None, str | None]]) -> DataFrame:
    """Rows with clashing further columns, some of them null."""
    full = [(i, t, None if k % 7 == 3 else "en", None if k % 5 == 2 else f"src{k % 3}", None, "r", None, k, 1, "x", "g", 0.5) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def words(rng: random.Random, n: int, letters: str = "abcdefgh") -> list[str]:
    return ["".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(n)]


def awkward(seed: int = 1) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    base = words(rng, 80)
    rows: list[tuple[int | None, str | None]] = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "ONE two"), (5, "one  two"), (None, "no id here"), (None, None)]
    rows += [(10 + i, " ".join(base)) for i in range(6)]
    for i in range(12):
        edited = list(base)
        for _ in range(i % 5):
            edited[rng.randrange(80)] = "edit" + str(rng.randrange(40))
        rows.append((20 + i, " ".join(edited)))
    rows += [(40 + i, " ".join(words(rng, rng.randint(1, 60)))) for i in range(20)]
    rows += [(70, "É à ÀÉ straße"), (71, "é à àé straße"), (72, "x" * 20_000), (73, " ".join(words(rng, 5_000))), (73, "same id, other text"), (74, "twice"), (74, "twice")]
    shared = "\n".join(" ".join(words(rng, 9)) for _ in range(5))
    rows += [(80 + i, f"head {i}\n{shared}\ntail {i}") for i in range(4)]
    rows += [(90, "a\nb\nc\na\nb\nc\na\nb\nc"), (91, "z\na\nb\nc"), (92, "long " * 80 + "\nshort"), (93, "before\n" + "long " * 80)]
    return rows
