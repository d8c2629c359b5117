"""Quality rules as a bitmask ledger: measured once, judged by versioned policies afterwards."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.batches import bound_batches

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims")


@dataclass(frozen=True)
class Rule:
    """A document fails the rule where ``fails`` is true; ``bit`` is its place in the mask."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 10 * n_words"),
    Rule(3, "exclaims", "100 * n_exclaims > 50 * n_words"),
    Rule(4, "duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule(5, "word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
)
#: Bits that each policy version heeds.
POLICIES = {"v1": 0b000111, "v2": 0b111111}
BASE = 0b000011


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of MEASURES. Null counts as empty."""
    raw = (text or "").encode()
    words = raw.split()  # bytes split at ASCII white space only
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if n > 3:
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        at = np.fromiter(map(number.__getitem__, words), np.int64, n)
        _, pair = np.unique(at[:-1] * len(number) + at[1:], return_inverse=True)
        _, triple, count = np.unique(pair[:-1].astype(np.int64) * len(number) + at[2:], return_inverse=True, return_counts=True)
        start = count[triple] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= start
        repeated = int(covered.sum())
    return (
        n,
        len(text or "") - (len(raw) - len(raw.translate(None, SPACE))),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        raw.count(b"!"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measure every whole text and evaluate every rule once: doc_id, the measurements, fail_mask.

    Null and empty texts have zero words and fail few_words. Rows are judged one by one, so repeated
    ids, ties and null ids need no care; other columns are not read. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame([measure(x) for x in batch["text"]], columns=MEASURES, dtype="int64")
            yield pd.concat([batch["doc_id"].reset_index(drop=True), found], axis=1)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    measured = source.mapInPandas(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    mask = F.lit(0)
    for rule in rules:
        mask = mask.bitwiseOR(F.when(F.expr(rule.fails), 1 << rule.bit).otherwise(0))
    return measured.withColumn("fail_mask", mask)


def apply_policy(entries: DataFrame, policy: str, policies: dict[str, int] = POLICIES) -> DataFrame:
    """Judge the ledger by one policy version, without reading a text again."""
    return entries.withColumns({"policy": F.lit(policy), "kept": F.col("fail_mask").bitwiseAND(policies[policy]) == 0})


def ablations(entries: DataFrame, policy: str, policies: dict[str, int] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone, and that stay without it.

    Only distinct masks (at most 2 to the number of rules) leave the first aggregation.
    """
    heeded = policies[policy]
    masks = entries.groupBy(F.col("fail_mask").bitwiseAND(heeded).alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    listed = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).alias("flag")) for r in rules if heeded >> r.bit & 1])
    each = masks.select("mask", "n", F.explode(listed).alias("r")).select("mask", "n", "r.*")
    hits = F.col("mask").bitwiseAND(F.col("flag")) != 0
    others = F.col("mask").bitwiseAND(F.bitwise_not(F.col("flag")))
    return each.groupBy("rule").agg(
        F.sum(F.when(hits, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hits & (others == 0), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(others == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
