"""Mixing sources to target weights: token weights are raked to marginals, documents sampled accordingly."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from pixelmill.llm.batches import bound_batches
from pixelmill.session import work_table

OTHER = "(other)"
MOST_CELLS = 1_000_000
#: How many forms of text are learned.
FORMS = 4
#: Logarithms of shares are summed in whole steps of this size: sums over all rows are exact in any order.
STEP = 2.0**-20
#: Classes of bytes that tell the form of a text in any language; the last class is all other bytes.
CLASSES = (b"\n", b" \t", b"0123456789", b".,;:!?", b"'\"()-", b"|#*=<>{}[]/\\_`~^", b"@&$%+", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
CLASS_OF = np.full(256, len(CLASSES), np.uint8)
for _at, _members in enumerate(CLASSES):
    CLASS_OF[list(_members)] = _at
N_CLASSES = len(CLASSES) + 1

Shares = Mapping[str, float] | Callable[[np.ndarray], np.ndarray]


def scaled(weights: np.ndarray, most: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Per row the factor by which min(most, factor * weights) sums to the row's target, or fills the row."""
    at = np.divide(most, weights, out=np.full_like(weights, np.inf), where=weights > 0)  # the factor that fills each cell
    order = np.argsort(at, axis=1, kind="stable")
    at, w, m = (np.take_along_axis(x, order, axis=1) for x in (at, weights, most))
    filled = np.cumsum(np.where(np.isfinite(at), m, 0), axis=1)
    before = np.hstack([np.zeros((len(at), 1)), filled[:, :-1]])
    open_sum = np.cumsum(w[:, ::-1], axis=1)[:, ::-1]
    factor = np.divide(targets[:, None] - before, open_sum, out=np.full_like(w, np.inf), where=open_sum > 0)
    fits = factor <= at
    found = np.take_along_axis(factor, fits.argmax(axis=1)[:, None], axis=1)[:, 0]
    fullest = np.where(np.isfinite(at), at, 0).max(axis=1)
    room = filled[:, -1]
    return np.where(room <= 0, 1.0, np.where(targets >= room, fullest, np.maximum(found, 1e-12)))


def rake(available: np.ndarray, shares: list[np.ndarray], total: float, sweeps: int = 300, tolerance: float = 1e-7) -> tuple[np.ndarray, float]:
    """Iterative proportional fitting of ``available`` tokens (one axis per dimension) to ``shares`` of ``total``.

    Every cell is min(available, available x one factor per value and dimension); each step sets the factors of
    one dimension so that its values sum to their shares. Returns the cells and the largest miss of a marginal,
    as a share of ``total``; it stays large where no such cells exist.
    """
    weights, miss = np.array(available, float), 0.0
    if total <= 0 or not weights.any():
        return np.zeros_like(weights), 0.0
    for _ in range(sweeps):
        for axis, share in enumerate(shares):
            moved = np.moveaxis(weights, axis, 0)
            rows, room = moved.reshape(len(share), -1), np.moveaxis(available, axis, 0).reshape(len(share), -1)
            rows = np.minimum(rows * scaled(rows, room, total * share)[:, None], 1e280)
            weights = np.moveaxis(rows.reshape(moved.shape), 0, axis)
        fitted = np.minimum(available, weights)
        others = [tuple(k for k in range(fitted.ndim) if k != axis) for axis in range(fitted.ndim)]
        miss = max(float(np.abs(fitted.sum(axis=o) - total * s).max()) for o, s in zip(others, shares, strict=True)) / total
        if miss <= tolerance:
            break
    return fitted, miss


def largest_mixture(available: np.ndarray, shares: list[np.ndarray], most: float, accepted: float = 1e-3, steps: int = 12) -> tuple[np.ndarray, float]:
    """Raked cells of the largest total up to ``most`` whose marginals all come out within ``accepted`` after the sweeps
    of ``rake``. A somewhat larger total may be met by many more sweeps: its cells exist, but raking nears them slowly.

    Without any such total the cells closest at the upper bound are returned; the miss tells.
    """
    bounds = [most]
    for axis, share in enumerate(shares):
        held = available.sum(axis=tuple(k for k in range(available.ndim) if k != axis))
        bounds += [h / s for h, s in zip(held, share, strict=True) if s > 0]
    high = min(bounds)
    best = rake(available, shares, high)
    if best[1] <= accepted or high <= 0:
        return best
    low, found = 0.0, None
    for _ in range(steps):
        middle = (low + high) / 2
        tried = rake(available, shares, middle)
        if tried[1] <= accepted:
            low, found = middle, tried
        else:
            high = middle
    return found or best


def measured(docs: DataFrame, text_col: str, carry: list[str]) -> DataFrame:
    """In one pass over the whole texts: the carried columns as a struct ``row``, words between ASCII white
    space as mix_tokens, and the bytes of each class. A null text counts as empty."""
    bound_batches(docs.sparkSession)
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(text_col).alias("text"))
    schema = StructType([source.schema["row"], StructField("mix_tokens", LongType()), StructField("classes", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(x or "").encode() for x in batch.column(1).to_pylist()]
            tokens = [len(x.split()) for x in raw]
            classes = [np.bincount(CLASS_OF[np.frombuffer(x, np.uint8)], minlength=N_CLASSES).astype(np.int32) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(classes, pa.list_(pa.int32()))], ["row", "mix_tokens", "classes"])

    return source.mapInArrow(run, schema)


@dataclass
class Forms:
    """Centres of forms of text, over the logarithms of the shares of byte classes, brought to one scale."""

    mean: np.ndarray
    scale: np.ndarray
    centres: np.ndarray

    @property
    def names(self) -> list[str]:
        return [f"form{k}" for k in range(len(self.centres))]

    def column(self, classes: Column) -> Column:
        """The name of the nearest centre, the first of equals."""

        def nearest(logs: Column) -> Column:
            x = self.scaled([F.get(logs, F.lit(i)) for i in range(N_CLASSES)])
            return F.concat(F.lit("form"), first_least(distances(x, self.centres)).cast("string"))

        return F.get(F.transform(F.array(share_logs(classes)), nearest), F.lit(0))  # the logarithms are taken once a row

    def scaled(self, logs: list[Column]) -> list[Column]:
        return [(x - float(m)) / float(s) for x, m, s in zip(logs, self.mean, self.scale, strict=True)]


def share_logs(classes: Column) -> Column:
    """Per class the logarithm of its share of the bytes; half a byte is added to each class."""
    n = F.aggregate(classes, F.lit(0), lambda s, x: s + x)
    return F.transform(classes, lambda c: F.ln((c + F.lit(0.5)) / (n + F.lit(0.5 * N_CLASSES))))


def distances(x: list[Column], centres: np.ndarray) -> list[Column]:
    """The squared distances from all centres."""
    squares = [[F.pow(v - float(c), F.lit(2.0)) for v, c in zip(x, centre, strict=True)] for centre in centres]
    return [sum(s[1:], s[0]) for s in squares]


def first_least(values: list[Column]) -> Column:
    return F.array_min(F.array(*[F.struct(v.alias("d"), F.lit(k).alias("k")) for k, v in enumerate(values)]))["k"]


def learned_forms(rows: DataFrame, k: int = FORMS, rounds: int = 1000) -> Forms:
    """k-means over the byte classes of all rows, one aggregate over the table a step, until the centres stand still.

    The first centre is the row nearest the mean, each further one the row farthest from those before it; of equals
    the row whose logarithms are least or greatest. Only sums per centre reach the driver.
    """
    steps, axes = [f"s{i}" for i in range(N_CLASSES)], [f"x{i}" for i in range(N_CLASSES)]
    shares = rows.select(share_logs(F.col("classes")).alias("logs"))
    logs = work_table(shares.select(*[F.round(F.get("logs", F.lit(i)) / STEP).cast("long").alias(s) for i, s in enumerate(steps)]), "mix-logs")
    sums = [F.sum(s).alias(s) for s in steps]
    squares = [F.sum((F.col(s) * F.col(s)).cast("decimal(20,0)")).alias(f"q{i}") for i, s in enumerate(steps)]
    (all_rows,) = logs.agg(F.count(F.lit(1)).alias("n"), *sums, *squares).collect()
    n = all_rows["n"]
    if not n:
        return Forms(np.zeros(N_CLASSES), np.ones(N_CLASSES), np.zeros((1, N_CLASSES)))
    mean = np.array([all_rows[s] / n * STEP for s in steps])
    spread = [n * int(all_rows[f"q{i}"]) - all_rows[s] ** 2 for i, s in enumerate(steps)]
    forms = Forms(mean, np.maximum(np.sqrt([v / n**2 for v in spread]) * STEP, 1e-6), np.zeros((1, N_CLASSES)))
    scaled = logs.select(*steps, *[x.alias(a) for x, a in zip(forms.scaled([F.col(s) * STEP for s in steps]), axes, strict=True)])

    def away(centres: np.ndarray) -> DataFrame:
        return scaled.select(*steps, *axes, F.array(*distances([F.col(a) for a in axes], centres)).alias("d"))

    def picked(centres: np.ndarray, most: Callable[[Column], Column]) -> tuple[float, list[float]]:
        (found,) = away(centres).agg(most(F.struct(F.array_min("d").alias("d"), *steps, *axes)).alias("row")).collect()
        return found["row"]["d"], [found["row"][a] for a in axes]

    centres = np.array([picked(forms.centres, F.min)[1]])
    while len(centres) < k:
        gap, farthest = picked(centres, F.max)
        if gap <= 0:
            break
        centres = np.vstack([centres, farthest])
    for _ in range(rounds):
        moved = centres.copy()
        for r in away(centres).groupBy((F.array_position("d", F.array_min("d")) - 1).alias("centre")).agg(F.count(F.lit(1)).alias("n"), *sums).collect():
            moved[r["centre"]] = (np.array([r[s] / r["n"] * STEP for s in steps]) - forms.mean) / forms.scale
        if np.allclose(moved, centres):
            break
        centres = moved
    else:
        warnings.warn(f"the centres of forms still moved after {rounds} rounds", stacklevel=2)
    return Forms(forms.mean, forms.scale, centres)


def flattened(power: float) -> Callable[[np.ndarray], np.ndarray]:
    """Wanted shares proportional to a power of the tokens that each value holds."""
    return lambda held: np.where(held > 0, np.maximum(held, 1e-300) ** power, 0.0)


#: The mixture of the registered query and of the pipeline: shares of tokens by source and language; the shares of
#: learned forms, which stand for topics, are drawn together.
SOURCES = {f"src{i}": 1.0 for i in range(20)}
LANGUAGES = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}
TOPIC_POWER = 0.8


def standard_targets() -> dict[str, tuple[str, Shares]]:
    return {"source": ("source", SOURCES), "lang": ("lang", LANGUAGES)}


@dataclass
class Mixture:
    """``rows`` (see ``mixture``), the cells, and per value of each dimension what it holds, should and does get."""

    rows: DataFrame
    report: list[dict]
    total: float
    miss: float


def planned(
    docs: DataFrame,
    targets: Mapping[str, tuple[str, Shares]] | None = None,
    keep_share: float = 0.75,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    topics: str | None = None,
    carry: list[str] | None = None,
) -> Mixture:
    """Calibrate a mixture. ``targets`` names each dimension with the column that holds its value and the wanted
    shares of tokens; ``topics`` is a column of topics, without it forms of text are learned from all documents.

    Values without a target (null among them) are one class and keep their present share; the listed ones share
    the rest. Cells are at most the product of the listed values (MOST_CELLS), so the driver rakes them whatever
    the number of rows. The largest total up to ``keep_share`` of all tokens is taken that meets every share within
    0.1 % of it; where there is none, the shares that come nearest are used, with a warning, and ``miss`` and
    ``report`` tell. The texts are read once; labels and counts are written and read from then on.
    """
    spark = docs.sparkSession
    targets = standard_targets() if targets is None else targets
    rows = work_table(measured(docs, text_col, docs.columns if carry is None else carry), "mix-rows")
    columns = {d: F.col("row").getField(c) for d, (c, _) in targets.items()}
    wanted: dict[str, Shares] = {d: s for d, (_, s) in targets.items()}
    classes: dict[str, list[str]] = {d: [*dict.fromkeys(s)] for d, s in wanted.items()}
    if topics is None:
        forms = learned_forms(rows)
        columns["topic"], classes["topic"] = forms.column(F.col("classes")), forms.names
    else:
        columns["topic"] = F.col("row").getField(topics).cast("string")
        classes["topic"] = sorted(r[0] for r in rows.select(columns["topic"]).distinct().limit(MOST_CELLS).collect() if r[0] is not None)
    wanted["topic"] = flattened(TOPIC_POWER)
    names = list(columns)
    classes = {d: [*c, OTHER] for d, c in classes.items()}
    if np.prod([len(c) for c in classes.values()], dtype=float) > MOST_CELLS:
        raise ValueError("too many target cells")
    keys = [f"mix_{d}" for d in names]
    labelled = rows.select("row", *[F.when(columns[d].isin(classes[d][:-1]), columns[d]).otherwise(OTHER).alias(k) for d, k in zip(names, keys, strict=True)], "mix_tokens")
    available = np.zeros([len(classes[d]) for d in names])
    for row in labelled.groupBy(*keys).agg(F.sum("mix_tokens").alias("n")).collect():
        available[tuple(classes[d].index(row[k]) for d, k in zip(names, keys, strict=True))] = row["n"]
    everything = available.sum()
    others = [tuple(k for k in range(len(names)) if k != axis) for axis in range(len(names))]
    held = [available.sum(axis=o) for o in others]
    shares = []
    for d, h in zip(names, held, strict=True):
        rule = wanted[d]
        listed = rule(h[:-1]) if callable(rule) else np.array([rule[c] for c in classes[d][:-1]], float)
        listed = np.where(h[:-1] > 0, listed, 0.0)  # what nobody holds cannot be asked for
        rest = h[-1] / max(everything, 1) if listed.sum() > 0 else 1.0
        shares.append(np.append(listed / max(listed.sum(), 1e-300) * (1 - rest), rest))
    fitted, miss = largest_mixture(available, shares, keep_share * everything)
    if miss > 1e-3:
        warnings.warn(f"the wanted shares cannot all be met: off by {miss:.4f} of the tokens", stacklevel=2)
    total = max(fitted.sum(), 1e-300)
    attained = [fitted.sum(axis=o) / total for o in others]
    report = [
        {"dimension": d, "value": v, "held": float(h), "wanted": float(w), "attained": float(a)}
        for d, hs, ws, got in zip(names, held, shares, attained, strict=True)
        for v, h, w, a in zip(classes[d], hs, ws, got, strict=True)
    ]
    probability = np.minimum(1.0, np.divide(fitted, available, out=np.full_like(fitted, keep_share), where=available > 0))
    table = [
        (*(classes[d][i] for d, i in zip(names, at, strict=True)), float(fitted[at] / total), float(p), *(float(x) for k, i in enumerate(at) for x in (shares[k][i], attained[k][i])))
        for at, p in np.ndenumerate(probability)
    ]
    schema = [f"{k} string" for k in keys] + ["mix_weight double", "probability double"] + [f"{x}_{d} double" for d in names for x in ("wanted", "attained")]
    cells = spark.createDataFrame(table, ", ".join(schema))
    row_id = F.col("row").getField(id_col)
    fields = [F.col("row").getField(f.name) for f in rows.schema["row"].dataType.fields if "map<" not in f.dataType.simpleString()]
    drawn = F.when(row_id.isNull(), F.xxhash64(F.lit(seed), *fields)).otherwise(F.xxhash64(F.lit(seed), row_id))
    uniform = F.shiftrightunsigned(drawn, 11).cast("double") * 2.0**-53
    # at most MOST_CELLS rows whatever the input
    return Mixture(labelled.join(F.broadcast(cells), keys).withColumn("sampled", uniform < F.col("probability")), report, float(total), miss)


def mixture(docs: DataFrame, *args, **options) -> DataFrame:
    """Every row, as a struct ``row``, with its calibrated probability and whether it is sampled.

    Takes what ``planned`` takes. A row is sampled where a hash of seed and id, uniform in 0 to 1, falls below the
    probability of its cell; a rerun draws the same rows. Rows that share an id are drawn together, rows without
    one by the hash of all their columns. Texts without tokens are drawn by their cell, too. Columns beside
    ``row``: mix_<dimension>, mix_tokens, mix_weight (share of the drawn tokens of the cell), probability,
    wanted_<dimension> and attained_<dimension> (shares of the row's value), sampled. An empty table gives an
    empty result.
    """
    return planned(docs, *args, **options).rows


def sampled_documents(docs: DataFrame, **options) -> DataFrame:
    """The sampled documents with their own columns."""
    return mixture(docs, **options).where("sampled").select("row.*")
