"""Quality classifier: a byte-level convolutional network in numpy, trained on a bounded labelled sample."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pixelmill.llm.batches import bound_batches, smallest_hashes
from pixelmill.llm.text import present
from pixelmill.session import work_table

WIDTH = 6  # bytes that a filter sees
FILTERS = 16
DEPTH = 8  # numbers that stand for a byte
BLOCK = 128  # a chunk is two neighbouring blocks, so chunks overlap by half
TAIL = WIDTH - 1
PIECE = 1024  # blocks convolved at once
MOST_LABELLED = 3000
MOST_BYTES = 32 << 20
KEEP = 0.7


@dataclass
class Network:
    """embedding (256, DEPTH), filters (WIDTH, DEPTH, FILTERS), bias, and the weights that combine the
    mean and the maximum over chunks of each pooled filter."""

    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[np.ndarray]:
        """What each pair of neighbouring bytes adds to every filter; three lookups convolve six bytes."""
        one = np.einsum("bd,wdf->wbf", self.embedding, self.filters).astype(np.float32)
        return [(one[w][:, None] + one[w + 1][None]).reshape(65536, -1) + (self.bias.astype(np.float32) if w == 0 else 0) for w in range(0, WIDTH, 2)]


def padded(text: bytes) -> np.ndarray:
    """The bytes and at least TAIL zeros, in whole blocks."""
    blocks = -(-(len(text) + TAIL) // BLOCK)
    room = np.zeros(blocks * BLOCK, np.uint8)
    room[: len(text)] = np.frombuffer(text, np.uint8)
    return room


def pooled(texts: list[bytes], tables: list[np.ndarray]) -> np.ndarray:
    """Per text the mean and the maximum over its chunks of each filter's largest response: whole texts."""
    rooms = [padded(x) for x in texts]
    sizes = np.array([len(x) // BLOCK for x in rooms])
    ends = np.cumsum(sizes)
    flat = np.concatenate([*rooms, np.zeros(TAIL + 1, np.uint8)])
    # the last TAIL windows of a text would reach into the next one
    over = ((ends * BLOCK)[:, None] - np.arange(1, TAIL + 1)).ravel()
    over.sort()
    most = np.empty((int(ends[-1]), FILTERS), np.float32)
    for first in range(0, len(most), PIECE):
        last = min(first + PIECE, len(most))
        low, high = first * BLOCK, last * BLOCK
        part = flat[low : high + TAIL + 1].astype(np.int32)
        pairs = part[:-1] << 8 | part[1:]
        n = high - low
        response = tables[0][pairs[:n]]
        for k in range(1, len(tables)):
            response += tables[k][pairs[2 * k : 2 * k + n]]
        response[over[np.searchsorted(over, low) : np.searchsorted(over, high)] - low] = -np.inf
        most[first:last] = response.reshape(-1, BLOCK, FILTERS).max(axis=1)
    np.maximum(most, 0, out=most)
    starts = ends - sizes
    chunks = np.maximum(most, np.concatenate([most[1:], most[-1:]]))
    lone = sizes == 1
    chunks[starts[lone]] = most[starts[lone]]
    inner = np.ones(len(most), bool)
    inner[(ends - 1)[~lone]] = False  # the last block starts no chunk, but in a text of one block
    chunks = chunks[inner]
    counts = np.maximum(sizes - 1, 1)
    at = np.cumsum(counts) - counts
    return np.hstack([np.add.reduceat(chunks, at, axis=0) / counts[:, None], np.maximum.reduceat(chunks, at, axis=0)])


def scores(texts: list[str | None], network: Network, tables: list[np.ndarray]) -> np.ndarray:
    if not texts:
        return np.empty(0)
    features = pooled([(x or "").encode() for x in texts], tables)
    return 1 / (1 + np.exp(-np.clip(features @ network.out + network.out_bias, -30, 30)))


def blocks_of(text: bytes) -> np.ndarray:
    """The blocks of a whole text, each with the TAIL bytes that follow it, as rows."""
    room = np.concatenate([padded(text), np.zeros(TAIL, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(room, BLOCK + TAIL)[::BLOCK]


def start(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {
        "embedding": rng.normal(0, 0.5, (256, DEPTH)),
        "filters": rng.normal(0, 0.25, (WIDTH, DEPTH, FILTERS)),
        "bias": np.zeros(FILTERS),
        "out": np.zeros(2 * FILTERS),
        "out_bias": np.zeros(1),
    }


def gradients(p: dict[str, np.ndarray], texts: list[np.ndarray], y: np.ndarray, decay: float = 1e-4, dtype: type = np.float32) -> tuple[float, dict[str, np.ndarray]]:
    """Mean log loss of texts given as blocks, and its gradients through the combination, both poolings and
    the filters to the byte embedding. All blocks of every text take part; PIECE of them are convolved at once.
    """
    sizes = np.array([len(x) for x in texts])
    x = np.concatenate(texts)
    lasts = np.cumsum(sizes) - 1
    one = np.einsum("bd,wdf->wbf", p["embedding"], p["filters"]).astype(dtype)
    peak = np.empty((len(x), FILTERS), np.int64)
    top = np.empty((len(x), FILTERS))
    for at in range(0, len(x), PIECE):
        part = x[at : at + PIECE]
        response = one[0][part[:, :BLOCK]]
        for w in range(1, WIDTH):
            response += one[w][part[:, w : w + BLOCK]]
        response[lasts[(lasts >= at) & (lasts < at + PIECE)] - at, BLOCK - TAIL :] = -np.inf  # these windows would leave the text
        peak[at : at + PIECE] = response.argmax(axis=1)
        top[at : at + PIECE] = np.take_along_axis(response, peak[at : at + PIECE, None], axis=1)[:, 0]
    h = np.maximum(top + p["bias"], 0)
    opens = np.ones(len(x), bool)
    opens[lasts[sizes > 1]] = False  # the last block starts no chunk, but in a text of one block
    left = np.flatnonzero(opens)
    right = np.minimum(left + 1, np.repeat(lasts, sizes)[left])
    from_left = h[left] >= h[right]
    chunks = np.where(from_left, h[left], h[right])
    counts = np.maximum(sizes - 1, 1)
    owner = np.repeat(np.arange(len(sizes)), counts)
    at = np.cumsum(counts) - counts
    mean, high = np.add.reduceat(chunks, at, axis=0) / counts[:, None], np.maximum.reduceat(chunks, at, axis=0)
    features = np.hstack([mean, high])
    z = np.clip(features @ p["out"] + p["out_bias"], -30, 30)
    loss = float(np.mean(np.logaddexp(0, z) - y * z) + decay / 2 * (p["out"] ** 2).sum())
    error = (1 / (1 + np.exp(-z)) - y) / len(y)
    d_features = np.outer(error, p["out"])
    is_high = chunks == high[owner]
    ties = np.add.reduceat(is_high, at, axis=0)  # chunks that reach the maximum share its gradient
    d_chunks = (d_features[:, :FILTERS] / counts[:, None])[owner] + (d_features[:, FILTERS:] / ties)[owner] * is_high
    d_top = np.zeros_like(h)
    d_top[left] += d_chunks * from_left
    d_top[right] += d_chunks * ~from_left
    d_top *= h > 0
    g = {"out": features.T @ error + decay * p["out"], "out_bias": error.sum(keepdims=True), "bias": d_top.sum(axis=0)}
    g["filters"], g["embedding"] = np.zeros_like(p["filters"]), np.zeros_like(p["embedding"])
    rows = np.arange(len(x))[:, None]
    for w in range(WIDTH):
        seen = x[rows, peak + w].astype(np.int64) * FILTERS + np.arange(FILTERS)  # the byte under place w of the winning window
        flow = np.bincount(seen.ravel(), d_top.ravel(), 256 * FILTERS).reshape(256, FILTERS)
        g["filters"][w] = p["embedding"].T @ flow
        g["embedding"] += flow @ p["filters"][w].T
    return loss, g


def fit(texts: list[bytes], labels: list[int], epochs: int = 10, batch: int = 48, rate: float = 0.01, seed: int = 5) -> Network:
    """Adam on the log loss in mini-batches of whole texts."""
    rng = np.random.default_rng(seed)
    data = [blocks_of(x) for x in texts]
    y = np.asarray(labels, float)
    p = start(seed)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    for epoch in range(epochs if len(data) else 0):
        order = rng.permutation(len(data))
        for first in range(0, len(order), batch):
            picked = order[first : first + batch]
            _, g = gradients(p, [data[i] for i in picked], y[picked])
            step += 1
            speed = rate * (0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 0.05)
            for k, v in p.items():
                first_m, second_m = moment[k]
                first_m += 0.1 * (g[k] - first_m)
                second_m += 0.001 * (g[k] ** 2 - second_m)
                v -= speed * (first_m / (1 - 0.9**step)) / (np.sqrt(second_m / (1 - 0.999**step)) + 1e-8)
    return Network(**p)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELLED, most_bytes: int = MOST_BYTES, **options
) -> Network:
    """Fit on whole texts of at most ``most`` labelled rows and ``most_bytes`` bytes in all.

    Rows are taken in the order of a hash of their id; one that no longer fits is passed over. Rows whose
    crc32(doc_id) mod 4 is 2 are held out. Of several labels of an id the smallest counts, of several texts
    the smallest, too. Only the text of a row is used. Rows without id or label are left out; without any
    labelled row all scores are 0.5.
    """
    bound_batches(docs.sparkSession)
    usable = labels.select(F.col("doc_id").alias("labelled_id"), F.col("quality").cast("int").alias("label")).where("labelled_id is not null and label in (0, 1)")
    usable = usable.where(~held_out(F.col("labelled_id"))).groupBy("labelled_id").agg(F.min("label").alias("label"))
    usable = usable.withColumn("place", F.xxhash64("labelled_id"))
    picked = usable.where(F.col("place") <= smallest_hashes(usable.count(), most)).orderBy("place", "labelled_id").limit(most)
    texts = docs.select(F.col(id_col).alias("labelled_id"), present(F.col(text_col)).alias("text"))
    # ``most`` rows at most from here on
    sample = texts.join(F.broadcast(picked), "labelled_id").groupBy("labelled_id", "place", "label").agg(F.min("text").alias("text"))
    sample = work_table(sample, "labelled-texts")
    fitting, held = [], 0
    for r in sorted(sample.select("place", "labelled_id", F.octet_length("text").alias("size")).collect()):
        if held + r["size"] <= most_bytes:
            fitting.append(r["labelled_id"])
            held += r["size"]
    rows = sorted(sample.where(F.col("labelled_id").isin(fitting)).select("labelled_id", "label", "text").collect()) if fitting else []
    return fit([r["text"].encode() for r in rows], [r["label"] for r in rows], **options)


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of every row as a struct ``row``, doc_id, held_out, score and predicted of its whole text.

    Null and empty texts get the score of an empty text. Rows are scored one by one, so repeated and null
    ids and further columns need no care. An empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(network)
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    schema = StructType([source.schema["row"], StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value.tables()
        for batch in batches:
            found = scores(batch.column(1).to_pylist(), shared.value, tables)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["row", "score"])

    judged = source.mapInArrow(run, schema)
    doc_id = F.col(f"row.{id_col}").cast("long")
    return judged.select("row", doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the classifier, trained on ``labels``, does not reject."""
    return score(docs, train(docs, labels, **options)).where("predicted = 1").select("row.*")
