"""Harmonic packing of token sequences: classes by reciprocals of the capacity, a fixed count of pieces per bin."""

from __future__ import annotations

import contextlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.llm.batches import bound_batches
from pixelmill.llm.bpe_automaton import byte_of_letter
from pixelmill.llm.token_lengths import PATTERN
from pixelmill.session import broadcast_if_small, work_table

CAPACITY = 2048
END_ID = 1
#: Characters that the tokenizer gets at once, about.
STRETCH = 200_000
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """A vocabulary file of the tokenizers library, read by tiktoken, which gives the same numbers in a fifth of the
    time where each merge's number tells its turn. Runs of white space that are too long for tiktoken's patterns, and
    vocabularies of another order, go to the tokenizers library itself."""

    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        self.library = tokenizers.Tokenizer.from_str(content.decode())
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(content)
        vocabulary, special = spec["model"]["vocab"], {x["content"]: x["id"] for x in spec["added_tokens"]}
        turns = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        letters = byte_of_letter()
        ranks = {bytes(map(letters.__getitem__, name)): i for name, i in vocabulary.items() if name not in special}
        ordered = turns == sorted(turns)
        self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special) if ordered else None

    def encode(self, text: str) -> np.ndarray:
        if self.ranks is not None:
            with contextlib.suppress(ValueError):
                return self.ranks.encode_to_numpy(text, allowed_special="all")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def encoder(content: bytes) -> Encoder:
    return Encoder(content)


def stretches(text: str, size: int = STRETCH) -> list[str]:
    """A long text in parts that are encoded alike apart and together.

    Byte-level vocabularies split texts before a single space between two characters that are no white space, whatever
    stands around; the parts begin there. Text without such a place stays in one part.
    """
    parts, begun = [], 0
    while len(text) - begun > size and (found := LONE_SPACE.search(text, begun + size)):
        parts.append(text[begun : found.start()])
        begun = found.start()
    return [*parts, text[begun:]]


def reciprocal_cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of ``n`` tokens: whole sequences first, then halves, quarters and so on of one, each at
    most once. Every piece is exactly 1/k of the capacity for a class k = 1, 2, 4 and so on."""
    rest = n % capacity
    return [capacity] * (n // capacity) + [1 << b for b in range(capacity.bit_length() - 2, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and cut every whole text: doc_id, start, length, ids (32-bit little-endian numbers), doc_tokens,
    ``share`` (the class: so many such pieces fill a sequence), and ``part`` and ``nth``, which worker made the piece
    and how many of its class it had made before."""
    content = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_bytes())
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, made = encoder(content.value).encode, TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], np.uint32)
        for batch in batches:
            ids = [np.concatenate([*map(encode, stretches(text)), end]) if text else end for text in batch.column("text").to_pylist()]
            cuts = [reciprocal_cuts(len(x), capacity) for x in ids]
            doc = np.repeat(np.arange(len(ids)), list(map(len, cuts)))
            length = np.fromiter(chain.from_iterable(cuts), np.int64)
            ends = length.cumsum()
            tokens = np.array(list(map(len, ids)), np.int64)
            nth, share = np.zeros(len(length), np.int64), capacity // length
            for k in np.unique(share).tolist():
                of_class = share == k
                nth[of_class] = made[k] + np.arange(of_class.sum())
                made[k] += int(of_class.sum())
            numbers = pa.py_buffer(np.concatenate(ids).astype("<u4").tobytes() if ids else b"")
            binary = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int32)), numbers])
            columns = [batch.column("doc_id").take(pa.array(doc)), ends - length - (tokens.cumsum() - tokens)[doc], length, binary, tokens[doc], share.astype(np.int32), np.full(len(doc), part, np.int32), nth]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=names)

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, share int, part int, nth long"
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "share", "part", "nth"]
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens (a power of two), without padding.

    A document is its tokens and ``end_id``. It is cut at reciprocals of the capacity (``reciprocal_cuts``), so that the
    bins of class k hold exactly k pieces and nothing else. Every worker fills the bins of each class by itself; what is
    left of a class in all workers, fewer than k pieces each, fills further bins, and the last m < k pieces of a class
    make a sequence for each power of two in m: its length is a power of two, which needs no padding.

    Result, one row per piece: doc_id, start, length, ids, doc_tokens, sequence_id (gapless from 0), offset. Null and
    empty texts are ``end_id`` alone. Null and repeated ids are packed row by row. An empty table gives no pieces.
    One count per worker and class is all that is gathered; pieces are not shuffled while those counts are few.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    cut = work_table(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "packing-pieces")
    counts = cut.groupBy("share", "part").agg(F.count(F.lit(1)).alias("n")).withColumns({"bins": F.floor(F.col("n") / F.col("share")), "left": F.col("n") % F.col("share")})
    of_class = Window.partitionBy("share")
    before = of_class.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    counts = work_table(
        counts.withColumns(
            {
                "bins_before": F.sum("bins").over(before) - F.col("bins"),
                "left_before": F.sum("left").over(before) - F.col("left"),
                "all_bins": F.sum("bins").over(of_class),
                "all_left": F.sum("left").over(of_class),
            }
        ),
        "packing-counts",
    )
    classes = counts.select("share", "all_bins", "all_left").distinct()  # one row per class: twelve at 2,048
    classes = classes.withColumn("sequences", F.col("all_bins") + F.floor(F.col("all_left") / F.col("share")) + F.bit_count(F.col("all_left") % F.col("share")))
    classes = classes.select("share", (F.sum("sequences").over(Window.orderBy("share").rowsBetween(Window.unboundedPreceding, 0)) - F.col("sequences")).alias("first_sequence"))
    counts = counts.join(F.broadcast(classes), "share")
    placed = cut.join(broadcast_if_small(counts, counts.count()), ["share", "part"])

    share, own = F.col("share"), F.col("nth") < F.col("bins") * F.col("share")
    rank = F.col("left_before") + F.col("nth") - F.col("bins") * share  # among what is left of the class
    last, odd = F.col("all_left") - F.col("all_left") % share, F.col("all_left") % share
    at = rank - last
    # a leftover piece belongs to the highest bit in which its place differs from their number
    bit = F.length(F.bin(at.bitwiseXOR(odd))) - 1
    width = F.pow(F.lit(2.0), bit).cast("long")
    group = F.floor(odd / (width * 2)) * width * 2
    number = (
        F.when(own, F.col("bins_before") + F.floor(F.col("nth") / share))
        .when(rank < last, F.col("all_bins") + F.floor(rank / share))
        .otherwise(F.col("all_bins") + F.floor(F.col("all_left") / share) + F.bit_count(group))
    )
    place = F.when(own, F.col("nth") % share).when(rank < last, rank % share).otherwise(at - group)
    return placed.select(
        "doc_id", "start", "length", "ids", "doc_tokens", (F.col("first_sequence") + number).cast("long").alias("sequence_id"), (place * F.col("length")).cast("long").alias("offset")
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences to train on: sequence_id, n_tokens, ids (32-bit little-endian numbers), and the documents' pieces
    in them in order (doc_id, start, length)."""
    members = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    return packed.groupBy("sequence_id").agg(members.alias("m")).select(
        "sequence_id",
        F.aggregate("m", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("n_tokens"),
        F.aggregate("m", F.lit(b""), lambda all_, x: F.concat(all_, x["ids"])).alias("ids"),
        F.transform("m", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["length"].alias("length"))).alias("pieces"),
    )
