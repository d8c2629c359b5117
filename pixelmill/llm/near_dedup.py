"""MinHash near-duplicates by an inverted join on signature coordinates."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.batches import bound_batches
from pixelmill.operators.components import components
from pixelmill.session import broadcast_if_small, work_table

WIDTH = 5
COORDINATES = 48
PERCENT = 85
#: The largest chance with which a pair just at the threshold may share too few coordinates.
MISS = 5e-5
KNOWN_WORDS = 500_000
BLOCK = 1 << 15
STRIDE = 8  # coordinates counted before those who cannot reach the threshold are skipped
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def miss_chance(percent: int, matches: int) -> float:
    """Chance that a pair of that similarity shares fewer than ``matches`` coordinates."""
    p = percent / 100
    return sum(comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k) for k in range(matches))


def least_matches(percent: int) -> int:
    """Coordinates that a pair must share: as many as keep the chance of a miss within MISS (30 at 85, 27 at 80)."""
    return max((m for m in range(1, COORDINATES + 1) if miss_chance(percent, m) <= MISS), default=1)


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


PLACE = odd_numbers(WIDTH, 11)
FACTOR, SHIFT = odd_numbers(COORDINATES, 12)[:, None], odd_numbers(COORDINATES, 13)[:, None]
CHECK = odd_numbers(2, 14)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hashes of words seen before; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a whole text; fewer words than WIDTH are one shingle."""
    words = (text or "").encode().translate(LOWER).split()  # bytes split at ASCII white space only
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    width = min(n, WIDTH)
    total = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        total += h[k : n - width + 1 + k] * PLACE[k]
    return np.unique(mixed(total))


def signature(items: np.ndarray) -> np.ndarray:
    """Per coordinate the smallest of its hashes, with the coordinate mixed in."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), BLOCK):
        np.minimum(low, (items[at : at + BLOCK] * FACTOR + SHIFT).min(axis=1), out=low)
    return mixed(low + FACTOR[:, 0])


def as_lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits; null without shingles) and signature of every whole text."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, keys, signatures = [], [], []
            for text in batch.column(1).to_pylist():
                items = shingles(text, hashes)
                sizes.append(len(items))
                keys.append((items * CHECK[0] ^ items >> np.uint64(9)).sum().tobytes() + items.sum().tobytes() if len(items) else None)
                signatures.append(signature(items) if len(items) else items)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), as_lists(signatures)], ["doc_id", "n_shingles", "set_key", "signature"]
            )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, signature array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """rep and items, the full shingle set, of documents given as (rep, text)."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), as_lists([shingles(x, hashes) for x in batch.column(1).to_pylist()])], ["rep", "items"])

    return docs.select("rep", "text").mapInArrow(run, "rep long, items array<long>")


def similar(common: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    return common * 100 >= (n_a + n_b - common) * percent


def sharing(posted: DataFrame, matches: int) -> DataFrame:
    """Representatives with at least ``matches`` keys that another one has, too: n_shingles, signature, and
    these keys with their counts, the rarest first. All others cannot reach ``matches`` with anyone."""
    keyed = posted.select("rep", F.explode("signature").alias("key"))
    common = keyed.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("key", "n")
    per_rep = keyed.join(common, "key").groupBy("rep").agg(F.array_sort(F.collect_set(F.struct("n", "key"))).alias("shared"))
    return posted.drop("shared").join(per_rep.where(F.size("shared") >= matches), "rep")


def confirmed(pairs: DataFrame, posted: DataFrame, sets: DataFrame, matches: int, percent: int) -> DataFrame:
    """Those pairs (a, b) that agree on enough coordinates and then on their full sets."""

    def side(name: str, frame: DataFrame, column: str) -> DataFrame:
        return frame.select(F.col("rep").alias(name), F.col(column).alias(f"{column}_{name}"))

    agree = F.aggregate(F.zip_with("signature_a", "signature_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    near = pairs.join(side("a", posted, "signature"), "a").join(side("b", posted, "signature"), "b").where(agree >= matches).select("a", "b")
    whole = near.join(side("a", sets, "items"), "a").join(side("b", sets, "items"), "b")
    return whole.where(similar(F.size(F.array_intersect("items_a", "items_b")), F.size("items_a"), F.size("items_b"), percent)).select("a", "b")


def hub_pairs(posted: DataFrame, percent: int) -> DataFrame:
    """Each posting list names one hub, the member whose keys are the most common; all others meet the hub."""
    score = F.aggregate("shared", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    lists = posted.select("rep", "n_shingles", score.alias("score"), F.explode("shared.key").alias("key"))
    best = F.max(F.struct("score", (-F.col("rep")).alias("minus"), F.col("n_shingles").alias("n")))
    hubs = lists.groupBy("key").agg(best.alias("hub")).select("key", (-F.col("hub.minus")).alias("b"), F.col("hub.n").alias("n_b"))
    pairs = lists.join(hubs, "key").where(F.col("rep") != F.col("b"))
    fits = similar(F.least("n_shingles", "n_b"), F.col("n_shingles"), F.col("n_b"), percent)
    return pairs.where(fits).select(F.col("rep").alias("a"), "b").distinct()


class Labels(dict):
    """Components merged inside one task."""

    def root(self, x: int) -> int:
        while (above := self.get(x, x)) != x:
            self[x] = x = self.get(above, above)
        return x

    def merge(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self[max(x, y)] = min(x, y)
        return x != y


def merged_lists(group: pd.DataFrame, matches: int, percent: int) -> list[tuple[int, int]]:
    """Links between the vertices of two parts, as many as join their components.

    The posting lists of the second part are sorted by coordinate value. Each vertex of the first one merges
    those that its prefix names; who stands there is a candidate. Its collisions are counted over the rest in
    strides, and whoever can no longer reach ``matches`` is skipped. Candidates left are judged on full sets,
    given as places in one list of all items.
    """
    low = (group["part"] == group["low"]).to_numpy()
    within = bool((group["low"] == group["high"]).iloc[0])
    first, second = (np.arange(len(group)),) * 2 if within else (np.flatnonzero(low), np.flatnonzero(~low))
    rep, component, n, most = (group[c].to_numpy() for c in ("rep", "component", "n_shingles", "most"))
    signature = np.stack(group["signature"].to_numpy())
    named = [np.asarray(x) for x in group["prefix"]]
    posted = np.concatenate([named[i] for i in second])
    owner = np.repeat(np.arange(len(second)), [len(named[i]) for i in second])
    order = np.argsort(posted, kind="stable")
    posted, owner = posted[order], owner[order]
    ends = np.cumsum(n)
    universe, place = np.unique(np.concatenate(list(group["items"])), return_inverse=True)
    place = np.split(place.astype(np.int32), ends[:-1])
    seen = np.zeros(len(universe), bool)
    labels, links = Labels(), []
    n_b, most_b, component_b, signature_b = n[second], most[second], component[second], signature[second]
    for a in first:
        met = np.zeros(len(second), bool)
        for at, to in zip(np.searchsorted(posted, named[a], "left"), np.searchsorted(posted, named[a], "right"), strict=True):
            met[owner[at:to]] = True
        bound = np.minimum(most[a], most_b)
        met &= (component_b != component[a]) & (bound * 100 >= (n[a] + n_b - bound) * percent)
        if within:
            met[: a + 1] = False
        found = np.flatnonzero(met)
        same = np.zeros(len(found), np.int64)
        for at in range(0, COORDINATES, STRIDE):
            same += (signature_b[found, at : at + STRIDE] == signature[a, at : at + STRIDE]).sum(axis=1)
            able = same + max(0, COORDINATES - at - STRIDE) >= matches
            found, same = found[able], same[able]
        if not len(found):
            continue
        seen[place[a]] = True
        for b in found:
            common = int(np.count_nonzero(seen[place[second[b]]]))
            if common * 100 >= (n[a] + n_b[b] - common) * percent and labels.merge(int(component[a]), int(component_b[b])):
                links.append((int(rep[a]), int(rep[second[b]])))
        seen[place[a]] = False
    return links


def residual_links(posted: DataFrame, labels: DataFrame, sets: DataFrame, matches: int, percent: int, part_rows: int = 2048, part_items: int = 2_000_000) -> DataFrame:
    """Confirmed links between different components that the hubs left out.

    A pair with ``matches`` equal coordinates shares one of the rarest COORDINATES - matches + 1 of each
    side, its prefix. Lists within one component hold nothing new. Shingles that no other member of the
    remaining lists has cannot be common to a pair; what is left of each set bounds the similarity of a pair.
    Every vertex belongs to a part of about ``part_rows`` vertices and ``part_items`` shingles that share their
    most common coordinate, so similar vertices mostly stand in one part. Two parts that share a list meet in one task, with those of their vertices that stand in
    such lists, so a pair is judged once however many lists it shares; a task gives links that join
    components, never pairs.
    """
    slots = F.greatest(F.lit(0), F.size("shared") - matches + 1)  # keys of one vertex only have taken the first slots
    rarest = posted.select("rep", "n_shingles", "signature", F.slice("shared.key", 1, slots).alias("prefix"), F.element_at("shared", -1)["key"].alias("anchor"))
    named = rarest.join(labels.withColumnRenamed("vertex", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    members = work_table(named.select("rep", "n_shingles", "component", F.explode("prefix").alias("key")), "prefixes")
    open_lists = work_table(members.join(open_keys(members), "key"), "open-lists")
    alive = open_lists.select("rep").distinct()
    items = sets.join(alive, "rep").select("rep", F.explode("items").alias("item"))
    alone = items.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.first("rep").alias("rep")).where("n = 1").groupBy("rep").agg(F.count(F.lit(1)).alias("n_alone"))
    bounded = open_lists.drop("length").join(alone, "rep", "left").withColumn("most", F.col("n_shingles") - F.coalesce("n_alone", F.lit(0)))
    bounded = work_table(bounded.where(F.col("most") * 100 >= F.col("n_shingles") * percent).drop("n_alone"), "bounded")
    bounded = work_table(bounded.join(open_keys(bounded), "key"), "bounded-lists")

    anchors = bounded.select("rep", F.col("n_shingles").alias("n"), "component", "most").distinct().join(rarest.select("rep", "anchor"), "rep")
    anchors = work_table(anchors, "anchors")
    sized = anchors.groupBy("anchor").agg(F.greatest(F.ceil(F.count(F.lit(1)) / part_rows), F.ceil(F.sum("n") / part_items)).alias("parts"))
    parted = anchors.join(sized, "anchor").select("rep", "component", "most", F.xxhash64("anchor", F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("part"))
    parted = work_table(parted, "parted")
    standing = work_table(bounded.select("key", "rep").join(parted.select("rep", "part", "component"), "rep"), "standing")
    held = work_table(standing.groupBy("key", "part").agg(F.min("component").alias("low_c"), F.max("component").alias("high_c")), "list-parts")
    a, b = (held.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("part", "low_c", "high_c")]) for side in "ab")
    apart = F.least("low_c_a", "low_c_b") < F.greatest("high_c_a", "high_c_b")
    meeting = a.join(b, "key").where((F.col("part_a") <= F.col("part_b")) & apart)
    meeting = work_table(meeting.select("key", "part_a", "part_b"), "meeting")
    sides = meeting.select("key", F.col("part_a").alias("part"), "part_a", "part_b").union(meeting.where("part_a < part_b").select("key", F.col("part_b").alias("part"), "part_a", "part_b"))
    involved = standing.drop("component").join(sides, ["key", "part"]).select(F.col("part_a").alias("low"), F.col("part_b").alias("high"), "part", "rep").distinct()
    data = parted.drop("part").join(rarest.drop("anchor"), "rep").join(sets, "rep")

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(merged_lists(group, matches, percent), columns=["a", "b"], dtype="int64")

    return involved.join(data, "rep").groupBy("low", "high").applyInPandas(judge, "a long, b long")


def open_keys(members: DataFrame) -> DataFrame:
    """Lists that hold more than one component, and their length."""
    held = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("length"))
    return held.where("low < high").select("key", "length")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, matches: int | None = None) -> DataFrame:
    """Components of documents whose 5-word shingle sets have at least ``percent`` % in common.

    Documents with equal sets are one vertex, so copies never meet in pairs. Every vertex is posted under
    its 48 coordinate values. Values of one vertex only, and then vertices left with fewer than ``matches``
    values, are dropped, which is exact. In each posting list all members meet the list's hub; confirmed
    links give components; a second join on the rarest values finds the pairs that the hubs left apart.
    Every link is confirmed on full sets. Only MinHash itself can miss a link; ``matches`` follows from
    ``percent`` if it is not given (see ``least_matches``).

    Result per row: doc_id, n_shingles, component_id (smallest doc_id reachable), kept. Null and empty
    texts have an empty set and stay alone; rows that share an id are one vertex; a null id has a null
    component and is not kept; an empty table gives an empty result.
    """
    matches = least_matches(percent) if matches is None else matches
    base = work_table(signed(docs, id_col, text_col), "signatures")
    reps = work_table(base.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "set-reps")
    vertices = base.join(reps.select("set_key", F.col("rep").alias("doc_id")), ["set_key", "doc_id"]).select(F.col("doc_id").alias("rep"), "n_shingles", "signature")
    vertices = work_table(vertices, "vertices")
    posted = work_table(sharing(work_table(sharing(vertices, matches), "sharing"), matches), "posted")
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    alive = posted.select("rep").distinct()
    sets = work_table(full_sets(texts.join(broadcast_if_small(alive, alive.count()), "rep", "left_semi")), "full-sets")
    links = work_table(confirmed(hub_pairs(posted, percent), posted, sets, matches, percent), "hub-links")
    labels = components(links)
    more = work_table(residual_links(posted, labels, sets, matches, percent), "more-links")
    if not more.isEmpty():
        labels = components(links.union(more))
    named = reps.join(labels.withColumnRenamed("vertex", "rep"), "rep", "left").where("copies > 1 or component is not null")
    named = work_table(named.select("set_key", F.coalesce("component", "rep").alias("component")), "set-components")
    settled = base.select("doc_id", "n_shingles", "set_key").join(broadcast_if_small(named, named.count()), "set_key", "left")
    component = F.coalesce("component", "doc_id")
    return settled.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that stay, one of each component, with their own columns; rows without id stay."""
    judged = near_duplicates(docs, id_col=id_col, **options).where("not kept and doc_id is not null")
    dropped = work_table(judged.select(F.col("doc_id").alias(id_col)).distinct(), "near-copies")  # joined by name, so no column can clash
    return docs.join(broadcast_if_small(dropped, dropped.count()), id_col, "left_anti").select(*[f"`{c}`" for c in docs.columns])
