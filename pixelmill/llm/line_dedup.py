"""Line deduplication: winnowed line hashes find places that match, their neighbours tell how far, later runs go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.llm.text import present
from pixelmill.session import work_table

RUN = 3
RUN_WORDS = 50
LONG_LINE = 300
WORD = r"[^\x20\x09-\x0D]+"
#: Parts that the rows of one fingerprint or one stretch are dealt to.
PARTS = 1024
ADDED = ("n_lines", "n_dropped_lines")
DOCUMENT = ("doc_id", "content")


def digest(text: Column) -> Column:
    """The first 128 bits of SHA-256, which stand for a text: no two texts are known to share them."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def numbered_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, content, pos (0-based), line (its digest), words and long of every line; equal rows count once."""
    text = present(F.col(text_col))
    # the hash is taken below the explode, so no line carries its whole text along
    named = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("content"), text.alias("text"))
    each = named.select(*DOCUMENT, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    each = each.select(
        *DOCUMENT, "pos", digest(F.col("line")).alias("line"), F.regexp_count("line", F.lit(WORD)).alias("words"), (F.octet_length("line") >= LONG_LINE).alias("long")
    )
    return each.repartition(*DOCUMENT).distinct()


def beside(value: str, k: int) -> Column:
    """``value`` of the line ``k`` places on (back, where negative), null outside the document."""
    order = Window.partitionBy(*DOCUMENT).orderBy("pos")
    return F.lead(value, k).over(order) if k > 0 else F.lag(value, -k).over(order) if k else F.col(value)


def stretches(run: int) -> list[tuple[int, int]]:
    """(lines, lines before the place) of every stretch of up to ``run`` lines around a place."""
    return [(size, back) for size in range(1, run + 1) for back in range(size)]


def winnowed(lines: DataFrame, run: int, run_words: int) -> DataFrame:
    """The lines with ``print`` (their hash), ``upto`` (words so far) and ``chosen``: a bit for each stretch around the
    line that is long enough to be a run and whose smallest hash stands here, at the last place of equals."""
    around = range(1 - run, run)
    near = lines.withColumn("print", F.xxhash64("line"))
    near = near.select("*", *[beside(c, k).alias(f"{c}{k}") for k in around for c in ("print", "words")])

    def chosen(size: int, back: int) -> Column:
        places = range(-back, size - back)
        lowest = F.lit(True)
        for k in places:
            lowest &= F.col("print") <= F.col(f"print{k}") if k <= 0 else F.col("print") < F.col(f"print{k}")
        wordy = sum((F.col(f"words{k}") for k in places), F.lit(0)) >= run_words
        enough = F.lit(True) if size == run else (wordy | F.col("long")) if size == 1 else wordy
        return F.coalesce(lowest & enough, F.lit(False)).cast("int")

    bits = sum((chosen(*stretch) * (1 << i) for i, stretch in enumerate(stretches(run))), F.lit(0))
    upto = F.sum("words").over(Window.partitionBy(*DOCUMENT).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return near.select(*DOCUMENT, "pos", "line", "words", "print", upto.alias("upto"), bits.alias("chosen"))


def extended(lines: DataFrame, places: DataFrame, run: int) -> DataFrame:
    """The stretches around ``places`` that each place was chosen for: start, lines, gram (the digest of their
    lines), before and through (words of the document up to their ends)."""
    marked = lines.withColumn("met", F.lit(False)).unionByName(places.select(*DOCUMENT, "pos", F.lit(True).alias("met")), allowMissingColumns=True)
    one = marked.repartition(*DOCUMENT).groupBy(*DOCUMENT, "pos")  # one shuffle; null ids meet too
    joined = one.agg(*[F.max(c).alias(c) for c in ("line", "words", "upto", "chosen", "met")])
    around = range(1 - run, run)
    near = joined.select("*", *[beside(c, k).alias(f"{c}{k}") for k in around for c in ("line", "words", "upto")]).where("met")

    def stretch(i: int, size: int, back: int) -> Column:
        first, last = -back, size - back - 1
        gram = F.unhex(F.substring(F.sha2(F.concat(*[F.col(f"line{k}") for k in range(first, last + 1)]), 256), 1, 32))
        found = F.struct(
            (F.col("pos") + first).alias("start"),
            F.lit(size).alias("lines"),
            gram.alias("gram"),
            (F.col(f"upto{first}") - F.col(f"words{first}")).alias("before"),
            F.col(f"upto{last}").alias("through"),
        )
        return F.when(F.col("chosen").bitwiseAND(1 << i) != 0, found)

    found = F.array_compact(F.array(*[stretch(i, *s) for i, s in enumerate(stretches(run))]))
    return near.select(*DOCUMENT, F.explode(found).alias("s")).select(*DOCUMENT, "s.*")


def occurring_again(rows: DataFrame, keys: list[str], counted: Column, first: Column) -> DataFrame:
    """``rows`` whose keys are counted more than once, with the smallest ``first`` of the key.

    Each key is dealt to PARTS parts by document, so a key that a third of all rows share meets in no task;
    totals come from one row per key and part.
    """
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(*DOCUMENT), F.lit(PARTS))).repartition(*keys, "part")
    parts = dealt.groupBy(*keys, "part").agg(F.sum(counted).alias("n"), F.min(first).alias("first"))
    totals = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("first").alias("first")).where("n > 1").drop("n")
    known = parts.select(*keys, "part").join(totals, keys)
    return dealt.join(known, [*keys, "part"]).drop("part")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, run_words: int = RUN_WORDS) -> DataFrame:
    """The maximal runs of lines that stood before: doc_id, content, start (0-based), lines and words.

    A stretch of lines is long enough for a run with ``run`` lines, with ``run_words`` words, or with one line of
    LONG_LINE bytes. Winnowing: equal stretches have their smallest line hash at the same place, so that place is a
    fingerprint of both. Only fingerprints are posted; those of one place are dropped, the others join their places.
    Each match is then extended both ways, over the stretches that its place was chosen for, by comparing the
    neighbouring lines (128 bits of SHA-256). All places of a stretch meet its first one in order of (doc_id,
    start), never each other, so work grows with the lines; that first one is no repeat. What overlaps or touches
    is one run.
    """
    lines = work_table(winnowed(numbered_lines(docs, id_col, text_col), run, run_words), "lines")
    posted = lines.where("chosen > 0").select(*DOCUMENT, "pos", "print")
    places = occurring_again(posted, ["print"], F.lit(1).cast("long"), F.col("print"))
    place = F.struct(*DOCUMENT, "start")
    found = work_table(extended(lines.drop("print"), places, run), "stretches")
    met = occurring_again(found, ["lines", "gram"], F.lit(1).cast("long"), place)
    later = met.where(place != F.col("first")).withColumn("end", F.col("start") + F.col("lines"))
    order = Window.partitionBy(*DOCUMENT).orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = later.withColumn("opens", F.coalesce(F.col("start") > reached, F.lit(True)).cast("int"))
    numbered = opened.withColumn("number", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy(*DOCUMENT, "number").agg(
        F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("lines"), (F.max("through") - F.min("before")).alias("words")
    )
    return merged.drop("number")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, run_words: int = RUN_WORDS) -> DataFrame:
    """The documents without their repeated runs, and two more columns: n_lines and n_dropped_lines.

    Lines end at \\n. Of equal runs the one with the smallest (doc_id, start) stays, wherever it stands; a
    null id comes first. Rows that repeat both id and text count as one document. A null text stays null
    with no lines dropped; an empty text is one empty line. An empty table gives an empty result. Input columns
    named like the two added ones are replaced by them.
    """
    runs = repeated_runs(docs, id_col, text_col, run, run_words)
    covered = runs.groupBy(*DOCUMENT).agg(F.collect_list(F.struct("start", "lines")).alias("gone"))
    covered = work_table(covered.select(F.col("doc_id").alias("gone_id"), F.col("content").alias("gone_content"), "gone"), "repeated-lines")
    carried = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(present(F.col(text_col))).alias("content")
    )
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("content") == F.col("gone_content"))
    joined = carried.join(covered.hint("merge"), same, "left")  # both grow with the corpus
    text = F.col("row").getField(text_col)
    split = F.split(present(text), "\n", -1)
    places = F.flatten(F.transform("gone", lambda x: F.sequence(x["start"], x["start"] + x["lines"] - 1)))

    def left_over(lines: Column) -> Column:  # of an array that is evaluated once, not once a line
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)  # in the order of its first argument
        cleaned = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
        return F.struct(cleaned.alias("text"), F.size(lines).alias("n_lines"), (F.size(lines) - F.size(kept)).alias("n_dropped"))

    judged = joined.select("row", "gone", F.when(F.col("gone").isNotNull(), F.get(F.transform(F.array(split), left_over), F.lit(0))).alias("left"), F.size(split).alias("n_split"))
    cleaned = F.when(F.col("gone").isNull(), text).otherwise(F.col("left.text"))
    return judged.select(
        *[(cleaned if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns if c not in ADDED],
        F.col("n_split").cast("long").alias("n_lines"),
        F.coalesce("left.n_dropped", F.lit(0)).cast("long").alias("n_dropped_lines"),
    )
