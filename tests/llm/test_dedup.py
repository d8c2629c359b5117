from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pytest

from pixelmill.llm import near_dedup
from pixelmill.llm.exact_dedup import content_sort, drop_copies
from pixelmill.llm.line_dedup import drop_repeated_lines, repeated_runs
from pixelmill.session import work_table
from tests.llm.fixtures import awkward, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("hot_rows", [1, 64])
def test_exact_copies_match_brute_force(spark, hot_rows):
    rows = awkward()
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    got = content_sort(documents(spark, rows), hot_rows=hot_rows).collect()
    assert len(got) == len(rows)
    expected = defaultdict(list)
    for norm, ids in groups.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            expected[i].append((max(known, default=None), len(ids), hashlib.sha256(norm.encode()).hexdigest()))
    found = defaultdict(list)
    for r in got:
        found[r.doc_id].append((r.keep_id, r.group_size, r.text_sha256))
    assert {k: sorted(v, key=str) for k, v in found.items()} == {k: sorted(v, key=str) for k, v in expected.items()}
    assert sum(r.kept for r in got) == len(groups)


def test_exact_copies_keep_columns_and_empty_input(spark):
    docs = documents(spark, awkward())
    assert drop_copies(docs).columns == docs.columns
    assert drop_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("hot_rows", "keep"), [(2, "max"), (256, "max"), (256, "min")])
def test_hot_texts_keep_one_row(spark, hot_rows, keep):
    rows = [(7, "One id", k % 10) for k in range(600)] + [(None, "no ids", k % 10) for k in range(600)] + [(3, "alike", 0)] * 5000
    rows += [(k % 4 or None, "few Ids", k % 10) for k in range(600)] + [(k, "ALIKE", 1) for k in range(600)] + [(9, "cold", 0), (9, "cold", 0), (1, "other", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source int").repartition(5)
    docs = work_table(docs, "hot")
    got = content_sort(docs, keep=keep, hot_rows=hot_rows).collect()
    assert len(got) == len(rows)
    best = max if keep == "max" else min
    for norm in {t.lower() for _, t, _ in rows}:
        ids = [i for i, t, _ in rows if t.lower() == norm]
        mine = [r for r in got if r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()]
        wanted = best((i for i in ids if i is not None), default=None)
        assert {(r.keep_id, r.group_size) for r in mine} == {(wanted, len(ids))}
        assert [r.doc_id for r in mine if r.kept] == [wanted]
    assert len(drop_copies(docs, keep=keep, hot_rows=hot_rows).collect()) == 6


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows, percent=85):
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in parent}


def test_near_copies_match_brute_force(spark):
    rows = awkward()
    got = near_dedup.near_duplicates(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    expected = brute_components(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == expected
    sizes = defaultdict(list)
    for i, t in rows:
        sizes[i].append(len(shingle_set(t)))
    found = defaultdict(list)
    for r in got:
        found[r.doc_id].append(r.n_shingles)
        assert r.kept == (r.doc_id is not None and r.doc_id == r.component_id)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in sizes.items()}


def test_near_copies_of_sf_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute_components(rows)


def test_links_that_the_hubs_leave_apart_are_found(spark):
    """A crowd of near copies around one text, edited from a small pool, so that copies share edits."""
    import random

    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(rng.randrange(6)):
            at = rng.randrange(10) * 12
            text[at] = f"e{at}{rng.randrange(2)}"
        rows.append((i, " ".join(text)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(documents(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_other_thresholds_miss_no_more(spark):
    assert [near_dedup.least_matches(p) for p in (85, 80)] == [30, 27]
    assert all(near_dedup.miss_chance(p, near_dedup.least_matches(p)) <= 5e-5 for p in range(60, 100))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, percent=80).collect()}
    assert got == brute_components(rows, 80) != brute_components(rows, 85)


def test_near_copies_keep_columns_and_empty_input(spark):
    docs = documents(spark, awkward())
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0
    ids = [r.doc_id for r in kept.where("doc_id is not null").collect()]
    assert set(ids) == set(brute_components(awkward()).values())


def brute_lines(rows, run=3, run_words=50, long_line=300):
    """Which lines of each (id, text) stand in a stretch that stood before, every stretch of up to ``run`` lines tried."""
    docs = {(i, t or "") for i, t in rows}
    order = sorted({(i, hashlib.md5(t.encode()).hexdigest(), t) for i, t in docs}, key=lambda x: (x[0] is not None, x[0] or 0))
    seen, gone = set(), defaultdict(set)
    for i, _, t in order:
        lines = t.split("\n")
        for s in range(len(lines)):
            for size in range(1, min(run, len(lines) - s) + 1):
                part = lines[s : s + size]
                if size == run or sum(len(WORD.findall(x)) for x in part) >= run_words or (size == 1 and len(part[0].encode()) >= long_line):
                    if tuple(part) in seen:
                        gone[i, t] |= set(range(s, s + size))
                    seen.add(tuple(part))
    return {(i, t): gone[i, t] for i, t in docs}


def left_lines(t, gone):
    return "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)


def brute_runs(t, gone):
    """(start, lines, words) of the unbroken rows of ``gone`` lines."""
    lines, runs = t.split("\n"), []
    for k in sorted(gone):
        if not runs or sum(runs[-1][:2]) != k:
            runs.append([k, 0, 0])
        runs[-1][1] += 1
        runs[-1][2] += len(WORD.findall(lines[k]))
    return runs


def test_line_runs_match_brute_force(spark):
    rows = awkward()
    docs = documents(spark, rows)
    cleaned = drop_repeated_lines(docs)
    assert cleaned.columns == [*docs.columns, "n_lines", "n_dropped_lines"]
    got = sorted((str(r.doc_id), r.text or "") for r in cleaned.collect())
    expected = brute_lines(rows)
    assert got == sorted((str(i), left_lines(t or "", expected[i, t or ""])) for i, t in rows)
    assert cleaned.where("text is null").count() == sum(t is None for _, t in rows)
    assert drop_repeated_lines(docs.limit(0)).count() == 0
    assert repeated_runs(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("run", "run_words"), [(3, 50), (3, 8), (4, 6), (2, 5)])
def test_maximal_runs_match_brute_force(spark, run, run_words):
    """Texts cut from few lines, so that matches begin, end, overlap and tie everywhere."""
    import random

    rng = random.Random(run * 100 + run_words)
    pool = [" ".join(rng.choices("abcdefghij", k=rng.choice([0, 1, 2, 4, 7, 30]))) for _ in range(25)] + ["x" * 300, "y" * 299]
    rows = [(None, "\n".join(pool[:6]))]
    for i in range(60):
        text = rng.choices(pool, k=rng.randrange(12))
        at = rng.randrange(len(pool) - 6)
        text[len(text) // 2 : len(text) // 2] = pool[at : at + rng.randrange(7)]
        rows.append((i, "\n".join(text)))
    docs = documents(spark, rows)
    expected = brute_lines(rows, run, run_words)
    got = [(str(r.doc_id), r.start, r.lines, r.words) for r in repeated_runs(docs, run=run, run_words=run_words).collect()]
    assert sorted(got) == sorted((str(i), *r) for (i, t), gone in expected.items() for r in brute_runs(t, gone))
    assert len(got) > 20
    cleaned = drop_repeated_lines(docs, run=run, run_words=run_words).collect()
    assert sorted((str(r.doc_id), r.text) for r in cleaned) == sorted((str(i), left_lines(t, expected[i, t])) for i, t in rows)


def test_passages_of_fifty_words_go_at_any_number_of_lines(spark):
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    passage = [word() for _ in range(51)]
    one, two = " ".join(passage), " ".join(passage[:20]) + "\n" + " ".join(passage[20:])
    rows = [(i, f"{word()} own {i}\n{one if i % 2 else two}\nend {i} {word()}") for i in range(8)]
    rows += [(20 + i, f"own {i}\n{' '.join(passage[:40])}\nend {i}") for i in range(4)]  # a line of 40 words is no run
    got = {r.doc_id: r.n_dropped_lines for r in drop_repeated_lines(documents(spark, rows)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 1, 4: 2, 5: 1, 6: 2, 7: 1, 20: 0, 21: 0, 22: 0, 23: 0}


def test_documents_of_many_lines(spark):
    """50,000 lines in one document, a tail of them again in another one, and columns named like the added ones."""
    import time

    lines = [f"line {i} {i * 7919 % 104729}" for i in range(50_000)]
    rows = [(1, "\n".join(lines), 7), (2, "\n".join(["own", *lines[-20_000:]]), 8), (3, "\n".join(["same"] * 30_000), 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int")
    began = time.perf_counter()
    got = {r.doc_id: r for r in drop_repeated_lines(docs).collect()}
    assert time.perf_counter() - began < 60
    assert (got[1].n_lines, got[1].n_dropped_lines, got[1].text) == (50_000, 0, rows[0][1])
    assert (got[2].n_lines, got[2].n_dropped_lines, got[2].text) == (20_001, 20_000, "own")
    assert (got[3].n_lines, got[3].n_dropped_lines, got[3].text) == (30_000, 29_999, "same")
    assert drop_repeated_lines(docs).columns == ["doc_id", "text", "n_lines", "n_dropped_lines"]


def test_template_texts_below_the_threshold(spark):
    """Texts of one template share most coordinates and no link; small parts meet as large ones do."""
    import random

    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = []
    for i in range(60):
        text = list(base)
        for _ in range(14 + i % 3):
            at = rng.randrange(400)
            text[at] = f"e{at}x{rng.randrange(3)}"
        rows.append((i, " ".join(text)))
    rows += [(100 + i, rows[i][1] + " tail") for i in range(0, 60, 7)]
    docs = documents(spark, rows)
    expected = brute_components(rows)
    assert 30 < len(set(expected.values())) < len(rows)
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()} == expected
    base = near_dedup.signed(docs).selectExpr("doc_id as rep", "n_shingles", "signature")
    posted = near_dedup.work_table(near_dedup.sharing(near_dedup.work_table(base, "vertices"), 30), "posted")
    sets = near_dedup.work_table(near_dedup.full_sets(docs.selectExpr("doc_id as rep", "text")), "sets")
    nobody = spark.createDataFrame([], "vertex long, component long")
    for part_rows in (4, 1000):
        links = near_dedup.residual_links(posted, nobody, sets, 30, 85, part_rows=part_rows).collect()
        parent = {}

        def root(x, parent=parent):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        for r in links:
            x, y = sorted((root(r.a), root(r.b)))
            parent[y] = x
        assert {i: root(i) for i, _ in rows} == expected


def test_near_copies_beside_clashing_columns(spark):
    docs = documents(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, "x"), (None, "x")])
    docs = docs.selectExpr("n AS near_copy_id", "*", "label AS component_id", "gone AS kept", "size AS set_key", "1 AS rep")
    left = near_dedup.drop_near_copies(docs)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "3", "None"]
