from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pixelmill.llm import merkle
from pixelmill.llm.queries import op11_merkle_manifest
from pixelmill.llm.ranks import ranked
from tests.llm.fixtures import awkward, documents


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(*values) -> str:
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def brute_tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and per node the digests before and after it, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            run = place // 3 * 3
            paths[i].append(("".join(nodes[run:place]), "".join(nodes[place + 1 : run + 3])))
        nodes, at = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [p // 3 for p in at]
    return nodes[0], paths


def brute_manifest(rows) -> list[tuple]:
    """(doc_id, leaf, subroot, root, path) of rows (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, brute_leaf(*r), r[0]))
    keys = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    inner = {k: brute_tree([x[2] for x in sorted(trees[k])]) for k in keys}
    root, outer = brute_tree([inner[k][0] for k in keys])
    return [(x[3], x[2], inner[k][0], root, path + outer[i]) for i, k in enumerate(keys) for x, path in zip(sorted(trees[k]), inner[k][1], strict=True)]


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest_matches_brute_force(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    docs = documents(spark, [*awkward(), *[(500 + i, f"row {i}") for i in range(30)], (600, "same"), (600, "same")])
    rows = [tuple(r) for r in docs.select(*merkle.FIELDS).collect()]
    rng = random.Random(3)
    rows += [(1000 + i, "hot" if i % 3 else None, None, rng.randint(0, 9), "é\n") for i in range(130)] + [(2000, "", "en", 1, "x"), (2001, "é", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"tree": F.lit(1), "rank": F.lit("x"), "node": F.lit(None).cast("int")})
    got = merkle.manifest(docs, shown={"text": F.replace("text", F.lit("\n"), F.lit(""))}).withColumn("proves", merkle.folded(F.col("shown_leaf"), F.col("path"))).collect()
    found = sorted((r.doc_id is not None, r.doc_id or 0, r.leaf, r.subroot, r.root, [(s.before, s.after) for s in r.path]) for r in got)
    assert found == sorted((i is not None, i or 0, *rest) for i, *rest in brute_manifest(rows))
    text = {brute_leaf(*r): r[4] or "" for r in rows}
    assert all((r.proves == r.root) == ("\n" not in text[r.leaf]) for r in got)


def test_lone_rows_and_no_rows(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    (r,) = merkle.manifest(spark.createDataFrame([(7, None, None, None, "t")], schema)).collect()
    assert r.leaf == r.subroot == r.root == brute_leaf(7, None, None, None, "t") and r.path == []
    assert merkle.manifest(spark.createDataFrame([], schema)).collect() == []


def test_query_on_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*merkle.FIELDS).collect()]
    expected = {}
    for r, (i, leaf, subroot, root, path) in zip(sorted(rows, key=lambda r: r[0]), sorted(brute_manifest(rows)), strict=True):
        shown = brute_leaf(*r[:4], r[4].replace("\n", "")) if zlib.crc32(str(i).encode()) % 2 == 0 else leaf
        for before, after in path:
            shown = h(before, shown, after)
        expected[i] = (leaf, subroot, root, h(*[x for s in path for x in s]), shown, shown == root)
    assert {r.doc_id: tuple(r)[1:] for r in op11_merkle_manifest(spark, sf).collect()} == expected


def test_ranks_of_a_hot_key(spark):
    rows = [(f"k{i % 7}" if i % 3 else "hot", i % 5 or None) for i in range(400)] + [("same", 1)] * 200
    got = ranked(spark.createDataFrame(rows, "key string, v int"), "key", ["v"], "ranks").collect()
    for key in {k for k, _ in rows}:
        mine = sorted((r.rank, r.v) for r in got if r.key == key)
        assert [x[0] for x in mine] == list(range(sum(k == key for k, _ in rows)))
        values = [x[1] or 0 for x in mine]
        assert values == sorted(values) and {r.key_rows for r in got if r.key == key} == {len(mine)}
