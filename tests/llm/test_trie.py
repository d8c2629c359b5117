from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pixelmill.llm import prefix_trie
from pixelmill.llm.prefix_trie import reopened
from pixelmill.llm.queries import op13_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def turn_key(r) -> tuple:
    role, text = r[2] or "", r[3] or ""
    return (r[1] is not None, r[1] or 0, role, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest())


def brute_trie(rows, opening=lambda c: zlib.crc32(str(c).encode()) % 9) -> list[tuple]:
    own = {}
    for r in sorted((r for r in rows if r[0] is not None), key=turn_key):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    members, ends = {}, {}
    for c, turns in own.items():
        h = opening(c)
        base = c - (c % 5 if c >= 0 else -(-c % 5))  # the remainder has the sign of c, as in SQL
        built = tuple(own.get(base, [])[:h] + turns[h:])
        ends.setdefault(built, []).append(c)
        for d in range(len(built) + 1):
            members.setdefault(built[:d], []).append(c)
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for key in members:
        if key:
            children[key[:-1]] += 1
    for key, inside in members.items():
        own_saved = (len(inside) - 1) * len(key[-1][1].encode()) if key else 0
        for d in range(len(key) + 1):
            leaves[key[:d]] += children[key] == 0
            saved[key[:d]] += own_saved
    return [
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest())
        for k, m in members.items()
    ]


def trie_rows(spark, rows, **options) -> list[tuple]:
    conversations = spark.createDataFrame(rows, SCHEMA).withColumns({"node": F.lit(1), "rank": F.lit("x"), "n": F.lit(None).cast("int")})
    trie = prefix_trie.prefix_trie(*reopened(conversations, **options))
    return [tuple(r) for r in trie.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]


def same(got: list[tuple], expected: list[tuple]) -> bool:
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))
    return order(got) == order(expected)


def awkward_rows() -> list[tuple]:
    rng = random.Random(5)
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 12)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "", None, "long " * 20])))
    rows = [r for r in rows if r[0] not in (5, 20)]  # two families without a first conversation
    rows += [(41, None, "user", "first"), (41, 1, "user", "x"), (41, 1, "user", "x"), (41, 1, "assistant", "x"), (41, None, None, None)]
    rows += [(-7, 0, "user", "a"), (-6, 0, "user", "a"), (-5, 0, "user", "a"), (None, 0, "user", "nobody's"), (9_000_000_000, 2, "user", "a"), (9_000_000_000, 1, "user", "b")]
    rows += [(c, t, "user", f"copy {t}") for c in range(100, 140) for t in range(3)]
    rows += [(205, t, "user", f"deep {t % 2}") for t in range(90)] + [(210, t, "user", f"deep {t % 2}") for t in range(70)]
    return rows


@pytest.mark.parametrize(("block", "share"), [(256, 10_000), (4, 10_000), (3, 1)])
def test_trie_matches_brute_force(spark, monkeypatch, block, share):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "HOT_SHARE", share)
    monkeypatch.setattr(prefix_trie, "END_BITS", 3)
    rows = awkward_rows()
    assert same(trie_rows(spark, rows), brute_trie(rows))


def test_openings_of_own_length(spark):
    rows = awkward_rows()
    assert same(trie_rows(spark, rows, opening=F.lit(2)), brute_trie(rows, lambda c: 2))
    alone = [(1, 0, "user", "x")]
    assert same(trie_rows(spark, alone, opening=F.lit(3)), brute_trie(alone, lambda c: 3))  # left without turns
    assert trie_rows(spark, []) == []


def test_hot_pointers_are_broadcast(spark):
    edges = spark.createDataFrame([(i, i % 2 if i < 3000 else i) for i in range(4000)], "node long, ptr long")
    found = spark.createDataFrame([(i, i * 10) for i in range(4000)], "node long, v long")
    got = prefix_trie.look_up(edges, found, {"v": "w"}).collect()
    assert len(got) == 4000 and all(r.w == r.ptr * 10 for r in got)


def test_query_on_tables(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        assert same([tuple(r) for r in op13_prefix_trie(spark, sf).collect()], brute_trie(rows))
