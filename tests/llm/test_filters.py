from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.llm import mixing, quality_cnn, quality_rules, sharding
from pixelmill.llm import queries as registered
from tests.llm.fixtures import awkward, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def brute_measures(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    repeated = {k + d for k in range(len(w) - 2) if grams[w[k], w[k + 1], w[k + 2]] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_rule_measures_match_brute_force(spark):
    rows = awkward() + [(200, "a b c a b c"), (201, "# x\n# x\n \n# x"), (202, "a a a a"), (203, "\x1c\x85 b  c")]
    entries = quality_rules.ledger(documents(spark, rows)).cache()
    got = sorted(map(str, ((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in entries.collect())))
    assert got == sorted(str((i, *brute_measures(t))) for i, t in rows)
    assert quality_rules.ledger(documents(spark, rows).limit(0)).count() == 0
    for policy, heeded in quality_rules.POLICIES.items():
        kept = quality_rules.apply_policy(entries, policy)
        assert kept.where("kept").count() == sum((r.fail_mask & heeded) == 0 for r in entries.collect())
        for r in quality_rules.ablations(entries, policy).collect():
            bit = next(x.bit for x in quality_rules.RULES if x.name == r.rule)
            masks = [x.fail_mask & heeded for x in entries.collect()]
            assert r.n_failed == sum(m >> bit & 1 for m in masks)
            assert r.n_failed_alone == sum(m == 1 << bit for m in masks)
            assert r.n_kept_without == sum(m & ~(1 << bit) == 0 for m in masks)


def test_base_rule_columns(spark):
    for r in registered.op3_quality_rules(spark, SF).collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_differencing_is_tight():
    rng = random.Random(3)
    for k in (2, 3, 7):
        sizes = [rng.randint(1, 1000) for _ in range(200)]
        bins = [0] * k
        for size, shard in zip(sizes, sharding.differencing(sizes, k), strict=True):
            bins[shard] += size
        assert max(bins) - min(bins) <= 2
    assert sharding.differencing([8, 7, 6, 5, 4], 2).count(0) in (2, 3)
    assert sharding.differencing([], 4) == [] and len(set(sharding.differencing([5, 5, 5], 3))) == 3


def test_differencing_matches_plain_lists():
    """Partial partitions as lists of bins, the two of largest spread joined in opposite order."""
    rng = random.Random(9)
    for k in (2, 3, 5):
        sizes = [rng.randint(1, 10**9) for _ in range(60)]
        parts = [[(s, [i])] + [(0, [])] * (k - 1) for i, s in enumerate(sizes)]
        while len(parts) > 1:
            parts.sort(key=lambda p: p[-1][0] - p[0][0])
            a, b = parts.pop(0), parts.pop(0)
            parts.append(sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)), key=lambda x: -x[0]))
        bins = [0] * k
        for size, shard in zip(sizes, sharding.differencing(sizes, k), strict=True):
            bins[shard] += size
        assert sorted(bins) == sorted(x[0] for x in parts[0])


def test_shards(spark):
    rows = awkward()
    got = sharding.shard_by_bytes(documents(spark, rows), shards=4, bundles=64, heavy=8, cell_rows=5).collect()
    assert len(got) == len(rows) and all(r.law == "bytes" and r.grown_shard is None for r in got)
    shard_of = {}
    for r in got:
        assert shard_of.setdefault((r.size, r.text_crc32), r.shard) == r.shard
    for shard in range(4):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert sorted(r.size for r in got) == sorted(len((t or "").encode()) + 16 for _, t in rows)
    assert sharding.shard_by_bytes(documents(spark, rows).limit(0), shards=4).count() == 0


def test_shards_of_sf_are_even(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sums = [r[0] for r in sharding.shard_by_bytes(docs).groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(sums) == 40 and max(sums) - min(sums) <= 64


def test_raking_meets_marginals_and_bounds():
    rng = np.random.default_rng(1)
    available = rng.integers(50, 1000, (5, 4, 3)).astype(float)
    shares = [np.array([0.1, 0.2, 0.3, 0.2, 0.2]), np.full(4, 0.25), np.array([0.5, 0.3, 0.2])]
    total = 0.3 * available.sum()
    fitted, miss = mixing.rake(available, shares, total)
    assert (fitted <= available + 1e-6).all() and miss < 1e-6
    for axis, share in enumerate(shares):
        others = tuple(i for i in range(3) if i != axis)
        assert fitted.sum(axis=others) == pytest.approx(share * total, rel=1e-4)
    halves = [np.array([0.5, 0.5]), np.array([0.5, 0.5])]
    bound, miss = mixing.rake(np.array([[10.0, 10.0], [100.0, 100.0]]), halves, 100.0)
    assert bound[0] == pytest.approx([10, 10]) and miss > 0.2
    best, miss = mixing.largest_mixture(np.array([[10.0, 10.0], [100.0, 100.0]]), halves, 200.0)
    assert best.sum() == pytest.approx(40, rel=2e-3) and miss <= 1e-3
    impossible = [np.array([0.5, 0.5]), np.array([0.2, 0.8])]
    assert mixing.largest_mixture(np.diag([50.0, 50.0]), impossible, 100.0)[1] > 0.01
    assert mixing.rake(np.zeros((2, 2)), halves, 0.0)[0].sum() == 0


def test_raking_matches_plain_loops():
    """The same fitting one value and one cell at a time, each factor found by bisection."""
    rng = np.random.default_rng(2)
    available = rng.integers(0, 400, (3, 3, 2)).astype(float)
    available[0, 1] = 0
    shares = [np.array([0.2, 0.5, 0.3]), np.array([0.4, 0.3, 0.3]), np.array([0.6, 0.4])]
    total = 0.4 * available.sum()
    factors = [np.ones(len(s)) for s in shares]

    def cell(at):
        return min(available[at], available[at] * np.prod([f[i] for f, i in zip(factors, at, strict=True)]))

    places = list(np.ndindex(*available.shape))
    for _ in range(60):
        for axis, share in enumerate(shares):
            for i, s in enumerate(share):
                low, high = 1e-6, 1e6
                for _ in range(60):
                    factors[axis][i] = middle = (low * high) ** 0.5
                    low, high = (middle, high) if sum(cell(at) for at in places if at[axis] == i) < s * total else (low, middle)
    fitted, miss = mixing.rake(available, shares, total)
    assert miss < 1e-6
    for at in places:
        assert fitted[at] == pytest.approx(cell(at), abs=0.01 * total / len(places))


def test_mixture_meets_its_shares(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = mixing.planned(docs)
    rows = plan.rows.collect()
    assert len(rows) == 1000 and plan.miss <= 1e-3
    for r in rows:
        assert r.mix_tokens == len(WORD.findall(r.row.text or ""))
        assert r.mix_source == r.row.source and r.mix_lang == r.row.lang
        assert 0 <= r.probability <= 1
    expected = sum(r.mix_tokens * r.probability for r in rows)
    assert expected == pytest.approx(plan.total, rel=1e-6)
    for entry in plan.report:
        got = sum(r.mix_tokens * r.probability for r in rows if r[f"mix_{entry['dimension']}"] == entry["value"]) / expected
        assert got == pytest.approx(entry["attained"], abs=1e-9) and got == pytest.approx(entry["wanted"], abs=2e-3)
    assert sum(e["wanted"] for e in plan.report if e["value"] == "en") == pytest.approx(0.55, abs=1e-9)
    hashes = spark.createDataFrame([(r.row.doc_id,) for r in rows], "doc_id long").select("doc_id", F.xxhash64(F.lit(7), "doc_id").alias("h")).collect()
    uniform = {h.doc_id: ((h.h % 2**64) >> 11) * 2.0**-53 for h in hashes}
    assert all(r.sampled == (uniform[r.row.doc_id] < r.probability) for r in rows)
    assert sum(r.mix_tokens for r in rows if r.sampled) == pytest.approx(expected, rel=0.2)
    again = mixing.mixture(docs).where("sampled").select("row.doc_id").collect()
    assert {r.doc_id for r in again} == {r.row.doc_id for r in rows if r.sampled}


def test_forms_are_the_nearest_centres(spark):
    """Word counts, byte classes and forms against plain Python."""
    docs = documents(spark, [(i, t) for i, t in awkward() if i is not None])
    rows = mixing.work_table(mixing.measured(docs, "text", ["doc_id", "text"]), "measured")
    forms = mixing.learned_forms(rows, k=3)
    assert 1 < len(forms.centres) <= 3
    for r in rows.select("row", "mix_tokens", "classes", forms.column(F.col("classes")).alias("form")).collect():
        raw = (r.row.text or "").encode()
        listed = b"".join(mixing.CLASSES)
        counts = [sum(b in c for b in raw) for c in mixing.CLASSES] + [sum(b not in listed for b in raw)]
        assert r.classes == counts and r.mix_tokens == len(WORD.findall(r.row.text or ""))
        z = (np.log((np.array(counts) + 0.5) / (sum(counts) + 0.5 * len(counts))) - forms.mean) / forms.scale
        away = ((forms.centres - z) ** 2).sum(axis=1)
        assert away[int(r.form[4:])] == pytest.approx(away.min())


def many_texts(spark):
    """More short texts than any sample held: words, and a few of digits, of signs and of blanks alone."""
    rng = random.Random(5)
    rows = []
    for i in range(6000):
        kind = i % 300
        letters = "0123456789.," if kind in (7, 8, 9) else "|#*=<>{}[]@" if kind == 17 else "ABCDE\n" if kind == 27 else "abcdefghij,-"
        text = " " * (i % 5) if kind == 37 else " ".join("".join(rng.choices(letters, k=rng.randint(1, 8))) for _ in range(rng.randint(3, 12)))
        rows.append((i, text, f"src{i % 3}", ("en", "en", "de", "fr", "es")[i % 5]))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


def brute_forms(docs, k=mixing.FORMS):
    """Mean, scale, centres and the nearest centre of every row, by k-means over all rows in numpy."""
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    listed = b"".join(mixing.CLASSES)
    counts = np.array([[sum(b in c for b in t) for c in mixing.CLASSES] + [sum(b not in listed for b in t)] for t in texts.values()], float)
    logs = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * mixing.N_CLASSES))
    mean, scale = logs.mean(axis=0), logs.std(axis=0)
    x = (logs - mean) / scale
    centres = x[[np.argmin((x**2).sum(axis=1))]]
    while len(centres) < k:
        centres = np.vstack([centres, x[((x[:, None] - centres) ** 2).sum(axis=2).min(axis=1).argmax()]])
    while True:
        nearest = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([x[nearest == i].mean(axis=0) if (nearest == i).any() else c for i, c in enumerate(centres)])
        if np.allclose(moved, centres):
            return mean, scale, centres, {i: f"form{f}" for i, f in zip(texts, nearest, strict=True)}
        centres = moved


def test_forms_are_learned_from_all_rows(spark, tmp_path):
    """Centres and the forms of op2_mixing against k-means over every row, whatever the ids and the parts are."""
    docs = many_texts(spark)
    mean, scale, centres, named = brute_forms(docs)
    rows = mixing.work_table(mixing.measured(docs, "text", ["doc_id"]), "measured")
    forms = mixing.learned_forms(rows)
    assert forms.mean == pytest.approx(mean, abs=1e-6) and forms.scale == pytest.approx(scale, abs=1e-6)
    assert forms.centres == pytest.approx(centres, abs=1e-4)
    dealt = mixing.learned_forms(mixing.measured(docs.withColumn("doc_id", -F.col("doc_id")).orderBy("text").repartition(7), "text", ["doc_id"]))
    assert (dealt.centres == forms.centres).all() and (dealt.scale == forms.scale).all()
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = registered.queries()["op2_mixing"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.mix_topic for r in got} == named
    with pytest.warns(UserWarning, match="still moved"):
        mixing.learned_forms(rows, rounds=1)


def test_mixture_by_a_given_topic(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), f"src{i % 2}", "en", f"t{i % 3}") for i in range(120)], "doc_id long, text string, source string, lang string, theme string")
    plan = mixing.planned(docs, topics="theme")
    assert {e["value"] for e in plan.report if e["dimension"] == "topic"} == {"t0", "t1", "t2", mixing.OTHER} and plan.miss <= 1e-3


def test_mixture_of_awkward_rows(spark):
    docs = documents(spark, awkward())
    assert mixing.sampled_documents(docs).columns == docs.columns
    rows = mixing.mixture(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.probability <= 1 for r in rows)
    assert mixing.sampled_documents(docs.limit(0)).count() == 0
    assert mixing.sampled_documents(docs, keep_share=0.0).count() == 0
    unnamed = documents(spark, [(None, f"text {i}") for i in range(200)])
    drawn = mixing.mixture(unnamed).collect()
    assert 0 < sum(r.sampled for r in drawn) < 200  # rows without id are not drawn as one


def naive_features(text, network):
    room = quality_cnn.padded(text.encode())
    n = len(room) - quality_cnn.TAIL
    out = np.full((len(room), quality_cnn.FILTERS), -np.inf)
    for t in range(n):
        out[t] = network.bias + sum(network.embedding[room[t + w]] @ network.filters[w] for w in range(quality_cnn.WIDTH))
    blocks = np.maximum(out.reshape(-1, quality_cnn.BLOCK, quality_cnn.FILTERS).max(axis=1), 0)
    chunks = blocks if len(blocks) == 1 else np.maximum(blocks[1:], blocks[:-1])
    return np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)])


def test_table_convolution_equals_the_naive_one(monkeypatch):
    monkeypatch.setattr(quality_cnn, "PIECE", 2)
    network = quality_cnn.fit([], [])
    texts = ["", "short", "x" * 123, "x" * 124, "Hello wörld. " * 40, "abc " * 31 + "zz", "q" * 700]
    got = quality_cnn.pooled([t.encode() for t in texts], network.tables())
    for row, text in zip(got, texts, strict=True):
        assert row == pytest.approx(naive_features(text, network), rel=1e-3, abs=1e-4)


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(4)
    p = quality_cnn.start(3)
    p["out"] = rng.normal(0, 0.5, p["out"].shape)
    p["bias"] = rng.normal(0, 0.3, p["bias"].shape)
    texts = [quality_cnn.blocks_of(t.encode()) for t in ("", "short", "Hello wörld, this is a text. " * 14, "".join(map(chr, rng.integers(32, 127, 900))))]
    y = np.array([0.0, 1.0, 1.0, 0.0])
    _, g = quality_cnn.gradients(p, texts, y, dtype=np.float64)
    for k, v in p.items():
        largest = np.argsort(-np.abs(g[k]).ravel())[:12]
        for at in [*largest, *rng.integers(0, v.size, 5)]:
            flat, eps = v.reshape(-1), 1e-6
            was = flat[at]
            flat[at] = was + eps
            up = quality_cnn.gradients(p, texts, y, dtype=np.float64)[0]
            flat[at] = was - eps
            down = quality_cnn.gradients(p, texts, y, dtype=np.float64)[0]
            flat[at] = was
            assert (up - down) / (2 * eps) == pytest.approx(g[k].ravel()[at], abs=1e-6, rel=1e-4), k


def test_training_is_bounded_and_takes_whole_texts(spark, monkeypatch):
    """Repeated ids train once, by their smallest text; rows beyond the bound of bytes are passed over."""
    seen = {}
    monkeypatch.setattr(quality_cnn, "fit", lambda texts, labels, **_: seen.update(zip(texts, labels, strict=True)))
    docs = documents(spark, [(40, "b" * 5000), (40, "a" * 3000), (41, None), (46, "c" * 9000), (None, "x")])
    labels = spark.createDataFrame([(40, 1), (40, 0), (41, 1), (46, 0), (None, 1)], "doc_id long, quality int")
    quality_cnn.train(docs, labels)
    usable = {i for i in (40, 41, 46) if zlib.crc32(str(i).encode()) % 4 != 2}
    whole = {40: (b"a" * 3000, 0), 41: (b"", 1), 46: (b"c" * 9000, 0)}
    assert seen == dict(whole[i] for i in usable)
    seen.clear()
    quality_cnn.train(docs, labels, most_bytes=4000)
    assert seen == dict(whole[i] for i in usable - {46})


def test_classifier_on_held_out_rows(spark):
    rows = registered.op4_quality_classifier(spark, "/root/testdata/sf0.1").where("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    judged = rows.join(labels, "doc_id").select("score", "quality", "predicted").toPandas()
    rank = judged.score.rank()
    good = judged.quality == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.97
    assert (judged.predicted == judged.quality).mean() > 0.93


def test_classifier_of_awkward_rows(spark):
    docs = documents(spark, awkward())
    labels = spark.createDataFrame([(40, 1, 0), (41, 0, 0), (42, None, 0), (None, 1, 0), (43, 1, None)], "doc_id long, quality int, toxic int")
    network = quality_cnn.train(docs, labels, epochs=2)
    rows = quality_cnn.score(docs, network).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert quality_cnn.score(docs.limit(0), network).count() == 0
    assert quality_cnn.drop_rejected(docs, labels, epochs=1).columns == docs.columns
    assert quality_cnn.train(docs, labels.limit(0)).out.sum() == 0
