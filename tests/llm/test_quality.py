"""Document quality: contract, edge cases, held-out accuracy, and the network's derivative."""

import zlib

import numpy as np
import pytest

from jobdelta.llm import quality, queries

LARGER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, found string, score double, y int, id int, shard int, bag string"


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", "f", 0.5, 1, 2, 3, "b") for d, t in rows], SCHEMA)


def features(texts):
    """Features of the passages of each text, all texts in one call."""
    raw = [t.encode() for t in texts]
    ends = np.cumsum([0] + [len(r) for r in raw])
    out = [[] for _ in texts]
    for doc, _, f in quality.passages(np.frombuffer(b"".join(raw), np.uint8), ends):
        for d, x in zip(doc.tolist(), f):
            out[d].append(x)
    return out


def test_query(spark):
    out = {r.doc_id: r for r in queries.QUERIES["op13_quality"](spark, LARGER).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    assert set(out) == set(texts)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in out.items())
    held = [(r.quality, out[r.doc_id].predicted) for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect() if out[r.doc_id].held_out]
    assert sum(p for y, p in held if y == 1) >= 0.98 * sum(y for y, _ in held)
    assert sum(1 - p for y, p in held if y == 0) >= 0.8 * sum(1 - y for y, _ in held)
    # The same texts score alike.
    same = {}
    assert all(same.setdefault(texts[d] or "", r.score) == r.score for d, r in out.items())


def test_cases(spark):
    good, bad = "the weather is fine and the road is long ", "BUY## NOW## WIN$$ CASH## "
    rows = [(n, (bad if n % 3 == 0 else good) * (1 + n % 7) + f"note{n}") for n in range(400)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, good * 40_000), (1004, bad), (1004, bad), (None, good), (1005, "x" * 300_000), (1006, "é 日本")]
    labels = spark.createDataFrame([(n, int(n % 3 != 0), 0) for n in range(400)] + [(None, 1, 1), (3, None, 1), (4, 1, 0), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)
    out = {}
    for r in quality.score_quality(docs, labels).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert sum(len(v) for v in out.values()) == len(rows)
    assert out[1000][0].score == out[1001][0].score == out[1002][0].score and out[1000][0].focus_start is None and out[1000][0].passages == 0
    assert out[1003][0].predicted == out[None][0].predicted == 1 and out[1003][0].passages == 40_000 * 9 // 48
    assert [r.predicted for r in out[1004]] == [0, 0] and out[1004][0].score == out[1004][1].score
    held = [n for n in range(400) if zlib.crc32(str(n).encode()) % 5 == 0]
    assert sum(out[n][0].predicted == (n % 3 != 0) for n in held) >= 0.97 * len(held)
    again = quality.score_quality(docs.withColumns({"lang": docs["source"], "source": docs["text"]}).repartition(3), labels).collect()
    assert sorted((str(r.doc_id), r.score) for r in again) == sorted((str(d), r.score) for d, v in out.items() for r in v)


def test_one_bad_passage_has_the_attention(spark):
    """A label speaks for the whole document; the passage that decides it is found."""
    good, bad = "the weather is fine and the road is long today my friend and so on again ", "BUY## NOW## WIN$$ CASH## CLICK!! HERE## FREE$$ "
    rows = [(n, good * 9 + (bad * 7 if n % 2 else good * 4) + good * 9 + f"note{n}") for n in range(500)]
    labels = spark.createDataFrame([(n, 1 - n % 2, 0) for n in range(500)], "doc_id long, quality int, toxic int")
    out = quality.score_quality(documents(spark, rows), labels).filter("held_out").collect()
    assert sum(r.predicted == 1 - r.doc_id % 2 for r in out) >= 0.97 * len(out)
    texts = dict(rows)
    odd = [r for r in out if r.doc_id % 2]
    assert sum("##" in texts[r.doc_id][r.focus_start : r.focus_start + 300] and r.focus_weight > 0.3 for r in odd) >= 0.9 * len(odd)


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = documents(spark, [(1, "a"), (2, None)])
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(n, 1) for n in range(9)], "doc_id long, quality int")
    assert len({r.score for r in quality.score_quality(docs, one).collect()}) == 1
    assert quality.score_quality(documents(spark, []).limit(0), none).count() == 0


def test_features_depend_on_the_text_alone(monkeypatch):
    texts = ["", "  lead and trail  ", "one", "ALL of the words " * 50, "\n", "x" * 500 + " y", "ends here", "  starts late", "é" * 60]
    alone = [features([t])[0] for t in texts]
    for other in (texts, texts[::-1]):
        for t, f in zip(other, features(other)):
            assert np.array_equal(f, alone[texts.index(t)])
    monkeypatch.setattr(quality, "_PIECE", 7)
    monkeypatch.setattr(quality, "_SLICE", 96)
    for f, g in zip(features(texts), alone):
        assert np.array_equal(f, g)
    assert len(alone[3]) == -(-200 // 48) and not alone[0] and not alone[4]


def test_derivative():
    rng = np.random.default_rng(3)
    w = {k: v + rng.normal(0, 0.1, v.shape) for k, v in quality.start_weights(0.7).items()}
    x, doc = rng.integers(0, 60, (9, quality.WIDTH)).astype(np.uint8), np.array([0, 0, 0, 1, 2, 2, 2, 2, 3])
    y, weight = np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 0.5, 1])
    _, d = quality.gradient(w, x, doc, y, weight)
    for k in w:
        for i in [tuple(rng.integers(0, n) for n in w[k].shape) for _ in range(5)]:
            step = {}
            for e in (1e-5, -1e-5):
                v = {a: b.copy() for a, b in w.items()}
                v[k][i] += e
                step[e] = quality.gradient(v, x, doc, y, weight)[0]
            assert d[k][i] == pytest.approx((step[1e-5] - step[-1e-5]) / 2e-5, abs=1e-7, rel=1e-4)


def test_attention_is_a_weighted_mean():
    w = quality.start_weights(0.5)
    h = np.random.default_rng(1).normal(0, 1, (6, quality.HIDDEN))
    doc = np.array([0, 0, 2, 2, 2, 2])
    p, weight, z, _, _ = quality.bags(w, h, doc, 3)
    assert np.bincount(doc, weights=weight).tolist() == pytest.approx([1, 0, 1])
    assert z[0] == pytest.approx(weight[0] * h[0] + weight[1] * h[1]) and p[1] == pytest.approx(0.5)
