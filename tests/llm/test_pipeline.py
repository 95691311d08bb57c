"""Each stage of the pipeline against a brute-force version of it, and odd rows through all of them."""

import random
import re

import pytest

import corpus_pipeline as P
from jobdelta.llm import language, toxicity
from test_dedup import brute_near

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def stage(name):
    return dict(P.STAGES)[name]


def test_names_and_columns(spark, docs):
    assert [n for n, _ in P.STAGES] == ["toxicity", "language", "exact_dedup", "near_dedup", "packing"]
    for _, f in P.STAGES[:-1]:
        assert f(spark, docs, SF).schema.simpleString() == docs.schema.simpleString()


def test_toxicity_stage(spark, docs):
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    kept = {r.doc_id for r in stage("toxicity")(spark, docs, SF).collect()}
    assert kept == {d for d, s in scores.items() if s < 0.5} and len(kept) < len(scores)


def test_language_stage(spark, docs):
    noise = "".join(random.Random(1).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(500))
    odd = docs.limit(1).selectExpr("-1L as doc_id", "'12 34' as text", "lang", "source", "n_chars")
    odd = odd.union(docs.limit(1).selectExpr("-2L as doc_id", f"'{noise}' as text", "cast(null as string) as lang", "source", "n_chars"))
    found = {r.doc_id: r for r in language.identify(docs.union(odd)).collect()}
    kept = {r.doc_id for r in stage("language")(spark, docs.union(odd), SF).collect()}
    assert kept == {d for d, r in found.items() if r.lang_pred != "und" and not r.foreign}
    assert not kept & {-1, -2} and len(kept) >= 0.99 * docs.count()


def test_exact_stage(spark, docs):
    best = {}
    for r in docs.collect():
        k = re.sub(r"[\x20\x09-\x0D]", "", r.text)
        best[k] = min(best.get(k, (1, 0)), (-len(r.text), r.doc_id))
    assert sorted(r.doc_id for r in stage("exact_dedup")(spark, docs, SF).collect()) == sorted(d for _, d in best.values())


def test_near_stage(spark, docs):
    want = brute_near([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id for r in stage("near_dedup")(spark, docs, SF).collect()} == {d for d, c in want.items() if d == c}


def test_run_packs_what_the_stages_keep(spark, docs):
    left = docs
    for _, f in P.STAGES[:-1]:
        left = spark.createDataFrame(f(spark, left, SF).collect(), docs.schema)
    packed = P.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in left.collect()}
    fill = {}
    for r in sorted(packed, key=lambda r: r.offset):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 1


def test_odd_rows_pass_every_stage(spark, docs):
    extra = "doc_id long, text string, lang string, source string, n_chars long, found string, kept boolean, row string, rest string"
    rows = [(None, None, None, None, None, None, None, None, None), (1, "", "en", "s", 0, "f", True, "r", "x"), (2, "a plain text of the corpus", None, None, None, None, None, None, None),
            (2, "a plain text of the corpus", None, None, None, None, None, None, None), (3, "word " * 50_000, "en", "s", 1, "f", False, "r", "x")]
    for data in (rows, []):
        df = spark.createDataFrame(data, extra)
        for name, f in P.STAGES[:-1]:
            out = f(spark, df, SF)
            assert out.columns == df.columns, name
            assert out.count() <= len(data)
        assert stage("packing")(spark, df, SF).select("doc_id").distinct().count() == len({r[0] for r in data})
    assert stage("exact_dedup")(spark, spark.createDataFrame(rows, extra), SF).count() == 3
