"""Token counts, encoding, decoding and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from jobdelta.llm import bpe, packing, queries, token_counts
from jobdelta.llm.pretokens import UnitCache, find, units

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  a", "a  ", "<|endoftext|>", "x  <|endoftext|>  y", "a" * 5000, "ab " * 4000, " \n x", "it's  we'll\t\n\nok", "é中\U0001f600 ՘ \x1c1٣²", "a\nb\r\n c"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def documents(spark, texts, ids=None):
    """With further columns whose names the operators also use."""
    rows = [(i if ids is None else ids[i], t, "x", 1, "k", b"z", True) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, length int, key string, sequence_id binary, kept boolean")


def random_texts(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice("ab  \n\tc'sré1٣²ệ<|endoftext|>中\U0001f600 zq") for _ in range(rng.randint(1, 50))) for _ in range(n)]


def test_units_meet_the_pretokens_again():
    for t in random_texts(300):
        head, rest = units(t)
        assert [p for u in (head, *[" " + r for r in rest]) for p in find(u)] == find(t)


def test_a_full_cache_starts_anew():
    cache = UnitCache(lambda us: [len(u) for u in us], limit=3)
    for _ in range(3):
        assert [h + sum(r) for h, r in cache.values(["one two three four five", "six"])] == [23, 3]


def test_long_pretokens_are_not_kept(library):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefghij") for _ in range(20_000)) + " tail" for _ in range(5)]
    counter, encoder = token_counts.Counter(PATH), bpe.Encoder(PATH)
    want = [library(t) for t in texts]
    for _ in range(2):
        assert counter.counts(texts) == [len(w) for w in want]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.ids(texts)] == want
    for made in (counter.made, encoder.made):
        assert b" tail" in made and max(map(len, made)) <= counter.cache.longest


def test_a_full_cache_keeps_what_is_asked_for():
    asked = []
    cache = UnitCache(lambda us: asked.extend(us) or [len(u) for u in us], limit=8)
    for n in range(30):
        cache.values([f"x the {n}"])
    assert asked.count(" the") == 1 and len(cache.kept) <= cache.limit + 2


def test_pretokens_step_together(library):
    e = bpe.Encoder(PATH)
    rng = random.Random(4)
    made = ["".join(rng.choice(["ofre", "ñar", "st", "s", "th", "ha", "hé", "e"]) for _ in range(rng.randint(1, 6))) for _ in range(3000)]
    made += ["ab" * 3000, "s" * 777]
    ps = [b"", *[m.encode() for m in made]]
    out = [np.frombuffer(x, "<u4").tolist() for x in e.pretokens(ps)]
    assert out == [[], *[library(m) for m in made]] == [e.pretoken(p) for p in ps]
    assert e.pretokens([]) == [] and e.pretokens([b""]) == [b""]


def test_counts_encoding_and_decoding(spark, library):
    texts = ODD + random_texts(200)
    docs = documents(spark, texts)
    want = [library(t) for t in texts]
    counted = {r.doc_id: r for r in token_counts.count_tokens(docs, PATH).collect()}
    decoded = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    for n, t in enumerate(texts):
        assert counted[n].n_tokens == len(want[n]) and counted[n].n_bytes == len((t or "").encode())
        assert np.frombuffer(decoded[n].ids, "<u4").tolist() == want[n]
        assert decoded[n].text == (t or "")


def test_decoding_bytes_that_are_no_text(spark):
    df = spark.createDataFrame([(1, np.asarray([164, 100], "<u4").tobytes()), (2, None), (3, b"")], "doc_id long, ids binary")
    out = {r.doc_id: r.text for r in bpe.decode(df, PATH).collect()}
    library = Tokenizer.from_file(PATH)
    assert out == {1: library.decode([164, 100], skip_special_tokens=False), 2: "", 3: ""}


def test_borders_agree_with_merging_from_scratch():
    e = bpe.Encoder(PATH)
    library = Tokenizer.from_file(PATH)
    rng = random.Random(1)
    tokens = [n for n, t in e.vocabulary.tokens.items() if t.isalpha() and t.isascii()]
    for _ in range(400):
        a, b = rng.choice(tokens), rng.choice(tokens)
        text = (e.vocabulary.tokens[a] + e.vocabulary.tokens[b]).decode()
        assert e.compatible(a, b) == (library.encode(text, add_special_tokens=False).ids == [a, b])


def test_empty_tables(spark):
    docs = documents(spark, []).limit(0)
    assert token_counts.over_limit(token_counts.count_tokens(docs, PATH)).count() == 0
    assert bpe.decode(bpe.encode(docs, PATH), PATH).count() == 0
    pieces = packing.cut_documents(docs, PATH)
    assert packing.place(pieces.drop("ids")).count() == 0


def test_queries_on_the_whole_table(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    counts = {r.doc_id: r for r in queries.QUERIES["op10_token_counts"](spark, SF).collect()}
    codes = {r.doc_id: r for r in queries.QUERIES["op2_bpe"](spark, SF).collect()}
    assert set(counts) == set(codes) == set(docs)
    for d, t in docs.items():
        ids = library(t)
        assert (counts[d].n_tokens, counts[d].over_limit) == (len(ids), len(ids) > 512)
        assert codes[d].n_tokens == len(ids)
        assert codes[d].ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert codes[d].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def check_packing(rows, texts, library, capacity=2048):
    """Every token of every document once, sequences without gap or overlap."""
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for d, t in texts.items():
        ids = [*library(t), 0]
        own = sorted(by_doc[d], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert all(r.length == capacity for r in own[1:]) and own[0].length <= capacity
        assert (len(own) == 1) == (len(ids) <= capacity)
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(sequences), -(-sum(r.length for r in rows) // capacity)


def test_packing_query(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    used, floor = check_packing(queries.QUERIES["op1_packing"](spark, SF).collect(), docs, library)
    assert used <= floor + 1


def test_packing_of_odd_texts(spark, library):
    from pyspark.sql import functions as F

    from jobdelta.llm.common import written

    pieces = written(packing.cut_documents(documents(spark, ODD), PATH).withColumn("ids_crc32", F.crc32("ids")), "test-pieces")
    placed = packing.place(pieces)
    check_packing(placed.collect(), dict(enumerate(ODD)), library)
    # The sequences themselves, put together from pieces that kept their ids.
    whole = {r.sequence_id: r for r in packing.sequences(placed).collect()}
    for r in placed.collect():
        assert bytes(whole[r.sequence_id].ids)[4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)


def test_packing_keeps_repeated_rows_and_missing_ids(spark):
    docs = documents(spark, ["same text", "same text", None, None], ids=[7, 7, None, None])
    from jobdelta.llm.common import written

    rows = packing.place(written(packing.cut_documents(docs, PATH).drop("ids"), "test-pieces")).collect()
    assert sorted((r.doc_id is None, r.length) for r in rows) == [(False, 3), (False, 3), (True, 1), (True, 1)]
    assert len({(r.sequence_id, r.offset) for r in rows}) == 4


def test_genetic_steps_keep_every_document():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 100, 400)
    pop = packing.first_population(sizes, 100, 6, rng)
    child = packing.crossover(sizes, pop[0], pop[1], 100, rng)
    for bins in (*pop, child, packing.mutate(sizes, child, 100, rng)):
        fill = np.bincount(bins, weights=sizes)
        assert (bins >= 0).all() and (fill > 0).all() and fill.max() <= 100
    best = packing.evolve(sizes, pop, 100, 10, rng)
    assert packing.fitness(sizes, best[0], 100) >= max(packing.fitness(sizes, p, 100) for p in pop)


@pytest.mark.parametrize("low,high", [(300, 1100), (500, 760), (100, 900)])
def test_genetic_search_beats_best_fit(low, high):
    """Lengths that best fit leaves bins half used by; the settings are those of one island."""
    rng = np.random.default_rng(5)
    sizes = rng.integers(low, high, packing.BLOCK).astype(np.int64)
    best_fit = packing.best_fit(sizes, np.full(len(sizes), -1), np.arange(len(sizes)), packing.CAPACITY).max() + 1
    floor = -(-int(sizes.sum()) // packing.CAPACITY)
    found = packing.evolve(sizes, packing.first_population(sizes, packing.CAPACITY, packing.POPULATION, rng), packing.CAPACITY, packing.EPOCHS * packing.GENERATIONS, rng)[0]
    assert np.bincount(found, weights=sizes).max() <= packing.CAPACITY and (found >= 0).all()
    assert found.max() + 1 < best_fit or best_fit == floor


def test_exchange_loses_no_document():
    rng = np.random.default_rng(8)
    for _ in range(30):
        sizes = rng.integers(1, 60, 80).astype(np.int64)
        bins = packing.best_fit(sizes, np.full(80, -1), np.arange(80), 100)
        bins = np.where(np.isin(bins, rng.choice(bins.max() + 1, 4, replace=False)), -1, bins)
        after = packing.exchange(sizes, bins, np.flatnonzero(bins < 0), 100)
        fill = lambda b: np.bincount(b[b >= 0], weights=sizes[b >= 0], minlength=80)
        assert (fill(after) <= 100).all() and (fill(after) >= fill(bins)).all() and (after >= 0).sum() + (after < 0).sum() == 80


def test_packing_blocks_share_their_last_sequences(spark):
    """Two pieces fill a sequence, never well: blocks of an odd number of pieces must not each keep a half-empty one."""
    sizes = [900 + n % 100 for n in range(3000)]
    pieces = spark.createDataFrame(list(enumerate(sizes)), "key long, length long")
    rows = packing.pack(pieces, block=200).collect()
    assert sorted(r.key for r in rows) == list(range(len(sizes)))
    assert len({r.sequence_id for r in rows}) == len(sizes) // 2


def test_packing_in_many_blocks(spark):
    rng = np.random.default_rng(0)
    sizes = [int(x) for x in rng.integers(1, 2048, 3000)] + [2048] * 5
    pieces = spark.createDataFrame(list(enumerate(sizes)), "key long, length long")
    rows = packing.pack(pieces, block=200).collect()
    assert sorted(r.key for r in rows) == list(range(len(sizes)))
    fill = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + sizes[r.key]
    assert max(fill.values()) <= 2048
    # Nearly as few as best fit over all documents at once, although no task saw more than about 200 of them.
    alone = packing.best_fit(np.asarray(sizes), np.full(len(sizes), -1), np.arange(len(sizes)), 2048)
    assert len(fill) <= 1.01 * (alone.max() + 1) + 2
