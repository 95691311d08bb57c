"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words and their beginnings; those that speak for the label in a bounded sample of labelled rows make
the space. Document frequencies come from all documents. Examples with equal vectors are one entry of the index
with a count per label. The index is inverted, its entries in blocks: a query adds up each block's greatest
possible score, reads blocks from the most promising on, and stops when no other block can hold a nearer entry.
Votes of the nearest entries are weighted by cosine and by how many labelled rows stand for a sampled one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobdelta.llm.common import fold, sized, texts_of, written

FOLDS, HELD_OUT = 5, 0
EXAMPLES = 8192  # labelled rows per label that the classifier is fitted on, at most
TERMS = 1024  # terms of the space, at most
NEIGHBOURS = 24  # distinct vectors that vote
LEAST_SEEN = 3  # toxic examples that hold a term
BLOCK = 64  # index entries in a block
ROWS = 1024  # texts whose neighbours are listed at once
PRIOR_WEIGHT = 1.0  # examples that the share of toxic rows counts for in a vote

_WORD = re.compile(r"[^\W\d_]+")
_BEGINNINGS = (3, 4, 5, 6)


def terms_of(word: str) -> list[str]:
    """A lower-case word, and its beginnings marked with an asterisk."""
    return [word, *(word[:n] + "*" for n in _BEGINNINGS if len(word) > n)]


class Vectors:
    """Term counts of texts, by a memory of what each blank-separated token holds."""

    def __init__(self, terms: list[str], limit: int = 120_000):
        self.number = {t: n for n, t in enumerate(terms)}
        self.stems = {t.rstrip("*")[:3] for t in terms}
        self.limit, self.kept = limit, {}

    def _token(self, token: str) -> tuple[int, ...]:
        if len(self.kept) > self.limit:
            self.kept.clear()
        found = tuple(self.number[t] for w in _WORD.findall(token) if w[:3] in self.stems for t in terms_of(w) if t in self.number)
        self.kept[token] = found
        return found

    def counts(self, text: str) -> dict[int, int]:
        kept = self.kept
        out: dict[int, int] = {}
        for token in text.lower().split():
            found = kept.get(token)
            if found is None:
                found = self._token(token)
            for n in found:
                out[n] = out.get(n, 0) + 1
        return out


class Index:
    """Exact nearest neighbours by cosine among sparse unit vectors, with a block-max inverted index."""

    def __init__(self, entries: list[dict[int, float]], width: int, block: int = BLOCK):
        # Entries with the same heaviest terms stand together, so that few blocks can score high for a query.
        self.order = sorted(range(len(entries)), key=lambda n: (sorted(entries[n].items(), key=lambda x: (-x[1], x[0])), n))
        self.block, self.blocks = block, -(-len(entries) // block)
        lists: list[list[tuple[int, float]]] = [[] for _ in range(width)]
        for place, n in enumerate(self.order):
            for t, w in entries[n].items():
                lists[t].append((place, w))
        self.places = [np.asarray([p for p, _ in x], dtype=np.int32) for x in lists]
        self.weights = [np.asarray([w for _, w in x], dtype=np.float64) for x in lists]
        self.ends = [np.searchsorted(p, np.arange(self.blocks + 1) * block) for p in self.places]
        self.most = []
        for p, w in zip(self.places, self.weights):
            top = np.zeros(self.blocks)
            np.maximum.at(top, p // block, w)
            self.most.append(top)

    def nearest(self, query: dict[int, float], k: int) -> list[tuple[float, int]]:
        """(cosine, entry) of the k nearest with a cosine above 0, nearest first; ties go to the smaller entry."""
        query = {t: w for t, w in query.items() if len(self.places[t])}
        if not query:
            return []
        bound = sum(w * self.most[t] for t, w in query.items())
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or len(best) == k and bound[b] < best[-1][0] - 1e-9:
                break
            scores = np.zeros(self.block)
            for t, w in query.items():
                lo, hi = self.ends[t][b], self.ends[t][b + 1]
                if hi > lo:
                    scores[self.places[t][lo:hi] - b * self.block] += w * self.weights[t][lo:hi]
            floor = best[-1][0] - 1e-9 if len(best) == k else 0.0
            found = np.flatnonzero((scores > 0) & (scores >= floor))
            best = sorted(best + [(round(float(scores[i]), 9), self.order[b * self.block + i]) for i in found.tolist()], key=lambda x: (-x[0], x[1]))[:k]
        return best


@dataclass
class Model:
    """All that scoring needs; its size is bounded by EXAMPLES and TERMS."""

    terms: list[str]
    idf: np.ndarray
    entries: list[dict[int, float]]  # distinct unit vectors of examples
    votes: list[tuple[float, float]]  # per entry: weight of its toxic and of all its examples
    ids: list[int]  # per entry: the smallest doc_id of an example
    prior: float  # share of toxic rows
    blank: float  # the same among rows without any term

    def unit(self, counts: dict[int, int]) -> dict[int, float]:
        raw = {t: (1 + math.log(n)) * self.idf[t] for t, n in counts.items()}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / norm for t, w in raw.items()} if norm else {}


class Scorer:
    def __init__(self, model: Model):
        self.model, self.vectors = model, Vectors(model.terms)
        self.index = Index(model.entries, len(model.terms))
        self.known: dict[tuple, tuple] = {}

    def score(self, text: str) -> tuple[float, list[tuple[int, float, float]], list[str]]:
        """Score, the nearest examples (doc_id, cosine, their toxic share), and the terms found."""
        counts = self.vectors.counts(text)
        if not counts:
            return self.model.blank, [], []
        key = tuple(sorted(counts.items()))
        found = self.known.get(key)
        if found is None:
            if len(self.known) > 20_000:
                self.known.clear()
            found = self.known[key] = self._vote(counts)
        return found

    def _vote(self, counts: dict[int, int]):
        m = self.model
        near = self.index.nearest(m.unit(counts), NEIGHBOURS)
        toxic, total, shown = PRIOR_WEIGHT * m.prior, PRIOR_WEIGHT, []
        for cosine, entry in near:
            yes, all_ = m.votes[entry]
            # Equal examples speak louder than one, but less than their number: they are often copies.
            strength = cosine * cosine * math.sqrt(all_)
            toxic += strength * yes / all_
            total += strength
            shown.append((m.ids[entry], cosine, yes / all_))
        return toxic / total, shown, [m.terms[t] for t in sorted(counts, key=lambda t: (-m.idf[t], t))]


def _sample(labels: DataFrame, examples: int) -> tuple[DataFrame, dict[int, float]]:
    """doc_id, y of at most `examples` rows per label, and how many rows each label has.

    Rows that repeat an id are one row, toxic if any of them is.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).filter(fold("doc_id", FOLDS) != HELD_OUT) \
        .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("y"))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    # By a hash of the id, a little under the bound on average, so that no task has to see all rows of a label.
    part = {y: min(1.0, 0.97 * examples / max(1, n.get(y, 0))) for y in (0, 1)}
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.when(F.col("y") == 1, int(part[1] * (1 << 30))).otherwise(int(part[0] * (1 << 30)))
    picked = [known.filter(drawn & (F.col("y") == y)).limit(examples) for y in (0, 1)]
    return picked[0].union(picked[1]), n


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found: Counter = Counter()
        for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
            words = {w for token in set(text.lower().split()) for w in _WORD.findall(token)}
            found.update((t, y) for t in {t for w in words for t in terms_of(w)})
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([y for _, y in found], pa.int32()), pa.array(list(found.values()), pa.int64())],
                                         names=["term", "y", "n"])


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, terms: int = TERMS) -> Model:
    """Fit on at most `examples` labelled rows per label outside the held-out fold; frequencies are of all documents."""
    texts = texts_of(docs)
    sample, labelled = _sample(labels, examples)
    # At most 2 * examples ids, so the sample may be sent to every executor.
    chosen = texts.join(F.broadcast(sample), texts["doc_id"] == sample["id"]).select("doc_id", "text", "y").dropDuplicates(["doc_id"])
    chosen = written(chosen, "toxicity-sample")
    counts = chosen.mapInArrow(_term_counts, "term string, y int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    rows = chosen.groupBy("y").count().collect()
    n = {0: 0, 1: 0} | {r["y"]: r["count"] for r in rows}
    weight = {y: labelled.get(y, 0) / max(1, n[y]) for y in (0, 1)}  # labelled rows that a sampled one stands for
    prior = (weight[1] * n[1] + 0.5) / (weight[1] * n[1] + weight[0] * n[0] + 1)
    # Terms that speak for the label: seen often enough, mostly in toxic rows, by chi-square.
    expected = (F.col("a") + F.col("b")) * n[1] / max(1, n[0] + n[1])
    share = weight[1] * F.col("a") / (weight[1] * F.col("a") + weight[0] * F.col("b"))
    picked = counts.filter((F.col("a") >= LEAST_SEEN) & (F.col("a") > expected) & (share >= 0.5)).withColumn("chi", (F.col("a") - expected) ** 2 / expected)
    names = [r["term"] for r in picked.orderBy(F.col("chi").desc(), "term").limit(terms).select("term").collect()]
    idf = _idf(texts, names)
    model = Model(names, idf, [], [], [], prior, prior)
    held = chosen.select("doc_id", "y", _counts_column(names)(F.col("text")).alias("counts")).collect()  # at most 2 * examples sparse rows
    entries: dict[tuple, list] = {}
    blank = [prior, 1.0]
    for r in sorted(held, key=lambda r: r["doc_id"]):
        if not r["counts"]:
            blank[0] += weight[r["y"]] * r["y"]
            blank[1] += weight[r["y"]]
            continue
        unit = model.unit(dict(zip(r["counts"][::2], r["counts"][1::2])))
        e = entries.setdefault(tuple(sorted(unit.items())), [0.0, 0.0, r["doc_id"]])
        e[0] += weight[r["y"]] * r["y"]
        e[1] += weight[r["y"]]
    model.entries = [dict(k) for k in entries]
    model.votes = [(e[0], e[1]) for e in entries.values()]
    model.ids = [e[2] for e in entries.values()]
    model.blank = blank[0] / blank[1]
    return model


def _counts_column(names: list[str]):
    """Term numbers and counts, one after the other."""

    def run(texts: pd.Series) -> pd.Series:
        v = Vectors(names)
        return texts.map(lambda t: [x for pair in sorted(v.counts(t).items()) for x in pair])

    return F.pandas_udf(run, "array<int>")


def _idf(texts: DataFrame, names: list[str]) -> np.ndarray:
    """Smoothed inverse document frequencies of the terms over all documents."""

    def run(batches):
        vectors = Vectors(names)
        for big in batches:
            seen = np.zeros(len(names), dtype=np.int64)
            for b in sized(big, "text"):
                for text in b.column("text").to_pylist():
                    for n in vectors.counts(text):
                        seen[n] += 1
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[seen[at], big.num_rows])], names=["term", "n"])

    df = np.zeros(len(names) + 1)
    for r in texts.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row per term
        df[int(r["term"])] = r["n"]
    return np.log((df[-1] + 1) / (df[:-1] + 1)) + 1


def scorer(model: Model):
    """A column function: text to a struct of score, neighbours (evidence) and terms; null counts as empty."""
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Scorer(model)  # of this task alone: what it remembers goes when the task ends
        for part in texts:
            for at in range(0, len(part), ROWS):
                out = [own.score(t or "") for t in part.iloc[at : at + ROWS]]
                yield pd.DataFrame({"score": [float(s) for s, _, _ in out], "neighbours": [[{"doc_id": d, "cosine": c, "toxic_share": y} for d, c, y in near] for _, near, _ in out],
                                    "terms": [t for _, _, t in out]})

    return F.pandas_udf(run, "score double, neighbours array<struct<doc_id: long, cosine: double, toxic_share: double>>, terms array<string>")


def with_score(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """All rows and columns of `docs` and a struct `name` of score, neighbours and terms."""
    return docs.withColumn(name, scorer(model)(F.col("text")))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, neighbours, terms of every row.

    Null and empty texts, and texts without any term of the model, get the share of toxic rows among such labelled
    rows. Repeated rows and null ids are scored row by row. Without labelled rows every score is 0.5; an empty
    table gives an empty one. Nothing but the text is an input of a score.
    """
    model = fit(docs, labels)
    out = with_score(texts_of(docs), model, "found")
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), F.col("found.score").alias("score"),
                      (F.col("found.score") >= 0.5).cast("int").alias("predicted"), F.col("found.neighbours").alias("neighbours"), F.col("found.terms").alias("terms"))
