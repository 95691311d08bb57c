"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 48 words, a label speaks for the bag alone. Every passage is read as counts over
byte-class pairs, hashed words and a few shares (distinct words, words seen before in the document), encoded by a
small layer, and weighted by gated attention; the weighted sum of a document's passages is scored by a logistic
layer. All of it is learnt together from document labels: a bounded sample is dealt to shards, each shard descends
by itself, and the shards' weights are averaged after every round. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobdelta.llm.common import bytes_of, fold, mixed, sized, texts_of, written

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
EXAMPLES = 2048  # labelled rows per label that the model is fitted on, at most
PASSAGE = 48  # words
WORDS = 256  # buckets of hashed words
HIDDEN, GATE = 24, 12  # width of a passage's representation, and of the attention
SHARDS, ROUNDS, SWEEPS, BAG = 8, 6, 3, 16  # shards of the sample, averaging rounds, passes over a shard per round, documents of one step
RATE, DECAY = 0.01, 1e-4
_SLICE, _PIECE = 1 << 19, 1 << 22  # words whose features, and bytes whose places, are in memory at once

# ---- passages ----------------------------------------------------------------------------------------------

_CLASSES = 16
_SHARES = 4
_PAIRS = _CLASSES * _CLASSES
WIDTH = _PAIRS + WORDS + _SHARES


def _byte_classes() -> np.ndarray:
    """A class per byte: blanks, line ends, vowels, consonants, capitals, digits, kinds of punctuation, parts of UTF-8."""
    kinds = [b" \t", b"\n\r\x0b\x0c", b"aeiou", b"bcdfghjklmnpqrstvwxyz", bytes(range(65, 91)), b"0123456789", b".", b",", b"!?", b"'\"`-",
             b"|/\\", b"#$%&*@+=~^_<>", b"()[]{};:", bytes(range(0xC0, 0x100)), bytes(range(0x80, 0xC0))]
    table = np.full(256, len(kinds), dtype=np.int64)
    for n, kind in enumerate(kinds):
        table[list(kind)] = n
    return table


_CLASS = _byte_classes()
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_POWER = mixed(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def _hashes(data: np.ndarray, solid: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each word: its bytes weighted by place, capitals as small letters, blanks as nothing."""
    word = np.zeros(len(starts), dtype=np.uint64)
    for p in range(0, len(data), _PIECE):
        q = min(len(data), p + _PIECE)
        lo, hi = max(0, int(np.searchsorted(starts, p, side="right")) - 1), int(np.searchsorted(starts, q))
        if lo == hi:
            continue
        own = np.maximum(starts[lo:hi], p)
        part = data[own[0] : q]
        letters = np.where(solid[own[0] : q], np.where((part >= 65) & (part <= 90), part + 32, part), 0).astype(np.uint64)
        at = np.arange(own[0], q) - np.repeat(starts[lo:hi], np.diff(np.append(own, q)))
        word[lo:hi] += np.add.reduceat(letters * _POWER[np.minimum(at, 255)], own - own[0])
    return mixed(word)


def passages(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, first byte, features) of the passages of texts given as bytes and their ends, some at a time.

    Features are bytes: 255 times the square root of a share of the passage.
    """
    # Word starts; a text's first byte starts one whatever stands before it.
    solid = ~_BLANK[data]
    before = np.empty_like(solid)
    before[:1], before[1:] = False, solid[:-1]
    inner = ends[:-1][ends[:-1] < len(data)]
    before[inner] = False
    starts = np.flatnonzero(solid & ~before)
    if not len(starts):
        return
    stops = np.append(starts[1:], len(data))
    text = np.searchsorted(ends, starts, side="right") - 1
    first = np.searchsorted(starts, ends)  # number of the first word of each text
    place = np.arange(len(starts)) - first[text]
    word = _hashes(data, solid, starts)
    # Seen before in the same text: all but the first of equal (text, word).
    order = np.lexsort((place, word, text))
    again = np.zeros(len(starts), dtype=bool)
    again[order[1:]] = (text[order[1:]] == text[order[:-1]]) & (word[order[1:]] == word[order[:-1]])
    opens = np.flatnonzero(place % PASSAGE == 0)  # first words of passages
    for lo in range(0, len(opens), max(1, _SLICE // PASSAGE)):
        own = opens[lo : lo + max(1, _SLICE // PASSAGE)]
        last = opens[lo + len(own)] if lo + len(own) < len(opens) else len(starts)
        n = len(own)
        sizes = np.diff(np.append(own, last))
        of_word = np.repeat(np.arange(n), sizes)
        w = slice(own[0], last)
        b0, b1 = int(starts[own[0]]), int(min(stops[last - 1], ends[text[last - 1] + 1]))
        # A passage ends with its text, whatever blanks the next text starts with.
        close = np.minimum(np.append(starts[own[1:]], b1), ends[text[own] + 1])
        pairs = np.zeros(n * _PAIRS)
        for p in range(b0, b1, _PIECE):
            q = min(b1, p + _PIECE)
            kinds = _CLASS[data[p : q + 1]]
            of_byte = np.searchsorted(starts[own], np.arange(p, p + len(kinds) - 1), side="right") - 1
            inner = np.arange(p + 1, p + len(kinds)) < close[of_byte]
            pairs += np.bincount((of_byte * _PAIRS + kinds[:-1] * _CLASSES + kinds[1:])[inner], minlength=n * _PAIRS)
        pairs = pairs.reshape(n, _PAIRS)
        hashed = np.bincount(of_word * WORDS + (word[w] % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, -1)
        length = np.bincount(of_word, weights=np.add.reduceat(solid[b0:b1], starts[w] - b0, dtype=np.int64), minlength=n)
        # Distinct words of a passage.
        inside = np.lexsort((word[w], of_word))
        new = np.ones(len(inside), dtype=bool)
        new[1:] = (of_word[inside[1:]] != of_word[inside[:-1]]) | (word[w][inside[1:]] != word[w][inside[:-1]])
        distinct = np.bincount(of_word, weights=new, minlength=n) / sizes
        repeated = np.bincount(of_word, weights=again[w], minlength=n) / sizes
        shares = np.stack([distinct, repeated, np.minimum(1.0, length / sizes / 20), sizes / PASSAGE], axis=1)
        share = np.concatenate([pairs / np.maximum(1, pairs.sum(axis=1))[:, None], hashed / sizes[:, None], shares], axis=1)
        yield text[own], starts[own], np.rint(255 * np.sqrt(share)).astype(np.uint8)


# ---- the network -------------------------------------------------------------------------------------------


def start_weights(prior: float) -> dict[str, np.ndarray]:
    """The fixed first weights; a document scores the share of label 1 at first."""
    rng = np.random.default_rng(13)
    make = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
    return {"enc": make(WIDTH, HIDDEN) * 4, "enc0": np.zeros(HIDDEN), "gate": make(HIDDEN, GATE), "gate0": np.zeros(GATE), "open": make(HIDDEN, GATE), "open0": np.zeros(GATE),
            "att": make(GATE, 1)[:, 0], "out": make(HIDDEN, 1)[:, 0] * 0.1, "out0": np.array([np.log(prior / (1 - prior))])}


def snapped(x: np.ndarray) -> np.ndarray:
    """Rounded to multiples of 2 ** -20. Products of such numbers add up exactly, so scores do not depend on a batch's other rows."""
    return np.rint(x * (1 << 20)) / (1 << 20)


def encode(w: dict, features: np.ndarray, snap=snapped) -> np.ndarray:
    """Representations of passages."""
    return snap(np.tanh(features.astype(np.float64) @ snap(w["enc"] / 255) + snap(w["enc0"])))


def bags(w: dict, h: np.ndarray, doc: np.ndarray, n: int, snap=snapped):
    """Score of each of `n` documents, each passage's weight, and what the gradient needs.

    `doc` is ascending; a document without passages scores by the last layer's offset.
    """
    t, g = snap(np.tanh(h @ snap(w["gate"]) + snap(w["gate0"]))), snap(1 / (1 + np.exp(-(h @ snap(w["open"]) + snap(w["open0"])))))
    logits = snap(t * g) @ snap(w["att"])
    top = np.full(n, -np.inf)
    np.maximum.at(top, doc, logits)
    e = snap(np.exp(logits - top[doc]))
    weight = e / np.maximum(1e-300, np.bincount(doc, weights=e, minlength=n))[doc]
    z = np.zeros((n, h.shape[1]))
    np.add.at(z, doc, weight[:, None] * h)
    return 1 / (1 + np.exp(-((z * w["out"]).sum(axis=1) + w["out0"]))), weight, z, t, g


def gradient(w: dict, x: np.ndarray, doc: np.ndarray, y: np.ndarray, importance: np.ndarray) -> tuple[float, dict]:
    """Weighted mean log loss of documents and its derivative by each weight."""
    exact = lambda v: v
    h = encode(w, x, exact)
    p, a, z, t, g = bags(w, h, doc, len(y), exact)
    total = importance.sum()
    dz = ((p - y) * importance / total)[:, None]
    d = {"out": (z * dz).sum(axis=0), "out0": dz.sum(axis=0)}
    back = dz[doc] * w["out"]  # of the loss by z, per passage
    # Softmax: a passage's logit gains what its representation is better than its document's mean.
    gain = a * ((h - z[doc]) * back).sum(axis=1)
    d["att"] = (t * g).T @ gain
    dt, dg = gain[:, None] * w["att"] * g * (1 - t * t), gain[:, None] * w["att"] * t * g * (1 - g)
    d["gate"], d["gate0"], d["open"], d["open0"] = h.T @ dt, dt.sum(axis=0), h.T @ dg, dg.sum(axis=0)
    dh = (a[:, None] * back + dt @ w["gate"].T + dg @ w["open"].T) * (1 - h * h)
    d["enc"], d["enc0"] = (x.astype(np.float64) / 255).T @ dh, dh.sum(axis=0)
    loss = -(importance * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))).sum() / total
    return float(loss), d


def descend(w: dict, rows: list[tuple[np.ndarray, float, float]], seed: int, sweeps: int = SWEEPS) -> dict:
    """Weights after `sweeps` passes over documents (features, label, importance), by Adam in steps of BAG documents."""
    w = {k: v.copy() for k, v in w.items()}
    mean = {k: np.zeros_like(v) for k, v in w.items()}
    square = {k: np.zeros_like(v) for k, v in w.items()}
    rng, step = np.random.default_rng(seed), 0
    for _ in range(sweeps):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), BAG):
            part = [rows[i] for i in order[lo : lo + BAG]]
            x = np.concatenate([f for f, _, _ in part])
            doc = np.repeat(np.arange(len(part)), [len(f) for f, _, _ in part])
            _, d = gradient(w, x, doc, np.array([y for _, y, _ in part]), np.array([i for _, _, i in part]))
            step += 1
            for k in w:
                g = d[k] + DECAY * w[k] if w[k].ndim > 1 else d[k]
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                w[k] -= RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    return w


# ---- fitting -----------------------------------------------------------------------------------------------


@dataclass
class Model:
    """All that scoring needs; its size is fixed."""

    weights: dict[str, np.ndarray]
    prior: float  # share of label 1 outside the held-out fold


def _bag_column(texts: pd.Series) -> pd.Series:
    """Passage features of each text, one passage after the other."""
    out = []
    for t in texts:
        raw = np.frombuffer((t or "").encode(), dtype=np.uint8)
        out.append(b"".join(f.tobytes() for _, _, f in passages(raw, np.array([0, len(raw)]))))
    return pd.Series(out)


def _sample(labels: DataFrame, examples: int) -> tuple[DataFrame, dict[int, int]]:
    """id, y of at most `examples` labelled rows per label outside the held-out fold, and how many rows each label has.

    Rows that repeat an id are one row, of label 1 if any of them is. Drawn by a hash of the id, a little under the
    bound on average, so no task has to see all rows of a label.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).filter(fold("doc_id", FOLDS) != HELD_OUT) \
        .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").cast("int").alias("y"))
    n = {0: 0, 1: 0} | {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    part = [min(1.0, 0.97 * examples / max(1, n[y])) for y in (0, 1)]
    drawn = F.pmod(F.xxhash64("id", F.lit(13)), F.lit(1 << 30)) < F.when(F.col("y") == 1, int(part[1] * (1 << 30))).otherwise(int(part[0] * (1 << 30)))
    return known.filter(drawn & (F.col("y") == 0)).limit(examples).union(known.filter(drawn & (F.col("y") == 1)).limit(examples)), n


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, rounds: int = ROUNDS) -> Model:
    """Fit on at most `examples` labelled rows per label outside the held-out fold."""
    sample, n = _sample(labels, examples)
    prior = (n[1] + 0.5) / (n[0] + n[1] + 1)
    if not (n[0] and n[1]):
        return Model(start_weights(prior) | {"out": np.zeros(HIDDEN)}, prior)
    # At most 2 * examples ids, so the sample may be sent to every executor.
    texts = texts_of(docs)
    chosen = texts.join(F.broadcast(sample), texts["doc_id"] == sample["id"]).groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text"))
    rows = chosen.select("doc_id", "y", F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(SHARDS)).alias("shard"), F.pandas_udf(_bag_column, "binary")(F.col("text")).alias("bag"))
    rows = written(rows, "quality-sample")
    found = {0: 0, 1: 0} | {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    stands = {y: n[y] / max(1, found[y]) for y in (0, 1)}  # labelled rows that a sampled one stands for
    weights = start_weights(prior)
    names = list(weights)
    for turn in range(rounds):
        now = weights

        def run(own: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values("doc_id")
            bags_ = [(np.frombuffer(b, np.uint8).reshape(-1, WIDTH), float(y), stands[y]) for b, y in zip(own["bag"], own["y"]) if len(b)]
            new = descend(now, bags_, 100 * turn + int(own["shard"].iloc[0])) if bags_ else now
            return pd.DataFrame({"shard": [int(own["shard"].iloc[0])], "n": [len(bags_)], "w": [np.concatenate([new[k].ravel() for k in names]).tobytes()]})

        parts = sorted((r["shard"], r["n"], bytes(r["w"])) for r in rows.groupBy("shard").applyInPandas(run, "shard long, n long, w binary").collect() if r["n"])  # a row per shard
        if not parts:
            break
        flat = sum(k * np.frombuffer(w) for _, k, w in parts) / sum(k for _, k, _ in parts)
        cuts = np.cumsum([weights[k].size for k in names])[:-1]
        weights = {k: v.reshape(now[k].shape) for k, v in zip(names, np.split(flat, cuts))}
    return Model(weights, prior)


# ---- scoring -----------------------------------------------------------------------------------------------


def scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[pa.RecordBatch, list, list]]:
    """Slices of batches with a `text` column, the score of each row, and its passages as (first byte, weight), whole."""
    w = model.weights
    for big in batches:
        for b in sized(big, "text", 1 << 20):
            data, ends = bytes_of(b.column("text"))
            parts = [(doc, first, encode(w, f)) for doc, first, f in passages(data, ends)]
            scores, shown = np.full(b.num_rows, round(model.prior, 6)), [[] for _ in range(b.num_rows)]
            if parts:
                doc, first, h = (np.concatenate(x) for x in zip(*parts))
                p, weight, *_ = bags(w, h, doc, b.num_rows)
                full = np.unique(doc)
                scores[full] = p[full].round(6)
                cuts = np.searchsorted(doc, full)
                for d, lo, hi in zip(full.tolist(), cuts, np.append(cuts[1:], len(doc))):
                    best = int(lo + weight[lo:hi].argmax())
                    shown[d] = [hi - lo, int(first[best] - ends[d]), float(weight[best])]
            yield b, scores.tolist(), shown


def with_quality(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """All rows and columns of `docs` and a struct `name`: score, passages, focus_start (byte) and focus_weight of the passage with most attention.

    Null texts count as empty; texts without a word have no focus and score the share of label 1.
    """
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            out = []
            for _, scores, shown in scored([pa.RecordBatch.from_arrays([pa.array(part.fillna(""), pa.large_string())], names=["text"])], model):
                out += [(s, *(x or (0, None, None))) for s, x in zip(scores, shown)]
            yield pd.DataFrame(out, columns=["score", "passages", "focus_start", "focus_weight"]).astype({"focus_start": "Int64"})

    return docs.withColumn(name, F.pandas_udf(run, "score double, passages long, focus_start long, focus_weight double")(F.col("text")))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, passages, focus_start, focus_weight of every row.

    Null and empty texts, and texts of blanks alone, score the share of label 1. Texts of any length are read whole,
    passage by passage. Equal texts score alike; repeated rows and null ids are scored row by row; a label for an id
    that several rows carry speaks for one of their texts, the smallest. Equal attention: the first passage is shown.
    Without labels of both kinds all rows score that share (0.5 without any). An empty table gives an empty one.
    Nothing but the text is an input of a score; further columns play no part.
    """
    model = fit(docs, labels)
    found = with_quality(texts_of(docs), model, "found")
    score = F.col("found.score")
    return found.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"),
                        F.col("found.passages").alias("passages"), F.col("found.focus_start").alias("focus_start"), F.col("found.focus_weight").alias("focus_weight"))
