"""Language-model scores from a hidden Markov model trained by Baum-Welch.

Words of all training documents are counted. Frequent words are symbols of their own; the others share symbols
by their endings, and a word's share of its symbol is its smoothed count. Latent states are trained on the symbol
sequences of all training documents: each task runs forward-backward over its own and returns expected counts,
which are added up by symbol. A text's score is the exact likelihood of its whole sequence by the scaled forward
recursion, times the shares of its words.

Counts of the most frequent words go to every worker, a bounded number; those of all other words are joined.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobdelta.llm.common import fold, sized, texts_of, written

FOLDS, HELD_OUT = 10, 0
SYMBOLS = 16_000  # frequent words that are symbols of their own
ENDINGS = 1_500  # symbols that the other words share
CARRIED = 1 << 17  # frequent words whose counts every worker holds
STATES, ROUNDS = 8, 5
SEGMENT = 512  # tokens: Baum-Welch trains on stretches of whole texts; scores are of whole sequences
SEEDS = 2048  # segments from which the first model is drawn, by their most frequent symbols
SEED_SYMBOLS = 2000
SMOOTHING = 0.1  # of word counts
BACKGROUND = 200.0  # symbols of the overall distribution that every state is given
STICKY = 0.95  # first chance to stay in a state
END = 0  # symbol of the end of a text


def words(text: str) -> list[bytes]:
    """Stretches without blanks, A-Z in lower case. bytes.split and bytes.lower mean exactly these characters."""
    return text.encode().lower().split()


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


# ---- words ------------------------------------------------------------------------------------------------


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
        found.clear()
        return out

    for big in batches:
        for b in sized(big, "text", 1 << 20):
            for t in b.column("text").to_pylist():
                found.update(words(t))
            if len(found) > 400_000:
                yield flush()
    yield flush()


@dataclass
class Vocabulary:
    """Word counts: `table` (word, n) holds all; `carried` the most frequent ones, in order."""

    table: DataFrame
    carried: list[bytes]
    counts: np.ndarray  # of the carried words
    texts: int  # training texts, so also end tokens
    tokens: int  # N
    distinct: int  # V
    shares: np.ndarray  # log10 denominators of words that share a symbol, by ending


def _least_count(table: DataFrame, most: int) -> int:
    """The count that at most `most` words reach, from a histogram whose size does not depend on the table: exact
    for small counts, in steps of a sixteenth of a doubling above."""
    n = F.col("n")
    step = F.when(n <= 1024, n).otherwise(1024 + F.floor(F.log2(n / 1024) * 16)).cast("long")
    rows = table.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).collect()
    total, least = 0, 2**62
    for r in sorted(rows, key=lambda r: -r["step"]):
        total += r["words"]
        if total > most:
            break
        least = r["least"]
    return least


def count_words(train: DataFrame) -> Vocabulary:
    table = written(train.select("text").mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "hmm-words")
    texts = train.count()
    total = table.agg(F.sum("n"), F.count(F.lit(1))).first()
    top = table.filter(F.col("n") >= _least_count(table, CARRIED)).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    counts = top.column("n").to_numpy()
    carried = top.column("word").cast(pa.binary()).to_pylist()
    # Totals of the words that share a symbol: those beyond the first, whatever their number, by ending.
    mass, kinds = np.zeros(ENDINGS), np.zeros(ENDINGS)

    def by_ending(batches):
        for b in batches:
            at = np.fromiter((ending(w.encode()) for w in b.column("word").to_pylist()), dtype=np.int64, count=b.num_rows)
            n = np.bincount(at, weights=b.column("n").to_numpy(), minlength=ENDINGS)
            k = np.bincount(at, minlength=ENDINGS)
            some = np.flatnonzero(k)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some].astype(np.int64)), pa.array(k[some])], names=["ending", "n", "kinds"])

    for r in table.mapInArrow(by_ending, "ending long, n long, kinds long").groupBy("ending").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).collect():  # ENDINGS rows
        mass[r["ending"]], kinds[r["ending"]] = r["n"], r["kinds"]
    for w, n in zip(carried[:SYMBOLS], counts):
        mass[ending(w)] -= n
        kinds[ending(w)] -= 1
    return Vocabulary(table, carried, counts, texts, int(total[0] or 0) + texts, int(total[1]) + (texts > 0), np.log10(mass + SMOOTHING * (kinds + 1)))


def _encoder(v: Vocabulary):
    """Texts to symbols, to the parts of both scores that carried words decide, and to the words that must be joined."""
    carried, counts, shares, texts, size = v.carried, v.counts, v.shares, v.texts, min(SYMBOLS, len(v.carried))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: n for n, w in enumerate(carried)}
        get = place.get
        symbol = np.asarray([1 + n if n < size else 1 + SYMBOLS + ending(w) for n, w in enumerate(carried)], dtype=np.uint16)
        logs = np.log10(counts + SMOOTHING)
        within = np.asarray([0.0 if n < size else logs[n] - shares[ending(w)] for n, w in enumerate(carried)])
        end_log = np.log10(texts + SMOOTHING)
        key = TaskContext.get().partitionId() << 36
        for big in batches:
            for b in sized(big, "text", 4 << 20):
                rows = []
                for text in b.column("text").to_pylist():
                    ws = words(text)
                    at = np.fromiter((get(w, -1) for w in ws), dtype=np.int64, count=len(ws))
                    out = np.empty(len(ws) + 1, dtype=np.uint16)
                    out[-1] = END
                    missing = np.flatnonzero(at < 0)
                    have = at if not len(missing) else at[at >= 0]
                    if len(missing):
                        rare = [ws[m] for m in missing.tolist()]
                        out[:-1][at >= 0] = symbol[have]
                        out[missing] = [1 + SYMBOLS + ending(w) for w in rare]
                    else:
                        rare = []
                        out[:-1] = symbol[at]
                    rows.append((len(ws) + 1, len(have) + (texts > 0), float(logs[have].sum()) + end_log, float(within[have].sum()) if len(have) else 0.0, out.tobytes(), rare))
                n, known, base, share, symbols, rare = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key + np.arange(len(rows))), b.column("doc_id"), b.column("train"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(share),
                     pa.array(symbols, pa.binary()), pa.array(rare, pa.list_(pa.binary())).cast(pa.list_(pa.string()))],
                    names=["key", "doc_id", "train", "n_tokens", "known", "base", "share", "symbols", "rare"])
                key += len(rows)

    return run


# ---- states -----------------------------------------------------------------------------------------------


@dataclass
class Model:
    start: np.ndarray  # K
    move: np.ndarray  # K x K
    emit: np.ndarray  # symbol x K

    @property
    def states(self) -> int:
        return len(self.start)


class Steps:
    """Sequences side by side, longest first, in order of time: step t holds token t of all that are so long."""

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.fromiter(map(len, sequences), dtype=np.int64, count=len(sequences))
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        self.count = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
        self.start = np.r_[0, np.cumsum(self.count)]
        rank = np.repeat(np.arange(len(lengths)), lengths)
        time = np.arange(len(rank)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.symbols = np.empty(len(rank), dtype=np.int64)
        self.symbols[self.start[time] + rank] = np.concatenate([sequences[n] for n in self.order])

    def forward(self, m: Model, keep: bool):
        """log10 likelihood of each sequence in the order given; with `keep` also scaled forward values and scales."""
        emit = m.emit[self.symbols]
        held = np.empty_like(emit) if keep else None
        scales = np.empty(len(self.symbols), dtype=emit.dtype)
        logs = np.zeros(len(self.order))
        a = None
        for t, n in enumerate(self.count.tolist()):
            lo = self.start[t]
            a = emit[lo : lo + n] * (m.start if t == 0 else a[:n] @ m.move)
            c = a.sum(axis=1)
            a /= c[:, None]
            scales[lo : lo + n] = c
            if keep:
                held[lo : lo + n] = a
        np.log10(scales, out=scales)
        for t, n in enumerate(self.count.tolist()):
            logs[:n] += scales[self.start[t] : self.start[t] + n]
        out = np.empty(len(logs))
        out[self.order] = logs
        return out, emit, held, scales

    def expected(self, m: Model):
        """Expected counts of first states, moves and (symbol, state), and the sum of log10 likelihoods."""
        logs, emit, alpha, scales = self.forward(m, True)
        scales = np.power(10.0, scales, dtype=np.float64).astype(emit.dtype)
        k = m.states
        first, moves = np.zeros(k), np.zeros((k, k))
        beta = np.ones((0, k), dtype=emit.dtype)
        for t in range(len(self.count) - 1, -1, -1):
            n, lo = int(self.count[t]), self.start[t]
            b = np.ones((n, k), dtype=emit.dtype)
            if len(beta):
                b[: len(beta)] = beta @ m.move.T
                moves += alpha[lo : lo + len(beta)].T @ beta
            own = alpha[lo : lo + n]
            beta = b * emit[lo : lo + n] / scales[lo : lo + n, None]  # what the step before needs
            own *= b
            own /= own.sum(axis=1, keepdims=True)
        first += alpha[: self.count[0]].sum(axis=0)
        return first, moves * m.move, alpha, float(logs.sum())


def _groups(column: pa.Array, tokens: int = 200_000, segment: int | None = None) -> Iterator[list[np.ndarray]]:
    held, size = [], 0
    for raw in column.to_pylist():
        x = np.frombuffer(raw, dtype="<u2")
        parts = [x] if segment is None else [x[i : i + segment] for i in range(0, len(x), segment)]
        held += parts
        size += len(x)
        if size >= tokens:
            yield held
            held, size = [], 0
    if held:
        yield held


def _expectation(m: Model):
    k, width = m.states, len(m.emit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((width + k + 1, k))  # symbols, then moves, then first states
        logs = tokens = 0.0
        for b in batches:
            for group in _groups(b.column("symbols"), segment=SEGMENT):
                steps = Steps(group)
                first, moves, gamma, likelihood = steps.expected(m)
                for s in range(k):
                    counts[:width, s] += np.bincount(steps.symbols, weights=gamma[:, s], minlength=width)
                counts[width : width + k] += moves
                counts[width + k] += first
                logs += likelihood
                tokens += len(steps.symbols)
        at = np.flatnonzero(counts.any(axis=1))
        rows = np.vstack([counts[at], np.r_[logs, tokens, np.zeros(k - 2)][None]])
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), *[pa.array(rows[:, s].copy()) for s in range(k)]], names=["row", *[f"s{s}" for s in range(k)]])

    return run


def first_model(sample: list[np.ndarray], width: int, states: int = STATES) -> Model:
    """States from a clustering of sampled segments by the symbols they hold: a start that Baum-Welch leaves behind."""
    overall = np.bincount(np.concatenate(sample), minlength=width) + 1e-3
    unit = np.sqrt(np.stack([np.bincount(x[x < SEED_SYMBOLS], minlength=SEED_SYMBOLS).astype(np.float32) for x in sample]))
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
    picked = [int(np.argmax([len(x) for x in sample]))]
    near = unit @ unit[picked[0]]
    while len(picked) < min(states, len(sample)):
        picked.append(int(np.argmin(near)))
        near = np.maximum(near, unit @ unit[picked[-1]])
    centres = unit[picked]
    for _ in range(6):
        own = (unit @ centres.T).argmax(axis=1)
        centres = np.stack([unit[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    emit = np.stack([np.bincount(np.concatenate([x for x, o in zip(sample, own) if o == c] or [np.zeros(0, dtype=np.int64)]), minlength=width) + BACKGROUND * overall / overall.sum()
                     for c in range(len(centres))], axis=1)
    while emit.shape[1] < states:
        emit = np.hstack([emit, overall[:, None]])
    k = emit.shape[1]
    move = np.full((k, k), (1 - STICKY) / max(1, k - 1))
    np.fill_diagonal(move, STICKY if k > 1 else 1.0)
    return Model(np.full(k, 1 / k), move, emit / emit.sum(axis=0))


def maximised(rows: np.ndarray, width: int, states: int) -> Model:
    """The model that expected counts make, each state smoothed towards the overall distribution."""
    emit, move, start = rows[:width], rows[width : width + states] + 1.0 / states, rows[width + states] + 1.0
    overall = emit.sum(axis=1) + 1e-3
    emit = emit + BACKGROUND * (overall / overall.sum())[:, None]
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def train(encoded: DataFrame, width: int, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """Baum-Welch over the symbol sequences of all training rows; also the log10 likelihood per token before each round."""
    learn = encoded.filter("train").select("key", "symbols")
    # About so many rows, chosen by a hash of their key, from whose beginnings the first model is drawn.
    every = max(1, learn.count() // SEEDS)
    drawn = learn.filter(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).select("key", F.substring("symbols", 1, 2 * SEGMENT).alias("symbols")).limit(2 * SEEDS).collect()
    seeds = [np.frombuffer(r["symbols"], dtype="<u2").astype(np.int64) for r in sorted(drawn, key=lambda r: r["key"])]
    learn = learn.select("symbols")
    if not seeds:
        return Model(np.full(states, 1 / states), np.full((states, states), 1 / states), np.full((width, states), 1 / width)), []
    m, course = first_model(seeds, width, states), []
    for _ in range(rounds):
        sums = learn.mapInArrow(_expectation(m), "row long, " + ", ".join(f"s{s} double" for s in range(states))) \
            .groupBy("row").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(states)]).toPandas()  # a row for each symbol, at most SYMBOLS + ENDINGS + STATES + 3
        rows = np.zeros((width + states + 1, states))
        at = sums["row"].to_numpy(dtype=int)
        values = sums[[f"s{s}" for s in range(states)]].to_numpy()
        rows[at[at >= 0]] = values[at >= 0]
        logs, tokens = values[at < 0][0, :2]
        course.append(logs / max(tokens, 1))
        m = maximised(rows, width, states)
    return m, course


def _likelihood(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            logs = [x for group in _groups(b.column("symbols")) for x in Steps(group).forward(m, False)[0].tolist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("key", "doc_id", "train", "n_tokens", "known", "base", "share")], pa.array(logs, pa.float64())],
                                             names=["key", "doc_id", "train", "n_tokens", "known", "base", "share", "logs"])

    return run


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row.

    Learns from rows outside the held-out fold. A null or empty text is its end token alone. A word that no
    training text holds has the share that its symbol leaves for one unseen word. Repeated rows and null ids are
    scored row by row; other columns are ignored; an empty table gives an empty one, and one without training
    rows leaves all counts 0.
    """
    rows = texts_of(docs).withColumn("train", fold("doc_id", FOLDS) != HELD_OUT)
    v = count_words(rows.filter("train"))
    width = 1 + SYMBOLS + ENDINGS
    encoded = written(rows.mapInArrow(_encoder(v), "key long, doc_id long, train boolean, n_tokens long, known long, base double, share double, symbols binary, rare array<string>"), "hmm-encoded")
    model, _ = train(encoded, width)
    scored = encoded.drop("rare").mapInArrow(_likelihood(model), "key long, doc_id long, train boolean, n_tokens long, known long, base double, share double, logs double")

    # Words beyond the carried ones: their counts are joined, summed up per text.
    shares = v.shares

    def shared(batches):
        for b in batches:
            at = np.fromiter((ending(w.encode()) for w in b.column("word").to_pylist()), dtype=np.int64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("word"), pa.array(shares[at])], names=["key", "word", "below"])

    rare = encoded.select("key", F.explode("rare").alias("word")).mapInArrow(shared, "key long, word string, below double")
    log = F.log10(F.coalesce("n", F.lit(0)) + SMOOTHING)
    joined = rare.join(v.table, "word", "left").groupBy("key").agg(
        F.sum(F.col("n").isNotNull().cast("long")).alias("more_known"), F.sum(log).alias("more_base"), F.sum(log - F.col("below")).alias("more_share"))
    below = float(np.log10(v.tokens + SMOOTHING * (v.distinct + 1)))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.join(joined, "key", "left").select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("known") + zero("more_known")).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base") - F.col("n_tokens") * below).alias("base_score"), (F.col("logs") + F.col("share") + zero("more_share")).alias("score"))
