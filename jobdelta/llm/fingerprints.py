"""Fingerprints of improbable features: byte windows of rare entropy, in chained Bloom filters.

Every window of WINDOW bytes has an entropy; how often each level of entropy occurs in the whole corpus ranks
windows by rarity. In every run of SPAN windows the rarest wins, and windows that win often enough are the
text's features. They are inserted, in order, into Bloom filters of FILTER_BITS bits, a new one after every
PER_FILTER features. Two fingerprints are compared filter by filter: the bits in common beyond those that chance
explains, as a share of the most there could be.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobdelta.llm.common import mixed, sized, texts_of
from jobdelta.llm.shingles import powers

WINDOW = 16
SPAN = 32
WINS = 6  # spans that a window must win
BRIEF = 4  # bytes of a window in texts too short for one span
LEVELS = 512  # of entropy, from 0 to log2(WINDOW) bits
WEAK = LEVELS // 4  # windows of lower entropy tell nothing
FILTER_BITS = 2048
PROBES = 5
PER_FILTER = 128

_NEVER = np.int64(2**62)
_BASE = np.uint64(0xC6A4A7935BD1E995)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_COUNT = np.arange(WINDOW + 1, dtype=np.float64)
_LOAD = np.where(_COUNT > 0, _COUNT * np.log2(np.maximum(_COUNT, 1)), 0)
#: What one more of a byte that a window holds c times adds to the sum of c*log2(c), in 1/65536 bits.
_STEP = np.rint(np.diff(_LOAD) * 65536).astype(np.int32)


class Layout:
    """Texts side by side with a gap after each, so that no window and no span of windows reaches the next."""

    def __init__(self, texts: list[bytes]):
        gap = WINDOW + SPAN
        self.lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.starts = np.cumsum(self.lengths + gap) - self.lengths - gap
        self.data = np.frombuffer(b"".join(t + bytes(gap) for t in texts), dtype=np.uint8)
        self.windows = np.maximum(self.lengths - WINDOW + 1, 0)
        inside = np.zeros(len(self.data) + 1, dtype=np.int8)
        np.add.at(inside, self.starts, 1)
        np.add.at(inside, self.starts + self.windows, -1)
        self.valid = np.cumsum(inside[:-1], dtype=np.int8) > 0

    def levels(self) -> np.ndarray:
        """Level of entropy of the window that begins at each place."""
        x = self.data
        n = len(x)
        before = np.zeros(n, dtype=np.uint8)  # equal bytes among the WINDOW - 1 before
        after = np.zeros(n, dtype=np.uint8)
        for d in range(1, min(WINDOW, n)):
            same = (x[d:] == x[:-d]).view(np.uint8)
            before[d:] += same
            after[:-d] += same
        # Sliding by a byte takes the first byte's last step away and adds the new byte's next one.
        enter, leave = np.cumsum(_STEP[before], dtype=np.int64), np.cumsum(_STEP[after], dtype=np.int64)
        load = np.zeros(n, dtype=np.int64)
        if n >= WINDOW:
            load[: n - WINDOW + 1] = enter[WINDOW - 1 :]
            load[1 : n - WINDOW + 1] -= leave[: n - WINDOW]
        full = int(_LOAD[WINDOW] * 65536)
        return np.clip((full - load) * LEVELS // (full + 1), 0, LEVELS - 1)


def features(texts: list[bytes], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the features of all texts in order, and the text of each.

    In a text too short for a span every window of BRIEF bytes is a feature. A text without any is one feature as
    a whole; an empty one has none.
    """
    at = Layout(texts)
    n = len(at.data)
    place = np.arange(n, dtype=np.int64)
    level = at.levels()
    key = np.where(at.valid & (level >= WEAK) & np.repeat(at.windows >= SPAN, at.lengths + WINDOW + SPAN), (rank[level] << np.int64(40)) | place, _NEVER)
    best = key
    d = 1
    while d < SPAN:  # the least of 1, 2, 4 ... places from each on
        best = np.minimum(best, np.r_[best[d:], np.full(min(d, n), _NEVER)][:n])
        d *= 2
    spans = np.flatnonzero(at.valid & (best < _NEVER))
    winner = best[spans] & np.int64((1 << 40) - 1)
    first = np.flatnonzero(np.r_[True, winner[1:] != winner[:-1]]) if len(winner) else np.zeros(0, dtype=np.int64)
    wins = np.diff(np.r_[first, len(winner)])
    won = winner[first]
    owner = np.searchsorted(at.starts, won, side="right") - 1
    won, owner = won[wins >= WINS], owner[wins >= WINS]
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((at.data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=sums[1:])
    back = powers(_INVERSE, n + 1)
    hashes = mixed((sums[won + WINDOW] - sums[won]) * back[won])
    brief = np.flatnonzero((at.windows < SPAN) & (at.lengths >= BRIEF))
    count = at.lengths[brief] - BRIEF + 1
    start = np.repeat(at.starts[brief] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    hashes = np.r_[hashes, mixed((sums[start + BRIEF] - sums[start]) * back[start] + np.uint64(BRIEF))]
    owner = np.r_[owner, np.repeat(brief, count)]
    bare = np.flatnonzero((np.bincount(owner, minlength=len(texts)) == 0) & (at.lengths > 0))
    if len(bare):
        whole = mixed((sums[at.starts[bare] + at.lengths[bare]] - sums[at.starts[bare]]) * back[at.starts[bare]] + at.lengths[bare].astype(np.uint64))
        hashes, owner = np.r_[hashes, whole], np.r_[owner, bare]
    order = np.argsort(owner, kind="stable")
    return hashes[order], owner[order]


def digests(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """For each text its filters, one row of bytes each."""
    hashes, owner = features(texts, rank)
    # A feature that a text has more than once is inserted the first time only.
    order = np.lexsort((np.arange(len(hashes)), hashes, owner))
    again = np.zeros(len(hashes), dtype=bool)
    if len(hashes):
        again[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    hashes, owner = hashes[~again], owner[~again]
    count = np.bincount(owner, minlength=len(texts))
    filters = -(-count // PER_FILTER)
    base = np.cumsum(filters) - filters
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    row = base[owner] + nth // PER_FILTER
    bits = np.zeros(int(filters.sum()) * FILTER_BITS, dtype=bool)
    for k in range(PROBES):
        bits[row * FILTER_BITS + ((hashes >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits.reshape(-1, FILTER_BITS), axis=1)
    return np.split(packed, np.cumsum(filters)[:-1]) if len(texts) else []


def to_text(filters: np.ndarray) -> str:
    return base64.b64encode(filters.tobytes()).decode("ascii")


def to_filters(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), dtype=np.uint8).reshape(-1, FILTER_BITS // 8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From 0 to 1. Equal fingerprints are 1, also empty ones; an empty one is like no other."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    ones_a, ones_b = np.bitwise_count(a).sum(axis=1, dtype=np.int64), np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    total = 0.0
    for row, ones in zip(a, ones_a):  # one filter at a time: memory stays that of the longer fingerprint
        both = np.bitwise_count(b & row).sum(axis=1, dtype=np.int64)
        chance = ones * ones_b / FILTER_BITS
        most = np.minimum(ones, ones_b)
        total += ones * float(np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0, 1).max())
    return min(1.0, total / float(ones_a.sum()))


def rarity(docs: DataFrame) -> np.ndarray:
    """Rank of each level of entropy over all windows of all texts: 0 is the rarest. Ties go to the higher level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(LEVELS, dtype=np.int64)
        for big in batches:
            for b in sized(big, "text", 1 << 20):
                at = Layout([t.encode() for t in b.column("text").to_pylist()])
                seen += np.bincount(at.levels()[at.valid], minlength=LEVELS)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["level", "n"])

    counts = np.zeros(LEVELS, dtype=np.int64)
    for r in texts_of(docs).select("text").mapInArrow(run, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():  # LEVELS rows
        counts[r["level"]] = r["n"]
    rank = np.empty(LEVELS, dtype=np.int64)
    rank[np.lexsort((-np.arange(LEVELS), counts))] = np.arange(LEVELS)
    return rank


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row; a null or empty text has the empty fingerprint."""
    rank = rarity(docs)

    def run(batches):
        for big in batches:
            for b in sized(big, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([to_text(d) for d in digests([t.encode() for t in b.column("text").to_pylist()], rank)], pa.string())],
                                                 names=["doc_id", "fingerprint"])

    return texts_of(docs).mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last quarter of characters replaced by as many first ones (or all) of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def in_order(docs: DataFrame) -> DataFrame:
    """bucket, doc_id, text, border, partitioned by bucket: ranges of doc_id, each sorted, with the first row after a
    bucket as its last one, marked as its border. The first row of all follows the last. Nulls come first, and rows
    with the same id stand in the order of their texts."""
    spark = docs.sparkSession
    rows = texts_of(docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    splits = sorted({int(x) for x in rows.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 1 / (4 * parts))})
    placed = rows.withColumn("bucket", _bucket(splits)(F.col("doc_id")))
    low = placed.groupBy("bucket").agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("low")).collect()  # one row a bucket
    low = sorted((r["bucket"], r["low"]) for r in low)
    if not low:
        return placed.withColumn("border", F.lit(False))
    after = spark.createDataFrame([(low[k - 1][0], x) for k, (_, x) in enumerate(low)], "to int, low long")
    borders = rows.join(F.broadcast(after), F.coalesce(rows["doc_id"], F.lit(-(2**63))) == after["low"]).groupBy("to", "doc_id").agg(F.min("text").alias("text"))
    both = placed.select("bucket", "doc_id", "text", F.lit(False).alias("border")).union(borders.select(F.col("to").alias("bucket"), "doc_id", "text", F.lit(True)))
    return both.repartitionById(parts, "bucket").sortWithinPartitions("bucket", "border", F.col("doc_id").asc_nulls_first(), "text")


def _bucket(splits: list[int]):
    def run(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), dtype=np.int32)
        out[known] = np.searchsorted(splits, ids[known].to_numpy(dtype=np.int64), side="right")
        return pd.Series(out)

    return F.pandas_udf(run, "int")


def compare_with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The next document is the one of the next id; after the last comes the first, and a lone document follows
    itself. Null and empty texts have no characters and the empty fingerprint; other columns are ignored; an
    empty table gives an empty one.
    """
    rank = rarity(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # bucket, doc_id, text and filters of a row that waits for the next one
        for big in batches:
            for b in sized(big, "text", 1 << 20):
                rows = list(zip(b.column("bucket").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("border").to_pylist()))
                filters = digests([t.encode() for _, _, t, _ in rows], rank)
                ready = []
                for (bucket, doc, text, border), own in zip(rows, filters):
                    if last is not None:
                        ready.append((*last, text, own))
                    last = None if border else (doc, text, own)
                if not ready:
                    continue
                new = [edited(text, following).encode() for _, text, _, following, _ in ready]
                changed = digests(new, rank)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in ready], pa.int64()), pa.array([len(r[1]) for r in ready], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in new]),
                     pa.array([to_text(r[2]) for r in ready], pa.string()), pa.array([to_text(c) for c in changed], pa.string()),
                     pa.array([likeness(r[2], c) for r, c in zip(ready, changed)], pa.float64()), pa.array([likeness(r[2], r[4]) for r in ready], pa.float64())],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return in_order(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
