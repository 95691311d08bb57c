"""Token counts by merging ragged arrays of pre-tokens, all sequences in step.

Symbols of many pre-tokens lie in one array. In each step every sequence applies its own lowest-ranked
pair, at all its places at once; sequences without a pair leave. A pair that a merge creates always ranks
behind that merge, so a sequence's steps follow the one-merge-at-a-time order exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobdelta.llm.common import once, sized, slices, texts_of
from jobdelta.llm.pretokens import UnitCache, Vocabulary, find


class PairRanks:
    """Rank of each mergeable pair, in a table with open addressing that arrays of pairs are looked up in."""

    ABSENT = np.int32(2**31 - 1)

    def __init__(self, merges: list[tuple[int, int]], made: list[int]):
        self.bits = max(8, int(np.ceil(np.log2(4 * max(1, len(merges))))))
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, self.ABSENT, dtype=np.int32)
        self.made = np.asarray(made, dtype=np.int32)
        for rank, (a, b) in enumerate(merges):
            at = int(self._slot(np.asarray([(a << 32) | b], dtype=np.int64))[0])
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.ranks[at] = (a << 32) | b, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], self.ABSENT)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


def surviving(symbols: np.ndarray, lengths: np.ndarray, pairs: PairRanks) -> np.ndarray:
    """How many symbols each sequence keeps once no pair of it can merge. Empty sequences keep 0."""
    counts = np.asarray(lengths, dtype=np.int64).copy()
    owner = np.flatnonzero(counts > 1)
    keep = np.repeat(counts > 1, counts)
    symbols, lengths = np.asarray(symbols, dtype=np.int32)[keep], counts[owner]
    seq = np.repeat(np.arange(len(owner)), lengths)
    ranks = None
    while len(symbols):
        if ranks is None:  # of the pair that begins at each place; none at a sequence's end
            ranks = np.full(len(symbols), pairs.ABSENT, dtype=np.int32)
            inside = np.flatnonzero(seq[:-1] == seq[1:])
            ranks[inside] = pairs.of(symbols[inside], symbols[inside + 1])
        starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        lowest = np.minimum.reduceat(ranks, starts)
        alive = lowest != pairs.ABSENT
        lengths = np.diff(np.r_[starts, len(symbols)])
        if not alive.all():
            counts[owner[~alive]] = lengths[~alive]
            here = np.repeat(alive, lengths)
            symbols, ranks = symbols[here], ranks[here]
            owner, lengths, lowest = owner[alive], lengths[alive], lowest[alive]
            seq = np.repeat(np.arange(len(owner)), lengths)
            if not len(symbols):
                break
        hit = ranks == np.repeat(lowest, lengths)
        # Places of a repeated symbol overlap: take every second place of a run, from its left end.
        chained = np.flatnonzero(hit[1:] & hit[:-1])
        if len(chained):
            begins = hit.copy()
            begins[1:] &= ~hit[:-1]
            where = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(begins, where, 0))
            hit &= (where - run) % 2 == 0
        at = np.flatnonzero(hit)
        symbols[at] = pairs.made[ranks[at]]
        stay = np.ones(len(symbols), dtype=bool)
        stay[at + 1] = False
        symbols, seq = symbols[stay], seq[stay]
        ranks = ranks[stay]
        # Only pairs at a merged symbol and just before one have changed.
        new = np.cumsum(stay)[at] - 1
        touched = np.unique(np.r_[new, new[new > 0] - 1])
        ranks[touched] = pairs.ABSENT
        touched = touched[touched + 1 < len(symbols)]
        touched = touched[seq[touched] == seq[touched + 1]]
        ranks[touched] = pairs.of(symbols[touched], symbols[touched + 1])
    return counts


class Counter:
    """Token counts of texts under one vocabulary file."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.pairs = PairRanks(self.vocabulary.merges, self.vocabulary.made)
        self.byte_ids = np.asarray(self.vocabulary.byte_ids, dtype=np.int32)
        self.cache = UnitCache(self._units)
        self.made: dict[bytes, int] = {}

    def _units(self, strings: list[str]) -> list[int]:
        found = [find(s) for s in strings]
        counts = self.made
        if len(counts) > self.cache.limit:
            counts.clear()
        distinct = list({p for ps in found for p in ps}.difference(counts))
        lengths = np.fromiter(map(len, distinct), dtype=np.int64, count=len(distinct))
        symbols = self.byte_ids[np.frombuffer(b"".join(distinct), dtype=np.uint8)]
        counts.update(zip(distinct, surviving(symbols, lengths, self.pairs).tolist()))
        out = [sum(map(counts.__getitem__, ps)) for ps in found]
        self.cache.drop_long(counts, found)
        return out

    def counts(self, texts: list[str]) -> list[int]:
        segments, owner, out = [], [], [0] * len(texts)
        for n, t in enumerate(texts):
            for k, s in enumerate(self.vocabulary.segments(t)):
                if k % 2:
                    out[n] += 1
                elif s:
                    segments.append(s)
                    owner.append(n)
        for n, (head, rest) in zip(owner, self.cache.values(segments)):
            out[n] += head + sum(rest)
        return out


def count_tokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every whole text.

    A null or empty text has 0 of both; repeated rows and null ids are counted row by row; other columns are
    ignored. `tokenizer_path` names a byte-level BPE file that every executor has; its special strings count
    as one token each where a text holds them.
    """

    def run(batches):
        counter = once(f"counter:{tokenizer_path}", lambda: Counter(tokenizer_path))
        for big in batches:
            for b in sized(big, "text"):
                texts = b.column("text").to_pylist()
                counts = [n for part in slices(texts) for n in counter.counts(part)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.compute.binary_length(b.column("text")).cast(pa.int64()), pa.array(counts, pa.int64())],
                                                 names=["doc_id", "n_bytes", "n_tokens"])

    return texts_of(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def over_limit(counted: DataFrame, limit: int = 512) -> DataFrame:
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
