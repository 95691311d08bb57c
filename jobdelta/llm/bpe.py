"""BPE encoding by backtracking over longest matches, and decoding by a table of offsets.

An Aho-Corasick automaton finds every vocabulary token inside a pre-token. Encoding takes the longest token
at each place whose neighbours on the left are compatible with it, and steps back over places from which no
compatible token leads on; each place fails at most once, so the work is linear in the text. Two neighbours
are compatible when merging their joined bytes from scratch gives the same two again.
"""

from __future__ import annotations

from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobdelta.llm.common import binaries, bytes_of, once, sized, slices, texts_of
from jobdelta.llm.pretokens import UnitCache, Vocabulary, find, keep_used


class Encoder:
    """Exact ids of texts under one byte-level BPE file."""

    PAIRS = 1 << 17  # pairs remembered; a full memory starts anew
    RUN = 1 << 18  # bytes of pre-tokens that take their steps together
    FEW = 16  # pre-tokens below which each goes on alone

    def __init__(self, path: str):
        v = self.vocabulary = Vocabulary(path)
        #: for each id the pair it was merged from and the rank of that merge; bytes have none
        self.split = {made: pair for pair, made in zip(v.merges, v.made)}
        self.rank = {made: n for n, made in enumerate(v.made)}
        self.cross = {pair: n for n, pair in enumerate(v.merges)}
        self.automaton = ahocorasick.Automaton()
        self.whole: dict[bytes, int] = {}
        for n, token in v.tokens.items():
            if len(token) == 1 or n in self.split:
                self.automaton.add_word(token.decode("latin-1"), n << 32 | len(token) - 1)
                self.whole[token] = n
        self.automaton.make_automaton()
        self.size = np.zeros(max(v.tokens) + 2, dtype=np.int64)  # the last place stands for no token
        #: for each id the longest other token that its bytes begin with, or -1
        self.shorter = np.full(len(self.size), -1, dtype=np.int64)
        for token, n in self.whole.items():
            self.size[n] = len(token)
            self.shorter[n] = next((self.whole[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in self.whole), -1)
        #: pairs by a hash of both ids, and whether they are compatible; a later pair takes the place of an earlier one
        self.asked = np.full(self.PAIRS, -1, dtype=np.int64)
        self.agreed = np.zeros(self.PAIRS, dtype=bool)
        #: the merges as arrays: each pair and its rank in order of pair; of each id its rank, and what it was merged from
        known = sorted((a << 32 | b, n) for (a, b), n in self.cross.items()) or [(-1, 0)]
        self.crossing, self.crossed = np.array(known, dtype=np.int64).T.copy()
        self.ranks = np.full(len(self.size), -1, dtype=np.int64)
        self.parts = np.zeros((2, len(self.size)), dtype=np.int64)
        for n, pair in self.split.items():
            self.ranks[n] = self.rank[n]
            self.parts[:, n] = pair
        self.fits: dict[tuple[int, int], bool] = {}
        self.cache = UnitCache(self._units)
        self.made: dict[bytes, bytes] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both from scratch leaves the border between them."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= self.PAIRS:
                self.fits.clear()
            known = self.fits[left, right] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        # Undo the merges on both sides of the border from the latest to the earliest. While two symbols face
        # each other, a merge across the border must not come before the merge that ends that state: strictly
        # before one on the left (equal merges go left to right), not after one on the right.
        before = len(self.cross)
        while True:
            over = self.cross.get((left, right))
            if over is not None and over < before:
                return False
            a, b = self.rank.get(left, -1), self.rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                left, before = self.split[left][1], a
            else:
                right, before = self.split[right][0], b + 1

    def _borders_hold(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """`_border_holds` of many pairs, which are undone together."""
        out, who = np.zeros(len(left), dtype=bool), np.arange(len(left))
        before = np.full(len(left), len(self.cross), dtype=np.int64)
        while len(who):
            pair = left << 32 | right
            at = np.minimum(np.searchsorted(self.crossing, pair), len(self.crossing) - 1)
            going = (self.crossing[at] != pair) | (self.crossed[at] >= before)
            a, b = self.ranks[left], self.ranks[right]
            ends = (a < 0) & (b < 0)
            out[who[going & ends]] = True
            going &= ~ends
            who, left, right, a, b = who[going], left[going], right[going], a[going], b[going]
            later = a > b
            before = np.where(later, a, b + 1)
            left, right = np.where(later, self.parts[1][left], left), np.where(later, right, self.parts[0][right])
        return out

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """`compatible` of many pairs."""
        pair = left << 32 | right
        slot = ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % self.PAIRS
        out = self.agreed[slot]
        new = np.flatnonzero(self.asked[slot] != pair)
        if len(new):
            each, which = np.unique(pair[new], return_inverse=True)
            holds = self._borders_hold(each >> 32, each & 0xFFFFFFFF)
            out[new] = holds[which]
            slots = slot[new]
            self.asked[slots] = pair[new]
            self.agreed[slots] = out[new]
            # Of pairs that share a place the one that stands there gives the answer.
            self.agreed[slots] = holds[np.searchsorted(each, self.asked[slots])]
        return out

    def _longest(self, text: str) -> np.ndarray:
        """The longest token that begins at each place: of matches that begin together it ends last."""
        met = np.fromiter(chain.from_iterable(self.automaton.iter(text)), dtype=np.int64).reshape(-1, 2)
        longest = np.full(len(text) + 1, -1, dtype=np.int64)
        longest[met[:, 0] - (met[:, 1] & 0xFFFFFFFF)] = met[:, 1] >> 32
        return longest

    def pretoken(self, p: bytes) -> list[int]:
        if not p:
            return []
        longest, size, shorter = self._longest(p.decode("latin-1")).tolist(), self.size, self.shorter
        dead = set()
        ids: list[int] = []
        at, n = 0, longest[0]
        while at < len(p):
            while n >= 0 and (at + int(size[n]) in dead or ids and not self.compatible(ids[-1], n)):
                n = int(shorter[n])
            if n >= 0:
                ids.append(n)
                at += int(size[n])
                n = longest[at]
            else:
                dead.add(at)
                gone = ids.pop()
                at -= int(size[gone])
                n = int(shorter[gone])
        return ids

    def pretokens(self, ps: list[bytes]) -> list[bytes]:
        """The ids of each pre-token: `pretoken` of all of them, which take each step together."""
        text = "\u0100".join([p.decode("latin-1") for p in ps])  # no token holds this letter
        longest, size, shorter = self._longest(text), self.size, self.shorter
        length = np.array([len(p) for p in ps], dtype=np.int64)
        begin = np.cumsum(length + 1) - length - 1
        ids = np.zeros(len(text) + 1, dtype=np.int64)  # a pre-token's ids stand from its begin on
        until = begin.copy()  # where they end
        dead = np.zeros(len(text) + 1, dtype=bool)
        who = np.flatnonzero(length)
        first, stop, at, n = begin[who], (begin + length)[who], begin[who], longest[begin[who]]
        top = first.copy()  # where the next id goes
        while len(who) > self.FEW:
            to = at + size[n]
            takes = (n >= 0) & ~dead[to]
            ask = np.flatnonzero(takes & (top > first))
            takes[ask] = self._compatible(ids[top[ask] - 1], n[ask])
            back = np.flatnonzero(n < 0)
            n_next = shorter[n]
            ids[top[takes]] = n[takes]
            top += takes
            at = np.where(takes, to, at)
            n = np.where(takes, longest[at], n_next)
            if len(back):
                dead[at[back]] = True
                top[back] -= 1
                gone = ids[top[back]]
                at[back] -= size[gone]
                n[back] = shorter[gone]
            ended = at == stop
            if ended.any():
                until[who[ended]] = top[ended]
                on = ~ended
                who, first, stop, at, n, top = who[on], first[on], stop[on], at[on], n[on], top[on]
        blob = ids.astype("<u4").tobytes()
        out = [blob[4 * a : 4 * b] for a, b in zip(begin.tolist(), until.tolist())]
        for k in who.tolist():
            out[k] = np.asarray(self.pretoken(ps[k]), dtype="<u4").tobytes()
        return out

    def _units(self, strings: list[str]) -> list[bytes]:
        found = [find(s) for s in strings]
        made = self.made
        used = set().union(*found)
        keep_used(made, used, self.cache.limit)
        new = used.difference(made)
        for part in slices(list(new), self.RUN):
            made.update(zip(part, self.pretokens(part)))
        out = [b"".join(map(made.__getitem__, ps)) for ps in found]
        self.cache.drop_long(made, [new])
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        segments, plan = [], []
        for t in texts:
            plan.append([])
            for k, s in enumerate(self.vocabulary.segments(t)):
                if k % 2:
                    plan[-1].append(np.asarray([self.vocabulary.specials[s]], dtype="<u4").tobytes())
                elif s:
                    plan[-1].append(len(segments))
                    segments.append(s)
        made = [head + b"".join(rest) for head, rest in self.cache.values(segments)]
        return [b"".join(x if isinstance(x, bytes) else made[x] for x in steps) for steps in plan]


class Decoder:
    """Bytes of ids: all tokens in one array, and where each begins."""

    RUN = 1 << 13  # ids whose bytes are gathered at once

    def __init__(self, path: str):
        v = Vocabulary(path)
        tokens = v.tokens | {n: s.encode() for s, n in v.specials.items()}
        size = max(tokens) + 1
        self.length = np.zeros(size, dtype=np.int64)
        for n, t in tokens.items():
            self.length[n] = len(t)
        self.start = np.cumsum(self.length) - self.length
        self.blob = np.frombuffer(b"".join(tokens.get(n, b"") for n in range(size)), dtype=np.uint8)

    def bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, one after the other, and how many each has."""
        length = self.length[ids]
        parts = []
        for at in range(0, len(ids), self.RUN):  # index arrays that stay in the processor's cache
            n = length[at : at + self.RUN]
            ends = np.cumsum(n)
            total = int(ends[-1])
            parts.append(self.blob[np.arange(total) + np.repeat(self.start[ids[at : at + self.RUN]] - (ends - n), n)])
        return np.concatenate(parts) if parts else self.blob[:0], length


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of every whole text.

    A null or empty text has no ids; repeated rows and null ids of documents stay, row by row; other columns
    are ignored. `tokenizer_path` names a byte-level BPE file that every executor has; its special strings
    become their own ids where a text holds them.
    """

    def run(batches):
        encoder = once(f"encoder:{tokenizer_path}", lambda: Encoder(tokenizer_path))
        for big in batches:
            for b in sized(big, "text"):
                ids = [x for part in slices(b.column("text").to_pylist()) for x in encoder.ids(part)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return texts_of(docs).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids and the text that the ids stand for; bytes that are no UTF-8 become U+FFFD."""

    def run(batches):
        decoder = once(f"decoder:{tokenizer_path}", lambda: Decoder(tokenizer_path))
        for big in batches:
            for b in sized(big, "ids"):
                data, ends = bytes_of(b.column("ids"))
                raw, length = decoder.bytes(data.view("<u4") if data.flags.aligned else np.frombuffer(data.tobytes(), "<u4"))
                at = np.r_[0, np.cumsum(length)][ends // 4]
                texts = binaries(raw, np.diff(at))
                try:
                    texts = texts.cast(pa.string())  # checks that it is UTF-8
                except pa.ArrowInvalid:
                    texts = pa.array([x.decode("utf-8", "replace") for x in texts.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), texts], names=["doc_id", "ids", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("ids", F.lit(b"")).alias("ids")).mapInArrow(run, "doc_id long, ids binary, text string")
