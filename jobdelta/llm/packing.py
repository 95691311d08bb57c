"""Best-fit packing of documents into fixed-length sequences by a grouping genetic algorithm.

The groups are bins (sequences). Crossover injects whole well-filled bins of one parent into another, removes
the bins that would hold a document twice, and places the displaced documents anew: bins first exchange one or two
documents for displaced ones that fill them better, then best fit places the rest, longest first.

Documents are dealt at random to blocks of bounded size. Each block is solved by several islands, each a task
of its own; between epochs every island sends its elite to the next one. Bins that remain poorly filled in
their block are dissolved and their documents dealt to fewer blocks, until one block is left.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobdelta.llm.common import binaries, once, sized, texts_of, written
from jobdelta.llm.pretokens import PATTERN, Vocabulary

CAPACITY = 2048
BLOCK = 4096  # documents that one block holds on average
ISLANDS, POPULATION, GENERATIONS, EPOCHS = 2, 4, 4, 2
SECONDS = 6  # larger halves of a pair that an exchange tries
WELL_FILLED = 0.995  # bins below this share of the capacity are dealt anew
TAIL = 8  # of a block's least filled bins, dealt anew when almost none is well filled


# ---- tokens and pieces ------------------------------------------------------------------------------------


class Tokenizer:
    """Ids of texts as the tokenizers library gives them, by the quicker of two libraries that agree.

    tiktoken, given the same vocabulary, encodes texts without special strings whose characters all Unicode
    versions class alike; tokenizers itself encodes the others.
    """

    def __init__(self, path: str):
        import os

        import tiktoken
        from tokenizers import Tokenizer as Library

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Library.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        v = Vocabulary(path)
        self.specials = tuple(v.specials)
        self.quick = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks={t: n for n, t in v.tokens.items()}, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.uint32)
        if max(text) < "\u0530" and not any(s in text for s in self.specials):
            return self.quick.encode_to_numpy(text, disallowed_special=())
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def cut_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Token pieces of every whole text: key, doc_id, piece, start, length, ids.

    A document is its ids and then `end_id`, so that a null or empty text is one piece of length 1. A longer
    one than `capacity` becomes pieces of that length, of which the first may be shorter. `key` (long) is one
    number per piece, also for repeated rows and null ids; it holds within one evaluation, so write the rows
    before using it twice. `ids` is binary, little-endian unsigned 32-bit. Other columns are ignored.
    """

    def run(batches):
        tokenizer = once(f"tokenizer:{tokenizer_path}", lambda: Tokenizer(tokenizer_path))
        key = TaskContext.get().partitionId() << 36
        for big in batches:
            for b in sized(big, "text"):
                out: list[tuple[int, int, int, int]] = []
                data = []
                for row, text in enumerate(b.column("text").to_pylist()):
                    ids = tokenizer.ids(text)
                    n = len(ids) + 1
                    data.append(ids.astype("<u4", copy=False).tobytes() + end_id.to_bytes(4, "little"))
                    first = n % capacity or capacity
                    starts = [0, *range(first, n, capacity)]
                    out += [(row, k, s, (starts[k + 1] if k + 1 < len(starts) else n) - s) for k, s in enumerate(starts)]
                rows, piece, start, length = (np.asarray(x, dtype=np.int64) for x in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key + np.arange(len(rows))), b.column("doc_id").take(pa.array(rows)), pa.array(piece.astype(np.int32)),
                     pa.array(start), pa.array(length), binaries(b"".join(data), length * 4)],
                    names=["key", "doc_id", "piece", "start", "length", "ids"])
                key += len(rows)

    return texts_of(docs).mapInArrow(run, "key long, doc_id long, piece int, start long, length long, ids binary")


# ---- one solution -----------------------------------------------------------------------------------------


def best_fit(sizes: np.ndarray, bins: np.ndarray, loose: np.ndarray, capacity: int) -> np.ndarray:
    """Place the documents `loose` into the bins that `bins` (bin of each document, -1: none) already opens.

    Longest first, each into the open bin that it fills best, else into a new one. Bins are renumbered from 0.
    """
    placed = np.flatnonzero(bins >= 0)
    bins = bins.copy()
    _, bins[placed] = np.unique(bins[placed], return_inverse=True)
    count = int(bins[placed].max()) + 1 if len(placed) else 0
    free = capacity - np.bincount(bins[placed], weights=sizes[placed], minlength=count).astype(np.int64)
    by_room: dict[int, list[int]] = {}
    for b in np.flatnonzero(free > 0).tolist():
        by_room.setdefault(int(free[b]), []).append(b)
    rooms = sum(1 << r for r in by_room)  # bit r: some bin has room r
    order = loose[np.argsort(-sizes[loose], kind="stable")]
    for item, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            own = by_room[room]
            b = own.pop()
            if not own:
                rooms ^= 1 << room
        else:
            b, room = count, capacity
            count += 1
        bins[item] = b
        if room > size:
            own = by_room.setdefault(room - size, [])
            if not own:
                rooms |= 1 << (room - size)
            own.append(b)
    return bins


def exchange(sizes: np.ndarray, bins: np.ndarray, loose: np.ndarray, capacity: int) -> np.ndarray:
    """`bins` after each open bin gave up one or two documents for one or two loose ones that fill it better.

    Documents given up are loose then, and mostly smaller, so the rest fits more easily. Bins are tried from the
    fullest on; of all exchanges of a bin the one that fills it most is made.
    """
    if not len(loose) or not (bins >= 0).any():
        return bins
    bins = bins.copy()
    placed = np.flatnonzero(bins >= 0)
    free = capacity - np.bincount(bins[placed], weights=sizes[placed]).astype(np.int64)
    order = placed[np.argsort(bins[placed], kind="stable")]
    cuts = np.searchsorted(bins[order], np.arange(len(free) + 1))
    size_of = sizes.tolist()
    pool = sorted((size_of[i], i) for i in loose.tolist())
    for b in np.argsort(free, kind="stable").tolist():
        room, own = int(free[b]), order[cuts[b] : cuts[b + 1]].tolist()
        if not room or not own or not pool:
            continue
        gain, out, taken = 0, (), ()
        ways = [(size_of[i], (i,)) for i in own] + [(size_of[i] + size_of[j], (i, j)) for n, i in enumerate(own) for j in own[:n]]
        for size, given in ways:
            k = bisect_right(pool, (size + room, len(size_of))) - 1
            if k >= 0 and pool[k][0] - size > gain:
                gain, out, taken = pool[k][0] - size, given, (k,)
            if len(given) == 1 and gain < room:
                last = bisect_right(pool, (size + room - pool[0][0], len(size_of))) - 1
                for k in range(last, max(-1, last - SECONDS), -1):  # the larger of two loose ones, then the best second
                    n = bisect_right(pool, (size + room - pool[k][0], len(size_of)), 0, k) - 1
                    if n >= 0 and pool[k][0] + pool[n][0] - size > gain:
                        gain, out, taken = pool[k][0] + pool[n][0] - size, given, (k, n)
            if gain == room:
                break
        if not gain:
            continue
        for k in sorted(taken, reverse=True):
            bins[pool.pop(k)[1]] = b
        for i in out:
            bins[i] = -1
            insort(pool, (size_of[i], i))
    return bins


def refit(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Displaced documents (bin -1) placed again: exchanged first, the rest by best fit."""
    bins = exchange(sizes, bins, np.flatnonzero(bins < 0), capacity)
    return best_fit(sizes, bins, np.flatnonzero(bins < 0), capacity)


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> float:
    """Few bins first, then bins as unevenly filled as can be: room gathered in few bins can be used again."""
    fill = np.bincount(bins, weights=sizes) / capacity
    return float(-len(fill) + np.mean(fill * fill))


def crossover(sizes: np.ndarray, one: np.ndarray, other: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """`one` with well-filled bins of `other` injected whole."""
    fill = np.bincount(other, weights=sizes)
    good = np.flatnonzero(fill >= np.quantile(fill, 0.3))
    chosen = np.zeros(len(fill), dtype=bool)
    chosen[rng.choice(good, size=max(1, len(good) // 3), replace=False)] = True
    injected = chosen[other]
    broken = np.zeros(int(one.max()) + 1, dtype=bool)
    broken[one[injected]] = True  # bins that hold a document a second time
    child = np.where(broken[one], -1, one)
    child[injected] = other[injected] + len(broken)
    return refit(sizes, child, capacity)


def mutate(sizes: np.ndarray, bins: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Dissolve the least filled bins and a few others, and place their documents anew."""
    fill = np.bincount(bins, weights=sizes)
    gone = np.zeros(len(fill), dtype=bool)
    gone[np.argsort(fill, kind="stable")[: max(1, len(fill) // 20)]] = True
    gone[rng.choice(len(fill), size=max(1, len(fill) // 20), replace=False)] = True
    return refit(sizes, np.where(gone[bins], -1, bins), capacity)


def first_population(sizes: np.ndarray, capacity: int, size: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Best fit of all documents, and variants whose first documents were placed in a random order."""
    none = np.full(len(sizes), -1)
    out = [best_fit(sizes, none, np.arange(len(sizes)), capacity)]
    while len(out) < size:
        out.append(mutate(sizes, out[0], capacity, rng))
    return out


def evolve(sizes: np.ndarray, population: list[np.ndarray], capacity: int, generations: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The population after some generations, best first; the best is never lost."""
    floor = -(-int(sizes.sum()) // capacity)
    keep = len(population)
    scored = sorted(((fitness(sizes, b, capacity), n, b) for n, b in enumerate(population)), key=lambda x: (-x[0], x[1]))
    for _ in range(generations):
        if int(scored[0][2].max()) + 1 == floor:
            break
        children = []
        for _ in range(max(1, keep // 2)):
            a, b = rng.choice(len(scored), size=2, replace=len(scored) < 2)
            children.append(mutate(sizes, crossover(sizes, scored[a][2], scored[b][2], capacity, rng), capacity, rng))
        scored = sorted(scored + [(fitness(sizes, c, capacity), keep + n, c) for n, c in enumerate(children)], key=lambda x: (-x[0], x[1]))[:keep]
    return [b for _, _, b in scored]


# ---- islands ----------------------------------------------------------------------------------------------

_STATE = "block long, island int, rank int, items binary, sizes binary, bins binary"


def _seed(capacity: int, islands: int, size: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        items, sizes = pdf["key"].to_numpy(np.int64), pdf["length"].to_numpy(np.int64)
        rows = []
        for island in range(islands):
            rng = np.random.default_rng([int(key[0]), island])
            for rank, bins in enumerate(first_population(sizes, capacity, size, rng)):
                rows.append((int(key[0]), island, rank, items.tobytes(), sizes.astype(np.int32).tobytes(), bins.astype(np.int32).tobytes()))
        return pd.DataFrame(rows, columns=["block", "island", "rank", "items", "sizes", "bins"])

    return run


def _epoch(capacity: int, generations: int, size: int, number: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="stable")
        sizes = np.frombuffer(pdf["sizes"].iloc[0], dtype=np.int32).astype(np.int64)
        population = [np.frombuffer(b, dtype=np.int32).astype(np.int64) for b in pdf["bins"]]
        rng = np.random.default_rng([int(key[0]), int(key[1]), number])
        best = evolve(sizes, population, capacity, generations, rng)[:size]
        return pd.DataFrame({"block": int(key[0]), "island": int(key[1]), "rank": range(len(best)), "items": pdf["items"].iloc[0],
                             "sizes": pdf["sizes"].iloc[0], "bins": [b.astype(np.int32).tobytes() for b in best]})

    return run


def _solve(items: DataFrame, blocks: int, level: int, capacity: int) -> DataFrame:
    """key, length, block, bin, fill of each document under the best solution of its block."""
    state = (items.withColumn("block", F.pmod(F.xxhash64(F.col("key"), F.lit(level)), F.lit(blocks)))
             .groupBy("block").applyInPandas(_seed(capacity, ISLANDS, POPULATION), _STATE))
    for n in range(EPOCHS):
        if n:  # each island's elite goes to the next island of its block
            elite = state.filter("rank = 0").withColumn("island", ((F.col("island") + 1) % ISLANDS).cast("int")).withColumn("rank", F.lit(POPULATION))
            state = written(state.union(elite), "packing-islands")
        state = state.groupBy("block", "island").applyInPandas(_epoch(capacity, GENERATIONS, POPULATION, n), _STATE)

    def best(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = np.frombuffer(pdf["sizes"].iloc[0], dtype=np.int32).astype(np.int64)
        found = [np.frombuffer(b, dtype=np.int32).astype(np.int64) for b in pdf.sort_values("island", kind="stable")["bins"]]
        bins = max(found, key=lambda b: fitness(sizes, b, capacity))
        order = np.lexsort((-sizes, bins))
        own, size = bins[order], sizes[order]
        before = np.cumsum(size) - size
        first = np.r_[True, own[1:] != own[:-1]]
        offset = before - np.maximum.accumulate(np.where(first, before, 0))
        return pd.DataFrame({"key": np.frombuffer(pdf["items"].iloc[0], dtype=np.int64)[order], "length": size, "block": int(key[0]),
                             "bin": own, "offset": offset, "fill": np.bincount(bins, weights=sizes)[own].astype(np.int64)})

    return state.filter("rank = 0").groupBy("block").applyInPandas(best, "key long, length long, block long, bin long, offset long, fill long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """key, sequence_id and offset of every row of `pieces` (key unique long, length 1 to `capacity`).

    Offsets in a sequence begin at 0 and leave no gap. Equal lengths are told apart by key alone, so ties have
    one outcome; an empty table gives an empty one. Rows must be repeatable: write them first.
    """
    spark = pieces.sparkSession
    full = pieces.filter(F.col("length") >= capacity).select("key", F.col("key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = pieces.filter(F.col("length") < capacity).select("key", "length")
    done, level = [full], 1
    count = items.count()
    blocks = max(1, -(-count // block))
    while count:
        solved = written(_solve(items, blocks, level, capacity), "packing-solved")
        # Sequences of their own are numbered by key; the others by level, block and bin, below zero.
        number = -((F.lit(level).cast("long") * (1 << 56)) + F.col("block") * (1 << 20) + F.col("bin"))
        if blocks == 1:
            done.append(solved.select("key", number.alias("sequence_id"), "offset"))
            break
        well = F.col("fill") >= F.lit(int(capacity * WELL_FILLED))
        left = solved.filter(~well).count()
        fewer = blocks
        if left > count * 9 // 10:  # almost nothing fills a sequence well, nor would other mixtures: only each block's least filled go on
            worst = solved.filter(~well).groupBy("block", "bin").agg(F.first("fill").alias("fill")) \
                .withColumn("nth", F.row_number().over(Window.partitionBy("block").orderBy("fill", "bin"))).filter(F.col("nth") <= TAIL)
            solved = written(solved.join(worst.select("block", "bin", F.lit(True).alias("worst")), ["block", "bin"], "left"), "packing-tails")
            well = F.col("worst").isNull()
            left, fewer = solved.filter(~well).count(), blocks // 2
        done.append(solved.filter(well).select("key", number.alias("sequence_id"), "offset"))
        items = solved.filter(~well).select("key", "length")
        count, level, blocks = left, level + 1, max(1, min(fewer, -(-left // block)))
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` with sequence_id and offset."""
    return pieces.join(pack(pieces.select("key", "length"), capacity), "key")


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, length and ids (binary) of the packed sequences, from pieces that still carry ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.concat_ws("", F.transform(parts, lambda p: F.hex(p["ids"]))).alias("ids")) \
        .withColumn("ids", F.unhex("ids"))
