"""The trie of conversation prefixes: ternary search trees per range shard, merged at the shards' borders.

A turn is known by a digest and its number of words. Rebuilt conversations are cut into bands of at most 64 turns;
a band's rows hang below the node that its earlier turns lead to, so no row and no group grows with a conversation.
The rows of a band are range-partitioned in lexicographic order and read in blocks. Each block numbers its turns by
a sorted dictionary, inserts its distinct sequences into ternary search trees from the median outwards, which keeps
them balanced, and sums members, leaves and savings from the last node to the first. Only nodes on the path of a
block's first or last sequence can be met by another block: they leave as partial sums and are merged by key, their
own subtrees added along their (at most 64) ancestors. Bands are finished from the deepest that two conversations
share up to the first; where a conversation is alone its nodes follow without a trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobdelta.llm.common import written

GROUP = 20  # conversations from a multiple of it on share the first turns of that one
BAND = 64  # turns of a row
BLOCK_ROWS = 1 << 13  # sequences of one set of search trees
TURNS_OF_A_JOIN = 4096  # turns of a conversation that meet its row in one join key
COPIES = 16  # of small tables whose keys may be very common on the other side
PIECE = 1 << 16  # bytes of joined ids in a row

_ITEM = 24  # 16 bytes of digest, 8 of words
_ROOT = bytes(16)
_NO_ENDS = hashlib.sha256(b"").hexdigest()

# ---- conversations -----------------------------------------------------------------------------------------


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, item of every row with a conv_id."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    words = F.lpad(F.hex(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")), 16, "0")
    return conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.concat(digest, words)).alias("item"))


def _placed(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), item: places by ranges of all rows and one border row each, so a conversation may span tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            conv = b.column("conv_id").to_numpy()
            new = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
            at = np.arange(len(conv)) - np.repeat(new, np.diff(np.append(new, len(conv))))
            if conv[0] == last:
                at[: new[1] if len(new) > 1 else len(conv)] += seen
            last, seen = conv[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), part)), b.column("conv_id"), pa.array(at), b.column("item")], names=["part", "conv_id", "at", "item"])

    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("item")]
    sorted_ = turns.repartitionByRange(*order).sortWithinPartitions(*order).drop("turn")
    local = written(sorted_.mapInArrow(run, "part long, conv_id long, at long, item binary"), "trie-turns")
    borders = local.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "at")).alias("last")).orderBy("part").collect()  # a row per range
    carried, open_ = [], (None, 0)
    for r in borders:
        before = open_[1] if open_[0] == r["first"] else 0
        if before:
            carried.append((r["part"], r["first"], before))
        open_ = (r["last"]["conv_id"], r["last"]["at"] + 1 + (before if r["last"]["conv_id"] == r["first"] else 0))
    if not carried:
        return local.select("conv_id", F.col("at").alias("pos"), "item")
    # At most a row per range.
    more = F.broadcast(turns.sparkSession.createDataFrame(carried, "part long, conv_id long, before long"))
    return local.join(more, ["part", "conv_id"], "left").select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "item")


def _key(before: Column | str, path: Column | str) -> Column:
    """The node that `path` leads to below the node `before`."""
    return F.when(F.octet_length(path) == 0, F.col(before) if isinstance(before, str) else before).otherwise(F.unhex(F.md5(F.concat(before, path))))


def _chained(segments: DataFrame) -> DataFrame:
    """The rows of long conversations with the node below which each band stands."""

    def run(batches):
        conv, before = None, _ROOT
        for b in batches:
            out = []
            for c, path in zip(b.column("conv_id").to_pylist(), b.column("path").to_pylist()):
                if c != conv:
                    conv, before = c, _ROOT
                out.append(before)
                before = hashlib.md5(before + path).digest()
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("band"), pa.array(out, pa.binary()), b.column("path"), b.column("goes_on")],
                                             names=["conv_id", "band", "before", "path", "goes_on"])

    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "band").mapInArrow(run, "conv_id long, band long, before binary, path binary, goes_on boolean")


def rebuilt(conversations: DataFrame, band: int = BAND) -> DataFrame:
    """conv_id, band, before, path, goes_on: every rebuilt conversation in rows of at most `band` turns.

    A conversation takes the first h turns of the one at its group's start in place of its own first h, where h
    comes from its id. One that keeps no turn has a row with an empty path.
    """
    turns = _placed(_turns(conversations))
    of_group = F.col("conv_id") % GROUP
    heads = turns.filter((of_group == 0) & (F.col("pos") < 3)).groupBy(F.col("conv_id").alias("base")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("heads"))  # at most three
    convs = turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("n")).withColumn("base", F.col("conv_id") - of_group) \
        .withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")).join(heads, "base", "left") \
        .select("conv_id", "n", "h", F.coalesce(F.expr("slice(heads, 1, h)"), F.array().cast("array<binary>")).alias("head"))
    convs = written(convs.withColumn("total", F.size("head") + F.greatest(F.lit(0), F.col("n") - F.col("h"))), "trie-conversations")
    # A long conversation's turns meet its row under many keys.
    meets = convs.select("conv_id", "h", F.size("head").alias("k"), "total", F.explode(F.expr(f"sequence(0, (n - 1) div {TURNS_OF_A_JOIN})")).alias("run"))
    own = turns.withColumn("run", F.expr(f"pos div {TURNS_OF_A_JOIN}")).join(meets, ["conv_id", "run"]).filter("pos >= h") \
        .select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).cast("long").alias("at"), "item", F.col("total").cast("long").alias("total"))
    taken = convs.select("conv_id", F.posexplode("head").alias("at", "item"), "total").select("conv_id", F.col("at").cast("long").alias("at"), "item", F.col("total").cast("long").alias("total"))
    path = F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "item"))), lambda x: F.hex(x["item"])), ""))  # at most `band` turns
    rows = own.union(taken).groupBy("conv_id", F.expr(f"at div {band}").alias("band")).agg(path.alias("path"), F.max("total").alias("total"))
    rows = written(rows.withColumn("goes_on", F.col("total") > (F.col("band") + 1) * band), "trie-rows")
    root = F.lit(_ROOT)
    short = rows.filter(F.col("total") <= band).select("conv_id", "band", root.alias("before"), "path", "goes_on")
    none = convs.filter("total = 0").select("conv_id", F.lit(0).cast("long").alias("band"), root.alias("before"), F.lit(b"").alias("path"), F.lit(False).alias("goes_on"))
    return written(short.union(none).union(_chained(rows.filter(F.col("total") > band).drop("total"))), "trie-segments")


# ---- ternary search trees ----------------------------------------------------------------------------------


class Trees:
    """The tries of a block of sequences, one below each `before`; a node's children form a binary search tree of codes."""

    def __init__(self):
        self.code, self.low, self.high, self.child = [], [], [], []  # child: root of the children's search tree
        self.up, self.depth, self.key, self.words = [], [], [], []
        self.n, self.conv, self.tail = [], [], []

    def _add(self, code: int, up: int, depth: int, key: bytes, words: int) -> int:
        for column, v in ((self.code, code), (self.low, -1), (self.high, -1), (self.child, -1), (self.up, up), (self.depth, depth), (self.key, key), (self.words, words),
                          (self.n, 0), (self.conv, None), (self.tail, None)):
            column.append(v)
        return len(self.code) - 1

    def root(self, before: bytes) -> int:
        return self._add(-1, -1, 0, before, 0)

    def _step(self, node: int, code: int) -> tuple[int, bool]:
        """The child of a node with this code, or the place where it belongs: (node or last met, found)."""
        at = met = self.child[node]
        while at >= 0:
            met = at
            if code == self.code[at]:
                return at, True
            at = self.low[at] if code < self.code[at] else self.high[at]
        return met, False

    def insert(self, root: int, before: bytes, path: bytes, codes: list[int], count: int, conv: int, tail) -> int:
        node = root
        self._count(node, count, conv)
        for d, code in enumerate(codes):
            at, found = self._step(node, code)
            if not found:
                end = (d + 1) * _ITEM
                new = self._add(code, node, d + 1, hashlib.md5(before + path[:end]).digest(), int.from_bytes(path[end - 8 : end], "big"))
                if at < 0:
                    self.child[node] = new
                elif code < self.code[at]:
                    self.low[at] = new
                else:
                    self.high[at] = new
                at = new
            node = at
            self._count(node, count, conv)
        if tail is not None:
            self.tail[node] = tail
        return node

    def _count(self, node: int, count: int, conv: int) -> None:
        self.n[node] += count
        self.conv[node] = conv if self.conv[node] is None else min(self.conv[node], conv)

    def path(self, node: int) -> list[int]:
        """Nodes from the root to this one."""
        out = []
        while node >= 0:
            out.append(node)
            node = self.up[node]
        return out[::-1]


def _median_first(n: int) -> Iterator[int]:
    """0 .. n - 1, every range's middle before its halves."""
    todo = [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            todo += [(mid + 1, hi), (lo, mid)]


def build(rows: list[tuple[bytes, bytes, int, tuple | None]]) -> tuple[Trees, set[int]]:
    """The trees of sorted rows (before, path, conv_id, tail), and the nodes that a neighbouring block may hold too."""
    distinct: list[list] = []
    for before, path, conv, tail in rows:
        if distinct and distinct[-1][0] == before and distinct[-1][1] == path:
            d = distinct[-1]
            d[2], d[3], d[4] = d[2] + 1, min(d[3], conv), tail if d[4] is None else d[4]
        else:
            distinct.append([before, path, 1, conv, tail])
    items = np.frombuffer(b"".join(d[1] for d in distinct), dtype=f"S{_ITEM}")
    _, codes = np.unique(items, return_inverse=True)  # the block's dictionary: codes sort like turns
    codes = codes.tolist()
    ends = np.cumsum([0] + [len(d[1]) // _ITEM for d in distinct]).tolist()
    trees, node_of = Trees(), [0] * len(distinct)
    start = 0
    while start < len(distinct):
        stop, before = start, distinct[start][0]
        while stop < len(distinct) and distinct[stop][0] == before:
            stop += 1
        root = trees.root(before)
        for i in _median_first(stop - start):
            _, path, count, conv, tail = distinct[start + i]
            node_of[start + i] = trees.insert(root, before, path, codes[ends[start + i] : ends[start + i + 1]], count, conv, tail)
        start = stop
    return trees, set(trees.path(node_of[0])) | set(trees.path(node_of[-1]))


_NODE = ("key binary, up binary, depth int, conv_id long, parent long, n long, children long, leaves long, saved long, "
         "words long, shared boolean, above array<binary>, tail_children long, tail_leaves long, tail_saved long")


def _totals(trees: Trees, border: set[int]) -> list[list]:
    """Columns of _NODE: whole sums for inner nodes; for border nodes what inner children add."""
    size = len(trees.code)
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    for v in range(size - 1, -1, -1):  # children stand behind their parents
        if v in border:
            continue
        if trees.tail[v]:
            children[v] += trees.tail[v][0]
            leaves[v] += trees.tail[v][1]
            saved[v] += trees.tail[v][2]
        leaves[v] += children[v] == 0
        saved[v] += (trees.n[v] - 1) * trees.words[v]
        u = trees.up[v]
        if u >= 0:
            children[u] += 1
            leaves[u] += leaves[v]
            saved[u] += saved[v]
    up = trees.up
    tails = [trees.tail[v] if v in border and trees.tail[v] else (None, None, None) for v in range(size)]
    return [trees.key, [trees.key[u] if u >= 0 else None for u in up], trees.depth, trees.conv, [trees.conv[u] if u >= 0 and u not in border else None for u in up],
            trees.n, children, leaves, saved, trees.words, [v in border for v in range(size)],
            [[trees.key[a] for a in trees.path(v)] if v in border else None for v in range(size)], *[list(c) for c in zip(*tails)]]


def _shard(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    types = [pa.binary(), pa.binary(), pa.int32()] + [pa.int64()] * 7 + [pa.bool_(), pa.list_(pa.binary())] + [pa.int64()] * 3
    names = [c.split()[0] for c in _NODE.split(", ")]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(_totals(*build(rows)), types)], names=names)

    rows: list = []
    for b in batches:
        for before, path, conv, *tail in zip(*[b.column(c).to_pylist() for c in ("before", "path", "conv_id", "tail_children", "tail_leaves", "tail_saved")]):
            rows.append((before, path, conv, None if tail[0] is None else tuple(tail)))
            if len(rows) == block_rows:
                yield out(rows)
                rows = []
    if rows:
        yield out(rows)


# ---- merging -----------------------------------------------------------------------------------------------


def _looked_up(rows: DataFrame, by: str, small: DataFrame, salt: Column) -> DataFrame:
    """Left join of `rows` with the table `small` (unique in `by`), whose rows are copied so that no key is met in one task."""
    copied = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(salt), F.lit(COPIES)).cast("int")).join(copied, [by, "salt"], "left").drop("salt")


def _band_nodes(rows: DataFrame, block_rows: int) -> DataFrame:
    """key, up, depth (in the band), conv_id, parent, n, children, leaves, saved of all nodes below the rows' `before`, these included."""
    order = ["before", "path", "conv_id"]
    raw = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda it: _shard(it, block_rows), _NODE), "trie-nodes")
    border = written(raw.filter("shared").groupBy("key").agg(
        F.min("up").alias("up"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")],
        F.max("words").alias("words"), F.first("above").alias("above"), *[F.max(c).alias(c) for c in ("tail_children", "tail_leaves", "tail_saved")]), "trie-border")
    kids = border.filter("up is not null").groupBy(F.col("up").alias("key")).agg(F.count(F.lit(1)).alias("kids"))
    tail = lambda c: F.coalesce(f"tail_{c}", F.lit(0))
    own = border.join(kids, "key", "left").withColumn("children", F.col("children") + F.coalesce("kids", F.lit(0)) + tail("children")) \
        .withColumn("leaves", F.col("leaves") + tail("leaves") + F.when(F.col("children") == 0, 1).otherwise(0)) \
        .withColumn("saved", F.col("saved") + tail("saved") + (F.col("n") - 1) * F.col("words"))
    sums = own.select(F.explode("above").alias("key"), "leaves", "saved").groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    named = border.select(F.col("key").alias("up"), F.col("conv_id").alias("found"))
    columns = ["key", "up", "depth", "conv_id", "parent", "n", "children", "leaves", "saved"]
    merged = _looked_up(own.drop("leaves", "saved").join(sums, "key"), "up", named, F.col("key")).withColumn("parent", F.col("found")).select(*columns)
    inner = raw.filter("not shared")
    done = inner.filter("parent is not null or up is null").select(*columns)
    open_ = _looked_up(inner.filter("parent is null and up is not null"), "up", named, F.col("key")).withColumn("parent", F.col("found")).select(*columns)
    return written(merged.union(done).union(open_), "trie-band")


def _end_hashes(rows: DataFrame) -> DataFrame:
    """key, ends: SHA-256 of the ascending ids of each key, joined by commas.

    A digest reads its input in order, so a key's ids pass one task in the end; they are joined into pieces by
    ranges of (key, id) before, and pass it as a stream.
    """

    def pieces(batches):
        key, first, text = None, None, []
        size = 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(text)])], names=["key", "first", "piece"])

        for b in batches:
            for k, c in zip(b.column("key").to_pylist(), b.column("conv_id").to_pylist()):
                if k != key or size > PIECE:
                    if text:
                        yield out()
                    key, first, text, size = k, c, [], 0
                text.append(str(c))
                size += len(text[-1]) + 1
        if text:
            yield out()

    def hashes(batches):
        key, h = None, None
        for b in batches:
            done = []
            for k, piece in zip(b.column("key").to_pylist(), b.column("piece").to_pylist()):
                if k == key:
                    h.update(b"," + piece.encode())
                    continue
                if h:
                    done.append((key, h.hexdigest()))
                key, h = k, hashlib.sha256(piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], names=["key", "ends"])
        if h:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()])], names=["key", "ends"])

    joined = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(pieces, "key binary, first long, piece string")
    return joined.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashes, "key binary, ends string")


def prefix_trie(conversations: DataFrame, band: int = BAND, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    Rows without a conv_id belong to no conversation and are left out. A null role or text is empty; a null turn
    comes first; turns of equal number stand in the order of their MD5 (byte length of the role, a colon, role,
    text), so repeated rows are repeated turns. A conversation without turns of its own left ends at the root or
    where its group's turns end. Texts and conversations may be of any length. An empty table has no node.
    Further columns play no part.
    """
    rows = rebuilt(conversations, band)
    deepest, apart = rows.agg(F.max("band")).first()[0], None
    later = rows.filter("band > 0")
    if deepest:
        # Which bands below the first hang on a node that several conversations pass.
        many = written(later.groupBy("before").agg(F.count(F.lit(1)).alias("passing")).filter("passing > 1"), "trie-shared")
        later = written(_looked_up(later, "before", many, F.col("conv_id")), "trie-later")
        deepest = later.filter("passing is not null").agg(F.max("band")).first()[0] or 0
        apart = later.filter("passing is null")
        later = later.filter("passing is not null").drop("passing")
    nodes, below = [], None
    for at in range(deepest or 0, -1, -1):
        own = rows.filter("band = 0") if at == 0 else later.filter(F.col("band") == at)
        own = own.withColumn("next", F.when(F.col("goes_on"), _key("before", "path")))
        if below is None:
            found = own.withColumns({c: F.lit(None).cast("long") for c in ("children", "leaves", "saved")})
        else:
            found = _looked_up(own, "next", below, F.col("conv_id"))
        alone = {"children": 1, "leaves": 1, "saved": 0}  # below a node that one conversation alone passes
        found = found.select("before", "path", "conv_id", *[F.when(F.col("goes_on"), F.coalesce(c, F.lit(v))).cast("long").alias(f"tail_{c}") for c, v in alone.items()])
        found = _band_nodes(found, block_rows)
        below = found.filter("depth = 0").select(F.col("key").alias("next"), "children", "leaves", "saved")
        inner = found if at == 0 else found.filter("depth > 0")
        nodes.append(inner.withColumn("whole", F.col("depth") + F.lit(at * band)))
    all_ = nodes[0]
    for more in nodes[1:]:
        all_ = all_.union(more)
    ended = rows.filter("band = 0") if apart is None else rows.filter("band = 0").unionByName(later)
    ends = _end_hashes(ended.filter("not goes_on").select(_key("before", "path").alias("key"), "conv_id"))
    out = all_.join(ends, "key", "left").select("conv_id", F.col("whole").cast("long").alias("depth"), "parent", "n", "children", "leaves", "saved",
                                                F.coalesce("ends", F.lit(_NO_ENDS)).alias("ends"), F.when((F.col("depth") == 1) & (F.col("whole") > 1), F.col("up")).alias("up"))
    if apart is not None:
        digest = F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
        turns = F.expr(f"octet_length(path) div {_ITEM}")
        single = apart.withColumn("turns", turns).withColumn("at", F.explode(F.expr("sequence(1, turns)"))).withColumn("last", ~F.col("goes_on") & (F.col("at") == F.col("turns")))
        out = out.union(single.select("conv_id", F.col("band") * band + F.col("at"), "conv_id", F.lit(1).cast("long"), F.when(F.col("last"), 0).otherwise(1).cast("long"), F.lit(1).cast("long"),
                                      F.lit(0).cast("long"), F.when(F.col("last"), digest).otherwise(_NO_ENDS), F.when(F.col("at") == 1, F.col("before"))))
        # The first node of a band: its parent is the last one of the band above, where that is shared.
        named = all_.filter(F.col("depth") == band).select(F.col("key").alias("up"), F.col("conv_id").alias("found"))
        firsts = _looked_up(out.filter("up is not null"), "up", named, F.col("conv_id")).withColumn("parent", F.coalesce("found", "parent"))
        out = out.filter("up is null").drop("up").union(firsts.drop("found").select(*[c for c in out.columns if c != "up"]))
    return out.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
                      F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


# ---- SQL twin ----------------------------------------------------------------------------------------------

_CRC = """xor(list_reduce(list_concat([4294967295::bigint], [ascii(c)::bigint for c in string_split(conv_id::varchar, '')]),
    lambda a, b: list_reduce(list_concat([xor(a, b)], range(1, 9)), lambda x, i: xor(x >> 1, case when x & 1 = 1 then 3988292384::bigint else 0::bigint end))), 4294967295::bigint)"""

#: All pairs of nodes and their prefixes, as text paths of turn digests.
ORACLE = rf"""with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
m as (select conv_id, turn, md5(strlen(role) || ':' || role || text) as item, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words from t),
w as (select item, any_value(words) as words from m group by item),
o as (select conv_id, list(item order by turn nulls first, item) as own from m group by conv_id),
h as (select conv_id, own, ({_CRC}) % 4 as h from o),
r as (select c.conv_id, list_concat(coalesce(b.own, [])[1:c.h], c.own[c.h + 1:]) as seq from h c left join o b on b.conv_id = c.conv_id - c.conv_id % {GROUP}),
p as (select conv_id, len(seq) as total, unnest(range(0, len(seq) + 1)) as depth, seq from r),
q as (select conv_id, total, depth, array_to_string(list_transform(seq[1:depth], lambda x: x || '/'), '') as path, seq[depth] as item from p),
n as (
  select path, depth, min(conv_id) as conv_id, count(*) as n, any_value(item) as item,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where total = depth), '')) as ends
  from q group by path, depth),
k as (
  select n.*, case when depth > 0 then left(path, length(path) - 33) end as up, case when depth > 0 then (n - 1) * w.words else 0 end as saves
  from n left join w using (item)),
c as (select up as path, count(*) as children from k where up is not null group by up),
v as (select k.*, coalesce(c.children, 0) as children from k left join c using (path)),
s as (
  select a.path, sum(case when b.children = 0 then 1 else 0 end) as leaves, sum(b.saves) as saved
  from v a join v b on b.depth >= a.depth and left(b.path, length(a.path)) = a.path group by a.path)
select v.conv_id, v.depth::bigint as depth, u.conv_id as parent_conv_id, v.n::bigint as n_convs, v.children::bigint as n_children, s.leaves::bigint as n_leaves,
  s.saved::bigint as saved_tokens, v.ends as ends_sha256
from v join s using (path) left join v u on u.path = v.up"""
