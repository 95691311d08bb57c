"""The conversation trie against one built in memory, with bands, blocks and copies that meet every way through it."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from jobdelta.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, key string, band int, n long, salt int, part long, at long, total long"


def table(spark, rows):
    """Rows with further columns whose names the operator also uses."""
    return spark.createDataFrame([(*r, "k", 1, 2, 3, 4, 5, 6) for r in rows], SCHEMA)


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[c].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [x[3] for x in sorted(v, key=lambda x: x[:3])] for c, v in turns.items()}
    seq = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        seq[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, s in seq.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                kids[s[: d - 1]].add(s[:d])
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        words = sum(1 for _ in filter(None, "".join(" " if ch in " \t\n\v\f\r" else ch for ch in s[-1][1]).split(" "))) if s else 0
        leaves[s] = sum(leaves[k] for k in kids[s]) or 1
        saved[s] = (len(members[s]) - 1) * words + sum(saved[k] for k in kids[s])
    return sorted((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(kids[s]), leaves[s], saved[s],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if len(seq[c]) == len(s)))).encode()).hexdigest()) for s, m in members.items())


def ordered(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=lambda r: (r[0], r[1], str(r)))


def agree(got, rows):
    assert got == sorted(brute(rows), key=lambda r: (r[0], r[1], str(r)))


def some_rows(seed, convs=120, words=("a", "b b", "c  c\tc", ""), longest=7):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 400), convs):
        for turn in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([turn, turn, turn, None, 0]), rng.choice(["user", "assistant", None]), rng.choice([*words, None])))
    return rows + rows[:5]


@pytest.mark.parametrize("band,block_rows", [(2, 3), (64, 8192)])
def test_trie_agrees_with_brute_force(spark, band, block_rows):
    rows = some_rows(band)
    agree(ordered(prefix_trie.prefix_trie(table(spark, rows), band=band, block_rows=block_rows)), rows)


def test_long_copies_share_many_bands(spark):
    """A conversation of many turns, copies of it, copies that end early or go on, and one alone."""
    talk = [(t, "user", f"turn {t}") for t in range(70)]
    rows = [(c, *x) for c in (41, 42, 44, 48, 50) for x in talk]
    rows += [(c, *x) for c in (51, 52) for x in talk[:30]] + [(c, *x) for c in (1,) for x in [*talk[:33], (99, "user", "other")]]
    rows += [(500, t, "user", f"alone {t}") for t in range(150)] + [(40, 0, "user", "first"), (40, 1, "user", "second")]
    agree(ordered(prefix_trie.prefix_trie(table(spark, rows), band=8, block_rows=4)), rows)


def test_one_conversation_over_many_partitions(spark):
    rows = [(7, t, "user", f"t{t % 50}") for t in range(3000)] + [(8, 0, "user", "x")]
    agree(ordered(prefix_trie.prefix_trie(table(spark, rows).repartition(16))), rows)


def test_odd_turns(spark):
    rows = [(20, 0, "user", "hello there"), (21, 0, "user", "x"), (22, None, None, None), (23, 5, "", ""), (None, 0, "user", "lost"),
            (24, 0, "ab", "c"), (25, 0, "a", "bc"), (26, 0, "user", "word " * 100_000), (26, 0, "user", "word " * 100_000), (39, 1, "user", "é x y")]
    agree(ordered(prefix_trie.prefix_trie(table(spark, rows))), rows)
    assert prefix_trie.prefix_trie(table(spark, []).limit(0)).count() == 0
    assert prefix_trie.prefix_trie(table(spark, [(None, 0, "user", "lost")])).count() == 0
    # A conversation that loses its only turn and has none to take ends at the root.
    alone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    agree(ordered(prefix_trie.prefix_trie(table(spark, [(alone, 0, "user", "gone")]))), [(alone, 0, "user", "gone")])


def test_trees_are_balanced():
    paths = sorted(hashlib.md5(str(n).encode()).digest() + (1).to_bytes(8, "big") for n in range(1000))
    trees, border = prefix_trie.build([(bytes(16), p, n, None) for n, p in enumerate(paths)])

    def height(v):
        return 0 if v < 0 else 1 + max(height(trees.low[v]), height(trees.high[v]))

    assert height(trees.child[0]) == 10 and border == {0, trees.path(trees.code.index(0, 1))[-1], trees.path(trees.code.index(999))[-1]}


def test_query_and_its_twin(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    twin = con.execute(f"select conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 from ({queries.ORACLES['op11_prefix_trie']})").fetchall()
    got = ordered(queries.QUERIES["op11_prefix_trie"](spark, sf))
    assert got == sorted(twin, key=lambda r: (r[0], r[1], str(r)))
    agree(got, con.execute("select conv_id, turn, role, text from conversations").fetchall())
