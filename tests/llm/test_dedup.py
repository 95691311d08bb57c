"""Exact copies, near-duplicates and boilerplate lines against brute force."""

import hashlib
import re

import duckdb
import pytest

from jobdelta.llm import exact_dedup, line_dedup, near_dedup, queries
from jobdelta.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, keep_id long, kept boolean, run string, norm string, node long, source string, digest string, `place` int"


def documents(spark, rows):
    """(doc_id, text, source) with further columns whose names the operators also use."""
    return spark.createDataFrame([(d, t, 0, True, "r", "n", 1, s, "x", 2) for d, t, s in rows], SCHEMA)


def twin(name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    res = con.execute(queries.ORACLES[name])
    cols = [c[0] for c in res.description]
    return cols, sorted(map(repr, res.fetchall()))


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_twin(spark, name):
    cols, want = twin(name)
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(repr(tuple(r[c] for c in cols)) for r in got.collect()) == want


def brute_exact(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for d, t, _ in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), d is None, d))
    return sorted((str(d), str(min(groups[norm(t)])[2]), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for d, t, _ in rows)


EXACT = [(1, "a b", "s"), (2, "ab", "s"), (3, "a  b\n", "s"), (4, None, "s"), (5, "", "s"), (6, " \t\x0b\x0c\r\n", "s"), (7, "c" * 50_000, "s"), (8, "c" * 50_000 + " ", "s"),
         (9, "a b", "s"), (10, "ab", "t"), (None, "z", "s"), (None, "z", "s"), (11, "z", "s"), (12, "é ü", "s"), (13, "éü", "s"), (14, "A b", "s")]


def test_exact_copies(spark):
    rows = EXACT + [(100 + n, "hot  text", "s") for n in range(300)]
    out = exact_dedup.mark_copies(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in out) == brute_exact(rows)
    kept = [r for r in out if r.kept]
    assert len(kept) == len({r.text_sha256 for r in out})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_repeated_rows_keep_one(spark):
    out = exact_dedup.mark_copies(documents(spark, [(1, "x", "s")] * 40)).collect()
    assert sum(r.kept for r in out) == 1 and {r.group_size for r in out} == {40} and {r.keep_id for r in out} == {1}


def test_exact_rows_come_back_whole(spark):
    docs = documents(spark, EXACT)
    rows = exact_dedup.mark_copies(docs, keep_rows=True).filter("kept").select("row.*")
    assert rows.columns == docs.columns
    assert {r for r in rows.collect()} <= {r for r in docs.collect()}


def test_empty_tables(spark):
    docs = documents(spark, []).limit(0)
    assert exact_dedup.mark_copies(docs).count() == 0
    assert near_dedup.near_groups(docs).count() == 0
    assert line_dedup.remove_boilerplate(docs).count() == 0


def shingles(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_near(rows):
    """Component of each document id, by comparing all pairs."""
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    up = {d: d for d, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (a, s) in enumerate(sets):
        for b, t in sets[:n]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: top(d) for d in up}


def test_near_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute_near(docs)
    out = queries.QUERIES["op5_near_dedup"](spark, SF).collect()
    assert {r.doc_id: r.component_id for r in out} == want
    assert {r.doc_id: r.n_shingles for r in out} == {d: len(shingles(t)) for d, t in docs}
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_near_cases(spark):
    base = [f"word{n}" for n in range(60)]
    change = lambda *at: " ".join("X" if n in at else w for n, w in enumerate(base))
    rows = [(10, change(), "s"), (9, change(3), "s"), (8, change(3, 30), "s"), (7, change(3, 30, 50), "s"), (6, change(1, 10, 20, 30, 40, 50), "s"),
            (20, None, "s"), (21, "", "s"), (22, " \n", "s"), (23, "one two", "s"), (24, "ONE  two", "s"), (25, "one two three", "s"),
            (30, change().upper(), "s"), (None, change(), "s"), (40, change() + " " + change(), "s")]
    rows += [(1000 + n, change(n % 60) + f" tail{n}", "s") for n in range(200)]
    out = near_dedup.near_groups(documents(spark, rows)).collect()
    want = brute_near([(d, t) for d, t, _ in rows])
    assert {r.doc_id: r.component_id for r in out if r.doc_id is not None} == want
    missing = next(r for r in out if r.doc_id is None)
    assert missing.component_id is None and missing.kept
    assert {r.doc_id: r.n_shingles for r in out}[22] == 0


def test_near_crowded_regions_go_deeper(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CROWDED", 2)
    words = [f"common{n}" for n in range(40)]
    rows = [(n, " ".join(words + [f"own{n}x{k}" for k in range(8 + n % 30)]), "s") for n in range(120)]
    out = near_dedup.near_groups(documents(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in out} == brute_near([(d, t) for d, t, _ in rows])


def test_near_crowded_regions_keep_single_bridges(spark, monkeypatch):
    """Two families of near copies are linked by one pair at 0.752 alone, and all regions that the pair shares are crowded."""
    monkeypatch.setattr(near_dedup, "CROWDED", 2)
    seeds, far, rows = (110, 161, 406, 428, 515, 543), (10, 45, 80, 115, 150, 185), []
    for seed in seeds:
        text = lambda *at: " ".join(f"X{seed}" if n in at else f"w{seed}x{n}" for n in range(216))  # noqa: B023, E731
        texts = [text(25), text(60), text(95), text(), text(*far, 30), text(*far, 65), text(*far, 100), text(*far)]
        rows += [(10 * seed + n, t, "s") for n, t in enumerate(texts)]
    out = near_dedup.near_groups(documents(spark, rows)).collect()
    want = brute_near([(d, t) for d, t, _ in rows])
    assert len(set(want.values())) == len(seeds)
    assert {r.doc_id: r.component_id for r in out} == want


def test_near_orders_hold_the_longest_common_prefixes(spark):
    """Every order is sorted over all ranges, and each class's partner is the neighbour with the longest prefixes, as in one sorted list."""
    rows = [(n, bytes(v for t in range(near_dedup.TREES * near_dedup.LABEL) for v in (0, 0, 0, (n * 7919 >> t % 7) % 2))) for n in range(300)]
    orders = near_dedup._orders(spark.createDataFrame(rows, "node long, signature binary").repartition(5))
    got = orders.select("tree", "node", "common", "before", "last").collect()
    width, total = 4 * near_dedup.LABEL, {}
    for t in range(near_dedup.TREES):
        line = sorted((sig[width * t : width * (t + 1)], n) for n, sig in rows)
        want = {}
        for (x, a), (y, b) in zip(line, line[1:]):
            same = next((k for k in range(near_dedup.LABEL) if x[4 * k : 4 * k + 4] != y[4 * k : 4 * k + 4]), near_dedup.LABEL)
            want[b] = (a, same)
            if same >= near_dedup.DEPTH:
                total[min(a, b), max(a, b)] = total.get((min(a, b), max(a, b)), 0) + same
        own = {r.node: r for r in got if r.tree == t}
        assert all((r.before, r.common) == want[n] for n, r in own.items() if r.common >= near_dedup.DEPTH)
        assert {n for n, (_, same) in want.items() if same >= near_dedup.DEPTH} <= set(own)
    best = {}
    for (a, b), n in total.items():
        for x, y in ((a, b), (b, a)):
            best[x] = max(best.get(x, (0, 0)), (n, -y))
    want = {(min(x, -y), max(x, -y)) for x, (_, y) in best.items()}
    assert {(r.a, r.b) for r in near_dedup._next_to(near_dedup.written(orders, "test-orders")).collect()} == want


def test_near_first_classes_of_crowded_regions_are_found_deeper(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CROWDED", 3)
    label = lambda *v: b"".join(x.to_bytes(4, "little") for x in v)
    labels = [label(1, 1, 1, k // 3, k, 0, 0, 0) for k in range(9)] + [label(2, 2, 2, k, k, k, k, k) for k in range(3)] + [label(3, 3, 3, 3, 3, 3, 3, 3)] * 5
    rows = [(0, lab, n) for n, lab in enumerate(labels)]
    orders = spark.createDataFrame(rows, "tree int, label binary, node long").withColumn("region", near_dedup._region(near_dedup.DEPTH))
    got = {(r.a, r.b) for r in near_dedup._first_of(orders).collect()}
    assert got == {(0, 1), (0, 2), (3, 4), (3, 5), (6, 7), (6, 8), (9, 10), (9, 11), (12, 13), (12, 14), (12, 15), (12, 16)}


def test_near_repeated_rows_are_one_document(spark):
    text = " ".join(f"w{n}" for n in range(30))
    out = near_dedup.near_groups(documents(spark, [(5, text, "s"), (5, text, "s"), (6, text, "s")])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in out) == [(5, 5, True), (5, 5, True), (6, 5, False)]


def test_components(spark):
    links = [(n, n + 1) for n in range(1, 40)] + [(100, 50), (50, 75), (7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{n: 1 for n in range(1, 41)}, 50: 50, 75: 50, 100: 50, 200: 200, 201: 200}


def brute_lines(rows, least=line_dedup.MIN_SITES):
    sites = {}
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            sites.setdefault(line.strip(line_dedup.BLANKS), set()).add(s or "")
    out = []
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not x.strip(line_dedup.BLANKS) or len(sites[x.strip(line_dedup.BLANKS)]) < least]
        out.append((str(d), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_lines(spark):
    rows = [(n, f"own {n}\nfooter  \n\n{'wide' if n % 7 else 'narrow'}\nfooter", f"s{n % 6}" if n % 5 else None) for n in range(60)]
    rows += [(None, None, None), (100, "", "a"), (101, "footer", "a"), (102, "\n\n", "b"), (103, "x" * 100_000 + "\nfooter", "c")]
    rows += [(200, "footer\nrest", "s1")] * 3
    rows += [(300 + n, "four sites\nkeep", f"t{n % 4}") for n in range(40)]
    rows += [(400 + n, "\r\n".join(["\tmixed ends" if n % 2 else "mixed ends", "", f"own\u00a0{n}", "last"]), f"u{n % 5}") for n in range(20)]
    out = line_dedup.remove_boilerplate(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_removed, r.text) for r in out) == brute_lines(rows)


def test_lines_on_many_sites_are_decided_as_exactly(spark):
    rows = [(n, f"line{n % 40}\nown {n}", f"site{(n * 7919) % (50 + 4 * (n % 40))}") for n in range(12_000)]
    out = line_dedup.remove_boilerplate(documents(spark, rows), min_sites=100).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_removed, r.text) for r in out) == brute_lines(rows, 100)
