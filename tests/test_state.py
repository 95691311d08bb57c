"""What is kept between batches: the search index, counts per search, client bitmaps; and deliveries in parts."""

import datetime
import ipaddress
import json

import pytest
from pyspark.sql import functions as F

from checks import load
from helpers import posting, postings
from jobdelta.functions.agents import client_bucket
from jobdelta.operators import counters, delivery, percolate, usage
from jobdelta.operators.delivery import outbox
from jobdelta.operators.search import _as_events, matching, watch_current_jobs
from jobdelta.operators.snapshot import posting_delta
from jobdelta.sources import search_index as X

WORDS = ["ring", "gear", "bolt", "wheel", "c++", "nurse", "senior", "remote", "york"]


def many(spark, n, change=0):
    """Postings whose title, place and pay follow from their number; `change` edits every seventh."""
    rows = []
    for k in range(n):
        title = f"{WORDS[k % 9]} {WORDS[k * 7 % 8]} no{k}" + (" rare" if k % 997 == 5 else "") + (f" v{change}" if change and k % 7 == change % 7 else "")
        rows.append(posting(f"r{k % 13}", f"k{k}", title, location=["New York", "Oslo", None][k % 3], ordinal=k, posted_at=f"2026-01-{1 + k % 28:02}"))
    return postings(spark, rows)


SEARCHES = [{"keywords": ["rare"]}, {"keywords": ["ring gear", "c++"], "locations": ["york"]}, {"all_keywords": ["bolt", "wheel"]}, {"keywords": ["gears"]}, {"locations": ["oslo"], "exclude_keywords": ["ring"]},
            {"remote_only": True}, {"min_salary": 5, "include_unknown": True}, {"seniority": ["senior"]}, {}, {"keywords": ["nothing has this"]}]


def keys(df):
    return sorted((r.resource_id, r.key, r.title) for r in df.collect())


def test_index_equals_a_scan_through_updates(spark, tmp_path):
    path = str(tmp_path / "index")
    now = many(spark, 600)
    X.write_index(now, path, block_docs=64)
    for n, size in ((1, 640), (2, 500)):
        then, now = now, many(spark, size, n)
        delta = posting_delta(then, now).persist()
        X.update_index(spark, path, delta.filter("sign > 0").drop("sign"), delta.filter("sign < 0"), block_docs=64)
        for search in SEARCHES[1:7:2] if n == 1 else SEARCHES[:1] + SEARCHES[2::2]:
            assert keys(X.indexed_matches(spark, path, **search)) == keys(matching(now, **search)), search
    assert len(X._state(spark, path)["segments"]) <= 3
    X.drop_segments(spark, path, keep=1)
    assert keys(X.indexed_matches(spark, path, **SEARCHES[1])) == keys(matching(now, **SEARCHES[1]))


def test_index_reads_what_a_search_hits(spark, tmp_path):
    path = str(tmp_path / "index")
    X.write_index(many(spark, 4000), path, block_docs=50)
    found = X.indexed_matches(spark, path, keywords=["rare"])
    docs = [f for f in found.inputFiles() if "/docs/" in f]
    assert found.count() == 5 and 0 < len(docs) <= 5                       # 5 of 80 blocks
    lists = X._lists(spark, path, X._state(spark, path)["segments"][0], [X._conditions(spark, keywords=["rare"])[0][0][0][0]])
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert lists.count() == 1 and "PartitionFilters: [isnotnull(slot" in plan and "PushedFilters: [IsNotNull(anchor), EqualTo(anchor" in plan


def test_index_without_a_table(spark, tmp_path):
    path = str(tmp_path / "index")
    X.write_index(many(spark, 3).limit(0), path)
    assert X.indexed_matches(spark, path, keywords=["ring"]).count() == 0
    X.update_index(spark, path, many(spark, 20), many(spark, 1).limit(0))
    assert keys(X.indexed_matches(spark, path, keywords=["ring"])) == keys(matching(many(spark, 20), keywords=["ring"]))
    with pytest.raises(FileNotFoundError):
        X.indexed_matches(spark, str(tmp_path / "none"))


def watches(spark, rows):
    return spark.createDataFrame(rows, "watch_id string, client_id string, resource_id string, keywords array<string>, cursor_id bigint, baseline bigint")


def test_matching_counts_follow_silent_changes(spark):
    """Pay is no tracked field, so no event tells of it; the counts do."""
    w = watches(spark, [("w1", "c", None, ["ring"], 0, 0), ("w2", "c", "r1", [], 0, 0)]).withColumn("min_salary", F.lit(100.0)).withColumn("include_unknown", F.lit(False))
    boards = spark.createDataFrame([(f"r{n}", True) for n in range(13)], "resource_id string, indexed boolean")
    pay = lambda df, v: df.withColumn("salary", F.when(F.col("ordinal") % 2 == 0, F.struct(
        F.lit(float(v)).alias("min"), F.lit(float(v)).alias("max"), F.lit("USD").alias("currency"), F.lit("year").alias("period"), F.lit(v).cast("long").alias("annual_min"), F.lit(v).cast("long").alias("annual_max"))))
    old, new = pay(many(spark, 200), 50), pay(many(spark, 200), 200)
    start = counters.count_matching(old, w, boards)
    assert {r.matching for r in start.collect()} == {0}
    got = {r.watch_id: r.matching for r in counters.next_matching(start, old, new, w, boards).collect()}
    assert got == {r.watch_id: r.matching for r in counters.count_matching(new, w, boards).collect()} and got["w1"] > 0 and got["w2"] > 0


def test_equal_searches_are_matched_once(spark):
    """The anchors of 600 searches that ask for three things are those of three; every search gets its rows."""
    rows = [(f"w{n}", "c", None, [["Ring ", "gear"], ["gear", "ring"], ["bolt"], ["nothing has this"]][n % 4], 0, 0) for n in range(600)]
    w = watches(spark, rows)
    classes = percolate.search_classes(w).select("w_class").distinct()
    assert classes.count() == 3
    now = many(spark, 90)
    got = percolate.percolate(_as_events(now), w, carry=["item_key"]).groupBy("watch_id").count().collect()
    want = {0: matching(now, keywords=["ring", "gear"]).count(), 1: matching(now, keywords=["ring", "gear"]).count(), 2: matching(now, keywords=["bolt"]).count()}
    assert {r.watch_id: r["count"] for r in got} == {f"w{n}": want[n % 4] for n in range(600) if n % 4 < 3}


def test_counts_are_made_by_class(spark):
    """Ten times the searches of the same three classes add no pair, and counts equal those of the pairs."""
    terms = [["ring"], ["gear", "ring"], ["bolt"]]
    few, lots = (watches(spark, [(f"w{n}", "c", "r1" if n % 6 == 5 else None, terms[n % 3], 0, 0) for n in range(size)]) for size in (60, 600))
    events = _as_events(many(spark, 90)).withColumn("sign", F.when(F.col("ordinal") % 3 == 0, -1).otherwise(1))
    met = percolate.meet(events, lots, ["item_key"])
    assert met.hits.count() == percolate.meet(events, few, ["item_key"]).hits.count() < 4 * 90
    pairs = percolate.percolate(events, lots, ["item_key", "sign"]).groupBy("watch_id").agg(F.count("*").alias("n"), F.sum("sign").alias("s")).collect()
    assert {r.watch_id: r.n for r in pairs} == {r.watch_id: r.n for r in percolate.count_hits(events, lots).collect()}
    assert {r.watch_id: r.s for r in pairs} == {r.watch_id: r.n for r in percolate.count_hits(events, lots, "sign").collect()}


def test_replayed_pairs_are_written_in_blocks(spark, tmp_path):
    """Pairs handed out in blocks are the same, with floors among the changes, and take a fraction of the disk (F2 f01b_replay)."""
    w = watches(spark, [(f"w{n}", "c", None, [["ring"], ["gear", "bolt"]][n % 2], 0, n % 50) for n in range(3000)])
    log = _as_events(many(spark, 900)).withColumn("change_id", F.col("ordinal") + 1)
    size, hashes = {}, {}
    for block in (None, 32):
        out = delivery.unread(log, w, since=30, carry=["change_id"], block=block).select("watch_id", "change_id")
        out.write.parquet(f"{tmp_path}/{block}")
        hashes[block] = spark.read.parquet(f"{tmp_path}/{block}").agg(F.count("*"), F.sum(F.xxhash64("watch_id", "change_id").cast("decimal(38,0)"))).first()
        size[block] = sum(p.stat().st_size for p in (tmp_path / str(block)).glob("*.parquet"))
    assert hashes[None] == hashes[32] and hashes[32][0] > 100_000
    assert 4 * size[32] < 3 * size[None]
    carried = delivery.unread(log, w.filter("watch_id < 'w2'"), since=30, carry=["change_id", "item_key"], block=32).select("watch_id", "change_id", "item_key")
    assert not carried.exceptAll(delivery.unread(log, w.filter("watch_id < 'w2'"), since=30, carry=["change_id", "item_key"]).select("watch_id", "change_id", "item_key")).count()


def files_per(spark, out, key, path):
    """In how many files of `out`, once written, each value of `key` stands, at most."""
    out.write.parquet(path)
    return spark.read.parquet(path).select(*key, F.input_file_name().alias("f")).distinct().groupBy(*key).count().agg(F.max("count")).first()[0]


def test_a_change_is_handed_out_by_one_task(spark, tmp_path):
    """Rows and watches meet in a grid: a file of unread changes holds few of them, though many classes see each (F1 f01_unread)."""
    assert percolate._grid(4, 0, 0) == (4, 1) and percolate._grid(200, 0, 0) == (16, 13)
    assert percolate._grid(4, 10 << 14, 15 << 14) == (10, 5)                              # more of both, more tasks
    w = watches(spark, [(f"w{n}", "c", None, [WORDS[n % 6], WORDS[n // 6 % 6]], n % 7, 0) for n in range(72)])
    log = _as_events(many(spark, 90)).withColumn("change_id", F.col("ordinal") + 1)
    out = delivery.unread(log, w, carry=["change_id", "item_key"]).select("watch_id", "change_id", "item_key")
    assert files_per(spark, out, ["change_id"], f"{tmp_path}/out") == 1
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), ("c", 3)], "w_class string, k int")          # rows may repeat, keys be null
    to = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("d", "u")], "w_class string, watch_id string")
    for sizes in ((0, 0), (5 << 14, 9 << 14)):
        got = percolate.hand_out(rows, to, ["k"], sizes=sizes).select("w_class", "k", "watch_id").collect()
        assert sorted(map(str, got)) == sorted(map(str, rows.join(to, "w_class").collect()))


def test_unread_counts_and_first_changes_need_no_pairs(spark):
    """Counts past each cursor and each watch's first changes equal those of all pairs, with cursors among and past the changes."""
    terms = [["ring"], ["bolt"]]
    w = watches(spark, [(f"w{n}", f"c{n % 3}", None, terms[n % 2], [0, 7, 40, 41, 500, 13][n % 6], 0) for n in range(24)])
    log = _as_events(many(spark, 90)).withColumn("change_id", F.col("ordinal") + 1)
    pairs = {}
    for r in delivery.unread(log, w, carry=["change_id"]).collect():
        pairs.setdefault(r.watch_id, []).append(r.change_id)
    assert 0 < len(pairs) < 24 and {r.watch_id: r.n for r in delivery.unread_counts(log, w).collect()} == {k: len(v) for k, v in pairs.items()}
    first = {}
    for r in percolate.first_hits(log, w, 3, ["change_id"], "cursor_id").collect():
        first.setdefault(r.watch_id, []).append(r.change_id)
    assert {k: sorted(v) for k, v in first.items()} == {k: sorted(v)[:3] for k, v in pairs.items()}


def test_a_posting_is_tested_for_watches_in_one_task(spark, tmp_path):
    """Equal board watches get the result of their class, a posting's from one task (F2 e07_matches)."""
    n = F.col("id")
    spark.range(1, 301).select(n.alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(1, 121).select(n.alias("p_partkey"), F.concat_ws(" ", F.lit("small"), F.when(n % 2 == 0, "ring").otherwise("bolt")).alias("p_name"), (n % 50).cast("int").alias("p_size"),
                               F.lit("LARGE").alias("p_type"), F.lit("Brand").alias("p_brand")).write.parquet(f"{tmp_path}/part.parquet")
    out = load().QUERIES["e07_matches"](spark, str(tmp_path))
    assert files_per(spark, out, ["resource_id", "key"], f"{tmp_path}/out") == 1
    assert spark.read.parquet(f"{tmp_path}/out").select("key", "watch_id").distinct().count() == out.count() == 450  # 150 board watches, three postings a board


def test_a_job_is_listed_by_one_task(spark, tmp_path):
    """As for changes: a file of the listings of all watches holds few postings (F3 e13b_watch_current_jobs)."""
    w = watches(spark, [(f"w{n}", "c", None, [WORDS[n % 6], WORDS[n // 6 % 6]], 0, 0) for n in range(72)])
    boards = spark.createDataFrame([(f"r{n}", True) for n in range(13)], "resource_id string, indexed boolean")
    out = watch_current_jobs(w, boards, many(spark, 90))
    assert files_per(spark, out, ["resource_id", "key"], f"{tmp_path}/out") == 1
    assert out.groupBy("watch_id").agg((F.max("rank") == F.count("*")).alias("whole")).filter("whole").count() == 72


def test_deliveries_are_shaped_once_for_all_watches(spark):
    """Columns made of a delivery are those of its changes, and are made before it meets its watches (F6 f08_outbox)."""
    log = _as_events(many(spark, 60)).withColumns({"change_id": F.col("ordinal") + 1, "check_id": F.lit("k")})
    w = watches(spark, [(f"w{n}", "c", None, [WORDS[n % 3]], 0, n % 2 * 20) for n in range(30)])
    ids = F.array_join(F.transform("changes", lambda c: c["change_id"].cast("string")), ",")
    for limit in (500, delivery.PART_BYTES):
        whole = outbox(log, w, max_bytes=limit).select("watch_id", "resource_id", "part", "parts", ids.alias("ids"))
        made = outbox(log, w, max_bytes=limit, made={"ids": ids})
        assert made.columns == ["watch_id", "resource_id", "check_id", "ids", "part", "parts"]
        assert sorted(map(str, made.select(whole.columns).collect())) == sorted(map(str, whole.collect())) != []
    plan = made._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(n for n, line in enumerate(plan) if "Join Inner" in line)
    assert not any("array_join" in line for line in plan[:join]) and any("array_join" in line for line in plan[join:])


def test_deliveries_come_in_bounded_parts(spark):
    log = many(spark, 300).withColumn("big", F.col("ordinal") == 100)
    fields = [c for c in log.columns if c not in ("resource_id", "complete", "big")]
    job = F.struct(*[F.when(F.col("big"), F.repeat(F.lit("long "), 2000)).otherwise(F.col(c)).alias(c) if c == "title" else F.col(c) for c in fields])
    changes = log.select((F.col("ordinal") + 1).alias("change_id"), F.lit("k").alias("check_id"), F.lit("r0").alias("resource_id"), F.lit("JOB_ADDED").alias("type"), F.col("key").alias("item_key"),
                         job.alias("job"), F.lit("s").alias("summary"), F.lower("title").alias("search_text"))
    w = watches(spark, [("whole", "c", "r0", [], 0, 0), ("few", "c", "r0", [], 298, 298)])
    limit = 4000
    out = outbox(changes, w, max_bytes=limit).collect()
    parts = sorted((r for r in out if r.watch_id == "whole"), key=lambda r: r.part)
    assert [r.part for r in parts] == list(range(len(parts))) and {r.parts for r in parts} == {len(parts)} and len(parts) > 10
    assert [c.change_id for r in parts for c in r.changes] == list(range(1, 301))             # every event once, in order
    size = lambda c: len(json.dumps(c.asDict(True), separators=(",", ":"), default=str).encode())
    assert all(len(r.changes) == 1 or sum(map(size, r.changes)) <= limit * 1.3 for r in parts)  # JSON here spells nulls out
    assert [len(r.changes) for r in parts if any(c.change_id == 101 for c in r.changes)] == [1]
    assert [(r.part, r.parts, len(r.changes)) for r in out if r.watch_id == "few"] == [(0, 1, 2)]


def test_client_bitmaps_count_what_distinct_counts(spark):
    day = lambda n: datetime.date(2026, 3, 1) + datetime.timedelta(days=n)
    rows = [(day(n % 40), f"c{(n * n) % 333}", "t", "v", 1 + n % 3) for n in range(2000)] + [(day(3), None, "t", "v", 5)]
    table = spark.createDataFrame(rows, "day date, client_id string, tool string, via string, calls bigint")
    early = usage.client_days(table.filter(F.col("day") < day(20)))
    late = usage.client_days(table.filter(F.col("day") >= day(20)), early.numbers)     # the next days keep the numbers given before
    assert late.numbers.count() == late.numbers.select("number").distinct().count() == len({r[1] for r in rows if r[1]})
    days = early.days.unionByName(late.days)
    spans = {"one": F.col("day") == F.lit(day(5)), "week": F.col("day") > F.lit(day(30)), "all": F.lit(True), "none": F.lit(False)}
    got = usage.active_clients(days, spans).first()
    want = {n: len({c for d, c, *_ in rows if c and ok(d)}) for n, ok in (("one", lambda d: d == day(5)), ("week", lambda d: d > day(30)), ("all", lambda d: True), ("none", lambda d: False))}
    assert got.asDict() == want
    clients = spark.createDataFrame([(f"c{n}", datetime.datetime(2026, 3, 12) + datetime.timedelta(days=n % 27)) for n in range(0, 333, 3)] + [("never", datetime.datetime(2026, 3, 20))], "client_id string, created_at timestamp_ntz")
    r = usage.retention(clients, usage.ClientDays(days, late.numbers), str(day(39)), f"{day(39)} 12:00:00").first()
    used = {}
    for d, c, *_ in rows:
        used.setdefault(c, set()).add(d)
    cohort = [(c.client_id, c.created_at.date()) for c in clients.collect() if c.client_id in used and c.created_at > datetime.datetime(2026, 3, 10, 12) and c.created_at.date() < day(39)]
    assert (r.cohort, r.returned) == (len(cohort), sum(any(d > came for d in used[c]) for c, came in cohort))


def test_address_buckets(spark):
    def expected(ip):
        try:
            v6 = ipaddress.IPv6Address(ip.split("%")[0])
        except ValueError:
            return ip
        return str(v6.ipv4_mapped) if v6.ipv4_mapped else ":".join(f"{int(g, 16):x}" for g in v6.exploded.split(":")[:4]) + "::/64"

    ips = ["1.2.3.4", "::1", "::", "::ffff:1.2.3.4", "::FFFF:0a01:0203", "2001:DB8::1", "2001:0db8:0000:00ab:1:2:3:4", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1::2::3",
           ":::", "fe80::1%eth0", "a:b", "12345::", "g::1", "::1.2.3.4", "64:ff9b::192.0.2.33", "1:2:3:4:5:6:1.2.3.4", "::ffff:1.2.3.256", "::ffff:01.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", ":1:2:3:4:5:6:7", "", "%", "::%"]
    got = {r.ip: r.b for r in spark.createDataFrame([(i,) for i in ips] + [(None,)], "ip string").select("ip", client_bucket(F.col("ip")).alias("b")).collect()}
    assert got[None] is None and {i: got[i] for i in ips if i != "::%"} == {i: expected(i) if ":" in i else i for i in ips if i != "::%"}


def test_kept_unread_counts_hold_no_row_per_pair(spark):
    """Hits are kept once for all watches that ask for the same thing; counts equal the plain rule over moves, a new and a deleted watch."""
    log = _as_events(many(spark, 90)).withColumn("change_id", F.substring("item_key", 2, 9).cast("bigint"))

    def watches(cursor, extra=()):
        rows = [(f"w{n}", None, ["ring"], cursor(n), None) for n in range(30)] + list(extra)
        return spark.createDataFrame(rows, "watch_id string, resource_id string, keywords array<string>, cursor_id long, deleted_at string")

    first, second = log.filter("change_id % 2 = 0"), log.filter("change_id % 2 = 1")
    ring = {parity: [k for k in range(90) if k % 2 == parity and "ring" in (WORDS[k % 9], WORDS[k * 7 % 8])] for parity in (0, 1)}
    state = counters.count_pending(first, watches(lambda n: n % 5))
    assert state.hits.count() == sum(k > 0 for k in ring[0])
    assert {r.watch_id: r.pending for r in state.counts.collect()} == {f"w{n}": sum(k > n % 5 for k in ring[0]) for n in range(30)}
    moved = watches(lambda n: 3 * n, [("late", None, ["ring"], 10, None)]).withColumn("deleted_at", F.when(F.col("watch_id") == "w3", "gone"))
    state = counters.next_pending(state, second, moved)
    expected = {f"w{n}": sum(k > max(3 * n, n % 5) for k in ring[0]) + sum(k > 3 * n for k in ring[1]) for n in range(30) if n != 3}
    assert {r.watch_id: r.pending for r in state.counts.collect()} == expected | {"late": sum(k > 10 for k in ring[1])}
    assert state.hits.count() == sum(k > 0 for k in ring[0] + ring[1]) + sum(k > 10 for k in ring[1])


def test_delta_makes_digests_again_for_differing_keys_only(spark):
    schema = "resource_id string, key string, title string"
    old = spark.createDataFrame([("r", f"k{n}", "a") for n in range(50)], schema)
    new = spark.createDataFrame([("r", f"k{n}", "b" if n == 7 else "a") for n in range(1, 51)], schema)
    delta = posting_delta(old, new)
    assert {(r.key, r.title, r.sign) for r in delta.collect()} == {("k0", "a", -1), ("k7", "a", -1), ("k7", "b", 1), ("k50", "a", 1)}
    # In both sides' plans the semi join with the differing keys stands below the digest.
    plan = delta._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == plan.count("Join LeftSemi") == 2 and plan.index("md5(") < plan.index("Join LeftSemi")
