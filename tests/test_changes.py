from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import posting, postings
from jobdelta.operators.changes import assign_change_ids, diff_postings
from jobdelta.operators.snapshot import carry_forward, changed_boards, content_hash, dedupe_postings


def kinds(df):
    return sorted((r.type, r.item_key, tuple(r.changed_fields or ())) for r in df.collect())


def diff(spark, before, after, **kw):
    return diff_postings(postings(spark, before), postings(spark, after), **kw)


def test_first_listing_is_a_baseline(spark):
    assert kinds(diff(spark, [posting("other", "a")], [posting("r", "a")])) == []


def test_order_is_not_a_change(spark):
    items = [posting("r", k) for k in "abc"]
    assert kinds(diff(spark, items, items[::-1])) == []


def test_add_remove_update(spark):
    before = [posting("r", "a"), posting("r", "b", title="Old"), posting("r", "c")]
    after = [posting("r", "b", title="New", location="Oslo"), posting("r", "c"), posting("r", "d")]
    assert kinds(diff(spark, before, after)) == [
        ("JOB_ADDED", "d", ()), ("JOB_REMOVED", "a", ()), ("JOB_UPDATED", "b", ("title", "location"))]


def test_untracked_fields_are_ignored(spark):
    a = posting("r", "a", company="X", posted_at="2026-01-01")
    assert kinds(diff(spark, [a], [{**a, "company": "Y", "posted_at": "2026-02-02"}])) == []


def test_incomplete_listing_never_removes(spark, rows):
    flags = rows("resource_id string, complete boolean", [("r", False)])
    assert kinds(diff(spark, [posting("r", "a"), posting("r", "b")], [posting("r", "b")], complete=flags)) == []


def test_emptied_board_removes_all(spark, rows):
    flags = rows("resource_id string, complete boolean", [("r", True)])
    got = diff(spark, [posting("r", "a"), posting("r", "b")], [posting("zz", "x")], complete=flags)
    assert kinds(got) == [("JOB_REMOVED", "a", ()), ("JOB_REMOVED", "b", ())]


def test_partial_then_full_is_silent(spark):
    assert kinds(diff(spark, [posting("r", "a", partial=True)], [posting("r", "a", title="Real", location="Rome")])) == []


def test_unique_jsonld_pair_is_one_update(spark):
    before = [posting("r", "job:x|oslo", "Cook ", location="Oslo", company="Inn", source="jsonld")]
    after = [posting("r", "job:x|rome", "cook", location="Rome", company="inn", source="jsonld")]
    assert kinds(diff(spark, before, after)) == [("JOB_UPDATED", "job:x|rome", ("title", "location"))]


def test_pair_with_nothing_changed_is_kept(spark):
    a = posting("r", "k1", "Cook", source="jsonld")
    assert kinds(diff(spark, [a], [{**a, "key": "k2"}])) == [("JOB_UPDATED", "k2", ())]


def test_two_candidates_are_not_paired(spark):
    before = [posting("r", "k1", "Cook", source="jsonld")]
    after = [posting("r", "k2", "Cook", source="jsonld"), posting("r", "k3", "Cook", source="jsonld")]
    assert [k[0] for k in kinds(diff(spark, before, after))] == ["JOB_ADDED", "JOB_ADDED", "JOB_REMOVED"]


def test_api_postings_are_never_paired(spark):
    assert len(kinds(diff(spark, [posting("r", "k1")], [posting("r", "k2")]))) == 2


def test_cap_keeps_adds_first(spark):
    after = [posting("r", f"n{n:03}", ordinal=n + 1) for n in range(250)]
    assert len(diff(spark, [posting("r", "old")], after).collect()) == 251  # all of them, unless a cap is asked for
    got = diff(spark, [posting("r", "old")], after, cap=200).collect()
    assert len(got) == 200 and {r.type for r in got} == {"JOB_ADDED"}
    assert {r.item_key for r in got} == {f"n{n:03}" for n in range(200)}


def test_ids_follow_the_batch_before(spark):
    before = [posting(f"r{b}", "old") for b in range(30)]
    after = [posting(f"r{b}", f"n{n}", ordinal=n + 1) for b in range(30) for n in range(1 + b % 4)]
    got = sorted((r.change_id, r.resource_id, r.type_rank, r.position, r.item_key) for r in assign_change_ids(diff(spark, before, after), start=500).collect())
    assert [g[0] for g in got] == list(range(501, 501 + len(got)))
    boards = [g[1] for g in got]
    assert sum(a != b for a, b in zip(boards, boards[1:])) == len(set(boards)) - 1        # a board's ids follow one another
    assert all(a[2:] < b[2:] for a, b in zip(got, got[1:]) if a[1] == b[1])               # in the order of its events


def test_no_event_is_lost_on_a_hot_board(spark):
    after = [posting("hot", f"k{n:04}", ordinal=n + 1) for n in range(1500)] + [posting("cold", "x")]
    got = assign_change_ids(diff(spark, [posting("hot", "old"), posting("cold", "old")], after)).collect()
    assert sorted(r.change_id for r in got) == list(range(1, 1504))


def test_several_checks_of_a_board_are_compared_in_order(spark):
    from jobdelta.plans.check import compare_checks

    stored = postings(spark, [posting("b", "1"), posting("b", "2"), posting("q", "1")])
    seen = [("b", "two", 20, ["2", "3"]), ("b", "one", 10, ["1", "2", "9"]), ("b", "three", 30, []), ("q", "only", 15, ["1", "5"]), ("f", "bad", 10, ["7"])]
    listed = None
    for board, check, _, keys in seen:
        df = postings(spark, [posting(board, k) for k in keys] or [posting(board, "none")]).withColumn("check_id", F.lit(check))
        df = df if keys else df.limit(0)
        listed = df if listed is None else listed.unionByName(df)
    boards = spark.createDataFrame([(b, c, at, "greenhouse", len(k), len(k), c == "bad", True) for b, c, at, k in seen],
                                   "resource_id string, check_id string, at int, adapter string, total int, jobs_count int, failed boolean, complete boolean") \
        .withColumn("fetched_at", F.timestamp_seconds("at")).drop("at")
    check = compare_checks(listed, boards, stored, start_id=10)
    got = sorted((r.change_id, r.resource_id, r.check_id, r.type, r.item_key) for r in check.changes.collect())
    assert [g[0] for g in got] == list(range(11, 11 + len(got)))
    by_check = {}
    for _, b, c, t, k in got:
        by_check.setdefault((b, c), set()).add((t, k))
    assert by_check == {("b", "one"): {("JOB_ADDED", "9")}, ("b", "two"): {("JOB_ADDED", "3"), ("JOB_REMOVED", "1"), ("JOB_REMOVED", "9")},
                        ("b", "three"): {("JOB_REMOVED", "2"), ("JOB_REMOVED", "3")}, ("q", "only"): {("JOB_ADDED", "5")}}
    assert sorted((r.resource_id, r.key) for r in check.postings.collect()) == [("q", "1"), ("q", "5")]


def test_snapshot_versions_swap_whole(spark, tmp_path):
    from jobdelta.sources import sinks as K

    path = str(tmp_path / "snap")
    K.write_snapshot(postings(spark, [posting(f"r{n % 9}", f"k{n}") for n in range(90)]), path, buckets=4)
    old = K.read_snapshot(spark, path)
    K.write_snapshot(postings(spark, [posting("r3", "new")]), path, boards=spark.createDataFrame([("r3",), ("r4",)], "resource_id string"))
    got = sorted((r.resource_id, r.key) for r in K.read_snapshot(spark, path).collect())
    assert ("r3", "new") in got and not any(b == "r4" for b, _ in got) and len(got) == 71
    assert old.count() == 90                                                                # a reader of the version before still sees it whole
    one = K.read_snapshot(spark, path, spark.createDataFrame([("r3",)], "resource_id string"))
    assert len(one.inputFiles()) < len(K.read_snapshot(spark, path).inputFiles())           # only the buckets of the boards asked for
    K.drop_versions(spark, path, keep=1)
    assert sorted((r.resource_id, r.key) for r in K.read_snapshot(spark, path).collect()) == got


def test_diff_plan_has_no_sort_aggregate(spark):
    df = postings(spark, [posting("r", "a")])
    assert "SortAggregate" not in dedupe_postings(df)._jdf.queryExecution().toString()
    plan = diff_postings(df, df.withColumn("title", F.lit("x")))._jdf.queryExecution().toString()
    assert "SortAggregate" not in plan


def test_last_duplicate_wins(spark):
    df = postings(spark, [posting("r", "a", "first", ordinal=1), posting("r", "a", "last", ordinal=2)])
    assert [r.title for r in dedupe_postings(df).collect()] == ["last"]


def test_carry_forward_only_for_partial_rows(spark):
    before = postings(spark, [posting("r", "a", "Full", location="Oslo"), posting("r", "b", "Old", partial=True)])
    now = postings(spark, [posting("r", "a", "slug", partial=True), posting("r", "b", "slug b", partial=True), posting("r", "c", "New")])
    got = {r.key: (r.title, r.partial) for r in carry_forward(now, before).collect()}
    assert got == {"a": ("Full", False), "b": ("slug b", True), "c": ("New", False)}


def test_hash_ignores_order_and_counts_copies(spark):
    a, b = posting("r", "a"), posting("r", "b")
    one = content_hash(postings(spark, [a, b])).first().content_hash
    assert one == content_hash(postings(spark, [b, a])).first().content_hash
    assert one != content_hash(postings(spark, [a, b, b])).first().content_hash
    assert changed_boards(postings(spark, [a, b]), postings(spark, [b, a])).count() == 0


_jobs = st.dictionaries(st.text("abcd", min_size=1, max_size=2), st.tuples(st.text("xyz", max_size=2), st.sampled_from([None, "Oslo"])), max_size=8)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(cases=st.lists(st.tuples(_jobs, _jobs), min_size=3, max_size=6))
def test_every_key_is_reported_once(spark, cases):
    """Many boards per example: each added and removed key appears once, each changed one once, nothing else."""
    before, after, want = [], [], set()
    for n, (old, new) in enumerate(cases):
        if not old:
            old = {"zz": ("q", None)}
        before += [posting(f"r{n}", k, t, location=loc) for k, (t, loc) in old.items()]
        after += [posting(f"r{n}", k, t, location=loc) for k, (t, loc) in new.items()]
        want |= {(f"r{n}", "JOB_ADDED", k) for k in new.keys() - old.keys()}
        if new:
            want |= {(f"r{n}", "JOB_REMOVED", k) for k in old.keys() - new.keys()}
        want |= {(f"r{n}", "JOB_UPDATED", k) for k in old.keys() & new.keys() if old[k] != new[k]}
    got = [(r.resource_id, r.type, r.item_key) for r in diff(spark, before, after or [posting("none", "x")]).collect()]
    assert sorted(got) == sorted(want)


def test_same_set_is_silent(spark):
    items = [posting(f"r{n % 3}", f"k{n}", title=f"t{n}") for n in range(30)]
    df = postings(spark, items)
    assert diff_postings(df, df.orderBy(F.rand(1))).count() == 0


def test_many_checks_of_a_board_take_no_more_jobs(spark):
    """Fifty checks in one batch equal fifty runs of one check each, and the number of jobs does not follow them."""
    from jobdelta.plans.check import compare_checks

    def checks(numbers):
        rows, facts = [], []
        for n in numbers:
            keys = [k for k in range(12) if (k * 7 + n * n) % 5]
            rows += [{**posting("b", f"k{k}", f"t{(n + k) // 9}", partial=(n + k) % 4 == 0, ordinal=k), "check_id": f"c{n:02}"} for k in keys]
            facts.append(("b", f"c{n:02}", n, "greenhouse", len(keys), len(keys), False, n % 6 != 0))
        listed = postings(spark, [{k: v for k, v in r.items() if k != "check_id"} for r in rows])
        tagged = listed.join(spark.createDataFrame([(r["key"], r["title"], r["partial"], r["check_id"]) for r in rows], "key string, title string, partial boolean, check_id string"),
                             ["key", "title", "partial"]).dropDuplicates(["key", "check_id"])
        boards = spark.createDataFrame(facts, "resource_id string, check_id string, at int, adapter string, total int, jobs_count int, failed boolean, complete boolean") \
            .withColumn("fetched_at", F.timestamp_seconds("at")).drop("at")
        return tagged, boards

    def told(check):
        return sorted((r.check_id, r.type, r.item_key, r.job.title, tuple(r.changed_fields or ())) for r in check.changes.collect())

    stored = postings(spark, [posting("b", f"k{k}", "t0", ordinal=k) for k in range(12)])

    def jobs(n):
        tracker, group = spark.sparkContext.statusTracker(), f"checks-{n}"
        spark.sparkContext.setJobGroup(group, group)
        found = told(compare_checks(*checks(range(1, n + 1)), stored))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found, len(tracker.getJobIdsForGroup(group))

    (few, jobs_few), (many, jobs_many) = jobs(4), jobs(50)
    assert jobs_many <= jobs_few + 10 and many[: len(few)] == few
    one_by_one, latest = [], stored
    for n in range(1, 5):
        check = compare_checks(*checks([n]), latest)
        one_by_one += told(check)
        latest = check.postings
    assert sorted(one_by_one) == few


def test_buckets_grow_with_the_rows(spark, tmp_path):
    from jobdelta.sources import sinks as K

    path = str(tmp_path / "snap")

    def rows(lo, hi, boards=40):
        return spark.range(lo, hi).select(F.concat(F.lit("r"), F.col("id") % boards).alias("resource_id"), F.concat(F.lit("k"), "id").alias("key"), F.col("id").cast("string").alias("title"))

    K.write_snapshot(rows(0, 200), path, bucket_rows=100)
    before = K.read_snapshot(spark, path)
    assert K._layout(K._contents(spark, path)).count == 2
    K.write_snapshot(rows(0, 20_000, 400), path, bucket_rows=100)          # a hundred times the rows
    first = K._contents(spark, path)
    assert K._layout(first).count == 200 and max(first["rows"].values()) < 1000
    assert before.count() == 200                                            # an older reader still sees its version
    K.write_snapshot(rows(0, 5000, 1).withColumn("resource_id", F.lit("big")), path, bucket_rows=100)   # one board alone
    last = K._contents(spark, path)
    assert last["big"] == {"big": 50} and max(last["rows"].values()) < 1000
    got = K.read_snapshot(spark, path)
    assert got.count() == 25_000 and got.select("resource_id", "key").distinct().count() == 25_000
    one = K.read_snapshot(spark, path, spark.createDataFrame([("big",)], "resource_id string")).filter("resource_id = 'big'")
    assert one.count() == 5000
    K.write_snapshot(rows(0, 3, 1).withColumn("resource_id", F.lit("big")), path, bucket_rows=100)      # and small again
    assert K._contents(spark, path)["big"] == {} and K.read_snapshot(spark, path).filter("resource_id = 'big'").count() == 3
    assert K.read_snapshot(spark, path).count() == 20_003
    K.drop_versions(spark, path, keep=1)
    assert K.read_snapshot(spark, path).count() == 20_003


def test_buckets_split_in_order():
    from jobdelta.sources.sinks import Layout

    a = Layout(3)
    for n in range(3, 60):
        b = a.grown(n)
        assert b.count == n
        for bucket in range(a.count, n):
            assert b.parent(bucket, a) < a.count
        c = a.grown(n // 2 + 2).grown(n)
        assert (c.level, c.split) == (b.level, b.split)


def test_a_board_that_moved_meanwhile_is_left_alone(spark):
    from jobdelta.streaming.changes import _sound

    boards = spark.createDataFrame([("a",), ("b",), ("c",)], "resource_id string")
    state = "resource_id string, current_snapshot_id string"
    base, now = spark.createDataFrame([("a", "1"), ("b", "1")], state), spark.createDataFrame([("a", "1"), ("b", "2")], state)
    assert sorted(r[0] for r in _sound(boards, base, now).collect()) == ["a", "c"]
    assert sorted(r[0] for r in _sound(boards, None, None).collect()) == ["a", "b", "c"]
    assert sorted(r[0] for r in _sound(boards, None, now).collect()) == ["c"]
