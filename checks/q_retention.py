"""I: retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import ORACLE_VIEWS
from jobdelta.operators import retention as R

NOW = "1998-12-01 00:00:00"
T = f"TIMESTAMP '{NOW}'"
# Watches with access and deletion times, in both dialects.
WATCHES = """SELECT w.*, o.last_accessed_at, CASE WHEN o.n % 4 = 0 THEN o.last_accessed_at + INTERVAL '5' DAY END AS deleted_at,
   CASE WHEN o.n % 4 = 0 THEN 'deleted' END AS delete_reason FROM fx_watches w
   JOIN (SELECT concat('w', o_custkey) AS watch_id, max(o_orderdate) AS last_accessed_at, count(*) AS n FROM orders GROUP BY o_custkey) o USING (watch_id)"""
ORACLE_VIEWS["ox_rw"] = WATCHES


@query("i01_expire_watches", f"""
SELECT watch_id, CASE WHEN deleted_at IS NULL AND last_accessed_at < {T} - INTERVAL 30 DAY THEN 'expired' ELSE delete_reason END AS delete_reason,
       strftime(CASE WHEN deleted_at IS NULL AND last_accessed_at < {T} - INTERVAL 30 DAY THEN {T} ELSE deleted_at END, '%Y-%m-%d') AS deleted_on FROM ox_rw""")
def i01(i):
    return R.expire_watches(i.sql(WATCHES), NOW).select("watch_id", "delete_reason", F.date_format("deleted_at", "yyyy-MM-dd").alias("deleted_on"))


def both(split, *cols):
    return split.kept.select(*cols, F.lit(True).alias("kept")).unionByName(split.deleted.select(*cols, F.lit(False).alias("kept")))


_CHANGES = "SELECT l_orderkey * 10 + l_linenumber AS change_id, l_shipdate AS detected_at, CAST(l_shipdate AS DATE) AS detected_day FROM lineitem"


@query("i02_drop_changes", f"SELECT change_id, NOT detected_at < {T} - INTERVAL 90 DAY AS kept FROM ({_CHANGES})")
def i02(i):
    return both(R.drop_changes(i.sql(_CHANGES), NOW), "change_id")


_SNAPS = "SELECT concat('s', o_orderkey) AS snapshot_id, concat('r', o_custkey) AS resource_id, o_orderdate AS fetched_at FROM orders"
_CURRENT = "SELECT concat('r', o_custkey) AS resource_id, concat('s', max(o_orderkey)) AS current_snapshot_id FROM orders GROUP BY o_custkey"


@query("i03_drop_snapshots", f"""
SELECT snapshot_id, NOT (fetched_at < {T} - INTERVAL 30 DAY AND snapshot_id NOT IN (SELECT current_snapshot_id FROM ({_CURRENT}))) AS kept FROM ({_SNAPS})""")
def i03(i):
    return both(R.drop_snapshots(i.sql(_SNAPS), i.sql(_CURRENT), NOW), "snapshot_id")


@query("i04_drop_deleted_watches", f"SELECT watch_id, NOT coalesce(deleted_at < {T} - INTERVAL 30 DAY, false) AS kept FROM ox_rw")
def i04(i):
    return both(R.drop_deleted_watches(i.sql(WATCHES), NOW), "watch_id")


_BOARDS = """SELECT b.*, o.created_at FROM fx_boards b JOIN (SELECT concat('r', o_custkey % 1000) AS resource_id, max(o_orderdate) AS created_at FROM orders GROUP BY o_custkey % 1000) o USING (resource_id)"""


@query("i05_drop_boards", f"""
SELECT resource_id, NOT (created_at < {T} - INTERVAL 1 DAY AND NOT indexed AND resource_id NOT IN (SELECT resource_id FROM ox_rw WHERE resource_id IS NOT NULL)) AS kept FROM ({_BOARDS})""")
def i05(i):
    return both(R.drop_boards(i.sql(_BOARDS), i.sql(WATCHES), NOW), "resource_id")


_CLIENTS = """SELECT concat('c', o_custkey % 700) AS client_id, min(o_orderdate) AS created_at,
       CASE WHEN o_custkey % 700 % 3 = 1 THEN min(o_orderdate) ELSE max(o_orderdate) END AS last_seen_at, count(*) % 3 <> 0 AS token_shown
  FROM orders GROUP BY o_custkey % 700"""
_TOKENS = "SELECT concat('c', c_custkey) AS client_id FROM customer WHERE c_mktsegment = 'BUILDING'"
ORACLE_VIEWS["ox_rc"] = _CLIENTS


@query("i06_drop_idle_clients", f"""
SELECT client_id, NOT (last_seen_at < {T} - INTERVAL 90 DAY AND client_id NOT IN (SELECT client_id FROM ox_rw WHERE deleted_at IS NULL)) AS kept FROM ox_rc""")
def i06(i):
    return both(R.drop_idle_clients(i.sql(_CLIENTS), i.sql(WATCHES), NOW), "client_id")


@query("i07_drop_unshown_clients", f"""
SELECT client_id, NOT (NOT token_shown AND created_at < {T} - INTERVAL 1 HOUR AND client_id NOT IN (SELECT client_id FROM ({_TOKENS}))
       AND client_id NOT IN (SELECT client_id FROM ox_rw)) AS kept FROM ox_rc""")
def i07(i):
    return both(R.drop_unshown_clients(i.sql(_CLIENTS), i.sql(_TOKENS), i.sql(WATCHES), NOW), "client_id")


_DAYS = "SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey AS id FROM orders"
_ROWS = "SELECT o_orderkey AS id, o_orderdate AS window_start, o_orderdate AS created_at, o_orderdate AS leased_until, CASE o_orderstatus WHEN 'O' THEN 'pending' ELSE 'delivered' END AS status FROM orders"


@query("i08_drop_old_days", "SELECT id, NOT day < DATE '1998-12-01' - 400 AS kept FROM (" + _DAYS + ")")
def i08(i):
    return both(R.drop_old_days(i.sql(_DAYS), "1998-12-01"), "id")


@query("i08b_drop_rows", f"""
SELECT 'windows' AS rule, CAST(count(*) FILTER (window_start < {T} - INTERVAL 1 DAY) AS BIGINT) AS deleted, CAST(count(*) FILTER (NOT window_start < {T} - INTERVAL 1 DAY) AS BIGINT) AS kept FROM ({_ROWS})
UNION ALL SELECT 'outbox', count(*) FILTER (status <> 'pending' AND created_at < {T} - INTERVAL 7 DAY), count(*) FILTER (NOT (status <> 'pending' AND created_at < {T} - INTERVAL 7 DAY)) FROM ({_ROWS})
UNION ALL SELECT 'leases', count(*) FILTER (leased_until < {T} - INTERVAL 1 HOUR), count(*) FILTER (NOT leased_until < {T} - INTERVAL 1 HOUR) FROM ({_ROWS})""")
def i08b(i):
    rows = i.sql(_ROWS)
    return R.report(windows=R.drop_windows(rows, NOW), outbox=R.drop_finished_outbox(rows, NOW), leases=R.drop_leases(rows, NOW))


_USERS = "SELECT concat('u', c_custkey) AS user_id, CASE WHEN c_custkey % 3 <> 0 THEN concat('c', c_custkey) END AS client_id FROM customer"
_GONE = "SELECT concat('u', c_custkey) AS user_id FROM customer WHERE c_nationkey % 4 = 0"
_OUT = "SELECT o_orderkey AS id, concat('w', o_custkey) AS watch_id FROM orders"


@query("i09_delete_accounts", f"""
WITH gc AS (SELECT client_id FROM ({_USERS}) WHERE user_id IN (SELECT user_id FROM ({_GONE})) AND client_id IS NOT NULL)
SELECT 'users' AS "table", count(*) AS n FROM ({_USERS}) WHERE user_id NOT IN (SELECT user_id FROM ({_GONE}))
UNION ALL SELECT 'clients', count(*) FROM ox_rc WHERE client_id NOT IN (SELECT client_id FROM gc)
UNION ALL SELECT 'watches', count(*) FROM ox_rw WHERE client_id NOT IN (SELECT client_id FROM gc)
UNION ALL SELECT 'outbox', count(*) FROM ({_OUT}) WHERE watch_id NOT IN (SELECT watch_id FROM ox_rw WHERE client_id IN (SELECT client_id FROM gc))""")
def i09(i):
    left = R.delete_accounts(i.sql(_GONE), i.sql(_USERS), i.sql(_CLIENTS.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")), i.sql(WATCHES), i.sql(_OUT))
    out = None
    for name, df in left.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = row if out is None else out.unionByName(row)
    return out
