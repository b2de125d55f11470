"""DuckDB SQL that answers each query of `queries` on the same tables."""

from __future__ import annotations

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)

KNOWN = """
known AS (
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice
    FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'
)"""

CHANGED = """
changed AS (
    SELECT o_orderkey, o_custkey, 'X' AS o_orderstatus, o_totalprice * 2 AS o_totalprice,
           CASE WHEN o_orderpriority = '1-URGENT' THEN 'D'
                WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'U' ELSE 'I' END AS op
    FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'
)"""

CDC = f"""
WITH {KNOWN}, {CHANGED},
merged AS (
    SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey,
           CASE WHEN t.o_orderkey IS NULL OR s.op = 'U' THEN s.o_custkey ELSE t.o_custkey END AS o_custkey,
           CASE WHEN t.o_orderkey IS NULL OR s.op = 'U' THEN s.o_orderstatus ELSE t.o_orderstatus END AS o_orderstatus,
           CASE WHEN t.o_orderkey IS NULL OR s.op = 'U' THEN s.o_totalprice ELSE t.o_totalprice END AS o_totalprice
    FROM known t FULL JOIN changed s ON t.o_orderkey = s.o_orderkey
    WHERE CASE WHEN t.o_orderkey IS NULL THEN s.op = 'I'
               WHEN s.op = 'D' THEN FALSE ELSE TRUE END
)"""


def daily(where: str) -> str:
    return f"""
    SELECT CAST(o_orderdate AS DATE) AS order_date, COUNT(*) AS order_count,
           CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS revenue
    FROM orders WHERE {where} GROUP BY 1"""


def skew(group: str, value: str, source: str, threshold: float, name: str) -> str:
    return f"""
    WITH ranked AS (
        SELECT {group} AS g, {value} AS v,
               ROW_NUMBER() OVER (PARTITION BY {group} ORDER BY {value}) - 1 AS i,
               COUNT(*) OVER (PARTITION BY {group}) AS n
        FROM {source} WHERE {value} IS NOT NULL
    ), picked AS (
        SELECT g, COUNT(*) AS n, MIN(v) AS min,
               MAX(CASE WHEN i = n // 4 THEN v END) AS p25,
               MAX(CASE WHEN i = n // 2 THEN v END) AS median,
               CAST(SUM(CAST(v AS DECIMAL(12,2))) AS DOUBLE) / COUNT(*) AS mean,
               MAX(CASE WHEN i = 3 * n // 4 THEN v END) AS p75,
               MAX(v) AS max
        FROM ranked GROUP BY g
    ), rated AS (
        SELECT *, CASE WHEN median > 0 THEN max / median ELSE 0.0 END AS ratio FROM picked
    )
    SELECT g AS {name}, n, min, p25, median, mean, p75, max, ratio, ratio >= {threshold} AS skewed
    FROM rated"""


ORDER_STAGE_TIMES = """
SELECT o_orderkey AS stage_id, o_orderpriority AS name,
       CASE WHEN o_orderstatus = 'F' THEN 'COMPLETE' ELSE 'UNKNOWN' END AS status,
       CAST(0 AS INTEGER) AS num_tasks,
       CASE WHEN o_orderstatus NOT IN ('F', 'O') AND o_orderpriority = '5-LOW' THEN 0
            ELSE epoch_ms(o_orderdate) END AS start_ms,
       CAST(CASE WHEN o_orderstatus = 'F' THEN 250 ELSE 1 END AS BIGINT) AS duration_ms
FROM orders"""

HOT = """
WITH hot AS (
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity,
           CASE WHEN l_linenumber <= 2 THEN (SELECT min(l_orderkey) FROM lineitem) ELSE l_orderkey END AS o_orderkey FROM lineitem
)"""

YEARLY = """
WITH base AS (
    SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS order_year FROM orders
), hit AS (
    SELECT * FROM base WHERE order_year = 1995 AND o_orderkey % 50 < 2
), upserted AS (
    SELECT o_orderkey, o_orderstatus,
           CASE WHEN o_orderkey IN (SELECT o_orderkey FROM hit) THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, order_year
    FROM base
    UNION ALL
    SELECT o_orderkey + 1000000000, o_orderstatus, o_totalprice, order_year FROM hit
), kept AS (
    SELECT * FROM upserted WHERE NOT (order_year = 1997 AND o_orderkey % 3 = 0)
), touched AS (
    SELECT DISTINCT order_year FROM hit
    UNION
    SELECT DISTINCT order_year FROM upserted WHERE order_year = 1997 AND o_orderkey % 3 = 0
)"""

ORACLES: dict[str, str] = {
    "file_level_writes": f"""
        {YEARLY}
        SELECT *, order_year NOT IN (SELECT order_year FROM touched) AS untouched FROM kept""",
    "version_at_commit": f"{YEARLY} SELECT * FROM upserted",
    "compact_small_files": f"""
        {YEARLY}
        SELECT *, TRUE AS untouched FROM base
        UNION ALL
        SELECT o_orderkey + 1000000000, o_orderstatus, o_totalprice, order_year, FALSE FROM base
        WHERE order_year < 1997 AND o_orderkey % 60 < 3""",
    "versions_by_commit": f"""
        {YEARLY}, sizes AS (
            SELECT (SELECT COUNT(DISTINCT order_year) FROM base) AS y, (SELECT COUNT(*) FROM base) AS b,
                   (SELECT COUNT(*) FROM upserted) AS u, (SELECT COUNT(*) FROM kept) AS k,
                   (SELECT COUNT(*) FROM base WHERE order_year = 1996) AS more
        )
        SELECT CAST(1 AS BIGINT) AS commit_no, 'append' AS operation, y AS live_files, b AS live_rows FROM sizes
        UNION ALL SELECT 2, 'overwrite', y, u FROM sizes
        UNION ALL SELECT 3, 'delete', y, k FROM sizes
        UNION ALL SELECT 4, 'append', y + 1, k + more FROM sizes
        UNION ALL SELECT 5, 'replace', y, k + more FROM sizes""",
    "log_records": """
        WITH traces AS (
            SELECT l_orderkey, COUNT(*) AS n, string_agg(chr(10) || chr(9) || 'at part ' || l_partkey || ' of ' || l_suppkey, ''
                   ORDER BY l_linenumber, l_partkey, l_suppkey) AS t FROM lineitem GROUP BY 1
        )
        SELECT o_orderdate + INTERVAL 10 YEARS AS ts, 'ERROR' AS level, 'Order' AS component, 'key ' || o_orderkey || coalesce(t, '') AS message,
               coalesce(n, 0) + 1 AS line_count
        FROM orders LEFT JOIN traces ON l_orderkey = o_orderkey""",
    "salted_join": f"{HOT} SELECT hot.*, o_orderstatus FROM hot JOIN orders USING (o_orderkey)",
    "salted_totals": f"""
        {HOT} SELECT o_orderkey, COUNT(*) AS items, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, MAX(l_linenumber) AS last_line,
                     COUNT(DISTINCT l_partkey) AS parts FROM hot GROUP BY 1""",
    "balanced_reads": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1000.0 WHEN o_orderkey % 10 <> 1 THEN o_totalprice END::DOUBLE AS price, TRUE AS even
        FROM orders""",
    "log_page": """
        SELECT row_number() OVER (ORDER BY event_id) - 1 AS line_no, lpad(event_id::VARCHAR, 12, '0') || ' ' || event_type AS value
        FROM events ORDER BY event_id LIMIT 500 OFFSET (SELECT COUNT(*) // 2 FROM events)""",
    "rows_unchanged": """
        SELECT unnest(['compacted', 'one_changed']) AS "check", COUNT(*) AS observed, COUNT(*) AS expected,
               unnest([TRUE, FALSE]) AS passed FROM lineitem""",
    "changed_rows": """
        WITH old AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders), new AS (
            SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 500 = 7 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
            FROM old WHERE o_orderkey % 500 <> 8
            UNION ALL SELECT * FROM old WHERE o_orderkey % 500 = 9
        ), counted AS (
            SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(SUM(b) AS BIGINT) AS rows_before, CAST(SUM(a) AS BIGINT) AS rows_after
            FROM (SELECT *, 1 AS b, 0 AS a FROM old UNION ALL SELECT *, 0, 1 FROM new) GROUP BY ALL
        )
        SELECT * FROM counted WHERE rows_before <> rows_after""",
    "differing_keys": """
        SELECT o_orderkey, 'gone' AS change FROM orders WHERE o_orderkey % 300 = 5
        UNION ALL SELECT o_orderkey + 1000000000, 'new' FROM orders WHERE o_orderkey % 300 = 6""",
    "sync_with_deletions": """
        WITH base AS (
            SELECT *, CAST(year(o_orderdate) AS INTEGER) AS order_year, max(o_orderdate) OVER () AS mark FROM orders
        ), marked AS (
            SELECT *, order_year = 1996 AND o_orderkey % 40 = 3 AS is_deleted,
                   CASE WHEN o_orderkey % 100 = 1 THEN o_orderdate + INTERVAL 4000 DAYS ELSE o_orderdate END AS moved FROM base
        )
        SELECT o_orderkey, order_year, is_deleted,
               CASE WHEN o_orderkey % 100 = 1 AND NOT is_deleted AND moved >= mark THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
               CASE WHEN NOT is_deleted AND moved >= mark THEN moved ELSE o_orderdate END AS o_orderdate
        FROM marked""",
    "vacuum_live": f"{YEARLY} SELECT order_year, 'removed' AS reason, CAST(1 AS BIGINT) AS candidates FROM touched",
    "gold_daily_revenue": daily("o_orderstatus = 'F'"),
    "silver_orders": """
        SELECT o_orderkey AS id, o_custkey AS user_id, o_orderstatus AS status,
               CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS total_amount,
               CAST(o_orderdate AS DATE) AS order_date
        FROM orders WHERE o_orderstatus IS NOT NULL""",
    "avg_over_threshold": "SELECT AVG(p_size) AS avg_p_size FROM part WHERE p_size > 25",
    "bucket_histogram": """
        SELECT CAST(FLOOR(p_size / 10) * 10 AS BIGINT) AS bucket, COUNT(*) AS row_count
        FROM part GROUP BY 1 ORDER BY 1""",
    "line_total": """
        SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS quantity,
               CAST(CAST(l_quantity AS INTEGER) * CAST(l_extendedprice AS DECIMAL(10,2)) AS DOUBLE) AS line_total
        FROM lineitem""",
    "append_rows": "SELECT * FROM orders",
    "overwrite_partitions": """
        SELECT o_orderkey,
               CASE WHEN year(o_orderdate) >= 1998 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
               o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS order_year
        FROM orders""",
    "replace_table": """
        SELECT o_orderkey AS id, o_custkey AS user_id, o_orderstatus AS status,
               CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS total_amount,
               CAST(o_orderdate AS DATE) AS order_date, CAST(year(o_orderdate) AS INTEGER) AS order_year
        FROM orders WHERE o_orderstatus IS NOT NULL""",
    "merge_upsert": f"""
        WITH {KNOWN}, {CHANGED}
        SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey,
               CASE WHEN t.o_orderkey IS NULL THEN s.o_custkey ELSE t.o_custkey END AS o_custkey,
               CASE WHEN s.o_orderkey IS NULL THEN t.o_orderstatus ELSE s.o_orderstatus END AS o_orderstatus,
               CASE WHEN t.o_orderkey IS NULL THEN s.o_totalprice ELSE t.o_totalprice END AS o_totalprice
        FROM known t FULL JOIN changed s ON t.o_orderkey = s.o_orderkey""",
    "merge_bucketed": f"""
        WITH {KNOWN}, {CHANGED}
        SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey,
               CASE WHEN t.o_orderkey IS NULL THEN s.o_custkey ELSE t.o_custkey END AS o_custkey,
               CASE WHEN e.o_orderkey IS NOT NULL THEN 'Y'
                    WHEN s.o_orderkey IS NULL THEN t.o_orderstatus ELSE s.o_orderstatus END AS o_orderstatus,
               CASE WHEN t.o_orderkey IS NULL THEN s.o_totalprice ELSE t.o_totalprice END AS o_totalprice
        FROM known t FULL JOIN changed s ON t.o_orderkey = s.o_orderkey
        LEFT JOIN orders e ON e.o_orderkey = t.o_orderkey AND e.o_orderdate < TIMESTAMP '1998-01-01'""",
    "merge_daily_idempotent": daily("o_orderstatus = 'F'"),
    "merge_partitions": """
        SELECT o_orderkey,
               CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
               o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS order_year
        FROM orders""",
    "cdc_merge": f"{CDC} SELECT * FROM merged",
    "cdc_collapse": """
        WITH outbox AS (
            SELECT user_id, event_id, ts, value,
                   CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op,
                   ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS up,
                   ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS down
            FROM events
        )
        SELECT l.user_id, l.event_id, l.ts, l.value,
               CASE WHEN l.op = 'D' THEN 'D' WHEN f.op = 'I' THEN 'I' ELSE 'U' END AS op
        FROM outbox l JOIN outbox f ON l.user_id = f.user_id AND l.down = 1 AND f.up = 1""",
    "cdc_collapse_merge": """
        WITH outbox AS (
            SELECT user_id, value,
                   CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op,
                   ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS up,
                   ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS down
            FROM events
        ), net AS (
            SELECT l.user_id, l.value,
                   CASE WHEN l.op = 'D' THEN 'D' WHEN f.op = 'I' THEN 'I' ELSE 'U' END AS op
            FROM outbox l JOIN outbox f ON l.user_id = f.user_id AND l.down = 1 AND f.up = 1
        ), held AS (
            SELECT c_custkey + 20 AS user_id, c_acctbal AS value FROM customer
        )
        SELECT coalesce(t.user_id, s.user_id) AS user_id,
               CASE WHEN t.user_id IS NULL OR s.op = 'U' THEN s.value ELSE t.value END AS value
        FROM held t FULL JOIN net s ON t.user_id = s.user_id
        WHERE CASE WHEN t.user_id IS NULL THEN s.op = 'I' WHEN s.op = 'D' THEN FALSE ELSE TRUE END""",
    "latest_change": """
        SELECT event_id, ts, user_id, event_type, value, props FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events
        ) WHERE rn = 1""",
    "soft_delete_live": "SELECT * FROM labels WHERE toxic = 0",
    "soft_delete_upsert": """
        SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'active' ELSE 'reviewed' END AS status,
               FALSE AS is_deleted
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
        WHERE coalesce(l.toxic, 0) <> 1""",
    "delete_where": "SELECT * FROM lineitem WHERE NOT coalesce(l_returnflag = 'R', FALSE)",
    "sync_full": """
        SELECT 'customer' AS table_name, c_custkey AS id, c_name AS label, 'overwrite' AS operation FROM customer
        UNION ALL
        SELECT 'part', p_partkey, p_name, 'overwrite' FROM part""",
    "sync_incremental": "SELECT * FROM events",
    "incremental_extract": """
        SELECT * FROM events
        WHERE ts > (SELECT MAX(ts) FROM events WHERE ts < TIMESTAMP '2024-01-16')""",
    "incremental_upsert": "SELECT * FROM events",
    "change_summary": f"""
        {CDC}, compared AS (
            SELECT CASE WHEN t.o_orderkey IS NULL THEN 'inserted'
                        WHEN m.o_orderkey IS NULL THEN 'deleted'
                        WHEN (t.o_custkey, t.o_orderstatus, t.o_totalprice)
                             IS DISTINCT FROM (m.o_custkey, m.o_orderstatus, m.o_totalprice) THEN 'updated'
                        ELSE 'unchanged' END AS change
            FROM known t FULL JOIN merged m ON t.o_orderkey = m.o_orderkey
        )
        SELECT c.change, COUNT(x.change) AS row_count
        FROM (VALUES ('inserted'), ('updated'), ('deleted'), ('unchanged')) c(change)
        LEFT JOIN compared x ON x.change = c.change GROUP BY 1""",
    "recent_snapshots": """
        SELECT event_id AS snapshot_id, ts AS committed_at, event_type AS operation
        FROM events ORDER BY ts DESC, event_id DESC LIMIT 20""",
    "latest_operation": """
        SELECT user_id AS table_name, event_type AS operation FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events
        ) WHERE rn = 1""",
    "snapshot_counts": """
        SELECT user_id AS table_name, event_type AS operation, COUNT(*) AS snapshots
        FROM events GROUP BY 1, 2""",
    "operation_history": """
        SELECT user_id AS table_name, ts AS committed_at, event_id AS snapshot_id, event_type AS operation
        FROM events ORDER BY 1, 2, 3""",
    "drop_consecutive_duplicates": """
        SELECT event_id, ts, user_id, event_type, value, props FROM (
            SELECT *, LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous,
                   ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
            FROM events
        ) WHERE rn = 1 OR event_type IS DISTINCT FROM previous""",
    "last_n": """
        SELECT * FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 500) ORDER BY ts, event_id""",
    "page_rows": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 1000",
    "page_after_key": """
        SELECT * FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1998-01-01', 0)
        ORDER BY o_orderdate, o_orderkey LIMIT 100""",
    "page_state": """
        WITH counted AS (SELECT COUNT(*) AS total FROM events),
        sized AS (SELECT total, greatest(least(total - 950, 100), 0) AS returned FROM counted)
        SELECT CAST(950 AS BIGINT) AS start, returned, total, 950 + returned AS next_from,
               950 + returned >= total AS done
        FROM sized""",
    "skew_report": skew("l_suppkey", "l_extendedprice", "lineitem", 2.0, "l_suppkey"),
    "skew_report_events": skew("user_id", "value", "events", 3.0, "user_id"),
    "key_skew": f"""
        WITH per_key AS (
            SELECT 1 AS one, CAST(COUNT(*) AS DOUBLE) AS rows_per_key FROM orders GROUP BY o_custkey
        ), report AS ({skew("one", "rows_per_key", "per_key", 2.0, "one")})
        SELECT n, min, p25, median, mean, p75, max, ratio, skewed FROM report""",
    "timeline_users": """
        WITH spans AS (
            SELECT user_id, epoch_us(MIN(ts)) // 1000 AS start_ms, epoch_us(MAX(ts)) // 1000 AS end_ms,
                   CAST(COUNT(*) AS INTEGER) AS num_tasks, arg_max(event_type, (ts, event_id)) AS last_type
            FROM events GROUP BY user_id
        ), stages AS (
            SELECT user_id AS stage_id, 'events of one user: ' || user_id AS name,
                   CASE last_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'COMPLETE' ELSE 'ACTIVE' END AS status,
                   num_tasks, start_ms, greatest(end_ms - start_ms, 1) AS duration_ms
            FROM spans
        ), ends AS (
            SELECT MIN(start_ms) AS first, greatest(MAX(start_ms + duration_ms) - MIN(start_ms), 1) AS span_ms
            FROM stages
        ), bars AS (
            SELECT s.*, e.span_ms,
                   CAST(round(CAST(start_ms - first AS DOUBLE) / CAST(span_ms AS DOUBLE) * 55) AS INTEGER) AS offset_cols,
                   CAST(round(CAST(duration_ms AS DOUBLE) / CAST(span_ms AS DOUBLE) * 55) AS INTEGER) AS length
            FROM stages s, ends e
        ), cut AS (
            SELECT *, least(greatest(length, 1), greatest(55 - offset_cols, 0)) AS bar_cols FROM bars
        )
        SELECT stage_id, name, status, num_tasks, start_ms, duration_ms, span_ms, offset_cols, bar_cols,
               CASE WHEN length(name) > 22 THEN substr(name, 1, 21) || '…' ELSE name END AS label,
               repeat(' ', offset_cols)
               || repeat(CASE status WHEN 'ACTIVE' THEN '▓' ELSE '█' END, bar_cols) AS bar
        FROM cut""",
    "stage_times_orders": ORDER_STAGE_TIMES,
    "task_metrics": """
        SELECT l_orderkey AS stage_id, l_partkey AS task_id, l_extendedprice AS run_time_ms FROM lineitem""",
    "skew_from_event_log": skew("l_suppkey", "l_extendedprice", "lineitem", 2.0, "stage_id"),
    "stages_from_event_log": """
        SELECT o_orderkey AS stage_id, o_orderpriority AS name,
               CASE WHEN o_orderstatus = 'P' THEN 'FAILED' ELSE 'COMPLETE' END AS status,
               CAST(o_custkey AS INTEGER) AS num_tasks, epoch_ms(o_orderdate) AS start_ms,
               greatest(o_custkey, 1) AS duration_ms
        FROM orders""",
    "parse_driver_log": """
        SELECT CASE WHEN event_type <> 'error' THEN date_trunc('second', ts) END AS ts,
               CASE WHEN event_type <> 'error' THEN upper(event_type) END AS level,
               CASE WHEN event_type <> 'error' THEN 'User' || user_id END AS component,
               CASE WHEN event_type <> 'error' THEN 'props: ' || props
                    ELSE chr(9) || 'at user ' || user_id END AS message
        FROM events""",
    "partition_inventory": """
        SELECT l_returnflag, l_linestatus, COUNT(*) AS row_count FROM lineitem GROUP BY 1, 2""",
    "rows_per_file": """
        SELECT 'lineitem.parquet' AS file_name, COUNT(*) AS row_count FROM lineitem
        UNION ALL SELECT 'orders.parquet', COUNT(*) FROM orders""",
    "list_status": """
        WITH status AS (
            SELECT CASE WHEN lang = 'en' THEN '.' ELSE '' END || 'doc-' || doc_id AS name, '-' AS type,
                   n_chars * 4096 AS length, source AS owner,
                   epoch_ms(CAST(1735689600000 + n_chars * 60000 AS BIGINT)) AS modified, '644 r=3' AS perms
            FROM documents
            UNION ALL
            SELECT DISTINCT source, 'd', 0, 'spark', TIMESTAMP '2025-01-01', '755 r=0' FROM documents
        )
        SELECT type, name,
               CASE WHEN type = 'd' THEN '-'
                    WHEN length < 1024 THEN printf('%d B', length)
                    WHEN length < 1048576 THEN printf('%.1f KB', length / 1024.0)
                    WHEN length < 1073741824 THEN printf('%.1f MB', length / 1048576.0)
                    ELSE printf('%.2f GB', length / 1073741824.0) END AS size,
               strftime(modified, '%Y-%m-%d %H:%M') AS modified, owner, perms
        FROM status WHERE name NOT LIKE '.%'""",
    "compact_files": "SELECT * FROM lineitem",
    "compact_partitions": "SELECT * FROM lineitem",
    "partition_files": """
        SELECT l_returnflag, l_linestatus, COUNT(*) AS row_count, TRUE AS has_files, TRUE AS has_bytes
        FROM lineitem GROUP BY 1, 2""",
    "vacuum_candidates": """
        SELECT 'part-' || o_orderkey AS path, o_orderdate AS modified FROM orders
        WHERE o_orderpriority <> '1-URGENT' AND o_orderdate < TIMESTAMP '2000-01-01' - INTERVAL 168 HOURS""",
    "human_size": """
        WITH sized AS (
            SELECT doc_id, n_chars * factor AS bytes
            FROM documents, (VALUES (1), (64), (8192), (1048576)) f(factor)
        )
        SELECT doc_id, bytes,
               CASE WHEN bytes < 1024 THEN printf('%d B', bytes)
                    WHEN bytes < 1048576 THEN printf('%.1f KB', bytes / 1024.0)
                    WHEN bytes < 1073741824 THEN printf('%.1f MB', bytes / 1048576.0)
                    ELSE printf('%.2f GB', bytes / 1073741824.0) END AS size
        FROM sized""",
    "format_mtime": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS modified FROM events",
    "hdfs_path": """
        SELECT doc_id, CASE lang WHEN 'de' THEN '/' ELSE '/docs/' || source END AS path FROM documents""",
    "split_key_value": """
        SELECT page_id,
               CASE WHEN instr(url, '=') > 0 THEN substr(url, 1, instr(url, '=') - 1) END AS key,
               CASE WHEN instr(url, '=') > 0 THEN substr(url, instr(url, '=') + 1) END AS value,
               instr(url, '=') > 0 AS valid
        FROM pages""",
    "history_lines": """
        SELECT conv_id, turn,
               '[' || strftime(TIMESTAMP '2024-01-01' + to_days(CAST(turn AS INTEGER)), '%Y-%m-%d %H:%M:%S') || '] '
               || replace(text, chr(10), ' ') AS line
        FROM conversations""",
    "render_tsv": """
        SELECT o_orderkey || chr(9) || CASE WHEN o_orderstatus = 'P' THEN 'None' ELSE o_orderstatus END
               || chr(9) || strftime(o_orderdate, '%Y-%m-%d') AS line
        FROM orders""",
    "export_csv": "SELECT doc_id, text, lang FROM documents",
    "export_json": "SELECT * FROM conversations",
    "row_count_check": """
        WITH counts AS (
            SELECT COUNT(*) AS raw, COUNT(o_orderstatus) AS silver FROM orders
        )
        SELECT 'not_empty' AS "check", silver AS observed, CAST(1 AS BIGINT) AS expected, silver > 0 AS passed FROM counts
        UNION ALL
        SELECT 'same_row_count', silver, raw, silver = raw FROM counts""",
    "increase_check": """
        WITH counts AS (
            SELECT COUNT(*) AS later, COUNT(*) FILTER (WHERE o_orderdate < TIMESTAMP '2000-01-01') AS earlier FROM orders
        )
        SELECT 'row_count_increased' AS "check", later AS observed, earlier AS expected, later > earlier AS passed
        FROM counts""",
    "null_counts": """
        SELECT 'event_id' AS column_name, COUNT(*) - COUNT(event_id) AS null_count FROM events
        UNION ALL SELECT 'value', COUNT(*) - COUNT(value) FROM events
        UNION ALL SELECT 'refund', COUNT(*) - COUNT(CASE WHEN event_type = 'purchase' THEN value END) FROM events""",
    "duplicate_keys": """
        SELECT l_orderkey, l_linenumber, COUNT(*) AS row_count
        FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1""",
    "orphan_rows": """
        WITH items AS (
            SELECT CASE WHEN l_linenumber = 1 THEN l_orderkey + 1000000000 ELSE l_orderkey END AS l_orderkey,
                   l_linenumber, l_partkey
            FROM lineitem
        )
        SELECT l_orderkey, l_linenumber, l_partkey FROM items l
        WHERE l_orderkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)""",
    "file_inventory": " UNION ALL ".join(
        f"SELECT '{name}.parquet' AS file_name, COUNT(*) AS row_count, TRUE AS same_bytes FROM {name}" for name in TABLES
    ),
    "sync_updated": """
        SELECT o_orderkey, o_orderstatus,
               CASE WHEN o_orderstatus = 'P' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
               CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL 4000 DAYS ELSE o_orderdate END AS o_orderdate
        FROM orders""",
    "commit_history": """
        WITH n AS (
            SELECT COUNT(*) AS whole, COUNT(*) FILTER (o_orderstatus = 'P') AS p,
                   COUNT(*) FILTER (o_orderstatus = 'F') AS f, COUNT(*) FILTER (o_totalprice = 0 AND o_orderstatus <> 'F') AS zero
            FROM orders
        )
        SELECT 0::INTEGER AS commit_no, 'append' AS operation, whole - p AS row_count FROM n
        UNION ALL SELECT 1, 'overwrite', whole FROM n
        UNION ALL SELECT 2, 'overwrite', whole + p FROM n
        UNION ALL SELECT 3, 'delete', whole + p - f - zero FROM n
        UNION ALL SELECT 4, 'replace', whole + p - f - zero FROM n""",
    "invalid_values": """
        SELECT * FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')""",
    "generated_users": """
        SELECT 'user_' || i AS username, TRUE AS age_fits, TRUE AS time_fits
        FROM range(1, (SELECT COUNT(*) + 1 FROM customer)) r(i)""",
}
