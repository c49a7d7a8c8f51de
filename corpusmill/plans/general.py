"""Queries of the general training-data operators: change feed, orphan references, intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import incremental, intervals, orphans
from corpusmill.session import read, scratch


def p1_found(spark, d):
    """Exactly the new or changed file versions of every succeeded run: a runner without a watermark takes up all windows
    of the log and commits them."""
    return incremental.changed_versions(read(spark, d, "files"), read(spark, d, "index_runs"), scratch(spark))


def p1_runs(spark, d):
    """Window and number of changed files of every succeeded run."""
    runs = incremental.run_summary(p1_found(spark, d), read(spark, d, "index_runs"))
    return runs.withColumns({c: F.unix_micros(c) for c in ("lower_excl", "upper_incl")})


def _orphans(spark, d):
    tables = {"chunks": read(spark, d, "chunks"), "sample_data": read(spark, d, "sample_data")}
    return orphans.orphan_rows(tables, read(spark, d, "files"), read(spark, d, "file_deletions"))


def p2_found(spark, d):
    """Rows of chunks and sample_data whose file is missing, deleted or came later."""
    return _orphans(spark, d).select("table_name", "row_id")


def p2_report(spark, d):
    """Orphan rows and keys per table, day and reason."""
    return orphans.orphan_report(_orphans(spark, d)).withColumn("period", F.date_format("period", "yyyy-MM-dd"))


def p3_found(spark, d):
    """Gaps between the line ranges of a file."""
    return intervals.gaps(read(spark, d, "chunks"), "file_id", "start_line", "end_line")


def p3_periods(spark, d):
    """Continuous stretches of covered lines of a file."""
    return intervals.merged(read(spark, d, "chunks"), "file_id", "start_line", "end_line")


QUERIES = {f.__name__: f for f in (p1_found, p1_runs, p2_found, p2_report, p3_found, p3_periods)}

_NORM = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({0}, '\', '/'), '/+', '/', 'g'), '(^|/)(\./)+', '\1', 'g'), '/\.$', ''), '(.)/$', '\1')"
_RUNS = """succ AS (SELECT run_id, started_at, lag(run_id) OVER (ORDER BY started_at, run_id) AS prev FROM (
  SELECT run_id, max(started_at) AS started_at, arg_max(lower(trim(status, E' \\t\\n\\r')), logged_at) AS st FROM index_runs GROUP BY run_id) WHERE st = 'succeeded')"""
_VERS = f"""v AS (SELECT {_NORM.format("repo_path")} AS repo, {_NORM.format("file_path")} AS path, lower(trim(file_hash, E' \\t\\n\\r')) AS h, created_at, id, arrived_at
  FROM files WHERE trim(file_hash, E' \\t\\n\\r') <> '')"""
_P1 = f"""WITH {_RUNS}, {_VERS},
cur AS (SELECT s.run_id, s.prev, repo, path, arg_max(h, (created_at, id)) AS h, arg_max(id, (created_at, id)) AS id
  FROM succ s JOIN v ON v.arrived_at <= s.started_at GROUP BY ALL)
SELECT c.run_id, c.id FROM cur c LEFT JOIN cur p ON p.run_id = c.prev AND p.repo = c.repo AND p.path = c.path
WHERE p.h IS NULL OR p.h <> c.h"""
_P2 = """WITH r AS (SELECT 'chunks' AS table_name, CAST(id AS VARCHAR) AS row_id, file_id, min(created_at) AS created_at FROM chunks WHERE file_id IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'sample_data', id, file_id, min(created_at) FROM sample_data WHERE file_id IS NOT NULL GROUP BY ALL),
f AS (SELECT id, min(arrived_at) AS arrived_at FROM files GROUP BY id),
x AS (SELECT file_id FROM file_deletions GROUP BY file_id HAVING arg_max(restored_at IS NULL, deleted_at)),
o AS (SELECT r.*, CASE WHEN f.id IS NULL OR x.file_id IS NOT NULL THEN 'no target' ELSE 'target came later' END AS reason
  FROM r LEFT JOIN f ON f.id = r.file_id LEFT JOIN x ON x.file_id = r.file_id
  WHERE f.id IS NULL OR x.file_id IS NOT NULL OR f.arrived_at > r.created_at)"""
_P3 = """WITH i AS (SELECT file_id, start_line AS s, end_line AS t, max(end_line) OVER (PARTITION BY file_id ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b
  FROM chunks WHERE file_id > 0 AND start_line >= 1 AND end_line >= start_line)"""

ORACLE = {
    "p1_found": _P1,
    "p1_runs": f"""WITH n AS ({_P1}), {_RUNS} SELECT s.run_id, epoch_us(lag(s.started_at) OVER (ORDER BY s.started_at, s.run_id)) AS lower_excl, epoch_us(s.started_at) AS upper_incl,
  (SELECT count(*) FROM n WHERE n.run_id = s.run_id) AS n_changed FROM succ s""",
    "p2_found": f"{_P2} SELECT DISTINCT table_name, row_id FROM o",
    "p2_report": f"{_P2} SELECT table_name, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS period, reason, count(*) AS n_rows, count(DISTINCT file_id) AS n_keys FROM o GROUP BY ALL",
    "p3_found": f"{_P3} SELECT file_id, CAST(b + 1 AS BIGINT) AS gap_start, CAST(s - 1 AS BIGINT) AS gap_end FROM i WHERE s > b + 1",
    "p3_periods": f"""{_P3}, g AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS k FROM i)
SELECT file_id, CAST(min(s) AS BIGINT) AS period_start, CAST(max(t) AS BIGINT) AS period_end, count(DISTINCT s) AS n_starts FROM g GROUP BY file_id, k""",
}
