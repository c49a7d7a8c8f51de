"""Change feed, orphan references, intervals: against brute force, with nulls, ties, repeated rows, empty tables and extra columns."""

import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import incremental, intervals, orphans
from corpusmill.session import scratch

T0 = datetime(2025, 3, 1, tzinfo=timezone.utc)
FILES = "id bigint, repo_path string, file_path string, file_hash string, created_at timestamp, arrived_at timestamp, key string, win int"
RUNS = "run_id bigint, started_at timestamp, status string, logged_at timestamp"
DELS = "file_id bigint, deleted_at timestamp, restored_at timestamp"


def at(hours):
    return None if hours is None else T0 + timedelta(hours=hours)


def make_feed(seed, n=120):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        path = r.choice(["a.py", "./a.py", "x//b.py", "x\\b.py", "c/./d.py", "c/d.py/"])
        h = r.choice(["h1", " H1 ", "h2", "h3", None, "", "  "])
        made = r.randint(0, 40)
        rows.append((i, r.choice(["/r", "/r/"]), path, h, at(made), at(made + r.choice([0, 0, 1, 30])), "k", 1))
    rows += r.sample(rows, 10)
    runs = []
    for k in range(8):
        start = at(6 * k + 3)
        runs += [(k, start, "running", start), (k, start, r.choice(["succeeded", " SUCCEEDED", "failed"]), start + timedelta(hours=1))]
    runs += runs[:2]
    return rows, runs


def norm(p):
    return ("/" if p.startswith("/") else "") + "/".join(s for s in p.replace("\\", "/").split("/") if s not in ("", "."))


def brute(rows, runs):
    last = {}
    for run, start, status, logged in runs:
        last[run] = max(last.get(run, (logged, "", start)), (logged, status.strip().lower(), start))
    ok = sorted((v[2], k) for k, v in last.items() if v[1] == "succeeded")
    before, out = {}, set()
    for start, run in ok:
        cur = {}
        for id_, repo, path, h, made, arrived, *_ in rows:
            if h is None or not h.strip() or arrived > start:
                continue
            key = (norm(repo), norm(path))
            cur[key] = max(cur.get(key, ((made, id_), "")), ((made, id_), h.strip().lower()))
        out |= {(run, v[0][1]) for k, v in cur.items() if before.get(k) != v[1]}
        before = {k: v[1] for k, v in cur.items()}
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_changed_versions(spark, seed):
    rows, runs = make_feed(seed)
    got = incremental.changed_versions(spark.createDataFrame(rows, FILES), spark.createDataFrame(runs, RUNS), scratch(spark)).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == brute(rows, runs)


def test_changed_versions_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(incremental, "BROADCAST_RUNS", 0)
    rows, runs = make_feed(4)
    got = incremental.changed_versions(spark.createDataFrame(rows, FILES), spark.createDataFrame(runs, RUNS), scratch(spark)).collect()
    assert set(map(tuple, got)) == brute(rows, runs)


def test_changed_versions_empty(spark):
    rows, runs = make_feed(1)
    none, no_runs = spark.createDataFrame([], FILES), spark.createDataFrame([], RUNS)
    assert incremental.changed_versions(none, spark.createDataFrame(runs, RUNS), scratch(spark)).count() == 0
    assert incremental.changed_versions(spark.createDataFrame(rows, FILES), no_runs, scratch(spark)).count() == 0
    nulls = spark.createDataFrame([(None,) * 8, (1, None, None, "h", None, at(1), None, None)], FILES)
    log = spark.createDataFrame([(5, at(2), "succeeded", at(3)), (6, None, None, None), (7, at(2), "succeeded", at(4))], RUNS)
    assert [tuple(r) for r in incremental.changed_versions(nulls, log, scratch(spark)).collect()] == [(5, 1)]


def test_feed_survives_failures(spark, tmp_path):
    """One run at a time, failing at every step: the same as the whole log at once; nothing stays of failed runs."""
    rows, runs = make_feed(7)
    feed = spark.createDataFrame(rows, FILES)
    runner = incremental.IncrementalFeed(spark, str(tmp_path / "feed"), buckets=3, compact_every=3)
    log, got, steps = {}, set(), iter(["start", "output", "commit"] * 9)
    for run, start, status, logged in runs:
        log[run] = max(log.get(run, (logged, "", start)), (logged, status.strip().lower(), start))
    for run, (_, status, start) in sorted(log.items()):
        before = runner.head()
        with pytest.raises(RuntimeError):
            runner.run(feed, start, run, fail_at=next(steps))
        assert runner.head() == before
        if status == "succeeded":
            got |= {(r["run_id"], r["id"]) for r in runner.run(feed, start, run).collect()}
    assert got == brute(rows, runs)
    head = runner.head()
    assert {m["dir"] for m in map(runner._manifest, runner._versions())} == {n for n in os.listdir(tmp_path / "feed") if n.startswith("v")}
    best = {}
    for id_, repo, path, h, made, arrived, *_ in rows:
        if h and h.strip() and incremental._micros(feed, arrived) <= head["watermark"]:
            best[norm(repo), norm(path)] = max(best.get((norm(repo), norm(path)), (at(0), -1)), (made, id_))
    state = runner.state().groupBy("repo", "path").agg(F.max("cur.ver").alias("v")).collect()
    assert {(r["repo"], r["path"]): r["v"]["id"] for r in state} == {k: v[1] for k, v in best.items()}
    with pytest.raises(RuntimeError, match="committed by another"):
        runner._commit(head["version"], {})
    assert not [n for n in os.listdir(tmp_path / "feed" / "manifests") if n.endswith(".tmp")]


def test_feed_watermark(spark, tmp_path):
    """The watermark never goes back, and a row that comes late with the watermark's own time is taken up next."""
    make = lambda *rows: spark.createDataFrame([(i, "/r", p, h, at(t), at(t), "k", 1) for i, p, h, t in rows], FILES)
    runner = incremental.IncrementalFeed(spark, str(tmp_path / "feed"))
    first = [(1, "a", "h1", 1), (2, "b", "h1", 3)]
    assert sorted(r["id"] for r in runner.run(make(*first), at(3), 1).collect()) == [1, 2]
    mark = runner.head()
    with pytest.raises(incremental.StaleRun):
        runner.run(make(*first), at(2), 2)
    assert runner.run(make(*first), at(3), 2).count() == 0 and runner.head() == mark
    later = [*first, (3, "c", "h1", 3), (4, "a", "H1", 4), (5, "b", "h2", 5)]
    log = spark.createDataFrame([(k, at(t)) for k, t in ((1, 2), (2, 3), (3, 4), (4, 9))], "run_id bigint, started_at timestamp")
    assert sorted((r["run_id"], r["id"]) for r in runner.catch_up(make(*later), log).collect()) == [(3, 3), (4, 5)]
    assert runner.catch_up(make(*later), log).count() == 0 and runner.head()["version"] == 2


def test_index_stream(spark, tmp_path):
    from corpusmill.streaming.incremental import index_stream

    schema = "id bigint, repo_path string, file_path string, file_hash string, created_at timestamp, arrived_at timestamp"
    days = [[(1, "/r", "a", "h1", at(0), at(0)), (2, "/r", "b", "h1", at(0), at(1))], [(3, "/r", "a", "h2", at(2), at(2)), (4, "/r", "b", "H1 ", at(2), at(3))], [(5, "/r", "c", None, at(4), at(4))]]
    got = []
    for day in days:
        spark.createDataFrame(day, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = index_stream(src, str(tmp_path / "store"), str(tmp_path / "ck"), lambda df, n: got.append(sorted(r["id"] for r in df.collect())))
        assert q.awaitTermination(120)
    assert got == [[1, 2], [3], []]


def test_windows(spark):
    log = spark.createDataFrame([(2, at(2)), (1, at(1)), (3, at(2))], "run_id bigint, started_at timestamp")
    h = lambda k: int(at(k).timestamp()) * 10**6
    assert sorted(map(tuple, incremental.commit_windows(log).collect())) == [(1, None, h(1)), (2, h(1), h(2))]
    assert list(map(tuple, incremental.commit_windows(log, h(1)).collect())) == [(2, h(1), h(2))]


@pytest.mark.parametrize("seed", [1, 2])
def test_orphans(spark, seed):
    r = random.Random(seed)
    files = [(i, "/r", "p", "h", at(0), at(r.randint(0, 20)), "k", 1) for i in range(30)]
    files += files[:5]
    dels = [(r.randint(0, 29), at(h), r.choice([None, at(h + 1)])) for h in range(12)]
    refs = [(i, r.choice([None, 0, -1, *range(40)]) if i % 3 else 7, r.choice([None, at(r.randint(0, 20))])) for i in range(200)]
    refs += refs[:20]
    ddl = "id bigint, file_id bigint, created_at timestamp"
    t = spark.createDataFrame(refs, ddl).withColumn("key", F.lit(1)).withColumn("salt", F.lit(2))
    got = orphans.orphan_rows({"chunks": t}, spark.createDataFrame(files, FILES), spark.createDataFrame(dels, DELS))
    seen = {f[0]: f[5] for f in files}
    state = {}
    for f, when, back in dels:
        state[f] = max(state.get(f, (when, back)), (when, back), key=lambda x: (x[0], x[1] is not None))
    gone = {f for f, (_, back) in state.items() if back is None}
    want = {str(i) for i, f, c in refs if f is not None and (f not in seen or f in gone or c is not None and c < seen[f])}
    ids = [x["row_id"] for x in got.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == want
    assert sum(x["n_rows"] for x in orphans.orphan_report(got).collect()) == len(want)


def test_orphans_hot_keys_and_rows_without_id(spark, monkeypatch):
    """Hot keys, orphan or not, are met by broadcast; rows without an id are rows of their own, the same row twice is one."""
    monkeypatch.setattr(orphans, "HOT", 0.2)
    files = spark.createDataFrame([(8, "/r", "p", "h", at(0), at(0), "k", 1), (9, "/r", "p", "h", at(0), at(5), "k", 1)], FILES)
    refs = [(i, 7, at(1)) for i in range(10)] + [(i, 8, at(1)) for i in range(10, 20)] + [(30, 9, at(4)), (30, 9, at(2)), (31, 9, at(6)), (32, 5, None)]
    refs += [(None, 5, at(1)), (None, 5, at(2)), (None, 5, at(2)), (None, 7, None)]
    t = spark.createDataFrame(refs, "id bigint, file_id bigint, created_at timestamp")
    got = orphans.orphan_rows({"t": t}, files, spark.createDataFrame([], DELS)).collect()
    ids = sorted((r["row_id"] or "", r["file_id"]) for r in got)
    assert ids == sorted([("", 5), ("", 5), ("", 7), ("30", 9), ("32", 5), *[(str(i), 7) for i in range(10)]])
    assert [r["created_at"] for r in got if r["row_id"] == "30"] == [at(2).replace(tzinfo=None)]
    old, new = t.where("id < 12 or id is null"), t.where("id >= 12")
    none = spark.createDataFrame([], DELS)
    state = orphans.fold_deltas(orphans.reference_deltas({"t": old}), orphans.existence_deltas(files, none))
    kept = orphans.fold_deltas(state, orphans.reference_deltas({"t": new}))
    assert sorted(map(str, orphans.orphan_rows({"t": t}, files, none, kept).collect())) == sorted(map(str, got))


def test_orphans_empty(spark):
    refs = spark.createDataFrame([], "id bigint, file_id bigint, created_at timestamp")
    files, dels = spark.createDataFrame([], FILES), spark.createDataFrame([], DELS)
    assert orphans.orphan_rows({"a": refs, "b": refs}, files, dels).count() == 0


def test_deltas_fold_in_steps(spark):
    refs = spark.createDataFrame([(1, 5, at(1)), (2, 5, at(2)), (3, 6, None)], "id bigint, file_id bigint, created_at timestamp")
    files = spark.createDataFrame([(5, "/r", "p", "h", at(0), at(0), "k", 1)], FILES)
    dels = spark.createDataFrame([(5, at(3), None)], DELS)
    a, b = orphans.reference_deltas({"x": refs}), orphans.existence_deltas(files, dels)
    once, twice = orphans.fold_deltas(a, b), orphans.fold_deltas(orphans.fold_deltas(a), b)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def cover(rows):
    lines = {}
    for e, s, t in rows:
        if e is not None and e > 0 and s is not None and t is not None and s >= 1 and t >= s:
            lines.setdefault(e, []).append((s, t))
    return {e: sorted({x for s, t in v for x in range(s, t + 1)}) for e, v in lines.items()}


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 5), (3, 9)])
def test_intervals(spark, seed, parts):
    r = random.Random(seed)
    rows = []
    for _ in range(400):
        s = r.choice([None, 0, -3, *range(1, 300)])
        rows.append((r.choice([None, 0, -1, 1, 1, 1, 1, 2, 3]), s, None if r.random() < 0.05 else (s or 1) + r.choice([-2, 0, 1, 5, 40])))
    rows += rows[:30]
    df = spark.createDataFrame([(*x, "t", 0) for x in rows], "f bigint, a int, b int, e string, _part int").drop("_part")
    gaps, periods = set(), set()
    for e, ls in cover(rows).items():
        start = prev = ls[0]
        for x in ls[1:]:
            if x != prev + 1:
                gaps.add((e, prev + 1, x - 1))
                periods.add((e, start, prev))
                start = x
            prev = x
        periods.add((e, start, prev))
    assert {tuple(x) for x in intervals.gaps(df, "f", "a", "b", parts).collect()} == gaps
    assert {tuple(x)[:3] for x in intervals.merged(df, "f", "a", "b", parts).collect()} == periods


def test_intervals_empty(spark):
    df = spark.createDataFrame([], "f bigint, a int, b int")
    assert intervals.gaps(df, "f", "a", "b").count() == 0 and intervals.merged(df, "f", "a", "b").count() == 0
