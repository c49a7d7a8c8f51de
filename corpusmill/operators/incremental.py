"""Processing only new or changed records.

Every run takes up the records whose commit sequence number (the time at which the feed made them visible) lies between
the watermark and an upper limit that is fixed when the run starts. The watermark is the upper limit of the last run
that succeeded. A run's output, its part of the state and its new watermark become visible together by one atomic
rename, so a failed run leaves nothing behind and the next one takes up the same records again.

Records at the watermark itself are read once more: taking up a version twice changes nothing, since the state holds the
greatest version of each file, and a record that came late with the watermark's own time is not lost.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpusmill.functions.paths import normal_hash, normal_path
from corpusmill.session import shuffle_partitions

#: Windows are attached to the feed by a broadcast join up to this many pending runs, beyond by a shuffled one.
BROADCAST_RUNS = 100_000


_STATE = "bucket int, repo string, path string, cur struct<ver: struct<created_at: timestamp, id: bigint>, hash: string>"


class StaleRun(ValueError):
    """A run whose upper limit lies before the watermark."""


def succeeded_runs(runs: DataFrame) -> DataFrame:
    """run_id, started_at of the runs whose last logged status, trimmed and in any case, is 'succeeded'.

    Ties in logged_at go to the greatest status text. Runs without a start are no runs.
    """
    status = F.lower(F.regexp_replace("status", r"^\s+|\s+$", ""))
    return (
        runs.groupBy("run_id")
        .agg(F.max(F.struct("logged_at", status.alias("s"))).alias("last"), F.max("started_at").alias("started_at"))
        .where((F.col("last.s") == "succeeded") & F.col("started_at").isNotNull())
        .select("run_id", "started_at")
    )


def commit_windows(runs: DataFrame, watermark: int | None = None) -> DataFrame:
    """run_id, lower (exclusive, null for the first window of a new feed), upper (inclusive) in microseconds, of succeeded
    runs (run_id, started_at) with a limit beyond the watermark. Of runs with one limit the least id takes it up; the
    others have nothing to do. The window function runs over the run log alone, one row per limit."""
    r = runs.groupBy(F.unix_micros("started_at").alias("upper")).agg(F.min("run_id").alias("run_id"))
    if watermark is not None:
        r = r.where(F.col("upper") > watermark)
    before = F.coalesce(F.lag("upper").over(Window.orderBy("upper")), F.lit(watermark).cast("bigint"))
    return r.select("run_id", before.alias("lower"), "upper")


def in_windows(rows: DataFrame, windows: DataFrame, n: int, least: int, most: int) -> DataFrame:
    """`rows` (column seq <= most) with run_id and upper of the window that takes each up.

    An equi-join on slots of time, as wide as the n windows are on average: a window lies in every slot it touches, so
    there are about 2 n of these rows, and a row meets the few windows of its slot instead of all.
    """
    width = max(1, (most - least) // n)
    slot = lambda c: F.expr(f"(greatest({c}, {least}L) - {least}L) div {width}L")
    w = windows.select("run_id", "lower", "upper", F.explode(F.sequence(slot(f"coalesce(lower, {least}L)"), slot("upper"))).alias("_slot"))
    j = rows.withColumn("_slot", slot("seq")).join(F.broadcast(w) if n <= BROADCAST_RUNS else w, "_slot")
    return j.where((F.col("seq") <= F.col("upper")) & (F.col("lower").isNull() | (F.col("seq") > F.col("lower")))).drop("_slot", "lower")


def current_versions(files: DataFrame) -> DataFrame:
    """Usable file versions: repo and file path in normal form, normal hash, the order key (created_at, id), and seq.

    Rows with a null or blank hash, without an id or never visible are left out; rows written twice fold later.
    """
    return files.select(
        normal_path(F.col("repo_path")).alias("repo"),
        normal_path(F.col("file_path")).alias("path"),
        normal_hash(F.col("file_hash")).alias("hash"),
        F.struct(F.col("created_at"), F.col("id")).alias("ver"),
        F.unix_micros("arrived_at").alias("seq"),
    ).where(F.col("hash").isNotNull() & F.col("ver.id").isNotNull() & F.col("seq").isNotNull())


def _micros(df: DataFrame, at) -> int:
    return df.sparkSession.range(1).select(F.unix_micros(F.lit(at))).first()[0]


class IncrementalFeed:
    """Runs over an append-only feed, with durable state in a folder that all executors share.

    Each committed version has a manifest, which names the folder of what the run wrote: `delta`, one row per file and
    window whose current version moved, marked where its hash changed (the output). The state is the last full copy plus
    the deltas since, so a run writes what moved and reads the buckets of files that its records touch; after
    `compact_every` deltas a run also writes a full copy.

    The commit is the rename of the manifest to its final name, which the file system refuses if the name exists: of two
    runs over one version one fails and leaves nothing visible. (Local and HDFS renames are atomic; an object store needs
    a file system layer with that guarantee.) After a commit, folders of versions that are decided but not named by a
    manifest - failed runs, lost races - are removed.

    Nulls: rows without a usable hash, id or arrival are passed over; a null repository or path is a path like others.
    An empty feed commits its watermark and gives no row. Extra columns are ignored.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None, compact_every: int = 20):
        """`buckets` of a new feed; by default as many as shuffles have partitions, and 32 at least. A feed keeps its number."""
        self.spark, self.folder, self.compact_every = spark, folder.rstrip("/"), compact_every
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.folder).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        self._fs.mkdirs(self._path(f"{self.folder}/manifests"))
        self.buckets = self.head().get("buckets") or buckets or max(32, shuffle_partitions(spark))

    def _versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("m") and n.endswith(".json"))

    def head(self) -> dict:
        """The last committed manifest: version, watermark (microseconds, None before the first run), folders."""
        done = self._versions()
        return self._manifest(done[-1]) if done else {"version": 0, "watermark": None, "dir": None, "base": None, "deltas": []}

    def _manifest(self, version: int) -> dict:
        s = self._fs.open(self._path(f"{self.folder}/manifests/m{version:012d}.json"))
        try:
            return json.loads(bytes(s.readAllBytes()).decode())
        finally:
            s.close()

    def output(self, manifest: dict) -> DataFrame:
        """run_id, repo, path, id, hash: the new and changed versions of a committed manifest."""
        d = self.spark.read.schema(f"{_STATE}, run_id bigint, changed boolean").parquet(f"{self.folder}/{manifest['dir']}/delta").where("changed")
        return d.select("run_id", "repo", "path", F.col("cur.ver.id").alias("id"), F.col("cur.hash").alias("hash"))

    def catch_up(self, feed: DataFrame, runs: DataFrame, fail_at: str | None = None) -> DataFrame:
        """Take up what all runs (run_id, started_at) beyond the watermark have to take up, each in its own window, in one
        commit; returns run_id, repo, path, id, hash. Without such runs nothing is committed and nothing comes out."""
        head = self.head()
        windows = commit_windows(runs, head["watermark"])
        n, least, most = windows.agg(F.count("*"), F.min("upper"), F.max("upper")).first()
        if not n:
            return self._nothing()
        return self._take(self._between(feed, head, most), head, {"watermark": most}, (windows, n, least, most), fail_at)

    def run(self, feed: DataFrame, upper, run_id: int | None = None, fail_at: str | None = None) -> DataFrame:
        """Take up everything between the watermark and `upper`. A limit before the watermark is refused: the watermark
        never goes back. The watermark's own limit again takes up nothing."""
        head, most = self.head(), _micros(feed, upper)
        if head["watermark"] is not None and most < head["watermark"]:
            raise StaleRun(f"the upper limit {most} lies before the watermark {head['watermark']}")
        if most == head["watermark"]:
            return self._nothing()
        one = self.spark.createDataFrame([(run_id, None, most)], "run_id bigint, lower bigint, upper bigint")
        return self._take(self._between(feed, head, most), head, {"watermark": most}, (one, 1, most, most), fail_at)

    def run_batch(self, batch: DataFrame, stream: str, number: int, fail_at: str | None = None) -> DataFrame | None:
        """Take up every visible row of a stream's batch, whatever its arrival; the stream's own offsets are the commit
        sequence. A batch that is committed already gives its stored output again. None if nothing is visible."""
        head = self.head()
        for version in reversed(self._versions()):
            m = self._manifest(version)
            if m.get("stream") == stream and m["batch"] <= number:
                if m["batch"] == number:
                    return self.output(m)
                break
        most = batch.agg(F.max(F.unix_micros("arrived_at"))).first()[0]
        if most is None:
            return None
        mark = {"watermark": max(most, head["watermark"] or most), "stream": stream, "batch": number}
        one = self.spark.createDataFrame([(None, None, most)], "run_id bigint, lower bigint, upper bigint")
        return self._take(current_versions(batch), head, mark, (one, 1, most, most), fail_at)

    def _nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], "run_id bigint, repo string, path string, id bigint, hash string")

    def _between(self, feed: DataFrame, head: dict, most: int) -> DataFrame:
        """The feed from the watermark to the limit; both bounds reach the scan."""
        rows = feed.where(F.col("arrived_at") <= F.timestamp_micros(F.lit(most)))
        if head["watermark"] is not None:
            rows = rows.where(F.col("arrived_at") >= F.timestamp_micros(F.lit(head["watermark"])))
        return current_versions(rows)

    def state(self, head: dict | None = None) -> DataFrame | None:
        """bucket, repo, path, cur of every file known; None before the first commit. Of several rows of a file, the
        greatest counts."""
        head = head or self.head()
        parts = [f"{self.folder}/{head['base']}/base"] * bool(head["base"]) + [f"{self.folder}/{d}/delta" for d in head["deltas"]]
        out = None
        for p in parts:
            one = self.spark.read.schema(_STATE).parquet(p)
            out = one if out is None else out.unionByName(one)
        return out

    def _take(self, rows: DataFrame, head: dict, mark: dict, windows: tuple, fail_at: str | None) -> DataFrame:
        """Per file and window only the greatest version matters, which partial aggregation leaves before the shuffle; a
        window function over a file's windows, the first of them its state, then carries the greatest version. A file,
        however hot, has at most one row per window after the first step."""
        w, n, least, most = windows
        if head["watermark"] is not None:  # the watermark's own time once more, in the first window
            w = w.withColumn("lower", F.when(F.col("lower") == head["watermark"], F.col("lower") - 1).otherwise(F.col("lower")))
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("repo", "path"), F.lit(self.buckets)).cast("int"))
        key = ["bucket", "repo", "path"]
        per = in_windows(rows, w, n, least, most).groupBy(*key, "run_id", "upper").agg(F.max(F.struct("ver", "hash")).alias("best"))
        old = self.state(head)
        if old is not None:
            touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # at most `buckets` of them
            old = old.where(F.col("bucket").isin(touched))
            per = per.unionByName(old.select(*key, F.lit(None).cast("bigint").alias("run_id"), F.lit(None).cast("bigint").alias("upper"), F.col("cur").alias("best")))
        along = Window.partitionBy(*key).orderBy(F.asc_nulls_first("upper"))
        moved = (
            per.repartition("bucket")
            .withColumn("cur", F.max("best").over(along.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("prev", F.lag("cur").over(along))
            .where(F.col("upper").isNotNull() & (F.col("prev").isNull() | (F.col("prev.ver") < F.col("cur.ver"))))
            .select(*key, "run_id", "cur", (F.col("prev").isNull() | (F.col("prev.hash") != F.col("cur.hash"))).alias("changed"))
        )
        version = head["version"] + 1
        folder = f"v{version:012d}-{uuid.uuid4().hex[:8]}"
        if fail_at == "start":
            raise RuntimeError("failed at the start")
        moved.write.partitionBy("bucket").parquet(f"{self.folder}/{folder}/delta")
        if fail_at == "output":
            raise RuntimeError("failed after the output")
        manifest = {"version": version, "dir": folder, "base": head["base"], "deltas": [*head["deltas"], folder], "buckets": self.buckets, **mark}
        if len(manifest["deltas"]) >= self.compact_every:
            full = self.state(manifest).groupBy(*key).agg(F.max("cur").alias("cur"))
            full.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{folder}/base")
            manifest |= {"base": folder, "deltas": []}
        if fail_at == "commit":
            raise RuntimeError("failed before the commit")
        self._commit(version, manifest)
        self._clean(version)
        return self.output(manifest)

    def _commit(self, version: int, manifest: dict) -> None:
        temp = self._path(f"{self.folder}/manifests/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(temp, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            self._files.rename(temp, self._path(f"{self.folder}/manifests/m{version:012d}.json"), self._no_options)
        except Exception as e:
            self._fs.delete(temp, False)
            raise RuntimeError(f"version {version} was committed by another run") from e

    def _clean(self, version: int) -> None:
        """Remove what no manifest names of versions that are decided."""
        named = {self._manifest(v)["dir"] for v in self._versions()}
        for s in self._fs.listStatus(self._path(self.folder)):
            name = s.getPath().getName()
            if name.startswith("v") and name not in named and int(name[1:13]) <= version:
                self._fs.delete(s.getPath(), True)


def changed_versions(files: DataFrame, runs: DataFrame, folder: str) -> DataFrame:
    """(run_id, id): for every succeeded run of the log, the current version of each file whose hash differs from the one
    that was current at the previous succeeded run, or that is new: the feed's runner, catching up in `folder`."""
    return IncrementalFeed(files.sparkSession, folder).catch_up(files, succeeded_runs(runs)).select("run_id", "id")


def run_summary(changed: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, lower_excl, upper_incl, n_changed of every succeeded run, also of those that took up nothing."""
    n = changed.groupBy("run_id").agg(F.count("*").alias("n"))
    ok = succeeded_runs(runs)
    before = F.lag("started_at").over(Window.orderBy("started_at", "run_id"))
    w = ok.select("run_id", before.alias("lower_excl"), F.col("started_at").alias("upper_incl"))
    return w.join(n, "run_id", "left").select("run_id", "lower_excl", "upper_incl", F.coalesce("n", F.lit(0)).alias("n_changed"))
