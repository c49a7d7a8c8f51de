"""The chunk store: differential load, upserts, refresh, expiry, completeness, cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmill.operators.prefix import range_parts, with_carry


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new`, and those of `old` whose key `new` does not have."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti").select(*new.columns))


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key: the greatest by the order columns. An aggregate, so it combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    m = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_m"))
    return m.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in (*order, *rest)])


def refresh(rows: DataFrame, live: DataFrame, key: str, stamp: Column, columns: list[str]) -> DataFrame:
    """Set the time columns of rows whose key is live."""
    j = rows.join(live.select(key).distinct().withColumn("_live", F.lit(True)), key, "left")
    for c in columns:
        j = j.withColumn(c, F.when(F.col("_live"), stamp).otherwise(F.col(c)))
    return j.drop("_live").select(*rows.columns)


def expire(rows: DataFrame, live: DataFrame, key: str, created: str, cutoff: Column) -> DataFrame:
    """What stays: rows not older than the cutoff, and older ones whose key is live. A null time stays."""
    old = F.col(created) < cutoff
    keep = rows.where(F.coalesce(~old, F.lit(True)))
    return keep.unionByName(rows.where(old).join(live.select(key).distinct(), key, "left_semi").select(*rows.columns))


def complete_files(rows: DataFrame, path: str, total: str) -> DataFrame:
    """Paths whose rows number exactly what their rows say they should."""
    g = rows.groupBy(path).agg(F.count("*").alias("_n"), F.min(total).alias("_t"))
    return g.where(F.col("_n") == F.col("_t")).select(path)


def diff(repo: DataFrame, db: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, action: 'insert' where the store has nothing or a null hash, 'update' where hashes differ, 'delete' where the
    source has nothing; equal rows do not appear."""
    r = repo.select(*keys, F.col(value).alias("_r"), F.lit(1).alias("_in_r"))
    b = db.select(*keys, F.col(value).alias("_d"), F.lit(1).alias("_in_d"))
    action = (
        F.when(F.col("_in_r").isNull(), "delete").when(F.col("_in_d").isNull() | F.col("_d").isNull(), "insert").when(F.coalesce(F.col("_r") != F.col("_d"), F.lit(True)), "update")
    )
    return r.join(b, keys, "full_outer").withColumn("action", action).where(F.col("action").isNotNull()).select(*keys, "action")


def cascade_delete(files: DataFrame, children: DataFrame, gone: DataFrame, fk: str) -> tuple[DataFrame, DataFrame]:
    """Files without those in `gone` (column id), and children without those of them."""
    return files.join(gone.select("id"), "id", "left_anti"), children.join(gone.select(F.col("id").alias(fk)), fk, "left_anti").select(*children.columns)


def numbered(rows: DataFrame, order: list[str], out: str = "id", start: int = 1) -> DataFrame:
    """Consecutive numbers along a global order, without sorting everything in one task."""
    p = with_carry(range_parts(rows, order).withColumn("_all", F.lit(1)), ["_all"], F.count("*"), F.sum)
    w = Window.partitionBy("_part").orderBy(*order)
    return p.withColumn(out, F.row_number().over(w) + F.coalesce("_carry", F.lit(0)) + (start - 1)).drop("_part", "_carry", "_all")


def write_versioned(df: DataFrame, folder: str, version: int) -> None:
    """Snapshot of a table under its schema version."""
    df.write.mode("overwrite").parquet(f"{folder}/schema={version}/data")


def schema_version(spark, folder: str) -> int | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    found = [s.getPath().getName() for s in fs.listStatus(path)]
    return max((int(n.split("=")[1]) for n in found if n.startswith("schema=")), default=None)


def drop_all(spark, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ensure_schema(spark, folder: str, wanted: int, create, force: bool = False) -> bool:
    """Recreate the store if its schema version is missing or another, or if forced; says whether it did."""
    if not force and schema_version(spark, folder) == wanted:
        return False
    drop_all(spark, folder)
    write_versioned(create(), folder, wanted)
    return True


#: Collections of the chunk store and their columns.
COLLECTIONS = {
    "chunks": "chunk_hash string, text string, created_at timestamp, updated_at timestamp, vector array<float>",
    "chunk_files": "file_path string, chunk_hash string, file_hash string, start_line int, end_line int, total_chunks int, searchable_file_path string, searchable_file_name string, classes array<string>, functions array<string>, "
    "meta_info struct<hierarchy: array<struct<type: string, value: string, is_breakable_node: boolean>>, import_only_chunk: boolean>, has_imports boolean, created_at timestamp, updated_at timestamp",
    "urls_content": "name string, url string, content string, last_indexed timestamp, content_hash string, cache_headers struct<etag: string, last_modified: string>, backend_id int",
}


def create_collection(spark, folder: str, name: str, schema: str) -> bool:
    """Make an empty collection unless it is there; says whether it did."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return False
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}")
    return True
