"""References to records that do not exist, are deleted, or arrive later.

References and existence are change deltas: every referring row adds +1 to its key's references, every target record
+1 to its key's existence, and a deletion takes the existence away again. Folding the deltas per key gives the state:
a key with references and no existence is an orphan key, and a key whose target became visible only after some
reference to it is orphan for those references. Only the rows of such keys are then picked out of the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusmill.session import checkpoint

#: A key with more than this fraction of all references is hot. There can be no more than 1 / HOT of them.
HOT = 1 / 1000


def deletion_state(deletions: DataFrame) -> DataFrame:
    """file_id of the files deleted at present: the row with the greatest deleted_at has no restored_at.

    Where two rows share the greatest deleted_at, a restored one wins.
    """
    last = F.max(F.struct("deleted_at", "restored_at"))
    return deletions.where(F.col("deleted_at").isNotNull()).groupBy("file_id").agg(last.alias("d")).where(F.col("d.restored_at").isNull()).select("file_id")


def reference_deltas(tables: dict[str, DataFrame]) -> DataFrame:
    """key, d_ref, d_exist, visible_from, ref_from of all referring rows (null references are none)."""
    out = None
    for df in tables.values():
        d = df.where(F.col("file_id").isNotNull()).select(
            F.col("file_id").cast("bigint").alias("key"), F.lit(1).cast("bigint").alias("d_ref"), F.lit(0).cast("bigint").alias("d_exist"),
            F.lit(None).cast("timestamp").alias("visible_from"), F.col("created_at").alias("ref_from"),
        )
        out = d if out is None else out.unionByName(d)
    return out


def existence_deltas(files: DataFrame, deletions: DataFrame) -> DataFrame:
    """+1 for each id of `files` (rows written twice count once), -1 where it is deleted at present."""
    none = F.lit(None).cast("timestamp")
    plus = files.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("key")).agg(F.min("arrived_at").alias("visible_from"))
    plus = plus.select("key", F.lit(0).cast("bigint").alias("d_ref"), F.lit(1).cast("bigint").alias("d_exist"), "visible_from", none.alias("ref_from"))
    minus = deletion_state(deletions).where(F.col("file_id").isNotNull())
    minus = minus.select(F.col("file_id").alias("key"), F.lit(0).cast("bigint").alias("d_ref"), F.lit(-1).cast("bigint").alias("d_exist"), none.alias("visible_from"), none.alias("ref_from"))
    return plus.unionByName(minus)


def fold_deltas(*deltas: DataFrame) -> DataFrame:
    """Signed counts per key. Folding folded states with further deltas gives the same as folding all deltas at once, so
    the state is kept up by folding it with what a run brings: `fold_deltas(saved, reference_deltas(new_rows), ...)`."""
    all_ = deltas[0]
    for d in deltas[1:]:
        all_ = all_.unionByName(d)
    return all_.groupBy("key").agg(
        F.sum("d_ref").alias("d_ref"), F.sum("d_exist").alias("d_exist"), F.min("visible_from").alias("visible_from"), F.min("ref_from").alias("ref_from")
    )


def orphan_keys(state: DataFrame) -> DataFrame:
    """key, gone, visible_from, d_ref of the keys with references that now or at their time had no target.

    A target without an arrival time counts as visible from the beginning.
    """
    gone = F.col("d_exist") <= 0
    return state.where((F.col("d_ref") > 0) & (gone | (F.col("ref_from") < F.col("visible_from")))).select("key", gone.alias("gone"), "visible_from", "d_ref")


def orphan_rows(tables: dict[str, DataFrame], files: DataFrame, deletions: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """table_name, row_id, file_id, created_at, reason of every orphan row, repeated rows once.

    The state is folded from the tables unless one is given that is up to date. Hot keys - more than HOT of all
    references, hence at most 1 / HOT of them - are broadcast and meet their rows where these lie; rows of other keys
    are shuffled by key, of which none is large. Of rows that share table and id the earliest orphan one counts. A row
    without an id is a row of its own by its other columns; it appears with a null row_id.
    """
    if state is None:
        state = checkpoint(fold_deltas(reference_deltas(tables), existence_deltas(files, deletions)))  # one row per key, used three times
    total = state.agg(F.sum("d_ref").alias("_total"))
    keys = state.where(F.col("d_ref") > 0).select("key", "d_ref", (F.col("d_exist") <= 0).alias("gone"), "visible_from", "ref_from")
    is_hot = F.col("d_ref") > HOT * F.col("_total")
    hot = keys.crossJoin(F.broadcast(total)).where(is_hot).select("key", F.lit(True).alias("_hot"), F.col("gone").alias("_g"), F.col("visible_from").alias("_v"))
    rows = None
    for name, df in tables.items():
        id_ = F.col("id").cast("string")
        own = F.when(id_.isNull(), F.xxhash64(*[df[c] for c, t in df.dtypes if "map<" not in t and "variant" not in t]))
        r = df.where(F.col("file_id").isNotNull()).select(F.lit(name).alias("table_name"), id_.alias("row_id"), own.alias("_own"), F.col("file_id").cast("bigint").alias("file_id"), "created_at")
        rows = r if rows is None else rows.unionByName(r)
    marked = rows.join(F.broadcast(hot), rows.file_id == hot.key, "left").drop("key")
    late = F.col("created_at") < F.col("_v")
    of_hot = marked.where(F.col("_hot") & (F.col("_g") | late))
    cold = orphan_keys(state).select("key", F.col("gone").alias("_g2"), F.col("visible_from").alias("_v2"))
    rest = marked.where(F.col("_hot").isNull()).drop("_g", "_v")
    of_cold = rest.join(cold, rest.file_id == cold.key).withColumnsRenamed({"_g2": "_g", "_v2": "_v"}).where(F.col("_g") | late)
    keep = ["table_name", "row_id", "_own", "file_id", "created_at", "_g"]
    hit = of_hot.select(*keep).unionByName(of_cold.select(*keep))
    first = hit.groupBy("table_name", "row_id", "_own").agg(F.min(F.struct("created_at", "file_id", "_g")).alias("m"))
    return first.select("table_name", "row_id", F.col("m.file_id").alias("file_id"), F.col("m.created_at").alias("created_at"), F.when(F.col("m._g"), "no target").otherwise("target came later").alias("reason"))


def orphan_report(orphans: DataFrame, period: str = "day") -> DataFrame:
    """table_name, period, reason, n_rows, n_keys; rows without created_at fall in the null period."""
    return orphans.groupBy("table_name", F.date_trunc(period, "created_at").alias("period"), "reason").agg(
        F.count("*").alias("n_rows"), F.countDistinct("file_id").alias("n_keys")
    )
