"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.session import read

from . import abuse, bpe, handwritten, mix, pack, split, validity


def _limits(spark, d, problem: str) -> dict[str, int]:
    """The profile's sizes, one row per name: of rows with one name the greatest amount counts."""
    rows = read(spark, d, "limit_profiles").where((F.col("problem") == problem) & F.col("limit_name").isin("max_size", "overlap", "capacity"))
    return {r[0]: r[1] for r in rows.groupBy("limit_name").agg(F.max("amount")).collect()}


def p4_found(spark, d):
    """Files that were not written by hand."""
    return handwritten.not_hand_written(read(spark, d, "repo_files")).select("file_id")


def p4_kinds(spark, d):
    """Number of files per repository and kind."""
    found = handwritten.not_hand_written(read(spark, d, "repo_files"))
    return found.groupBy("repo_path", "kind").agg(F.count("*").alias("n_files"))


def p5_found(spark, d):
    """Items that must be split: those of which the splitter makes more than one piece."""
    p = _limits(spark, d, "p5")
    made = split.pieces(read(spark, d, "sample_data"), p["max_size"], p["overlap"], with_text=False)
    return made.where(F.col("n_pieces") > 1).select("id").distinct()


def p5_pieces(spark, d):
    """All pieces of all items, by their offsets and lines."""
    p = _limits(spark, d, "p5")
    return split.distinct_pieces(read(spark, d, "sample_data"), p["max_size"], p["overlap"])


def p6_containers(spark, d):
    """Each item's container."""
    return pack.containers(read(spark, d, "sample_data"), _limits(spark, d, "p6")["capacity"])


def p6_fill(spark, d):
    """How full the containers are."""
    return pack.fill_report(p6_containers(spark, d), _limits(spark, d, "p6")["capacity"])


def p7_found(spark, d):
    """Files that are not valid in their language."""
    return validity.invalid_files(read(spark, d, "repo_files"), read(spark, d, "files")).select("file_id")


def p7_rates(spark, d):
    """Rates of such files per repository and language."""
    return validity.invalid_rates(read(spark, d, "repo_files"), read(spark, d, "files"))


def p8_ids(spark, d):
    """Token ids of every document by byte_bpe_50k."""
    return bpe.encode(read(spark, d, "documents"), "doc_id", "text")


def p8_round_trip(spark, d):
    """Per source: documents, tokens, and documents whose decoded ids differ from the text (none)."""
    docs = read(spark, d, "documents").select("doc_id", "text", mix.normal_source(F.col("source")).alias("source"))
    ids = bpe.encode(docs.select(F.struct("doc_id", "text", "source").alias("doc"), "text"), "doc", "text")
    back = bpe.decode(ids.select(F.struct("doc", F.size("ids").alias("n")).alias("k"), "ids"), "k")
    return back.groupBy(F.col("k.doc.source").alias("source")).agg(
        F.count("*").alias("n_docs"), F.sum("k.n").alias("n_tokens"), F.count_if(F.col("text") != F.coalesce("k.doc.text", F.lit(""))).alias("n_differ")
    )


def p9_uses(spark, d):
    """How often each document is used."""
    return mix.mix(read(spark, d, "documents"), read(spark, d, "mix_targets"))[0]


def p9_shares(spark, d):
    """The shares wanted and reached."""
    return mix.mix(read(spark, d, "documents"), read(spark, d, "mix_targets"))[1]


def p10_found(spark, d):
    """Documents with abusive, hateful or sexual language."""
    return abuse.score(read(spark, d, "documents")).where("flagged").select("doc_id")


def p10_scores(spark, d):
    """The score of every document."""
    return abuse.score(read(spark, d, "documents"))


def p10_rates(spark, d):
    """Rates per source."""
    return abuse.rates(read(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p4_found, p4_kinds, p5_found, p5_pieces, p6_containers, p6_fill, p7_found, p7_rates, p8_ids, p8_round_trip, p9_uses, p9_shares, p10_found, p10_scores, p10_rates)}

ORACLE = {
    "p5_found": "SELECT DISTINCT id FROM sample_data WHERE length(content) > (SELECT amount FROM limit_profiles WHERE problem = 'p5' AND limit_name = 'max_size')",
}
