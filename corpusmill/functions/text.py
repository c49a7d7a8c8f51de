"""Text columns: identifier tokens, n-grams, lines, rendering, hashes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# fixed values: what a word is, and the parts of a camel-case word
WORD = r"[\p{L}\p{N}_]+"
CAMEL = r"[A-Z][a-z]+|[a-z]+|[A-Z]+(?=[A-Z]|$)"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def identifier_tokens(text: Column) -> Column:
    """Lower-cased parts longer than one character: a word with `_` is split there, else at its camel humps, else it
    stays whole. Order is kept. Null text has a null array, blank text an empty one."""

    def parts(w: Column) -> Column:
        camel = F.regexp_extract_all(w, F.lit(CAMEL), F.lit(0))
        return F.when(F.contains(w, F.lit("_")), F.split(w, "_")).when(F.size(camel) > 0, camel).otherwise(F.array(w))

    flat = F.flatten(F.transform(words(text), parts))
    return F.transform(F.filter(flat, lambda p: F.length(p) > 1), F.lower)


def joined_runs(tokens: Column, n: int) -> Column:
    """Adjacent tokens joined by `_`, n at a time; empty for shorter arrays. `tokens` is evaluated several times: pass a
    column, not an expression that is dear."""
    m = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    out = F.slice(tokens, 1, m)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(tokens, k + 1, m), lambda a, b: F.concat(a, F.lit("_"), b))
    return out


def with_tokens(df: DataFrame, text: str, out: str = "tokens", strict: bool = False) -> DataFrame:
    """`df` with unigrams, then bigrams, then trigrams of a text column. The trigrams run over unigrams and bigrams
    together, as existing indexes have them; `strict` builds them over the unigrams alone. Each step is a column of its
    own, so that the text is cut up once."""
    keep = df.columns
    step = df.withColumn("_u", identifier_tokens(F.col(text)))
    step = step.select(*keep, "_u", F.concat("_u", joined_runs(F.col("_u"), 2)).alias("_l"))
    return step.select(*[c for c in keep if c != out], F.concat("_l", joined_runs(F.col("_u" if strict else "_l"), 3)).alias(out))


def lines(text: Column) -> Column:
    """Split at LF only; a final LF gives a last empty line."""
    return F.split(text, "\n", -1)


def split_lines(text: Column) -> Column:
    r"""Split at any line end (CRLF, LF, CR, VT, FF, FS-RS, NEL, LS, PS); a final line end gives no empty line."""
    eol = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, rf"(?:{eol})\z", ""), eol, -1))


def count_lines(text: Column) -> Column:
    """Number of lines as a file reader counts them: a final LF ends a line and opens none."""
    n = F.size(lines(text))
    return F.when(text == "", F.lit(0)).otherwise(n - F.when(text.endswith("\n"), 1).otherwise(0))


def line_range(text: Column, start: Column, end: Column) -> Column:
    """Lines start..end (1-based, inclusive) joined by LF."""
    return F.array_join(F.slice(lines(text), start, F.greatest(end - start + 1, F.lit(0))), "\n")


def numbered(text: Column, start: Column, ellipsis: bool = False) -> Column:
    """Each line with its number in front; optionally a line of dots at the end."""
    out = F.array_join(F.transform(lines(text), lambda l, i: F.concat((i + start).cast("string"), F.lit(": "), l)), "\n")
    return F.concat(out, F.lit("\n...")) if ellipsis else out


def truncated_line(line: Column, most: int = 200, keep: int = 97) -> Column:
    """Lines longer than `most` shown by their ends and their length."""
    n = F.length(line)
    return F.when(
        n > most, F.concat(F.substring(line, 1, keep), F.lit(" … "), F.right(line, F.lit(keep)), F.lit(" (truncated, "), n.cast("string"), F.lit(" chars)"))
    ).otherwise(line)


def nonspace_length(text: Column) -> Column:
    """Code points that are no white space."""
    return F.length(F.regexp_replace(text, r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]", ""))


def line_of_offset(text: Column, offset: Column) -> Column:
    """1-based line that holds the character at a 0-based offset."""
    head = F.left(text, offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def trimmed_blank_lines(text: Column) -> Column:
    """Without blank lines at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"\A(?:[ \t\r]*\n)+", ""), r"(?:\n[ \t\r]*)+\z", "")


def lf_only(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def is_comment_or_blank(line: Column) -> Column:
    t = F.trim(F.translate(line, "\t\r", "  "))
    return (t == "") | t.rlike(r"^(?:#|//|/\*|\*|--)")


def uuid5(key: Column, namespace: str = "6ba7b8109dad11d180b400c04fd430c8") -> Column:
    """Name-based UUID (version 5) of the key; the namespace is that of DNS names unless given as 32 hex digits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(key, "utf-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)
    )


def xxh64_hex(text: Column) -> Column:
    """XXH64 with seed 0 of the UTF-8 bytes as 16 hex digits: a Catalyst expression where the session allows it (the
    built-in function has another seed), else an Arrow batch function."""
    expr = _catalyst_xxh64(text)
    if expr is not None:
        return F.lower(F.lpad(F.hex(expr), 16, "0"))
    return _xxh64_batch(text)


def _catalyst_xxh64(text: Column) -> Column | None:
    from pyspark.sql import SparkSession

    try:
        jvm = SparkSession.active().sparkContext._jvm
        utils = jvm.org.apache.spark.sql.classic.ExpressionUtils
        child = utils.expression(text.cast("string")._jc)
        seq = jvm.scala.jdk.javaapi.CollectionConverters.asScala(jvm.java.util.Arrays.asList(_one(jvm, child))).toSeq()
        return Column(utils.column(jvm.org.apache.spark.sql.catalyst.expressions.XxHash64(seq, 0)))
    except Exception:
        return None


def _one(jvm, child):
    from pyspark import SparkContext

    arr = SparkContext._active_spark_context._gateway.new_array(jvm.org.apache.spark.sql.catalyst.expressions.Expression, 1)
    arr[0] = child
    return arr


def _xxh64_batch(text: Column) -> Column:
    @F.pandas_udf("string")
    def digest(s: pd.Series) -> pd.Series:
        import xxhash

        return s.map(lambda x: None if x is None else xxhash.xxh64_hexdigest(x.encode()))

    return digest(text)
