"""Tokens, n-grams, lines, search and rerank goldens."""

import math
import re
import uuid
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from corpusmill.functions import lang as L, text as T
from corpusmill.operators import fuzzy, lines as N, search as S

WORDS = {
    "camelCase": ["camel", "case"], "HTTPServer": ["http", "server"], "ABC": ["abc"], "ABC1": ["ab"], "x1": [], "X1": ["x1"], "snake_case_Name": ["snake", "case", "name"], "__init__": ["init"], "a_b": [], "abc123": ["abc"], "": [], "Ünïcode": ["code"],
}


def test_identifier_tokens(spark):
    df = spark.createDataFrame([(k,) for k in WORDS] + [(None,)], "t string")
    got = {r[0]: r[1] for r in df.select("t", T.identifier_tokens(F.col("t"))).collect()}
    assert got[None] is None
    for k, v in WORDS.items():
        assert got[k] == v, k


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_ngrams(spark, n):
    u = ["alpha", "beta", "gamma", "delta"][:n]
    got = T.with_tokens(spark.createDataFrame([(" ".join(u), 1)], "t string, tokens int"), "t", "tokens").first()["tokens"]
    both = u + [f"{a}_{b}" for a, b in zip(u, u[1:])]
    assert got == both + ["_".join(x) for x in zip(both, both[1:], both[2:])]


def test_bm25_against_python(spark):
    docs = [(1, "gateway policy gateway"), (2, "policy lantern"), (3, None), (4, ""), (5, "the other fallback")]
    q = "gateway policy policy"
    got = dict(map(tuple, S.bm25(spark.createDataFrame([(*x, 9) for x in docs], "id int, t string, tf int"), "id", "t", q, strict=True).collect()))

    def grams(t):
        u = [w for w in re.findall(r"[a-z]+", t or "") if len(w) > 1]
        return u + ["_".join(x) for x in zip(u, u[1:])] + ["_".join(x) for x in zip(u, u[1:], u[2:])]

    tf = {i: Counter(grams(t)) for i, t in docs}
    av = sum(sum(c.values()) for c in tf.values()) / len(docs)
    want = {}
    for i, c in tf.items():
        dl = sum(c.values())
        s = 0
        for t in grams(q):
            df = sum(1 for x in tf.values() if t in x)
            if t in c:
                s += math.log((len(docs) - df + 0.5) / (df + 0.5) + 1) * 2.2 * c[t] / (c[t] + 1.2 * (0.25 + 0.75 * dl / av))
        if s:
            want[i] = s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_minmax(spark):
    f = lambda xs: [r["norm"] for r in S.minmax(spark.createDataFrame([(float(x),) for x in xs], "score double")).orderBy("score").collect()]
    assert f([]) == [] and f([3]) == [1.0] and f([2, 2]) == [1.0, 1.0] and f([1, 2, 3]) == [0.0, 0.5, 1.0]


def test_containment(spark):
    rows = [(1, "f", 1, 10), (2, "f", 2, 5), (3, "f", 20, 30), (4, "f", 20, 30), (5, "g", 1, 3), (6, "g", 2, 4), (7, "h", 1, 5), (8, "h", 1, 9)]
    df = spark.createDataFrame(rows, "id int, p string, s int, e int")
    assert {r["id"] for r in S.without_contained(df, "p", "s", "e", "id").collect()} == {1, 5, 6, 8}
    assert {r["id"] for r in S.without_contained(df, "p", "s", "e", "id", keep_one=True).collect()} == {1, 3, 5, 6, 8}


def test_hashes(spark):
    df = spark.createDataFrame([("",), ("a",), ("ünï",), (None,)], "t string")
    for t, h, u in df.select("t", T.xxh64_hex(F.col("t")), T.uuid5(F.col("t"))).collect():
        if t is not None:
            assert h == xxhash.xxh64_hexdigest(t.encode()) and u == str(uuid.uuid5(uuid.NAMESPACE_DNS, t))
    assert df.select(T._xxh64_batch(F.col("t"))).collect()[1][0] == xxhash.xxh64_hexdigest(b"a")


@pytest.mark.parametrize("t", ["", "a", "a\n", "a\r\nb", "a b\n\n", "x\rb\x0bc"])
def test_lines(spark, t):
    r = spark.createDataFrame([(t,)], "t string").select(T.split_lines(F.col("t")), T.count_lines(F.col("t")), T.lines(F.col("t"))).first()
    assert r[0] == t.splitlines() and r[1] == len(t.split("\n")) - (1 if t.endswith("\n") or not t else 0) and r[2] == t.split("\n")


def test_windows(spark):
    df = spark.createDataFrame([(1, "\n".join(map(str, range(40)))), (2, "one")], "id int, t string")
    got = [tuple(r)[:3] for r in N.fixed_windows(df, ["id"], "t").orderBy("id", "start").collect()]
    assert got == [(1, 0, 30), (1, 15, 40), (1, 30, 40), (2, 0, 1)]
    with pytest.raises(ValueError):
        N.fixed_windows(df, ["id"], "t", 5, 5)


def test_islands(spark):
    t = "\n".join("hit" if i in (3, 5, 12) else f"l{i}" for i in range(1, 16))
    df = spark.createDataFrame([(1, t), (2, None), (3, "no")], "id int, t string")
    got = N.islands(df, ["id"], "t", lambda l: l.contains("hit")).collect()
    assert [(r["first"], r["last"], r["matches"]) for r in got] == [(1, 7, [3, 5]), (10, 14, [12])]


def test_fuzzy(spark):
    assert fuzzy.ratio("gateway", "gatway") == 92 and fuzzy.ratio("", "") == 100
    df = spark.createDataFrame([(1, "src/gateway/x.py"), (2, "lib/y.py"), (3, None)], "id int, p string")
    assert [r["id"] for r in fuzzy.fuzzy_paths(df, "id", "p", "gatway").collect()] == [1]


def test_status_and_listing(spark):
    df = spark.createDataFrame([(" M a.py",), ("R  a.py -> b c.py",), ("?? d",)], "line string")
    assert [tuple(r) for r in L.parse_status(df, "line").collect()] == [("M", "a.py"), ("R", "b c.py"), ("??", "d")]
    tree = spark.createDataFrame([("100644 blob ab\tx y.py",), ("160000 commit cd\tsub",)], "line string")
    assert [tuple(r) for r in L.parse_tree_listing(tree, "line").collect()] == [("ab", "x y.py")]
