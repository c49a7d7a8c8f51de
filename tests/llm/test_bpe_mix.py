"""Encoding against the public library, exact round trips, and the mixture's shares."""

import os
import random

import pytest

from corpusmill.llm import bpe, mix

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_VOCABULARY), reason="no vocabulary file")


def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(os.path.join(os.path.dirname(bpe.DEFAULT_VOCABULARY), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def ids_of(texts):
    flat, counts, offsets = bpe.merger(bpe.vocabulary()).encode(texts)
    out, offs, at = [], [], 0
    for n in counts.tolist():
        out.append(flat[at : at + n].tolist())
        offs.append(offsets[at : at + n].tolist())
        at += n
    return out, offs


def test_against_library():
    r = random.Random(3)
    letters = "'   \n\t\r\xa0 abstrevlmd'S09é漢!?.😀<|endoftext|>́\u2028\x85"
    texts = ["", " ", "'", "it's we'll they'RE", "a" * 5000, "<|endoftext|>", "x" + "\n" * 50 + "y", "日本語" * 400, "AbC9" * 3000]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(4000)]
    ids, offsets = ids_of(texts)
    want = [e.ids for e in reference().encode_batch(texts, add_special_tokens=False)]
    assert ids == want
    for t, o in zip(texts, offsets):
        assert o == sorted(o) and all(0 <= x < len(t) for x in o)


def test_every_code_point_class():
    texts = [f"a{chr(c)}a {chr(c)}1'{chr(c)}s" for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    ids, _ = ids_of(texts)
    assert ids == [e.ids for e in reference().encode_batch(texts, add_special_tokens=False)]


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    m = bpe.Merger(bpe.vocabulary())
    flat, _, _ = m.encode(["one two three four five six seven eight nine ten"])
    assert len(m.cache) <= 5 and flat.tolist() == reference().encode("one two three four five six seven eight nine ten").ids


def test_encode_decode(spark):
    rows = [(1, "héllo wörld", 0), (2, None, 0), (3, "", 0), (4, " \n ", 0), (5, "x" * 100_000, 0), (1, "héllo wörld", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = bpe.encode(df, "doc_id", "text", offsets=True).collect()
    assert len(got) == 6 and all(len(r["ids"]) == len(r["offsets"]) for r in got)
    assert [r["ids"] for r in got if r["doc_id"] in (2, 3)] == [[], []]
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(df, "doc_id", "text"), "doc_id").collect()}
    assert all(back[k] == (t or "") for k, t, _ in rows)
    assert bpe.encode(df.limit(0), "doc_id", "text").count() == 0
    n = {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(df, ["doc_id"], "text").collect()}
    assert all(n[r["doc_id"]] == len(r["ids"]) for r in got)


def test_truncate_and_split():
    m = bpe.Merger(bpe.vocabulary())
    text = "one two three four five six"
    ids = m.encode([text])[0].tolist()
    assert bpe.truncated(m, text, 4) == "one two three" and bpe.truncated(m, text, 100) == text and bpe.truncated(m, "", 5) == "" and bpe.truncated(m, text, 1) == ""
    parts = bpe.split_by_tokens(m, text, 2)
    assert "".join(parts) == text and len(parts) == -(-len(ids) // 2) and bpe.split_by_tokens(m, "", 2) == []


def test_plan(spark):
    def plan(targets, sizes, total=None):
        t = spark.createDataFrame(targets, "source string, weight double, max_repeats int")
        n = spark.createDataFrame(list(sizes.items()), "source string, n bigint")
        return {r["source"]: r["expected"] for r in mix.plan_copies(t, n, total).collect()}

    assert plan([("a", 0.5, 1), ("b", 0.5, 4), ("none", 0.3, 2)], {"a": 100, "b": 50, "x": 9}) == {"a": 1.0, "b": 2.0}
    assert plan([("a", 0.5, 1), ("b", 0.5, 4)], {"a": 100, "b": 50}, total=1000) == {"a": 1.0, "b": 4.0}
    assert plan([("a", 0.5, None), ("b", 0.5, None)], {"a": 100, "b": 50}) == {"a": 0.75, "b": 1.5}
    assert plan([("a", 1.0, 1)], {}) == {}


def test_mix(spark):
    r = random.Random(5)
    rows = [(i, "word " * r.randint(1, 60), r.choice(["Big", " big", "BIG", "small-one", "small one", "other", None]), 1) for i in range(900)]
    rows += [(9000, None, "big", 1), (9001, "", "big", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _part int").drop("_part")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small_one", 0.3, 3), ("gone", 0.2, 2), (None, 0.1, 1)], "source string, weight double, max_repeats int")
    used, shares = mix.mix(docs, targets)
    got = used.collect()
    assert len(got) == len({x["doc_id"] for x in got}) == sum(1 for x in rows if mix_name(x[2]) in ("big", "small_one"))
    limit = {"big": 1, "small_one": 3}
    assert all(0 <= x["copies"] <= limit[x["source"]] for x in got) and all(x["copies"] == 0 for x in got if not x["n_tokens"])
    s = {x["source"]: x for x in shares.collect()}
    assert set(s) == {"big", "small_one", "gone"} and s["gone"]["tokens_used"] == 0
    assert abs(s["big"]["share"] - 0.625) < 0.01 and abs(s["small_one"]["share"] - 0.375) < 0.01
    again = mix.mix(docs.repartition(5), targets)[0].collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mix.mix(docs.limit(0), targets)[0].count() == 0 and mix.mix(docs, targets.limit(0))[0].count() == 0


def mix_name(s):
    return None if s is None else "_".join(s.strip().lower().replace("-", " ").split())
