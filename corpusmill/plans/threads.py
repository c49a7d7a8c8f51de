"""Queries of conversations and event streams."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from corpusmill.functions import text as T
from corpusmill.session import read
from corpusmill.streaming import events as E, providers as P
from corpusmill.streaming.fold import ordered_fold

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


_O = ["ts", "event_id"]


def events(spark, d):
    return read(spark, d, "events")


# provider streams: every document as an answer that comes in pieces, in each provider's own payloads
_PIECES = "transform(sequence(0, cast(ceil(length(text) / 40.0) AS int) - 1), i -> substring(text, i * 40 + 1, 40))"
_J = "to_json(named_struct({}))"
_TYPED = lambda kind, rest="": _J.format(f"'type', '{kind}'" + (", " + rest if rest else ""))
_STOP = _TYPED("content_block_stop")
_WHEN = lambda cond, *xs: f"CASE WHEN {cond} THEN array({', '.join(xs)}) ELSE cast(array() AS array<string>) END"
_DELTA = lambda kind, key, value: _TYPED("content_block_delta", f"'delta', named_struct('type', '{kind}', '{key}', {value})")
_CHUNK = lambda delta, finish="null": _J.format(f"'choices', array(named_struct('delta', {delta}, 'finish_reason', {finish}))")
_CALL = lambda extra, args: f"named_struct('tool_calls', array(named_struct({extra}'function', named_struct({args}))))"
RAW = {
    "messages": [
        _WHEN("doc_id % 5 = 0", _TYPED("content_block_start", "'content_block', named_struct('type', 'thinking')"), _DELTA("thinking_delta", "thinking", "concat('plan ', doc_id)"), _DELTA("signature_delta", "signature", "'s'"), _STOP),
        f"array({_TYPED('content_block_start', "'content_block', named_struct('type', 'text')")})", f"transform({_PIECES}, p -> {_DELTA('text_delta', 'text', 'p')})", f"array({_STOP})",
        _WHEN("doc_id % 3 = 0", _TYPED("content_block_start", "'content_block', named_struct('type', 'tool_use', 'name', 'lookup', 'id', concat('u', doc_id))")),
        _WHEN("doc_id % 3 = 0 AND doc_id % 6 <> 0", _DELTA("input_json_delta", "partial_json", "'{\"n\":'"), _DELTA("input_json_delta", "partial_json", "concat(length(text), '}')")), _WHEN("doc_id % 3 = 0", _STOP),
        f"array({_TYPED('message_stop', "'amazon-bedrock-invocationMetrics', named_struct('inputTokenCount', doc_id, 'outputTokenCount', length(text), 'cacheReadInputTokenCount', doc_id % 7)")}, '{{\"type\":\"ping\"}}', 'no json')",
    ],
    "responses": [
        f"array({_TYPED('response.created')}, {_TYPED('response.output_item.added', "'item', named_struct('type', 'message')")})", f"transform({_PIECES}, p -> {_TYPED('response.output_text.delta', "'delta', p")})", f"array({_TYPED('response.output_text.done')})",
        _WHEN("doc_id % 3 = 0", _TYPED("response.output_item.added", "'item', named_struct('type', 'function_call', 'name', 'lookup', 'call_id', concat('u', doc_id))"), _TYPED("response.function_call_arguments.delta", "'delta', '{\"n\":'"), _TYPED("response.function_call_arguments.delta", "'delta', concat(length(text), '}')"), _TYPED("response.function_call_arguments.done")),
        f"array({_TYPED('response.completed', "'response', named_struct('usage', named_struct('input_tokens', doc_id, 'output_tokens', length(text), 'input_tokens_details', named_struct('cached_tokens', doc_id % 7)))")})",
    ],
    "candidates": [
        f"transform({_PIECES}, p -> {_J.format("'candidates', array(named_struct('content', named_struct('parts', array(named_struct('text', p)))))")})",
        _WHEN("doc_id % 3 = 0", _J.format("'candidates', array(named_struct('content', named_struct('parts', array(named_struct('function_call', named_struct('name', 'lookup', 'id', concat('u', doc_id), 'args', concat('n=', length(text))))))))")),
        f"array({_J.format("'candidates', array(named_struct('finish_reason', CASE WHEN doc_id % 15 = 0 THEN 'MALFORMED_FUNCTION_CALL' ELSE 'STOP' END, 'finish_message', 'bad')), 'usage_metadata', named_struct('prompt_token_count', doc_id, 'candidates_token_count', length(text), 'cached_content_token_count', doc_id % 7)")})",
    ],
    "choices": [
        _WHEN("doc_id % 5 = 0", _CHUNK("named_struct('reasoning', concat('plan ', doc_id))"), _CHUNK("named_struct('reasoning_details', array(named_struct('type', 'reasoning.encrypted')))")),
        f"transform({_PIECES}, p -> {_CHUNK("named_struct('content', p)")})",
        _WHEN("doc_id % 3 = 0", _CHUNK(_CALL("'id', concat('u', doc_id), ", "'name', 'lookup', 'arguments', '{\"n\":'")), _CHUNK(_CALL("", "'arguments', concat(length(text), '}')")), _CHUNK("named_struct('content', 'not heard')")),
        _WHEN("doc_id % 2 = 0", _CHUNK("named_struct('content', '')", "'stop'")),
        f"array({_J.format("'usage', named_struct('prompt_tokens', doc_id, 'completion_tokens', length(text), 'prompt_tokens_details', named_struct('cached_tokens', doc_id % 7))")})",
    ],
}


def raw_stream(spark, d, provider):
    """stream, seq, payload."""
    x = read(spark, d, "documents").where("text <> ''")
    return x.select(F.col("doc_id").alias("stream"), F.posexplode(F.expr(f"concat({', '.join(RAW[provider])})")).alias("seq", "payload"))


def normal_events(spark, d, provider):
    return ordered_fold(raw_stream(spark, d, provider), "stream", ["seq"], P.MACHINES[provider], P.EVENT, "ord")


def _joined(rows, order, text):
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda t: t[text]), "")


def _kinds(spark, d, provider):
    e = normal_events(spark, d, provider)
    return e.groupBy("stream", "kind").agg(F.count("*").alias("n"), F.md5(_joined(e, "ord", "text")).alias("digest"), F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum("cache_read").alias("cache_read"))


_DOC = "x AS (SELECT doc_id, text, length(text) AS l, CAST(ceil(length(text) / 40.0) AS BIGINT) AS pieces FROM documents WHERE text <> '')"
_ROW = "SELECT doc_id AS stream, '{}' AS kind, {} AS n, md5({}) AS digest, NULL AS input, NULL AS output, NULL AS cache_read FROM x WHERE {}"


def _kinds_sql(think="doc_id % 5 = 0", calls=(), net=True, extra=()):
    """What must come out, said of the documents themselves."""
    rows = [("text_start", "1", "''", "true"), ("text_delta", "pieces", "text", "true"), ("text_end", "1", "''", "true"), ("tool_start", "1", "''", "doc_id % 3 = 0"), ("tool_end", "1", "''", "doc_id % 3 = 0"), *calls, *extra]
    rows += [("thinking_start", "1", "''", think), ("thinking_delta", "1", "'plan ' || doc_id", think)]
    use = f"SELECT doc_id, 'usage', 1, md5(''), doc_id{' - doc_id % 7' if net else ''}, l, doc_id % 7 FROM x"
    return f"WITH {_DOC} " + " UNION ALL ".join([_ROW.format(*r) for r in rows] + [use])


_CUT_CALL = ("tool_delta", "2", "'{\"n\":' || l || '}'", "doc_id % 3 = 0")


@query(_kinds_sql(calls=[("tool_delta", "2", "'{\"n\":' || l || '}'", "doc_id % 3 = 0 AND doc_id % 6 <> 0"), ("tool_delta", "1", "'{}'", "doc_id % 6 = 0")], net=False, extra=[("thinking_end", "1", "'s'", "doc_id % 5 = 0")]))
def ev_normalize_anthropic(spark, d):
    return _kinds(spark, d, "messages")


@query(_kinds_sql(think="false", calls=[_CUT_CALL]))
def ev_normalize_openai(spark, d):
    return _kinds(spark, d, "responses")


@query(_kinds_sql(think="false", calls=[("tool_delta", "1", "'{\"value\": \"n=' || l || '\"}'", "doc_id % 3 = 0")], extra=[("malformed", "1", "'bad'", "doc_id % 15 = 0")]))
def ev_normalize_google(spark, d):
    return _kinds(spark, d, "candidates")


@query(_kinds_sql(calls=[_CUT_CALL], extra=[("thinking_end", "1", "''", "doc_id % 5 = 0")]))
def ev_normalize_openrouter(spark, d):
    return _kinds(spark, d, "choices")


@query(f"""WITH {_DOC}, b AS (SELECT *, CAST(doc_id % 5 = 0 AS INT) AS t FROM x) SELECT doc_id AS stream, 1 AS block, 'thinking' AS kind, md5('plan ' || doc_id) AS digest, NULL AS tool_name, NULL AS tool_use_id, NULL AS tool_input FROM b WHERE t = 1
UNION ALL SELECT doc_id, t + 1, 'text', md5(text), NULL, NULL, NULL FROM b
UNION ALL SELECT doc_id, t + 2, 'tool', NULL, 'lookup', 'u' || doc_id, CASE WHEN doc_id % 6 = 0 THEN '{{}}' ELSE '{{"n":' || l || '}}' END FROM b WHERE doc_id % 3 = 0""")
def ev_fold_blocks(spark, d):
    """Content blocks of every answer, with whole texts and arguments."""
    b = ordered_fold(normal_events(spark, d, "messages"), "stream", ["ord"], P.Blocks, P.BLOCK)
    return b.select("stream", "block", "kind", F.md5("text").alias("digest"), "tool_name", "tool_use_id", "tool_input")


@query(f"WITH {_DOC}, g AS (SELECT doc_id, text, pieces, unnest(range(0, pieces, 3)) AS i FROM x) SELECT doc_id AS stream, 'text_delta' AS kind, least(3, pieces - i) AS n, md5(substr(text, i * 40 + 1, 120)) AS digest FROM g")
def ev_microbatch_combine(spark, d):
    """Up to three text deltas in one."""
    c = E.combine_deltas(normal_events(spark, d, "responses"), "stream", "ord", "kind", "text", 3)
    return c.where("kind = 'text_delta'").select("stream", "kind", "n", F.md5("text").alias("digest"))


@query(f"WITH {_DOC} SELECT doc_id AS stream, doc_id - doc_id % 7 AS input, l AS output, doc_id % 7 AS cache_read FROM x")
def ev_usage_accumulate(spark, d):
    e = normal_events(spark, d, "choices").groupBy("stream")
    return e.agg(F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum("cache_read").alias("cache_read"))


@query("SELECT event_id, user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error' AND (x.ts, x.event_id) <= (e.ts, e.event_id))")
def ev_cancellation(spark, d):
    return E.until_cancelled(events(spark, d), "user_id", _O, F.col("event_type") == "error").select("event_id", "user_id")


@query("SELECT doc_id AS stream, len(regexp_extract_all(text, '(?s)`([^`]*)`')) AS n_tags, md5(array_to_string(regexp_extract_all(text, '(?s)`([^`]*)`', 1), '')) AS inside, md5(regexp_replace(text, '(?s)`([^`]*)`', '', 'g')) AS outside FROM documents WHERE text <> '' AND NOT contains(text, '<')")
def ev_xml_tags(spark, d):
    """What lies in and outside tags, of texts that come in pieces of forty characters; backticks become tags first."""
    x = read(spark, d, "documents").where("text <> '' and not contains(text, '<')").select("doc_id", F.regexp_replace("text", r"`([^`]*)`", "<c>$1</c>").alias("text"))
    pieces = x.select(F.col("doc_id").alias("stream"), F.posexplode(F.expr(_PIECES)).alias("seq", "text"))
    t = ordered_fold(pieces, "stream", ["seq"], lambda: P.Tags({"c"}), P.Tags.SCHEMA)
    return t.select("stream", "n_tags", F.md5("inside").alias("inside"), F.md5("outside").alias("outside"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def windowed_counts(spark, d):
    w = E.windowed_counts(events(spark, d), "ts", "event_type", "1 hour")
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))


@query(f"""WITH {_DOC} SELECT doc_id AS id, 1 AS pos, 'text' AS kind, md5(text) AS digest, NULL AS tool_name, NULL AS input_n, doc_id AS used_input, l AS used_output FROM x
UNION ALL SELECT doc_id, 2, 'tool_use', NULL, 'lookup', l, doc_id, l FROM x WHERE doc_id % 3 = 0""")
def nonstream_parse(spark, d):
    """Whole answers as JSON into typed blocks and usage."""
    x = read(spark, d, "documents").where("text <> ''")
    block = "named_struct('type', {}, 'text', {}, 'name', {}, 'id', {}, 'input', {})"
    blocks = f"array({block.format("'text'", 'text', 'null', 'null', 'null')})"
    both = f"array({block.format("'text'", 'text', 'null', 'null', 'null')}, {block.format("'tool_use'", 'null', "'lookup'", "concat('u', doc_id)", "named_struct('n', length(text))")})"
    body = f"CASE WHEN doc_id % 3 = 0 THEN to_json(named_struct('content', {both}, 'usage', named_struct('input_tokens', doc_id, 'output_tokens', length(text)))) ELSE to_json(named_struct('content', {blocks}, 'usage', named_struct('input_tokens', doc_id, 'output_tokens', length(text)))) END"
    schema = "content array<struct<type: string, text: string, name: string, id: string, input: struct<n: int>>>, usage struct<input_tokens: bigint, output_tokens: bigint>"
    p = x.select(F.col("doc_id").alias("id"), F.from_json(F.expr(body), schema).alias("p"))
    p = p.select("id", F.posexplode("p.content").alias("pos", "b"), F.col("p.usage").alias("u"))
    return p.select("id", (F.col("pos") + 1).alias("pos"), F.col("b.type").alias("kind"), F.md5("b.text").alias("digest"), F.col("b.name").alias("tool_name"), F.col("b.input.n").alias("input_n"), F.col("u.input_tokens").alias("used_input"), F.col("u.output_tokens").alias("used_output"))


# conversations: documents in order of time within a repository
_TH = """th AS (SELECT doc_id AS id, repo_path AS session, CASE doc_id % 2 WHEN 0 THEN 'USER' ELSE 'ASSISTANT' END AS actor, text, md5(coalesce(text, '')) AS data_hash, lower(trim(source)) AS source, created_at FROM documents)"""


def threads(spark, d):
    x = read(spark, d, "documents")
    return x.select(
        F.col("doc_id").alias("id"), F.col("repo_path").alias("session"), F.when(F.col("doc_id") % 2 == 0, "USER").otherwise("ASSISTANT").alias("actor"), "text", F.md5(F.coalesce("text", F.lit(""))).alias("data_hash"), F.lower(F.trim("source")).alias("source"), "created_at"
    )


def _turns():
    return Window.partitionBy("session").orderBy("created_at", "id")


def _query_before():
    """Id of the last user turn before."""
    return F.last(F.when(F.col("actor") == "USER", F.col("id")), ignorenulls=True).over(_turns().rowsBetween(Window.unboundedPreceding, -1))


_WS = "OVER (PARTITION BY session ORDER BY created_at NULLS FIRST, id)"


@query(f"WITH {_TH} SELECT id FROM th WHERE source = 'chat_turn' AND session = (SELECT max(session) FROM th)")
def scan_message_threads(spark, d):
    t = threads(spark, d)
    return t.where("source = 'chat_turn'").join(F.broadcast(t.agg(F.max("session").alias("session"))), "session", "left_semi").select("id")


@query(f"WITH {_TH} SELECT id, row_number() {_WS} AS turn FROM th WHERE source = 'chat_turn'")
def thread_history(spark, d):
    return threads(spark, d).where("source = 'chat_turn'").select("id", F.row_number().over(_turns()).alias("turn"))


@query(r"""SELECT doc_id AS id, md5(CASE WHEN doc_id % 4 = 0 THEN 'cached: ' ELSE '' END || coalesce(text, '')) AS digest, CASE WHEN doc_id IN (SELECT file_id % 5000 FROM repo_files) THEN 2 ELSE 1 END AS n_blocks FROM documents""")
def query_text(spark, d):
    """The cached part of a message before its own, and a block for its attachment if there is one."""
    a = read(spark, d, "repo_files").select((F.col("file_id") % 5000).alias("id"), F.lit(True).alias("attached")).distinct()
    t = threads(spark, d).select("id", F.concat(F.when(F.col("id") % 4 == 0, "cached: ").otherwise(""), F.coalesce("text", F.lit(""))).alias("full")).join(a, "id", "left")
    blocks = F.array(F.struct(F.lit("text").alias("kind"), F.col("full").alias("text")))
    blocks = F.when(F.col("attached"), F.array_append(blocks, F.struct(F.lit("file").alias("kind"), F.col("id").cast("string").alias("text")))).otherwise(blocks)
    return t.select("id", F.md5(F.get(blocks, 0)["text"]).alias("digest"), F.size(blocks).alias("n_blocks"))


@query(f"WITH {_TH}, c AS (SELECT id, list(id) OVER (PARTITION BY session ORDER BY created_at NULLS FIRST, id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS chain, last_value(CASE WHEN actor = 'USER' THEN id END IGNORE NULLS) OVER (PARTITION BY session ORDER BY created_at NULLS FIRST, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM th) SELECT id, array_to_string(CASE WHEN q IS NULL OR list_contains(coalesce(chain, []), q) THEN coalesce(chain, []) ELSE list_append(chain, q) END, ',') AS chain FROM c")
def conversation_chain(spark, d):
    """Ids of the last five turns, and of the query that a turn answers if it is none of these."""
    prev = F.collect_list("id").over(_turns().rowsBetween(-5, -1))
    c = threads(spark, d).select("id", prev.alias("chain"), _query_before().alias("q"))
    chain = F.when(F.col("q").isNull() | F.array_contains("chain", F.col("q")), F.col("chain")).otherwise(F.array_append("chain", F.col("q")))
    return c.select("id", F.array_join(F.transform(chain, lambda x: x.cast("string")), ",").alias("chain"))


@query(f"WITH {_TH} SELECT id, CASE actor WHEN 'USER' THEN 'user' ELSE 'model' END AS role FROM th")
def role_map(spark, d):
    return threads(spark, d).select("id", F.when(F.col("actor") == "USER", "user").otherwise("model").alias("role"))


# messages: the paragraphs of a document are the blocks of a message, those that begin with a fence or an indent are tool calls
_BLOCKS = """bl AS (SELECT doc_id AS id, list_transform(string_split(text, chr(10) || chr(10)), lambda b, i: {'tool': starts_with(b, '```') OR starts_with(b, '    '), 'ord': i, 'text': b}) AS blocks FROM documents WHERE text IS NOT NULL)"""


def messages(spark, d):
    """id, actor, session, blocks: array of (tool, ord, text)."""
    b = F.transform(F.split("text", "\n\n"), lambda b, i: F.struct((b.startswith("```") | b.startswith("    ")).alias("tool"), (i + 1).alias("ord"), b.alias("text")))
    return threads(spark, d).where("text is not null").select("id", "actor", "session", "created_at", b.alias("blocks"))


_SOLID = "list_filter(blocks, lambda b: b.tool OR regexp_matches(b.text, '[^ \\t\\n\\r]'))"


def _solid():
    return F.filter("blocks", lambda b: b["tool"] | b["text"].rlike(r"[^ \t\n\r]"))


@query(f"WITH {_BLOCKS} SELECT id, len({_SOLID}) AS n_blocks FROM bl WHERE len({_SOLID}) > 0")
def drop_blank_text(spark, d):
    """Blank text blocks are dropped; a message without blocks is none."""
    return messages(spark, d).select("id", F.size(_solid()).alias("n_blocks")).where("n_blocks > 0")


@query(f"WITH {_BLOCKS} SELECT id, array_to_string(list_transform(list_concat(list_filter(blocks, lambda b: NOT b.tool), list_filter(blocks, lambda b: b.tool)), lambda b: b.ord), ',') AS ords FROM bl")
def text_first_sort(spark, d):
    """Text blocks of a message before its tool blocks, each in their order."""
    return messages(spark, d).select("id", F.array_join(F.transform(F.array_sort("blocks"), lambda b: b["ord"].cast("string")), ",").alias("ords"))


# requests and responses of tools: chat turns ask, tool outputs answer; the key of a call repeats after a while
_CALLS = f"""{_TH}, t AS (SELECT id, session, created_at, CASE source WHEN 'chat_turn' THEN 'request' WHEN 'tool_output' THEN 'response' END AS kind, 'u' || (id % 7) AS tool_use_id FROM th WHERE session IS NOT NULL)"""


def calls(spark, d):
    t = threads(spark, d).where("session is not null")
    kind = F.when(F.col("source") == "chat_turn", "request").when(F.col("source") == "tool_output", "response")
    return t.select("id", "session", "created_at", kind.alias("kind"), F.concat(F.lit("u"), (F.col("id") % 7).cast("string")).alias("tool_use_id")).where("kind is not null")


@query()
def join_tool_request_response(spark, d):
    """Every response with the request that it takes from the line of its session, if there is one."""
    return ordered_fold(calls(spark, d), "session", ["created_at", "id"], P.Pairing, P.Pairing.SCHEMA).select("response", "request")


@query()
def tool_pairing_fifo(spark, d):
    """The pairs alone: requests that were passed over, and responses without one, do not come out."""
    return join_tool_request_response(spark, d).where("request is not null")


@query(f"WITH {_TH}, g AS (SELECT *, sum(CAST(source IS DISTINCT FROM 'tool_output' AS INT)) {_WS} AS grp FROM th) SELECT session, CAST(grp AS BIGINT) AS grp, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY created_at NULLS FIRST, id) AS ids FROM g WHERE source = 'tool_output' GROUP BY 1, 2")
def parallel_tool_grouping(spark, d):
    """Consecutive tool turns form one message; any other turn closes the group."""
    g = threads(spark, d).withColumn("grp", F.sum(F.when(F.col("source") == "tool_output", 0).otherwise(1)).over(_turns())).where("source = 'tool_output'")
    g = g.groupBy("session", "grp").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("created_at", "id"))).alias("a"))
    return g.select("session", "grp", "n", F.array_join(F.transform("a", lambda x: x["id"].cast("string")), ",").alias("ids"))


@query(f"WITH {_BLOCKS}, a AS (SELECT DISTINCT file_id % 5000 AS id FROM repo_files WHERE ends_with(file_path, '.py')) SELECT id, md5(array_to_string(list_transform(list_filter(blocks, lambda b: NOT b.tool), lambda b: b.text), chr(10) || chr(10))) AS digest, CASE WHEN a.id IS NULL THEN 0 ELSE 1 END AS n_images FROM bl LEFT JOIN a USING (id)")
def user_multipart(spark, d):
    """The texts of a message as one part, joined by blank lines, and its images after them."""
    images = attachments(spark, d).where(F.col("file_type").startswith("image/")).select("id").distinct().withColumn("n_images", F.lit(1))
    texts_ = F.array_join(F.transform(F.filter("blocks", lambda b: ~b["tool"]), lambda b: b["text"]), "\n\n")
    return messages(spark, d).join(images, "id", "left").select("id", F.md5(texts_).alias("digest"), F.coalesce("n_images", F.lit(0)).alias("n_images"))


def attachments(spark, d):
    """id, file_type: files stand for what is attached to the document of the same number."""
    kind = F.when(F.col("file_path").endswith(".py"), "image/png").otherwise("text/plain")
    return read(spark, d, "repo_files").select((F.col("file_id") % 5000).alias("id"), kind.alias("file_type"))


@query(f"WITH {_TH}, m AS (SELECT *, actor = 'ASSISTANT' AND source IS NOT DISTINCT FROM 'tool_output' AS calls FROM th), p AS (SELECT *, lag(actor = 'ASSISTANT' AND calls) {_WS} AS prev FROM m) SELECT id FROM p WHERE NOT (actor = 'ASSISTANT' AND NOT regexp_matches(coalesce(text, ''), '[^ \\t\\n\\r]') AND coalesce(prev, false))")
def filter_empty_after_tools(spark, d):
    """A blank message of the assistant is dropped if the one before, as it was given, is the assistant's with tool calls."""
    m = threads(spark, d).withColumn("calls", (F.col("actor") == "ASSISTANT") & F.col("source").eqNullSafe("tool_output"))
    p = m.withColumn("prev", F.lag("calls").over(_turns()))
    blank = ~F.coalesce("text", F.lit("")).rlike(r"[^ \t\n\r]")
    return p.where(~((F.col("actor") == "ASSISTANT") & blank & F.coalesce("prev", F.lit(False)))).select("id")


@query(f"WITH {_TH} SELECT session, string_agg(DISTINCT source, ',' ORDER BY source) AS tools FROM th WHERE source IS NOT NULL GROUP BY 1")
def tools_sorted(spark, d):
    return threads(spark, d).where("source is not null").groupBy("session").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("tools"))


@query(f"WITH {_BLOCKS}, {_TH}, l AS (SELECT th.id, len(blocks) AS last_block, row_number() OVER (PARTITION BY session ORDER BY th.created_at DESC, th.id DESC) = 1 AS last_message FROM th JOIN bl USING (id)) SELECT id, last_block, last_message FROM l")
def cache_breakpoint(spark, d):
    """Where a prompt may be kept: the last block of every turn, and the last message of its conversation."""
    m = messages(spark, d)
    last = m.groupBy("session").agg(F.max(F.struct("created_at", "id")).alias("m")).select(F.col("session").alias("_s"), F.col("m.id").alias("_last"))
    j = m.join(last, F.col("session").eqNullSafe(F.col("_s")))
    return j.select("id", F.size("blocks").alias("last_block"), (F.col("id") == F.col("_last")).alias("last_message"))


@query("SELECT doc_id AS id, ['eu', 'us', 'ap'][doc_id % 3 + 1] AS region FROM documents")
def session_region_route(spark, d):
    r = F.array(F.lit("eu"), F.lit("us"), F.lit("ap"))
    return threads(spark, d).select("id", F.element_at(r, (F.pmod("id", F.lit(3)) + 1).cast("int")).alias("region"))


@query(f"WITH {_TH} SELECT th.id FROM th JOIN (SELECT DISTINCT file_id % 5000 AS id FROM repo_files WHERE ends_with(file_path, '.py')) a ON a.id = th.id")
def attachment_filter(spark, d):
    """Turns whose attachment is there and is an image."""
    a = attachments(spark, d).where(F.col("file_type").startswith("image/")).select("id").distinct()
    return threads(spark, d).join(a, "id", "left_semi").select("id")


@query("SELECT source, count(input) AS n, sum(input) AS input, sum(cached) AS cached FROM (SELECT lower(trim(source)) AS source, n_chars AS input, CASE WHEN doc_id % 2 = 0 THEN n_chars END AS cached FROM documents) GROUP BY 1")
def usage_sum(spark, d):
    """A cached count is null only where all are."""
    x = read(spark, d, "documents").select(F.lower(F.trim("source")).alias("source"), "n_chars", F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")).alias("c"))
    return x.groupBy("source").agg(F.count("n_chars").alias("n"), F.sum("n_chars").alias("input"), F.sum("c").alias("cached"))


@query(f"WITH {_TH}, s AS (SELECT data_hash, min(id) AS stored FROM th GROUP BY 1) SELECT id, stored, stored = id AS inserted FROM th JOIN s USING (data_hash)")
def join_conversation_hashes(spark, d):
    """Turns matched with stored ones by content; misses are inserted."""
    t = threads(spark, d)
    s = t.groupBy("data_hash").agg(F.min("id").alias("stored"))
    return t.select("id", "data_hash").join(s, "data_hash").select("id", "stored", (F.col("stored") == F.col("id")).alias("inserted"))


@query(f"WITH {_TH}, q AS (SELECT *, last_value(CASE WHEN actor = 'USER' THEN id END IGNORE NULLS) OVER (PARTITION BY session ORDER BY created_at NULLS FIRST, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS query_id FROM th) SELECT id, query_id, '[{{\"kind\":\"text\",\"text\":\"' || md5(coalesce(text, '')) || '\"}}]' AS payload FROM q WHERE actor = 'ASSISTANT'")
def store_response(spark, d):
    """Response rows with the user's query that they answer - the last before them, over all turns - and the JSON of their
    blocks, which is what is hashed."""
    t = threads(spark, d).withColumn("query_id", _query_before()).where("actor = 'ASSISTANT'")
    payload = F.to_json(F.array(F.struct(F.lit("text").alias("kind"), F.md5(F.coalesce("text", F.lit(""))).alias("text"))))
    stored = t.select("id", "query_id", payload.alias("payload"), T.xxh64_hex(payload).alias("data_hash"))
    return stored.select("id", "query_id", "payload")


@query(f"WITH {_TH} SELECT id, md5(CASE WHEN id % 4 = 0 THEN 'cached: ' ELSE '' END || coalesce(text, '')) AS digest FROM th WHERE actor = 'USER'")
def store_query(spark, d):
    """Query rows: the whole message, the cached part before its own, is what is hashed."""
    q = threads(spark, d).where("actor = 'USER'")
    full = F.concat(F.when(F.col("id") % 4 == 0, "cached: ").otherwise(""), F.coalesce("text", F.lit("")))
    stored = q.select("id", full.alias("text"), T.xxh64_hex(full).alias("data_hash"))
    return stored.select("id", F.md5("text").alias("digest"))


@query()
def tool_budget(spark, d):
    """Servers in order, taken while the running total of their tools stays within the budget; others are passed over."""
    n = threads(spark, d).where("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    a = n.agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("a"), (F.sum("n") * 0.6).alias("cap"))
    fold = """aggregate(a, named_struct('t', cast(0 as bigint), 'k', cast(array() as array<string>)), (acc, x) -> CASE WHEN acc.t + x.n <= cap THEN named_struct('t', acc.t + x.n, 'k', array_append(acc.k, x.source)) ELSE acc END, acc -> acc.k)"""
    return a.select(F.explode(F.expr(fold)).alias("source"))
