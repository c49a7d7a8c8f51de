"""Event streams of language model providers in one vocabulary, and what is built from it.

A machine takes a stream's raw payloads (JSON texts) one by one and gives normal events:
(kind, text, tool_name, tool_use_id, input, output, cache_read, cache_write). Kinds are text_start, text_delta, text_end,
tool_start, tool_delta, tool_end, thinking_start, thinking_delta, thinking_end, redacted, malformed and usage. Payloads
that are no JSON, or of kinds unknown here, give nothing. Machines are plain objects that can be pickled, so they serve
the batch fold and the stateful one alike.
"""

from __future__ import annotations

import json

EVENT = "kind string, text string, tool_name string, tool_use_id string, input bigint, output bigint, cache_read bigint, cache_write bigint"


def event(kind: str, text: str | None = None, tool: str | None = None, use: str | None = None) -> tuple:
    return kind, text, tool, use, None, None, None, None


def usage(given: int, made: int, read: int | None = None, written: int | None = None) -> tuple:
    return "usage", None, None, None, given, made, read, written


class Machine:
    """`feed(row)` with the raw payload in row.payload."""

    def feed(self, row) -> list[tuple]:
        try:
            x = json.loads(row.payload)
        except (TypeError, ValueError):
            return []
        return self.take(x) if isinstance(x, dict) else []

    def take(self, x: dict) -> list[tuple]:
        raise NotImplementedError

    def close(self) -> list[tuple]:
        return []


class Messages(Machine):
    """Blocks with numbered starts and stops (`content_block_start`, `content_block_delta`, `content_block_stop`); usage comes
    with `message_stop`. A tool call without arguments gets an empty object. A thinking block ends with its signature."""

    def __init__(self):
        self.running, self.any_arguments = None, False

    def take(self, x):
        kind, block, delta = x.get("type"), x.get("content_block") or {}, x.get("delta") or {}
        if kind == "message_stop":
            m = next((v for k, v in x.items() if k.endswith("invocationMetrics")), {})
            return [usage(m.get("inputTokenCount", 0), m.get("outputTokenCount", 0), m.get("cacheReadInputTokenCount", 0), m.get("cacheWriteInputTokenCount", 0))]
        if kind == "content_block_start":
            self.any_arguments = False
            if block.get("type") == "text":
                self.running = "text"
                return [event("text_start")]
            if block.get("type") == "tool_use":
                self.running = "tool"
                return [event("tool_start", None, block.get("name"), block.get("id"))]
            if block.get("type") == "thinking":
                self.running = "thinking"
                return [event("thinking_start")]
            if block.get("type") == "redacted_thinking":
                self.running = "thinking"
                return [event("redacted", block.get("data"))]
        if kind == "content_block_delta":
            what = delta.get("type")
            if what == "text_delta":
                self.running = "text"
                return [event("text_delta", delta.get("text"))]
            if what == "input_json_delta":
                self.running = "tool"
                self.any_arguments |= bool(delta.get("partial_json"))
                return [event("tool_delta", delta.get("partial_json"))]
            if what == "thinking_delta":
                self.running = "thinking"
                return [event("thinking_delta", delta.get("thinking"))]
            if what == "signature_delta":
                self.running = "thinking"
                return [event("thinking_end", delta.get("signature"))]
        if kind == "content_block_stop":
            if self.running == "tool":
                empty = [] if self.any_arguments else [event("tool_delta", "{}")]
                self.any_arguments = False
                return [*empty, event("tool_end")]
            if self.running == "text":
                return [event("text_end")]
        return []


class Responses(Machine):
    """Items that are added and done (`response.output_item.added`, ...); the prompt's cached tokens are not counted as
    input. Stateless."""

    def take(self, x):
        kind, item = x.get("type"), x.get("item") or {}
        if kind == "response.completed":
            u = (x.get("response") or {}).get("usage")
            if not u:
                return []
            cached = (u.get("input_tokens_details") or {}).get("cached_tokens", 0)
            return [usage(u.get("input_tokens", 0) - cached, u.get("output_tokens", 0), cached)]
        if kind == "response.output_item.added":
            if item.get("type") == "function_call":
                return [event("tool_start", None, item.get("name"), item.get("call_id"))]
            return [event("text_start")] if item.get("type") == "message" else []
        name = {
            "response.function_call_arguments.delta": "tool_delta", "response.function_call_arguments.done": "tool_end", "response.output_text.delta": "text_delta", "response.output_text.done": "text_end",
        }.get(kind)
        return [event(name, x.get("delta") if name.endswith("delta") else None)] if name else []


class Candidates(Machine):
    """Chunks of parts, each a text or a whole function call: a change of kind ends the running text; calls come whole."""

    def __init__(self):
        self.in_text = False

    def take(self, x):
        c = (x.get("candidates") or [{}])[0]
        m = x.get("usage_metadata")
        spent = []
        if m and c.get("finish_reason"):
            cached = m.get("cached_content_token_count") or 0
            spent = [usage((m.get("prompt_token_count") or 0) - cached, m.get("candidates_token_count") or 0, cached)]
        if c.get("finish_reason") == "MALFORMED_FUNCTION_CALL":
            self.in_text = False
            return [event("malformed", c.get("finish_message") or "No message provided"), *spent]
        out = []
        for p in (c.get("content") or {}).get("parts") or []:
            text, call = p.get("text"), p.get("function_call")
            if text:
                out += [event("text_start")] * (not self.in_text) + [event("text_delta", text)]
                self.in_text = True
            elif call:
                out += [event("text_end")] * self.in_text
                out += [event("tool_start", None, call.get("name"), call.get("id")), event("tool_delta", arguments(call.get("args"))), event("tool_end")]
                self.in_text = False
        if c.get("finish_reason"):
            out += [event("text_end")] * self.in_text
            self.in_text = False
        return out + spent


def arguments(args) -> str:
    """Arguments of a whole call as JSON: none are an empty object, a text that is no JSON is wrapped."""
    if not args:
        return "{}"
    if isinstance(args, str):
        try:
            json.loads(args)
            return args
        except ValueError:
            return json.dumps({"value": args}, ensure_ascii=False)
    return json.dumps(args, ensure_ascii=False)


class Choices(Machine):
    """Deltas of one choice with content, reasoning and tool calls mixed. After the first tool call all text and reasoning
    is passed over, encrypted reasoning always; what is open at the end is closed."""

    def __init__(self):
        self.text_open = self.thinking_open = self.seen_call = self.call_open = False
        self.call_id = self.call_name = None

    def take(self, x):
        if u := x.get("usage"):
            cached = (u.get("prompt_tokens_details") or {}).get("cached_tokens") or 0
            return [usage((u.get("prompt_tokens") or 0) - cached, u.get("completion_tokens") or 0, cached)]
        choice = (x.get("choices") or [{}])[0]
        d, finish, out = choice.get("delta") or {}, choice.get("finish_reason"), []
        text, calls, reasoning, details = d.get("content") or "", d.get("tool_calls") or [], d.get("reasoning"), d.get("reasoning_details")
        details = [details] if isinstance(details, dict) else [y for y in details or [] if isinstance(y, dict)]
        if any(y.get("type") == "reasoning.encrypted" for y in details):
            return []
        if reasoning or details:
            if self.seen_call:
                return []
            out += [event("thinking_start")] * (not self.thinking_open)
            self.thinking_open = True
            return [*out, event("thinking_delta", reasoning or " ".join(str(y.get("summary") or y.get("data") or "") for y in details))]
        if self.thinking_open and (text or calls or finish in ("stop", "tool_calls")):
            out.append(event("thinking_end", ""))
            self.thinking_open = False
        if calls:
            self.seen_call = True
            out += self._end_text()
            for c in calls:
                f = c.get("function") or {}
                if c.get("id") and f.get("name"):
                    out += self._end_call()
                    self.call_id, self.call_name, self.call_open = c["id"], f["name"], True
                    out.append(event("tool_start", None, self.call_name, self.call_id))
                if f.get("arguments") and self.call_open:
                    out.append(event("tool_delta", f["arguments"]))
            if finish == "tool_calls":
                out += self._end_call()
            return out
        if text:
            out += self._end_call()
            if self.seen_call:
                return out
            out += [event("text_start")] * (not self.text_open) + [event("text_delta", text)]
            self.text_open = True
        if finish == "stop":
            out += self._end_text()
        return out

    def _end_text(self) -> list[tuple]:
        was, self.text_open = self.text_open, False
        return [event("text_end")] * was

    def _end_call(self) -> list[tuple]:
        was, self.call_open = self.call_open, False
        return [event("tool_end")] * was

    def close(self):
        return self._end_text() + self._end_call()


MACHINES = {"messages": Messages, "responses": Responses, "candidates": Candidates, "choices": Choices}

BLOCK = "block int, kind string, text string, tool_name string, tool_use_id string, tool_input string"


class Blocks:
    """Normal events into content blocks: a start drops what is open, a delta or an end counts only for an open block of its
    kind, a block that does not end is lost. A tool's arguments are read as JSON at its end; if they are none, the block has
    a null input."""

    def __init__(self):
        self.n, self.kind, self.parts, self.tool = 0, None, [], (None, None)

    def feed(self, row) -> list[tuple]:
        kind, _, step = row.kind.partition("_")
        if row.kind == "redacted":
            self.kind = None
            return [self._made("redacted", row.text)]
        if step == "start":
            self.kind, self.parts, self.tool = kind, [], (row.tool_name, row.tool_use_id)
        elif step == "delta" and kind == self.kind:
            self.parts.append(row.text or "")
        elif step == "end" and kind == self.kind:
            self.kind = None
            text, self.parts = "".join(self.parts), []
            if kind == "tool":
                try:
                    given = json.dumps(json.loads(text or "{}"), ensure_ascii=False, separators=(",", ":"))
                except ValueError:
                    given = None
                return [self._made("tool", None, *self.tool, given)]
            return [self._made(kind, text)]
        return []

    def _made(self, kind, text, tool=None, use=None, given=None) -> tuple:
        self.n += 1
        return self.n, kind, text, tool, use, given

    def close(self) -> list[tuple]:
        return []


class Pairing:
    """Requests of tools wait in line; a response takes the one with its id after all before it have left the line, and
    without one empties it. Rows: row.kind ('request' or 'response'), row.id, row.tool_use_id."""

    SCHEMA = "response bigint, request bigint"

    def __init__(self):
        self.line: list[tuple] = []

    def feed(self, row) -> list[tuple]:
        if row.kind == "request":
            self.line.append((row.tool_use_id, row.id))
            return []
        while self.line:
            use, request = self.line.pop(0)
            if use == row.tool_use_id:
                return [(row.id, request)]
        return [(row.id, None)]

    def close(self) -> list[tuple]:
        return []


class Tags:
    """What lies in and outside the given tags of a text that comes in pieces (row.text); one row at the end."""

    SCHEMA = "n_tags int, inside string, outside string"

    def __init__(self, tags: set[str]):
        from corpusmill.streaming.events import TagParser

        self.parser, self.inside, self.outside = TagParser(tags), [], []

    def _take(self, found) -> None:
        for tag, text in found:
            (self.outside if tag is None else self.inside).append(text)

    def feed(self, row) -> list[tuple]:
        self._take(self.parser.feed(row.text or ""))
        return []

    def close(self) -> list[tuple]:
        self._take(self.parser.close())
        return [(self.parser.closed, "".join(self.inside), "".join(self.outside))]
