"""Text edits row by row: search-and-replace blocks, line-numbered replacements, unified diffs."""

from __future__ import annotations

import difflib
import json
import re

import pandas as pd
from pyspark.sql import DataFrame

_BLOCK = re.compile(r"^-{3} SEARCH\n(.*?)^={3}\n(.*?)^\+{3} REPLACE[ \t]*$", re.S | re.M)
_BEGIN = re.compile(r"^-{3} SEARCH[ \t]*$", re.M)


class EditError(ValueError):
    """An edit that cannot be applied."""


def parse_blocks(diff: str) -> list[tuple[list[str], list[str]]]:
    """(search lines, replacement lines) of each block; a block without its end is an error."""
    diff = diff.replace("\r\n", "\n")
    found = [(a.splitlines(), b.splitlines()) for a, b in _BLOCK.findall(diff)]
    if len(found) != len(_BEGIN.findall(diff)):
        raise EditError("unterminated block")
    return found


def _runs(lines: list[str], n: int):
    return range(len(lines) - n + 1)


def locate(lines: list[str], search: list[str], fuzzy: float = 0.8) -> tuple[int, int] | None:
    """Half-open line span of the first place that fits: equal lines; equal but for a common indent; equal when trimmed;
    first and last line equal when trimmed (from three lines on); most similar window of about the same length."""
    n = len(search)
    if not n:
        return None
    for i in _runs(lines, n):
        if lines[i : i + n] == search:
            return i, i + n
    strip = [s.strip() for s in search]
    flat = [s.strip() for s in lines]
    depth = lambda s: len(s) - len(s.lstrip())
    candidates = [i for i in _runs(lines, n) if flat[i : i + n] == strip]
    for i in candidates:
        if len({depth(lines[i + k]) - depth(search[k]) for k in range(n) if strip[k]}) <= 1:
            return i, i + n
    if candidates:
        return candidates[0], candidates[0] + n
    if n >= 3:
        for i in _runs(lines, n):
            if flat[i] == strip[0] and flat[i + n - 1] == strip[-1]:
                return i, i + n
    best, span = fuzzy, None
    text = "\n".join(search)
    for size in range(max(1, int(n * 0.9)), int(n * 1.1 + 0.999) + 1):
        for i in _runs(lines, size):
            m = difflib.SequenceMatcher(None, text, "\n".join(lines[i : i + size]), autojunk=False)
            if m.real_quick_ratio() >= best and m.quick_ratio() >= best and (r := m.ratio()) >= best and (span is None or r > best):
                best, span = r, (i, i + size)
    return span


def search_replace(content: str, diff: str) -> str:
    """All blocks are located on the original text; a blank search appends. Line ends and a missing final one stay as
    they were; overlapping blocks, blocks without a place and an unchanged result are errors."""
    crlf = "\r\n" in content
    text = content.replace("\r\n", "\n")
    final = text.endswith("\n") or not text
    lines = text.split("\n")[:-1] if text.endswith("\n") else text.split("\n") if text else []
    spans, missing = [], []
    for search, new in parse_blocks(diff):
        if not any(s.strip() for s in search):
            spans.append((len(lines), len(lines), new))
        elif span := locate(lines, search):
            spans.append((*span, new))
        else:
            near = difflib.get_close_matches(search[0], lines, 1, 0.6)
            missing.append(search[0] + (f" (near: {near[0]})" if near else ""))
    if missing:
        raise EditError("not found: " + "; ".join(missing))
    spans.sort(key=lambda x: (x[0], x[1]))
    if any(b[0] < a[1] for a, b in zip(spans, spans[1:])):
        raise EditError("blocks overlap")
    out, at = [], 0
    for a, b, new in spans:
        out += lines[at:a] + new
        at = b
    out += lines[at:]
    result = "\n".join(out) + ("\n" if final and out else "")
    if result == text:
        raise EditError("no change")
    return result.replace("\n", "\r\n") if crlf else result


def line_numbered(content: str, chunks: list[tuple[int, int, str]]) -> str:
    """Replace lines start..end (1-based) by each chunk's text. Of a replacement's pieces the last is dropped, so one
    without a final line end loses its last line; chunks that no line reaches are appended whole."""
    waiting = sorted(chunks, key=lambda c: c[0])
    out, skip = [], 0
    for no, line in enumerate(content.splitlines(keepends=True), 1):
        if no > skip and waiting and waiting[0][0] == no:
            _, end, text = waiting.pop(0)
            out += [p + "\n" for p in text.split("\n")[:-1]]
            skip = end
        if no > skip:
            out.append(line)
    for _, _, text in waiting:
        out += [p + "\n" for p in text.split("\n")]
    return "".join(out)


def hunks(diff: str) -> list[list[str]]:
    """Hunks of a unified diff, code fences and file headers taken off; those without a change are left out."""
    out: list[list[str]] = [[]]
    for line in diff.replace("\r\n", "\n").split("\n"):
        if line.startswith(("```", "--- ", "+++ ", "diff --git", "index ")):
            continue
        if line.startswith("@@"):
            out.append([])
        elif line or out[-1]:
            out[-1].append(line)
    return [h for h in out if any(x[:1] in "+-" and x for x in h)]


def before_after(hunk: list[str]) -> tuple[list[str], list[str]]:
    clean = [h if h else " " for h in hunk]
    return [h[1:] for h in clean if h[0] in " -"], [h[1:] for h in clean if h[0] in " +"]


def normalised(hunk: list[str]) -> list[str]:
    """The hunk as a plain difference of its sides: white space on blank lines is dropped, changes come first as removed, then
    as added lines; empty if the sides are equal."""
    old, new = (["" if not x.strip() else x for x in side] for side in before_after(hunk))
    return list(difflib.unified_diff(old, new, n=max(len(old), len(new)), lineterm=""))[3:]


def distinct_hunks(found: list[list[str]]) -> list[list[str]]:
    """Normalised hunks, equal ones and those without a change once or not at all."""
    out: dict[str, list[str]] = {}
    for h in found:
        n = normalised(h)
        if n:
            out.setdefault("\n".join(n), n)
    return list(out.values())


_OUT = "\u2190"


def relative(text: str) -> str:
    """Each line's indent as what it adds to that of the line before, or as marks for what it takes away."""
    out, before = [], ""
    for line in text.split("\n"):
        body = line.lstrip(" \t")
        indent = line[: len(line) - len(body)] if body else before
        out.append((indent[len(before) :] if indent.startswith(before) else _OUT * (len(before) - len(indent)) or _OUT + "=" + indent) + body if body else line)
        before = indent
    return "\n".join(out)


def absolute(text: str) -> str | None:
    """The inverse of `relative`; None where more is taken away than there is."""
    out, before = [], ""
    for line in text.split("\n"):
        marks = len(line) - len(line.lstrip(_OUT))
        rest = line[marks:]
        if not rest.strip():
            out.append(line)
            continue
        if marks == 1 and rest.startswith("="):
            rest = rest[1:]
            before = ""
        elif marks > len(before):
            return None
        else:
            before = before[: len(before) - marks]
        body = rest.lstrip(" \t")
        before += rest[: len(rest) - len(body)]
        out.append(before + body)
    return "\n".join(out)


def flexible_replace(content: str, search: str, new: str) -> str | None:
    """All places of a text replaced: as it is, without blank lines around, by relative indents, or both; None if there is
    none. Markers of indents must not occur in the texts themselves."""
    plain = lambda t: t
    bare = lambda t: t.strip("\r\n") + "\n"
    for strip, by_indent in ((plain, False), (bare, False), (plain, True), (bare, True)):
        if by_indent and _OUT in content + search + new:
            continue
        a, b, c = (relative(strip(t)) if by_indent else strip(t) for t in (content, search, new))
        if b.strip() and b in a:
            got = a.replace(b, c)
            if (got := absolute(got) if by_indent else got) is not None:
                return got
    return None


def _apply_hunk(lines: list[str], hunk: list[str]) -> list[str] | None:
    """The hunk where its old side fits, all places if it fits several times; else with less and less context."""
    while hunk and not hunk[-1].strip():
        hunk = hunk[:-1]
    edges = [i for i, h in enumerate(hunk) if h[:1] in "+-" and h]
    for drop in range(max(edges[0], len(hunk) - 1 - edges[-1]) + 1):
        part = hunk[min(drop, edges[0]) : len(hunk) - min(drop, len(hunk) - 1 - edges[-1])]
        old, new = before_after(part)
        if not old:
            return lines + new if not lines or drop == 0 and len(hunk) == len(new) else None
        if (span := locate(lines, old, 2.0)) is None:
            continue
        at, out, n = 0, [], span[1] - span[0]
        exact = lines[span[0] : span[1]]
        while at < len(lines):
            if lines[at : at + n] == exact:
                out += new
                at += n
            else:
                out.append(lines[at])
                at += 1
        return out
    old, new = before_after(hunk)
    got = flexible_replace("\n".join(lines) + "\n", "\n".join(old) + "\n", "\n".join(new) + "\n") if old else None
    return got.removesuffix("\n").split("\n") if got is not None else None


def unified(content: str, diff: str) -> tuple[str, list[str]]:
    """(new text, errors): hunks one after another; a hunk without a place is reported and passed over."""
    crlf, text = "\r\n" in content, content.replace("\r\n", "\n")
    final = text.endswith("\n")
    lines, errors = text.split("\n")[: -1 if final else None] if text else [], []
    for h in distinct_hunks(hunks(diff)):
        got = _apply_hunk(lines, h)
        if got is None:
            errors.append("no place for hunk: " + h[0][:60])
        else:
            lines = got
    out = "\n".join(lines) + ("\n" if (final or not text) and lines else "")
    return (out.replace("\n", "\r\n") if crlf else out), errors


def numbered(content: str, diff: str) -> tuple[str, list[str]]:
    """A line-numbered edit given as JSON: [[first line, last line, text], ...]."""
    try:
        chunks = [(int(a), int(b), str(t)) for a, b, t in json.loads(diff)]
    except (ValueError, TypeError) as e:
        raise EditError(f"no list of line ranges and texts: {e}") from e
    return line_numbered(content, chunks), []


RUNNERS = {"search_and_replace": lambda c, d: (search_replace(c, d), []), "unified": unified, "line_numbered": numbered}


def apply_edits(edits: DataFrame, key: str = "file_path") -> DataFrame:
    """key, content, errors of rows (key, content, kind, diff): one edit per row by the runner of its kind. A row whose
    edit fails keeps its content and says why; nothing is shuffled."""

    def run(batches):
        for b in batches:
            text, why = [], []
            for c, kind, d in zip(b["content"], b["kind"], b["diff"]):
                try:
                    new, errors = RUNNERS[kind](c or "", d or "")
                except (EditError, KeyError) as e:
                    new, errors = c, [str(e)]
                text.append(new)
                why.append("; ".join(errors) or None)
            yield pd.DataFrame({key: b[key], "content": text, "errors": why})

    kept = edits.select(key, "content", "kind", "diff")
    return kept.mapInPandas(run, f"`{key}` {dict(kept.dtypes)[key]}, content string, errors string")
