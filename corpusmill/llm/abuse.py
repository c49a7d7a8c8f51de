"""Scores for abusive, hateful and sexual content: a weighted finite-state grammar over clauses.

A text is normalised (compatibility forms, invisible characters, look-alike letters, spaced or dashed letters, digits
and signs for letters, repeated letters, masked letters) and cut into clauses. Then transducers are composed:

1. the lexicon maps a token to its labels: insults, demeaning words, groups, targets, violence, explicit words;
2. reported speech makes neutral what somebody else said or what is quoted where words are talked about;
3. negation makes neutral the insult that is denied, or said of oneself or of a thing - not others of the clause;
4. the grammar, in which insult, threat, target and hate are parts that rules are composed of, accepts clauses, each group
   of rules with its weight; all rules run as one automaton, one step per token.

Steps 2 and 3 only take symbols away, so they are run on clauses that the grammar accepts without them, and the grammar
once more on what is left. Soft-wrapped lines are joined before. The score of a text is 1 minus the product of
(1 - weight) over its matches.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corpusmill.session import spread

from . import abuse_lexicon as lexicon
from .abuse_rules import DENIED, GRAMMAR, LISTED, REPORTED, RULES
from .fst import BEGIN, END, Acceptor, Rewriter, labels
from .mix import normal_source

#: Texts with at least this score are cases.
THRESHOLD = 0.5

_LOOKALIKE = str.maketrans(
    "аеорсхуіѕјԁһкмтвнгӏքοαειρνκτυ",
    "aeopcxyisjdhkmtbhrlfoaeipvktu",
)
_LOOKS = re.compile("[" + "".join(chr(c) + chr(c).upper() for c in _LOOKALIKE) + "]")
_LEET = str.maketrans("4310578$@!|€+", "aeiostbsaiiet")
_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤︀-️﻿]")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:([ \-._*])[^\W\d_])(?:\1[^\W\d_]){2,}(?![^\W_])")
_CLAUSE = re.compile("(?<=[.!?])[\\s\"'»“)]+|[\n\r  ]+|(?<=[.!?])(?=[A-ZÄÖÜÉ¡¿])")
_WORD = re.compile(r"[\w@$!*|€+]+(?:[-'’][\w@$*]+)*")
_BREAK = re.compile("\r\n|[\n\r\u2028\u2029]")
_MARGIN = re.compile(r"(?P<margin>\s*)(?P<mark>(?:(?://[/!]?|#+|\*|--|;+|>)\s+)*)")
_ITEM = re.compile(r"(?:[-+•]|\d+[.)]|[a-z]\))\s")
_BEGIN = re.compile(r"(?!\w+(?: ?=|\())[^\W_]|[\"'(«„“‘$@!|€+*]\S")
_END = re.compile(r"(?:^|[^\w,)\"'’”»“\-*@$])[\"'’”»“)]*\s*$|[.!?:;][\"'’”»“)]*\s*$")
_HYPHEN = re.compile(r"[^\W\d_]-$")
_COMMAS = frozenset(",;:–—…")
_MARKED = re.compile(rf"{_WORD.pattern}|[{''.join(sorted(_COMMAS))}]")
_RUN = re.compile(r"(.)\1+")
_QUOTED = re.compile(r"«[^»]{1,80}»|„[^“”]{1,80}[“”]|“[^”]{1,80}”|\"[^\"]{1,80}\"|`[^`]{1,80}`|‘[^’]{1,80}’|(?<!\w)'[^'\n]{1,80}'(?!\w)")


def _fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


def _squeeze(s: str) -> str:
    return _RUN.sub(r"\1", s)


_SEX = {_fold(w) for w in lexicon.EXPLICIT}
_SOFT = {_fold(w) for w in lexicon.SOFT}
_STRONG = {_fold(w) for w in lexicon.INSULTS} - _SOFT
_SLURS = {_fold(w) for w in lexicon.SLURS}
_ALL = _STRONG | _SOFT | _SEX | _SLURS
_SQUEEZED: dict[str, str] = {}
for _w in sorted(_ALL):
    if len(_squeeze(_w)) >= 5:
        _SQUEEZED.setdefault(_squeeze(_w), _w)
_MASKS: dict[tuple, str] = {}
for _w in sorted(_ALL, key=lambda w: (w in _STRONG, w)):
    _MASKS[(_w[0], _w[-1], len(_w))] = _w
_OPEN_MASKS: dict[tuple, str] = {}
for _w in sorted(_ALL, key=lambda w: (w in _STRONG, w)):
    _OPEN_MASKS.setdefault((_w[0], len(_w)), _w)
_GROUPS = {_fold(w) for w in lexicon.GROUPS}


def normalise(text: str) -> str:
    """Compatibility forms, no invisible characters, look-alikes as Latin in words that are Latin or all look-alikes,
    spaced letters joined. Case and sentence marks stay."""
    t = text if text.isascii() else _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if _LOOKS.search(t):
        t = re.sub(r"[^\W\d_]+", _latin, t)
    if _SPACED.search(t):
        t = _SPACED.sub(lambda m: re.sub(r"[ \-._*]", "", m.group()), t)
    return t


def _latin(m) -> str:
    w = m.group()
    low = w.lower()
    mapped = low.translate(_LOOKALIKE)
    if mapped == low:
        return w
    latin = sum("a" <= c <= "z" for c in low)
    return mapped if latin or _fold(mapped).isascii() and mapped in _ALL else w


@functools.lru_cache(1 << 14)
def word(token: str) -> str:
    """The word that a token stands for, in folded lower case: an insult or explicit word also where it is written with
    signs, repeated or masked letters; 'ID' for identifiers and numbers."""
    low = token.lower()
    core = low.strip("!*|+@$€") if not low.startswith(("@", "$")) else low.rstrip("!*|+")
    f = _fold(core)
    if f in _ALL or f in _GROUPS:
        return f
    if f.isalpha() and f.isascii():
        if _RUN.search(f) and (w := _SQUEEZED.get(_squeeze(f))):
            return w
        return f if not (token[1:].lower() != token[1:] and not token.isupper()) else "ID"
    if "*" in low and re.fullmatch(r"\w\*{2,}\w?", low.strip("!")):
        m = low.strip("!")
        w = _OPEN_MASKS.get((m[0], len(m))) if m[-1] == "*" else _MASKS.get((m[0], m[-1], len(m)))
        return "f" if w is None else w
    if "_" in f or re.fullmatch(r"\d+", f):
        return "ID"
    if any(c.isalpha() for c in f):
        g = _fold(low.rstrip("!*|+") if low[-1:] in "!*|+" and low.rstrip("!*|+") else low).translate(_LEET)
        for x in (g, g.replace("i", "l"), g.rstrip("i")):
            h = re.sub(r"[-']", "", x)
            if h in _ALL or (w := _SQUEEZED.get(_squeeze(h))) and (h := w):
                return h
    h = re.sub(r"[-.]", "", f)
    return h if h in _ALL or h in _GROUPS else f


_ACCEPTOR = Acceptor([r for _, r in RULES])
_REPORTED, _DENIED, _LISTED = Rewriter(REPORTED), Rewriter(DENIED), Rewriter(LISTED)
_KNOWN = set().union(*(labels(r) for r in [*(r for _, r in RULES), *REPORTED, *DENIED, *LISTED]))
_OTHERS = {_fold(w) for w in lexicon.OTHERS}
_COMMON = {_fold(w) for w in lexicon.COMMON} | {"CAP", "WORD", "FREE", "UNLIKE", "NOTWHO", "LY", "NEG", "PARTS_OF_YOU", BEGIN, END, ","}
#: Without one of these labels in a clause no rule of the grammar can match.
_TELLING = set().union(*(labels(r) for _, r in RULES)) - _COMMON
_LABELS: dict[str, set[str]] = {}
for _name, _list in [*lexicon.CLASSES.items(), ("INS", _STRONG), ("SOFT", _SOFT), ("SEX", _SEX)]:
    for _w in _list:
        _LABELS.setdefault(_fold(_w), set()).add(_name)

_FIRST, _LAST, _COMMA = frozenset({BEGIN}), frozenset({END, "UNLIKE"}), frozenset({",", "UNLIKE"})
_interned: dict[frozenset, frozenset] = {}


def _symbol(w: str, cap: bool) -> frozenset:
    got = set(_LABELS.get(w, ()))
    if w in _KNOWN:
        got.add(w)
    elif cap and not got and w not in _COMMON and w != "ID":
        got.add("CAP")
    got.add("WORD")
    if not got & {"INS", "SOFT"} and w not in _OTHERS:
        got.add("FREE")
    if w != "like":
        got.add("UNLIKE")
    if w not in ("who", "whoever", "which"):
        got.add("NOTWHO")
    if len(w) > 4 and w.endswith("ly"):
        got.add("LY")
    f = frozenset(got)
    return _interned.setdefault(f, f)


@functools.lru_cache(1 << 17)
def symbols(token: str) -> tuple[frozenset, ...]:
    """The symbols of a token; a contraction is several words."""
    w = word(token)
    cap = token[:1].isupper() and token[1:].islower()
    return (_symbol(w, cap),) if w.isalnum() else tuple(_symbol(x, cap) for x in _NO_WORD.split(w) if x)


@functools.lru_cache(1 << 17)
def telling(token: str) -> bool:
    return any(s & _TELLING for s in symbols(token))


_NO_WORD = re.compile(r"[^\w]+")
_HINT = re.compile(r"[^\W_]")


def encode(clause: str) -> list[frozenset]:
    """The clause as symbols between its begin and its end, commas included."""
    out = [_FIRST]
    for t in _MARKED.findall(clause):
        if t in _COMMAS:
            out.append(_COMMA)
        else:
            out += symbols(t)
    out.append(_LAST)
    return out


def _accepted(s: list[frozenset]) -> set[int]:
    """Groups of rules that accept the clause."""
    return {RULES[k][0] for k in _ACCEPTOR.scan(x for x in s if x is not _COMMA)}


def score_clause(clause: str) -> tuple[list[tuple[str, float]], bool]:
    """[(kind, weight)] of the groups of rules that the clause matches after what is quoted, listed, reported, denied or
    said of oneself or of a thing was taken back; and whether anything was."""
    tokens = _WORD.findall(clause)
    if not any(map(telling, tokens)):
        return [], False
    s = encode(clause)
    before = found = _accepted(s)
    if found and _QUOTED.search(clause):
        bare = encode(_QUOTED.sub(" ", clause))
        if any(x & {"MENTION", "SAID", "WROTE"} for x in bare):
            s, found = bare, _accepted(bare)
    if found:
        rest = _REPORTED(s)
        if any("MENTION" in x for x in rest):
            rest = _LISTED(rest)
        rest = _DENIED(rest)
        if rest != s:
            found = _accepted(rest)
    return [GRAMMAR[g][:2] for g in sorted(found)], len(found) < len(before)


def score_text(text: str | None) -> tuple[float, str | None]:
    """(score from 0 to 1, kind with the greatest weight or None); 0 for null and blank texts."""
    if not text or not _HINT.search(text):
        return 0.0, None
    text = normalise(text)
    if not _BROKEN.search(text) and not any(map(telling, set(_WORD.findall(text)))):
        return 0.0, None
    left, best = 1.0, (0.0, None)
    for block in _blocks(text):
        for kind, weight in _score_block(block):
            left *= 1 - weight
            best = max(best, (weight, kind), key=lambda x: x[0])
    return round(1 - left, 6), best[1]


def _score_lines(lines: list[str]) -> tuple[list[tuple[str, float]], bool]:
    out, took = [], False
    for s in lines:
        for clause in _CLAUSE.split(s):
            if clause and len(clause) > 2:
                got, back = score_clause(clause)
                out += got
                took |= back
    return out, took


def _score_block(lines: list[str]) -> list[tuple[str, float]]:
    """Matches in soft-wrapped lines as one; where nothing was taken back, those of the single lines if they are more:
    some patterns end with the line."""
    if len(lines) == 1:
        return _score_lines(lines)[0]
    one = ""
    for s in lines:
        one = one + s if _HYPHEN.search(one) else f"{one} {s}"
    both, took = _score_lines([one])
    if took:
        return both
    single = _score_lines(lines)[0]
    return both if len(single) <= len(both) else single


_BROKEN = re.compile(r"[^\W\d_]-[\r\n\u2028\u2029]")


def _blocks(text: str):
    """Lists of lines, each without its margin and comment mark, that are one line of prose wrapped.

    A line goes on in the next one if it ends without a stop, bracket or operator, and the next has the same margin and
    mark (under a list item a deeper margin) and begins with a word, but is no list item.
    """
    block, before, end = [], ("", ""), False
    for line in _BREAK.split(text):
        m = _MARGIN.match(line)
        body = line[m.end() :]
        item = _ITEM.match(body)
        here = (m["margin"] if not m["mark"] else "", m["mark"].strip())
        depth = len(here[0]) if not here[1] else len(m.group())
        if block and not end and not item and _BEGIN.match(body) and here[1] == before[1] and (depth == before[2] or before[3] and depth > before[2]):
            block.append(body)
            before = (*before[:2], depth, False)
        else:
            if block:
                yield block
            block, before = [body] if body.strip() else [], (*here, depth, bool(item))
        end = bool(_END.search(body))
    if block:
        yield block


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, kind, flagged for every row of `docs`; nothing is shuffled, rows written twice stay twice."""
    kept = spread(docs.select(F.col(key).alias(key), F.col(text).alias("_text")))

    def run(batches):
        for b in batches:
            got = [score_text(t) for t in b["_text"]]
            yield pd.DataFrame({key: b[key], "score": [s for s, _ in got], "kind": [k for _, k in got], "flagged": [s >= THRESHOLD for s, _ in got]})

    return kept.mapInPandas(run, f"`{key}` {dict(kept.dtypes)[key]}, score double, kind string, flagged boolean")


def rates(docs: DataFrame) -> DataFrame:
    """Per source in one spelling: documents, flagged ones by kind, rate. Null sources form one group."""
    tagged = docs.select(F.struct("doc_id", normal_source(F.col("source")).alias("source")).alias("k"), "text")
    got = score(tagged, "k")
    one = lambda k: F.count_if(F.col("flagged") & (F.col("kind") == k))
    return got.groupBy(F.col("k.source").alias("source")).agg(
        F.count("*").alias("n_docs"), F.count_if("flagged").alias("n_flagged"), one("abusive").alias("n_abusive"), one("hateful").alias("n_hateful"), one("sexual").alias("n_sexual"),
        (F.count_if("flagged") / F.count("*")).alias("rate"),
    )
