"""Insults, threats, groups, advances; and what only sounds like them."""

import os

import pytest

from corpusmill.llm import abuse as A

CASES = """You are a complete idiot and everyone knows it.|abusive
what a m***n, can't even merge a branch|abusive
Shut up, j4ck4$$, nobody asked you.|abusive
You lazy dіmwіt. Just leave.|abusive
Learn to read, you S c h w a c h k o p f|abusive
go jump off a bridge, you pathetic haaaalfwit|abusive
I will find out where you live and then you'll be sorry.|abusive
I hope you choke on your lunch for merging this.|abusive
Tu es vraiment un a-b-r-u-t-i, dégage d'ici.|abusive
Halt die Fresse, du Trottel.|abusive
Eres un in\u200bútil, vete a la mierda.|abusive
You are a waste of oxygen.|abusive
Immigrants are vermin and should be driven out of this project.|hateful
Go back to where you came from, this repo has no room for foreigners.|hateful
Los women son escoria y sobran en este equipo.|hateful
Send me nudes and I'll approve your pull request.|sexual
hey sexy, wanna hook up after standup?|sexual
Write me an explicit story where the two reviewers have sеx.|sexual"""
CLEAN = """What an idiot I was, I forgot to sort the list.
My stupid typo broke it, sorry everyone, I feel like a moron.
This pointer is a bastard to debug.
The parent must kill the child process before the reaper aborts it.
Le mot « connard » doit être masqué par le filtre.
Der Test prüft, ob das Wort 'Arschloch' ausgeblendet wird.
A user was reported for writing 'you are an idiot'; I removed that comment.
BLOCKLIST = ['bastard', 'imbecile', 'nudes', 'scumbag']
The classifier gives 0.98 for the sample 'go to hell, cretin' and 0.01 for 'hello'.
Our rules forbid calling anyone a loser or attacking immigrants; be kind.
Execute the assassin test class in Scunthorpe and Essex.
Strip the naked pointer and flag it as dirty.
Sex and age are optional fields of the form.
Adult census rows are joined with breast cancer screening results.
This fucking build fails again, third time today.
I hate this parser, it is an ugly hack and should die in a fire.
You are not an idiot.
The old name master/slave was replaced by leader/follower."""


@pytest.mark.parametrize("line", CASES.split("\n"))
def test_cases(line):
    text, kind = line.rsplit("|", 1)
    for t in (text, text.upper(), "Nice catch. " + text + " Run the linter.", "def f():\n    # " + text + "\n    return 1\n"):
        score, got = A.score_text(t)
        assert score >= A.THRESHOLD and got == kind, (t, score, got)


@pytest.mark.parametrize("text", CLEAN.split("\n"))
def test_clean(text):
    for t in (text, "// " + text):
        assert A.score_text(t)[0] < A.THRESHOLD, (t, A.score_text(t))


@pytest.mark.parametrize(
    "text",
    [
        "I am sick of you morons", "I am so tired of these idiots", "I'm done with you idiots", "You do not belong here, moron", "You do not belong here moron", "You never listen, you idiot", "I was an idiot, but you are a moron",
        "I am tired of morons like you", "You idiot, I was waiting", "You moron, test your code", "you are a\nloser", "# you are a\n# loser", "> you are such a\r\n> worthless\r\n> loser", '"""Parse.\n\n    you are a\n    loser\n    """',
        "- you are a\n  loser", "you are a mo-\nron", "you are useless\nfix it 'now'",
    ],
)
def test_insults_of_others_and_over_lines(text):
    assert A.score_text(text)[0] >= A.THRESHOLD


@pytest.mark.parametrize(
    "text",
    [
        "You are not an idiot or a moron", "I feel like an idiot and a moron", "I must have been a complete idiot", "He is not an idiot, he is new", "you don't have to be an idiot to miss this", "Nobody called you an idiot",
        "I am tired of being such an idiot", "I am, frankly, an idiot", "I feel like a\nmoron.", "# What an idiot\n# I was", "you are a\n\nloser-free zone", "- you\n- loser", "int you;\nloser = 2", "you = a\nloser = 1",
    ],
)
def test_taken_back(text):
    assert A.score_text(text)[0] < A.THRESHOLD


def test_rows(spark):
    rows = [(1, None, None, 0.0), (2, "", "A b", 0.0), (3, "  \n", "a-b", 0.0), (4, "Get lost, idiot", " A_B ", 0.0), (5, "x " * 200_000 + "you idiot", "a b", 0.0), (4, "Get lost, idiot", "a b", 0.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, score double")
    got = sorted((r["doc_id"], r["flagged"]) for r in A.score(df).collect())
    assert got == [(1, False), (2, False), (3, False), (4, True), (4, True), (5, True)]
    rate = {r["source"]: (r["n_docs"], r["n_flagged"]) for r in A.rates(df).collect()}
    assert rate == {None: (1, 0), "a_b": (5, 3)} and A.score(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/content_labels.parquet"), reason="no labelled rows")
def test_agreement_with_raters(spark):
    """On rows where at least two raters are of one mind. The labels were not used, but phrases of such texts were known."""
    d = "/root/testdata/sf0.01"
    votes = {}
    for doc, label in spark.read.parquet(f"{d}/content_labels.parquet").select("doc_id", "label").collect():
        votes.setdefault(doc, []).append(label != "ok")
    sure = {k: sum(v) > len(v) / 2 for k, v in votes.items() if len(v) >= 2 and sum(v) in (0, len(v))}
    got = {r["doc_id"]: r["flagged"] for r in A.score(spark.read.parquet(f"{d}/documents.parquet")).collect()}
    both = [(got[k], v) for k, v in sure.items() if k in got]
    assert len(both) > 10 and sum(a == b for a, b in both) / len(both) >= 0.95


def test_every_rule_needs_a_telling_word():
    """So a text without such words need not be read closely."""
    assert all(A._ACCEPTOR.needs(k, lambda label: label not in A._TELLING) for k in range(len(A.RULES)))


def test_sentences():
    import abuse_sentences

    bad = [(want, s) for want, s in abuse_sentences.sentences(abuse_sentences.KNOWN) if (A.score_text(s)[0] >= A.THRESHOLD) != want]
    assert not bad


def test_reported_speech_and_long_clauses():
    case = lambda t: A.score_text(t)[0] >= A.THRESHOLD
    assert not case("He said you are an idiot and I asked him to stop") and not case("My boss called me a moron")
    assert case("Whoever wrote this is a worthless halfwit") and case("He said it works, you idiot")
    one = A.score_text("you are an idiot")[0]
    assert A.score_text("x " * 1850 + "you are an idiot " + "x " * 1850)[0] == one  # counted once, also in a long clause
    assert case("you " + "x " * 3 + "idiot " + "y " * 100_000)


def test_transducers_against_backtracking():
    """The automaton accepts what a plain matcher does, on random clauses."""
    import random

    from corpusmill.llm.fst import Acceptor, Rewriter, _matches, parse

    rules = [parse(x) for x in ("a b? c", "^ (a|b){1,3} $", "x ~{0,2} y", "a .{0,} b $", "(a (b|c)*)+ d", "c+ <a b>")]
    acceptor, r = Acceptor(rules), random.Random(5)
    sym = lambda w: frozenset({w, "NEG"} if w == "n" else {w})
    for _ in range(3000):
        s = [frozenset({"^"}), *(sym(r.choice("abcdxyn")) for _ in range(r.randint(0, 7))), frozenset({"$"})]
        want = {k for k, rule in enumerate(rules) if any(next(_matches(rule, s, i, ()), None) for i in range(len(s)))}
        assert acceptor.scan(s) == want
    assert [sorted(x) for x in Rewriter(rules[5:])([sym("c"), sym("a"), sym("b"), sym("a")])][0] == ["c"]
