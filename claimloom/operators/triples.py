"""Subject, relation and object from a dependency parse.

A parse is an array of struct(i, text, lemma, pos, dep, head) as any parser's Arrow function can give it; `functions.text.triple` needs
none. All strategies but the last look at every parse; the last one serves where they found nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicons as lx

PARSE = "array<struct<i:int,text:string,lemma:string,pos:string,dep:string,head:int>>"
TRIPLES = "array<struct<subject:string,relation:string,relation_lemma:string,object:string>>"
_ACTION, _TRIVIAL = frozenset(lx.ACTION_WORDS), frozenset(lx.TRIVIAL_OBJECTS)
_SUBJECT, _PASSIVE, _OBJECT = {"nsubj"}, {"nsubjpass"}, {"dobj", "obj", "attr", "oprd"}


class Tree:
    """A parse with its children."""

    def __init__(self, tokens):
        self.t = {x["i"]: x for x in tokens}
        self.kids: dict[int, list[int]] = {i: [] for i in self.t}
        for i, x in self.t.items():
            if x["head"] != i and x["head"] in self.kids:
                self.kids[x["head"]].append(i)

    def of(self, i: int, deps: set[str]) -> list[int]:
        return [k for k in self.kids[i] if self.t[k]["dep"] in deps]

    def joined(self, i: int) -> list[int]:
        """A token and everything conjoined to it."""
        out = [i]
        for k in self.of(i, {"conj"}):
            out += self.joined(k)
        return out

    def span(self, i: int, without: set[int] = frozenset()) -> str:
        """The words below a token, in order, without punctuation and without what hangs on `without`."""
        got, todo = [], [i]
        while todo:
            k = todo.pop()
            got.append(k)
            todo += [c for c in self.kids[k] if c not in without]
        return " ".join(self.t[k]["text"] for k in sorted(got) if self.t[k]["pos"] != "PUNCT")

    def phrase(self, i: int, without: set[int] = frozenset()) -> str:
        """A noun with its modifiers, conjuncts left to themselves, and what hangs on `without`."""
        return self.span(i, set(self.of(i, {"conj", "cc", "relcl", "prep"})) | without)

    def relation(self, i: int) -> str:
        """A verb with its negation before it and its particle after it."""
        return " ".join([*(self.t[k]["text"] for k in self.of(i, {"neg"})), self.t[i]["text"], *(self.t[k]["text"] for k in self.of(i, {"prt"}))])


def _is_action(x) -> bool:
    return x["text"].lower() in _ACTION or x["lemma"].lower() in _ACTION


def _compound(t: Tree):
    """A chain of nouns that hides a verb: parted at its first action word."""
    for i, x in t.t.items():
        if x["dep"] != "ROOT":
            continue
        chain = sorted([*t.of(i, {"compound", "nsubj", "amod"}), i])
        chain = sorted({c for k in chain for c in (k, *t.of(k, {"compound"}))})
        at = next((k for k in chain if _is_action(t.t[k]) and t.t[k]["pos"] in ("NOUN", "PROPN", "ADJ") and k != chain[0] and k != chain[-1]), None)
        if at is not None:
            left = " ".join(t.t[k]["text"] for k in chain if k < at)
            right = " ".join(t.t[k]["text"] for k in chain if k > at)
            yield left, t.t[at]["text"], t.t[at]["lemma"], right
            for k in t.joined(i)[1:]:
                yield left, t.t[at]["text"], t.t[at]["lemma"], t.phrase(k)


def _objects(t: Tree, v: int):
    for o in t.of(v, _OBJECT):
        yield from t.joined(o)
    for p in t.of(v, {"prep"}):
        for o in t.of(p, {"pobj"}):
            yield from t.joined(o)
    for x in t.of(v, {"xcomp", "ccomp"}):
        yield from _objects(t, x)


def _verbs(t: Tree):
    """A verb with its subjects and objects, the agent of a passive as subject."""
    for v, x in t.t.items():
        if x["pos"] != "VERB":
            continue
        subjects = [k for s in t.of(v, _SUBJECT) for k in t.joined(s)]
        passive = [k for s in t.of(v, _PASSIVE) for k in t.joined(s)]
        agents = [k for a in t.of(v, {"agent"}) for o in t.of(a, {"pobj"}) for k in t.joined(o)]
        if not subjects and not passive and x["dep"] == "conj":
            subjects = [k for s in t.of(x["head"], _SUBJECT) for k in t.joined(s)]
        objects = list(_objects(t, v))
        for s, o in [*((s, o) for s in subjects for o in objects), *((a, o) for a in agents for o in passive), *((s, o) for s in passive for o in objects if not agents)]:
            yield t.phrase(s), t.relation(v), x["lemma"], t.phrase(o)


def _copula(t: Tree):
    """Is and are with what they say of their subject."""
    for v, x in t.t.items():
        if x["lemma"].lower() == "be" and x["pos"] in ("AUX", "VERB"):
            for s in (k for s in t.of(v, _SUBJECT) for k in t.joined(s)):
                for o in t.of(v, {"attr", "acomp"}):
                    yield t.phrase(s), t.relation(v), "be", t.span(o)


def _inverted(t: Tree):
    """An action word taken for the subject of its object."""
    for v, x in t.t.items():
        for a in t.of(v, _SUBJECT):
            if _is_action(t.t[a]) and t.t[a]["pos"] in ("NOUN", "PROPN"):
                before = " ".join(t.t[k]["text"] for k in sorted(t.of(a, {"compound", "amod"})))
                yield before, t.t[a]["text"], t.t[a]["lemma"], t.phrase(v, {a})


def _pairs(t: Tree):
    """The first two nouns, associated (E5)."""
    nouns = [i for i, x in sorted(t.t.items()) if x["pos"] in ("NOUN", "PROPN") and x["dep"] != "compound"]
    if len(nouns) >= 2:
        yield t.phrase(nouns[0]), "associated with", "associate", t.phrase(nouns[1])


def extract(tokens) -> list[tuple[str, str, str, str]]:
    """The triples of one parse; the first of equal ones, none with an empty, equal or trivial object."""
    t = Tree(tokens)
    found: dict[tuple[str, str, str], tuple[str, str, str, str]] = {}

    def take(rows):
        for s, r, lemma, o in rows:
            s, o = s.strip(), o.strip()
            if s and o and s.lower() != o.lower() and o.lower() not in _TRIVIAL:
                found.setdefault((s.lower(), lemma.lower(), o.lower()), (s, r.strip(), lemma.lower(), o))

    for way in (_compound, _verbs, _copula, _inverted):
        take(way(t))
    if not found:
        take(_pairs(t))
    return list(found.values())


def triples(parse: Column) -> Column:
    """The triples of each parse; null and empty parses have none."""

    @F.pandas_udf(TRIPLES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("subject", "relation", "relation_lemma", "object")
        for s in batches:
            yield pd.Series([[dict(zip(names, x, strict=True)) for x in extract(list(p))] if p is not None and len(p) else [] for p in s])

    return run(parse)


def parsed(text: Column, parser: Callable[[pd.Series], pd.Series]) -> Column:
    """`text` through a parser: a function from a series of texts to a series of lists of token dicts (D-hooks)."""
    return F.pandas_udf(lambda s: parser(s), PARSE)(text)
