"""Boolean queries: lexer, parser to a tree, and planner to one pass over the postings.

    expr := [NOT] factor { (AND | OR) operand }     operators have no precedence and bind from the left
    factor, operand := words | ( expr ) | expr

A NOT before an expression's first factor binds to that factor; after AND or OR it begins a new expression, which
takes the rest. Keywords are upper case and whole words. Stop words match nothing; words that stand together are one
operand, which matches a term of that spelling only. Anything malformed is a ValueError; an empty query matches
nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stem import stem_word
from ..functions.text import STOPWORDS, SYMBOLS

_SPLIT = re.compile(r"(\bAND\b|\bOR\b|\bNOT\b|\(|\))")
_KEYWORDS = {"AND", "OR", "NOT", "(", ")"}


@dataclass(frozen=True)
class Term:
    text: str | None  # None: a stop word


@dataclass(frozen=True)
class Not:
    of: Node


@dataclass(frozen=True)
class Both:
    left: Node
    right: Node


@dataclass(frozen=True)
class Either:
    left: Node
    right: Node


Node = Term | Not | Both | Either


def lex(query: str) -> list[str]:
    return [t.strip() for t in _SPLIT.split(query) if t.strip()]


def operand(text: str) -> Term:
    words = text.lower().replace("'", "").split()
    if len(words) == 1 and words[0] in {*STOPWORDS, *SYMBOLS}:
        return Term(None)
    return Term(" ".join(stem_word(w) for w in words))


class _Parser:
    def __init__(self, tokens: list[str]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def expr(self) -> Node:
        negate = self.peek() == "NOT"
        self.at += negate
        node = self.factor()
        node = Not(node) if negate else node
        while self.peek() in ("AND", "OR"):
            join = Both if self.peek() == "AND" else Either
            self.at += 1
            node = join(node, self.factor())
        return node

    def factor(self) -> Node:
        t = self.peek()
        if t is None or t in ("AND", "OR", ")"):
            raise ValueError(f"an operand was expected, not {t or 'the end'}")
        if t == "NOT":
            return self.expr()
        self.at += 1
        if t != "(":
            return operand(t)
        node = self.expr()
        if self.peek() != ")":
            raise ValueError("a closing parenthesis was expected")
        self.at += 1
        return node


def parse(query: str) -> Node | None:
    tokens = lex(query)
    if not tokens:
        return None
    p = _Parser(tokens)
    node = p.expr()
    if p.peek() == ")":
        raise ValueError("a closing parenthesis too many")
    return node


def terms(node: Node | None) -> list[str]:
    """Distinct search terms, in order of appearance."""
    match node:
        case Term(text):
            return [text] if text else []
        case Not(of):
            return terms(of)
        case Both(a, b) | Either(a, b):
            return list(dict.fromkeys(terms(a) + terms(b)))
    return []


def predicate(node: Node, found: Column) -> Column:
    """The query as a condition on the array of query terms that a document has."""
    match node:
        case Term(text):
            return F.array_contains(found, text) if text else F.lit(False)
        case Not(of):
            return ~predicate(of, found)
        case Both(a, b):
            return predicate(a, found) & predicate(b, found)
        case Either(a, b):
            return predicate(a, found) | predicate(b, found)
    raise TypeError(node)


def matches(query: str, post: DataFrame, universe: DataFrame) -> DataFrame:
    """(doc_id) of matching documents: postings of the query's terms are grouped once, whatever the query's form."""
    node = parse(query)
    if node is None:
        return universe.select("doc_id").limit(0)
    found = post.where(F.col("term").isin(terms(node))).groupBy("doc_id").agg(F.collect_set("term").alias("found"))
    rows = universe.select("doc_id").distinct().join(found, "doc_id", "left")
    return rows.where(predicate(node, F.coalesce("found", F.array().cast("array<string>")))).select("doc_id")
