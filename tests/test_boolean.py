from itertools import product
from random import Random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from skein.operators import index as I
from skein.plans import boolean_query as B

WORDS = ("xa", "xb", "xc")
#: One document for each subset of the words, the empty one included.
SUBSETS = [tuple(w for w, on in zip(WORDS, bits, strict=True) if on) for bits in product((0, 1), repeat=3)]


@pytest.fixture(scope="module")
def find(spark):
    docs = spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate(SUBSETS)], "doc_id long, text string")
    post = I.postings(docs).cache()
    return lambda q: {r.doc_id for r in B.matches(q, post, docs).collect()}


def holds(node, words) -> bool:
    match node:
        case B.Term(t):
            return t in words
        case B.Not(a):
            return not holds(a, words)
        case B.Both(a, b):
            return holds(a, words) and holds(b, words)
        case B.Either(a, b):
            return holds(a, words) or holds(b, words)


def where(f) -> set[int]:
    return {i for i, s in enumerate(SUBSETS) if f(*(w in s for w in WORDS))}


def render(n):
    match n:
        case B.Term(t):
            return t
        case B.Not(a):
            return f"(NOT {render(a)})" if isinstance(a, B.Term) else f"(NOT ({render(a)}))"
        case B.Both(a, b):
            return f"(({render(a)}) AND ({render(b)}))"
        case B.Either(a, b):
            return f"(({render(a)}) OR ({render(b)}))"


def tree(r: Random, depth: int):
    kind = r.randrange(4) if depth else 0
    if not kind:
        return B.Term(r.choice(WORDS))
    return B.Not(tree(r, depth - 1)) if kind == 1 else (B.Both if kind == 2 else B.Either)(tree(r, depth - 1), tree(r, depth - 1))


@pytest.mark.parametrize("seed", range(8))
def test_truth_tables_of_random_trees(find, seed):
    t = tree(Random(seed), 3)
    assert find(render(t)) == {i for i, s in enumerate(SUBSETS) if holds(t, s)}


def test_operators_bind_from_the_left_and_not_takes_the_rest(find):
    assert find("xa OR xb AND xc") == where(lambda a, b, c: (a or b) and c)
    assert find("xa AND xb OR xc") == where(lambda a, b, c: (a and b) or c)
    assert find("xa AND NOT xb OR xc") == where(lambda a, b, c: a and ((not b) or c))
    assert find("NOT xa AND xb") == where(lambda a, b, c: (not a) and b)


def test_what_matches_nothing(find):
    for q in ("the", "(the)", "xa xb", "xz", ""):
        assert find(q) == set()
    assert find("NOT the") == set(range(len(SUBSETS)))


@pytest.mark.parametrize("query", ["a AND", "AND a", "(a", "a)", "()", "NOT", "OR"])
def test_malformed(query):
    with pytest.raises(ValueError):
        B.parse(query)


def test_keywords_are_whole_words():
    assert B.parse("NOTHING") == B.Term("noth")


trees = st.recursive(st.sampled_from(WORDS).map(B.Term), lambda t: st.builds(B.Not, t) | st.builds(B.Both, t, t) | st.builds(B.Either, t, t), max_leaves=8)


@given(trees)
def test_parse_gives_back_what_was_rendered(tree):
    assert B.parse(render(tree)) == tree
