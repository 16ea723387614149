import math
from collections import Counter
from random import Random

import pytest

from skein.functions.stem import stem_word, with_stem
from skein.operators import index as I
from skein.operators import rank as R
from skein.plans.search import is_boolean, search

#: Words that are their own stems, drawn with falling frequency; document 7 is empty and 8 is null.
VOCABULARY = [f"z{i}q" for i in range(30)]


def corpus(seed: int = 3) -> dict[int, list[str]]:
    r = Random(seed)
    return {d: [VOCABULARY[min(int(r.expovariate(0.2)), 29)] for _ in range(r.randrange(1, 40))] for d in range(7)} | {7: [], 8: []}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    texts = corpus()
    docs = spark.createDataFrame([(d, " ".join(w) if d < 8 else None) for d, w in texts.items()], "doc_id long, text string")
    return texts, docs, I.Index.build(docs, str(tmp_path_factory.mktemp("index") / "own"))


def by_hand(texts):
    tf = {(t, d): n for d, w in texts.items() for t, n in Counter(w).items()}
    df = Counter(t for t, _ in tf)
    weight = {(t, d): n + math.log10(len(texts) / df[t]) for (t, d), n in tf.items()}
    length = {d: math.sqrt(sum(weight[t, d] ** 2 for t in w)) for d, w in texts.items()}
    return tf, df, weight, length


def test_stems_of_the_published_examples(spark):
    want = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "rational": "ration", "hopefulness": "hope", "electrical": "electr", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll", "sized": "size", "it": "it", "été": "été"}
    assert {w: stem_word(w) for w in want} == want
    got = with_stem(spark.createDataFrame([(w,) for w in want], "word string")).collect()
    assert {r.word: r.term for r in got} == want


def test_stored_index_equals_the_formulas(made):
    texts, _, index = made
    tf, df, weight, length = by_hand(texts)
    assert {(r.term, r.doc_id): r.tf for r in index.postings.collect()} == tf
    terms = index.postings.select("term").distinct()
    got = {(r.term, r.doc_id): (r.df, r.weight) for r in index.weights(terms).collect()}
    assert set(got) == set(weight) and all(got[k][0] == df[k[0]] and math.isclose(got[k][1], weight[k]) for k in got)
    assert {r.doc_id: round(r.length, 9) for r in index.lengths.collect()} == {d: round(x, 9) for d, x in length.items()}


def test_champions_break_ties_by_id(spark):
    docs = spark.createDataFrame([(d, "pear " * n) for d, n in ((9, 1), (4, 3), (6, 1), (2, 1))], "doc_id long, text string")
    w = I.tf_idf(I.postings(docs), I.corpus_size(docs))
    assert [(r.doc_id, r.rank) for r in I.champions(w, 3).orderBy("rank").collect()] == [(4, 1), (2, 2), (6, 3)]


def test_search_ranks_as_the_formula_does(made, spark):
    texts, _, index = made
    _, _, weight, length = by_hand(texts)
    asked = VOCABULARY[1:4]
    scores = {d: sum(weight.get((t, d), 0) for t in asked) / length[d] for d in texts if any((t, d) in weight for t in asked)}
    urls = spark.createDataFrame([(d, f"http://h/{d}") for d in texts], "doc_id long, url string")
    got = search(index, " ".join(asked), urls).collect()
    assert {r.doc_id: round(r.score, 9) for r in got} == {d: round(s, 9) for d, s in scores.items()}
    assert all(r.url == f"http://h/{r.doc_id}" for r in got)
    best = search(index, " ".join(asked), n=2).collect()
    assert [r.doc_id for r in best] == sorted(scores, key=lambda d: (-scores[d], d))[:2]


def test_search_takes_boolean_queries(made):
    texts, _, index = made
    a, b = VOCABULARY[0], VOCABULARY[2]
    assert is_boolean(f"{a} AND {b}") and not is_boolean(f"{a} {b}")
    assert {r.doc_id for r in search(index, f"{a} AND NOT {b}").collect()} == {d for d, w in texts.items() if a in w and b not in w}


def test_simple_rank_covers_every_document(made):
    texts, docs, index = made
    tf, df, _, _ = by_hand(texts)
    t = VOCABULARY[1]
    terms = I.query_terms(docs.sparkSession, t)
    got = {r.doc_id: r.score for r in R.rank_simple(I.log_tf(index.postings), I.idf(index.postings, index.size), docs, terms).collect()}
    idf = math.log10(len(texts) / df[t])
    assert set(got) == set(texts)
    assert all(math.isclose(s, (1 + math.log10(tf[t, d]) if (t, d) in tf else 0) - idf) for d, s in got.items())


def test_url_vocabulary_is_dense_and_ordered(spark):
    urls = spark.createDataFrame([(u,) for u in ("b", "a", "c", "a", None)], "url string")
    assert [(r.doc_id, r.url) for r in I.url_vocabulary(urls).orderBy("doc_id").collect()] == [(0, "a"), (1, "b"), (2, "c")]


def test_postings_of_repeated_ids_are_added(spark):
    docs = spark.createDataFrame([(1, "Pear pears don't"), (1, "pear plum"), (2, "plum"), (None, "fig"), (None, "figs fig"), (3, None)], "doc_id long, text string")
    want = {("pear", 1): 3, ("dont", 1): 1, ("plum", 1): 1, ("plum", 2): 1, ("fig", None): 3}
    assert {(r.term, r.doc_id): r.tf for r in I.postings(docs).collect()} == want
    assert {r.term: r.df for r in I.block_frequency(I.blocks(docs)).collect()} == {"pear": 1, "dont": 1, "plum": 2, "fig": 1}


def test_postings_deal_no_words(made):
    _, docs, _ = made
    assert "Exchange" not in I.postings(docs)._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_any_size_and_frequency_weigh_alike(made, spark, monkeypatch):
    texts, docs, _ = made
    _, df, weight, length = by_hand(texts)
    for frequent in (1, 20, 10**6):
        monkeypatch.setattr(I, "FREQUENT", frequent)
        got = I.block_weights(I.blocks(docs), I.corpus_size(docs))
        assert {(r.term, r.doc_id): (r.df, round(r.weight, 9)) for r in got.collect()} == {k: (df[k[0]], round(w, 9)) for k, w in weight.items()}
        assert {r.doc_id: round(r.length, 9) for r in I.doc_length(got, docs).collect()} == {d: round(x, 9) for d, x in length.items()}
    import pyarrow as pa

    monkeypatch.setattr(I, "AT_ONCE", 1)
    monkeypatch.setattr(I, "KNOWN", 2)
    rows = pa.RecordBatch.from_arrays([pa.array([*texts]), pa.array([" ".join(w) for w in texts.values()])], ["doc_id", "text"])
    small = [(b["term"], d, n) for made in I._inverted(iter([rows])) for b in made.to_pylist() for d, n in zip(b["ids"], b["tfs"])]
    assert {(t, d): n for t, d, n in small} == by_hand(texts)[0] and len(small) == len(weight)


def test_a_query_prunes_the_index(made, spark):
    _, _, index = made
    plan = index.weights(I.query_terms(spark, VOCABULARY[1]))._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(term,{VOCABULARY[1]})" in plan


def test_stems_of_made_words_are_alike_in_python(spark):
    r, ends = Random(5), ["", "s", "ies", "sses", "eed", "ed", "ing", "y", "e", "ll", "sion", "ion", "ization", "iveness", "icate", "ement", "yed", "tting"]
    words = ["".join(r.choice("aeioubcdlmrsty") for _ in range(r.randrange(5))) + r.choice(ends) + r.choice(["", "s", "ed", "e"]) for _ in range(1500)]
    got = with_stem(spark.createDataFrame([(w,) for w in set(words)], "word string")).collect()
    assert all(x.term == stem_word(x.word) for x in got)
