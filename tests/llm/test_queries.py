"""The queries of learned operators on tables of their own: held-out accuracy, and that held-out labels are never used."""

import random
import zlib

import numpy as np
import pytest

from skein.llm import queries as Q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LETTERS = {"en": "abcdefgh", "fr": "ghijklmn", "de": "mnopqrst"}


def crc(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


def table(seed=1, n=360):
    """(doc_id, text, lang, toxic, quality): toxic texts call someone names, bad ones are shouted without order."""
    r, out = random.Random(seed), []
    for i in range(n):
        lang = r.choice(sorted(LETTERS))
        words = ["".join(r.choice(LETTERS[lang]) for _ in range(r.randint(2, 8))) for _ in range(60)]
        toxic, quality = int(r.random() < 0.4), int(r.random() < 0.5)
        if toxic:
            at = r.randrange(50)
            words[at:at] = ["you", r.choice(["idiot", "moron", "scum"])]
        if not quality:
            words = [w.upper() + "#$%" for w in words]
        out.append((i, " ".join(words), lang, toxic, quality))
    return out


@pytest.fixture(scope="module")
def write(spark, tmp_path_factory):
    def run(rows, name):
        path = tmp_path_factory.mktemp(name)
        spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang, *_ in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(i, q, x) for i, _, _, x, q in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        return str(path)

    return run


def auc(score, label):
    good, bad = ([s for s, y in zip(score, label, strict=True) if y == k] for k in (1, 0))
    return np.mean([(a > b) + (a == b) / 2 for a in good for b in bad])


@pytest.mark.parametrize(("query", "column", "modulus", "held"), [("op1_toxicity", 3, 4, 2), ("op9_quality", 4, 5, 0)])
def test_classifiers_are_right_on_held_out_rows_and_learn_from_no_other(spark, write, query, column, modulus, held):
    rows = table()
    out = [i for i, *_ in rows if crc(i, modulus) == held]
    got = {x.doc_id: x for x in Q.QUERIES[query](spark, write(rows, query)).collect()}
    assert set(got) == {i for i, *_ in rows} and {i for i, x in got.items() if x.held_out} == set(out)
    assert auc([got[i].score for i in out], [rows[i][column] for i in out]) > 0.95
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got.values())
    # Other labels of the held-out rows change no score.
    flipped = [tuple(1 - v if k == column and row[0] in out else v for k, v in enumerate(row)) for row in rows]
    again = {x.doc_id: x.score for x in Q.QUERIES[query](spark, write(flipped, "flipped")).collect()}
    assert again == {i: x.score for i, x in got.items()}


def test_languages_are_right_on_held_out_rows_and_learned_from_no_other(spark, write):
    # One language is rare.
    rows = [(*row[:2], row[2] if row[2] != "de" or row[0] < 90 else "en", *row[3:]) for row in table(2) if row[2] != "de" or row[0] < 90]
    out = {i for i, *_ in rows if crc(i, 4) == 2}
    got = {x.doc_id: x for x in Q.op8_language(spark, write(rows, "lang")).collect()}
    assert {i for i, x in got.items() if x.held_out} == out
    assert all(got[i].lang_pred == lang for i, _, lang, *_ in rows if i in out)
    other = [(i, t, "xx" if i in out else lang, *x) for i, t, lang, *x in rows]
    again = {x.doc_id: (x.lang_pred, x.score) for x in Q.op8_language(spark, write(other, "other")).collect()}
    assert again == {i: (x.lang_pred, x.score) for i, x in got.items()}


def test_archive_query_equals_its_sql(spark, tmp_path):
    import duckdb

    rows = [(1, "u", "same é"), (2, "u", "same é"), (3, "v", None), (4, "w", ""), (5, "x", "one")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = Q.op6_warc(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({Q.OP6_SQL})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
