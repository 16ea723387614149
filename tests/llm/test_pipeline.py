"""The pipeline against a plain version of each stage."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from skein.llm import near, packing, simhash
from tests.llm.test_operators import PASSAGE, ROWS, SCHEMA, brute_components, brute_dedup


@pytest.fixture(scope="module")
def docs(spark):
    more = [(20 + i, f"{w} of the plain text number {i} and words that differ {w * 3} from all others", "en", "abc"[i % 3], 1) for i, w in enumerate("alpha beta gamma delta epsilon zeta".split())]
    return spark.createDataFrame([*ROWS, *more, (40, "12345 !!", "en", "a", 8)], SCHEMA).cache()


def rows(df):
    return Counter((x.doc_id, x.text) for x in df.collect())


def test_stages(spark, docs, tmp_path):
    kept = P.language(spark, docs, "")
    assert kept.columns == docs.columns
    left = rows(kept)
    assert set(left) <= {(x[0], x[1]) for x in ROWS} | {(x.doc_id, x.text) for x in docs.collect()}
    assert not any(t is None or not any(c.isalpha() for c in t) for _, t in left)

    once = P.near_dedup(spark, docs, "")
    all_rows = [(x.doc_id, x.text) for x in docs.collect()]
    groups = {c for _, _, c in brute_components(all_rows)}
    got = Counter(x.doc_id for x in once.collect())
    assert got == Counter(groups) and once.columns == docs.columns

    cut = P.repeat_removal(spark, docs, "")
    want = Counter()
    for d, _, removed, _, b in brute_dedup(all_rows):
        text = b.decode("utf-8", "ignore")
        if text.split():
            want[d, text] += 1
    assert rows(cut) == want and cut.columns == docs.columns
    assert not any(PASSAGE[:300] in t for _, t in want)

    mixed = P.mix(spark, docs, "")
    assert mixed.columns == docs.columns and set(rows(mixed)) <= set(all_rows)
    before, after = rows(docs), rows(mixed)
    assert all(n <= 2 * before[k] for k, n in after.items())

    tok = packing.Pieces(packing.default_path())
    packed = P.pack(spark, docs, "").collect()
    assert sum(x.length for x in packed) == sum(len(tok.ids(t or "")) // 4 + 1 for _, t in all_rows)


def test_near_copies_of_empty_texts_are_one_group():
    assert simhash.fingerprint("") == simhash.fingerprint(" \n") == 0


def test_run(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() > 0
    docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert P.run(spark, str(tmp_path / "none")).count() == 0


def jaccard(x, y, n=5):
    x, y = ({tuple(t[i : i + n]) for i in range(max(1, len(t) - n + 1))} for t in (x, y))
    return len(x & y) / len(x | y)


def near_rows():
    """Texts of 100 to 300 words and copies with words changed; every pair of similarity 0.8 or more is to be linked, and no other."""
    rng, out = random.Random(3), []
    for g in range(60):
        text = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(100, 300))]
        for c in range(rng.randint(1, 4)):
            t = list(text)
            for _ in range(c * rng.randint(0, 3)):
                t[rng.randrange(len(t))] = f"x{rng.randint(0, 5000)}"
            out.append((10 * g + c, " ".join(t)))
    return out


def components_of(rows, linked):
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and linked(rows[i][1].split(), rows[j][1].split()):
                root = [root[j] if x == root[i] else x for x in root]
    return root


def test_near_copies_by_five_word_shingles(spark):
    rows = near_rows()
    root = components_of(rows, lambda x, y: jaccard(x, y) >= 0.8)
    want = {min(d for (d, _), r in zip(rows, root, strict=True) if r == k) for k in set(root)}
    assert len(want) < len(rows) - 40
    got = P.near_dedup(spark, spark.createDataFrame([(d, t, "en", "a", 1) for d, t in rows], SCHEMA), "")
    assert Counter(x.doc_id for x in got.collect()) == Counter(want)


def test_alike_finds_all_components_of_a_block():
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(200)]
    sets = []
    for _ in range(90):
        drop = rng.randint(0, 60)
        sets.append(np.unique(np.array(rng.sample(base, 200 - drop) + [rng.getrandbits(64) for _ in range(rng.randint(0, 40))], dtype=np.uint64)))
    similar = lambda x, y: 5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y))
    want, got = list(range(90)), list(range(90))
    for i in range(90):
        for j in range(i):
            if want[i] != want[j] and similar(sets[i], sets[j]):
                want = [want[j] if x == want[i] else x for x in want]
    links = near.alike(sets, list(range(90)))
    assert all(similar(sets[i], sets[j]) for i, j in links) and len(links) == 90 - len(set(want)) > 20
    for i, j in links:
        got = [got[j] if x == got[i] else x for x in got]
    assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))
    assert near.alike(sets, want) == []


def changed_copies(n, words, rng):
    """Texts, one at a time with words changed of one another and of a common text, so that links are few and go by chains."""
    base, out = [f"w{rng.randint(0, 5000)}" for _ in range(words)], []
    for i in range(n):
        t = list(out[-1][1].split() if i % 3 == 1 else base)
        for _ in range(rng.randint(1, 3) if i % 3 == 1 else rng.randint(words // 40, words // 20)):
            t[rng.randrange(words)] = f"x{rng.randint(0, 5000)}"
        out.append((i, " ".join(t)))
    return out


def test_no_link_is_lost_between_blocks_of_a_bucket(spark):
    rows = changed_copies(90, 120, random.Random(11))
    # All texts are in one bucket, by bands and by fingerprints of their own that no other has.
    marks = near.marked(spark.createDataFrame(rows, "row long, text string"))
    marks = marks.select(F.col(near.KEY).alias("key"), "row", F.col(near.COUNT).alias("n"), F.hash("row").cast("long").alias("fp"), F.array(F.lit(7).cast("long")).alias("bands")).cache()
    texts = spark.createDataFrame(rows, "row long, text string")
    ids = {x.key: x.row for x in marks.collect()}
    root = components_of(rows, lambda x, y: jaccard(x, y) >= 0.8)
    want = {frozenset(i for i, r in enumerate(root) if r == k) for k in set(root)}
    assert 10 < sum(len(w) > 1 for w in want)
    for block in (2, 9, 60, 90):
        got = {}
        for x in near.near_components(marks, texts, block).collect():
            got.setdefault(x.root, set()).add(ids[x.node])
        assert {frozenset(g) for g in got.values()} == {w for w in want if len(w) > 1}


@pytest.mark.parametrize("words", [1, 30, 3000])
def test_parities_leave_out_no_similar_pair(words):
    rng = np.random.default_rng(words)
    base = rng.integers(0, 1 << 63, words, dtype=np.uint64)
    sets = [np.unique(np.append(rng.choice(base, rng.integers(words // 2, words) or 1, replace=False), rng.integers(0, 1 << 63, rng.integers(0, words // 9 + 1), dtype=np.uint64))) for _ in range(100)]
    sets.sort(key=len)
    similar = {(i, j) for i in range(100) for j in range(i) if near.similar(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))}
    side = lambda part: near.Side([len(s) for s in part], [near.parities(s) for s in part])
    x, own = side(sets), np.arange(100)
    pairs = lambda found: {(int(i), int(j)) for a, b in found for i, j in zip(a, b, strict=True)}
    assert similar and similar <= pairs(near.close(x, x, own, True))
    even, odd = [*range(0, 100, 2)], [*range(1, 100, 2)]
    place = {k: i for i, k in enumerate(even + odd)}
    crossing = {(place[min(p, key=lambda k: k % 2)], place[max(p, key=lambda k: k % 2)]) for p in similar if (p[0] + p[1]) % 2}
    assert crossing <= pairs(near.close(side([sets[i] for i in even]), side([sets[i] for i in odd]), own, True))
    assert not pairs(near.close(x, x, own * 0, True)) and len(pairs(near.close(x, x, own, False))) < 100


def test_mix_takes_the_same_texts_whatever_repeats(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, 1, 2]), " ".join(f"w{rng.randint(0, 9)}" for _ in range(5)), "en", rng.choice(["a", None]), i) for i in range(120)]
    rows += rows[:30]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("size", "taken", "number", "copies", "row", "text_key", "k")})
    one, two = (Counter((x.doc_id, x.text, x.source, x.n_chars) for x in P.mix(spark, docs.repartition(n), "").collect()) for n in (1, 7))
    assert one == two and sum(one.values()) > 150
    assert P.mix(spark, docs, "").columns == docs.columns


CLASHING = ["row", "n_removed", "kept", "score", "lang_pred", "grams", "root", "key", "tid", "digest", "rows", "size", "number"]


@pytest.mark.parametrize("stage", P.STAGES[:-1], ids=lambda s: s[0])
def test_stages_pass_on_columns_of_any_name(spark, docs, stage):
    more = docs.withColumns({c: F.lit("own") for c in CLASHING})
    got = stage[1](spark, more, "").cache()
    assert got.count() and got.columns == more.columns and rows(got) == rows(stage[1](spark, docs, ""))
    assert got.where(" OR ".join(f"{c} <> 'own'" for c in CLASHING)).count() == 0
    assert stage[1](spark, more.limit(0), "").count() == 0


def test_only_texts_long_enough_are_judged_unlike(spark):
    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    rows = [(i, " ".join(word("abcdefgh" if i % 2 else "mnopqrst") for _ in range(80)), "en" if i % 2 else "fr", "a", 1) for i in range(80)]
    short = [(1000 + i, word("abcdefgh"), None, "a", 1) for i in range(200)]
    other = [(2000 + i, " ".join(word([chr(0x0E01 + k) for k in range(40)]) for _ in range(40)), None, "a", 1) for i in range(120)]
    got = {x.doc_id for x in P.language(spark, spark.createDataFrame(rows + short + other, SCHEMA), "").collect()}
    assert got == {x[0] for x in rows + short}


def test_each_component_keeps_one_row_where_ids_tie_or_are_null(spark):
    rng = random.Random(5)
    text = lambda: [f"w{rng.randint(0, 5000)}" for _ in range(150)]
    one, two, three = text(), text(), text()
    rows = [(1, one), (1, two), (None, three), (None, [*three[:-1], "changed"]), (None, ["changed", *three[1:]])]
    got = P.near_dedup(spark, spark.createDataFrame([(d, " ".join(t), "en", "a", 1) for d, t in rows], SCHEMA), "").collect()
    assert sorted(x.text for x in got if x.doc_id == 1) == sorted([" ".join(one), " ".join(two)])
    assert len(got) == 3
