"""Of the operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import common, components, langid, media, mixing, packing, qualnet, quality_rules, simhash, suffix, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
r = random.Random(7)
LONG = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(9000))
PASSAGE = " ".join("".join(r.choice("klmnop") for _ in range(6)) for _ in range(60))
ROWS = [
    (0, None, "en", "a", None),
    (1, "", None, None, 0),
    (2, "short one", "en", "b", 9),
    (2, "short one", "en", "b", 9),
    (3, LONG, "en", "a", len(LONG)),
    (4, LONG[:5000] + PASSAGE + LONG[20000:22000], "en", "a", 1),
    (5, PASSAGE + " é " + PASSAGE, "fr", "c", 1),
    (None, "no id here at all", None, "c", 1),
    (None, "no id here at all", None, "c", 1),
    (6, "\n\n \t", "en", "b", 1),
    (7, "x" * 700, "en", None, 700),
    (8, "a line of words\n" * 40, "de", "a", 1),
    (9, LONG[:5000] + PASSAGE + LONG[20000:22000], "en", "a", 1),
    (10, "A # heading $ with % symbols & more | of < them >", "en", "a", 1),
]
CLASH = ["score", "predicted", "lang_pred", "fp", "fingerprint", "component_id", "tid", "n_bytes", "kept", "size", "taken", "k", "h", "digest", "rows", "removed", "runs", "rest", "row", "none", "own", "root", "least", "_copies", "_n"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({c: F.lit("own") for c in CLASH})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def near(docs_):
    return simhash.near_duplicates(docs_)


def brute_components(rows):
    fps = [simhash.fingerprint(t or "") for _, t in rows]
    seen, out = {}, []
    for i in range(len(rows)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            j = todo.pop()
            for k in range(len(rows)):
                if k not in group and bin(fps[j] ^ fps[k]).count("1") <= 2:
                    group.add(k)
                    todo.append(k)
        for k in group:
            seen[k] = min((rows[x][0] for x in group if rows[x][0] is not None), default=None)
    for i, (d, _) in enumerate(rows):
        out.append((d, f"{fps[i]:016x}", seen[i]))
    return Counter(out)


def test_simhash(docs, clashing, none):
    want = brute_components([(x[0], x[1]) for x in ROWS])
    for d in (docs, clashing):
        assert Counter((x.doc_id, x.fingerprint, x.component_id) for x in near(d).collect()) == want
    assert near(none).count() == 0


@pytest.mark.parametrize("seed", [0, 3, 5])
def test_simhash_links_join_what_all_pairs_join(spark, seed):
    g = np.random.default_rng(seed)
    base = g.integers(0, 2**62, 6).astype(np.uint64)
    f = np.unique(base[g.integers(0, 6, 80)] ^ (np.uint64(1) << g.integers(0, 9, 80).astype(np.uint64)) ^ (np.uint64(1) << g.integers(0, 64, 80).astype(np.uint64)))
    links = simhash.links(spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long"), 2)
    place = {int(x): i for i, x in enumerate(f.view(np.int64))}
    p = list(range(len(f)))

    def find(i):
        while p[i] != i:
            i = p[i]
        return i

    def join(pairs):
        p[:] = range(len(f))
        for a, b in pairs:
            p[max(find(a), find(b))] = min(find(a), find(b))
        return [find(i) for i in range(len(f))]

    got = join([(place[x.a], place[x.b]) for x in links.collect()])
    assert got == join(np.argwhere(np.bitwise_count(f[:, None] ^ f[None, :]) <= 2).tolist())


def test_simhash_buckets_have_a_bound():
    """Fingerprints that agree on a choice differ in 16 bits at most."""
    masks, _ = simhash.keys(np.zeros(1, np.uint64), 2)
    assert len(masks) == 28 and set(np.bitwise_count(masks).tolist()) == {48}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (200, 201), (201, 200)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(20)}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_dedup(rows, least=200):
    raw = [(d, (t or "").encode()) for d, t in rows]
    c = Counter(b[i : i + least] for _, b in raw for i in range(len(b) - least + 1))
    out = []
    for d, b in raw:
        m = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if c[b[i : i + least]] > 1:
                m[i : i + least] = b"\1" * least
        runs = sum(1 for i in range(len(m)) if m[i] and not (i and m[i - 1]))
        kept = bytes(x for x, y in zip(b, m) if not y)
        out.append((d, len(b), sum(m), runs, kept))
    return out


@pytest.mark.parametrize("most", [1, 20_000])
def test_suffix(docs, clashing, none, most):
    want = Counter((d, n, k, s, hashlib.sha256(b).hexdigest()) for d, n, k, s, b in brute_dedup([(x[0], x[1]) for x in ROWS]))
    assert sum(k for _, _, k, _, _ in want) > 10_000
    for d in (docs, clashing):
        got = suffix.dedup(d, most=most)
        assert Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got.collect()) == want
    assert suffix.dedup(none).count() == 0


def test_suffix_keeps_bytes(docs):
    got = Counter((x.doc_id, bytes(x.kept)) for x in suffix.dedup(docs, keep_text=True).collect())
    assert got == Counter((d, b) for d, _, _, _, b in brute_dedup([(x[0], x[1]) for x in ROWS]))


def fresh():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_path())


def ids(tokenizer, text) -> bytes:
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_ids_are_the_tokenizers_own_also_with_added_tokens():
    tok, pieces, rng = fresh(), packing.Pieces(packing.default_path()), np.random.default_rng(8)
    added = [t.content for t in tok.get_added_tokens_decoder().values()]
    assert added
    parts = [*added, *[t[1:] for t in added], "a", "  ", "é", "日本", "\n\n", "don't", "123", "|", "<", "word"]
    for _ in range(300):
        text = "".join(rng.choice(parts, rng.integers(1, 9)))
        assert pieces.encode(text) == ids(tok, text), text


def test_pack(docs, clashing, none):
    tok = fresh()
    for d in (docs, clashing):
        pieces = packing.pack(d, window=64).collect()
        place = sorted((x.sequence_id, x.offset, x.length) for x in pieces)
        end = 0
        for s, o, n in place:
            assert s * 64 + o == end and n <= 64 - o
            end += n
        texts = defaultdict(list)
        for x in pieces:
            assert x.ids_crc32 == zlib.crc32(bytes(x.ids))
            texts[x.doc_id].append((x.start, bytes(x.ids), x.doc_tokens))
        want = Counter((i, ids(tok, t) + b"\0\0\0\0") for i, t, *_ in ROWS)
        assert end == sum(len(b) // 4 * n for (_, b), n in want.items())
        for (i, b), n in want.items():
            at = {s: ids for s, ids, _ in texts[i]}
            if n == 1 and i is not None:
                assert b"".join(at[s] for s in sorted(at)) == b
                assert {t for _, _, t in texts[i]} == {len(b) // 4}
    assert packing.pack(none).count() == 0


def test_media(docs, clashing, none):
    for form in ("wav", "png"):
        for d in (docs, clashing):
            got = media.describe(media.encode(d, form), carve=True).collect()
            assert len(got) == len(ROWS)
            want = Counter((i, *[f(media.payload(t or "")) for f in (lambda p: p[1], lambda p: len(p[0]), lambda p: hashlib.sha256(p[0]).hexdigest(), lambda p: zlib.crc32(p[0][-16:]))]) for i, t, *_ in ROWS)
            assert Counter((x.doc_id, x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) for x in got) == want
            assert all(x.corrected for x in got)
    assert media.describe(media.encode(none)).count() == 0


def test_mix(docs, clashing, none):
    for d in (docs, clashing):
        got = mixing.mix(d).collect()
        size = Counter()
        for _, t, _, s, _ in ROWS:
            size[s] += len((t or "").encode().split())
        total = sum(size.values())
        assert len(got) == len(ROWS) and sum({x.source: x.target for x in got}.values()) == pytest.approx(1.5 * total)
        for x in got:
            assert x.source_size == size[x.source] and x.taken in (0, x.size, 2 * x.size) and x.target <= 2 * x.source_size
        assert sum(x.taken for x in got) <= 1.5 * total
        key = lambda rows: Counter((x.doc_id, x.source, x.size, x.taken) for x in rows)
        assert key(got) == key(mixing.mix(d.repartition(5)).collect())
    assert mixing.mix(none).count() == 0


def test_mix_of_texts_without_words(spark):
    got = mixing.mix(spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")).collect()
    assert [(x.size, x.target, x.taken) for x in got] == [(0, 0.0, 0)] * 2


def test_targets_are_filled_like_water(spark):
    sizes = spark.createDataFrame([(False, "a", 10), (False, "b", 1000), (False, "c", 500), (True, "", 90)], "s_null boolean, s string, size long")
    got = {(x.s_null, x.s): (x.weight, x.target) for x in mixing.source_targets(sizes).collect()}
    level = (1.5 * 1600 - 20 - 180) / 3
    assert got == {(False, "a"): (3, 20.0), (False, "b"): (1, level), (False, "c"): (2, pytest.approx(1000)), (True, ""): (3, 180.0)} or sum(t for _, t in got.values()) == pytest.approx(2400)
    assert all(t <= 2 * s + 1e-9 for t, s in ((got[False, "a"][1], 10), (got[False, "c"][1], 500), (got[True, ""][1], 90)))


def test_quality(docs, clashing, none):
    for d in (docs, clashing):
        got = {x.doc_id: x for x in quality_rules.cascade(d).collect()}
        for i, t, *_ in ROWS:
            w = (t or "").split()
            n = Counter(zip(w, w[1:], w[2:]))
            again = {i + j for i, g in enumerate(zip(w, w[1:], w[2:])) if n[g] > 1 for j in range(3)}
            lines = [x for x in (t or "").split("\n") if x.strip()]
            x = got[i]
            assert (x.n_words, x.word_chars, x.n_repeat_words, x.n_dup_lines) == (len(w), sum(map(len, w)), len(again), len(lines) - len(set(lines))), i
            assert x.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (x.base_failed and x.kept)
        assert got[3].kept and got[10].n_symbols == 7
    assert quality_rules.cascade(none).count() == 0


def test_rules_are_ordered_by_what_they_reject_of_the_rest_per_cost():
    # Rule 0 rejects half at a cost of 1; rule 1 the same rows and a few more at 1.5; rule 2 a fifth of others at 0.3.
    verdicts = [(0b011, 50), (0b010, 5), (0b100, 20), (0, 25)]
    order = quality_rules.greedy([1.0, 1.5, 0.3], verdicts)
    assert [i for i, _ in order] == [2, 0, 1] and [round(s, 4) for _, s in order] == [0.2, 0.625, round(5 / 30, 4)]


def test_costs_tell_dear_rules_from_cheap_ones(docs):
    some = docs.where("doc_id = 3").select("doc_id", "text")
    cheap, dear = quality_rules.Rule("cheap", F.length("text") < 3), quality_rules.Rule("dear", quality_rules.count(F.col("text"), "[^a-c]+b") < 3)
    found = quality_rules.order_rules(some, [dear, cheap], F.lit(False))
    costs = {r.name: c for r, _, c in found}
    assert costs["dear"] > 20 * costs["cheap"]


def test_order_of_rules_does_not_change_the_verdict(docs):
    rules = quality_rules.rules()
    verdict = lambda rs: Counter((x.doc_id, x.kept) for x in quality_rules.cascade(docs, rs).collect())
    assert verdict(rules) == verdict(rules[::-1])


def test_classifiers(docs, clashing, none):
    net = qualnet.Net(filters=4)
    model = toxicity.fit([])
    space = langid.Space(dims=256)
    names, protos = langid.fit(langid.training_rows(docs), space)
    for d in (docs, clashing):
        for got in (qualnet.score(d, net).collect(), toxicity.score(d, model).collect()):
            assert len(got) == len(ROWS) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
        found = langid.identify(d, names, protos, space).collect()
        assert len(found) == len(ROWS) and all(0 <= x.score <= 1 for x in found)
        assert {x.doc_id: x.lang_pred for x in found}[0] == "und" and {x.doc_id: x.lang_pred for x in found}[6] == "und"
    for got in (qualnet.score(none, net), toxicity.score(none, model), langid.identify(none, [], protos, space)):
        assert got.count() == 0


def test_samples_leave_held_out_rows_alone(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(11)] + [(None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = common.labelled_sample(docs, labels, "quality", 100, 4, 2)
    held = {i for i in range(11) if zlib.crc32(str(i).encode()) % 4 == 2}
    ids = {t or "": i for i, t, *_ in ROWS}
    assert got and not {ids[t] for t, _ in got} & held
    assert common.labelled_sample(docs, labels.limit(0), "quality", 100, 4, 2) == []


def test_warc(spark):
    rows = [(1, "http://b.x/1", "same"), (2, "http://a.x/2", "same"), (3, None, None), (4, "http://a.x/2", ""), (None, "http://n/", "same"), (5, "http://a.x/\r\n5", "x\r\n\r\nWARC/1.1\r\n\r\ny"), (5, "http://a.x/5", "x\r\n\r\nWARC/1.1\r\n\r\ny"), (6, "u", "é" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("own"))
    last = {}
    for p, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if p is None else p)
    want = Counter()
    for p, _, h in rows:
        b = (h or "").encode()
        again = p is not None and last[h or ""] != p
        want[p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", last[h or ""] if again else None] += 1
    for compression in ("gzip", "none"):
        got = warc.archive(pages, compression=compression).collect()
        assert Counter((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in got) == want
        keys = [(x.url_key, x.ts) for x in got]
        assert keys == sorted(keys)
    assert warc.archive(pages.limit(0)).count() == 0
    assert warc.url_key("http://www.Ex.com/A/?q=1") == "com,ex)/a?q=1"


def test_captures_can_be_fetched_and_histories_go_on_over_ranges(spark, tmp_path):
    r = random.Random(10)
    rows = [(i, f"http://h{i % 3}/", "".join(r.choice("abc\r\n") for _ in range(r.randint(0, 400)))) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    path = f"file://{tmp_path}/archives"
    warc.write(pages, path, per_file=9)
    index = warc.runs(spark, path)
    whole = warc.merged(index).collect()
    parts = warc.merged(index, per_range=7).collect()
    entry = lambda x: (x.url_key, x.ts, x.page_id, x.previous)
    assert len({x.file for x in whole}) > 4 and [entry(x) for x in whole] == [entry(x) for x in parts]
    last = {}
    for x in whole:
        assert x.previous == last.get(x.url_key)
        last[x.url_key] = x.ts
        with open(x.file.removeprefix("file:"), "rb") as f:
            f.seek(x.offset)
            fields, block = warc.fetch(f.read(x.length))
        assert fields["warc-record-id"] == f"<urn:page:{x.page_id}>" and fields["warc-date"] == x.ts
        if x.record_type == "response":
            assert block.endswith(b"\r\n\r\n" + rows[x.page_id][2].encode())


def test_records_of_any_length_end_in_a_zero_byte():
    for n in (0, 1, (1 << 24) - 1, 1 << 24, (1 << 25) + 5):
        m = warc.members(b"a" * n)
        assert n == 0 or m[-1] == 0
        assert b"".join(d for _, _, d in warc._plain(m)) == b"a" * n if n else m == b""
