"""Of the operators' cores, without Spark."""

import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import langid, media, packing, qualnet, simhash, suffix, toxicity, warc


def together(n, edges):
    p = list(range(n))

    def find(i):
        while p[i] != i:
            i = p[i]
        return i

    for a, b in edges:
        p[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("r", [0, 1, 2, 3])
def test_gray_index_links_what_brute_force_links(r):
    g = np.random.default_rng(r)
    for _ in range(60):
        f = np.unique(g.integers(0, 2**10, int(g.integers(2, 80))).astype(np.uint64))
        near = np.bitwise_count(f[:, None] ^ f[None, :]) <= r
        if len(f) > 1:
            q, other = simhash.GrayIndex(f).within(f, r)
            assert set(zip(q.tolist(), other.tolist())) == set(map(tuple, np.argwhere(near).tolist()))
            assert together(len(f), simhash.forest(f, r)) == together(len(f), np.argwhere(near).tolist())


def test_fingerprint_is_the_majority_of_hashes():
    import xxhash

    for text in ("", " \n", "A", "A b", "a b c", "The cat sat on the mat the cat sat", "é É x y z"):
        w = text.encode().lower().split()
        hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_cover(strings, least):
    c = Counter(s[i : i + least] for s in strings for i in range(len(s) - least + 1))
    out = []
    for s in strings:
        m = [False] * len(s)
        for i in range(len(s) - least + 1):
            if c[s[i : i + least]] > 1:
                m[i : i + least] = [True] * least
        out.append(m)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", max_size=24).map(str.encode), min_size=1, max_size=6, unique=True), st.integers(1, 6))
def test_maximal_repeats_cover_what_repeats(strings, least):
    groups = suffix.maximal_repeats(strings, None, least)
    cover = [[False] * len(s) for s in strings]
    for _, _, n, places in groups:
        for i, o in places:
            cover[i][o : o + n] = [True] * n
    assert cover == brute_cover(strings, least)


def test_groups_are_maximal_and_have_all_occurrences():
    strings = [b"xabcdey", b"zabcdew", b"qabcr"]
    groups = {g: (p, n, sorted(at)) for g, p, n, at in suffix.maximal_repeats(strings, None, 3)}
    own = {n: (g, at, p) for g, (p, n, at) in groups.items()}
    assert own[5][1] == [(0, 1), (1, 1)] and own[3][1] == [(2, 1)]
    assert own[5][2] == own[3][0]


def test_cells_hold_every_window_once_and_equal_windows_alike():
    r = random.Random(1)
    base = bytes(r.choice(b"abcdefgh") for _ in range(900))
    data = [base + b"x" * 700, b"tail" + base[300:800] + bytes(r.choice(b"uvw") for _ in range(500)), b"q" * 250, b"short"]
    owner = {}
    for d in data:
        start, n, h = suffix.cells(d)
        assert sum(n) == max(0, len(d) - 199)
        for s, k, a in zip(start.tolist(), n.tolist(), h.tolist()):
            for i in range(s, s + k):
                assert owner.setdefault(d[i : i + 200], a) == a


def test_pieces_equal_the_tokenizer():
    p = packing.Pieces(packing.default_path())
    r = random.Random(2)
    letters = "ab Zé1²½ªº'sd\n\t\x0b\x0c\r\x85\xa0 .,!?“—… \x1c\x00ſß中😀 's 're ’"
    assert p.merge is not None
    for _ in range(3000):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 14)))
        assert p.encode(t) == p.ids(t), repr(t)


def test_loser_tree_merges():
    r = random.Random(3)
    for _ in range(200):
        runs = [sorted(r.randint(0, 20) for _ in range(r.randint(0, 6))) for _ in range(r.randint(0, 7))]
        assert list(warc.LoserTree(runs)) == sorted(x for y in runs for x in y)


@pytest.mark.parametrize("form", ["wav", "png"])
@given(data=st.binary(max_size=600))
@settings(max_examples=40, deadline=None)
def test_media_round_trip(form, data):
    body = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
    stored = media.WRITE[form](body)
    seen = media.Sniffer().sniff(stored, "text/plain")
    assert (seen["format"], seen["length"], seen["corrected"]) == (form, len(stored), True)
    assert media.READ[form](stored) == body


def test_an_updated_pdf_ends_at_its_last_end():
    one = b"%PDF-1.7\nstartxref\n9\n%%EOF"
    data = b"head" + one + b"\nstartxref\n20\n%%EOF" + b"between" + one + b"tail"
    found = [(at, n) for at, n, f in media.Sniffer().find(data) if f.name == "pdf"]
    assert found == [(4, len(one) + len(b"\nstartxref\n20\n%%EOF")), (data.rindex(one), len(one))]


def test_sniffing_wants_structure_and_carves():
    png, wav = media.to_png(bytes(range(192))), media.to_wav(b"12345")
    found = media.Sniffer().find(b"BM RIFF GIF89a %PDF- " + png + b"junk" + wav + b"\xff\xd8\xff")
    assert [(n, f.name) for _, n, f in found] == [(len(png), "png"), (len(wav), "wav")]
    assert media.Sniffer().sniff(b"RIFFxxxxWAVE")["format"] is None
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"
    z = zlib.compressobj(wbits=31)
    gz = z.compress(b"hello") + z.flush()
    assert [(a, n, f.name) for a, n, f in media.Sniffer().find(gif + gz)] == [(0, len(gif), "gif"), (len(gif), len(gz), "gzip")]
    broken = bytearray(png)
    broken[20] ^= 1
    assert media.Sniffer().sniff(bytes(broken))["format"] is None


def test_grammar_scores_clauses_and_not_words():
    s = toxicity.Scorer(toxicity.Model(*toxicity.learn_lexicon([])))
    kinds = lambda t: {k for k, v in zip(toxicity.KINDS, s.features(t)) if v}
    assert kinds("you are an idiot") == {"aimed_insult"}
    assert kinds("what an idiot. you there") == {"insult"}
    assert kinds("you are not an idiot") == {"negated_insult"}
    assert kinds("the paper quoted idiot") == {"reported_insult"}
    assert kinds("idiot, you") == {"insult", "aims"}
    # A quotation opens and closes, over clauses but not over lines; „ and « open only.
    assert kinds('"hello" idiot') == {"insult"} and kinds('"hello idiot') == {"reported_insult"}
    assert kinds('„so. idiot“ moron') == {"reported_insult", "insult"} and kinds('«idiot»') == {"reported_insult"}
    assert kinds('"hello\nidiot') == {"insult"} and kinds("he said so. idiot") == {"insult"}
    assert kinds("I will kill you") == {"threat", "aims"}
    assert s.score("you are an idiot") > s.score("she said idiot") > s.score("nothing at all") - 1e-9


def test_weights_are_added_along_the_path():
    from math import exp, isclose

    m, state, weights = toxicity.grammar(), None, []
    state = m.start
    for symbol in ("target", "insult", "insult", "end", "negation", "insult"):
        state, out, w = m.step(state, symbol)
        weights.append((out, exp(w)))
    assert [o for o, _ in weights] == ["target", "aimed_insult", "more_insult", "end", "negation", "negated_insult"]
    for (_, got), want in zip(weights, (1, toxicity.AIMED, toxicity.AGAIN, 1, 1, toxicity.NEGATED), strict=True):
        assert isclose(got, want)


def test_the_grammar_beats_isolated_words():
    r = random.Random(11)
    plain = lambda: " ".join("".join(r.choice("abcdefg") for _ in range(5)) for _ in range(r.randint(3, 12)))
    toxic = ["you are an {}", "you {}", "what an {}", "those {} again"]
    clean = ["you are not an {}", "the paper said {}", 'a title, "{} of the year", was read', "she told me {}", "never a {}"]
    rows = [(f"{plain()}. {r.choice(toxic if y else clean).format(r.choice(toxicity.LISTED['insult']))}. {plain()}", y) for y in (0, 1) for _ in range(300)]
    train, held = rows[::2], rows[1::2]

    def right(machine):
        scorer = toxicity.Scorer(toxicity.fit(train, 0.5, machine=machine), machine=machine)
        return np.mean([(scorer.score(t) >= 0.5) == y for t, y in held])

    assert right(None) > 0.95 and right(toxicity.words_alone()) < 0.8


def test_context_of_hits_is_learned_and_listed_words_keep_their_class():
    r = random.Random(12)
    plain = lambda: " ".join("".join(r.choice("abcdefg") for _ in range(5)) for _ in range(8))
    rows = [(f"{plain()}. {'zuvu, thou' if y else 'hark quoth'} idiot. {plain()}. {plain()}", y) for y in (0, 1) for _ in range(300)]
    words, _ = toxicity.learn_lexicon(rows)
    assert words["quoth"][0] == words["hark"][0] == "report" and words["not"][0] == "negation" and words["you"][0] == "target"
    assert all(words[w][0] in ("insult", "target") for w in ("zuvu", "thou"))


def test_toxicity_learns_beginnings_of_words():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(5))
    rows = [(" ".join(word() for _ in range(30)) + (f" zork{word()}" if i % 2 else ""), i % 2) for i in range(300)]
    m = toxicity.fit(rows, 0.5)
    s = toxicity.Scorer(m)
    assert s.score("aaaaa zorkyes") > 0.5 > s.score("aaaaa bbbbb") and s.score("") < 0.5


def test_language_profiles():
    space = langid.Space(dims=512)
    r = random.Random(5)
    make = lambda letters: " ".join("".join(r.choice(letters) for _ in range(6)) for _ in range(40))
    names, protos = langid.fit([(make("abcde"), "one") for _ in range(10)] + [(make("vwxyz"), "two") for _ in range(10)], space)
    assert names == ["one", "two"]
    for letters, name in (("abcde", 0), ("vwxyz", 1)):
        assert int(np.argmax(protos @ langid.unit(space.profile(*space.grams(make(letters)))))) == name
    assert len(space.grams("123 !?")[0]) == 0 and len(space.grams("a")[0])
    t = langid.Table(space, most=64)
    codes, counts = space.grams(make("abcdefgh"))
    assert np.allclose(t.profile(codes[:20], counts[:20]), space.profile(codes[:20], counts[:20]))
    assert np.allclose(t.profile(codes, counts), space.profile(codes, counts))


def test_network_reads_whole_texts_and_learns():
    r = random.Random(6)
    good = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(80))
    rows = [(good(), 1) if i % 2 else (good().upper(), 0) for i in range(60)]
    net = qualnet.Net(filters=8).fit(rows, epochs=6)
    assert np.mean([(net.score(t) >= 0.5) == y for t, y in [(good(), 1), (good().upper(), 0)] * 10]) > 0.9
    assert 0 <= net.score("") <= 1
    # A change anywhere can change the pooled vectors: chunks cover all places.
    text = good() * 12
    assert len(net.chunks(text)) == max(1, -(-(-(-len(text) // 256) - 1) // 3))
    assert (net.chunks(text[:-40] + "Q!" * 20)[-1] != net.chunks(text)[-1]).any()


def test_network_gradient_is_the_slope():
    net = qualnet.Net(filters=4)
    text, eps = "Some words, some WORDS; " * 60, 1e-2
    g = net.gradient(text, 1)

    def loss():
        return float(np.log1p(np.exp(-net.logit(net.chunks(text)))))

    for name in ("out", "bias"):
        for i in range(3):
            old = net.params[name][i]
            net.params[name][i] = old + eps
            up = loss()
            net.params[name][i] = old - eps
            down = loss()
            net.params[name][i] = old
            assert abs((up - down) / (2 * eps) - g[name][i]) < 2e-2 * max(1, abs(g[name][i]))
