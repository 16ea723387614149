import numpy as np

from skein.functions import urls as U
from skein.operators import crawl as C
from skein.operators import duplicates as D
from skein.operators import frontier as FR
from skein.operators import graph as G
from skein.operators import robots as RB
from skein.operators import web as W
from skein.sources import corpus as S
from skein.streaming.frontier import scheduled, unseen


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f).first()[0]


def test_pagerank_equals_the_dense_iteration(spark):
    nodes, edges = list("abcd"), [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("b", "x"), ("a", "b")]
    m = np.zeros((4, 4))
    for s, d in {e for e in edges if e[1] in nodes}:
        m[nodes.index(s), nodes.index(d)] = 1
    m[m.sum(axis=1) == 0] = 1
    m = 0.85 * m / m.sum(axis=1, keepdims=True) + 0.15 / 4
    state = np.full(4, 0.25)
    for _ in range(100):
        old, state = state, state @ m
        if np.allclose(state, old):
            break
    got = {r.node: r["rank"] for r in G.pagerank(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(n,) for n in nodes], "node string")).collect()}
    assert np.allclose([got[n] for n in nodes], state, atol=1e-9)


def test_pagerank_of_nothing(spark):
    assert G.pagerank(spark.createDataFrame([], "src string, dst string"), spark.createDataFrame([], "node string")).count() == 0


def test_leaders_follow_the_sequential_scan(spark):
    rng = np.random.default_rng(5)
    n, pairs = 14, set()
    for _ in range(18):
        a, b = sorted(rng.integers(0, n, 2).tolist())
        if a != b:
            pairs.add((a, b))
    leads, want = [], {}
    for i in range(n):
        near = [j for j in leads if (j, i) in pairs]
        want[i] = near[0] if near else None
        if not near:
            leads.append(i)
    got = D.leaders(spark.createDataFrame([(i,) for i in range(n)], "rep long"), spark.createDataFrame(sorted(pairs), "a long, b long"))
    assert {r.rep: r.leader for r in got.collect()} == want


def test_first_leaders_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1000, (5, 84))
    rows = []
    for i in range(60):
        k = base[i % 5].copy()
        for block in rng.integers(0, 14, int(rng.integers(0, 12))):
            k[6 * block : 6 * block + 6] = rng.integers(0, 1000, 6)
        rows.append((i, k.tolist()))
    reps = spark.createDataFrame(rows, "rep long, sketch array<long>")
    want = D.leaders(reps.select("rep"), D.dup_pairs(reps))
    got = {r.rep: r.leader for r in D.first_leaders(reps).collect()}
    assert got == {r.rep: r.leader for r in want.collect()} and 10 < sum(x is None for x in got.values()) < 50


def test_shingles_of_short_texts(spark):
    docs = spark.createDataFrame([(0, None), (1, "a b c"), (2, "a b c d"), (3, "a b  c d\ne")], "doc_id long, text string")
    assert {r.doc_id for r in D.short_docs(docs).collect()} == {0, 1}
    assert [(r.doc_id, r.pos, r.shingle.split("\x1f")) for r in D.shingles(docs).orderBy("doc_id", "pos").collect()] == [(2, 0, list("abcd")), (3, 0, list("abcd")), (3, 1, list("bcde"))]
    assert {r.doc_id for r in D.sketches(docs).collect()} == {2, 3}


def test_copies_get_the_first_as_leader(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(5, text), (7, text), (9, text + " more"), (11, "quite another text than those")], "doc_id long, text string")
    got = {r.doc_id: r.leader for r in D.duplicates(docs).collect()}
    assert got[5] is None and got[7] == 5 and got[11] is None


def test_urls(spark):
    for url, want in [("HTTP://Ex.com/a/", "http://Ex.com/a"), ("http://x/a%20b", "http://x/a b"), ("http://x/a%23b", "http://x/a"), ("http://x/a+b%zz", "http://x/a+b%zz"), ("http://x/?", "http://x"), ("http://x/a?q=1#f", "http://x/a?q=1"), ("http://x///", "http://x")]:
        assert one(spark, url, U.normalize(U.F.col("v"))) == want, url
    for href, want in [("/b", "http://x/b"), ("c", "http://x/p/c"), ("../c?d", "http://x/c?d"), ("./e", "http://x/p/e"), ("//y/z", "http://y/z"), ("https://z/", "https://z"), ("?r=1", "http://x/p/q?r=1")]:
        assert one(spark, href, U.normalize(U.F.col("v"), U.F.lit("http://x/p/q"))) == want, href
    assert one(spark, "http://u@h:8/p?q", U.host(U.F.col("v"))) == "u@h:8"


def test_robots(spark):
    text = "Disallow: /early\nUser-agent: one\nUser-Agent: two\nDisallow: /a\nDisallow: \nUser-agent: *\nDisallow: /\nUser-agent: crlf\r\nDisallow: /c\r"
    robots = spark.createDataFrame([("h", text)], "host string, robots string")
    assert {(r.agent, r.prefix) for r in RB.robots_rules(robots).collect()} >= {("two", "/a"), ("two", ""), ("*", "/")}
    asked = spark.createDataFrame([("h", p, a) for p in ("", "/a/b", "/x") for a in ("one", "two", "three")] + [("g", "/a", "one")], "host string, path string, agent string")
    got = {(r.host, r.path, r.agent): r.allowed for r in RB.robots_access(asked, robots).collect()}
    assert got["h", "", "one"] and got["h", "/a/b", "one"] and not got["h", "/a/b", "two"] and got["h", "/x", "two"]
    assert not got["h", "", "three"] and not got["h", "/x", "three"] and got["g", "/a", "one"]


def test_robots_are_kept_between_batches(spark):
    kind = "host string, robots string, at long"
    known = RB.robots_cache(spark.createDataFrame([], kind), spark.createDataFrame([("a", "old", 1), ("b", None, 1)], kind))
    assert {r.host for r in RB.robots_missing(spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "host string"), known).collect()} == {"c"}
    again = RB.robots_cache(known, spark.createDataFrame([("a", "new", 2)], kind))
    assert {(r.host, r.robots, r["at"]) for r in again.collect()} == {("a", "new", 2), ("b", None, 1)}


def test_links_and_contents(spark):
    html = '<script>"</p>"</script><a href="/b">one</a> <a class="x" href="/b">two &amp; <b>more</b></a><a href="mailto:q">m</a><a href="/p/">self</a>'
    pages = spark.createDataFrame([(1, "http://h/p", html), (2, "http://h/b", "<p> text </p>"), (3, "http://h/z", '<a href="b">late</a>')], "page_id long, url string, html string")
    links = W.hyperlinks(pages)
    assert {(r.page_id, r.dst, r.anchor) for r in links.collect()} == {(1, "http://h/b", "two & more"), (1, "http://h/p", "self"), (3, "http://h/b", "late")}
    assert {(r.src, r.dst) for r in W.link_graph(links).collect()} == {("http://h/p", "http://h/b"), ("http://h/z", "http://h/b")}
    assert {r.url: r.content for r in W.page_content(pages).collect()}["http://h/b"] == "text"
    assert [(r.url, r.anchors) for r in W.anchor_text(links, pages).collect()] == [("http://h/b", "late")]


def test_heap(spark):
    empty = spark.createDataFrame([], "host string, next_time long")
    assert FR.next_host(empty, 5).count() == 0
    pushed = FR.push_hosts(empty, spark.createDataFrame([("t",), ("t",)], "host string"), 1000)
    assert [(r.host, r.next_time, r.pushed) for r in pushed.collect()] == [("t", 4000, True)]
    again = FR.push_hosts(pushed.select("host", "next_time"), spark.createDataFrame([("t",)], "host string"), 2000)
    assert [r.pushed for r in again.collect()] == [False]
    assert FR.next_host(pushed.select("host", "next_time"), 3000).first().wait_s == 1.0
    assert FR.next_host(pushed.select("host", "next_time"), 9000).first().wait_s == 0.0


def test_streams_end_as_the_batch_does(spark, tmp_path):
    rows = [(f"http://h{i % 3}/p{i % 7}", i) for i in range(20)]
    spark.createDataFrame(rows, "url string, seq long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("url string, seq long").parquet(str(tmp_path / "in"))
    q = unseen(stream()).writeStream.format("memory").queryName("unseen").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.url for r in spark.table("unseen").collect()} == {u for u, _ in rows}
    firsts = FR.frontier_dedup(spark.createDataFrame(rows, "url string, seq long"))
    firsts.coalesce(1).write.parquet(str(tmp_path / "first"))
    s = spark.readStream.schema("url string, seq long").parquet(str(tmp_path / "first"))
    q = scheduled(s).writeStream.format("memory").queryName("scheduled").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r.url, r.at) for r in FR.politeness_schedule(firsts).collect()}
    assert {(r.url, r["at"]) for r in spark.table("scheduled").collect()} == want


def test_registered_pagerank_settles(spark, tmp_path):
    from skein.queries import QUERIES

    bought = [(0, 0), (0, 1), (1, 1), (2, 1), (3, 2), (4, 2), (4, 0), (5, 1)]
    spark.createDataFrame([(i, c) for i, (c, _) in enumerate(bought)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(i, k) for i, (_, k) in enumerate(bought)], "l_orderkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    nodes = sorted({f"c{c}" for c, _ in bought} | {f"s{k}" for _, k in bought})
    m = np.zeros((len(nodes), len(nodes)))
    for c, k in bought:
        m[nodes.index(f"c{c}"), nodes.index(f"s{k}")] = 1
    m[m.sum(axis=1) == 0] = 1
    m = 0.85 * m / m.sum(axis=1, keepdims=True) + 0.15 / len(nodes)
    state, rounds = np.full(len(nodes), 1 / len(nodes)), 0
    for rounds in range(1, 101):
        old, state = state, state @ m
        if np.allclose(state, old):
            break
    assert rounds > 5
    got = {r.node: r["rank"] for r in QUERIES["pagerank"](spark, str(tmp_path)).collect()}
    assert np.allclose([got[n] for n in nodes], state, rtol=0, atol=1e-9)


def test_forms_of_links_and_entities(spark):
    html = "<a href='/q'>a</a><A HREF = /n>b<a href=\"/d\">c &lt;&#233;&#x20AC;&unknown;&amp;lt;</a><a data-href='/no' name=x>d</a><area href='/no'>"
    pages = spark.createDataFrame([(1, "http://h/", html)], "page_id long, url string, html string")
    assert {(r.dst, r.anchor) for r in W.hyperlinks(pages).collect()} == {("http://h/q", "a"), ("http://h/n", "b"), ("http://h/d", "c <é€&unknown;&lt;")}
    from skein.functions.html import html_text

    assert one(spark, "<p>1 &#60; 2 &#xD800;&#99999999;</p>", html_text(U.F.col("v"))) == "1 < 2 \ufffd&#99999999;"


def test_crawl_goes_through_hosts_in_turn_and_minds_robots(spark):
    site = {"http://a/": '<a href="/x">1</a><a href="/no/y">2</a><a href="http://b/">3</a>', "http://a/x": '<a href="/">home</a><a href="/gone">4</a>', "http://a/no/y": "secret", "http://b/": "b"}
    snapshot = spark.createDataFrame([(u.rstrip("/"), h) for u, h in site.items()], "url string, html string")
    robots = spark.createDataFrame([("a", "User-agent: *\nDisallow: /no")], "host string, robots string")
    done = C.run(spark.createDataFrame([("http://a",)], "url string"), snapshot, robots)
    got = {r.url: (r.html is not None, r["round"]) for r in done.fetched.collect()}
    assert {u: f for u, (f, _) in got.items()} == {"http://a": True, "http://b": True, "http://a/x": True, "http://a/no/y": False, "http://a/gone": False}
    rounds = [r for u, (_, r) in got.items() if u.startswith("http://a")]
    assert len(set(rounds)) == len(rounds)
    assert C.run(spark.createDataFrame([("http://a",)], "url string"), snapshot, robots, most=0).round == 1


def test_front_queues_give_their_first(spark):
    urls = spark.createDataFrame([(f"http://h{i % 2}/{i}", i) for i in range(9)], "url string, seq long")
    got = C.front_dequeue(FR.frontier_route(urls, back_queues=1, front_queues=2), 1).collect()
    routed = FR.frontier_route(urls, back_queues=1, front_queues=2).where("queue = 'front'").collect()
    assert {(r.number, r.seq) for r in got} == {(n, min(r.seq for r in routed if r.number == n)) for n in {r.number for r in routed}}
    assert {r.url for r in FR.new_urls(urls, urls.where("seq > 0")).collect()} == {"http://h0/0"}


def test_sources_and_sinks(spark, tmp_path):
    log = spark.createDataFrame([(200, "text/html", 1), (404, "text/html", 2), (200, "image/png", 3)], "status int, content_type string, id int")
    assert [r.id for r in W.fetched(log).collect()] == [1]
    contents = spark.createDataFrame([("http://a", "one"), ("http://b", "two")], "url string, content string")
    links = spark.createDataFrame([("http://a", "http://b")], "src string, dst string")
    S.write_corpus(contents, links, str(tmp_path / "corpus"))
    assert {(r.url, r.content) for r in S.read_corpus(spark, str(tmp_path / "corpus" / "contents")).collect()} == {("http://a", "one"), ("http://b", "two")}
    assert S.enough(contents, 1) and not S.enough(contents, 2)
    assert [(r.src, r.dst) for r in S.read_references(spark, str(tmp_path / "corpus")).collect()] == [("http://a", "http://b")]


def test_rounds_of_leaders_carry_only_what_is_undecided(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(1000 + i, rng.integers(1000 * i, 1000 * i + 1000, 84).tolist()) for i in range(40)]  # classes without a key
    # A chain: each shares 2 blocks with all, and is similar to none, but for two near copies.
    shared, chain = rng.integers(0, 9, 12).tolist(), []
    for i in range(8):
        chain.append((i, shared + rng.integers(10**6 * (i + 1), 10**6 * (i + 1) + 10**5, 72).tolist()))
    rows += chain + [(50, chain[5][1][:-6] + [1] * 6), (51, chain[2][1][:-6] + [2] * 6)]
    written = []

    def noted(df, name="step", put=D.materialize):
        out = put(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(D, "materialize", noted)
    reps = spark.createDataFrame(rows, "rep long, sketch array<long>")
    got = {r.rep: r.leader for r in D.first_leaders(reps).collect()}
    monkeypatch.undo()
    want = D.leaders(reps.select("rep"), D.dup_pairs(reps))
    assert got == {r.rep: r.leader for r in want.collect()} and got[50] == 5 and got[51] == 2
    assert dict(written)["keyed"] == 10
    left = [n for name, n in written if name == "waiting"]
    assert len(left) >= 8 and left == sorted(left, reverse=True) and left[-1] == 0 and sum(left) < len(left) * dict(written)["keys"] / 2


def test_a_lesser_leader_of_a_later_round_is_found(spark):
    # 1 is blocked by 0, with which it shares two blocks, and leads in the second round; 3 is similar to 2, a leader of the first, and to 1.
    one, zero = list(range(84)), list(range(200, 284))
    zero[72:] = one[72:]
    two = list(range(300, 384))
    three = one[:42] + two[42:]
    rows = [(0, zero), (1, one), (2, two), (3, three)]
    reps = spark.createDataFrame(rows, "rep long, sketch array<long>")
    got = {r.rep: r.leader for r in D.first_leaders(reps, min_similarity=0.3).collect()}
    want = D.leaders(reps.select("rep"), D.dup_pairs(reps, min_similarity=0.3))
    assert got == {r.rep: r.leader for r in want.collect()} == {0: None, 1: None, 2: None, 3: 1}


def test_pagerank_of_linked_and_unlinked_sources(spark):
    rng = np.random.default_rng(4)
    nodes = [f"n{i}" for i in range(30)]
    # 0-9 have no link to them, 20-29 none from them.
    edges = {(f"n{rng.integers(0, 20)}", f"n{rng.integers(10, 30)}") for _ in range(70)}
    m = np.zeros((30, 30))
    for s, d in edges:
        m[int(s[1:]), int(d[1:])] = 1
    m[m.sum(axis=1) == 0] = 1
    m = 0.85 * m / m.sum(axis=1, keepdims=True) + 0.15 / 30
    state = np.full(30, 1 / 30)
    for _ in range(6):
        state = state @ m
    e, v = spark.createDataFrame(sorted(edges), "src string, dst string"), spark.createDataFrame([(n,) for n in nodes], "node string")
    for closed in (False, True):
        got = {r.node: r["rank"] for r in G.pagerank(e, v, iterations=6, stop=False, closed=closed).collect()}
        assert np.allclose([got[n] for n in nodes], state, atol=1e-12, rtol=0)


def test_rounds_of_pagerank_deal_nothing_where_no_source_is_linked(spark, monkeypatch):
    plans = []

    def noted(df, name="step", put=G.materialize):
        plans.extend([df._jdf.queryExecution().executedPlan().toString()] if name == "ranks" else [])
        return put(df, name)

    monkeypatch.setattr(G, "materialize", noted)
    edges = [("c1", "s1"), ("c1", "s2"), ("c2", "s2"), ("c3", "s1")]
    got = G.pagerank(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(n,) for n in ("c1", "c2", "c3", "s1", "s2")], "node string"))
    assert round(sum(r["rank"] for r in got.collect()), 9) == 1 and len(plans) > 2
    assert not any("Exchange" in p or "Join" in p for p in plans[1:])
