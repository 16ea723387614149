"""The same queries in DuckDB SQL, written from the operators' definitions and not from their plans."""

from __future__ import annotations

from .functions.stem import stem_sql, stem_word
from .functions.text import STOPWORDS, SYMBOLS, TOKEN
from .operators.duplicates import BLOCK, HASHES, moduli
from .queries import BACK, CHAMPIONS, NOW, PAGE_QUERY, QUERY, REQUESTS, ROBOTS, TOP


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _text(s: str) -> str:
    """A literal, with line ends as chr()."""
    return " || chr(10) || ".join(_q(x) for x in s.split("\n"))


_STOP = ", ".join(_q(w) for w in STOPWORDS + SYMBOLS)
_TOKENS = f"""tok AS (SELECT doc_id, regexp_extract_all(replace(lower(text), '''', ''), {_q(TOKEN)}) AS t FROM documents),
occ AS (SELECT doc_id, unnest(t) AS word FROM tok),
pairs AS (SELECT word, doc_id FROM occ WHERE word NOT IN ({_STOP}))"""
_VOC = f"vw AS (SELECT DISTINCT word FROM pairs), voc AS MATERIALIZED (SELECT word, term FROM {stem_sql('vw')})"
_POST = f"{_TOKENS}, {_VOC}, post AS MATERIALIZED (SELECT term, doc_id, count(*)::BIGINT AS tf FROM pairs JOIN voc USING (word) GROUP BY ALL)"
_IDF = f"{_POST}, n AS (SELECT count(DISTINCT doc_id) AS n FROM documents), idf AS (SELECT term, count(*)::BIGINT AS df, log10(max(n) / count(*)) AS idf FROM post, n GROUP BY term)"
_W = f"{_IDF}, w AS MATERIALIZED (SELECT term, doc_id, tf, tf + idf AS weight, idf FROM post JOIN idf USING (term))"
_LEN = "len AS (SELECT doc_id, coalesce(sqrt(sum(tf * weight * weight)), 0) AS length FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN w USING (doc_id) GROUP BY doc_id)"
_CHAMP = f"champ AS (SELECT term, doc_id, row_number() OVER (PARTITION BY term ORDER BY weight DESC, doc_id) AS rank FROM w QUALIFY rank <= {CHAMPIONS})"
_TERMS = sorted({stem_word(w) for w in QUERY.split() if w not in STOPWORDS})
_IN = ", ".join(_q(t) for t in _TERMS)
_RANKED = f"{_W}, {_LEN}, {_CHAMP}, ranked AS (SELECT doc_id, sum(weight) / max(length) AS score FROM w JOIN len USING (doc_id) WHERE term IN ({_IN}) AND doc_id IN (SELECT doc_id FROM champ WHERE term IN ({_IN})) GROUP BY doc_id)"


def _has(t: str) -> str:
    return f"SELECT doc_id FROM post WHERE term = {_q(stem_word(t))}"


_ALL = "SELECT DISTINCT doc_id FROM documents"
_EDGES = "edges AS MATERIALIZED (SELECT DISTINCT 'c' || o_custkey AS src, 's' || l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey), nodes AS MATERIALIZED (SELECT src AS node FROM edges UNION SELECT dst FROM edges)"
_DEG = "deg AS MATERIALIZED (SELECT src, count(*)::BIGINT AS degree FROM edges GROUP BY src)"
#: Of edges and nodes: each step makes all ranks anew, and notes by how much the worst of them moved beyond its tolerance.
_RANKS = f"""{_DEG}, pn AS (SELECT count(*)::DOUBLE AS pn FROM nodes),
it AS (SELECT 0 AS i, node, 1 / pn AS rank, NULL::DOUBLE AS worst FROM nodes, pn
  UNION ALL
  SELECT i, node, rank, max(abs(rank - old) - 1e-5 * old) OVER () AS worst FROM (
    SELECT p.i + 1 AS i, p.node, p.rank AS old,
      0.85 * (coalesce(v, 0) + coalesce(sum(CASE WHEN deg.src IS NULL THEN p.rank END) OVER (), 0) / pn) + 0.15 / pn AS rank
    FROM it p CROSS JOIN pn LEFT JOIN deg ON deg.src = p.node
    LEFT JOIN (SELECT dst, sum(q.rank / d.degree) AS v FROM it q JOIN edges ON q.node = edges.src JOIN deg d ON d.src = edges.src GROUP BY dst) t ON t.dst = p.node
    WHERE p.i < 100 AND (p.worst IS NULL OR p.worst > 1e-8))),
ranks AS MATERIALIZED (SELECT node, rank FROM it WHERE i = (SELECT max(i) FROM it))"""

_WORDS = r"wd AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents)"
_SHINGLES = f"{_WORDS}, places AS (SELECT doc_id, w, unnest(range(0, len(w) - 3)) AS pos FROM wd WHERE len(w) >= 4), sh AS MATERIALIZED (SELECT doc_id, pos::INT AS pos, concat_ws(chr(31), w[pos + 1], w[pos + 2], w[pos + 3], w[pos + 4]) AS shingle FROM places)"
_SKETCH = f"{_SHINGLES}, hs AS (SELECT DISTINCT doc_id, ('0x' || substr(md5(shingle), 1, 15))::BIGINT AS h FROM sh), sk AS MATERIALIZED (SELECT doc_id, [{', '.join(f'min(h % {m})' for m in moduli())}] AS sketch FROM hs GROUP BY doc_id)"
_CLASS = f"{_SKETCH}, cl AS MATERIALIZED (SELECT sketch, min(doc_id) AS rep FROM sk GROUP BY sketch)"
_BLOCKS = ", ".join(f"md5(array_to_string(sketch[{i + 1}:{i + BLOCK}], ','))" for i in range(0, HASHES, BLOCK))
_CAND = f"{_CLASS}, ss AS (SELECT DISTINCT rep, unnest([{_BLOCKS}]) AS s FROM cl), cand AS MATERIALIZED (SELECT x.rep AS a, y.rep AS b, count(*)::BIGINT AS overlap FROM ss x JOIN ss y ON x.s = y.s AND x.rep < y.rep GROUP BY ALL HAVING count(*) >= 2)"
_JAC = "len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1})))"
_PAIRS = f"{_CAND}, dp AS MATERIALIZED (SELECT a, b, overlap, {_JAC.format('x.sketch', 'y.sketch')} AS similarity FROM cand JOIN cl x ON a = x.rep JOIN cl y ON b = y.rep WHERE {_JAC.format('x.sketch', 'y.sketch')} >= 0.5)"
# Rounds enough for the chains of these tables; anyone left undecided is null in `leads` and fails the comparison.
_ROUNDS = 12
_LEAD = f"{_PAIRS}, l0 AS (SELECT rep, NULL::BOOLEAN AS leads FROM cl)"
for _i in range(1, _ROUNDS + 1):
    _LEAD += f""",
l{_i} AS MATERIALIZED (SELECT l.rep, CASE WHEN any_value(l.leads) IS NOT NULL THEN any_value(l.leads) WHEN coalesce(bool_or(k.leads), false) THEN false
  WHEN count(dp.a) FILTER (WHERE k.leads IS NULL) = 0 THEN true END AS leads FROM l{_i - 1} l LEFT JOIN dp ON dp.b = l.rep LEFT JOIN l{_i - 1} k ON k.rep = dp.a GROUP BY l.rep)"""
_LEAD += f", ld AS (SELECT l.rep, CASE WHEN any_value(l.leads) THEN NULL WHEN any_value(l.leads) IS NULL THEN -1 ELSE min(k.rep) END AS leader FROM l{_ROUNDS} l LEFT JOIN dp ON dp.b = l.rep LEFT JOIN l{_ROUNDS} k ON k.rep = dp.a AND k.leads GROUP BY l.rep)"


def _norm(u: str) -> str:
    """For absolute URLs."""
    s = f"regexp_replace(regexp_replace({u}, '#$', ''), '[?](#|$)', '\\1')"
    s = f"(lower(regexp_extract({s}, '^[A-Za-z][A-Za-z0-9+.-]*:')) || regexp_replace({s}, '^[A-Za-z][A-Za-z0-9+.-]*:', ''))"
    s = f"CASE WHEN contains({s}, '%') THEN url_decode(replace({s}, '+', '%2B')) ELSE {s} END"
    return f"regexp_replace(split_part({s}, '#', 1), '/+$', '')"


def _host(u: str) -> str:
    return f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


#: What the pages of these tables have: entities, and links in double quotes, all closed.
_ENTITIES = {"&middot;": "·", "&copy;": "©", "&quot;": '"', "&#39;": "'", "&nbsp;": "\xa0", "&lt;": "<", "&gt;": ">", "&amp;": "&"}
_MARKUP = ["(?is)<script[^>]*>.*?</script *>", "(?is)<style[^>]*>.*?</style *>", "(?s)<!--.*?-->", "(?s)<[^>]*>"]
_ANCHOR = '(?is)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>'


def _unescape(t: str) -> str:
    for name, letter in _ENTITIES.items():
        t = f"replace({t}, {_q(name)}, {_q(letter)})"
    return t


def _html(h: str) -> str:
    for p in _MARKUP:
        h = f"regexp_replace({h}, {_q(p)}, '', 'g')"
    return rf"regexp_replace({_unescape(h)}, '^\s+|\s+$', '', 'g')"


# All hrefs of these tables are root-relative.
_LINKS = f"""anc AS (SELECT page_id, url, unnest(regexp_extract_all(html, {_q(_ANCHOR)}, 1)) AS href, unnest(regexp_extract_all(html, {_q(_ANCHOR)}, 2)) AS txt,
  unnest(range(len(regexp_extract_all(html, {_q(_ANCHOR)}, 1)))) AS pos FROM pages),
lnk AS (SELECT page_id, url, {_norm("regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') || " + _unescape("href"))} AS dst, max_by({_unescape("regexp_replace(txt, '(?s)<[^>]*>', '', 'g')")}, pos) AS anchor
  FROM anc WHERE NOT (starts_with(href, 'mailto:') OR starts_with(href, 'javascript:') OR starts_with(href, '#') OR starts_with(href, 'tel:')) GROUP BY ALL)"""
#: Crawled pages and all that they link to.
_WEB = f"{_LINKS}, edges AS MATERIALIZED (SELECT DISTINCT {_norm('url')} AS src, dst FROM lnk WHERE {_norm('url')} <> dst), nodes AS MATERIALIZED (SELECT {_norm('url')} AS node FROM pages UNION SELECT dst FROM edges)"
_PAGE_TEXTS = f"documents AS (SELECT page_id AS doc_id, {_html('html')} AS text FROM pages)"
_PAGE_SEARCH = f"WITH {_PAGE_TEXTS}, {_RANKED.replace(_IN, ', '.join(_q(stem_word(w)) for w in PAGE_QUERY.split()))} SELECT doc_id, url, round(score, 6) AS score FROM ranked JOIN pages ON page_id = doc_id ORDER BY ranked.score DESC, doc_id LIMIT {TOP}"
_URLS = f"u AS (SELECT url, min(seq)::BIGINT AS seq FROM (SELECT {_norm('url')} AS url, page_id AS seq FROM pages) GROUP BY url)"
_ROBOTS = "rob(host, robots) AS (VALUES " + ", ".join(f"({_q(h)}, {_text(t)})" for h, t in ROBOTS) + r"""),
ln AS (SELECT host, unnest(string_split(robots, chr(10))) AS line, generate_subscripts(string_split(robots, chr(10)), 1) AS pos FROM rob),
ag AS (SELECT host, pos, CASE WHEN regexp_matches(line, '^User-[aA]gent: ') THEN regexp_extract(line, '^User-[aA]gent: (.*)', 1) END AS a, CASE WHEN starts_with(line, 'Disallow: ') THEN substr(line, 11) END AS prefix FROM ln),
rl AS (SELECT host, last_value(a IGNORE NULLS) OVER (PARTITION BY host ORDER BY pos) AS agent, prefix FROM ag),
named AS (SELECT DISTINCT host, agent FROM rl WHERE agent <> ''), rules AS (SELECT DISTINCT host, agent, prefix FROM rl WHERE agent <> '' AND prefix IS NOT NULL)"""
_REQ = "req(host, path, agent) AS (VALUES " + ", ".join(f"({_q(h)}, {_q(p)}, {_q(a)})" for h, p, a in REQUESTS) + ")"

ORACLES: dict[str, str] = {
    "doc_preprocess": "SELECT doc_id, md5(replace(lower(text), '''', '')) AS digest FROM documents",
    "tokenize": f"WITH {_TOKENS} SELECT doc_id, len(t)::BIGINT AS n, md5(array_to_string(t, ' ')) AS digest FROM tok",
    "stopword_filter": f"WITH {_TOKENS}, k AS (SELECT doc_id, list_filter(t, lambda x: x NOT IN ({_STOP})) AS t FROM tok) SELECT doc_id, len(t)::BIGINT AS n, md5(coalesce(array_to_string(t, ' '), '')) AS digest FROM k",
    "stem": f"WITH {_TOKENS}, {_VOC} SELECT word, term FROM voc",
    "url_vocabulary": "SELECT row_number() OVER (ORDER BY url) - 1 AS doc_id, url FROM (SELECT DISTINCT url FROM pages)",
    "universe": _ALL,
    "pairs": f"WITH {_TOKENS} SELECT word, doc_id FROM pairs",
    "postings": f"WITH {_POST} SELECT * FROM post",
    "docs_with_term": f"WITH {_POST} {_has('thing')}",
    "term_exists": f"WITH {_POST} SELECT DISTINCT term FROM post WHERE term IN ('thing', 'worthless', 'nosuchterm')",
    "document_frequency": f"WITH {_IDF} SELECT term, df FROM idf",
    "idf": f"WITH {_IDF} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "tf_idf": f"WITH {_W} SELECT term, doc_id, tf, round(weight, 6) AS weight FROM w",
    "log_tf": f"WITH {_POST} SELECT term, doc_id, tf, round(1 + log10(tf), 6) AS log_tf FROM post",
    "doc_length": f"WITH {_W}, {_LEN} SELECT doc_id, round(length, 6) AS length FROM len",
    "champions": f"WITH {_W}, {_CHAMP} SELECT term, doc_id, rank FROM champ",
    "free_text_match": f"WITH {_POST} SELECT DISTINCT doc_id FROM post WHERE term IN ({_IN})",
    "rank_candidates": f"WITH {_W}, {_CHAMP} SELECT DISTINCT doc_id FROM champ WHERE term IN ({_IN})",
    "rank_cosine": f"WITH {_RANKED} SELECT doc_id, round(score, 6) AS score FROM ranked",
    "rank_top10": f"WITH {_RANKED} SELECT doc_id, round(score, 6) AS score FROM ranked ORDER BY ranked.score DESC, doc_id LIMIT {TOP}",
    "rank_simple": f"WITH {_IDF} SELECT d.doc_id, round(sum(CASE WHEN tf > 0 THEN 1 + log10(tf) ELSE 0 END - idf), 6) AS score FROM ({_ALL}) d CROSS JOIN (SELECT * FROM idf WHERE term IN ({_IN})) i LEFT JOIN post p ON p.doc_id = d.doc_id AND p.term = i.term GROUP BY d.doc_id",
    "rank_combined": f"WITH RECURSIVE {_RANKED}, {_WEB}, {_RANKS}, pr AS (SELECT page_id AS doc_id, rank AS page_rank FROM pages JOIN ranks ON node = {_norm('url')}) SELECT doc_id, round(0.5 * score + 0.5 * coalesce(page_rank, 0), 6) AS score FROM ranked LEFT JOIN pr USING (doc_id)",
    "page_search": _PAGE_SEARCH,
    "bool_term": f"WITH {_POST} {_has('thing')}",
    "bool_and": f"WITH {_POST} ({_has('thing')}) INTERSECT ({_has('tion')})",
    "bool_or": f"WITH {_POST} ({_has('worthless')}) UNION ({_has('idiot')})",
    "bool_not": f"WITH {_POST} ({_ALL}) EXCEPT ({_has('tion')})",
    "bool_nested": f"WITH {_POST} (({_has('thing')}) INTERSECT ({_has('tion')})) UNION (({_has('worthless')}) INTERSECT (({_ALL}) EXCEPT ({_has('idiot')})))",
    "out_degree": f"WITH {_EDGES}, {_DEG} SELECT src, degree FROM deg",
    "transition_probs": f"WITH {_EDGES}, {_DEG} SELECT src, dst, round(1.0 / degree, 6) AS p FROM edges JOIN deg USING (src)",
    "pagerank": f"WITH RECURSIVE {_EDGES}, {_RANKS} SELECT node, round(rank, 9) AS rank FROM ranks",
    "pagerank_top10": f"WITH RECURSIVE {_EDGES}, {_RANKS} SELECT node, round(rank, 9) AS rank FROM ranks ORDER BY round(ranks.rank, 12) DESC, node LIMIT {TOP}",
    "link_pagerank": f"WITH RECURSIVE {_WEB}, {_RANKS} SELECT node, round(rank, 9) AS rank FROM ranks",
    "short_docs": f"WITH {_WORDS} SELECT doc_id FROM wd WHERE len(w) < 4",
    "shingles": f"WITH {_SHINGLES} SELECT doc_id, pos, md5(shingle) AS digest FROM sh",
    "hash_family": f"WITH h AS (SELECT word, ('0x' || substr(md5(word), 1, 15))::BIGINT AS h FROM (VALUES ('a'), ('b'), ('the quick')) v(word)), m AS (SELECT unnest({moduli()}) AS m, unnest(range({HASHES}))::INT AS i) SELECT word, i, h % m AS value FROM h, m",
    "minhash": f"WITH {_SKETCH} SELECT doc_id, array_to_string(sketch, ',') AS sketch FROM sk",
    "supershingles": f"WITH {_SKETCH} SELECT DISTINCT doc_id, unnest([{_BLOCKS}]) AS super FROM sk",
    "jaccard": f"WITH {_CAND} SELECT a, b, round({_JAC.format('x.sketch', 'y.sketch')}, 6) AS similarity FROM cand JOIN cl x ON a = x.rep JOIN cl y ON b = y.rep",
    "dup_candidates": f"WITH {_CAND} SELECT a, b, overlap FROM cand",
    "dup_pairs": f"WITH {_PAIRS} SELECT a, b, overlap, round(similarity, 6) AS similarity FROM dp",
    "dup_leaders": f"WITH {_LEAD} SELECT rep, leader FROM ld",
    "duplicates": f"WITH {_LEAD} SELECT doc_id, CASE WHEN doc_id = rep THEN leader ELSE coalesce(leader, rep) END AS leader FROM sk JOIN cl USING (sketch) JOIN ld USING (rep)",
    "exact_jaccard": f"WITH {_PAIRS}, st AS (SELECT doc_id, list(DISTINCT shingle) AS s FROM sh WHERE doc_id IN (SELECT a FROM dp UNION SELECT b FROM dp) GROUP BY doc_id) SELECT a, b, round({_JAC.format('x.s', 'y.s')}, 6) AS jaccard FROM dp JOIN st x ON a = x.doc_id JOIN st y ON b = y.doc_id",
    "url_normalize": f"SELECT page_id, {_norm('url')} AS url FROM pages",
    "url_parts": f"SELECT page_id, {_host('url')} AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages",
    "html_text": f"SELECT page_id, md5({_html('html')}) AS digest FROM pages",
    "hyperlinks": f"WITH {_LINKS} SELECT page_id, dst, anchor FROM lnk",
    "link_graph": f"WITH {_LINKS} SELECT DISTINCT url AS src, dst FROM lnk WHERE url <> dst",
    "anchor_text": f"WITH {_LINKS}, k AS (SELECT 'http://' || {_host('url')} AS url, min(page_id) AS first FROM pages GROUP BY 1) SELECT k.url, string_agg(trim(anchor), ' ' ORDER BY page_id DESC, trim(anchor)) AS anchors FROM lnk JOIN k ON k.url = 'http://' || {_host('dst')} WHERE page_id > first AND trim(anchor) <> '' GROUP BY k.url",
    "page_content": f"WITH t AS (SELECT {_host('url')} AS url, page_id, {_html('html')} AS text FROM pages), c AS (SELECT url, string_agg(text, ' ' ORDER BY page_id DESC) AS content FROM t WHERE text <> '' GROUP BY url) SELECT url, md5(content) AS digest, length(content)::INT AS n FROM c",
    "crawl_batch": f"WITH {_LINKS}, g AS (SELECT DISTINCT url AS src, dst FROM lnk WHERE url <> dst) SELECT (SELECT count(DISTINCT url) FROM pages WHERE {_html('html')} <> '') AS contents, (SELECT count(*) FROM g) AS links, (SELECT count(DISTINCT src) FROM g) AS sources",
    "crawl_walk": f"WITH pages AS (SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY {_norm('url')} ORDER BY page_id DESC) = 1), {_WEB}, p AS (SELECT DISTINCT {_norm('url')} AS url FROM pages) SELECT url, true AS found FROM p UNION ALL SELECT node AS url, false AS found FROM nodes WHERE node NOT IN (SELECT url FROM p)",
    "robots_agents": f"WITH {_ROBOTS} SELECT host, agent FROM named",
    "robots_rules": f"WITH {_ROBOTS} SELECT host, agent, prefix FROM rules",
    "robots_access": f"WITH {_ROBOTS}, {_REQ}, a AS (SELECT req.*, CASE WHEN named.agent IS NULL THEN '*' ELSE req.agent END AS ua, CASE WHEN path = '' THEN '/' ELSE path END AS page FROM req LEFT JOIN named USING (host, agent)) SELECT host, path, agent, NOT EXISTS (SELECT 1 FROM rules r WHERE r.host = a.host AND r.agent = a.ua AND r.prefix <> '' AND starts_with(page, r.prefix)) AS allowed FROM a",
    "frontier_dedup": f"WITH {_URLS} SELECT url, seq FROM u",
    "frontier_route": f"WITH {_URLS}, h AS (SELECT *, {_host('url')} AS host FROM u), f AS (SELECT host, min(seq) AS first FROM h GROUP BY host), o AS (SELECT host, first, row_number() OVER (ORDER BY first, host) AS number FROM f QUALIFY number <= {BACK}) SELECT url, seq, h.host, CASE WHEN o.host IS NULL THEN 'front' ELSE 'back' END AS queue, coalesce(number, ('0x' || substr(md5(url), 1, 15))::BIGINT % 3) AS number FROM h LEFT JOIN o ON o.host = h.host AND o.first = h.seq",
    "politeness_schedule": f"WITH {_URLS} SELECT url, {_host('url')} AS host, {NOW} + 3000 * row_number() OVER (PARTITION BY {_host('url')} ORDER BY seq, url) AS at FROM u",
    "next_host": f"WITH {_URLS}, p AS (SELECT DISTINCT {_host('url')} AS host FROM u) SELECT min(host) AS host, 3.0::DOUBLE AS wait_s FROM p",
    "push_hosts": f"WITH {_URLS}, h AS (SELECT {_host('url')} AS host, min(seq) AS first FROM u GROUP BY 1), b AS (SELECT host, row_number() OVER (ORDER BY first, host) AS number FROM h) SELECT host, {NOW} + 3000 AS next_time, number > {BACK} AS pushed FROM b",
}
