"""The queries of this subpackage and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, media, mixing, packing, qualnet, quality_rules, simhash, suffix, toxicity, warc
from .common import id_crc, labelled_sample, stage_table, table


#: Rows that classifiers are fitted on, at most; for languages, of each.
TOXICITY_ROWS, LANGUAGE_ROWS, QUALITY_ROWS = 4000, 500, 1600


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    sample = labelled_sample(docs, labels, "toxic", TOXICITY_ROWS, 4, 2)
    share = qualnet.label_share(labels.where(id_crc(F.col("doc_id")) % 4 != 2), "toxic")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(sample, share))
    return scored.select("doc_id", (id_crc(F.col("doc_id")) % 4 == 2).alias("held_out"), "score", "predicted")


def op2_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.cascade(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "fingerprint", "component_id")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), keep_ids=False)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = stage_table(media.encode(table(spark, sf_dir, "documents")), "media")
    return media.describe(stored).drop("embedded", "corrected")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", "taken")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, space = table(spark, sf_dir, "documents"), langid.Space()
    names, prototypes = langid.fit(langid.training_rows(docs, LANGUAGE_ROWS), space)
    found = langid.identify(docs.select("doc_id", "text"), names, prototypes, space)
    return found.select("doc_id", (id_crc(F.col("doc_id")) % 4 == 2).alias("held_out"), "lang_pred", "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    sample = labelled_sample(docs, labels, "quality", QUALITY_ROWS, 5, 0)
    share = qualnet.label_share(labels.where(id_crc(F.col("doc_id")) % 5 != 0), "quality")
    scored = qualnet.score(docs.select("doc_id", "text"), qualnet.Net().fit(sample, prior=share))
    return scored.select("doc_id", (id_crc(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", "predicted")


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_cascade": op2_quality_cascade,
    "op3_simhash": op3_simhash,
    "op4_pack": op4_pack,
    "op5_media": op5_media,
    "op6_warc": op6_warc,
    "op7_mix": op7_mix,
    "op8_language": op8_language,
    "op9_quality": op9_quality,
    "op10_suffix": op10_suffix,
}

OP2_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
      FROM t),
v AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM f)),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM v),
p AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM g, (SELECT unnest([0, 1, 2]) AS j) WHERE n > 1 GROUP BY r),
b AS (SELECT f.doc_id, f.text, len(w)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM f LEFT JOIN p USING (r)),
c AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 100 > n_words * 10
    OR (length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g'))) * 100 > word_chars * 30
    OR (length(text) - length(regexp_replace(text, '[!?]', '', 'g'))) * 100 > n_words * 10
    OR n_dup_lines * 100 > len(string_split(text, chr(10))) * 50
    OR word_chars < n_words * 2 OR word_chars > n_words * 15) AS kept
FROM c
"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, source IS NULL AS s_null, coalesce(source, '') AS s,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 15))::BIGINT AS k FROM documents),
s0 AS (SELECT s_null, s, sum(size)::HUGEINT AS source_size FROM d GROUP BY ALL),
s1 AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY s_null, s) - 1) % 3 + 1)::INT]::BIGINT AS w FROM s0),
s2 AS (SELECT *, source_size * (6 // w) AS lvl, sum(source_size) OVER () AS al, sum(w) OVER () AS wall FROM s1),
s3 AS (SELECT *, al * 3 - 2 * 2 * coalesce(sum(source_size) OVER e, 0) AS lft, wall - coalesce(sum(w) OVER e, 0) AS wl
       FROM s2 WINDOW e AS (ORDER BY lvl, s_null, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, source_size * wl * 4 <= lft * w AS capped FROM s3),
s5 AS (SELECT *, max(CASE WHEN NOT capped THEN wl END) OVER () AS fw, max(CASE WHEN NOT capped THEN {'w': wl, 'l': lft} END) OVER () AS fr FROM s4),
s6 AS (SELECT s_null, s, source_size::BIGINT AS source_size, CASE WHEN capped THEN (2 * source_size)::DOUBLE
         ELSE least(w::DOUBLE * fr.l::DOUBLE / (fw * 2)::DOUBLE, (2 * source_size)::DOUBLE) END AS target FROM s5),
r AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.s_null, d.s ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum
      FROM d JOIN s6 ON d.s_null = s6.s_null AND d.s = s6.s),
x AS (SELECT *, unnest([0, 1]) AS copy FROM r WHERE size > 0 AND target > 0),
y AS (SELECT *, (cum + source_size * copy)::DOUBLE / target AS v FROM x),
z AS (SELECT *, sum(size) OVER (ORDER BY v, s_null, s, copy, k, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM y),
t AS (SELECT doc_id, k, size, s_null, s, sum(size) AS taken FROM z WHERE upto <= (SELECT sum(size) * 3 / 2 FROM d) GROUP BY ALL)
SELECT r.doc_id, r.size, r.source_size, r.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM r LEFT JOIN t ON r.doc_id = t.doc_id AND r.k = t.k AND r.size = t.size AND r.s_null = t.s_null AND r.s = t.s
"""

#: Five digits of the hexadecimal digest are four of base 32.
_B32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {shift}) & 31)::INT, 1)" for i in range(8) for shift in (15, 10, 5, 0))
OP6_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT html, max(page_id) AS keeper FROM p GROUP BY html)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_B32} AS payload_digest,
  CASE WHEN page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM p JOIN k USING (html)
"""

ORACLES: dict[str, str] = {"op6_warc": OP6_SQL, "op2_quality_cascade": OP2_SQL, "op7_mix": OP7_SQL}
