"""The thin opN queries: production parameters over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm.collocations import collocations
from tidelane.llm.common import learnable, table
from tidelane.llm.decontaminate import leaks
from tidelane.llm.html import extract
from tidelane.llm.interleave import shard_digest
from tidelane.llm.merkle import manifest
from tidelane.llm.minhash import near_duplicates
from tidelane.llm.mixing import mixture
from tidelane.llm.ngramjoin import ngram_join
from tidelane.llm.pii import personal_data, personal_digest
from tidelane.llm.quality import quality
from tidelane.llm.tokencount import document_counts
from tidelane.llm.topk import top_k
from tidelane.llm.toxicity import toxicity


#: The rank file of a public byte-level vocabulary; a path on every executor.
VOCABULARY = os.environ.get("TIDELANE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The pattern that splits text for this vocabulary (a fixed value of it), and the id that its ranks leave free.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEPARATOR = 50256

#: Target weights of the mixture: domains, languages within them, and equal sources within those.
DOMAINS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANGUAGES = {"en": 5, "de": 2, "fr": 2, "es": 1}


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_digest(personal_data(table(spark, sf_dir, "documents")))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)
    return out.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixture(table(spark, sf_dir, "documents"), DOMAINS, LANGUAGES, share=(3, 5), max_epochs=2, seed="mix")
    return out.drop("text_key")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("bits", "text_key")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality(docs, table(spark, sf_dir, "labels"), threshold=0.3)
    return out.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "score", "predicted")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digest(table(spark, sf_dir, "documents"), 24, seed="shard")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op9_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_counts(table(spark, sf_dir, "documents"), VOCABULARY, PATTERN, SEPARATOR).select("doc_id", "n_tokens")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op11_ngramjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), k=3, percent=90)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), least=10, most_words=3, share=50, top=2000)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_topk": op2_topk,
    "op3_toxicity": op3_toxicity,
    "op4_mixing": op4_mixing,
    "op5_decontaminate": op5_decontaminate,
    "op6_quality": op6_quality,
    "op7_sharding": op7_sharding,
    "op8_minhash": op8_minhash,
    "op9_tokencount": op9_tokencount,
    "op10_html": op10_html,
    "op11_ngramjoin": op11_ngramjoin,
    "op12_collocations": op12_collocations,
    "op13_merkle": op13_merkle,
}

ORACLE_SQL: dict[str, str] = {
    "op2_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op4_mixing": """
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    'd' || (coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) AS INTEGER), 0) % 4) AS domain,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS BIGINT) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, 2 * CAST(sum(n_tokens) AS BIGINT) AS cap FROM docs GROUP BY ALL),
d0 AS (SELECT 0 AS p, domain AS c, CAST(sum(cap) AS BIGINT) AS cap, CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END AS w FROM leaf GROUP BY domain),
d1 AS (SELECT *, CAST(sum(cap) OVER () AS BIGINT) * 3 // 5 AS budget FROM d0),
{fill:d:p},
l1 AS (SELECT l.domain AS p, l.lang AS c, CAST(sum(l.cap) AS BIGINT) AS cap, CASE l.lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS w, any_value(g.got) AS budget FROM leaf l JOIN dg g ON g.c = l.domain GROUP BY l.domain, l.lang),
{fill:l:p},
s1 AS (SELECT l.domain || '/' || l.lang AS p, l.source AS c, l.cap, 1 AS w, g.got AS budget FROM leaf l JOIN lg g ON g.p = l.domain AND g.c = l.lang),
{fill:s:p},
plan AS (
  SELECT l.*, CASE WHEN tokens > 0 THEN got // tokens ELSE 0 END AS whole, got - (CASE WHEN tokens > 0 THEN got // tokens ELSE 0 END) * tokens AS rest
  FROM leaf l JOIN sg g ON g.p = l.domain || '/' || l.lang AND g.c = l.source),
turns AS (SELECT d.*, CAST(unnest(range(0, whole + 1)) AS INTEGER) AS epoch, whole, rest FROM docs d JOIN plan USING (domain, lang, source)),
summed AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5('mix:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM turns)
SELECT doc_id, epoch, domain, lang, source, n_tokens FROM summed WHERE epoch < whole OR (rest > 0 AND before < rest)""",
    # every window that shares a shingle with an item, without fingerprints; items have five words or more
    "op5_decontaminate": """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
ds AS (SELECT doc_id, len(w) AS n, unnest(range(0, len(w) - 4)) AS p, unnest(list_transform(range(1, len(w) - 3), lambda k: concat_ws(' ', w[k], w[k + 1], w[k + 2], w[k + 3], w[k + 4]))) AS s FROM d),
si AS (SELECT item_id, len(w) AS size, unnest(list_transform(range(1, len(w) - 3), lambda k: concat_ws(' ', w[k], w[k + 1], w[k + 2], w[k + 3], w[k + 4]))) AS s FROM i),
ci AS (SELECT item_id, size, s, count(*) AS k FROM si GROUP BY ALL),
st AS (SELECT DISTINCT doc_id, item_id, size, unnest(range(least(greatest(0, p - size + 5), greatest(0, least(p, n - size))), greatest(0, least(p, n - size)) + 1)) AS first FROM ds JOIN ci ON ci.s = ds.s),
cw AS (SELECT st.doc_id, st.item_id, st.size, st.first, ds.s, count(*) AS k FROM st JOIN ds ON ds.doc_id = st.doc_id AND ds.p BETWEEN st.first AND st.first + st.size - 5 GROUP BY ALL),
m AS (
  SELECT cw.doc_id, cw.item_id, cw.size, cw.first, sum(cw.k) AS n, sum(least(cw.k, coalesce(ci.k, 0))) AS met FROM cw LEFT JOIN ci ON ci.item_id = cw.item_id AND ci.s = cw.s GROUP BY ALL),
r AS (SELECT m.*, met / (n + size - 4 - met)::DOUBLE AS similarity FROM m)
SELECT r.doc_id, r.item_id, CAST(first AS BIGINT) AS first_word, CAST(least(size, len(d.w)) AS BIGINT) AS n_words, similarity FROM r JOIN d ON d.doc_id = r.doc_id WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY r.doc_id, r.item_id ORDER BY similarity DESC, first) = 1""",
    # the checksum is folded over a text's bytes with the 256 values of the reflected polynomial 0xEDB88320
    "op7_sharding": """
WITH steps AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, CAST(i AS BIGINT))) AS t),
d AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS s,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents),
h AS (
  SELECT doc_id, s, len(bytes) + 8 AS size, xor(4294967295, list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) AS text_crc32,
    md5('shard:' || md5(text)) AS g, md5('shard:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM d, steps),
k AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY g) * 1200 > count(*) OVER () THEN o ELSE g END AS key FROM h),
r AS (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY key, o, doc_id) AS r, count(*) OVER (PARTITION BY s) AS n, count(*) OVER () AS total,
    CAST('0x' || substr(md5('shard:' || s), 1, 8) AS BIGINT) AS u FROM k),
a AS (SELECT *, row_number() OVER (ORDER BY CAST((r - 1) * 4294967296 + u AS DOUBLE) / (n * 4294967296.0::DOUBLE), s, r) - 1 AS place FROM r),
p AS (SELECT *, CAST(place * 24 // total AS INTEGER) AS shard FROM a)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, shard, CAST(place - (CAST(shard AS BIGINT) * total + 23) // 24 AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard FROM p""",
    "op8_minhash": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) WHEN len(ws) = 1 THEN [ws[1]] ELSE [] END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
half AS (SELECT x, y FROM met JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
link AS (SELECT x, y FROM half UNION ALL SELECT y, x FROM half),
reach AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y),
top AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(top.y, w.doc_id)) AS component_id, least(w.doc_id, coalesce(top.y, w.doc_id)) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN top ON top.x = w.doc_id""",
}

#: Water filling of one level: from <k>1 (p, c, cap, w, budget) to <k>g (p, c, got).
_FILL = """{k}2 AS (
  SELECT *, budget - coalesce(sum(cap) OVER (PARTITION BY p ORDER BY cap / w::DOUBLE, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rem,
    sum(w) OVER (PARTITION BY p ORDER BY cap / w::DOUBLE, c ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM {k}1),
{k}3 AS (SELECT *, cap * ws <= rem * w AS filled FROM {k}2),
{k}4 AS (SELECT *, budget - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER (PARTITION BY p) AS rest, sum(CASE WHEN filled THEN 0 ELSE w END) OVER (PARTITION BY p) AS wr FROM {k}3),
{k}5 AS (SELECT *, CASE WHEN filled THEN cap ELSE CAST(rest * w // greatest(wr, 1) AS BIGINT) END AS part FROM {k}4),
{k}6 AS (SELECT *, budget - sum(part) OVER (PARTITION BY p) AS spare, row_number() OVER (PARTITION BY p ORDER BY filled, cap / w::DOUBLE DESC, c DESC) AS z FROM {k}5),
{k}g AS (SELECT p, c, CAST(CASE WHEN z = 1 AND NOT filled THEN least(cap, part + spare) ELSE part END AS BIGINT) AS got FROM {k}6)"""
for _k in "dls":
    ORACLE_SQL["op4_mixing"] = ORACLE_SQL["op4_mixing"].replace(f"{{fill:{_k}:p}}", _FILL.format(k=_k))

#: {column} stands for a value as it enters a leaf; the checksum is that of op7_sharding, over the id.
_MERKLE = """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, CAST(i AS BIGINT))) AS t),
d AS (
  SELECT row_number() OVER () AS r, doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS g,
    {doc_id} || {source} || {lang} || {n_chars} AS rest, {text} AS body,
    {low} AS low_body,
    xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda x: CAST('0x' || x AS BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) AS crc FROM documents, crc),
leaf AS (SELECT r, doc_id, g, sha256(rest || body) AS leaf, CASE WHEN crc % 3 = 0 THEN sha256(rest || low_body) ELSE sha256(rest || body) END AS own FROM d),
nodes AS (
  SELECT g, 0 AS level, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n, leaf AS h, r FROM leaf
  UNION ALL
  SELECT g, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)), NULL FROM nodes WHERE n > 1 GROUP BY g, level, pos // 8, n),
subroots AS (SELECT g, h FROM nodes WHERE n = 1),
tops AS (
  SELECT g, 0 AS level, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n, h FROM subroots
  UNION ALL
  SELECT NULL, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 8, n),
steps AS (
  SELECT g, level, pos, coalesce(string_agg(h, '' ORDER BY pos) OVER (PARTITION BY g, level, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
    coalesce(string_agg(h, '' ORDER BY pos) OVER (PARTITION BY g, level, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM nodes WHERE n > 1),
top_steps AS (
  SELECT level, pos, coalesce(string_agg(h, '' ORDER BY pos) OVER (PARTITION BY level, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
    coalesce(string_agg(h, '' ORDER BY pos) OVER (PARTITION BY level, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM tops WHERE n > 1),
depth AS (SELECT g, max(level) AS levels FROM nodes GROUP BY g),
walk AS (
  SELECT l.r, l.g, 0 AS level, n.pos, l.own AS h, '' AS kin, false AS up FROM leaf l JOIN nodes n ON n.r = l.r AND n.level = 0
  UNION ALL
  SELECT w.r, w.g, CASE WHEN w.up OR w.level < p.levels THEN w.level + 1 ELSE 0 END,
    CASE WHEN w.up OR w.level < p.levels THEN w.pos // 8 ELSE t.pos END,
    CASE WHEN w.up THEN sha256(x.a || w.h || x.b) WHEN w.level < p.levels THEN sha256(s.a || w.h || s.b) ELSE w.h END,
    CASE WHEN w.up THEN w.kin || x.a || x.b WHEN w.level < p.levels THEN w.kin || s.a || s.b ELSE w.kin END, w.up OR w.level = p.levels
  FROM walk w JOIN depth p ON p.g = w.g JOIN tops t ON t.g = w.g
  LEFT JOIN steps s ON s.g = w.g AND s.level = w.level AND s.pos = w.pos LEFT JOIN top_steps x ON x.level = w.level AND x.pos = w.pos
  WHERE NOT w.up OR x.a IS NOT NULL),
done AS (SELECT r, h, kin FROM walk WHERE up QUALIFY row_number() OVER (PARTITION BY r ORDER BY level DESC) = 1)
SELECT l.doc_id, l.leaf, s.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(w.kin) AS proof_sha256, w.h AS folded_root,
  w.h = (SELECT h FROM tops WHERE n = 1) AS verified
FROM leaf l JOIN done w ON w.r = l.r JOIN subroots s ON s.g = l.g"""
_FIELD = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || {0}, '-')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL["op13_merkle"] = _MERKLE.format(
    low=_FIELD.format(_LOWER), **{c: _FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
)

ORACLE_SQL["op12_collocations"] = """
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n-\\r]')) AS piece
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS ws FROM d),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, 1 AS size, unnest(ws) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND f >= 10),
cut AS (SELECT *, array_to_string(ws[1:k], ' ') AS p, array_to_string(ws[k + 1:], ' ') AS q FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
s AS (
  SELECT cut.lang, cut.size, cut.phrase, a, k, x.f AS l, y.f AS r, CAST(1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = p JOIN f y ON y.lang = cut.lang AND y.phrase = q),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS phrase, a FROM c WHERE size = 3),
o AS (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY ALL),
r AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
  FROM b JOIN t ON t.lang = b.lang LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.longer IS NULL OR 100 * o.longer < 50 * a)
SELECT * FROM r WHERE rank <= 2000"""

ORACLE_SQL["op11_ngramjoin"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) > 2 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
half AS (SELECT x, y FROM met JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 90 * (p.n + q.n - k)),
link AS (SELECT x, y FROM half UNION ALL SELECT y, x FROM half),
reach AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y),
top AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(top.y, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN top ON top.x = w.doc_id"""
