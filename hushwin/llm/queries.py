"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushwin.llm import divergence, langid, maxent, mixing, neardup, packing, pii, quality, render, resample, topk, toxicity, urls
from hushwin.llm.common import crc32_mod, table
from hushwin.llm.suffixes import ADDRESS, RULES


def op1_norm_bucketed_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op2_segment_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op3_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is its row in ``labels``: bad if of low quality or toxic."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.cast("int").alias("bad"))
    return urls.judge(table(spark, sf_dir, "pages"), outcomes).drop("bad_rate")


def op4_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


def op6_capped_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_layout_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.extract(table(spark, sf_dir, "pages"))


def op8_weak_supervision_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.judge(table(spark, sf_dir, "documents"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept", F.col("p_good").alias("p_good"))


def op9_crf_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents")).drop("found")


def op10_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_maxent_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents"), crc32_mod("doc_id", 10) == 0)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_norm_bucketed_top_k, op2_segment_toxicity, op3_host_reputation, op4_rank_order_language, op5_power_of_two_packing,
    op6_capped_water_filling, op7_layout_rendering, op8_weak_supervision_quality, op9_crf_personal_data, op10_minmax_near_duplicates,
    op11_source_divergence, op12_maxent_language_model, op13_importance_resampling)}

_OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

_OP3 = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
marked AS (
  SELECT doc_id AS page_id, max((quality = 0 OR toxic = 1)::INT) AS bad FROM labels
  WHERE doc_id IS NOT NULL GROUP BY doc_id),
counted AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS bad FROM p LEFT JOIN marked USING (page_id) GROUP BY host),
users AS (SELECT host, regexp_replace(host, '^.*@', '', 's') AS h FROM counted),
named AS (
  SELECT host, CASE WHEN h LIKE '[%' THEN string_split(h, ']')[1] || ']'
                    ELSE regexp_replace(regexp_replace(h, ':[0-9]*$', ''), '\.$', '') END AS h FROM users),
labelled AS (SELECT host, h, string_split(h, '.') AS l FROM named),
listed AS (SELECT unnest([{rules}]) AS rule),
ends AS (SELECT host, l, unnest(range(2, len(l) + 1)) AS k FROM labelled),
fitting AS (
  SELECT host, k, CASE WHEN '!' || array_to_string(l[-k:], '.') IN (SELECT rule FROM listed) THEN k - 1
                       WHEN array_to_string(l[-k:], '.') IN (SELECT rule FROM listed)
                         OR '*.' || array_to_string(l[-(k - 1):], '.') IN (SELECT rule FROM listed) THEN k END AS size
  FROM ends),
longest AS (SELECT host, arg_max(size, k) AS size FROM fitting WHERE size IS NOT NULL GROUP BY host),
placed AS (
  SELECT host, h, l, coalesce(size, 1) AS size, h LIKE '[%' OR regexp_full_match(l[-1], '(?i)[0-9]+|0x[0-9a-f]*') AS is_address
  FROM labelled LEFT JOIN longest USING (host)),
hosts AS (
  SELECT host, n, bad, CASE WHEN is_address THEN '{address}' ELSE array_to_string(l[-size:], '.') END AS suffix,
         CASE WHEN is_address THEN h ELSE array_to_string(l[-least(size + 1, len(l)):], '.') END AS domain
  FROM counted JOIN placed USING (host)),
base AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1.0) AS m FROM hosts),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(m) AS m FROM hosts, base GROUP BY suffix),
ks AS (
  SELECT 1 / least(greatest(coalesce(sum((bad - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0), 1e-4), 0.25) - 1 AS k
  FROM suffixes),
shrunk AS (SELECT suffix, (bad + k * m) / (n + k) AS m, n + k + 1 AS w FROM suffixes, ks),
domains AS (
  SELECT h.suffix, h.domain, sum(h.n) AS n, sum(h.bad) AS bad, any_value(s.m) AS m, any_value(s.m * (1 - s.m) / s.w) AS var
  FROM hosts h JOIN shrunk s USING (suffix) GROUP BY h.suffix, h.domain),
kd AS (
  SELECT 1 / least(greatest(coalesce(sum((bad - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0), 1e-4), 0.25) - 1 AS k
  FROM domains),
posterior AS (SELECT suffix, domain, (bad + k * m) / (n + k) AS m, n + k + 1 AS w, (k / (n + k)) ** 2 * var AS passed FROM domains, kd),
means AS (
  SELECT h.host, h.n, h.bad, d.m, d.m * (1 - d.m) / d.w + d.passed AS var FROM hosts h JOIN posterior d USING (suffix, domain)),
kh AS (
  SELECT 1 / least(greatest(coalesce(sum((bad - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0), 1e-4), 0.25) - 1 AS k
  FROM means),
known AS (SELECT host, (bad + k * m) / (n + k) AS mean, n + k + 1 AS w, (k / (n + k)) ** 2 * var AS passed FROM means, kh),
ruled AS (
  SELECT page_id, host, path,
         CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
              WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
              WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
              WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
  FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN mean - 1.64 * sqrt(mean * (1 - mean) / w + passed) > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled JOIN known USING (host)
""".replace("{rules}", ", ".join(f"'{r}'" for r in sorted(RULES))).replace("{address}", ADDRESS)

_OP6 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk
  FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE rnk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM sources),
shared AS (
  SELECT *, (SELECT sum(source_size) FROM sources) AS total,
         (SELECT sum(source_size) FROM sources) - coalesce(sum(cap) OVER prev, 0) AS room,
         sum(weight) OVER () - coalesce(sum(weight) OVER prev, 0) AS weights
  FROM weighted
  WINDOW prev AS (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, cap::DOUBLE * weights::DOUBLE <= weight::DOUBLE * room::DOUBLE AS is_full FROM shared),
targets AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN cap::DOUBLE
              ELSE (weight * (total - coalesce(sum(cap) FILTER (WHERE is_full) OVER (), 0)))::BIGINT::DOUBLE
                   / (sum(weight) FILTER (WHERE NOT is_full) OVER ())::DOUBLE END AS target
  FROM capped),
quotas AS (
  SELECT *, floor(target + 0.5)::BIGINT AS quota,
         CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS whole FROM targets),
placed AS (
  SELECT s.doc_id, s.size, q.source_size, q.target, q.whole, q.quota - q.whole * q.source_size AS rest,
         sum(s.size) OVER upto - sum(s.size) OVER same AS before, sum(s.size) OVER same AS at_key
  FROM sized s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source
  WINDOW upto AS (PARTITION BY s.source ORDER BY s.key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         same AS (PARTITION BY s.source, s.key))
SELECT doc_id, size, source_size, target,
       (whole * size + CASE WHEN at_key = 0 OR rest <= before THEN 0
                            WHEN rest >= before + at_key THEN size
                            ELSE size * (rest - before) // at_key END)::BIGINT AS taken
FROM placed
"""

_OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
t AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
v AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
sizes AS (SELECT lang, count(*) AS vocabulary, sum(lang_n) AS lang_total FROM v GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN v ON v.lang = t.lang AND v.term = t.term GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
g AS (
  SELECT a.lang, a.source, coalesce(total, 0) AS total, coalesce(vocabulary, 0) AS vocabulary, coalesce(lang_total, 0) AS lang_total
  FROM (SELECT DISTINCT lang, source FROM d) a LEFT JOIN totals USING (lang, source) LEFT JOIN sizes USING (lang)),
p AS (
  SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
         (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + g.vocabulary)::HUGEINT)::BIGINT AS p,
         (1 + 1000000000::HUGEINT * (v.lang_n + 1) // (g.lang_total + g.vocabulary)::HUGEINT)::BIGINT AS of_lang
  FROM g JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
priced AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN priced ON priced.lang = a.lang AND priced.source = a.source AND priced.item = b.source),
found AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, (p - of_lang) * (p - of_lang) // of_lang FROM p WHERE n > 0 AND p > of_lang),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""

_OP13 = r"""
WITH bits AS (
  SELECT list(c ORDER BY i) AS crcs FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256))::BIGINT AS i))),
d AS (
  SELECT doc_id, row_number() OVER () AS row,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
w AS (SELECT row, unnest(words) AS word FROM d),
distinct_words AS (SELECT DISTINCT word, lower(hex(encode(word))) AS h FROM (SELECT word FROM w UNION ALL SELECT word FROM b)),
hashed AS (
  SELECT word, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda i: (strpos('0123456789abcdef', h[2 * i + 1]) - 1) * 16 + strpos('0123456789abcdef', h[2 * i + 2]) - 1)),
      lambda c, x: xor(c >> 8, crcs[1 + (xor(c, x) & 255)])), 4294967295) % 10000 AS bucket
  FROM distinct_words, bits),
f AS (SELECT row, bucket FROM w JOIN hashed USING (word)),
s AS (SELECT bucket, count(*) AS s FROM f GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN hashed USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)
                                 / ((s + 1.0::DOUBLE) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT row, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN gains USING (bucket) GROUP BY row),
scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight, row,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (row)),
ranks AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, row) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranks USING (row)
"""

_OP10 = r"""
WITH RECURSIVE worded AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
placed AS (SELECT r, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM worded WHERE len(w) >= 5),
grams AS (
  SELECT r, t || ' ' || lead(t, 1) OVER p || ' ' || lead(t, 2) OVER p || ' ' || lead(t, 3) OVER p || ' ' || lead(t, 4) OVER p AS g
  FROM placed WINDOW p AS (PARTITION BY r ORDER BY i)),
distinct_grams AS MATERIALIZED (
  SELECT DISTINCT r, g FROM grams WHERE g IS NOT NULL
  UNION ALL SELECT r, array_to_string(w, ' ') FROM worded WHERE len(w) BETWEEN 1 AND 4),
sets AS MATERIALIZED (SELECT r, md5(string_agg(g, chr(10) ORDER BY g)) AS s, count(*) AS n FROM distinct_grams GROUP BY r),
classes AS MATERIALIZED (
  SELECT min(r) AS c, s, any_value(n) AS n, min(doc_id) AS least FROM sets JOIN worded USING (r) GROUP BY s),
shingles AS (SELECT c, n, g FROM classes JOIN distinct_grams ON r = c),
links AS (
  SELECT a.c AS a, b.c AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.c <> b.c AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reached AS (
  SELECT c AS a, c AS b FROM classes
  UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
components AS (SELECT a AS c, min(least) AS component_id FROM reached JOIN classes ON classes.c = reached.b GROUP BY a)
SELECT d.doc_id, coalesce(t.n, 0)::BIGINT AS n_shingles, CASE WHEN t.n IS NULL THEN d.doc_id ELSE component_id END AS component_id,
       t.n IS NULL OR d.doc_id = component_id AS kept
FROM worded d LEFT JOIN sets t USING (r) LEFT JOIN classes k ON t.s = k.s LEFT JOIN components USING (c)
"""

ORACLE = {
    "op1_norm_bucketed_top_k": _OP1,
    "op3_host_reputation": _OP3,
    "op6_capped_water_filling": _OP6,
    "op10_minmax_near_duplicates": _OP10,
    "op11_source_divergence": _OP11,
    "op13_importance_resampling": _OP13,
}
