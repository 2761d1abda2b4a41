"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, hidden_markov, jaccard_join, language_id, license_scan, line_dedup, mixing, quality_rules, secret_scan, substring_dedup, vector_codes, warc, whitening
from tessera.llm.common import read


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.length("text").cast("long").alias("kept_chars"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(read(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_totals(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("items"), (F.size("items") > 0).alias("contaminated"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = language_id.fit(docs, ~held_out)
    return language_id.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select(
        "doc_id", "held_out", "lang_pred", "score", "accepted"
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_rules.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.similarity_components(read(spark, sf_dir, "documents").select("doc_id", "text"), 90, 3)
    return found.select("doc_id", "n_shingles", "component_id")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    axes = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "axis")
    out = out.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), "identity_error", axes)
    return out.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "axis.whitened", "axis.explained", "identity_error")


def op12_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    out = hidden_markov.score(read(spark, sf_dir, "documents").select("doc_id", (~held_out).alias("train"), "text"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = vector_codes.compress(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    digest = hashlib.sha256(",".join(map(str, books.flat())).encode()).hexdigest()
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    longs = [F.col(c).cast("long").alias(c) for c in ("error", "label_error")]
    return out.select("vec_id", code.alias("code"), *longs, F.lit(digest).alias("codebooks_sha256"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_mixing": op5_mixing,
    "op6_decontaminate": op6_decontaminate,
    "op7_language_id": op7_language_id,
    "op8_quality_rules": op8_quality_rules,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_license_scan": op10_license_scan,
    "op11_whitening": op11_whitening,
    "op12_hidden_markov": op12_hidden_markov,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE: dict[str, str] = {}

ORACLE["op5_mixing"] = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) AS sid FROM s),
v AS (SELECT source, source_size, sid, CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2.0::DOUBLE AS cap FROM w),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
             sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
             (SELECT sum(source_size) FROM s) * 1.5::DOUBLE AS total FROM v),
l AS (SELECT coalesce(min_by((total - held) / free, sid_order), 0) AS level FROM
        (SELECT total, held, free, cap, weight, row_number() OVER (ORDER BY cap / weight, sid) AS sid_order FROM o)
        WHERE weight * ((total - held) / free) <= cap),
t AS (SELECT source, source_size, least(weight * level, cap) AS target, CAST(floor(least(weight * level, cap)) AS BIGINT) AS quota FROM v, l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.quota,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null')), d.doc_id, d.size
                               ROWS UNBOUNDED PRECEDING) - d.size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(start + size, quota) - start) + greatest(0, least(start + size + source_size, quota) - (start + source_size)) AS BIGINT) AS taken
FROM p
"""

_PART = "to_base(CAST('0x' || digest[{0}:{1}] AS BIGINT), 32, 8)"
_BASE32 = f"translate({' || '.join(_PART.format(10 * i + 1, 10 * i + 10) for i in range(4))}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"
ORACLE["op1_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages),
k AS (SELECT digest AS d, max(page_id) AS last, count(*) AS n FROM p GROUP BY digest)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN n > 1 AND (page_id IS NULL OR page_id < last) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n > 1 AND (page_id IS NULL OR page_id < last) THEN last END AS refers_to
FROM p JOIN k ON digest = d
"""

_WORDS = r"list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
ORACLE["op2_substring_dedup"] = rf"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS win FROM w, LATERAL (SELECT unnest(generate_series(1, len(w) - 49)) AS i) s),
f AS (SELECT win, min(doc_id) AS first FROM win GROUP BY win),
late AS (SELECT doc_id, i FROM win JOIN f USING (win) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS i FROM late),
g AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id
"""

ORACLE["op9_jaccard_join"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS g
      FROM w, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 2))) AS i) x WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 90 * (x.n + y.n - n_both)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN c ON w.doc_id = c.a
"""

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_MEASURES = ("symbol_share", "mean_word", "dup_line_share", "repeat_share")
_VERDICT = " AND ".join(f"{m} <= {m}_hi" for m in _MEASURES)
_FENCES = ", ".join(f"max(greatest(q3 + 3 * (q3 - q1), {quality_rules.MATERIAL.get(m, 0)}::DOUBLE)) FILTER (measure = '{m}') AS {m}_hi" for m in _MEASURES)
_FENCES += ", max(q1 - 3 * (q3 - q1)) FILTER (measure = 'mean_word') AS mean_word_lo"


def _quartiles(name: str, by: str) -> str:
    return f"""
{name}_b AS (SELECT {by}, measure, bucket, sum(n) AS n FROM sk GROUP BY ALL),
{name}_r AS (SELECT *, sum(n) OVER (PARTITION BY {by}, measure ORDER BY bucket NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY {by}, measure) AS n_all,
             CASE WHEN bucket IS NULL THEN 0 ELSE 2 * pow(1.04::DOUBLE, bucket) / 2.04::DOUBLE END AS value FROM {name}_b),
{name} AS (SELECT {by}, measure, max(n_all)::DOUBLE AS n, min(value) FILTER (upto >= 0.25 * n_all) AS q1, min(value) FILTER (upto >= 0.75 * n_all) AS q3 FROM {name}_r GROUP BY {by}, measure)"""


ORACLE["op8_quality_rules"] = rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: length(translate(x, {_SPACE}, '')) > 0) AS l FROM t),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM t, LATERAL (SELECT unnest(generate_series(1, len(w) - 2)) AS i) s),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM twice) GROUP BY doc_id),
m AS (SELECT l.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(t, {_SPACE}, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM l LEFT JOIN rep ON l.doc_id = rep.doc_id),
x AS (SELECT *, n_symbols / greatest(word_chars, 1) AS symbol_share, word_chars / greatest(n_words, 1) AS mean_word,
             n_dup_lines / greatest(n_lines, 1) AS dup_line_share, n_repeat_words / greatest(n_words, 1) AS repeat_share FROM m),
u AS (SELECT lang, source, measure, v FROM (SELECT lang, source, {', '.join(_MEASURES)} FROM x WHERE n_words > 0) UNPIVOT (v FOR measure IN ({', '.join(_MEASURES)}))),
sk AS (SELECT lang, source, measure, CASE WHEN v > 0 THEN CAST(ceil(ln(v) / ln(1.04::DOUBLE)) AS INT) END AS bucket, 1 AS one, count(*) AS n FROM u GROUP BY ALL),
{_quartiles("grp", "lang, source")},
{_quartiles("every", "one")},
drawn AS (SELECT g.lang, g.source, g.measure, (g.n * g.q1 + 50 * e.q1) / (g.n + 50) AS q1, (g.n * g.q3 + 50 * e.q3) / (g.n + 50) AS q3 FROM grp g JOIN every e USING (measure)),
own AS (SELECT lang, source, {_FENCES} FROM drawn GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {_VERDICT} AND mean_word >= mean_word_lo AS kept
FROM x LEFT JOIN own o ON x.lang IS NOT DISTINCT FROM o.lang AND x.source IS NOT DISTINCT FROM o.source
"""

_LICENSE_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_TEMPLATES = ", ".join(f"('{label}', '{label}/{i}', '{t}')" for label, texts in license_scan.TEMPLATES.items() for i, t in enumerate(texts))
_PLACES = " UNION ALL ".join(
    f"SELECT doc_id, i, '{label}' AS label FROM at WHERE " + " AND ".join(f"w[i + {j}] = '{p}'" for j, p in enumerate(phrase)) for label, phrase in license_scan.PHRASES.items()
)
ORACLE["op10_license_scan"] = rf"""
WITH d AS (SELECT doc_id, {_LICENSE_WORDS} AS w FROM documents),
ats AS (SELECT doc_id, w, i FROM d, LATERAL (SELECT unnest(generate_series(1, len(w))) AS i) s),
p AS ({_PLACES.replace("FROM at WHERE", "FROM ats WHERE")}),
base AS (SELECT doc_id, count(*) AS n, min(i) - 1 AS a, max(i) - 1 AS b, list(DISTINCT label) AS labels FROM p GROUP BY doc_id),
tp AS (SELECT label, template, {_LICENSE_WORDS} AS w FROM (VALUES {_TEMPLATES}) v(label, template, text)),
tg AS (SELECT label, template, len(w) AS t_words, i AS t_at, array_to_string(w[i:i + 3], ' ') AS g FROM tp, LATERAL (SELECT unnest(generate_series(1, len(w) - 3)) AS i) s),
dg AS (SELECT doc_id, i AS a, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g FROM ats WHERE i <= len(w) - 3),
h AS (SELECT doc_id, label, template, t_words, a, a - t_at AS diagonal, t_at FROM dg JOIN tg USING (g)),
v AS (SELECT DISTINCT doc_id, template, diagonal FROM h),
f AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {license_scan.GAP} THEN 0 ELSE 1 END AS fresh FROM v),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS run FROM f),
c AS (SELECT doc_id, template, run, label, t_words, diagonal, a, unnest(generate_series(t_at, t_at + 3)) AS k FROM h JOIN r USING (doc_id, template, diagonal)),
g AS (SELECT doc_id, template, label, t_words, min(diagonal) AS low, max(diagonal) AS high, min(a) AS first, max(a) + 3 AS last FROM c GROUP BY doc_id, template, run, label, t_words
      HAVING count(DISTINCT k) >= {license_scan.COVER} * t_words),
al AS (SELECT g.doc_id, g.label, first, last, list_max(list_reduce(
         list_transform(range(1, t_words + 1), lambda p: list_transform(range(low, high + 1), lambda x: CASE WHEN p + x >= 1 AND d.w[p + x] = tp.w[p] THEN 1 ELSE 0 END)),
         lambda best, m: list_transform(range(1, len(m) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: greatest(best[i] + m[i], coalesce(best[i + 1], 0))))),
         list_transform(range(low, high + 1), lambda x: 0))) / t_words AS score
       FROM g JOIN d ON d.doc_id = g.doc_id JOIN tp ON tp.template = g.template),
sp AS (SELECT doc_id, label, first, last, score FROM al WHERE score >= {license_scan.COVER}),
s AS (SELECT * FROM sp WHERE NOT EXISTS (SELECT 1 FROM sp o WHERE o.doc_id = sp.doc_id AND o.label <> sp.label AND o.first <= sp.first AND o.last >= sp.last AND o.last - o.first > sp.last - sp.first)),
o AS (SELECT doc_id, list(DISTINCT label) AS labels, max(score) AS score FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, base.a AS first_word, base.b AS last_word,
       array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(o.labels, [])))), ',') AS labels,
       CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(o.score, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base ON d.doc_id = base.doc_id LEFT JOIN o ON d.doc_id = o.doc_id
"""

_CODEBOOKS = "".join(
    f""",
a{i} AS (SELECT part, v, any_value(n) AS n, arg_min(entry, (gap, entry)) AS entry, min(gap) AS gap
       FROM (SELECT d.part, d.v, d.n, b.entry, list_inner_product(d.v, d.v) - 2 * list_inner_product(d.v, b.c) + list_inner_product(b.c, b.c) AS gap FROM d JOIN b{i} b ON b.part = d.part)
       GROUP BY part, v),
m{i} AS (SELECT part, entry, list(mean ORDER BY pos) AS c FROM
        (SELECT part, entry, pos, floor(sum(n * v[pos]) / sum(n)) AS mean FROM a{i}, LATERAL (SELECT unnest(generate_series(1, len(v))) AS pos) s GROUP BY ALL) GROUP BY part, entry),
b{i + 1} AS (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN m{i} m ON m.part = b.part AND m.entry = b.entry)"""
    for i in range(vector_codes.ROUNDS)
)
ORACLE["op13_vector_codes"] = f"""
WITH e AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda c: floor({vector_codes.SCALE} * c::DOUBLE)) AS x
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (SELECT r, vec_id, label, part, x[part * (len(x) // 4) + 1:(part + 1) * (len(x) // 4)] AS v FROM e, LATERAL (SELECT unnest(generate_series(0, 3)) AS part) s),
d AS (SELECT part, v, count(*) AS n FROM p GROUP BY part, v),
b0 AS (SELECT part, r - 1 AS entry, v AS c FROM p WHERE r <= {vector_codes.ENTRIES}){_CODEBOOKS},
f AS (SELECT part, v, arg_min(entry, (gap, entry)) AS entry, min(gap) AS gap
      FROM (SELECT d.part, d.v, b.entry, list_inner_product(d.v, d.v) - 2 * list_inner_product(d.v, b.c) + list_inner_product(b.c, b.c) AS gap FROM d JOIN b{vector_codes.ROUNDS} b ON b.part = d.part)
      GROUP BY part, v),
o AS (SELECT r, any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(printf('%02x', entry), '' ORDER BY p.part) AS code, CAST(sum(gap) AS BIGINT) AS error
      FROM p JOIN f ON f.part = p.part AND f.v = p.v GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: CAST(y AS BIGINT)), ','), ',' ORDER BY part, entry)) FROM b{vector_codes.ROUNDS}) AS codebooks_sha256
FROM o
"""
