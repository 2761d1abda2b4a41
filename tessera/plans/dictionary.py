"""Dictionary matching over the documents, translation by a cache, and mentions merged to entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import plain
from tessera.operators import dictionary as D
from tessera.session import table

CANONICAL = 4


def _opening(text, n):
    return F.array_join(F.slice(F.filter(F.split(plain(F.col(text)), " "), lambda w: w != ""), 1, n), " ")


def _terms(spark, sf_dir):
    """(term, alias): names of parts, the first two words of each turn and the first four of each benchmark item; the least number of equal ones."""
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1_000_000_000).alias("term"), plain(F.col("p_name")).alias("alias"))
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn") + 2_000_000_000_000).alias("term"), _opening("text", 2).alias("alias"))
    b = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 3_000_000_000_000_000).alias("term"), _opening("text", 4).alias("alias"))
    return p.unionByName(c).unionByName(b).filter("alias <> ''").groupBy("alias").agg(F.min("term").alias("term"))


def c32_dictionary(spark, sf_dir):
    """Documents against a dictionary of openings and names: all places, those that a reader takes (longest first), and their terms."""
    found = D.matches(table(spark, sf_dir, "documents"), "doc_id", "text", _terms(spark, sf_dir), "term", "alias")
    taken = lambda c: F.sum(F.when(F.col("taken"), c))
    rows = D.marked(found).groupBy("doc").agg(F.count(F.lit(1)).alias("places"), F.countDistinct("term").alias("terms"), F.count_if("taken").alias("taken"), taken(F.col("n")).alias("words"), taken(F.col("term")).alias("term_sum"))
    return rows.withColumnRenamed("doc", "doc_id")


def j06_translated(spark, sf_dir):
    """Search phrases of parts by name, type and brand: those cached for the longer half, the parts themselves for the others."""
    p = table(spark, sf_dir, "part")
    said = F.concat_ws("  ", F.lit("photo of"), F.reverse("p_name"), F.lower("p_brand"))
    cache = p.filter("p_size > 25").select("p_name", "p_type", "p_brand", said.alias("said"))
    e = p.select("p_name", "p_type", "p_brand").distinct()
    return D.translated(e, cache, ["p_name", "p_type", "p_brand"], "said")


def j04_entities(spark, sf_dir):
    """Entities mentioned in conversations, runs of words with a capital: mentions, turns, and the span of the first one."""
    runs = D.capital_runs(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text")
    first = F.min(F.struct("turn", "start", "n"))
    out = runs.groupBy("conv_id", "entity").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("turn").alias("turns"), first.alias("f"))
    return out.select("conv_id", "entity", "mentions", "turns", F.col("f.turn").cast("long").alias("turn"), F.col("f.start").cast("long").alias("start"), F.col("f.n").cast("long").alias("n"))


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "cj" and k[1:3].isdigit()}
_PLAIN = "trim(regexp_replace(strip_accents(lower(coalesce({0}, ''))), '[^a-z0-9]+', ' ', 'g'))"
_SPLIT = f"list_filter(string_split({_PLAIN}, ' '), lambda x: x <> '')"
ORACLE = {
    "c32_dictionary": f"""WITH s AS (SELECT 1000000000 + p_partkey AS term, {_PLAIN.format('p_name')} AS alias FROM part
          UNION ALL SELECT 2000000000000 + conv_id * 1000 + turn, array_to_string({_SPLIT.format('text')}[1:2], ' ') FROM conversations
          UNION ALL SELECT 3000000000000000 + item_id, array_to_string({_SPLIT.format('text')}[1:4], ' ') FROM benchmark),
        t AS (SELECT alias, min(term) AS term, len(string_split(alias, ' ')) AS n FROM s WHERE alias <> '' GROUP BY alias),
        d AS (SELECT doc_id, {_SPLIT.format('text')} AS w FROM documents),
        g AS (SELECT doc_id, i - 1 AS start, k AS n, array_to_string(w[i:i + k - 1], ' ') AS g FROM d, LATERAL (SELECT unnest(generate_series(1, len(w))) AS i) a, LATERAL (SELECT unnest((SELECT list(DISTINCT n) FROM t)) AS k) b WHERE i + k - 1 <= len(w)),
        m AS (SELECT doc_id, start, g.n, term FROM g JOIN t ON g.g = t.alias AND g.n = t.n),
        o AS (SELECT doc_id, start, max(n) AS n, arg_max(term, n) AS term FROM m GROUP BY ALL),
        f AS (SELECT doc_id, list_reduce(list([start::BIGINT, n::BIGINT, term::BIGINT, 0] ORDER BY start), lambda a, x: CASE WHEN x[1] >= a[1] THEN [x[1] + x[2], a[2] + 1, a[3] + x[2], a[4] + x[3]] ELSE a END, [0::BIGINT, 0, 0, 0]) AS r FROM o GROUP BY 1),
        e AS (SELECT doc_id, count(*) AS places, count(DISTINCT term) AS terms FROM m GROUP BY 1)
        SELECT doc_id, places, terms, r[2] AS taken, r[3] AS words, r[4] AS term_sum FROM e JOIN f USING (doc_id)""",
    "j06_translated": """WITH c AS (SELECT DISTINCT p_name, p_type, p_brand, 'photo of ' || reverse(p_name) || ' ' || lower(p_brand) AS said FROM part WHERE p_size > 25), e AS (SELECT DISTINCT p_name, p_type, p_brand FROM part)
        SELECT e.*, coalesce(said, p_name || ' ' || p_type || ' ' || p_brand) AS phrase, said IS NOT NULL AS from_cache FROM e LEFT JOIN c USING (p_name, p_type, p_brand)""",
    "j04_entities": r"""WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM conversations),
        x AS (SELECT conv_id, turn, i - 1 AS pos, w[i] AS raw, regexp_replace(w[i], '[.,;:!?]+$', '') AS word FROM w, LATERAL (SELECT unnest(generate_series(1, len(w))) AS i) s),
        k AS (SELECT * FROM x WHERE pos > 0 AND regexp_matches(word, '^\p{Lu}\p{Ll}')),
        f AS (SELECT *, CASE WHEN lag(pos) OVER o = pos - 1 AND NOT regexp_matches(lag(raw) OVER o, '[.,;:!?]$') THEN 0 ELSE 1 END AS fresh FROM k WINDOW o AS (PARTITION BY conv_id, turn ORDER BY pos)),
        r AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM f),
        e AS (SELECT conv_id, turn, min(pos) AS start, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS entity FROM r GROUP BY conv_id, turn, run)
        SELECT conv_id, entity, count(*) AS mentions, count(DISTINCT turn) AS turns, min(turn)::BIGINT AS turn, arg_min(start, (turn, start))::BIGINT AS start, arg_min(n, (turn, start))::BIGINT AS n FROM e GROUP BY ALL""",
}
