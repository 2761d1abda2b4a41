"""Provider listings through the data source: pushed filters, union of listings, sweeps that resume."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.plans.streams import scratch
from tessera.session import table
from tessera.sources import files
from tessera.sources.providers import register
from tessera.streaming import jobs

PAGE = 40
ORDER = ["archive", "museum", "stock"]


def _listed(spark, sf_dir):
    """Parts as items of three providers: all in the stock, large ones in the museum, red ones in the archive; pages of forty by key."""
    p = table(spark, sf_dir, "part")
    file = lambda h: F.struct(F.lit(h).alias("height"), F.concat_ws("/", F.lit("https://media.example"), F.col("p_partkey").cast("string"), F.lit(str(h))).alias("url"))
    low, high = F.array(file(360), file(720)), F.array(file(360), file(720), file(2160))
    item = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_type") != "LARGE", F.lower("p_type")).alias("license"), F.col("p_size").cast("double").alias("duration"), F.when(F.col("p_size") % 2 == 0, low).otherwise(high).alias("files")))
    rules = {"stock": F.lit(True), "museum": F.col("p_size") > 30, "archive": F.col("p_name").startswith("red")}
    rows = None
    for provider, rule in rules.items():
        one = p.filter(rule).select(F.lit(provider).alias("provider"), "p_partkey", item.alias("item"))
        rows = one if rows is None else rows.unionByName(one)
    # pages of a bounded number of items, by the range of keys
    return rows.withColumn("page", F.floor(F.col("p_partkey") / PAGE))


def _write(rows, folder):
    pages = rows.groupBy("provider", "page").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "item"))).alias("items"))
    name = F.concat(F.col("provider"), F.lit("/page-"), F.lpad(F.col("page").cast("string"), 6, "0"), F.lit(".json"))
    text = F.array_join(F.transform("items", lambda x: x["item"]), "\n")
    files.write_files(pages.select(name.alias("name"), text.cast("binary").alias("content")), folder).count()


def _source(spark, folder, stream=False, **options):
    register(spark)
    reader = (spark.readStream if stream else spark.read).format("providers").option("path", folder)
    return reader.options(**options).load()


def _uri(folder):
    return f"file://{folder}" if folder.startswith("/") else folder


def a21_provider_pages(spark, sf_dir):
    """Items of two providers with some licenses and lengths: the filters reach the source, pages of the third are not opened."""
    folder = _uri(scratch(spark, "providers"))
    _write(_listed(spark, sf_dir), folder)
    rows = _source(spark, folder).filter(F.col("provider").isin("museum", "stock") & F.col("license").isin("economy", "promo") & (F.col("duration") >= 20.0))
    return rows.groupBy("provider", "license").agg(F.count(F.lit(1)).alias("n"), F.sum("duration").alias("seconds"), F.max("height").cast("long").alias("height"))


def a22_ranked_union(spark, sf_dir):
    """All listings in order of precedence: an item comes from its first one, in the best file of at most 1080 lines, best five of
    each license by hints of the query, listing and id."""
    folder = _uri(scratch(spark, "providers"))
    _write(_listed(spark, sf_dir), folder)
    rows = _source(spark, folder, providers=",".join(ORDER), max_height="1080", **{"stock.max_height": "2160"})
    first = rows.groupBy("provider_id").agg(F.min(F.struct("listing", "page", "place", "title", "license", "height")).alias("r")).select("provider_id", "r.*")
    hint = 10 * F.col("title").contains("ring").cast("int") + F.col("title").contains("blue").cast("int")
    best = Window.partitionBy("license").orderBy(F.desc("hint"), "listing", "provider_id")
    ranked = first.withColumn("hint", hint.cast("long")).withColumn("rank", F.row_number().over(best).cast("long")).filter("rank <= 5")
    return ranked.select("license", "rank", "provider_id", F.col("listing").cast("long").alias("listing"), F.col("height").cast("long").alias("height"), "hint")


def a19_resumed_sweep(spark, sf_dir):
    """A sweep as a stream, run twice with one checkpoint: the first run sees the pages of even number, more are put, and the second run reads
    those that are newer than each provider's last; what it did not read stays away."""
    folder, out = _uri(scratch(spark, "providers")), scratch(spark, "swept")
    listed = _listed(spark, sf_dir)
    middle = F.col("page") < 3
    for run, rows in enumerate((listed.filter(middle & (F.col("page") % 2 == 0)), listed.filter(~middle | (F.col("page") % 2 == 1)))):
        _write(rows, folder)
        found = _source(spark, folder, stream=True).withColumn("run", F.lit(run).cast("long"))
        swept = jobs.drain(found, out)
    return swept.groupBy("provider", "run").agg(F.count(F.lit(1)).alias("n"), F.min("page").cast("long").alias("first_page"), F.sum("provider_id").alias("ids"))


QUERIES = {k: v for k, v in list(globals().items()) if k[0] == "a" and k[1:3].isdigit()}
_LISTED = f"""l AS (SELECT 'stock' AS provider, 2 AS listing, * FROM part UNION ALL SELECT 'museum', 1, * FROM part WHERE p_size > 30 UNION ALL SELECT 'archive', 0, * FROM part WHERE p_name LIKE 'red%'),
        i AS (SELECT *, lower(p_type) AS license, p_partkey // {PAGE} AS page, CASE WHEN p_size % 2 = 0 THEN 720 ELSE 2160 END AS height FROM l WHERE p_type <> 'LARGE')"""
ORACLE = {
    "a21_provider_pages": f"""WITH {_LISTED} SELECT provider, license, count(*) AS n, sum(p_size)::DOUBLE AS seconds, max(height)::BIGINT AS height FROM i
        WHERE provider IN ('museum', 'stock') AND license IN ('economy', 'promo') AND p_size >= 20 GROUP BY ALL""",
    "a22_ranked_union": f"""WITH {_LISTED}, f AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY listing) AS k FROM i),
        r AS (SELECT *, 10 * (p_name LIKE '%ring%')::INT + (p_name LIKE '%blue%')::INT AS hint FROM f WHERE k = 1),
        s AS (SELECT *, row_number() OVER (PARTITION BY license ORDER BY hint DESC, listing, p_partkey) AS rank FROM r)
        SELECT license, rank, p_partkey AS provider_id, listing::BIGINT AS listing, CASE WHEN listing < 2 THEN 720 ELSE height END::BIGINT AS height, hint::BIGINT AS hint FROM s WHERE rank <= 5""",
    "a19_resumed_sweep": f"""WITH {_LISTED}, a AS (SELECT *, page < 3 AND page % 2 = 0 AS early FROM i),
        b AS (SELECT l.provider, max(l.p_partkey // {PAGE}) AS last FROM l WHERE l.p_partkey // {PAGE} < 3 AND (l.p_partkey // {PAGE}) % 2 = 0 GROUP BY 1),
        r AS (SELECT a.*, CASE WHEN early THEN 0 WHEN page > coalesce(last, -1) THEN 1 END AS run FROM a LEFT JOIN b USING (provider))
        SELECT provider, run::BIGINT AS run, count(*) AS n, min(page)::BIGINT AS first_page, CAST(sum(p_partkey) AS BIGINT) AS ids FROM r WHERE run IS NOT NULL GROUP BY ALL""",
}
