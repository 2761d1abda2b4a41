"""Vector retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.neighbours import knn_join
from tessera.operators.vector import prefiltered_topk
from tessera.plans.streams import scratch
from tessera.session import table


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors of label 3 nearest (cosine) to vector 0."""
    emb = table(spark, sf_dir, "embeddings")
    found = emb.filter("vec_id = 0").select("embedding").first()
    query = [float(x) for x in found[0] or []] if found else []  # without the query vector nothing is near
    return prefiltered_topk(emb, query, k=10, where="label = 3", id_col="vec_id").select(
        "vec_id", F.round("score", 6).alias("score")
    )


def c01_neighbour_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors nearest to each vector whose id is divisible by 100, itself left out."""
    emb = table(spark, sf_dir, "embeddings")
    rows, _ = knn_join(emb.filter("vec_id % 100 = 0"), emb, "vec_id", "embedding", 11, scratch(spark, "neighbours"))
    rows = rows.filter("query <> id").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("rank")).cast("long")).filter("rank <= 10")
    return rows.select("query", "rank", "id", F.round("cosine", 6).alias("cosine"))


def c01_pruned_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the neighbour join computed no more cosines than there are, and how many there are."""
    emb = table(spark, sf_dir, "embeddings")
    _, work = knn_join(emb.filter("vec_id % 100 = 0"), emb, "vec_id", "embedding", 11, scratch(spark, "neighbours"))
    return work.select("all_pairs", (F.col("pairs") <= F.col("all_pairs")).alias("within"))


QUERIES = {"vector_topk": vector_topk, "c01_neighbour_join": c01_neighbour_join, "c01_pruned_share": c01_pruned_share}
ORACLE = {
    "vector_topk": """
        SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
        FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
        WHERE e.label = 3 ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, vec_id LIMIT 10""",
    "c01_neighbour_join": """
        WITH p AS (SELECT q.vec_id AS query, e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS c FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id)
        SELECT query, rank, id, round(c, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, id) AS rank FROM p) WHERE rank <= 10""",
    "c01_pruned_share": "SELECT count(*) FILTER (vec_id % 100 = 0) * count(*) AS all_pairs, true AS within FROM embeddings",
}
