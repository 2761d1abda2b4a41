"""Texts read by their structure: balanced objects, pieces under a limit, phrases of capitals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import jsontext, text
from tessera.session import table

JOINS = ["de", "do", "of", "the"]


def h42_balanced_objects(spark, sf_dir):
    """Payloads of events with braces in a string, told twice among remarks with a stray brace: objects found, and the sum of their fields."""
    note = F.concat(F.lit('{"note": "a } and { inside", "k": '), F.get_json_object("props", "$.k"), F.lit("}"))
    raw = F.concat(F.lit('model said "ok: '), "props", F.lit(" then\n"), note, F.when(F.col("event_type") == "error", F.lit(' {"cut": {"k": 1}')).otherwise(F.lit(" done }")))
    found = table(spark, sf_dir, "events").select("event_type", "props", jsontext.objects(raw).alias("o"), jsontext.first_valid(raw).alias("first"))
    k = lambda o: F.get_json_object(o, "$.k").cast("long")
    each = found.select("event_type", F.size("o").alias("n"), k(F.get("o", F.lit(0))).alias("a"), k(F.get("o", F.lit(1))).alias("b"), (F.col("first") == F.col("props")).alias("same"))
    return each.groupBy("event_type").agg(F.sum("n").alias("objects"), F.sum("a").alias("first_k"), F.sum("b").alias("second_k"), F.count_if("same").alias("same"))


def h20_pieces(spark, sf_dir):
    """Whole documents cut to pieces of at most 300 characters: that the pieces make up the text, how long the longest is, and their characters."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"), text.split_within(F.col("text"), 300).alias("p"))
    longest = F.coalesce(F.array_max(F.transform("p", lambda x: F.length(x))), F.lit(0)) <= 300
    fewest = F.size("p") >= F.ceil(F.length("t") / 300)
    return d.select("doc_id", (F.array_join("p", "") == F.col("t")).alias("whole"), longest.alias("within"), fewest.alias("enough"), F.aggregate("p", F.lit(0), lambda n, x: n + F.length(x)).cast("long").alias("chars"))


def h18_phrases(spark, sf_dir):
    """Phrases of capitalised words in each turn, with the small words that join them."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.capital_phrases(F.col("text"), JOINS).alias("p"))
    return c.select("conv_id", "turn", F.size("p").cast("long").alias("n"), F.array_join(F.array_sort("p"), "|").alias("phrases"))


QUERIES = {k: v for k, v in list(globals().items()) if k[0] == "h" and k[1:3].isdigit()}
_WORD = r"\p{Lu}[\p{L}\p{N}''-]*"
ORACLE = {
    "h42_balanced_objects": """WITH e AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
        SELECT event_type, 2 * count(*) AS objects, CAST(sum(k) AS BIGINT) AS first_k, CAST(sum(k) AS BIGINT) AS second_k, count(*) AS same FROM e GROUP BY 1""",
    "h20_pieces": "SELECT doc_id, true AS whole, true AS within, true AS enough, length(coalesce(text, '')) AS chars FROM documents",
    "h18_phrases": f"""SELECT conv_id, turn, CAST(len(p) AS BIGINT) AS n, array_to_string(list_sort(p), '|') AS phrases FROM
        (SELECT conv_id, turn, list_distinct(regexp_extract_all(text, '({_WORD}(?:[ ](?:(?:{"|".join(JOINS)})[ ])*{_WORD})*)', 1)) AS p FROM conversations)""",
}
