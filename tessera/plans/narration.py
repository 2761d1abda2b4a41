"""Captions as files, scene bounds, chapter triggers and query plans of narrations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators.sequences import shares_to_bounds
from tessera.plans.solvers import _words
from tessera.plans.streams import scratch
from tessera.session import table
from tessera.solvers import narration as N
from tessera.sources import sinks


def _turn_cues(spark, sf_dir):
    """A cue for each turn of a conversation: its first 42 characters, timed by length."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("cue"), F.substring(text.inline(F.col("text")), 1, 42).alias("line"), (F.length("text") + 20).alias("n"))
    timed = shares_to_bounds(c, ["conv_id"], ["cue"], "n", F.lit(60.0))
    return timed.select("conv_id", "cue", F.col("b_start").alias("start"), F.col("b_end").alias("end"), "line")


def _files(spark, folder, kind):
    whole = spark.read.text(folder, wholetext=True)
    return whole.select("conv_id", F.lit(kind).alias("kind"), F.sha2(F.col("value").cast("binary"), 256).alias("sha"), F.length("value").cast("long").alias("chars"))


def a34_captions(spark, sf_dir):
    """SRT files of all conversations, one each, read back: digest and length of each file's content."""
    folder = scratch(spark, "captions")
    sinks.write_captions(_turn_cues(spark, sf_dir), folder, "conv_id")
    return _files(spark, folder, "srt")


def a35_caption_formats(spark, sf_dir):
    """The same as WebVTT, with its header."""
    folder = scratch(spark, "captions")
    sinks.write_captions(_turn_cues(spark, sf_dir), folder, "conv_id", "vtt")
    return _files(spark, folder, "vtt")


def e07_two_line_cues(spark, sf_dir):
    """Cues of two lines from each turn's timed words, overlaps split in the middle."""
    return N.captions(_words(spark, sf_dir), "turn_id").select("turn_id", "cue", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "line")


def c17_scene_bounds(spark, sf_dir):
    """Bounds of scenes, three for each turn, by silences or by terms met in the timed words."""
    words = _words(spark, sf_dir).withColumn("word", text.squeezed(F.col("word")))
    n = words.groupBy("turn_id").agg(F.max("i").alias("last"))
    scenes = words.join(n, "turn_id").withColumn("scene", F.floor(F.col("i") * 3 / (F.col("last") + 1)).cast("long"))
    scenes = scenes.groupBy("turn_id", "scene").agg(F.array_sort(F.collect_set(F.when(F.length("word") >= 7, F.col("word")))).alias("terms")).withColumn("length", F.lit(60.0))
    silences = words.filter((F.col("turn_id") % 2 == 0) & (F.length("word") <= 2)).withColumn("r", F.row_number().over(Window.partitionBy("turn_id").orderBy("i"))).filter("r <= 3")
    return N.scene_bounds(scenes, words, silences.select("turn_id", F.col("start").alias("s_start"), F.col("end").alias("s_end")), "turn_id")


def e26_chapter_triggers(spark, sf_dir):
    """Chapter triggers at the quarters of each turn: the words around the first one there, whether they hold a cue, confidence."""
    w = _words(spark, sf_dir).withColumn("at", F.floor(F.col("i") / 4))
    series = w.groupBy("turn_id").agg(F.array_sort(F.collect_list(F.struct("i", "word", "start"))).alias("w"))
    rows = series.select("turn_id", "w", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("scene")).withColumn("t", F.col("scene") * 15.0)
    # a turn's words come in order of their start, so the first one is found by counting those before
    at = F.size(F.filter("w", lambda x: x["start"] < F.greatest(F.lit(0.0), F.col("t") - 0.25)))
    rows = rows.withColumn("at", at).filter(F.col("at") < F.size("w"))
    begin = F.greatest(F.col("at") - 3, F.lit(0))
    cue = F.array_join(F.transform(F.slice("w", begin + 1, F.col("at") + 4 - begin), lambda x: x["word"]), " ")
    rows = rows.withColumn("cue_text", cue).withColumn("cue", F.col("cue_text").rlike("(?i)\\b(and|but|then|now|so|also)\\b"))
    confidence = F.greatest(F.lit(0.35), F.when(F.col("cue"), 0.85).otherwise(0.55))
    return rows.select("turn_id", F.col("scene").cast("long").alias("scene"), F.get("w", F.col("at"))["word"].alias("anchor"), "cue_text", "cue", confidence.alias("confidence"))


def _sentences(spark, sf_dir):
    """Sentences of each turn, timed by length, with a pause after questions; the role's first capitalised word is their entity."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), F.posexplode(text.sentences(F.col("text"))).alias("n", "s"))
    timed = shares_to_bounds(c.withColumn("w", F.length("s") + 1), ["turn_id"], ["n"], "w", F.lit(60.0))
    entity = F.regexp_extract("s", "^([A-Z][a-z]+)", 1)
    return timed.select("turn_id", F.col("n").cast("long").alias("n"), (F.col("b_start") + F.when(F.col("n") % 3 == 1, 0.5).otherwise(0.0)).alias("start"), F.col("b_end").alias("end"), F.nullif(entity, F.lit("")).alias("entity"), (F.length(entity) > 5).alias("strict"))


def e03_scenes(spark, sf_dir):
    """Scenes of each turn's sentences, closed by pauses, length and changes of a strict entity."""
    return N.sessions(_sentences(spark, sf_dir), "turn_id")


def e03_spans(spark, sf_dir):
    """The bounds of the scenes of each turn in order: scenes, sentences and length of all."""
    rows = N.sessions(_sentences(spark, sf_dir), "turn_id")
    return rows.groupBy("turn_id").agg(F.sum("sentences").alias("sentences"), F.round(F.min("start"), 2).alias("first"), F.round(F.max("end"), 2).alias("last"))


#: The English words of each kind of entity.
KIND_WORDS = {
    "food": "food dish meal",
    "landmark": "landmark monument building",
    "building": "building architecture",
    "place": "city region area",
    "attraction": "tourist attraction sight",
    "other_visual": "scene",
}


def query_plan(name, kind, place, features, home="Portugal"):
    """At most four queries from the most specific to the most general, distinct whatever their case: the name with kind and
    two features, with its place, with its country, and the place with the kind. None without a name."""
    words = F.coalesce(F.create_map(*[F.lit(x) for pair in KIND_WORDS.items() for x in pair])[F.lower(F.coalesce(kind, F.lit("")))], F.lit("scene"))
    name, place = F.trim(F.coalesce(name, F.lit(""))), F.trim(F.coalesce(place, F.lit("")))
    joined = lambda *parts: F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " ")
    queries = F.array(
        joined(name, words, F.array_join(F.slice(F.coalesce(features, F.expr("cast(array() as array<string>)")), 1, 2), " ")),
        F.when(place != "", joined(name, place, words)),
        joined(name, F.lit(home)),
        joined(F.when(place != "", place).otherwise(home), words),
    )
    kept = F.filter(F.array_compact(queries), lambda q: q != "")
    first = F.filter(kept, lambda q, i: F.array_position(F.transform(kept, F.lower), F.lower(q)) == i + 1)
    return F.when(name != "", first).otherwise(F.expr("cast(array() as array<string>)"))


def f15_query_plans(spark, sf_dir):
    """Query plans of parts: type as kind, brand as place, the name's words as features."""
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_type") == "ECONOMY", "food").when(F.col("p_type") == "PROMO", "Landmark").when(F.col("p_type") == "STANDARD", "place")
    place = F.when(F.col("p_size") > 25, F.col("p_brand"))
    q = query_plan(F.col("p_name"), kind, place, F.when(F.col("p_size") % 2 == 0, F.split("p_name", " ")))
    return p.select("p_partkey", F.array_join(q, "|").alias("queries"), F.size(q).cast("long").alias("n"))


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "acef" and k[1:3].isdigit()}
_STAMP = "format('{{:02d}}:{{:02d}}:{{:02d}}{1}{{:03d}}', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"
_CUES = """WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'))[1:42] AS line, length(text) + 20 AS n FROM conversations),
    b AS (SELECT conv_id, turn, line, row_number() OVER w AS k, 60.0::DOUBLE * (sum(n) OVER w - n) / sum(n) OVER p AS s, 60.0::DOUBLE * sum(n) OVER w / sum(n) OVER p AS e
          FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY conv_id)),
    m AS (SELECT *, CAST(round(s * 1000) AS BIGINT) AS sm, CAST(round(e * 1000) AS BIGINT) AS em FROM b)
"""
_SENT = "list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')"
ORACLE = {
    "a34_captions": _CUES + f""", f AS (SELECT conv_id, string_agg(k || chr(10) || {_STAMP.format('sm', ',')} || ' --> ' || {_STAMP.format('em', ',')} || chr(10) || line || chr(10), chr(10) ORDER BY turn) AS f FROM m GROUP BY 1)
        SELECT conv_id, 'srt' AS kind, sha256(f) AS sha, length(f) AS chars FROM f""",
    "a35_caption_formats": _CUES + f""", f AS (SELECT conv_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({_STAMP.format('sm', '.')} || ' --> ' || {_STAMP.format('em', '.')} || chr(10) || line || chr(10), chr(10) ORDER BY turn) AS f FROM m GROUP BY 1)
        SELECT conv_id, 'vtt' AS kind, sha256(f) AS sha, length(f) AS chars FROM f""",
    "e26_chapter_triggers": """WITH w0 AS (SELECT conv_id * 1000 + turn AS turn_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\r\\n]+'), lambda x: x <> '') AS w FROM conversations),
        w1 AS (SELECT turn_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w0),
        w AS (SELECT turn_id, word, i, 60.0::DOUBLE * (sum(length(word)) OVER o - length(word)) / sum(length(word)) OVER p AS start FROM w1 WINDOW o AS (PARTITION BY turn_id ORDER BY i ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY turn_id)),
        t AS (SELECT turn_id, scene, min(i) AS at FROM w, (VALUES (1), (2), (3)) v(scene) WHERE start >= scene * 15.0::DOUBLE - 0.25::DOUBLE GROUP BY 1, 2),
        c AS (SELECT t.turn_id, t.scene, any_value(w.word) FILTER (w.i = t.at) AS anchor, string_agg(w.word, ' ' ORDER BY w.i) AS cue_text FROM t JOIN w ON w.turn_id = t.turn_id AND w.i BETWEEN t.at - 3 AND t.at + 3 GROUP BY 1, 2)
        SELECT turn_id, CAST(scene AS BIGINT) AS scene, anchor, cue_text, regexp_matches(cue_text, '(?i)\\b(and|but|then|now|so|also)\\b') AS cue,
          CASE WHEN regexp_matches(cue_text, '(?i)\\b(and|but|then|now|so|also)\\b') THEN 0.85::DOUBLE ELSE 0.55::DOUBLE END AS confidence FROM c""",
    "e03_spans": f"""WITH s AS (SELECT conv_id * 1000 + turn AS turn_id, {_SENT.format("text")} AS s FROM conversations)
        SELECT turn_id, len(s) AS sentences, 0.0::DOUBLE AS first, 60.0::DOUBLE AS last FROM s WHERE len(s) > 0""",
    "f15_query_plans": """WITH p AS (SELECT p_partkey, p_name AS n, CASE p_type WHEN 'ECONOMY' THEN 'food dish meal' WHEN 'PROMO' THEN 'landmark monument building' WHEN 'STANDARD' THEN 'city region area' ELSE 'scene' END AS k,
          CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS b, CASE WHEN p_size % 2 = 0 THEN array_to_string(string_split(p_name, ' ')[1:2], ' ') ELSE '' END AS f FROM part),
        q AS (SELECT p_partkey, list_filter([trim(n || ' ' || k || ' ' || f), CASE WHEN b <> '' THEN n || ' ' || b || ' ' || k END, n || ' Portugal', CASE WHEN b <> '' THEN b ELSE 'Portugal' END || ' ' || k], lambda x: x IS NOT NULL) AS q FROM p)
        SELECT p_partkey, array_to_string(q, '|') AS queries, len(q) AS n FROM q""",
}
