"""Alignment of segments with what their scenes ask for: violations as rows, from joins and one list of rules a segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import contains_words

#: Kinds of entities that stand in each metadata column, and the kinds of violations with their severity.
COLUMNS_OF = {"food": ["foods"], "landmark": ["landmarks", "places"], "building": ["landmarks", "places"], "attraction": ["landmarks", "places"]}
METADATA = ["places", "landmarks", "foods"]
SEVERITY = {
    "segment_crosses_entity_boundary": "strict",
    "wrong_food_entity": "strict",
    "wrong_landmark_entity": "strict",
    "generic_for_strict_entity": "strict",
    "missing_required_entity": "strict",
    "unconfirmed_entity": "warning",
    "entity_coverage_gap": "warning",
}


def has_entity(entity: Column, kind: Column) -> Column:
    """Whether a segment's metadata name the entity, in the columns that its kind may stand in (any for other kinds)."""
    held = {c: F.coalesce(contains_words(F.col(c), entity), F.lit(False)) for c in METADATA}
    found = F.lit(None).cast("boolean")
    for k, columns in COLUMNS_OF.items():
        some = F.lit(False)
        for c in columns:
            some = some | held[c]
        found = F.coalesce(F.when(kind == k, some), found)
    return F.coalesce(found, held["places"] | held["landmarks"] | held["foods"])


def crossed(segments: DataFrame, spans: DataFrame, least: float) -> DataFrame:
    """(scene, seg, crossed): the distinct strict entities, sorted, whose spans of the same video overlap a segment by over ``least`` seconds.

    Spans meet segments in the time slots that both touch, so the join is by equality; a slot is as long as the mean segment, or so.
    """
    slot = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / SLOT), F.floor(F.col(b) / SLOT))).alias("slot")
    a = segments.select("video", "scene", "seg", "t_in", "t_out", slot("t_in", "t_out"))
    b = spans.filter("strict").select("video", F.lower(F.trim("entity")).alias("name"), F.col("t_in").alias("s_in"), F.col("t_out").alias("s_out"), slot("t_in", "t_out"))
    over = F.least("t_out", "s_out") - F.greatest("t_in", "s_in")
    met = a.join(b, ["video", "slot"]).filter(over > least)
    return met.groupBy("scene", "seg").agg(F.array_sort(F.collect_set("name")).alias("crossed"))


#: Seconds of a time slot.
SLOT = 10.0


def violations(segments: DataFrame, briefs: DataFrame, spans: DataFrame, coverage: DataFrame | None = None, least: float = 0.5, promote: bool = False) -> DataFrame:
    """(scene, seg, violation, severity, expected) of all segments of scenes that must show an entity, and of the plan's gaps.

    ``segments``: video, scene, seg, t_in, t_out, places, landmarks, foods, confirmed. ``briefs``: scene, entity, kind, strict; scenes without
    a brief, without an entity or not strict have no violations. ``spans``: video, entity, t_in, t_out, strict. ``coverage``: entity, strict, deficit.
    A segment may break several rules: it crosses from one strict entity into another, its metadata lack the entity (wrong food or landmark by the
    entity's kind; without any metadata generic, else missing), and nobody confirmed it, a warning unless ``promote``.
    """
    asked = briefs.filter("strict AND entity <> ''").select("scene", "entity", "kind")
    rows = segments.join(asked, "scene").join(crossed(segments, spans, least), ["scene", "seg"], "left")
    nothing = F.lit(True)
    for c in METADATA:
        nothing = nothing & (F.trim(F.coalesce(c, F.lit(""))) == "")
    lacking = (
        F.when(F.col("kind") == "food", "wrong_food_entity")
        .when(F.col("kind").isin("landmark", "building", "attraction"), "wrong_landmark_entity")
        .when(nothing, "generic_for_strict_entity")
        .otherwise("missing_required_entity")
    )
    rule = lambda broken, name, expected: F.when(broken, F.struct(name.alias("violation"), expected.alias("expected")))
    found = F.array(
        rule(F.size("crossed") > 1, F.lit("segment_crosses_entity_boundary"), F.array_join("crossed", ",")),
        rule(~has_entity(F.col("entity"), F.col("kind")), lacking, F.col("entity")),
        rule(~F.coalesce("confirmed", F.lit(False)), F.lit("unconfirmed_entity"), F.col("entity")),
    )
    out = rows.select("scene", "seg", F.inline(F.array_compact(found)))
    if coverage is not None:
        gap = coverage.filter("strict AND deficit > 0")
        out = out.unionByName(gap.select(F.lit(None).cast(segments.schema["scene"].dataType).alias("scene"), F.lit(-1).cast(segments.schema["seg"].dataType).alias("seg"), F.lit("entity_coverage_gap").alias("violation"), F.col("entity").alias("expected")))
    level = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])[F.col("violation")]
    if promote:
        level = F.when(F.col("violation") == "unconfirmed_entity", "strict").otherwise(level)
    return out.withColumn("severity", level)
