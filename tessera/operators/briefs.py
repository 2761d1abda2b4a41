"""Visual briefs of scenes by ordered rules: from the entity that a scene names, else from the words of its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a text that speak of food and of monuments.
FOOD = ["pastel", "pastéis", "receita", "doce", "comida", "prato", "sabor", "comer", "bacalhau", "nata", "restaurante", "gastronomia", "café"]
MONUMENTS = ["mosteiro", "monumento", "torre", "igreja", "castelo", "palácio", "catedral", "muralha", "livraria", "ponte"]
#: Mood of an entity's kind, and what is shown of a scene without one: subject, what it must have and must not, kind of shot.
MOODS = {"landmark": "referência cultural", "food": "gastronomia local"}
OTHER_MOOD, OTHER_KIND = "ambiente local", "other_visual"
GENERAL = {
    "food": ("close-up of traditional portuguese food dish", ["food"], ["landmark"], "close-up"),
    "monument": ("wide shot of historic portuguese monument", ["landmark"], ["food"], "wide"),
    "street": ("cinematic street scene in Porto portugal", [], [], "medium"),
}
CLOSE = ["food", "landmark"]


def says(text: Column, words: list[str]) -> Column:
    """Whether a text has one of the words, case ignored; a null text has none."""
    return F.coalesce(text.rlike("(?iU)\\b(?:" + "|".join(words) + ")\\b"), F.lit(False))


def _terms(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.expr("cast(array() as array<string>)")


def briefs(scenes: DataFrame, video: str, scene: str) -> DataFrame:
    """(video, scene, subject, must_have, must_not, shot, mood, entity, kind, strict, location) for scenes with entity, kind, strict, location, text.

    A named entity is the subject, and its kind decides the shot; a scene without one goes by its text, food or monuments, if it speaks of just one of these. A scene
    without a location takes that of the nearest scene before it in the video. Blank entities and locations count as missing.
    """
    filled = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    before = Window.partitionBy(video).orderBy(scene).rowsBetween(Window.unboundedPreceding, 0)
    named, kind = filled("entity"), F.coalesce(filled("kind"), F.lit(OTHER_KIND))
    food, monument = says(F.col("text"), FOOD), says(F.col("text"), MONUMENTS)
    general = F.when(food & ~monument, "food").when(monument & ~food, "monument").otherwise("street")
    rows = scenes.withColumns({"named__": named, "kind__": kind, "general__": general, "location__": F.last(filled("location"), ignorenulls=True).over(before)})
    own = F.col("named__").isNotNull()

    def of(place: int, wrap) -> Column:
        out = wrap(GENERAL["street"][place])
        for name in ("food", "monument"):
            out = F.when(F.col("general__") == name, wrap(GENERAL[name][place])).otherwise(out)
        return out

    mood = F.coalesce(*[F.when(F.col("kind__") == k, F.lit(m)) for k, m in MOODS.items()], F.lit(OTHER_MOOD))
    return rows.select(
        video,
        scene,
        F.when(own, F.concat(F.lit("close-up cinematic shot of "), "named__", F.lit(" in Porto Portugal"))).otherwise(of(0, F.lit)).alias("subject"),
        F.when(own, F.array("kind__")).otherwise(of(1, _terms)).alias("must_have"),
        F.when(own & (F.col("kind__") == "landmark"), _terms(["people"])).when(own, _terms([])).otherwise(of(2, _terms)).alias("must_not"),
        F.when(own, F.when(F.col("kind__").isin(CLOSE), "close-up").otherwise("medium")).otherwise(of(3, F.lit)).alias("shot"),
        F.when(own, mood).otherwise("").alias("mood"),
        F.coalesce("named__", F.lit("")).alias("entity"),
        F.when(own, F.col("kind__")).otherwise("").alias("kind"),
        (own & F.coalesce("strict", F.lit(False))).alias("strict"),
        F.coalesce("location__", F.lit("")).alias("location"),
    )
