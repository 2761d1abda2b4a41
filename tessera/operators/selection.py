"""Scores and hard rules of candidates for a scene, each as one list of terms over joined columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of a candidate's score.
WEIGHTS = {"similarity": 1.0, "quality": 0.02, "usage": 0.15, "source": 0.10, "landmark": 0.20, "place": 0.15, "missed": 0.10, "confirmed": 0.15, "geography": 0.30}
#: Sources of evidence that a critical moment does not take, states of truth that it does, and the category of sights.
WEAK_SOURCE, FIRM_STATES, SIGHTS = "metadata_fallback", ["exact", "regional"], "city_landmark"


def names_any(text: Column, terms: Column) -> Column:
    """Whether a text holds one of the terms, case ignored; blank terms and null texts hold nothing."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(F.exists(terms, lambda t: (F.trim(t) != "") & F.contains(low, F.lower(F.trim(t)))), F.lit(False))


def entity_score(weights: dict[str, float] = WEIGHTS) -> Column:
    """The score of a candidate row: similarity, quality, uses (by other videos), source_uses (of its file in this one), places, landmarks, confirmed,
    entities and excluded (arrays of terms). A scene that asks for an entity adds for it in the landmarks, else in the places, else takes off."""
    w = weights
    asked = F.coalesce(F.exists("entities", lambda t: F.trim(t) != ""), F.lit(False))
    entity = F.when(~asked, 0.0).when(names_any(F.col("landmarks"), F.col("entities")), w["landmark"]).when(names_any(F.col("places"), F.col("entities")), w["place"]).otherwise(-w["missed"])
    elsewhere = names_any(F.concat_ws(",", "places", "landmarks"), F.col("excluded"))
    flag = lambda c, x: F.when(c, x).otherwise(0.0)
    known = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        w["similarity"] * F.col("similarity") + w["quality"] * F.col("quality") - w["usage"] * known("uses") - w["source"] * known("source_uses")
        + entity + flag(F.coalesce("confirmed", F.lit(False)), w["confirmed"]) - flag(elsewhere, w["geography"])
    )


def broken_rules() -> Column:
    """Names of the rules that a candidate (source, categories, confidence, truth) breaks for its moment (critical, forbidden, least, takes_sights), as an array.

    Texts are compared without case and outer spaces; a missing least confidence is 0.6, a missing confidence 0.
    """
    clean = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    cleaned = lambda c: F.transform(F.coalesce(F.col(c), F.expr("cast(array() as array<string>)")), lambda x: F.lower(F.trim(x)))
    critical = F.coalesce("critical", F.lit(False))
    rules = {
        "weak_source": critical & (clean("source") == WEAK_SOURCE),
        "forbidden_category": F.arrays_overlap(cleaned("categories"), cleaned("forbidden")),
        "sight_not_taken": ~F.coalesce("takes_sights", F.lit(True)) & F.array_contains(cleaned("categories"), SIGHTS),
        "low_confidence": critical & (F.coalesce("confidence", F.lit(0.0)) < F.coalesce("least", F.lit(0.6))),
        "truth_not_firm": critical & ~clean("truth").isin(FIRM_STATES),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))


def by_contract(candidates: DataFrame, moments: DataFrame, key: str) -> DataFrame:
    """The candidates with ``broken``, the rules that they break for the moment of their ``key``; without a moment none."""
    return candidates.join(moments, key, "left").withColumn("broken", broken_rules()).select(*candidates.columns, "broken")
