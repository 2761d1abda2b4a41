"""Decisions and blends over evidence columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.scoring import clamp

#: Least confidence of a shot that other evidence may confirm, and how many independent families that takes.
FLOOR, FAMILIES = 0.70, 2


def confirmation(confidence: Column, families: Column, refused: Column, failed: Column, least: float = 0.85) -> Column:
    """confirmed, corroborated (between FLOOR and ``least`` with FAMILIES distinct families), retry (the check itself failed) or rejected."""
    enough = F.size(F.array_distinct(F.coalesce(families, F.expr("cast(array() as array<string>)")))) >= FAMILIES
    sure = ~F.coalesce(refused, F.lit(False)) & confidence.isNotNull()
    return (
        F.when(sure & (confidence >= least), "confirmed")
        .when(sure & (confidence >= FLOOR) & enough, "corroborated")
        .when(F.coalesce(failed, F.lit(False)), "retry")
        .otherwise("rejected")
    )


def window_score(safe: Column, need: Column, found: Column, wanted: Column, confidence: Column, length: Column, target: Column) -> Column:
    """0.58 need + 0.24 share of the wanted actions found (0.5 if none is wanted) + 0.12 confidence + 0.06 fit of the length; -1 if unsafe."""
    actions = F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, found)) / F.size(wanted)).otherwise(0.5)
    aim = F.greatest(target, F.lit(0.1))
    fit = F.greatest(F.lit(0.0), 1 - F.abs(F.greatest(length, F.lit(0.1)) - aim) / F.greatest(aim, F.lit(1.0)))
    blend = 0.58 * need + 0.24 * actions + 0.12 * F.coalesce(confidence, F.lit(0.0)) + 0.06 * fit
    return F.when(safe, F.round(blend, 3)).otherwise(-1.0)


def block_match(expected: Column, city: Column, neutral: Column) -> Column:
    """How a candidate's city fits a block's: 1 the same, 0.45 neutral without one, else 0; without an expected city 0.85
    neutral, 0.65 without a city, 0.45 otherwise."""
    none = lambda c: F.coalesce(c, F.lit("")) == ""
    free = F.when(neutral, 0.85).when(none(city), 0.65).otherwise(0.45)
    bound = F.when(F.lower(city) == F.lower(expected), 1.0).when(none(city) & neutral, 0.45).otherwise(0.0)
    return F.when(none(expected), free).otherwise(bound)


def entity_match(same_city: Column, shared: Column, near: Column, overlap: Column) -> Column:
    """0.55 for the city, 0.45 for a shared landmark or 0.25 for one of the same city, 0.05 for each shared term up to 0.25."""
    marks = F.when(shared > 0, 0.45).when(near, 0.25).otherwise(0.0)
    return clamp(F.when(same_city, 0.55).otherwise(0.0) + marks + F.least(F.lit(0.25), overlap * 0.05))


def specificity(city: Column, landmarks: Column, place: Column, tags: Column, on_theme: Column) -> Column:
    """How special a candidate is: 0.25, and more for a city, landmarks, a kind of place, four tags or more, words of the theme."""
    score = F.lit(0.25)
    for condition, gain in (
        (F.coalesce(city, F.lit("")) != "", 0.25),
        (landmarks > 0, 0.2),
        (~F.coalesce(place, F.lit("")).isin("", "general"), 0.15),
        (tags >= 4, 0.1),
        (on_theme, 0.15),
    ):
        score = score + F.when(condition, gain).otherwise(0.0)
    return clamp(score)


#: What a text asks to see, by the first pattern that occurs, and the roles it may play.
NEEDS = [
    ("market_stall", "(?i)(mercado|market|banca|stall|feira|food hall)", "proof_exact,context_regional"),
    ("vendor_interaction", "(?i)(vendedor|vendor|atendente|atendimento|servindo|servir)", "proof_exact,detail_cutaway"),
    ("people_eating", "(?i)(pessoas comendo|people eating|a comer|degustando|tasting)", "proof_exact,detail_cutaway"),
    ("pastry_closeup", "(?i)(doces|pastel|pastry|sobremesa|dessert|confeitaria|bakery)", "proof_exact,detail_cutaway"),
    ("food_closeup", "(?i)(comida|food|prato|dish|ingrediente|fresco|fresh produce)", "proof_exact,detail_cutaway"),
    ("wine_pouring", "(?i)(vinho|wine|taça|glass|pour|pouring|brinde|toasting)", "proof_exact,closing_payoff"),
    ("restaurant_table", "(?i)(restaurante|restaurant|mesa|table|cafe|coffee shop)", "proof_exact,detail_cutaway"),
    ("street_level", "(?i)(rua|street|bairro|centro|downtown|walking)", "context_regional,opening_establishing"),
    ("landmark", "(?i)(ponte|bridge|torre|tower|rio|river|catedral|palacio|palace|landmark)", "opening_establishing,context_regional"),
]
FOOD_INTENTS = ("gastronomy", "market", "pastry", "restaurant", "cafe", "street_food")


def visual_need(text: Column, intent: Column) -> Column:
    """(need, roles) of a text: the first of NEEDS that occurs, else by the intent, else the street."""
    pair = lambda need, roles: F.struct(F.lit(need).alias("need"), F.lit(roles).alias("roles"))
    rules = [F.when(F.concat_ws(" ", text, intent).rlike(p), pair(n, r)) for n, p, r in NEEDS]
    low = F.lower(intent)
    by_intent = F.when(low.isin(*FOOD_INTENTS), pair("food_closeup", "proof_exact,detail_cutaway")).when(low == "wine", pair("wine_pouring", "proof_exact,closing_payoff"))
    return F.coalesce(*rules, by_intent, pair("street_level", "context_regional,detail_cutaway"))
