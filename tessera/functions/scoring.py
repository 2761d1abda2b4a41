"""Score columns: clamps, weighted sums, penalties, states by thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def weighted(parts: dict[str, float] | list[tuple[Column, float]], missing: float = 0.0) -> Column:
    """Sum of columns times weights; a null counts as ``missing``."""
    pairs = [(F.col(k), w) for k, w in parts.items()] if isinstance(parts, dict) else parts
    return reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(missing)) * F.lit(w) for c, w in pairs])


def state(x: Column, steps: list[tuple[float, str]], below: str) -> Column:
    """Name of the highest step that x reaches; steps in falling order."""
    return F.coalesce(*[F.when(x >= limit, F.lit(name)) for limit, name in steps], F.lit(below))


def percent(x: Column) -> Column:
    """A share given as 0-1 or as percent, as 0-1."""
    return clamp(F.when(x > 1, x / 100).otherwise(x))


def batch_count(deficit: Column, useful: Column, most: int) -> Column:
    """How many batches a deficit needs: 0 without one, else 1 to ``most``."""
    return F.when(deficit <= 0, 0).otherwise(F.least(F.greatest(F.ceil(deficit / useful), F.lit(1)), F.lit(most))).cast("int")


def reuse_penalty(used: Column, hours_since: Column, same_block: Column, times: Column, cooldown: float = 12.0) -> Column:
    """Penalty for using an item again: flat, within the cooldown, in the same block, and per use up to a limit."""
    return (
        F.when(used, 1.5).otherwise(0.0)
        + F.when(hours_since < cooldown, 0.8).otherwise(0.0)
        + F.when(same_block, 1.2).otherwise(0.0)
        + F.least(F.lit(1.2), times * 0.08)
    )


#: Weights of a candidate's features, and of its penalties.
GAINS = {
    "semantic": 8.0, "intent": 3.0, "required": 5.0, "block": 3.0, "entity": 3.5, "specific": 3.0, "theme": 3.0, "source": 2.5, "editorial": 3.0,
    "binding": 3.5, "resolution": 1.0, "motion": 1.0, "confidence": 1.0, "intro": 1.0,
}
LOSSES = {
    "forbidden": 10.0, "source_reuse": 4.0, "asset_reuse": 4.0, "window_reuse": 5.0, "signature_reuse": 3.5, "block_mismatch": 8.0, "cross_scene": 8.5,
    "generic": 7.0, "uncertain": 5.0, "fallback": 4.5, "dark": 4.0, "off_theme": 15.0,
}
#: Penalties and the value from which they are a reason.
REASONS = [
    ("block_mismatch", 1.0, "wrong_block"), ("window_reuse", 1.0, "reused_window"), ("asset_reuse", 1.0, "reused_asset"), ("source_reuse", 1.0, "reused_source_url"),
    ("signature_reuse", 0.5, "repeated_visual_signature"), ("cross_scene", 1.0, "cross_scene_candidate"), ("generic", 1.0, "generic_asset"), ("uncertain", 1.0, "uncertain_asset"), ("dark", 0.5, "dark_frame_risk"),
]


def candidate_score(features: dict[str, Column], blocked: Column) -> Column:
    """Gains less losses, each times its weight, to three digits; -1 for blocked candidates. Features that are absent count 0."""
    total = F.lit(0.0)
    for sign, weights in ((1.0, GAINS), (-1.0, LOSSES)):
        for name, weight in weights.items():
            if name in features:
                total = total + F.coalesce(features[name].cast("double"), F.lit(0.0)) * (sign * weight)
    return F.when(blocked, -1.0).otherwise(F.round(total, 3))


def candidate_reasons(features: dict[str, Column], block_reasons: list[tuple[str, Column]]) -> Column:
    """Why a candidate is blocked or ranked low, in order: blocks first, then penalties, then a low semantic score."""
    found = [F.when(c, F.lit(n)) for n, c in block_reasons]
    found += [F.when(features[f] >= least, F.lit(n)) for f, least, n in REASONS if f in features]
    found += [F.when(features["semantic"] < 0.2, F.lit("low_semantic_score"))] if "semantic" in features else []
    return F.array_compact(F.array(*found))
