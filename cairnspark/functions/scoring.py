"""Column functions for risk, score and confidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and bonuses of the review score (by level, per caller, for production code, by depth, for a guess),
# and the tiers of hotspots.
BASE = {"HIGH": 80, "MEDIUM": 50, "LOW": 20}
CALLER_WEIGHT, PRODUCTION, GUESS = 8.0, 6, 8
NEAR, SECOND, FAR = 12, 6, -4
HOT_HIGH, HOT_MEDIUM = 10, 5


@dataclass(frozen=True)
class Thresholds:
    high: int = 10
    high_exported: int = 5
    medium: int = 3


def risk(export: Column, test: Column, depth: Column, prod: Column, t: Thresholds = Thresholds()) -> Column:
    """The first rung that holds decides."""
    return (
        F.when(prod >= t.high, "HIGH")
        .when(export & (prod >= t.high_exported), "HIGH")
        .when((depth <= 1) & export & (prod >= 1), "MEDIUM")
        .when(prod >= t.medium, "MEDIUM")
        .when(test & (prod == 0), "LOW")
        .when(export, "MEDIUM")
        .otherwise("LOW")
    )


def reason(export: Column, test: Column, depth: Column, prod: Column, t: Thresholds = Thresholds()) -> Column:
    """Why, rung by rung as in risk."""
    by = lambda what: F.concat(F.lit(what), prod.cast("string"))
    return (
        F.when(prod >= t.high, by("many callers outside tests: "))
        .when(export & (prod >= t.high_exported), by("exported, callers outside tests: "))
        .when((depth <= 1) & export & (prod >= 1), by("exported and next to the change, callers outside tests: "))
        .when(prod >= t.medium, by("some callers outside tests: "))
        .when(test & (prod == 0), "only tests use it")
        .when(export, "exported, hardly called here")
        .otherwise("not exported, hardly called")
    )


def review_score(level: Column, confidence: Column, test: Column, depth: Column, prod: Column) -> Column:
    """Base by level, more for callers, production code and nearness, less for guesses; never negative."""
    base = F.when(level == "HIGH", BASE["HIGH"]).when(level == "MEDIUM", BASE["MEDIUM"]).otherwise(BASE["LOW"])
    near = F.when(depth <= 1, NEAR).when(depth == 2, SECOND).when(depth >= 4, FAR).otherwise(0)
    total = base + F.round(CALLER_WEIGHT * F.log1p(prod)) + F.when(test, 0).otherwise(PRODUCTION) + near - F.when(confidence == "HEURISTIC", GUESS).otherwise(0)
    return F.greatest(total, F.lit(0)).cast("long")


def risk_order(level: Column) -> Column:
    return F.when(level == "HIGH", 0).when(level == "MEDIUM", 1).when(level == "LOW", 2).otherwise(3)


def hotspot_risk(inbound: Column) -> Column:
    return F.when(inbound >= HOT_HIGH, "HIGH").when(inbound >= HOT_MEDIUM, "MEDIUM").otherwise("LOW")


def weaker(a: Column, b: Column) -> Column:
    """The weaker of two confidences ('' reads as EXACT): HEURISTIC sorts last."""
    clean = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("EXACT"))
    return F.greatest(clean(a), clean(b))
