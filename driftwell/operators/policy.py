"""Gate decisions: promote, hold or roll back, from a window's rate, longest run and peak."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import percent
from ..plans.errors import PolicyError
from ..plans.registry import POLICIES

#: The limits of each risk tier.
TIERS = {
    "experimental": {"max_anomaly_rate": 0.25, "min_persistence": 5, "severity_ratio": 3.5, "hold_fraction": 0.6},
    "standard": {"max_anomaly_rate": 0.12, "min_persistence": 3, "severity_ratio": 2.5, "hold_fraction": 0.5},
    "high_impact": {"max_anomaly_rate": 0.05, "min_persistence": 2, "severity_ratio": 1.8, "hold_fraction": 0.4},
}


def tier_limits(name: str) -> dict[str, float]:
    if name.lower() not in TIERS:
        raise PolicyError(f"unknown risk tier '{name}'; known: {', '.join(sorted(TIERS))}")
    return TIERS[name.lower()]


def decide(max_anomaly_rate: float, min_persistence: int, severity_ratio: float, hold_fraction: float = 0.5, prefix: str = "") -> tuple[Column, Column]:
    """Action and reason over the columns ``score, threshold, anomaly_rate, run`` of window results.

    A threshold of 0 or less makes every peak severe.
    """
    ratio = F.when(F.col("threshold") > 0, F.col("score") / F.col("threshold")).otherwise(F.lit(float("inf")))
    sustained = F.col("run") >= min_persistence
    breach = F.col("anomaly_rate") >= max_anomaly_rate
    back = sustained & (breach | (ratio >= severity_ratio))
    hold = F.col("anomaly_rate") >= F.lit(max_anomaly_rate) * F.lit(hold_fraction)
    rate, peak = percent(F.col("anomaly_rate")), F.when(F.col("threshold") > 0, F.format_string("%.1f", F.bround(ratio, 1))).otherwise(F.lit("inf"))
    head = F.concat(F.lit("run="), F.col("run").cast("string"), F.lit(", rate="), rate)
    action = F.when(back, "rollback").when(hold, "hold").otherwise("promote")
    reason = (
        F.when(back, F.concat(F.lit(f"{prefix}sustained anomaly ("), head, F.lit(", peak="), peak, F.lit("x threshold)")))
        .when(hold, F.concat(F.lit(f"{prefix}elevated but unconfirmed ("), head, F.lit(")")))
        .otherwise(F.concat(F.lit(f"{prefix}healthy ("), head, F.lit(", peak="), peak, F.lit("x)")))
    )
    return action, reason


@POLICIES.register("threshold")
@dataclass
class ThresholdPolicy:
    """Explicit limits, whatever the tier."""

    max_anomaly_rate: float = 0.12
    min_persistence: int = 3
    severity_ratio: float = 2.5
    hold_fraction: float = 0.5

    def evaluate(self, results: DataFrame, tier: str = "standard") -> DataFrame:
        action, reason = decide(self.max_anomaly_rate, self.min_persistence, self.severity_ratio, self.hold_fraction)
        return results.withColumns({"action": action, "reason": reason})


@POLICIES.register("risk_aware")
@dataclass
class RiskAwarePolicy:
    """The limits of a tier: the policy's own, or else the deployment's."""

    tier: str | None = None

    def evaluate(self, results: DataFrame, tier: str = "standard") -> DataFrame:
        name = (self.tier or tier).lower()
        action, reason = decide(**tier_limits(name), prefix=f"[tier={name}] ")
        return results.withColumns({"action": action, "reason": reason})


def first_stop(decisions: DataFrame) -> DataFrame:
    """The decisions up to the first that is not to promote, that one included: what a rollout reaches."""
    from pyspark.sql import Window

    w = Window.partitionBy("stream_id").orderBy("stage").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.max(F.col("action") != "promote").over(w), F.lit(False))
    return decisions.withColumn("__past", earlier).where("not __past").drop("__past")
