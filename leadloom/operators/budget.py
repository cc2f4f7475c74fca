"""The spend guard: a projection over scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check(scenarios: DataFrame) -> DataFrame:
    """Adds allowed, state, remaining and reason to budget_cap, est_run_cost, overhead_pct,
    monthly_usage, plan_limit. The state at_risk can't come up for overheads from 0 on."""
    cap, zero = F.col("budget_cap"), F.lit(0.0)
    most = F.when(F.coalesce("plan_limit", zero) > 0, F.col("plan_limit")).otherwise(cap)
    out = scenarios.withColumns(
        {
            "_remaining": F.least(F.greatest(zero, most - F.coalesce("monthly_usage", zero)), cap),
            "_protected": cap * (F.lit(1.0) - F.col("overhead_pct")),
            "_effective": F.col("est_run_cost") * (F.lit(1.0) + F.col("overhead_pct")),
        }
    )
    capped, over = F.col("_effective") > F.col("_protected"), F.col("_effective") > F.col("_remaining")
    money = lambda c: F.format_string("%.4f", F.col(c))
    return out.withColumns(
        {
            "allowed": ~capped & ~over,
            "state": F.when(capped, "capped").when(over, "over_budget").otherwise("within_budget"),
            "remaining": F.when(capped | over, F.col("_remaining")).otherwise(F.col("_remaining") - F.col("_effective")),
            "reason": F.when(capped, F.concat(F.lit("run_cost_exceeds_safe_budget:"), money("_effective"), F.lit(">"), money("_protected"))).when(over, F.concat(F.lit("insufficient_remaining:"), money("_effective"), F.lit(">"), money("_remaining"))).otherwise(""),
        }
    ).drop("_remaining", "_protected", "_effective")


def simulate(scenarios: DataFrame) -> DataFrame:
    """What the simulator shows: what is left of the protected cap, which may be negative."""
    return check(scenarios).withColumn("remaining", F.col("budget_cap") * (F.lit(1.0) - F.col("overhead_pct")) - F.coalesce("monthly_usage", F.lit(0.0)) - F.col("est_run_cost") * (F.lit(1.0) + F.col("overhead_pct")))
