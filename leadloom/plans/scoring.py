"""Declarative scoring: rules, weights and cut points, compiled to one projection.

Conditions are SQL texts over a record's columns. Each is evaluated once a record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = ("fit", "intent", "quality", "engagement")


@dataclass(frozen=True)
class Rule:
    component: str
    when: str
    points: str = "0"
    #: A tag for score_reasons, or with reason_sql an expression for it.
    reason: str | None = None
    reason_sql: str | None = None


@dataclass(frozen=True)
class ScoreModel:
    name: str
    weights: dict[str, str]
    rules: tuple[Rule, ...]
    score: str = "lead_score"
    #: Columns that several rules look at, computed once: names and SQL.
    derived: tuple[tuple[str, str], ...] = ()
    high: int = 80
    usable: int = 50
    #: Unique records from this score on are nurtured.
    nurture: int = 50

    def component(self, name: str) -> str:
        terms = [f"CASE WHEN _rule{n} THEN {r.points} ELSE 0 END" for n, r in enumerate(self.rules) if r.component == name and r.points != "0"]
        return f"least(100, {' + '.join(terms)})"

    def reasons(self) -> str:
        """Reasons in order, separated by |."""
        tags = [(f"_rule{n}", r.reason_sql or f"'{r.reason}'") for c in COMPONENTS for n, r in enumerate(self.rules) if r.component == c and (r.reason or r.reason_sql)]
        if not tags:
            return "''"
        return "concat_ws('|', " + ", ".join(f"CASE WHEN {w} THEN {t} END" for w, t in tags) + ")"

    def total(self) -> str:
        weighted = " + ".join(f"score_{c} * CAST({w} AS DOUBLE)" for c, w in self.weights.items())
        return f"CAST(floor({weighted} + CAST(0.5 AS DOUBLE)) AS INT)"

    def band(self, high: str, usable: str, low: str) -> str:
        return f"CASE WHEN {self.score} >= {self.high} THEN '{high}' WHEN {self.score} >= {self.usable} THEN '{usable}' ELSE '{low}' END"

    def apply(self, records: DataFrame) -> DataFrame:
        """Adds score_fit and so on, the score, score_band, recommended_action, score_reasons."""
        out = records.withColumns({k: F.expr(v) for k, v in self.derived})
        # Each condition is a column of its own, as points and reasons both look at it.
        out = out.withColumns({f"_rule{n}": F.expr(f"coalesce({r.when}, false)") for n, r in enumerate(self.rules)})
        out = out.withColumns({f"score_{c}": F.expr(f"CAST({self.component(c)} AS INT)") for c in self.weights})
        out = out.withColumn(self.score, F.expr(self.total()))
        reasons = F.expr(self.reasons())
        return out.withColumns(
            {
                "score_band": F.expr(self.band("high", "usable", "low")),
                "recommended_action": F.expr(self.band("send_first", "keep", "hold")),
                "score_reasons": F.when(reasons == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(reasons, r"\|"))),
            }
        ).drop(*[k for k, _ in self.derived], *[f"_rule{n}" for n in range(len(self.rules))])
