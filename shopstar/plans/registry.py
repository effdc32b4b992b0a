"""Registry of every report: name -> Spark callable and name -> oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shopstar.plans import analytics as A
from shopstar.sources.testmarts import DerivedMarts

Report = Callable[[SparkSession, str], DataFrame]


def _on_marts(fn, **params) -> Report:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(DerivedMarts.for_session(spark, sf_dir), **params)
    run.__name__ = getattr(fn, "__name__", "report")
    run.__doc__ = fn.__doc__
    run.report = (fn, params)  # the marts-level function, for running on written marts
    return run


def _analytics() -> dict[str, Report]:
    return {
        "q1_channel_revenue": _on_marts(A.channel_revenue),
        "q1_channel_revenue_literal": _on_marts(A.channel_revenue, literal=True),
        "q2_top_categories": _on_marts(A.top_categories),
        "q3_store_ranking": _on_marts(A.store_ranking),
        "q4_customer_segments": _on_marts(A.customer_segments),
        "q5_promotion_roi": _on_marts(A.promotion_roi),
        "q5_promotion_roi_with_baseline": _on_marts(A.promotion_roi, with_baseline=True),
        "q6_monthly_trend": _on_marts(A.monthly_trend),
        "q7_channel_growth": _on_marts(A.channel_growth),
        "q7_channel_growth_literal": _on_marts(A.channel_growth, literal=True),
        "q8_holiday_lift": _on_marts(A.holiday_lift),
        "q9_top_states": _on_marts(A.top_states),
        "q10_top_brands": _on_marts(A.top_brands),
    }


def on_marts(name: str, marts) -> DataFrame:
    """Run a registered report on any marts object (derived or written)."""
    fn, params = queries()[name].report
    return fn(marts, **params)


def queries() -> dict[str, Report]:
    from shopstar.plans.registry_more import more_queries
    out: dict[str, Report] = {}
    out.update(_analytics())
    out.update(more_queries(_on_marts))
    return out


def oracle_sql() -> dict[str, str]:
    from shopstar.plans.analytics_sql import SQL
    from shopstar.plans.registry_more import more_sql
    out = dict(SQL)
    out.update(more_sql())
    return out
