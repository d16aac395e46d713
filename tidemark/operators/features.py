"""Detector features: engineered columns, their registry and leakage-safe selection."""

from __future__ import annotations

from fnmatch import fnmatch

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import ordered, so_far

#: Feature groups by name. Those of `leaking` use later data.
GROUPS: dict[str, list[str]] = {
    "semantic": ["semantic_velocity", "velocity_acceleration"],
    "growth": ["growth_rate", "growth_acceleration", "new_works", "total_works"],
    "novelty": ["novel_terms", "novelty_rate", "novelty_momentum"],
    "dormancy": ["dormancy_length", "awakening_intensity", "is_awakening"],
    "citations": ["cross_domain_share", "cross_domain_refs", "within_lineage_refs", "citation_balance"],
    "leaking": ["cd_index", "cd_min", "cd_max", "disruption_intensity"],
    "field": ["relative_new_works", "relative_cumulative_works", "growth_vs_field", "acceleration_vs_field", "new_works_over_p75"],
}
CORE = ("semantic", "growth", "novelty", "dormancy", "citations", "leaking")
CONTEXT_METRICS = ("author_influx", "citation_velocity", "reference_vitality", "topic_diversity", "cross_cluster_bridging")
CONTEXT_SUFFIXES = ("z", "qoq_delta", "roll_1q", "roll_2q", "roll_4q", "max_dev_4q", "min_dev_4q")


def group(name: str) -> list[str]:
    """The columns of a group; core joins the groups of one lineage, context is metrics by suffixes."""
    if name == "core":
        return [c for g in CORE for c in GROUPS[g]]
    if name == "context":
        return [f"{m}_{s}" for m in CONTEXT_METRICS for s in CONTEXT_SUFFIXES]
    if name not in GROUPS:
        raise KeyError(f"unknown feature group: {name}")
    return list(GROUPS[name])


def resolve(include: list[str], columns: list[str] = (), exclude: list[str] = (), available: list[str] | None = None) -> list[str]:
    """Columns of groups and named columns, once each in order, less those that any exclude pattern matches; only available ones if given."""
    wanted = dict.fromkeys([c for g in include for c in group(g)] + list(columns))
    return [c for c in wanted if not any(fnmatch(c, p) for p in exclude) and (available is None or c in available)]


def select_features(columns: list[str], field: str = "auto", leakage_safe: bool = False) -> list[str]:
    """The feature columns of a table: core, context and conv_* columns that it has, and field-relative ones unless field is off.

    leakage_safe leaves out what uses later data, field-relative columns among them; field='only' takes nothing else.
    """
    if field not in ("auto", "off", "only"):
        raise ValueError(f"unknown field mode: {field!r}")
    relative = [] if field == "off" or leakage_safe else resolve(["field"], sorted(c for c in columns if c.startswith("field_")), available=columns)
    if field == "only":
        if not relative:
            raise ValueError("no field-relative columns")
        return relative
    own = resolve(["core", "context"], sorted(c for c in columns if c.startswith("conv_")), GROUPS["leaking"] if leakage_safe else (), columns)
    return own + relative


def engineered(signals: DataFrame, key: str = "lineage_id") -> DataFrame:
    """signals (key, q_idx and the raw columns) with running totals, differences and products of them; nulls are 0.

    growth_rate is the relative change of the running total, infinite changes counting as 0.
    """
    w = ordered([key], "q_idx")
    out = signals.withColumn("total_works", F.sum("new_works").over(so_far([key], "q_idx")))
    before = F.lag("total_works").over(w)
    out = out.withColumn("growth_rate", F.coalesce(F.try_divide((F.col("total_works") - before).cast("double"), before.cast("double")), F.lit(0.0)))
    out = out.withColumns({
        "velocity_acceleration": F.col("semantic_velocity") - F.lag("semantic_velocity").over(w), "growth_acceleration": F.col("growth_rate") - F.lag("growth_rate").over(w),
        "novelty_momentum": F.col("novelty_rate") * F.col("n_new_papers"), "is_awakening": (F.col("awakening_intensity") > 0).cast("int"),
        "citation_balance": F.col("cross_domain_refs") / (F.col("within_lineage_refs") + 1), "disruption_intensity": F.col("cd_index") * F.col("n_papers_cd"),
    })
    return out.fillna(0)
