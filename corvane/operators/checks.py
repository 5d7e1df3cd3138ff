"""Constraint checks (C1-C12) as queries for the rows that break a rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count (A1)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def outside(df: DataFrame, col: str, low: float, high: float) -> DataFrame:
    return df.where(~F.col(col).between(low, high))


def too_long(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Rows with a null or a text over its limit."""
    return df.where(reduce(lambda a, b: a | b, (F.col(c).isNull() | (F.length(c) > n) for c, n in limits.items())))


def unknown(df: DataFrame, col: str, domain: tuple[str, ...]) -> DataFrame:
    """Rows whose value is null or outside the domain."""
    return df.where(~F.coalesce(F.col(col).isin(*domain), F.lit(False)))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Children whose key is no parent's (J6); a null key is no reference."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def unproven(items: DataFrame, evidence: DataFrame, keys: list[str], only_model: str | None = None) -> DataFrame:
    """Items without evidence, or with evidence of the kind ``only_model`` alone."""
    usable = evidence if only_model is None else evidence.where(F.col("evidence_type") != only_model)
    return items.join(usable.select(*keys), keys, "left_anti")


def report(rules: dict[str, DataFrame]) -> DataFrame:
    """(rule, n): how many rows break each rule."""
    counts = [df.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("n")) for rule, df in rules.items()]
    return reduce(DataFrame.unionByName, counts)


def section_status(stages: DataFrame, sections: dict[str, int]) -> DataFrame:
    """Availability of each job's sections by the status of the stage that makes them."""
    wanted = F.explode(F.array(*(F.struct(F.lit(s).alias("section"), F.lit(k).alias("stage")) for s, k in sections.items())))
    asked = stages.select("job_id").distinct().select("job_id", wanted.alias("x")).select("job_id", "x.section", "x.stage")
    status = F.when(F.col("status") == "completed", "available").when(F.col("status") == "failed", "unavailable").otherwise("pending")
    return asked.join(stages.select("job_id", "stage", "status"), ["job_id", "stage"], "left").select("job_id", "section", status.alias("section_status"))
