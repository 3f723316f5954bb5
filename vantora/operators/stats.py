"""Statistics of metadata fields and what a planner makes of them.

Fields come as rows (id, field, value), so any number of fields needs one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shares below which a filter is applied first, and together with the search.
PRE_BELOW, HYBRID_BELOW = 0.1, 0.5


def value_counts(rows: DataFrame) -> DataFrame:
    """(field, value, n): in how many ids each value occurs; nulls don't count."""
    return rows.where("id is not null and field is not null and value is not null").select("id", "field", "value").distinct().groupBy("field", "value").agg(F.count("*").alias("n"))


def field_stats(rows: DataFrame) -> DataFrame:
    """(field, unique_values, total_ids, avg_ids, min_ids, max_ids)."""
    return value_counts(rows).groupBy("field").agg(F.count("*").alias("unique_values"), F.sum("n").alias("total_ids"), F.avg("n").alias("avg_ids"), F.min("n").alias("min_ids"), F.max("n").alias("max_ids"))


def most_common(rows: DataFrame) -> DataFrame:
    """(field, value, n): the most frequent value of each field, the smaller text on a tie."""
    counts = value_counts(rows)
    top = counts.groupBy("field").agg(F.max("n").alias("n"))
    return counts.join(top, ["field", "n"]).groupBy("field", "n").agg(F.min("value").alias("value")).select("field", "value", "n")


def numeric_stats(rows: DataFrame) -> DataFrame:
    """(field, unique_values, n, least, most) of the values that are numbers."""
    numbers = rows.where("id is not null and field is not null").select("field", F.col("value").try_cast("double").alias("x")).where("x is not null and not isnan(x)")
    return numbers.groupBy("field").agg(F.countDistinct("x").alias("unique_values"), F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))


def planner_stats(rows: DataFrame) -> DataFrame:
    """(field, cardinality, total, selectivity): selectivity is one over the number of values."""
    out = field_stats(rows).select("field", F.col("unique_values").alias("cardinality"), F.col("total_ids").alias("total"))
    return out.withColumn("selectivity", 1.0 / F.col("cardinality"))


def selectivity(conditions: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds the estimated share of rows of each condition (plan, field, value).

    A known value: its share; an unknown value of a known field: one over the number of values; an unknown field: 1.
    """
    fields = counts.groupBy("field").agg(F.count("*").alias("card"), F.sum("n").alias("total"))
    rows = conditions.join(fields, "field", "left").join(counts, ["field", "value"], "left")
    share = F.when(F.col("card").isNull(), 1.0).when(F.col("n").isNull(), 1.0 / F.col("card")).otherwise(F.col("n") / F.col("total"))
    return rows.select("plan", "field", "value", share.alias("share"))


def strategy(share: Column) -> Column:
    return F.when(share <= 0, "none").when(share < PRE_BELOW, "pre").when(share < HYBRID_BELOW, "hybrid").otherwise("post")


def plans(conditions: DataFrame, counts: DataFrame) -> DataFrame:
    """(plan, filter_order, share, strategy): conditions from the rarest on, and the product of their shares."""
    rows = selectivity(conditions, counts).groupBy("plan").agg(F.array_sort(F.collect_list(F.struct(F.round("share", 9).alias("share"), "field"))).alias("c"))
    share = F.aggregate("c", F.lit(1.0), lambda s, x: s * x.share)
    return rows.select("plan", F.array_join(F.transform("c", lambda x: x.field), ",").alias("filter_order"), share.alias("share")).withColumn("strategy", strategy(F.col("share")))


def histogram(values: DataFrame, group: str, value: str, bounds: list[float]) -> DataFrame:
    """(group, le, n): cumulative counts below each bound; the last bound, infinity, holds all values."""
    slot = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        slot = F.when(F.col(value) <= bounds[i], i).otherwise(slot)
    counts = values.where(F.col(value).isNotNull()).groupBy(group, slot.alias("slot")).agg(F.count("*").alias("n"))
    each = counts.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("m"))  # at most one entry for each bound
    bound = F.array(*[F.lit(float(b)) for b in bounds], F.lit(float("inf")))
    cum = F.transform(bound, lambda b, i: F.struct(b.alias("le"), F.aggregate(F.sequence(F.lit(0), i), F.lit(0).cast("bigint"), lambda s, j: s + F.coalesce(F.try_element_at(F.col("m"), j), F.lit(0))).alias("n")))
    return each.select(group, F.inline(cum))
