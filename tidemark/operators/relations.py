"""Relational operators of general use: correlations, cross tables, grouping sets, ranks, JSON columns, approximate aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import ordered


def average_ranks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows without nulls in columns, with <column>_rank: the rank from 1, the mean rank among equal values.

    Ranks are counted over distinct values, one row for each, and joined back, so no task sorts all rows.
    """
    out = rows.dropna(subset=columns)
    for c in columns:
        counts = out.groupBy(c).agg(F.count(F.lit(1)).alias("n_"))
        below = F.coalesce(F.sum("n_").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        out = out.join(counts.select(c, (below + (F.col("n_") + 1) / 2.0).alias(f"{c}_rank")), c)
    return out


def correlations(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, Pearson's and Spearman's correlation (average ranks of ties) of two columns, rows with a null left out."""
    ranked = average_ranks(rows.select(a, b), [a, b])
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.corr(a, b).alias("pearson"), F.corr(f"{a}_rank", f"{b}_rank").alias("spearman"))


def grouping_totals(rows: DataFrame, keys: list[str], value: str, how: str = "rollup") -> DataFrame:
    """Count and sum of value for every grouping set of a rollup or cube; level is the bit mask of keys summed over."""
    grouped = {"rollup": rows.rollup, "cube": rows.cube}[how](*keys)
    return grouped.agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def crosstab(rows: DataFrame, a: str, b: str, total: str = "All") -> DataFrame:
    """(a, b, n) for every pair of values that occurs, with margins: total stands for all values. Null values are written as 'null'."""
    named = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(c) for c in (a, b)])
    counts = named.cube(a, b).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*[F.coalesce(c, F.lit(total)).alias(c) for c in (a, b)], "n")


def with_ranks(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rank, dense rank, percent rank and how many rows of the group came before (ties by no order count apart), by descending order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumns({"rank": F.rank().over(w), "dense_rank": F.dense_rank().over(w), "percent_rank": F.percent_rank().over(w)})


def numbered(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """place: how many rows of the group come before."""
    return rows.withColumn("place", F.row_number().over(ordered(keys, order)) - 1)


def packed(rows: DataFrame, columns: list[str], into: str = "packed") -> DataFrame:
    """Columns as one JSON text; nulls are left out of it."""
    return rows.withColumn(into, F.to_json(F.struct(*columns)))


def unpacked(rows: DataFrame, schema: str, column: str = "packed") -> DataFrame:
    """The fields of a JSON text by a declared schema; texts that don't parse give nulls."""
    return rows.withColumn("json_", F.from_json(column, schema)).select(*rows.columns, "json_.*")


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    """Columns whose whole name matches a regular expression, in the table's order."""
    import re

    return [c for c in df.columns if re.fullmatch(pattern, c)]


def sketches(rows: DataFrame, keys: list[str], item: str, value: str, error: float = 0.02) -> DataFrame:
    """Approximate distinct count (relative error as given) and median of each group, in bounded memory for a group of any size."""
    return rows.groupBy(*keys).agg(F.approx_count_distinct(item, error).alias("distinct"), F.approx_percentile(value, F.lit(0.5), F.lit(int(1 / error))).alias("median"))


def hash_unit(*columns: Column, seed: int = 42) -> Column:
    """Uniform in [0, 1) from the MD5 of seed and columns: the same on every engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
