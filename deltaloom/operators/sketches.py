"""Mergeable sketches, kept by group and merged to coarser groups later: distinct values and quantiles.

A sketch is a few kilobytes whatever it has seen, so what is stored and shuffled doesn't grow with the rows. Sketches of
parts merge to that of the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Logarithm of the registers of a distinct sketch; its standard error is 1.04 over the root of the registers.
REGISTERS = 12
#: Size of a quantile sketch, and the rank error that it keeps to with 99 % certainty.
QUANTILE_SIZE, RANK_ERROR = 400, 0.0075


def distinct_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, sketch`` of the distinct values that aren't null."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(value, REGISTERS).alias("sketch"))


def distinct_of(stored: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, estimate`` from stored sketches of finer groups."""
    return stored.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def distinct_within(estimate: Column, exact: Column, errors: float = 3.0) -> Column:
    """True if the estimate lies within so many standard errors."""
    return F.abs(estimate - exact) <= F.lit(errors * 1.04 / 2 ** (REGISTERS / 2)) * exact + 1


def quantiles_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, sketch`` of the values, as doubles; nulls don't count."""
    return df.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(QUANTILE_SIZE)).alias("sketch"))


def quantiles_of(stored: DataFrame, keys: list[str], asked: list[float]) -> DataFrame:
    """``keys, q, quantile`` for each quantile asked for, from stored sketches of finer groups; groups without values have none."""
    merged = stored.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(QUANTILE_SIZE)).alias("sketch")).where(F.kll_sketch_get_n_double("sketch") > 0)
    each = F.array(*(F.struct(F.lit(float(q)).alias("q"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias("quantile")) for q in asked))
    return merged.withColumn("of", F.explode(each)).select(*keys, "of.q", "of.quantile")


def rank_within(q: Column, below: Column, up_to: Column) -> Column:
    """True if ranks from ``below`` to ``up_to`` come within the sketch's error of ``q``."""
    return (below <= q + RANK_ERROR) & (up_to >= q - RANK_ERROR)
