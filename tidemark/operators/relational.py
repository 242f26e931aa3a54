"""Relational operators over DataFrames whose columns are slots (alias__column)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import exprs
from tidemark.plans.bound import is_join_key


def scan(source: DataFrame, alias: str, columns: list[str]) -> DataFrame:
    """The named columns under the alias's slots; the file scan reads no others."""
    return source.select(*[F.col(f"`{c}`").alias(f"{alias}__{c}") for c in columns])


def filter_rows(df: DataFrame, predicates: list) -> DataFrame:
    """Rows for which every predicate is TRUE."""
    for p in predicates:
        df = df.where(exprs.predicate(p))
    return df


def join(left: DataFrame, right: DataFrame, kind: str, predicates: list) -> DataFrame:
    """Inner, left or cross join; equalities between the sides are keys, the rest residual."""
    if not predicates:
        return left.crossJoin(right) if kind in ("cross", "inner") else left.join(right, F.lit(True), kind)
    condition = None
    for p in predicates:
        part = exprs.join_key(p) if is_join_key(p) else exprs.predicate(p)
        condition = part if condition is None else condition & part
    return left.join(right, condition, "left" if kind == "left" else "inner")


def aggregate(df: DataFrame, group_by: list, aggregates: list) -> DataFrame:
    """Groups (NULL is one), or one row over everything; without functions, distinct rows."""
    columns = [F.col(f"`{c.slot}`") for c in group_by]
    functions = [exprs.aggregate(a.function, a.argument).alias(a.slot) for a in aggregates]
    if not functions:
        return df.select(*columns).distinct()
    return df.groupBy(*columns).agg(*functions) if columns else df.agg(*functions)


def sort(df: DataFrame, keys: list[tuple[str, bool, bool]]) -> DataFrame:
    columns = []
    for slot, descending, may_be_nan in keys:
        c = F.col(f"`{slot}`")
        columns.append(exprs.ordering(exprs.no_nan(c) if may_be_nan else c, descending))
    return df.orderBy(*columns)


def limit(df: DataFrame, n: int) -> DataFrame:
    """After a sort Spark plans both as one top-k."""
    return df.limit(n)


def project(df: DataFrame, outputs: list[tuple[str, str]]) -> DataFrame:
    """The output columns in order; names may repeat, as may slots."""
    return df.select(*[F.col(f"`{slot}`").alias(name) for slot, name in outputs])
