"""ANALYZE: counts, extremes, distinct values, common values and histograms of columns."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import TidemarkError
from tidemark.plans.estimator import Bucket, ColumnStatistics, TableStatistics
from tidemark.types import SPARK

# Tables of up to LOCAL_ROWS rows are sorted whole by the driver, larger ones by the executors.
LOCAL_ROWS, MAX_BUCKETS, MAX_COMMON, COMMON_FACTOR, DISTINCT_ERROR = 30_000, 64, 32, 1.25, 0.016


def _ordered(value: Column, kind: str) -> Column:
    """NULL instead of what extremes and histograms leave out: NaN and the infinities."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value) if kind == "DOUBLE" else value


def basic_statistics(df: DataFrame, columns: dict[str, str], prefixes: list[tuple[str, ...]] = ()) -> DataFrame:
    """One row per column (name, rows, nulls, low, high, distinct): one pass, partially
    aggregated; distinct counts are HyperLogLog++ sketches, so nothing is shuffled but a
    row of each partition.  ``prefixes`` are columns counted together (p_0, p_1, ...)."""
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for c, kind in columns.items():
        value = F.col(f"`{c}`")
        ordered = _ordered(value, kind)
        aggregates += [F.count(value).alias(f"n_{c}"), F.min(ordered).alias(f"lo_{c}"), F.max(ordered).alias(f"hi_{c}"), F.approx_count_distinct(value, DISTINCT_ERROR).alias(f"d_{c}")]
        aggregates.append((F.count_if(F.isnan(value)) if kind == "DOUBLE" else F.lit(0)).alias(f"x_{c}"))
    aggregates += [F.approx_count_distinct(F.struct(*[f"`{c}`" for c in p]), DISTINCT_ERROR).alias(f"p_{k}") for k, p in enumerate(prefixes)]
    return df.agg(*aggregates)


def common_values(values: list, scale: float) -> list[tuple[object, float]]:
    """Up to MAX_COMMON values that occur over COMMON_FACTOR times the mean and twice."""
    counts: dict[object, int] = {}
    for v in values:
        counts[v] = counts.get(v, 0) + 1
    mean = len(values) / max(len(counts), 1)
    often = [(v, n) for v, n in counts.items() if n > COMMON_FACTOR * mean and n >= 2]
    often.sort(key=lambda x: (-x[1], x[0]))
    return [(v, n * scale) for v, n in often[:MAX_COMMON]]


def histogram(ordered: list, scale: float) -> list[Bucket]:
    """Equi-depth buckets over sorted values; their rows add up to the scaled count."""
    n = len(ordered)
    b = min(MAX_BUCKETS, n)
    out = []
    for i in range(b):
        lo, hi = i * n // b, (i + 1) * n // b
        part = ordered[lo:hi]
        distinct = 1 + sum(x != y for x, y in zip(part, part[1:], strict=False))
        out.append(Bucket(part[0], part[-1], round(hi * scale) - round(lo * scale), distinct))
    return out


def ranked_values(df: DataFrame, columns: dict[str, str], nulls: bool) -> DataFrame:
    """One row per column and value: part (partitions in order), c (the column's place), a
    field for each type in use, n (rows), reached (the partition's rows up to this value, its
    own included).  Rows are counted before they are sorted, so a frequent value is one row;
    partitions are ranges of column and value."""

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # inside, so that executors needn't import this module
        total = 0
        for b in batches:
            reached = total + np.cumsum(b.column("n").to_numpy(zero_copy_only=False))
            total = int(reached[-1]) if len(reached) else total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(reached, pa.int64())], names=[*b.schema.names, "reached"])

    kinds = sorted(set(columns.values()))
    cells = []
    for k, (c, kind) in enumerate(columns.items()):
        value = F.col(f"`{c}`").cast(SPARK[kind])
        value = value if nulls else _ordered(value, kind)
        cells.append(F.struct(F.lit(k).alias("c"), *[(value if x == kind else F.lit(None).cast(SPARK[x])).alias(x) for x in kinds]))
    values = df.select(F.inline(F.array(*cells)))
    if not nulls:
        values = values.where(reduce(or_, [F.col(x).isNotNull() for x in kinds]))
    order = ["c", *[F.col(x).asc_nulls_last() for x in kinds]]
    counts = values.groupBy("c", *kinds).agg(F.count(F.lit(1)).alias("n")).repartitionByRange(*order).sortWithinPartitions(*order)
    counts = counts.select(F.spark_partition_id().alias("part"), "c", *kinds, "n")
    return counts.mapInArrow(running, T.StructType([*counts.schema, T.StructField("reached", T.LongType())]))


def distributions(df: DataFrame, columns: dict[str, str], nulls: bool = False) -> dict[str, tuple[list[tuple[object, float]], list[Bucket]]]:
    """What ``common_values`` and ``histogram`` (of sorted values) give for all rows of each
    column, without a bound on rows or values: the driver gets the totals of partitions and
    the results.  NULL, NaN and the infinities are left out, or with ``nulls`` values too,
    NULL the highest; -0.0 counts as 0.0."""
    kinds, names = sorted(set(columns.values())), list(columns)
    out = {c: ([], []) for c in names}
    ranked = ranked_values(df, columns, nulls).persist()
    try:
        size, distinct, before, parts = Counter(), Counter(), Counter(), []
        for part, c, rows, values in sorted(ranked.groupBy("part", "c").agg(F.sum("n"), F.count(F.lit(1))).collect()):
            parts.append((part, c, size[c] - before[part]))  # from places in the partition to ranks in the column
            before[part] += rows
            size[c] += rows
            distinct[c] += values
        facts = [(part, c, shift, size[c], min(MAX_BUCKETS, size[c]), COMMON_FACTOR * (size[c] / distinct[c])) for part, c, shift in parts]
        facts = df.sparkSession.createDataFrame(facts, "part int, c int, shift long, size long, buckets long, often double")
        ranked_all = ranked.join(F.broadcast(facts), ["part", "c"])

        most = Window.partitionBy("c").orderBy(F.desc("n"), *[F.col(x).asc_nulls_last() for x in kinds])
        common = ranked_all.where("n > often AND n >= 2").select("c", *kinds, "n", F.row_number().over(most).alias("place")).where(F.col("place") <= MAX_COMMON)
        for r in sorted(common.toArrow().to_pylist(), key=lambda r: (r["c"], r["place"])):
            out[names[r["c"]]][0].append((r[columns[names[r["c"]]]], float(r["n"])))

        # A value stands at the ranks from ``begin`` to before ``end``, and in the buckets of these.
        placed = ranked_all.withColumn("end", F.expr("reached + shift")).withColumn("begin", F.expr("end - n"))
        placed = placed.withColumn("bucket", F.explode(F.expr("sequence(((begin + 1) * buckets - 1) div size, (end * buckets - 1) div size)")))
        inside = F.expr("least(end, (bucket + 1) * size div buckets) - greatest(begin, bucket * size div buckets)")
        extremes = [f(x).alias(f"{name}_{x}") for x in kinds for name, f in (("low", F.min), ("high", F.max))]
        buckets = placed.groupBy("c", "bucket").agg(F.sum(inside).alias("rows"), F.count(F.lit(1)).alias("distinct"), *extremes).toArrow().to_pylist()
    finally:
        ranked.unpersist()
    for r in sorted(buckets, key=lambda r: (r["c"], r["bucket"])):
        kind = columns[names[r["c"]]]
        out[names[r["c"]]][1].append(Bucket(r[f"low_{kind}"], r[f"high_{kind}"], r["rows"], r["distinct"]))
    for k, c in enumerate(names):
        edges = [i * size[k] // max(len(out[c][1]), 1) for i in range(len(out[c][1]) + 1)]
        if len(out[c][1]) != min(MAX_BUCKETS, size[k]) or [b.rows for b in out[c][1]] != [hi - lo for lo, hi in zip(edges, edges[1:], strict=False)]:
            raise TidemarkError(f"values of {c} moved between partitions while they were counted: analyze again")
    return out


def analyze_table(df: DataFrame, columns: dict[str, str], primary_key: str | None, prefixes: list[tuple[str, ...]] = ()) -> TableStatistics:
    """Counts and extremes in one pass; common values and histograms of all rows, which the
    driver sorts in small tables and the executors in others."""
    head = basic_statistics(df, columns, prefixes).first()
    rows = head["rows"]
    shapes = {}
    if rows <= LOCAL_ROWS:
        table = df.toArrow()
        for c, kind in columns.items():
            values = [v for v in table.column(c).to_pylist() if v is not None and not (kind == "DOUBLE" and (v != v or abs(v) == float("inf")))]
            shapes[c] = common_values(values, 1.0), histogram(sorted(values), 1.0)
    else:
        shapes = distributions(df, columns)
    out = {}
    for c in columns:
        s = ColumnStatistics(rows, rows - head[f"n_{c}"], head[f"d_{c}"], head[f"lo_{c}"], head[f"hi_{c}"], nan=head[f"x_{c}"])
        if primary_key == c:
            s.distinct = rows
        s.common, s.buckets = shapes[c]
        out[c] = s
    return TableStatistics(rows, out, prefixes={p: head[f"p_{k}"] for k, p in enumerate(prefixes)})
