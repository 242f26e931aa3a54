"""Operator 5: all pairs of embeddings within a cosine, as an exact metric range join.

Pivots partition the unit vectors into cells.  A vector goes to its nearest pivot's cell
and, as a replica, to each lower-numbered cell that may hold a partner: the triangle
inequality on angles (distance to the pivot against the cell's radius, and against the
own pivot) and the distance to the plane between both pivots exclude the others.  Every
pair within range so meets in exactly one cell, and cells are joined on their own, in
blocks of bounded size, with single-precision products first and double precision for
every pair that could pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.llm.components import connected_components

COSINE = 0.9
BLOCK = 2048
MAX_PIVOTS = 256
PIVOTED_LENGTHS = 64  # lengths with most vectors; vectors of a further one share one cell
BROADCAST_ROWS = 200_000  # cells: four integers each


def _units(column: pa.Array, dim: int) -> np.ndarray:
    x = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), dim)
    with np.errstate(over="ignore"):
        scale = np.abs(x).max(axis=1, keepdims=True)
        x = x / scale  # so that squares neither overflow nor vanish
        return x / np.sqrt(np.square(x).sum(axis=1, keepdims=True))


def _slack(dim: int) -> float:
    """More than the rounding of a single-precision product of unit vectors."""
    return 1e-6 + dim * 2.0**-23


def _assign(pivots: dict[int, np.ndarray], radii: dict[int, np.ndarray] | None, cosine: float):
    """Without ``radii``: length, cell and angle of each vector.  With them: the vector once
    for each cell that it must meet others in.  A length without pivots is one cell."""
    reach = np.arccos(cosine)
    chord = np.sqrt(2 - 2 * cosine)
    gaps = {dim: np.sqrt(np.maximum(2 - 2 * np.clip(p @ p.T, -1, 1), 1e-18)) for dim, p in pivots.items()}

    def cells(v: pa.Array, dim: int):
        """Rows and cells to send them to, each row's own cell, and its angle there."""
        if dim not in pivots:
            nothing = np.zeros(len(v), np.int64)
            return np.arange(len(v)), nothing, nothing, np.zeros(len(v))
        p = pivots[dim]
        cos = np.clip(_units(v, dim) @ p.T, -1, 1)
        home = cos.argmax(axis=1)
        best = cos[np.arange(len(home)), home]
        angle, own = np.arccos(cos), np.arccos(best)
        if radii is None:
            return np.arange(len(v)), home, home, own
        meets = (angle <= radii[dim][None, :] + reach + 1e-9) & (angle - own[:, None] <= 2 * reach + 1e-9) & (best[:, None] - cos <= gaps[dim][home] * chord + 1e-9)
        meets &= np.arange(len(p))[None, :] < home[:, None]
        meets[np.arange(len(home)), home] = True
        return *np.nonzero(meets), home, own

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                whole = batch.slice(a, 4096)
                lengths = np.asarray(pc.list_value_length(whole.column("v")))
                for dim in np.unique(lengths).tolist():
                    part = whole.filter(pa.array(lengths == dim))
                    row, cell, home, own = cells(part.column("v"), dim)
                    dims = pa.array(np.full(len(row), dim, np.int32))
                    if radii is None:
                        yield pa.RecordBatch.from_arrays([dims, pa.array(cell.astype(np.int32)), pa.array(own)], names=["dim", "cell", "angle"])
                        continue
                    take = pa.array(row)
                    replica = pa.array((cell != home[row]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [dims, pa.array(cell.astype(np.int32)), replica, part.column("vec_id").take(take), part.column("weight").take(take), part.column("v").take(take)],
                        names=["dim", "cell", "replica", "vec_id", "weight", "v"],
                    )

    return run


def _join_block(cosine: float):
    out_schema = pa.schema([("vec_id", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])

    def run(key, table):
        table = table.combine_chunks()
        dim, _, i, j = (k.as_py() for k in key)
        side = np.asarray(table["block"])
        ids, weights = np.asarray(table["vec_id"]), np.asarray(table["weight"])
        x = _units(table["v"].combine_chunks(), dim)
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        links = np.zeros(len(ids), dtype=np.int64)
        parent = np.arange(len(ids))
        single = x.astype(np.float32)
        for a in range(0, len(left), 1024):
            rows = left[a : a + 1024]
            near = single[rows] @ single[right].T >= np.float32(cosine - _slack(dim))
            p, q = np.nonzero(near)
            p, q = rows[p], right[q]
            if i == j:
                p, q = p[p < q], q[p < q]
            for b in range(0, len(p), 65536):
                s, t = p[b : b + 65536], q[b : b + 65536]
                close = np.einsum("ij,ij->i", x[s], x[t]) >= cosine
                s, t = s[close], t[close]
                links += np.bincount(s, weights=weights[t], minlength=len(ids)).astype(np.int64) + np.bincount(t, weights=weights[s], minlength=len(ids)).astype(np.int64)
                while True:  # hook larger roots on smaller ones, then flatten
                    u, v = parent[s], parent[t]
                    apart = u != v
                    if not apart.any():
                        break
                    s, t, u, v = s[apart], t[apart], u[apart], v[apart]
                    np.minimum.at(parent, np.maximum(u, v), np.minimum(u, v))
                    while not np.array_equal(parent, parent[parent]):
                        parent = parent[parent]
        linked = np.flatnonzero(links)
        return pa.table([pa.array(ids[linked]), pa.array(links[linked]), pa.array(ids[parent[linked]])], schema=out_schema)

    return run


def _range_join(reps: DataFrame, cosine: float, block: int, max_pivots: int) -> DataFrame:
    """(vec_id, n, other): links counted per block, and a vector each one is joined to."""
    lengths = reps.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).orderBy(F.desc("n"), "dim").limit(PIVOTED_LENGTHS).collect()
    pivots = {}
    for r in lengths:
        own = reps.where(F.size("v") == r["dim"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(int(min(max_pivots, -(-r["n"] // block))))
        pivots[r["dim"]] = _units(own.select("v").toArrow()["v"].combine_chunks(), r["dim"])
    radii = {dim: np.full(len(p), -np.inf) for dim, p in pivots.items()}
    if pivots:
        far = reps.where(F.size("v").isin(*pivots)).mapInArrow(_assign(pivots, None, cosine), "dim int, cell int, angle double").groupBy("dim", "cell").agg(F.max("angle").alias("radius"))
        for r in far.collect():  # one row for each pivot at most
            radii[r["dim"]][r["cell"]] = r["radius"]
    dealt = reps.mapInArrow(_assign(pivots, radii, cosine), "dim int, cell int, replica int, vec_id long, weight long, v array<double>")
    blocks = lambda replica: F.ceil(F.sum((F.col("replica") == replica).cast("int")) / F.lit(block)).cast("int")
    counts = cut(dealt.groupBy("dim", "cell").agg(F.greatest(blocks(0), F.lit(1)).alias("n_home"), blocks(1).alias("n_other")))
    small = counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    dealt = dealt.join(F.broadcast(counts) if small else counts, ["dim", "cell"])
    spread = F.pmod(F.xxhash64("vec_id"), F.when(F.col("replica") == 0, F.col("n_home")).otherwise(F.col("n_other"))).cast("int")
    dealt = dealt.withColumn("block", F.when(F.col("replica") == 0, spread).otherwise(F.col("n_home") + spread).cast("int"))
    # Blocks 0..n_home-1 hold the cell's own vectors, the rest replicas; (i, j) with i <= j
    # and i of the cell's own meet.
    own = F.transform(F.sequence(F.lit(0), F.col("n_home") + F.col("n_other") - 1), lambda j: F.struct(F.least(F.col("block"), j.cast("int")).alias("i"), F.greatest(F.col("block"), j.cast("int")).alias("j")))
    replica = F.transform(F.sequence(F.lit(0), F.col("n_home") - 1), lambda i: F.struct(i.cast("int").alias("i"), F.col("block").alias("j")))
    tasks = dealt.select("dim", "cell", "block", "vec_id", "weight", "v", F.explode(F.when(F.col("replica") == 0, own).otherwise(replica)).alias("task"))
    tasks = tasks.select("dim", "cell", "task.i", "task.j", "block", "vec_id", "weight", "v")
    return tasks.groupBy("dim", "cell", "i", "j").applyInArrow(_join_block(cosine), "vec_id long, n long, other long")


def near_duplicate_embeddings(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, block: int = BLOCK, max_pivots: int = MAX_PIVOTS
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors link when their cosine in double precision is ``cosine`` or more.  n_links
    counts the other rows linked directly, component_id is the smallest vec_id reachable
    by links, kept says that it is the row's own.

    Equal vectors are one vector with a weight, so copies cost nothing; no list of pairs
    is made, each block hands on counts and a spanning forest.  ``max_pivots`` bounds what
    the driver holds; cells may grow beyond ``block``, blocks don't.

    A vector that is null, empty, zero or holds null, NaN or an infinity links with
    nothing, nor do vectors of different length, which are joined side by side in one plan.
    Vectors may be of any length.  Null vec_id: n_links 0, component_id
    null, kept false.  A vec_id that occurs again: its rows are vectors of their own (equal
    ones link) that share their number.  Empty table: no rows.  Other columns are not read.
    """
    v = F.col("v")
    read = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = v.isNotNull() & F.col("vec_id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    # -0.0 and 0.0 are one value; the pair of hashes stands for the vector.
    same = F.transform("v", lambda x: x + F.lit(0.0))
    read = read.withColumn("h", F.when(F.coalesce(fine, F.lit(False)), F.struct(F.xxhash64(same).alias("a"), F.xxhash64(F.lit(1), same).alias("b"))))
    reps = read.where("h is not null").groupBy("h").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("weight"), F.any_value("v").alias("v"))
    reps = cut(reps)
    found = cut(_range_join(reps.select("vec_id", "weight", "v"), cosine, block, max_pivots))
    sums = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    labels = connected_components(found.select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    classes = reps.select("h", F.col("vec_id").alias("rep"), "weight")
    classes = classes.join(sums.withColumnRenamed("vec_id", "rep"), "rep", "left").join(labels.select(F.col("node").alias("rep"), "root"), "rep", "left")
    classes = classes.select("h", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component"))
    out = read.select("vec_id", "h").join(classes, "h", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_duplicate_embeddings`` of all embeddings."""
    return near_duplicate_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
