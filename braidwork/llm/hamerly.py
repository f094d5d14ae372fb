"""Clusters of integer vectors by Lloyd's rounds with Hamerly's bounds.

Every vector keeps the centroid it is assigned to, one upper bound of its distance to that centroid, and one lower
bound of its distance to every other. A round loosens both by how far the centroids have moved; a vector whose upper
bound stays below its lower bound, or below half the way from its centroid to the next one, can't have changed and
isn't compared. The others get their own distance anew, and, if that doesn't settle it, a scan of all centroids in
exact integers. Bounds are rounded outwards and have to differ, so ties always reach the scan.

A round is one narrow pass from one written table to the next: no vector is shuffled. What is summed for the new
centroids are K x dimensions numbers a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm import common

CENTROIDS, ROUNDS, DIMENSIONS, SCALE = 40, 5, 64, 256
#: Components are held within this, so that every squared distance is an exact 64-bit integer.
LARGEST = 1 << 27
#: Bounds are rounded outwards by this share, far above what doubles lose.
SLACK = 1e-12

STATE = "vec_id bigint, v array<int>, cluster int, upper double, lower double, distance bigint, scans int"


def kept(vectors: DataFrame, dimensions: int = DIMENSIONS, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors of that many components, none of which is null or not finite, as integers floor(SCALE * x). Components beyond LARGEST count as LARGEST."""
    x = F.transform(F.col(f"`{column}`"), lambda x: x.cast("double"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("x", lambda x: F.greatest(F.least(F.floor(x * SCALE), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    return vectors.select(F.col(f"`{id_column}`").cast("bigint").alias("vec_id"), x.alias("x")).filter((F.size("x") == dimensions) & finite).select("vec_id", whole.alias("v"))


def first_centroids(points: DataFrame, k: int = CENTROIDS) -> list[list[int]]:
    """The k vectors with the least sha256 of `2:<vec_id>` (a null id as empty text; ties: the lesser vector)."""
    key = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r.v) for r in points.orderBy(key, "vec_id", "v").limit(k).collect()]


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x (n, d) and c (k, d), as int64 (n, k)."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if top * top * x.shape[1] < 1 << 51:  # every sum is a whole number below 2**53
        dot = (x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    else:
        dot = x @ c.T
    return (x * x).sum(1)[:, None] - 2 * dot + (c * c).sum(1)[None, :]


def up(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 + SLACK)


def down(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 - SLACK)


def scanned(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each vector its nearest centroid (ties: the smaller number), that squared distance, and the second least."""
    d = squares(x, c)
    at = d.argmin(1)
    own = d[np.arange(len(x)), at]
    d[np.arange(len(x)), at] = np.iinfo(np.int64).max
    return at, own, d.min(1)


def assigned(points: DataFrame, centroids: list[list[int]], before: list[list[int]] | None, exact: bool) -> DataFrame:
    """One round over (vec_id, v), or over the table of the round before, whose centroids were `before`. With exact, every vector's own squared distance is worked out, else only where its bound is in doubt."""
    c = np.array(centroids, np.int64)
    k = len(c)
    between = squares(c, c)
    np.fill_diagonal(between, np.iinfo(np.int64).max)
    half = down(between.min(1)) / 2 if k > 1 else np.full(k, np.inf)
    schema = common.arrow_schema(common.T._parse_datatype_string(STATE))
    if before is not None:
        drift = up(((c - np.array(before, np.int64)) ** 2).sum(1))
        most = np.array([np.delete(drift, i).max(initial=0.0) for i in range(k)])

    def run(batches):
        for batch in common.pieces(batches, 8192):
            n = batch.num_rows
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.int64)
            if before is None:
                cluster, lower, upper = np.zeros(n, np.int64), np.zeros(n), np.full(n, np.inf)
                distance, scans = np.zeros(n, np.int64), np.zeros(n, np.int64)
                doubt = np.arange(n)
            else:
                cluster, upper, lower, distance, scans = (batch.column(i).to_numpy(zero_copy_only=False).copy() for i in (2, 3, 4, 5, 6))
                upper = (upper + drift[cluster]) * (1 + SLACK)
                lower = np.maximum(lower - most[cluster], 0) * (1 - SLACK)
                safe = np.maximum(half[cluster], lower)
                near = np.arange(n) if exact else np.flatnonzero(upper >= safe)
                distance[near] = ((x[near] - c[cluster[near]]) ** 2).sum(1)
                upper[near] = up(distance[near])
                doubt = np.flatnonzero(upper >= safe)
            if len(doubt):
                at, own, second = scanned(x[doubt], c)
                cluster[doubt], distance[doubt] = at, own
                upper[doubt], lower[doubt] = up(own), down(second) if k > 1 else np.inf
                scans[doubt] += 1
            columns = [batch.column(0), batch.column(1), *(pa.array(v, f.type) for v, f in zip((cluster.astype(np.int32), upper, lower, distance, scans.astype(np.int32)), list(schema)[2:]))]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(columns, schema)], schema=schema)

    return points.mapInArrow(run, STATE)


def moved(state: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids of the assigned vectors: exact floor(sum / count) by component; empty ones stay. A row a centroid and task is shuffled."""

    def run(batches):
        k, d = len(centroids), len(centroids[0])
        total, n = np.zeros((k, d), object), np.zeros(k, np.int64)
        for batch in common.pieces(batches, 8192):
            at = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
            order = np.argsort(at, kind="stable")
            own, start = np.unique(at[order], return_index=True)
            total[own] += np.add.reduceat(x[order].astype(np.int64), start)  # of at most 8192 rows: no overflow
            n += np.bincount(at, minlength=k)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(n[own], pa.int64()), pa.array([[int(y) for y in total[i]] for i in own], pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = state.select("cluster", "v").mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    each = parts.select("cluster", "n", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("col").cast("decimal(38,0)")).alias("s"))
    out = [list(c) for c in centroids]
    for r in each.collect():
        out[r.cluster][r.pos] = int(r.s) // r.n
    return out


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, id_column: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, v, cluster, upper, lower, distance, scans) of every kept vector, and the final centroids: `rounds` rounds of assignment and new centroids, then one assignment more. scans counts the full scans that a vector took.

    Vectors of another length, null or with a component that is null or not finite are left out. Rows that repeat an
    id are vectors of their own; a null id stays null. With fewer than k vectors there are fewer centroids; an empty
    table gives no rows. Other columns aren't read.
    """
    points = common.stored(kept(vectors, dimensions, id_column, column), "points")
    centroids = first_centroids(points, k)
    if not centroids:
        return points.select("vec_id", "v", *(F.lit(None).cast(t).alias(x) for x, t in (("cluster", "int"), ("upper", "double"), ("lower", "double"), ("distance", "bigint"), ("scans", "int")))), []
    state, before = points, None
    for i in range(rounds + 1):
        after = common.stored(assigned(state, centroids, before, exact=i == rounds), "assigned")
        common.drop_stored(state)
        state = after
        if i < rounds:
            before, centroids = centroids, moved(state, centroids)
    return state, centroids


def op12_clusters(spark, sf_dir: str) -> DataFrame:
    """The clusters of embeddings; a sum that doesn't fit 64 bits is null."""
    found, centroids = clusters(common.load(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    total = lambda: F.sum(F.col("distance").cast("decimal(38,0)"))
    per = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(total().alias("s")).collect()}  # a row a centroid
    fit = lambda n: n if n < 1 << 63 else None
    rows = [(i, fit(per.get(i, 0)), fit(sum(per.values())), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    sums = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    near = "(SELECT vec_id, min(struct_pack(d := d, c := c)) AS m FROM (SELECT p.vec_id, k.c, sum((p.x - k.x) * (p.x - k.x))::BIGINT AS d FROM p JOIN c{i} k ON k.i = p.i GROUP BY ALL) GROUP BY vec_id)"
    steps = ["v AS (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS y FROM embeddings WHERE len(embedding) = 64)",
             "p AS (SELECT vec_id, i, floor(256 * y)::BIGINT AS x FROM v WHERE vec_id NOT IN (SELECT vec_id FROM v WHERE y IS NULL OR NOT isfinite(y)))",
             f"s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM (SELECT DISTINCT vec_id FROM p) ORDER BY sha256('2:' || vec_id) LIMIT {CENTROIDS})",
             "c0 AS MATERIALIZED (SELECT s.c, p.i, p.x FROM s JOIN p USING (vec_id))"]
    for i in range(ROUNDS):
        steps += [f"a{i} AS MATERIALIZED {near.format(i=i)}",
                  f"n{i} AS (SELECT a.m.c AS c, p.i, sum(p.x) AS t, count(*) AS n FROM a{i} a JOIN p USING (vec_id) GROUP BY ALL)",
                  f"c{i + 1} AS MATERIALIZED (SELECT k.c, k.i, coalesce((t - ((t % n) + n) % n) // n, k.x)::BIGINT AS x FROM c{i} k LEFT JOIN n{i} n ON n.c = k.c AND n.i = k.i)"]
    steps += [f"f AS MATERIALIZED {near.format(i=ROUNDS)}", f"h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{ROUNDS} GROUP BY c)"]
    return f"WITH {', '.join(steps)}\nSELECT vec_id, f.m.c::INT AS cluster, f.m.d AS distance, (sum(f.m.d) OVER (PARTITION BY f.m.c))::BIGINT AS cluster_inertia, (sum(f.m.d) OVER ())::BIGINT AS inertia, h.h AS centroid_sha256 FROM f JOIN h ON h.c = f.m.c"


OP12_SQL = _sql()
