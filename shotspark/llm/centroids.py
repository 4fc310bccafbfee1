"""Centroid clustering with a LAESA pivot table.

Components become integers, floor(64 * x), and all distances and means are exact integers. The
distances of every vector to a few fixed pivots are computed once and stored beside the vector.
In each round the driver knows the distances from the pivots to the k centroids; the triangle
inequality then bounds the distance of a vector to every centroid from below by the largest
difference of the two. The centroid with the lowest bound is measured first, and only centroids
whose bound does not exceed that distance are measured too. Bounds are lowered by a margin above
all rounding, so a centroid that ties or wins is never passed over.

A round is one pass over the stored table: tasks hand over one row per cluster and dimension,
Spark adds them up, and the driver holds k x dim sums. Hot vectors need nothing special, since no
row ever meets another one.

Cases: vectors that are null, of another length, or hold null, NaN or infinite entries are
dropped; repeated rows stay and count each; a null key is written as an empty text where keys are
hashed, and rows with equal hashes start in the order of their vectors; ties go to the smaller
number; a cluster without vectors keeps its centroid; fewer vectors than ``k`` give fewer
clusters; an empty table gives an empty result. Entries beyond +-2**27 after scaling raise, since
their squared distances leave 64 bits. Only key and vector are read, so further columns cannot clash.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotspark.llm.common import stored, table

CLUSTERS, ROUNDS, DIM, SCALE = 16, 3, 64, 64
PIVOTS = 16  # pivots of the table
POOL = 256  # vectors among which the pivots are chosen
ROWS = 4096  # vectors measured together
LIMIT = 1 << 27


def integers(rows: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """key, x (array of long) of the rows that stay."""
    v = F.col(vector)
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    fine = v.isNotNull() & (F.size(v) == dim) & sound
    wide = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE))
    bound = F.forall(v, lambda c: F.abs(c.cast("double")) < LIMIT / SCALE)
    whole = F.when(bound, wide).otherwise(F.raise_error(F.lit("a vector entry is too large for exact distances")))
    return rows.filter(fine).select(F.col(key).alias("key"), whole.alias("x"))


def _first(kept: DataFrame, n: int, dim: int) -> np.ndarray:
    """The ``n`` vectors with the smallest hash of ``1:<key>``, in that order."""
    name = F.concat(F.lit("1:"), F.coalesce(F.col("key").cast("string"), F.lit("")))
    rows = kept.select(F.sha2(name, 256).alias("h"), "x").orderBy("h", "x").limit(n).collect()
    return np.array([r["x"] for r in rows], np.int64).reshape(len(rows), dim)


def choose_pivots(pool: np.ndarray, n: int) -> np.ndarray:
    """Pivots far from each other: each is the vector of the pool farthest from those before it."""
    chosen = [0]
    near = squared(pool, pool[0])
    while len(chosen) < min(n, len(pool)):
        far = int(near.argmax())
        if near[far] == 0:
            break
        chosen.append(far)
        near = np.minimum(near, squared(pool, pool[far]))
    return pool[chosen]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors, row by row."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(points)))
    for i, p in enumerate(points):
        out[:, i] = np.sqrt(squared(x, p))
    return out


def nearest(x: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, between: np.ndarray) -> tuple:
    """Number of the nearest centroid of each vector, the exact squared distance, and how many
    distances were measured. ``between`` has the distances from the pivots to the centroids."""
    bound = np.zeros((len(x), len(centroids)))
    for p in range(between.shape[0]):
        own, theirs = to_pivots[:, p, None], between[p][None]
        np.maximum(bound, np.abs(own - theirs) - 1e-9 * (own + theirs + 1), out=bound)
    number = bound.argmin(axis=1)
    best = squared(x, centroids[number])
    left = bound <= np.sqrt(best)[:, None] * (1 + 1e-9)
    left[np.arange(len(x)), number] = False
    measured = len(x)
    for c in range(len(centroids)):  # ascending, so that a tie keeps the smaller number
        rows = np.flatnonzero(left[:, c])
        measured += len(rows)
        d = squared(x[rows], centroids[c])
        wins = (d < best[rows]) | ((d == best[rows]) & (c < number[rows]))
        best[rows[wins]], number[rows[wins]] = d[wins], c
    return number, best, measured


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), -1)


def _parts(batches, centroids, between):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            x = _matrix(part.column("x"), np.int64)
            number, best, _ = nearest(x, _matrix(part.column("pivots"), np.float64), centroids, between)
            yield part, x, number, best


def pivot_table(kept: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The rows with ``pivots``, their distances to the pivots."""

    def compute(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                d = _distances(_matrix(part.column("x"), np.int64), pivots)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * d.shape[1], pa.int32()), pa.array(d.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("x"), flat], ["key", "x", "pivots"])

    key_type = kept.schema["key"].dataType.simpleString()
    return kept.mapInArrow(compute, f"key {key_type}, x array<long>, pivots array<double>")


def _sums(measured: DataFrame, centroids: np.ndarray, between: np.ndarray) -> list:
    """(cluster, dimension, rows, sum) of all vectors by their nearest centroid."""

    def compute(batches):
        k, dim = centroids.shape
        n, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for _, x, number, _ in _parts(batches, centroids, between):
            n += np.bincount(number, minlength=k)
            for c in np.unique(number):
                total[c] += x[number == c].sum(axis=0)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(seen, dim).astype(np.int32)), pa.array(np.tile(np.arange(dim, dtype=np.int32), len(seen))),
                pa.array(np.repeat(n[seen], dim)), pa.array(total[seen].ravel()),
            ],
            ["cluster", "dim", "n", "s"],
        )

    parts = measured.select("x", "pivots").mapInArrow(compute, "cluster int, dim int, n long, s long")
    added = parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    return added.collect()  # k x dim rows


def cluster(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM
) -> tuple[DataFrame, np.ndarray]:
    """key, cluster, distance of each vector that stays, and the final centroids."""
    kept, _ = stored(integers(rows, key, vector, dim), "vectors")
    pool = _first(kept, max(POOL, k), dim)
    centroids = pool[:k].copy()
    schema = f"key {kept.schema['key'].dataType.simpleString()}, cluster int, distance long"
    if not len(pool):
        return kept.sparkSession.createDataFrame([], schema), centroids
    pivots = choose_pivots(pool, PIVOTS)
    measured, _ = stored(pivot_table(kept, pivots), "pivot-table")
    for _ in range(rounds):
        for r in _sums(measured, centroids, _distances(pivots, centroids)):
            centroids[r["cluster"], r["dim"]] = int(r["s"]) // r["n"]
    between = _distances(pivots, centroids)

    def assign(batches):
        for part, _, number, best in _parts(batches, centroids, between):
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), pa.array(number.astype(np.int32)), pa.array(best)], ["key", "cluster", "distance"]
            )

    found, _ = stored(measured.mapInArrow(assign, schema), "assigned")
    return found, centroids


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance, inertia and digest of the centroid of each vector."""
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    sums = dict(found.groupBy("cluster").agg(F.sum("distance")).collect())  # one row per cluster
    facts = spark.createDataFrame(
        [(c, s, sum(sums.values()), digests[c]) for c, s in sums.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return found.join(F.broadcast(facts), "cluster").select(
        F.col("key").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _sql() -> str:
    """The same in plain SQL: every distance, and one step per round."""
    near = """a{r} as (select id, arg_min(c, (d, c)) as c, min(d) as d from (
  select id, c, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - m.x[i]) * (v.x[i] - m.x[i]))) as d
  from v, c{r} m) group by id)"""
    mean = """m{r} as (select c, list(s order by i) as x from (
  select c, i, cast((s - ((s % n) + n) % n) // n as bigint) as s from (
    select c, i, cast(sum(x) as bigint) as s, count(*) as n from (
      select c, unnest(v.x) as x, unnest(range(1, 65)) as i from a{r} join v using (id)) group by c, i)) group by c),
c{n} as (select c{r}.c, coalesce(m{r}.x, c{r}.x) as x from c{r} left join m{r} using (c))"""
    steps = [
        """v as (select row_number() over () as id, vec_id,
  list_transform(embedding, lambda e: cast(floor(64 * cast(e as double)) as bigint)) as x from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = 64)""",
        """c0 as (select row_number() over (order by h, x) - 1 as c, x from (
  select sha256('1:' || coalesce(cast(vec_id as varchar), '')) as h, x from v order by h, x limit 16))""",
    ]
    for r in range(ROUNDS):
        steps += [near.format(r=r), mean.format(r=r, n=r + 1)]
    steps.append(near.format(r=ROUNDS))
    return f"""with {", ".join(steps)}
select vec_id, cast(a{ROUNDS}.c as integer) as cluster, cast(d as bigint) as distance,
  cast(sum(d) over (partition by a{ROUNDS}.c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
  sha256(array_to_string(c{ROUNDS}.x, ',')) as centroid_sha256
from a{ROUNDS} join v using (id) join c{ROUNDS} on c{ROUNDS}.c = a{ROUNDS}.c"""


OP13_SQL = _sql()
