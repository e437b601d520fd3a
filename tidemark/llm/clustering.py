"""Lloyd's rounds over whole-number vectors, each vector assigned by an annulus search.

A centroid at distance d of a vector has a norm within d of the vector's. So centroids are sorted by norm, the one with the
next norm gives an upper bound, and only those whose norms lie within that bound of the vector's, found by binary search,
are compared, in whole numbers. The annulus is widened by more than its floating-point error, so that ties at its border
are compared, too.

Centroids (k, a parameter) travel to the tasks; vectors never leave theirs: a task sends its k sums. Sums are exact
decimals. Each round reads the quantised vectors from a written table and is repeated as a whole or in part by Spark.

Defined results: vectors of another length or with a null or non-finite component are left out; fewer vectors than k give
fewer centroids, none gives an empty result; rows that repeat an id count and are returned each, where ids share a hash the
smaller vector starts first; rows without an id start no cluster unless there are too few others; equal distances go to
the smaller cluster. A quantised component whose squared distances could exceed 64 bits fails the query. Further columns
are left alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

DIMS = 64
SCALE = 64


def quantised(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and q, the floor of each scaled component, of the vectors that are whole."""
    most = math.isqrt(2**62 // dims) // 2
    x = F.col("embedding").cast("array<double>")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    number = lambda v: F.when(F.abs(v * scale) <= most, F.floor(v * scale)).otherwise(F.raise_error(F.lit("component too large")).cast("long")).cast("int")
    whole = vectors.select("vec_id", x.alias("x")).where((F.size("x") == dims) & F.forall("x", finite))
    return whole.select("vec_id", F.transform("x", number).alias("q"))


def starts(kept: DataFrame, k: int) -> np.ndarray:
    """The vectors with the k smallest hashes, in their order."""
    digest = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = kept.orderBy(digest.asc_nulls_last(), "q").select("q").limit(k).collect()
    return np.array([r.q for r in rows], dtype=np.int64)


class Annuli:
    """Centroids in the order of their norms."""

    def __init__(self, centroids: np.ndarray):
        norms = np.sqrt((centroids * centroids).sum(axis=1).astype(float))
        self.numbers = np.argsort(norms, kind="stable")
        self.norms, self.centroids = norms[self.numbers], centroids[self.numbers]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and squared distance of each row."""
        norms = np.sqrt((x * x).sum(axis=1).astype(float))
        first = np.minimum(np.searchsorted(self.norms, norms), len(self.norms) - 1)
        best, cluster = ((x - self.centroids[first]) ** 2).sum(axis=1), self.numbers[first]
        reach = np.sqrt(best.astype(float))
        reach += 1e-9 * (norms + reach + 1)
        low, high = np.searchsorted(self.norms, norms - reach, "left"), np.searchsorted(self.norms, norms + reach, "right")
        for j, number in enumerate(self.numbers):
            rows = np.flatnonzero((low <= j) & (j < high) & (first != j))
            d = ((x[rows] - self.centroids[j]) ** 2).sum(axis=1)
            nearer = (d < best[rows]) | ((d == best[rows]) & (number < cluster[rows]))
            best[rows[nearer]], cluster[rows[nearer]] = d[nearer], number
        return cluster, best


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch["q"].flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def updated(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round; those without vectors stay."""
    k, dims = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli, total, count = Annuli(centroids), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _matrix(batch, dims)
            cluster, _ = annuli.nearest(x)
            np.add.at(total, cluster, x)
            count += np.bincount(cluster, minlength=k)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict(
            {"cluster": np.repeat(used, dims), "part": np.tile(np.arange(dims), len(used)), "total": total[used].ravel(), "count": np.repeat(count[used], dims)}
        )

    parts = kept.mapInArrow(sums, "cluster long, part long, total long, count long")
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    out = centroids.copy()
    for r in parts.groupBy("cluster", "part").agg(whole("total").alias("total"), whole("count").alias("count")).collect():  # k x dims rows at most
        out[r.cluster, r.part] = int(r.total) // int(r["count"])
    return out


def assigned(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of each vector."""
    dims = centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = Annuli(centroids)
        for batch in batches:
            cluster, distance = annuli.nearest(_matrix(batch, dims))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return kept.mapInArrow(assign, f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = DIMS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance after the rounds, and the final centroids. vectors: vec_id and embedding."""
    kept = materialize(quantised(vectors, dims, scale))
    centroids = starts(kept, k)
    if not len(centroids):
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        centroids = updated(kept, centroids)
    return materialize(assigned(kept, centroids)), centroids


def cluster_report(vectors: DataFrame, k: int = 16, rounds: int = 3) -> DataFrame:
    """clusters() with the summed distance of each cluster and of all, and a digest of each centroid."""
    found, centroids = clusters(vectors, k, rounds)
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("cluster_inertia")).collect()  # k rows at most
    of, every = {r.cluster: r.cluster_inertia for r in sums}, sum(r.cluster_inertia for r in sums)
    rows = [(i, of.get(i, 0), every, digest) for i, digest in digests]
    small = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 16, rounds: int = 3) -> str:
    steps = [
        f"""kept as materialized (
  select row_number() over () as rn, vec_id, [cast(floor({SCALE} * cast(x as double)) as bigint) for x in embedding] as q
  from embeddings
  where len(embedding) = {DIMS} and list_count(embedding) = {DIMS} and list_bool_and([isfinite(x) for x in embedding])),
parts as materialized (select rn, unnest(q) as x, generate_subscripts(q, 1) as j from kept),
chosen as (select row_number() over (order by sha256('1:' || cast(vec_id as varchar)) nulls last, q) - 1 as c, q from kept),
c0 as materialized (select c, unnest(q) as x, generate_subscripts(q, 1) as j from chosen where c < {k})"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} as materialized (
  select rn, min(d * {k} + c) % {k} as c, min(d * {k} + c) // {k} as d
  from (select p.rn, o.c, cast(sum((p.x - o.x) * (p.x - o.x)) as bigint) as d from parts p join c{i} o using (j) group by p.rn, o.c) group by rn)"""
        )
        if i < rounds:
            steps.append(
                f"""c{i + 1} as materialized (
  select o.c, o.j, case when n is null then o.x else (s - (s % n + n) % n) // n end as x
  from c{i} o left join (select a.c, p.j, sum(p.x) as s, count(*) as n from parts p join a{i} a using (rn) group by a.c, p.j) using (c, j))"""
            )
    last = rounds
    return (
        "with "
        + ",\n".join(steps)
        + f""",
digests as (select c, sha256(string_agg(cast(cast(x as bigint) as varchar), ',' order by j)) as digest from c{last} group by c)
select vec_id, cast(a.c as integer) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by a.c) as bigint) as cluster_inertia,
       cast(sum(d) over () as bigint) as inertia, digest as centroid_sha256
from kept join a{last} a using (rn) join digests g on g.c = a.c"""
    )


SQL = _sql()
