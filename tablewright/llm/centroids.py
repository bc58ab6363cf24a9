"""Lloyd's clustering sharded over dimensions, in exact integers.

Vectors are scaled to integers and cut into column blocks: a *shard* is ``WIDTH`` dimensions, and
a *chunk* is up to ``CHUNK`` vectors. One block, a chunk's numbers in one shard, is one record. In
each round

1. block tasks compute exact partial squared distances to their shard's slice of the centroids,
2. a shuffle by chunk adds the blocks' partial distances, and the least sum (then the
   smaller number) is each vector's cluster,
3. the clusters go back to the blocks, which are dealt by (shard, chunk) once and do not move
   again; every shard sums its dimensions by cluster and updates its own slice by exact floor
   division. An empty cluster keeps its slice.

At scale: tasks are as many as the blocks need, however the vectors lay and however many shuffle
partitions there are, so that many small partitions do not make many tasks in each of the rounds' stages. A
task holds about ``BLOCKS`` blocks or their distances, whatever the number of vectors or their length, and no key has more than one record per shard or chunk, so
there is no hot key. Partial sums of a shard are combined before their shuffle. The driver gets, and tasks
are sent, the centroids alone: clusters * dimensions integers. Blocks are written to the shared
folder once; a round depends on them and on the centroids before it, so lineage does not grow, and a
lost executor costs a re-read of its blocks. Distances are 64-bit integers, sums unbounded ones:
results do not depend on the order of rows.

Defined results: vectors of another length, or with a null or non-finite component, are left out. A
scaled component beyond 2**27 is refused with an error, since distances could pass 64 bits. Fewer vectors
than clusters make fewer clusters. A null id starts a cluster only after all others; vectors whose ids hash alike start in
the order of their components. Repeated rows are vectors of their own. No vector: no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import discarding_stages, staged

CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
#: Dimensions of a shard, and vectors of a chunk.
WIDTH = 16
CHUNK = 4096
#: Blocks that a task takes at least, if there are more than executors' cores: 16 MB of full ones.
BLOCKS = 64
#: Largest scaled component.
LIMIT = 1 << 27


def usable(vector: Column, dims: int) -> Column:
    """Exactly ``dims`` components, none null or non-finite."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def first_vectors(kept: DataFrame, clusters: int) -> list[list[int]]:
    """The scaled vectors whose ids hash least; ``kept``: id, vector."""
    hashed = F.sha2(F.concat(F.lit("3:"), F.col("id").cast("string")), 256)
    scaled = F.transform("vector", lambda x: F.floor(x * SCALE).cast("bigint"))
    ranked = kept.select(hashed.alias("hash"), scaled.alias("scaled"))
    # written first: of a limit that is collected, every partition would send its rows to the driver
    first = staged(ranked.orderBy(F.col("hash").asc_nulls_last(), "scaled").limit(clusters), "first")
    return [r["scaled"] for r in first.orderBy(F.col("hash").asc_nulls_last(), "scaled").collect()]


def cut_into_blocks(kept: DataFrame, dims: int) -> DataFrame:
    """(chunk, shard, ids, block): int32 numbers, row by row. Ids stand with shard 0 only."""
    id_type = kept.schema["id"].dataType.simpleString()
    schema = f"chunk bigint, shard int, ids array<{id_type}>, block binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for begin in range(0, batch.num_rows, CHUNK):
                part = batch.slice(begin, CHUNK)
                vectors = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                scaled = np.floor(vectors * SCALE)
                if np.abs(scaled).max() > LIMIT:
                    raise ValueError(f"a component beyond {LIMIT // SCALE} cannot be clustered exactly")
                numbers = scaled.astype("<i4")
                ids = part.column("id")
                for shard, start in enumerate(range(0, dims, WIDTH)):
                    some = ids if shard == 0 else ids.slice(0, 0)
                    lists = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some)
                    block = np.ascontiguousarray(numbers[:, start : start + WIDTH]).tobytes()
                    columns = [pa.array([chunk], pa.int64()), pa.array([shard], pa.int32()), lists, pa.array([block], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["chunk", "shard", "ids", "block"])
                chunk += 1

    return kept.mapInArrow(run, schema)


def slices(centroids: np.ndarray) -> list[np.ndarray]:
    """Each shard's columns."""
    return [centroids[:, k : k + WIDTH] for k in range(0, centroids.shape[1], WIDTH)]


def partial_distances(block: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Squared distances in one shard: a row per vector, a column per centroid."""
    wide = block.astype(np.int64)
    return np.stack([np.square(wide - c).sum(axis=1) for c in piece], axis=1)


def block_sums(block: np.ndarray, nearest: np.ndarray, clusters: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums by cluster and how many vectors each has, as unbounded integers."""
    sums = np.stack([block[nearest == c].sum(axis=0, dtype=np.int64) for c in range(clusters)])
    return sums.astype(object), np.bincount(nearest, minlength=clusters).astype(object)


@dataclass(frozen=True)
class Clusters:
    """What rounds ended with: the clusters' vectors, and a row per vector."""

    centroids: np.ndarray
    assigned: DataFrame  # id, cluster, distance

    def digests(self) -> list[str]:
        return [sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids.tolist()]


def merged(add: Callable) -> Callable[[Iterable], Iterator]:
    """For ``mapPartitions``: the values of each key added up; a task has few keys, or few blocks."""

    def run(records: Iterable) -> Iterator:
        totals = {}
        for key, value in records:
            totals[key] = add(totals[key], value) if key in totals else value
        yield from totals.items()

    return run


def meet(records: Iterable) -> Iterator:
    """(shard, numbers, nearest) from blocks, as bytes, and clusters that come under the same keys."""
    waiting = {}
    for key, value in records:
        if key not in waiting:
            waiting[key] = value
            continue
        first = waiting.pop(key)
        block, nearest = (first, value) if isinstance(first, bytes) else (value, first)
        yield key[0], block, nearest
    if waiting:
        raise RuntimeError(f"{len(waiting)} blocks and clusters did not meet")


class _Blocks:
    """Blocks dealt by (shard, chunk) to tasks of about ``BLOCKS`` each, however many partitions they lie in."""

    def __init__(self, table: DataFrame, dims: int):
        self.table, self.dims = table, dims
        rows = table.select("shard", "chunk", "block").rdd
        n = table.count()
        self.tasks = max(1, -(-n // BLOCKS), min(n, table.sparkSession.sparkContext.defaultParallelism))
        self.dealt = rows.map(lambda r: ((r["shard"], r["chunk"]), bytes(r["block"]))).partitionBy(self.tasks)

    def _read(self, keyed: RDD, tasks: int | None = None) -> RDD:
        """Records that lie with their key, by as many tasks as asked for at most."""
        return keyed.coalesce(min(self.tasks, tasks or self.tasks))

    def nearest(self, centroids: np.ndarray) -> RDD:
        """(chunk, (cluster, distance) of its vectors)."""
        dims, sent = self.dims, self.table.sparkSession.sparkContext.broadcast(slices(centroids))

        def partial(record):
            (shard, chunk), block = record
            numbers = np.frombuffer(block, "<i4").reshape(-1, min(WIDTH, dims - shard * WIDTH))
            return chunk, partial_distances(numbers, sent.value[shard])

        def least(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            best = total.argmin(axis=1)  # the smaller number of equals
            return best.astype("<i4"), total[np.arange(len(best)), best]

        add = merged(np.add)
        partials = self._read(self.dealt).map(partial).mapPartitions(add)
        return self._read(partials.partitionBy(self.tasks)).mapPartitions(add).mapValues(least)

    def updated(self, centroids: np.ndarray) -> np.ndarray:
        """The centroids after one round; each shard divides its own slice."""
        dims, k = self.dims, len(centroids)
        shards = range(len(slices(centroids)))
        sent = self.table.sparkSession.sparkContext.broadcast(slices(centroids))
        clusters = self.nearest(centroids).flatMap(lambda r: [((s, r[0]), r[1][0]) for s in shards])

        def sums(record):
            shard, block, nearest = record
            numbers = np.frombuffer(block, "<i4").reshape(-1, min(WIDTH, dims - shard * WIDTH))
            return shard, block_sums(numbers, nearest, k)

        def divide(record):
            shard, (total, n) = record
            old = sent.value[shard]
            return shard, [[int(t // n[c]) for t in total[c]] if n[c] else old[c].tolist() for c in range(k)]

        add = merged(lambda a, b: (a[0] + b[0], a[1] + b[1]))
        # both sides are dealt alike, so only the clusters move
        met = self._read(self.dealt.union(clusters.partitionBy(self.tasks))).mapPartitions(meet)
        summed = met.map(sums).mapPartitions(add).partitionBy(len(shards))
        found = dict(self._read(summed, len(shards)).mapPartitions(add).map(divide).collect())
        return np.hstack([np.array(found[s], np.int64).reshape(k, -1) for s in shards]) if found else centroids


def cluster(
    vectors: DataFrame, *, dims: int, clusters: int = CLUSTERS, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding"
) -> Clusters:
    """``rounds`` rounds, then every vector's cluster and squared distance."""
    spark = vectors.sparkSession
    bare = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    kept = bare.filter(usable(F.col("vector"), dims))
    id_type = kept.schema["id"].dataType.simpleString()
    with discarding_stages(spark):
        centroids = np.array(first_vectors(kept, clusters), np.int64).reshape(-1, dims)
        if not len(centroids):
            return Clusters(centroids, spark.createDataFrame([], f"id {id_type}, cluster int, distance bigint"))
        table = staged(cut_into_blocks(kept, dims), "blocks")
        blocks = _Blocks(table, dims)
        for _ in range(rounds):
            centroids = blocks.updated(centroids)
        final = blocks.nearest(centroids).map(lambda r: (r[0], r[1][0].tolist(), r[1][1].tolist()))
        final = spark.createDataFrame(final, "chunk bigint, clusters array<int>, distances array<bigint>")
        members = table.filter("shard = 0").select("chunk", "ids")
        each = members.join(final, "chunk").select(F.explode(F.arrays_zip("ids", "clusters", "distances")).alias("v"))
        assigned = each.select(F.col("v.ids").alias("id"), F.col("v.clusters").alias("cluster"), F.col("v.distances").alias("distance"))
        return Clusters(centroids, staged(assigned, "assigned", keep=True))


def with_inertia(found: Clusters) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector."""
    spark = found.assigned.sparkSession
    wide = F.col("distance").cast("decimal(38,0)")
    sums = {r["cluster"]: int(r["total"]) for r in found.assigned.groupBy("cluster").agg(F.sum(wide).alias("total")).collect()}
    rows = [(c, sums.get(c, 0), sum(sums.values()), digest) for c, digest in enumerate(found.digests())]
    of = spark.createDataFrame(rows, "number int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    met = found.assigned.join(F.broadcast(of), F.col("cluster") == F.col("number"))  # a row per cluster
    return met.drop("number")
