"""Approximate nearest neighbours by learned partitions.

On a bounded sample of the vectors the exact neighbour graph is built and split into
parts of nearly equal size that keep neighbours together.  A small classifier (one linear
layer and a softmax) learns which part a vector belongs to.  Every vector of the table is
indexed in its most probable part; a query visits its several most probable parts and is
compared there with all vectors, in double precision.  How many parts to visit is
measured: the fewest with which the sample's own queries reach ``recall`` against brute
force.

Parts are cut into blocks of about ``BLOCK`` vectors, and so are the queries that visit
a part, so the unit of work is a block against a block, however large a part is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut

#: Vectors that the partition is learnt from, at most.
SAMPLE = 3_000
PARTS = 32
NEIGHBOURS = 15
ROUNDS = 12
STEPS = 200
#: Share of the true neighbours that the sample's queries must find.
RECALL = 0.96
BLOCK = 4_096


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest others of each row, by inner product."""
    near = x @ x.T
    np.fill_diagonal(near, -np.inf)
    return np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(x) - 1)]


def split_graph(graph: np.ndarray, parts: int, seed: int) -> np.ndarray:
    """A balanced partition: rounds in which nodes move to where most neighbours are, as far as there is room."""
    m = len(graph)
    room = -(-m * 21 // (20 * parts))
    label = np.random.default_rng(seed).permutation(m) % parts
    for _ in range(ROUNDS):
        pull = np.zeros((m, parts))
        for c in range(graph.shape[1]):
            np.add.at(pull, (np.arange(m), label[graph[:, c]]), 1.0)
            np.add.at(pull, (graph[:, c], label), 1.0)
        new, size = np.full(m, -1), np.zeros(parts, dtype=np.int64)
        for flat in np.argsort(-pull, axis=None, kind="stable").tolist():
            i, k = divmod(flat, parts)
            if new[i] < 0 and size[k] < room:
                new[i], size[k] = k, size[k] + 1
        still = (new == label).mean()
        label = new
        if still > 0.99:
            break
    return label


def learn_router(x: np.ndarray, label: np.ndarray, parts: int) -> np.ndarray:
    """Weights (parts, dimensions + 1) of a softmax, by gradient steps with momentum."""
    scale = np.sqrt((x**2).sum(axis=1).mean()) or 1.0
    a = np.hstack([x / scale, np.ones((len(x), 1))])
    w, pace, goal = np.zeros((parts, a.shape[1])), 0.0, np.eye(parts)[label]
    for _ in range(STEPS):
        z = a @ w.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        pace = 0.9 * pace + (p - goal).T @ a / len(x) + 1e-4 * w
        w -= 2.0 * pace
    w[:, :-1] /= scale
    return w


@dataclass(frozen=True)
class Router:
    weights: np.ndarray
    probes: int

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts of each row, most probable first."""
        return np.argsort(-(x @ self.weights[:, :-1].T + self.weights[:, -1]), axis=1, kind="stable")


def train(x: np.ndarray, k: int, parts: int = PARTS, recall: float = RECALL, seed: int = 29) -> Router:
    """Partition, classifier and number of parts to visit, from a sample of vectors."""
    parts = max(1, min(parts, len(x) // 8))
    if parts == 1:
        return Router(np.zeros((1, x.shape[1] + 1)), 1)
    router = Router(learn_router(x, split_graph(neighbour_graph(x, NEIGHBOURS), parts, seed), parts), parts)
    order = router.order(x)
    queries = np.arange(0, len(x), max(1, len(x) // 500))
    truth = neighbour_graph(x, k)[queries]
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None, :], axis=1)
    needed = place[queries[:, None], order[truth, 0]]  # how many parts a query must visit for each neighbour
    found = np.array([(needed < p).mean() for p in range(1, parts + 1)])
    return Router(router.weights, int(np.argmax(found >= recall)) + 1)


def usable(vector: Column) -> Column:
    """Not null, not zero, and every component finite."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda v: v != 0), F.lit(False))


def search(vectors: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int, seed: int = 29) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every query, nearest first.

    Nearness is the inner product of the original vectors in double precision, ties go to
    the smaller id.  Rows of one id count once (the largest vector in array order); null ids
    and unusable vectors take no part, nor do vectors of another length than the sample's
    most common one.  A query is no candidate of its own.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), is_query.alias("q")).where(usable(F.col("v")))
    rows = rows.groupBy("id").agg(F.max("v").alias("v"), F.max("q").alias("q"))
    sample = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(SAMPLE).select("v").collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return vectors.sparkSession.createDataFrame([], schema)
    lengths = [len(r["v"]) for r in sample]
    size = max(sorted(set(lengths)), key=lengths.count)
    router = train(np.array([r["v"] for r in sample if len(r["v"]) == size]), k)
    shared = vectors.sparkSession.sparkContext.broadcast(router)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, size)
            order = shared.value.order(x) if len(x) else np.zeros((0, 1), dtype=np.int64)
            asked = batch.column(2).fill_null(False).to_numpy(zero_copy_only=False)
            visits = pa.array([o[: shared.value.probes].tolist() if q else None for o, q in zip(order, asked, strict=True)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(order[:, 0].astype(np.int32)), visits], names=["id", "x", "part", "visits"])

    routed = cut(rows.where(F.size("v") == size).mapInArrow(route, "id long, x binary, part int, visits array<int>"), "routed")
    parts = len(router.weights)
    total = routed.count()

    def blocked(part: DataFrame, n: int, name: str) -> DataFrame:
        blocks = max(1, -(-n // (parts * BLOCK)))
        dealt = part.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
        return dealt.groupBy("part", "block").agg(F.collect_list("id").alias(f"{name}_id"), F.collect_list("x").alias(f"{name}_x")).drop("block")

    queries = routed.where(F.col("visits").isNotNull()).select("id", "x", F.explode("visits").alias("part"))
    pairs = blocked(routed.select("id", "x", "part"), total, "c").join(blocked(queries, total // 20 * router.probes, "q"), "part")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lambda cell: np.frombuffer(b"".join(cell.as_py()), dtype=np.float64).reshape(-1, size)
        for batch in batches:
            for c_id, c_x, q_id, q_x in zip(*batch.columns, strict=True):
                ids, asked = c_id.values.to_numpy(), q_id.values.to_numpy()
                order = np.argsort(ids, kind="stable")  # ties: smaller ids first
                ids, x, y = ids[order], table(c_x)[order], table(q_x)
                for lo in range(0, len(asked), 512):
                    own = asked[lo : lo + 512]
                    score = y[lo : lo + 512] @ x.T
                    score[own[:, None] == ids[None, :]] = -np.inf
                    keep = np.argsort(-score, axis=1, kind="stable")[:, :k]
                    best = np.take_along_axis(score, keep, axis=1).ravel()
                    fine = best > -np.inf
                    # the score again as a plain sum, so that it does not depend on how blocks are multiplied
                    who, which = np.repeat(np.arange(len(own)), keep.shape[1])[fine], keep.ravel()[fine]
                    exact = np.einsum("ij,ij->i", y[lo : lo + 512][who], x[which])
                    yield pa.RecordBatch.from_pydict({"query_id": own[who], "vec_id": ids[which], "score": exact})

    found = pairs.select("c_id", "c_x", "q_id", "q_x").mapInArrow(compare, "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
