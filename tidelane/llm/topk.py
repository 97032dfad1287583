"""Exact top-k by inner product with multi-resolution segment statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelane.llm.common import cut

#: Vectors of a block of rows and of a packed block of queries; queries that are held against a block at once.
ROW_BLOCK, QUERY_BLOCK, TILE = 8192, 512, 64
#: Numbers of the queries that one pass over the rows takes along (16 MB).
CHUNK_NUMBERS = 1 << 21
#: Rows whose best scores give the first floors, and by how much each further pass for floors reads more.
FIRST_ROWS, MORE = 1 << 16, 16
#: Tasks of a pass at least, and rows of a task.
LEAST_TASKS, TASK_ROWS = 8, 1 << 16

_PACKED = "dim int, n int, ids binary, x binary"


def levels(dim: int) -> list[int]:
    """Numbers of segments, coarse to fine, as long as their two statistics each are at most half of a vector's numbers."""
    out = [4]
    while 8 * out[-1] <= dim:
        out.append(2 * out[-1])
    return [s for s in out if 4 * s <= dim]


def _packer(block: int):
    """Rows (vec_id, embedding) as blocks of whole-number vectors of one length.

    A vector takes no part if its inner product with one as long could leave 63 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def emit(dim: int) -> pa.RecordBatch:
            ids, x = (np.concatenate(p) for p in zip(*held.pop(dim), strict=True))
            values = [[dim], [len(ids)], [ids.tobytes()], [x.tobytes()]]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
                names=["dim", "n", "ids", "x"],
            )

        for batch in batches:
            lists = batch.column(1)
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            starts = np.append(0, np.cumsum(size))[:-1]
            for dim in np.unique(size):
                rows = np.flatnonzero(size == dim)
                x = np.floor(64 * flat[starts[rows][:, None] + np.arange(dim)])
                fit = np.abs(x).max(axis=1) < (2.0**62 / dim) ** 0.5
                rows, x = rows[fit], x[fit].astype(np.int64)
                for a in range(0, len(rows), block):
                    held.setdefault(int(dim), []).append((ids[rows[a : a + block]].astype(np.int64), x[a : a + block]))
                    if sum(len(i) for i, _ in held[int(dim)]) >= block:
                        yield emit(int(dim))
        for dim in list(held):
            yield emit(dim)

    return run


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, times the root of its length: their distance bounds the vectors' from below."""
    parts = np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1]))
    root = np.sqrt([len(p) for p in parts])
    return np.hstack([np.column_stack([x[:, p].mean(axis=1) for p in parts]) * root, np.column_stack([x[:, p].std(axis=1) for p in parts]) * root])


class Side:
    """Vectors of one length with their ids and the statistics of every level, each computed once."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x, self.f = ids, x, x.astype(float)
        self.stats = [segment_statistics(self.f, s) for s in levels(x.shape[1])]
        self.norm = float(np.sqrt((self.f**2).sum(axis=1).max(initial=0)))
        self.top = int(np.abs(x).max(initial=0))


def best_rows(q: Side, a: int, b: int, x: Side, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of every pair of queries a to b and rows that can be among a query's k best.

    The score is (|q|^2 + |x|^2 - d^2) / 2, and statistics of a level have the vectors' norms, so that the inner
    product of two rows of statistics is the score that their lower bound of d allows. A block whose box of coarse
    statistics puts all queries below their floors is skipped. Pairs that a level puts below the floor go; finer
    levels, and the exact scores, are computed for the rows that are left for some query. Queries without a floor get
    one from the block's own k-th best score.
    """
    none = np.zeros(0, np.int64)
    qf = q.f[a:b]
    own = q.ids[a:b]
    least = (floor - 1e-6 * (1 + q.norm * x.norm))[:, None]
    left = np.arange(len(x.ids))
    open_ = np.ones((b - a, len(left)), bool)
    if x.stats:
        low, high = x.stats[0].min(axis=0), x.stats[0].max(axis=0)
        coarse = q.stats[0][a:b]
        box = np.maximum(coarse, 0) @ high + np.minimum(coarse, 0) @ low
        if (box < least[:, 0]).all():
            return none, none, none
    for mine, other in zip(q.stats, x.stats, strict=True):
        open_ &= mine[a:b] @ other[left].T >= least
        some = open_.any(axis=0)
        left, open_ = left[some], open_[:, some]
        if not len(left):
            return none, none, none
    if q.top * x.top * qf.shape[1] < 2**53:
        score = qf @ x.f[left].T
    else:  # beyond what floats hold exactly
        score = q.x[a:b] @ x.x[left].T
    open_ &= own[:, None] != x.ids[left][None, :]
    fresh = np.flatnonzero(np.isneginf(floor))
    if len(fresh) and len(left) > k:
        seen = np.where(open_[fresh], score[fresh].astype(float), -np.inf)
        floor = floor.copy()
        floor[fresh] = np.partition(seen, len(left) - k, axis=1)[:, len(left) - k]
    qi, at = np.nonzero(open_ & (score >= floor[:, None]))
    return qi + a, left[at], score[qi, at].astype(np.int64)


def _searcher(queries: dict[int, tuple[np.ndarray, np.ndarray, int]], floors: dict[int, np.ndarray], k: int):
    """For each task and query its k best of the task's rows; queries and floors are broadcast values by vector length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = queries.value
        sides = {dim: Side(ids, x) for dim, (ids, x, _) in known.items()}
        floor = {dim: f.copy() for dim, f in floors.value.items()}
        top = {dim: tuple(np.zeros(0, np.int64) for _ in range(3)) for dim in known}
        for batch in batches:
            for dim, ids, raw in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if dim not in sides:
                    continue
                q = sides[dim]
                x = Side(np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, dim))
                got = [top[dim]]
                for a in range(0, len(q.ids), TILE):
                    b = min(a + TILE, len(q.ids))
                    qi, xi, score = best_rows(q, a, b, x, k, floor[dim][a:b])
                    got.append((qi, x.ids[xi], score))
                qi, vec, score = (np.concatenate(p) for p in zip(*got, strict=True))
                order = np.lexsort((vec, -score, qi))
                qi, vec, score = qi[order], vec[order], score[order]
                place = np.arange(len(qi)) - np.searchsorted(qi, qi)
                keep = place < k
                top[dim] = (qi[keep], vec[keep], score[keep])
                last = place == k - 1
                floor[dim][qi[last]] = np.maximum(floor[dim][qi[last]], score[last])
        for dim, (qi, vec, score) in top.items():
            columns = [qi + known[dim][2], known[dim][0][qi], vec, score]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["query", "query_id", "vec_id", "score"])

    return run


def _chunk(queries: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, int]]:
    """A chunk's queries by vector length: ids, vectors and the number of the first one."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for row in queries.toArrow().to_pylist():
        held.setdefault(row["dim"], []).append((np.frombuffer(row["ids"], np.int64), np.frombuffer(row["x"], np.int64).reshape(-1, row["dim"])))
    out, first = {}, 0
    for dim in sorted(held):
        ids, x = (np.concatenate(p) for p in zip(*held[dim], strict=True))
        order = np.lexsort((*x.T[::-1], ids))
        out[dim] = (ids[order], x[order], first)
        first += len(ids)
    return out


def top_k(vectors: DataFrame, every: int, k: int, chunk_numbers: int = CHUNK_NUMBERS, first_rows: int = FIRST_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row whose vec_id is divisible by `every`.

    Components become floor(64 x); the score is their inner product, ties go to the smaller vec_id, and rows of the
    query's own id are no candidates. Vectors that are null or hold a null or non-finite component take no part, and
    neither do rows without id, nor vectors with a component of 2^31 / sqrt(length) or more after rounding, whose
    scores a long can't hold; vectors meet only vectors of their length. Repeated rows are candidates (and queries) of
    their own. Fewer than k candidates are all returned. Other columns are not read.

    Rows are packed into blocks of a fixed number of vectors, written once, and stay where they are: queries come to
    them in chunks of chunk_numbers numbers, each broadcast for one pass over the blocks. Before the pass over all
    blocks, passes over a 16th, a 256th, ... of them, down to first_rows rows, give each query a floor, so that a pass
    returns about 16 k rows a query at most, however many tasks it has.
    """
    spark = vectors.sparkSession
    ok = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(
        "embedding",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).where(F.col("vec_id").isNotNull() & ok)
    tasks = max(LEAST_TASKS, rows.count() // TASK_ROWS)
    blocks = cut(rows.repartition(tasks, "vec_id").mapInArrow(_packer(ROW_BLOCK), _PACKED))
    queries = cut(rows.where(F.col("vec_id") % every == 0).mapInArrow(_packer(QUERY_BLOCK), _PACKED))
    n_rows = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    numbers = queries.agg(F.coalesce(F.sum(F.col("n").cast("long") * F.col("dim")), F.lit(0))).head()[0]
    chunks = -(-numbers // chunk_numbers)
    shares = [1]
    while n_rows // shares[-1] > first_rows:
        shares.append(shares[-1] * MORE)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    out = None
    for c in range(chunks):
        asked = _chunk(queries.where(F.pmod(F.xxhash64("ids", "x"), F.lit(chunks)) == c))
        held = spark.sparkContext.broadcast(asked)
        floors = {dim: np.full(len(ids), -np.inf) for dim, (ids, _, _) in asked.items()}
        for share in shares[::-1]:
            part = blocks.where(F.pmod(F.xxhash64("ids"), F.lit(share)) == 0) if share > 1 else blocks
            found = part.mapInArrow(_searcher(held, spark.sparkContext.broadcast(floors), k), "query long, query_id long, vec_id long, score long")
            ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            if share > 1:
                floors = {dim: f.copy() for dim, f in floors.items()}
                for r in ranked.where(F.col("rank") == k).select("query", "score").toArrow().to_pylist():
                    dim = max((d for d, (*_, first) in asked.items() if first <= r["query"]), key=lambda d: asked[d][2])
                    at = r["query"] - asked[dim][2]
                    floors[dim][at] = max(floors[dim][at], r["score"])
        done = ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        done = cut(done) if chunks > 1 else done
        out = done if out is None else out.unionByName(done)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long") if out is None else out
