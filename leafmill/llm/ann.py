"""Nearest neighbours by vantage-point trees.

Every partition of the vectors is a shard with trees of its own, over unit vectors by Euclidean distance, which orders
like the cosine and keeps the triangle inequality. A node holds, for both halves, the least and the largest distance to its
vantage point; a query skips a half that must lie farther than relax * (distance of its k-th nearest so far). relax = 1
is exact search; below 1 more is skipped. A shard's trees are built once; queries go through them in blocks of bounded size, all of
a block together; the shards' k best are merged by a window.

Results are scored again on the original vectors in double precision, adding up in order of the dimensions.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part; cosines are taken between vectors of
one length only; ties go to the smaller id; a query's own id is never its neighbour; of rows with one id and equal
vectors one counts, and a query id with different vectors is asked with the vector that sorts first; a null id takes no part;
columns other than vec_id and embedding are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import lean, pick, stored

K = 5
LEAF = 256
#: Queries that are sent to the shards at once, and vectors of a shard's tree.
QUERY_BLOCK, SHARD_ROWS = 4096, 65_536
#: Numbers of the vectors of either side of pairs that are scored at once.
PAIR_NUMBERS = 1 << 20
#: Rounding that pruning allows for.
SLACK = 1e-7
FOUND = "query_id long, vec_id long, score double"


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, adding up from the first dimension to the last."""
    dot, left, right = (np.zeros(len(a)) for _ in range(3))
    for j in range(a.shape[1]):
        dot, left, right = dot + a[:, j] * b[:, j], left + a[:, j] * a[:, j], right + b[:, j] * b[:, j]
    return dot / (np.sqrt(left) * np.sqrt(right))


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def reach(self, rows: np.ndarray) -> np.ndarray:
        """Distance of each query's k-th nearest."""
        worst = self.scores[rows, -1]
        return np.where(np.isinf(worst), np.inf, np.sqrt(np.maximum(2 - 2 * np.where(np.isinf(worst), 0, worst), 0)))

    def offer(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, unit: np.ndarray) -> None:
        """Candidates for the queries of these rows: every pair that may be among the k best is scored exactly."""
        near = self.unit[rows] @ unit.T >= (self.scores[rows, -1] - SLACK)[:, None]
        near &= self.ids[rows][:, None] != ids[None, :]
        q, c = np.nonzero(near)
        if not len(q):
            return
        step = max(1, PAIR_NUMBERS // vectors.shape[1])
        score = np.concatenate([cosine(self.vectors[rows[q[i : i + step]]], vectors[c[i : i + step]]) for i in range(0, len(q), step)])
        some = np.unique(q)
        k = self.k
        whole_q = np.concatenate([q, np.repeat(some, k)])
        whole_s = np.concatenate([score, self.scores[rows[some]].ravel()])
        whole_i = np.concatenate([ids[c], self.found[rows[some]].ravel()])
        order = np.lexsort((-whole_s, whole_i, whole_q))
        whole_q, whole_s, whole_i = whole_q[order], whole_s[order], whole_i[order]
        again = np.zeros(len(order), bool)  # an id that is there with a better score
        again[1:] = (whole_q[1:] == whole_q[:-1]) & (whole_i[1:] == whole_i[:-1]) & (whole_s[1:] > -np.inf)
        whole_q, whole_s, whole_i = whole_q[~again], whole_s[~again], whole_i[~again]
        order = np.lexsort((whole_i, -whole_s, whole_q))
        whole_q, whole_s, whole_i = whole_q[order], whole_s[order], whole_i[order]
        start = np.searchsorted(whole_q, some)
        at = start[:, None] + np.arange(k)
        self.scores[rows[some]], self.found[rows[some]] = whole_s[at], whole_i[at]


class Tree:
    """A vantage-point tree over the rows of a matrix. Halves are cut at the median, so equal vectors can't unbalance it."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        self.root = self.built(np.arange(len(ids)))

    def built(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        # The vantage point is the row farthest from the first: points at the edge cut best.
        first = self.unit[rows[0]]
        vantage = self.unit[rows[np.argmin(self.unit[rows] @ first)]]
        far = np.linalg.norm(self.unit[rows] - vantage, axis=1)
        order = np.argsort(far, kind="stable")
        half = len(rows) // 2
        near, rest = order[:half], order[half:]
        return vantage, [(far[x].min(), far[x].max(), self.built(rows[x])) for x in (near, rest)]

    def search(self, best: Best, relax: float = 1.0) -> None:
        self.visit(self.root, best, np.arange(len(best.ids)), relax)

    def visit(self, node, best: Best, queries: np.ndarray, relax: float) -> None:
        if isinstance(node, np.ndarray):
            best.offer(queries, self.ids[node], self.vectors[node], self.unit[node])
            return
        vantage, halves = node
        far = np.linalg.norm(best.unit[queries] - vantage, axis=1)
        nearer = far <= (halves[0][1] + halves[1][0]) / 2
        for mine, (first, second) in ((nearer, halves), (~nearer, halves[::-1])):
            own, d = queries[mine], far[mine]
            if not len(own):
                continue
            for low, high, child in (first, second):
                least = np.maximum(np.maximum(d - high, low - d), 0)
                open_ = least <= relax * best.reach(own) + SLACK
                if open_.any():
                    self.visit(child, best, own[open_], relax)


def usable(vectors: DataFrame) -> DataFrame:
    """id, v: the rows that take part, their vectors in double precision."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists(v, lambda x: x != 0)
    rows = pick(vectors, id="vec_id", v="embedding").select(F.col("id").cast("bigint"), v.cast("array<double>"))
    return rows.where(F.col("id").isNotNull() & F.coalesce(finite & nonzero, F.lit(False)))


def matrix(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of a list column, by list length: row numbers and their matrix."""
    lengths, out = np.asarray(column.value_lengths()), {}
    flat, at = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        out[int(n)] = rows, flat[at[rows][:, None] + np.arange(n)]
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, relax: float = 1.0, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of `vectors` for each of `queries` (both vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    asked = stored(usable(queries).groupBy("id").agg(F.min("v").alias("v")), "ann-queries")
    blocks = max(1, -(-asked.count() // query_block))
    sent = []
    for block in range(blocks):  # the stated query set, a block of bounded size at a time
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)
        sent.append(spark.sparkContext.broadcast([(r["id"], r["v"]) for r in part.collect()]))
    whole = rows.mapInArrow(lean(_searcher(sent, k, relax)), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = whole.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _blocks_of(sent, k: int) -> Iterator[dict[int, Best]]:
    """The queries by the length of their vectors, a block at a time; only one block is held."""
    for block in sent:
        by_length: dict[int, list] = {}
        for i, v in block.value:
            by_length.setdefault(len(v), []).append((i, v))
        yield {n: Best(np.array([i for i, _ in own], np.int64), np.array([v for _, v in own], float), k) for n, own in by_length.items()}
        if len(sent) > 1:
            block.__dict__.pop("_value", None)  # read again from its file for the next tree


def _searcher(sent, k: int, relax: float):
    """Each shard's trees are built once, and all blocks of queries go through them."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        kept = next(_blocks_of(sent, k)) if len(sent) == 1 else None  # a single block gathers its best over all trees

        def told(best: Best) -> pa.RecordBatch:
            q, c = np.nonzero(best.scores > -np.inf)
            return pa.RecordBatch.from_arrays([pa.array(best.ids[q]), pa.array(best.found[q, c]), pa.array(best.scores[q, c])], ["query_id", "vec_id", "score"])

        def grown(n: int) -> Iterator[pa.RecordBatch]:
            parts = held.pop(n)
            tree = None
            for asked in [kept] if kept is not None else _blocks_of(sent, k):
                if n in asked:
                    tree = tree or Tree(np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts]))
                    tree.search(asked[n], relax)
                    if kept is None:
                        yield told(asked[n])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for n, (rows, values) in matrix(batch.column(1)).items():
                held.setdefault(n, []).append((ids[rows], values))
                if sum(len(x) for x, _ in held[n]) >= SHARD_ROWS:
                    yield from grown(n)
        for n in sorted(held):
            yield from grown(n)
        for best in (kept or {}).values():
            yield told(best)

    return search


def every_fiftieth(vectors: DataFrame, k: int = K, relax: float = 1.0) -> DataFrame:
    """The stated query set: rows whose vec_id is divisible by 50, against all rows."""
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), k, relax)


def nearest_sql(vectors: str = "embeddings", k: int = K) -> str:
    return f"""
with rows as (
  select vec_id, embedding::double[] as v from {vectors}
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))) as score
  from rows q join rows c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(c.v) = len(q.v)),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from pairs)
select query_id, rank, vec_id, score from ranked where rank <= {k}
"""
