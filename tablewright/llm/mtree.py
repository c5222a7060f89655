"""Exact top-k by inner product with M-trees and best-first search.

Inner product is not a metric; every vector x of a block gets one more component
sqrt(M - |x|^2), M the largest squared norm of the block, and a query q gets 0.
Then |q' - x'|^2 = |q|^2 + M - 2 q.x, so the highest scores are the nearest points.

Equal rows are counted first and searched once.  Rows are dealt to blocks by their
nearest of a few sampled pivots, large groups of one pivot to several blocks.  With r
the largest distance of a pivot's rows from it, no row x of pivot p scores above
q.p + |q| r, so a query goes only to the blocks of pivots where that reaches its k-th
best score among the sampled rows.  A block meets its queries chunk by chunk in a
task, which builds an M-tree and searches it.  Pages hold routing objects with
covering radius and distance to the parent; the search opens pages by their best
possible score and skips whatever the triangle inequality, from the stored
distances alone, proves to score below the k-th best so far.  Sampling pivots only
shapes the blocks: every row is searched, and scores are exact integers.

Defined results: a vector that is null, or has a null or non-finite component,
takes no part, nor does a null vec_id; shorter vectors count as padded with zeros;
quantized components beyond a long saturate, as do scores; rows of the query's own
vec_id are no candidates; repeated rows are candidates each, and one query; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

_FANOUT, _PAGE = 16, 512


def quantized(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every valid vector."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull()).where(~bad).select(
        "vec_id", F.transform("e", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _matrix(vectors, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _largest(a: np.ndarray) -> float:
    return float(np.abs(a.astype(np.float64)).max(initial=0))


def _scores(a: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; through doubles where these are exact."""
    if exact:
        return (a @ q).astype(np.int64)
    top = (1 << 63) - 1
    return np.array([max(-top - 1, min(top, sum(int(x) * int(y) for x, y in zip(r, q, strict=True)))) for r in a], dtype=np.int64)


class MTree:
    """An M-tree over integer vectors.  A page is a dict: ``x`` the routing objects or
    points, ``up`` their distances to the page's own routing object, and either
    ``radius`` and ``pages`` (inner) or ``rows`` (leaf).  A row stands for its ``copies``."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray | None = None):
        self.ids, self.vectors = ids, vectors
        self.copies = np.ones(len(ids), dtype=np.int64) if copies is None else copies
        self.floats = f = vectors.astype(np.float64)
        self.largest = _largest(vectors)
        norms = np.einsum("ij,ij->i", f, f)
        self.most = float(norms.max()) * (1 + 1e-12)
        self.points = np.hstack([f, np.sqrt(np.maximum(0.0, self.most - norms))[:, None]])
        self.slack = 1e-7 * (1.0 + self.most ** 0.5)
        self.random = np.random.default_rng(len(ids))
        self.center = self.points[0]
        rows = np.arange(len(ids))
        self.root = self._build(rows, self.center)
        self.radius = float(self._distances(self.points, self.center).max())

    @staticmethod
    def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        d = x - c
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def _build(self, rows: np.ndarray, center: np.ndarray) -> dict:
        if len(rows) <= _PAGE:
            return {"rows": rows, "up": self._distances(self.points[rows], center)}
        picked = self.random.choice(rows, _FANOUT, replace=False)
        pivots, mine = self.points[picked], self.points[rows]
        nearest = np.argmin(np.einsum("ij,ij->i", pivots, pivots)[None, :] - 2 * mine @ pivots.T, axis=1)
        parts = [rows[nearest == i] for i in range(_FANOUT)]
        if max(map(len, parts)) == len(rows):  # all alike: cut anywhere
            parts = np.array_split(rows, _FANOUT)
            pivots = np.stack([self.points[p[0]] for p in parts])
        keep = [i for i, p in enumerate(parts) if len(p)]
        centers = pivots[keep]
        return {"x": centers, "up": self._distances(centers, center),
                "radius": np.array([self._distances(self.points[parts[i]], pivots[i]).max() for i in keep]),
                "pages": [self._build(parts[i], pivots[i]) for i in keep]}

    def search(self, query: np.ndarray, own: int, k: int, least: int) -> list[tuple[int, int]]:
        """The (score, vec_id) of up to ``k`` best rows that score ``least`` or more."""
        q = np.append(query.astype(np.float64), 0.0)
        plus = float(q @ q) + self.most
        exact = self.largest * _largest(query) * max(1, len(query)) < 2 ** 53
        data, asked = (self.floats, query.astype(np.float64)) if exact else (self.vectors, query)
        slack = self.slack + 1e-7 * plus ** 0.5
        best: list[tuple[int, int]] = []  # a heap with the worst on top
        floor = least

        def bound(near):
            """The highest score possible at distance ``near`` or more."""
            near = np.maximum(0.0, near - slack)
            return (plus - near * near) / 2 + 1e-9 * plus + 1

        d = float(np.linalg.norm(q - self.center))
        queue = [(-float(bound(d - self.radius)), 0, d, self.root)]
        made = 1
        while queue and -queue[0][0] >= floor:
            _, _, d, page = heapq.heappop(queue)
            if "rows" in page:
                rows = page["rows"][bound(np.abs(d - page["up"])) >= floor]
                if not len(rows):
                    continue
                scores = _scores(data[rows], asked, exact)
                for s, i, n in zip(scores.tolist(), self.ids[rows].tolist(), self.copies[rows].tolist(), strict=True):
                    if i == own or s < floor:
                        continue
                    for _ in range(min(n, k)):
                        if len(best) < k:
                            heapq.heappush(best, (s, -i))
                        elif (s, -i) > best[0]:
                            heapq.heapreplace(best, (s, -i))
                    if len(best) == k:
                        floor = max(floor, best[0][0])
                continue
            open_ = np.flatnonzero(bound(np.abs(d - page["up"]) - page["radius"]) >= floor)
            if not len(open_):
                continue
            far = self._distances(page["x"][open_], q)
            tops = bound(far - page["radius"][open_])
            for j, f, t in zip(open_.tolist(), far.tolist(), tops.tolist(), strict=True):
                if t >= floor:
                    heapq.heappush(queue, (-t, made, f, page["pages"][j]))
                    made += 1
        return [(s, -i) for s, i in best]


def top_k(embeddings: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, pivots: int = 64,
          cells: int = 1 << 21, chunk: int = 1 << 14) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best of all other rows; of rows
    that repeat as many copies as fit among the ``k``.

    Queries are the rows whose vec_id ``every`` divides.  ``pivots`` rows are sampled to
    shape the blocks; a block holds about ``cells`` components and meets at most about
    ``chunk`` queries at a time, which bounds a task's memory."""
    vectors = staged(quantized(embeddings, scale).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies")), "vectors")
    about = vectors.agg(F.max(F.size("v")).alias("dims"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("queries")).first()
    dims, n_queries = max(1, about.dims or 1), about.queries or 0
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(pivots).collect()
    p_ids, p = [r.vec_id for r in sample], _matrix([r.v for r in sample], dims)

    def assign(batches):
        pf = p.astype(np.float64)
        half = (pf * pf).sum(axis=1) / 2
        for b in batches:
            x = _matrix(b.column("v").to_pylist(), dims).astype(np.float64)
            near = np.argmax(x @ pf.T - half, axis=1) if len(pf) else np.zeros(len(x), dtype=np.int64)
            far = np.linalg.norm(x - pf[near], axis=1) if len(pf) else np.zeros(len(x))
            yield pa.record_batch([*b.columns, pa.array(near.astype(np.int32)), pa.array(far)], names=["vec_id", "v", "copies", "pivot", "far"])

    dealt = staged(vectors.mapInArrow(assign, "vec_id long, v array<bigint>, copies long, pivot int, far double"), "dealt")
    rows_per_block = max(256, cells // dims)
    sizes = {r.pivot: (r.n, r.radius) for r in dealt.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}  # a row a pivot
    parts = [-(-sizes.get(i, (0, 0.0))[0] // rows_per_block) for i in range(max(1, len(p_ids)))]
    radius = np.array([sizes.get(i, (0, 0.0))[1] for i in range(len(p_ids))])
    starts = [sum(parts[:i]) for i in range(len(parts))]
    chunks = max(1, -(-n_queries // chunk))
    at = F.col("pivot") + 1
    block = F.element_at(F.array(*[F.lit(s) for s in starts]), at) + F.pmod(
        F.xxhash64(F.lit(5), "vec_id", "v"), F.greatest(F.lit(1), F.element_at(F.array(*[F.lit(n) for n in parts]), at))).cast("int")
    rows = dealt.select("vec_id", "v", "copies", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    queries = dealt.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"))
    queries = queries.withColumn("chunk", F.pmod(F.xxhash64(F.lit(7), "query_id"), F.lit(chunks)).cast("int"))

    def route(batches):
        """Each query with the blocks that may hold one of its best, and the score these must reach."""
        pf = p.astype(np.float64)
        reach = np.sqrt((pf * pf).sum(axis=1)) + radius
        for b in batches:
            asked = _matrix(b.column("q").to_pylist(), dims)
            exact = _largest(p) * _largest(asked) * dims < 2 ** 53
            least, chosen = [], []
            for query_id, q in zip(b.column("query_id").to_pylist(), asked, strict=True):
                seen = _scores(pf if exact else p, q.astype(np.float64) if exact else q, exact)
                known = sorted((s for s, i in zip(seen.tolist(), p_ids, strict=True) if i != query_id), reverse=True)
                least.append(known[k - 1] if len(known) >= k else -(1 << 63))
                qf = q.astype(np.float64)
                size = float(np.sqrt(qf @ qf))
                top = np.minimum(pf @ qf + size * radius, size * reach) + 1e-6 * size * reach + 1
                chosen.append([starts[i] + j for i in range(len(parts)) if not top[i] < least[-1] for j in range(parts[i])])
            yield pa.record_batch([*b.columns, pa.array(least, pa.int64()), pa.array(chosen, pa.list_(pa.int32()))],
                                  names=["query_id", "q", "chunk", "least", "blocks"])

    queries = queries.mapInArrow(route, "query_id long, q array<bigint>, chunk int, least long, blocks array<int>")
    queries = queries.withColumn("block", F.explode("blocks")).drop("blocks")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            tree = MTree(left["vec_id"].to_numpy(), _matrix(left["v"], dims), left["copies"].to_numpy())
            for query_id, least, q in zip(right["query_id"], right["least"], _matrix(right["q"], dims), strict=True):
                out += [(query_id, i, s) for s, i in tree.search(q, query_id, k, least)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = rows.groupBy("block", "chunk").cogroup(queries.groupBy("block", "chunk")).applyInPandas(search, "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
