"""Exact top-k with repeated rows, one vec_id holding much of the table, and clustered vectors
whose queries need few blocks."""

import numpy as np

from tablewright.llm import mtree


def _brute(rows, k=10, every=100):
    """Rows of (query_id, rank, vec_id, score)."""
    data = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows]
    queries = {}
    for i, v in data:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in data if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def _got(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return sorted(map(tuple, mtree.top_k(df, **kw).collect()))


def _vectors(n, dims, seed, centers=None):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, dims))
    if centers:
        x = x * 0.01 + (g.normal(size=(centers, dims)) * 3)[np.arange(n) % centers]
    return [[float(np.float32(y)) for y in v] for v in x]


def test_repeated_rows_and_a_hot_id(spark):
    plain = list(enumerate(_vectors(900, 6, 1)))
    rows = plain + plain[10:14] * 30 + [(7, v) for v in _vectors(600, 6, 2)] + [(300, v) for v in _vectors(5, 6, 3)]
    assert _got(spark, rows, cells=6 * 256) == _brute(rows)


def test_all_rows_alike(spark):
    rows = [(i % 50, [1.0, 2.0]) for i in range(1000)] + [(100, [1.0, 2.0])]
    assert _got(spark, rows, cells=512) == _brute(rows)


def test_clustered_queries_meet_few_blocks(spark):
    rows = list(enumerate(_vectors(6000, 8, 4, centers=12)))
    assert _got(spark, rows, cells=8 * 256, pivots=48) == _brute(rows)


def test_blocks_that_cannot_score_are_left_out(spark):
    rows = list(enumerate(_vectors(6000, 8, 4, centers=12)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    every = spark.sparkContext.accumulator(0)
    search = mtree.MTree.search
    try:
        def counted(self, *args):
            every.add(1)
            return search(self, *args)
        mtree.MTree.search = counted
        n = mtree.top_k(df, cells=8 * 256, pivots=48).select("query_id").distinct().count()
    finally:
        mtree.MTree.search = search
    assert n == 60 and 60 <= every.value < 60 * 24 * 0.7      # of at least 24 blocks of 256 rows


def test_huge_components(spark):
    rows = [(i, [3e12 * (1 + i % 7), -2e12 * (i % 5)]) for i in range(301)]
    top = (1 << 63) - 1
    want = [(q, r, i, max(-top - 1, min(top, s))) for q, r, i, s in _brute(rows)]
    got = _got(spark, rows)
    assert [(q, r, s) for q, r, _, s in got] == [(q, r, s) for q, r, _, s in want]
