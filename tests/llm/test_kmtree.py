import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import kmtree as K

SCHEMA = "vec_id long, embedding array<float>, leaf string, v int"


def _single(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], *more)
            for i, v, *more in rows]


def _brute(rows, k, is_query):
    rows = _single(rows)
    use = [(i, np.array(v, float)) for i, v, *_ in rows if i is not None and v and None not in v
           and np.isfinite(v).all() and any(v)]
    width = max(set(len(v) for _, v in use), key=[len(v) for _, v in use].count)
    use = [(i, v / np.linalg.norm(v)) for i, v in use if len(v) == width]
    out = {}
    for i, q in use:
        if is_query(i):
            near = sorted((-float(q @ v), j) for j, v in use if j != i)
            out[i] = near[:k]
    return out


def _search(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return K.neighbours(df, F.col("id") % 50 == 0, **kw).orderBy("query_id", "rank").collect()


def test_small_table_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist(), "clash", 1) for i in range(120)]
    rows += [(200, None, None, None), (250, [0.0] * 6, None, None), (300, [float("nan")] * 6, None, None),
             (350, [1.0, None, 0.0, 0.0, 0.0, 0.0], None, None), (400, [1.0, 2.0], None, None), (450, [], None, None),
             (None, [1.0] * 6, None, None), (500, [float("inf")] + [1.0] * 5, None, None)]
    rows += [(600 + i, rows[50][1], None, None) for i in range(7)] + [(7, rows[7][1], None, None)]
    got, want = _search(spark, rows, recall=1.0), _brute(rows, 5, lambda i: i % 50 == 0)
    assert {r.query_id for r in got} == set(want)
    for q, near in want.items():
        mine = [r for r in got if r.query_id == q]
        assert [r["rank"] for r in mine] == list(range(1, len(near) + 1))
        for r, (s, _) in zip(mine, near, strict=True):
            assert math.isclose(r.score, -s, abs_tol=1e-12)
    assert [r.vec_id for r in got if r.query_id == 50] == [600, 601, 602, 603, 604]


@pytest.mark.parametrize("rows,n", [([], 0), ([(50, [1.0, 2.0], None, None)], 0),
                                    ([(50, [1.0, 2.0], None, None), (1, [2.0, 1.0], None, None)], 1)])
def test_few_rows(spark, rows, n):
    assert len(_search(spark, rows)) == n


def test_hot_leaf_is_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 20)
    monkeypatch.setattr(K, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 0.5, 0.25] if i % 3 else rng.normal(size=3).tolist(), None, None) for i in range(1, 401)]
    got, want = _search(spark, rows, recall=1.0), _brute(rows, 5, lambda i: i % 50 == 0)
    for q, near in want.items():
        assert np.allclose([r.score for r in got if r.query_id == q], [-s for s, _ in near])


def test_tree_visits_every_leaf_once():
    rng = np.random.default_rng(3)
    x = K.unit(rng.normal(size=(3000, 8)))
    tree = K.Tree.fit(x, 5, 40)
    assert sorted(tree.visits(x[0], tree.leaves)) == list(range(tree.leaves)) and tree.leaves > 50
    assert tree.route(x[:50]).tolist() == [tree.visits(q, 1)[0] for q in x[:50]]


def test_visits_widen_until_there_are_enough_candidates(spark):
    """One leaf a row and many copies of a query's own id: one visit holds too little."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(50, x[50].tolist())] * 12
    index = spark.createDataFrame(rows, "id long, v array<double>")
    tree = K.Tree.fit(K.unit(x), 4, 1)
    leaf = dict(enumerate(tree.route(K.unit(x)).tolist()))
    index = index.withColumn("leaf", F.element_at(F.create_map(
        *[F.lit(y) for i, n in leaf.items() for y in (i, n)]), F.col("id").cast("int")).cast("long"))
    got = K.search(index, index.where("id % 50 = 0").select("id", "v").distinct(), tree, 1, 5).collect()
    assert {q: sum(r.query_id == q for r in got) for q in (0, 50, 100, 150)} == dict.fromkeys((0, 50, 100, 150), 5)


def test_recall_on_the_given_table(spark):
    sf = "/root/testdata/sf0.1"
    out = K.query(spark, sf).toPandas()
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    want = _brute(list(zip(e.vec_id.tolist(), e.embedding.map(list))), 5, lambda i: i % 50 == 0)
    found = out.groupby("query_id").vec_id.apply(set)
    hits = sum(len(found[q] & {j for _, j in near}) for q, near in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
