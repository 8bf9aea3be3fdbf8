import itertools
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowlens.llm import langid as L

SCHEMA = "doc_id long, text string, lang string, score double, spans string"
TEACH = [(1, "the cat sat on the mat and the dog ran with this thing", "en", None, None),
         (2, "der hund und die katze sind nicht auf der matte geblieben", "de", None, None),
         (3, "это просто русский текст для обучения модели языка", "ru", None, None),
         (4, None, "fr", None, None), (5, "nothing declared here", None, None, None)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_spans_and_scripts(spark):
    model = L.learn(_frame(spark, TEACH), F.lit(True))
    assert model.langs == ["de", "en", "ru"]
    text = "The dog and the cat. Привет, текст! und die katze nicht"
    rows = [(1, text, None, None, None), (1, text, None, None, None), (2, None, "x", None, None),
            (3, "", None, None, None), (4, "123 ... !!", None, None, None), (None, "the cat", None, None, None),
            (6, "日本語", None, None, None), (7, "the " * 30000, None, None, None)]
    out = L.identify(_frame(spark, rows), model, penalty=2.0).collect()
    got = {r.id: r for r in out}
    assert len(out) == 8 and sum(r.id == 1 for r in out) == 2
    assert [(s.lang, text[s.start:s.stop]) for s in got[1].spans] == [
        ("en", "The dog and the cat"), ("ru", "Привет, текст"), ("de", "und die katze nicht")]
    for i in (2, 3, 4):
        assert (got[i].lang_pred, got[i].score, got[i].spans) == ("und", 0.0, [])
    assert got[None].lang_pred == "en" and got[7].lang_pred == "en" and got[7].score == 1
    assert got[6].lang_pred in model.langs
    assert L.identify(_frame(spark, []), model).count() == 0


def test_nothing_to_learn(spark):
    out = L.predict(_frame(spark, [(1, "some words", None, None, None)])).collect()
    assert [(r.lang_pred, r.score) for r in out] == [("und", 0.0)]


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 7, 5)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(size=(bounds[-1], 3)) * 3
    got = L.viterbi(scores, bounds, 1.5)
    for a, b in zip(bounds, bounds[1:]):
        def total(path):
            return sum(scores[a + i, k] for i, k in enumerate(path)) - 1.5 * sum(x != y for x, y in zip(path, path[1:]))
        best = max(itertools.product(range(3), repeat=b - a), key=total)
        assert np.isclose(total(got[a:b]), total(best))


def test_counts_equal_brute_force(spark):
    got = {(r.lang, r.bucket): r.n for r in L.count_grams(_frame(spark, TEACH)).collect()}
    scripts = {lang: n for (lang, b), n in got.items() if b >= L.BUCKETS}
    assert scripts == {r[2]: len(r[1].split()) for r in TEACH[:3]}
    grams = {lang: sum(n for (k, b), n in got.items() if k == lang and b < L.BUCKETS) for lang in scripts}
    assert grams == {r[2]: sum(len(w) + 1 for w in r[1].split()) for r in TEACH[:3]}


def test_held_out_fold_teaches_nothing_and_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = L.query(spark, sf).toPandas()
    assert (out.held_out == out.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)).all()
    both = out.merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    both = both[both.held_out]
    assert (both.lang == both.lang_pred).mean() > 0.99
    masked = docs.withColumn("lang", F.when(~L.held_out(), F.col("lang")))
    again = L.predict(masked).toPandas()
    same = out.set_index("doc_id").lang_pred.sort_index()
    pd.testing.assert_series_equal(same, again.set_index("id").lang_pred.sort_index(), check_names=False)
