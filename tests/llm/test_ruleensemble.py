import zlib

import numpy as np
from pyspark.sql import functions as F

from flowlens.llm import common as C
from flowlens.llm import ruleensemble as R

SCHEMA = "doc_id long, text string, x int, label string, score string"


def _stats(texts):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    return R.text_statistics(data, np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))


def test_statistics_by_hand():
    text = "The cat the cat SAT! 12|\nfoo#, bar. é\nfoo#, bar. é\n"
    got = dict(zip(R.STATISTICS, _stats(["", text, "   "])[1]))
    words, n = text.split(), len(text.encode())
    want = {"log_words": np.log1p(len(words)), "mean_word": sum(len(w.encode()) for w in words) / len(words),
            "symbols": 3 / n, "pipes": 1 / n, "digits": 2 / n, "upper": 4 / sum(c.isascii() and c.isalpha() for c in text),
            "shouted": 1 / 12, "exclamations": 1 / 12, "stops": 2 / 12, "same_as_last": 0.0, "distinct_words": 9 / 12,
            "repeated_pairs": (11 - 8) / 12, "repeat_lines": 1 / 3, "blank": 0.0, "not_ascii": 4 / n}
    want["repeated_pairs"] = (11 - len(set(zip(words, words[1:])))) / 12
    want["distinct_words"] = len(set(words)) / 12
    for name, value in want.items():
        assert np.isclose(got[name], value), name
    assert _stats([""])[0].tolist() == [0.0] * 18 + [1.0]


def test_statistics_do_not_depend_on_neighbours():
    texts = ["a b a b", "", "a b\na b", "x " * 500, "é|# A!"]
    alone = np.concatenate([_stats([t]) for t in texts])
    assert np.allclose(_stats(texts), alone)


def test_paths_of_a_description():
    text = """RandomForestClassificationModel
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 1 <= 2.0)
      Predict: 0.0
     Else (feature 1 > 2.0)
      Predict: 1.0
    Else (feature 0 > 0.5)
     If (feature 0 <= 1.5E-1)
      Predict: 1.0
     Else (feature 0 > 1.5E-1)
      Predict: 0.0
  Tree 1 (weight 1.0):
    If (feature 0 <= 0.5)
     Predict: 0.0
    Else (feature 0 > 0.5)
     Predict: 1.0
"""
    inf = np.inf
    assert R.tree_paths(text) == [((0, -inf, 0.5),), ((0, -inf, 0.5), (1, -inf, 2.0)), ((0, -inf, 0.5), (1, 2.0, inf)),
                                  ((0, 0.5, inf),), ((0, 0.5, 0.15),)]


def test_compiled_score_equals_the_weights(spark):
    model = R.Ensemble(0.25, [(1.5, ((0, 0.5, np.inf),)), (-2.0, ((0, -np.inf, 0.7), (1, 1.0, 2.0)))])
    rows = spark.createDataFrame([([a, b],) for a in (0.4, 0.5, 0.6, 0.7, 0.8) for b in (1.0, 1.5, 2.0, 2.5)], "x array<double>")
    for r in rows.select("x", model.score(F.col("x")).alias("s")).collect():
        z = 0.25 + 1.5 * (r.x[0] > 0.5) - 2.0 * (r.x[0] <= 0.7 and 1.0 < r.x[1] <= 2.0)
        assert np.isclose(r.s, 1 / (1 + np.exp(-z)))


def test_edge_rows(spark):
    rows = [(1, None, 5, "c", "c"), (2, "", None, None, None), (2, "", None, None, None), (None, "some text", None, None, None),
            (4, "word " * 60000, None, None, None), (5, "plain short text", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, q) for i in (1, 2, 4, 5, None) for q in (1, None, 7)], "doc_id long, quality int")
    out = R.scored(docs, labels).collect()
    assert len(out) == 6 and all(r.score == 1.0 for r in out) and out[0].row.asDict().keys() == set(docs.columns)
    none = R.scored(docs, labels.limit(0)).collect()
    assert all(r.score == 0.5 for r in none)
    assert R.scored(docs.limit(0), labels).count() == 0


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    out = R.query(spark, sf).toPandas()
    assert (out.held_out == out.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 3 == 1)).all()
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.5)).all()
    both = out.merge(C.table(spark, sf, "labels").toPandas(), on="doc_id")
    both = both[both.held_out]
    assert (both.predicted == both.quality).mean() > 0.98


def test_bounded_fit_still_learns(spark):
    sf = "/root/testdata/sf0.1"
    stats = R.measure(C.table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")
    labels = C.table(spark, sf, "labels")
    model = R.learn(stats, labels, fit_rows=800)
    both = stats.join(labels, "doc_id").where(R.held_out()).select("quality", (model.score(F.col("x")) >= 0.5).cast("int").alias("p"))
    assert both.where("p = quality").count() > 0.95 * both.count()
