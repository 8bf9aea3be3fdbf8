import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import interpolation as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, id string, row string, piece string, held string"


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return ["<s>", *WORD.findall(lower), "</s>"]


def crc(k):
    return zlib.crc32(str(k).encode())


def counts(texts, order):
    c = Counter()
    for t in texts:
        t = tokens(t)
        for k in range(1, order + 1):
            c.update(tuple(t[i:i + k]) for i in range(len(t) - k + 1))
    total = sum(n for g, n in c.items() if len(g) == 1 and g != ("<s>",))
    words = sum(len(g) == 1 and g != ("<s>",) for g in c)
    return c, total, words


def parts(c, total, words, t, i, order):
    """(bucket, [uniform, estimates of all orders]) of token i."""
    out, bucket = [1 / (words + 1)], 0
    for k in range(1, order + 1):
        h = tuple(t[i - k + 1:i]) if i - k + 1 >= 0 else None
        context = total if k == 1 else c[h] if h is not None else 0
        if context:
            bucket = 64 * k + context.bit_length() - 1
        out.append(c[tuple(t[i - k + 1:i + 1])] / context if context else 0.0)
    return bucket, out


def brute(rows, order):
    """Scores, weights and totals by definition, with plain dictionaries."""
    teach = [(k, x) for k, x in rows if k is not None and crc(k) % 7 != 2]
    held = [(k, x) for k, x in teach if crc(k) // 7 % L.FOLDS == L.FOLD]
    rest = [x for k, x in teach if crc(k) // 7 % L.FOLDS != L.FOLD]
    model = counts(rest, order)
    events = [parts(*model, tokens(x), i, order) for _, x in held for i in range(1, len(tokens(x)))]
    weights = {}
    for b in {b for b, _ in events}:
        m = 1 + b // 64
        weights[b] = [1 / m] * m + [0.0] * (order + 1 - m)
    for _ in range(L.ROUNDS):
        new = {b: [L.PRIOR] * (1 + b // 64) + [0.0] * (order - b // 64) for b in weights}
        for b, p in events:
            mixed = [w * x for w, x in zip(weights[b], p)]
            for k, v in enumerate(mixed):
                new[b][k] += v / sum(mixed)
        new = {b: [x / sum(w) for x in w] for b, w in new.items()}
        moved = max((abs(x - y) for b in new for x, y in zip(new[b], weights[b])), default=0)
        weights = new
        if moved < L.CLOSE:
            break
    c, total, words = counts([x for _, x in teach], order)
    table = L.weight_table(weights, order)
    out = []
    for k, x in rows:
        t = tokens(x)
        base = sum(math.log10((c[(w,)] + 1) / (total + words + 1)) for w in t[1:])
        score = 0.0
        for i in range(1, len(t)):
            b, p = parts(c, total, words, t, i, order)
            score += math.log10(sum(w * v for w, v in zip(table[b], p)))
        out.append((k, len(t) - 1, sum(c[(w,)] > 0 for w in t[1:]), base, score))
    return out, total, words, weights


def check(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3:] for r in got], [r[3:] for r in want], rtol=1e-9)


def frame(spark, tmp_path, rows):
    full = [(*r, "x", "y", "z", "w") for r in rows]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet")


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    words = [f"W{k}" if k % 3 else f"w{k}é" for k in range(60)]
    out = []
    for k in range(n):
        size = int(rng.integers(0, 60))
        out.append((k, " ".join(words[int(60 * v ** 3)] for v in rng.random(size))))
    return out + [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 2, "w1 W1 w1\nunknown-" * 3), (None, "W1 w3é nulls"),
                  (None, None), (n + 3, out[1][1]), (n + 3, out[1][1]), (n + 4, "w0é " * 20000)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(spark, tmp_path, monkeypatch, order):
    """Counts, weights and scores, with slices, chunks and buckets small enough to be many."""
    for name, value in (("SLICE_BYTES", 700), ("BUCKET_BYTES", 4000), ("CHUNK_ROWS", 16)):
        monkeypatch.setattr(L, name, value)
    rows = corpus(order, 220)
    df = frame(spark, tmp_path, rows)
    fold = F.floor(F.crc32(F.col("doc_id").cast("string")) / 7) % L.FOLDS == L.FOLD
    out, model = L.fit_and_score(df, ~L.held_out() & F.col("doc_id").isNotNull(), fold, order=order)
    want, total, words, weights = brute(rows, order)
    assert (model["tokens"], model["words"]) == (total, words)
    assert model["weights"].keys() == weights.keys()
    for b, w in weights.items():
        assert np.allclose(model["weights"][b], w, atol=1e-9)
    check([tuple(r) for r in out.collect()], want)


def test_query_on_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    out = L.query(spark, sf).collect()
    want, total, _, _ = brute([tuple(r) for r in docs], L.ORDER)
    assert {r.train_tokens for r in out} == {total}
    assert all(r.held_out == (crc(r.doc_id) % 7 == 2) for r in out)
    check([(r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in out], want)


def test_model_beats_unigrams_on_unseen_documents(spark):
    out = L.query(spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    assert len(out) > 50 and out.score.sum() > out.base_score.sum()


def test_probabilities_sum_to_one():
    """Over the vocabulary and one unknown word, after contexts seen and unseen."""
    import pyarrow as pa
    texts = ["a b a c", "b a a", "c"]
    c, total, words = counts(texts, 2)
    table = L.weight_table({64: [.2, .8, 0], 129: [.1, .3, .6]}, 2)
    for context in ("a", "b", "zz"):
        mass = 0.0
        for w in ["a", "b", "c", "</s>", "unknown"]:
            t = ["<s>", context, w]
            grams = L.Grams(pa.array([context if w == "</s>" else f"{context} {w}"]), 2)
            keys, number = grams.distinct()
            known = {}
            for x in {*c, *[(v,) for v in t]}:
                text = " ".join(v for v in x if v not in ("<s>", "</s>"))
                g = L.Grams(pa.array([text]), 2)
                known[int(g.keys[len(x) - 1][len(x) - 1 if x[0] == "<s>" else len(x) if x[-1] != "</s>" else len(g.owner) - 1])] = c[x]
            seen = np.array([known.get(int(k), 0) for k in keys])
            bucket, shares, _ = L.estimates(grams, number, seen, total)
            p = table[bucket][:, 0] / (words + 1) + (table[bucket][:, 1:].T * shares).sum(axis=0)
            mass += p[1]
        assert abs(mass - 1) < 1e-12


def test_nothing_to_learn_and_empty(spark, tmp_path):
    rows = [(None, "some words"), (None, None)]
    df = frame(spark, tmp_path, rows)
    out, model = L.fit_and_score(df, F.lit(False), F.lit(True))
    assert model["tokens"] == 0 and sorted((r.n_tokens, r.n_known, r.score) for r in out.collect()) == [(1, 0, 0.0), (3, 0, 0.0)]
    empty = spark.createDataFrame([], SCHEMA)
    out, _ = L.fit_and_score(empty, F.lit(True), F.lit(True))
    assert out.count() == 0
