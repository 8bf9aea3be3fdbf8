import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flowlens.llm import packing as K

PATH = public_tokenizers.path(K.VOCABULARY)
BITS = ["a", "A", " ", "\n", "é", "É", "日本", "🙂", "'s", "'S", "'", "1", "²", "--", "<|endoftext|>", "\x85", "\xa0",
        "\x1c", "ing", "The", " the", "\t", " ", "ſ", "é", "_", "ª", "ǅ", "İ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(rows, texts, library, size=K.SIZE):
    """Every id in one piece, pieces gapless in sequences of at most ``size``; returns padding."""
    docs = {}
    for r in rows:
        docs.setdefault(r.id, []).append(r)
    for i, text in texts.items():
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [K.END_ID], "<u4")
        at = 0
        for r in sorted(docs[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start:at].tobytes())
        assert at == len(ids)
    seqs, padding = {}, 0
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        padding += size - at
    return padding


def test_encoding_equals_the_library(library):
    rng = random.Random(3)
    texts = ["", "a" * 5000, " " * 3000, "-" * 4000] + [
        "".join(rng.choice(BITS) for _ in range(rng.randrange(60))) for _ in range(800)]
    for text, ids in zip(texts, K.Ids(PATH).encoded(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_in_use_stay_when_the_kept_ones_are_too_many(library, monkeypatch):
    """Words are encoded without the file's own splitting, and those of the slice outlast the others."""
    monkeypatch.setattr(K, "KEEP_WORDS", 4)
    ids, learnt = K.Ids(PATH), []
    monkeypatch.setattr(ids, "_learn", lambda words, learn=ids._learn: learnt.append(sorted(words)) or learn(words))
    for text in ("one two three", "two İ's", "two --'s ǅ"):
        assert next(iter(ids.encoded([text]))).tolist() == library.encode(text, add_special_tokens=False).ids
    assert "two" in learnt[0] and "two" not in learnt[1] + learnt[2]


@pytest.mark.parametrize("demand", [{}, {256: 3}, {1: 700}, {100: 1}, {85: 10, 86: 10, 170: 5}, {129: 4, 128: 9, 127: 1}])
def test_patterns_use_up_the_demand(demand):
    found, used = K.solve_patterns(demand, 256), {}
    for times, pieces in found:
        assert sum(k * n for k, n in pieces.items()) <= 256
        for k, n in pieces.items():
            used[k] = used.get(k, 0) + n * times
    assert used == demand


def test_patterns_are_near_the_bound():
    rng = np.random.default_rng(4)
    demand = {int(k): int(n) for k, n in enumerate(rng.integers(1, 2000, 64), 1)}
    total = sum(t for t, _ in K.solve_patterns(demand, 64))
    assert total <= 1.005 * sum(k * n for k, n in demand.items()) / 64 + 64


def test_small_cases(spark, library):
    rows = [(1, None, "clash"), (2, "", None), (3, "one two", None), (4, "word " * 2047, None), (5, "word " * 2048, None),
            (6, "long text " * 20000, None), (None, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    check(K.pack(df, PATH).collect(), {i: t for i, t, _ in rows}, library)
    assert K.pack(df.limit(0), PATH).count() == 0
    twice = K.pack(df.union(df), PATH).collect()
    assert len(twice) == 2 * len(K.pack(df, PATH).collect())


def test_hot_length_and_query(spark, library):
    same = spark.createDataFrame([(i, "three words here") for i in range(3000)], "doc_id long, text string").repartition(5)
    rows = K.pack(same, PATH).collect()
    check(rows, {i: "three words here" for i in range(3000)}, library)
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in K.query(spark, sf).withColumnRenamed("doc_id", "id").collect()]
    padding = check(rows, texts, library)
    assert padding < 0.02 * sum(r.length for r in rows)


def test_inverse_equals_solver():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 40):
        a = rng.integers(-3, 4, (n, n)) + np.eye(n) * 9
        assert np.allclose(K._inverse(a) @ a, np.eye(n), atol=1e-9)
    assert np.allclose(K._inverse(np.array([[0, 2], [1, 0]])), [[0, 1], [0.5, 0]])
