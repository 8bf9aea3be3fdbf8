import hashlib
import re
import zlib

import numpy as np
import pytest

from flowlens.llm import common as C
from flowlens.llm import periodic as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, id string, runs string, start string"


def brute(words):
    """Runs of a list by definition: every period, every maximal stretch."""
    n, seen = len(words), {}
    for q in range(1, n // 3 + 1):
        a = 0
        while a + q < n:
            b = a
            while b + q < n and words[b] == words[b + q]:
                b += 1
            if b > a and b + q - a >= max(24, 3 * q):
                seen.setdefault((a, b + q), q)      # the smallest period comes first
            a = max(b, a + 1) if b > a else a + 1
    return sorted((a, b, q) for (a, b), q in seen.items())


def rewritten(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = rewritten(doc_id, WORD.findall(text or ""))
    runs = sorted(((a, b - a, q) for a, b, q in brute(words)), key=lambda r: (r[0], r[2]))
    drop = {k for a, n, q in runs for k in range(a + q, a + n)}
    from fractions import Fraction
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)),
            sha(" ".join(w for k, w in enumerate(words) if k not in drop)))


def periodic_text(rng, letters):
    """Random pieces, powers of pieces, powers of powers, broken by single words."""
    out = []
    for _ in range(rng.integers(1, 5)):
        piece = list(rng.integers(0, letters, rng.integers(1, 30)))
        if rng.random() < .5:
            piece = piece * int(rng.integers(1, 8)) + list(rng.integers(0, letters, rng.integers(0, 3)))
        piece = piece * int(rng.integers(1, 7))
        out += piece[:len(piece) - int(rng.integers(0, 3))]
        out += list(rng.integers(0, letters, rng.integers(0, 4)))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    texts = [periodic_text(rng, int(rng.integers(1, 5))) for _ in range(12)] + [[], [1], [2] * 24, [2] * 23]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    words = C.mix(np.concatenate([np.asarray(t, np.int64) for t in texts]).astype(np.uint64) + np.uint64(7))
    got = [tuple(int(v) for v in r) for r in P.find_runs(words, bounds)]
    want = [(a + s, b + s, q) for s, t in zip(bounds, texts) for a, b, q in brute(t)]
    assert got == want


def test_wavelet_tree_equals_brute_force():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 201):
        values = rng.permutation(n)
        tree = P.WaveletTree(values)
        left, right = np.sort(rng.integers(0, n + 1, (2, 300)), axis=0)
        x = rng.integers(0, n + 1, 300)
        want = [min((v for v in values[a:b] if v >= y), default=n) for a, b, y in zip(left, right, x)]
        assert tree.successor(left, right, x).tolist() == want


def test_query_equals_brute_force_on_edges(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(f"w{v}" for v in periodic_text(rng, 3)), "x", "y", "z") for k in range(60)]
    rows += [(60, None, None, None, None), (61, "", None, None, None), (62, " \t\n ", None, None, None),
             (63, "a b\nc\t" * 9, None, None, None), (63, "a b\nc\t" * 9, None, None, None),
             (None, "é ü " * 40, None, None, None), (None, None, None, None, None),
             (64, "again " * 30000, None, None, None), (65, "x" * 300000, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = P.query(spark, str(tmp_path)).collect()
    got = sorted(((r.doc_id, *r[1:8]) for r in out), key=repr)
    small = [r for r in rows if r[0] not in (64, 65)]
    want = sorted(((r[0], *expected(r[0], r[1])) for r in small), key=repr)
    assert sorted((g for g in got if g[0] not in (64, 65)), key=repr) == want
    big = {g[0]: g for g in got}
    n = len(rewritten(64, ["again"] * 30000))
    assert big[64][1:6] == (1, 0, n, 1, 1000 * n) and big[65][1] == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert P.periodic_runs(empty).count() == 0
    plain = P.periodic_runs(spark.createDataFrame(rows[63:64], SCHEMA)).collect()[0]
    assert plain.collapsed == "a b c" and plain.runs[0].asDict() == {"start": 0, "length": 27, "period": 3}


def test_whole_table_equals_brute_force(spark):
    """Every document of up to 400 words, and the planted long ones by their own period."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas()
    out = {r.doc_id: r for r in P.query(spark, "/root/testdata/sf0.001").collect()}
    assert len(out) == len(docs)
    checked = 0
    for r in docs.itertuples():
        if len(WORD.findall(r.text or "")) <= 400:
            assert tuple(out[r.doc_id])[1:8] == expected(r.doc_id, r.text)
            checked += 1
    assert checked > 50 and sum(r.n_runs for r in out.values()) > 5
