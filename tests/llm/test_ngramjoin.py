import random
import re

import numpy as np
import pytest

from flowlens.llm import ngramjoin as J

SCHEMA = "doc_id long, text string, n_shingles string, root string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=4):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(texts, percent=85):
    """Component of each position, over all pairs of distinct sets."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b:
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def _texts(seed=1, families=14, copies=14):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocab, k=60))
    out = [None, "", " \n\t", "one", "One", "two words", "a b c", "A b\tC", "a b c d", "é É", "É é", "a " * 3000]
    for f in range(families):
        base = rng.choices(vocab, k=rng.randrange(8, 160))
        for c in range(copies):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 25 + c % 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab) + "x" * (c % 2)
            if c % 5 == 4:
                w = w[: int(len(w) * rng.uniform(0.8, 1))]
            out.append(" ".join(w) if f % 4 else passage + " " + " ".join(w[:12]))
    return out


def _run(spark, rows, **kw):
    out = J.components(spark.createDataFrame(rows, SCHEMA), **kw).collect()
    return {r.id: (r.n_shingles, r.root) for r in out}


def _groups(keys):
    seen = {}
    for i, k in keys:
        seen.setdefault(k, set()).add(i)
    return {frozenset(g) for g in seen.values()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    texts = _texts(seed)
    got = _run(spark, [(i, t, "clash", None) for i, t in enumerate(texts)])
    n, root = brute(texts)
    assert [got[i][0] for i in range(len(texts))] == n
    assert all((got[i][1] is None) == (n[i] == 0) for i in got)
    assert _groups((i, got[i][1] if n[i] else f"own{i}") for i in got) == _groups(enumerate(root))
    assert 5 < len(set(root)) < len(texts) - 20


def test_frequent_shingles_and_small_buckets_change_nothing(spark, monkeypatch):
    texts = _texts(3, 8, 10)
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    want = _run(spark, rows)
    monkeypatch.setattr(J, "HOT_SHARE", 100)
    monkeypatch.setattr(J, "BUCKET_ROWS", 50)
    monkeypatch.setattr(J, "HUB_ROUNDS", 0)
    monkeypatch.setattr(J, "BEFORE", 2)
    monkeypatch.setattr(J, "HOT_CODES", 50)
    monkeypatch.setattr(J, "SLICE_ROWS", 3)
    got = _run(spark, rows)
    assert _groups((i, v[1]) for i, v in got.items()) == _groups((i, v[1]) for i, v in want.items())


def test_clashing_names_are_made_anew(spark, monkeypatch):
    """A salt under which different sets get one name is passed over."""
    real = J.shingle_sets
    bad = lambda part, size, salt=0: (lambda r: (*r[:2], np.where(r[2] != 0, r[2] * 0 + 5, 0) if not salt else r[2], r[3]))(
        real(part, size, salt))
    texts = _texts(4, 3, 5)
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    want = _run(spark, rows)
    monkeypatch.setattr(J, "shingle_sets", bad)
    _, salt = J.named_classes(spark.createDataFrame(rows, SCHEMA), 4, "doc_id", "text")
    got = _run(spark, rows)
    assert salt and _groups((i, v[1]) for i, v in got.items()) == _groups((i, v[1]) for i, v in want.items())


def test_repeated_rows_null_ids_and_empty(spark):
    rows = [(1, "the same five words here", None, None)] * 3 + [(None, "the same five words here", None, None),
            (None, None, None, None), (7, "x", None, None), (7, "y", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = J.components(df).collect()
    assert len(out) == 7 and len({r.root for r in out if r.n_shingles == 2}) == 1
    assert J.components(df.limit(0)).count() == 0


def test_suffix_filter_never_undercounts():
    rng = np.random.default_rng(5)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(2))
        for depth in range(4):
            assert J.overlap_bound(x, y, depth) >= len(np.intersect1d(x, y))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    n, root = brute([d.text for d in docs])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.query(spark, sf).collect()}
    assert got == {d.doc_id: (n[i], docs[root[i]].doc_id) for i, d in enumerate(docs)}
