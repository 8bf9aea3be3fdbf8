import corpus_pipeline as P
import pytest

from flowlens.llm import common as C
from tests.llm.test_ngramjoin import shingles
from tests.llm.test_packing import check

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from tokenizers import Tokenizer
    import public_tokenizers
    docs = C.table(spark, SF, "documents")
    quality = {r.doc_id: r.quality for r in C.table(spark, SF, "labels").collect()}
    seen = {}
    for name, stage in P.STAGES:
        out = C.staged(stage(spark, docs, SF), "t")
        if name != "packing":
            assert out.columns == docs.columns and out.exceptAll(docs).count() == 0
        seen[name], docs = out.collect(), out
    first = {r.doc_id for r in seen["quality"]}
    good = [d for d, q in quality.items() if q == 1]
    assert sum(d in first for d in good) >= 0.98 * len(good)
    assert sum(q == 0 and d in first for d, q in quality.items()) <= 0.1 * sum(q == 0 for q in quality.values())
    assert len(seen["language"]) >= 0.98 * len(seen["quality"])
    rows = sorted(seen["language"], key=lambda r: r.doc_id)
    roots = _groups([r.text for r in rows])
    assert {r.doc_id for r in seen["near_duplicates"]} == {rows[i].doc_id for i in set(roots)}
    texts = {r.doc_id: r.text for r in seen["near_duplicates"]}
    packed = docs.withColumnRenamed("doc_id", "id").collect()
    check(packed, texts, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))


def _groups(texts):
    """Smallest position linked with each (five words, 0.8), by brute force over distinct sets."""
    sets = [shingles(t, 5) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            small, large = sorted((len(a), len(b)))
            if a and b and 100 * small >= 80 * large:
                both = len(a & b)
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    x, y = root[i], root[j]
                    root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def test_edge_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    same = "one and the same text of a few words that all stay as they are here"
    rows = [(1, same, "en", "a", 5, "x"), (1, same, "en", "a", 5, "x"), (None, same, None, None, None, None), (2, None, "en", "a", 0, None),
            (3, "", None, None, None, None), (4, "word " * 30000, "en", "b", 9, None), (5, same.upper(), "en", "b", 9, None)]
    docs = spark.createDataFrame(rows, schema)
    kept = P.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4]
    assert P.language(spark, docs, SF).columns == docs.columns
    for stage in (P.quality, P.language, P.near_duplicates, P.pack):
        assert stage(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("name", ["run"])
def test_run_is_registered(spark, name):
    import __spark_entry__ as E
    assert E.queries()["pipeline"] is getattr(P, name) and "pipeline" not in E.oracle_sql()
