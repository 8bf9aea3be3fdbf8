import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flowlens.llm import bpe

PATH = public_tokenizers.path(bpe.VOCABULARY)
BITS = ["a", "A", " ", "  ", "\n", "é", "日本", "🙂", "'s", "'", "1", "²", "--", "<|endoftext|>", "<|", "\x85",
        "\xa0", "\x1c", "ing", "the", " the", "\t", " ", "ſ", "é", "_", "ß", "\r\n", "…"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _texts():
    rng = random.Random(3)
    return ([None, "", " ", "a" * 20000, " " * 3000, "-" * 4000, "ab" * 3000, "<|endoftext|><|endoftext|>"]
            + ["".join(rng.choice(BITS) for _ in range(rng.randrange(60))) for _ in range(800)])


def test_equals_the_library(library):
    texts = [t or "" for t in _texts()]
    for text, (ids, raw) in zip(texts, bpe.codec(PATH).encoded(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == ",".join(map(str, want))
        assert raw.decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)


def test_memory_bound_changes_nothing(library, monkeypatch):
    codec = bpe.Codec(PATH)
    monkeypatch.setattr(bpe, "KEEP_WORDS", 5)
    monkeypatch.setattr(bpe, "KEEP_PAIRS", 3)
    for text in ["one two three four five six seven", "seven six eight one", "x" * 100 + " one"] * 2:
        (ids, raw), = codec.encoded([text])
        assert ids == ",".join(map(str, library.encode(text, add_special_tokens=False).ids))
        assert raw.decode() == text


def test_spark_round_trip(spark, library):
    texts = _texts()
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "x y", None), (3, "again", None), (3, "again", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    ids = bpe.encode_texts(df, PATH)
    back = bpe.decode_ids(ids, PATH)
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for _, t, _ in rows)
    got = {(r.id, r.decoded_sha256): (r.n_tokens, r.ids_sha256) for r in bpe.digests(df, PATH).collect()}
    for i, text, _ in rows:
        want = library.encode(text or "", add_special_tokens=False).ids
        assert got[i, hashlib.sha256((text or "").encode()).hexdigest()] == (
            len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())


def test_empty_table_and_bad_bytes(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(empty, PATH).count() == 0
    half = spark.createDataFrame([(1, [bpe.codec(PATH).token[b"\xc3"]]), (2, None)], "id long, ids array<int>")
    assert {r.id: r.text for r in bpe.decode_ids(half, PATH).collect()} == {1: "�", 2: ""}


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = bpe.query(spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        want = library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
