import base64
import collections
import os
import random
import re

import pytest

from flowlens.llm import compression as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n_words string, ratio string"


def _brute(text):
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    count, cover = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            cover.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(cover))


def _texts():
    rng = random.Random(5)
    bits = ["a", "bé", "ç", "a b", "\n", "\n\n", "\t", " ", "\r\n", "日本", "#*", "<x>", " ", "\x0b", "𝒳", "x x x x x "]
    texts = ["", None, " ", "\n", "a", "x\n", "x\nx", "x\n\nx\n", "a b c d e a b c d e", "é " * 50]
    texts += ["".join(rng.choice(bits) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(80))) for _ in range(150)]
    return texts + ["word%d " % 3 * 60000, " ".join(f"w{i * i % 9973}" for i in range(60000))]


def _measure(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return K.compression_bands(df).toPandas().set_index("id").sort_index()


def test_counts_equal_brute_force(spark):
    texts = _texts()
    out = _measure(spark, [(i, t, "clash", None) for i, t in enumerate(texts)])
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for i, text in enumerate(texts):
        assert tuple(out.loc[i][cols]) == _brute(text or ""), i


def test_bands(spark):
    sf, rng = "/root/testdata/sf0.001", random.Random(7)
    good = (spark.read.parquet(f"{sf}/documents.parquet")
            .join(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1"), "doc_id")
            .orderBy("doc_id").toPandas().text)
    prose = [t for t in good if len(t.split()) > 100]
    half = prose[0] + " spam" * 2000
    noise = "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(5000))
    n = len(prose)
    out = _measure(spark, [(i, t, None, None) for i, t in enumerate([*prose, "again and " * 900, half, noise])])
    assert not out.repetitive[:n].any() and not out.incompressible[:n].any()
    assert out.repetitive[n] and out.repetitive[n + 1] and out.incompressible[n + 2]


def test_empty_table_and_repeated_rows(spark):
    assert len(_measure(spark, [])) == 0
    out = _measure(spark, [(1, "same text here", None, None)] * 3 + [(None, None, None, None)])
    assert len(out) == 4 and out.ratio.isna().sum() == 1


def test_query(spark):
    sf = "/root/testdata/sf0.1"
    out = K.query(spark, sf).toPandas()
    assert len(out) == spark.read.parquet(os.path.join(sf, "documents.parquet")).count()
    failed = (out.n_words < 10) | (100 * out.n_repeat_words > 20 * out.n_words)
    assert (out.base_failed == failed).all() and not (out.kept & failed).any()
    good = out.merge(spark.read.parquet(os.path.join(sf, "labels.parquet")).toPandas(), on="doc_id")
    good = good[~good.base_failed]
    assert good[good.quality == 1].kept.mean() > 0.98
    assert good[good.quality == 0].kept.mean() < 1


@pytest.mark.parametrize("size", [K.CHUNK_BYTES - 1, K.CHUNK_BYTES, K.CHUNK_BYTES + 1])
def test_chunks_are_whole(spark, size):
    row = _measure(spark, [(1, "ab" * (size // 2) + "c" * (size % 2), None, None)]).iloc[0]
    assert (row.chunk_min == row.chunk_min) == (size >= K.CHUNK_BYTES)


def _prose(spark):
    return (spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
            .join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("quality = 1"), "doc_id")
            .where("octet_length(text) >= 2048").orderBy("doc_id").limit(600).toPandas().text.tolist())


def _noise(size):
    rng = random.Random(11)
    return base64.b64encode(rng.randbytes(size)).decode()[:size], "".join(chr(rng.randrange(33, 127)) for _ in range(size))


def test_hot_group_does_not_widen_its_band(spark):
    prose = _prose(spark)
    clean = [t for t in prose if len(t.encode()) < 4096][:200]
    hot = [(t[:1700] + t[:850 + 3 * (i % 100)]) for i, t in enumerate(prose[:len(clean) // 2])]
    texts = [*clean, *hot, *_noise(3000)]
    out = _measure(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    n, m = len(clean), len(clean) + len(hot)
    assert n >= 100 and out.ratio[n:m].between(2.7, 3.6).all()
    assert not out.repetitive[:n].any() and not out.incompressible[:n].any()
    assert out.repetitive[n:m].all() and out.incompressible[m:].all()


def test_chunks_at_the_end_and_of_text_noise(spark):
    prose = " ".join(_prose(spark)).encode()[:61440].decode(errors="ignore")
    encoded, printable = _noise(9000)
    texts = [prose, prose + "spam " * 800, prose + encoded, prose[:30000] + printable + prose[30000:], prose + encoded[:4000]]
    out = _measure(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    assert out.repetitive.tolist() == [False, True, False, False, False]
    assert out.incompressible.tolist() == [False, False, True, True, True]
