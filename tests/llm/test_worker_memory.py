"""A worker's memory while it reads one batch of many MB of text."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from flowlens.llm import common as C
from flowlens.llm import langid, ngramjoin, packing, ruleensemble

MB = 1 << 20


class Caught(Exception):
    """Carries the function that a query hands to ``mapInArrow``."""


def task_of(monkeypatch, make):
    def told(self, func, schema, *args, **kw):
        raise Caught(func)

    from pyspark.sql.classic.dataframe import DataFrame
    monkeypatch.setattr(DataFrame, "mapInArrow", told)
    with pytest.raises(Caught) as found:
        make()
    return found.value.args[0]


def batch_of(n_bytes):
    """Rows of about 2 KB; few distinct words, so that kept words weigh little."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(n_bytes // 2000)]
    ids = pa.array(range(len(texts)), pa.int64())
    return pa.record_batch([ids, pa.array(["en"] * len(texts)), pa.array(texts)], names=["id", "lang", "text"])


class Part:
    @staticmethod
    def get():
        return Part

    @staticmethod
    def partitionId():
        return 0


@pytest.mark.parametrize("name, most", [("quality", 60), ("language", 80), ("near_duplicates", 35), ("packing", 12)])
def test_a_batch_is_read_a_piece_at_a_time(spark, monkeypatch, name, most):
    df = spark.createDataFrame([(1, "en", "a")], "doc_id long, lang string, text string")
    path = public_tokenizers.path(packing.VOCABULARY)
    make = {"quality": lambda: ruleensemble.measure(df), "language": lambda: langid.count_grams(df),
            "near_duplicates": lambda: ngramjoin.classes_of(df), "packing": lambda: packing.cut_documents(df, path)}[name]
    run = task_of(monkeypatch, make)
    monkeypatch.setattr(packing, "TaskContext", Part)
    if name == "language":
        langid.tables()
    if name == "packing":
        packing.token_ids(path)
    for power in ("_POW", "_POW_INV"):
        monkeypatch.setattr(C, power, np.ones(1, np.uint64))
    batch = batch_of(4 * MB)
    batch = batch.select(["lang", "text"] if name == "language" else ["id", "text"])
    tracemalloc.start()
    try:
        for _ in run(iter([batch])):
            pass
        peak = tracemalloc.get_traced_memory()[1] / MB
    finally:
        tracemalloc.stop()
    assert peak < most


def test_classes_of_pieces_are_those_of_the_whole(spark, monkeypatch):
    """Frequent shingles are counted over a slice, whatever the pieces it is read in."""
    run = task_of(monkeypatch, lambda: ngramjoin.classes_of(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 2))
    texts = ["a b c", None, "", "x", "a b d e", "a b"] * 30
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "text"])
    whole = pa.Table.from_batches(list(run(iter([batch]))))
    monkeypatch.setattr(C, "PIECE_BYTES", 7)
    assert pa.Table.from_batches(list(run(iter([batch])))).equals(whole)
    assert (whole["n"].to_numpy() < 0).any()
