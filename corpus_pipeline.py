"""Training-corpus pipeline over ``documents``.

Stages, each an operator of ``flowlens.llm`` over all rows its predecessor kept:

1. quality classifier: rows whose score is below 0.5 go;
2. language ID: rows without a letter, or of which no language labels at least half, go;
3. n-gram Jaccard join: one row of each group of near duplicates stays, the one of smallest
   doc_id (five-word shingles, Jaccard 0.8 or more; equal ids: the first in the table);
4. packing: the pieces of all rows in sequences of 2048 tokens.

Stages 1 to 3 return the columns of ``documents``. Every stage's result is written as Parquet
and reread as the next one's input. Null texts count as empty, are scored like any text, and
go in stage 2; an empty table stays empty; rows are judged one by one, so repeated ids and
further columns are no trouble.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import common as C
from flowlens.llm import langid, ngramjoin, packing, ruleensemble

LEAST_QUALITY = 0.5
LEAST_LANGUAGE_SHARE = 0.5
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _rows(docs: DataFrame) -> DataFrame:
    """(row): the columns of every row as one value."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: keep rows that score at least ``LEAST_QUALITY``."""
    scored = ruleensemble.scored(docs, C.table(spark, sf_dir, "labels"))
    return scored.where(F.col("score") >= LEAST_QUALITY).select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: keep rows of which one language labels at least ``LEAST_LANGUAGE_SHARE``."""
    teaches = ~langid.held_out() & F.col("doc_id").isNotNull()
    model = langid.learn(docs, teaches)
    named = langid.identify(_rows(docs), model, spans=False, id_col="row", text_col="row.text")
    return named.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SHARE)).select("id.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: keep one row of each component; rows without a word stay.

    Only the rows' places travel through the join; the places that go are then taken out
    of the table."""
    rows = C.with_row_id(docs, "__place")
    keys = rows.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("__place").alias("place"))
                       .alias("key"), "text")
    joined = C.staged(ngramjoin.components(keys, NEAR_WORDS, NEAR_PERCENT, "key", "text")
                      .where("root is not null").select("id", "root"), "joined")
    first = C.staged(joined.groupBy("root").agg(F.min("id").alias("first"), F.count("*").alias("rows"))
                     .where("rows > 1"), "first")
    gone = C.staged(C.join_hot(joined, first, "root", joined.count())
                    .where(F.col("id") != F.col("first")).select("id.place.*"), "gone")
    same = (F.col("__place.file") == gone["file"]) & (F.col("__place.row") == gone["row"])
    return rows.join(gone, same, "left_anti").drop("__place")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the pieces of every row and their places."""
    return packing.pack(docs, public_tokenizers.path(packing.VOCABULARY)).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("packing", pack)]

#: The classifiers are fitted and the packing solves a program: no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = C.staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
