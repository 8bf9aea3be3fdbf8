"""Operator 2, language identification of mixed-language texts.

A word is a maximal run of letters (lower-cased). Its script, looked up in ranges of code
points, narrows the candidates to the languages that were learned with that script; its
score in a language is the sum of smoothed log shares of its letter trigrams (hashed to
``BUCKETS``, word ends included). Viterbi over the words, with a penalty for each switch of
language, labels the words; runs of one label are the spans. A text's language is the one
that labels most of its letters (ties: the smaller name); its score is that share.

The counts come from every learnable row, added up in Spark; the model holds one number
per language and bucket, whatever the input's size, and at most ``MOST_LANGUAGES``.

Defined results: null text, or one without a letter, is ``und`` with score 0 and no spans;
words of a script that no language was learned with fit all languages alike; with nothing to
learn from every text is ``und``; rows without language or text teach nothing; repeated
rows and ids are judged row by row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm import common as C

BUCKETS, MOST_LANGUAGES = 1 << 16, 1000
SMOOTHING, SWITCH_PENALTY = 0.5, 8.0
SCRIPT_SHARE = 0.005
GROUP_BYTES = 6 << 20
# fixed values: first and last code points of scripts
SCRIPTS = [("latin", 0x41, 0x24F), ("ipa", 0x250, 0x2AF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F),
           ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F),
           ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F),
           ("gujarati", 0xA80, 0xAFF), ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F),
           ("kannada", 0xC80, 0xCFF), ("malayalam", 0xD00, 0xD7F), ("thai", 0xE00, 0xE7F),
           ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x139F),
           ("khmer", 0x1780, 0x17FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF),
           ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
           ("han", 0x20000, 0x3FFFF)]
SCRIPT_NAMES = ["other", *dict.fromkeys(n for n, _, _ in SCRIPTS)]
_TABLES: list[np.ndarray] = []


def tables() -> tuple[np.ndarray, np.ndarray]:
    """(is a letter, script number) by code point, made once per worker."""
    if not _TABLES:
        letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        script = np.zeros(0x110000, np.uint8)
        for name, a, b in SCRIPTS:
            script[a:b + 1] = SCRIPT_NAMES.index(name)
        _TABLES.extend((letter, script))
    return _TABLES[0], _TABLES[1]


def words_of(texts: list[str]) -> dict[str, np.ndarray]:
    """Letter words of texts: bounds per text, start and end (code points within all texts in
    a row, after lower-casing), script, and the trigram buckets with their word."""
    letter, script = tables()
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    n = len(code)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = letter[code]
    cut = np.zeros(n + 2, bool)
    cut[offsets + 1] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | cut[1:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | cut[2:])) + 1
    # each word's letters between two zeros on the left and one on the right
    size = ends - starts
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    padded = np.zeros(len(at) + 3 * len(starts), np.uint64)
    word = np.repeat(np.arange(len(starts)), size)
    padded[np.arange(len(at)) + 3 * word + 2] = code[at]
    gram = (padded[:-2] * np.uint64(0x9E3779B97F4A7C15) + padded[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
            + padded[2:] * np.uint64(0x165667B19E3779F9)) if len(padded) > 2 else np.zeros(0, np.uint64)
    first = np.concatenate([[0], np.cumsum(size + 3)])[:-1]   # a word of k letters has k + 1 trigrams
    grams = np.repeat(first - np.concatenate([[0], np.cumsum(size + 1)[:-1]]), size + 1) + np.arange((size + 1).sum())
    return {"bounds": np.searchsorted(starts, offsets), "starts": starts, "ends": ends, "offsets": offsets,
            "script": script[code[starts]] if len(starts) else np.zeros(0, np.uint8),
            "bucket": (C.mix(gram[grams]) >> np.uint64(48)).astype(np.int64), "size": size + 1}


def count_grams(df: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, bucket, n) over all rows; buckets from ``BUCKETS`` on count words per script."""
    rows = df.select(F.col(f"`{lang_col}`").cast("string").alias("lang"),
                     F.col(f"`{text_col}`").cast("string").alias("text")).where("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def given():
            for lang, n in counts.items():
                k = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(k), pa.string()), pa.array(k, pa.int32()), pa.array(n[k])],
                    names=["lang", "bucket", "n"])
            counts.clear()

        for batch in batches:
            for part in C.text_slices(batch, "text", C.PIECE_BYTES):
                langs = np.array(part["lang"].to_pylist())
                w = words_of([t.lower() for t in part["text"].to_pylist()])
                per_word = np.repeat(np.arange(len(langs)), np.diff(w["bounds"]))
                per_gram = np.repeat(per_word, w["size"])
                for lang in np.unique(langs):
                    if lang not in counts:
                        counts[lang] = np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64)
                    mine = langs == lang
                    counts[lang][:BUCKETS] += np.bincount(w["bucket"][mine[per_gram]], minlength=BUCKETS)
                    counts[lang][BUCKETS:] += np.bincount(w["script"][mine[per_word]], minlength=len(SCRIPT_NAMES))
                if len(counts) > 64:
                    yield from given()
        yield from given()

    return (rows.mapInArrow(run, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


class Model:
    """Log shares per bucket and language, and the languages of each script."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        if len(self.langs) > MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
        table = np.zeros((len(self.langs), BUCKETS + len(SCRIPT_NAMES)))
        place = {lang: k for k, lang in enumerate(self.langs)}
        table[counts["lang"].map(place).to_numpy(int), counts["bucket"].to_numpy(int)] = counts["n"]
        grams, scripts = table[:, :BUCKETS] + SMOOTHING, table[:, BUCKETS:]
        self.score = np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32).copy()
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.fits = (share >= SCRIPT_SHARE).T.copy()             # script x language
        self.unlearned = ~self.fits.any(axis=1)                  # scripts

    def word_scores(self, w: dict[str, np.ndarray]) -> np.ndarray:
        """Word x language: scores, very low for languages outside the word's script."""
        n = len(w["starts"])
        out = np.zeros((n, len(self.langs)), np.float32)
        if out.size:
            first = np.concatenate([[0], np.cumsum(w["size"])[:-1]])
            for k in range(len(self.langs)):
                out[:, k] = np.add.reduceat(self.score[:, k][w["bucket"]], first)
            out -= out.max(axis=1, keepdims=True)
            known = self.fits[w["script"]]
            out[~known] = -1e6
            out[self.unlearned[w["script"]]] = 0
        return out


def viterbi(scores: np.ndarray, bounds: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word: all texts step together, the longest first in the arrays."""
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    size, start = size[order], bounds[:-1][order]
    labels = np.zeros(len(scores), np.int64)
    if not len(scores):
        return labels
    back = np.zeros(scores.shape, np.uint16)
    own = np.arange(scores.shape[1])[None, :]
    live = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")   # texts with more than t words
    value = scores[start[:live[0]]].astype(np.float64)
    final = value.copy()
    for t in range(1, size[0]):
        n = live[t]
        value = value[:n]
        top = value.argmax(axis=1)
        best = value[np.arange(n), top] - penalty
        stay = value >= best[:, None]
        at = start[:n] + t
        back[at] = np.where(stay, own, top[:, None])
        value = np.where(stay, value, best[:, None]) + scores[at]
        final[:n] = value
    label = final.argmax(axis=1)
    for t in range(size[0] - 1, -1, -1):
        n = live[t]
        at = start[:n] + t
        labels[at] = label[:n]
        label[:n] = back[at, label[:n]]
    return labels


def identify(df: DataFrame, model: Model, penalty: float = SWITCH_PENALTY, spans: bool = True,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, spans) of every row; a span is (start, stop, lang) in code points of
    the lower-cased text, from the first letter of its first word to the last of its last."""
    picked = C.picked(df, id_col, text_col)
    names = np.array(model.langs, dtype=object)
    group = max(1 << 20, GROUP_BYTES * 4 // max(4, len(names)))
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string())]))

    def judged(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [(t or "").lower() for t in part["text"].to_pylist()]
        n = len(texts)
        pred, share, found = np.full(n, "und", object), np.zeros(n), [[] for _ in range(n)]
        scores, letters, bounds, starts, ends, at = [], [], [np.zeros(1, np.int64)], [], [], 0
        while at < n:                      # trigrams of a piece at a time, words of the whole group
            stop, room = at, C.PIECE_BYTES
            while stop < n and (stop == at or room > 0):
                room -= len(texts[stop])
                stop += 1
            w = words_of(texts[at:stop])
            scores.append(model.word_scores(w))
            letters.append(w["ends"] - w["starts"])
            bounds.append(w["bounds"][1:] + bounds[-1][-1])
            base = np.repeat(w["offsets"][:-1], np.diff(w["bounds"]))
            starts.append(w["starts"] - base)
            ends.append(w["ends"] - base)
            at = stop
        bounds = np.concatenate(bounds)
        if len(names) and bounds[-1]:
            letters = np.concatenate(letters)
            label = viterbi(np.concatenate(scores), bounds, penalty)
            owner = np.repeat(np.arange(n), np.diff(bounds))
            held = np.bincount(owner * len(names) + label, letters, n * len(names)).reshape(n, -1)
            total = held.sum(axis=1)
            some = total > 0
            pred[some] = names[held.argmax(axis=1)[some]]
            share[some] = held.max(axis=1)[some] / total[some]
            if spans:
                starts, ends = np.concatenate(starts), np.concatenate(ends)
                new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (label[1:] != label[:-1])])
                for a, b in zip(new, np.r_[new[1:], len(label)], strict=True):
                    found[owner[a]].append({"start": int(starts[a]), "stop": int(ends[b - 1]), "lang": names[label[a]]})
        cols = [part["id"], pa.array(pred, pa.string()), pa.array(share)]
        return pa.RecordBatch.from_arrays(cols + ([pa.array(found, span_type)] if spans else []),
                                          names=["id", "lang_pred", "score"] + ["spans"] * spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.with_text(batches):
            for part in C.text_slices(batch, "text", group):
                yield judged(part)

    out = [T.StructField("id", picked.schema["id"].dataType), T.StructField("lang_pred", T.StringType()),
           T.StructField("score", T.DoubleType())]
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()),
                         T.StructField("lang", T.StringType())])
    return picked.mapInArrow(run, T.StructType(out + [T.StructField("spans", T.ArrayType(span))] * spans))


def learn(df: DataFrame, teaches: Column) -> Model:
    """Model of the rows for which ``teaches`` holds."""
    return Model(count_grams(df.where(teaches)).toPandas())


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that teaches nothing: crc32(id as text) mod 4 is 2 (a null id is not in it)."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, spans: bool = False) -> DataFrame:
    """Prediction of every document by a model of the documents' own teaching fold."""
    teaches = ~held_out() & F.col("doc_id").isNotNull()
    return identify(docs, learn(docs, teaches), spans=spans)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: predicted language of every document."""
    docs = C.table(spark, sf_dir, "documents")
    return predict(docs).withColumnRenamed("id", "doc_id").select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score")
