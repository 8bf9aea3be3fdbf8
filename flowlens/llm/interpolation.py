"""Operator 11, language-model scores by deleted interpolation.

A token's probability mixes the maximum-likelihood estimates of all n-gram orders up to
``ORDER`` and a uniform share over the training vocabulary plus one unknown word. The
mixture weights belong to the bucket of the token's longest context seen in training: its
length and the power of two of its count. They are learned by expectation-maximisation on
a fold of the training documents (one of ``FOLDS``) whose own counts are deleted from the
estimates meanwhile; the final estimates count every training document.

How the counts travel: a slice of some MB of texts is reduced to its distinct n-gram keys
(64 bits) with their counts, sorted, and dealt as arrays to buckets by the keys' leading
bits, so each key is met in one task, once per slice, however common it is. A bucket adds
the counts up and answers every slice with arrays in the order of the slice's own sorted
keys; the keys themselves do not travel back. Answers and texts then meet in row order
(one shuffle), and each text is scored from its slice's answers. The number of buckets
follows the input's bytes, so buckets, slices and answers stay bounded at any size.

Defined results: null text counts as empty (its only token is the end); rows with a null id
are scored but teach nothing; repeated rows and ids are counted and scored row by row;
without training tokens every token has the uniform probability; an empty table gives no
rows; columns other than the id and the text are not read. Words are told apart by a 64-bit
hash of their bytes, n-grams by one of 62 bits and their order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import common as C

ORDER = 2
FOLDS, FOLD = 16, 3
SLICE_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
CHUNK_ROWS = 1 << 14
#: Keys in one row: Spark hands Python workers so many thousand rows at once, whatever their size.
ROW_KEYS = 256
ROUNDS, CLOSE, PRIOR = 20, 1e-3, 1.0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
START, END = np.uint64(0x51A7F3C2D98E6B04), np.uint64(0xE2D0C5B7A6918374)
_LEVEL = np.uint64(3)


class Grams:
    """Tokens of some texts and the sorted distinct n-gram keys that a model is asked for.

    A text is read as START, its words, END. ``keys[k - 1]`` holds the key of the k-gram that
    ends at each position (0 where the text is too short for it); the two lowest bits of a
    key are its order, 0 for START alone.
    """

    def __init__(self, texts: pa.Array, order: int):
        n, parts, sizes = len(texts), [], [np.zeros(0, np.int64)]
        for part in C.text_slices(pa.record_batch([texts], ["text"]), "text"):   # hashing needs wide arrays: a little at a time
            data, offsets = C.text_bytes(part["text"])
            data = LOWER[data]
            starts, ends, bounds = C.word_spans(data, offsets)
            parts.append(C.span_hashes(data, starts, ends))
            sizes.append(np.diff(bounds))
        words = np.concatenate(sizes)
        self.last = np.cumsum(words + 2) - 1                  # END's position in each text
        self.first = self.last - words - 1                    # START's
        size = int(words.sum()) + 2 * n
        token = np.zeros(size, np.uint64)
        word = np.ones(size, bool)
        word[self.first] = word[self.last] = False
        token[word] = np.concatenate([np.zeros(0, np.uint64), *parts])
        token[self.first], token[self.last] = START, END
        self.owner = np.repeat(np.arange(n), words + 2)
        place = np.arange(size) - self.first[self.owner] if n else np.zeros(0, np.int64)
        self.scored = place > 0
        self.keys, rolled = [], np.zeros(size, np.uint64)
        for k in range(1, order + 1):
            rolled = C.mix(token if k == 1 else np.r_[np.zeros(1, np.uint64), rolled[:-1]] * np.uint64(5) + token)
            key = rolled & ~_LEVEL | np.uint64(k)
            key[place < k - 1] = 0
            if k == 1:
                key[self.first] = START & ~_LEVEL
            self.keys.append(key)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(sorted distinct keys, number of each key in them by order and position)."""
        flat = np.concatenate(self.keys)
        real = flat != 0
        keys, at = np.unique(flat[real], return_inverse=True)
        number = np.full(len(flat), -1, np.int64)
        number[real] = at
        return keys, number.reshape(len(self.keys), -1)

    def counts(self, keys: np.ndarray, number: np.ndarray, taught: np.ndarray) -> np.ndarray:
        """How often each key occurs in the texts for which ``taught`` holds."""
        use = (number >= 0) & taught[self.owner]
        return np.bincount(number[use], minlength=len(keys))


def estimates(grams: Grams, number: np.ndarray, seen: np.ndarray, total: int
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, estimates by order, count) of every scored position; an order whose context is
    unseen has estimate 0 and a bucket of its own keeps it out of the mixture."""
    at = np.flatnonzero(grams.scored)
    shares = np.zeros((len(number), len(at)))
    bucket = np.zeros(len(at), np.int64)
    for k in range(len(number)):
        count = np.where(number[k, at] >= 0, seen[number[k, at]], 0)
        if k == 0:
            context, word = np.full(len(at), total), count
        else:
            context = np.where(number[k - 1, at - 1] >= 0, seen[number[k - 1, at - 1]], 0)
        known = context > 0
        shares[k, known] = count[known] / context[known]
        bucket[known] = 64 * (k + 1) + np.frexp(context[known].astype(float))[1] - 1
    return bucket, shares, word


def _rows(df: DataFrame, id_col: str, text_col: str, taught: Column, fold: Column) -> DataFrame:
    """(id, text, taught, held, piece, row): a piece is a range of rows of one file, of one fold."""
    placed = C.with_row_id(df, "__place")
    row = F.col("__place.row")
    held = F.coalesce(taught & fold, F.lit(False)).alias("held")
    rows = placed.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                         F.coalesce(taught, F.lit(False)).alias("taught"), held, F.col("__place.file").alias("file"),
                         row.alias("row"))
    piece = F.xxhash64("file", F.floor(F.col("row") / CHUNK_ROWS), "held").alias("piece")
    return rows.select("id", "text", "taught", "held", piece, "row")


def count_slices(rows: DataFrame, order: int, bits: int) -> DataFrame:
    """(bucket, piece, row, held, at, keys, n): sorted distinct keys of each slice, by bucket, at most
    ``ROW_KEYS`` a row; ``at`` is the first one's place among the slice's keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.text_slices(batch, "text", SLICE_BYTES):
                pieces = part["piece"].to_numpy()
                for piece in np.unique(pieces):
                    yield one(part.take(pa.array(np.flatnonzero(pieces == piece))))

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        grams = Grams(part["text"], order)
        keys, number = grams.distinct()
        n = grams.counts(keys, number, part["taught"].to_numpy(zero_copy_only=False))
        bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
        place = np.arange(len(keys))
        start = np.maximum.accumulate(np.where(np.r_[True, bucket[1:] != bucket[:-1]], place, 0))
        cut = np.flatnonzero((place - start) % ROW_KEYS == 0)
        ends = pa.array(np.r_[cut, len(keys)], pa.int32())
        first = [part[c][0].as_py() for c in ("piece", "row", "held")]
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[cut]), *(pa.array([v] * len(cut)) for v in first), pa.array(cut),
             pa.ListArray.from_arrays(ends, pa.array(keys.view(np.int64))),
             pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int32)))],
            names=["bucket", "piece", "row", "held", "at", "keys", "n"])

    return rows.select("text", "taught", "held", "piece", "row").mapInArrow(
        run, "bucket long, piece long, row long, held boolean, at long, keys array<long>, n array<int>")


ANSWER = ("piece long, row long, held boolean, at long, seen array<long>, kept array<long>, "
          "totals array<long>")


def add_up(slices: DataFrame) -> DataFrame:
    """Answers: per slice and bucket the corpus counts of its keys, with (``seen``) and, for
    slices of the held fold, without (``kept``) that fold's own; one row per bucket without a
    piece holds the ``totals``: tokens and distinct words, seen and kept."""
    def answers(table: pa.Table) -> pa.Table:
        lists = table["keys"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        keys, at = np.unique(lists.flatten().to_numpy().view(np.uint64), return_inverse=True)
        n = table["n"].combine_chunks().flatten().to_numpy()
        held = np.repeat(table["held"].to_numpy(zero_copy_only=False), sizes)
        seen = np.bincount(at, n, len(keys)).astype(np.int64)
        kept = seen - np.bincount(at[held], n[held], len(keys)).astype(np.int64)
        word = (keys & _LEVEL) == 1
        totals = [int(v) for c in (seen, kept) for v in (c[word].sum(), (c[word] > 0).sum())]
        ends = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
        kept_sizes = np.where(table["held"].to_numpy(zero_copy_only=False), sizes, 0)
        rows = pa.table([table["piece"], table["row"], table["held"], table["at"],
                         pa.ListArray.from_arrays(ends, pa.array(seen[at])),
                         pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(kept_sizes)], pa.int32()),
                                                  pa.array(kept[at[held]])),
                         pa.nulls(len(table), pa.list_(pa.int64()))], names=names)
        sums = pa.table([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.int64()),
                         pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.int64())),
                         pa.array([totals], pa.list_(pa.int64()))], names=names)
        return pa.concat_tables([rows, sums])

    names = [f.split()[0] for f in ANSWER.split(", ")]
    return slices.groupBy("bucket").applyInArrow(answers, ANSWER)


def meet(rows: DataFrame, answers: DataFrame, counts: str, judge, schema: str) -> DataFrame:
    """``judge(texts, counts)`` for every slice: its rows and its answers, in the keys' order.

    Rows and answers are dealt by piece and sorted, a slice's answers before its rows, so a
    task holds one slice at a time."""
    kind = rows.schema["id"].dataType
    left = rows.select("piece", "row", F.lit(1).alias("side"), F.lit(0).cast("long").alias("at"), "id", "text",
                       F.lit(None).cast("array<long>").alias("counts"))
    right = answers.where("piece is not null").select(
        "piece", "row", F.lit(0).alias("side"), "at", F.lit(None).cast(kind).alias("id"),
        F.lit(None).cast("string").alias("text"), F.col(counts).alias("counts"))
    both = left.unionByName(right).repartition("piece").sortWithinPartitions("piece", "row", "side", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, waiting = [], []

        def finish() -> Iterator[pa.RecordBatch]:
            if waiting:
                part = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                yield from judge(part, np.concatenate([a.flatten().to_numpy() for a in known]))
            known.clear()
            waiting.clear()

        for batch in batches:
            side = batch["side"].to_numpy()
            cut = np.flatnonzero(np.r_[True, side[1:] != side[:-1]]) if len(side) else []
            for a, b in zip(cut, [*cut[1:], len(side)], strict=True):
                part = batch.slice(a, b - a)
                if side[a]:
                    waiting.append(part.select(["id", "text"]))
                else:
                    if waiting:
                        yield from finish()
                    known.append(part["counts"])
        yield from finish()

    return both.mapInArrow(run, schema)


def held_events(rows: DataFrame, answers: DataFrame, order: int, total: int) -> DataFrame:
    """(bucket, p1.., n): estimates of the held fold's tokens without that fold's counts."""
    def judge(part: pa.RecordBatch, kept: np.ndarray) -> Iterator[pa.RecordBatch]:
        grams = Grams(part["text"], order)
        bucket, shares, _ = estimates(grams, grams.distinct()[1], kept, total)
        key = C.mix(bucket.astype(np.uint64))
        for p in shares:
            key = C.mix(key * np.uint64(3) + p.view(np.uint64))
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), *(pa.array(p[first]) for p in shares), pa.array(n)],
                                         names=["bucket", *names, "n"])

    names = [f"p{k}" for k in range(1, order + 1)]
    return meet(rows.where("held"), answers.where("held"), "kept", judge,
                "bucket long, " + ", ".join(f"{p} double" for p in names) + ", n long")


def learn_weights(events: DataFrame, order: int, words: int) -> dict[int, list[float]]:
    """Mixture weights (uniform, order 1, ...) per bucket by expectation-maximisation; a bucket's
    weights start equal and carry ``PRIOR`` pseudo-tokens each, so none vanishes. At most 64
    buckets per order meet the driver."""
    spark, uniform = events.sparkSession, 1 / (words + 1)
    counts = {r["bucket"]: r["n"] for r in events.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    size = {b: 1 + b // 64 for b in counts}                     # components a bucket may use
    weights = {b: [1 / size[b]] * size[b] + [0.0] * (order + 1 - size[b]) for b in counts}
    names = [f"w{k}" for k in range(order + 1)]
    for _ in range(ROUNDS if counts else 0):
        table = spark.createDataFrame([(b, *w) for b, w in weights.items()],
                                      "bucket long, " + ", ".join(f"{w} double" for w in names))
        parts = [F.col("w0") * F.lit(uniform)] + [F.col(f"w{k}") * F.col(f"p{k}") for k in range(1, order + 1)]
        mixed = sum(parts[1:], parts[0])
        sums = (events.join(F.broadcast(table), "bucket").groupBy("bucket")
                .agg(*[F.sum(F.col("n") * p / mixed).alias(w) for w, p in zip(names, parts, strict=True)]).collect())
        new = {}
        for r in sums:
            b = r["bucket"]
            got = [r[w] + PRIOR if k < size[b] else 0.0 for k, w in enumerate(names)]
            new[b] = [g / sum(got) for g in got]
        moved = max(abs(x - y) for b in new for x, y in zip(new[b], weights[b], strict=True))
        weights = new
        if moved < CLOSE:
            break
    return weights


def weight_table(weights: dict[int, list[float]], order: int) -> np.ndarray:
    """Weights of every bucket: those of the nearest learned one of its order, else equal ones."""
    out = np.zeros((64 * (order + 1), order + 1))
    for b in range(len(out)):
        k = b // 64
        near = min((x for x in weights if x // 64 == k), key=lambda x: (abs(x - b), x), default=None)
        out[b] = weights[near] if near is not None else [1 / (k + 1)] * (k + 1) + [0.0] * (order - k)
    return out


SCORED = "n_tokens long, n_known long, base_score double, score double"


def score_rows(rows: DataFrame, answers: DataFrame, order: int, total: int, words: int, weights: np.ndarray
               ) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of every row."""
    def judge(part: pa.RecordBatch, seen: np.ndarray) -> Iterator[pa.RecordBatch]:
        grams = Grams(part["text"], order)
        bucket, shares, word = estimates(grams, grams.distinct()[1], seen, total)
        w = weights[bucket]
        p = w[:, 0] / (words + 1)
        for k in range(order):
            p += w[:, k + 1] * shares[k]
        owner, n = grams.owner[grams.scored], part.num_rows
        base = np.log10((word + 1) / (total + words + 1))
        yield pa.RecordBatch.from_arrays(
            [part["id"], pa.array(np.bincount(owner, minlength=n)),
             pa.array(np.bincount(owner[word > 0], minlength=n)), pa.array(np.bincount(owner, base, n)),
             pa.array(np.bincount(owner, np.log10(p), n))], names=["id", *(f.split()[0] for f in SCORED.split(", "))])

    return meet(rows, answers, "seen", judge, f"id {rows.schema['id'].dataType.simpleString()}, {SCORED}")


def fit_and_score(df: DataFrame, taught: Column, fold: Column, id_col: str = "doc_id", text_col: str = "text",
                  order: int = ORDER) -> tuple[DataFrame, dict]:
    """Scores of all rows by a model of the rows for which ``taught`` holds; its weights are
    learned on those for which ``fold`` holds too. Also returns N, V and the weights."""
    if not 1 <= order <= 3:
        raise ValueError("orders 1 to 3")
    rows = _rows(df, id_col, text_col, taught, fold)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, size) / BUCKET_BYTES)))
    answers = C.staged(add_up(count_slices(rows, order, bits)), "ngram-counts")
    totals = answers.where("totals is not null").agg(*[F.sum(F.col("totals")[k]).alias(f"t{k}") for k in range(4)])
    total, words, kept_total, kept_words = (int(v or 0) for v in totals.first())
    events = C.staged(held_events(rows, answers, order, kept_total), "held-events")
    weights = learn_weights(events, order, kept_words)
    out = score_rows(rows, answers, order, total, words, weight_table(weights, order))
    return out, {"tokens": total, "words": words, "weights": weights}


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that teach nothing: crc32(id as text) mod 7 is 2 (a null id is not in it)."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 7 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: scores of every document."""
    docs = C.table(spark, sf_dir, "documents")
    fold = F.floor(F.crc32(F.col("doc_id").cast("string")) / 7) % FOLDS == FOLD
    out, model = fit_and_score(docs, ~held_out() & F.col("doc_id").isNotNull(), fold)
    return out.withColumnRenamed("id", "doc_id").select(
        "doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias(
            "train_tokens"), "base_score", "score")
