"""Operator 8, packing by cutting-stock column generation.

Every document (its token ids and an end id) is cut into full pieces of ``SIZE`` tokens, each
a sequence of its own, and one remainder. Remainders of 1 to ``SIZE - 1`` tokens fall into
length classes of ``STEP`` tokens. Over the histogram of the classes, whose size does not
depend on the data, a linear program chooses how often to use which pattern (numbers of
pieces per class that fit a sequence): it starts with one-class patterns, and a knapsack
dynamic program prices new ones with the dual values until none helps. Counts are rounded
down; what is left over (fewer pieces than classes times pieces in a sequence) is packed
first-fit by decreasing length. Patterns are then dealt to the documents by their rank
within the class.

Tokenising runs once, in tasks; only the histogram reaches the driver. Ranks are the tasks'
running counts plus an offset per (task, class), so no class is ever sorted or gathered,
whatever its share of the rows.

Defined results: null text is an empty text (its only id is the end id); repeated rows and
ids are packed row by row; an empty table gives no rows; only the id and the text column
are read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowlens.llm import common as C
from flowlens.llm.bpe import DIGITS, KEEP_LENGTH, LETTERS, UNUSUAL

VOCABULARY, END_ID = "word_bpe_49k.json", 1
SIZE, STEP = 2048, 8
#: Words kept per worker before the memory is dropped and filled anew: about 300 bytes each.
KEEP_WORDS = 200_000
TOLERANCE = 1e-9
#: Column generation ends when no pattern can lower the number of sequences by this share.
GAP = 2e-4
#: The vocabulary's own pattern, for lower-cased texts of plain Latin characters.
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\s{LETTERS}{DIGITS}]+")
# fixed values: how a vocabulary file cuts texts that ``PIECES`` cuts alike, and how it marks the end of a word
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True}
WORD_END = "</w>"


class Ids:
    """Token ids of texts, as the tokenizers library gives them; ids of words are kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        parts = [json.loads(p.__getstate__()) if p else {} for p in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)]
        if (parts[0].get("normalizers"), parts[1].get("pretokenizers", [])[:1]) != (NORMAL, [SPLIT]):
            raise ValueError("the pattern of words and that of the vocabulary file differ")
        # the same model for words that are cut and lower-cased already
        self.learner = Tokenizer(self.tokenizer.model)
        self.learner.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words: many are encoded at once as one spaced text."""
        out = {}
        for at in range(0, len(words), 4096):
            some = words[at:at + 4096]
            ids = np.array(self.learner.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            edge = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(edge) != len(some) or edge[-1] != 4 * len(ids):
                raise ValueError("words of the pattern and of the vocabulary file differ")
            raw, edge = ids.tobytes(), [0, *edge.tolist()]
            out.update(zip(some, [raw[a:b] for a, b in zip(edge, edge[1:], strict=False)], strict=True))
        return out

    def encoded(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of every text."""
        cut = [None if UNUSUAL.search(t) or any(s in t for s in self.special)
               else PIECES.findall(t.lower()) for t in texts]
        used = set().union(*(x for x in cut if x))
        if len(self.words) > KEEP_WORDS:              # words of this slice stay
            self.words = {w: v for w in used if (v := self.words.get(w))}
        new = self._learn(list(used.difference(self.words)))
        table = self.words | new if len(new) > KEEP_WORDS else self.words
        table.update((w, v) for w, v in new.items() if table is not self.words or len(w) <= KEEP_LENGTH)
        for text, words in zip(texts, cut, strict=True):
            if words is None:
                yield self._whole(text)
            else:
                yield np.frombuffer(b"".join([table.get(w) or new[w] for w in words]), "<u4")


_IDS: dict[str, Ids] = {}


def token_ids(path: str) -> Ids:
    """The worker's tokenizer of a vocabulary file, loaded once."""
    if path not in _IDS:
        _IDS[path] = Ids(path)
    return _IDS[path]


CUT_FIELDS = [("task", pa.int32(), "int"), ("row", pa.int64(), "bigint"),
              ("doc_tokens", pa.int64(), "bigint"), ("full_crcs", pa.list_(pa.int64()), "array<bigint>"),
              ("full_before", pa.int64(), "bigint"), ("rest", pa.int32(), "int"),
              ("rest_crc", pa.int64(), "bigint"), ("kind", pa.int32(), "int"),
              ("kind_rank", pa.int64(), "bigint")]


def cut_documents(df: DataFrame, path: str, end_id: int | None = END_ID, size: int = SIZE, step: int = STEP,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: checksums of its full pieces and of its remainder, the
    remainder's class and the document's rank within the class in this task."""
    picked = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows, full = TaskContext.get().partitionId(), 0, 0
        seen = np.zeros(size // step + 2, np.int64)
        tail = np.array([] if end_id is None else [end_id], "<u4")
        for batch in batches:
            for part in C.text_slices(batch, "text", C.PIECE_BYTES):
                made = []
                for ids in token_ids(path).encoded([t or "" for t in part["text"].to_pylist()]):
                    ids = np.concatenate([ids, tail])
                    whole, rest = divmod(len(ids), size)
                    raw = ids.tobytes()
                    crcs = [zlib.crc32(raw[k:k + 4 * size]) for k in range(0, 4 * size * whole, 4 * size)]
                    kind = -(-rest // step)
                    made.append((task, rows, len(ids), crcs, full, rest, zlib.crc32(raw[4 * size * whole:]),
                                 kind, seen[kind]))
                    seen[kind] += 1
                    full += whole
                    rows += 1
                yield pa.RecordBatch.from_arrays(
                    [part["id"], *(pa.array([m[k] for m in made], t) for k, (_, t, _) in enumerate(CUT_FIELDS))],
                    names=["id", *(n for n, _, _ in CUT_FIELDS)])

    ddl = ", ".join(f"{n} {d}" for n, _, d in CUT_FIELDS)
    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, {ddl}")


def knapsack(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Best value and counts of an unbounded knapsack, by dynamic programming over the room."""
    best, item = np.zeros(room + 1), np.full(room + 1, -1)
    for r in range(1, room + 1):
        best[r] = best[r - 1]
        fit = np.searchsorted(sizes, r, "right")
        if fit:
            gain = best[r - sizes[:fit]] + values[:fit]
            k = int(gain.argmax())
            if gain[k] > best[r] + TOLERANCE:
                best[r], item[r] = gain[k], k
    counts, r = np.zeros(len(sizes), np.int64), room
    while r > 0:
        if item[r] < 0:
            r -= 1
        else:
            counts[item[r]] += 1
            r -= sizes[item[r]]
    return float(best[room]), counts


def _inverse(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots, by whole-array steps: a few hundred rows need no threaded
    solver, whose threads stall a driver that shares its cores."""
    n = len(a)
    both = np.concatenate([a.astype(float), np.eye(n)], axis=1)
    for k in range(n):
        p = k + int(np.abs(both[k:, k]).argmax())
        if not both[p, k]:
            raise np.linalg.LinAlgError("singular patterns")
        both[[k, p]] = both[[p, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        both -= np.outer(factor, both[k])
    return both[:, n:]


def solve_patterns(demand: dict[int, int], room: int) -> list[tuple[int, dict[int, int]]]:
    """(times, pieces per class) patterns that use up the demand exactly, by column generation."""
    sizes = np.array(sorted(k for k, n in demand.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    wanted = np.array([demand[int(k)] for k in sizes], float)
    columns = np.diag(room // sizes)              # basis: one pattern per class at first
    inverse = np.diag(1.0 / (room // sizes))
    for turn in range(50 * len(sizes)):
        value, pattern = knapsack(inverse.sum(axis=0), sizes, room)   # duals: every pattern costs 1
        if value <= 1 + GAP:
            break
        step = (inverse * pattern).sum(axis=1)
        level = (inverse * wanted).sum(axis=1)
        ratio = np.where(step > TOLERANCE, level / np.where(step > TOLERANCE, step, 1), np.inf)
        out = int(ratio.argmin())
        columns[:, out] = pattern
        if turn % 200 == 199:                     # fresh inverse against rounding
            inverse = _inverse(columns)
        else:
            pivot = inverse[out] / step[out]
            inverse = inverse - np.outer(step, pivot)
            inverse[out] = pivot
    times = np.floor(np.maximum((_inverse(columns) * wanted).sum(axis=1), 0) + 1e-6).astype(np.int64)
    left = wanted.astype(np.int64) - columns @ times
    for p in np.flatnonzero((columns * (left < 0)[:, None]).any(axis=0)):   # rounding took too many
        while times[p] and (columns[:, p] * (left < 0)).any():
            times[p] -= 1
            left += columns[:, p]
    found = [(int(t), {int(sizes[i]): int(columns[i, p]) for i in np.flatnonzero(columns[:, p])})
             for p, t in enumerate(times) if t]
    bins: list[tuple[int, dict[int, int]]] = []   # first fit by decreasing length
    for i in range(len(sizes) - 1, -1, -1):
        for _ in range(left[i]):
            k = int(sizes[i])
            at = next((b for b, (free, _) in enumerate(bins) if free >= k), len(bins))
            if at == len(bins):
                bins.append((room, {}))
            bins[at][1][k] = bins[at][1].get(k, 0) + 1
            bins[at] = (bins[at][0] - k, bins[at][1])
    return found + [(1, pieces) for _, pieces in bins]


def slots(patterns: list[tuple[int, dict[int, int]]], first: int) -> list[tuple]:
    """(class, rank from, rank to, pieces per sequence, first sequence, order in it) rows:
    which ranks of a class lie in which sequences."""
    used: dict[int, int] = {}
    out = []
    for times, pieces in patterns:
        for order, (kind, n) in enumerate(sorted(pieces.items(), reverse=True)):
            at = used.get(kind, 0)
            out.append((kind, at, at + n * times, n, first, order))
            used[kind] = at + n * times
        first += times
    return out


def pack(df: DataFrame, path: str, end_id: int | None = END_ID, size: int = SIZE, step: int = STEP,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = df.sparkSession
    docs = C.staged(cut_documents(df, path, end_id, size, step, id_col, text_col), "cut")

    full_counts = docs.groupBy("task").agg(F.sum(F.size("full_crcs")).alias("n"))
    before = F.sum("n").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, -1))   # one row per task
    full_from = full_counts.select("task", F.coalesce(before, F.lit(0)).alias("full_from"))
    kinds = docs.where("kind > 0").groupBy("task", "kind").agg(F.count("*").alias("n"))
    order = W.partitionBy("kind").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    kind_from = kinds.select("task", "kind", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("kind_from"))

    demand = {r.kind: r.n for r in kinds.groupBy("kind").agg(F.sum("n").alias("n")).collect()}   # size / step rows
    first = docs.agg(F.sum(F.size("full_crcs"))).first()[0] or 0
    rows = slots(solve_patterns(demand, size // step), first)
    plan = spark.createDataFrame(
        rows, "kind int, rank_from long, rank_to long, per long, first long, slot int")
    # at most two patterns' worth of rows per class: bounded by (size / step) squared
    by_kind = F.broadcast(plan.groupBy("kind").agg(F.sort_array(F.collect_list(
        F.struct("rank_from", "rank_to", "per", "first", "slot"))).alias("plan")))

    full = docs.where(F.size("full_crcs") > 0).join(full_from, "task").select(
        "id", F.posexplode("full_crcs").alias("k", "ids_crc32"), "doc_tokens",
        (F.col("full_from") + F.col("full_before")).alias("base"))
    full = full.select("id", (F.col("k") * F.lit(size)).cast("long").alias("start"),
                       F.lit(size).cast("long").alias("length"), "ids_crc32", "doc_tokens",
                       (F.col("base") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    ranked = (docs.where("kind > 0").join(kind_from, ["task", "kind"])
              .withColumn("r", F.col("kind_rank") + F.col("kind_from")).join(by_kind, "kind")
              .withColumn("p", F.element_at(F.filter("plan", lambda x: (x["rank_from"] <= F.col("r"))
                                                     & (F.col("r") < x["rank_to"])), 1)))
    within = F.col("r") - F.col("p.rank_from")
    placed = ranked.select(
        "id", (F.col("doc_tokens") - F.col("rest")).alias("start"), F.col("rest").cast("long").alias("length"),
        F.col("rest_crc").alias("ids_crc32"), "doc_tokens",
        (F.col("p.first") + F.floor(within / F.col("p.per"))).cast("long").alias("sequence_id"),
        F.col("p.slot").alias("slot"), F.pmod(within, F.col("p.per")).alias("copy"))
    order = W.partitionBy("sequence_id").orderBy("slot", "copy").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))
    return full.unionByName(placed.drop("slot", "copy"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the pieces of all documents and their places in sequences."""
    out = pack(C.table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return out.withColumnRenamed("id", "doc_id")
