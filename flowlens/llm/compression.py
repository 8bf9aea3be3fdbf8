"""Operator 7, quality rules by compression bands.

Whole documents and fixed chunks are compressed with zstandard; a document whose ratio lies
outside the band of its length is repetitive (too high) or incompressible (too low).

The band of a length class (log2 of the bytes) is centred on the class's median ratio over
the whole corpus, blended with a prior curve that weighs as much as ``PRIOR_DOCS``
documents; its half width is ``SPREADS`` robust standard deviations, taken from the side of
the median with less spread (a hot group widens its own side only), at least ``LEAST_HIGH`` /
``LEAST_LOW`` and at most ``MOST_HIGH`` / ``MOST_LOW`` of the centre. Short texts scatter as
1 / sqrt(bytes): ``SCATTER`` keeps their upper side open where copies make the spread small.
Chunks of ``CHUNK_BYTES`` have one band.

Defined results: null text counts as empty (no word, base fails, not kept); empty table
gives no rows; repeated rows and doc_ids are judged row by row; columns other than the id
and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import common as C

LEVEL = 3
CHUNK_BYTES = 4096
SPREADS = 5.0
LEAST_HIGH, LEAST_LOW = 0.12, 0.30
MOST_HIGH, MOST_LOW = 0.30, 0.35
SCATTER = 3.4
CHUNK_HIGH, CHUNK_LOW = 1.6, 0.7
PRIOR_DOCS, PRIOR_SPREAD = 50, 0.05
# prior centre of zstandard's ratio for prose, by log2 of the bytes
PRIOR = [(5, 0.75), (6, 0.85), (7, 1.05), (8, 1.4), (9, 1.55), (10, 1.75), (11, 1.95),
         (12, 2.1), (13, 2.2), (14, 2.3), (15, 2.4), (16, 2.5)]
WINDOW = 5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
          ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
          ("n_bytes", pa.int64()), ("ratio", pa.float64()), ("chunk_min", pa.float64()),
          ("chunk_max", pa.float64())]


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def _owner(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The five exact counts of each text."""
    n = len(offsets) - 1
    starts, ends, bounds = C.word_spans(data, offsets)
    lead = ((data & 0xC0) != 0x80) & ~C.SEPARATOR[data]

    # lines: cut at \n and at text borders; only lines that hold a word take part
    edges = np.union1d(np.flatnonzero(data == 0x0A) + 1, offsets)
    line_from, line_to = edges[:-1], edges[1:]
    ended = data[line_to - 1] == 0x0A if len(line_to) else np.zeros(0, bool)
    worded = np.searchsorted(starts, line_to) > np.searchsorted(starts, line_from)
    line_from, line_to = line_from[worded], (line_to - ended)[worded]
    line_owner = np.searchsorted(offsets, line_from, "right") - 1
    keys = C.span_hashes(data, line_from, line_to) ^ C.mix(line_owner.astype(np.uint64))
    _, first = np.unique(keys, return_index=True)
    dup_lines = np.bincount(line_owner, minlength=n) - np.bincount(line_owner[first], minlength=n)

    owner = _owner(bounds)
    window, at = C.window_hashes(C.span_hashes(data, starts, ends), bounds, WINDOW)
    keys = window ^ C.mix(owner[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    covered = np.cumsum(cover[:-1]) > 0
    return {"n_words": np.diff(bounds), "word_chars": _sums(lead, offsets),
            "n_symbols": _sums(SYMBOLS[data], offsets), "n_dup_lines": dup_lines,
            "n_repeat_words": np.bincount(owner[covered], minlength=n)}


def _ratios(data: np.ndarray, offsets: np.ndarray, level: int, chunk: int) -> list[np.ndarray]:
    pack = zstandard.ZstdCompressor(level=level).compress
    n = len(offsets) - 1
    ratio, low, high = (np.full(n, np.nan) for _ in range(3))
    for i in range(n):
        text = data[offsets[i]:offsets[i + 1]].tobytes()
        if not text:
            continue
        ratio[i] = len(text) / len(pack(text))
        at = list(range(0, len(text) - chunk + 1, chunk))
        if at and len(text) % chunk:        # the last bytes, in a whole chunk that overlaps
            at.append(len(text) - chunk)
        whole = [chunk / len(pack(text[k:k + chunk])) for k in at]
        if whole:
            low[i], high[i] = min(whole), max(whole)
    return [ratio, low, high]


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = LEVEL,
            chunk: int = CHUNK_BYTES) -> DataFrame:
    """One row per input row: the id, exact counts, bytes and compression ratios."""
    picked = df.select(F.col(f"`{id_col}`").alias("id"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.text_slices(batch, "text"):
                data, offsets = C.text_bytes(part["text"])
                counts = base_counts(data, offsets)
                cols = [*counts.values(), np.diff(offsets), *_ratios(data, offsets, level, chunk)]
                yield pa.RecordBatch.from_arrays(
                    [part["id"], *(pa.array(v, t, from_pandas=True)
                                   for v, (_, t) in zip(cols, FIELDS, strict=True))],
                    names=["id", *(f for f, _ in FIELDS)])

    kind = picked.schema["id"].dataType.simpleString()
    ddl = ", ".join(f"{f} {'bigint' if t == pa.int64() else 'double'}" for f, t in FIELDS)
    return picked.mapInArrow(run, f"id {kind}, {ddl}")


def band_limits(stats: DataFrame) -> DataFrame:
    """(band, low, high) of whole documents; band -1 holds the chunk limits.

    Medians come from every measured document; the table has one row per power of two.
    """
    log = F.floor(F.log2("n_bytes")).cast("int")
    docs = stats.where("n_bytes > 0").select(log.alias("band"), F.log("ratio").alias("x"))
    centre = docs.groupBy("band").agg(F.percentile_approx("x", [0.25, 0.5, 0.75], 10000).alias("q"),
                                      F.count("*").alias("n"))
    prior = F.element_at(F.map_from_arrays(*(F.array(*[F.lit(v) for v in col])
                                             for col in zip(*PRIOR, strict=True))),
                         F.greatest(F.lit(PRIOR[0][0]), F.least(F.lit(PRIOR[-1][0]),
                                                               F.col("band"))))
    weight = F.col("n") / (F.col("n") + PRIOR_DOCS)
    low, mid, high = (F.col("q")[i] for i in range(3))
    side = F.least(high - mid, mid - low) / 0.6745
    centred = F.exp(weight * mid + (1 - weight) * F.log(prior))
    spread = (weight * side + (1 - weight) * PRIOR_SPREAD) * SPREADS
    least_high = F.greatest(F.lit(LEAST_HIGH), SCATTER / F.sqrt(F.pow(F.lit(2.0), "band")))
    whole = centre.select(
        "band", (centred * (1 - F.greatest(F.lit(LEAST_LOW), F.least(spread, F.lit(MOST_LOW))))).alias("low"),
        (centred * (1 + F.least(F.greatest(least_high, spread), F.lit(MOST_HIGH)))).alias("high"))
    chunk_mid = dict(PRIOR)[CHUNK_BYTES.bit_length() - 1]
    both = F.concat(*(F.array(c) for c in ("chunk_min", "chunk_max")))
    chunks = (stats.where("chunk_min is not null").select(F.explode(both).alias("r"))
              .agg(F.percentile_approx("r", 0.5, 10000).alias("m"), F.count("*").alias("n"))
              .select(F.lit(-1).alias("band"),
                      ((F.coalesce("m", F.lit(chunk_mid)) * F.col("n") + chunk_mid * PRIOR_DOCS)
                       / (F.col("n") + PRIOR_DOCS)).alias("m"))
              .select("band", (F.col("m") * CHUNK_LOW).alias("low"),
                      (F.col("m") * CHUNK_HIGH).alias("high")))
    return whole.unionByName(chunks)


def judge(stats: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds ``repetitive`` and ``incompressible`` (false for empty texts)."""
    table = F.broadcast(limits.groupBy().agg(   # at most 64 length classes
        F.map_from_entries(F.collect_list(F.struct("band", F.struct("low", "high")))).alias("t")))
    band = F.floor(F.log2("n_bytes")).cast("int")
    doc, chunk = F.element_at("t", band), F.element_at("t", F.lit(-1))
    return (stats.join(table, how="left").withColumn(
        "repetitive", F.coalesce((F.col("ratio") > doc["high"])
                                 | F.coalesce(F.col("chunk_max") > chunk["high"], F.lit(False)),
                                 F.lit(False)))
        .withColumn("incompressible",
                    F.coalesce((F.col("ratio") < doc["low"])
                               | F.coalesce(F.col("chunk_min") < chunk["low"], F.lit(False)),
                               F.lit(False)))
        .drop("t"))


def compression_bands(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures, limits and verdict of every row (see the module's docstring)."""
    stats = C.staged(measure(df, id_col, text_col), "bands")
    return judge(stats, band_limits(stats))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: counts, base rules and the band verdict of every document."""
    out = compression_bands(C.table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols",
                      "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                      (~failed & ~F.col("repetitive") & ~F.col("incompressible")).alias("kept"),
                      "ratio", "chunk_min", "chunk_max")
