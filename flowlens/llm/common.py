"""Helpers shared by the training-data operators: staged tables, byte-level word arrays.

Word rule used throughout: a word is a maximal run of bytes other than space and
0x09-0x0D. Texts stay UTF-8; every separator is ASCII, so no character is ever cut.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.session import ensure_checkpoint_dir

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SLICE_BYTES = 2 << 20
#: Texts whose bytes or words are spread out as wide arrays at once: about 150 times as much memory.
PIECE_BYTES = 512 << 10
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POW = np.ones(1, np.uint64)
_POW_INV = np.ones(1, np.uint64)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reader of one given table.

    Python workers started elsewhere than in the source tree find the package through
    their environment (on a cluster the package is shipped with ``--py-files``).
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, tag: str, mode_options: dict | None = None) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and reread it.

    The written table cuts the lineage, survives lost executors and, unlike a checkpoint,
    keeps its size known to the planner.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{tag}-{uuid.uuid4().hex}"
    writer = df.write
    for key, value in (mode_options or {}).items():
        writer = writer.option(key, value)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no later job reads."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._staged_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def join_hot(left: DataFrame, right: DataFrame, key: str, total: int, how: str = "inner",
             hot_keys: int = 1 << 14, least: int = 1000) -> DataFrame:
    """Join with a table of one row per key whose column ``rows`` says how many rows of ``left`` have it.

    Keys of more than one in ``hot_keys`` of the ``total`` rows are joined by a broadcast (at most
    ``hot_keys`` rows), so that no task of the shuffled rest gets a hot key. ``how`` is inner, or left
    for keys that the table may lack."""
    limit = max(least, total // hot_keys)
    hot = F.broadcast(right.where(F.col("rows") > limit).drop("rows"))
    cold = right.where(F.col("rows") <= limit).drop("rows")
    some = left.join(hot, key)
    rest = left.join(F.broadcast(right.where(F.col("rows") > limit).select(key)), key, "left_anti")
    return some.unionByName(rest.join(cold, key, how))


def tasks_of(spark: SparkSession) -> int:
    """Shuffle width the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(batch: pa.RecordBatch, text_col: str, size: int = SLICE_BYTES
                ) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows of about ``size`` text bytes (one row at least)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[text_col]), 0)
                     .to_numpy(zero_copy_only=False)) if batch.num_rows else []
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts in a row, offsets of the texts); null reads as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    raw = column.buffers()[2]
    data = (np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None and n
            else np.zeros(0, np.uint8))
    return data, offsets - offsets[0] if n else np.zeros(1, np.int64)


def word_spans(data: np.ndarray, offsets: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) byte positions of the words of all texts and words-before count per text.

    The third array has one more entry than there are texts: text ``i`` owns words
    ``bounds[i]:bounds[i + 1]``.
    """
    n = len(data)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~SEPARATOR[data]
    cut = np.zeros(n + 2, bool)
    cut[offsets + 1] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | cut[1:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | cut[2:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those for usual pieces and slices are kept."""
    global _POW, _POW_INV
    if len(_POW) >= n:
        return _POW[:n], _POW_INV[:n]
    out = []
    for base in (_BASE, _INV):
        steps = np.full(PIECE_BYTES + 2 if n <= PIECE_BYTES + 2 else max(n, SLICE_BYTES + 2), base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    if n <= 2 * SLICE_BYTES:
        _POW, _POW_INV = out
    return out[0][:n], out[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, from one running polynomial sum over all bytes."""
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    spans = (total[ends] - total[starts]) * inverse[starts]
    return mix(spans ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(words: np.ndarray, bounds: np.ndarray, size: int
                  ) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every window of ``size`` words that lies inside one text."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + words[k:k + n])
    last_start = np.repeat(bounds[1:] - size, np.diff(bounds))
    first = np.flatnonzero(np.arange(n) <= last_start[:n])
    return out[first], first


def picked(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text); a text that is a field of a struct ``id`` stays there (see ``with_text``)."""
    key = F.col(f"`{id_col}`").alias("id")
    if text_col.startswith(f"{id_col}."):
        return df.select(key)
    return df.select(key, F.col(f"`{text_col}`").cast("string").alias("text"))


def with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with a column ``text``, taken out of the struct ``id`` where it lies there."""
    for batch in batches:
        if "text" not in batch.schema.names:
            text = pc.struct_field(batch["id"], "text").cast(pa.string())
            batch = pa.RecordBatch.from_arrays([batch["id"], text], names=["id", "text"])
        yield batch


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """Adds a struct that names each row's place in its file, which every later read of the
    same files gives again; a table that is not read from files is written first."""
    try:
        place = df.metadataColumn("_metadata")
        out = df.select("*", F.struct(place["file_path"].alias("file"), place["row_index"].alias("row")).alias(name))
        out.schema  # noqa: B018  resolves the columns
        return out
    except AnalysisException:
        return with_row_id(staged(df, "rows"), name)
