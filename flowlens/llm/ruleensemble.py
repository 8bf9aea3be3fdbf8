"""Operator 3, quality classifier by a sparse rule ensemble.

1. Statistics of whole texts (``STATISTICS``) are counted once, in tasks.
2. A forest is grown on the labelled rows; every path from a root to a node becomes a
   conjunction of bounds on statistics (a rule), equal rules count once.
3. Logistic weights of the rules are fitted with an L1 penalty, which leaves few of them.
4. The rules with a weight are compiled into one Spark column expression, the score.

``FIT_ROWS`` bounds the labelled rows of the fit: beyond it a share of them is taken by a
hash of the id. Everything else covers all rows.

Defined results: null text counts as empty (statistics 0) and is scored like any row;
labels other than 0 and 1 and null ids teach nothing; of several labels of one id the
more frequent one counts, 0 if equal; repeated documents are scored row by row; an empty
table gives no rows. Nothing to learn from: score 0.5; one class only: its label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm import common as C

FIT_ROWS = 200_000
TREES, DEPTH, LASSO = 10, 3, 0.002
#: Distinct words are counted per block, so that the share does not fall with the length.
BLOCK_WORDS = 100
STATISTICS = ["log_words", "mean_word", "longest_word", "symbols", "pipes", "digits", "upper", "shouted",
              "exclamations", "stops", "commas", "not_ascii", "short_words", "symbol_ends", "same_as_last",
              "distinct_words", "repeated_pairs", "repeat_lines", "blank"]

Rule = tuple[tuple[int, float, float], ...]   # (statistic, more than, at most), by statistic


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_ALPHA = _UPPER | _flags("abcdefghijklmnopqrstuvwxyz")
_SYMBOL = _flags("#*$%&|<>=~^_+@{}[]\\")


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Text x statistic; shares of letters, bytes, words or lines, 0 where there are none."""
    n = len(offsets) - 1

    def total(flags, edges=offsets):
        run = np.zeros(len(flags) + 1)
        np.cumsum(flags, out=run[1:])
        return np.diff(run[edges])

    def share(part, whole):
        return np.divide(part, whole, out=np.zeros(n), where=whole > 0)

    size = np.diff(offsets).astype(float)
    starts, ends, bounds = C.word_spans(data, offsets)
    words = np.diff(bounds).astype(float)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    length = (ends - starts).astype(float)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)
    of_word = lambda flags: total(flags, bounds)
    upper, alpha, symbol = _UPPER[data], _ALPHA[data], _SYMBOL[data]
    ups, alphas = np.concatenate([[0], np.cumsum(upper)]), np.concatenate([[0], np.cumsum(alpha)])
    n_up, n_alpha = ups[ends] - ups[starts], alphas[ends] - alphas[starts]

    hashes = C.span_hashes(data, starts, ends)
    same = np.zeros(len(starts), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    salt = C.mix(owner.astype(np.uint64) + np.uint64(7))
    block = (np.arange(len(starts)) - bounds[owner]) // BLOCK_WORDS   # words new in their block
    _, first = np.unique(hashes ^ salt ^ C.mix(block.astype(np.uint64) + np.uint64(1 << 40)), return_index=True)
    distinct = np.bincount(owner[first], minlength=n)
    pairs, at = C.window_hashes(hashes, bounds, 2)
    _, first = np.unique(pairs ^ salt[at], return_index=True)
    distinct_pairs = np.bincount(owner[at[first]], minlength=n)

    edges = np.union1d(np.flatnonzero(data == 0x0A) + 1, offsets)
    line_owner = np.searchsorted(offsets, edges[:-1], "right") - 1
    lines = C.span_hashes(data, edges[:-1], edges[1:]) ^ C.mix(line_owner.astype(np.uint64))
    _, first = np.unique(lines, return_index=True)
    n_lines = np.bincount(line_owner, minlength=n).astype(float)

    columns = [
        np.log1p(words), share(of_word(length), words), np.minimum(longest, 1000), share(total(symbol), size),
        share(total(data == ord("|")), size), share(total((data >= 0x30) & (data <= 0x39)), size),
        share(total(upper), total(alpha)), share(of_word((n_up >= 2) & (n_up == n_alpha)), words),
        share(total(data == ord("!")), words), share(total(data == ord(".")), words),
        share(total(data == ord(",")), words), share(total(data >= 0x80), size), share(of_word(length <= 3), words),
        share(of_word(_SYMBOL[data[ends - 1]] if len(ends) else ends), words), share(of_word(same), words),
        share(distinct, words), share(np.maximum(words - 1, 0) - distinct_pairs, words),
        share(n_lines - np.bincount(line_owner[first], minlength=n), n_lines), (words == 0).astype(float)]
    return np.stack(columns, axis=1)


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the statistics of every row as an array."""
    picked = C.picked(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.with_text(batches):
            for part in C.text_slices(batch, "text", C.PIECE_BYTES):
                x = text_statistics(*C.text_bytes(part["text"]))
                edges = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part["id"], pa.ListArray.from_arrays(pa.array(edges), pa.array(x.ravel()))], names=["id", "x"])

    schema = T.StructType([T.StructField("id", picked.schema["id"].dataType),
                           T.StructField("x", T.ArrayType(T.DoubleType()))])
    return picked.mapInArrow(run, schema)


def tree_paths(description: str) -> list[Rule]:
    """Rules of all paths in a forest's text form (indented If / Else lines)."""
    rules: dict[Rule, None] = {}
    stack: list[tuple[int, int, str, float]] = []
    for line in description.splitlines():
        found = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if not found:
            continue
        depth = len(found[1])
        while stack and stack[-1][0] >= depth:
            stack.pop()
        stack.append((depth, int(found[2]), found[3], float(found[4])))
        bounds: dict[int, tuple[float, float]] = {}
        for _, k, sign, at in stack:
            low, high = bounds.get(k, (-np.inf, np.inf))
            bounds[k] = (low, min(high, at)) if sign == "<=" else (max(low, at), high)
        rules[tuple((k, *bounds[k]) for k in sorted(bounds))] = None
    return list(rules)


def rule_column(rule: Rule, x: Column) -> Column:
    """The conjunction as a condition on the array of statistics."""
    out = F.lit(True)
    for k, low, high in rule:
        if np.isfinite(low):
            out = out & (x[k] > float(low))
        if np.isfinite(high):
            out = out & (x[k] <= float(high))
    return out


class Ensemble:
    """Weighted rules; ``score`` compiles them into a column."""

    def __init__(self, base: float, weighted: list[tuple[float, Rule]]):
        self.base, self.weighted = base, weighted

    @classmethod
    def fit(cls, rows: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO,
            seed: int = 11) -> Ensemble:
        """Of ``rows(x, label)``, label 0.0 or 1.0."""
        count = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
        if len(count) < 2:
            return cls({0.0: -np.inf, 1.0: np.inf}.get(next(iter(count), None), 0.0), [])
        data = rows.select(array_to_vector("x").alias("features"), "label")
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, seed=seed, cacheNodeIds=False,
                                        minInstancesPerNode=5).fit(data)
        rules = tree_paths(forest.toDebugString)
        if not rules:
            return cls(float(np.log(count[1.0] / count[0.0])), [])
        hits = F.array(*(rule_column(r, F.col("x")).cast("double") for r in rules))
        fitted = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60).fit(
            rows.select(array_to_vector(hits).alias("features"), "label"))
        weights = fitted.coefficients.toArray()
        return cls(float(fitted.intercept), [(float(w), r) for w, r in zip(weights, rules, strict=True) if w])

    def score(self, x: Column) -> Column:
        """Probability of label 1."""
        if not np.isfinite(self.base):
            return F.lit(1.0 if self.base > 0 else 0.0)
        z = F.lit(self.base)
        for w, rule in self.weighted:
            z = z + F.when(rule_column(rule, x), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that teaches nothing: crc32(id as text) mod 3 is 1 (a null id is not in it)."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 1, F.lit(False))


def learn(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Ensemble:
    """Ensemble of ``stats(doc_id, x)`` and ``labels(doc_id, quality)`` outside the held-out fold."""
    known = (labels.select("doc_id", "quality").where("doc_id is not null and quality in (0, 1)").where(~held_out())
             .groupBy("doc_id").agg((F.avg("quality") > 0.5).cast("double").alias("label")))
    rows = C.staged(stats.join(known, "doc_id").select("doc_id", "x", "label"), "labelled")
    n = rows.count()
    if n > fit_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * fit_rows / n)))
    return Ensemble.fit(rows.select("x", "label"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(row, score) of every document; ``row`` holds its columns.

    The statistics are counted twice, to learn and to score, so that no copy of the
    documents is written."""
    stats = C.staged(measure(docs), "stats").withColumnRenamed("id", "doc_id")
    model = learn(stats, labels)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return measure(rows, "row", "row.text").select(F.col("id").alias("row"), model.score(F.col("x")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: quality score of every document."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = C.staged(measure(docs), "stats").withColumnRenamed("id", "doc_id")
    model = learn(stats, C.table(spark, sf_dir, "labels"))
    score = model.score(F.col("x"))
    return stats.select("doc_id", held_out().alias("held_out"), score.alias("score"),
                        (score >= 0.5).cast("int").alias("predicted"))
