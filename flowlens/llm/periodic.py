"""Operator 13, periodic runs of words by internal pattern matching.

A run is a stretch of consecutive words with smallest period q (words q apart are equal),
at least ``max(LEAST, 3 * q)`` words long, that no neighbouring word extends.

* Windows of ``BLOCK`` words that occur once in their text take part in no run that a block
  could find; the others are ranked by prefix doubling, which gives for every dyadic length
  the class of equal windows and, in the end, their suffix order.
* Each run holds an aligned block of ``BLOCK * 2**j`` words whose next copy lies one period
  later, less than two block lengths away. So every aligned block asks for its occurrences
  in the neighbouring window: its class is an interval of the suffix order, and a wavelet
  tree over that order answers "the first position from x on within the interval".
* Three or more occurrences of a block in such a window are an arithmetic progression. Its
  step p is a period of the block; a run then matches the p-periodic stretch round the block
  with the one round the progression, so only the distance of their left ends and that of
  their right ends remain as candidate periods. One or two occurrences are candidates as such.
* Longest common extensions over the same ranks give each candidate's stretch; of stretches
  with equal ends the smallest period is the run's.

All texts of a slice are handled together by array steps; windows never cross a text.

Defined results: null text counts as empty (no words, no runs, empty collapsed text); a null
id plants nothing; repeated rows and ids are judged row by row; an empty table gives no
rows; columns other than the id and the text are not read. Words are compared by a 64-bit
hash of their bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm import common as C

LEAST, BLOCK = 24, 8
SLICE_BYTES = 8 << 20


class WaveletTree:
    """Order statistics of any interval of a permutation of 0..n-1 (all queries as arrays)."""

    def __init__(self, values: np.ndarray):
        self.size = len(values)
        self.bits = max(1, int(self.size - 1).bit_length()) if self.size else 1
        self.zeros, self.levels = [], []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            before = np.zeros(self.size + 1, np.int64)
            np.cumsum(~one, out=before[1:])
            self.levels.append(before)
            self.zeros.append(int(before[-1]))
            values = np.concatenate([values[~one], values[one]])

    def _step(self, k: int, left: np.ndarray, right: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        zl, zr = self.levels[k][left], self.levels[k][right]
        return (np.where(one, self.zeros[k] + left - zl, zl), np.where(one, self.zeros[k] + right - zr, zr))

    def below(self, left: np.ndarray, right: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of [left, right) are smaller than x (x up to n)."""
        out = np.where(x >= self.size, right - left, 0)
        x = np.minimum(x, self.size - 1)
        live = out == 0
        for k in range(self.bits):
            one = (x >> (self.bits - 1 - k) & 1).astype(bool)
            out += np.where(one & live, self.levels[k][right] - self.levels[k][left], 0)
            left, right = self._step(k, left, right, one)
        return out

    def smallest(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value of the given rank (from 0) in [left, right)."""
        out, rank = np.zeros(len(left), np.int64), rank.copy()
        for k in range(self.bits):
            low = self.levels[k][right] - self.levels[k][left]
            one = rank >= low
            rank -= np.where(one, low, 0)
            out = out << 1 | one
            left, right = self._step(k, left, right, one)
        return out

    def successor(self, left: np.ndarray, right: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The smallest value of [left, right) that is at least x; n where there is none."""
        rank = self.below(left, right, x)
        found = rank < right - left
        out = np.full(len(left), self.size, np.int64)
        out[found] = self.smallest(left[found], right[found], rank[found])
        return out


class Matcher:
    """Equality classes of dyadic windows, their suffix order, and extensions of equal words.

    ``words``: hashes of the words of several texts in a row, ``bounds`` their borders.
    """

    def __init__(self, words: np.ndarray, bounds: np.ndarray):
        self.words = words
        n = len(words)
        size = np.diff(bounds)
        self.first = np.repeat(bounds[:-1], size)     # of each word's text
        self.last = np.repeat(bounds[1:], size)
        window, at = C.window_hashes(words, bounds, BLOCK)
        window = window ^ C.mix(self.first[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(window, kind="stable")
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = window[order][1:] == window[order][:-1]
        again = order[same[1:] | same[:-1]]
        self.places = np.sort(at[again])              # windows that occur twice in their text
        m = len(self.places)
        self.ranks: list[np.ndarray] = []             # per level: class of each word's window
        self.class_size: list[np.ndarray] = []
        self.order = np.zeros(0, np.int64)
        if not m:
            return
        longest = int(size.max())
        number = np.empty(len(window), np.int64)
        number[order] = np.cumsum(~same[:-1])
        # the first level's numbers follow the windows' hashes: any fixed order will do
        code = np.zeros(n, np.int64)
        code[at] = number
        key = code[self.places]
        length = BLOCK
        while True:
            rank = np.arange(n, dtype=np.int64) + m   # a window found once, or none: a class of its own
            self.order = np.argsort(key, kind="stable")
            key = key[self.order]
            new = np.r_[True, key[1:] != key[:-1]]
            start = np.maximum.accumulate(np.where(new, np.arange(m), 0))
            rank[self.places[self.order]] = start
            self.ranks.append(rank)
            self.class_size.append(np.bincount(start, minlength=m))
            if 6 * length > longest or new.all():
                break
            follow = self.places + length
            inside = follow + length <= self.last[self.places]
            tail = np.where(inside, rank[np.minimum(follow, n - 1)], n + m + self.places)
            key = rank[self.places] * (2 * n + m + 1) + tail
            length *= 2
        self.tree = WaveletTree(self.order)           # values: numbers of places

    def next_copy(self, level: int, block: np.ndarray, from_word: np.ndarray) -> np.ndarray:
        """First occurrence of the level's window at ``block`` from a word on; n where none."""
        left = self.ranks[level][block]
        right = left + self.class_size[level][left]
        found = self.tree.successor(left, right, np.searchsorted(self.places, from_word))
        return np.where(found < len(self.places), self.places[np.minimum(found, len(self.places) - 1)],
                        len(self.words))

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a < b on are equal in pairs, within their text."""
        end, out = self.last[a], np.zeros(len(a), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            out = self._walk(out, level, level == len(self.ranks) - 1, b, a, end, 0)
        return self._words(out, a, b, end, 1)

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a < b are equal in pairs, within their text."""
        out = np.zeros(len(a), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            out = self._walk(out, level, level == len(self.ranks) - 1, b, a, self.first[a], BLOCK << level)
        return self._words(out, a, b, self.first[a], -1)

    def _walk(self, out, level, repeat, b, a, border, back):
        rank, length = self.ranks[level], BLOCK << level
        live = np.arange(len(a))
        while len(live):
            done = out[live]
            x, y = (a[live] + done, b[live] + done) if not back else (a[live] - done - length, b[live] - done - length)
            fits = y + length <= border[live] if not back else x >= border[live]
            live, x, y = live[fits], x[fits], y[fits]
            live = live[rank[x] == rank[y]]
            out[live] += length
            if not repeat:
                break
        return out

    def _words(self, out, a, b, border, sign):
        live = np.arange(len(a))
        for _ in range(BLOCK):
            done = out[live]
            x, y = (a[live] + done, b[live] + done) if sign > 0 else (a[live] - done - 1, b[live] - done - 1)
            fits = y < border[live] if sign > 0 else x >= border[live]
            live, x, y = live[fits], x[fits], y[fits]
            live = live[self.words[x] == self.words[y]]
            out[live] += 1
        return out


def _occurrences(match: Matcher, level: int, block: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, period) candidates from occurrences low..high words after each block."""
    none = len(match.words)
    found = []
    at = block + low
    for _ in range(3):
        at = match.next_copy(level, block, at)
        at = np.where(at <= block + high, at, none)
        found.append(at)
        at = at + 1
    one, two, three = found
    few = three == none
    out = [(block[few & (x < none)], (x - block)[few & (x < none)]) for x in (one, two)]
    many = ~few
    if many.any():
        here, there, step = block[many], one[many], (two - one)[many]
        ends = []
        for p in (here, there):
            ends.append((p - match.backward(p, p + step), p + step + match.forward(p, p + step)))
        out += [(here, ends[1][k] - ends[0][k]) for k in (0, 1)]
    return np.concatenate([x for x, _ in out]), np.concatenate([q for _, q in out])


def find_runs(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(start, end, period) of every run, by start, end (positions among all words given)."""
    match = Matcher(words, bounds)
    starts, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for level, rank in enumerate(match.ranks):
        length = BLOCK << level
        block = match.places[(match.places - match.first[match.places]) % length == 0]
        block = block[match.class_size[level][rank[block]] > 1]
        if level == 0:                 # short periods: every occurrence within the block
            at, live = block + 1, block
            for _ in range(BLOCK - 1):
                at = match.next_copy(0, live, at)
                near = at < live + BLOCK
                live, at = live[near], at[near]
                starts.append(live)
                periods.append(at - live)
                at = at + 1
        for x in (_occurrences(match, level, block, length, 2 * length - 1),):
            starts.append(x[0])
            periods.append(x[1])
    a, q = np.concatenate(starts), np.concatenate(periods)
    good = q > 0
    a, q = a[good], q[good]
    good = a + q < match.last[a] if len(a) else good[good]
    a, q = a[good], q[good]
    if not len(a):
        return np.zeros((0, 3), np.int64)
    left, right = a - match.backward(a, a + q), a + q + match.forward(a, a + q)
    long = right - left >= np.maximum(LEAST, 3 * q)
    runs = np.stack([left, right, q], axis=1)[long]
    runs = runs[np.lexsort(runs.T[::-1])]
    return runs[np.r_[True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1)]] if len(runs) else runs


def planted(doc_id: int | None, n: int) -> np.ndarray:
    """For each word of a text of n words, the number of the word that stands there."""
    at = np.arange(n)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[a:] = a + (at[a:] - a) % p
    return at


def _strongest(runs: np.ndarray) -> tuple[int, int, int, int]:
    """(start, length, period, exponent in thousandths) of the run of greatest length/period."""
    size, q = runs[:, 1] - runs[:, 0], runs[:, 2]
    power = size / q
    near = np.flatnonzero(power >= power.max() * (1 - 1e-9))
    best = min(near, key=lambda k: (-Fraction(int(size[k]), int(q[k])), int(runs[k, 0]), int(q[k])))
    return int(runs[best, 0]), int(size[best]), int(q[best]), 1000 * int(size[best]) // int(q[best])


RUN = T.ArrayType(T.StructType([T.StructField(k, T.LongType()) for k in ("start", "length", "period")]))
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("runs", RUN), T.StructField("start", T.LongType()),
          T.StructField("length", T.LongType()), T.StructField("period", T.LongType()),
          T.StructField("exponent_milli", T.LongType()), T.StructField("collapsed", T.StringType())]


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rewrite: Callable[[object, int], np.ndarray] | None = None, digest: bool = False) -> DataFrame:
    """One row per text: id, n_words, all runs by start and period, the strongest run's start,
    length, period and exponent, and the text without repetitions (each run's words after
    its first period dropped, kept words joined by one space).

    ``rewrite(id, n)`` gives the word numbers that a text of n words is read as. With
    ``digest``, ``runs`` and ``collapsed`` are replaced by ``n_runs`` and sha256 strings.
    """
    rows = C.picked(df, id_col, text_col)
    fields = [T.StructField("id", rows.schema["id"].dataType)] + FIELDS
    if digest:
        swap = {"runs": [T.StructField("n_runs", T.LongType()), T.StructField("runs_sha256", T.StringType())],
                "collapsed": [T.StructField("collapsed_sha256", T.StringType())]}
        fields = [g for f in fields for g in swap.get(f.name, [f])]

    def sha(text: bytes) -> str:
        return hashlib.sha256(text).hexdigest()

    def judged(part: pa.RecordBatch) -> pa.RecordBatch:
        ids = part["id"].to_pylist()
        data, offsets = C.text_bytes(part["text"])
        starts, ends, bounds = C.word_spans(data, offsets)
        words = C.span_hashes(data, starts, ends)
        place = np.arange(len(words))
        if rewrite is not None:
            for i, key in enumerate(ids):
                a, b = bounds[i], bounds[i + 1]
                place[a:b] = a + rewrite(key, int(b - a))
        runs = find_runs(words[place], bounds)
        dropped = np.zeros(len(words) + 1, np.int64)
        np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
        np.add.at(dropped, runs[:, 1], -1)
        kept = np.cumsum(dropped[:-1]) == 0
        per_text = np.searchsorted(runs[:, 0], bounds)
        out: dict[str, list] = {f.name: [] for f in fields}
        for i, key in enumerate(ids):
            a, b = int(bounds[i]), int(bounds[i + 1])
            mine = runs[per_text[i]:per_text[i + 1]].copy()
            mine[:, :2] -= a
            mine = mine[np.lexsort((mine[:, 2], mine[:, 0]))]
            listed = [(int(s), int(e - s), int(q)) for s, e, q in mine]
            best = _strongest(mine) if listed else (None,) * 4
            shown = [bytes(data[starts[k]:ends[k]]) for k in place[a:b][kept[a:b]]]
            text = b" ".join(shown)
            values = {"id": key, "n_words": b - a, "start": best[0], "length": best[1], "period": best[2],
                      "exponent_milli": best[3]}
            if digest:
                values |= {"n_runs": len(listed), "collapsed_sha256": sha(text),
                           "runs_sha256": sha("".join(f"{s},{n},{q}\n" for s, n, q in listed).encode())}
            else:
                values |= {"runs": [{"start": s, "length": n, "period": q} for s, n, q in listed],
                           "collapsed": text.decode("utf-8")}
            for name, column in out.items():
                column.append(values[name])
        kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string(),
                 RUN: pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))}
        return pa.RecordBatch.from_arrays(
            [part["id"]] + [pa.array(out[f.name], kinds[f.dataType]) for f in fields[1:]],
            names=[f.name for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.with_text(batches):
            for part in C.text_slices(batch, "text", SLICE_BYTES):
                yield judged(part)

    return rows.mapInArrow(run, T.StructType(fields))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: runs of every document, planted repetitions included."""
    out = periodic_runs(C.table(spark, sf_dir, "documents"), rewrite=planted, digest=True)
    return out.select(F.col("id").alias("doc_id"), "n_runs", "start", "length", "period", "exponent_milli",
                      "runs_sha256", "collapsed_sha256", "n_words")
