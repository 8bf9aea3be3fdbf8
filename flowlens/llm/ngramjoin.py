"""Operator 9, n-gram Jaccard join with rare-first prefix filtering.

A document's set are the 52-bit hashes of its distinct n-word shingles; equal sets form one
class, which is the node of everything below. Two classes link when their Jaccard
similarity reaches ``PERCENT``; the result are the connected components of the links.

1. *Rarity.* Shingle occurrences are dealt over buckets of the hash space in packed blocks;
   each bucket counts the classes of every shingle and sends back the shingles that at least
   two classes share. Shingles that take more than one part in ``HOT_SHARE`` of all
   occurrences are counted in the first pass, pre-added per task, and never dealt, so that
   no bucket holds a frequent shingle. A shared shingle's code is its rarity (12 bits,
   logarithmic from 2048 on) before its hash: codes sort rare-first, for all classes alike.
2. *Prefix.* Two linked classes share a shingle among the rarest ``n - ceil(t n) + 1`` of each.
   Shingles of one class only come first in that order and need no code.
3. *Candidates* meet on prefix shingles and pass the length filter and, at the shared shingle,
   the positional filter. Verification takes the suffix filter, then counts the
   intersection, once per pair.
4. *Groups of copies.* In each of ``HUB_ROUNDS`` rounds every prefix shingle compares its
   classes with one hub only, the class whose shingles are most widely shared; components
   are formed, and shingles whose classes all lie in one component are done. All pairs that
   are left, between different components, are then compared. No link between components
   can be missed; links inside a component are not all counted. Shingles of very many classes
   (at most ``HOT_CODES`` of them) get their hub by a broadcast, and their last pairs are dealt
   in slices of the classes.

Classes are named by 63 bits of a hash of the set; a second hash tells whether two different
sets ever got one name, and then all names are made anew with another salt.

Defined results: null, empty or wordless texts have an empty set and link with nothing (their
component is their own id); fewer words than n make one shingle; repeated rows are copies;
rows without an id take part, their id never names a component unless no other is there
(then null); an empty table gives no rows; only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm import common as C
from flowlens.llm.components import connected_components

WORDS, PERCENT = 4, 85
KEY_BITS, LOW_BITS = 52, 48
HOT_SHARE = 1 << 17
BUCKET_ROWS = 1 << 20
GROUP_BYTES = 4 << 20
HUB_ROUNDS = 2
SUFFIX_DEPTH = 2
#: Codes with more rows than one in HOT_CODES of all (SLICE_ROWS at least) are not shuffled to one task.
HOT_CODES, SLICE_ROWS = 1 << 14, 1000
#: Codes kept with a prefix shingle, for the last pairs, to tell whether a pair met before.
BEFORE = 32
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_KEY = np.uint64((1 << KEY_BITS) - 1)
_LOW = np.uint64((1 << LOW_BITS) - 1)


# ---------------------------------------------------------------- sets of shingles

def shingle_sets(part: pa.RecordBatch, size: int, salt: int = 0
                 ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys sorted within each text, edges per text, class per text, second hash of the set);
    class 0 for empty sets."""
    data, offsets = C.text_bytes(part["text"])
    data = _LOWER[data]
    starts, ends, bounds = C.word_spans(data, offsets)
    words = C.span_hashes(data, starts, ends)
    count = np.diff(bounds)
    owner = np.repeat(np.arange(len(count)), count)
    key, first = C.window_hashes(words, bounds, size)
    who = owner[first]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):                       # the whole sequence is one shingle
        whole = np.array([_sequence(words[bounds[i]:bounds[i + 1]]) for i in short], np.uint64)
        key, who = np.concatenate([key, whole]), np.concatenate([who, short])
    key = key >> np.uint64(64 - KEY_BITS)
    order = np.lexsort((key, who))
    key, who = key[order], who[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (who[1:] != who[:-1])
    key, who = key[new], who[new]
    edges = np.searchsorted(who, np.arange(len(count) + 1))
    one, two = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(C.mix(key ^ np.uint64(seed)))])
                for seed in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03))
    one, two = one[edges[1:]] - one[edges[:-1]], two[edges[1:]] - two[edges[:-1]]
    n = np.diff(edges).astype(np.uint64)
    name = C.mix(one ^ C.mix(two + n) ^ np.uint64(salt))
    check = C.mix(two ^ C.mix(one + n) + np.uint64(0x2545F4914F6CDD1D))
    return key, edges, np.where(n > 0, name | np.uint64(1), np.uint64(0)).view(np.int64), check.view(np.int64)


def _sequence(words: np.ndarray) -> int:
    out = np.full(1, len(words), np.uint64)
    for k in range(len(words)):
        out = C.mix(out * np.uint64(0x2545F4914F6CDD1D) + words[k:k + 1] + np.uint64(0x51ED27))
    return int(out[0])


def classes_of(df: DataFrame, size: int = WORDS, id_col: str = "doc_id", text_col: str = "text", salt: int = 0
               ) -> DataFrame:
    """(id, n, class, check) of every row, and (key, times) rows of shingles that are frequent in a slice."""
    picked = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.text_slices(batch, "text"):
                sets = [shingle_sets(piece, size, salt) for piece in C.text_slices(part, "text", C.PIECE_BYTES)]
                key, count, name, check = (np.concatenate(x) for x in zip(*(
                    (key, np.diff(edges), name, check) for key, edges, name, check in sets), strict=True))
                n = part.num_rows
                found, times = np.unique(key, return_counts=True)
                hot = times >= max(8, len(key) // HOT_SHARE)
                m = int(hot.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([part["id"], pa.nulls(m, part["id"].type)]),
                     pa.array(np.concatenate([count, np.full(m, -1)])),
                     pa.array(np.concatenate([name, np.zeros(m, np.int64)])),
                     pa.array(np.concatenate([np.zeros(n, np.int64), found[hot].astype(np.int64)])),
                     pa.array(np.concatenate([np.zeros(n, np.int64), times[hot]])),
                     pa.array(np.concatenate([check, np.zeros(m, np.int64)]))],
                    names=["id", "n", "class", "key", "times", "check"])

    return picked.mapInArrow(run, T.StructType([T.StructField("id", picked.schema["id"].dataType), *(
        T.StructField(c, T.LongType()) for c in ("n", "class", "key", "times", "check"))]))


def named_classes(df: DataFrame, size: int, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """``classes_of`` under the first salt that gives different sets different names, and that salt."""
    salt = 0
    while True:
        first = C.staged(classes_of(df, size, id_col, text_col, salt), "classes")
        clash = (first.where("n > 0").groupBy("class").agg(F.min("check").alias("low"), F.max("check").alias("high"))
                 .where("low <> high"))
        if clash.isEmpty():
            return first, salt
        C.discard(first)
        salt = salt * 0x5851F42D4C957F2D + 0x14057B7EF767814F & (1 << 64) - 1


# ---------------------------------------------------------------- packed blocks

BLOCK = "place int, names binary, sizes binary, totals binary, values binary"
_NAMES = ["place", "names", "sizes", "totals", "values"]


def _blocks(place: np.ndarray, name: np.ndarray, total: np.ndarray, value: np.ndarray, width: int) -> pa.RecordBatch:
    """One row per place: the classes there, how many values each has, the set sizes (0 where
    unknown) and the values, cut to ``width`` bytes. Rows must be sorted by (place, name)."""
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (name[1:] != name[:-1])
    run = np.flatnonzero(new)
    sizes = np.diff(np.append(run, len(place))).astype("<u4")
    first = np.flatnonzero(np.append(True, place[run][1:] != place[run][:-1])) if len(run) else run
    spot = place[run][first]
    first = np.append(first, len(run))
    at = np.append(run, len(place))
    raw = np.ascontiguousarray(value.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
    cols = [[], [], [], []]
    for a, b in zip(first, first[1:]):
        cols[0].append(name[run[a:b]].astype("<i8").tobytes())
        cols[1].append(sizes[a:b].tobytes())
        cols[2].append(total[run[a:b]].astype("<u4").tobytes())
        cols[3].append(raw[at[a]:at[b]].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(spot, pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], names=_NAMES)


def _unpacked(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, set size, value) of every value in some blocks."""
    names, sizes, totals, values = (b"".join(table[c].to_pylist()) for c in _NAMES[1:])
    sizes = np.frombuffer(sizes, "<u4")
    raw = np.zeros((len(values) // width, 8), np.uint8)
    raw[:, :width] = np.frombuffer(values, np.uint8).reshape(-1, width)
    return (np.repeat(np.frombuffer(names, "<i8"), sizes), np.repeat(np.frombuffer(totals, "<u4"), sizes),
            raw.view("<u8").ravel())


def _code(key: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Rarity before hash."""
    times = times.astype(np.float64)
    rare = np.where(times < 2048, times, 2048 + np.minimum(2047, np.floor(64 * np.log2(np.maximum(times, 2048) / 2048))))
    return (rare.astype(np.uint64) << np.uint64(KEY_BITS)) | key


def shared_codes(df: DataFrame, hot: dict[str, np.ndarray], buckets: int, size: int = WORDS,
                 id_col: str = "doc_id", text_col: str = "text", salt: int = 0) -> DataFrame:
    """(class, n, codes): every class's codes of shingles that other classes have too, ascending
    (8 bytes each); classes without any may be missing."""
    picked = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    hot_key, hot_times = hot["key"], hot["times"]
    span = -(-(1 << KEY_BITS) // buckets)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in C.text_slices(batch, "text", GROUP_BYTES):
                keys, names, totals = [], [], []
                for piece in C.text_slices(part, "text", C.PIECE_BYTES):
                    key, edges, name, _ = shingle_sets(piece, size, salt)
                    fresh = np.zeros(len(name), bool)
                    for i in np.flatnonzero(name):        # a class once per task
                        if int(name[i]) not in seen:
                            seen.add(int(name[i]))
                            fresh[i] = True
                    n = np.diff(edges)
                    mine = np.repeat(fresh, n)
                    keys.append(key[mine])
                    names.append(np.repeat(name[fresh], n[fresh]))
                    totals.append(np.repeat(n[fresh], n[fresh]))
                key, name, total = map(np.concatenate, (keys, names, totals))
                if not len(key):
                    continue
                at = np.minimum(np.searchsorted(hot_key, key), max(len(hot_key) - 1, 0))
                known = hot_key[at] == key if len(hot_key) else np.zeros(len(key), bool)
                # frequent shingles go straight to the class; a class without any sends its size
                first = np.ones(len(key), bool)
                first[1:] = name[1:] != name[:-1]
                direct = known | first
                code = np.where(known[direct], _code(key[direct], hot_times[at[direct]] if len(hot_key)
                                                     else np.ones(int(direct.sum()))), np.uint64(0))
                place = _home(name[direct], buckets)
                order = np.lexsort((name[direct], place))
                yield _blocks(-1 - place[order], name[direct][order], total[direct][order], code[order], 8)
                key, name, total = key[~known], name[~known], total[~known]
                place = (key // np.uint64(span)).astype(np.int64)
                order = np.argsort(place, kind="stable")          # classes stay together
                if len(order):
                    yield _blocks(place[order], name[order], total[order], key[order] & _LOW, LOW_BITS // 8)

    def count(where: tuple, table: pa.Table) -> pa.Table:
        place = where[0].as_py()
        if place < 0:                                             # already codes
            return table.select(_NAMES)
        name, total, low = _unpacked(table, LOW_BITS // 8)
        base = np.uint64(place * span)
        key = base + ((low - base) & _LOW)
        order = np.lexsort((name, key))
        key, name, total = key[order], name[order], total[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
        key, name, total = key[new], name[new], total[new]
        run = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.append(run, len(key)))
        times = np.repeat(times, times)
        many = times > 1
        code, name, total = _code(key[many], times[many]), name[many], total[many]
        home = _home(name, buckets)
        order = np.lexsort((name, home))
        return pa.Table.from_batches([_blocks(-1 - home[order], name[order], total[order], code[order], 8)])

    def gather(table: pa.Table) -> pa.Table:
        name, total, code = _unpacked(table, 8)
        order = np.lexsort((code, name))
        name, total, code = name[order], total[order], code[order]
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (name[1:] != name[:-1])
        new &= code > 0
        name, total, code = name[new], total[new], code[new]
        run = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.zeros(0, np.int64)
        edge = np.append(run, len(name))
        raw = code.astype("<u8")
        return pa.table({"class": pa.array(name[run]), "n": pa.array(total[run].astype(np.int64)),
                         "codes": pa.array([raw[a:b].tobytes() for a, b in zip(edge, edge[1:])], pa.binary())})

    dealt = picked.mapInArrow(deal, BLOCK)
    codes = dealt.where("place >= 0").groupBy("place").applyInArrow(lambda k, t: count(k, t), BLOCK)
    direct = dealt.where("place < 0")
    return (codes.unionAll(direct).groupBy("place").applyInArrow(gather, "class long, n long, codes binary"))


def _home(name: np.ndarray, buckets: int) -> np.ndarray:
    return (C.mix(name.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


# ---------------------------------------------------------------- candidates and verification

def least_overlap(a, b, percent: int):
    """Smallest intersection of linked sets of these sizes: ceil(t (a + b) / (1 + t))."""
    return F.ceil((a + b) * percent / F.lit(100.0 + percent) - F.lit(1e-9))


def earlier_codes(records: DataFrame, percent: int) -> DataFrame:
    """(code, class, before): with every coded prefix shingle the codes before it, the first
    ``BEFORE`` of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n, raw in zip(*(batch[c].to_pylist() for c in ("class", "n", "codes")), strict=True):
                code = np.frombuffer(raw, "<u8").view(np.int64)
                take = min(n - (n * percent + 99) // 100 + 1 - (n - len(code)), len(code))
                if take > 0:
                    some = np.minimum(np.arange(take), BEFORE)
                    at = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(some)], pa.int32()), pa.array(code[at]))
                    yield pa.RecordBatch.from_arrays([pa.array(code[:take]), pa.array(np.full(take, name)), lists],
                                                     names=["code", "class", "before"])

    return records.mapInArrow(run, "code long, class long, before array<bigint>")


def postings(records: DataFrame, percent: int) -> DataFrame:
    """(code, class, n, alone, pos, shared): the coded prefix shingles of every class;
    ``alone`` is its number of shingles without a code, ``pos`` counts from 0 in the rare-first
    order of the whole set and ``shared`` is the mean rarity of the set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for name, n, raw in zip(*(batch[c].to_pylist() for c in ("class", "n", "codes")), strict=True):
                code = np.frombuffer(raw, "<u8")
                alone = n - len(code)
                take = n - (n * percent + 99) // 100 + 1 - alone
                if take <= 0:
                    continue
                take = min(take, len(code))
                mean = (float((code >> np.uint64(KEY_BITS)).sum()) + alone) / n
                for col, v in zip(out, (code[:take].view(np.int64), np.full(take, name), np.full(take, n),
                                        np.full(take, alone), np.arange(alone, alone + take), np.full(take, mean)), strict=True):
                    col.append(v)
            cols = [np.concatenate(c) if c else np.zeros(0) for c in out]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                cols, [pa.int64()] * 5 + [pa.float64()], strict=True)],
                names=["code", "class", "n", "alone", "pos", "shared"])

    return records.mapInArrow(run, "code long, class long, n long, alone long, pos long, shared double")


def overlap_bound(x: np.ndarray, y: np.ndarray, depth: int = SUFFIX_DEPTH) -> int:
    """Upper bound of the intersection of two ascending arrays (suffix filter): split at the
    middle of one, the parts cannot share more than the smaller of them."""
    if depth == 0 or not len(x) or not len(y):
        return min(len(x), len(y))
    mid = len(y) // 2
    at = int(np.searchsorted(x, y[mid]))
    return overlap_bound(x[:at], y[:mid], depth - 1) + overlap_bound(x[at:], y[mid:], depth - 1)


def verified(pairs: DataFrame, records: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the candidate ``pairs(u, v)`` that link."""
    side = lambda c: records.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col("codes").alias(f"codes_{c}"))
    both = pairs.select("u", "v").join(side("u"), "u").join(side("v"), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (nu, nv, cu, cv) in enumerate(zip(*(batch[c].to_pylist() for c in (
                    "n_u", "n_v", "codes_u", "codes_v")), strict=True)):
                x, y = np.frombuffer(cu, "<u8"), np.frombuffer(cv, "<u8")
                need = -(-percent * (nu + nv) // (100 + percent))
                if overlap_bound(x, y) >= need:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = 100 * both >= percent * (nu + nv - both)
            out = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([out["u"], out["v"]], names=["u", "v"])

    return both.mapInArrow(run, "u long, v long")


def _may_link(a: str, b: str, percent: int, first: bool = False) -> Column:
    """Length filter, and positional filter at the shared code: what is left from it on in the
    shorter rest, and the coded shingles before it in both, bound the intersection. A linked
    pair passes at its first shared code, whatever the others say.

    With ``first``, rows have ``before``: a pair that shares an earlier code within both lists is
    left to that code, and where the lists reach back all the way nothing before is shared."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    left = F.least(n - F.col(f"{a}.pos"), m - F.col(f"{b}.pos"))
    coded = [F.col(f"{x}.pos") - F.col(f"{x}.alone") for x in (a, b)]
    before = F.least(*coded)
    if first:
        before = F.when(F.greatest(*coded) <= BEFORE, 0).otherwise(before)
    fits = ((F.col(f"{a}.part") != F.col(f"{b}.part")) & (100 * n >= percent * m) & (100 * m >= percent * n)
            & (before + left >= least_overlap(n, m, percent)))
    return fits & ~F.arrays_overlap(F.col(f"{a}.before"), F.col(f"{b}.before")) if first else fits


def _pairs(rows: DataFrame) -> DataFrame:
    u, v = F.col("a.class"), F.col("b.class")
    return rows.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()


def linked_components(records: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, root) of all classes that link with another one."""
    entry = ["class", "n", "alone", "pos", "shared"]
    lists = C.staged(postings(records, percent), "postings")
    total = lists.count()
    links, done, parts = None, None, None
    for turn in range(HUB_ROUNDS + 1):
        named = (lists.withColumn("part", F.col("class")) if parts is None else
                 lists.join(parts.withColumnRenamed("node", "class"), "class", "left")
                 .withColumn("part", F.coalesce("root", "class")).drop("root"))
        named = C.staged(named.select("code", F.struct(*entry, "part").alias("a")), "lists")
        hubs = named.groupBy("code").agg(
            F.max(F.struct("a.shared", "a.class", "a.n", "a.alone", "a.pos", "a.part")).alias("b"),
            F.min("a.part").alias("low"), F.max("a.part").alias("high"), F.count("*").alias("rows")).where("low <> high")
        hubs = C.staged(hubs.select("code", "b", "rows"), "hubs")
        sliced = hubs.withColumn("slices", F.ceil(F.col("rows") / SLICE_ROWS).cast("int"))
        met = C.join_hot(named, sliced, "code", total, hot_keys=HOT_CODES, least=SLICE_ROWS)
        if turn < HUB_ROUNDS:
            met = C.staged(met.where("a.class <> b.class"), "met")
            pairs = _pairs(met.where(_may_link("a", "b", percent)))
        else:
            met = met.select("code", "slices", "a", F.col("a.class").alias("class"))
            back = earlier_codes(records.join(met.select("class").distinct(), "class", "left_semi"), percent)
            met = C.staged(met.join(back, ["code", "class"]).select(
                "code", "slices", F.struct("a.*", "before").alias("a")), "met")
            left = met.select("code", "a", F.pmod(F.xxhash64("a.class"), "slices").cast("int").alias("slice"))
            right = met.select("code", F.col("a").alias("b"),
                               F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
            pairs = _pairs(left.join(right, ["code", "slice"]).where("a.class > b.class")
                           .where(_may_link("a", "b", percent, first=True)))
        if done is not None:
            pairs = pairs.join(done, ["u", "v"], "left_anti")
        pairs = C.staged(pairs, "pairs")
        found = C.staged(verified(pairs, records, percent), "links")
        links = found if links is None else links.unionAll(found)
        done = pairs if done is None else done.unionAll(pairs)
        parts = C.staged(connected_components(links), "parts")
        C.discard(named, hubs, lists)
        if turn < HUB_ROUNDS:
            lists = C.staged(met.select("code", "a.*").drop("part"), "lists")
        C.discard(met)
    return parts


def components(df: DataFrame, size: int = WORDS, percent: int = PERCENT,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, class, root) of every row: ``root`` names the component (null for empty sets)."""
    spark = df.sparkSession
    first, salt = named_classes(df, size, id_col, text_col)
    docs = first.where("n >= 0").select("id", "n", "class")
    total = docs.agg(F.sum("n")).first()[0] or 0
    hot = (first.where("n < 0").groupBy("key").agg(F.sum("times").alias("times"))
           .where(F.col("times") > total / HOT_SHARE).toPandas().sort_values("key"))   # HOT_SHARE keys at most
    hot = {"key": hot["key"].to_numpy(np.int64).astype(np.uint64), "times": hot["times"].to_numpy(np.int64)}
    buckets = max(1 << (KEY_BITS - LOW_BITS), C.tasks_of(spark), -(-total // BUCKET_ROWS))
    records = C.staged(shared_codes(df, hot, buckets, size, id_col, text_col, salt), "records")
    parts = linked_components(records, percent)
    return (docs.join(parts.select(F.col("node").alias("class"), "root"), "class", "left")
            .select("id", F.col("n").alias("n_shingles"), "class",
                    F.when(F.col("n") > 0, F.coalesce("root", "class")).alias("root")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: set size and smallest reachable doc_id of every document."""
    rows = C.staged(components(C.table(spark, sf_dir, "documents")), "joined")
    least = C.staged(rows.where("root is not null").groupBy("root").agg(F.min("id").alias("least"), F.count("*").alias("rows")),
                     "least")
    return C.join_hot(rows, least, "root", rows.count(), "left").select(
        F.col("id").alias("doc_id"), "n_shingles",
        F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))
