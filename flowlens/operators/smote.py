"""SMOTE oversampling (R5) on Spark, with exact same-class nearest neighbours.

The k nearest other rows of the same class (Euclidean) are found by pivot tiles, without a
class-wide self join:

1. identical points of a class collapse to one distinct point with a multiplicity, so a
   value repeated by a third of all rows is a single row from here on;
2. tiles: about sqrt(n) points of each class, drawn by hash, are its pivots (``PIVOT_BYTES``
   bounds all of them); a point belongs to the tile of its nearest pivot. A tile of more
   than ``TILE_ROWS`` points is cut into rings by the distance to the pivot, a ring whose
   distances are all alike into blocks by a hash;
3. own ring: each seed meets the points of its ring; their k-th distance, or a bound out of
   the tiles' sizes and radii, is the seed's radius r;
4. other rings: a tile or ring is visited only if the triangle inequality leaves room for a
   point within r: no point nearer than |d(seed, pivot) - ring|, none across the plane half
   way to another pivot. (class, tile, ring) is the join key; a pair of blocks is one task's
   group of bounded size;
5. groups: where that leaves much of a class open (many dimensions), rings of neighbouring tiles
   are visited together, so that a seed is sent to a few groups and not to each of its tiles. A
   group has a quarter of the points that a seed of the class has to visit, at most a block.

Only rows of classes that need new rows are read, and only points that are copied are seeds.
Rows without a label, and rows whose vector is null, of another length than most, or holds a
null or non-finite component, take no part in the search (SMOTE keeps them as they are).

Synthetic row = a + u * (b - a), with b drawn from the k neighbour rows and u and the draw
from ``xxhash64`` (deterministic). A row without neighbours repeats itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.joins import join_small, materialize_small
from flowlens.operators.windows import hash_rank
from flowlens.session import cut_lineage

SEED = 42
TILE_ROWS = 2000      # points of one ring; blocks of points or seeds that meet have at most BLOCK times as many
BLOCK = 4
PIVOT_BYTES = 32 << 20  # all pivots together (they are broadcast)
BINS = 1024           # steps of a tile's distance histogram, cut into rings
MAX_CLASSES = 10_000
CELLS = 1 << 22       # entries of one distance matrix within a task
RING = ["__c", "__tile", "__ring"]
ENTRIES = "array<struct<cum_end:bigint,d:double,q:bigint,arr:array<double>>>"


def _u(*parts) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(SEED), *parts), F.lit(1 << 53)).cast("double") / float(1 << 53)


def distinct_points(df: DataFrame, key: str, label: str, array_col: str) -> DataFrame:
    """(label, __arr, __pid = smallest key, __m = rows) per distinct point of a class that
    can take part."""
    base = df.select(key, label, F.col(array_col).cast("array<double>").alias("__arr")).where(
        F.col(label).isNotNull() & F.col("__arr").isNotNull())
    base = base.where(F.forall("__arr", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))
    width = base.groupBy(F.size("__arr").alias("w")).count().orderBy(F.desc("count"), "w").first()
    return (base.where(F.size("__arr") == (width.w if width else 0)).groupBy(label, "__arr")
            .agg(F.min(key).alias("__pid"), F.count(F.lit(1)).alias("__m")))


def _matrix(column: pa.Array) -> np.ndarray:
    """Equally long Arrow lists as one matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of the rows of x and y, up to ``_room``."""
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ y.T + (y * y).sum(axis=1), 0))


def _room(x: np.ndarray, y: np.ndarray) -> float:
    """More than the rounding error of ``_distances``."""
    return 1e-6 * float(np.sqrt((x * x).sum(axis=1).max()) + np.sqrt((y * y).sum(axis=1).max()) + 1e-300)


def choose_pivots(pts: DataFrame, sizes: dict[int, int], dim: int) -> dict[int, np.ndarray]:
    """About sqrt(n) points of each class by hash, at most ``PIVOT_BYTES`` in all."""
    want = {c: math.ceil(math.sqrt(n)) for c, n in sizes.items()}
    most = max(1, PIVOT_BYTES // (8 * max(1, dim)))
    if sum(want.values()) > most:
        scale = most / sum(want.values())
        want = {c: max(1, int(w * scale)) for c, w in want.items()}
    spark = pts.sparkSession
    shares = spark.createDataFrame([(c, min(1.0, (2 * want[c] + 32) / n)) for c, n in sizes.items()],
                                   "__c int, share double")
    drawn = pts.withColumn("h", _u(F.col("__pid"))).join(F.broadcast(shares), "__c").where("h < share")
    found = drawn.select("__c", "h", "__pid", "__arr").toArrow().sort_by(
        [("__c", "ascending"), ("h", "ascending"), ("__pid", "ascending")])
    cls = found["__c"].to_numpy()
    return {c: _matrix(found["__arr"].slice(int(np.searchsorted(cls, c)), min(n, int((cls == c).sum()))))
            for c, n in want.items()}


def tiles(pts: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds ``__tile`` (nearest pivot of the class) and ``__dp`` (the distance to it)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls = batch["__c"].to_numpy()
            tile, dp = np.zeros(len(cls), np.int32), np.zeros(len(cls))
            x = _matrix(batch["__arr"]) if len(cls) else None
            for c in np.unique(cls):
                mine, p = np.flatnonzero(cls == c), pivots[int(c)]
                for part in np.array_split(mine, 1 + len(mine) * len(p) // CELLS):
                    d = _distances(x[part], p)
                    tile[part] = d.argmin(axis=1)
                    dp[part] = d[np.arange(len(part)), tile[part]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tile), pa.array(dp)],
                                             names=[*batch.schema.names, "__tile", "__dp"])
    cols = ["__c", "__pid", "__m", "__arr"]
    return pts.select(*cols).mapInArrow(
        run, "__c int, __pid long, __m long, __arr array<double>, __tile int, __dp double")


def rings(index: DataFrame) -> DataFrame:
    """Adds ``__ring``: tiles of more than ``TILE_ROWS`` points are cut by the distance to their
    pivot, from a histogram of at most ``BINS`` steps a tile."""
    span = index.groupBy("__c", "__tile").agg(F.count("*").alias("n"), F.min("__dp").alias("lo"),
                                              F.max("__dp").alias("hi")).where(F.col("n") > TILE_ROWS)
    step = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(BINS - 1), F.floor(
        (F.col("__dp") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS))).otherwise(F.lit(0)).cast("int")
    large = join_small(index, span.select("__c", "__tile", "lo", "hi"), ["__c", "__tile"], "left")
    large = large.withColumn("__bin", F.when(F.col("hi").isNull(), 0).otherwise(step)).drop("lo", "hi")
    counts = large.groupBy("__c", "__tile", "__bin").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("__c", "__tile").orderBy("__bin").rowsBetween(
        Window.unboundedPreceding, 0)) - F.col("n")
    cut = counts.select("__c", "__tile", "__bin", F.floor(before / TILE_ROWS).cast("int").alias("__ring"))
    return large.join(cut, ["__c", "__tile", "__bin"]).drop("__bin")


def pivot_order(pivots: np.ndarray) -> np.ndarray:
    """Places of the pivots in an order that keeps near ones together: halved again and again at the median
    of the coordinate with the widest spread."""
    out, todo = [], [np.arange(len(pivots))]
    while todo:
        mine = todo.pop()
        if len(mine) <= 2:
            out += mine.tolist()
            continue
        x = pivots[mine]
        order = mine[x[:, np.ptp(x, axis=0).argmax()].argsort(kind="stable")]
        todo += [order[len(order) // 2:], order[:len(order) // 2]]
    return np.array(out).argsort()


def ring_groups(spread: DataFrame, pivots: dict[int, np.ndarray], visited: dict[int, float]) -> DataFrame:
    """(ring key, group): rings in the order of their pivots, together as far as a group has at most a quarter
    of the points ``visited`` by a seed of the class."""
    rows = [(c, t, int(place), max(1.0, min(BLOCK * TILE_ROWS, visited.get(c, 0.0) / 4)))
            for c, p in pivots.items() for t, place in enumerate(pivot_order(p))]       # one row per pivot
    places = spread.sparkSession.createDataFrame(rows, "__c int, __tile int, place int, most double")
    so_far = Window.partitionBy("__c").orderBy("place", "__ring").rowsBetween(Window.unboundedPreceding, 0)
    start = F.floor((F.sum("n").over(so_far) - F.col("n")) / F.col("most")).cast("int")
    return spread.join(F.broadcast(places), ["__c", "__tile"]).select(*RING, start.alias("group"))


def nearest_in_rings(ask: DataFrame, index: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """(p, q, q_m, d): the ``k`` nearest other points of each seed in each (ring, block) it asks.

    ``ask``: (__pid, __arr, ring key), ``sizes``: (ring key, blocks). Points are dealt over
    their ring's blocks, seeds over blocks of ``BLOCK`` x ``TILE_ROWS``."""
    asked = ask.groupBy(*RING).agg(F.ceil(F.count("*") / (BLOCK * TILE_ROWS)).cast("int").alias("seed_blocks"))
    sizes = cut_lineage(sizes.select(*RING, "blocks").join(asked, RING))
    slot = F.xxhash64(F.lit(SEED), "__pid")
    names = [f"seed{c}" for c in RING]   # the seeds are rows of the index: names of their own
    left = ask.join(sizes, RING).select(
        F.col("__pid").alias("p"), F.col("__arr").alias("v"), *(F.col(c).alias(n) for c, n in zip(RING, names, strict=True)),
        F.pmod(slot, "seed_blocks").cast("int").alias("seed_block"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = index.join(sizes, RING).select(
        "__pid", "__m", "__arr", *RING, F.pmod(slot, "blocks").cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("seed_blocks") - 1)).alias("seed_block"))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        p, q = a["p"].to_numpy(), b["__pid"].to_numpy()
        r = c = np.zeros(0, np.int64)
        d = np.zeros(0)
        if len(p) and len(q):
            x, y = _matrix(a["v"]), _matrix(b["__arr"])
            room, found = 2 * _room(x, y), []
            for part in np.array_split(np.arange(len(p)), 1 + len(p) * len(q) // CELLS):
                far = np.where(q[None, :] == p[part][:, None], np.inf, _distances(x[part], y))
                kth = np.partition(far, k - 1, axis=1)[:, k - 1:k] if len(q) > k else np.inf
                rr, cc = np.nonzero((far <= kth + room) & (far < np.inf))
                found.append((part[rr], cc))
            r, c = (np.concatenate(z) for z in zip(*found, strict=True))
            d = np.sqrt(((x[r] - y[c]) ** 2).sum(axis=1))
            order = np.lexsort((q[c], d, r))
            r, c, d = r[order], c[order], d[order]
            first = np.arange(len(r)) - np.searchsorted(r, r) < k
            r, c, d = r[first], c[first], d[first]
        return pa.table({"p": pa.array(p[r], pa.int64()), "q": pa.array(q[c], pa.int64()),
                         "q_m": pa.array(b["__m"].to_numpy()[c], pa.int64()), "d": pa.array(d, pa.float64())})

    pair = ["block", "seed_block"]
    return left.groupBy(*names, *pair).cogroup(right.groupBy(*RING, *pair)).applyInArrow(
        compare, "p long, q long, q_m long, d double")


def open_tiles(seeds: DataFrame, pivots: dict[int, np.ndarray], spans: dict[int, tuple], k: int) -> DataFrame:
    """(__c, __pid, own, own_ring, r, __tile, dt) of every tile that may hold a point within the
    seed's radius; ``spans``: class -> (smallest, largest distance, rows) of its tiles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, own = batch["__c"].to_numpy(), batch["__tile"].to_numpy()
            m, dp = batch["__m"].to_numpy(), batch["__dp"].to_numpy()
            known = batch["r"].to_numpy(zero_copy_only=False)
            x = _matrix(batch["__arr"]) if len(cls) else None
            for c in np.unique(cls):
                mine, p = np.flatnonzero(cls == c), pivots[int(c)]
                lo, hi, rows = spans[int(c)]
                for part in np.array_split(mine, 1 + len(mine) * len(p) // CELLS):
                    if not len(part):
                        continue
                    room, d = _room(x[part], p), _distances(x[part], p)
                    reach = d + hi                       # every point of the tile is within
                    order = reach.argsort(axis=1)
                    held = np.broadcast_to(rows, d.shape).copy()
                    held[np.arange(len(part)), own[part]] -= m[part]
                    enough = np.take_along_axis(held, order, 1).cumsum(axis=1) >= (k + 1 - m[part])[:, None]
                    at = enough.argmax(axis=1)
                    bound = np.where(enough.any(axis=1), np.take_along_axis(
                        reach, np.take_along_axis(order, at[:, None], 1), 1)[:, 0], np.inf)
                    r = np.fmin(known[part].astype(float), bound) + 4 * room
                    gap = _distances(p[own[part]], p)    # the plane half way to the other pivot
                    with np.errstate(divide="ignore", invalid="ignore"):
                        plane = np.where(gap > 4 * room, (d * d - (dp[part] ** 2)[:, None]) / (2 * gap), 0)
                    slack = room * (1 + (d + dp[part][:, None]) / np.maximum(gap, 1e-300))
                    keep = ((rows > 0) & (d - hi <= r[:, None]) & (lo - d <= r[:, None])
                            & (plane - slack <= r[:, None]))
                    s, t = np.nonzero(keep)
                    rows_of = pa.array(part[s])
                    yield pa.RecordBatch.from_arrays(
                        [batch["__c"].take(rows_of), batch["__pid"].take(rows_of),
                         pa.array(own[part][s]), batch["__ring"].take(rows_of), pa.array(r[s]),
                         pa.array(t.astype(np.int32)), pa.array(d[s, t])],
                        names=["__c", "__pid", "own", "own_ring", "r", "__tile", "dt"])
    return seeds.select("__c", "__pid", "__m", "__arr", "__tile", "__ring", "__dp", "r").mapInArrow(
        run, "__c int, __pid long, own int, own_ring int, r double, __tile int, dt double")


def same_class_neighbours(df: DataFrame, key: str, label: str, array_col: str, k: int = 5,
                          seeds: DataFrame | None = None) -> DataFrame:
    """(label, __arr, __total, nbrs) per distinct point: ``nbrs`` = the k nearest other
    rows of its class as array<struct<cum_end, d, q, arr>> (own copies first at distance 0,
    then by (distance, point key); ``cum_end`` = rows up to and including the entry),
    ``__total`` = min(k, other rows of the class). ``seeds(label, array_col)``: only these
    points are answered (all others are still neighbours)."""
    pts = cut_lineage(distinct_points(df, key, label, array_col))
    classes = materialize_small(pts.groupBy(label).agg(F.count("*").alias("__n"),
                                                       F.first(F.size("__arr")).alias("__w")), MAX_CLASSES)
    found = classes.toArrow().to_pylist()
    numbered = df.sparkSession.createDataFrame(
        [(r[label], i) for i, r in enumerate(found)], f"`{label}` {pts.schema[label].dataType.simpleString()}, __c int")
    pts = pts.join(F.broadcast(numbered), label)     # at most MAX_CLASSES rows
    if seeds is None:
        wanted = pts
    else:
        points = seeds.select(label, F.col(array_col).cast("array<double>").alias("__arr")).distinct()
        wanted = pts.join(points, [label, "__arr"], "left_semi")
    if not found:
        return wanted.select(label, "__arr", F.lit(0).cast("long").alias("__total"),
                             F.array().cast(ENTRIES).alias("nbrs"))
    pivots = choose_pivots(pts, {i: r["__n"] for i, r in enumerate(found)}, found[0]["__w"])
    index = cut_lineage(rings(tiles(pts, pivots)))
    spread = index.groupBy(*RING).agg(F.count("*").alias("n"), F.sum("__m").alias("rows"),
                                      F.min("__dp").alias("lo"), F.max("__dp").alias("hi"))
    spread = cut_lineage(spread.withColumn("blocks", F.ceil(F.col("n") / (BLOCK * TILE_ROWS)).cast("int")))
    spans = {c: (np.full(len(p), np.inf), np.full(len(p), -np.inf), np.zeros(len(p), np.int64))
             for c, p in pivots.items()}
    for r in spread.groupBy("__c", "__tile").agg(      # one row per pivot
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("rows").alias("rows")).toArrow().to_pylist():
        for part, value in zip(spans[r["__c"]], (r["lo"], r["hi"], r["rows"]), strict=True):
            part[r["__tile"]] = value

    searching = index.where(F.col("__m") <= k)
    if seeds is not None:
        searching = searching.join(wanted.select("__pid"), "__pid", "left_semi")
    near = cut_lineage(nearest_in_rings(searching.select("__pid", "__arr", *RING), index, spread, k))
    own = searching.select("__pid", "__m")
    so_far = Window.partitionBy("p").orderBy("d", "q").rowsBetween(Window.unboundedPreceding, 0)
    radius = near.join(own, near["p"] == own["__pid"]).withColumn("rows", F.sum("q_m").over(so_far) + F.col("__m") - 1) \
        .groupBy("p").agg(F.min(F.when(F.col("rows") >= k, F.col("d"))).alias("r"))
    asking = cut_lineage(searching.join(radius, searching["__pid"] == radius["p"], "left").drop("p"))

    def opened(of_rings: DataFrame) -> DataFrame:
        """The rings, with the columns of ``of_rings``, that each seed has to visit besides its own."""
        return join_small(open_tiles(asking, pivots, spans, k), of_rings, ["__c", "__tile"]).where(
            ~((F.col("__tile") == F.col("own")) & (F.col("__ring") == F.col("own_ring")))
            & (F.col("dt") - F.col("r") <= F.col("hi")) & (F.col("dt") + F.col("r") >= F.col("lo")))

    bounds = spread.select(*RING, "lo", "hi", "n")
    seeds_of = {r[0]: r[1] for r in asking.groupBy("__c").count().collect()}           # one row per class
    visited = {r[0]: r[1] / seeds_of[r[0]] for r in opened(bounds).groupBy("__c").agg(F.sum("n")).collect()}
    group = cut_lineage(ring_groups(spread, pivots, visited))
    together = [F.col("__c"), F.col("group").alias("__tile"), F.lit(0).alias("__ring")]   # a group stands as one ring
    ask = opened(bounds.join(group, RING)).select("__pid", *together).distinct()
    ask = cut_lineage(ask.join(searching.select("__pid", "__arr"), "__pid"))
    sizes = spread.join(group, RING).select(*together, "n").groupBy(*RING).agg(F.sum("n").alias("n"))
    sizes = cut_lineage(sizes.withColumn("blocks", F.ceil(F.col("n") / (BLOCK * TILE_ROWS)).cast("int")))
    grouped = join_small(index, group, RING).select("__pid", "__m", "__arr", *together)
    # a group may hold the seed's own ring as well
    allp = near.unionByName(nearest_in_rings(ask, grouped, sizes, k)).groupBy("p", "q").agg(
        F.first("q_m").alias("q_m"), F.first("d").alias("d"))

    fw = Window.partitionBy("p").orderBy("d", "q").rowsBetween(Window.unboundedPreceding, -1)
    first = Window.partitionBy("p").orderBy("d", "q")
    top = allp.withColumn("i", F.row_number().over(first)).withColumn(
        "others", F.coalesce(F.sum("q_m").over(fw), F.lit(0))).where(F.col("i") <= k)
    top = top.join(own, top["p"] == own["__pid"]).withColumn("__before", F.col("others") + F.col("__m") - 1) \
        .where(F.col("__before") < k).drop("__pid", "__m")
    vectors = pts.select(F.col("__pid").alias("q"), F.col("__arr").alias("q_arr"))
    lists = top.join(vectors, "q").groupBy("p").agg(F.sort_array(F.collect_list(F.struct(
        (F.col("__before") + F.least(F.col("q_m"), k - F.col("__before"))).alias("cum_end"), "d", "q",
        F.col("q_arr").alias("arr")))).alias("__others"))    # at most k
    copies = F.least(F.col("__m") - 1, F.lit(k))
    copy = F.when(copies > 0, F.array(F.struct(copies.cast("long").alias("cum_end"), F.lit(0.0).alias("d"),
                                               F.col("__pid").alias("q"), F.col("__arr").alias("arr"))))
    none = F.array().cast(ENTRIES)
    nb = wanted.join(lists, wanted["__pid"] == lists["p"], "left").select(
        label, "__arr", F.concat(F.coalesce(copy, none), F.coalesce("__others", none)).alias("nbrs"))
    return nb.withColumn("__total", F.coalesce(F.try_element_at("nbrs", F.lit(-1))["cum_end"], F.lit(0)))


def smote(df: DataFrame, key: str, label: str, array_col: str, k: int = 5,
          plan: DataFrame | None = None, target: str = "target") -> DataFrame:
    """Oversample every class to the majority class size, or to ``plan``'s
    per-class ``target`` (e.g. ``sample.rebalance_plan``: classes below n/k up to n/k).
    Output: the original rows (copy = -1) plus synthetic rows (origin key, copy number),
    with columns (key, copy, label, array_col)."""
    base = df.select(key, label, F.col(array_col).cast("array<double>").alias(array_col))
    counts = base.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    if plan is None:
        counts = counts.withColumn("__need", F.max("__n").over(Window.partitionBy()) - F.col("__n"))
    else:
        counts = join_small(counts, plan.select(label, F.col(target).alias("__t")), on=label)
        counts = counts.withColumn("__need", F.greatest(F.lit(0), F.col("__t") - F.col("__n"))) \
            .drop("__t")
    # exact rank within class by hash order, bucketed so a big class spans many tasks
    ranked = hash_rank(base, [label], key, rank="__r1").withColumn("__r", F.col("__r1") - 1)
    ranked = join_small(ranked.drop("__r1", "__h"), counts, on=label, how="inner")
    copies = (F.floor(F.col("__need") / F.col("__n"))
              + F.when(F.col("__r") < F.col("__need") % F.col("__n"), 1).otherwise(0)).cast("int")
    need = ranked.withColumn("__m", copies).where(F.col("__m") > 0)
    needy = join_small(base, counts.where(F.col("__need") > 0).select(label), on=label, how="left_semi")
    nb = same_class_neighbours(needy, key, label, array_col, k, need.select(label, array_col))
    j = need.join(nb.withColumnRenamed("__arr", array_col), [label, array_col], "left")
    j = j.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__m") - 1)))
    total = F.coalesce(F.col("__total"), F.lit(0))
    draw = F.pmod(F.xxhash64(F.lit(SEED), F.col(key), F.col("copy")), total)
    pick = F.when(total > 0, F.element_at(F.filter("nbrs", lambda e: e["cum_end"] > draw), 1))
    j = j.withColumn("__pick", pick).withColumn("__u", _u(F.col(key), F.col("copy"), F.lit(7)))
    point = F.when(F.col("__pick").isNull(), F.col(array_col)).otherwise(
        F.zip_with(array_col, "__pick.arr", lambda a, b: a + F.col("__u") * (b - a)))
    synth = j.select(key, F.col("copy").cast("int").alias("copy"), label,
                     point.alias(array_col))
    orig = base.select(key, F.lit(-1).alias("copy"), label, array_col)
    return orig.unionByName(synth)
