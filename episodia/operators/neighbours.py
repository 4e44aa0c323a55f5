"""Missing values from the nearest rows.

Rows are compared by the mean squared difference of the standardised columns that both
have.  Candidates come from several trees that halve the rows along their columns: the
upper part of a tree is cut on a sample and deals rows to cells, inside a cell the
halving goes on to leaves of at most ``leaf`` rows.  A row stands in one leaf of each
tree, as if missing columns had their means; it looks in every leaf that it can
reach, on both sides of a border in a column it lacks.  Equal rows are searched
once, so no leaf is filled by copies.

The leaves that a row reaches grow with a power of the rows, so many rows are searched in
another way: rows that lack the same columns ask together, the rows that share the same
columns with them are laid along a curve in nested boxes, and a box is opened only
if it can hold one of the ``k`` nearest.  That finds the nearest rows of a cell exactly, and one cell
holds millions of values, so the trees matter only beyond.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodia.functions.scalars import uniform
from episodia.session import durable, written

#: rows of a cell, and sampled rows that place its borders
CELL_ROWS, DRAWS = 200_000, 64
#: rows whose distances to a leaf are held at once
AT_ONCE = 512
#: above so many rows that lack columns in at most so many ways, cells are searched by boxes
FULL_ROWS, PATTERNS = 1 << 14, 64
#: values of such a cell, and tasks that share those who ask in it
CELL_VALUES, SHARES = 8 << 20, 12
#: rows of a box and boxes of the next larger one; (row, box) pairs held at once
RUN, FAN, PAIRS = 32, 8, 1 << 21
#: bits of a column's place on the curve
BITS = 20


def halved(z: np.ndarray, some: np.ndarray, order: Sequence[int], depth: int) -> tuple[int, float] | None:
    """Column and border that halve ``some`` rows best balanced, the next columns first; None if all are equal."""
    for step in range(len(order)):
        j = order[(depth + step) % len(order)]
        x = z[some, j]
        border = np.median(x)
        if (x <= border).all():
            border = x[x < border].max() if (x < border).any() else border
        if (x <= border).any() and (x > border).any():
            return j, float(border)
    return None


def sides(x: np.ndarray, border: float) -> tuple[np.ndarray, np.ndarray]:
    """Which values go left and which right; unknown ones go both ways."""
    unknown = np.isnan(x)
    return unknown | (x <= border), unknown | (x > border)


def leaves(z: np.ndarray, gives: np.ndarray, asks: np.ndarray, order: Sequence[int], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers: at most ``most`` that give (unless more are equal) and those that ask there."""
    filled = np.nan_to_num(z)
    open_groups = [(gives, asks, 0)]
    while open_groups:
        some, asking, depth = open_groups.pop()
        cut = halved(filled, some, order, depth) if len(some) > most else None
        if cut is None:
            yield some, asking
            continue
        low = filled[some, cut[0]] <= cut[1]
        left, right = sides(z[asking, cut[0]], cut[1])
        open_groups += [(some[low], asking[left], depth + 1), (some[~low], asking[right], depth + 1)]


def upper_tree(sample: np.ndarray, order: Sequence[int], cells: int) -> list[tuple]:
    """Nodes (column, border, left, right) of a tree with ``cells`` leaves; negative children are cells."""
    nodes, made = [], [0]

    def grow(some, depth, wanted):
        cut = halved(sample, some, order, depth) if wanted > 1 and len(some) > 1 else None
        if cut is None:
            made[0] += 1
            return -made[0]
        at = len(nodes)
        nodes.append(None)
        low = sample[some, cut[0]] <= cut[1]
        left, right = grow(some[low], depth + 1, wanted // 2), grow(some[~low], depth + 1, wanted - wanted // 2)
        nodes[at] = (*cut, left, right)
        return at

    grow(np.arange(len(sample)), 0, cells)
    return nodes


def cells_of(z: np.ndarray, nodes: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of row number and cell; a row lacking a border's column is in the cells of both sides."""
    rows, at = np.arange(len(z)), np.full(len(z), 0 if nodes else -1)
    done = [(rows[:0], rows[:0])]
    while len(rows):
        over = at < 0
        done.append((rows[over], -at[over]))
        rows, at = rows[~over], at[~over]
        if len(rows):
            column, border, left, right = (np.array(x) for x in zip(*[nodes[i] for i in at]))
            low, high = sides(z[rows, column.astype(int)], border)
            rows, at = np.concatenate([rows[low], rows[high]]), np.concatenate([left[low], right[high]])
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*done))


def nearest_known(z: np.ndarray, some: np.ndarray, asking: np.ndarray, k: int) -> Iterator[tuple]:
    """For blocks of asking rows and each column they lack: (rows, column, distances, numbers of the ``k`` nearest among ``some`` that know it).

    Places without a row have an infinite distance.
    """
    known = ~np.isnan(z)
    full = np.where(known[some], z[some], 0.0)
    mask, square = known[some].astype(float), full ** 2
    for at in range(0, len(asking), AT_ONCE):
        q = asking[at:at + AT_ONCE]
        ours, asked = known[q].astype(float), np.where(known[q], z[q], 0.0)
        common = ours @ mask.T
        total = asked ** 2 @ mask.T + ours @ square.T - 2 * asked @ full.T
        distance = np.where(common > 0, np.maximum(total, 0.0) / np.maximum(common, 1), np.inf)
        for j in range(z.shape[1]):
            donors = np.flatnonzero(known[some, j])
            rows = np.flatnonzero(~known[q, j])
            if not len(donors) or not len(rows):
                continue
            d = distance[np.ix_(rows, donors)]
            near = np.argpartition(d, k - 1, axis=1)[:, :k] if len(donors) > k else np.tile(np.arange(len(donors)), (len(rows), 1))
            yield q[rows], j, np.take_along_axis(d, near, 1), some[donors[near]]


def along_curve(places: np.ndarray) -> np.ndarray:
    """A number for each row that interleaves the bits of its columns' places, so that near rows have near numbers."""
    bits = min(BITS, 63 // places.shape[1])
    out = np.zeros(len(places), np.int64)
    for b in range(BITS - 1, BITS - 1 - bits, -1):
        for j in range(places.shape[1]):
            out <<= 1
            out |= places[:, j] >> b & 1
    return out


def keep_nearest(distance: np.ndarray, giver: np.ndarray, rows: np.ndarray, d: np.ndarray, found: np.ndarray) -> None:
    """Merge found rows into the nearest so far, ordered by distance and number."""
    k = distance.shape[1]
    touched = np.unique(rows)
    rows = np.concatenate([np.repeat(touched, k), rows])
    d, found = np.concatenate([distance[touched].ravel(), d]), np.concatenate([giver[touched].ravel(), found])
    order = np.lexsort((found, d, rows))
    rows, d, found = rows[order], d[order], found[order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    rank = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
    best = rank < k
    distance[rows[best], rank[best]], giver[rows[best], rank[best]] = d[best], found[best]


def search_boxes(x: np.ndarray, x_curve: np.ndarray, y: np.ndarray, y_curve: np.ndarray, numbers: np.ndarray, distance: np.ndarray, giver: np.ndarray) -> None:
    """Merge the rows of ``y``, which stand in order of the curve, into the nearest so far of each row of ``x``."""
    k, n, width = distance.shape[1], *y.shape
    runs = max(1, n // max(RUN, k))
    ends = np.arange(runs + 1) * n // runs
    low, high = [np.minimum.reduceat(y, ends[:-1])], [np.maximum.reduceat(y, ends[:-1])]
    while len(low[-1]) > FAN:
        at = np.arange(0, len(low[-1]), FAN)
        low.append(np.minimum.reduceat(low[-1], at))
        high.append(np.maximum.reduceat(high[-1], at))
    inside = np.arange(np.diff(ends).max())

    def compare(rows, boxes):
        """Distances to all rows of a box, and their places; a shorter box repeats its last."""
        at = np.minimum(ends[boxes][:, None] + inside, ends[boxes + 1][:, None] - 1)
        d = sum((x[rows, j][:, None] - y[at, j]) ** 2 for j in range(width)) / width
        d[ends[boxes][:, None] + inside >= ends[boxes + 1][:, None]] = np.inf
        return d, at

    step = max(1, PAIRS // max(len(inside), runs))
    for begin in range(0, len(x), step):
        rows = np.arange(begin, min(begin + step, len(x)))
        # the box around the row's own place bounds what can be among the nearest
        home = np.clip(np.searchsorted(ends, np.searchsorted(y_curve, x_curve[rows]), "right") - 1, 0, runs - 1)
        d, at = compare(rows, home)
        most = distance[rows, -1]
        if d.shape[1] >= k:
            most = np.minimum(most, np.partition(d, k - 1, axis=1)[:, k - 1])
        i, j = np.nonzero((d <= most[:, None]) & np.isfinite(d))
        if len(i):
            keep_nearest(distance, giver, rows[i], d[i, j], numbers[at[i, j]])
        asking, box = np.repeat(rows, len(low[-1])), np.tile(np.arange(len(low[-1])), len(rows))
        for level in range(len(low) - 1, -1, -1):
            gap = sum(np.maximum(np.maximum(low[level][box, j] - x[asking, j], x[asking, j] - high[level][box, j]), 0.0) ** 2 for j in range(width)) / width
            near = gap <= distance[asking, -1]
            asking, box = asking[near], box[near]
            if level:
                asking, box = np.repeat(asking, FAN), (box[:, None] * FAN + np.arange(FAN)).ravel()
                there = box < len(low[level - 1])
                asking, box = asking[there], box[there]
        away = box != home[asking - begin]
        asking, box = asking[away], box[away]
        part = max(1, PAIRS // len(inside))
        for some in range(0, len(asking), part):
            who = asking[some:some + part]
            d, at = compare(who, box[some:some + part])
            i, j = np.nonzero((d <= distance[who, -1][:, None]) & np.isfinite(d))
            if len(i):
                keep_nearest(distance, giver, who[i], d[i, j], numbers[at[i, j]])


def nearest_by_boxes(z: np.ndarray, gives: np.ndarray, asks: np.ndarray, k: int) -> Iterator[tuple]:
    """Like ``nearest_known`` over all rows: (rows, column, distances, numbers of the ``k`` nearest that know it), equal distances by number.

    A distance depends on the columns that both know, so rows that share the same ones with those who ask are searched together.
    """
    known = ~np.isnan(z)
    pattern = known @ (1 << np.arange(z.shape[1], dtype=np.int64))
    places = np.zeros(z.shape, np.int32)
    for c in range(z.shape[1]):
        values, rank = np.unique(z[known[:, c], c], return_inverse=True)
        places[known[:, c], c] = rank * ((1 << BITS) - 1) // max(len(values) - 1, 1)
    gives, asked = np.sort(gives), pattern[asks]
    for p in np.unique(asked):
        who = asks[asked == p]
        for j in np.flatnonzero(~(p >> np.arange(z.shape[1]) & 1).astype(bool)):
            donors = gives[known[gives, j]]
            shared = pattern[donors] & p
            distance, giver = np.full((len(who), k), np.inf), np.zeros((len(who), k), np.int64)
            # few common columns give small distances, which close most boxes of the others
            for common in sorted(set(np.unique(shared).tolist()) - {0}, key=lambda m: (m.bit_count(), m)):
                columns = np.flatnonzero(common >> np.arange(z.shape[1]) & 1)
                some = donors[shared == common]
                curve, y = along_curve(places[np.ix_(some, columns)]), z[np.ix_(some, columns)]
                order = np.lexsort((*y.T, curve))
                y, curve, some = y[order], curve[order], some[order]
                # of equal rows only the first k can be among the nearest
                first = np.flatnonzero(np.r_[True, (y[1:] != y[:-1]).any(1)])
                few = np.arange(len(y)) - np.repeat(first, np.diff(np.r_[first, len(y)])) < k
                search_boxes(z[np.ix_(who, columns)], along_curve(places[np.ix_(who, columns)]), y[few], curve[few], some[few], distance, giver)
            yield who, j, distance, giver


def shares_of(counts: dict[int, int], width: int) -> dict[int, int]:
    """Which of ``SHARES`` tasks looks for the rows of a pattern; the costly ones are dealt first."""
    total = sum(counts.values())  # for each lacking column all rows are laid along curves, then each asking row is looked for under every set of common columns
    cost = {p: (width - p.bit_count()) * (total + 10 * n * ((1 << p.bit_count()) - 1)) for p, n in counts.items()}
    load, out = [0] * SHARES, {}
    for p in sorted(cost, key=lambda p: (-cost[p], p)):
        out[p] = load.index(min(load))
        load[out[p]] += cost[p]
    return out


def nearest_rows(vectors: DataFrame, width: int, k: int, trees: int, leaf: int, seed: int) -> DataFrame:
    """``vec, col, near``: for each lacking column the nearest (distance, vec, value) found.

    ``vectors`` is a table of ``vec`` and ``z``, an array with NaN where nothing is known.
    """
    spark = vectors.sparkSession
    count, pattern = vectors.count(), F.transform("z", lambda x: F.isnan(x))
    ways = vectors.groupBy(pattern.alias("lacks")).count().limit(PATTERNS + 1).collect() if FULL_ROWS < count and width < 32 else []
    boxes = 0 < len(ways) <= PATTERNS
    shares = shares_of({sum(1 << i for i, x in enumerate(r["lacks"]) if not x): r["count"] for r in ways}, width) if boxes else {}
    cell_rows = CELL_VALUES // width if boxes else CELL_ROWS
    cells = max(1, math.ceil(count / cell_rows))
    rng = np.random.default_rng(seed)
    orders = [[int(j) for j in rng.permutation(width)] for _ in range(trees)]
    if boxes and cells == 1:
        orders = orders[:1]  # every tree would give the same rows
    share = min(1.0, DRAWS * cells / max(cells * cell_rows, 1)) if cells > 1 else 0.0
    drawn = vectors.filter(uniform(F.lit("cells"), F.lit(seed), "vec") < share).select("z").collect() if share else []  # about DRAWS rows a cell
    sample = np.nan_to_num(np.array([r["z"] for r in drawn], np.float64).reshape(-1, width))
    uppers = spark.sparkContext.broadcast([upper_tree(sample, o, cells) if cells > 1 else [] for o in orders])

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

    def deal(batches):
        for batch in batches:
            z = matrix(batch.column(1))
            lacking = np.flatnonzero(np.isnan(z).any(1))
            # all shares of a cell have its rows, each has some of those who ask
            mine = np.array([shares[int(p)] for p in ~np.isnan(z[lacking]) @ (1 << np.arange(width, dtype=np.int64))], np.int64) if boxes else np.zeros(len(lacking), np.int64)
            for t, nodes in enumerate(uppers.value):
                for part in range(SHARES if boxes else 1):
                    for asks, some in ((False, np.arange(len(z))), (True, lacking[mine == part])):
                        rows, cell = cells_of(z[some] if asks else np.nan_to_num(z), nodes)
                        picked = batch.take(pa.array(some[rows]))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t, np.int32)), pa.array(cell), pa.array(np.full(len(rows), part, np.int32)),
                                                          pa.array(np.full(len(rows), asks)), *picked.columns], ["tree", "cell", "share", "asks", "vec", "z"])

    def by_leaves(z, asks, order):
        for some, asking in leaves(z, np.flatnonzero(~asks), np.flatnonzero(asks), order, leaf):
            yield from nearest_known(z, some, asking, k)

    def search(table: pa.Table) -> pa.Table:
        if boxes:  # equal distances go by number, so the numbers follow the ids
            table = table.sort_by("vec")
        z, ids, asks = matrix(table.column("z").combine_chunks()), table.column("vec").to_numpy(), table.column("asks").to_numpy()
        # the k best so far of each asking row and column it lacks: distance and row, in order
        asking = np.flatnonzero(asks)
        place = np.full((len(asking), width), -1, np.int64)
        row, col = np.nonzero(np.isnan(z[asking]))
        place[row, col] = np.arange(len(row))
        row = asking[row]
        distance, giver = np.full((len(row), k), np.inf), np.zeros((len(row), k), np.int64)
        every = nearest_by_boxes(z, np.flatnonzero(~asks), asking, k) if boxes else by_leaves(z, asks, orders[table.column("tree")[0].as_py()])
        for rows, j, d, found in every:
            at = place[np.searchsorted(asking, rows), j]
            d, found = np.concatenate([distance[at], d], 1), np.concatenate([giver[at], found], 1)
            first = np.lexsort((ids[found], d), axis=1)[:, :k]
            distance[at], giver[at] = np.take_along_axis(d, first, 1), np.take_along_axis(found, first, 1)
        there = np.isfinite(distance)
        some, flat = there.any(1), giver[there]
        entries = pa.StructArray.from_arrays([pa.array(distance[there]), pa.array(ids[flat], pa.int64()), pa.array(z[flat, np.repeat(col, there.sum(1))])], ["distance", "vec", "value"])
        ends = np.concatenate([[0], np.cumsum(there.sum(1)[some])]).astype(np.int32)
        return pa.table([pa.array(ids[row[some]], pa.int64()), pa.array(col[some].astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), entries)], ["vec", "col", "near"])

    near = "near array<struct<distance: double, vec: long, value: double>>"
    dealt = vectors.select("vec", "z").mapInArrow(deal, "tree int, cell long, share int, asks boolean, vec long, z array<double>")
    found = dealt.groupBy("tree", "cell", "share").applyInArrow(search, f"vec long, col int, {near}")
    if boxes and cells == 1:
        return found.select("vec", "col", "near")
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_list("near"))))  # at most trees x k entries
    return found.groupBy("vec", "col").agg(F.slice(every, 1, k).alias("near"))


def filled_from_nearest(df: DataFrame, columns: Sequence[str], k: int = 5, max_missing: float = 0.9, trees: int = 4,
                        leaf: int = 1024, seed: int = 42) -> DataFrame:
    """Nulls of ``columns`` become the mean of the ``k`` nearest rows that know the column.

    Columns with at least ``max_missing`` nulls are left alone.  A row that shares
    no column with any candidate takes the column's mean.
    """
    stats = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"k_{c}") for c in columns],
        *[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in columns], *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in columns],
    ).first()
    used = [c for c in columns if stats[f"k_{c}"] / (stats["n"] or 1) > 1 - max_missing]
    if not used:
        return df
    mean, spread = {c: float(stats[f"m_{c}"]) for c in used}, {c: float(stats[f"s_{c}"] or 1.0) for c in used}
    z = F.array(*[F.coalesce((F.col(c).cast("double") - F.lit(mean[c])) / F.lit(spread[c]), F.lit(float("nan"))) for c in used])
    rows = durable(df.withColumn("_z", z))
    vectors = written(rows.select(F.col("_z").alias("z")).distinct().withColumn("vec", F.monotonically_increasing_id()), "vectors")
    near = nearest_rows(vectors, len(used), k, trees, leaf, seed)
    value = F.aggregate("near", F.lit(0.0), lambda a, x: a + x["value"]) / F.size("near")
    fills = near.withColumn("value", value).groupBy("vec").agg(*[F.max(F.when(F.col("col") == i, F.col("value"))).alias(f"_v{i}") for i in range(len(used))])
    given = vectors.join(fills, "vec").drop("vec").withColumnRenamed("z", "_of")
    out = rows.join(given, rows["_z"] == given["_of"], "left")
    return out.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.col(f"_v{i}") * F.lit(spread[c]) + F.lit(mean[c]), F.lit(mean[c])) for i, c in enumerate(used)
    }).select(*df.columns)
