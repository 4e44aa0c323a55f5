"""Ordered per-key columns that survive a key holding a third of all rows.

A plain ``Window.partitionBy(key)`` puts every row of a key into one task.
``ordered`` first counts rows per key.  If no key exceeds a task's fair share,
it emits ordinary window columns.  If some keys do, their rows are cut into
segments at sampled quantiles of the whole order tuple, each segment gets
its own window, and a small table with one row per (key, segment) carries
totals, last values and so on from one segment to the next.  Both forms give
the same rows; only the physical layout differs.

The table of hot keys has at most one row per shuffle partition, because a key
is hot only above ``total / partitions`` rows.  That bound is what makes it
safe to collect and to broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodia.session import durable

ROWS_PER_TASK = 1_000_000
# sampled rows for each segment
DRAWS = 16
# carried bytes (by the columns' default sizes) beyond this are joined by Spark's own choice of strategy
BROADCAST_BYTES = 8 << 20

_SEG = "_segment"
_HOT = "_is_hot"
_ORDER = "_order_tuple"


class Cell:
    """One output column of :func:`ordered`."""

    def plain(self, w: "Frames", order: list[str]) -> Column:
        raise NotImplementedError

    def partial(self, order: list[str]) -> Column:
        raise NotImplementedError

    def carry(self, part: Column, w: "Frames") -> Column:
        raise NotImplementedError

    def merge(self, local: Column, carried: Column) -> Column:
        raise NotImplementedError

    def finish(self, value: Column) -> Column:
        return value


@dataclass
class Frames:
    """The window frames cells choose from."""

    base: WindowSpec
    whole: WindowSpec

    @property
    def so_far(self) -> WindowSpec:
        return self.base.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    @property
    def before(self) -> WindowSpec:
        return self.base.rowsBetween(Window.unboundedPreceding, -1)

    @property
    def after(self) -> WindowSpec:
        return self.base.rowsBetween(1, Window.unboundedFollowing)

    def last_rows(self, n: int) -> WindowSpec:
        return self.base.rowsBetween(-(n - 1), Window.currentRow)


def _plus(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


def _order_key(order: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@dataclass
class RunningSum(Cell):
    """Sum of ``value`` from the first row to the current one, nulls skipped."""

    value: Column | str

    def plain(self, w, order):
        return F.sum(_col(self.value)).over(w.so_far)

    def partial(self, order):
        return F.sum(_col(self.value))

    def carry(self, part, w):
        return F.sum(part).over(w.before)

    def merge(self, local, carried):
        return _plus(local, carried)


class RowIndex(RunningSum):
    """0-based position of the row within its key."""

    def __init__(self):
        super().__init__(F.lit(1).cast("long"))

    def finish(self, value):
        return value - 1


@dataclass
class RunningMax(Cell):
    """Largest ``value`` so far (a latch for 0/1 flags)."""

    value: Column | str

    def plain(self, w, order):
        return F.max(_col(self.value)).over(w.so_far)

    def partial(self, order):
        return F.max(_col(self.value))

    def carry(self, part, w):
        return F.max(part).over(w.before)

    def merge(self, local, carried):
        return F.greatest(local, carried)


@dataclass
class Total(Cell):
    """An aggregate of the whole key on each of its rows: sum, min, max or count."""

    value: Column | str
    how: str = "sum"

    def _agg(self, c: Column) -> Column:
        return {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[self.how](c)

    def plain(self, w, order):
        return self._agg(_col(self.value)).over(w.whole)

    def partial(self, order):
        return self._agg(_col(self.value))

    def carry(self, part, w):
        again = "sum" if self.how == "count" else self.how
        return Total(part, again)._agg(part).over(w.whole)

    def merge(self, local, carried):
        return F.coalesce(carried, local)


@dataclass
class LastSeen(Cell):
    """Last non-null ``value`` up to the current row."""

    value: Column | str

    def plain(self, w, order):
        return F.last(_col(self.value), ignorenulls=True).over(w.so_far)

    def partial(self, order):
        v = _col(self.value)
        return F.max_by(v, F.when(v.isNotNull(), _order_key(order)))

    def carry(self, part, w):
        return F.last(part, ignorenulls=True).over(w.before)

    def merge(self, local, carried):
        return F.coalesce(local, carried)


@dataclass
class NextSeen(Cell):
    """First non-null ``value`` after the current row."""

    value: Column | str

    def plain(self, w, order):
        return F.first(_col(self.value), ignorenulls=True).over(w.after)

    def partial(self, order):
        v = _col(self.value)
        return F.min_by(v, F.when(v.isNotNull(), _order_key(order)))

    def carry(self, part, w):
        return F.first(part, ignorenulls=True).over(w.after)

    def merge(self, local, carried):
        return F.coalesce(local, carried)


@dataclass
class Following(Cell):
    """``value`` of the next row; null on the last row."""

    value: Column | str

    def plain(self, w, order):
        return F.lead(F.struct(_col(self.value).alias("v"))).over(w.base)

    def partial(self, order):
        return F.min_by(F.struct(_col(self.value).alias("v")), _order_key(order))

    def carry(self, part, w):
        return F.lead(part).over(w.base)

    def merge(self, local, carried):
        return F.coalesce(local, carried)

    def finish(self, value):
        return value.getField("v")


@dataclass
class Preceding(Cell):
    """``value`` of the row before; null on the first row."""

    value: Column | str

    def plain(self, w, order):
        return F.lag(F.struct(_col(self.value).alias("v"))).over(w.base)

    def partial(self, order):
        return F.max_by(F.struct(_col(self.value).alias("v")), _order_key(order))

    def carry(self, part, w):
        return F.lag(part).over(w.base)

    def merge(self, local, carried):
        return F.coalesce(local, carried)

    def finish(self, value):
        return value.getField("v")


@dataclass
class History(Cell):
    """Array of ``value`` over the last ``n`` rows, oldest first.

    ``value`` must not be null; wrap nullable values in a struct.
    """

    value: Column | str
    n: int

    def plain(self, w, order):
        return F.collect_list(_col(self.value)).over(w.last_rows(self.n))

    def partial(self, order):
        raise NotImplementedError("handled by _tails")

    def carry(self, part, w):
        # every segment holds at least one row, so n - 1 segments are enough
        previous = w.base.rowsBetween(-max(self.n - 1, 1), -1)
        return F.flatten(F.collect_list(part).over(previous))

    def merge(self, local, carried):
        joined = F.concat(F.coalesce(carried, F.slice(local, 1, 0)), local)
        return F.slice(joined, F.greatest(F.size(joined) - self.n + 1, F.lit(1)), F.lit(self.n))


@dataclass
class HotKeys:
    """Keys above a task's fair share of rows and where to cut them."""

    keys: list[str]
    rows: list[Row] = field(default_factory=list)
    #: key columns and ``_cuts``, the lower bounds of all segments but the first
    table: DataFrame | None = None
    bits: int = 0

    def __bool__(self) -> bool:
        return bool(self.rows)


def find_hot_keys(
    df: DataFrame, keys: list[str], order: list[str], rows_per_task: int | None = None
) -> HotKeys:
    """Count rows per key (one job) and cut the keys above a fair share.

    A key is hot above ``max(rows_per_task, total / shuffle partitions)`` rows,
    so there are never more hot keys than shuffle partitions.
    """
    floor = ROWS_PER_TASK if rows_per_task is None else rows_per_task
    partitions = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    top = counts.orderBy(F.desc("_n")).limit(partitions).collect()
    if not top or top[0]["_n"] <= floor:
        return HotKeys(keys)
    total = counts.agg(F.sum("_n")).first()[0] if keys else top[0]["_n"]
    share = max(floor, total // partitions)
    hot = [r for r in top if r["_n"] > share]
    if not hot:
        return HotKeys(keys)

    # segments follow the rows of the largest key
    pieces = max(4, 2 * -(-hot[0]["_n"] // max(floor, 1)))
    bits = max(2, (int(pieces) - 1).bit_length())
    segments = 1 << bits
    drawn = df.select(*keys, F.struct(*order).alias(_ORDER))
    if keys:
        schema = T.StructType([*[T.StructField(f"_hot_{k}", df.schema[k].dataType) for k in keys], T.StructField("_n", T.LongType())])
        marks = df.sparkSession.createDataFrame([(*[r[k] for k in keys], r["_n"]) for r in hot], schema)
        cond = F.lit(True)
        for k in keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_hot_{k}"))
        drawn = drawn.join(F.broadcast(marks), cond).drop(*[f"_hot_{k}" for k in keys])
    else:
        drawn = drawn.withColumn("_n", F.lit(hot[0]["_n"]))
    # a hash of the order tuple draws, so a lost task draws the same rows again
    chance = F.lit(float(DRAWS * segments)) / F.col("_n")
    place = F.shiftrightunsigned(F.xxhash64(_ORDER, *keys), 11) / F.lit(float(1 << 53))
    drawn = drawn.filter(place < chance)
    tile = F.ntile(segments).over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(_ORDER))
    firsts = drawn.withColumn("_tile", tile).filter("_tile > 1").groupBy(*keys, "_tile").agg(F.min(_ORDER).alias("_cut"))
    cuts = F.transform(F.array_sort(F.collect_list(F.struct("_tile", "_cut"))), lambda x: x["_cut"])
    bounds = firsts.groupBy(*keys).agg(cuts.alias("_cuts"))
    # a key with few drawn rows repeats its last bound; those segments stay empty
    last = F.element_at("_cuts", -1)
    padded = F.concat("_cuts", F.array_repeat(last, F.lit(segments - 1) - F.size("_cuts")))
    table = durable(bounds.withColumn("_cuts", padded))
    rows = table.select(*keys, F.size("_cuts").alias("_size")).collect()
    return HotKeys(keys, rows, table, bits)


def _width(kind: T.DataType) -> int:
    """Bytes of a value, roughly: 8 a number, 32 a text, the sum of a struct."""
    if isinstance(kind, T.StructType):
        return sum(_width(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _width(kind.elementType)
    return 32 if isinstance(kind, (T.StringType, T.BinaryType)) else 8


def _segment_number(x: Column, cuts: Column, bits: int) -> Column:
    """How many cut points are at or below ``x``, by binary search."""
    steps = F.array(*[F.lit(1 << b) for b in range(bits - 1, -1, -1)])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda acc, step: F.when(F.element_at(cuts, acc + step) <= x, acc + step).otherwise(acc),
    )


def with_segments(df: DataFrame, order: list[str], hot: HotKeys) -> DataFrame:
    """Add the segment number; rows of ordinary keys are all in segment 0."""
    place = F.struct(*order)
    if not hot.keys:
        cut = df.withColumn("_cuts", hot.table.select("_cuts").scalar())
        return cut.withColumns({_SEG: _segment_number(place, F.col("_cuts"), hot.bits), _HOT: F.lit(True)}).drop("_cuts")
    table = hot.table.withColumnsRenamed({k: f"_hot_{k}" for k in hot.keys})
    cond = F.lit(True)
    for k in hot.keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_hot_{k}"))
    joined = df.join(F.broadcast(table), cond, "left")
    seg = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(
        _segment_number(place, F.col("_cuts"), hot.bits)
    )
    joined = joined.withColumns({_SEG: seg, _HOT: F.col("_cuts").isNotNull()})
    return joined.drop("_cuts", *[f"_hot_{k}" for k in hot.keys])


def _tails(df: DataFrame, group: list[str], order: list[str], cells: dict[str, Cell]) -> DataFrame | None:
    """The last ``n - 1`` rows of each segment for the history cells.

    ``row_number() <= n`` is pushed below the shuffle by Spark's group limit.
    """
    histories = {k: c for k, c in cells.items() if isinstance(c, History)}
    if not histories:
        return None
    longest = max(c.n for c in histories.values())
    w = Window.partitionBy(*group).orderBy(*[F.col(c).desc() for c in order])
    picked = (
        df.select(
            *group, *order, *[_col(c.value).alias(f"_h_{k}") for k, c in histories.items()]
        )
        .withColumn("_back", F.row_number().over(w))
        .filter(F.col("_back") <= max(longest - 1, 1))
    )
    packed = F.sort_array(
        F.collect_list(F.struct(-F.col("_back"), *[F.col(f"_h_{k}") for k in histories]))
    )
    out = picked.groupBy(*group).agg(packed.alias("_tail"))
    # array.field gives the array of that field
    return out.select(*group, *[F.col(f"_tail._h_{k}").alias(f"_p_{k}") for k in histories])


def ordered(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    cells: dict[str, Cell],
    hot: HotKeys | None = None,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Add one column per cell, computed in ``order`` within ``keys``.

    ``order`` must be a total order within a key.  An empty ``keys`` treats the
    whole table as one key, which is how global ranks stay distributed.  Pass
    ``hot`` to reuse the counts of an earlier call on the same key.
    """
    if hot is None:
        hot = find_hot_keys(df, keys, order, rows_per_task)
    if not hot:
        part = keys if keys else [F.lit(0)]
        frames = Frames(Window.partitionBy(*part).orderBy(*order), Window.partitionBy(*part))
        return df.select(
            "*", *[c.finish(c.plain(frames, order)).alias(name) for name, c in cells.items()]
        )

    rows = with_segments(df, order, hot)
    group = [*keys, _SEG]
    frames = Frames(Window.partitionBy(*group).orderBy(*order), Window.partitionBy(*group))
    local = rows.select(
        "*",
        *[
            c.plain(frames, order).alias(f"_l_{name}")
            for name, c in cells.items()
        ],
    )

    # only hot keys have more than one segment, so only they need a carry
    hot_rows = rows.filter(_HOT)
    direct = {n: c for n, c in cells.items() if not isinstance(c, History)}
    summary = hot_rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[c.partial(order).alias(f"_p_{n}") for n, c in direct.items()],
    )
    tails = _tails(hot_rows, group, order, cells)
    if tails is not None:
        cond = F.lit(True)
        tails = tails.withColumnsRenamed({g: f"_t_{g}" for g in group})
        for g in group:
            cond = cond & F.col(g).eqNullSafe(F.col(f"_t_{g}"))
        summary = summary.join(tails, cond, "left").drop(*[f"_t_{g}" for g in group])
    part = keys if keys else [F.lit(0)]
    over = Frames(Window.partitionBy(*part).orderBy(_SEG), Window.partitionBy(*part))
    carried = summary.select(
        *[F.col(g).alias(f"_k_{g}") for g in group],
        *[c.carry(F.col(f"_p_{n}"), over).alias(f"_c_{n}") for n, c in cells.items()],
    )
    cond = F.lit(True)
    for g in group:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_k_{g}"))
    # one row per hot key and segment: number and width are known here
    longest = max([c.n for c in cells.values() if isinstance(c, History)], default=1)
    if len(hot.rows) << hot.bits <= BROADCAST_BYTES // (longest * _width(carried.schema)):
        carried = F.broadcast(carried)
    joined = local.join(carried, cond, "left")
    out = [F.col(c) for c in df.columns]
    for name, c in cells.items():
        out.append(c.finish(c.merge(F.col(f"_l_{name}"), F.col(f"_c_{name}"))).alias(name))
    return joined.select(*out)


def panel_window(keys: list[str], order: list[str]) -> WindowSpec:
    """Window over a calendar panel.

    Use it only on panels that hold at most one row per key and calendar step:
    the length of a partition is then bounded by the calendar, not by the data.
    """
    return Window.partitionBy(*keys).orderBy(*order)
