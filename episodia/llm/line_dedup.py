"""Line runs repeated across documents, by names of line windows.

The corpus is a set of line-id sequences.  From each line a passage opens, the
shortest run with enough words; a run is also followed to every end before the
next line's passage ends.  These windows are at most two for each line, and every
run that an earlier place shares is a union of windows that it shares: each line
opens a passage inside the run, and the last of them goes on to the run's end.
A window's name is made of the hashes of two runs of ``2^k`` lines that overlap in
it, which come from doubling.  Of the windows with one name the first is the
original, the others are later copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodia.llm.words import U64, mixed, text_parts
from episodia.session import written

#: a run is a passage, and deleted where it comes again, from so many words on
PASSAGE_WORDS = 50
LAST = (1 << 63) - 1


def window_ends(upto: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """First line and end (exclusive) of each window of a text with so many words up to each line."""
    n = len(upto)
    last = np.searchsorted(upto, np.concatenate([[0], upto[:-1]]) + words)
    end = last[last < n] + 1
    many = np.maximum(1, np.concatenate([end[1:], [n + 1]])[:len(end)] - end)
    start = np.repeat(np.arange(len(end)), many)
    return start, end[start] + np.arange(len(start)) - np.repeat(np.cumsum(many) - many, many)


def window_names(ids: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """Hash of the ``length`` ids from ``start`` on, for each window."""
    level = np.frexp(length.astype(np.float64))[1] - 1
    out, run = np.empty(len(start), U64), mixed(ids ^ U64(seed))
    with np.errstate(over="ignore"):
        for k in range(int(level.max()) + 1 if len(level) else 0):
            at = np.flatnonzero(level == k)
            s, n = start[at], length[at]
            out[at] = mixed(run[s] * U64(0xD1342543DE82EF95) + mixed(run[s + n - (1 << k)] + n.astype(U64)))
            run = mixed(run[:-(1 << k)] * U64(0x9E3779B97F4A7C15) + mixed(run[1 << k:] + U64(k)))
    return out


def _windows(words: int):
    """Place, end and name of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for batch in text_parts(whole):
                ids, row, start, end, offset = [], [], [], [], []
                for i, t in enumerate(batch.column("text").to_pylist()):
                    lines = t.split(b"\n") if t is not None else []
                    if not lines:
                        continue
                    a, e = window_ends(np.cumsum([len(x.split()) for x in lines]), words)
                    if not len(a):
                        continue
                    row.append(np.full(len(a), i))
                    offset.append(np.full(len(a), len(ids)))
                    start.append(a)
                    end.append(e)
                    ids.extend(xxhash.xxh3_64_intdigest(x.strip()) for x in lines)
                if not row:
                    continue
                row, start, end, offset = (np.concatenate(x).astype(np.int64) for x in (row, start, end, offset))
                names = [window_names(np.array(ids, U64), offset + start, end - start, seed).view(np.int64) for seed in (0x243F6A8885A308D3, 0x13198A2E03707344)]
                yield pa.RecordBatch.from_arrays([
                    batch.column("d").take(pa.array(row)), batch.column("k").take(pa.array(row)), pa.array(start), pa.array(end), pa.array(names[0]), pa.array(names[1])],
                    ["d", "k", "pos", "end", "g", "h"])

    return run


def copied_runs(windows: DataFrame) -> DataFrame:
    """Runs with an earlier occurrence: ``k`` and the lines ``start`` to ``end`` (exclusive), apart from each other."""
    place = F.struct("d", "pos", "k")
    first = windows.groupBy("g", "h").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("src")).filter("n > 1").drop("n")
    later = windows.join(first, ["g", "h"]).filter(place > F.col("src")).groupBy("k", "pos").agg(F.max("end").alias("end"))
    lines = Window.partitionBy("k").orderBy("pos")
    apart = F.col("pos") > F.max("end").over(lines.rowsBetween(Window.unboundedPreceding, -1))
    runs = later.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(lines.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("k", "_run").agg(F.min("pos").alias("start"), F.max("end").alias("end")).drop("_run")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = PASSAGE_WORDS) -> DataFrame:
    """``docs`` without later copies of repeated line runs of at least ``words`` words.

    Lines are compared without white space at their ends.  Of a passage (the
    shortest run of lines from a line on with that many words) the occurrence
    first in order of id and line stays; a later one is deleted together with
    all lines that go on like any earlier one.  All columns return, with the text
    shortened, and ``_lines``, a struct of ``n`` and ``deleted``.  Null text stays
    null with no lines; a text deleted whole becomes empty.  Rows equal in id and
    text are one document and get the same result; null ids come last.  An
    empty table gives an empty one.
    """
    d, k = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), F.xxhash64(id_col, text_col)
    rows = docs.select(d.alias("d"), k.alias("k"), F.col(text_col).cast("binary").alias("text"))
    windows = written(rows.mapInArrow(_windows(words), "d long, k long, pos long, end long, g long, h long"), "windows")
    gone = copied_runs(windows).groupBy(F.col("k").alias("_k")).agg(F.collect_list(F.struct("start", "end")).alias("_gone"))
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[text_col].alias("_text"), k.alias("_k"))
    joined = packed.join(gone, "_k", "left")
    parts = F.split("_text", "\n", -1)
    kept = F.filter(parts, lambda x, i: ~F.exists("_gone", lambda r: (i >= r["start"]) & (i < r["end"])))
    joined = joined.withColumn("_kept", F.when(F.col("_gone").isNull(), parts).otherwise(kept))
    counts = F.struct(F.coalesce(F.size(parts), F.lit(0)).alias("n"), F.coalesce(F.size(parts) - F.size("_kept"), F.lit(0)).alias("deleted"))
    text = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join("_kept", "\n"))
    return joined.select(*[(text if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns], counts.alias("_lines"))


def op10_line_runs(spark, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return cleaned.select("doc_id", F.col("_lines.n").cast("long").alias("n_lines"), F.col("_lines.deleted").cast("long").alias("n_deleted"), F.crc32(F.col("text").cast("binary")).alias("kept_crc32"))
