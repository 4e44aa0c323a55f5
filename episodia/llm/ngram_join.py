"""Exact n-gram Jaccard join by T-occurrence search.

Two sets of sizes ``a`` and ``b`` link when ``100 * common >= 85 * union``, so
they have at least ``ceil(85 * max(a, b) / 100)`` members in common.  In any fixed
order of members, the first ``n - needed + extra`` members of both sets then share
at least the smaller ``extra`` of them.  Three uses of that fact keep the
work near the number of documents that do have a partner:

1. In hash order: documents too few of whose first members occur anywhere else
   are out.  Only this prefix of every set is ever shuffled.
2. In order of frequency among what is left: rare members first, so a passage
   that thousands share comes last.
3. Sets that agree in a minimum hash meet in blocks and are linked
   (T-occurrence search).  Then only lists that hold more than one component
   are looked at; documents over such lists are a family, dealt to blocks, and
   those outside its largest component are searched in its blocks.  No pairs are
   formed as rows, and none is compared within the largest component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodia.llm.graph import components
from episodia.llm.words import U64, WordTable, mixed, text_parts, windows, word_codes
from episodia.session import durable, written

WIDTH, PERCENT = 4, 85
#: one in so many members is looked at beyond the shortest prefix
EXTRA = 12
MINHASHES = 3
BUCKET_POSTINGS = 1_000_000
#: a block holds about so many sets and so many of their members at most
BLOCK, BLOCK_MEMBERS = 1000, 400_000


def needed(n):
    return (PERCENT * n + 99) // 100


def extra(n):
    return np.maximum(1, n // EXTRA)


def _needed(n: Column) -> Column:
    return F.floor((n * PERCENT + 99) / 100)


def _extra(n: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n / EXTRA))


def shingle_sets(texts: list[bytes | None], table: WordTable) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    rows = [table.rows(t.lower().split()) if t else np.empty(0, np.int64) for t in texts]
    codes = table.filled()
    out = [np.unique(windows(codes[r], WIDTH)) if len(r) else np.empty(0, U64) for r in rows]
    table.trim()
    return out


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, U64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = WordTable(word_codes)
    for whole in batches:
        for batch in text_parts(whole):
            sets = shingle_sets(batch.column("text").to_pylist(), table)
            n = np.array([len(s) for s in sets], np.int64)
            first = np.array([mixed(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64) for s in sets], U64)
            second = np.array([mixed(s + U64(0x14057B7EF767814F)).sum(dtype=U64) for s in sets], U64)
            prefix = [s[:max(0, len(s) - int(needed(len(s))) + int(extra(len(s))))] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("u"), batch.column("k"), pa.array(n), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), _lists(prefix)],
                ["doc_id", "u", "k", "n", "f1", "f2", "prefix"])


def _spread(buckets: int):
    """Postings packed by bucket; a member met twice in a batch is sent once, as shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("prefix")
            lens = np.asarray(pc.list_value_length(col), np.int64)
            hashes = np.asarray(col.flatten()).view(U64)
            ids = np.repeat(np.asarray(batch.column("u"), np.int64), lens)
            order = np.argsort(hashes, kind="stable")
            hashes, ids = hashes[order], ids[order]
            new = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.empty(0, np.int64)
            counts = np.diff(np.append(new, len(hashes)))
            known = np.repeat(counts > 1, counts)
            who, times = np.unique(ids[known], return_counts=True)
            heads = hashes[new]
            owner = np.where(counts > 1, -1, ids[new])
            at = (heads & U64(buckets - 1)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            heads, owner, at = heads[order], owner[order], at[order]
            cut = np.searchsorted(at, np.arange(buckets + 1))
            home = np.argsort(who % buckets, kind="stable")
            who, times = who[home], times[home]
            cut2 = np.searchsorted(who % buckets, np.arange(buckets + 1))
            rows = [b for b in range(buckets) if cut[b + 1] > cut[b] or cut2[b + 1] > cut2[b]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(rows, np.int64))] + [
                    pa.array([x[c[b]:c[b + 1]].tobytes() for b in rows], pa.binary()) for x, c in ((heads, cut), (owner, cut), (who, cut2), (times.astype(np.int64), cut2))],
                ["bucket", "h", "o", "w", "t"])

    return run


def _met(pdf: pd.DataFrame) -> pd.DataFrame:
    """How often each document's members occur elsewhere, for one bucket."""
    h = np.concatenate([np.frombuffer(x, U64) for x in pdf["h"]])
    o = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["o"]])
    order = np.argsort(h, kind="stable")
    h, o = h[order], o[order]
    same = h[1:] == h[:-1] if len(h) else np.empty(0, bool)
    shared = (o >= 0) & (np.append(same, False)[:len(h)] | np.concatenate([[False], same])[:len(h)])
    who = np.concatenate([o[shared], *[np.frombuffer(x, np.int64) for x in pdf["w"]]])
    times = np.concatenate([np.ones(shared.sum(), np.int64), *[np.frombuffer(x, np.int64) for x in pdf["t"]]])
    ids, at = np.unique(who, return_inverse=True)
    return pd.DataFrame({"u": ids, "met": np.bincount(at, weights=times, minlength=len(ids)).astype(np.int64)})


def occurrences(index: list[np.ndarray]):
    """Inverted lists of a block: members, list bounds and the sets in them."""
    who = np.repeat(np.arange(len(index)), [len(s) for s in index])
    flat = np.concatenate(index) if index else np.empty(0, U64)
    order = np.argsort(flat, kind="stable")
    members, starts = np.unique(flat[order], return_index=True)
    return members, np.append(starts, len(flat)), who[order]


def search(query: np.ndarray, lists, sizes: np.ndarray) -> np.ndarray:
    """T-occurrence search with divide and skip: sets of the block linked to ``query``.

    Short lists are merged and counted.  The longest ones, fewer than the
    required overlap, are left out of the merge and probed by binary search
    for sets that could still reach it.
    """
    members, bounds, who = lists
    at = np.searchsorted(members, query)
    at = at[at < len(members)] if len(members) else at[:0]
    at = at[np.isin(members[at], query, assume_unique=False)] if len(at) else at
    at = np.unique(at)
    if not len(at):
        return np.empty(0, np.int64)
    length = bounds[at + 1] - bounds[at]
    order = np.argsort(-length, kind="stable")
    at, length = at[order], length[order]
    n = len(query)
    required = -(-PERCENT * (n + sizes) // (100 + PERCENT))  # ceil, for each set of the block
    least = int(needed(n))
    skip = min(int(least / (0.0085 * np.log2(max(int(length[0]), 2)) + 1)), max(least - 1, 0)) if length[0] > 32 else 0
    merged = at[skip:]
    runs = bounds[merged + 1] - bounds[merged]
    entries = np.repeat(bounds[merged] - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum()) if len(merged) else np.empty(0, np.int64)
    counts = np.bincount(who[entries], minlength=len(sizes))
    some = np.flatnonzero(counts + skip >= required)
    if skip and len(some):
        total = counts[some]
        for a in at[:skip]:
            part = who[bounds[a]:bounds[a + 1]]
            place = np.searchsorted(part, some)
            place[place == len(part)] = 0
            total = total + (part[place] == some)
        return some[total >= required[some]]
    return some[counts[some] >= required[some]]


def _root(up: np.ndarray, x: int) -> int:
    while up[x] != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


def _arrays(column: pd.Series) -> list[np.ndarray]:
    return [np.asarray(x, np.int64).view(U64) for x in column]


def _within(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links inside the blocks of one bucket, as edges to a block's first set."""
    a, b = [], []
    for _, part in pdf.sort_values(["block", "c"]).groupby("block", sort=False):
        sets, ids = _arrays(part["hashes"]), part["c"].to_numpy()
        sizes = np.array([len(s) for s in sets], np.int64)
        lists, up = occurrences(sets), np.arange(len(sets))
        for i, s in enumerate(sets):
            if _root(up, i) != i or (up == i).sum() > 1:
                continue  # already linked; what this leaves apart is found later
            for j in search(s, lists, sizes):
                x, y = _root(up, i), _root(up, int(j))
                up[max(x, y)] = min(x, y)
        for i in range(len(sets)):
            if (r := _root(up, i)) != i:
                a.append(ids[i])
                b.append(ids[r])
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _across(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between components of a family: queries searched in one block of it."""
    a, b = [], []
    for _, part in pdf.sort_values(["block", "role", "c"]).groupby("block", sort=False):
        own, asks = part[part["role"] == 0], part[part["role"] == 1]
        if not len(own) or not len(asks):
            continue
        sets, ids, of = _arrays(own["hashes"]), own["c"].to_numpy(), own["comp"].to_numpy()
        sizes, lists = np.array([len(s) for s in sets], np.int64), occurrences(sets)
        for c, comp, s in zip(asks["c"], asks["comp"], _arrays(asks["hashes"])):
            found = search(s, lists, sizes)
            others, first = np.unique(of[found], return_index=True)
            for other, i in zip(others, found[first]):  # one link joins a component
                if other != comp:
                    a.append(c)
                    b.append(ids[i])
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = WordTable(word_codes)
    for whole in batches:
        for batch in text_parts(whole):
            sets = shingle_sets(batch.column("text").to_pylist(), table)
            mins = [[int(mixed(s + U64(977 * (i + 1))).min().view(np.int64)) if len(s) else 0 for i in range(MINHASHES)] for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("n"), _lists(sets), pa.array(mins, pa.list_(pa.int64()))], ["c", "n", "hashes", "mins"])


def _blocks(n) -> Column:
    """Blocks that rows with sets of ``n`` members are dealt to."""
    return F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(n) / BLOCK_MEMBERS))


def _buckets(total: int) -> int:
    return 1 << max(5, int(np.ceil(np.log2(max(total, 1) / BUCKET_POSTINGS + 1))))


def with_partners(profile: DataFrame) -> DataFrame:
    """Rows of the profile enough of whose first members occur in another row."""
    total = profile.agg(F.sum(F.size("prefix"))).first()[0] or 0
    buckets = _buckets(total)
    packed = profile.select("u", "prefix").mapInArrow(_spread(buckets), "bucket long, h binary, o binary, w binary, t binary")
    met = packed.groupBy("bucket").applyInPandas(_met, "u long, met long").groupBy("u").agg(F.sum("met").alias("met"))
    return profile.drop("prefix").join(met, "u").filter(F.col("met") >= _extra(F.col("n"))).drop("met")


def classes_and_links(docs: DataFrame, profile: DataFrame) -> DataFrame:
    """``c`` (class of equal sets) and ``root`` (smallest class linked to it)."""
    left = durable(with_partners(profile))
    classes = left.groupBy("n", "f1", "f2").agg(F.min_by(F.struct("u", "k"), "u").alias("x")).select("n", F.col("x.u").alias("c"), F.col("x.k").alias("k"))
    text = docs.select(F.xxhash64("doc_id", "text").alias("k"), F.col("text").cast("binary").alias("text"))
    # rows equal in id and text are one; the join has dealt them by that key
    chosen = text.join(classes, "k").dropDuplicates(["k"]).select("c", "n", "text")
    sets = written(chosen.mapInArrow(_full_sets, "c long, n long, hashes array<long>, mins array<long>"), "sets")
    postings = sets.select("c", F.explode("hashes").alias("h"))
    common = postings.groupBy("h").agg(F.count(F.lit(1)).cast("int").alias("df")).filter("df > 1")
    ranked = postings.join(common, "h").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("l"))  # at most one set's members
    ranked = ranked.join(sets.select("c", "n"), "c")
    n, s = F.col("n"), F.size("l")
    keep = n - _needed(n) + _extra(n) - (n - s)  # members that occur nowhere else come first
    near = durable(ranked.filter((s >= _needed(n)) & (keep > 0)).select("c", "n", F.transform(F.slice("l", F.lit(1), keep.cast("int")), lambda x: x["h"]).alias("prefix")))
    near_sets = written(sets.join(near.select("c"), "c", "left_semi"), "near")
    # blocks of sets with an equal minimum hash; large ones are cut
    keys = near_sets.select("c", "n", F.posexplode("mins").alias("round", "key"))
    many = keys.groupBy("round", "key").agg(F.count(F.lit(1)).alias("m"), _blocks("n").alias("cut")).filter("m > 1")
    dealt = keys.join(many, ["round", "key"]).select("c", F.xxhash64("round", "key", F.pmod(F.xxhash64("c"), "cut")).alias("block"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    bucket = F.pmod(F.xxhash64("block", F.lit(1)), F.lit(parts))
    edges = durable(dealt.join(near_sets.select("c", "hashes"), "c").withColumn("bucket", bucket).groupBy("bucket").applyInPandas(_within, "a long, b long"))
    first = components(edges)
    comp = durable(near.select("c", "n", "prefix").join(first.withColumnRenamed("node", "c"), "c", "left").withColumn("comp", F.coalesce("root", "c")).drop("root"))
    # lists that hold several components; documents over such lists form families
    lists = comp.select("c", "comp", F.explode("prefix").alias("h"))
    several = lists.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min("c").alias("low")).filter("x <> y").select("h", "low")
    families = components(lists.join(several, "h").select(F.col("c").alias("a"), F.col("low").alias("b")).unionByName(comp.filter("c <> comp").select(F.col("c").alias("a"), F.col("comp").alias("b"))))
    placed = durable(comp.select("c", "n", "comp").join(families.select(F.col("node").alias("c"), F.col("root").alias("family")), "c"))
    sizes = placed.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n")).groupBy("family").agg(
        F.ceil(F.greatest(F.sum("m") / BLOCK, F.sum("n") / BLOCK_MEMBERS)).alias("cut"), F.count(F.lit(1)).alias("comps"), F.max_by("comp", F.struct("m", "comp")).alias("largest")).filter("comps > 1")
    placed = placed.join(sizes, "family")
    cut = F.col("cut")
    members = placed.select("c", "comp", F.lit(0).alias("role"), F.xxhash64("family", F.pmod(F.xxhash64("c"), cut)).alias("block"))
    # what is outside the largest component of its family is searched in all its blocks
    queries = placed.filter("comp <> largest").select("c", "comp", F.lit(1).alias("role"), "family", F.explode(F.sequence(F.lit(0).cast("long"), (cut - 1).cast("long"))).alias("part"))
    queries = queries.select("c", "comp", "role", F.xxhash64("family", "part").alias("block"))
    rows = members.unionByName(queries).join(near_sets.select("c", "hashes"), "c").withColumn("bucket", bucket)
    more = rows.groupBy("bucket").applyInPandas(_across, "a long, b long")
    last = components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    return left.select("u", "n", "f1", "f2").join(classes_keys(left), ["n", "f1", "f2"]).select("u", "c").join(last.withColumnRenamed("node", "c"), "c", "left").select("u", F.coalesce("root", "c").alias("root"))


def classes_keys(left: DataFrame) -> DataFrame:
    return left.groupBy("n", "f1", "f2").agg(F.min("u").alias("c"))


def _rows_and_roots(docs: DataFrame) -> DataFrame:
    """``u``, ``doc_id``, ``k`` (hash of id and text), ``n`` and ``root`` of every row."""
    docs = docs.select("doc_id", "text")
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("u"), F.xxhash64("doc_id", "text").alias("k"), F.col("text").cast("binary").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    profile = written(rows.mapInArrow(_profile, f"doc_id {id_type}, u long, k long, n long, f1 long, f2 long, prefix array<long>"), "profile")
    roots = durable(classes_and_links(docs, profile.filter("n > 0")))
    return profile.select("u", "doc_id", "k", "n").join(roots, "u", "left").withColumn("root", F.coalesce("root", "u"))


def ngram_components(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs``.

    Words are runs other than ASCII white space, A-Z lower-cased; a set holds the
    distinct 4-word shingles, or the whole sequence if it is shorter.  Null and
    blank texts have an empty set and are linked with nothing.  Repeated rows and
    equal texts are one class.  ``component_id`` is the smallest ``doc_id`` that is
    reachable over links (null ids are passed over; null if there is no other).
    Needs ``doc_id`` and ``text``; other columns are ignored.  An empty table
    gives an empty one.
    """
    all_rows = _rows_and_roots(docs)
    lowest = all_rows.filter("root <> u").select("root").distinct()
    smallest = all_rows.join(lowest, "root", "left_semi").groupBy("root").agg(F.min("doc_id").alias("least"))
    return all_rows.join(smallest, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest ``doc_id``.

    Rows with an empty set stay, but rows equal in id and text are one row.
    """
    kept = _rows_and_roots(docs).groupBy("root").agg(F.min_by("k", F.struct(F.col("doc_id").isNull(), "doc_id", "k")).alias("_k")).select("_k").distinct()
    # the join deals rows by the key, so dropping repeated ones needs no exchange
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.xxhash64("doc_id", "text").alias("_k"))
    return packed.join(kept, "_k").dropDuplicates(["_k"]).select("_row.*")


def op3_t_occurrence(spark, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
