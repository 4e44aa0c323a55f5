"""A context-tree weighting model of bytes, counted over all documents and kept in shards.

A text is its lower-cased words, a blank after each and a line feed at the end.  Each
byte is eight binary choices; a choice has a tree of its own over the bytes before it,
up to ``DEPTH``, and each node of a tree estimates the next bit by Krichevsky and Trofimov.
A node's weighted probability mixes its own estimate with the product of its children's,
half and half, so after training the share of each depth on a path is known and
the model gives a fixed probability to each byte after its context.  A path ends at the deepest
node that training has seen.

Documents are read in chunks.  A chunk asks for each of its distinct strings and words once, in
buckets of packed numbers, and gets the answers in the same order, so neither the
model nor the vocabulary has to fit anywhere as a whole.

The table of all distinct byte strings of ``DEPTH + 1`` with their training counts is sorted by context,
latest byte first, and cut into ranges.  Every node whose strings lie in one range is
computed there.  Nodes that several ranges hold begin one of the ranges' first or last strings; each range gives partial
sums for these, which are added up and sent back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodia.llm.words import mixed, text_parts, word_codes
from episodia.session import written

DEPTH = 5
#: text bytes that one look-up of strings and words serves
CHUNK_BYTES = 16 << 20
#: text bytes handled at a time
PART_BYTES = 2 << 20
END = b"\n"
HALF = np.log(0.5)


def spelled(text: bytes | None) -> tuple[list[bytes], bytes]:
    """The words of a text and the bytes that stand for it."""
    words = (text or b"").lower().split()
    return words, (b" ".join(words) + b" " if words else b"") + END


def pieces(texts: list[bytes], most: int = PART_BYTES, depth: int = DEPTH) -> Iterator[tuple[list[int], list[bytes]]]:
    """Lists of text numbers and slices of about ``most`` bytes, each slice behind the ``depth`` bytes before it.

    Every text starts after line feeds.
    """
    owners, slices, held = [], [], 0
    for i, text in enumerate(texts):
        whole = END * depth + text
        for at in range(0, len(text), most):
            owners.append(i)
            slices.append(whole[at:at + most + depth])
            held += len(slices[-1])
            if held >= most or len(slices) >= 1 << 15:
                yield owners, slices
                owners, slices, held = [], [], 0
    if slices:
        yield owners, slices


def gram_keys(slices: list[bytes], depth: int = DEPTH) -> np.ndarray:
    """For each byte of ``slices`` but the first ``depth``, one number: its context, latest byte first, and itself."""
    raw = np.frombuffer(b"".join(slices), np.uint8).astype(np.int64)
    keys = raw[depth:].copy()
    for d in range(1, depth + 1):
        keys |= raw[depth - d:len(raw) - d] << (8 * (depth - d + 1))
    ends = np.cumsum(np.fromiter(map(len, slices), np.int64, len(slices)))[:-1] - depth
    keep = np.ones(len(keys), bool)
    for d in range(depth):
        keep[ends + d] = False
    return keys[keep]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps up."""
    steps = np.ones_like(x)
    for i in range(8):
        steps *= x + i
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(steps)


def log_estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of ``n0`` zeros and ``n1`` ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple:
    """Distinct sorted keys with sums; ``keys`` are sorted."""
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[start], *[np.add.reduceat(v, start) if len(start) else v[:0] for v in values]


class Nodes:
    """Nodes of one depth and bit: sorted ids (context, bits so far), counts and log weighted probability."""

    def __init__(self, ids, n0, n1, below):
        self.ids, self.n0, self.n1, self.below = ids, n0, n1, below
        self.weighted = self.share = None

    def settle(self, deepest: bool) -> None:
        own = log_estimate(self.n0, self.n1)
        self.weighted = own if deepest else HALF + np.logaddexp(own, self.below)
        self.share = np.ones(len(own)) if deepest else np.exp(np.minimum(HALF + own - self.weighted, 0.0))


def straddling(depth: int, ends: list[int]) -> list[np.ndarray]:
    """For each depth the contexts of the strings ``ends``."""
    return [np.unique(np.array(ends, np.int64) >> (8 * (depth + 1 - d))) for d in range(depth + 1)]


def grow(keys: np.ndarray, counts: np.ndarray, shared: list[np.ndarray], known: dict | None = None, depth: int = DEPTH) -> list[list[Nodes]]:
    """The nodes [depth][bit] of sorted strings with positive counts.

    Nodes with a ``shared`` context are incomplete: their sums leave out shared children.
    With ``known`` (depth, bit -> ids, n0, n1, weighted, share of all ranges) they are replaced.
    """
    tree = [[None] * 8 for _ in range(depth + 1)]
    now, n = keys, counts.astype(np.float64)
    for d in range(depth, -1, -1):
        if d < depth:
            now = (now >> 16) << 8 | (now & 255)
            order = np.argsort(now, kind="stable")
            now, n = summed(now[order], n[order])
        for t in range(8):
            ids = (now >> 8) << 8 | 1 << t | (now & 255) >> (8 - t)
            ones = n * (now >> (7 - t) & 1)
            ids, total, ones = summed(ids, n, ones)
            below = np.zeros(len(ids))
            if d < depth:
                child = tree[d + 1][t]
                inner = ~np.isin(child.ids >> 8, shared[d + 1])
                parent = (child.ids[inner] >> 16) << 8 | (child.ids[inner] & 255)
                below = np.bincount(np.searchsorted(ids, parent), child.weighted[inner], len(ids)) if len(ids) else below
            node = Nodes(ids, total - ones, ones, below)
            node.settle(d == depth)
            if known is not None:
                inner = ~np.isin(ids >> 8, shared[d])
                other = known[d, t]
                order = np.argsort(np.concatenate([ids[inner], other[0]]), kind="stable")
                kept = Nodes(*[np.concatenate([a[inner], b])[order] for a, b in zip((ids, node.n0, node.n1), other[:3])], None)
                kept.weighted, kept.share = (np.concatenate([a[inner], b])[order] for a, b in zip((node.weighted, node.share), other[3:]))
                node = kept
            tree[d][t] = node
    return tree


def shared_nodes(rows: list[tuple], depth: int = DEPTH) -> dict:
    """From the ranges' sums (depth, id, n0, n1, below) the nodes (depth, bit) -> ids, n0, n1, weighted, share."""
    table = np.array(rows, np.float64).reshape(-1, 5)
    ids = np.array([r[1] for r in rows], np.int64)
    bits = np.frexp((ids & 255).astype(np.float64))[1] - 1
    out = {}
    for d in range(depth, -1, -1):
        for t in range(8):
            mine = np.flatnonzero((table[:, 0] == d) & (bits == t))
            mine = mine[np.argsort(ids[mine], kind="stable")]
            node = Nodes(ids[mine], table[mine, 2], table[mine, 3], table[mine, 4].copy())
            if d < depth and len(out[d + 1, t][0]):
                child = out[d + 1, t]
                np.add.at(node.below, np.searchsorted(node.ids, (child[0] >> 16) << 8 | (child[0] & 255)), child[3])
            node.settle(d == depth)
            out[d, t] = (node.ids, node.n0, node.n1, node.weighted, node.share)
    return out


def log2_of(keys: np.ndarray, tree: list[list[Nodes]], depth: int = DEPTH) -> np.ndarray:
    """Log2 probability of each string's last byte after the bytes before it."""
    total = np.zeros(len(keys))
    for t in range(8):
        bit = keys >> (7 - t) & 1
        symbol = 1 << t | (keys & 255) >> (8 - t)
        done, rest, value = np.zeros(len(keys)), np.ones(len(keys)), np.full(len(keys), 0.5)
        alive = np.arange(len(keys))
        for d in range(depth + 1):
            node = tree[d][t]
            if not len(node.ids) or not len(alive):
                break
            want = (keys[alive] >> (8 * (depth + 1 - d))) << 8 | symbol[alive]
            at = np.minimum(np.searchsorted(node.ids, want), len(node.ids) - 1)
            found = node.ids[at] == want
            alive, at = alive[found], at[found]
            n0, n1 = node.n0[at], node.n1[at]
            estimate = (np.where(bit[alive] == 1, n1, n0) + 0.5) / (n0 + n1 + 1.0)
            value[alive] = done[alive] + rest[alive] * estimate
            done[alive] += rest[alive] * node.share[at] * estimate
            rest[alive] *= 1.0 - node.share[at]
        total += np.log2(value)
    return total


def packed(values: np.ndarray, width: int = 8) -> bytes:
    """Whole numbers as planes of bytes, lowest first, which compress well when sorted or small."""
    return values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(data: bytes, width: int = 8) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<i8").astype(np.int64)


def chunks(batches: Iterator[pa.RecordBatch], most: int, part_bytes: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of a task's batches with the number of their chunk."""
    part, seq, held = TaskContext.get().partitionId(), 0, 0
    for whole in batches:
        for batch in text_parts(whole, part_bytes):
            yield part << 24 | seq, batch
            held += batch.column("text").nbytes
            if held >= most:
                seq, held = seq + 1, 0


class Wanted:
    """The distinct strings and words of a chunk with their training counts, in the order of their buckets."""

    def __init__(self, buckets: int, part_bytes: int = PART_BYTES):
        self.buckets, self.part_bytes, self.grams, self.words = buckets, part_bytes, [], {}

    def add(self, texts: list[bytes | None], learn: list[bool]) -> None:
        for train in (True, False):
            spelt = [spelled(t) for t, l in zip(texts, learn) if l == train]
            for words, _ in spelt:
                for w in words:
                    self.words[w] = self.words.get(w, 0) + train
            for _, slices in pieces([b for _, b in spelt], self.part_bytes):
                keys, n = np.unique(gram_keys(slices), return_counts=True)
                self.grams.append((keys, n if train else np.zeros(len(n), np.int64)))
        if sum(len(k) for k, _ in self.grams) > self.part_bytes:
            self.grams = [self.merged()]

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in self.grams] or [np.zeros(0, np.int64)])
        n = np.concatenate([c for _, c in self.grams] or [np.zeros(0, np.int64)])
        order = np.argsort(keys, kind="stable")
        return summed(keys[order], n[order])

    def gram_buckets(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        keys, n = self.merged()
        yield from self.dealt(mixed(keys.astype(np.uint64)), keys, n)

    def word_buckets(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        words = sorted(self.words)
        keys, n = np.empty(len(words), object), np.fromiter((self.words[w] for w in words), np.int64, len(words))
        keys[:] = words
        yield from self.dealt(word_codes(words), keys, n)

    def dealt(self, codes, keys, n):
        bucket = (codes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for b in range(self.buckets):
            some = order[edges[b]:edges[b + 1]]
            if len(some):
                yield b, keys[some], n[some]


#: bytes of a packed string
WIDTH = DEPTH + 1
ASKED = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWER = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("check", pa.int64()), ("values", pa.binary())])
ASKED_DDL, ANSWER_DDL = ("chunk long, kind int, bucket int, " + x for x in ("keys binary, counts binary", "check long, values binary"))
GRAMS, WORDS = 0, 1


def requests(docs: DataFrame, buckets: int, chunk_bytes: int, part_bytes: int) -> DataFrame:
    """``chunk, kind, bucket, keys, counts`` of ``docs`` (``text`` binary, ``learn``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def asked(chunk, wanted):
            rows = [(chunk, GRAMS, b, packed(k, WIDTH), packed(n)) for b, k, n in wanted.gram_buckets()]
            rows += [(chunk, WORDS, b, b" ".join(k), packed(n)) for b, k, n in wanted.word_buckets()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ASKED.types)], schema=ASKED)

        now, wanted = None, None
        for chunk, batch in chunks(batches, chunk_bytes, part_bytes):
            if chunk != now:
                if now is not None:
                    yield asked(now, wanted)
                now, wanted = chunk, Wanted(buckets, part_bytes)
            wanted.add(batch.column("text").to_pylist(), batch.column("learn").to_pylist())
        if now is not None:
            yield asked(now, wanted)

    return docs.select("text", "learn").mapInArrow(run, ASKED_DDL)


def word_answers(asked: DataFrame) -> DataFrame:
    """Training counts of the words of each request; a row without a chunk has a bucket's sum and number of trained words."""
    def bucket(table: pa.Table) -> pa.Table:
        counts: dict[bytes, int] = {}
        rows = list(zip(*[table.column(c).to_pylist() for c in ("chunk", "bucket", "keys", "counts")]))
        for _, _, keys, n in rows:
            for w, c in zip(keys.split(b" "), unpacked(n).tolist()):
                counts[w] = counts.get(w, 0) + c
        total = np.array([sum(counts.values()), sum(c > 0 for c in counts.values())])
        out = [(None, WORDS, rows[0][1], 0, packed(total))]
        for chunk, b, keys, _ in rows:
            out.append((chunk, WORDS, b, zlib.crc32(keys), packed(np.array([counts[w] for w in keys.split(b" ")]))))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), ANSWER.types)], schema=ANSWER)

    return asked.filter(F.col("kind") == WORDS).groupBy("bucket").applyInArrow(bucket, ANSWER_DDL)


def gram_counts(asked: DataFrame) -> DataFrame:
    """``bucket, gram, n``: every distinct string of the documents and how often training has it."""
    names = ["bucket", "gram", "n"]

    def bucket(table: pa.Table) -> pa.Table:
        keys = np.concatenate([unpacked(k, WIDTH) for k in table.column("keys").to_pylist()])
        n = np.concatenate([unpacked(k) for k in table.column("counts").to_pylist()])
        order = np.argsort(keys, kind="stable")
        keys, n = summed(keys[order], n[order])
        return pa.table([pa.array(np.full(len(keys), table.column("bucket")[0].as_py(), np.int32)), pa.array(keys), pa.array(n)], names)

    return asked.filter(F.col("kind") == GRAMS).groupBy("bucket").applyInArrow(bucket, "bucket int, gram long, n long")


def scored_grams(counts: DataFrame) -> DataFrame:
    """``bucket, gram, log2`` of all strings under the model that ``counts`` trains."""
    spark = counts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = written(counts.repartitionByRange(parts, "gram").withColumn("part", F.spark_partition_id()), "ranges")

    def trained(table: pa.Table) -> tuple:
        keys, n = (np.asarray(table.column(c)) for c in ("gram", "n"))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        return order, keys, keys[n > 0], n[n > 0], straddling(DEPTH, [int(keys[0]), int(keys[-1])])

    def partial(table: pa.Table) -> pa.Table:
        _, _, keys, n, shared = trained(table)
        rows = []
        for d, nodes in enumerate(grow(keys, n, shared)):
            for node in nodes:
                some = np.isin(node.ids >> 8, shared[d])
                rows.append((np.full(some.sum(), d), node.ids[some], node.n0[some], node.n1[some], node.below[some]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*rows)], ["depth", "id", "n0", "n1", "below"])

    said = ranges.groupBy("part").applyInArrow(partial, "depth long, id long, n0 double, n1 double, below double")
    # at most ranges x 2 x (depth + 1) contexts of at most 255 nodes
    rows = said.groupBy("depth", "id").agg(F.sum("n0"), F.sum("n1"), F.sum("below")).collect()
    known = spark.sparkContext.broadcast(shared_nodes([tuple(r) for r in rows]))

    def final(table: pa.Table) -> pa.Table:
        order, every, keys, n, shared = trained(table)
        ours = {}
        for (d, t), node in known.value.items():
            some = np.isin(node[0] >> 8, shared[d])
            ours[d, t] = tuple(a[some] for a in node)
        buckets = pa.array(np.asarray(table.column("bucket"))[order])
        return pa.table([buckets, pa.array(every), pa.array(log2_of(every, grow(keys, n, shared, ours)))], ["bucket", "gram", "log2"])

    return ranges.groupBy("part").applyInArrow(final, "bucket int, gram long, log2 double")


def gram_answers(asked: DataFrame, scored: DataFrame) -> DataFrame:
    def bucket(table: pa.Table, known: pa.Table) -> pa.Table:
        grams, log2 = (np.asarray(known.column(c)) for c in ("gram", "log2"))
        order = np.argsort(grams)
        grams, log2 = grams[order], log2[order]
        out = []
        for chunk, b, keys in zip(*[table.column(c).to_pylist() for c in ("chunk", "bucket", "keys")]):
            out.append((chunk, GRAMS, b, zlib.crc32(keys), log2[np.searchsorted(grams, unpacked(keys, WIDTH))].tobytes()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), ANSWER.types)], schema=ANSWER)

    return asked.filter(F.col("kind") == GRAMS).groupBy("bucket").cogroup(scored.groupBy("bucket")).applyInArrow(bucket, ANSWER_DDL)


class Answers:
    """What a chunk was told, checked against what its documents ask."""

    def __init__(self, table: pa.Table):
        self.told = {(k, b): (c, v) for k, b, c, v in zip(*[table.column(x).to_pylist() for x in ("kind", "bucket", "check", "values")])}

    def to(self, kind: int, bucket: int, keys: bytes) -> bytes:
        check, values = self.told.get((kind, bucket), (None, b""))
        if check != zlib.crc32(keys):
            raise ValueError("the documents were not the same when they were read again")
        return values


RESULT = ("doc_id {}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double")


def score(docs: DataFrame, learn: Column, text_col: str = "text", id_col: str = "doc_id", chunk_bytes: int = CHUNK_BYTES,
          part_bytes: int = PART_BYTES) -> DataFrame:
    """Score every text of ``docs`` by the model that the rows with ``learn`` train.

    Result for each row: ``doc_id, held_out`` (does not learn)``, n_tokens`` (words and one end)``, n_known`` (tokens
    seen in training)``, train_tokens, base_score`` (log10 under add-0.1 word counts)``, score`` (log10 of the
    byte model)``, n_bytes`` and ``bits_per_byte``, its code length.

    Nulls and blanks are the end alone.  A null ``learn`` counts as false.  Repeated rows are learned as often as they
    come and score the same.  Other columns are ignored, whatever their names; an empty table gives an
    empty one.  ``docs`` is read twice and must give the same rows, as a table does; otherwise the job fails.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = written(requests(rows, buckets, chunk_bytes, part_bytes), "requests")
    words = written(word_answers(asked), "word-counts")
    totals = [unpacked(bytes(r["values"])) for r in words.filter(F.col("chunk").isNull()).select("values").collect()]  # one row a bucket
    ends = rows.filter("learn").count()
    n, distinct = (int(sum(t[i] for t in totals)) + x for i, x in enumerate((ends, int(ends > 0))))
    grams = gram_answers(asked, written(scored_grams(written(gram_counts(asked), "grams")), "log-probabilities"))
    answers = words.filter(F.col("chunk").isNotNull()).unionByName(grams)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, batch in chunks(batches, chunk_bytes, part_bytes):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, chunk))], [*batch.schema.names, "chunk"])

    def judge(table: pa.Table, told: pa.Table) -> pa.Table:
        answers, wanted = Answers(told), Wanted(buckets, part_bytes)
        texts, learned = table.column("text").to_pylist(), table.column("learn").to_pylist()
        for at in range(0, len(texts), 1 << 10):
            wanted.add(texts[at:at + (1 << 10)], learned[at:at + (1 << 10)])
        known: dict[bytes, int] = {}
        for b, keys, _ in wanted.word_buckets():
            known.update(zip(keys, unpacked(answers.to(WORDS, b, b" ".join(keys))).tolist()))
        wanted.words.clear()
        some = [(keys, np.frombuffer(answers.to(GRAMS, b, packed(keys, WIDTH)))) for b, keys, _ in wanted.gram_buckets()]
        keys, log2 = (np.concatenate(x) for x in zip(*some))
        del answers, wanted, some
        order = np.argsort(keys)
        keys, log2 = keys[order], log2[order]
        bits, size, tokens, seen, base = np.zeros(len(texts)), [], [], [], []
        for start in range(0, len(texts), 1 << 10):
            spelt = [spelled(t) for t in texts[start:start + (1 << 10)]]
            for owner, slices in pieces([b for _, b in spelt], part_bytes):
                # sorted with the text's place in the low bits, each string is looked up once
                numbers = np.repeat(np.arange(len(slices)), [len(s) - DEPTH for s in slices])
                both = np.sort(gram_keys(slices).astype(np.uint64) << np.uint64(15) | numbers.astype(np.uint64))
                grams = (both >> np.uint64(15)).astype(np.int64)
                first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
                value = np.repeat(log2[np.searchsorted(keys, grams[first])], np.diff(np.append(first, len(grams))))
                np.add.at(bits, start + np.array(owner), np.bincount((both & np.uint64(0x7FFF)).astype(np.int64), value, len(slices)))
            for found, spell in spelt:
                counts = np.fromiter((known[w] for w in found), np.float64, len(found))
                counts = np.append(counts, ends)
                size.append(len(spell))
                tokens.append(len(counts))
                seen.append(int((counts > 0).sum()))
                base.append(float(np.log10((counts + 0.1) / (n + 0.1 * (distinct + 1))).sum()))
        return pa.table([table.column("doc_id"), pa.array([not l for l in learned]), pa.array(tokens, pa.int64()), pa.array(seen, pa.int64()), pa.array([n] * len(texts), pa.int64()),
                         pa.array(base, pa.float64()), pa.array(bits * np.log10(2)), pa.array(size, pa.int64()), pa.array(-bits / np.array(size))],
                        [x.split()[0] for x in RESULT.split(", ")])

    return rows.mapInArrow(number, f"doc_id {id_type}, text binary, learn boolean, chunk long").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        judge, RESULT.format(id_type))


def op12_context_tree(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 != 0)
