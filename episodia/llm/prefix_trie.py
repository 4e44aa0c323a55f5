"""The trie of shared conversation beginnings, over sorted shards and a skeleton.

A conversation is the sequence of its turns' digests.  Sequences are sorted and cut
into ranges; copies of one sequence are cut by their id.  A node that more than one
range holds is a beginning of some range's first sequence, a splitter.  The splitters' trie,
the skeleton, goes to all tasks: a range finishes every other node by itself and gives
partial sums for skeleton nodes, which are added up by node and then from the deepest up.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5, sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodia.session import written

#: bytes of a turn's digest
TURN = 16
LOCAL, PARTIAL, ENDS = 0, 1, 2
#: characters of a list of ids in one row
PIECE = 1 << 20
#: what a range says: finished nodes, partial sums and ids that end at skeleton nodes
SAID = ("kind int, node string, parent string, part int, piece int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long, bytes long, ends string")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: for each id the turns in order as (digest of role and text, bytes of the text)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turn = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"), turn.alias("digest"),
                                                               F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    out = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return out.select("conv_id", F.transform("ts", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))


def with_shared_starts(rows: DataFrame, most: int = 8, family: int = 5) -> DataFrame:
    """Each conversation behind the first turns of its family's first one.

    The family of ``c`` starts with ``c - c % family``; ``crc32(c) % (most + 1)`` turns of that one
    replace as many of its own.
    """
    head = rows.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("first"), F.slice("turns", 1, most).alias("head"))
    joined = rows.join(head, F.col("conv_id") - F.col("conv_id") % family == F.col("first"), "left")
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")
    nothing = F.slice("turns", 1, 0)
    own = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("head", nothing), F.lit(1), h), own).alias("turns"))


def shard_nodes(part: int, rows: list[tuple], first: bytes, following: bytes | None, piece: int = PIECE) -> list[tuple]:
    """The trie of one range's sorted (path, conv_id, bytes of each turn) as rows of ``SAID``.

    Nodes come in the order of their paths, so a node's children have larger
    numbers and one walk backwards adds everything up.
    """
    up, path, size, ends, skeleton = [-1], [b""], [0], [[]], [True]
    open_nodes, last = [0], b""
    for key, conv_id, sizes in rows:
        depth, most = 0, min(len(open_nodes) - 1, len(sizes))
        if key == last:
            depth = most
        else:
            while depth < most and key[depth * TURN:(depth + 1) * TURN] == last[depth * TURN:(depth + 1) * TURN]:
                depth += 1
        del open_nodes[depth + 1:]
        for d in range(depth + 1, len(sizes) + 1):
            start = key[:d * TURN]
            up.append(open_nodes[-1])
            path.append(start)
            size.append(sizes[d - 1])
            ends.append([])
            skeleton.append(skeleton[open_nodes[-1]] and (first.startswith(start) or (following is not None and following.startswith(start))))
            open_nodes.append(len(up) - 1)
        ends[open_nodes[-1]].append(conv_id)
        last = key
    n = len(up)
    convs, least = [len(e) for e in ends], [min(e, default=None) for e in ends]
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        p = up[i]
        if not skeleton[i]:
            leaves[i] = leaves[i] or 1
            saved[i] += (convs[i] - 1) * size[i]
        if p >= 0:
            convs[p] += convs[i]
            least[p] = least[i] if least[p] is None else min(least[p], least[i])
            if not skeleton[i]:
                children[p] += 1
                leaves[p] += leaves[i]
                saved[p] += saved[i]
    out = []
    for i in range(n):
        p, ids = up[i], ",".join(map(str, ends[i]))
        depth = len(path[i]) // TURN
        numbers = (convs[i], children[i], leaves[i], saved[i], size[i])
        above = md5(path[p]).hexdigest() if p >= 0 and skeleton[p] else None
        if skeleton[i]:
            name = md5(path[i]).hexdigest()
            out.append((PARTIAL, name, above, part, 0, depth, least[i], None, *numbers, None))
            out += [(ENDS, name, None, part, k, depth, *[None] * 7, ids[at:at + piece]) for k, at in enumerate(range(0, len(ids), piece))]
        else:
            out.append((LOCAL, None, above, part, 0, depth, least[i], None if above else least[p], *numbers, sha256(ids.encode()).hexdigest()))
    return out


def skeleton_sums(partial: DataFrame) -> list[tuple]:
    """Nodes of the skeleton with what all ranges say of them: at most ranges x longest splitter."""
    sums = partial.groupBy("node").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.min("bytes").alias("bytes"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]).collect()
    nodes = {r["node"]: r.asDict() for r in sums}
    for r in sorted(nodes.values(), key=lambda r: -r["depth"]):
        r["n_leaves"] = r["n_leaves"] or 1  # children that are skeleton nodes were added before
        r["saved_tokens"] += (r["n_convs"] - 1) * r["bytes"]
        if r["parent"] is not None:
            above = nodes[r["parent"]]
            above["n_children"] += 1
            above["n_leaves"] += r["n_leaves"]
            above["saved_tokens"] += r["saved_tokens"]
    return [(k, r["conv_id"], r["depth"], nodes[r["parent"]]["conv_id"] if r["parent"] is not None else None, r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"])
            for k, r in nodes.items()]


def ends_digests(pieces: DataFrame) -> DataFrame:
    """SHA-256 of each skeleton node's ids, joined by commas; a task reads one list in pieces as they come."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for node, piece, text in zip(*[batch.column(c).to_pylist() for c in ("node", "piece", "ends")]):
                if node != now:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = node, sha256()
                elif piece == 0:
                    state.update(b",")  # the next range's first piece
                state.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in range(2)], ["node", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    spread = pieces.select("node", "part", "piece", "ends").repartition("node").sortWithinPartitions("node", "part", "piece")
    return spread.mapInArrow(run, "node string, ends_sha256 string")


def prefix_trie(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """The nodes of the trie of ``turns`` (arrays of digest, bytes) of ``conv_id`` (distinct, not null).

    One row for each distinct beginning, the empty one included if there is a row at
    all: ``conv_id`` (the smallest with that beginning), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves`` and ``saved_tokens`` (below and at the node; each node's bytes once
    for each conversation but one), ``ends_sha256`` of the ids that end there.

    Equal sequences may be any share of the rows.  One conversation's digests and sizes
    (24 bytes a turn) must fit into a task.
    """
    spark = rows.sparkSession
    hexes = F.array_join(F.col("turns.digest"), "")
    keyed = written(rows.select("conv_id", F.unhex(hexes).alias("path"), F.col("turns.bytes").alias("sizes")), "paths")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(keyed.repartitionByRange(parts, "path", "conv_id").withColumn("part", F.spark_partition_id()), "ranges")
    starts = dealt.groupBy("part").agg(F.min("path").alias("path")).orderBy("part").collect()  # one row a range
    first = {r["part"]: bytes(r["path"]) for r in starts}
    following = {a["part"]: bytes(b["path"]) for a, b in zip(starts, starts[1:])}
    skeleton = spark.sparkContext.broadcast((first, following))
    schema = pa.schema([(f.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[f.split()[1]]) for f in SAID.split(", ")])

    def shard(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        ours = sorted(zip(*[table.column(c).to_pylist() for c in ("path", "conv_id", "sizes")]))
        starts_at, next_at = skeleton.value
        said = shard_nodes(part, ours, starts_at[part], next_at.get(part), piece)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*said), schema.types)], schema=schema)

    said = written(dealt.groupBy("part").applyInArrow(shard, SAID), "shards")
    numbers = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    sums = spark.createDataFrame(skeleton_sums(said.filter(F.col("kind") == PARTIAL)), "node string, " + ", ".join(f"{c} long" for c in numbers))
    digests = ends_digests(said.filter(F.col("kind") == ENDS)).withColumnRenamed("node", "of")
    none = F.lit(sha256(b"").hexdigest())
    upper = sums.join(digests, F.col("node") == F.col("of"), "left").select(*numbers, F.coalesce("ends_sha256", none).alias("ends_sha256"))
    named = F.broadcast(sums.select(F.col("node").alias("of"), F.col("conv_id").alias("above")))  # the skeleton, bounded as in skeleton_sums
    lower = said.filter(F.col("kind") == LOCAL).join(named, F.col("parent") == F.col("of"), "left")
    lower = lower.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).select(*numbers, F.col("ends").alias("ends_sha256"))
    return lower.unionByName(upper).select(*COLUMNS)


def conversation_trie(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """The trie of the rebuilt ``conversations`` (``conv_id, turn, role, text``).

    Turns are ordered by number, null first; equal numbers by the digest of role and text.
    Null roles and texts are empty; rows without an id belong to no conversation.  Repeated
    rows are turns of their own.  Other columns are ignored; an empty table gives an empty one.
    """
    return prefix_trie(with_shared_starts(turns(conversations.select("conv_id", "turn", "role", "text"))), piece)


def op13_splitter_skeleton(spark, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


CRC32 = """
xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, [ascii(c)::bigint for c in string_split(conv_id::varchar, '')]), lambda a, b:
  list_reduce(list_prepend(xor(a, b), [0, 1, 2, 3, 4, 5, 6, 7]), lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::bigint ELSE 0 END))))
"""

OP13_SQL = f"""
WITH given AS (
  SELECT conv_id, turn, strlen(coalesce(text, '')) AS bytes, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL
), t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS pos FROM given
), c AS (
  SELECT conv_id, {CRC32} % 9 AS h FROM (SELECT DISTINCT conv_id FROM given)
), rebuilt AS (
  SELECT c.conv_id, t.pos, t.digest, t.bytes FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.pos < c.h
  UNION ALL
  SELECT c.conv_id, t.pos, t.digest, t.bytes FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h
), members AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS key, bytes FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
  UNION ALL
  SELECT conv_id, 0, '', 0 FROM c
), nodes AS (
  SELECT key, depth, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs FROM members GROUP BY key, depth
), ends AS (
  SELECT m.key, string_agg(m.conv_id::varchar, ',' ORDER BY m.conv_id) AS ids FROM members m
  JOIN (SELECT conv_id, max(depth) AS depth FROM members GROUP BY conv_id) USING (conv_id, depth) GROUP BY m.key
), children AS (
  SELECT left(key, 32 * (depth - 1)::integer) AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), below AS (
  SELECT left(n.key, 32 * d.depth) AS key, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved
  FROM nodes n LEFT JOIN children k USING (key), LATERAL (SELECT unnest(range(n.depth + 1))::integer AS depth) d GROUP BY 1
)
SELECT n.conv_id, n.depth::bigint AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, b.n_leaves, b.saved::bigint AS saved_tokens,
  sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN below b USING (key) LEFT JOIN children k USING (key) LEFT JOIN ends e USING (key)
LEFT JOIN nodes p ON n.depth > 0 AND p.key = left(n.key, 32 * (n.depth - 1)::integer)
"""
