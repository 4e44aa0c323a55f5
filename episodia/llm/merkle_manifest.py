"""A manifest of a dataset as hash trees, with a version of the tree for each changed leaf.

Leaves are put in order and cut into aligned blocks of ``2 ** HEIGHT``; a task holds one
block at a time.  Roots of blocks are the leaves of the next level's blocks, so
levels above are tables again, each a thousandth of the one below.  From the top
down every block learns its siblings on the way to the root.

Inside a block the tree is persistent: changing a leaf copies its ancestors and
shares every other node with the versions before.  Above the block a version goes
on along the siblings of its block, which no version changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodia.llm.numbering import numbered
from episodia.session import written

#: levels of a block; a block has 2 ** HEIGHT leaves
HEIGHT = 10
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*texts: str) -> str:
    return sha256("".join(texts).encode()).hexdigest()


class VersionedTree:
    """Nodes as rows (digest, left, right) that are only ever added.

    ``right`` is -1 where a run has one node.  ``height`` goes on hashing lone
    nodes up to that level; by default the tree ends with its first single node.
    """

    def __init__(self, leaves: list[str], height: int = 0):
        self.digests, self.left, self.right = list(leaves), [-1] * len(leaves), [-1] * len(leaves)
        level, self.height = list(range(len(leaves))), 0
        while len(level) > 1 or self.height < height:
            level = [self.node(a, b) for a, b in zip(level[::2], level[1::2] + [-1] * (len(level) % 2))]
            self.height += 1
        self.root = level[0]

    def node(self, left: int, right: int) -> int:
        self.left.append(left)
        self.right.append(right)
        self.digests.append(digest(self.digests[left], self.digests[right] if right >= 0 else ""))
        return len(self.digests) - 1

    def path(self, at: int, root: int | None = None) -> tuple[list[int], list[tuple[int, bool]]]:
        """Nodes from the root to the leaf ``at``, and beside each but the root its sibling and whether that is left."""
        now = self.root if root is None else root
        nodes, beside = [now], []
        for level in range(self.height - 1, -1, -1):
            right = at >> level & 1
            beside.append((self.left[now], True) if right else (self.right[now], False))
            now = self.right[now] if right else self.left[now]
            nodes.append(now)
        return nodes, beside

    def changed(self, at: int, leaf: str, root: int | None = None) -> tuple[int, list[int]]:
        """The root of a version with another leaf, and its new nodes from the leaf up."""
        _, beside = self.path(at, root)
        self.digests.append(leaf)
        self.left.append(-1)
        self.right.append(-1)
        now = len(self.digests) - 1
        copies = [now]
        for other, on_left in reversed(beside):
            now = self.node(other, now) if on_left else self.node(now, other)
            copies.append(now)
        return now, copies

    def steps(self, at: int) -> list[str]:
        """Siblings from the leaf up: ``<`` or ``>`` and the digest; blank where there is none."""
        return ["" if other < 0 else ("<" if on_left else ">") + self.digests[other] for other, on_left in reversed(self.path(at)[1])]


def climbed(start: str, steps: list[str]) -> list[str]:
    """Digests from ``start`` along the siblings, one for each step."""
    out = []
    for step in steps:
        start = digest(step[1:], start) if step[:1] == "<" else digest(start, step[1:])
        out.append(start)
    return out


def block_tree(leaves: list[str], block: int, height: int) -> VersionedTree:
    """Only a first block that is not full can be a whole tree; others go up all levels."""
    return VersionedTree(leaves, height if block else 0)


def in_blocks(nodes: DataFrame, label: str, height: int) -> DataFrame:
    """Nodes (``tree``, ``place``, ``node``, a struct) as rows ``tree, block, nodes``."""
    at = F.struct((F.col("place") % (1 << height)).alias("at"), F.col("node"))
    rows = nodes.groupBy("tree", F.shiftright("place", height).alias("block")).agg(F.array_sort(F.collect_list(at)).alias("nodes"))
    return written(rows.withColumn("nodes", F.col("nodes.node")), label)


def block_roots(blocks: DataFrame, height: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [block_tree(leaves, block, height) for leaves, block in zip(batch.column("hashes").to_pylist(), batch.column("block").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("block"), pa.array([t.digests[t.root] for t in trees], pa.string())],
                                             ["tree", "block", "hash"])

    return blocks.select("tree", "block", F.col("nodes.hash").alias("hashes")).mapInArrow(run, "tree string, block long, hash string")


def levels_of(nodes: DataFrame, label: str, height: int) -> tuple[list[DataFrame], DataFrame]:
    """The tables of blocks from the leaves up, and the root of each tree (``tree``, ``hash``)."""
    levels = []
    while True:
        levels.append(in_blocks(nodes, f"{label}-{len(levels)}", height))
        roots = written(block_roots(levels[-1], height), f"{label}-roots")
        if not roots.agg(F.max("block")).first()[0]:
            return levels, roots.select("tree", "hash")
        nodes = roots.select("tree", F.col("block").alias("place"), F.struct("hash").alias("node"))


def passed_down(blocks: DataFrame, paths: DataFrame, height: int) -> DataFrame:
    """``tree, place, name, hash, subroot, root, above`` of all nodes, from what their blocks know.

    Nodes of the tree of trees have a name; they are subroots themselves.
    """
    named = "name" in blocks.schema["nodes"].dataType.elementType.names
    rows = blocks.select("tree", "block", F.col("nodes.hash").alias("hashes"), (F.col("nodes.name") if named else F.lit(None).cast("array<string>")).alias("names"))
    rows = rows.join(paths, ["tree", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree, n = block_tree(row["hashes"], row["block"], height), len(row["hashes"])
                yield pa.RecordBatch.from_pydict({
                    "tree": [row["tree"]] * n, "place": [(row["block"] << height) + i for i in range(n)], "name": row["names"] or [None] * n, "hash": row["hashes"],
                    "subroot": [row["subroot"]] * n, "root": [row["root"]] * n, "above": [tree.steps(i) + row["above"] for i in range(n)],
                }, schema=pa.schema([("tree", pa.string()), ("place", pa.int64()), ("name", pa.string()), ("hash", pa.string()),
                                     ("subroot", pa.string()), ("root", pa.string()), ("above", pa.list_(pa.string()))]))

    return rows.mapInArrow(run, "tree string, place long, name string, hash string, subroot string, root string, above array<string>")


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def manifest(docs: DataFrame, changes: dict[str, Column], where: Column, fields: list[str] | None = None,
             id_col: str = "doc_id", tree_col: str = "lang", height: int = HEIGHT) -> DataFrame:
    """Proofs of all rows of ``docs`` and the versions in which a row is changed.

    A leaf hashes the ``fields``, each with its length.  Every value of ``tree_col`` has a
    tree over its rows in order of ``id_col`` (nulls first, equal ids by leaf), and the roots of the trees
    (null first, by UTF-8) have a tree in turn.  ``changes`` replaces columns in rows
    that fulfil ``where``; where the leaf then differs, a version is made.

    Result: ``doc_id, leaf, changed`` (the other leaf or null)``, subroot, root, siblings``
    (from the leaf up, ``<`` or ``>`` for the side; blank: none)``, copies`` (digests of
    the nodes that the version adds, leaf first; null without a version) and
    ``folded_root``, the root recomputed from the changed or given leaf and the siblings.

    Repeated rows are leaves of their own.  Empty texts and nulls differ.  Other
    columns are ignored, whatever their names; an empty table gives an empty one.
    """
    fields = fields or FIELDS
    leaf = leaf_hash([F.col(c) for c in fields])
    other = F.when(where, leaf_hash([changes.get(c, F.col(c)) for c in fields]))
    rows = docs.select(F.coalesce(F.concat(F.lit("="), F.col(tree_col)), F.lit("")).alias("tree"), F.col(id_col).alias("doc_id"), leaf.alias("hash"), other.alias("other"))
    rows = written(rows.withColumn("other", F.when(F.col("other") != F.col("hash"), F.col("other"))), "leaves")
    placed = numbered(rows, "tree", ["doc_id", "hash"], "leaf-order")
    lower, subroots = levels_of(placed.select("tree", "place", F.struct("hash", "doc_id", "other").alias("node")), "leaf-blocks", height)
    top = numbered(subroots.select(F.lit("").alias("all"), "tree", "hash"), "all", ["tree"], "tree-order")
    upper, root = levels_of(top.select(F.col("all").alias("tree"), "place", F.struct("hash", F.col("tree").alias("name")).alias("node")), "tree-blocks", height)

    block = F.col("place").alias("block")
    paths = root.select("tree", F.lit(0).cast("long").alias("block"), F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root"),
                        F.array().cast("array<string>").alias("above"))
    for blocks in reversed(upper):
        nodes = passed_down(blocks, paths, height)
        paths = nodes.select("tree", block, "subroot", "root", "above")
    # the node of a tree is the root of its topmost block
    paths = nodes.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("block"), F.col("hash").alias("subroot"), "root", "above")
    for blocks in reversed(lower[1:]):
        paths = passed_down(blocks, paths, height).select("tree", block, "subroot", "root", "above")
    return proofs(lower[0].join(paths, ["tree", "block"]), docs.schema[id_col].dataType, height)


def proofs(blocks: DataFrame, id_type, height: int) -> DataFrame:
    """One row for each leaf of blocks that know the siblings ``above`` them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).select(["block", "hashes", "others", "subroot", "root", "above"]).to_pylist()[0]
                tree, n = block_tree(row["hashes"], row["block"], height), len(row["hashes"])
                siblings, copies, folded = [], [], []
                for at, (leaf, other) in enumerate(zip(row["hashes"], row["others"])):
                    siblings.append(tree.steps(at) + row["above"])
                    if other is None:
                        copies.append(None)
                        folded.append(([leaf] + climbed(leaf, siblings[-1]))[-1])
                    else:
                        version, new = tree.changed(at, other)
                        new = [tree.digests[k] for k in new]
                        copies.append(new + climbed(tree.digests[version], row["above"]))
                        folded.append(copies[-1][-1])
                arrays = [batch.column("ids").slice(i, 1).flatten(), row["hashes"], row["others"], [row["subroot"]] * n, [row["root"]] * n, siblings, copies, folded]
                kinds = [None, *[pa.string()] * 4, pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
                yield pa.RecordBatch.from_arrays([a if k is None else pa.array(a, k) for a, k in zip(arrays, kinds)],
                                                 ["doc_id", "leaf", "changed", "subroot", "root", "siblings", "copies", "folded_root"])

    rows = blocks.select("block", "subroot", "root", "above", F.col("nodes.hash").alias("hashes"), F.col("nodes.other").alias("others"), F.col("nodes.doc_id").alias("ids"))
    return rows.mapInArrow(run, f"doc_id {id_type.simpleString()}, leaf string, changed string, subroot string, root string, "
                                "siblings array<string>, copies array<string>, folded_root string")


def tampering(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The manifest of ``docs`` and what its proofs say of rows whose ``n_chars`` is one too large."""
    due = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    # beyond 64 bits the sum is a decimal, so the largest number overflows nothing
    rows = manifest(docs, {"n_chars": F.col("n_chars").cast("decimal(38,0)") + 1}, due, height=height)
    text = F.array_join(F.transform("siblings", lambda s: F.substring(s, 2, 64)), "")
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(text, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
                       F.size(F.coalesce("copies", F.array())).alias("n_copied"))


def op11_path_copying(spark, sf_dir: str) -> DataFrame:
    return tampering(spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS))


#: checksum of an id's decimal text, bit by bit
CRC32 = """
list_reduce(list_prepend(4294967295::bigint, [ascii(c)::bigint for c in string_split(doc_id::varchar, '')]), lambda a, b:
  list_reduce(list_prepend(xor(a, b), [0, 1, 2, 3, 4, 5, 6, 7]), lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::bigint ELSE 0 END)))
"""

OP11_SQL = f"""
WITH RECURSIVE fields AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, n_chars, xor({CRC32}, 4294967295::bigint) % 7 = 0 AS due,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id::varchar, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents
), leaves AS (
  SELECT tree, doc_id, sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN due AND n_chars IS NOT NULL THEN sha256(head || strlen((n_chars::hugeint + 1)::varchar) || ':' || (n_chars::hugeint + 1)::varchar || tail) END AS other FROM fields
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves
), low AS (
  SELECT tree, 0 AS level, place, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT tree, level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), max((n + 1) // 2) FROM low WHERE n > 1 GROUP BY tree, level, place // 2
), subroots AS (
  SELECT tree, level AS height, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS number FROM low WHERE n = 1
), high AS (
  SELECT 0 AS level, number AS place, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), max((n + 1) // 2) FROM high WHERE n > 1 GROUP BY level, place // 2
), steps AS (
  SELECT p.tree, p.place, k.level, coalesce(s.h, '') AS h, (p.place >> k.level) % 2 = 1 AS on_left
  FROM placed p JOIN subroots r USING (tree), LATERAL (SELECT unnest(range(r.height)) AS level) k
  LEFT JOIN low s ON s.tree = p.tree AND s.level = k.level AND s.place = xor(p.place >> k.level, 1)
  UNION ALL
  SELECT p.tree, p.place, 1000 + k.level, coalesce(s.h, ''), (r.number >> k.level) % 2 = 1
  FROM placed p JOIN subroots r USING (tree), LATERAL (SELECT unnest(range((SELECT max(level) FROM high))) AS level) k
  LEFT JOIN high s ON s.level = k.level AND s.place = xor(r.number >> k.level, 1)
), ways AS (
  SELECT tree, place, list(struct_pack(h := h, l := on_left) ORDER BY level) AS way, string_agg(h, '' ORDER BY level) AS proof FROM steps GROUP BY tree, place
), climb AS (
  SELECT tree, place, coalesce(way, []) AS way, 0 AS pos, coalesce(other, leaf) AS h FROM placed LEFT JOIN ways USING (tree, place)
  UNION ALL
  SELECT tree, place, way, pos + 1, sha256(CASE WHEN way[pos + 1].l THEN way[pos + 1].h || h ELSE h || way[pos + 1].h END) FROM climb WHERE pos < len(way)
)
SELECT p.doc_id, p.leaf, r.subroot, top.h AS root, sha256(coalesce(w.proof, '')) AS proof_sha256, c.h AS folded_root, c.h = top.h AS verified,
  CASE WHEN p.other IS NULL OR p.other = p.leaf THEN 0 ELSE len(c.way) + 1 END::integer AS n_copied
FROM placed p JOIN subroots r USING (tree) JOIN climb c ON c.tree = p.tree AND c.place = p.place AND c.pos = len(c.way)
LEFT JOIN ways w ON w.tree = p.tree AND w.place = p.place CROSS JOIN (SELECT h FROM high WHERE n = 1) top
"""
