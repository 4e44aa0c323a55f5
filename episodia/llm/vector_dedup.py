"""Near-duplicate vectors by product quantisation over inverted lists.

A coarse quantiser deals unit vectors to inverted lists; what is left after
subtracting a list's centre is coded by one code word in each of several
subspaces.  Every vector searches the lists of its nearest centres: squared
distances come from look-up tables (the query is not coded), and since the coding
error of each vector is stored, the triangle inequality tells which candidates
can still be near enough.  These are compared by exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodia.llm.graph import components
from episodia.llm.splitters import unit_hash
from episodia.session import durable, written

COSINE = 0.9
LISTS, PROBES, SUBSPACES, CODES = 256, 16, 8, 256
#: vectors (expected) that the quantisers are fitted on; every vector is indexed
TRAIN, ROUNDS = 16_384, 12
#: members and queries that meet in one task
MEMBERS, QUERIES, STEP = 4096, 16_384, 512


def unit(vectors: list, dim: int) -> np.ndarray:
    """Vectors scaled to length one and padded with zeros to ``dim`` numbers."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        v = np.asarray(v, np.float64)
        v = v / np.abs(v).max()
        out[i, :len(v)] = v / np.sqrt((v * v).sum())
    return out


def nearest(points: np.ndarray, centres: np.ndarray, k: int = 1) -> np.ndarray:
    """Indices of the ``k`` nearest centres, the nearest first."""
    d = (centres * centres).sum(1) - 2 * points @ centres.T
    if k == 1:
        return d.argmin(1)[:, None]
    part = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(centres) else np.tile(np.arange(len(centres)), (len(points), 1))
    return np.take_along_axis(part, np.take_along_axis(d, part, 1).argsort(1, kind="stable"), 1)


def k_means(points: np.ndarray, k: int, rng) -> np.ndarray:
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(ROUNDS):
        own = nearest(points, centres)[:, 0]
        many = np.bincount(own, minlength=len(centres))
        total = np.stack([np.bincount(own, points[:, j], len(centres)) for j in range(points.shape[1])], 1)
        centres[many > 0] = total[many > 0] / many[many > 0, None]
        if (many == 0).any():
            centres[many == 0] = points[rng.choice(len(points), int((many == 0).sum()))]
    return centres


@dataclass
class Quantiser:
    coarse: np.ndarray
    books: np.ndarray  # subspace, code, place

    def code(self, points: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and coding errors (distances) of points in their lists."""
        rest = points - self.coarse[own]
        width = self.books.shape[2]
        codes, error = np.empty((len(points), len(self.books)), np.uint8), np.zeros(len(points))
        for s, book in enumerate(self.books):
            part = rest[:, s * width:(s + 1) * width]
            codes[:, s] = nearest(part, book)[:, 0]
            error += ((part - book[codes[:, s]]) ** 2).sum(1)
        return codes, np.sqrt(error)


def fit(points: np.ndarray, seed: int = 5) -> Quantiser:
    rng = np.random.default_rng(seed)
    coarse = k_means(points, LISTS, rng)
    rest = points - coarse[nearest(points, coarse)[:, 0]]
    width = points.shape[1] // SUBSPACES
    books = np.zeros((SUBSPACES, CODES, width))
    for s in range(SUBSPACES):
        book = k_means(rest[:, s * width:(s + 1) * width], CODES, rng)
        books[s] = book[np.arange(CODES) % len(book)]
    return Quantiser(coarse, books)


def _encoder(sent, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Quantiser = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("embedding")
            points = unit([x.values.to_numpy(zero_copy_only=False) for x in column], dim)
            probes = nearest(points, model.coarse, min(PROBES, len(model.coarse)))
            codes, error = model.code(points, probes[:, 0])
            yield pa.RecordBatch.from_arrays([
                batch.column("u"), batch.column("n"), pa.array([len(x) for x in column], pa.int32()), pa.array([p.tobytes() for p in points], pa.binary()),
                pa.array(probes[:, 0], pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(probes.tolist(), pa.list_(pa.int32()))],
                ["u", "n", "dim", "point", "list", "code", "error", "probes"])

    return run


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index linked to each of ``n`` nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _searcher(sent, dim: int):
    """Queries against the members of one block of a list.

    Gives for each vector the number of linked vectors, and one edge to the
    smallest vector of its group in this block (links themselves stay here).
    A link is counted for its member's side too where the member does not
    probe the query's list and so would miss it.
    """
    near = np.sqrt(2 - 2 * COSINE)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        model: Quantiser = sent.value
        own, asks = pdf[pdf["role"] == 0].sort_values("u"), pdf[pdf["role"] == 1].sort_values("u")
        if not len(own) or not len(asks):
            return pd.DataFrame({"u": np.empty(0, np.int64), "links": np.empty(0, np.int64), "to": np.empty(0, np.int64)})
        here = int(own["at"].iloc[0])
        points, targets = (np.frombuffer(b"".join(x["point"]), np.float64).reshape(-1, dim) for x in (asks, own))
        codes = np.frombuffer(b"".join(own["code"]), np.uint8).reshape(len(own), -1)
        bound = near + own["error"].to_numpy() + 1e-9
        width = model.books.shape[2]
        q_id, t_id = asks["u"].to_numpy(), own["u"].to_numpy()
        q_n, t_n, q_home = asks["n"].to_numpy(), own["n"].to_numpy(), asks["list"].to_numpy()
        q_dim, t_dim = asks["dim"].to_numpy(), own["dim"].to_numpy()
        probed = np.zeros((len(own), len(model.coarse)), bool)
        for i, p in enumerate(own["probes"]):
            probed[i, p] = True
        ids = np.union1d(q_id, t_id)
        links, left, right = np.zeros(len(ids), np.int64), [], []
        q_at, t_at = np.searchsorted(ids, q_id), np.searchsorted(ids, t_id)
        for i in range(0, len(asks), STEP):
            part = points[i:i + STEP]
            rest = part - model.coarse[here]
            squared = np.zeros((len(part), len(own)))
            for s, book in enumerate(model.books):
                r = rest[:, s * width:(s + 1) * width]
                table = (r * r).sum(1)[:, None] - 2 * r @ book.T + (book * book).sum(1)
                squared += table[:, codes[:, s]]
            may = np.sqrt(np.maximum(squared, 0)) <= bound
            some = np.flatnonzero(may.any(0))
            exact = part @ targets[some].T
            a, b = np.nonzero(may[:, some] & (exact >= COSINE) & (q_id[i:i + STEP, None] != t_id[some]) & (q_dim[i:i + STEP, None] == t_dim[some]))
            a, b = a + i, some[b]
            np.add.at(links, q_at[a], t_n[b])
            missed = ~probed[b, q_home[a]]
            np.add.at(links, t_at[b[missed]], q_n[a[missed]])
            label = _labels(len(ids), q_at[a], t_at[b])  # a forest stands for the links of this step
            moved = np.flatnonzero(label != np.arange(len(ids)))
            left.append(moved)
            right.append(label[moved])
        label = _labels(len(ids), np.concatenate(left), np.concatenate(right)) if left else np.arange(len(ids))
        out = np.flatnonzero((links > 0) | (label != np.arange(len(ids))))
        return pd.DataFrame({"u": ids[out], "links": links[out], "to": ids[label[out]]})

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every vector.

    Vectors link when their cosine is at least 0.9.  Equal vectors are searched
    once and counted as often as they come.  Vectors that are null, empty or
    zero, or hold null or non-finite numbers, link with nothing, nor do vectors
    of different lengths.  ``component_id`` is the smallest id reachable over
    links (null ids are passed over).  Other columns are ignored; an empty table
    gives an empty one.
    """
    spark = vectors.sparkSession
    v = F.col("embedding")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    bad = v.isNull() | (F.size(v) == 0) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | F.forall(v, lambda x: x == 0)
    rows = written(rows.withColumns({"u": F.monotonically_increasing_id(), "good": ~F.coalesce(bad, F.lit(True))}), "vectors")
    # hot copies are summed before the shuffle; the text of the numbers is the key
    key = F.sha2(F.concat_ws(",", v.cast("array<string>")), 256)
    good = rows.filter("good").withColumn("k", key)
    distinct = written(good.groupBy("k").agg(F.min("u").alias("u"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding")), "distinct")
    size = distinct.agg(F.max(F.size("embedding")), F.count(F.lit(1))).first()
    none = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not size[1]:
        return none
    dim = -(-size[0] // SUBSPACES) * SUBSPACES
    sample = [r["embedding"] for r in distinct.filter(unit_hash("u") < TRAIN / size[1]).orderBy("u").select("embedding").collect()]
    sample = sample or [r["embedding"] for r in distinct.orderBy("u").limit(1).collect()]
    sent = spark.sparkContext.broadcast(fit(unit(sample, dim)))  # centres and code books only
    coded = written(distinct.select("u", "n", "embedding").mapInArrow(
        _encoder(sent, dim), "u long, n long, dim int, point binary, list int, code binary, error double, probes array<int>"), "codes")
    members = coded.groupBy(F.col("list").alias("at")).agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("nt"))
    asked = coded.select(F.explode("probes").alias("at")).groupBy("at").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("nq"))
    blocks = F.broadcast(members.join(asked, "at"))  # one row for each list
    some = F.xxhash64("u")
    def to(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = coded.withColumn("at", F.col("list")).join(blocks, "at").withColumns({"role": F.lit(0), "tb": F.pmod(some, F.col("nt"))}).select("*", to("nq").alias("qb"))
    asks = coded.withColumn("at", F.explode("probes")).join(blocks, "at").withColumns({"role": F.lit(1), "qb": F.pmod(some, F.col("nq"))}).select("*", to("nt").alias("tb"))
    columns = ["at", "tb", "qb", "role", "u", "n", "dim", "point", "list", "code", "error", "probes"]
    none_b = F.lit(None).cast("binary")
    asks = asks.withColumns({"code": none_b, "probes": F.lit(None).cast("array<int>")})
    found = durable(own.select(columns).unionByName(asks.select(columns)).groupBy("at", "tb", "qb").applyInPandas(_searcher(sent, dim), "u long, links long, to long"))
    links = found.groupBy("u").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("u").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "u")
    classes = distinct.select("k", "u", "n").join(links, "u", "left").join(roots, "u", "left").select(
        "k", "u", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "u").alias("root"))
    each = good.select("vec_id", "k").join(classes, "k")
    least = each.groupBy("root").agg(F.min("vec_id").alias("least"))
    each = each.join(least, "root").select("vec_id", "n_links", F.coalesce("least", "vec_id").alias("component_id"))
    rest = rows.filter("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return each.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_product_quantisation(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
