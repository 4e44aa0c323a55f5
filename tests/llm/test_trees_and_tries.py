"""Manifest, context-tree model and conversation trie against brute-force versions and on awkward rows."""

import math
import random
import sys
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import groupby
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import edge_tables as T  # noqa: E402


def empty(df):
    return df.filter("1 = 0")


def crc(v):
    return zlib.crc32(str(v).encode())


# manifest

def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def folded(nodes):
    """Root and, for each node, its siblings from the bottom up as (digest, is left)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, k in enumerate(at):
            other = k ^ 1
            paths[i].append((level[other], other < k) if other < len(level) else ("", False))
        at = [k // 2 for k in at]
        level = [H(*level[i:i + 2]) for i in range(0, len(level), 2)]
    return level[0], paths


def manifest_by_hand(rows):
    leaf = lambda r: H(*[field(v) for v in r])
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in order:
        ours = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((ours, *folded([leaf(r) for r in ours])))
    root, upper = folded([t[1] for t in trees])
    out = []
    for (ours, subroot, paths), above in zip(trees, upper):
        for r, path in zip(ours, paths):
            steps = path + above
            now = r
            if r[0] is not None and crc(r[0]) % 7 == 0 and r[3] is not None:
                now = (*r[:3], r[3] + 1, r[4])
            value = leaf(now)
            for other, left in steps:
                value = H(other, value) if left else H(value, other)
            out.append((r[0], leaf(r), subroot, root, H(*[s for s, _ in steps]), value, value == root))
    return out


@pytest.mark.parametrize("height", [10, 2])
def test_manifest_equals_the_tree_by_hand(spark, height):
    """With blocks of four leaves, trees have several levels of blocks."""
    from episodia.llm import merkle_manifest as M

    rng = random.Random(5)
    rows = [(d, s, l, None if t is None else len(t), t) for d, t, l, s in T.edge_rows()]
    rows += [(1000 + i, "s", rng.choice(["aa", "Ä", "z", "hot", "hot"]), 5, "x" * (i % 7)) for i in range(90)]
    rows += [(77, "s", "hot", 9223372036854775807, "top")] * 3 + [(4, None, None, None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df = df.withColumns({c: F.lit("mine") for c in ("tree", "place", "block", "node", "hash", "other", "all", "_salt", "_part")}).repartition(5)
    got = sorted(map(str, (tuple(r)[:7] for r in M.tampering(df, height).collect())))
    assert got == sorted(map(str, manifest_by_hand(rows)))


def test_manifest_of_one_row_and_of_none(spark):
    from episodia.llm.merkle_manifest import tampering

    one = [(7, "s", "en", 3, "abc")]
    df = spark.createDataFrame(one, "doc_id long, source string, lang string, n_chars long, text string")
    assert [tuple(r)[:7] for r in tampering(df).collect()] == manifest_by_hand(one)
    assert tampering(empty(df)).count() == 0


def test_versions_share_all_nodes_but_the_ancestors():
    from episodia.llm.merkle_manifest import VersionedTree

    tree = VersionedTree([H(str(i)) for i in range(11)])
    before, nodes = tree.digests[tree.root], len(tree.digests)
    second, copies = tree.changed(6, "other")
    third, more = tree.changed(10, "last", second)
    assert len(copies) == len(more) == tree.height + 1 and len(tree.digests) == nodes + len(copies) + len(more)
    leaves = [H(str(i)) for i in range(11)]
    assert before == folded(leaves)[0] == tree.digests[tree.root]
    leaves[6] = "other"
    assert tree.digests[second] == folded(leaves)[0]
    leaves[10] = "last"
    assert tree.digests[third] == folded(leaves)[0]


# context-tree weighting

def weighted_model(texts, depth):
    """The model written down plainly: counts in dictionaries, weights by recursion."""
    counts, children = defaultdict(lambda: [0, 0]), defaultdict(set)
    for text in texts:
        raw = b"\n" * depth + text
        for i in range(depth, len(raw)):
            for t in range(8):
                j = 1 << t | raw[i] >> (8 - t)
                for d in range(depth + 1):
                    counts[raw[i - d:i], j][raw[i] >> (7 - t) & 1] += 1
                    if d:
                        children[raw[i - d + 1:i], j].add(raw[i - d:i])

    def own(c, j):
        a, b = counts[c, j]
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    memo = {}

    def weighted(c, j):
        if (c, j) not in memo:
            p = own(c, j)
            if len(c) < depth:
                q = sum(weighted(k, j) for k in children[c, j])
                m = max(p, q)
                p = math.log(.5) + m + math.log(math.exp(p - m) + math.exp(q - m))
            memo[c, j] = p
        return memo[c, j]

    def estimate(raw, i, d, j, bit):
        c = raw[i - d:i]
        if (c, j) not in counts:
            return None
        k = (counts[c, j][bit] + .5) / (sum(counts[c, j]) + 1)
        deeper = estimate(raw, i, d + 1, j, bit) if d < depth else None
        if deeper is None:
            return k
        share = math.exp(math.log(.5) + own(c, j) - weighted(c, j))
        return share * k + (1 - share) * deeper

    def log10(text):
        raw, total = b"\n" * depth + text, 0.0
        for i in range(depth, len(raw)):
            for t in range(8):
                p = estimate(raw, i, 0, 1 << t | raw[i] >> (8 - t), raw[i] >> (7 - t) & 1)
                total += math.log10(.5 if p is None else p)
        return total

    return log10


@pytest.fixture(scope="module")
def scored_edges(spark):
    from episodia.llm import context_tree as C

    rows = T.edge_rows() + [(300 + i, "the thing " * (i % 5) + "İ\x00 \x85end", "en", "b") for i in range(20)]
    df = spark.createDataFrame(rows, T.SCHEMA).withColumns({c: F.lit("mine") for c in ("chunk", "kind", "bucket", "keys", "counts", "learn", "score", "gram")}).repartition(4)
    learn = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 != 0
    return rows, C.score(df, learn).collect()


def test_scores_equal_the_model_written_plainly(scored_edges):
    from episodia.llm import context_tree as C

    rows, got = scored_edges
    spell = lambda t: C.spelled(None if t is None else t.encode())
    held = lambda d: crc("" if d is None else d) % 10 == 0
    # the very long text stays out of the plain model's scoring, not out of its training
    train = [spell(t) for d, t, *_ in rows if not held(d)]
    model = weighted_model([b for _, b in train], C.DEPTH)
    words = Counter(w for ws, _ in train for w in ws)
    n, v = sum(words.values()) + len(train), len(words) + 1
    base = lambda c: math.log10((c + .1) / (n + .1 * (v + 1)))
    want = {}
    for d, t, *_ in rows:
        ws, b = spell(t)
        counts = [words[w] for w in ws] + [len(train)]
        want[d, len(b), len(ws)] = (held(d), len(counts), sum(c > 0 for c in counts), n, sum(map(base, counts)), model(b) if len(b) < 10_000 else None)
    assert len(got) == len(rows) and any(r["held_out"] for r in got)
    for r in got:
        h, k, known, total, b, s = want[r["doc_id"], r["n_bytes"], r["n_tokens"] - 1]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, k, known, total)
        assert math.isclose(r["base_score"], b, rel_tol=1e-9)
        assert s is None or math.isclose(r["score"], s, rel_tol=1e-8)
        assert math.isclose(r["bits_per_byte"], -r["score"] / math.log10(2) / r["n_bytes"])


def test_chunks_and_slices_change_no_score(spark, scored_edges):
    from episodia.llm import context_tree as C

    rows, before = scored_edges
    df = spark.createDataFrame(rows, T.SCHEMA).repartition(2)
    again = C.score(df, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 != 0, chunk_bytes=3000, part_bytes=501).collect()
    key = lambda r: (str(r["doc_id"]), r["n_bytes"], r["n_tokens"])
    for a, b in zip(sorted(before, key=key), sorted(again, key=key)):
        assert key(a) == key(b) and math.isclose(a["score"], b["score"], rel_tol=1e-9) and math.isclose(a["base_score"], b["base_score"], rel_tol=1e-9)


def test_probabilities_of_all_next_bytes_sum_to_one():
    from episodia.llm import context_tree as C

    keys, n = np.unique(C.gram_keys([b"\n" * C.DEPTH + b"abracadabra abracadabra \n"]), return_counts=True)
    tree = C.grow(keys, n, [np.zeros(0, np.int64)] * (C.DEPTH + 1))
    for context in (keys[0] >> 8, keys[5] >> 8, 0x6162636465, 0):
        every = (np.int64(context) << 8) | np.arange(256)
        assert math.isclose(float((2 ** C.log2_of(every, tree)).sum()), 1.0, rel_tol=1e-9)


def test_nothing_to_learn_from_and_no_rows(spark):
    from episodia.llm import context_tree as C

    df = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in C.score(df, F.lit(False)).collect()}
    assert got[2]["score"] == pytest.approx(8 * math.log10(.5)) and got[1]["base_score"] == 0.0 and got[1]["n_known"] == 0
    assert C.score(empty(df), F.lit(True)).count() == 0


def test_held_out_texts_are_shorter_than_under_word_counts(spark, small):
    from episodia.llm import context_tree as C

    rows = [r for r in C.op12_context_tree(spark, small.replace("sf0.001", "sf0.01")).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


# conversation trie

def trie_by_hand(rows):
    talks = defaultdict(list)
    digest = lambda r: __import__("hashlib").md5(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest()
    for r in rows:
        if r[0] is not None:
            talks[r[0]].append(r)
    seqs = {c: [(r[2] or "", r[3] or "") for r in sorted(t, key=lambda r: (r[1] is not None, r[1] or 0, digest(r)))] for c, t in talks.items()}
    rebuilt = {c: tuple(seqs.get(c - c % 5, [])[:crc(c) % 9] + s[crc(c) % 9:]) for c, s in seqs.items()}
    members = defaultdict(list)
    for c, s in sorted(rebuilt.items()):
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[:len(p)] == p]
        leaves = [q for q in below if not any(len(o) == len(q) + 1 and o[:-1] == q for o in members)]
        ends = ",".join(str(c) for c in m if rebuilt[c] == p)
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), sum(len(q) == len(p) + 1 for q in below), len(leaves),
                    sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q), sha256(ends.encode()).hexdigest()))
    return out


def talk_rows():
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", None]), rng.choice(["a", "ü", "", None, "bb"])) for c in range(60) for t in range(rng.randrange(1, 6))]
    rows += [(100 + c, t, "user", f"same {t}") for c in range(80) for t in range(3)]  # one large group of copies
    rows += [(300, t, "user", f"long {t}") for t in range(400)] + [(301, t, "user", f"long {t}") for t in range(400)]
    rows += [(400, None, "user", "no number"), (400, 1, "a", "x"), (400, 1, "a", "x"), (400, 1, "b", "y"), (None, 1, "user", "nobody"), (403, 0, "user", "short")]
    return rows


@pytest.mark.parametrize("partitions", [1, 4, 60])
def test_trie_equals_all_prefixes_by_hand(spark, partitions):
    from episodia.llm import prefix_trie as P

    rows = talk_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("mine") for c in ("path", "sizes", "part", "node", "depth", "turns")}).repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = P.conversation_trie(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, trie_by_hand(rows)))


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    from episodia.llm import prefix_trie as P

    df = spark.createDataFrame([(c, 0, "u", "t") for c in (1, 2, 3)], "conv_id long, turn long, role string, text string")
    assert sorted(map(str, map(tuple, P.conversation_trie(df).collect()))) == sorted(map(str, trie_by_hand([tuple(r) for r in df.collect()])))
    assert P.conversation_trie(empty(df)).count() == 0


def test_ids_that_end_at_a_node_come_in_pieces(spark):
    from episodia.llm import prefix_trie as P

    rows = [(1000 + 5 * c, 0, "u", "t") for c in range(50)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(str, map(tuple, P.conversation_trie(df, piece=7).collect()))) == sorted(map(str, trie_by_hand(rows)))


def test_no_window_or_group_holds_the_copies(spark):
    """Sorted shards hold about equal shares of one conversation's copies."""
    from episodia.llm import prefix_trie as P

    rows = [(5 * c, t, "u", f"t{t}") for c in range(400) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    sizes = [len(list(g)) for _, g in groupby(sorted(r["part"] for r in P.with_shared_starts(P.turns(df)).select(
        F.unhex(F.array_join(F.col("turns.digest"), "")).alias("path"), "conv_id").repartitionByRange(8, "path", "conv_id").select(F.spark_partition_id().alias("part")).collect()))]
    assert len(sizes) >= 6 and max(sizes) < 150
