"""Small tables with the awkward cases, and brute-force versions of operators."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def variant(rng: random.Random, times: int, base=BASE) -> str:
    words = (base * 3)[:60]
    for _ in range(times):
        words[rng.randrange(len(words))] = f"other{rng.randrange(10_000)}"
    return " ".join(words)


def edge_rows() -> list[tuple]:
    """(doc_id, text, lang, source): nulls, blanks, repeats, a very long text, near copies."""
    rng = random.Random(3)
    rows = [
        (1, "One plain text about nothing in particular.", "en", "a"), (1, "One plain text about nothing in particular.", "en", "a"),
        (1, "The same id with another text.", None, "b"), (2, None, "en", None), (3, "", "de", "b"), (4, " \n\t ", None, "c"),
        (None, "no id here at all", "en", "c"), (None, None, None, None), (5, "12 345 !!! ...", "fr", "a"), (6, LONG, "en", "a"),
        (7, "two words", "en", "b"), (8, "Two Words", "en", "b"), (9, "two words", "en", "b"), (10, "Été à \U0001f600 İstanbul ẞ", "fr", "d"),
    ]
    rows += [(100 + i, variant(rng, rng.randrange(4)), "en", "hot") for i in range(60)]
    rows += [(200 + i, variant(rng, 0), "en", "hot") for i in range(30)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"
#: names that the operators use inside, as columns of the input
CLASHES = ["u", "k", "n", "c", "h", "size", "shard", "slot", "rank", "level", "_h", "_k", "_r", "_size", "_row", "_text", "_gone", "start", "target", "row", "met", "role"]


def edge_docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows(), SCHEMA)
    return df.withColumns({c: F.lit(f"mine {c}") for c in CLASHES}).repartition(3)


def words(text: str | None) -> list[bytes]:
    return WORD.findall(bytes(text or "", "utf8").lower())


def shingles(text: str | None) -> set:
    w = words(text)
    return {tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


class Groups:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def jaccard_components(rows: list[tuple]) -> list[tuple]:
    """(doc_id, n_shingles, component_id) by comparing all sets that share a shingle."""
    sets, lists, groups = [shingles(t) for _, t in rows], {}, Groups(len(rows))
    for i, s in enumerate(sets):
        for x in s:
            lists.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in lists[x] if j < i).items():
            if 100 * both >= 85 * (len(s) + len(sets[j]) - both):
                groups.join(i, j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = groups.root(i)
            ids[r] = min(ids.get(r, d), d)
    return [(d, len(sets[i]), ids.get(groups.root(i), d)) for i, (d, _) in enumerate(rows)]


def kept_lines(rows: list[tuple], least: int = 50) -> dict:
    """(id, text) -> (lines, deleted, checksum of what stays) for distinct rows."""
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    lines = [[] if t is None else t.encode().split(b"\n") for _, t in order]
    bare = [[x.strip() for x in l] for l in lines]
    first, gone = {}, [set() for _ in lines]
    for i, l in enumerate(bare):
        for p in range(len(l)):
            total, e = 0, p
            while e < len(l) and total < least:
                total += len(l[e].split())
                e += 1
            if total < least:
                continue
            key = tuple(l[p:e])
            if key not in first:
                first[key] = (i, p)
                continue
            j, q = first[key]
            n = e - p
            while p + n < len(l) and q + n < len(bare[j]) and l[p + n] == bare[j][q + n]:
                n += 1
            gone[i].update(range(p, p + n))
    out = {}
    for i, r in enumerate(order):
        left = b"\n".join(x for p, x in enumerate(lines[i]) if p not in gone[i])
        out[r] = (len(lines[i]), len(gone[i]), None if r[1] is None else zlib.crc32(left))
    return out
