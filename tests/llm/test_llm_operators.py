"""Each operator against a brute-force version and on awkward rows."""

import math
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import edge_tables as T  # noqa: E402

VOCABULARY = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return T.edge_docs(spark).cache()


def empty(df):
    return df.filter("1 = 0")


# language

def test_languages_are_learned_and_switches_are_seen(spark):
    from episodia.llm import language_id as L

    rng = random.Random(1)
    parts = {"xx": ["thon", "ther", "ande", "ingly", "owth"], "yy": ["schun", "eitz", "ungü", "keitz", "achen"]}
    word = {k: (lambda v=v: rng.choice(v) + rng.choice(v)) for k, v in parts.items()}
    rows = [(i, " ".join(word[l]() for _ in range(60)), l) for i in range(300) for l in [("xx", "yy")[i % 2]]]
    half = " ".join(word["xx"]() for _ in range(30)) + " " + " ".join(word["yy"]() for _ in range(90))
    rows += [(1000, half, None), (1001, None, "xx"), (1002, "12 !!", "xx"), (1003, "", None), (None, "thonther", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("mine"))
    got = {r["doc_id"]: r for r in L.identify(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["lang_pred"] == l for i, _, l in rows[:300])
    assert got[1000]["lang_pred"] == "yy" and 0.6 < got[1000]["score"] < 0.9 and got[1000]["n_switches"] >= 1
    assert [got[i]["lang_pred"] for i in (1001, 1002, 1003)] == ["und"] * 3 and got[1001]["score"] == 0.0
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(300))
    assert L.identify(empty(df)).count() == 0
    assert L.keep_identified(df).columns == df.columns and L.keep_identified(df).count() == len(rows) - 3


def test_forward_backward_sums_all_paths():
    from itertools import product

    from episodia.llm.language_id import forward_backward

    rng = np.random.default_rng(0)
    lens, k = np.array([3, 0, 1, 4]), 3
    scores, trans, start = rng.normal(size=(8, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    got, pairs = forward_backward(scores, lens, trans, start, pairs=True)
    want, want_pairs, at = np.zeros((8, k)), np.zeros((k, k)), 0
    for n in lens:
        if n:
            weight = {p: math.exp(start[p[0]] + sum(scores[at + t, y] for t, y in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:]))) for p in product(range(k), repeat=int(n))}
            total = sum(weight.values())
            for p, w in weight.items():
                for t, y in enumerate(p):
                    want[at + t, y] += w / total
                for a, b in zip(p, p[1:]):
                    want_pairs[a, b] += w / total
        at += n
    assert np.allclose(got, want, atol=1e-4) and np.allclose(pairs, want_pairs, atol=1e-3)


# n-gram join

def test_ngram_components_equal_brute_force(spark, docs):
    from episodia.llm import ngram_join as N

    rows = [(r[0], r[1]) for r in T.edge_rows()]
    got = Counter(tuple(r) for r in N.ngram_components(docs).collect())
    assert got == Counter(T.jaccard_components(rows))
    assert N.ngram_components(empty(docs)).count() == 0
    kept = N.keep_one_of_each(docs)
    want = {(c if d is not None else None, n) for d, n, c in T.jaccard_components(rows)}
    assert kept.columns == docs.columns
    blank = len({r for r in rows if not T.shingles(r[1])})
    linked = len({c for d, n, c in T.jaccard_components(rows) if n and d is not None}) + 1  # ids 1 and 1 differ in text
    assert kept.count() == blank + linked + 1 and want


def test_ngram_components_of_many_near_copies(spark, monkeypatch):
    from episodia.llm import ngram_join as N

    rng, rows = random.Random(5), []
    for i in range(400):
        rows.append((i, T.variant(rng, rng.randrange(9))))
    common = " ".join(f"passage{i}" for i in range(30))
    rows += [(1000 + i, common + " " + " ".join(f"own{i}y{j}" for j in range(rng.randrange(3, 40)))) for i in range(200)]
    monkeypatch.setattr(N, "BLOCK", 50)  # several blocks for one family
    got = sorted(tuple(r) for r in N.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(T.jaccard_components(rows))


def test_search_counts_like_sets():
    from episodia.llm.ngram_join import occurrences, search

    rng = np.random.default_rng(2)
    for _ in range(30):
        common = rng.choice(4000, 300, replace=False).astype(np.uint64)
        sets = [np.unique(np.concatenate([rng.choice(common, 280, replace=False), rng.integers(5000, 9000, rng.integers(0, 60)).astype(np.uint64)])) for _ in range(60)]
        sizes, lists = np.array([len(s) for s in sets]), occurrences(sets)
        q = sets[0]
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 85 * len(np.union1d(q, s))]
        assert search(q, lists, sizes).tolist() == want


# decontamination

def test_leaks_verbatim_and_with_other_values(spark):
    from episodia.llm import decontamination as D

    item = "Yesterday afternoon Alice bought 12 red apples and 30 kg of flour for the bakery, then gave 12 apples to Bob before she walked home."
    other = "Completely different words make this question stand apart from every single other one in here today."
    fill = "some words before it that nobody asked about. "
    same = item.replace("Alice", "Carol").replace("Bob", "David").replace("12", "45").replace("30", "7")
    broken = item.replace("12 red", "45 red").replace("30", "7")  # 12 turns into 45 once and stays 12 once
    bench = spark.createDataFrame([(1, item), (2, other), (3, other), (4, None), (5, "")], "item_id long, text string")
    rows = [(1, fill + item + " and after"), (2, fill + same), (3, fill + broken), (4, item.upper()), (5, None), (6, ""), (7, fill * 5), (8, other), (None, other), (8, other), (9, "the of and")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "form", "h", "item")})
    got = {(r["doc_id"], r["item_id"]): r for r in D.leaks(df, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (4, 1), (8, 2), (None, 2)}
    assert got[1, 1]["verbatim"] and got[1, 1]["coverage"] == 1.0 and not got[2, 1]["verbatim"]
    assert D.leaks(empty(df), bench).count() == 0 and D.leaks(df, empty(bench)).count() == 0
    left = D.drop_leaks(df, bench)
    assert left.columns == df.columns and sorted(r[0] for r in left.select("doc_id").collect()) == [3, 5, 6, 7, 9]


def test_leaks_find_every_benchmark_passage(spark, small):
    from episodia.llm.decontamination import op2_template_windows

    items = spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()
    texts = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    want = {(d, i) for d, t in texts for i, x in items if x in (t or "")}
    assert {(r[0], r[1]) for r in op2_template_windows(spark, small).collect()} == want


def test_leaks_count_a_repeated_window_once(spark):
    from episodia.llm import decontamination as D

    words = [f"w{chr(97 + i)}x" for i in range(16)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    line = "\n".join(" ".join(words[:8] + [f"own{chr(97 + i)}", "thing"]) for i in range(6))  # one of nine windows, six times
    df = spark.createDataFrame([(1, line), (2, " ".join(words))], "doc_id long, text string")
    assert [(r["doc_id"], r["coverage"]) for r in D.leaks(df, bench).collect()] == [(2, 1.0)]


def test_leaks_with_equal_or_half_changed_values(spark):
    from episodia.llm import decontamination as D

    text = "the farmer carried {} apples and then {} pears over to the market where nobody wanted any of them today"
    tail = " while the old baker with {} loaves watched from a window across the square and did not say one word about it"
    bench = spark.createDataFrame([(1, text.format(3, 5)), (2, tail.format(12) + text.format(12, 9))], "item_id long, text string")
    rows = [(1, text.format(4, 4)), (2, tail.format(12) + text.format(13, 9))]
    got = {(r["doc_id"], r["item_id"]): r for r in D.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert (1, 1) in got and got[1, 1]["coverage"] == 1.0  # 3 and 5 both turn into 4
    assert (2, 2) in got and not got[2, 2]["verbatim"]  # one of two 12 became 13


def test_leaks_of_short_numeric_long_and_named_items(spark):
    from episodia.llm import decontamination as D

    letters = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    long = [f"w{letters(i)}" for i in range(500)]
    names = "Tom has 5 apples. Tom buys 9 pears. Tom eats 2 plums."
    items = [(1, "which river crosses the old town?"), (2, "12 45 7 kg 88 3 cm 91 14 62"), (3, " ".join(long)), (4, names), (5, "What is 17 + 25?")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    fill = "and now for something that is not in any list at all, namely "
    rows = [(1, fill + items[0][1] + " nobody knows"), (2, fill + items[1][1] + " as said"), (3, fill + " ".join(long[150:350]) + " " + fill), (4, fill + "this. " + names.replace("Tom", "Eve")), (5, fill + items[4][1]),
            (6, fill + "12 45 7 kg 88 9 cm 33 14 62"), (7, fill + "What is 18 + 25?"), (8, fill + " ".join(long[150:190])), (9, fill)]
    got = {(r["doc_id"], r["item_id"]): r for r in D.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert set(got) == {(i, i) for i in range(1, 6)}
    assert got[1, 1]["coverage"] == 1.0 and 0.3 < got[3, 3]["coverage"] < 0.5 and not got[4, 4]["verbatim"]


# mixing

def test_mix_reaches_targets(spark, docs):
    from episodia.llm import mixing as M

    rows = M.mix(docs).select("doc_id", "source", "_mix.*", F.col("size").alias("mine")).collect()
    assert len(rows) == len(T.edge_rows()) and all(r["mine"] == "mine size" for r in rows)
    by, size = defaultdict(list), {}
    for r in rows:
        by[r["source"]].append(r)
    total = sum(len(T.words(t)) for _, t, *_ in T.edge_rows())
    assert math.isclose(sum(v[0]["target"] for v in by.values()), total, rel_tol=1e-9)
    for s, v in by.items():
        size[s] = sum(r["size"] for r in v)
        assert v[0]["source_size"] == size[s] and v[0]["target"] <= 3 * size[s] + 1e-6
        assert all(r["taken"] == r["copies"] * r["size"] and r["copies"] <= 3 for r in v)
        largest = max(Counter((r["doc_id"]) for r in v for _ in range(1)).values()) * max(r["size"] for r in v)
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= largest / 2 + 1
    assert rows and sorted(map(str, rows)) == sorted(map(str, M.mix(docs).select("doc_id", "source", "_mix.*", F.col("size").alias("mine")).collect()))
    assert M.mix(empty(docs)).count() == 0
    assert M.mixed_rows(docs).columns == docs.columns and M.mixed_rows(docs).count() == sum(r["copies"] for r in rows)


# toxicity

def test_network_gradient_and_windows():
    from episodia.llm import toxicity as X

    rng = np.random.default_rng(1)
    w = {k: v.astype(np.float64) for k, v in X.initial(5, 1).items()}
    mask = np.ones((6, 3), bool)
    mask[4:, 1] = False
    x, y = rng.normal(size=(6, 3, X.INPUTS)), np.array([1.0, 0.0, 1.0])

    def loss(w):
        logit = X.read([x @ w["xf"] + w["cf"], x @ w["xb"] + w["cb"]], mask, w)
        return float((np.logaddexp(0, logit) - y * logit).sum())

    logit, kept = X.read([x @ w["xf"] + w["cf"], x @ w["xb"] + w["cb"]], mask, w, keep=True)
    d, _ = X.slopes((X.sigmoid(logit) - y), kept, x, mask, w)
    for k in ("xf", "hb", "cf", "a", "v", "o", "z"):
        at = tuple(0 for _ in w[k].shape)
        w[k][at] += 1e-3
        up = loss(w)
        w[k][at] -= 2e-3
        down = loss(w)
        w[k][at] += 1e-3
        assert abs((up - down) / 2e-3 - d[k][at]) < 2e-3 + 0.02 * abs(d[k][at]), k
    for n in (0, 1, 47, 48, 49, 84, 85, 500):
        starts = X.starts_of(n)
        covered = {p for s in starts for p in range(s, min(n, s + X.WINDOW))}
        assert covered == set(range(n)) and (n <= X.WINDOW or starts[-1] == n - X.WINDOW)


def test_toxicity_learns_words_and_spellings(spark):
    from episodia.llm import toxicity as X

    rng = random.Random(4)
    plain = lambda n: [rng.choice("abcdefgh") * 2 + rng.choice("ijklmn") + rng.choice("opqrs") + rng.choice("tuvw") for _ in range(n)]
    rows, labels = [], []
    for i in range(900):
        w = plain(rng.randrange(20, 150))
        bad = i % 4 == 0
        if bad:
            w[rng.randrange(len(w))] = "zyxqu" + rng.choice(["a", "en", "isch", "ot", "uz"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(2000, None), (2001, ""), (2002, "77 !"), (2003, " ".join(plain(20_000) + ["zyxquon"] + plain(5_000))), (None, "aaipt"), (2000, None)]
    labels += [(1, 0), (3000, 1), (None, 1), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("mine"))
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = X.toxicity(df, marks).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    held = [i for i in range(900) if by[i]["held_out"]]
    assert np.mean([by[i]["predicted"] == (i % 4 == 0) for i in held]) > 0.95
    assert by[2003]["predicted"] == 1 and by[2000]["score"] == by[2001]["score"] == by[2002]["score"] == 0.0
    assert X.toxicity(empty(df), marks).count() == 0
    assert {r["score"] for r in X.toxicity(df, empty(marks)).collect()} == {0.0}


# vectors

def test_vectors_link_like_brute_force(spark, monkeypatch):
    from episodia.llm import vector_dedup as V

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 20))
    data = [(int(i), [float(x) for x in (centres[i % 40] + 0.25 * rng.normal(size=20)).astype(np.float32)]) for i in range(900)]
    data += [(2000 + i, data[3][1]) for i in range(30)]
    data += [(3000, None), (3001, []), (3002, [0.0] * 20), (3003, [1.0, None] + [0.0] * 18), (3004, [float("nan")] * 20), (3005, [float("inf")] * 20), (3006, [3.0]), (3007, [4.0]), (None, data[5][1]), (3, data[3][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumns({c: F.lit(0) for c in ("n", "list", "code", "label")})
    monkeypatch.setattr(V, "MEMBERS", 16)
    monkeypatch.setattr(V, "QUERIES", 64)
    got = V.near_vectors(df).collect()
    assert len(got) == len(data)
    good = [i for i, (_, v) in enumerate(data) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, groups = np.zeros(len(data), int), T.Groups(len(data))
    for a in good:
        for b in good:
            if a < b and len(data[a][1]) == len(data[b][1]):
                x, y = np.array(data[a][1]), np.array(data[b][1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                    links[a] += 1
                    links[b] += 1
                    groups.join(a, b)
    ids = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            r = groups.root(i)
            ids[r] = min(ids.get(r, d), d)
    want = Counter((d, int(links[i]), ids.get(groups.root(i), d)) for i, (d, _) in enumerate(data))
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert V.near_vectors(empty(df)).count() == 0


def test_vector_recall_on_the_table(spark, small):
    from episodia.llm.vector_dedup import op6_product_quantisation

    rows = sorted((r[0], r[1]) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect())
    v = np.array([r[1] for r in rows], float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    want = (v @ v.T >= 0.9).sum() - len(v)
    got = sum(r["n_links"] for r in op6_product_quantisation(spark, small).collect())
    assert 0.9 * want <= got <= want


# shards

def test_shards_are_even_and_reproducible(spark, docs):
    from episodia.llm.sharding import shard

    rows = shard(docs, shards=5).collect()
    want = Counter((d, len((t or "").encode()) + 8, None if t is None else zlib.crc32(t.encode())) for d, t, *_ in T.edge_rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    assert shard(empty(docs)).count() == 0


def test_shards_split_only_large_groups(spark):
    from episodia.llm.sharding import shard

    rows = [(i, f"text {i} " * 9) for i in range(4000)] + [(5000 + i, "one hot text " * 8) for i in range(2000)] + [(9000 + i, f"pair {i // 2}") for i in range(400)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=24).collect()
    sizes, where = Counter(), defaultdict(set)
    for r in got:
        sizes[r["shard"]] += r["size"]
        where[r["text_crc32"]].add(r["shard"])
    mean = sum(sizes.values()) / 24
    assert len(sizes) == 24 and max(abs(s - mean) for s in sizes.values()) < 0.05 * mean
    hot = zlib.crc32(("one hot text " * 8).encode())
    assert len(where.pop(hot)) > 1 and all(len(s) == 1 for s in where.values())


# urls

def test_rules_equal_a_plain_loop(spark):
    from episodia.llm.url_rules import judge

    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.net", "/en/deep/", "block"), ("a.example.net", "/", "block"), ("org", "/fr/", "allow"), ("Org", "/fr/", "block"), ("com", "", "block"), ("x.com", "/b", "allow")]
    rng, urls = random.Random(2), [None, "", "no scheme", "http://", "://net/", "http://net", "http://net/", "HTTP://A.Example.NET/en/deep/x?q#f", "https://example.net?x=/en/", "http://example.netx/en/", "http://xexample.net/en/",
                                   "http://" + "a." * 300 + "net/z", "http://net./x", "ftp://u@x.com:8/b", "http://x.com/bc", "http://com"]
    hosts = ["net", "example.net", "a.example.net", "b.a.example.net", "org", "x.org", "x.com", "y.x.com", "de"]
    urls += [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/deep/', '/en/deep', '/fr/a', '/b', '/c?d'])}" for _ in range(400)] + ["http://b.a.example.net/en/deep/1"] * 200
    df = spark.createDataFrame([(i % 500, u) for i, u in enumerate(urls)], "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "key", "stack")}).repartition(5)

    def parts(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u[u.index("://") + 3:]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:end].lower(), rest[end:]
        return host, rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]

    def plain(u):
        host, path = parts(u)
        fits = [(len(h + p), h.count("."), h + p, v) for h, p, v in ((h.lower(), p, v) for h, p, v in rules if (h, v) != ("Org", "block")) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[2], best[3] if best else "allow"

    got = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in judge(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect())
    assert got == Counter((i % 500, *plain(u)) for i, u in enumerate(urls))
    assert judge(empty(df), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    none = judge(df, spark.createDataFrame([], "host string, path string, verdict string")).select("rule", "verdict").distinct().collect()
    assert [tuple(r) for r in none] == [(None, "allow")]


# token files

def test_token_files_round_trip(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    from episodia.llm import token_frames as K

    tokenizer, folder = Tokenizer.from_file(VOCABULARY), f"file://{tmp_path}/ids"
    files = K.write_token_files(docs, VOCABULARY, folder)
    got = K.read_token_files(files, folder, with_ids=True).collect()
    want = Counter((d, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for d, t, *_ in T.edge_rows())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    order = sorted(got, key=lambda r: r["start"])
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in order]
    assert ids == sorted(ids)
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(order, order[1:])) and order[0]["start"] == 0
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got)
    some = K.read_token_files(files, folder, wanted=[6, 9]).collect()
    assert {r["doc_id"] for r in some} == {6, 9} and {(r["start"], r["n_tokens"]) for r in some} <= {(r["start"], r["n_tokens"]) for r in got}
    assert K.token_digest(empty(docs), VOCABULARY).count() == 0


def test_token_frames_are_plain_zstandard_and_checked(spark, tmp_path):
    import zstandard

    from episodia.llm import token_frames as K

    store, base = K.open_store(f"file://{tmp_path}")
    writer = K.FrameWriter(store, f"{base}/x.zst", "<u2", 1)
    parts = [np.arange(n, dtype=np.uint32) for n in (1, 5000, 0, 7)]
    for i, p in enumerate(parts):
        writer.add(i or None, p)
    path, n, total = writer.close()
    raw = zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True).read()
    assert raw == b"".join(p.astype("<u2").tobytes() for p in parts) and (n, total) == (4, 5008)
    assert [(d, b, len(i)) for d, b, i in K.read_frames(store, path)] == [(None, 0, 1), (1, 1, 5000), (2, 5001, 0), (3, 5001, 7)]
    assert [d for d, *_ in K.read_frames(store, path, {3})] == [3]
    data = bytearray(open(path, "rb").read())
    table = np.frombuffer(bytes(data[-9 - 48:-9]), "<u4")
    data[-9 - 48 + 8] ^= 1  # the first frame's checksum
    open(path, "wb").write(bytes(data))
    assert len(table) == 12
    with pytest.raises(ValueError, match="damaged"):
        list(K.read_frames(store, path))


def test_special_tokens_are_found_in_their_own_case_only():
    from tokenizers import Tokenizer

    from episodia.llm import token_frames as K

    texts = ["One <|EndOfText|> two", "One <|endoftext|> two.", "A<|StartOfText|>b, <|ENDOFTEXT|>", "\u00c9t\u00e9 <| plain |> Done.", "No such mark, None."]
    tokenizer = Tokenizer.from_file(VOCABULARY)
    got = K.Encoder(VOCABULARY).encode([t.encode() for t in texts])
    assert [g.tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


# lines

def test_line_runs_equal_brute_force(spark, docs):
    from episodia.llm.line_dedup import dedup_lines

    rng = random.Random(8)
    bank = [[" ".join(f"p{b}l{j}w{k}" for k in range(rng.randrange(0, 14))) for j in range(rng.randrange(4, 30))] for b in range(6)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(rng.randrange(1, 4)):
            b = rng.choice(bank)
            a = rng.randrange(len(b))
            lines += b[a:a + rng.randrange(1, 25)] + [f"own {i} {rng.random()}"] * rng.randrange(2)
        rows.append((i, "\n".join(lines)))
    rows += [(500 + i, rows[7][1]) for i in range(20)] + [(3, rows[3][1]), (None, rows[9][1]), (900, None), (901, ""), (902, "\n\n\n"), (903, "\n".join(["same line of five words"] * 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("pos", "h", "m", "d", "_k", "_gone", "_lines")}).drop("_lines").repartition(4)
    got = Counter((r["doc_id"], r["n"], r["deleted"], None if r["text"] is None else zlib.crc32(r["text"].encode())) for r in dedup_lines(df).select("doc_id", "text", "_lines.*").collect())
    want = T.kept_lines(rows)
    assert got == Counter((r[0], *want[r]) for r in rows)
    assert dedup_lines(empty(df)).count() == 0


def runs_like_any_earlier(rows, least=50):
    """Deleted lines of each row (distinct ids) when all earlier occurrences are compared."""
    lines = [[x.strip() for x in t.split("\n")] for _, t in sorted(rows)]
    where, gone = defaultdict(list), [set() for _ in lines]
    for i, l in enumerate(lines):
        for p in range(len(l)):
            e = next((e for e in range(p + 1, len(l) + 1) if sum(len(x.split()) for x in l[p:e]) >= least), None)
            if e is not None:
                for j, q in where[tuple(l[p:e])]:
                    n = e - p
                    while p + n < len(l) and q + n < len(lines[j]) and l[p + n] == lines[j][q + n]:
                        n += 1
                    gone[i].update(range(p, p + n))
                where[tuple(l[p:e])].append((i, p))
    return {r[0]: len(g) for r, g in zip(sorted(rows), gone)}


def test_line_runs_go_on_like_any_earlier_text(spark):
    from episodia.llm.line_dedup import dedup_lines

    a, b, c = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 60), ("b", 10), ("c", 10)))
    rows = [(1, f"{a}\n{c}"), (2, f"{a}\n{b}"), (3, f"{a}\n{b}")]
    got = {r["doc_id"]: (r["text"], r["deleted"]) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text", "_lines.*").collect()}
    assert got == {1: (rows[0][1], 0), 2: (b, 1), 3: ("", 2)}

    rng = random.Random(11)
    bank = [" ".join(f"l{j}w{k}" for k in range(rng.choice([0, 1, 3, 12, 30, 55, 70]))) for j in range(12)]
    rows = [(i, "\n".join(rng.choice(bank[:rng.choice([2, 5, 12])]) for _ in range(rng.randrange(1, 40)))) for i in range(150)]
    got = {r["doc_id"]: r["deleted"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "_lines.*").collect()}
    want = runs_like_any_earlier(rows)
    assert got == want and got != {d: T.kept_lines(rows)[d, t][1] for d, t in rows}


# pieces

def test_components_of_random_graphs(spark):
    from episodia.llm.graph import components

    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)]
    groups = T.Groups(2000)
    for a, b in edges:
        groups.join(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: groups.root(x) for a, b in edges for x in (a, b) if a != b}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_registered_queries():
    from episodia.llm.queries import QUERIES, SQL

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(SQL) <= set(QUERIES)
