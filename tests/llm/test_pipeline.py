"""The stages one after the other, on a table and on awkward rows."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import edge_tables as T  # noqa: E402

pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_clean_documents(spark, small):
    import corpus_pipeline as C

    from episodia.session import written

    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    columns, results = docs.columns, {}
    for name, stage in C.STAGES:
        docs = results[name] = written(stage(spark, docs, small), name)
        if name != C.STAGES[-1][0]:
            assert docs.columns == columns
    ids = {n: sorted(r[0] for r in d.select("doc_id").collect()) for n, d in results.items()}
    assert ids["language_id"] == sorted(d for d, _ in rows)
    assert ids["ngram_join"] == sorted({c for _, _, c in T.jaccard_components(rows)})
    items = [r[0] for r in spark.read.parquet(f"{small}/benchmark.parquet").select("text").collect()]
    texts = dict(rows)
    assert ids["decontamination"] == [d for d in ids["ngram_join"] if not any(x in texts[d] for x in items)]
    assert set(ids["mixing"]) <= set(ids["decontamination"]) and ids["token_files"] == ids["mixing"]


def test_run_on_awkward_rows(spark, small, tmp_path):
    import corpus_pipeline as C

    T.edge_docs(spark).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{small}/benchmark.parquet").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    rows = C.run(spark, f"file://{tmp_path}").collect()
    assert rows and all(r["n_tokens"] >= 1 for r in rows)


def test_stages_reject_texts_not_ids(spark, monkeypatch):
    from episodia.llm import decontamination as D
    from episodia.llm import language_id as L

    item = "the small brown dog ran across the wide green field to fetch his ball"
    good, other = "a text in plain words about the weather of the day", "some more plain words about the sea and its boats"
    rows = [(None, good, "en"), (None, "", "en"), (None, None, "en"), (7, good, "en"), (7, "12 !!", "en"), (7, item, "en"), (None, item, "en"), (None, other, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    monkeypatch.setattr(L, "fit", lambda pieces: L.Model(["a", "b"], *[L.np.zeros(s, L.np.float32) for s in ((1 << L.BITS, 2), (2, 2), 2)]))
    kept = sorted(((r[0], r[1]) for r in L.keep_identified(df).select("doc_id", "text").collect()), key=str)
    assert kept == sorted([(None, good), (7, good), (7, item), (None, item), (None, other)], key=str)
    left = sorted(((r[0], r[1]) for r in D.drop_leaks(df, bench).select("doc_id", "text").collect()), key=str)
    assert left == sorted([(d, t) for d, t, _ in rows if t != item], key=str)
    # halves of an item in two texts of one id are no leak, and three even languages stay
    words = item.split()
    halves = spark.createDataFrame([(5, " ".join(words[:9])), (5, " ".join(words[5:]))], "doc_id long, text string")
    assert {r["coverage"] for r in D.leaks(halves, bench, coverage=0.25).collect()} == {2 / 7}
    monkeypatch.setattr(L, "fit", lambda pieces: L.Model(["a", "b", "c"], *[L.np.zeros(s, L.np.float32) for s in ((1 << L.BITS, 3), (3, 3), 3)]))
    assert L.keep_identified(df).count() == 5
