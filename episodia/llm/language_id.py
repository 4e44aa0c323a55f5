"""Language of texts by a linear-chain conditional random field over words.

Every word gets a score for each language from hashed features (beginnings and
endings, letter n-grams, the word itself); learned transitions make switches
between languages rare.  Forward-backward labels each word of the whole text with
probabilities, so code-switched text has several languages; a document is of the
language with the largest share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodia.llm.letters import affixes, by_width, grams, letter_words, whole
from episodia.llm.splitters import unit_hash
from episodia.llm.words import U64, WordTable, text_parts
from episodia.session import written

BITS = 17
ORDERS, AFFIX = (1, 2, 3), 3
#: documents of each language in the training sample (expected), and what is taken of each
TRAIN_DOCS, PIECES, PIECE_WORDS = 400, 3, 40
EPOCHS, BATCH, RATE, DECAY = 4, 64, 0.05, 1e-6
UNKNOWN = "und"


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words one after another, and the word of each."""
    mask = U64((1 << BITS) - 1)
    feature, owner = [], []
    for at, framed, lens in by_width(words):
        for order in ORDERS:
            for h, valid in grams(framed, lens, order):
                feature.append((h & mask)[valid].astype(np.int32))
                owner.append(at[valid])
        for h in [*affixes(framed, lens, AFFIX), whole(framed)]:
            feature.append((h & mask).astype(np.int32))
            owner.append(at)
    if not feature:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    return np.concatenate(feature), np.concatenate(owner)


def word_scores(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Score of each distinct word for each language."""
    mask = U64((1 << BITS) - 1)
    out = np.zeros((len(words), weights.shape[1]), np.float32)
    for at, framed, lens in by_width(words):
        total = np.zeros((len(at), weights.shape[1]), np.float32)
        for order in ORDERS:
            for h, valid in grams(framed, lens, order):
                total += weights[(h & mask).astype(np.int64)] * valid[:, None]
        for h in [*affixes(framed, lens, AFFIX), whole(framed)]:
            total += weights[(h & mask).astype(np.int64)]
        out[at] = total
    return out


def forward_backward(scores: np.ndarray, lens: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Probabilities of each label at each place of sequences laid end to end.

    Sequences run side by side, the longest first.  With ``pairs`` also the
    expected number of each transition.
    """
    potential = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float32) + np.float32(1e-9)
    trans, start = np.exp(trans).astype(np.float32), np.exp(start).astype(np.float32)
    begin = np.concatenate([[0], np.cumsum(lens)[:-1]])
    order = np.argsort(-lens, kind="stable")
    order = order[lens[order] > 0]
    begin, sizes = begin[order], lens[order]
    longest = int(sizes[0]) if len(sizes) else 0
    running = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")  # sequences longer than t
    alpha = np.empty_like(potential)
    a = start * potential[begin] if longest else None
    for t in range(longest):
        m = running[t]
        at = begin[:m] + t
        if t:
            a = (a[:m] @ trans) * potential[at]
        a = a / a.sum(1, keepdims=True)
        alpha[at] = a
    marginal, counts = np.empty_like(potential), np.zeros_like(trans)
    b = np.empty((0, trans.shape[0]), np.float32)
    for t in range(longest - 1, -1, -1):
        m = running[t]
        if len(b) < m:
            b = np.concatenate([b, np.ones((m - len(b), trans.shape[0]), np.float32)])
        at = begin[:m] + t
        g = alpha[at] * b
        marginal[at] = g / g.sum(1, keepdims=True)
        if t:
            seen = potential[at] * b
            if pairs:
                joint = alpha[at - 1][:, :, None] * trans[None] * seen[:, None, :]
                counts += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            b = seen @ trans.T
            b /= b.sum(1, keepdims=True)
    return (marginal, counts) if pairs else marginal


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray


def fit(pieces: list[tuple[str, list[str]]], seed: int = 7) -> Model:
    """Train on pieces of (language, words); sequences splice pieces of several languages."""
    labels = sorted({lang for lang, _ in pieces})
    rng, k = np.random.default_rng(seed), len(labels)
    number = {lang: i for i, lang in enumerate(labels)}
    pieces = [(number[lang], words) for lang, words in pieces if words]
    weights, trans, start = np.zeros((1 << BITS, k), np.float32), np.zeros((k, k), np.float32), np.zeros(k, np.float32)
    if k < 2 or not pieces:
        return Model(labels, weights, trans, start)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, words in pieces for w in words))}
    feature, owner = word_features(list(vocabulary))
    order = np.argsort(owner, kind="stable")
    feature, bounds = feature[order], np.searchsorted(owner[order], np.arange(len(vocabulary) + 1))
    coded = [(y, np.array([vocabulary[w] for w in words])) for y, words in pieces]
    speed_w, speed_t, speed_s = np.full_like(weights, 1e-6), np.full_like(trans, 1e-6), np.full_like(start, 1e-6)
    for _ in range(EPOCHS):
        line, sequences = rng.permutation(len(coded)), []
        while len(line):
            n = int(rng.integers(1, 5))
            sequences.append([coded[i] for i in line[:n]])
            line = line[n:]
        for i in range(0, len(sequences), BATCH):
            batch = sequences[i:i + BATCH]
            words = np.concatenate([w for s in batch for _, w in s])
            truth = np.concatenate([np.full(len(w), y) for s in batch for y, w in s])
            lens = np.array([sum(len(w) for _, w in s) for s in batch])
            distinct, place = np.unique(words, return_inverse=True)
            runs = bounds[distinct + 1] - bounds[distinct]
            flat = feature[np.repeat(bounds[distinct] - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())]
            of = np.repeat(np.arange(len(distinct)), runs)
            scores = np.stack([np.bincount(of, weights[flat, j], len(distinct)) for j in range(k)], 1).astype(np.float32)[place]
            marginal, expected = forward_backward(scores, lens, trans, start, pairs=True)
            wrong = -marginal
            wrong[np.arange(len(truth)), truth] += 1
            first = np.concatenate([[0], np.cumsum(lens)[:-1]])
            inside = np.ones(len(truth), bool)
            inside[first] = False
            at = np.flatnonzero(inside)
            seen = np.bincount(truth[at - 1] * k + truth[at], minlength=k * k).reshape(k, k)
            by_word = np.stack([np.bincount(place, wrong[:, j], len(distinct)) for j in range(k)], 1)
            used, back = np.unique(flat, return_inverse=True)
            slope = np.stack([np.bincount(back, by_word[of, j], len(used)) for j in range(k)], 1) / len(batch) - DECAY * weights[used]
            speed_w[used] += slope ** 2
            weights[used] += (RATE * slope / np.sqrt(speed_w[used])).astype(np.float32)
            for value, speed, step in ((trans, speed_t, (seen - expected) / len(batch)), (start, speed_s, wrong[first].sum(0) / len(batch))):
                speed += step ** 2
                value += (RATE * step / np.sqrt(speed)).astype(np.float32)
    return Model(labels, weights, trans, start)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_pieces(docs: DataFrame) -> list[tuple[str, list[str]]]:
    """A bounded sample: about ``TRAIN_DOCS`` documents of each language, three pieces of each.

    Held-out rows never enter.  Documents are drawn by a hash; the pieces start
    at hashed places anywhere in the text.
    """
    rows = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    many = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each language
    if not many:
        return []
    chance = F.element_at(F.create_map(*[F.lit(x) for k, n in many.items() for x in (k, min(1.0, TRAIN_DOCS / n))]), F.col("lang"))
    drawn = rows.filter(unit_hash("doc_id", "text") < chance).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, words = [], []
            for lang, text, h in zip(*[batch.column(c).to_pylist() for c in ("lang", "text", "h")]):
                all_ = letter_words(text)
                spare = max(1, len(all_) - PIECE_WORDS + 1)
                for i in range(PIECES if spare > 1 else 1):
                    at = (h ^ (i * 0x9E3779B97F4A7C15)) % spare
                    langs.append(lang)
                    words.append(all_[at:at + PIECE_WORDS])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.list_(pa.string()))], ["lang", "words"])

    pieces = drawn.withColumn("text", F.col("text").cast("binary")).mapInArrow(cut, "lang string, words array<string>").collect()
    return sorted((r["lang"], list(r["words"])) for r in pieces)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc``, ``lang_pred``, ``score`` and ``n_switches`` (changes of language between words) of each row.

    ``score`` is the language's share of all word probabilities.  A text without
    a letter, empty or null, is ``und`` with score 0, as is every text if no
    language could be learned.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # 2^17 weights for each language, whatever the input
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        k = len(model.labels)
        table = WordTable(lambda words: word_scores(words, model.weights))
        for whole_batch in batches:
            for batch in text_parts(whole_batch, 12 << 20):
                rows = [table.rows(letter_words(t)) for t in batch.column("text").to_pylist()]
                lens = np.array([len(r) for r in rows], np.int64)
                label, score, switches = [UNKNOWN] * len(rows), np.zeros(len(rows)), np.zeros(len(rows), np.int64)
                if k and lens.sum():
                    marginal = forward_backward(table.filled()[np.concatenate(rows)], lens, model.trans, model.start)
                    some = np.flatnonzero(lens)
                    begin = np.concatenate([[0], np.cumsum(lens[some])[:-1]])
                    share = np.add.reduceat(marginal.astype(np.float64), begin, axis=0) / lens[some][:, None]
                    share /= share.sum(1, keepdims=True)
                    best = share.argmax(1)
                    word_best = marginal.argmax(1)
                    change = np.concatenate([[False], word_best[1:] != word_best[:-1]])
                    change[begin] = False
                    score[some] = share[np.arange(len(some)), best]
                    switches[some] = np.add.reduceat(change.astype(np.int64), begin)
                    for i, j in zip(some, best):
                        label[i] = model.labels[j]
                table.trim()
                yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(label), pa.array(score), pa.array(switches)], ["doc", "lang_pred", "score", "n_switches"])

    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc {id_type}, lang_pred string, score double, n_switches long")


def keep_identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """``docs`` without rows that are of no language or of none with at least ``least``.

    A text spread evenly over four or more languages is none of them; one that
    switches between two or three stays.  The decision is one for each id and
    text, so rows that share an id alone do not fall together.  Rows that stay
    come back as they are.  The few keys that fall are written first, so texts are neither
    sent while the model runs nor, with few keys, at all.
    """
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("_key"), "text")
    rows = predict(keyed, fit(training_pieces(docs)), "_key")
    rejected = rows.filter((F.col("lang_pred") == UNKNOWN) | (F.col("score") < least)).select(F.col("doc").alias("_out")).distinct()
    rejected = written(rejected, "rejected")
    return docs.join(rejected, F.xxhash64(docs["doc_id"], docs["text"]) == rejected["_out"], "left_anti")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out and label every row of ``docs``.

    Needs ``doc_id``, ``text`` and ``lang``; the latter is used for training only,
    other columns are ignored.  Repeated rows get the same label, null ids count
    as empty text for the hold-out; an empty table gives an empty one.
    """
    docs = docs.select("doc_id", "text", "lang")
    labelled = predict(docs, fit(training_pieces(docs)))
    return labelled.select(F.col("doc").alias("doc_id"), held_out(F.col("doc")).alias("held_out"), "lang_pred", "score", "n_switches")


def op1_chain_field(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
