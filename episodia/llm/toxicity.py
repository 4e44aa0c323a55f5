"""Toxicity of texts by a bidirectional gated recurrent network over words.

A word's input joins what is known of the word itself (a learned vector and its
odds among toxic texts) with what its letter n-grams say, so unseen spellings
count too.  Two gated recurrent layers read a window in both directions,
attention pools their states, and a text scores as its highest of all overlapping
windows.  Everything is trained here in numpy on a bounded labelled sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodia.llm.language_id import held_out
from episodia.llm.letters import by_width, grams, letter_words
from episodia.llm.splitters import unit_hash
from episodia.llm.words import U64, WordTable, text_parts

WINDOW, STRIDE = 48, 36
HIDDEN, WORD_DIM, ATTEND = 8, 6, 8
GRAM_BITS, GRAM_ORDERS = 18, (3, 4, 5)
#: expected training texts of each label
SAMPLE = {1: 1200, 0: 2400}
#: a word of the sample gets a vector of its own from so many texts on
LEAST_TEXTS = 3
ROUNDS, EPOCHS, BATCH, RATE, DECAY = 3, 2, 64, 0.02, 1e-4
SMOOTH = 5.0

INPUTS = WORD_DIM + 3


@dataclass
class Model:
    """All learned values; their size does not depend on the input's."""

    vocabulary: dict = field(default_factory=dict)
    odds: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))
    gram_odds: np.ndarray = field(default_factory=lambda: np.zeros(1 << GRAM_BITS, np.float32))
    weights: dict = field(default_factory=dict)


def gram_numbers(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all letter n-grams and the word of each."""
    mask, number, owner = U64((1 << GRAM_BITS) - 1), [], []
    for at, framed, lens in by_width(words):
        for order in GRAM_ORDERS:
            for h, valid in grams(framed, lens, order):
                number.append((h & mask)[valid].astype(np.int64))
                owner.append(at[valid])
    if not number:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(number), np.concatenate(owner)


def word_inputs(words: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(row of the word vector, the three fixed inputs) of distinct words."""
    rows = np.array([model.vocabulary.get(w, 0) for w in words], np.int64)
    number, owner = gram_numbers(words)
    values = model.gram_odds[number]
    total = np.bincount(owner, values, len(words)) / np.maximum(np.bincount(owner, minlength=len(words)), 1)
    top = np.full(len(words), -9.0, np.float32)
    np.maximum.at(top, owner, values)
    top[top < -8] = 0
    return rows, np.stack([model.odds[rows], total.astype(np.float32), top], 1).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(1) / (np.float32(1) + np.exp(-np.clip(x, -30, 30)))


def initial(words: int, seed: int) -> dict:
    rng = np.random.default_rng(seed)

    def draw(*shape):
        return (rng.standard_normal(shape) * (0.6 / np.sqrt(shape[0]))).astype(np.float32)

    w = {"vectors": draw(words, WORD_DIM) * 0.1}
    for side in ("f", "b"):
        w |= {f"x{side}": draw(INPUTS, 3 * HIDDEN), f"h{side}": draw(HIDDEN, 3 * HIDDEN), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}
    w |= {"a": draw(2 * HIDDEN, ATTEND), "v": draw(ATTEND, 1), "o": draw(2 * HIDDEN, 1), "z": np.zeros(1, np.float32)}
    return w


def read(projected: list[np.ndarray], mask: np.ndarray | None, w: dict, keep: bool = False):
    """Logit of each window; ``projected`` holds the inputs of both directions, time first."""
    steps, n = projected[0].shape[:2]
    states, trace = [], []
    for side, p in zip("fb", projected):
        h, u, out, kept = np.zeros((n, HIDDEN), np.float32), w[f"h{side}"], np.empty((steps, n, HIDDEN), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            gates = p[t]
            g = h @ u
            zr = sigmoid(gates[:, :2 * HIDDEN] + g[:, :2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(gates[:, 2 * HIDDEN:] + r * g[:, 2 * HIDDEN:])
            new = c + z * (h - c)
            if mask is not None:
                new = np.where(mask[t][:, None], new, h)
            if keep:
                kept.append((t, h, z, r, c, g[:, 2 * HIDDEN:]))
            h = new
            out[t] = h
        states.append(out)
        trace.append(kept)
    both = np.concatenate(states, 2)
    seen = np.tanh(both @ w["a"])
    energy = (seen @ w["v"])[:, :, 0]
    if mask is not None:
        energy = np.where(mask, energy, np.float32(-1e9))
    weight = np.exp(energy - energy.max(0))
    weight /= weight.sum(0)
    pooled = np.einsum("tn,tnh->nh", weight, both)
    logit = (pooled @ w["o"])[:, 0] + w["z"]
    return (logit, (both, seen, weight, pooled, trace)) if keep else logit


def slopes(error: np.ndarray, kept, inputs: np.ndarray, mask: np.ndarray, w: dict) -> tuple[dict, np.ndarray]:
    """Gradient of the loss by back-propagation, and that of the inputs."""
    both, seen, weight, pooled, trace = kept
    steps, n = mask.shape
    d = {"z": np.array([error.sum()]), "o": pooled.T @ error[:, None]}
    d_pooled = error[:, None] * w["o"][:, 0]
    d_weight = np.einsum("nh,tnh->tn", d_pooled, both)
    d_both = weight[:, :, None] * d_pooled[None]
    d_energy = weight * (d_weight - (weight * d_weight).sum(0))
    d["v"] = np.einsum("tna,tn->a", seen, d_energy)[:, None]
    d_seen = d_energy[:, :, None] * w["v"][:, 0] * (1 - seen ** 2)
    d["a"] = np.einsum("tnh,tna->ha", both, d_seen)
    d_both = d_both + d_seen @ w["a"].T
    d_inputs = np.zeros_like(inputs)
    for k, side in enumerate("fb"):
        u = w[f"h{side}"]
        part = d_both[:, :, k * HIDDEN:(k + 1) * HIDDEN]
        d_u, d_p = np.zeros_like(u), np.zeros((steps, n, 3 * HIDDEN), np.float32)
        carry = np.zeros((n, HIDDEN), np.float32)
        for t, h, z, r, c, g in reversed(trace[k]):
            total = carry + part[t]
            on = mask[t][:, None]
            d_new = np.where(on, total, 0)
            d_c = d_new * (1 - z) * (1 - c ** 2)
            d_z = d_new * (h - c) * z * (1 - z)
            d_r = d_c * g * r * (1 - r)
            gates = np.concatenate([d_z, d_r, d_c], 1)
            back = np.concatenate([d_z, d_r, d_c * r], 1)
            d_p[t] = gates
            d_u += h.T @ back
            carry = np.where(on, d_new * z, total) + back @ u.T
        d[f"h{side}"], d[f"c{side}"] = d_u, d_p.sum((0, 1))
        d[f"x{side}"] = np.einsum("tni,tng->ig", inputs, d_p)
        d_inputs += d_p @ w[f"x{side}"].T
    return d, d_inputs


def starts_of(n: int) -> np.ndarray:
    """Starts of the overlapping windows of ``n`` words; the last ends with the text."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


def fit(texts: list[list[str]], labels: list[int], seed: int = 11) -> Model:
    """Train on texts as lists of words; each text counts by its highest window."""
    y, model = np.array(labels, np.float32), Model()
    if len(set(labels)) < 2:
        return model
    distinct = list(dict.fromkeys(w for t in texts for w in t))
    number = {w: i for i, w in enumerate(distinct)}
    coded = [np.array([number[w] for w in t], np.int64) for t in texts]
    sets = [np.unique(c) for c in coded]
    many = np.array([y.sum(), len(y) - y.sum()])

    def odds(seen: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
        """How much likelier an item is in toxic texts (log odds) and texts it is in."""
        at, who = np.concatenate(seen), np.repeat(y, [len(s) for s in seen])
        pos, neg = np.bincount(at, who, size), np.bincount(at, 1 - who, size)
        return (np.log((pos + SMOOTH) / (many[0] + SMOOTH)) - np.log((neg + SMOOTH) / (many[1] + SMOOTH)) - np.log((many[1] + SMOOTH) / (many[0] + SMOOTH))).astype(np.float32), pos + neg

    word_odds, in_texts = odds(sets, len(distinct))
    gram, owner = gram_numbers(distinct)
    order = np.argsort(owner, kind="stable")
    gram, bounds = gram[order], np.searchsorted(owner[order], np.arange(len(distinct) + 1))
    gram_sets = [np.unique(np.concatenate([gram[bounds[i]:bounds[i + 1]] for i in s])) if len(s) else np.empty(0, np.int64) for s in sets]
    model.gram_odds = odds(gram_sets, 1 << GRAM_BITS)[0]
    known = np.flatnonzero(in_texts >= LEAST_TEXTS)
    model.vocabulary = {distinct[i]: r + 1 for r, i in enumerate(known)}
    model.odds = np.concatenate([[0], word_odds[known]]).astype(np.float32)
    rows, fixed = word_inputs(distinct, model)
    w = model.weights = initial(len(known) + 1, seed)
    rng = np.random.default_rng(seed)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in w.items()}
    tick = 0
    peak = fixed.max(1)
    for round_ in range(ROUNDS):
        chosen = []
        values = window_scores(coded, projections(rows, fixed, model), model) if round_ else None
        for i, c in enumerate(coded):
            starts = starts_of(len(c))
            value = values[i] if round_ else np.array([peak[c[s:s + WINDOW]].max(initial=-9) for s in starts])
            chosen.append((i, int(starts[value.argmax()])))
            if y[i] == 0 and len(starts) > 1:
                chosen.append((i, int(starts[rng.integers(len(starts))])))
        for _ in range(EPOCHS):
            line = rng.permutation(len(chosen))
            for b in range(0, len(line), BATCH):
                some = [chosen[j] for j in line[b:b + BATCH]]
                ids, mask = np.zeros((WINDOW, len(some)), np.int64), np.zeros((WINDOW, len(some)), bool)
                for j, (i, s) in enumerate(some):
                    part = coded[i][s:s + WINDOW]
                    ids[:len(part), j], mask[:len(part), j] = part, True
                at = rows[ids]
                x = np.concatenate([w["vectors"][at], fixed[ids]], 2)
                logit, kept = read([x @ w["xf"] + w["cf"], x @ w["xb"] + w["cb"]], mask, w, keep=True)
                error = ((sigmoid(logit) - y[[i for i, _ in some]]) / len(some)).astype(np.float32)
                d, d_x = slopes(error, kept, x, mask, w)
                d["vectors"] = np.zeros_like(w["vectors"])
                for j in range(WORD_DIM):
                    d["vectors"][:, j] = np.bincount(at.ravel(), d_x[:, :, j].ravel(), len(d["vectors"]))
                tick += 1
                for k, g in d.items():
                    g = np.clip(g, -1, 1) + DECAY * w[k]
                    first, second = moments[k]
                    first += 0.1 * (g - first)
                    second += 0.01 * (g * g - second)
                    rate = RATE * 0.5 ** round_
                    w[k] -= (rate * (first / (1 - 0.9 ** tick)) / (np.sqrt(second / (1 - 0.99 ** tick)) + 1e-8)).astype(np.float32)
    return model


def projections(rows: np.ndarray, fixed: np.ndarray, model: Model) -> np.ndarray:
    """Input of both directions' gates for each distinct word."""
    w = model.weights
    x = np.concatenate([w["vectors"][rows], fixed], 1)
    return np.concatenate([x @ w["xf"] + w["cf"], x @ w["xb"] + w["cb"]], 1).astype(np.float32)


def window_scores(words: list[np.ndarray], gates: np.ndarray, model: Model, most: int = 8192) -> list[np.ndarray]:
    """Logits of all windows of each text, given as rows of ``gates``."""
    counts = [len(starts_of(len(c))) for c in words]
    out = np.zeros(sum(counts), np.float32)
    first = np.concatenate([[0], np.cumsum(counts)])
    flat = np.concatenate(words) if words else np.empty(0, np.int64)
    begin = np.concatenate([[0], np.cumsum([len(c) for c in words])])
    full = [(first[i] + np.arange(counts[i]), begin[i] + starts_of(len(c))) for i, c in enumerate(words) if len(c) >= WINDOW]
    if full:
        at, start = np.concatenate([f[0] for f in full]), np.concatenate([f[1] for f in full])
        for b in range(0, len(at), most):
            ids = flat[start[None, b:b + most] + np.arange(WINDOW)[:, None]]
            out[at[b:b + most]] = read([gates[:, :3 * HIDDEN][ids], gates[:, 3 * HIDDEN:][ids]], None, model.weights)
    short = [i for i, c in enumerate(words) if 0 < len(c) < WINDOW]
    for b in range(0, len(short), most):
        some = short[b:b + most]
        ids, mask = np.zeros((WINDOW, len(some)), np.int64), np.zeros((WINDOW, len(some)), bool)
        for j, i in enumerate(some):
            ids[:len(words[i]), j], mask[:len(words[i]), j] = words[i], True
        out[first[some]] = read([gates[:, :3 * HIDDEN][ids], gates[:, 3 * HIDDEN:][ids]], mask, model.weights)
    return [out[a:b] for a, b in zip(first, first[1:])]


def training_texts(docs: DataFrame, labels: DataFrame) -> tuple[list[list[str]], list[int]]:
    """A bounded sample of labelled texts that are not held out, drawn by a hash."""
    rows = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    many = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chance = F.when(F.col("toxic") == 1, F.lit(min(1.0, SAMPLE[1] / max(many.get(1, 0), 1)))).otherwise(F.lit(min(1.0, SAMPLE[0] / max(many.get(0, 0), 1))))
    drawn = rows.filter(unit_hash("doc_id") < chance)
    # about sum(SAMPLE.values()) rows
    found = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(drawn), "doc_id").collect()
    found = sorted((r["doc_id"], bytes(r["text"] or b""), r["toxic"]) for r in found)
    return [letter_words(t) for _, t, _ in found], [int(x) for _, _, x in found]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every row: its highest window.

    Texts without a letter, empty or null, score 0; so does everything if the
    labels held one class only.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        table = WordTable(lambda words: projections(*word_inputs(words, model), model), 250_000)
        for whole in batches:
            for batch in text_parts(whole):
                out = np.zeros(batch.num_rows)
                if model.weights:
                    words = [table.rows(letter_words(t)) for t in batch.column("text").to_pylist()]
                    logits = window_scores(words, table.filled(), model) if any(map(len, words)) else [np.zeros(1)] * len(words)
                    out = np.array([float(sigmoid(x.max())) if len(c) else 0.0 for c, x in zip(words, logits)])
                    table.trim()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {id_type}, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on ``labels`` (``doc_id``, ``toxic``) and score every row of ``docs``.

    Only ``doc_id`` and ``text`` of the documents are read.  A document with
    several labels is toxic if one says so; null labels are left out.  Repeated
    rows get equal scores; an empty table gives an empty one.
    """
    docs = docs.select("doc_id", "text")
    rows = score(docs, fit(*training_texts(docs, labels)))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_gated_recurrent(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
