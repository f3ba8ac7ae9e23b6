"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fitted, fold, lowered, slices, strings, text_bytes, words_of, tidy
from .grams import gram_codes

BITS, SIZES, DIM = 16, (3, 4, 5), 12
#: Words in a window; the windows of a text begin every half window and cover all of it.
WINDOW = 4


@dataclass
class Model:
    vectors: np.ndarray  # a vector for each bucket of n-grams
    weights: np.ndarray  # DIM x 2
    bias: np.ndarray  # 2

    def logits(self) -> np.ndarray:
        """What each bucket adds to logit 1 against logit 0: the layers are linear, so they can be multiplied out."""
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float64)

    @property
    def lean(self) -> float:
        return float(self.bias[1] - self.bias[0])


@dataclass
class Scorer:
    """What is needed of a model to score texts."""

    table: np.ndarray
    lean: float


def subwords(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of every word's n-grams, with its edges marked, and where those of each word begin, end last."""
    data, offsets = text_bytes(words)
    size = np.diff(offsets)
    n = len(size)
    padded = np.full(len(data) + 2 * n, ord("<"), np.uint8)
    begins = offsets[:-1] + 2 * np.arange(n)
    inside = np.arange(len(data)) + np.repeat(1 + 2 * np.arange(n), size)
    padded[inside] = data
    padded[begins + size + 1] = ord(">")
    left = np.repeat(begins + size + 2, size + 2) - np.arange(len(padded))
    owner = np.repeat(np.arange(n), size + 2)
    codes, owners = [], []
    for k in SIZES:
        code = gram_codes(padded, k, BITS)
        keep = left[: len(code)] >= k
        codes.append(code[keep])
        owners.append(owner[: len(code)][keep])
    code, own = np.concatenate(codes), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return code[order].astype(np.int64), np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))])


def word_values(words: pa.Array, table: np.ndarray) -> np.ndarray:
    """The mean over each word's n-grams of the table's values; 0 for a word too short to have any."""
    codes, starts = subwords(words)
    total = np.concatenate([[0.0], np.cumsum(table[codes])])
    return (total[starts[1:]] - total[starts[:-1]]) / np.maximum(np.diff(starts), 1)


def window_means(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean of each window of each text, and where those of each text begin; every text has one window at least."""
    n = np.diff(starts)
    count = np.maximum(1, -(-(n - WINDOW) // (WINDOW // 2)) + 1)
    own = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    begin = starts[:-1][own] + at * (WINDOW // 2)
    end = np.minimum(begin + WINDOW, starts[1:][own])
    total = np.concatenate([[0.0], np.cumsum(values)])
    return (total[end] - total[begin]) / np.maximum(np.minimum(WINDOW, n[own]), 1), np.concatenate([[0], np.cumsum(count)])


def text_scores(texts: pa.Array, model: Scorer) -> np.ndarray:
    """The probability of the most toxic window of each text."""
    flat, starts = words_of(lowered(texts))
    table = model.table
    coded = flat.dictionary_encode()
    values = word_values(coded.dictionary, table)[np.asarray(coded.indices)] if len(flat) else np.zeros(0)
    means, at = window_means(values, starts)
    z = np.maximum.reduceat(means, at[:-1]) + model.lean if len(texts) else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def flat_add(to: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Adds values to rows that may repeat; numpy does so fast along one axis only."""
    width = to.shape[1]
    np.add.at(to.reshape(-1), (rows[:, None] * width + np.arange(width)).reshape(-1), values.reshape(-1))


def fit(texts: list[str], labels: list[int], *, epochs: int = 10, rate: float = 0.2, hidden: float = 0.5, seed: int = 0) -> Model:
    """Trains vectors and softmax weights together on labelled texts; the bias stays at the odds of a window without words.

    A label says that some window of a text is toxic, not which. So each round scores all windows and learns from the
    one that scores highest in each text: the usual way with labels on bags. The first windows are found by the words
    that stand out in toxic texts, so that the rounds begin near the right ones. In learning, a share `hidden` of the
    n-grams of every other toxic window is left out: the rest must do, as in a word that is spelled otherwise.
    """
    rng = np.random.default_rng(seed)
    model = Model(rng.normal(0, 0.05, (1 << BITS, DIM)), rng.normal(0, 0.3, (DIM, 2)), np.array([2.0, -2.0]))
    arr = lowered(pa.array(texts, pa.large_string()))
    flat, starts = words_of(arr)
    y = np.array(labels)
    if not len(flat) or y.min() == y.max():
        model.bias = np.array([4.0, -4.0]) if not len(y) or not y.max() else np.array([-4.0, 4.0])
        model.vectors[:] = 0
        return model
    coded = flat.dictionary_encode()
    word = np.asarray(coded.indices).astype(np.int64)
    codes, cut = subwords(coded.dictionary)
    # Texts of each class that hold each n-gram, once a text.
    ones, zeros = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for i in range(len(y)):
        w = np.unique(word[starts[i] : starts[i + 1]])
        m = cut[w + 1] - cut[w]
        grams = np.unique(codes[np.repeat(cut[w] - (np.cumsum(m) - m), m) + np.arange(m.sum())])
        (ones if y[i] else zeros)[grams] += 1
    odd = np.log((ones + 0.1) / (y.sum() + 0.2)) - np.log((zeros + 0.1) / ((1 - y).sum() + 0.2))
    hint = np.where(ones + zeros >= 5, odd, 0.0)
    values = np.add.reduceat(np.append(hint[codes], 0), np.minimum(cut[:-1], len(codes)))
    values = np.where(np.diff(cut) > 0, values / np.maximum(np.diff(cut), 1), 0)
    heavy = float(np.clip((1 - y).sum() / y.sum(), 1, 3))  # the rarer label weighs more
    sums = [np.zeros((DIM, 2)), np.zeros(1 << BITS)]
    for epoch in range(epochs):
        if epoch > 2:
            table = model.logits()
            total = np.concatenate([[0.0], np.cumsum(table[codes])])
            values = (total[cut[1:]] - total[cut[:-1]]) / np.maximum(np.diff(cut), 1)
        means, at = window_means(values[word], starts)
        # The best window of each text, and of clean texts two more at random.
        top = np.maximum.reduceat(means, at[:-1])
        first = np.flatnonzero(means == np.repeat(top, np.diff(at)))
        own = np.repeat(np.arange(len(y)), np.diff(at))
        first = first[np.unique(own[first], return_index=True)[1]]
        clean = np.flatnonzero(y == 0)
        more = np.concatenate([at[clean] + rng.integers(0, np.diff(at)[clean]) for _ in range(2)])
        pick = np.concatenate([first, more])
        docs = own[pick]
        begin = starts[docs] + (pick - at[docs]) * (WINDOW // 2)
        end = np.minimum(begin + WINDOW, starts[docs + 1])
        target = y[docs]
        # Single words of clean texts: a word that only stood beside a toxic one must not keep a share of the blame.
        full = clean[np.diff(starts)[clean] > 0]
        alone = np.concatenate([starts[full] + rng.integers(0, np.diff(starts)[full]) for _ in range(4)])
        pick, begin, end = np.concatenate([pick, alone]), np.concatenate([begin, alone]), np.concatenate([end, alone + 1])
        target = np.concatenate([target, np.zeros(len(alone), target.dtype)])
        order = rng.permutation(len(pick))
        for s in range(0, len(order), 64):
            rows = order[s : s + 64]
            n = end[rows] - begin[rows]
            if not n.sum():
                continue
            row = np.repeat(np.arange(len(rows)), n)
            ws = word[np.repeat(begin[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            k = np.diff(cut)[ws]
            gram = codes[np.repeat(cut[ws] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
            part = np.repeat(1 / (np.maximum(k, 1) * np.maximum(n, 1)[row]), k)
            owner = np.repeat(row, k)
            drop = (rng.random(len(gram)) < hidden) & ((target[rows] == 1) & (rng.random(len(rows)) < 0.5))[owner]
            gram, part, owner = gram[~drop], part[~drop], owner[~drop]
            bag = np.zeros((len(rows), DIM))
            flat_add(bag, owner, model.vectors[gram] * part[:, None])
            z = bag @ model.weights + model.bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), target[rows]] -= 1
            p *= np.where(target[rows] == 1, heavy, 1.0)[:, None]
            back = p @ model.weights.T
            step = bag.T @ p
            sums[0] += step**2
            model.weights -= 0.1 * rate * step / np.sqrt(sums[0] + 1e-8)
            # AdaGrad, one rate for each n-gram: rare ones move as fast as common ones.
            some, at_some = np.unique(gram, return_inverse=True)
            slope = np.zeros((len(some), DIM))
            flat_add(slope, at_some, part[:, None] * back[owner])
            sums[1][some] += (slope**2).mean(1)
            model.vectors[some] -= rate * slope / np.sqrt(sums[1][some] + 1e-8)[:, None]
    return model


def learned(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id_col: str, label_col: str, per_class: int) -> Broadcast:
    """The model, fitted on a bounded sample of labelled rows, for all executors."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(label_id_col).isNotNull()).select(F.col(label_id_col).alias("_lid"), (F.col(label_col) > 0).cast("int").alias("_y"), F.pmod(F.xxhash64(label_id_col), F.lit(1 << 30)).alias("_at"))
    sizes = {r._y: r["count"] for r in marks.groupBy("_y").count().collect()}
    few = lambda y: int(min(1.0, per_class / max(1, sizes.get(y, 1))) * (1 << 30))
    # The sample of labels is bounded, so it goes to the documents.
    chosen = marks.where(F.col("_at") <= F.when(F.col("_y") == 1, few(1)).otherwise(few(0))).select("_lid", "_y")
    docs = documents.select(F.col(id_col), F.col(text_col).alias("_t"))
    known = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("_lid")).where(F.length("_t") > 0).select("_y", "_t")

    def learn(labels: list[int], texts: list[str]) -> Scorer:
        model = fit(texts, labels)
        return Scorer(model.logits(), model.lean)

    return documents.sparkSession.sparkContext.broadcast(fitted(known, learn))  # of fixed size


def score(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", per_class: int = 2500, held_out: Column | None = None) -> DataFrame:
    """The toxicity of each document, learned from the rows that `labels` names.

    The model is fitted in one task from at most about `per_class` rows of each label, those of least hashed id: a
    bounded sample. A word is the mean of the vectors of its hashed character n-grams (3 to 5 bytes, edges marked); a
    window of WINDOW words is the mean of its words, and goes through a linear softmax; a text has the score of its most
    toxic window. A word with a new spelling shares n-grams with known ones and so their vectors.

    Returns a row for each row: the id, held_out (if given), score (0 to 1) and predicted (score >= 0.5). Null and empty
    texts are scored as a window without words. With nothing to learn from, every score is near 0. Labels that
    are null, or of ids that no document has, aren't learned from. Other columns are ignored.
    """
    shared = learned(documents, labels, id_col, text_col, label_id_col, label_col, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = strings(b.column(2))
            found = [text_scores(texts.slice(s, e - s), shared.value) for s, e in slices(texts, 1_000_000)]
            out = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    rows = documents.select(F.col(id_col), (F.lit(False) if held_out is None else held_out).alias("held_out"), F.col(text_col))
    return rows.mapInArrow(tidy(run), f"`{id_col}` {documents.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int")


def clean(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", per_class: int = 2500) -> DataFrame:
    """The rows of documents with a score under one half, with all their columns; learned as in score()."""
    shared = learned(documents, labels, id_col, text_col, label_id_col, label_col, per_class)
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = strings(b.column(at))
            found = [text_scores(texts.slice(s, e - s), shared.value) for s, e in slices(texts, 1_000_000)]
            if found:
                yield b.filter(pa.array(np.concatenate(found) < 0.5))

    return documents.mapInArrow(tidy(run), documents.schema)


def held_out_of(id_col: str = "doc_id") -> Column:
    return fold(id_col, 5) == 0
