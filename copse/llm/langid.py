"""Language identification by nearest clustered centroid of TF-IDF n-gram vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fitted, fold, slices, strings, text_bytes, tidy
from .grams import gram_counts

BITS, SIZES = 12, (1, 2, 3)
UNDECIDED = "und"


@dataclass
class Centroids:
    """idf: a weight for each bucket; vectors: unit rows; langs: the language of each; limits: each one's largest distance."""

    langs: list[str]
    idf: np.ndarray
    vectors: np.ndarray
    limits: np.ndarray


def vectors_of(texts: pa.Array, idf: np.ndarray | None = None) -> np.ndarray:
    """Unit vectors of damped n-gram counts, weighted by idf; all zero where a text has no n-grams."""
    data, offsets = text_bytes(pc.utf8_lower(texts))
    x = np.log1p(gram_counts(data, offsets, SIZES, BITS))
    if idf is None:
        return x
    x *= idf
    size = np.sqrt((x**2).sum(1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def idf_of(rows: DataFrame) -> np.ndarray | None:
    """A weight for each bucket from the documents of all rows that hold it: a sum of fixed size. None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = 0, np.zeros(1 << BITS, np.int64)
        for b in batches:
            texts = strings(b.column(0))
            for s, e in slices(texts, 2_000_000, 512):
                found += (vectors_of(texts.slice(s, e - s)) > 0).sum(0)
            n += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, 1 << BITS), pa.int32()), pa.array([n, *found.tolist()], pa.int64())], names=["bucket", "n"])

    got = {r.bucket: r.n for r in rows.select("text").mapInArrow(tidy(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    if not got.get(-1):
        return None
    return np.log((1 + got[-1]) / (1 + np.array([got[i] for i in range(1 << BITS)]))).astype(np.float32) + 1


def fit(texts: list[str], langs: list[str], idf: np.ndarray, *, clusters: int = 4, reject: float = 0.995, seed: int = 0) -> Centroids:
    """Spherical k-means within each language; ties and the order of rows don't depend on chance but for the seed."""
    arr = pa.array(texts, pa.large_string())
    raw = np.concatenate([vectors_of(arr.slice(s, e - s)) for s, e in slices(arr)])
    x = raw * idf
    x /= np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-9)
    rng = np.random.default_rng(seed)
    y = np.array(langs)
    names, vectors, limits = [], [], []
    for lang in sorted(set(langs)):
        own = x[y == lang]
        c = own[rng.permutation(len(own))[:clusters]]
        for _ in range(10):
            at = (own @ c.T).argmax(1)
            c = np.stack([own[at == k].sum(0) if (at == k).any() else c[k] for k in range(len(c))])
            c /= np.maximum(np.sqrt((c**2).sum(1, keepdims=True)), 1e-9)
        near = (own @ c.T)
        at, distance = near.argmax(1), 1 - near.max(1)
        for k in range(len(c)):
            names.append(lang)
            vectors.append(c[k])
            limits.append(np.quantile(distance[at == k], reject) if (at == k).any() else 0.0)
    return Centroids(names, idf, np.array(vectors, np.float32), np.array(limits))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(documents: DataFrame, training: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 600, clusters: int = 4, held_out: Column | None = None) -> DataFrame:
    """The language of each document, learned from `training`.

    The model is fitted in one task from at most about `per_lang` rows of each language, those of least hashed id: a
    bounded sample. Document frequencies are those of all training rows. Each text becomes a TF-IDF vector of hashed byte n-grams (1 to 3 bytes), normalised, and takes the
    language of the nearest of `clusters` centroids a language, by cosine.

    Returns a row for each row: the id, held_out (if given), lang_pred, score (cosine to the nearest centroid, 0 to 1)
    and rejected: whether it lies farther from that centroid than all but 0.5 % of the centroid's training rows. A
    rejected text still has the nearest language in lang_pred. Null texts and those without a letter are `und` with score
    0 and rejected. With nothing to learn from, all are `und`. Ties go to the language that sorts first. Other columns
    are ignored.
    """
    known = training.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col), F.lit(1 << 30)).alias("at"))
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    model = None
    if sizes:
        limit = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, per_lang / n) * (1 << 30)))]), F.col("lang"))
        idf = idf_of(known)
        model = fitted(known.where(F.col("at") <= limit).select("lang", "text"), lambda langs, texts: fit(texts, langs, idf, clusters=clusters) if texts else None)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a fixed number of centroids a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = strings(b.column(2))
            langs, scores, far = [], [], []
            for s, e in slices(texts, 2_000_000, 512):
                part = texts.slice(s, e - s)
                letters = np.array([has_letter(t) for t in part.to_pylist()], bool)
                if m is None:
                    langs, scores, far = langs + [UNDECIDED] * len(part), scores + [0.0] * len(part), far + [True] * len(part)
                    continue
                near = vectors_of(part, m.idf) @ m.vectors.T
                at = near.argmax(1)
                top = np.clip(near[np.arange(len(part)), at].astype(np.float64), 0, 1)
                langs += [m.langs[k] if ok else UNDECIDED for k, ok in zip(at, letters, strict=True)]
                scores += np.where(letters, top, 0.0).tolist()
                far += (~letters | (1 - top > m.limits[at])).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(far, pa.bool_())], names=[id_col, "held_out", "lang_pred", "score", "rejected"])

    rows = documents.select(F.col(id_col), (F.lit(False) if held_out is None else held_out).alias("held_out"), F.col(text_col))
    return rows.mapInArrow(tidy(run), f"`{id_col}` {documents.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double, rejected boolean")


def held_out_of(id_col: str = "doc_id") -> Column:
    return fold(id_col, 4) == 2
