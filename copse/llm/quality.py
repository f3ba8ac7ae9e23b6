"""Quality by importance resampling: the ratio of hashed n-gram models of target and raw text, with Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import ODD, lowered, run_hashes, slices, stored, strings, text_bytes, tidy

BITS = 14
#: So many n-grams of the target are taken to be as in the raw text.
PRIOR = 1000
#: Bytes of words (digits, letters, _, all beyond ASCII), of white space, and others.
KIND = np.full(256, 2, np.uint8)
KIND[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = 1
KIND[[9, 10, 11, 12, 13, 32]] = 0


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each text's n-grams, and where those of each text begin, with the end last.

    Tokens are runs of word characters and runs of others, A-Z lowered; the n-grams are tokens and pairs of neighbours.
    A token equal to the one before it counts as one and the same n-gram whatever the token, and so does a token equal
    to the one two before.
    """
    data, offsets = text_bytes(lowered(texts))
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = KIND[data]
    edge = np.ones(len(data), bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    begin = np.flatnonzero(edge)
    end = np.append(begin[1:], len(data))
    keep = kind[begin] > 0
    begin, end = begin[keep], end[keep]
    token = run_hashes(data, begin, end)
    starts = np.searchsorted(begin, offsets)
    own = np.repeat(np.arange(len(offsets) - 1), np.diff(starts))
    bucket = lambda h: (((h ^ (h >> np.uint64(32))) * np.uint64(ODD)) >> np.uint64(64 - BITS)).astype(np.int64)
    pair = token[:-1] * np.uint64(31) + token[1:]
    beside = own[1:] == own[:-1]
    same = beside & (token[1:] == token[:-1])
    pair = np.where(same, np.uint64(1), pair)
    again = (own[2:] == own[:-2]) & (token[2:] == token[:-2])
    found = [bucket(token), bucket(pair)[beside], bucket(np.full(again.sum(), 2, np.uint64))]
    owner = [own, own[1:][beside], own[2:][again]]
    code, own = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(own, kind="stable")
    return code[order], np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(offsets) - 1))])


def counted(documents: DataFrame, text_col: str) -> np.ndarray:
    """How often each bucket occurs in all texts: one row of counts a partition comes together bucket by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for b in batches:
            texts = strings(b.column(0))
            for s, e in slices(texts, 1_000_000):
                total += np.bincount(features(texts.slice(s, e - s))[0], minlength=1 << BITS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(1 << BITS)
    for r in documents.select(text_col).mapInArrow(tidy(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def log_ratios(texts: pa.Array, ratio: np.ndarray) -> np.ndarray:
    """The log importance weight of each text: what the target's model gives it against the raw text's."""
    code, starts = features(texts)
    total = np.concatenate([[0.0], np.cumsum(ratio[code])])
    return total[starts[1:]] - total[starts[:-1]]


def ratio_of(wanted: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """The log ratio of each bucket; the raw text's shares stand in for PRIOR n-grams of the target's."""
    prior = (raw + 1) / (raw + 1).sum()
    target = (wanted + PRIOR * prior) / (wanted.sum() + PRIOR)
    return np.log(target) - np.log(prior)


def gumbel(*parts: Column | int) -> Column:
    """Gumbel noise from a hash: the same on a rerun, another for another seed."""
    u = (F.pmod(F.xxhash64(*(p if isinstance(p, Column) else F.lit(p) for p in parts)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(values: DataFrame, col: str, k: int) -> float:
    """The k-th largest value, found by narrowing a histogram; exact. Values are finite."""
    low, high = values.agg(F.min(col), F.max(col)).first()
    above = 0
    while high > low:
        width = (high - low) / 4096
        if low + width <= low:
            break
        at = F.least(F.floor((F.col(col) - low) / width), F.lit(4095))
        inside = values.where((F.col(col) >= low) & (F.col(col) <= high))
        for r in inside.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("low"), F.max(col).alias("high")).orderBy(F.desc("at")).collect():
            if above + r.n >= k:
                low, high = r.low, r.high
                break
            above += r.n
    return high


def resample(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", share: float | None = None, per_class: int = 3000, seed: int = 9, carry: bool = False) -> DataFrame:
    """Draws documents that are like the target text, which are those labelled 1.

    Two generative models over hashed n-grams: of the target, from a bounded sample of its labelled rows (at most about
    `per_class`, those of least hashed id), and of the raw text, from all documents. log_ratio, the log importance weight
    of a document, is the log of the ratio of what both give to its whole text. Of n documents k = share * n (rounded) are
    drawn without replacement, by these weights: they are those with the k largest of log_ratio + Gumbel noise. Without a
    `share`, it is that of the target among all labelled rows, and a standard error more, as a draw too small would lose
    some of the target. So the noise decides between documents whose weights are a
    few factors of e apart, and hardly between others. It comes from the seed, the id and the text, so a rerun draws the
    same.

    Returns a row for each row: the id, log_ratio, gumbel_key and kept. Null and empty texts have log_ratio 0. Repeated
    rows share a key; if the k-th largest key is tied, all of its rows are kept. Without labels all are kept, and without
    a labelled target, of which nothing is known then, none. Other columns are ignored. carry: returns the rows of
    documents that are kept instead, with all their columns.
    """
    spark = documents.sparkSession
    marks = labels.where(F.col(label_col).isNotNull() & F.col(label_id_col).isNotNull()).select(F.col(label_id_col).alias("_lid"), (F.col(label_col) > 0).cast("int").alias("_y"), F.pmod(F.xxhash64(label_id_col), F.lit(1 << 30)).alias("_at"))
    sizes = {r._y: r["count"] for r in marks.groupBy("_y").count().collect()}
    if share is None:
        n = sum(sizes.values())
        share = sizes.get(1, 0) / n if n else 1.0
        share += (share * (1 - share) / max(1, n)) ** 0.5
    few = int(min(1.0, per_class / max(1, sizes.get(1, 1))) * (1 << 30))
    chosen = marks.where((F.col("_y") == 1) & (F.col("_at") <= few)).select("_lid").distinct()
    docs = documents.select(F.col(id_col), F.col(text_col))
    # The sample of labels is bounded, so it goes to the documents.
    target = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("_lid"), "left_semi")
    ratio = ratio_of(counted(target, text_col), counted(docs, text_col))
    shared = spark.sparkContext.broadcast(ratio)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = strings(b.column(0).field(text_at))
            found = [np.zeros(0), *(log_ratios(texts.slice(s, e - s), shared.value) for s, e in slices(texts, 1_000_000))]
            yield pa.RecordBatch.from_arrays([b.column(0) if carry else pa.StructArray.from_arrays([b.column(0).field(0)], [id_col]), pa.array(np.concatenate(found)), b.column(1)], names=["row", "log_ratio", "noise"])

    columns = documents.columns if carry else [id_col, text_col]
    text_at = columns.index(text_col)
    given = documents.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), gumbel(seed, F.col(id_col), F.col(text_col)).alias("noise"))
    row = given.schema["row"] if carry else StructField("row", StructType([documents.schema[id_col]]))
    kinds = StructType([row, StructField("log_ratio", DoubleType()), StructField("noise", DoubleType())])
    scored = stored(given.mapInArrow(tidy(run), kinds).select("row", "log_ratio", (F.col("log_ratio") + F.col("noise")).alias("gumbel_key")), "weights")
    k = round(share * scored.count())
    least = kth_largest(scored.select("gumbel_key"), "gumbel_key", k) if k else float("inf")
    enough = F.col("gumbel_key") >= F.lit(least)
    if carry:
        return scored.where(enough).select("row.*")
    return scored.select(f"row.`{id_col}`", "log_ratio", "gumbel_key", enough.alias("kept"))
