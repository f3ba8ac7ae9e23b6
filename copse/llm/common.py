"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import pickle
import re
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most keys that may count as heavy: a heavy key has over 1/HEAVY of the rows, so there are fewer than this.
HEAVY = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, for tables that cut the lineage.

    It is the one named in spark.checkpoint.dir. Only where none is set, as in tests on one machine, a folder in /tmp is
    set and used; on a cluster that is an error, as executors would write to disks of their own.
    """
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not made.isDefined() and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir should name a folder that all machines share")
        path = made.get() if made.isDefined() else "file:///tmp/checkpoints/copse"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: the lineage is cut, and a lost executor loses nothing.

    by: a column of few values, each of which has a folder of its own.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/copse-{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame, folder: str = "") -> None:
    """Deletes the table, or one folder of the table, of a stored() frame that nothing needs any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        if "/copse-" in file:
            path = jvm.org.apache.hadoop.fs.Path(f"{file[: file.index('/', file.index('/copse-') + 1)]}/{folder}".rstrip("/"))
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def heavy_keys(df: DataFrame, key: str) -> DataFrame:
    """The keys with over 1/HEAVY of the rows of df: fewer than HEAVY, whatever the size of df."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = df.count()
    return counts.where(F.col("_n") > total / HEAVY).select(key)


def keyed_join(big: DataFrame, small: DataFrame, key: str, dealt: bool = False) -> DataFrame:
    """Left join of big with small, which has one row for each key at most, where some keys may have a large share of big.

    Heavy keys number fewer than HEAVY, so their rows of small are broadcast; the other rows are shuffled, and no key of
    theirs has over 1/HEAVY of the rows. big is read twice and should be a stored table. dealt: the other rows are always
    shuffled, at every size, whatever the size of small.
    """
    heavy = heavy_keys(big, key).withColumn("_heavy", F.lit(True))
    marked = big.join(F.broadcast(heavy), key, "left")
    few = small.join(F.broadcast(heavy.select(key)), key, "left_semi")
    return (
        marked.where(F.col("_heavy")).drop("_heavy").join(F.broadcast(few), key, "left")
        .unionByName(marked.where(F.col("_heavy").isNull()).drop("_heavy").join(small.hint("merge") if dealt else small, key, "left"))
    )


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving freed memory back to the machine at its end: a Python worker lives on after its task."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL(None).malloc_trim(0)

    return inner


def fitted(rows: DataFrame, fit: Callable[..., object]) -> object:
    """What fit makes of the columns of rows, a bounded sample: run in one task, so that the driver needn't hold the rows.

    Rows are sorted, so that the result doesn't depend on how they come.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(zip(*(chain.from_iterable(x) for x in zip(*([c.to_pylist() for c in b.columns] for b in batches), strict=True)), strict=True))
        model = fit(*([list(c) for c in zip(*got, strict=True)] or [[] for _ in names]))
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    made = rows.repartition(1).mapInArrow(tidy(run), "model binary").first()
    return pickle.loads(made[0]) if made else fit(*([] for _ in names))  # no task runs where Spark knows that there are no rows


#: Name of the column that holds row_key().
KEY = "_copse_key"


def row_key(id_col: str, text_col: str) -> Column:
    """64 bits for a row's id and text; rows alike in both share it."""
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def marked(documents: DataFrame, marks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each row of documents whole, as a struct `row` in which no column name can clash, with its KEY and the columns of
    marks, which has a row for some keys; null where it has none."""
    whole = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), row_key(id_col, text_col).alias(KEY))
    return keyed_join(whole, marks, KEY, dealt=True)


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column as one large_string array; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(texts: pa.Array, most_bytes: int = 4_000_000, most_rows: int = 2048) -> Iterator[tuple[int, int]]:
    """Cuts rows into ranges of at most so many bytes and rows; a longer text is a range of its own."""
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)[1:] if len(texts) else []
    start, n = 0, len(texts)
    begun = np.frombuffer(texts.buffers()[1], np.int64, 1, 8 * texts.offset)[0] if n else 0
    while start < n:
        stop = int(np.searchsorted(ends, begun + most_bytes, side="right"))
        stop = min(max(stop, start + 1), start + most_rows, n)
        yield start, stop
        start, begun = stop, ends[stop - 1]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of all texts end to end, and where each begins, with the end last."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Table for bytes.translate and for numpy: A-Z become a-z, all else stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lowered(texts: pa.Array) -> pa.Array:
    """A-Z in lower case, other letters as they are."""
    data, offsets = text_bytes(texts)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(LOWER[data]))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space [\\x20\\x09-\\x0D], and where those of each text begin, with the end last."""
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    offsets = offsets - offsets[0]
    filled = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if not filled.all():
        before = np.concatenate([[0], np.cumsum(filled)])
        flat, offsets = flat.filter(pa.array(filled)), before[offsets]
    return flat, offsets


ODD = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD**i and its inverse modulo 2**64 for i < n."""
    if len(_POWERS.get("up", ())) < n:
        m = max(n, 1 << 20)
        for name, base in (("up", ODD), ("down", pow(ODD, -1, 1 << 64))):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def run_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for each run of bytes: a polynomial of its bytes, which running sums give for all at once, and mixed."""
    up, down = powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    h = (total[end] - total[begin]) * down[begin]
    for shift, factor in ((29, 0xBF58476D1CE4E5B9), (32, 0x94D049BB133111EB), (29, ODD)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(32))


def word_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 of all texts with A-Z lowered, where each word between ASCII white space begins and ends in it, and which
    word is the first of each text, with their number last."""
    data, offsets = text_bytes(texts)
    if not len(data):
        none = np.zeros(0, np.int64)
        return data, none, none, np.zeros(len(offsets), np.int64)
    data = LOWER[data]
    solid = ~SPACE[data]
    edge = solid.copy()
    edge[1:] &= ~solid[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    edge[first] = solid[first]
    begin = np.flatnonzero(edge)
    stop = solid.copy()
    stop[:-1] &= ~solid[1:]
    last = first[first > 0] - 1
    stop[last] = solid[last]
    return data, begin, np.flatnonzero(stop) + 1, np.searchsorted(begin, offsets)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64 bits for each word between ASCII white space, A-Z lowered, and where those of each text begin, with the end last."""
    data, begin, end, starts = word_spans(texts)
    return run_hashes(data, begin, end), starts
