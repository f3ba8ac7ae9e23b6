"""Token ids in files of the range coder: written in ascending order of document, and read back.

A file holds whole documents: blocks of ids, then a footer (an Arrow stream of each document's id and number of ids), the
footer's length and checksum. Its name tells its place: part-<task>-<file of the task>.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, shared_dir, slices, stored, strings, tidy
from .rangecoder import BLOCK, decode_block, encode_block
from .tokens import default_tokenizer, encoder

#: Ids in a file, about; a file ends with the document that reaches this.
FILE_IDS = BLOCK
TAIL = b"CXFT"
#: Distinct words that a Python worker keeps here, about 200 bytes each.
KEPT = 1_200_000


def to_bytes(ids: np.ndarray, footer: pa.RecordBatch) -> bytes:
    """The whole file."""
    with pa.BufferOutputStream() as sink:
        with pa.ipc.new_stream(sink, footer.schema) as w:
            w.write_batch(footer)
        foot = sink.getvalue().to_pybytes()
    blocks = [encode_block(ids[s : s + BLOCK]) for s in range(0, len(ids), BLOCK)]
    return b"".join([*blocks, foot, np.array([len(foot), crc32(foot)], "<u4").tobytes(), TAIL])


def from_bytes(data: bytes) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """All ids, the documents' own ids, and where each document begins, with the end last. Raises ValueError if damaged."""
    if data[-4:] != TAIL:
        raise ValueError("the file has no end")
    size, check = (int(x) for x in np.frombuffer(data[-12:-4], "<u4"))
    foot = data[len(data) - 12 - size : -12]
    if crc32(foot) != check:
        raise ValueError("the footer's checksum fails")
    table = pa.ipc.open_stream(foot).read_all().combine_chunks()
    starts = np.concatenate([[0], np.cumsum(np.asarray(table.column("n")))]).astype(np.int64)
    ids, at, end = [np.zeros(0, np.uint32)], 0, len(data) - 12 - size
    view = memoryview(data)
    while at < end:
        got, took = decode_block(view[at:end])
        ids.append(got)
        at += took
    whole = np.concatenate(ids)
    if len(whole) != starts[-1]:
        raise ValueError("ids are missing")
    docs = table.column("id").combine_chunks() if table.num_rows else pa.array([], table.schema.field("id").type)
    return whole, docs, starts


def write(documents: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end: int = 2) -> DataFrame:
    """Writes the ids of all texts, in order of id, as files below path; returns a row (task, file, path, ids) for each.

    Documents are dealt to tasks by ranges of id, so that the files follow one another. Rows of one id are ordered by a
    hash of their text, by which a large group of them is also dealt to several tasks; null ids come first. A task writes
    a file under another name and then renames it, so a task that runs again only puts the same file there again.
    """
    spark = documents.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        context = TaskContext.get()
        task, made, waiting = context.partitionId(), 0, 0
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        docs: list[pa.Array] = []

        def flush() -> pa.RecordBatch:
            nonlocal made, waiting
            footer = pa.RecordBatch.from_arrays([pa.concat_arrays(docs), pa.array(np.concatenate(sizes))], names=["id", "n"])
            data = to_bytes(np.concatenate(ids), footer)
            to = f"{root}/part-{task:06d}-{made:05d}.ctx"
            with fs.open_output_stream(f"{to}.{context.taskAttemptId()}") as f:
                f.write(data)
            fs.move(f"{to}.{context.taskAttemptId()}", to)
            out = pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int32()), "file": pa.array([made], pa.int32()), "path": [to], "ids": pa.array([waiting], pa.int64())})
            made, waiting = made + 1, 0
            for x in (ids, sizes, docs):
                x.clear()
            return out

        own = encoder(name, KEPT)
        for b in batches:
            texts = strings(b.column(1))
            for s, e in slices(texts, 8_000_000, 8192):
                got, starts = own.encode(texts.slice(s, e - s), end)
                ids.append(got)
                sizes.append(np.diff(starts))
                docs.append(b.column(0).slice(s, e - s))
                waiting += len(got)
                if waiting >= FILE_IDS:
                    yield flush()
        if waiting:
            yield flush()

    local = path.removeprefix("file://") if path.startswith("file:") else path
    fs, root = pafs.FileSystem.from_uri(path if "://" in path else local)
    fs.create_dir(root, recursive=True)
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).withColumn("h", F.xxhash64("t"))
    dealt = rows.repartitionByRange(tasks, F.col("id"), F.col("h")).sortWithinPartitions("id", "h").select("id", "t")
    return stored(dealt.mapInArrow(tidy(run), "task int, file int, path string, ids long"), "files")


def read(files: DataFrame, path: str, *, id_col: str = "doc_id", id_type: str = "bigint") -> DataFrame:
    """A row for each document in the files: its id, start, n_tokens and ids_crc32, in the files' order.

    What comes to the driver is a number for each file, from which it adds up where each file starts.
    """
    spark = files.sparkSession
    total, starts = 0, []
    for r in sorted(files.select("task", "file", "path", "ids").collect()):
        starts.append((r.path, total))
        total += r.ids
    rows = spark.createDataFrame(starts, "path string, first long").repartition(max(1, len(starts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(path)
        for b in batches:
            for name, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(name) as f:
                    ids, docs, at = from_bytes(f.read())
                raw, cut = memoryview(ids.astype("<u4")).cast("B"), (4 * at).tolist()
                crc = np.fromiter((crc32(raw[s:e]) for s, e in zip(cut, cut[1:], strict=False)), np.int64, len(docs))
                yield pa.RecordBatch.from_arrays([docs, pa.array(first + at[:-1]), pa.array(np.diff(at)), pa.array(crc)], names=[id_col, "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(tidy(run), f"`{id_col}` {id_type}, start long, n_tokens long, ids_crc32 long")


def round_trip(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end: int = 2, path: str | None = None) -> DataFrame:
    """Writes all documents' ids in files and tells from the files what is in them.

    Returns a row for each row: the id, start (ids of all documents before it), n_tokens (with the end id) and ids_crc32.
    Null and empty texts are the end id alone. Rows that repeat an id each have a row. An empty table gives no file. Other
    columns are ignored.
    """
    import uuid

    path = path or f"{shared_dir(documents.sparkSession)}/copse-ids-{uuid.uuid4().hex}"
    path = path if "://" in path else f"file://{path.removeprefix('file:')}"
    files = write(documents, path, id_col=id_col, text_col=text_col, tokenizer=tokenizer, end=end)
    out = read(files, path, id_col=id_col, id_type=documents.schema[id_col].dataType.simpleString())
    dropped(files)
    return out
