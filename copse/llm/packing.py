"""Packing of documents into sequences of a fixed length, by minimum bin slack."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, strings, tidy
from .tokens import default_tokenizer, encoder

#: Ids that one task packs at a time, about.
POOL = 4_000_000


def fill(lengths: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """The lengths, and how often each, whose sum comes closest to room without going over it.

    lengths: (length, how many there are), longest first. Bit s of a set of sums is on if some choice sums up to s. A
    length that is there n times is taken in lots of 1, 2, 4 ... and the rest, so any number of it can be made up. The
    sets before each lot are kept, and tell on the way back which lots were taken.
    """
    mask, sums, lots = (1 << (room + 1)) - 1, 1, []
    for length, n in lengths:
        if length > room:
            continue
        n, lot = min(n, room // length), 1
        while n > 0:
            take = min(lot, n)
            lots.append((length, take, sums))
            sums |= (sums << (length * take)) & mask
            n, lot = n - take, 2 * lot
        if sums >> room & 1:
            break
    best = sums.bit_length() - 1
    taken: Counter[int] = Counter()
    for length, take, before in reversed(lots):
        if not before >> best & 1:
            taken[length] += take
            best -= length * take
    return sorted(taken.items(), reverse=True)


def pack(doc: np.ndarray, start: np.ndarray, length: np.ndarray, size: int, last: bool) -> tuple[list[np.ndarray], list[tuple]]:
    """Sequences made of pieces, and what is left over (less than size ids in all; nothing if `last`).

    Each sequence is begun with the longest piece left and filled up by fill(). If that leaves slack, the longest piece of
    those not taken, which is longer than the slack, is cut in two. A way to fill a sequence is used as often as there are
    pieces for it. When fewer ids than a sequence are left, the sequences are the powers of two that they make up.

    A sequence set is an array of (doc, start, length, sequence, offset) rows.
    """
    out: list[np.ndarray] = []
    made = 0
    full = length // size
    if full.any():  # whole sequences of one document
        own = np.repeat(np.arange(len(doc)), full)
        k = np.arange(len(own)) - np.repeat(np.cumsum(full) - full, full)
        out.append(np.stack([doc[own], start[own] + k * size, np.full(len(own), size), np.arange(len(own)), np.zeros(len(own), np.int64)]))
        made = len(own)
    start, length = start + full * size, length - full * size
    pieces: dict[int, list[tuple[int, int]]] = {}
    for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True):
        if n:
            pieces.setdefault(n, []).append((d, s))
    total = int(length.sum())
    rows: list[tuple] = []
    order = sorted(pieces, reverse=True)
    while total >= size or last and total:
        room = size if total >= size else 1 << (total.bit_length() - 1)
        taken: list[tuple[int, int]] = []
        if order[0] <= room:
            counts = [(n, len(pieces[n]) - (i == 0)) for i, n in enumerate(order)]
            taken = sorted((Counter({order[0]: 1}) + Counter(dict(fill(counts, room - order[0])))).items(), reverse=True)
        slack = room - sum(n * k for n, k in taken)
        used = dict(taken)
        times = min([len(pieces[n]) // k for n, k in taken] or [1]) if room == size else 1
        cut = 0
        if slack:
            cut = next(n for n in order if len(pieces[n]) > used.get(n, 0))
            times = min(times, len(pieces[cut]) // (used.get(cut, 0) + 1)) if room == size else 1
        for t in range(times):
            at = 0
            for n, k in taken:
                for _ in range(k):
                    d, s = pieces[n].pop()
                    rows.append((d, s, n, made, at))
                    at += n
            if slack:
                d, s = pieces[cut].pop()
                rows.append((d, s, slack, made, at))
                if cut - slack not in pieces:
                    pieces[cut - slack] = []
                pieces[cut - slack].append((d, s + slack))
            made += 1
            total -= room
        order = sorted((n for n, x in pieces.items() if x), reverse=True)
        pieces = {n: pieces[n] for n in order}
    if rows:
        out.append(np.array(rows, np.int64).T)
    return out, [(d, s, n) for n in order for d, s in pieces[n]]


def packed(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, tokenizer: str | None = None, end: int = 2) -> DataFrame:
    """Packs the ids of all documents into sequences of `size` (a power of two), without padding.

    Each task packs what it reads, about POOL ids at a time, into full sequences, and sets less than one sequence aside;
    what all tasks have set aside is packed once more, and only there do sequences come out shorter: they have lengths of
    powers of two, which need no padding. No step needs more than its own pool in memory, and nothing but the remainders,
    under `size` ids a pool, is shuffled.

    Returns a row for each piece: the id, start (its document's ids before it), length, ids_crc32, doc_tokens (with the end
    id), sequence_id and offset in the sequence. Null and empty texts are the end
    id alone. Rows that repeat an id are packed each for itself; null ids are kept. Other columns are ignored.
    """
    spark = documents.sparkSession
    name = tokenizer or default_tokenizer()
    id_type = documents.schema[id_col].dataType.simpleString()
    kinds = f"`{id_col}` {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, rest binary"

    def batch(names: pa.Array, ids: np.ndarray, begin: np.ndarray, base: np.ndarray, tokens: np.ndarray, doc: np.ndarray, start: np.ndarray, length: np.ndarray, sequence: np.ndarray | None, offset: np.ndarray | None) -> pa.RecordBatch:
        """begin: where a row's ids are; base: how many of its document's ids stand before those."""
        raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        spots = zip((4 * (begin[doc] + start)).tolist(), (4 * (begin[doc] + start + length)).tolist(), strict=True)
        if sequence is None:
            data = pa.array([bytes(raw[s:e]) for s, e in spots], pa.binary())
            crc, none = pa.nulls(len(doc), pa.int64()), pa.nulls(len(doc), pa.int64())
            tail = [none, none, data]
        else:
            crc = pa.array(np.fromiter((crc32(raw[s:e]) for s, e in spots), np.int64, len(doc)))
            tail = [pa.array(sequence), pa.array(offset), pa.nulls(len(doc), pa.binary())]
        return pa.RecordBatch.from_arrays([names.take(pa.array(doc)), pa.array(base[doc] + start), pa.array(length), crc, pa.array(tokens[doc]), *tail], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "rest"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, base = encoder(name), TaskContext.get().partitionId() << 36
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        docs: list[pa.Array] = []
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base
            whole, names, n = np.concatenate(ids), pa.concat_arrays(docs), np.concatenate(sizes)
            begin, zero = np.cumsum(n) - n, np.zeros(len(n), np.int64)
            got, left = pack(np.arange(len(n)), zero, n, size, False)
            for d, s, m, q, o in got:
                yield batch(names, whole, begin, zero, n, d, s, m, base + q, o)
            if got:
                base += 1 + max(int(x[3].max()) for x in got)
            if left:
                d, s, m = np.array(left, np.int64).T
                yield batch(names, whole, begin, zero, n, d, s, m, None, None)
            for x in (ids, sizes, docs):
                x.clear()

        for b in batches:
            texts = strings(b.column(1))
            for s, e in slices(texts, 4_000_000, 4096):
                got, starts = own.encode(texts.slice(s, e - s), end)
                ids.append(got)
                sizes.append(np.diff(starts))
                docs.append(b.column(0).slice(s, e - s))
                waiting += len(got)
                if waiting >= POOL:
                    yield from flush()
                    waiting = 0
        if waiting:
            yield from flush()
        own.clear()  # the worker lives on, and a task learns more words than are kept

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (1 << 62) | TaskContext.get().partitionId() << 36
        pool: list[pa.RecordBatch] = []
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base, waiting
            t = pa.Table.from_batches(pool).combine_chunks()
            n = np.asarray(t.column("length"))
            whole = np.frombuffer(b"".join(t.column("rest").to_pylist()), "<u4")
            begin, zero = np.cumsum(n) - n, np.zeros(len(n), np.int64)
            got, _ = pack(np.arange(len(n)), zero, n, size, True)
            names = t.column(id_col).combine_chunks()
            for d, s, m, q, o in got:
                yield batch(names, whole, begin, np.asarray(t.column("start")), np.asarray(t.column("doc_tokens")), d, s, m, base + q, o)
            base += 1 + max(int(x[3].max()) for x in got)
            pool.clear()
            waiting = 0

        for b in batches:
            if b.num_rows:
                pool.append(b)
                waiting += int(np.asarray(b.column(2)).sum())
            if waiting >= POOL:
                yield from flush()
        if waiting:
            yield from flush()

    rows = documents.select(F.col(id_col), F.col(text_col))
    pieces = stored(rows.mapInArrow(tidy(first), kinds), "pieces")
    rest = pieces.where(F.col("sequence_id").isNull())
    total = rest.agg(F.sum("length")).first()[0] or 0
    last = rest.repartition(-(-total // POOL) or 1).sortWithinPartitions(id_col, "start", "length").mapInArrow(tidy(second), kinds)
    return pieces.where(F.col("sequence_id").isNotNull()).unionByName(last).drop("rest")
