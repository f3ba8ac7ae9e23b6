"""Exact top-k search by inner product, as a Voronoi kNN join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, tidy

#: Rows of data in one block at most, about; larger cells are cut into several blocks.
BLOCK = 8192


def as_integers(x: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(scale * x.astype(np.float64)).astype(np.int64)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products: by BLAS while doubles are exact, else with 64-bit integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def best(s: np.ndarray, qid: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of scores its k highest, without the query's own row; ids ascend, so ties go to the smaller."""
    lowest = np.iinfo(np.int64).min
    own = ids[None, :] == qid[:, None]
    s = np.where(own, lowest, s)
    take = min(k, s.shape[1])
    limit = np.partition(s, s.shape[1] - take, axis=1)[:, s.shape[1] - take]
    rows, cols = [], []
    for i in range(len(s)):
        above = np.flatnonzero(s[i] > limit[i])
        level = np.flatnonzero((s[i] == limit[i]) & ~own[i])[: take - len(above)]
        found = np.concatenate([above, level])
        rows.append(np.full(len(found), i))
        cols.append(found)
    i, j = np.concatenate(rows), np.concatenate(cols)
    keep = ~own[i, j]
    i, j = i[keep], j[keep]
    return i, j, s[i, j]


def top_k(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50, scale: int = 256, pivots: int = 48, sample: int = 4096) -> DataFrame:
    """The k rows of highest integer inner product for each query, the rows whose id is divisible by `every`.

    1. `pivots` pivots are fitted on a bounded sample (at most about `sample` rows, those of least hashed id); the sample
       decides only how much is pruned, never what is found. 2. Each row goes to its nearest pivot. 3. Each cell is
       summed up: rows, radius, and the k+1 ids of least distance to the pivot. 4. From the summaries each query derives a
       score that k rows of other ids are sure to reach: a row at distance r from pivot p scores at least q.p - |q|r. It is sent
       only to cells that could beat it: no row of a cell of radius R scores over q.p + |q|R. 5. Cells are cut into
       blocks of about BLOCK rows, each solved where it lies, and the k best over all blocks are kept.

    Returns (query_id, rank from 1, vec_id, score); ties go to the smaller id, and a query with fewer candidates gets
    all. Vectors that are null, empty, or hold null or non-finite components take no part, nor do null ids. Vectors of
    another length than most of the sample are compared with none but those of their own length. Rows with the query's
    own id are not its candidates; a repeated id is one query, by the least of its vectors, while each of its rows is a candidate of others. Components have to stay
    under 2**31 / scale for scores to fit 64 bits. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    v = F.col(vector_col).cast("array<double>")
    sound = F.col(id_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.where(sound).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"))
    rows = rows.withColumn("dim", F.size("v"))
    n = rows.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not n:
        return empty
    share = min(1.0, sample / n)
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * sample)
    fitted: dict[int, np.ndarray] = {}
    got = picked.toPandas()
    rng = np.random.default_rng(0)
    for dim, part in got.groupby("dim"):
        x = np.array(part["v"].tolist(), np.float64)
        p = x[rng.permutation(len(x))[:pivots]]
        for _ in range(5):
            near = ((x**2).sum(1)[:, None] - 2 * x @ p.T + (p**2).sum(1)).argmin(1)
            p = np.stack([x[near == c].mean(0) if (near == c).any() else p[c] for c in range(len(p))])
        fitted[int(dim)] = p

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            dims = np.asarray(b.column(2))
            cell, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = np.asarray(b.column(1).take(pa.array(at)).flatten()).reshape(len(at), dim).astype(np.float64)
                p = fitted.get(int(dim), np.zeros((1, dim)))
                d = np.stack([((x - y) ** 2).sum(1) for y in p])
                cell[at] = d.argmin(0)
                far[at] = np.sqrt(d.min(0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(cell), pa.array(far)], names=["id", "v", "dim", "cell", "far"])

    placed = stored(rows.mapInArrow(tidy(place), "id long, v array<long>, dim int, cell int, far double"), "placed")
    # A summary for each cell: its size, its radius and the k+1 ids nearest to the pivot.
    sizes = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"), F.count_if(F.col("id") % every == 0).alias("asked"))
    # Rows of one id count once there, as none of them may be a candidate.
    ids = placed.groupBy("dim", "cell", "id").agg(F.min("far").alias("far"))
    nearest = ids.groupBy("dim", "cell", F.spark_partition_id()).agg(F.slice(F.sort_array(F.collect_list(F.struct("far", "id"))), 1, k + 1).alias("near"))
    nearest = nearest.groupBy("dim", "cell").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    summary = {(r.dim, r.cell): r for r in sizes.join(nearest, ["dim", "cell"]).collect()}
    cells: dict[int, list] = {}
    for (dim, c), r in sorted(summary.items()):
        cells.setdefault(dim, []).append((c, r.n, r.radius, [(x.far, x.id) for x in r.near], max(1, -(-r.n // BLOCK))))
    first, total = {}, 0
    for dim, own in cells.items():
        for c, *_, blocks in own:
            first[dim, c] = (total, blocks)
            total += blocks

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for every block of the cells that it needs."""
        for b in batches:
            for i in range(b.num_rows):
                dim = b.column(2)[i].as_py()
                q = np.asarray(b.column(1).slice(i, 1).flatten()).astype(np.float64)
                own = cells[dim]
                p = fitted.get(dim, np.zeros((1, dim)))[[c for c, *_ in own]]
                size = np.sqrt((q**2).sum())
                mid = p @ q
                # The query's own id is no candidate, in whichever cells its rows lie.
                asker = b.column(0)[i].as_py()
                sure = np.sort([m - size * far for m, (*_, near, _) in zip(mid, own, strict=True) for far, x in near if x != asker])[::-1]
                reach = sure[k - 1] if len(sure) >= k else -np.inf
                slack = 1e-6 * (1 + size * (1 + np.abs(p).max())) * dim
                to = [first[dim, c] for (c, _, radius, *_), m in zip(own, mid, strict=True) if m + size * radius + slack >= reach - slack]
                blocks = [x for f, many in to for x in range(f, f + many)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(blocks, pa.int32()), pa.array(np.ones(len(blocks), np.int8)), b.column(0).take(pa.array([i] * len(blocks))), b.column(1).take(pa.array([i] * len(blocks)))],
                    names=["block", "kind", "id", "v"],
                )

    where = F.create_map(*[F.lit(x) for (dim, c), (f, many) in first.items() for x in (f"{dim},{c}", (f << 32) | many)])
    spot = F.element_at(where, F.concat_ws(",", "dim", "cell"))
    block = (F.shiftright(spot, 32) + F.pmod(F.xxhash64("id", F.lit(7)), spot.bitwiseAND(F.lit((1 << 32) - 1)))).cast("int")
    data = placed.select(block.alias("block"), F.lit(0).cast("byte").alias("kind"), "id", "v")
    asked = placed.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("v", "dim")).alias("q")).select("id", "q.v", "q.dim").mapInArrow(tidy(needed), "block int, kind byte, id long, v array<long>")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by block, data before queries; a block's data are held, its queries pass by."""
        held, parts, x, ids = None, [], None, None
        for b in batches:
            blocks, kinds = np.asarray(b.column(0)), np.asarray(b.column(1))
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
            for s, e in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if s == e:
                    continue
                if blocks[s] != held:
                    held, parts, x = int(blocks[s]), [], None
                m, got = np.asarray(b.column(3).slice(s, e - s).flatten()).reshape(e - s, -1), np.asarray(b.column(2).slice(s, e - s))
                if kinds[s] == 0:
                    parts.append((got, m))
                    continue
                if x is None and parts:
                    ids = np.concatenate([i for i, _ in parts])
                    order = np.argsort(ids, kind="stable")
                    ids, x = ids[order], np.concatenate([y for _, y in parts])[order]
                    parts = []
                if x is None:
                    continue
                for f in range(0, len(got), 512):
                    i, j, sc = best(scores(m[f : f + 512], x), got[f : f + 512], ids, k)
                    yield pa.RecordBatch.from_arrays([pa.array(got[f : f + 512][i]), pa.array(ids[j]), pa.array(sc)], names=["query_id", "vec_id", "score"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    solved = data.union(asked).repartition(tasks, "block").sortWithinPartitions("block", "kind").mapInArrow(tidy(solve), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return solved.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
