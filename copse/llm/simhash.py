"""SimHash fingerprints, and near duplicates from a byte-position index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, LOWER, keyed_join, marked, row_key, slices, stored, strings, text_bytes, tidy
from .components import connected

SEED = 42
#: Postings of up to so many fingerprints are compared pair by pair; longer ones are linked through common neighbours.
PAIRED = 64
FOLD = LOWER.tobytes()


def fingerprints_of(texts: pa.Array, shingle: int = 3) -> np.ndarray:
    """The 64-bit SimHash of each text, as uint64. A text without words has zero."""
    data, offsets = text_bytes(texts)
    whole = data.tobytes().translate(FOLD)
    h64 = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i in range(len(texts)):
        words = whole[offsets[i] : offsets[i + 1]].split()
        if not words:
            continue
        if len(words) <= shingle:
            hashes.append(h64(b" ".join(words), SEED))
            counts[i] = 1
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        firsts = np.concatenate([[0], ends[: len(words) - shingle] + 1]).tolist()
        hashes += [h64(line[s:e], SEED) for s, e in zip(firsts, ends[shingle - 1 :].tolist(), strict=True)]
        counts[i] = len(firsts)
    out = np.zeros(len(texts), np.uint64)
    if hashes:
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        some = np.flatnonzero(counts)
        begins = np.cumsum(counts[some]) - counts[some]
        sums = np.add.reduceat(bits, begins, axis=0, dtype=np.int32)
        most = (2 * sums > counts[some, None]).astype(np.uint8)
        out[some] = np.packbits(most, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """A row (id, key, fp long) for each row; null and empty texts have fingerprint 0. key: row_key() of the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = strings(b.column(1))
            found = [fingerprints_of(texts.slice(s, e - s), shingle) for s, e in slices(texts, 1_000_000)]
            fp = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp.view(np.int64))], names=[id_col, KEY, "fp"])

    ids = documents.select(F.col(id_col), F.col(text_col), row_key(id_col, text_col).alias(KEY))
    return ids.mapInArrow(tidy(run), f"`{id_col}` {documents.schema[id_col].dataType.simpleString()}, {KEY} long, fp long")


def byte_at(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))


def shared_bytes(a: str, b: str) -> Column:
    """How many of the 8 byte positions hold the same byte."""
    x = F.col(a).bitwiseXOR(F.col(b))
    return sum((F.when(byte_at(x, i) == 0, 1).otherwise(0) for i in range(8)), F.lit(0))


def pair_masks() -> list[tuple[int, list[int]]]:
    """For each choice of two of the four groups of two positions: the mask of their bits, and the other four positions."""
    out = []
    for groups in combinations(range(4), 2):
        mask = sum(0xFFFF << (16 * g) for g in groups)
        out.append((mask - (1 << 64) if mask >> 63 else mask, [i for i in range(8) if i // 2 not in groups]))
    return out


def tallied(posts: DataFrame, least: int) -> DataFrame:
    """Rows (k, a, b, hits), a < b: the pairs that meet in `least` or more of the 8 byte positions' posting lists.

    posts: (k, key, fp), where the fingerprints of one k and key share the four positions of mask k. These are four hits;
    each fingerprint is filed under its byte at each of the other positions, a pair's further hits are the lists that hold
    both, and pairs without enough hits go before any bits are compared. With least over 4, pairs without a further hit
    aren't even made.
    """
    other = F.array(*(F.array(*(F.struct(F.lit(i).alias("i"), byte_at(F.col("fp"), i).alias("byte")) for i in rest)) for _, rest in pair_masks()))
    filed = posts.select("k", "key", "fp", F.explode(F.element_at(other, F.col("k") + 1)).alias("at")).select("k", "key", "at.i", "at.byte", "fp")
    lists = filed.groupBy("k", "key", "i", "byte").agg(F.sort_array(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    pairs = lists.select("k", F.posexplode("fps").alias("place", "a"), "fps").select("k", "a", F.explode(F.slice("fps", F.col("place") + 2, PAIRED)).alias("b"))
    return pairs.groupBy("k", "a", "b").agg((F.count(F.lit(1)) + 4).alias("hits")).where(F.col("hits") >= least)


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, whose graph has the components of all pairs of distinct fingerprints that differ in at most
    `distance` bits (0 to 2).

    Such a pair has different bytes in at most `distance` of 8 positions, so it must meet in 8 - distance of the posting
    lists by byte and position: that is the least count of the tally. A list of one byte would hold a 256th of all
    fingerprints and the lists give the square of that in pairs, so those of several positions are intersected beforehand:
    the positions are four groups of two, and any pair that can reach the count shares two whole groups, so it meets under
    at least one of their six combinations, each of 32 bits. Within such a posting the lists of the other positions are
    made, and a pair's hits in them are counted (see tallied); only pairs with enough hits are verified bit by bit.

    A posting with more than PAIRED fingerprints, as of a large group of near copies, isn't paired. There each
    fingerprint is filed under itself and under the 32 changes of one bit outside the shared bytes: two fingerprints
    differ in at most two bits just if they are filed under a common value (1 and 2 bits: with distance 1, the value is
    one of the two, which the verification sees to). At most 33 distinct fingerprints share such a value, so the pairs
    stay linear in the number of fingerprints, and every link within the posting is still found.
    """
    least = 8 - distance
    masks = [m for m, _ in pair_masks()]
    keyed = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)))).alias("p")).select("fp", "p.k", "p.key")
    sizes = keyed.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    posts = stored(keyed.join(sizes, ["k", "key"]), "postings")
    pairs = tallied(posts.where(F.col("n") <= PAIRED), least).select("a", "b").distinct()

    flips = [F.array(*(F.lit(0) if x < 0 else F.lit(1 << x if x < 63 else -(1 << 63)) for x in [-1, *(i for i in range(64) if not (m >> i) & 1)])) for m in masks]
    changed = F.element_at(F.array(*flips), F.col("k") + 1)
    filed = posts.where(F.col("n") > PAIRED).select("k", "fp", F.explode(F.transform(changed, lambda x: F.col("fp").bitwiseXOR(x))).alias("near"))
    groups = filed.groupBy("k", "near").agg(F.sort_array(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    # All of a group lie within two bits of each other; where two are asked for, each is linked to the first.
    if distance == 2:
        near = groups.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, PAIRED)).alias("b"))
    else:
        near = groups.select(F.posexplode("fps").alias("i", "a"), "fps").select("a", F.explode(F.slice("fps", F.col("i") + 2, PAIRED)).alias("b"))
    return (
        pairs.union(near.where(shared_bytes("a", "b") >= least))
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )


def grouped(documents: DataFrame, id_col: str, text_col: str, shingle: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and for each distinct one a fingerprint that stands for its component."""
    prints = stored(fingerprints(documents, id_col=id_col, text_col=text_col, shingle=shingle), "prints")
    distinct = stored(prints.groupBy("fp").agg(F.min(id_col).alias("low")), "distinct")
    linked = connected(links(distinct.select("fp"), distance))
    roots = distinct.join(linked.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    return prints, stored(roots, "roots")


def near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """The fingerprint of each document and the smallest id that it can reach over links of at most `distance` bits.

    Returns a row for each row: the id, fingerprint (16 lowercase hex digits) and component_id. Null and empty texts,
    and texts of white space, have fingerprint zero and are linked with each other and with any other fingerprint near
    zero. Equal fingerprints are one vertex, so repeated rows and exact copies cost no pairs. Null ids are carried; a
    component of null ids alone has a null component_id. Other columns are ignored.
    """
    prints, roots = grouped(documents, id_col, text_col, shingle, distance)
    lows = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    named = stored(keyed_join(roots, lows, "root").select("fp", "component_id"), "named")
    return keyed_join(prints, named, "fp").select(
        F.col(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def representatives(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """One row of each component of near duplicates, with all its columns: that with the smallest id.

    Null ids come after all others; of rows with the same id and text one stays, and of rows with the same id and other
    texts in the same component, the one of the least hash.
    """
    prints, roots = grouped(documents, id_col, text_col, shingle, distance)
    return least_rows(documents, prints.withColumnRenamed(id_col, "id"), roots, id_col, text_col)


def least_rows(documents: DataFrame, prints: DataFrame, roots: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The least row of each component. prints: (id, KEY, fp) of all rows; roots: (fp, root) of all fingerprints."""
    # The least row of each fingerprint, then of each component.
    order = F.struct(F.col("id").isNull().alias("none"), "id", F.col(KEY).alias("key"))
    least = prints.groupBy("fp", KEY).agg(F.min(order).alias("row"), F.count(F.lit(1)).alias("n"))
    least = least.groupBy("fp").agg(F.min(F.struct("row", "n")).alias("best"))
    best = least.join(roots.select("fp", "root"), "fp").groupBy("root").agg(F.min("best").alias("best"))
    keep = stored(best.select(F.col("best.row.key").alias(KEY), F.col("best.n").alias("_times")), "kept")
    found = marked(documents, keep, id_col, text_col).where(F.col("_times").isNotNull())
    # Repeated rows come down to one before they are shuffled.
    many = found.where("_times > 1").groupBy(KEY).agg(F.first("row").alias("row"))
    return found.where("_times = 1").select("row.*").unionByName(many.select("row.*"))
