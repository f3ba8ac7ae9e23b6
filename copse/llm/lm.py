"""Language-model scores from a weighted backoff automaton.

States are START, the words seen in training (what was read last) and the root. The state of h has an arc to w for every w
seen after it, with (1 - l) c(hw)/c(h) + l P(w), and a failure arc with weight l to the root, which reads nothing. The root
has an arc to w for every known word, with P(w) = (1 - e) c(w)/N + e S(w), and a failure arc with weight e to a spelling
automaton S over bytes, whose states are the last two bytes, with failure arcs to one and none; its end leads back to the
root. A text is read once from left to right: the state is carried along, and the log10 weights of all arcs taken, failure
arcs among them, are added up. The weights of what a state can read sum to one, so the sum is the log10 probability of the
text, and it depends on the table alone, not on how its rows lie.

e is the share of words seen once (Good-Turing). l = T(c)/(T(c) + c), as Witten and Bell have it for a state seen c times
with T successors; T(c) = c**b, where b is chosen so that the successors of all states sum up to the number of distinct
pairs.

The automaton of a large corpus fits on no machine, so it is spread: texts are cut into blocks, each block names its
distinct words and pairs to the shards that own them, the shards sum up the counts of all blocks and answer with the totals,
and each block builds the part of the automaton that its texts can reach, and reads them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, fold, run_hashes, slices, stored, strings, text_bytes, tidy, word_spans

#: Bytes of text in a block, about; one text is never cut.
BLOCK = 3_000_000
#: Hashes of the end, which counts as a token, and of the start, which doesn't.
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Counts are told apart in so many steps, BINS to a factor of two, to find the growth of successors.
STEPS, BINS = 512, 8


def planes(values: np.ndarray) -> bytes:
    """The bytes of numbers, all first bytes, then all second bytes and so on, compressed."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()
    return packed(raw)


def unplanes(data: bytes, kind: type) -> np.ndarray:
    raw = unpacked(data)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, len(raw) // width).T).reshape(-1).view(kind)


def packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def hashes_of(words: list[bytes]) -> np.ndarray:
    """64 bits for each word; the end is the word without bytes."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size)
    out = run_hashes(np.frombuffer(b"".join(words), np.uint8), end - size, end)
    out[size == 0] = END
    return out


def pair_keys(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """56 bits for each pair of hashes, in the upper bytes of 64: the last byte, always zero, costs nothing to send."""
    key = before * np.uint64(0x9E3779B97F4A7C15) + after
    key ^= key >> np.uint64(32)
    key *= np.uint64(0xD6E8FEB86659FD93)
    return (key ^ (key >> np.uint64(29))) & ~np.uint64(255)


def pairs_of(ids: np.ndarray, sizes: np.ndarray, words: int) -> np.ndarray:
    """state * words + id of each token, where the state is the id before it and START's is `words`."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum(sizes) - sizes] = words
    return before * words + ids


def cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where the keys of each shard begin in a sorted array, with the end last: shards own ranges of equal width."""
    edges = np.array([(i << 64) // shards for i in range(1, shards)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


class Spelling:
    """Interpolated Witten-Bell automaton over the bytes of words, each ended by a space, from counts of byte triples."""

    def __init__(self, code: np.ndarray, n: np.ndarray) -> None:
        order = np.argsort(code)
        self.code, self.n = code[order], n[order].astype(np.float64)
        self.two, at = np.unique(self.code >> 8, return_inverse=True)
        self.two_n, self.two_kinds = np.bincount(at, self.n), np.bincount(at).astype(np.float64)
        self.pair, at = np.unique(self.code & 0xFFFF, return_inverse=True)
        self.pair_n = np.bincount(at, self.n)
        self.one, at = np.unique(self.pair >> 8, return_inverse=True)
        self.one_n, self.one_kinds = np.bincount(at, self.pair_n), np.bincount(at).astype(np.float64)
        self.byte_n = np.bincount(self.code & 0xFF, self.n, 256)
        total, kinds = self.byte_n.sum(), float((self.byte_n > 0).sum())
        self.byte_p = (self.byte_n + (kinds + 1) / 256) / (total + kinds + 1)

    @staticmethod
    def found(table: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, values[at], 0.0)

    def log10(self, words: list[bytes]) -> np.ndarray:
        """log10 of S for each word; the end is the word without bytes."""
        code, own = triples(words)
        p = self.byte_p[code & 0xFF]
        for keys, values, context, n, kinds, mask in ((self.pair, self.pair_n, self.one, self.one_n, self.one_kinds, 0xFFFF), (self.code, self.n, self.two, self.two_n, self.two_kinds, 0xFFFFFF)):
            c, k = (self.found(context, x, (code & mask) >> 8) for x in (n, kinds))
            p = np.where(c > 0, (self.found(keys, values, code & mask) + k * p) / np.maximum(c + k, 1), p)
        return np.bincount(own, np.log10(p), len(words))


def triples(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of each word and of the space after it, with the two bytes before, spaces at first; and its word."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(b"  " + b"   ".join(words) + b" ", np.uint8).astype(np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 3
    code = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    own = np.repeat(np.arange(len(words)), size)[: len(code)]
    # A word of n bytes has n + 3 places, the last two of which see the spaces before the next word.
    keep = np.ones(len(code), bool)
    last = np.cumsum(size) - 1
    for place in (last, last - 1):
        keep[place[place < len(code)]] = False
    return code[keep], own[keep]


def steps_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum((np.log2(np.maximum(counts, 1)) * BINS).astype(np.int64), STEPS - 1)


def growth(states: np.ndarray, counts: np.ndarray, pairs: int) -> float:
    """b between 0 and 1, for which c**b over all states, of which so many with such counts are in each step, sums up to pairs."""
    some = states > 0
    mean = counts[some] / states[some]
    low, high = 0.0, 1.0
    for _ in range(60):
        b = (low + high) / 2
        low, high = (b, high) if (states[some] * mean**b).sum() < pairs else (low, b)
    return low


class Automaton:
    """States, arcs and failure arcs that texts of given words can reach.

    words: of the texts, each once; counts, pairs and pair_counts: in training, of the words and of state * words + word,
    where START is the state after the last word. The root's number is one above START's.
    """

    def __init__(self, words: list[bytes], counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, shape: dict) -> None:
        n = len(words)
        self.width, self.start = n, n
        with np.errstate(divide="ignore"):
            spelled = shape["spelling"].log10(words)
            known = counts > 0
            p = (1 - shape["rare"]) * counts / max(1, shape["n"]) + shape["rare"] * 10.0**spelled
            # The root reads a known word by an arc; any other by the failure arc and the spelling automaton.
            self.root = np.where(known, np.log10(np.where(known, p, 1.0)), np.log10(shape["rare"]) + spelled).tolist()
            seen = np.append(counts, shape["texts"]).astype(np.float64)
            back = np.where(seen > 0, 1 / (1 + np.maximum(seen, 1) ** (1 - shape["growth"])), 1.0)
            # Failure arcs; the root's own, at the end, costs nothing as root[] has it.
            self.fail = [*np.log10(back).tolist(), 0.0]
        self.go = np.where(known, np.arange(n), n + 1).tolist()
        there = pair_counts > 0
        code, times = pairs[there], pair_counts[there]
        state, word = code // n, code % n
        weight = np.log10((1 - back[state]) * times / seen[state] + back[state] * p[word])
        self.arcs = dict(zip(code.tolist(), weight.tolist(), strict=True))

    def read(self, ids: list[int], sizes: list[int]) -> list[float]:
        """The sum of weights along each text."""
        arcs, fail, root, go, width = self.arcs.get, self.fail, self.root, self.go, self.width
        out, at = [], 0
        for size in sizes:
            state, total = self.start, 0.0
            for word in ids[at : at + size]:
                weight = arcs(state * width + word) if state <= width else None
                if weight is None:
                    total += fail[state]
                    weight = root[word]
                total += weight
                state = go[word]
            out.append(total)
            at += size
        return out


def score(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """log10 probability of each text, under a model of all texts that aren't held out.

    Tokens are the words between ASCII white space, A-Z lowered, then one end. Returns a row for each row: the id,
    held_out, n_tokens, n_known (tokens seen in training), train_tokens, base_score (add-one unigrams) and score. Null
    and empty texts are one end token. Without training texts the root is the spelling automaton alone, with equal bytes.
    Repeated rows each count. Words are told apart by 64 bits of hash, pairs by 56. Other columns are ignored.
    """
    spark = documents.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.col(id_col), (F.lit(False) if held_out is None else held_out).alias("held"), F.col(text_col))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block a row with its texts, as ids of its words, and a row for each shard with what it asks."""
        kinds = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("docs", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary()), ("held", pa.binary()), ("words", pa.binary()), ("ones", pa.binary()), ("twos_k", pa.binary()), ("twos_n", pa.binary())])
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            texts = strings(b.column(2))
            for s, e in slices(texts, BLOCK, 1 << 30):
                data, begin, end, starts = word_spans(texts.slice(s, e - s))
                out = np.asarray(b.column(1).slice(s, e - s)).astype(bool)
                keys, first, at, n = np.unique(run_hashes(data, begin, end), return_index=True, return_inverse=True, return_counts=True)
                # Ids: 0 is the end, then the words by how often they are here.
                rank = np.argsort(-n, kind="stable")
                place = np.empty(len(rank), np.int64)
                place[rank] = np.arange(1, len(rank) + 1)
                raw = data.tobytes()
                words = [b"", *(raw[x:y] for x, y in zip(begin[first[rank]].tolist(), end[first[rank]].tolist(), strict=True))]
                sizes = np.diff(starts) + 1
                ids = np.insert(place[at], starts[1:], 0)
                hashed = np.concatenate([np.array([END]), keys[rank]])
                learned = np.repeat(~out, sizes)
                ones = np.bincount(ids[learned], minlength=len(words)).astype(np.uint32)
                order = np.argsort(hashed)
                u = cuts(hashed[order], shards)
                code, at = np.unique(pairs_of(ids, sizes, len(words)), return_inverse=True)
                twos = np.bincount(at[learned], minlength=len(code)).astype(np.uint32)
                pairs = pair_keys(np.append(hashed, START)[code // len(words)], hashed[code % len(words)])
                by = np.argsort(pairs)
                pairs, twos = pairs[by], twos[by]
                v = cuts(pairs, shards)
                docs = pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s)], names=["id"])
                with pa.BufferOutputStream() as sink:
                    with pa.ipc.new_stream(sink, docs.schema) as w:
                        w.write_batch(docs)
                    whole = sink.getvalue().to_pybytes()
                yield pa.RecordBatch.from_pydict({"block": [block], "shard": [-1], "docs": [packed(whole)], "ids": [planes(ids.astype(np.uint32))], "sizes": [planes(sizes.astype(np.uint32))], "held": [planes(out.astype(np.uint8))], "words": [packed(b"\n".join(words))], "ones": [None], "twos_k": [None], "twos_n": [None]}, schema=kinds)
                for a in range(0, shards, 256):
                    some = range(a, min(a + 256, shards))
                    none = [None] * len(some)
                    yield pa.RecordBatch.from_pydict({"block": [block] * len(some), "shard": list(some), "docs": none, "ids": none, "sizes": none, "held": none, "words": [packed(b"\n".join([words[i] for i in order[u[k] : u[k + 1]].tolist()])) for k in some], "ones": [planes(ones[order[u[k] : u[k + 1]]]) for k in some], "twos_k": [planes(np.diff(pairs[v[k] : v[k + 1]], prepend=np.uint64(0))) for k in some], "twos_n": [planes(twos[v[k] : v[k + 1]]) for k in some]}, schema=kinds)
                block += 1

    cells = "block long, shard int, docs binary, ids binary, sizes binary, held binary, words binary, ones binary, twos_k binary, twos_n binary"
    table = stored(rows.mapInArrow(tidy(blocks), cells).withColumn("asks", F.col("shard") >= 0), "blocks", "asks")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shard; each shard's counts are summed over all blocks and go back to each. Block -1: the shard's sums."""
        held, own = None, []
        kinds = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("ones", pa.binary()), ("twos", pa.binary()), ("sums", pa.list_(pa.int64())), ("states", pa.list_(pa.int64())), ("seen", pa.list_(pa.int64())), ("codes", pa.binary()), ("times", pa.binary())])

        def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
            whole, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            total = np.bincount(at, np.concatenate(counts), len(whole)).astype(np.uint64)
            return total, first, np.split(total[at], np.cumsum([len(k) for k in keys])[:-1])

        def flush() -> Iterator[pa.RecordBatch]:
            # The end's row in a list of words is the one without bytes; an empty list has no words at all.
            counts = [unplanes(r["ones"], np.uint32) for r in own]
            words = [unpacked(r["words"]).split(b"\n") if len(c) else [] for r, c in zip(own, counts, strict=True)]
            total, first, ones = summed([hashes_of(w) for w in words], counts)
            flat = [w for x in words for w in x]
            codes, times = np.unique(triples([flat[i] for i in first[total > 0].tolist()])[0], return_counts=True)
            pair_total, _, twos = summed([np.cumsum(unplanes(r["twos_k"], np.uint64), dtype=np.uint64) for r in own], [unplanes(r["twos_n"], np.uint32) for r in own])
            step = steps_of(total[total > 0].astype(np.float64))
            sums = [int((total > 0).sum()), int(total.sum()), int((total == 1).sum()), int((pair_total > 0).sum())]
            states, seen = np.bincount(step, minlength=STEPS), np.bincount(step, total[total > 0].astype(np.float64), STEPS).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"block": [-1], "shard": [held], "ones": [None], "twos": [None], "sums": [sums], "states": [states.tolist()], "seen": [seen.tolist()], "codes": [planes(codes.astype(np.uint32))], "times": [planes(times.astype(np.uint32))]}, schema=kinds)
            for i in range(0, len(own), 256):
                none = [None] * len(own[i : i + 256])
                yield pa.RecordBatch.from_pydict({"block": [r["block"] for r in own[i : i + 256]], "shard": [held] * len(none), "ones": [planes(x) for x in ones[i : i + 256]], "twos": [planes(x) for x in twos[i : i + 256]], "sums": none, "states": none, "seen": none, "codes": none, "times": none}, schema=kinds)
            own.clear()

        for b in batches:
            for r in b.to_pylist():
                if r["shard"] != held and own:
                    yield from flush()
                held = r["shard"]
                own.append(r)
        if own:
            yield from flush()

    asked = table.where("asks").select("block", "shard", "words", "ones", "twos_k", "twos_n")
    answered = asked.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "block")
    answered = stored(answered.mapInArrow(tidy(totals), "block long, shard int, ones binary, twos binary, sums array<long>, states array<long>, seen array<long>, codes binary, times binary"), "totals")
    dropped(table.where("asks"), "asks=true")
    # From each shard come a few sums, and the counts of byte triples, of which there are 2**24 at most in all.
    of_shards = answered.where("block = -1")

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for codes, times in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(unplanes(codes, np.uint32).astype(np.int64)), pa.array(unplanes(times, np.uint32).astype(np.int64))], names=["code", "n"])

    spell = of_shards.select("codes", "times").mapInArrow(tidy(spelled), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    got = of_shards.select(F.posexplode(F.concat("sums", "states", "seen")).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    sums = np.zeros(4 + 2 * STEPS, np.int64)
    for r in got:
        sums[r.i] = r.x
    v, n, once, pairs = sums[:4].tolist()
    states, seen = sums[4 : 4 + STEPS], sums[4 + STEPS :]
    texts = rows.where(~F.col("held")).count()
    # START is a state like the words, but the end is none: all texts end there, so one takes the place of the other.
    shape = {"spelling": Spelling(spell["code"].to_numpy(np.int64), spell["n"].to_numpy(np.int64)), "texts": texts, "v": v, "n": n, "rare": (once + 1) / (n + 1) if n else 1.0, "growth": growth(states, seen, pairs)}
    shared = spark.sparkContext.broadcast(shape)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by block, its texts first, then the answers of all shards in order."""
        own, ones, twos = None, [], []

        def flush() -> pa.RecordBatch:
            m = shared.value
            words = unpacked(own["words"]).split(b"\n")
            ids, sizes = unplanes(own["ids"], np.uint32).astype(np.int64), unplanes(own["sizes"], np.uint32).astype(np.int64)
            hashed = hashes_of(words)
            count = np.zeros(len(words))
            count[np.argsort(hashed)] = np.concatenate([unplanes(x, np.uint64) for x in ones])
            code = np.unique(pairs_of(ids, sizes, len(words)))
            keys = pair_keys(np.append(hashed, START)[code // len(words)], hashed[code % len(words)])
            together = np.zeros(len(code))
            together[np.argsort(keys)] = np.concatenate([unplanes(x, np.uint64) for x in twos])
            total = Automaton(words, count, code, together, m).read(ids.tolist(), sizes.tolist())
            docs = pa.ipc.open_stream(unpacked(own["docs"])).read_all().column(0).combine_chunks()
            of = np.repeat(np.arange(len(sizes)), sizes)
            known = np.bincount(of, count[ids] > 0, len(sizes)).astype(np.int64)
            base = np.bincount(of, np.log10((count + 1) / (m["n"] + m["v"] + 1))[ids], len(sizes))
            return pa.RecordBatch.from_arrays([docs, pa.array(unplanes(own["held"], np.uint8) == 1), pa.array(sizes), pa.array(known), pa.array(np.full(len(docs), m["n"])), pa.array(base), pa.array(total, pa.float64())], names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        for b in batches:
            for r in b.to_pylist():
                if r["shard"] == -1:
                    if own:
                        yield flush()
                    own, ones, twos = r, [], []
                else:
                    ones.append(r["ones"])
                    twos.append(r["twos"])
        if own:
            yield flush()

    none = lambda *names: [F.lit(None).cast("binary").alias(c) for c in names]
    parts = ("docs", "ids", "sizes", "held", "words")
    body = table.where("not asks").select("block", "shard", *parts, *none("ones", "twos"))
    back = answered.where("block >= 0").select("block", "shard", *none(*parts), "ones", "twos")
    full = body.union(back).repartition(shards, "block").sortWithinPartitions("block", "shard")
    return full.mapInArrow(tidy(scored), f"`{id_col}` {documents.schema[id_col].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out_of(id_col: str = "doc_id") -> Column:
    return fold(id_col, 7) == 2
