import hashlib
import math
import random
import re
from fractions import Fraction
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from copse.llm import decontam, htmltext, idfiles, langid, lm, packing, quality, rangecoder, resemblance, simhash, tokens, topk, toxicity
from copse.llm.components import connected

ODD = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, row string, w int"
ROWS = [(1, "The cat sat on the mat. It's 12 o'clock, isn't it?"), (2, None), (3, ""), (4, " \t\n"), (5, "Ünïcode ſtraße — “quotes” don’t 'll"), (5, "Ünïcode ſtraße — “quotes” don’t 'll"), (None, "the cat sat on the mat"), (7, "a <|endoftext|> b<|ENDOFTEXT|>"), (8, "word " * 30_000), (9, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None, None, 0, 0.0, "r", 1) for i, t in ROWS], ODD)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (9, 0, 1), (None, 1, 1), (8, None, None), (999, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def tokenizer():
    return tokens.encoder(tokens.default_tokenizer())


def ids_of(tokenizer, text):
    return np.array([*tokenizer.tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def test_words_encode_as_the_whole_text(tokenizer):
    rnd = random.Random(1)
    signs = ["a", "B", "é", "İ", "ß", "'", "'s", "'LL", "1", "23", ".", "-", "“", " ", "\n", " ", "é", "<|", "|>", "<|endoftext|>", "日本", "Σ", "ς", " ", "\x00", "٣"]
    texts = ["".join(rnd.choices(signs, k=rnd.randint(0, 12))) for _ in range(6000)]
    got, starts = tokenizer.encode(pa.array(texts, pa.large_string()), 2)
    for i, t in enumerate(texts):
        assert got[starts[i] : starts[i + 1]].tolist() == ids_of(tokenizer, t).tolist(), repr(t)


@pytest.mark.parametrize("n", [1, 2, 255, 257, 70_000])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.zipf(1.3, n) % 50_000, np.full(n, 7), rng.integers(0, 65_000, n)):
        data = rangecoder.encode_block(ids.astype(np.uint32))
        got, size = rangecoder.decode_block(memoryview(data))
        assert size == len(data) and (got == ids).all()


def test_contexts_make_files_smaller():
    rng = np.random.default_rng(1)
    phrases = [rng.integers(0, 40_000, 12) for _ in range(500)]
    ids = np.concatenate([phrases[i] for i in rng.integers(0, 500, 40_000)]).astype(np.uint32)
    n = np.bincount(ids)
    order_zero = -(n[n > 0] * np.log2(n[n > 0] / len(ids))).sum() / 8
    assert len(rangecoder.encode_block(ids)) < order_zero / 2


def test_damage_is_found():
    data = bytearray(rangecoder.encode_block(np.arange(5000, dtype=np.uint32)))
    data[len(data) // 2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        rangecoder.decode_block(memoryview(bytes(data)))


def test_id_files(spark, docs, tokenizer):
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in idfiles.round_trip(docs).collect()))
    start, want = 0, []
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        x = ids_of(tokenizer, t)
        want.append((start, i, len(x), crc32(x.tobytes())))
        start += len(x)
    assert got == want
    assert idfiles.round_trip(docs.where("false")).count() == 0


def test_packing(spark, docs, tokenizer):
    got = packing.packed(docs).collect()
    seen, sequences = {}, {}
    for r in got:
        x = next(x for i, t in ROWS if i == r.doc_id and len(x := ids_of(tokenizer, t)) == r.doc_tokens)
        assert r.ids_crc32 == crc32(x[r.start : r.start + r.length].tobytes())
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(len(ids_of(tokenizer, t)) for _, t in ROWS)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096 and at & (at - 1) == 0
    assert packing.packed(docs.where("false")).count() == 0


def test_fill_is_the_closest_sum():
    rnd = random.Random(3)
    for _ in range(200):
        lengths = sorted({rnd.randint(1, 30): rnd.randint(1, 3) for _ in range(4)}.items(), reverse=True)
        room = rnd.randint(1, 60)
        pieces = [n for n, k in lengths for _ in range(k)]
        best = max(s for m in range(len(pieces) + 1) for c in combinations(pieces, m) if (s := sum(c)) <= room)
        got = packing.fill(lengths, room)
        assert sum(n * k for n, k in got) == best and all(k <= dict(lengths)[n] for n, k in got)


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]


def test_decontamination(spark, monkeypatch):
    rnd = random.Random(5)
    pick = lambda n: " ".join(rnd.choices("abcdefg", k=n))
    items = [(i, pick(rnd.randint(1, 12))) for i in range(12)] + [(50, None), (51, ""), (None, "a b"), (3, "a b c")]
    texts = [(i, pick(rnd.randint(0, 200))) for i in range(25)] + [(30, None), (31, ""), (7, "A-a a,b"), (7, "A-a a,b"), (None, "a b")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = spark.createDataFrame([(*r, "x", 1) for r in texts], "doc_id long, text string, n_words string, items int")
    want = []
    for i, t in texts:
        ws, hit, got = words(t), set(), set()
        for item, b in items:
            bs = words(b) if item is not None else []
            for win in [bs[j : j + 8] for j in range(max(1, len(bs) - 7))] if bs else []:
                for p in range(len(ws) - len(win) + 1):
                    if ws[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        got.add(str(item))
        want.append((i, len(ws), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), len(got) >= 2))
    key = lambda r: tuple(map(str, r))
    for limit, chars in ((50_000, 1 << 30), (3, 1 << 30), (50_000, 10)):
        monkeypatch.setattr(decontam, "SENT_WORDS", limit)
        monkeypatch.setattr(decontam, "SENT_CHARS", chars)
        found = decontam.decontaminate(rows, bench).drop("items").collect()
        assert sorted(map(tuple, found), key=key) == sorted(want, key=key)
        kept = decontam.uncontaminated(rows, bench)
        assert kept.columns == rows.columns and kept.count() == sum(not r[-1] for r in want)
    assert decontam.decontaminate(rows.where("false"), bench).count() == 0
    assert {r.n_items for r in decontam.decontaminate(rows, bench.where("false")).collect()} == {0}


def fingerprint(text):
    ws = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode()
    ws = re.findall(rb"[^\x20\x09-\x0D]+", ws)
    sh = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) > 2 else [b" ".join(ws)] * bool(ws)
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_representatives(docs):
    got = simhash.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(i), f"{fingerprint(t):016x}") for i, t in ROWS)
    assert {r.doc_id: r.component_id for r in got}[4] == 2
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert len(kept.collect()) == len({r.component_id for r in got if r.component_id is not None}) + (1 if any(r.component_id is None for r in got) else 0)
    assert simhash.representatives(docs.where("false")).count() == 0


@pytest.mark.parametrize("paired", [64, 2])
def test_links_find_every_component(spark, monkeypatch, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rnd = random.Random(paired)
    fps = set()
    for _ in range(8):
        x = rnd.getrandbits(64)
        fps.add(x)
        for _ in range(15):
            x ^= (1 << rnd.randrange(64)) | (1 << rnd.randrange(64))
            fps.add(x)
    fps = sorted(fps)
    parent = {x: x for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(fps, 2):
        if bin(a ^ b).count("1") <= 2:
            parent[root(a)] = root(b)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {r.v: r.root for r in connected(simhash.links(df)).collect()}
    groups = {}
    for x in fps:
        groups.setdefault(root(x), set()).add(signed(x))
    for g in groups.values():
        assert {got.get(x, x) for x in g} == {min(g)} if len(g) > 1 else True


def test_byte_positions_are_tallied(spark):
    rnd = random.Random(4)
    key = 0x1122334400000000  # under mask 5, positions 4 to 7
    fps = sorted({key | int.from_bytes(bytes(rnd.randrange(3) for _ in range(4)), "little") for _ in range(40)})
    alone = key + (1 << 60)
    df = spark.createDataFrame([(5, key, x) for x in fps] + [(5, alone, alone | x & 0xFFFFFFFF) for x in fps[:1]], "k int, key long, fp long")
    shared = {(a, b): sum(a >> 8 * i & 255 == b >> 8 * i & 255 for i in range(8)) for a, b in combinations(fps, 2)}
    assert len({*shared.values()}) == 4  # 4 to 7
    for least in (5, 6, 7):
        got = {(r.a, r.b): r.hits for r in simhash.tallied(df, least).collect()}
        assert got == {p: n for p, n in shared.items() if n >= least}


@pytest.mark.parametrize("paired", [64, 2])
def test_representatives_at_similarity(spark, monkeypatch, paired):
    monkeypatch.setattr(resemblance, "PAIRED", paired)
    rnd = random.Random(5)
    texts = ["", None, "one", "One", "two words"]
    for size in (20, 60, 60, 150, 400):
        base = [f"w{rnd.randrange(3000)}" for _ in range(size)]
        for _ in range(14):
            other = list(base)
            for _ in range(rnd.randrange(1 + size // 25)):
                other[rnd.randrange(size)] = f"x{rnd.randrange(3000)}"
            texts.append(" ".join(other))

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    far = 0
    for i, j in combinations(range(len(texts)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
            far += (fingerprint(texts[i]) ^ fingerprint(texts[j])).bit_count() > 2
    assert far > 10
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = resemblance.representatives(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(root))
    assert resemblance.representatives(df.where("false")).count() == 0


def test_large_group_of_near_copies_is_linear(spark, monkeypatch):
    """Rows that are compared grow as the group, not as its square, and the components are those of all pairs."""
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(400):
        other = list(base)
        for _ in range(i % 9):
            other[rnd.randrange(150)] = f"x{rnd.randrange(100_000)}"
        texts.append(" ".join(other))
    rows = []
    real = resemblance.verified

    def counted(pairs, *others):
        rows.append(pairs.count())
        return real(pairs, *others)

    monkeypatch.setattr(resemblance, "verified", counted)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if root[i] != root[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    assert 20 < len(set(root)) < 300
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in resemblance.representatives(df).collect()) == sorted(set(root))
    assert sum(rows) <= 20 * len(texts), rows


def test_passages_make_no_groups_in_many_documents(spark, monkeypatch):
    """The order of shingles is taken from a share of the documents, so that passages of many stay out of the prefixes."""
    rnd = random.Random(21)
    passages = [[f"p{k}_{i}" for i in range(20)] for k in range(10)]
    texts = [" ".join([*passages[i % 10], *(f"w{rnd.randrange(1_000_000)}" for _ in range(60))]) for i in range(1500)]
    texts += [texts[3] + " more", texts[8] + " more"]
    long = []
    real = resemblance.candidates

    def counted(*given):
        met = real(*given)
        long.append(met.where("kind = 1").count())
        return met

    monkeypatch.setattr(resemblance, "candidates", counted)
    monkeypatch.setattr(resemblance, "SAMPLE", 2)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in resemblance.representatives(df).collect()) == list(range(1500))
    assert long == [0]


@pytest.mark.parametrize("words", [40, 4000])
def test_crossing_joins_what_is_alike(words):
    """Few words: most hashes are held by many sets; many words: by few."""
    rng = np.random.default_rng(words)
    least = Fraction(3, 5)
    sets = []
    for _ in range(30):
        own = rng.choice(words, rng.integers(8, 30), replace=False)
        for _ in range(rng.integers(1, 5)):
            own = np.unique(np.append(own[1:], rng.integers(0, words)))
            sets.append(np.unique((own.astype(np.uint64) + np.uint64(1)) << np.uint64(30)))
    entries = [(i, i % (len(sets) // 2), resemblance.closed(x)) for i, x in enumerate(sets)]
    ahead, others = entries[::3], entries

    def components(edges):
        of = {r: r for _, r, _ in entries}
        for a, b in edges:
            a, b = of[entries[a][1]], of[entries[b][1]]
            of = {r: a if x == b else x for r, x in of.items()}
        return {frozenset(r for r in of if of[r] == x) for x in of.values()}, len(set(of.values()))

    want = [(a, b) for a, _, x in ahead for b, _, y in others if resemblance.alike(x, y, least)]
    got = resemblance.crossing(ahead, others, least)
    assert set(got) <= set(want) and components(got) == components(want)
    assert len(got) == len({r for _, r, _ in entries}) - components(want)[1] > 0


def test_sets_with_one_passage_in_common_go_first():
    rng = np.random.default_rng(8)
    passage = np.arange(20, dtype=np.uint64)
    sets = [np.append(passage, rng.integers(100, 1 << 30, 60).astype(np.uint64)) for _ in range(200)]
    sets += [np.append(sets[7][:-2], np.arange(50, 52, dtype=np.uint64)), np.append(sets[9][:-2], np.arange(60, 62, dtype=np.uint64))]
    entries = [(i, 7 if i in (7, 200) else i, resemblance.closed(np.unique(x) << np.uint64(30))) for i, x in enumerate(sets)]
    least = Fraction(4, 5)
    # 7 and 200 are of one component already.
    assert sorted(i for i, *_ in resemblance.foreign(entries, entries, least)) == [9, 201]
    assert {frozenset(p) for p in resemblance.crossing(entries, entries, least)} == {frozenset((9, 201))}


def test_top_k(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 8)).astype(np.float32)
    v[100:160] = v[0]
    rows = [(int(i), [float(x) for x in r], "q") for i, r in enumerate(v)] + [(450, None, "q"), (500, [float("nan")] * 8, "q"), (501, [None] * 8, "q")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id string")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df).collect()}
    m = np.floor(256 * v.astype(np.float64)).astype(np.int64)
    want = {}
    for q in range(0, 400, 50):
        s = m @ m[q]
        best = sorted((-int(s[i]), i) for i in range(400) if i != q)[:5]
        want |= {(q, k + 1): (i, -x) for k, (x, i) in enumerate(best)}
    assert got == want
    assert topk.top_k(df.where("false")).count() == 0


def test_top_k_of_a_repeated_query_id(spark):
    rnd = random.Random(3)
    rows = [(50, [9.0, 9.0])] * 12 + [(50, [9.0, 8.5])] * 8 + [(i, [rnd.uniform(-2, 2), rnd.uniform(-2, 2)]) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = [math.floor(256 * x) for x in min(v for i, v in rows if i == 50)]
    said = sorted((-sum(a * math.floor(256 * x) for a, x in zip(q, v, strict=True)), i) for i, v in rows if i != 50)[:5]
    got = sorted((r["rank"], r.vec_id, r.score) for r in topk.top_k(df).collect())
    assert got == [(n, i, -s) for n, (s, i) in enumerate(said, 1)]


def test_lm_scores(spark, docs):
    out = lm.score(docs, held_out=lm.held_out_of()).collect()
    train = [t for i, t in ROWS if crc32(str(i if i is not None else "").encode()) % 7 != 2]
    toks = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if w] + [None]
    counts = {}
    for t in train:
        for w in toks(t):
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), len(toks(t)), sum(w in counts for w in toks(t)), round(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in toks(t)), 6)) for i, t in ROWS)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out) == want
    assert {r.train_tokens for r in out} == {n} and all(-math.inf < r.score < 0 for r in out)
    assert lm.score(docs.where("false")).count() == 0


def tokens_of(text):
    return [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}).encode()) if w] + [b""]


def lm_by_hand(train):
    """P(word | state) in plain dictionaries: state is the word before, b" " at the start, or None for the root."""
    one, two, three = {}, {}, {}
    for t in train:
        before = b" "
        for w in tokens_of(t):
            one[w] = one.get(w, 0) + 1
            two[before, w] = two.get((before, w), 0) + 1
            before = w
    n, starts = sum(one.values()), len(train)
    for w in one:
        x = b"  " + w + b" "
        for i in range(2, len(x)):
            three[x[i - 2 : i + 1]] = three.get(x[i - 2 : i + 1], 0) + 1
    sums = [{}, {}, {}]
    for k, c in three.items():
        sums[2][k] = c
        sums[1][k[1:]] = sums[1].get(k[1:], 0) + c
        sums[0][k[2:]] = sums[0].get(k[2:], 0) + c
    total, kinds = sum(sums[0].values()), len(sums[0])

    def spell(w):
        out, x = 0.0, b"  " + w + b" "
        for i in range(2, len(x)):
            p = (sums[0].get(x[i : i + 1], 0) + (kinds + 1) / 256) / (total + kinds + 1)
            for k in (1, 2):
                after = [c for g, c in sums[k].items() if g[:k] == x[i - k : i]]
                if after:
                    p = (sums[k].get(x[i - k : i + 1], 0) + len(after) * p) / (sum(after) + len(after))
            out += math.log10(p)
        return out

    rare = (sum(c == 1 for c in one.values()) + 1) / (n + 1) if n else 1.0
    step = {}
    for c in one.values():
        k = int(math.log2(c) * 8)
        step[k] = (step.get(k, (0, 0))[0] + 1, step.get(k, (0, 0))[1] + c)
    low, high = 0.0, 1.0
    for _ in range(60):
        b = (low + high) / 2
        low, high = (b, high) if sum(m * (c / m) ** b for m, c in step.values()) < len(two) else (low, b)

    def log10(state, w):
        root = math.log10((1 - rare) * one[w] / n + rare * 10 ** spell(w)) if w in one else math.log10(rare) + spell(w)
        c = starts if state == b" " else one.get(state, 0)
        if not c:
            return root
        back = 1 / (1 + c ** (1 - low))
        if (state, w) in two:
            return math.log10((1 - back) * two[state, w] / c + back * 10**root)
        return math.log10(back) + root

    return log10, one, spell, rare


def test_lm_reads_the_automaton(spark):
    rnd = random.Random(8)
    vocabulary = ["the", "cat", "Sat", "mat", "é", "x" * 40, "a", "b", "c"]
    rows = [(i, " ".join(rnd.choices(vocabulary, weights=[9, 5, 4, 3, 2, 1, 1, 1, 1], k=rnd.randint(0, 30)))) for i in range(60)]
    rows += [(100, "new words the q" + "r" * 300), (101, "s" * 3000), (102, None), (1, "the the")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.col("doc_id") >= 50
    parts = [sorted((r.doc_id, r.n_tokens, r.score, r.base_score) for r in lm.score(df.repartition(k), held_out=held).collect()) for k in (1, 8)]
    assert parts[0] == parts[1]
    log10, one, spell, rare = lm_by_hand([t for i, t in rows if i < 50])
    want = []
    for i, t in rows:
        total, before = 0.0, b" "
        for w in tokens_of(t):
            total += log10(before, w)
            before = w
        want.append((i, total))
    assert sorted((i, round(x, 6)) for i, _, x, _ in parts[0]) == sorted((i, round(x, 6)) for i, x in want)
    scores = {i: x for i, _, x, _ in parts[0]}
    assert 8 < scores[101] / (log10(b" ", b"s" * 300)) < 11
    # What a state can read sums up to one: known words, and all others by their spelling.
    for state in [b" ", *(w for w in one if w), b"unknown"]:
        seen = sum(10 ** log10(state, w) for w in one)
        other = 10 ** (log10(state, b"zzz") - spell(b"zzz")) * (1 - sum(10 ** spell(w) for w in one))
        assert seen + other == pytest.approx(1)


def test_lm_without_training(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(df, held_out=F.lit(True)).collect()}
    assert got[1].train_tokens == 0 and got[1].n_known == 0 and got[1].score == pytest.approx(5 * math.log10(1 / 256))


def test_models_bear_odd_rows(spark, docs, labels):
    lang = langid.predict(docs, docs, held_out=langid.held_out_of()).collect()
    assert len(lang) == len(ROWS) and {r.lang_pred for r in lang if r.doc_id in (2, 3, 4)} == {"und"} and all(0 <= r.score <= 1 for r in lang)
    for marks in (labels, labels.where("false")):
        tox = toxicity.score(docs, marks).collect()
        assert len(tox) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in tox)
        assert toxicity.clean(docs, marks).columns == docs.columns
        kept = quality.resample(docs, marks)
        assert kept.count() == len(ROWS)
        assert quality.resample(docs, marks, carry=True).count() == kept.where("kept").count()
    none = docs.where("false")
    assert [f.count() for f in (langid.predict(none, none), toxicity.score(none, labels), quality.resample(none, labels))] == [0, 0, 0]


def test_document_frequencies_are_of_all_rows(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"the word {i * 7919}", "en") for i in range(2000)], "doc_id long, text string, lang string").repartition(3)
    seen, fit = [], langid.fit
    monkeypatch.setattr(langid, "fitted", lambda rows, f: f([r.lang for r in rows.collect()], [r.text for r in rows.collect()]))
    monkeypatch.setattr(langid, "fit", lambda *a, **b: seen.append(fit(*a, **b)) or seen[0])
    langid.predict(df, df, per_lang=50)
    n = (langid.vectors_of(pa.array([r.text for r in df.collect()], pa.large_string())) > 0).sum(0)
    assert seen[0].idf == pytest.approx(np.log(2001 / (1 + n)) + 1, abs=1e-5)


def test_toxic_misspellings_share_ngrams(spark):
    rnd = random.Random(4)
    clean = ["".join(rnd.choices("abcdefghij", k=6)) for _ in range(300)]
    bad = ["zorgblat", "wuxkrimp", "qivvoth"]
    rows = [(i, " ".join(rnd.choices(clean, k=40) + ([rnd.choice(bad)] if i % 4 == 0 else [])), int(i % 4 == 0)) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    new = spark.createDataFrame([(1000, " ".join(rnd.choices(clean, k=40)) + " zorgblatt"), (1001, " ".join(rnd.choices(clean, k=40)))], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score(df.select("doc_id", "text").union(new), df.select("doc_id", "toxic")).collect()}
    assert got[1000] == 1 and got[1001] == 0


def test_quality_keeps_the_target(spark):
    rnd = random.Random(6)
    good = ["river", "stone", "walks", "under", "bright", "clouds", "the", "and"]
    junk = ["$$$", "click", "buy", "!!!", "http", "&&&"]
    rows = [(i, " ".join(rnd.choices(good if i % 3 else junk, k=60))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = df.where("doc_id < 300").select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"))
    got = {r.doc_id: r.kept for r in quality.resample(df, marks, share=2 / 3).collect()}
    assert sum(got[i] == bool(i % 3) for i in range(600)) >= 595
    assert sum(r.kept for r in quality.resample(df, marks).collect()) == round(600 * (2 / 3 + math.sqrt(2 / 9 / 300)))
    assert quality.resample(df, marks, share=0.5, seed=1).where("kept").count() == 300


def test_quality_weights_are_those_of_both_models(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choices("abcdefgh", k=rnd.randint(0, 12)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i < 10)) for i in range(20)], "doc_id long, quality int")
    buckets = lambda t: quality.features(pa.array([t], pa.large_string()))[0].tolist()
    wanted, raw = [0.0] * (1 << quality.BITS), [0.0] * (1 << quality.BITS)
    for i, t in rows:
        for k in buckets(t):
            raw[k] += 1
            wanted[k] += i < 10
    n, m = sum(raw) + len(raw), sum(wanted)
    ratio = lambda k: math.log((wanted[k] + quality.PRIOR * (raw[k] + 1) / n) / (m + quality.PRIOR) / ((raw[k] + 1) / n))
    got = {r.doc_id: r for r in quality.resample(df, marks).collect()}
    for i, t in rows:
        assert got[i].log_ratio == pytest.approx(sum(map(ratio, buckets(t))), abs=1e-9)
    keys = sorted((r.gumbel_key for r in got.values()), reverse=True)
    assert sorted((r.gumbel_key for r in got.values() if r.kept), reverse=True) == keys[: sum(r.kept for r in got.values())]


def test_gumbel_noise_draws_by_weight(spark):
    weights = [0.0, 0.5, 1.0, 2.0]
    rows = spark.createDataFrame(list(enumerate(weights)), "i int, w double").crossJoin(spark.range(4000).withColumnRenamed("id", "seed"))
    best = rows.withColumn("key", F.col("w") + quality.gumbel(F.col("seed"), F.col("i"))).groupBy("seed").agg(F.max_by("i", "key").alias("i"))
    n = {r.i: r["count"] for r in best.groupBy("i").count().collect()}
    total = sum(map(math.exp, weights))
    assert all(abs(n[i] / 4000 - math.exp(w) / total) < 0.03 for i, w in enumerate(weights))


def page(host, n, body):
    return (n, f"https://{host}/p/{n}", f"<html><head><title>t</title><style>x{{}}</style></head><body><nav><a>Home</a></nav><div class='top'>Welcome to {host}</div><article><h1>Title {n}</h1><p>{body}</p><script>var a = '<p>no</p>';</script></article><aside>ad</aside><footer>(c)</footer></body></html>")


def test_page_text(spark):
    rows = [page("a.org", i, f"Body &amp; <b>bold</b>\n  number {i} x{i * 7}.") for i in range(40)] + [(90, None, None), (91, "x", ""), (92, "http://b.org", "no markup at all")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in htmltext.extract(df).collect()}
    assert got[7] == ("Title 7\nBody & bold number 7 x49.", 33)
    assert got[90] == ("", 0) and got[91] == ("", 0) and got[92][0] == "no markup at all"
    assert htmltext.extract(df.where("false")).count() == 0


def test_page_text_keeps_what_is_a_page_own(spark):
    tips = ["Tip of all" if i < 18 else f"Tip of page {i}" for i in range(20)]
    rows = [(i, "http://a.org/", page("a.org", i, f"Text of {i}")[2].replace("<article>", f"<article><div class='hint'>{t}</div>")) for i, t in enumerate(tips)]
    rows += [(100 + i, None, "<html><body><div><p>Said by a copy</p></div></body></html>") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in htmltext.extract(df).collect()}
    assert all(f"Tip of page {i}" in got[i] for i in (18, 19)) and not any("Tip of all" in t for t in got.values())
    assert {got[100 + i] for i in range(30)} == {"Said by a copy"}


def test_page_text_of_small_hosts(spark):
    def one(i, host, tip):
        return (i, f"http://{host}/", page(host, i, f"Text of {i}")[2].replace("<article>", f"<article><div class='hint'>{tip}</div>"))

    rows = [one(i, "a.org", "Tip of all") for i in range(3)] + [one(10, "b.org", "Tip of one")] * 2 + [one(20 + i, "c.org", f"Tip {i > 0}") for i in range(3)]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(3)] == [f"Title {i}\nText of {i}" for i in range(3)]
    assert got[10].startswith("Tip of one") and got[20].startswith("Tip False") and got[21].startswith("Tip True")


def test_matching_is_the_largest(monkeypatch):
    rnd = random.Random(4)
    for _ in range(300):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randint(0, 6))] for _ in range(2))
        best = max(k for k in range(7) for c in combinations(range(len(a)), k) for d in combinations(range(len(b)), k) if [a[i] for i in c] == [b[j] for j in d])
        got = htmltext.matched(a, b)
        assert len(got) == best and got == sorted(got) and all(a[i] == b[j] for i, j in got)
        with monkeypatch.context() as m:
            m.setattr(htmltext, "MATCHED", 0)
            got = htmltext.matched(a, b)
        assert got == sorted(got) and len({i for i, _ in got}) == len(got) <= best and all(a[i] == b[j] for i, j in got)


def test_page_text_by_the_wrapper_alone(spark, monkeypatch):
    def one(i, host, block):
        return (i, f"https://{host}/{i}", f"<html><body><div><p>{block}</p></div><section><p>Story {host} {i}</p><p>More of {i}</p></section></body></html>")

    rows = [one(i, "a.org", "Always said") for i in range(15)] + [one(20 + i, "b.org", "Always said") for i in range(3)] + [one(30, "c.org", "Always said")]
    deep = "<div>" * 5000 + "Deep down" + "</div>" * 5000 + "<p>Later"
    rows += [(40, "https://d.org/", deep), (41, "https://e.org/", "".join(f"<x{i}>t{i}</x{i}>" for i in range(900))), (42, "https://e.org/", "".join(f"<x{i}>u{i}</x{i}>" for i in range(900, 0, -1)))]
    df = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string").repartition(4)
    parts = []
    for sent in (16_000_000, 0):
        monkeypatch.setattr(htmltext, "SENT", sent)
        parts.append({r.page_id: r.text for r in htmltext.extract(df).collect()})
    got = parts[0]
    assert parts[1] == got
    assert [got[i] for i in range(15)] == [f"Story a.org {i}\nMore of {i}" for i in range(15)]
    assert got[21] == "Story b.org 21\nMore of 21" and got[30].startswith("Always said")
    assert got[40] == "Deep down\nLater" and got[41].split("\n") == [f"t{i}" for i in range(900)]


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        sizes.append(docs.count() if name != "packing" else docs.select("doc_id").distinct().count())
    assert sizes == sorted(sizes, reverse=True)[: len(sizes)] and sizes[-1] == sizes[-2] > 0


CLASHES = "doc_id long, text string, lang string, source string, n_chars long, _bad int, _times int, _heavy int, row string, _copse_key long, items string, w int, fp long, x string"


def test_pipeline_bears_odd_tables(spark, tmp_path):
    import corpus_pipeline

    folder = f"file://{tmp_path}"
    long = " ".join(f"w{i % 997}x{i}" for i in range(20_000))
    near = [f"n{i}" for i in range(200)]
    item = " ".join(f"b{i}" for i in range(12))
    texts = [(1, "plain words that are all right here"), (2, None), (3, ""), (4, " \n"), (5, long), (5, long), (None, "no id at all but some words"), (6, " ".join(near)), (7, " ".join([*near[:100], "other", *near[101:]])), (8, "before " + item + " after"), (9, "plain words that are all right here")]
    docs = spark.createDataFrame([(i, t, "en", "s", None, 1, 2, 3, "r", 4, "i", 5, 6, "x") for i, t in texts], CLASHES)
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (6, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("labels", labels.where("doc_id is not null")), ("benchmark", spark.createDataFrame([(1, item), (2, None), (None, "x")], "item_id long, text string"))):
        df.write.parquet(f"{folder}/odd/{name}.parquet")
        df.where("false").write.parquet(f"{folder}/none/{name}.parquet")
    for case in ("odd", "none"):
        got = spark.read.parquet(f"{folder}/{case}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, got, f"{folder}/{case}")
            if name != "packing":
                assert out.columns == docs.columns
            out.write.parquet(f"{folder}/{case}/{name}")
            before, got = got, spark.read.parquet(f"{folder}/{case}/{name}")
            ids = sorted((r.doc_id is not None, r.doc_id or 0) for r in got.select("doc_id").distinct().collect())
            if case == "odd" and name == "near_duplicates":
                # Texts without words are alike, copies and near copies are one, and of each group the least id stays.
                assert [i for _, i in ids] == [0, 1, 2, 5, 6, 8] and got.count() == 6
            if case == "odd" and name == "decontamination":
                assert [i for _, i in ids] == [0, 1, 2, 5, 6]
        assert got.count() == 0 if case == "none" else {r.doc_id for r in got.collect()} == {None, 1, 2, 5, 6}
