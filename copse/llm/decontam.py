"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, marked, row_key, stored

#: What stands between words, which are of digits, a-z and all characters beyond ASCII once A-Z are lowered.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many distinct words, and windows of so many characters in all, are sent to all executors; with more, the joins
#: shuffle on the word.
SENT_WORDS, SENT_CHARS = 50_000, 50_000_000


def words(text: Column) -> Column:
    """The words with A-Z lowered; null has none. Splitting is several times as fast as extracting every match."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def windows_of(benchmark: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """A row (item, win, len) for each distinct window of each item: size consecutive words, or all of a shorter item."""
    found = benchmark.where(F.col(item_col).isNotNull()).select(
        F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")
    )
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    return (
        found.where(F.size("w") > 0)
        .select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, size))).alias("win"))
        .distinct()
        .withColumn("len", F.size("win"))
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 8, least_items: int = 2) -> DataFrame:
    """Which words of each document lie in windows of benchmark items.

    Containment has to be exact, so the prefix of a window, its words ordered by rarity, is one word: the one that is
    rarest in the documents. Only places of a document that hold such a word are joined with windows; the place of the
    word in the window fixes where the window would begin, which must lie inside the document (positional and length
    bounds); what is left is verified word by word over the window's whole length.

    Returns a row for each row of documents: the id, n_words, n_hit (words inside occurrences of windows), n_items,
    items (their ids as strings, sorted), items_sha256 and contaminated (n_items >= least_items). Null and empty texts
    have no words and so no hits. Rows that repeat an id are each judged by their own text; a null id is kept. Items
    with a null id, a null text or no words take no part; items of the same id are one item. Other columns are ignored.

    The windows and their words go to all executors while they are few (SENT_WORDS, SENT_CHARS); beyond that every word
    of the documents is shuffled to the windows' rarest words, and only what is around the words found is then looked at.
    Neither way drops anything.
    """
    wins, vocab, small = benchmark_windows(benchmark, item_col, item_text_col, size)
    docs = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    times = F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))
    return (
        judged(docs, wins, vocab, small)
        .withColumn("_", times)
        .select(
            F.col("_id").alias(id_col),
            F.col("n_words").cast("long").alias("n_words"),
            F.size("hit").cast("long").alias("n_hit"),
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
            (F.size("items") >= least_items).alias("contaminated"),
            "items",
        )
    )


def uncontaminated(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 8, least_items: int = 2) -> DataFrame:
    """The rows of documents that hold windows of fewer than least_items items, with all their columns."""
    wins, vocab, small = benchmark_windows(benchmark, item_col, item_text_col, size)
    docs = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    bad = stored(judged(docs, wins, vocab, small, True).where(F.size("items") >= least_items).select(F.col("_h").alias(KEY), F.lit(True).alias("_bad")).distinct(), "contaminated")
    return marked(documents, bad, id_col, text_col).where(F.col("_bad").isNull()).select("row.*")


def benchmark_windows(benchmark: DataFrame, item_col: str, item_text_col: str, size: int) -> tuple[DataFrame, DataFrame, bool]:
    """The windows, their distinct words, and whether these are few enough to send."""
    wins = stored(windows_of(benchmark, item_col, item_text_col, size), "windows")
    vocab = wins.select(F.explode("win").alias("w")).distinct()
    chars = wins.agg(F.sum(F.length("item") + F.length(F.concat_ws(" ", "win")))).first()[0] or 0
    return wins, vocab, chars <= SENT_CHARS and vocab.limit(SENT_WORDS + 1).count() <= SENT_WORDS


def judged(docs: DataFrame, wins: DataFrame, vocab: DataFrame, small: bool, only_hits: bool = False) -> DataFrame:
    """A row (_id, _h, n_words, times, hit, items) for each distinct row (_id, _text) of docs; times: how often it is there.

    only_hits: leaves out rows without any window.
    """
    # How often each word of a window stands in the documents.
    spread = docs.select(F.explode(words(F.col("_text"))).alias("w"))
    if small:
        spread = spread.join(F.broadcast(vocab), "w", "left_semi")
    counts = spread.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    if not small:  # summed up before the words are shuffled
        counts = counts.join(vocab, "w", "left_semi")
    ranked = (
        wins.select("item", "win", "len", F.posexplode("win").alias("at", "w"))
        .join(F.broadcast(counts) if small else counts, "w", "left")
        .groupBy("item", "win", "len")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w", "at")).alias("rare"))
        .where(F.col("rare.n") > 0)
        .groupBy("win", "len", F.col("rare.w").alias("w"), F.col("rare.at").alias("at"))
        .agg(F.sort_array(F.collect_set("item")).alias("window_items"))
    )
    ranked = stored(ranked, "ranked")  # as small as the benchmark
    first = [r.w for r in ranked.select("w").distinct().collect()] if small else []
    most = wins.agg(F.max("len")).first()[0] or 1

    # A row for each place with such a word, with the words around it; place -1 stands for the document itself.
    held = docs.select("_id", row_key("_id", "_text").alias("_h"), words(F.col("_text")).alias("ws")).withColumn("n_words", F.size("ws"))
    start = lambda i: F.greatest(i - (most - 1), F.lit(0))
    itself = F.struct(F.lit(-1).alias("i"), F.lit(None).cast("string").alias("w"), F.lit(0).alias("from"), F.array().cast("array<string>").alias("near"))

    def around(places: Column) -> Column:
        return F.transform(places, lambda i: F.struct(i.alias("i"), F.get("ws", i).alias("w"), start(i).alias("from"), F.slice("ws", start(i) + 1, i - start(i) + most).alias("near")))

    def each(held: DataFrame, places: Column) -> DataFrame:
        return held.select("_id", "_h", "n_words", F.explode(places).alias("p")).select("_id", "_h", "n_words", "p.*")

    if small:
        hit = lambda w: w.isin(first) if first else F.lit(False)
        places = around(F.array_compact(F.transform("ws", lambda w, i: F.when(hit(w), i))))
        rows = each(held, places if only_hits else F.concat(F.array(itself), places)).join(F.broadcast(ranked), "w", "left")
    else:
        spots = held.select("_h", F.posexplode("ws").alias("i", "w")).join(ranked.select("w").distinct(), "w", "left_semi")
        spots = spots.groupBy("_h").agg(F.collect_set("i").alias("places"))
        rows = each(held.join(spots, "_h"), around(F.col("places"))).join(ranked, "w")
        if not only_hits:
            rows = rows.unionByName(each(held, F.array(itself)), allowMissingColumns=True)
    begins = F.col("i") - F.col("at")
    alike = F.slice("near", begins - F.col("from") + 1, F.col("len")) == F.col("win")
    found = (
        rows.withColumn("begins", F.when((begins >= 0) & (begins + F.col("len") <= F.col("n_words")), begins))
        .withColumn("ok", F.coalesce(F.when(F.col("begins").isNotNull(), alike), F.lit(False)))
        .where((F.col("i") == -1) | F.col("ok"))
    )
    span = F.when(F.col("ok"), F.sequence(F.col("begins"), F.col("begins") + F.col("len") - 1))
    return (
        found.groupBy("_id", "_h", "n_words")
        .agg(
            F.sum((F.col("i") == -1).cast("int")).alias("times"),
            F.array_distinct(F.flatten(F.collect_set(span))).alias("hit"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("ok"), F.col("window_items")))))).alias("items"),
        )
    )


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
wins AS (SELECT DISTINCT item, ws[i:i+7] AS win FROM (SELECT item, ws, unnest(generate_series(1, greatest(len(ws) - 7, 1))) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT len(win) AS n FROM wins),
spots AS (SELECT doc_id, i, n, ws[i:i+n-1] AS win FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM d, lens WHERE len(ws) >= n)),
found AS (SELECT s.doc_id, s.i, s.n, w.item FROM spots s JOIN wins w ON s.win = w.win),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM found) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
