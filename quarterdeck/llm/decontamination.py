"""Benchmark passages in documents, by a prefix-filtered join of word shingles.

A benchmark item is cut into windows, a window into shingles of a few words. Its shingles are ordered by rarity in
the corpus, and only the rarest (the prefix: as many as a window that occurs can't all miss) are joined with the
documents' shingles. A match fixes where the window would lie; it must lie within the document, and the words there
are compared with the window's. A Bloom filter of bounded size stands before the joins, so that of the documents'
positions few leave the task that cuts them. All is done by Spark's own expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterdeck.llm.common import texts_of
from quarterdeck.llm.url_filter import LOWER, UPPER
from quarterdeck.llm.url_filter import _level as bloom_level
from quarterdeck.session import pin

#: A word is a run of ASCII letters and digits and of all characters beyond ASCII (upper case counts as lower case).
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: Keys that a filter is sized for at most (16 MB). With more keys it lets more through, and the join decides anyway.
FILTER_KEYS = 1 << 23


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def _shingle(words: str, start: Column, width: int) -> Column:
    """The 64-bit hash of ``width`` words from ``start`` (from 0) on; words beyond the end are left out."""
    return F.xxhash64(*[F.get(words, (start + j).cast("int")) for j in range(width)])


def _windows(items: DataFrame, item: str, text: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(id, window) of the distinct windows, and (id, item) of the items that they are in."""
    words = items.select(F.col(f"`{item}`").cast("string").alias("item"),
                         words_of(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("words"))
    starts = F.when(F.size("words") > 0, F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1))))
    cut = pin(words.select("item", "words", F.explode(starts).alias("start")).select(
        "item", F.slice("words", F.col("start"), F.lit(window)).alias("window")).distinct(), "cut")
    distinct = pin(cut.select("window").distinct().withColumn("id", F.monotonically_increasing_id()), "windows")
    return distinct, pin(cut.join(distinct, "window").select("id", "item"), "owners")


def _shingles(windows: DataFrame, width: int) -> DataFrame:
    """id, window, offset and shingle: each window's shingles; a window of fewer words is one shingle."""
    offsets = F.sequence(F.lit(0), F.greatest(F.size("window") - width, F.lit(0)))
    return windows.select("id", "window", F.explode(offsets).alias("offset")).select(
        "id", "window", "offset", _shingle("window", F.col("offset"), width).alias("shingle"))


def _positions(texts: DataFrame, widths: list[int]) -> DataFrame:
    """doc_id, body, words, at and shingle: a row for each place in a document where words of one of ``widths`` begin."""
    cut = texts.select("doc_id", "body", words_of(F.col("text")).alias("words"))
    # no filter on the number of words: it would be pushed down and cut the text a second time
    places = F.when(F.size("words") >= min(widths), F.sequence(F.lit(0), F.size("words") - min(widths)))
    placed = cut.select("doc_id", "body", "words", F.explode(places).alias("at"))
    # a generator even for a single width: its output is a column, where an expression would be worked out anew by each use. All of
    # this must be expressions that Spark compiles (no lambdas): the words are then shared by the rows of a text, not copied for each
    fits = lambda n: F.when(F.col("at") + n <= F.size("words"), _shingle("words", F.col("at"), n))
    return placed.withColumn("shingle", F.explode(F.array(*map(fits, widths)))).where("shingle IS NOT NULL")


def _may_hold(keys: DataFrame) -> tuple[DataFrame, Column]:
    """The distinct shingles of ``keys``, and a test that all of them and few others pass."""
    keys = pin(keys.select(F.col("shingle").alias("key")).distinct(), "keys")
    count = keys.count()
    if not count:
        return keys, F.lit(False)
    # room for six times the keys at two places each: about one position in a hundred passes wrongly
    return keys, bloom_level(keys, 0, 6 * min(count, FILTER_KEYS), 0.25).passes(F.col("shingle"))


def find_windows(texts: DataFrame, windows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, body, id, start and stop: where a window stands in a text; ``texts`` holds doc_id, body and text."""
    shingles = pin(_shingles(windows, shingle), "shingles")
    longest = windows.agg(F.max(F.size("window"))).first()[0] or 0
    # at most as many as a shingle has words
    widths = sorted(r[0] for r in shingles.select(F.least(F.size("window"), F.lit(shingle))).distinct().collect())
    if not widths:
        return texts.select("doc_id", "body", *[F.lit(0).cast("long").alias(c) for c in ("id", "start", "stop")]).limit(0)
    positions = _positions(texts, widths)

    # rarity over the whole corpus; a task sends one row for a shingle that it has seen, however often
    _, known = _may_hold(shingles)
    seen = positions.where(known).groupBy("shingle").agg(F.count(F.lit(1)).alias("seen"))
    own = Window.partitionBy("id")
    ranked = shingles.join(seen, "shingle", "left").withColumns({
        "n": F.count(F.lit(1)).over(own),
        "place": F.row_number().over(own.orderBy(F.coalesce("seen", F.lit(0)), "shingle", "offset"))})
    needed = F.ceil(F.col("n") * percent / 100).cast("int")
    # a shingle that the corpus hasn't got finds nothing
    prefixes = pin(ranked.where((F.col("place") <= F.col("n") - needed + 1) & F.col("seen").isNotNull()).select(
        "id", "window", "offset", "shingle", F.col("n").cast("int").alias("n"), needed.alias("needed")), "prefixes")

    _, wanted = _may_hold(prefixes)
    first = F.greatest(F.col("at") - longest, F.lit(0))
    near = positions.where(wanted).select(
        "doc_id", "body", "at", "shingle", F.size("words").alias("n_words"), first.alias("first"),
        F.slice("words", first + 1, F.lit(2 * longest)).alias("near"))
    start, length = F.col("at") - F.col("offset"), F.size("window")
    inside = near.join(prefixes, "shingle").where((start >= 0) & (start + length <= F.col("n_words")))
    there = F.slice("near", start - F.col("first") + 1, length)
    width = F.least(length, F.lit(shingle))
    same = F.filter(F.sequence(F.lit(1), F.col("n")), lambda j: F.slice("there", j, width) == F.slice("window", j, width))
    found = inside.withColumn("there", there).where(F.size(same) >= F.col("needed"))
    return found.select("doc_id", "body", "id", start.cast("long").alias("start"), (start + length).cast("long").alias("stop"))


def _covered(ranges: str) -> Column:
    """How many places the ranges cover together."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("until"))
    step = lambda s, r: F.struct((s["n"] + F.greatest(r["stop"] - F.greatest(r["start"], s["until"]), F.lit(0))).alias("n"),
                                 F.greatest(s["until"], r["stop"]).alias("until"))
    return F.aggregate(F.col(ranges), zero, step, lambda s: s["n"])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, percent: int = 100, key: str = "doc_id",
                  text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, items (sorted as strings) and ranges (start and stop word, from 0).

    A window of an item is ``window`` words in a row, or all words of an item that has fewer. It occurs where at
    least ``percent`` of its shingles of ``shingle`` words stand at their places; with 100 these are exactly its words.
    The words of all occurrences count as hit. A null or empty text, of either table, has no words and no windows. Repeated
    documents are judged alike, each in a row of its own; items that repeat an id count once, and one without an id
    hits words and isn't listed. Without items nothing is hit. Further columns are left out.
    """
    if not 0 < percent <= 100 or not 0 < shingle <= window:
        raise ValueError("percent must be in 1..100 and a shingle no longer than a window")
    # rows with the same id and text share their hits; a text is told by 64 bits and its length
    texts = texts_of(docs, key, text).withColumn("body", F.struct(F.xxhash64("text"), F.length("text")))
    windows, owners = _windows(items, item, item_text, window)
    hits = pin(find_windows(texts, windows, shingle, percent), "hits")
    per_doc = hits.groupBy("doc_id", "body").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("ranges"))
    named = hits.select("doc_id", "body", "id").distinct().join(owners, "id").groupBy("doc_id", "body").agg(
        F.sort_array(F.collect_set("item")).alias("items"))
    rows = texts.select("doc_id", "body", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    for part in (per_doc, named):
        part = part.select(F.col("doc_id").alias("_doc"), F.col("body").alias("_body"), *[c for c in part.columns if c not in ("doc_id", "body")])
        same = reduce(lambda a, b: a & b, [rows["doc_id"].eqNullSafe(part["_doc"]), rows["body"] == part["_body"]])
        rows = rows.join(part, same, "left").drop("_doc", "_body")
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    return rows.select("doc_id", "n_words", F.coalesce(_covered("ranges"), F.lit(0)).cast("long").alias("n_hit"),
                       F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("ranges", none).alias("ranges"))
