"""Language identification by fusing independent evidence.

The text gives a likelihood per language from letter trigrams. What the markup declares is
weighed by how often each language declares it, and the host and the suffix of its address by
what their other rows are written in: counts per host are smoothed towards its suffix, those
towards the whole corpus. All three are grouped aggregations over every row; only the
trigram model is fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterdeck.llm.common import bounded_batches, utf8
from quarterdeck.llm.url_filter import host_of
from quarterdeck.session import pin

#: Rows that the trigram model is fitted on at most; slots that trigrams are hashed to.
LABELLED_ROWS, SLOTS = 20_000, 1 << 16
#: Values of the hash that rows are drawn by.
DRAWS = 1 << 30
#: Neighbouring trigrams share letters, so their log likelihoods count for less than independent ones would.
TEMPER = 0.1
#: Rows' worth of belief that a host takes from its suffix, a suffix from the corpus, and a declaration from chance.
HOST_STRENGTH, SUFFIX_STRENGTH, DECLARED_STRENGTH = 5.0, 20.0, 1.0
UNKNOWN = "und"
# ASCII letters in lower case, all other ASCII as spaces, further bytes as they are
_FOLD = bytes(c if chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(128)) + bytes(range(128, 256))


def trigrams(text: bytes) -> np.ndarray:
    """Slots of the byte trigrams around each letter of the folded text, its ends padded with spaces."""
    raw = np.frombuffer(b" " + text.translate(_FOLD) + b" ", np.uint8).astype(np.uint32)
    slots = (raw[:-2] * np.uint32(0x9E3779B1) ^ raw[1:-1] * np.uint32(0x85EBCA6B) ^ raw[2:] * np.uint32(0xC2B2AE35))
    slots = (slots ^ slots >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(16)
    return slots[raw[1:-1] != 32]


_COUNTS = pa.schema([("lang", pa.string()), ("slot", pa.int32()), ("n", pa.int64())])


def _count(batches) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch, "text"), strict=True):
            if lang not in counts:
                counts[lang] = np.zeros(SLOTS, np.int64)
            counts[lang] += np.bincount(trigrams(text), minlength=SLOTS)
    for lang, found in counts.items():
        slots = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slots)), pa.array(slots, pa.int32()), pa.array(found[slots])], schema=_COUNTS)


class TextModel:
    """Log likelihoods of trigrams per language; the last row is noise, where all are alike."""

    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs, self.table = langs, table


def equal_part(counts: list[int], total: int) -> float:
    """The part of each label that adds up to ``total`` rows, where labels with fewer rows give all they have."""
    left = total
    for i, n in enumerate(sorted(counts)):
        if n * (len(counts) - i) >= left:
            return left / (len(counts) - i)
        left -= n
    return float(max(counts, default=0))


def fit_text(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", labelled_rows: int = LABELLED_ROWS) -> TextModel:
    """Fit on at most about ``labelled_rows`` rows, picked by a hash of their key and text; rows without a label are left out.

    Each label gets an equal part of them, and what labels with fewer rows leave of theirs; the row with the least hash
    is always drawn, so every label is in the model. The counts that reach the driver are bounded by languages x SLOTS.
    """
    rows = bounded_batches(labelled).select(F.col(f"`{lang}`").cast("string").alias("lang"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
                           F.pmod(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")), F.lit(DRAWS)).alias("draw")).where("lang IS NOT NULL AND lang <> ''")
    labels = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("least")).collect()
    part = equal_part([r["n"] for r in labels], labelled_rows)
    most = [(r["lang"], max(r["least"], int(min(1.0, part / r["n"]) * DRAWS) - 1)) for r in labels]
    drawn = rows.join(pin(labelled.sparkSession.createDataFrame(most, "lang string, most long"), "most"), "lang").where("draw <= most").select("lang", "text")
    counts = drawn.mapInArrow(_count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.zeros((len(langs) + 1, SLOTS))
    table[[langs.index(x) for x in counts["lang"]], counts["slot"].to_numpy(np.int64)] = counts["n"]
    table += 0.5
    return TextModel(langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))


def _scorer(model: TextModel):
    table = np.ascontiguousarray(model.table.T)

    def score(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for text in utf8(batch, "text"):
                slots = trigrams(text)
                sizes.append(len(slots))
                # in parts, so that a very long text takes no more memory than a part
                found.append(sum((table[slots[at:at + SLOTS]].sum(axis=0, dtype=np.float64) for at in range(0, len(slots), SLOTS)),
                                 np.zeros(table.shape[1])).tolist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in batch.schema.names if n != "text"), pa.array(found, pa.list_(pa.float64())), pa.array(sizes, pa.int64())],
                names=[*(n for n in batch.schema.names if n != "text"), "likelihoods", "n_trigrams"])

    return score


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    raw = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: x / total)


def _sums(n: int) -> list[Column]:
    return [F.sum(F.get("belief", F.lit(i))).alias(f"n{i}") for i in range(n)]


def identify(records: DataFrame, model: TextModel, threshold: float = 0.5) -> DataFrame:
    """``records`` without their text, with lang, probability and accepted.

    ``records`` holds text, declared (language of the markup), host and suffix as strings, any of them null,
    and key columns; one with the name of a result gives way to it. Missing evidence of one sort leaves the others to decide. A text without
    letters has no language of its own: its lang is ``und`` and it isn't accepted. Nor is one that noise explains
    better than any language, or whose best language stays below ``threshold``. Equal probabilities go to
    the first language in the alphabet. A model without languages accepts nothing. Repeated rows are judged alike; an empty table gives an empty result.
    """
    size = len(model.langs) + 1
    keys = [c for c in records.columns if c not in ("text", "declared", "host", "suffix", "lang", "probability", "accepted")]
    scored = bounded_batches(records).select(F.struct(*[F.col(f"`{c}`") for c in keys]).alias("keys"), "declared", "host", "suffix", "text")
    scored = scored.mapInArrow(_scorer(model), T.StructType([*scored.schema[:-1], T.StructField("likelihoods", T.ArrayType(T.DoubleType())),
                                                             T.StructField("n_trigrams", T.LongType())]))
    tempered = F.transform("likelihoods", lambda x: x * TEMPER)
    scored = pin(scored.withColumns({
        "host": F.coalesce("host", F.lit("")), "suffix": F.coalesce("suffix", F.lit("")), "declared": F.lower(F.trim(F.coalesce("declared", F.lit("")))),
        "logs": tempered, "belief": F.when(F.col("n_trigrams") > 0, _softmax(tempered)).otherwise(F.array_repeat(F.lit(0.0), size))}).drop("likelihoods"), "scored")

    # counts of soft votes by host, their suffix and the corpus
    hosts = pin(scored.groupBy("suffix", "host").agg(*_sums(size)), "hosts")
    totals = [F.sum(f"n{i}").alias(f"n{i}") for i in range(size)]
    suffixes = pin(hosts.groupBy("suffix").agg(*totals), "suffixes")
    corpus = suffixes.agg(*totals).first()
    whole = sum(x or 0.0 for x in corpus)
    share = [((x or 0.0) + 1.0) / (whole + size) for x in corpus]
    suffix_total = sum((F.col(f"n{i}") for i in range(size)), F.lit(0.0))
    suffixes = suffixes.select("suffix", F.array(*[(F.col(f"n{i}") + SUFFIX_STRENGTH * share[i]) / (suffix_total + SUFFIX_STRENGTH)
                                                   for i in range(size)]).alias("suffix_prior"))
    hosts = hosts.join(suffixes, "suffix").select("suffix", "host", "suffix_prior", F.array(*[f"n{i}" for i in range(size)]).alias("host_votes"))

    # how often a row of each language declares what this one does
    declared = pin(scored.groupBy("declared").agg(*_sums(size)), "declared")
    kinds_declared = max(declared.count(), 1)
    told = [F.col(f"n{i}") for i in range(size)]
    declared = declared.where("declared <> ''").select("declared", F.array(*[
        F.log((told[i] + DECLARED_STRENGTH) / ((corpus[i] or 0.0) + DECLARED_STRENGTH * kinds_declared)) for i in range(size)]).alias("declared_logs"))

    # a row's own vote is taken out of its host's counts
    joined = scored.join(hosts, ["suffix", "host"], "left").join(declared, "declared", "left")
    others = F.zip_with("host_votes", "belief", lambda votes, own: F.greatest(votes - own, F.lit(0.0)))
    weight = F.aggregate(F.col("others"), F.lit(HOST_STRENGTH), lambda a, x: a + x)
    prior = F.zip_with("others", "suffix_prior", lambda n, p: F.log((n + p * HOST_STRENGTH) / F.col("weight")))
    fused = F.zip_with("logs", "prior_logs", lambda a, b: a + b)
    fused = F.when(F.col("declared_logs").isNotNull(), F.zip_with(fused, "declared_logs", lambda a, b: a + b)).otherwise(fused)
    judged = (joined.withColumn("others", others).withColumn("weight", weight).withColumn("prior_logs", prior)
              .withColumn("posterior", _softmax(fused)).withColumn("probability", F.array_max("posterior")))
    best = F.get(F.array(*[F.lit(x) for x in [*model.langs, UNKNOWN]]), F.array_position("posterior", F.col("probability")).cast("int") - 1)
    best = F.when(F.col("n_trigrams") > 0, best).otherwise(F.lit(UNKNOWN))
    return judged.select(*[F.col(f"keys.`{c}`") for c in keys], best.alias("lang"), "probability",
                         ((best != UNKNOWN) & (F.col("probability") >= threshold)).alias("accepted"))


def suffix_of(host: Column) -> Column:
    """The last label of a host; null without one."""
    return F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit(""))


def page_text(html: Column) -> Column:
    """The text between the tags, scripts and styles left out."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")


def page_language(html: Column) -> Column:
    """What the lang attribute of the html tag declares, up to its region; null without one."""
    return F.nullif(F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]+)""", 1), F.lit(""))


def records_of(docs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Documents and pages as records: doc_id or page_id (the other is null), text, declared, host and suffix.

    A document has no markup and declares nothing; its source is its host. A page declares what its markup does.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    none = F.lit(None).cast("long")
    records = docs.select(F.col("doc_id").cast("long").alias("doc_id"), none.alias("page_id"), F.lit(None).cast("string").alias("declared"),
                          F.col("source").cast("string").alias("host"), F.lit(None).cast("string").alias("suffix"), text)
    if pages is None:
        return records
    host = host_of(F.col("url"))
    return records.unionAll(pages.select(
        none.alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), page_language(F.col("html")).alias("declared"),
        host.alias("host"), suffix_of(host).alias("suffix"), F.coalesce(page_text(F.col("html")), F.lit("")).alias("text")))
