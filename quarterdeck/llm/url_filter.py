"""URL verdicts by rules and by a cascade of Bloom filters.

The first filter of a cascade holds the listed keys, the second those other keys of the corpus
that the first lets through, the third the listed keys that the second lets through,
and so on, until a filter lets nothing wrong through. Over the keys it was built for, the
level at which a key first fails tells exactly whether it is listed, without a join: the
filters are arrays of 64-bit words that travel with the plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterdeck.session import pin

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A cascade takes at most so many bits (32 MB); above, ``mark`` joins instead.
MOST_BITS = 1 << 28


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Rule:
    """Fits its host and all subdomains, on paths that begin with its own."""

    verdict: str
    host: str
    path: str

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def rule_columns(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, null without one; of equally long ones the first."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.host + r.path)):
        fits = rule.fits(host, path)
        text = F.when(fits, rule.host + rule.path).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def _places(key: Column, level: int, hashes: int, bits: int) -> list[Column]:
    first = F.pmod(F.xxhash64(key, F.lit(2 * level)), F.lit(bits))
    second = F.pmod(F.xxhash64(key, F.lit(2 * level + 1)), F.lit(bits - 1)) + 1
    return [F.pmod(first + second * i, F.lit(bits)) for i in range(hashes)]


@dataclass
class Level:
    number: int
    hashes: int
    bits: int
    words: DataFrame

    def passes(self, key: Column) -> Column:
        words, found = self.words.scalar(), None
        for place in _places(key, self.number, self.hashes, self.bits):
            word = F.get(words, F.shiftrightunsigned(place, 6).cast("int"))
            bit = F.getbit(word, F.pmod(place, F.lit(64)).cast("int")) == 1
            found = bit if found is None else found & bit
        return found


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    def contains(self, key: Column) -> Column:
        """Whether a key of the corpus is listed: it is if the first level that it fails has an odd number."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            answer = F.when(level.passes(key), answer).otherwise(F.lit(level.number % 2 == 1))
        return answer


def _level(keys: DataFrame, number: int, count: int, rate: float) -> Level:
    hashes = max(1, round(-math.log2(rate)))
    bits = max(128, math.ceil(count * hashes / math.log(2)))
    bits = -(-bits // 64) * 64 + 1  # odd, so that the second hash rarely falls on few places
    places = keys.select(F.explode(F.array(*_places(F.col("key"), number, hashes, bits))).alias("place"))
    ones = places.select(F.shiftrightunsigned("place", 6).alias("word"),
                         F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("place", F.lit(64)).cast("int")).alias("ones"))
    empty = keys.sparkSession.range(-(-bits // 64)).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("ones"))
    words = ones.unionAll(empty).groupBy("word").agg(F.bit_or("ones").alias("ones"))
    # one row of at most MOST_BITS
    ordered = F.sort_array(F.collect_list(F.struct("word", "ones")))
    return Level(number, hashes, bits, pin(words.agg(F.transform(ordered, lambda w: w["ones"]).alias("words")), "filter"))


def build_cascade(universe: DataFrame, most_bits: int = MOST_BITS) -> Cascade | None:
    """The cascade over ``universe`` (key string, listed boolean; keys distinct and not null).

    None if the filters would take more than ``most_bits``; then ``mark`` joins.
    """
    universe = pin(universe.select("key", "listed"), "keys")
    counts = universe.agg(F.count_if("listed").alias("listed"), F.count_if(~F.col("listed")).alias("others")).first()
    cascade, wrong, right = Cascade(), counts["others"], counts["listed"]
    rate = min(0.5, max(2.0 ** -16, math.sqrt(0.5) * right / wrong)) if wrong and right else 0.5
    if max(1, round(-math.log2(rate))) * right / math.log(2) * 3 > most_bits:
        return None
    inside, outside = universe.where("listed"), universe.where("not listed")
    if not right:
        return cascade
    while True:
        level = _level(inside, len(cascade.levels), right, rate)
        cascade.levels.append(level)
        through = pin(outside.where(level.passes(F.col("key"))).select("key", "listed"), "through")
        inside, outside, right, rate = through, inside, through.count(), 0.5
        if not right:
            return cascade


def mark(rows: DataFrame, key: str, universe: DataFrame, name: str, most_bits: int = MOST_BITS) -> DataFrame:
    """``rows`` with the boolean column ``name``: whether its key is listed in ``universe``.

    Each row's key must be in ``universe``; a null key isn't listed. Beyond ``most_bits`` the listed
    keys are joined, which gives the same answers.
    """
    cascade = build_cascade(universe, most_bits)
    if cascade is not None:
        return rows.withColumn(name, F.coalesce(cascade.contains(F.col(key)), F.lit(False)) & F.col(key).isNotNull())
    listed = universe.where("listed").select(F.col("key").alias(f"{name}_key"), F.lit(True).alias(name))
    return rows.join(listed, F.col(key) == F.col(f"{name}_key"), "left").drop(f"{name}_key").withColumn(
        name, F.coalesce(name, F.lit(False)))


def judge(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", most_bits: int = MOST_BITS) -> DataFrame:
    """page_id, host, path, rule, verdict for each row.

    The longest rule that fits decides. Where none fits, the host does: a host is listed if a rule blocks
    one of its pages, and a listed host is blocked. A null url, or one without ://, has an empty host and
    path, fits no rule and is allowed. Repeated rows are judged alike; further columns are left out.
    """
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    text, verdict = rule_columns(rules, F.col("host"), F.col("path"))
    rows = rows.select("page_id", "host", "path", text.alias("rule"), verdict.alias("decided"))
    hosts = rows.groupBy(F.col("host").alias("key")).agg(F.coalesce(F.bool_or(F.col("decided") == "block"), F.lit(False)).alias("listed"))
    marked = mark(rows, "host", hosts, "listed", most_bits)
    return marked.select("page_id", "host", "path", "rule", F.coalesce(
        "decided", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
