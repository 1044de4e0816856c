"""Personal data: fixed patterns, and identifiers found through the words before them.

Everything here is a DataFrame plan. The fixed patterns give the base spans. With strings that can only be
keys (32 or more hexadecimal digits) they seed a graph of cues and instances (the string itself), which
also holds every other string that looks like an identifier. A cue is a label (a word and the signs behind it, such
as ``token = "``) or else the two words before an occurrence. A cue scores
by the weight of the instances it precedes, an instance by the cues that precede it, round after round;
the instances that strong cues vouch for are personal data as well. Instances that nobody knows yet don't count
against a label: what does are the strings behind it, anywhere in the corpus, that are known to be no
identifiers. What else follows two words isn't looked up, so there unknown instances count against them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterdeck.llm.common import texts_of
from quarterdeck.session import pin

#: The kinds in their order, with their patterns (fixed by contract). Possessive quantifiers stand where
#: giving back can't help. \G keeps a search that starts inside a run of the class, right behind the match
#: before, and the look-behind refuses others: the run has failed from its begin already.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "found": r"(?<![A-Za-z0-9])(?=[A-Za-z_#/-]*+[0-9])[A-Za-z0-9]++(?:[_#/-][A-Za-z0-9]++)*+",
}
BASE = ["email", "ip", "card", "phone"]
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: Characters before an occurrence that are looked at for its cue.
REACH = 48
#: A key: no word, number or date has this form.
KEY = r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{32,}$"
#: A label, shorter than what is looked at, and what may follow one.
SIGNS = ["=", ":", "#"]
LABEL = r"(?<!\p{L})(\p{L}{1,30}+\s{0,8}+[" + "".join(SIGNS) + r"][^\p{L}\p{N}]{0,8}+)"
FOLLOWED = LABEL + r"(?=([\p{L}\p{N}]\S{0,63}))"


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))

    def worth(place: Column) -> Column:
        digit = F.substring(digits, place, F.lit(1)).cast("int")
        double = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return F.when(place % 2 == 0, double).otherwise(digit)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda so_far, place: so_far + worth(place))
    return total % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    """Whether a match of its kind's pattern counts; what fails is dropped and not tried again."""
    return (F.when(kind == "email", True)
            .when(kind == "ip", value.rlike(rf"^{PART}(?:\.{PART}){{3}}$"))
            .when(kind == "card", F.when(_digits(value).between(13, 19), _luhn(value)).otherwise(False))
            .when(kind == "phone", _digits(value).between(9, 15))
            .otherwise((F.length(value) >= 7) & (_digits(value) >= 5)))


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, body, text: ``body`` hashes the text, so rows that repeat an id stay apart."""
    return texts_of(df, key, text).select("doc_id", F.xxhash64("text").alias("body"), "text")


def _may_hold(text: Column) -> Column:
    """Whether a text holds a character that every span needs one of."""
    return F.contains(text, F.lit("@")) | text.rlike("[0-9]")


def _cue(text: Column) -> Column:
    """A cue as the graph knows it: in lower case, with single spaces."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, body, kind, start, end, value, cue of every valid match, in code points."""
    text = F.col("text")
    none = F.expr("CAST(NULL AS ARRAY<STRUCT<gap: INT, tail: STRING, value: STRING>>)")

    def found(kind: str, possible: Column) -> Column:
        pattern = PATTERNS[kind]
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        gaps = F.split(text, pattern, -1)
        rows = F.zip_with(gaps, values, lambda gap, value: F.struct(
            F.length(gap).alias("gap"), F.right(gap, F.lit(REACH)).alias("tail"), value.alias("value")))
        return F.when(possible & text.rlike(pattern), rows).otherwise(none)

    digit = text.rlike("[0-9]")
    possible = {"email": F.contains(text, F.lit("@")), "ip": digit & F.contains(text, F.lit(".")), "card": digit,
                "phone": digit & F.contains(text, F.lit("+")), "found": digit}
    wide = docs.where(_may_hold(text)).select("doc_id", "body", F.explode(F.array(*[
        F.struct(F.lit(number).alias("kind_no"), F.lit(kind).alias("kind"), found(kind, possible[kind]).alias("rows"))
        for number, kind in enumerate(PATTERNS)])).alias("k"))
    each = wide.where("k.rows IS NOT NULL").select("doc_id", "body", "k.kind_no", "k.kind", F.posexplode("k.rows").alias("place", "row"))
    # what follows the last match has no value; rows that repeat id and text are one document
    each = each.where("row.value IS NOT NULL").select("doc_id", "body", "kind_no", "kind", "place", "row.*").dropDuplicates(
        ["doc_id", "body", "kind_no", "place"])
    before = Window.partitionBy("doc_id", "body", "kind_no").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("value")
    label, words = F.regexp_extract("tail", LABEL + "$", 1), F.regexp_extract("tail", r"((?:\S+\s+)?\S+)\s*$", 1)
    cue = _cue(F.when(label != "", label).otherwise(words))
    placed = each.withColumn("end", F.sum(F.col("gap") + size).over(before)).withColumn("start", F.col("end") - size)
    return placed.where(_valid(F.col("kind"), F.col("value"))).select(
        "doc_id", "body", "kind_no", "kind", "start", "end", F.lower("value").alias("value"), F.nullif(cue, F.lit("")).alias("cue"))


def _apart(occurrences: DataFrame) -> DataFrame:
    """Without the identifier-like strings that overlap a base span."""
    base = F.col("kind") != "found"
    by_start = Window.partitionBy("doc_id", "body").orderBy("start", "kind_no")
    reached = F.max(F.when(base, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    next_one = F.min(F.when(base, F.col("start"))).over(
        Window.partitionBy("doc_id", "body").orderBy(F.desc("start"), F.desc("kind_no")).rowsBetween(Window.unboundedPreceding, -1))
    clear = (F.coalesce(reached, F.lit(0)) <= F.col("start")) & (next_one.isNull() | (next_one >= F.col("end")))
    return occurrences.withColumn("clear", base | clear).where("clear").drop("clear")


def _against(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """cue, against: how many different strings follow a label that are known to be no identifiers."""
    text = F.col("text")
    possible = reduce(lambda a, b: a | b, [F.contains(text, F.lit(sign)) for sign in SIGNS])
    each = lambda group: F.regexp_extract_all(text, F.lit(FOLLOWED), F.lit(group))
    pairs = docs.where(possible).select(F.explode(F.arrays_zip(each(1).alias("cue"), each(2).alias("value"))).alias("pair"))
    met = pairs.select(_cue(F.col("pair.cue")).alias("cue"), F.lower("pair.value").alias("value")).join(labels, "cue", "left_semi")
    plain = ~F.contains("value", F.lit("@")) & (_digits(F.col("value")) < 4)
    return met.where(plain).groupBy("cue").agg(F.count_distinct("value").alias("against"))


def _discovered(docs: DataFrame, occurrences: DataFrame, rounds: int, confidence: float, support: int) -> DataFrame:
    """The values, one row each, that strong cues vouch for."""
    seed = (F.col("kind") != "found") | F.col("value").rlike(KEY)
    edges = pin(occurrences.where("cue IS NOT NULL").groupBy("cue", "value").agg(F.max(seed.cast("double")).alias("seed")), "cues")
    label = F.col("cue").rlike(LABEL + "$")
    # a label needs support, and every value that could ever back it is an edge
    labels = pin(edges.where(label).groupBy("cue").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("cue"), "labels")
    against = pin(_against(docs, labels), "against")
    seeds = edges.where("seed = 1").select("value", F.lit(1.0).alias("weight")).distinct()
    weights, known = seeds, None
    for _ in range(rounds):
        weighed = edges.join(weights, "value", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
        cues = weighed.groupBy("cue").agg(F.count("*").alias("n"), F.sum("weight").alias("held"),
                                          F.sum((F.col("weight") >= confidence).cast("int")).alias("backers"))
        backed = cues.where(F.col("backers") >= support).join(against, "cue", "left")
        # one counterexample is assumed, so that few instances can't make a cue certain
        others = F.when(label, F.coalesce("against", F.lit(0))).otherwise(F.col("n") - F.col("held"))
        strong = backed.withColumn("score", F.col("held") / (F.col("held") + others + 1)).where(F.col("score") >= confidence).select("cue", "score")
        known = pin(edges.join(strong, "cue").groupBy("value").agg(
            F.max("seed").alias("seed"), (1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("weight")), "values")
        weights = seeds.unionAll(known.where("seed = 0").select("value", "weight"))
    return known.where(F.col("weight") >= confidence).select("value")


def personal_spans(df: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = 3, confidence: float = 0.75,
                   support: int = 3) -> DataFrame:
    """doc_id, body, kind_no, kind, start, end of each span; places are code points, ``end`` is exclusive.

    ``body`` is the xxhash64 of the text. A cue is strong if its score reaches ``confidence`` and at least
    ``support`` different values of that weight follow it. A label's score is the weight of what it precedes, over that
    and the number of different strings behind it that are no identifiers, and one more; that of two words the
    weight over the number of all their instances and one more. Rows that repeat id and text count
    once. A null text is empty; an empty table gives an empty result.
    """
    docs = _keyed(df, key, text)
    occurrences = pin(_apart(_occurrences(docs)), "occurrences")
    more = _discovered(docs, occurrences, rounds, confidence, support)
    base = occurrences.where("kind <> 'found'")
    return base.unionAll(occurrences.where("kind = 'found'").join(more, "value", "left_semi").select(base.columns)).drop("value", "cue")


def find_personal_data(df: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """Per row: doc_id, a count of spans of each kind (n_email ... n_found), base_spans and spans as text.

    A span reads kind:start:end; spans are ordered by kind, then start, and joined by commas. Further columns are
    left out.
    """
    spans = personal_spans(df, key, text, **settings)
    ordered = F.sort_array(F.collect_list(F.struct("kind_no", "start", "end", "kind")))
    told = spans.groupBy("doc_id", "body").agg(ordered.alias("all"))

    def text_of(rows: Column) -> Column:
        return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.coalesce(F.size(F.filter("all", lambda s: s["kind"] == kind)), F.lit(0)).cast("long").alias(f"n_{kind}")

    rows = _keyed(df, key, text).select("doc_id", "body")
    joined = rows.alias("r").join(told.alias("t"), rows["doc_id"].eqNullSafe(told["doc_id"]) & (rows["body"] == told["body"]), "left")
    every = joined.select("r.doc_id", F.when(F.col("t.all").isNotNull(), F.col("t.all")).otherwise(F.array().cast(
        "array<struct<kind_no:int,start:bigint,end:bigint,kind:string>>")).alias("all"))
    return every.select("doc_id", *[count(k) for k in PATTERNS],
                        text_of(F.filter("all", lambda s: s["kind"] != "found")).alias("base_spans"), text_of(F.col("all")).alias("spans"))


def redact(df: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``df`` with each span in ``text`` replaced by its kind in brackets; overlapping spans go as one, named after the first."""
    spans = personal_spans(df, key, text, **settings)
    by_start = Window.partitionBy("doc_id", "body").orderBy("start", "kind_no")
    reached = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reached.isNull() | (F.col("start") >= reached), 1).otherwise(0)
    runs = spans.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("doc_id", "body", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"),
                                                       F.min_by("kind", F.struct("start", "kind_no")).alias("kind"))
    cuts = pin(merged.groupBy("doc_id", "body").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("cuts")), "cuts")
    own = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    # texts that can't hold a span stay where they are: only the others meet their cuts
    rest = df.where(~_may_hold(own))
    rows = df.where(_may_hold(own)).select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("rest"), F.col(f"`{key}`").cast("long").alias("ident"),
                     own.alias("own")).withColumn("hash", F.xxhash64("own"))
    joined = rows.join(cuts, F.col("ident").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("body")), "left")
    own, last = F.col("own"), F.size("cuts")

    def before(place: Column) -> Column:
        begin = F.when(place == 0, F.lit(0)).otherwise(F.get("cuts", place - 1)["end"])
        span = F.get("cuts", place)
        return F.concat(F.substring(own, (begin + 1).cast("int"), (span["start"] - begin).cast("int")), F.lit("["), F.upper(span["kind"]), F.lit("]"))

    parts = F.transform(F.sequence(F.lit(0), last - 1), before)
    behind = F.substring(own, (F.get("cuts", last - 1)["end"] + 1).cast("int"), F.length(own))
    clean = F.when(F.col("cuts").isNull(), F.col(f"rest.`{text}`")).otherwise(F.concat(F.array_join(parts, ""), behind))
    cut = joined.select(*[clean.alias(text) if c == text else F.col(f"rest.`{c}`") for c in df.columns])
    return cut.unionAll(rest.select(*[F.col(f"`{c}`") for c in df.columns]))
