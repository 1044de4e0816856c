"""Newest revisions, and one value per key out of conflicting filings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterdeck.operators.skew import SALT, spread
from quarterdeck.panel import column

# The lower rank is preferred, a code that is not listed is unknown.
FILING_STATUS_RANK = {"MR": 1, "OR": 2, "PR": 3, "RS": 4, "ER": 5}
ACCOUNTING_STANDARD_RANK = {"IAS/IFRS": 1, "US GAAP": 2}
UNKNOWN = 99
#: Measures of a row that travel together, and those of them that are aggregated as the columns of one row: a measure has up to three
#: aggregates, and Spark compiles a stage as a whole only below 100 columns.
RUN, SIDE = 64, 16
RULES = ["_updated", "_consolidated", "_status", "_standard"]
#: Bytes of the files read for which a resolution has at least one task, however few tasks the session's shuffles have: where rows are
#: dealt out, of which a task has one aggregate, and where groups are folded, which are held by one aggregate for each rule.
DEALT, FOLDED = 8 << 20, 4 << 20
#: The same for rows dealt out to more tasks than a map side can write to without holding its rows.
DEALT_HELD = 32 << 20


def latest_revision(df: DataFrame, keys: list[str], revision: str) -> DataFrame:
    """All rows of the highest revision of each key; equal revisions are all kept.

    A rank filter: Spark drops what can't have rank 1 before the shuffle, so of a key with very many rows
    only each task's rows of its highest revision travel. Null keys form a group of
    their own, and a null revision is below all others.
    """
    newest = Window.partitionBy(*[column(k) for k in keys]).orderBy(column(revision).desc_nulls_last())
    return df.withColumn("_rank", F.rank().over(newest)).where(F.col("_rank") == 1).drop("_rank")


def latest_revision_join(base: DataFrame, revised: DataFrame, keys: list[str],
                         revision: str, heavy: dict[int, float] | None = None) -> DataFrame:
    """``base`` with the newest revision of each key; keys without one drop out.

    Several rows of the newest revision repeat the base row. ``heavy`` names the keys of ``base``
    to spread, as ``skew.heavy_keys`` finds them.
    """
    newest = latest_revision(revised, keys, revision)
    clash = [c for c in newest.columns if c in base.columns and c not in keys]
    rows, (newest,), on = spread(base, [newest.drop(*clash)], keys, heavy)
    return rows.join(newest, on, "inner").drop(SALT)


def _rank(code: str, ranks: dict[str, int]) -> Column:
    cases = [F.when(column(code) == k, F.lit(r)) for k, r in ranks.items()]
    return F.coalesce(*cases, F.lit(UNKNOWN))


def _ranks(updated: str, consolidated: str, status: str, standard: str) -> list[Column]:
    """The columns that ``RULES`` names."""
    ranks = [column(updated), F.when(column(consolidated) == "Y", 0).otherwise(1),
             _rank(status, FILING_STATUS_RANK), _rank(standard, ACCOUNTING_STANDARD_RANK)]
    return [r.alias(name) for r, name in zip(ranks, RULES, strict=True)]


def _grouped(ranked: DataFrame, keys: list[str], by: list[str], n: range) -> DataFrame:
    """The smallest and the largest ``_v<i>`` of each group of rows that have a key."""
    # rows without a key are left out here and not by a filter of their own: that one would be
    # pushed below the expressions the keys are made of and work them out a second time
    keyed = reduce(lambda a, b: a & b, [column(k).isNotNull() for k in keys])
    return ranked.groupBy(*by).agg(
        F.bool_and(keyed).alias("_keyed"),
        *[f(F.col(f"_v{i}")).alias(f"{p}{i}") for i in n
          for f, p in ((F.min, "_lo"), (F.max, "_hi"))]).where("_keyed").drop("_keyed")


def _folded(groups: DataFrame, keys: list[str], n: range) -> DataFrame:
    """``_best<i>`` of each key out of the groups by key and rules: the rules from last to first."""
    known = {"_updated": F.col("_updated").isNotNull(), "_consolidated": F.lit(True),
             "_status": F.col("_status") != UNKNOWN, "_standard": F.col("_standard") != UNKNOWN}
    agrees = lambda i: F.col(f"_lo{i}") == F.col(f"_hi{i}")
    groups = groups.withColumns({f"_best{i}": F.when(agrees(i) & known["_standard"], F.col(f"_lo{i}"))
                                 for i in n})

    for depth in range(len(RULES) - 1, -1, -1):
        rule = RULES[depth]
        pick = F.max_by if rule == "_updated" else F.min_by
        # a subgroup without any value of the column does not compete for it
        order = lambda i: F.when(F.col(f"_lo{i}").isNotNull(), F.col(rule))
        groups = groups.groupBy(*keys, *RULES[:depth]).agg(
            *[F.min(f"_lo{i}").alias(f"_lo{i}") for i in n],
            *[F.max(f"_hi{i}").alias(f"_hi{i}") for i in n],
            *[pick(F.col(f"_best{i}"), order(i)).alias(f"_best{i}") for i in n])
        usable = known[RULES[depth - 1]] if depth else F.lit(True)
        groups = groups.withColumns({
            f"_best{i}": F.when(usable, F.when(agrees(i), F.col(f"_lo{i}"))
                                .otherwise(F.col(f"_best{i}"))) for i in n})
    return groups


def resolve_by_priority(df: DataFrame, keys: list[str], values: list[str], updated: str, consolidated: str,
                        status: str, standard: str) -> DataFrame:
    """One value per key and column, by priority rules over conflicting rows.

    Per column, over the rows where it is not null: if they agree, that value.
    Otherwise keep, in turn, the rows with the latest update, the consolidated
    ones if there are any, those of the best filing status, and those of the best
    accounting standard, until the rows left agree. If they never do, or a needed
    update date, status or standard is unknown for all of them, the result is null.

    The rows are reduced once to one per key and rank combination, keeping each
    column's smallest and largest value; the map side combines, so a key with
    very many rows arrives as few. Where updates are days or times, hardly two rows are alike in all that and a
    map side would hold a whole file split as groups: there the rows are dealt out first, to no more tasks than
    a map side can write to without holding its rows, and combine in the tasks they come to, those of one input
    part together. The rules are then folded from last to first:
    at every step a group either agrees or passes on the result of its best
    subgroup. All aggregates are over plain columns, without collected lists.
    """
    n = range(len(values))
    ranked = df.select(*keys, *[column(v).alias(f"_v{i}") for i, v in enumerate(values)],
                       *_ranks(updated, consolidated, status, standard))

    kind = dict(df.dtypes)[updated]
    dealt = kind.startswith(("date", "timestamp"))
    size = _bytes_read(df)
    # the rows of a group go to as many tasks as it has input parts, so a heavy one is spread
    parts = ["_part"] if dealt else []
    if dealt:
        ranked = ranked.withColumn("_part", F.spark_partition_id()).repartition(_dealt_tasks(df, size), *keys, *RULES, "_part")

    groups = _grouped(ranked, keys, [*keys, *RULES, *parts], n)
    # from here on every grouping contains the keys: one exchange serves all of them. A key has
    # few rows left, at most one per calendar day and code; update times are not bounded that
    # way, so there only the last grouping, which combines on the map side, is by key alone
    # tasks are not joined: the groups of a task are held by several aggregates
    groups = groups.repartition(_tasks(size, FOLDED, _session_tasks(df)), *keys, *(["_updated"] if kind.startswith("timestamp") else []))
    if dealt:
        groups = groups.groupBy(*keys, *RULES).agg(*[F.min(f"_lo{i}").alias(f"_lo{i}") for i in n],
                                                   *[F.max(f"_hi{i}").alias(f"_hi{i}") for i in n])
    return _folded(groups, keys, n).select(*keys, *[F.col(f"_best{i}").alias(v) for i, v in enumerate(values)])


def _session_tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _bytes_read(df: DataFrame) -> int:
    """Of the files that ``df`` reads."""
    spark = df.sparkSession
    conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    places = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in df.inputFiles()]
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in places)


def _tasks(size: int, part: int, least: int) -> int:
    """One for each ``part`` of ``size`` bytes, and ``least`` at least."""
    return max(least, -(-size // part))


def _dealt_tasks(df: DataFrame, size: int, runs: int = 1) -> int:
    """Tasks that rows are dealt out to, each of them as ``runs`` rows.

    Up to ``spark.shuffle.sort.bypassMergeThreshold`` of them Spark writes a row to its task's file at once; with more, a map side
    holds all its rows, a whole file split, to put them in order. So there are more only where each would get too much, or
    for more cores.
    """
    spark = df.sparkSession
    streamed = max(int(spark.conf.get("spark.shuffle.sort.bypassMergeThreshold", "200")), spark.sparkContext.defaultParallelism)
    return _tasks(size, DEALT_HELD, min(streamed, _tasks(size, DEALT, _session_tasks(df) * runs)))


def resolve_wide(df: DataFrame, keys: list[str], values: list[str], updated: str, consolidated: str,
                 status: str, standard: str) -> DataFrame:
    """``resolve_by_priority`` for hundreds of columns: the same rules and the same result.

    The measures of a type are resolved as those of ``SIDE`` columns, a row for every ``SIDE`` of them, so that the aggregates, and the
    code that Spark compiles for them, don't grow with the number of measures. Values cross two exchanges: before they are taken
    apart, as runs of ``RUN`` measures of a row, dealt out by key and run, which serves all groupings by the rules; and settled, on the
    return to columns. The rows of a key don't combine before the first exchange, but its runs go to different tasks. Runs without a
    value stay behind, but for the first of a row: it keeps a key without values. Types apart, as only values of fixed size are
    aggregated by hash. As a row becomes as many as it has runs, they go to so many times the tasks that the session's shuffles
    have, if a map side can write to them without holding its rows.
    """
    types = dict(df.dtypes)
    ranks, size = _ranks(updated, consolidated, status, standard), _bytes_read(df)
    out = None
    for kind in sorted({types[v] for v in values}):
        own = [i for i, v in enumerate(values) if types[v] == kind]
        n, sides, runs = range(min(SIDE, len(own))), range(min(RUN // SIDE, -(-len(own) // SIDE))), range(-(-len(own) // RUN))
        tasks = _dealt_tasks(df, size, len(runs))
        cell = lambda at: (column(values[own[at]]) if at < len(own) else F.lit(None)).cast(kind)
        side = lambda at: F.struct(*[cell(at + j).alias(f"_v{j}") for j in n])
        # runs are structs of their own before they are exploded: compiled code writes them, in parts small enough for the virtual machine
        packed = df.select(*map(column, keys), *ranks, *[F.struct(*[side(r * RUN + s * SIDE).alias(f"_s{s}") for s in sides]).alias(f"_r{r}") for r in runs])
        taken = packed.select(*map(column, keys), *RULES, F.posexplode(F.array(*[F.col(f"_r{r}") for r in runs])).alias("_run", "_xs"))
        some = F.coalesce(*[F.col(f"_xs._s{s}._v{j}") for s in sides for j in n]).isNotNull()
        dealt = taken.where((F.col("_run") == 0) | some).repartition(tasks, *map(column, keys), "_run")
        parts = dealt.select(*map(column, keys), "_run", *RULES, F.posexplode(F.array(*[F.col(f"_xs._s{s}") for s in sides])).alias("_side", "_x"))
        # no filter on these columns: the optimizer would note it once for each subset of the names that they get next
        by = [*keys, "_run", "_side"]
        settled = _folded(_grouped(parts.select(*map(column, by), *RULES, "_x.*"), keys, [*by, *RULES], n), by, n)
        place = (F.col("_run") * (RUN // SIDE) + F.col("_side")).alias("_at")
        found = settled.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(place, F.struct(*[F.col(f"_best{j}") for j in n])))).alias("_m"))
        part = found.select(*keys, *[F.try_element_at("_m", F.lit(at // SIDE))[f"_best{at % SIDE}"].alias(f"_v{i}") for at, i in enumerate(own)])
        out = part if out is None else out.join(part, keys)
    return out.select(*keys, *[F.col(f"_v{i}").alias(v) for i, v in enumerate(values)])
