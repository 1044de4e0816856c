"""Imputation and the split into training and test rows."""

import uuid

from pyspark.sql import functions as F

from quarterdeck.operators import impute
from quarterdeck.operators.ar1 import impute_ar1
from quarterdeck.operators.reshape import union_rows
from quarterdeck.panel import PanelSpec
from quarterdeck.session import scratch_path
from quarterdeck.sources.tables import write_bucketed
from registry.book import query, rounded

PANEL = PanelSpec.of("entity", ("yr", "qtr"))


def fill_sql(src: str, x: str, part: str = "entity", order: str = "yr, qtr", tag: str = "",
             head: bool = True) -> str:
    """CTEs, their names led by ``tag`` (``head=False`` leaves the head as it is): ``placed`` with head-filled h, last value row l, last gap row b; ``line`` per entity."""
    w = f"(PARTITION BY {part} ORDER BY {order})"
    full = f"(PARTITION BY {part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"""
{tag}rows_ AS (SELECT *, row_number() OVER {w} AS i, count({x}) OVER {w} AS seen,
            first_value({x} IGNORE NULLS) OVER {full} AS f FROM {src}),
{tag}head AS (SELECT *, {f"CASE WHEN seen = 0 THEN f ELSE {x} END" if head else x} AS h FROM {tag}rows_),
{tag}lasts AS (SELECT {part}, max(CASE WHEN h IS NOT NULL THEN i END) AS l FROM {tag}head GROUP BY {part}),
{tag}gaps AS (SELECT {tag}head.{part}, max(CASE WHEN h IS NULL AND i < l THEN i ELSE 0 END) AS b
         FROM {tag}head JOIN {tag}lasts ON {tag}head.{part} = {tag}lasts.{part} GROUP BY {tag}head.{part}),
{tag}line AS (SELECT {tag}head.{part} AS e, any_value(l) AS l, any_value(b) AS b,
           CASE WHEN count(h) > 1 THEN regr_slope(h, i - b - 1) ELSE 0 END AS slope,
           CASE WHEN count(h) > 1 THEN regr_intercept(h, i - b - 1) ELSE max(h) END AS level
         FROM {tag}head JOIN {tag}lasts ON {tag}head.{part} = {tag}lasts.{part} JOIN {tag}gaps ON {tag}head.{part} = {tag}gaps.{part}
         WHERE i > b AND i <= l GROUP BY {tag}head.{part}),
{tag}tail AS (SELECT {tag}head.*, CASE WHEN i > l THEN level + slope * (i - b - 1) ELSE h END AS t
         FROM {tag}head LEFT JOIN {tag}line ON e = {part}),
{tag}near AS (SELECT *, max(CASE WHEN t IS NOT NULL THEN i END) OVER {w} AS i0,
           min(CASE WHEN t IS NOT NULL THEN i END) OVER (PARTITION BY {part} ORDER BY {order}
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS i1 FROM {tag}tail),
{tag}filled AS (SELECT n.*, CASE WHEN n.t IS NOT NULL THEN n.t
             ELSE a.t + (c.t - a.t) / (n.i1 - n.i0) * (n.i - n.i0) END AS y
           FROM {tag}near n LEFT JOIN {tag}tail a ON a.{part} = n.{part} AND a.i = n.i0
           LEFT JOIN {tag}tail c ON c.{part} = n.{part} AND c.i = n.i1)"""


def ar1_sql(src: str, x: str, name: str) -> str:
    """CTE ``name``: the forward walk one row at a time; each fit goes over the lists of all earlier pairs."""
    return f"""
{name}_n AS (SELECT entity, yr, qtr, {x} AS x, row_number() OVER (PARTITION BY entity ORDER BY yr, qtr) AS i FROM {src}),
{name} AS (SELECT entity, yr, qtr, i, CAST(x AS DOUBLE) AS v, []::DOUBLE[] AS xs, []::DOUBLE[] AS ys FROM {name}_n WHERE i = 1
  UNION ALL
  SELECT entity, yr, qtr, i, v, CASE WHEN p THEN list_append(xs, l) ELSE xs END, CASE WHEN p THEN list_append(ys, v) ELSE ys END
  FROM (SELECT *, l IS NOT NULL AND v IS NOT NULL AS p FROM (
    SELECT *, CASE WHEN x IS NOT NULL THEN x WHEN l IS NULL THEN NULL
                   WHEN len(xs) >= 3 AND sxx > len(xs) * (1e-12 * mx) ** 2
                   THEN my + greatest(least(sxy / nullif(sxx, 0), 0.999999), -0.999999) * (l - mx) ELSE l END AS v
    FROM (SELECT *, list_sum(list_transform(xs, lambda q: (q - mx) ** 2)) AS sxx,
                 list_sum(list_transform(list_zip(xs, ys), lambda z: (z[1] - mx) * (z[2] - my))) AS sxy
      FROM (SELECT r.entity, r.yr, r.qtr, r.i, r.x, w.v AS l, xs, ys, list_avg(xs) AS mx, list_avg(ys) AS my
            FROM {name} w JOIN {name}_n r ON r.entity = w.entity AND r.i = w.i + 1) AS a) AS b) AS c) AS d)"""


def frames_sql(src: str, features: list[str], targets: list[str], cutoff: int, negative=(), digits: int = 3) -> str:
    """The four frames from ``src``, which has a row per entity and quarter."""
    measures = [*features, *targets]
    neutral = ", ".join(f"CASE WHEN avg(CASE WHEN {m} IS NULL THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY entity) > 0.8 "
                        f"THEN 0 ELSE {m} END AS {m}" for m in measures)
    ctes = [f"neutral AS (SELECT entity, yr, qtr, {neutral} FROM {src} WHERE yr < {cutoff})"]
    ctes += [fill_sql("neutral", m, tag=f"{m}_") for m in measures]
    for m in features:
        ctes.append(f"{m}_h AS (SELECT entity, yr, qtr, y AS x FROM {m}_filled UNION ALL "
                    f"SELECT entity, yr, qtr, {m} FROM {src} WHERE yr >= {cutoff})")
        ctes.append(ar1_sql(f"{m}_h", "x", f"{m}_w"))

    def frame(name, cols, cell, tables, where):
        sign = lambda m: "-" if m in negative else ""
        out = [f"{sign(m)}round({cell(m)}, {digits}) AS {m}" if m in cols else f"NULL AS {m}" for m in measures]
        joined = f"{tables(cols[0])} {cols[0]}_t " + " ".join(
            f"JOIN {tables(m)} {m}_t USING (entity, yr, qtr)" for m in cols[1:])
        return f"SELECT '{name}' AS frame, entity, yr, qtr, {', '.join(out)} FROM {joined} WHERE {where}"

    test = f"yr >= {cutoff}"
    parts = [frame("train_x", features, lambda m: f"{m}_t.y", lambda m: f"{m}_filled", "true"),
             frame("train_y", targets, lambda m: f"{m}_t.y", lambda m: f"{m}_filled", "true"),
             frame("test_x", features, lambda m: f"{m}_t.v", lambda m: f"{m}_w", test),
             frame("test_y", targets, lambda m: f"{m}_t.{m}", lambda m: src, test)]
    return ", ".join(ctes) + " " + " UNION ALL ".join(parts)


@query("neutralize_sparse_columns", """
SELECT entity, yr, qtr, CASE WHEN avg(CASE WHEN gappy IS NULL THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY entity) > 0.8
       THEN 0 ELSE gappy END AS gappy, sales FROM fx_panel""", "fx_panel")
def _(t):
    p = t.fx_panel.select("entity", "yr", "qtr", "gappy", "sales")
    return impute.neutralize_sparse_columns(p, PANEL, ["gappy", "sales"])


@query("fill_head", f"WITH {fill_sql('fx_panel', 'gappy')} SELECT entity, yr, qtr, h AS gappy FROM head", "fx_panel")
def _(t):
    return impute.fill_head(t.fx_panel.select("entity", "yr", "qtr", "gappy"), PANEL, ["gappy"])


@query("fill_tail_trend", f"""
WITH {fill_sql('fx_cents', 'gappy', head=False)} SELECT entity, yr, qtr, round(t, 3) AS gappy FROM tail""", "fx_cents")
def _(t):
    p = t.fx_cents.select("entity", "yr", "qtr", "gappy")
    return rounded(impute.fill_tail_trend(p, PANEL, ["gappy"]), "gappy", digits=3)


@query("fill_interior_linear", """
WITH r AS (SELECT entity, yr, qtr, gappy, row_number() OVER (PARTITION BY entity ORDER BY yr, qtr) AS i FROM fx_cents),
n AS (SELECT *, max(CASE WHEN gappy IS NOT NULL THEN i END) OVER (PARTITION BY entity ORDER BY i) AS i0,
        min(CASE WHEN gappy IS NOT NULL THEN i END) OVER (PARTITION BY entity ORDER BY i
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS i1 FROM r)
SELECT n.entity, n.yr, n.qtr, round(CASE WHEN n.gappy IS NOT NULL THEN n.gappy
       ELSE a.gappy + (c.gappy - a.gappy) / (n.i1 - n.i0) * (n.i - n.i0) END, 3) AS gappy
FROM n LEFT JOIN r a ON a.entity = n.entity AND a.i = n.i0 LEFT JOIN r c ON c.entity = n.entity AND c.i = n.i1""",
       "fx_cents")
def _(t):
    p = t.fx_cents.select("entity", "yr", "qtr", "gappy")
    return rounded(impute.fill_interior_linear(p, PANEL, ["gappy"]), "gappy", digits=3)


@query("impute_panel", f"""
WITH {fill_sql('fx_cents', 'gappy')} SELECT entity, yr, qtr, round(y, 3) AS gappy, sales FROM filled""",
       "fx_cents")
def _(t):
    p = t.fx_cents.select("entity", "yr", "qtr", "gappy", "sales")
    return rounded(impute.impute_panel(p, PANEL, ["gappy", "sales"]), "gappy", digits=3)


WIDE = 200
#: Keeps sums of cells away from the halves that rounding could take either way.
SCALE = 0.6180339887


@query("impute_wide", f"""
WITH spread AS (SELECT entity * 10 + p AS ep, entity, p, yr, qtr, sales,
                       CASE WHEN (yr * 4 + qtr + p) % 10 < p THEN NULL ELSE CAST(gappy AS DOUBLE) END AS x
                FROM fx_cents, (SELECT unnest(range(10)) AS p) AS r),
{fill_sql("spread", "x", "ep")}
SELECT entity, yr, qtr, any_value(sales) AS sales, CAST(count(y) * {WIDE // 10} AS BIGINT) AS n,
       round({SCALE} * sum({WIDE // 10} * y + {WIDE // 10} * p + {sum(range(0, WIDE, 10))}), 3) AS total,
       round({SCALE} * max(CASE WHEN p = 3 THEN y + 13 END), 3) AS m13
FROM filled GROUP BY entity, yr, qtr""", "fx_cents")
def _(t):
    """Hundreds of measures of a panel filled at once, with gaps of different kinds, and summed up by key."""
    def measure(i):
        gap = (F.col("yr") * 4 + F.col("qtr") + i % 10) % 10 < i % 10
        return F.when(~gap, F.col("gappy") + i).alias(f"m{i}")

    names = [f"m{i}" for i in range(WIDE)]
    panel = t.fx_cents.select("entity", "yr", "qtr", "sales", *map(measure, range(WIDE)))
    wide = impute.impute_wide(panel, PANEL, names)
    values = F.array_compact(F.array(*names))
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    wide = wide.select("entity", "yr", "qtr", "sales", F.size(values).cast("long").alias("n"),
                       F.when(F.size(values) > 0, total * SCALE).alias("total"), (F.col("m13") * SCALE).alias("m13"))
    return rounded(wide, "total", "m13", digits=3)


@query("impute_bucketed", f"""
WITH {fill_sql('fx_cents', 'gappy')} SELECT entity, yr, qtr, round(y, 3) AS gappy, sales FROM filled""",
       "fx_cents")
def _(t):
    """The same fills on a table that is written by entity, which needs no exchange any more."""
    name = f"panel_{uuid.uuid4().hex}"
    table = write_bucketed(t.fx_cents.select("entity", "yr", "qtr", "gappy", "sales"), name, ["entity"], ["yr", "qtr"], 8,
                           scratch_path(t.spark, "bucketed"))
    return rounded(impute.impute_panel(table, PANEL, ["gappy", "sales"]), "gappy", digits=3)


@query("impute_events", f"""
WITH gapped AS (SELECT event_id, user_id, ts, CASE WHEN event_id * 7919 % 11 >= 4 AND event_id % 400 > 30 THEN value END AS x FROM events),
{fill_sql("gapped", "x", "user_id", "ts, event_id")} SELECT event_id, round(y, 6) AS x FROM filled""")
def _(t):
    """Raw events, of which one user may hold any share, filled in blocks."""
    shown = (F.col("event_id") * 7919 % 11 >= 4) & (F.col("event_id") % 400 > 30)
    gapped = t.events.select("event_id", "user_id", "ts", F.when(shown, F.col("value")).alias("x"))
    spec = PanelSpec.of("user_id", ("ts", "event_id"), bounded=False)
    return rounded(impute.impute_events(gapped, spec, ["x"]), "x").select("event_id", "x")


@query("impute_ar1", f"""
WITH {ar1_sql("fx_cents", "gappy", "walk")}
SELECT entity, yr, qtr, round(v, 3) AS gappy FROM walk""", "fx_cents", recursive=True)
def _(t):
    p = t.fx_cents.select("entity", "yr", "qtr", "gappy")
    return rounded(impute_ar1(p, PANEL, ["gappy"]), "gappy", digits=3)


@query("split_panel", """
SELECT entity, yr, qtr, sales, CASE WHEN yr < 1999 THEN 'train' ELSE 'test' END AS split
FROM (SELECT *, count(CASE WHEN yr < 1999 THEN 1 END) OVER (PARTITION BY entity) AS n
      FROM fx_panel WHERE gappy IS NOT NULL) AS x WHERE n >= 3""", "fx_panel")
def _(t):
    p = t.fx_panel.where("gappy is not null").select("entity", "yr", "qtr", "sales")
    return impute.split_panel(p, PANEL, cutoff=1999)


@query("build_train_test", """
WITH src AS (SELECT entity, yr, qtr, gappy, qty, lead(gappy) OVER (PARTITION BY entity ORDER BY yr, qtr) AS target
             FROM fx_cents), """ + frames_sql("src", ["gappy", "qty"], ["target"], 1999), "fx_cents", recursive=True)
def _(t):
    """The four frames under one roof, each row marked with the frame it is from."""
    p = t.fx_cents.withColumn("target", F.lead("gappy").over(PANEL.window()))
    frames = impute.build_train_test(p.select("entity", "yr", "qtr", "gappy", "qty", "target"), PANEL,
                                     ["gappy", "qty"], ["target"], cutoff=1999)
    parts = [f.withColumn("frame", F.lit(name)) for name, f in frames.items()]
    return rounded(union_rows(*parts), "gappy", "qty", "target", digits=3).select(
        "frame", "entity", "yr", "qtr", "gappy", "qty", "target")
