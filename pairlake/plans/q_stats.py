"""Statistics-collector queries, batch and streaming.

Reports: events as (name = event_type, rank = user_id % 4, round = day of
month) with some values replaced by NaN, +-inf and 1e20; 'purchase' is
silent on days = 1 mod 4 and never reported by rank 3.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlake.functions.timefmt import epoch_seconds
from pairlake.operators import catalog as C
from pairlake.operators import stats as ST
from pairlake.operators.sets import common_names
from pairlake.plans.registry import register
from pairlake.session import load_table
from pairlake.streaming import collector as R


def reports(spark, sf):
    ev = load_table(spark, sf, "events")
    e = F.col("event_id")
    v = (F.when(e % 101 == 0, F.lit(float("nan"))).when(e % 103 == 0, F.lit(float("inf")))
         .when(e % 107 == 0, F.lit(1e20)).when(e % 109 == 0, F.lit(float("-inf"))).otherwise(F.col("value")))
    r = ev.select("event_id", "ts", F.col("event_type").alias("name"), (F.col("user_id") % 4).cast("int").alias("rank"),
                  F.dayofmonth("ts").cast("int").alias("round"), v.alias("value"))
    silent = (F.col("name") == "purchase") & ((F.col("round") % 4 == 1) | (F.col("rank") == 3))
    return r.filter(~silent)


_R = """r AS (SELECT * FROM (SELECT event_id, ts, event_type AS name, CAST(user_id % 4 AS INTEGER) AS rank,
  CAST(day(ts) AS INTEGER) AS round,
  CASE WHEN event_id % 101 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 103 = 0 THEN 'inf'::DOUBLE
       WHEN event_id % 107 = 0 THEN 1e20 WHEN event_id % 109 = 0 THEN '-inf'::DOUBLE ELSE value END AS value
  FROM events) WHERE NOT (name = 'purchase' AND (round % 4 = 1 OR rank = 3))),
rf AS (SELECT *, (NOT isnan(value) AND abs(value) < 1.8446742974197924e19) AS ok FROM r)"""


def _mom(keys: str, src: str = "rf") -> str:
    return f"""SELECT {keys}, CAST(sum(CAST(ok AS BIGINT)) AS BIGINT) AS num, sum(CASE WHEN ok THEN value ELSE 0 END) AS s,
  sum(CASE WHEN ok THEN value * value ELSE 0 END) AS ss FROM {src} GROUP BY {keys}"""


_STATS = """num, round(CASE WHEN num = 0 THEN 'NaN'::DOUBLE ELSE s / num END, 6) AS mean,
  round(CASE WHEN num = 0 OR isnan(s) OR isinf(s) THEN 'NaN'::DOUBLE WHEN num = 1 THEN 0.0
             ELSE sqrt(greatest(ss / num - (s / num) * (s / num), 0)) END, 6) AS std"""


def _round_stats(df, *keys):
    return df.select(*keys, "num", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@register("collect_stats", ids=("A3", "P8"), sql=f"""
WITH {_R}, m AS ({_mom('name')}) SELECT name, {_STATS} FROM m
""")
def q_collect_stats(spark, sf):
    return _round_stats(ST.collect_stats(reports(spark, sf)), "name")


@register("merge_moments", ids=("A4",), sql=f"""
WITH {_R}, m AS ({_mom('name, rank')})
SELECT name, CAST(sum(num) AS BIGINT) AS num, round(sum(s), 6) AS sum, round(sum(ss), 4) AS sumsq FROM m GROUP BY name
""")
def q_merge_moments(spark, sf):
    per_rank = ST.moments(reports(spark, sf), ["name", "rank"], "value")
    m = ST.merge_moments(per_rank, "name")
    return m.select("name", "num", F.round("sum", 6).alias("sum"), F.round("sumsq", 4).alias("sumsq"))


@register("stat_deltas", ids=("W3",), sql=f"""
WITH {_R}, m AS ({_mom('name, round')}) SELECT name, round, {_STATS} FROM m WHERE num <> 0
""")
def q_stat_deltas(spark, sf):
    return _round_stats(ST.moments_to_stats(ST.stat_deltas(reports(spark, sf))), "name", "round")


@register("cumulative_stats", ids=("W5",), sql=f"""
WITH {_R}, d AS ({_mom('name, round')}),
c AS (SELECT name, round, CAST(sum(num) OVER w AS BIGINT) AS num, sum(s) OVER w AS s, sum(ss) OVER w AS ss FROM d WHERE num <> 0
      WINDOW w AS (PARTITION BY name ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT name, round, {_STATS} FROM c
""")
def q_cumulative_stats(spark, sf):
    c = ST.cumulative_stats(ST.stat_deltas(reports(spark, sf)))
    return _round_stats(ST.moments_to_stats(c), "name", "round")


@register("keep_previous", ids=("W4",), sql=f"""
WITH {_R}, d AS ({_mom('name, round')}), dd AS (SELECT * FROM d WHERE num <> 0),
sp AS (SELECT f.name, rr.round FROM (SELECT name, min(round) AS f FROM dd GROUP BY name) f
       JOIN (SELECT DISTINCT round FROM dd) rr ON rr.round >= f.f),
j AS (SELECT sp.name, sp.round, dd.num, dd.s, dd.ss FROM sp LEFT JOIN dd ON sp.name = dd.name AND sp.round = dd.round),
k AS (SELECT name, round,
  last(num IGNORE NULLS) OVER w AS num, last(s IGNORE NULLS) OVER w AS s, last(ss IGNORE NULLS) OVER w AS ss FROM j
  WINDOW w AS (PARTITION BY name ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT name, round, {_STATS} FROM k
""")
def q_keep_previous(spark, sf):
    k = ST.keep_previous(ST.stat_deltas(reports(spark, sf)))
    return _round_stats(ST.moments_to_stats(k), "name", "round")


@register("filter_names", ids=("P7",), sql=f"""
WITH {_R}, m AS ({_mom('name')}) SELECT name, {_STATS} FROM m WHERE regexp_full_match(name, 'c.*|view')
""")
def q_filter_names(spark, sf):
    return _round_stats(ST.collect_stats(ST.filter_names(reports(spark, sf), "c.*|view")), "name")


@register("report0_stats", ids=("R4", "A3"), sql=f"""
WITH {_R}, m AS ({_mom('name', '(SELECT * FROM rf WHERE rank = 0)')}) SELECT name, {_STATS} FROM m
""")
def q_report0(spark, sf):
    return _round_stats(ST.collect_stats(ST.report0(reports(spark, sf))), "name")


_STEP = "CAST(floor(epoch(ts) / 3600) AS BIGINT)"


def _metric_rows(spark, sf):
    """Training-metric reports: (hour step, metric = event type, rank,
    value = ln(1 + event value)).  The log keeps metric values off exact
    decimal ties: raw 2-decimal values averaged over 2^k reports land exactly
    on ...5 at the 7th decimal, where two engines' summation orders round
    the 6-decimal log text differently."""
    ev = load_table(spark, sf, "events")
    step = F.floor(epoch_seconds(ev, "ts") / 3600).cast("long")
    return ev.select(step.alias("step"), F.col("event_type").alias("metric"),
                     (F.col("user_id") % 4).cast("int").alias("rank"), F.log1p("value").alias("value"))


_A7 = f"""pr AS (SELECT {_STEP} AS step, event_type AS metric, user_id % 4 AS rank, avg(ln(1 + value)) AS v
        FROM events GROUP BY ALL),
a7 AS (SELECT step, metric, avg(v) AS value FROM pr GROUP BY step, metric)"""


@register("rank_mean", ids=("A7",), sql=f"""
WITH {_A7} SELECT step, metric, round(value, 6) AS value FROM a7
""")
def q_rank_mean(spark, sf):
    m = ST.rank_mean(_metric_rows(spark, sf))
    return m.select("step", "metric", F.round("value", 6).alias("value"))


@register("metric_log_roundtrip", ids=("F29", "S9", "A7"), sql=f"""
WITH {_A7} SELECT step, metric, round(value, 6) AS value FROM a7
""")
def q_metric_log(spark, sf):
    m = ST.rank_mean(_metric_rows(spark, sf))
    lines = C.format_metric_log(m)
    # a colour-coded timestamp prefix as the logger writes it, plus a noise line per step
    coloured = lines.select(F.concat(F.lit("\x1b[34m[2024-01-01 00:00:00]\x1b[0m "), F.col("line")).alias("value"))
    noise = lines.select(F.concat(F.lit("checkpoint saved at step "), F.col("step").cast("string")).alias("value"))
    parsed = C.parse_metric_log(coloured.unionByName(noise))
    return parsed.select("step", "metric", F.round("value", 6).alias("value"))


@register("replica_consistency", ids=("A9", "F24"), sql="""
WITH rep AS (
  SELECT p_name || '#' || CAST(p_partkey AS VARCHAR) AS name, replica,
    CASE WHEN p_partkey % 300 = 0 THEN 'NaN'::DOUBLE
         WHEN p_partkey % 500 = 7 AND replica = 2 THEN p_retailprice + 0.01 ELSE p_retailprice END AS value
  FROM part, range(4) t(replica)),
v AS (SELECT name, replica, CASE WHEN isnan(value) THEN 0.0 ELSE value END AS v FROM rep
      WHERE NOT regexp_full_match(name, '.*#1\\d*'))
SELECT name, max(CASE WHEN replica = 0 THEN v END) AS replica0, min(v) AS min_value, max(v) AS max_value
FROM v GROUP BY name HAVING min(v) <> max(CASE WHEN replica = 0 THEN v END) OR max(v) <> max(CASE WHEN replica = 0 THEN v END)
  OR max(CASE WHEN replica = 0 THEN v END) IS NULL
""")
def q_replica_consistency(spark, sf):
    p = load_table(spark, sf, "part")
    rep = p.select(F.concat(F.col("p_name"), F.lit("#"), F.col("p_partkey").cast("string")).alias("name"),
                   "p_partkey", "p_retailprice", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("replica"))
    value = (F.when(F.col("p_partkey") % 300 == 0, F.lit(float("nan")))
             .when((F.col("p_partkey") % 500 == 7) & (F.col("replica") == 2), F.col("p_retailprice") + 0.01)
             .otherwise(F.col("p_retailprice")))
    rep = rep.select("name", F.col("replica").cast("long").alias("replica"), value.alias("value"))
    return ST.replica_consistency(rep, ignore_regex=r".*#1\d*")


_NAMES = """n AS (SELECT rank, name, row_number() OVER (PARTITION BY rank ORDER BY name) - 1 AS pos
       FROM (SELECT DISTINCT rank, name FROM r))"""


@register("name_set_fingerprints", ids=("A10",), sql=f"""
WITH {_R}, {_NAMES}
SELECT rank, count(*) AS n_names,
  CAST(sum(('0x' || substr(md5(CAST(pos AS VARCHAR) || '|' || name), 1, 8))::BIGINT) AS BIGINT) AS fingerprint
FROM n GROUP BY rank
""")
def q_name_fingerprints(spark, sf):
    from pyspark.sql import Window
    r = reports(spark, sf).select("rank", "name").distinct()
    n = r.withColumn("pos", F.row_number().over(Window.partitionBy("rank").orderBy("name")) - 1)
    return ST.name_set_fingerprints(n, "rank", "pos", "name")


@register("common_names", ids=("U4",), sql=f"""
WITH {_R} SELECT name FROM r GROUP BY name HAVING count(DISTINCT rank) = (SELECT count(DISTINCT rank) FROM r)
""")
def q_common_names(spark, sf):
    return common_names(reports(spark, sf), "rank", "name")


# ---------------------------------------------------------------- streaming

_WIN = """w AS (SELECT date_trunc('day', ts) AS ws, name, ok, value FROM rf {where}),
m AS (SELECT ws, name, CAST(sum(CAST(ok AS BIGINT)) AS BIGINT) AS num, sum(CASE WHEN ok THEN value ELSE 0 END) AS s,
      sum(CASE WHEN ok THEN value * value ELSE 0 END) AS ss FROM w GROUP BY ws, name)"""


def _stream_sql(where: str = "") -> str:
    return f"""
WITH {_R}, {_WIN.format(where=where)}
SELECT CAST(epoch(ws) AS BIGINT) AS window_start, name, {_STATS} FROM m
"""


def _stream_result(spark, sf, rank=None):
    from pairlake.streaming.collector import events_stream
    s = events_stream(spark, sf)
    e = F.col("event_id")
    v = (F.when(e % 101 == 0, F.lit(float("nan"))).when(e % 103 == 0, F.lit(float("inf")))
         .when(e % 107 == 0, F.lit(1e20)).when(e % 109 == 0, F.lit(float("-inf"))).otherwise(F.col("value")))
    s = s.select("ts", F.col("event_type").alias("name"), (F.col("user_id") % 4).cast("int").alias("rank"),
                 F.dayofmonth("ts").cast("int").alias("round"), v.alias("value"))
    s = s.filter(~((F.col("name") == "purchase") & ((F.col("round") % 4 == 1) | (F.col("rank") == 3))))
    out = R.run_update_to_parquet(R.stream_stats(s, rank="rank" if rank == 0 else None), "stream_stats",
                                  ["window_start", "name"])
    return out.select(F.unix_seconds("window_start").alias("window_start"), "name", "num",
                      F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@register("stream_stats", ids=("R1", "R6"), sql=_stream_sql())
def q_stream_stats(spark, sf):
    return _stream_result(spark, sf)


@register("stream_stats_rank0", ids=("R1", "R4"), sql=_stream_sql("WHERE rank = 0"))
def q_stream_stats_rank0(spark, sf):
    return _stream_result(spark, sf, rank=0)


@register("stream_cumulative", ids=("R2",), sql=f"""
WITH {_R}, m AS ({_mom('name')}) SELECT name, {_STATS} FROM m
""")
def q_stream_cumulative(spark, sf):
    from pairlake.streaming.collector import events_stream
    s = events_stream(spark, sf)
    e = F.col("event_id")
    v = (F.when(e % 101 == 0, F.lit(float("nan"))).when(e % 103 == 0, F.lit(float("inf")))
         .when(e % 107 == 0, F.lit(1e20)).when(e % 109 == 0, F.lit(float("-inf"))).otherwise(F.col("value")))
    s = s.select(F.col("event_type").alias("name"), (F.col("user_id") % 4).cast("int").alias("rank"),
                 F.dayofmonth("ts").cast("int").alias("round"), v.alias("value"))
    s = s.filter(~((F.col("name") == "purchase") & ((F.col("round") % 4 == 1) | (F.col("rank") == 3))))
    out = R.run_complete_to_parquet(R.stream_cumulative(s), "stream_cumulative")
    return _round_stats(out, "name")


@register("stream_keep_previous", ids=("R3", "R6", "W4"), sql=f"""
WITH {_R},
d AS (SELECT name, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS round_start, CAST(sum(CAST(ok AS BIGINT)) AS BIGINT) AS num,
      sum(CASE WHEN ok THEN value ELSE 0 END) AS s, sum(CASE WHEN ok THEN value * value ELSE 0 END) AS ss
      FROM rf WHERE round NOT IN (11, 12, 20) AND NOT (name = 'click' AND round > 24) GROUP BY ALL),
dd AS (SELECT * FROM d WHERE num <> 0),
sp AS (SELECT name, unnest(generate_series(f, (SELECT max(round_start) FROM d), 86400)) AS round_start
       FROM (SELECT name, min(round_start) AS f FROM dd GROUP BY name)),
j AS (SELECT sp.name, sp.round_start, dd.num, dd.s, dd.ss FROM sp LEFT JOIN dd USING (name, round_start)),
k AS (SELECT name, round_start, last(num IGNORE NULLS) OVER w AS num, last(s IGNORE NULLS) OVER w AS s,
      last(ss IGNORE NULLS) OVER w AS ss FROM j
      WINDOW w AS (PARTITION BY name ORDER BY round_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT name, round_start, {_STATS.replace('s / num END, 6)', 's / num END, 9)')} FROM k
""")
def q_stream_keep_previous(spark, sf):
    """R3 into R6: days 11, 12 and 20 are silent for all names, the last ones for one."""
    from pairlake.streaming.collector import events_stream
    from pairlake.streaming.keep_previous import run_keep_previous
    s = events_stream(spark, sf)
    e = F.col("event_id")
    v = (F.when(e % 101 == 0, F.lit(float("nan"))).when(e % 103 == 0, F.lit(float("inf")))
         .when(e % 107 == 0, F.lit(1e20)).when(e % 109 == 0, F.lit(float("-inf"))).otherwise(F.col("value")))
    s = s.select("ts", F.col("event_type").alias("name"), (F.col("user_id") % 4).cast("int").alias("rank"),
                 F.dayofmonth("ts").cast("int").alias("round"), v.alias("value"))
    s = s.filter(~((F.col("name") == "purchase") & ((F.col("round") % 4 == 1) | (F.col("rank") == 3))))
    s = s.filter(~F.col("round").isin(11, 12, 20) & ~((F.col("name") == "click") & (F.col("round") > 24)))
    # values have 2 decimals and many rounds hold 2^k reports, so a mean is
    # often an exact tie at 6 decimals; the state sums in numpy order and the
    # twin in SQL order, so compare means at 9 decimals (no ties there)
    st = ST.moments_to_stats(run_keep_previous(s))
    return st.select("name", "round_start", "num", F.round("mean", 9).alias("mean"), F.round("std", 6).alias("std"))
