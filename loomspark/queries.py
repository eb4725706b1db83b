"""Driver queries of the library's own operators, each beside the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.arrays import doubles
from .functions.timeutil import HOUR, micros
from .plans import features
from .sources import versions
from .operators import graph, joins, lineage, metrics, pooling, quantiles, sampling, signal, validate, vectors, windows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# Windows -----------------------------------------------------------------------------------------------------------

_NUMBERED = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events"
_TUMBLING = f"SELECT user_id, (idx // 3)::BIGINT AS window_id, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM ({_NUMBERED}) GROUP BY ALL"


@query("tumbling_count_sum", f"SELECT * FROM ({_TUMBLING}) WHERE n = 3")
def _(s, d):
    return windows.tumbling_count(table(s, d, "events"), 3, ["user_id"], "ts", "event_id", [r6(F.sum("value"), "total")])


@query("tumbling_count_flush", _TUMBLING)
def _(s, d):
    return windows.tumbling_count(table(s, d, "events"), 3, ["user_id"], "ts", "event_id", [r6(F.sum("value"), "total")], include_partial=True)


@query("tumbling_time", "SELECT event_type, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def _(s, d):
    w = windows.tumbling_time(table(s, d, "events"), "1 hour", ["event_type"], "ts", [F.count(F.lit(1)).alias("n"), r6(F.sum("value"), "total")])
    return w.select("event_type", micros("window_start").alias("start_us"), "n", "total")


@query(
    "tumbling_anchored",
    """
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
walk AS (
  SELECT user_id, rn, us, value, us AS anchor, 0 AS window_id, false AS closes FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn, e.us, e.value, CASE WHEN w.closes THEN w.us ELSE w.anchor END, w.window_id + w.closes::INT,
    e.us - (CASE WHEN w.closes THEN w.us ELSE w.anchor END) >= 21600000000
  FROM walk w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1
)
SELECT user_id, window_id::BIGINT AS window_id, count(*)::BIGINT AS n, min(us) AS first_us, max(us) AS last_us, round(sum(value), 6) AS sum
FROM walk GROUP BY user_id, window_id HAVING bool_or(closes)
""",
)
def _(s, d):
    w = windows.tumbling_anchored(table(s, d, "events"), 6 * HOUR, "user_id", "ts", "event_id", "value")
    return w.withColumn("sum", F.round("sum", 6))


@query(
    "sliding_count_mean",
    f"SELECT event_id, agg FROM (SELECT event_id, idx, round(avg(value) OVER (PARTITION BY user_id ORDER BY idx ROWS 3 PRECEDING), 6) AS agg FROM ({_NUMBERED})) WHERE least(idx + 1, 4) >= 2",
)
def _(s, d):
    return windows.sliding_count(table(s, d, "events"), 4, ["user_id"], "ts", "event_id", F.avg("value"), slide=2).select("event_id", r6(F.col("agg"), "agg"))


@query(
    "sliding_every_slide",
    f"SELECT event_id, agg FROM (SELECT event_id, idx, round(max(value) OVER (PARTITION BY user_id ORDER BY idx ROWS 3 PRECEDING), 6) AS agg FROM ({_NUMBERED})) WHERE (idx + 1) % 2 = 0",
)
def _(s, d):
    return windows.sliding_count(table(s, d, "events"), 4, ["user_id"], "ts", "event_id", F.max("value"), slide=2, mode="every_slide", block=20).select("event_id", r6(F.col("agg"), "agg"))


@query(
    "sliding_time_sum",
    """SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 6) AS total FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)""",
)
def _(s, d):
    out = windows.sliding_time(table(s, d, "events"), HOUR, ["event_type"], "ts", {"n": F.count(F.lit(1)), "total": F.sum("value")})
    return out.select("event_id", "n", r6(F.col("total"), "total"))


@query(
    "sliding_throttled",
    """
WITH RECURSIVE f AS (
  SELECT event_id, user_id, epoch_us(ts) AS us, sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW) AS total,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
walk AS (
  SELECT *, true AS emit, us AS last FROM f WHERE rn = 1
  UNION ALL SELECT f.*, f.us - w.last >= 21600000000, CASE WHEN f.us - w.last >= 21600000000 THEN f.us ELSE w.last END
  FROM walk w JOIN f ON f.user_id = w.user_id AND f.rn = w.rn + 1)
SELECT event_id, user_id, round(total, 6) AS total FROM walk WHERE emit""",
)
def _(s, d):
    f = windows.sliding_time(table(s, d, "events"), 12 * HOUR, ["user_id"], "ts", {"total": F.sum("value")})
    return windows.throttled(f.select("event_id", "user_id", "us", "total"), 6 * HOUR, "user_id", "us", "event_id").select("event_id", "user_id", r6(F.col("total"), "total"))


@query(
    "sliding_hop",
    """SELECT event_type, epoch_us(b) AS start_us, count(*)::BIGINT AS n, round(avg(value), 6) AS mean FROM (
SELECT *, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS b FROM events) GROUP BY ALL""",
)
def _(s, d):
    w = windows.sliding_hop(table(s, d, "events"), "2 hours", "1 hour", ["event_type"], "ts", [F.count(F.lit(1)).alias("n"), r6(F.avg("value"), "mean")])
    return w.select("event_type", micros("window_start").alias("start_us"), "n", "mean")


@query(
    "session_agg",
    """SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM (
SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM (
SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 8 HOUR, true)::INT AS starts FROM events)) GROUP BY user_id, sid""",
)
def _(s, d):
    w = windows.sessions(table(s, d, "events"), "8 hours", ["user_id"], "ts", [r6(F.sum("value"), "total")])
    return w.select("user_id", micros("session_start").alias("start_us"), micros("session_end").alias("end_us"), "n", "total")


@query("window_p90", "SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY ALL")
def _(s, d):
    days = table(s, d, "events").select("value", micros(F.window("ts", "1 day")["start"]).alias("start_us"))
    return quantiles.exact_quantile(days, ["start_us"], "value", 0.9).select("start_us", r6(F.col("quantile"), "p90"))


@query("array_window_mean", "SELECT label, (generate_subscripts(embedding, 1) - 1)::INT AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings".join(["SELECT label, pos, round(avg(x), 6) AS value FROM (", ") GROUP BY ALL"]))
def _(s, d):
    return windows.array_window(table(s, d, "embeddings"), ["label"], "embedding").withColumn("value", F.round("value", 6))


@query("load_shed", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY time_bucket(INTERVAL 1 HOUR, ts) ORDER BY ts, event_id) AS r FROM events) WHERE r <= 5")
def _(s, d):
    return windows.shed(table(s, d, "events"), 5, "ts", "event_id")[0].select("event_id")


@query(
    "load_shed_counts",
    "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, count(*)::BIGINT AS n, least(count(*), 5)::BIGINT AS n_kept, greatest(count(*) - 5, 0)::BIGINT AS n_dropped FROM events GROUP BY 1",
)
def _(s, d):
    return windows.shed(table(s, d, "events"), 5, "ts", "event_id")[1].select(micros("window_start").alias("start_us"), "n", "n_kept", "n_dropped")


# Temporal joins ----------------------------------------------------------------------------------------------------


def _events(s, d, kind: str) -> DataFrame:
    return table(s, d, "events").filter(F.col("event_type") == kind).select("event_id", "ts", "user_id", "value")


def _asof(kind: str, hours: int | None) -> str:
    limit = f"WHERE epoch_us(l.ts) - epoch_us(r.ts) <= {hours * HOUR}" if hours else ""
    return f"""SELECT l.event_id, round(r.value, 6) AS right_value, epoch_us(r.ts) AS right_value_us
FROM (SELECT * FROM events WHERE event_type = 'purchase') l ASOF JOIN (SELECT * FROM events WHERE event_type = '{kind}') r ON l.user_id = r.user_id AND l.ts >= r.ts {limit}"""


@query("asof_backward", _asof("view", 24))
def _(s, d):
    j = joins.asof_backward(_events(s, d, "purchase"), _events(s, d, "view"), ["user_id"], "ts", "event_id", "value", 24 * HOUR)
    return j.select("event_id", r6(F.col("right_value"), "right_value"), "right_value_us")


@query("asof_unbounded", _asof("view", None))
def _(s, d):
    j = joins.asof_backward(_events(s, d, "purchase"), _events(s, d, "view"), ["user_id"], "ts", "event_id", "value")
    return j.select("event_id", r6(F.col("right_value"), "right_value"), "right_value_us")


@query(
    "nearest_inner",
    f"""SELECT event_id, round(value, 6) AS right_value FROM (SELECT l.event_id, r.value,
  row_number() OVER (PARTITION BY l.event_id ORDER BY abs(epoch_us(l.ts) - epoch_us(r.ts)), r.ts, r.event_id) AS k
FROM events l JOIN events r ON l.user_id = r.user_id AND l.event_type = 'purchase' AND r.event_type = 'click' AND abs(epoch_us(l.ts) - epoch_us(r.ts)) <= {12 * HOUR}) WHERE k = 1""",
)
def _(s, d):
    j = joins.nearest_within(_events(s, d, "purchase"), _events(s, d, "click"), ["user_id"], "ts", "event_id", "value", 12 * HOUR)
    return j.select("event_id", r6(F.col("right_value"), "right_value"))


def _left(fallback: str) -> str:
    other = {"none": "NULL", "zero": "0.0", "nearest": "near", "linear": "(1 - (us - pus) / (qus - pus)) * pv + (us - pus) / (qus - pus) * qv"}[fallback]
    return f"""WITH l AS (SELECT event_id, user_id, ts, epoch_us(ts)::DOUBLE AS us FROM events WHERE event_type = 'purchase'),
r AS (SELECT user_id, ts, value, epoch_us(ts)::DOUBLE AS us FROM events WHERE event_type = 'view'),
p AS (SELECT l.*, r.value AS pv, r.us AS pus FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts),
q AS (SELECT p.*, r.value AS qv, r.us AS qus FROM p ASOF LEFT JOIN r ON p.user_id = r.user_id AND p.ts < r.ts),
n AS (SELECT *, CASE WHEN qus IS NULL OR us - pus <= qus - us THEN pv ELSE qv END AS near, least(us - pus, qus - us) AS gap FROM q)
SELECT event_id, round(CASE WHEN gap <= {HOUR} THEN near ELSE {other} END, 6) AS right_value FROM n"""


for _how in ("none", "nearest", "linear", "zero"):

    @query(f"left_{_how}", _left(_how))
    def _(s, d, how=_how):
        j = joins.left_nearest(_events(s, d, "purchase"), _events(s, d, "view"), ["user_id"], "ts", "event_id", "value", HOUR, how)
        return j.select("event_id", r6(F.col("right_value"), "right_value"))


@query(
    "outer_last_known",
    """SELECT event_id, """
    + ", ".join(f"round(last_value(CASE WHEN event_type = '{k}' THEN value END IGNORE NULLS) OVER w, 6) AS {k}_value" for k in ("view", "click", "purchase"))
    + " FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
)
def _(s, d):
    e = table(s, d, "events").select("event_id", "ts", "user_id", "value", F.col("event_type").alias("stream"))
    j = joins.last_known(e, ["view", "click", "purchase"], ["user_id"], "ts", "event_id", "value")
    return j.select("event_id", *(r6(F.col(k), f"{k}_value") for k in ("view", "click", "purchase")))


@query(
    "nway_join",
    """SELECT l.event_id, round(v.value, 6) AS view_value, round(c.value, 6) AS click_value FROM (SELECT * FROM events WHERE event_type = 'purchase') l
ASOF JOIN (SELECT * FROM events WHERE event_type = 'view') v ON l.user_id = v.user_id AND l.ts >= v.ts
ASOF JOIN (SELECT * FROM events WHERE event_type = 'click') c ON l.user_id = c.user_id AND l.ts >= c.ts""",
)
def _(s, d):
    j = joins.asof_many(_events(s, d, "purchase"), {"view_value": _events(s, d, "view"), "click_value": _events(s, d, "click")}, ["user_id"], "ts", "event_id", "value")
    return j.select("event_id", r6(F.col("view_value"), "view_value"), r6(F.col("click_value"), "click_value"))


@query(
    "retention",
    f"SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS r FROM (SELECT *, max(ts) OVER (PARTITION BY event_type) AS newest FROM events) WHERE epoch_us(ts) >= epoch_us(newest) - {2 * 48 * HOUR}) WHERE r <= 100",
)
def _(s, d):
    return joins.within_retention(table(s, d, "events"), "event_type", "ts", 48 * HOUR, 100).select("event_id")


@query(
    "point_in_time",
    """SELECT l.o_orderkey, round(r.o_totalprice, 6) AS feature FROM (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') l
ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_totalprice) AS o_totalprice FROM orders WHERE o_orderpriority != '1-URGENT' GROUP BY ALL) r
ON l.o_custkey = r.o_custkey AND l.o_orderdate >= r.o_orderdate""",
)
def _(s, d):
    o = table(s, d, "orders")
    history = o.filter("o_orderpriority != '1-URGENT'").groupBy("o_custkey", "o_orderdate").agg(F.max("o_totalprice").alias("o_totalprice")).withColumn("o_orderkey", F.lit(0).cast("long"))
    j = joins.point_in_time(o.filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey", "o_orderdate"), history, ["o_custkey"], "o_orderdate", "o_orderkey", "o_totalprice")
    return j.select("o_orderkey", r6(F.col("feature"), "feature"))


# Validation --------------------------------------------------------------------------------------------------------


@query(
    "validate_rules",
    """SELECT len(errors) = 0 AS ok, array_to_string(list_sort(errors), '; ') AS errors FROM (SELECT list_filter([
  CASE WHEN bool_or(l_quantity > 40) THEN 'l_quantity: value outside [1, 40]' END,
  CASE WHEN bool_or(isnan(l_tax)) THEN 'l_tax: contains NaN' END, 'Missing required field: l_missing',
  CASE WHEN bool_or(NOT l_discount < 0.1) THEN 'l_discount: discount too high' END,
  'l_linenumber: Expected dtype bigint, got int'], lambda x: x IS NOT NULL) AS errors FROM lineitem)""",
)
def _(s, d):
    v = validate
    rules = [v.in_range("l_quantity", 1, 40), v.not_nan("l_tax"), v.not_inf("l_extendedprice"), v.required("l_missing"), v.custom("l_discount", "l_discount < 0.1", "discount too high"), v.dtype("l_linenumber", "bigint")]
    out = v.validate(table(s, d, "lineitem"), rules)
    return out.select("ok", F.array_join("errors", "; ").alias("errors"))


@query(
    "quarantine",
    """SELECT event_id, concat_ws('; ', CASE WHEN value > 400 THEN 'value: value outside [1, 400]' WHEN value < 1 THEN 'value: value outside [1, 400]' END, CASE WHEN event_type = 'error' THEN 'event_type: is an error' END) AS errors
FROM events WHERE value > 400 OR value < 1 OR event_type = 'error'""",
)
def _(s, d):
    rules = [validate.in_range("value", 1, 400), validate.custom("event_type", "event_type != 'error'", "is an error")]
    return validate.split(table(s, d, "events"), rules)[1].select("event_id", F.array_join("errors", "; ").alias("errors"))


_FIELDS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("profile", " UNION ALL ".join(f"SELECT '{f}' AS field, count({f})::BIGINT AS n, round(avg({f}), 6) AS mean, round(stddev_samp({f}), 6) AS std, min({f}) AS min, max({f}) AS max FROM lineitem" for f in _FIELDS))
def _(s, d):
    return validate.profile(table(s, d, "lineitem"), _FIELDS).withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query(
    "drift_by_day",
    """WITH b AS (SELECT ts::DATE AS day, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS low, max(value) AS high FROM events GROUP BY 1),
s AS (SELECT *, count(*) OVER w AS seen, avg(mean) OVER w AS mu, avg(std) OVER w AS sigma, min(low) OVER w AS pmin, max(high) OVER w AS pmax FROM b WINDOW w AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT strftime(day, '%Y-%m-%d') AS day, round(mean, 6) AS mean, round(mu, 6) AS mu, round(sigma, 6) AS sigma,
  coalesce(seen >= 10 AND abs(mean - mu) > 0.3 * sigma, false) AS mean_shift,
  coalesce(seen >= 10 AND (low < pmin - 0.5 * (pmax - pmin) OR high > pmax + 0.5 * (pmax - pmin)), false) AS range_shift FROM s""",
)
def _(s, d):
    e = table(s, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return validate.drift(e, "day", "value", sigmas=0.3).select("day", r6(F.col("mean"), "mean"), r6(F.col("mu"), "mu"), r6(F.col("sigma"), "sigma"), "mean_shift", "range_shift")


@query(
    "suggest_rules",
    """SELECT unnest(['embedding', 'embedding', 'embedding', 'embedding']) AS field, unnest(['dtype', 'shape', 'range', 'not_nan']) AS rule,
  unnest(['array<float>', '*,' || max(len(embedding)), printf('%.4f', min(list_min(embedding))::DOUBLE) || ',' || printf('%.4f', max(list_max(embedding))::DOUBLE), 'yes']) AS value FROM embeddings
UNION ALL SELECT unnest(['label', 'label', 'label']), unnest(['dtype', 'range', 'not_nan']), unnest(['int', printf('%.4f', min(label)::DOUBLE) || ',' || printf('%.4f', max(label)::DOUBLE), 'yes']) FROM embeddings""",
)
def _(s, d):
    return validate.suggest(table(s, d, "embeddings"), ["embedding", "label"])


# Sampling ----------------------------------------------------------------------------------------------------------


def _u(seed: str, key: str = "doc_id") -> str:
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 12))::BIGINT"


@query("sample_uniform", f"SELECT doc_id FROM labels ORDER BY {_u('7')}, doc_id LIMIT 50")
def _(s, d):
    return sampling.sample_uniform(table(s, d, "labels"), 50, "doc_id", 7).select("doc_id")


_RANKED = f"SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_u('3', 'c_custkey')}, c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n, count(*) OVER () AS total FROM customer"


@query("sample_stratified", f"SELECT c_custkey, c_mktsegment FROM ({_RANKED}) WHERE r <= greatest(1, floor(100 * n / total)) ORDER BY {_u('3b', 'c_custkey')}, c_custkey LIMIT 100")
def _(s, d):
    return sampling.stratified(table(s, d, "customer"), 100, "c_mktsegment", "c_custkey", 3).select("c_custkey", "c_mktsegment")


@query(
    "sample_balanced",
    f"SELECT c_custkey, c_mktsegment FROM ({_RANKED}) JOIN (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) AS i, count(*) OVER () AS k FROM (SELECT DISTINCT c_mktsegment FROM customer)) USING (c_mktsegment) WHERE r <= 98 // k + (i <= 98 % k)::INT",
)
def _(s, d):
    return sampling.balanced(table(s, d, "customer"), 98, "c_mktsegment", "c_custkey", 3).select("c_custkey", "c_mktsegment")


@query("sample_weighted", f"SELECT p_partkey FROM part ORDER BY -ln(greatest({_u('5', 'p_partkey')}, 1) / 281474976710656.0) / p_size, p_partkey LIMIT 80")
def _(s, d):
    return sampling.weighted(table(s, d, "part"), 80, F.col("p_size"), "p_partkey", 5).select("p_partkey")


@query(
    "sample_focal",
    f"SELECT doc_id FROM labels JOIN (SELECT toxic, count(*) AS n FROM labels GROUP BY 1) USING (toxic) ORDER BY -ln(greatest({_u('9')}, 1) / 281474976710656.0) / pow(1.0 / n, 2), doc_id LIMIT 60",
)
def _(s, d):
    return sampling.focal(table(s, d, "labels"), 60, "doc_id", "toxic", None, seed=9).select("doc_id")


@query(
    "sample_with_replacement",
    f"""WITH w AS (SELECT p_partkey, p_size, sum(p_size) OVER (ORDER BY {_u('2p', 'p_partkey')} // 1099511627776, p_partkey) AS upto, sum(p_size) OVER () AS total FROM part WHERE p_size > 0),
d AS (SELECT i AS draw, greatest({_u('2r', 'i')}, 1) / 281474976710656.0 AS u FROM unnest(generate_series(0, 199)) AS g(i))
SELECT draw::BIGINT AS draw, p_partkey FROM d JOIN w ON u * total >= upto - p_size AND u * total < upto""",
)
def _(s, d):
    return sampling.with_replacement(table(s, d, "part"), 200, "p_partkey", 2, F.col("p_size")).select("draw", "p_partkey")


@query("batches", f"SELECT doc_id, ((row_number() OVER (ORDER BY {_u('4')}, doc_id) - 1) // 32)::BIGINT AS batch FROM labels")
def _(s, d):
    return sampling.batches(table(s, d, "labels"), 32, "doc_id", 4).select("doc_id", "batch")


for _how, _raw in (("inverse", "1.0 / n"), ("inverse_sqrt", "1.0 / sqrt(n)"), ("effective", "(1 - 0.999) / (1 - pow(0.999, n))")):

    @query(f"class_weights_{_how}", f"SELECT l_returnflag, n, round(w * count(*) OVER () / sum(w) OVER (), 6) AS weight FROM (SELECT l_returnflag, n, {_raw} AS w FROM (SELECT l_returnflag, count(*)::BIGINT AS n FROM lineitem GROUP BY 1))")
    def _(s, d, how=_how):
        return sampling.class_weights(table(s, d, "lineitem"), "l_returnflag", how).withColumn("weight", F.round("weight", 6))


@query(
    "difficulty_ema",
    """SELECT user_id, round(list_reduce(list(value ORDER BY ts, event_id), lambda a, x: 0.1 * x + 0.9 * a), 6) AS difficulty,
round(arg_max(value, (ts, event_id)), 6) AS last_loss FROM events GROUP BY 1""",
)
def _(s, d):
    return sampling.difficulty(table(s, d, "events"), "user_id", ["ts", "event_id"], "value").select("user_id", r6(F.col("difficulty"), "difficulty"), r6(F.col("last_loss"), "last_loss"))


@query(
    "sampling_stats",
    f"""WITH picked AS (SELECT c_mktsegment FROM ({_RANKED}) WHERE r <= greatest(1, floor(100 * n / total)) ORDER BY {_u('3b', 'c_custkey')}, c_custkey LIMIT 100)
SELECT c_mktsegment, original, sampled, round((sampled / sum(sampled) OVER ()) / (original / sum(original) OVER ()), 6) AS ratio FROM
(SELECT c_mktsegment, count(*)::BIGINT AS original FROM customer GROUP BY 1) JOIN (SELECT c_mktsegment, count(*)::BIGINT AS sampled FROM picked GROUP BY 1) USING (c_mktsegment)""",
)
def _(s, d):
    c = table(s, d, "customer")
    return sampling.sampling_stats(c, sampling.stratified(c, 100, "c_mktsegment", "c_custkey", 3), "c_mktsegment").withColumn("ratio", F.round("ratio", 6))


# Vectors, graphs, pooling ------------------------------------------------------------------------------------------

_SCORE = {
    "cosine": "list_dot_product(q.e, k.e) / (greatest(sqrt(list_dot_product(q.e, q.e)), 1e-12) * greatest(sqrt(list_dot_product(k.e, k.e)), 1e-12))",
    "dot": "list_dot_product(q.e, k.e)",
    "l2": "-(list_dot_product(q.e, q.e) - 2 * list_dot_product(q.e, k.e) + list_dot_product(k.e, k.e))",
}


def _vectors(s, d) -> DataFrame:
    return table(s, d, "embeddings")


for _metric, _expr in _SCORE.items():

    @query(
        f"knn_{_metric}",
        f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT q.vec_id AS query_id, k.vec_id AS key_id, {_expr} AS score FROM v q JOIN v k ON q.vec_id % 100 = 0)
SELECT query_id, key_id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, key_id) AS rank FROM p) WHERE rank <= 5""",
    )
    def _(s, d, metric=_metric):
        v = _vectors(s, d).withColumnRenamed("embedding", "vector")
        out = vectors.knn(v.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "key_id"), 5, metric)
        return out.withColumn("score", F.round("score", 6))


@query(
    "knn_graph",
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT q.label, q.vec_id AS src, k.vec_id AS dst, round(greatest(list_dot_product(q.e, q.e) - 2 * list_dot_product(q.e, k.e) + list_dot_product(k.e, k.e), 0), 9) AS distance FROM v q JOIN v k USING (label))
SELECT label, src, dst, round(distance, 6) AS distance, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label, src ORDER BY distance, dst) AS rank FROM p) WHERE rank <= 3""",
)
def _(s, d):
    return vectors.knn_graph(_vectors(s, d), 3, "label", "vec_id", "embedding").withColumn("distance", F.round("distance", 6))


_RETAIN = "SELECT event_type, user_id, us FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY us DESC, event_id DESC, user_id DESC) AS r FROM (SELECT event_type, user_id, max(epoch_us(ts)) AS us, arg_max(event_id, ts) AS event_id FROM events {where} GROUP BY ALL)) WHERE r <= 20"


@query("retention_lru", _RETAIN.format(where=""))
def _(s, d):
    e = table(s, d, "events").withColumn("us", micros("ts"))
    return vectors.retain(e, 20, "event_type", "user_id", ["us", "event_id"]).select("event_type", "user_id", "us")


@query("retention_fifo", _RETAIN.format(where="WHERE value > 100"))
def _(s, d):
    e = table(s, d, "events").filter("value > 100").withColumn("us", micros("ts"))
    return vectors.retain(e, 20, "event_type", "user_id", ["us", "event_id"]).select("event_type", "user_id", "us")


@query("retention_lfu")
def _(s, d):
    e = table(s, d, "events").select("event_type", "user_id", "event_id", F.when(F.col("value") > 250, "read").otherwise("write").alias("kind"))
    return vectors.retain_lfu(e, 20, "event_type", "user_id", "event_id", "kind")


@query("usage_counts", "SELECT user_id, count(*)::BIGINT AS uses FROM events GROUP BY 1")
def _(s, d):
    return vectors.usage(table(s, d, "events"), "user_id")


def _part_graph(s, d):
    nodes = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"))
    edges = table(s, d, "lineitem").select(F.col("l_suppkey").alias("dst"), F.col("l_partkey").alias("src"), F.col("l_quantity").alias("weight"), (F.col("l_discount") * 10 - F.col("l_tax") * 10).alias("score"))
    return nodes, edges


_GRAPH = """n AS (SELECT p_partkey AS id, p_retailprice AS price, p_size::DOUBLE AS size FROM part),
e AS (SELECT l_suppkey AS dst, l_partkey AS src, l_quantity AS weight, l_discount * 10 - l_tax * 10 AS score FROM lineitem)"""

for _how, _price, _size in (("mean", "avg(n.price)", "avg(n.size)"), ("sum", "sum(n.price)", "sum(n.size)"), ("max", "max(n.price)", "max(n.size)")):

    @query(
        f"neighbor_{_how}",
        f"""WITH {_GRAPH}, a AS (SELECT dst, {_price} AS price, {_size} AS size FROM e JOIN n ON e.src = n.id GROUP BY dst)
SELECT n.id, round(coalesce(a.price, 0), 4) AS price, round(coalesce(a.size, 0), 4) AS size FROM n LEFT JOIN a ON n.id = a.dst""",
    )
    def _(s, d, how=_how):
        nodes, edges = _part_graph(s, d)
        return graph.neighbor_aggregate(nodes, edges, ["price", "size"], how).select("id", F.round("price", 4).alias("price"), F.round("size", 4).alias("size"))


@query(
    "two_hop",
    f"""WITH {_GRAPH}, a AS (SELECT dst, sum(n.size * weight) / greatest(count(*), 1) AS size FROM e JOIN n ON e.src = n.id GROUP BY dst),
h AS (SELECT n.id, coalesce(a.size, 0) AS size FROM n LEFT JOIN a ON n.id = a.dst), b AS (SELECT dst, sum(h.size * weight) / greatest(count(*), 1) AS size FROM e JOIN h ON e.src = h.id GROUP BY dst)
SELECT n.id, round(coalesce(b.size, 0), 4) AS size FROM n LEFT JOIN b ON n.id = b.dst""",
)
def _(s, d):
    nodes, edges = _part_graph(s, d)
    return graph.neighbor_aggregate(nodes, edges, ["size"], "mean", hops=2, weight="weight").select("id", F.round("size", 4).alias("size"))


@query(
    "edge_softmax",
    f"""WITH {_GRAPH}, s AS (SELECT dst, src, CASE WHEN score > 0 THEN score ELSE 0.2 * score END AS s FROM e),
w AS (SELECT dst, src, exp(s - max(s) OVER (PARTITION BY dst)) AS w FROM s),
a AS (SELECT dst, sum(w * n.price) / sum(w) AS price FROM w JOIN n ON w.src = n.id GROUP BY dst)
SELECT n.id, round(coalesce(a.price, 0), 4) AS price FROM n LEFT JOIN a ON n.id = a.dst""",
)
def _(s, d):
    nodes, edges = _part_graph(s, d)
    return graph.edge_softmax(nodes, edges, ["price"]).withColumn("price", F.round("price", 4))


@query("graph_pool", "SELECT n_nationkey AS graph, round(coalesce(avg(s_acctbal), 0), 4) AS bal FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def _(s, d):
    nodes = table(s, d, "supplier").select(F.col("s_nationkey").alias("graph"), F.col("s_acctbal").alias("bal"))
    graphs = table(s, d, "nation").select(F.col("n_nationkey").alias("graph"))
    return graph.graph_pool(nodes, graphs, "graph", ["bal"]).withColumn("bal", F.round("bal", 4))


_POS = "SELECT vec_id, label, (generate_subscripts(embedding, 1) - 1)::INT AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings"

for _how, _agg in (("mean", "coalesce(sum(x) FILTER (WHERE vec_id % 3 != 0), 0) / greatest(count(*) FILTER (WHERE vec_id % 3 != 0), 1e-9)"), ("sum", "coalesce(sum(x) FILTER (WHERE vec_id % 3 != 0), 0)"), ("max", "coalesce(max(x) FILTER (WHERE vec_id % 3 != 0), -1e9)")):

    @query(f"group_pool_{_how}", f"SELECT label, pos, round({_agg}, 6) AS value FROM ({_POS}) GROUP BY ALL")
    def _(s, d, how=_how):
        return pooling.masked_pool(_vectors(s, d), "label", "embedding", F.col("vec_id") % 3 != 0, how).withColumn("value", F.round("value", 6))


@query(
    "attention_pool",
    f"""SELECT label, pos, round(sum(w * x) / sum(w), 6) AS value FROM (SELECT *, exp(s - max(s) OVER (PARTITION BY label)) AS w FROM (SELECT *, (vec_id % 7)::DOUBLE AS s FROM ({_POS}))) GROUP BY ALL""",
)
def _(s, d):
    return pooling.attention_pool(_vectors(s, d), "label", "embedding", F.col("vec_id") % 7).withColumn("value", F.round("value", 6))


@query(
    "pair_summary",
    """WITH l AS (SELECT *, row_number() OVER () AS i FROM lineitem)
SELECT a.l_orderkey, a.l_linenumber, round(avg(a.l_quantity - b.l_quantity), 6) AS mean_diff, round(avg(a.l_quantity * b.l_quantity), 6) AS mean_product
FROM l a JOIN l b USING (l_orderkey) GROUP BY a.i, a.l_orderkey, a.l_linenumber""",
)
def _(s, d):
    p = pooling.pair_summary(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", "l_quantity")
    return p.select("l_orderkey", "l_linenumber", r6(F.col("mean_diff"), "mean_diff"), r6(F.col("mean_product"), "mean_product"))


@query("padding_mask", "SELECT doc_id, list_sum(list_transform(string_split(text, ' '), lambda t: (t != 'the')::INT))::BIGINT AS kept FROM documents")
def _(s, d):
    words = table(s, d, "documents").select("doc_id", F.transform(F.split("text", " "), lambda t: F.when(t == "the", 0).otherwise(1)).alias("tokens"))
    return words.select("doc_id", F.size(F.filter(pooling.padding_mask("tokens", 0), lambda k: k)).cast("long").alias("kept"))


# Signals and metrics -----------------------------------------------------------------------------------------------


@query(
    "causal_filter",
    """SELECT event_type, day, round(total + 0.5 * coalesce(lag(total, 2) OVER w, 0) + 0.25 * coalesce(lag(total, 4) OVER w, 0), 6) AS filtered FROM (
SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, sum(value) AS total FROM events GROUP BY ALL) WINDOW w AS (PARTITION BY event_type ORDER BY day)""",
)
def _(s, d):
    days = table(s, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sum("value").alias("total"))
    return signal.causal_filter(days, [1.0, 0.5, 0.25], "total", ["event_type"], ["day"], 2, bucket=F.substring("day", 1, 7), block=3).select("event_type", "day", r6(F.col("filtered"), "filtered"))


_LAYERS = [([1.0, 0.5], 1), ([1.0, 0.5], 2), ([1.0, 0.5], 4)]


def _stacked() -> str:
    sql = "SELECT user_id, event_id, ts, value AS x FROM events"
    for weights, dilation in _LAYERS:
        sql = f"SELECT user_id, event_id, ts, x * {weights[0]} + {weights[1]} * coalesce(lag(x, {dilation}) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS x FROM ({sql})"
    return f"SELECT event_id, round(x, 5) AS filtered FROM ({sql})"


@query("causal_stack", _stacked())
def _(s, d):
    out = signal.causal_stack(table(s, d, "events"), _LAYERS, "value", ["user_id"], ["ts", "event_id"], block=10)
    return out.select("event_id", F.round("filtered", 5).alias("filtered"))


_CHAIN = "SELECT o_orderkey AS node, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent FROM orders"


def _chain(s, d) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(s, d, "orders").select(F.col("o_orderkey").alias("node"), F.lag("o_orderkey").over(w).alias("parent"))


@query(
    "version_lineage",
    f"""WITH RECURSIVE c AS ({_CHAIN}), walk AS (SELECT node, node AS root, 0 AS depth FROM c WHERE parent IS NULL
UNION ALL SELECT c.node, root, depth + 1 FROM walk JOIN c ON c.parent = walk.node) SELECT node, root, depth::BIGINT AS depth FROM walk WHERE depth > 0""",
)
def _(s, d):
    return lineage.roots(_chain(s, d), "node", "parent")


_PARTS = "SELECT p_partkey AS node, unnest([p_partkey // 2, p_partkey // 3]) AS parent FROM part"
_REACHED = f"""WITH RECURSIVE e AS (SELECT DISTINCT node, parent FROM ({_PARTS}) WHERE parent > 0),
walk AS (SELECT node, parent AS ancestor, 1 AS depth FROM e UNION SELECT walk.node, e.parent, depth + 1 FROM walk JOIN e ON e.node = walk.ancestor),
reached AS (SELECT node, ancestor, min(depth)::BIGINT AS depth FROM walk GROUP BY ALL)"""


def _parts(s, d) -> DataFrame:
    key = F.col("p_partkey")
    return table(s, d, "part").select(key.alias("node"), F.explode(F.array(F.floor(key / 2), F.floor(key / 3))).alias("parent")).filter("parent > 0")


@query("feature_closure", f"{_REACHED} SELECT * FROM reached")
def _(s, d):
    return lineage.closure(_parts(s, d), "node", "parent")


@query("feature_lineage", f"{_REACHED} SELECT node, count(*)::BIGINT AS n_dependencies, (count(*) FILTER (depth = 1))::BIGINT AS n_direct, max(depth)::BIGINT AS depth FROM reached GROUP BY node")
def _(s, d):
    reached = lineage.closure(_parts(s, d), "node", "parent")
    return reached.groupBy("node").agg(F.count(F.lit(1)).alias("n_dependencies"), F.count(F.when(F.col("depth") == 1, 1)).alias("n_direct"), F.max("depth").alias("depth"))


@query("positional_time", "SELECT event_id, round(sin(h), 6) AS sin_0, round(cos(h), 6) AS cos_0, round(sin(h * 0.01), 6) AS sin_1, round(cos(h * 0.01), 6) AS cos_1 FROM (SELECT event_id, hour(ts)::DOUBLE AS h FROM events)")
def _(s, d):
    return table(s, d, "events").select("event_id", *(r6(c, n) for n, c in signal.positional(F.hour("ts").cast("double"), 4).items()))


@query(
    "nucleus",
    """WITH x AS (SELECT p_brand, p_partkey, p_retailprice / 200 AS l FROM part), k AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY l DESC) AS r FROM x) WHERE r <= 10),
e AS (SELECT *, exp(l - max(l) OVER (PARTITION BY p_brand)) AS e FROM k), q AS (SELECT *, e / sum(e) OVER (PARTITION BY p_brand) AS prob FROM e),
b AS (SELECT *, coalesce(sum(prob) OVER (PARTITION BY p_brand ORDER BY l DESC, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM q)
SELECT p_brand, p_partkey, round(prob, 6) AS prob FROM b WHERE b <= 0.7""",
)
def _(s, d):
    p = table(s, d, "part").withColumn("logit", F.col("p_retailprice") / 200)
    return signal.nucleus(p, "p_brand", "p_partkey", "logit", 10, 0.7).withColumn("prob", F.round("prob", 6))


@query("argmax_item", "SELECT p_brand, p_partkey, 1.0::DOUBLE AS prob FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 1")
def _(s, d):
    return signal.nucleus(table(s, d, "part"), "p_brand", "p_partkey", "p_retailprice", temperature=0)


_PMF = """e AS (SELECT user_id, event_id, row_number() OVER w AS n, least(value / 1000, 0.9) AS h, lead(1) OVER w IS NULL AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
a AS (SELECT *, coalesce(product(1 - h) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS alive FROM e),
p AS (SELECT user_id, event_id, n, CASE WHEN last THEN alive ELSE alive * h END AS pmf FROM a)"""


def _hazard(s, d):
    from pyspark.sql import Window

    e = table(s, d, "events").withColumn("h", F.least(F.col("value") / 1000, F.lit(0.9))).withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return signal.stopping_pmf(e, "user_id", ["ts", "event_id"], "h")


@query("hazard_pmf", f"WITH {_PMF} SELECT event_id, round(pmf, 6) AS pmf FROM p")
def _(s, d):
    return _hazard(s, d).select("event_id", r6(F.col("pmf"), "pmf"))


@query(
    "stopping_kl",
    f"""WITH {_PMF}, m AS (SELECT user_id, sum(pmf * n) AS m FROM p GROUP BY 1)
SELECT user_id, round(any_value(m), 5) AS mean_steps, round(sum(CASE WHEN pmf > 0 THEN pmf * (ln(pmf) - (n - 1) * ln(1 - 1 / m) - ln(1 / m)) ELSE 0 END), 5) AS kl FROM p JOIN m USING (user_id) GROUP BY 1""",
)
def _(s, d):
    return signal.geometric_kl(_hazard(s, d), "user_id").select("user_id", F.round("mean_steps", 5).alias("mean_steps"), F.round("kl", 5).alias("kl"))


def _views(s, d):
    """All vectors in batches of 80; vectors n and n + 1 are two views of one pair."""
    v = F.col("vec_id")
    return _vectors(s, d).select(F.floor(v / 80).alias("batch"), F.floor(v / 2).alias("pair"), (v % 2).alias("view"), "label", "embedding")


_VIEWS = "v AS (SELECT vec_id, vec_id // 80 AS batch, vec_id // 2 AS pair, vec_id % 2 AS view, label, embedding::DOUBLE[] AS e FROM embeddings)"


def _nce(same: str) -> str:
    return f"""WITH {_VIEWS}, s AS (SELECT a.batch, a.vec_id, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) / 0.5 AS s, {same} AS pos FROM v a JOIN v b ON a.batch = b.batch AND a.vec_id != b.vec_id),
l AS (SELECT batch, vec_id, avg(s) FILTER (WHERE pos) AS sp, ln(sum(exp(s))) AS z FROM s GROUP BY ALL) SELECT batch, round(avg(z - sp), 6) AS loss FROM l WHERE sp IS NOT NULL GROUP BY 1"""


@query("info_nce", _nce("a.pair = b.pair"))
def _(s, d):
    return metrics.info_nce(_views(s, d), "batch", "pair", "view", "embedding", 0.5).withColumn("loss", F.round("loss", 6))


@query("supervised_nce", _nce("a.label = b.label"))
def _(s, d):
    return metrics.info_nce(_views(s, d), "batch", "pair", "view", "embedding", 0.5, "label").withColumn("loss", F.round("loss", 6))


@query(
    "queue_loss",
    """WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings),
p AS (SELECT a.vec_id, a.e AS q, list_dot_product(a.e, b.e) / 0.2 AS pos FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id >= 64),
n AS (SELECT p.vec_id, any_value(pos) AS pos, sum(exp(list_dot_product(p.q, v.e) / 0.2)) AS neg FROM p JOIN v ON v.vec_id < 64 GROUP BY 1)
SELECT count(*)::BIGINT AS n, round(avg(ln(exp(pos) + neg) - pos), 6) AS loss FROM n""",
)
def _(s, d):
    v = _vectors(s, d)
    pairs = v.filter("vec_id >= 64").select("vec_id", F.col("embedding").alias("q")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("k")), "vec_id")
    return metrics.queue_loss(pairs, v.filter("vec_id < 64"), "q", "k", "embedding", 0.2).withColumn("loss", F.round("loss", 6))


@query(
    "gaussian_kl",
    """WITH h AS (SELECT embedding[1:32]::DOUBLE[] AS m, embedding[33:64]::DOUBLE[] AS v FROM embeddings),
k AS (SELECT -0.5 * list_sum(list_transform(generate_series(1, 32), lambda i: 1 + v[i] - m[i] * m[i] - exp(v[i]))) AS k, list_sum(list_transform(generate_series(1, 32), lambda i: (m[i] - v[i]) * (m[i] - v[i]))) AS s FROM h)
SELECT count(*)::BIGINT AS n, round(sum(s) / (32 * count(*)), 6) AS mse, round(avg(k), 6) AS kl, round(sum(s) / (32 * count(*)) + 2 * avg(k), 6) AS loss FROM k""",
)
def _(s, d):
    e = doubles("embedding")
    mu, logvar = F.slice(e, 1, 32), F.slice(e, 33, 32)
    out = metrics.vae_loss(_vectors(s, d), mu, logvar, mu, logvar, 2.0)
    return out.select("n", *(r6(F.col(c), c) for c in ("mse", "kl", "loss")))


for _how, _expr in (("average", "(a.e[i] + b.e[i]) / 2"), ("product", "a.e[i] * b.e[i]")):

    @query(
        f"fuse_{_how}",
        f"""WITH a AS (SELECT vec_id, embedding[1:32]::DOUBLE[] AS e FROM embeddings), b AS (SELECT vec_id, embedding[33:64]::DOUBLE[] AS e FROM embeddings WHERE vec_id % 2 = 0)
SELECT vec_id, (i - 1)::INT AS pos, round({_expr}, 6) + 0.0::DOUBLE AS value FROM a JOIN b USING (vec_id), unnest(generate_series(1, 32)) AS u(i)""",
    )
    def _(s, d, how=_how):
        v = _vectors(s, d)
        a, b = v.select("vec_id", F.slice("embedding", 1, 32).alias("a")), v.filter("vec_id % 2 = 0").select("vec_id", F.slice("embedding", 33, 32).alias("b"))
        return joins.combine(a, b, "vec_id", "a", "b", how).select("vec_id", F.posexplode("fused").alias("pos", "value")).withColumn("value", F.round("value", 6) + 0.0)  # no negative zero


# Features and versions ---------------------------------------------------------------------------------------------


@query(
    "features_derived",
    """WITH m AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_avg(embedding::DOUBLE[]) AS mean, list_stddev_samp(embedding::DOUBLE[]) AS std FROM embeddings)
SELECT vec_id, round(mean, 6) AS mean, round(std, 6) AS std, round((e[1] - mean) / (std + 1e-6), 6) AS first_z FROM m""",
)
def _(s, d):
    store = features.FeatureStore()
    store.register(features.Feature("mean", lambda df: features.array_mean(doubles("embedding"))))
    store.register(features.Feature("std", lambda df: features.array_std(doubles("embedding"))))
    store.register(features.Feature("first_z", lambda df: features.standardised(doubles("embedding")[0], df["mean"], df["std"]), ["mean", "std"]))
    out = store.compute(_vectors(s, d).select("vec_id", "embedding"), ["mean", "std", "first_z"])
    return out.select("vec_id", *(r6(F.col(c), c) for c in ("mean", "std", "first_z")))


def _diamond() -> features.FeatureStore:
    store = features.FeatureStore()
    store.register(features.Feature("A", lambda df: F.col("l_quantity") * 2))
    store.register(features.Feature("B", lambda df: df["A"] + 1, ["A"]))
    store.register(features.Feature("C", lambda df: df["A"] * 3, ["A"]))
    store.register(features.Feature("D", lambda df: df["B"] + df["C"], ["B", "C"]))
    return store


@query("feature_diamond", "SELECT l_orderkey, l_linenumber, l_quantity, l_quantity * 2 + 1 + l_quantity * 6 AS D FROM lineitem")
def _(s, d):
    return _diamond().compute(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["D"])


def _edited(o: DataFrame) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 50 == 0, F.col("o_totalprice") + 10).otherwise(F.col("o_totalprice"))
    return o.filter("o_orderkey % 97 != 1").withColumn("o_totalprice", price)


_EDITED = "(SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice + 10 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 97 != 1)"


def _orders(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query(
    "version_diff",
    f"""WITH j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_custkey AS c0, b.o_custkey AS c1, a.o_orderstatus AS s0, b.o_orderstatus AS s1, a.o_totalprice AS p0, b.o_totalprice AS p1
FROM orders a FULL JOIN {_EDITED} b ON a.o_orderkey = b.o_orderkey)
SELECT o_orderkey, 'o_custkey' AS "column", c0::VARCHAR AS old, c1::VARCHAR AS new FROM j WHERE c0 IS DISTINCT FROM c1
UNION ALL SELECT o_orderkey, 'o_orderstatus', s0, s1 FROM j WHERE s0 IS DISTINCT FROM s1
UNION ALL SELECT o_orderkey, 'o_totalprice', printf('%.2f', p0), printf('%.2f', p1) FROM j WHERE p0 IS DISTINCT FROM p1""",
)
def _(s, d):
    cells = versions.changed_cells(_orders(s, d), _edited(_orders(s, d)), "o_orderkey")
    money = lambda c: F.when(F.col("column") == "o_totalprice", F.format_string("%.2f", F.col(c).cast("double"))).otherwise(F.col(c))
    return cells.select("o_orderkey", "column", F.when(F.col("old").isNotNull(), money("old")).alias("old"), F.when(F.col("new").isNotNull(), money("new")).alias("new"))




@query(
    "version_stats",
    """SELECT 'o_custkey' AS "column", round(avg(o_custkey), 4) AS mean, round(stddev_samp(o_custkey), 4) AS std, min(o_custkey)::DOUBLE AS min, max(o_custkey)::DOUBLE AS max, round(sqrt(sum(o_custkey::DOUBLE * o_custkey)), 4) AS norm FROM orders
UNION ALL SELECT 'o_totalprice', round(avg(o_totalprice), 4), round(stddev_samp(o_totalprice), 4), min(o_totalprice), max(o_totalprice), round(sqrt(sum(o_totalprice * o_totalprice)), 4) FROM orders""",
)
def _(s, d):
    st = versions.statistics(_orders(s, d), "o_orderkey")
    return st.select("column", *(F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max", "norm")))


@query(
    "version_reconstruct",
    f"""SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 30 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM {_EDITED}
UNION ALL SELECT -o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) FROM orders WHERE o_orderkey % 41 = 0 AND o_orderkey > 0""",
)
def _(s, d):
    v0 = _orders(s, d)
    v1 = _edited(v0)
    v2 = v1.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 30 == 0, "X").otherwise(F.col("o_orderstatus")))
    v3 = v2.unionByName(v0.filter("o_orderkey % 41 = 0 AND o_orderkey > 0").withColumn("o_orderkey", -F.col("o_orderkey")))
    chain = [versions.delta(a, b, "o_orderkey") for a, b in ((v0, v1), (v1, v2), (v2, v3))]
    return versions.apply_deltas(v0, chain, "o_orderkey").withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("merge_mean", "SELECT c_custkey, c_mktsegment, round(c_acctbal + CASE WHEN c_custkey % 2 = 0 THEN 5 ELSE 0 END, 4) AS c_acctbal FROM customer")
def _(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    theirs = c.withColumn("c_acctbal", F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") + 10).otherwise(F.col("c_acctbal")))
    return versions.merged(c, theirs, "c_custkey", "mean").withColumn("c_acctbal", F.round("c_acctbal", 4))


_HASHED = {"orders": ["o_orderkey", "o_custkey", "o_orderstatus"], "customer": ["c_custkey", "c_name", "c_mktsegment"], "lineitem": ["l_orderkey", "l_linenumber", "l_returnflag"], "events": ["event_id", "user_id", "event_type", "props"], "documents": ["doc_id", "lang", "text"]}


@query(
    "fingerprint",
    " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", count(*)::BIGINT AS n, sum(('0x' || substr(h, 1, 12))::BIGINT)::VARCHAR AS total, bit_xor(('0x' || substr(h, 13, 12))::BIGINT)::BIGINT AS mix FROM (SELECT md5(concat_ws('|', {', '.join(c)})) AS h FROM {t})"
        for t, c in _HASHED.items()
    ),
)
def _(s, d):
    from functools import reduce

    return reduce(DataFrame.unionByName, (versions.content_sums(table(s, d, t), c).withColumn("table", F.lit(t)) for t, c in _HASHED.items()))


@query(
    "stats_diff",
    """WITH o AS (SELECT * FROM orders), e AS (SELECT o_custkey, o_totalprice FROM """
    + _EDITED
    + """), s AS (
SELECT 'o_custkey' AS "column", 'old' AS side, avg(o_custkey) AS mean, stddev_samp(o_custkey) AS std, min(o_custkey)::DOUBLE AS min, max(o_custkey)::DOUBLE AS max, sqrt(sum(o_custkey::DOUBLE * o_custkey)) AS norm FROM o
UNION ALL SELECT 'o_totalprice', 'old', avg(o_totalprice), stddev_samp(o_totalprice), min(o_totalprice), max(o_totalprice), sqrt(sum(o_totalprice * o_totalprice)) FROM o
UNION ALL SELECT 'o_custkey', 'new', avg(o_custkey), stddev_samp(o_custkey), min(o_custkey), max(o_custkey), sqrt(sum(o_custkey::DOUBLE * o_custkey)) FROM e
UNION ALL SELECT 'o_totalprice', 'new', avg(o_totalprice), stddev_samp(o_totalprice), min(o_totalprice), max(o_totalprice), sqrt(sum(o_totalprice * o_totalprice)) FROM e),
u AS (SELECT "column", side, 'mean' AS stat, mean AS v FROM s UNION ALL SELECT "column", side, 'std', std FROM s UNION ALL SELECT "column", side, 'min', min FROM s UNION ALL SELECT "column", side, 'max', max FROM s UNION ALL SELECT "column", side, 'norm', norm FROM s)
SELECT a."column", a.stat, round(a.v, 3) AS old, round(b.v, 3) AS new, round(b.v - a.v, 3) + 0.0 AS change FROM u a JOIN u b ON a."column" = b."column" AND a.stat = b.stat AND a.side = 'old' AND b.side = 'new'""",
)
def _(s, d):
    out = versions.stats_diff(_orders(s, d), _edited(_orders(s, d)), "o_orderkey")
    return out.select("column", "stat", *((F.round(c, 3) + 0.0).alias(c) for c in ("old", "new", "change")))


@query(
    "first_changed_cells",
    f"""WITH j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_custkey AS c0, b.o_custkey AS c1, a.o_orderstatus AS s0, b.o_orderstatus AS s1, a.o_totalprice AS p0, b.o_totalprice AS p1
FROM orders a FULL JOIN {_EDITED} b ON a.o_orderkey = b.o_orderkey),
c AS (SELECT o_orderkey, 'o_custkey' AS "column" FROM j WHERE c0 IS DISTINCT FROM c1 UNION ALL SELECT o_orderkey, 'o_orderstatus' FROM j WHERE s0 IS DISTINCT FROM s1 UNION ALL SELECT o_orderkey, 'o_totalprice' FROM j WHERE p0 IS DISTINCT FROM p1)
SELECT * FROM c ORDER BY o_orderkey, "column" LIMIT 100""",
)
def _(s, d):  # a report of the first hundred
    return versions.changed_cells(_orders(s, d), _edited(_orders(s, d)), "o_orderkey").orderBy("o_orderkey", "column").limit(100).select("o_orderkey", "column")


@query(
    "feature_ttl",
    f"""SELECT l.event_id, round(CASE WHEN epoch_us(l.ts) - epoch_us(r.ts) <= {6 * HOUR} THEN r.value END, 6) AS feature FROM (SELECT * FROM events WHERE event_type = 'purchase') l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.ts >= r.ts""",
)
def _(s, d):
    j = joins.point_in_time(_events(s, d, "purchase"), _events(s, d, "view"), ["user_id"], "ts", "event_id", "value", 6 * HOUR)
    return j.select("event_id", r6(F.col("feature"), "feature"))


@query(
    "nearest_nway",
    " JOIN ".join(
        f"""(SELECT event_id, round(value, 6) AS {k}_value FROM (SELECT l.event_id, r.value, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(epoch_us(l.ts) - epoch_us(r.ts)), r.ts, r.event_id) AS k
FROM events l JOIN events r ON l.user_id = r.user_id AND l.event_type = 'purchase' AND r.event_type = '{k}' AND abs(epoch_us(l.ts) - epoch_us(r.ts)) <= {24 * HOUR}) WHERE k = 1)"""
        for k in ("view", "click")
    ).join(["SELECT event_id, view_value, click_value FROM ", " USING (event_id)"]),
)
def _(s, d):
    j = joins.nearest_many(_events(s, d, "purchase"), {"view_value": _events(s, d, "view"), "click_value": _events(s, d, "click")}, ["user_id"], "ts", "event_id", "value", 24 * HOUR)
    return j.select("event_id", r6(F.col("view_value"), "view_value"), r6(F.col("click_value"), "click_value"))


@query(
    "shape_rules",
    """WITH p AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
SELECT rule, n = 0 AS ok, CASE WHEN n = 0 THEN '' ELSE error END AS errors FROM (
SELECT 'any' AS rule, 0 AS n, '' AS error
UNION ALL SELECT 'width', 1, 'pairs: Dimension 2: expected 3, got 2'
UNION ALL SELECT 'axes', 1, 'pairs: Expected 2 dimensions, got 3'
UNION ALL SELECT 'length', (SELECT (min(n) != 5 OR max(n) != 5)::INT FROM p), (SELECT 'pairs: Dimension 1: expected 5, got ' || CASE WHEN min(n) != 5 THEN min(n) ELSE max(n) END FROM p)
UNION ALL SELECT 'rows', (SELECT (count(*) != 7)::INT FROM p), (SELECT 'pairs: Dimension 0: expected 7, got ' || count(*) FROM p))""",
)
def _(s, d):
    from functools import reduce

    pairs = table(s, d, "events").groupBy("user_id").agg(F.collect_list(F.array("value", F.col("event_id").cast("double"))).alias("pairs"))
    shapes = {"any": ["*", "*", 2], "width": ["*", "*", 3], "axes": ["*", "*"], "length": ["*", 5, "*"], "rows": [7, "*", "*"]}
    each = (validate.validate(pairs, [validate.shape("pairs", dims)]).select(F.lit(k).alias("rule"), "ok", F.array_join("errors", "; ").alias("errors")) for k, dims in shapes.items())
    return reduce(DataFrame.unionByName, each)


@query(
    "validate_drift",
    """WITH b AS (SELECT epoch_us(ts) // 86400000000 AS day, avg(value) AS mean, stddev_samp(value) AS std FROM events GROUP BY 1),
w AS (SELECT mean, count(*) OVER p AS seen, avg(mean) OVER p AS mu, avg(std) OVER p AS sigma FROM b WINDOW p AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT CASE WHEN (SELECT max(value) FROM events) > 480 THEN 'value: value outside [0, 480]' END AS m UNION ALL SELECT CASE WHEN (SELECT count(*) FROM w WHERE seen >= 10 AND abs(mean - mu) > 0.3 * sigma) > 0 THEN 'value: Significant mean shift detected' END)
SELECT count(m) = 0 AS ok, coalesce(string_agg(m, '; ' ORDER BY m), '') AS errors FROM e""",
)
def _(s, d):
    e = table(s, d, "events").withColumn("day", F.floor(micros("ts") / 86_400_000_000))
    out = validate.validate_batches(e, [validate.in_range("value", 0, 480)], "day", ["value"], sigmas=0.3)
    return out.select("ok", F.array_join("errors", "; ").alias("errors"))


@query("sample_epochs", " UNION ALL ".join(f"(SELECT {e}::INT AS epoch, doc_id FROM labels ORDER BY {_u(f'7/{e}')}, doc_id LIMIT 40)" for e in (0, 1)))
def _(s, d):
    pick = lambda e: sampling.sample_uniform(table(s, d, "labels"), 40, "doc_id", sampling.epoch_seed(7, e)).select(F.lit(e).alias("epoch"), "doc_id")
    return pick(0).unionByName(pick(1))


@query(
    "sample_class_weighted",
    f"SELECT c_custkey FROM customer ORDER BY -ln(greatest({_u('6', 'c_custkey')}, 1) / 281474976710656.0) / CASE c_mktsegment WHEN 'BUILDING' THEN 5.0 WHEN 'MACHINERY' THEN 0.5 ELSE 1.0 END, c_custkey LIMIT 70",
)
def _(s, d):
    return sampling.class_weighted(table(s, d, "customer"), 70, "c_mktsegment", {"BUILDING": 5.0, "MACHINERY": 0.5}, "c_custkey", 6).select("c_custkey")


_LOSSES = "(SELECT user_id AS c_custkey, list_reduce(list(value ORDER BY ts, event_id), lambda a, x: 0.1 * x + 0.9 * a) AS difficulty, arg_max(value, (ts, event_id)) AS last_loss FROM events GROUP BY 1)"


@query("sample_adaptive", f"SELECT c_custkey FROM customer LEFT JOIN {_LOSSES} USING (c_custkey) ORDER BY -ln(greatest({_u('8', 'c_custkey')}, 1) / 281474976710656.0) / coalesce(greatest(0.1, least(10.0, last_loss)), 1.0), c_custkey LIMIT 60")
def _(s, d):
    losses = sampling.difficulty(table(s, d, "events").withColumnRenamed("user_id", "c_custkey"), "c_custkey", ["ts", "event_id"], "value")
    return sampling.adaptive(table(s, d, "customer"), 60, "c_custkey", "c_mktsegment", losses, 9, 8).select("c_custkey")


@query("sample_focal_scores", f"SELECT c_custkey FROM customer LEFT JOIN {_LOSSES} USING (c_custkey) ORDER BY -ln(greatest({_u('8', 'c_custkey')}, 1) / 281474976710656.0) / pow(coalesce(difficulty, 1.0), 2), c_custkey LIMIT 60")
def _(s, d):
    losses = sampling.difficulty(table(s, d, "events").withColumnRenamed("user_id", "c_custkey"), "c_custkey", ["ts", "event_id"], "value")
    return sampling.focal(table(s, d, "customer"), 60, "c_custkey", "c_mktsegment", losses, seed=8).select("c_custkey")


@query(
    "retention_cleared",
    """WITH c AS (SELECT event_type, max(event_id) AS cleared FROM events WHERE event_id % 997 = 0 GROUP BY 1)
SELECT event_type, user_id, uses FROM (SELECT event_type, user_id, count(*)::BIGINT AS uses FROM events e LEFT JOIN c USING (event_type) WHERE event_id % 997 != 0 AND (cleared IS NULL OR event_id > cleared) GROUP BY ALL)""",
)
def _(s, d):
    e = table(s, d, "events").withColumn("kind", F.when(F.col("event_id") % 997 == 0, "clear").otherwise("write"))
    return vectors.since_clear(e, "event_type", "event_id", "kind").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("uses"))


@query("fuse_concat", "SELECT vec_id, (i - 1)::INT AS pos, round((embedding[1:8]::DOUBLE[] || embedding[33:36]::DOUBLE[])[i], 6) + 0.0::DOUBLE AS value FROM embeddings, unnest(generate_series(1, 12)) AS u(i) WHERE vec_id % 2 = 0")
def _(s, d):
    v = _vectors(s, d)
    a, b = v.select("vec_id", F.slice("embedding", 1, 8).alias("a")), v.filter("vec_id % 2 = 0").select("vec_id", F.slice("embedding", 33, 4).alias("b"))
    return joins.combine(a, b, "vec_id", "a", "b", "concat").select("vec_id", F.posexplode("fused").alias("pos", "value")).withColumn("value", F.round("value", 6) + 0.0)
