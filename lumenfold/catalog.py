"""Registered queries of the analysis engine, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import kernels, metrics, stats
from .operators import algebra, bayes, folds, preprocess
from .sources.tensors import TensorFrame, embeddings_tensor, flat_embeddings, relabel, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


# ---- naive Bayes on the embeddings tensor ---------------------------------------------------------------------------

T_SQL = """
cells AS (SELECT vec_id AS id, label + 1 AS c, vec_id % 5 + 1 AS fold, unnest(embedding)::DOUBLE AS x, unnest(generate_series(0, 63)) AS i FROM embeddings),
tens AS (SELECT id, c, fold, i // 8 AS t, i % 8 AS f, x FROM cells)"""
NB_SQL = f"""
WITH {T_SQL},
folds AS (SELECT DISTINCT fold FROM tens),
model AS (SELECT g.fold, t, c, f, avg(x) AS mu, var_samp(x) AS va FROM tens JOIN folds g ON tens.fold <> g.fold GROUP BY g.fold, t, c, f),
sc AS (SELECT s.fold, s.id, s.c AS y, s.t AS t_test, m.t, m.c, sum(-(s.x - m.mu) * (s.x - m.mu) / (2 * m.va)) AS s
  FROM tens s JOIN model m ON s.fold = m.fold AND s.f = m.f {{on}} GROUP BY 1, 2, 3, 4, 5, 6),
pred AS (SELECT fold, id, y, t, t_test, arg_min(c, (-s, c)) AS p FROM sc GROUP BY 1, 2, 3, 4, 5)"""
PERF_SQL = """
per AS (SELECT fold, {k}, avg(CASE WHEN p = y THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS a, count(*) AS n FROM pred GROUP BY fold, {k})
SELECT {k}, round(sum(a * n) / sum(n), 6) + 0.0::DOUBLE AS perf, round(stddev_samp(a), 6) + 0.0::DOUBLE AS perf_std FROM per GROUP BY {k}"""


def _perf(pred: DataFrame, *keys: str) -> DataFrame:
    per = metrics.accuracy(pred.withColumnRenamed("clabel", "y"), ["fold", *keys])
    return metrics.fold_average(per, keys).select(*[F.col(k).cast("bigint").alias(k) for k in keys], r6("perf").alias("perf"), r6("perf_std").alias("perf_std"))


@query(NB_SQL.format(on="AND s.t = m.t") + "," + PERF_SQL.format(k="t"))
def nb_across_time(spark, sf_dir):
    t = embeddings_tensor(spark, sf_dir)
    return _perf(bayes.score(t.df, bayes.fit_folds(t), ["fold", "t"]), "t")


@query(NB_SQL.format(on="") + "," + PERF_SQL.format(k="t, t_test"))
def nb_time_by_time(spark, sf_dir):
    t = embeddings_tensor(spark, sf_dir)
    return _perf(bayes.score(t.df.withColumnRenamed("t", "t_test"), bayes.fit_folds(t), ["fold"]), "t", "t_test")


@query(NB_SQL.format(on="AND s.t = m.t") + """
, cm AS (SELECT y, p, count(*) AS n FROM pred GROUP BY y, p), grid AS (SELECT a.i AS class_i, b.i AS class_j FROM generate_series(1, 10) a(i), generate_series(1, 10) b(i))
SELECT class_i, class_j, round(coalesce(n, 0)::DOUBLE / sum(coalesce(n, 0)) OVER (PARTITION BY class_i), 6) + 0.0::DOUBLE AS perf
FROM grid LEFT JOIN cm ON y = class_i AND p = class_j""")  # fmt: skip
def nb_multiclass_confusion(spark, sf_dir):
    t = embeddings_tensor(spark, sf_dir)
    pred = bayes.score(t.df, bayes.fit_folds(t), ["fold", "t"]).withColumn("y", F.col("clabel")).withColumn("all", F.lit(1))
    return metrics.confusion(pred, ["all"], 10).select(F.col("class_i").cast("bigint"), F.col("class_j").cast("bigint"), r6("perf").alias("perf"))


@query(f"""
WITH {T_SQL},
near AS (SELECT s.id, s.c, s.fold, e.t, (s.t - e.t + 1) * 8 + s.f AS f, s.x FROM tens s JOIN generate_series(0, 7) e(t) ON abs(s.t - e.t) <= 1),
folds AS (SELECT DISTINCT fold FROM tens),
model AS (SELECT g.fold, t, c, f, avg(x) AS mu, var_samp(x) AS va FROM near JOIN folds g ON near.fold <> g.fold GROUP BY g.fold, t, c, f),
sc AS (SELECT s.fold, s.id, s.c AS y, s.t, m.c, sum(-(s.x - m.mu) * (s.x - m.mu) / (2 * m.va)) AS s FROM near s JOIN model m ON s.fold = m.fold AND s.t = m.t AND s.f = m.f GROUP BY 1, 2, 3, 4, 5),
pred AS (SELECT fold, id, y, t, arg_min(c, (-s, c)) AS p FROM sc GROUP BY 1, 2, 3, 4),""" + PERF_SQL.format(k="t"))  # fmt: skip
def nb_searchlight_neighbours(spark, sf_dir):
    t = embeddings_tensor(spark, sf_dir)
    edges = spark.range(8).select(F.col("id").cast("int").alias("center"), F.explode(F.sequence(F.greatest(F.col("id") - 1, F.lit(0)).cast("int"), F.least(F.col("id") + 1, F.lit(7)).cast("int"))).alias("neighbour"))
    near = bayes.smooth_search(t, edges, "t")
    return _perf(bayes.score(near.df, bayes.fit_folds(near), ["fold", "t"]), "t")


@query(f"""
WITH {T_SQL},
model AS (SELECT t, c, f, avg(x) AS mu, var_samp(x) AS va FROM tens WHERE fold <= 3 GROUP BY t, c, f),
sc AS (SELECT s.id, s.c AS y, s.t, m.c, sum(-(s.x - m.mu) * (s.x - m.mu) / (2 * m.va)) AS s FROM tens s JOIN model m ON s.t = m.t AND s.f = m.f WHERE s.fold > 3 GROUP BY 1, 2, 3, 4),
pred AS (SELECT id, y, t, arg_min(c, (-s, c)) AS p FROM sc GROUP BY 1, 2, 3)
SELECT t, round(avg(CASE WHEN p = y THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) + 0.0::DOUBLE AS perf, count(*) AS n FROM pred GROUP BY t""")
def nb_transfer(spark, sf_dir):
    t = embeddings_tensor(spark, sf_dir)
    pred = bayes.score(t.where("fold > 3").df, bayes.fit_all(t.where("fold <= 3")), ["t"])
    return metrics.accuracy(pred.withColumnRenamed("clabel", "y"), ["t"]).select(F.col("t").cast("bigint"), r6("perf").alias("perf"), "n")


# ---- metrics on lineitem --------------------------------------------------------------------------------------------

P_SQL = """
WITH p AS (SELECT l_returnflag AS k, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS y, l_quantity - 25.5::DOUBLE AS dval, 1 / (1 + exp(-(l_quantity - 25.5::DOUBLE) / 10)) AS prob,
  CASE WHEN l_quantity - 25.5 < 0 THEN 2 ELSE 1 END AS pred FROM lineitem),
c AS (SELECT k, count(*) AS n, sum((y = 1 AND pred = 1)::INT) AS a, sum((y = 1 AND pred = 2)::INT) AS b, sum((y = 2 AND pred = 1)::INT) AS c, sum((y = 2 AND pred = 2)::INT) AS d FROM p GROUP BY k)"""
NANQ = "'NaN'::DOUBLE"


def _binary(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    d = F.col("l_quantity") - 25.5
    return li.select(F.col("l_returnflag").alias("k"), F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("y"), d.alias("dval"), (1 / (1 + F.exp(-d / 10))).alias("prob"), metrics.label_of(d, "dval").alias("pred"))


def _metric(name: str, sql: str, run) -> None:
    def f(spark, sf_dir):
        return run(_binary(spark, sf_dir)).select("k", r6("perf").alias("perf"))

    f.__name__ = name
    query(P_SQL + sql)(f)


def _value(expr: str) -> str:
    return f" SELECT k, round({expr}, 6) + 0.0::DOUBLE AS perf FROM c"


_metric("metric_accuracy_clabel", _value("(a + d)::DOUBLE / n"), lambda p: metrics.accuracy(p, ["k"]))
_metric("metric_accuracy_dval", " SELECT k, round(avg(CASE WHEN dval * (1.5 - y) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) + 0.0::DOUBLE AS perf FROM p GROUP BY k", lambda p: metrics.accuracy(p, ["k"], "dval"))
_metric("metric_accuracy_prob", " SELECT k, round(avg(CASE WHEN (prob - 0.5) * (1.5 - y) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) + 0.0::DOUBLE AS perf FROM p GROUP BY k", lambda p: metrics.accuracy(p, ["k"], "prob"))
_metric("metric_precision", _value(f"CASE WHEN a + c = 0 THEN {NANQ} ELSE a::DOUBLE / (a + c) END"), lambda p: metrics.per_class(p, ["k"], 2, "precision"))
_metric("metric_recall", _value(f"CASE WHEN a + b = 0 THEN {NANQ} ELSE a::DOUBLE / (a + b) END"), lambda p: metrics.per_class(p, ["k"], 2, "recall"))
_metric("metric_f1", _value(f"CASE WHEN 2 * a + b + c = 0 OR a = 0 THEN {NANQ} ELSE 2.0::DOUBLE * a / (2 * a + b + c) END"), lambda p: metrics.per_class(p, ["k"], 2, "f1"))
_metric("metric_kappa", _value(
    "((a + d)::DOUBLE / n - ((a + b)::DOUBLE * (a + c) + (c + d)::DOUBLE * (b + d)) / (n::DOUBLE * n)) / "
    f"nullif(1 - ((a + b)::DOUBLE * (a + c) + (c + d)::DOUBLE * (b + d)) / (n::DOUBLE * n), 0)").replace("round(((", "round(((", 1), lambda p: metrics.kappa(p, ["k"], 2))  # fmt: skip
_metric("metric_auc", f""", one AS (SELECT k, y, rank() OVER (PARTITION BY k ORDER BY dval) + (count(*) OVER (PARTITION BY k, dval) - 1) / 2.0::DOUBLE AS r FROM p),
 s AS (SELECT k, sum(CASE WHEN y = 1 THEN r ELSE 0 END) AS r1, sum((y = 1)::INT)::DOUBLE AS n1, sum((y = 2)::INT)::DOUBLE AS n2 FROM one GROUP BY k)
 SELECT k, round(CASE WHEN n1 * n2 = 0 THEN {NANQ} ELSE (r1 - n1 * (n1 + 1) / 2) / (n1 * n2) END, 6) + 0.0::DOUBLE AS perf FROM s""", lambda p: metrics.auc(p, ["k"]))
_metric("metric_tval", f""", s AS (SELECT k, avg(dval) FILTER (y = 1) AS m1, avg(dval) FILTER (y = 2) AS m2, var_samp(dval) FILTER (y = 1) AS v1, var_samp(dval) FILTER (y = 2) AS v2,
 count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 2) AS n2 FROM p GROUP BY k)
 SELECT k, round(CASE WHEN n1 > 1 AND n2 > 1 THEN (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)) ELSE {NANQ} END, 6) + 0.0::DOUBLE AS perf FROM s""", lambda p: metrics.tval(p, ["k"]))


@query(P_SQL + f""", u AS (SELECT k, 1 AS class_i, 1 AS class_j, a AS v, a + b AS t FROM c UNION ALL SELECT k, 1, 2, b, a + b FROM c UNION ALL SELECT k, 2, 1, c, c + d FROM c UNION ALL SELECT k, 2, 2, d, c + d FROM c)
SELECT k, class_i, class_j, round(CASE WHEN t = 0 THEN {NANQ} ELSE v::DOUBLE / t END, 6) + 0.0::DOUBLE AS perf FROM u""")
def metric_confusion(spark, sf_dir):
    return metrics.confusion(_binary(spark, sf_dir), ["k"], 2).select("k", "class_i", "class_j", r6("perf").alias("perf"))


@query(P_SQL + " SELECT k, y AS class_i, round(avg(dval), 6) + 0.0::DOUBLE AS perf FROM p GROUP BY k, y")
def metric_dval(spark, sf_dir):
    return metrics.mean_dval(_binary(spark, sf_dir), ["k"]).select("k", "class_i", r6("perf").alias("perf"))


M_SQL = """
WITH p AS (SELECT l_linestatus AS k, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS y, l_linenumber % 3 + 1 AS pred FROM lineitem),
g AS (SELECT k, i FROM (SELECT DISTINCT k FROM p), generate_series(1, 3) s(i)),
v AS (SELECT g.k, g.i AS class_i, count(*) FILTER (y = i AND pred = i)::DOUBLE AS h, count(*) FILTER (pred = i) AS col, count(*) FILTER (y = i) AS r FROM g JOIN p USING (k) GROUP BY g.k, g.i)
SELECT k, class_i, round(CASE WHEN {d} = 0 THEN 'NaN'::DOUBLE ELSE h / {d} END, 6) + 0.0::DOUBLE AS perf FROM v"""


def _multi(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    y = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    return li.select(F.col("l_linestatus").alias("k"), y.alias("y"), (F.col("l_linenumber") % 3 + 1).alias("pred"))


@query(M_SQL.format(d="col"))
def metric_precision_multi(spark, sf_dir):
    return metrics.per_class(_multi(spark, sf_dir), ["k"], 3, "precision").select("k", F.col("class_i").cast("bigint"), r6("perf").alias("perf"))


@query(M_SQL.format(d="r"))
def metric_recall_multi(spark, sf_dir):
    return metrics.per_class(_multi(spark, sf_dir), ["k"], 3, "recall").select("k", F.col("class_i").cast("bigint"), r6("perf").alias("perf"))


R_SQL = "WITH p AS (SELECT o_orderpriority AS k, o_custkey % 5 + 1 AS fold, o_totalprice / 1000 AS y, (o_totalprice / 1000) * 0.9 + o_custkey % 7 AS pred FROM orders)"


def _responses(spark, sf_dir) -> DataFrame:
    y = F.col("o_totalprice") / 1000
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("k"), (F.col("o_custkey") % 5 + 1).alias("fold"), y.alias("y"), (y * F.lit(0.9) + F.col("o_custkey") % 7).alias("pred"))


def _regression(kind: str, expr: str) -> None:
    def f(spark, sf_dir):
        return metrics.regression(_responses(spark, sf_dir), ["k"], kind).select("k", r6("perf").alias("perf"))

    f.__name__ = f"metric_{kind}"
    query(f"{R_SQL} SELECT k, round({expr}, 6) + 0.0::DOUBLE AS perf FROM p GROUP BY k")(f)


_regression("mse", "avg((pred - y) * (pred - y))")
_regression("mae", "avg(abs(pred - y))")
_regression("r_squared", "1 - var_samp(pred - y) / var_samp(y)")


@query(R_SQL + """, f AS (SELECT k, fold, avg(abs(pred - y)) AS a, count(*) AS n FROM p GROUP BY k, fold)
SELECT k, round(sum(a * n) / sum(n), 6) + 0.0::DOUBLE AS perf, round(stddev_samp(a), 6) + 0.0::DOUBLE AS perf_std FROM f GROUP BY k""")
def fold_weighted_mean_std(spark, sf_dir):
    per = metrics.regression(_responses(spark, sf_dir), ["k", "fold"], "mae")
    return metrics.fold_average(per, ["k"]).select("k", r6("perf").alias("perf"), r6("perf_std").alias("perf_std"))


@query(P_SQL + """ SELECT 'accuracy' AS metric, k, round((a + d)::DOUBLE / n, 6) + 0.0::DOUBLE AS perf FROM c
UNION ALL SELECT 'precision', k, round(CASE WHEN a + c = 0 THEN 'NaN'::DOUBLE ELSE a::DOUBLE / (a + c) END, 6) + 0.0::DOUBLE FROM c UNION ALL SELECT 'recall', k, round(CASE WHEN a + b = 0 THEN 'NaN'::DOUBLE ELSE a::DOUBLE / (a + b) END, 6) + 0.0::DOUBLE FROM c""")
def multi_metric(spark, sf_dir):
    """Several metrics from one scan: all come from the same counts."""
    c = metrics.counts(_binary(spark, sf_dir), ["k"], 2)
    a, b, cc, d = (F.col(n) for n in ("n_1_1", "n_1_2", "n_2_1", "n_2_2"))
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), r6(v).alias("perf")) for m, v in (("accuracy", metrics.ratio(a + d, F.col("n"))), ("precision", metrics.ratio(a, a + cc)), ("recall", metrics.ratio(a, a + b)))])
    return c.select("k", F.explode(rows).alias("m")).select("m.metric", "k", "m.perf")


# ---- cross-validation folds -----------------------------------------------------------------------------------------

O_SQL = "WITH o AS (SELECT o_orderkey AS sample_id, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS clabel, (o_orderkey::BIGINT * 1103515245 + 12345 + {seed} * 7919) % 2147483648 AS key FROM orders)"


def _orders(spark, sf_dir) -> DataFrame:
    c = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), c.alias("clabel"), F.col("o_totalprice").alias("x"))


@query("SELECT 1 AS repeat, (vec_id % 5 + 1)::INT AS fold, vec_id AS sample_id FROM embeddings")
def cv_predefined(spark, sf_dir):
    return folds.predefined(flat_embeddings(spark, sf_dir).df)


@query("SELECT 1 AS repeat, (row_number() OVER (ORDER BY o_orderkey))::INT AS fold, o_orderkey AS sample_id FROM orders")
def cv_leaveout(spark, sf_dir):
    return folds.leaveout(_orders(spark, sf_dir))


@query("""WITH o AS (SELECT o_orderkey AS sample_id, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS clabel, r AS repeat, (o_orderkey::BIGINT * 1103515245 + 12345 + r * 7919) % 2147483648 AS key FROM orders, generate_series(1, 2) s(r))
SELECT repeat::INT AS repeat, ((row_number() OVER (PARTITION BY repeat, clabel ORDER BY key, sample_id) - 1) % 5 + 1)::INT AS fold, sample_id FROM o""")
def cv_kfold_stratified_lcg(spark, sf_dir):
    return folds.kfold(_orders(spark, sf_dir), 5, 2)


@query(O_SQL.format(seed=1) + " SELECT 1 AS repeat, CASE WHEN row_number() OVER (PARTITION BY clabel ORDER BY key, sample_id) <= round(count(*) OVER (PARTITION BY clabel) * 0.1::DOUBLE) THEN 1 ELSE 0 END AS fold, sample_id FROM o")
def cv_holdout_lcg(spark, sf_dir):
    return folds.holdout(_orders(spark, sf_dir), 0.1)


@query(O_SQL.format(seed=1) + """, g AS (SELECT sample_id, clabel, (row_number() OVER (PARTITION BY clabel ORDER BY key, sample_id) - 1) // 5 AS g, count(*) OVER (PARTITION BY clabel) // 5 AS m FROM o),
s AS (SELECT clabel, coalesce(sum(m) OVER (ORDER BY clabel ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM (SELECT DISTINCT clabel, m FROM g))
SELECT 1 AS repeat, (CASE WHEN g < m THEN g + off + 1 ELSE 0 END)::INT AS fold, sample_id FROM g JOIN s USING (clabel)""")
def cv_leaveout_grouped(spark, sf_dir):
    return folds.leaveout_grouped(_orders(spark, sf_dir), 5)


# ---- preprocessing --------------------------------------------------------------------------------------------------


def _events_split(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("sample_id"), F.col("event_type").alias("f"), F.col("value").alias("x"), (F.col("event_id") % 5 == 0).alias("is_test"))


@query("WITH m AS (SELECT event_type AS f, avg(value) AS m FROM events WHERE event_id % 5 <> 0 GROUP BY 1) SELECT event_id AS sample_id, event_type AS f, event_id % 5 = 0 AS is_test, round(value - m, 6) + 0.0::DOUBLE AS x FROM events JOIN m ON event_type = f")
def prep_demean(spark, sf_dir):
    return preprocess.demean(_events_split(spark, sf_dir), ["f"]).select("sample_id", "f", "is_test", r6("x").alias("x"))


@query("WITH m AS (SELECT event_type AS f, avg(value) AS m, stddev_samp(value) AS s FROM events WHERE event_id % 5 <> 0 GROUP BY 1) SELECT event_id AS sample_id, event_type AS f, event_id % 5 = 0 AS is_test, round((value - m) / s, 6) + 0.0::DOUBLE AS x FROM events JOIN m ON event_type = f")
def prep_zscore(spark, sf_dir):
    return preprocess.zscore(_events_split(spark, sf_dir), ["f"]).select("sample_id", "f", "is_test", r6("x").alias("x"))


@query(O_SQL.format(seed=0).replace(" AS key FROM", " AS key, o_totalprice AS x FROM") + """, g AS (SELECT clabel, x, (row_number() OVER (PARTITION BY clabel ORDER BY key, sample_id) - 1) // 5 AS grp, count(*) OVER (PARTITION BY clabel) // 5 AS m FROM o)
SELECT clabel, grp, round(avg(x), 6) + 0.0::DOUBLE AS x, count(*) AS n FROM g WHERE grp < m GROUP BY clabel, grp""")
def prep_average_samples(spark, sf_dir):
    return preprocess.average_samples(_orders(spark, sf_dir), []).select("clabel", "grp", r6("x").alias("x"), "n")


@query(O_SQL.format(seed=0) + ", g AS (SELECT *, row_number() OVER (PARTITION BY clabel ORDER BY key, sample_id) AS r, count(*) OVER (PARTITION BY clabel) AS n FROM o) SELECT sample_id, clabel FROM g WHERE r <= (SELECT min(n) FROM g)")
def prep_undersample(spark, sf_dir):
    return preprocess.undersample(_orders(spark, sf_dir), []).select("sample_id", "clabel")


@query(O_SQL.format(seed=0) + """, g AS (SELECT *, row_number() OVER (PARTITION BY clabel ORDER BY key, sample_id) - 1 AS r, count(*) OVER (PARTITION BY clabel) AS n FROM o),
d AS (SELECT clabel, n, unnest(generate_series(1, (SELECT max(n) FROM g) - n)) AS d FROM (SELECT DISTINCT clabel, n FROM g)),
e AS (SELECT clabel, ((d::BIGINT * 1103515245 + 12345) % 2147483648) % n AS r FROM d)
SELECT sample_id, clabel FROM o UNION ALL SELECT g.sample_id, clabel FROM e JOIN g USING (clabel, r)""")
def prep_oversample(spark, sf_dir):
    return preprocess.oversample(_orders(spark, sf_dir), []).select("sample_id", "clabel")


def _series(spark, sf_dir) -> DataFrame:
    """Daily means per user and event type over all days: absent days are missing."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.to_date("ts").alias("d"), "value")
    first = e.agg(F.min("d").alias("d0"), F.max("d").alias("d1"))
    cells = e.groupBy("user_id", "event_type", "d").agg(F.avg("value").alias("x"))
    days = cells.select("user_id", "event_type").distinct().crossJoin(F.broadcast(first)).select("user_id", "event_type", F.explode(F.sequence("d0", "d1")).alias("d"))
    grid = days.join(cells, ["user_id", "event_type", "d"], "left")
    return grid.select("user_id", "event_type", F.datediff("d", F.lit("1970-01-01")).alias("day"), F.coalesce("x", F.lit(float("nan"))).alias("x"))


S_SQL = """
WITH e AS (SELECT user_id, event_type, (ts::DATE - DATE '1970-01-01')::INT AS day, avg(value) AS x FROM events GROUP BY 1, 2, 3),
g AS (SELECT u.user_id, u.event_type, d.day::INT AS day FROM (SELECT DISTINCT user_id, event_type FROM e) u, generate_series((SELECT min(day) FROM e), (SELECT max(day) FROM e)) d(day)),
s AS (SELECT g.*, x FROM g LEFT JOIN e USING (user_id, event_type, day))
SELECT user_id, event_type, day, coalesce(round({v}, 6) + 0.0::DOUBLE, {fill}) AS x FROM s"""


def _impute(name: str, method: str, value: str, fill: float | None) -> None:
    def f(spark, sf_dir):
        got = preprocess.impute(_series(spark, sf_dir), ["user_id", "event_type"], "day", method, fill=fill)
        return got.select("user_id", "event_type", "day", r6("x").alias("x"))

    f.__name__ = name
    query(S_SQL.format(v=value, fill=NANQ if fill is None else f"{fill}::DOUBLE"))(f)


_over = "OVER (PARTITION BY user_id, event_type ORDER BY day ROWS BETWEEN "
_impute("prep_impute_forward", "forward", f"last_value(x IGNORE NULLS) {_over} UNBOUNDED PRECEDING AND CURRENT ROW)", None)
_impute("prep_impute_backward", "backward", f"first_value(x IGNORE NULLS) {_over} CURRENT ROW AND UNBOUNDED FOLLOWING)", None)
_impute("prep_impute_fill", "fill", "x", 0.0)


# ---- kernels and closed forms ---------------------------------------------------------------------------------------

K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda z: z::DOUBLE) AS e FROM embeddings)
SELECT a.vec_id AS i, b.vec_id AS j, round({k}, 6) + 0.0::DOUBLE AS k FROM v a JOIN v b ON a.vec_id <= b.vec_id"""


def _kernel(name: str, sql: str, **params) -> None:
    def f(spark, sf_dir):
        return kernels.kernel_matrix(flat_embeddings(spark, sf_dir).df, name, digits=6, **params)

    f.__name__ = f"kernel_{name}"
    query(K_SQL.format(k=sql))(f)


_kernel("linear", "list_dot_product(a.e, b.e)")
_kernel("polynomial", "pow(list_dot_product(a.e, b.e) * 0.5 + 1, 2)", gamma=0.5)
_kernel("rbf", "exp(-0.1::DOUBLE * pow(list_distance(a.e, b.e), 2))", gamma=0.1)


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda z: z::DOUBLE) AS e FROM embeddings),
g AS (SELECT vec_id, label * 1000 + (row_number() OVER (PARTITION BY label ORDER BY (vec_id::BIGINT * 1103515245 + 12345) % 2147483648, vec_id) - 1) // 3 AS grp, (row_number() OVER (PARTITION BY label ORDER BY (vec_id::BIGINT * 1103515245 + 12345) % 2147483648, vec_id) - 1) // 3 AS q, count(*) OVER (PARTITION BY label) // 3 AS m FROM v),
p AS (SELECT a.vec_id AS i, b.vec_id AS j, list_dot_product(a.e, b.e) AS k FROM v a, v b)
SELECT x.grp AS gi, y.grp AS gj, round(avg(k), 6) + 0.0::DOUBLE AS k FROM p JOIN g x ON i = x.vec_id JOIN g y ON j = y.vec_id WHERE x.q < x.m AND y.q < y.m GROUP BY 1, 2""")
def prep_average_kernel(spark, sf_dir):
    samples = flat_embeddings(spark, sf_dir).df
    member = preprocess.groups_of(samples.select("sample_id", "clabel"), [], 3).select("sample_id", (((F.col("clabel") - 1) * 1000) + F.col("grp")).alias("grp"))
    return kernels.averaged_kernel_matrix(samples, member, "linear", digits=6)


@query("""WITH d AS (SELECT CASE WHEN c_acctbal > 4500 THEN 1 ELSE 2 END AS clabel, c_mktsegment AS k, c_acctbal / 1000 AS x1, (c_custkey % 97)::DOUBLE / 10 AS x2 FROM customer),
c AS (SELECT k, clabel, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, covar_pop(x1, x1) AS s11, covar_pop(x1, x2) AS s12, covar_pop(x2, x2) AS s22 FROM d GROUP BY 1, 2),
a AS (SELECT k, sum(n * s11) AS s11, sum(n * s12) AS s12, sum(n * s22) AS s22, max(m1) FILTER (clabel = 1) AS a1, max(m1) FILTER (clabel = 2) AS b1, max(m2) FILTER (clabel = 1) AS a2, max(m2) FILTER (clabel = 2) AS b2 FROM c GROUP BY k),
w AS (SELECT *, (s22 * (a1 - b1) - s12 * (a2 - b2)) / (s11 * s22 - s12 * s12) AS w1, (s11 * (a2 - b2) - s12 * (a1 - b1)) / (s11 * s22 - s12 * s12) AS w2 FROM a)
SELECT k, round(w1, 8) AS w1, round(w2, 8) AS w2, round(-(w1 * (a1 + b1) + w2 * (a2 + b2)) / 2, 8) AS b FROM w""")
def lda_2feature(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    d = c.select(F.col("c_mktsegment").alias("k"), F.when(F.col("c_acctbal") > 4500, 1).otherwise(2).alias("clabel"), (F.col("c_acctbal") / 1000).alias("x1"), ((F.col("c_custkey") % 97).cast("double") / 10).alias("x2"))
    return algebra.lda_two_features(d, ["k"]).select("k", *[F.round(n, 8).alias(n) for n in ("w1", "w2", "b")])


@query("""WITH a AS (SELECT p_brand AS k, covar_pop(p_size, p_retailprice) AS c, var_pop(p_size) AS v, count(*) AS n, avg(p_size) AS mx, avg(p_retailprice) AS my FROM part GROUP BY 1), w AS (SELECT *, c * n / (v * n + 2) AS w FROM a)
SELECT k, round(w, 6) + 0.0::DOUBLE AS w, round(my - w * mx, 6) + 0.0::DOUBLE AS b FROM w""")
def ridge_1feature(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("k"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return algebra.ridge_one_feature(p, ["k"], 2.0).select("k", r6("w").alias("w"), r6("b").alias("b"))


@query("""WITH a AS (SELECT p_brand AS k, var_samp(p_size) AS a, covar_samp(p_size, p_retailprice / 100) AS b, var_samp(p_retailprice / 100) AS d FROM part GROUP BY 1)
SELECT k, round((a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b), 6) + 0.0::DOUBLE AS e1, round((a + d) / 2 - sqrt((a - d) * (a - d) / 4 + b * b), 6) + 0.0::DOUBLE AS e2 FROM a""")
def pca_2feature(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("k"), F.col("p_size").cast("double").alias("x1"), (F.col("p_retailprice") / 100).alias("x2"))
    return algebra.pca_two_features(p, ["k"]).select("k", r6("e1").alias("e1"), r6("e2").alias("e2"))


C_SQL = f"WITH {T_SQL}, pr AS (SELECT a.t, a.c AS clabel, a.f AS fi, b.f AS fj, a.x AS xi, b.x AS xj, a.id FROM tens a JOIN tens b ON a.id = b.id AND a.t = b.t AND a.f <= b.f)"


@query(C_SQL + " SELECT t, clabel, fi, fj, round(covar_pop(xi, xj) * count(*), 6) + 0.0::DOUBLE AS scatter, count(*) AS n FROM pr GROUP BY 1, 2, 3, 4")
def class_scatter(spark, sf_dir):
    return algebra.class_scatter(embeddings_tensor(spark, sf_dir)).select(F.col("t").cast("bigint"), "clabel", F.col("fi").cast("bigint"), F.col("fj").cast("bigint"), r6("scatter").alias("scatter"), "n")


@query(f"""WITH {T_SQL}, m AS (SELECT t, f, avg(x) AS m FROM tens GROUP BY 1, 2), z AS (SELECT id, t, f, x - m AS x FROM tens JOIN m USING (t, f)),
s AS (SELECT a.t, a.f AS fi, b.f AS fj, avg(a.x * b.x) AS s, avg(a.x * b.x * a.x * b.x) AS s2, count(*) AS n FROM z a JOIN z b ON a.id = b.id AND a.t = b.t GROUP BY 1, 2, 3),
q AS (SELECT t, sum(s2 - s * s) AS phi, sum(s * s) AS ss, sum(s) FILTER (fi = fj) AS tr, count(*) FILTER (fi = fj) AS p, max(n) AS n FROM s GROUP BY t)
SELECT t, round(greatest(0, least(1, phi / (ss - tr * tr / p) / n)), 6) + 0.0::DOUBLE AS lambda FROM q""")
def ledoit_wolf(spark, sf_dir):
    return algebra.ledoit_wolf(embeddings_tensor(spark, sf_dir)).select(F.col("t").cast("bigint"), r6("lambda").alias("lambda"))


@query(C_SQL + """, s AS (SELECT t, clabel, fi, fj, covar_pop(xi, xj) * count(*) AS s, count(*) AS n FROM pr GROUP BY 1, 2, 3, 4), c AS (SELECT t, fi, fj, sum(s) / sum(n) AS c FROM s GROUP BY 1, 2, 3),
u AS (SELECT t, fi AS f, fj AS g, c FROM c UNION ALL SELECT t, fj, fi, c FROM c WHERE fi < fj) SELECT t, f, round(sum(c * (g + 1)), 6) + 0.0::DOUBLE AS pattern FROM u GROUP BY t, f""")
def activation_pattern(spark, sf_dir):
    got = algebra.activation_pattern(embeddings_tensor(spark, sf_dir), [1, 2, 3, 4, 5, 6, 7, 8])
    return got.select(F.col("t").cast("bigint"), F.col("f").cast("bigint"), r6("pattern").alias("pattern"))


# ---- statistics -----------------------------------------------------------------------------------------------------

CDF = "(CASE WHEN {z} >= 0 THEN 1 - {u} ELSE {u} END)"


def cdf_sql(z: str) -> str:
    """The approximation of ``stats.normal_cdf`` in SQL."""
    t = f"(1 / (1 + 0.2316419::DOUBLE * abs({z})))"
    upper = f"(exp(-{z} * {z} / 2) * 0.3989422804014327::DOUBLE * {t} * (0.319381530::DOUBLE + {t} * (-0.356563782::DOUBLE + {t} * (1.781477937::DOUBLE + {t} * (-1.821255978::DOUBLE + {t} * 1.330274429::DOUBLE)))))"
    return f"(CASE WHEN {z} >= 0 THEN 1 - {upper} ELSE {upper} END)"


@query("""WITH d AS (SELECT o_orderpriority AS k, count(*) FILTER (o_custkey % 2 = 0)::BIGINT AS hits, count(*) AS n FROM orders GROUP BY 1)
SELECT k, round((SELECT coalesce(sum(exp(lgamma(d.n + 1) - lgamma(i + 1) - lgamma(d.n - i + 1) + d.n * ln(0.5::DOUBLE))), 0) FROM generate_series(d.hits + 1, d.n) s(i)), 6) + 0.0::DOUBLE AS p FROM d""")
def stat_binomial(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    d = o.groupBy(F.col("o_orderpriority").alias("k")).agg(F.avg((F.col("o_custkey") % 2 == 0).cast("double")).alias("perf"), F.count(F.lit(1)).alias("n"))
    return stats.binomial(d, ["k"]).select("k", r6("p").alias("p"))


Z_RS = "((n1 * n2 / 2 - least(u, n1 * n2 - u)) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12))"


@query(f"""WITH d AS (SELECT event_type AS k, value AS x, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 2 END AS g FROM events),
r AS (SELECT k, g, rank() OVER (PARTITION BY k ORDER BY x) + (count(*) OVER (PARTITION BY k, x) - 1) / 2.0::DOUBLE AS r FROM d),
a AS (SELECT k, sum(r) FILTER (g = 1) AS r1, count(*) FILTER (g = 1)::DOUBLE AS n1, count(*) FILTER (g = 2)::DOUBLE AS n2 FROM r GROUP BY k), b AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u FROM a), z AS (SELECT k, least(u, n1 * n2 - u) AS u, {Z_RS} AS z FROM b)
SELECT k, u, round(z, 6) + 0.0::DOUBLE AS z, round(2 * (1 - {cdf_sql("abs(z)")}), 6) + 0.0::DOUBLE AS p FROM z""")
def stat_ranksum(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("k"), F.col("value").alias("x"), F.when(F.col("user_id") % 2 == 0, 1).otherwise(2).alias("grp"))
    return stats.rank_sum(e, ["k"]).select("k", "u", r6("z").alias("z"), r6("p").alias("p"))


@query(f"""WITH d AS (SELECT event_type AS k, floor((value - 50) * 10) AS x FROM events WHERE floor((value - 50) * 10) <> 0),
r AS (SELECT k, x, rank() OVER (PARTITION BY k ORDER BY abs(x)) + (count(*) OVER (PARTITION BY k, abs(x)) - 1) / 2.0::DOUBLE AS r FROM d),
a AS (SELECT k, sum(sign(x) * r) AS w, count(*) AS n FROM r GROUP BY k), z AS (SELECT *, w / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 6) AS z FROM a)
SELECT k, w, n, round(z, 6) + 0.0::DOUBLE AS z, round(2 * (1 - {cdf_sql("abs(z)")}), 6) + 0.0::DOUBLE AS p FROM z""")
def stat_signrank(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("k"), F.floor((F.col("value") - 50) * 10).cast("double").alias("x"))
    return stats.signed_rank(e, ["k"]).select("k", "w", "n", r6("z").alias("z"), r6("p").alias("p"))


L2_SQL = """
WITH u AS (SELECT user_id, event_type AS k, avg(value) - 50 AS d FROM events GROUP BY 1, 2),
s AS (SELECT k, d, p, CASE WHEN (((user_id * 131 + p * 7919)::BIGINT * 1103515245 + 12345) % 2147483648 // 65536) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS g, user_id FROM u, generate_series(1, 200) q(p))"""


def _subjects(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("k")).agg((F.avg("value") - 50).alias("d"))


@query(L2_SQL + """, t AS (SELECT k, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM u GROUP BY k), n AS (SELECT k, p, avg(d * g) / (stddev_samp(d * g) / sqrt(count(*))) AS t FROM s GROUP BY k, p)
SELECT k, round(max(t.t), 6) + 0.0::DOUBLE AS stat, sum((n.t > t.t)::INT) / 200.0::DOUBLE AS p FROM t JOIN n USING (k) GROUP BY k""")
def stat_l2_signflip_lcg(spark, sf_dir):
    s = _subjects(spark, sf_dir)
    real = stats.t_statistic(s, ["k"], F.col("d"))
    null = stats.t_statistic(stats.sign_flips(s, "user_id", 200), ["k", "perm"], F.col("d") * F.col("sign"))
    return stats.permutation_p(real, null, ["k"], 200).select("k", r6("stat").alias("stat"), "p")


@query(L2_SQL + """, r AS (SELECT k, avg(d) FILTER (user_id % 2 = 0) - avg(d) FILTER (user_id % 2 = 1) AS t FROM u GROUP BY k), n AS (SELECT k, p, avg(d) FILTER (g > 0) - avg(d) FILTER (g < 0) AS t FROM s GROUP BY k, p)
SELECT k, round(max(r.t), 6) + 0.0::DOUBLE AS stat, sum((n.t > r.t)::INT) / 200.0::DOUBLE AS p FROM r JOIN n USING (k) GROUP BY k""")
def stat_l2_groupperm_lcg(spark, sf_dir):
    s = _subjects(spark, sf_dir)
    gap = lambda one, two: (F.avg(F.when(one, F.col("d"))) - F.avg(F.when(two, F.col("d")))).alias("stat")
    real = s.groupBy("k").agg(gap(F.col("user_id") % 2 == 0, F.col("user_id") % 2 == 1))
    null = stats.sign_flips(s, "user_id", 200).groupBy("k", "perm").agg(gap(F.col("sign") > 0, F.col("sign") < 0))
    return stats.permutation_p(real, null, ["k"], 200).select("k", r6("stat").alias("stat"), "p")


PERM_SQL = """
WITH t AS (SELECT event_id, (event_id::BIGINT * 1103515245 + 12345) % 2147483648 AS key, event_type AS k, value AS x, event_id % 2 = 0 AS y FROM events),
p AS (SELECT k, x, y, (((event_id * 31 + q.p * 7919)::BIGINT * 1103515245 + 12345) % 2147483648 // 65536) % 2 = 0 AS yp, q.p FROM t, generate_series(1, 50) q(p)),
r AS (SELECT k, avg(x) FILTER (y) - avg(x) FILTER (NOT y) AS s FROM t GROUP BY k), n AS (SELECT k, p, avg(x) FILTER (yp) - avg(x) FILTER (NOT yp) AS s FROM p GROUP BY k, p)
SELECT k, sum((n.s > r.s)::INT) / 50.0::DOUBLE AS p{extra} FROM r JOIN n USING (k) GROUP BY k"""


def _permuted(spark, sf_dir, bonferroni: int) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("k"), F.col("value").alias("x"))
    gap = lambda y: (F.avg(F.when(y, F.col("x"))) - F.avg(F.when(~y, F.col("x")))).alias("stat")
    real = e.groupBy("k").agg(gap(F.col("event_id") % 2 == 0))
    # permutation ids are a column, not a loop: the labels are redrawn in the row and summed in one aggregation
    perm = e.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(50))))
    drawn = F.floor(folds.lcg(F.col("event_id") * 31 + F.col("perm") * 7919, 0) / 65536) % 2 == 0
    return stats.permutation_p(real, perm.groupBy("k", "perm").agg(gap(drawn)), ["k"], 50, bonferroni=bonferroni)


@query(PERM_SQL.format(extra=""))
def stat_permutation_lcg(spark, sf_dir):
    return _permuted(spark, sf_dir, 1).select("k", "p")


@query(PERM_SQL.format(extra=", sum((n.s > r.s)::INT) / 50.0::DOUBLE < 0.05::DOUBLE / 5 AS mask"))
def stat_bonferroni(spark, sf_dir):
    return _permuted(spark, sf_dir, 5).select("k", "p", "mask")


@query("""WITH d AS (SELECT event_type AS k, (ts::DATE - DATE '1970-01-01')::INT AS day, avg(value) AS stat FROM events GROUP BY 1, 2), u AS (SELECT *, day - row_number() OVER (PARTITION BY k ORDER BY day) AS g FROM d WHERE stat > 50),
c AS (SELECT k, g, min(day) AS first, max(day) AS last, count(*) AS size, sum(stat) AS mass FROM u GROUP BY k, g) SELECT k, first, last, size, round(mass, 6) + 0.0::DOUBLE AS mass, row_number() OVER (PARTITION BY k ORDER BY first) AS cluster_id FROM c""")
def stat_cluster_1d(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("k"), F.datediff(F.to_date("ts"), F.lit("1970-01-01")).alias("day")).agg(F.avg("value").alias("stat"))
    return stats.runs_1d(d, ["k"], "day", 50.0).select("k", "first", "last", "size", r6("mass").alias("mass"), F.col("cluster_id").cast("bigint"))


# ---- results and plumbing -------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT user_id, event_type AS k, avg(value) AS perf FROM events GROUP BY 1, 2) SELECT k, round(avg(perf), 6) + 0.0::DOUBLE AS perf, round(stddev_samp(perf), 6) + 0.0::DOUBLE AS perf_std, count(*) AS n_results FROM r GROUP BY k""")
def result_combine_average(spark, sf_dir):
    from .plans.results import combine

    r = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("k")).agg(F.avg("value").alias("perf"))
    return combine([r.drop("user_id")], "average", ["k"]).select("k", r6("perf").alias("perf"), r6("perf_std").alias("perf_std"), "n_results")


@query("""SELECT (user_id % 2 + 1)::INT AS "result", event_type AS k, round(avg(value), 6) + 0.0::DOUBLE AS perf FROM events GROUP BY 1, 2""")
def result_combine_merge(spark, sf_dir):
    from .plans.results import combine

    e = table(spark, sf_dir, "events")
    parts = [e.where(F.col("user_id") % 2 == k).groupBy(F.col("event_type").alias("k")).agg(F.avg("value").alias("perf")) for k in (0, 1)]
    return combine(parts, "merge", ["k"]).select("result", "k", r6("perf").alias("perf"))


@query("SELECT o_orderkey AS sample_id, (dense_rank() OVER (ORDER BY o_orderstatus))::INT AS clabel FROM orders")
def relabel_classes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderstatus").alias("clabel"))
    return relabel(o)


@query('SELECT a.l AS "lambda", b.gamma, c.degree::BIGINT AS degree FROM (VALUES (0.01::DOUBLE), (0.1::DOUBLE), (1.0::DOUBLE)) a(l), (VALUES (0.5::DOUBLE), (2.0::DOUBLE)) b(gamma), (VALUES (1), (2), (3)) c(degree)')
def grid_allcomb(spark, sf_dir):
    from .plans.results import grid

    return grid(spark, lambda_=[0.01, 0.1, 1.0], gamma=[0.5, 2.0], degree=[1, 2, 3]).withColumnRenamed("lambda_", "lambda")


# ---- models in groups: checked by tests with tolerances -------------------------------------------------------------


def _spec(**kw):
    from .plans.analysis import AnalysisSpec

    return AnalysisSpec(**({"cv": "predefined"} | kw))


def _two_classes(t: TensorFrame) -> TensorFrame:
    return TensorFrame(t.df.withColumn("clabel", F.when(F.col("clabel") <= 5, 1).otherwise(2)), t.search)


def _cv(name: str, model: str, binary: bool, **kw) -> None:
    def f(spark, sf_dir):
        from .plans.analysis import classify

        t = embeddings_tensor(spark, sf_dir)
        return classify(_two_classes(t) if binary else t, _spec(model=model, **kw), 2 if binary else 10)

    f.__name__ = name
    query()(f)


_cv("lda_cv", "lda", True, metric=("accuracy", "auc"), preprocess=(("zscore", {}),))
_cv("multiclass_lda_cv", "multiclass_lda", False, metric=("accuracy", "confusion"))
_cv("kernel_fda_cv", "kernel_fda", False)
_cv("logreg_cv", "logreg", True)
_cv("svm_cv", "svm", True, hyperparameter={"kernel": "linear"})
_cv("ensemble_cv", "ensemble", True, hyperparameter={"nlearners": 10, "nfeatures": 0.5})
_cv("pca_lda_cv", "lda", True, preprocess=(("pca", {"n": 4}),))
_cv("mmn_lda_cv", "lda", True, preprocess=(("mmn", {}),))


@query()
def lda_time_by_time(spark, sf_dir):
    from .plans.analysis import classify_time_by_time

    return classify_time_by_time(_two_classes(embeddings_tensor(spark, sf_dir)), _spec(model="lda"))


@query()
def lda_transfer(spark, sf_dir):
    from .plans.analysis import transfer

    t = _two_classes(embeddings_tensor(spark, sf_dir))
    return transfer(t.where("fold <= 3"), t.where("fold > 3"), _spec(model="lda"))


# the engine itself where a closed form exists: naive Bayes, and models of one feature

ENGINE_SQL = f"""
WITH {T_SQL},
folds AS (SELECT DISTINCT fold FROM tens),
d AS (SELECT id, c, CASE WHEN c <= 5 THEN 1 ELSE 2 END AS y, fold, t, x FROM tens WHERE f = 0)"""


def _position_perf(got: DataFrame, *keys: str) -> DataFrame:
    return got.select(*[F.col(k).cast("bigint").alias(k) for k in keys], r6("perf").alias("perf"), r6("perf_std").alias("perf_std"))


def _first_feature(t: TensorFrame) -> TensorFrame:
    return TensorFrame(t.df.withColumn("features", F.slice("features", 1, 1)), t.search)


@query(ORACLES["nb_across_time"])
def engine_naive_bayes(spark, sf_dir):
    from .plans.analysis import classify_across_time

    return _position_perf(classify_across_time(embeddings_tensor(spark, sf_dir), _spec(model="naive_bayes")), "t")


@query(ORACLES["nb_across_time"])
def engine_naive_bayes_append(spark, sf_dir):
    from .plans.analysis import classify

    return _position_perf(classify(embeddings_tensor(spark, sf_dir), _spec(model="naive_bayes", append=True)), "t")


@query(ORACLES["nb_time_by_time"])
def engine_naive_bayes_time_by_time(spark, sf_dir):
    from .plans.analysis import classify_time_by_time

    return _position_perf(classify_time_by_time(embeddings_tensor(spark, sf_dir), _spec(model="naive_bayes")), "t", "t_test")


@query(ORACLES["nb_transfer"].replace(", count(*) AS n FROM pred", " FROM pred"))
def engine_naive_bayes_transfer(spark, sf_dir):
    from .plans.analysis import transfer

    t = embeddings_tensor(spark, sf_dir)
    return transfer(t.where("fold <= 3"), t.where("fold > 3"), _spec(model="naive_bayes")).select(F.col("t").cast("bigint").alias("t"), r6("perf").alias("perf"))


@query(ENGINE_SQL + """, m AS (SELECT g.fold, t, avg(x) FILTER (y = 1) AS a, avg(x) FILTER (y = 2) AS b FROM d JOIN folds g ON d.fold <> g.fold GROUP BY 1, 2),
pred AS (SELECT d.fold, d.t, y, CASE WHEN (a - b) * (x - (a + b) / 2) >= 0 THEN 1 ELSE 2 END AS p FROM d JOIN m ON d.fold = m.fold AND d.t = m.t),""" + PERF_SQL.format(k="t"))
def engine_lda(spark, sf_dir):
    from .plans.analysis import classify

    return _position_perf(classify(_first_feature(_two_classes(embeddings_tensor(spark, sf_dir))), _spec(model="lda"), 2), "t")


CENTROID_SQL = ENGINE_SQL + """, m AS (SELECT g.fold, t, {y} AS k, avg(x) AS mu FROM d JOIN folds g ON d.fold <> g.fold GROUP BY 1, 2, 3),
pred AS (SELECT d.fold, d.t, d.id, d.{y} AS y, arg_min(k, (abs(x - mu), k)) AS p FROM d JOIN m ON d.fold = m.fold AND d.t = m.t GROUP BY 1, 2, 3, 4),""" + PERF_SQL.format(k="t")


@query(CENTROID_SQL.format(y="c"))
def engine_multiclass_lda(spark, sf_dir):
    from .plans.analysis import classify

    return _position_perf(classify(_first_feature(embeddings_tensor(spark, sf_dir)), _spec(model="multiclass_lda"), 10), "t")


@query(CENTROID_SQL.format(y="y"))
def engine_kernel_fda(spark, sf_dir):
    from .plans.analysis import classify

    return _position_perf(classify(_first_feature(_two_classes(embeddings_tensor(spark, sf_dir))), _spec(model="kernel_fda", hyperparameter={"kernel": "linear"}), 2), "t")


RIDGE_SQL = f"""
WITH {T_SQL},
folds AS (SELECT DISTINCT fold FROM tens),
d AS (SELECT id, fold, t, max(x) FILTER (f = 0) AS x, max(x) FILTER (f = 1) AS y FROM tens GROUP BY 1, 2, 3),
m AS (SELECT g.fold, t, {{w}} AS w, {{b}} AS b FROM d JOIN folds g ON d.fold <> g.fold GROUP BY 1, 2),
per AS (SELECT d.fold, d.t, avg(abs(y - w * x - b)) AS a, count(*) AS n FROM d JOIN m ON d.fold = m.fold AND d.t = m.t GROUP BY 1, 2)
SELECT t, round(sum(a * n) / sum(n), 6) + 0.0::DOUBLE AS perf, round(stddev_samp(a), 6) + 0.0::DOUBLE AS perf_std FROM per GROUP BY t"""
RIDGE_W = "(covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + 2))"


def _engine_regression(name: str, sql: str, **kw) -> None:
    def f(spark, sf_dir):
        from .plans.analysis import regress

        t = embeddings_tensor(spark, sf_dir)
        d = t.df.withColumn("y", F.element_at("features", 2)).withColumn("features", F.slice("features", 1, 1))
        return _position_perf(regress(TensorFrame(d, t.search, "y"), _spec(metric=("mean_absolute_error",), **kw)), "t")

    f.__name__ = name
    query(sql)(f)


_engine_regression("engine_ridge", RIDGE_SQL.format(w=RIDGE_W, b=f"(avg(y) - {RIDGE_W} * avg(x))"), model="ridge", hyperparameter={"lambda": 2.0})
_engine_regression("engine_kernel_ridge", RIDGE_SQL.format(w="(sum(x * y) / (sum(x * x) + 2))", b="0.0::DOUBLE"), model="kernel_ridge", hyperparameter={"kernel": "linear", "lambda": 2.0})


@query()
def stat_permutation_analysis(spark, sf_dir):
    from .plans.significance import permutation_test

    t = _two_classes(embeddings_tensor(spark, sf_dir))
    return permutation_test(t, _spec(model="lda"), 20, "bonferroni", classes=2)[0]


@query()
def stat_cluster_analysis(spark, sf_dir):
    from .plans.significance import permutation_test

    t = _two_classes(embeddings_tensor(spark, sf_dir))
    return permutation_test(t, _spec(model="lda"), 20, "cluster", 0.5, classes=2)[0]


@query()
def svm_tuned_cv(spark, sf_dir):
    from .plans.analysis import classify

    return classify(_two_classes(embeddings_tensor(spark, sf_dir)), _spec(model="libsvm", hyperparameter={"svm_type": 0, "kernel": "linear", "cost": [0.1, 1.0]}), 2)


def _regress(name: str, model: str) -> None:
    def f(spark, sf_dir):
        from .plans.analysis import regress

        t = embeddings_tensor(spark, sf_dir)
        y = F.element_at("features", 1) * 2 + F.element_at("features", 2)
        return regress(TensorFrame(t.df.withColumn("y", y), t.search, "y"), _spec(model=model, metric=("mean_absolute_error", "r_squared")))

    f.__name__ = name
    query()(f)


_regress("ridge_cv", "ridge")
_regress("kernel_ridge_cv", "kernel_ridge")


def _filters(name: str, run) -> None:
    def f(spark, sf_dir):
        import numpy as np

        from .sources.simulate import oscillation_arrays

        x, y, _ = oscillation_arrays(60, 8, 256, bands=((8, 12), (18, 24)))
        w = np.atleast_2d(run(x, y))
        return spark.createDataFrame([(i, j, float(w[i, j])) for i in range(w.shape[0]) for j in range(w.shape[1])], "channel INT, component INT, weight DOUBLE")

    f.__name__ = name
    query()(f)


def _csp(x, y):
    from .operators.spatial import fit_csp

    return fit_csp(x, y, 1)[0]


def _ssd(x, y):
    from .operators.spatial import fit_ssd
    from .sources.simulate import bandpass

    return fit_ssd(bandpass(x, 256, 8, 12), bandpass(x, 256, 5, 15) - bandpass(x, 256, 7, 13), 3)[0]


def _mmn(x, y):
    from .operators.spatial import fit_mmn

    return fit_mmn(x)


for _name, _run in (("csp_filters", _csp), ("ssd_filters", _ssd), ("mmn_filters", _mmn)):
    _filters(_name, _run)


@query()
def stat_cluster_2d(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 4).alias("perm"), F.hour("ts").cast("bigint").alias("h"), (F.dayofweek("ts") - 1).cast("bigint").alias("d")).agg(F.avg("value").alias("stat"))
    return stats.clusters_nd(e, ["h", "d"], [24, 7], 52.0)


def _simulated(name: str, make) -> None:
    def f(spark, sf_dir):
        from .sources import simulate

        return make(simulate, spark)

    f.__name__ = name
    query()(f)


_simulated("sim_gaussian", lambda s, spark: s.gaussian(spark, 200, 5, 3))
_simulated("sim_spiral", lambda s, spark: s.spiral(spark, 500))
_simulated("sim_radial", lambda s, spark: s.radial(spark, 500))
_simulated("sim_checkerboard", lambda s, spark: s.checkerboard(spark, 500))
_simulated("sim_regression", lambda s, spark: s.regression(spark, "linear", 500, 3))
_simulated("sim_erp", lambda s, spark: s.erp_peaks(spark, 20, 50, [15, 30], [3, 5], [1, -1], [[1, 0.5], [0.2, 1]]))
_simulated("sim_oscillations", lambda s, spark: s.oscillations(spark, n=4, channels=3, times=64))
_simulated("sim_coupled_oscillations", lambda s, spark: s.oscillations(spark, True, n=4, channels=3, times=64))
