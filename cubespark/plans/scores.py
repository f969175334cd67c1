"""Queries for the metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cubespark.operators import metrics
from cubespark.plans import query
from cubespark.sources import read_table

_R = "with r as (select l_extendedprice as y, 1000 + 1400 * l_quantity as p from lineitem) "


def _regression(spark, d):
    return read_table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.lit(1000) + 1400 * F.col("l_quantity")).alias("p"))


_FORMULAS = {
    "mae": "avg(abs(y - p))", "mse": "avg((y - p) * (y - p))", "rmse": "sqrt(avg((y - p) * (y - p)))", "r2": "1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y))",
    "huber_loss": "avg(case when abs(y - p) <= 5000 then 0.5 * (y - p) * (y - p) else 5000 * (abs(y - p) - 2500) end)", "mape": "avg(abs((y - p) / y)) * 100", "explained_variance": "1 - var_pop(y - p) / var_pop(y)",
}


def _register(name: str, formula: str) -> None:
    places = 0 if name in ("mse", "huber_loss") else 4

    @query(name, _R + f"select round({formula}, {places}) as {name} from r")
    def run(spark, d):
        return metrics.Evaluator("pytorch").get_metrics([name], delta=5000.0)[name](_regression(spark, d)).select(F.round(name, places).alias(name))


for _name, _formula in _FORMULAS.items():
    _register(_name, _formula)


def _median(framework: str, formula: str) -> None:
    @query(f"median_ae_{framework}", _R + f", a as (select abs(y - p) e, row_number() over (order by abs(y - p)) rn, count(*) over () n from r) select round({formula}, 6) as med_ae from a")
    def run(spark, d):
        return metrics.Evaluator(framework).get_metrics(["med_ae"])["med_ae"](_regression(spark, d)).select(F.round("med_ae", 6).alias("med_ae"))


_median("pytorch", "max(case when rn = (n + 1) // 2 then e end)")
_median("sklearn", "median(e)")
_median("tensorflow", "max(case when rn = n // 2 + 1 then e end)")

_C = """with s as (select label as y, vec_id, [((vec_id * 31 + c * 17) % 97) / 97.0::double + case when c = label then 0.3 else 0.0 end for c in range(10)] as s from embeddings),
k as (select y, s, cast(list_position(s, list_max(s)) - 1 as int) as p from s), cls as (select unnest(range(10)) c),
t as (select c, count(*) filter (y = c and p = c) tp, count(*) filter (y <> c and p = c) fp, count(*) filter (y = c and p <> c) fn from cls, k group by c),
v as (select c, tp, fp, fn, tp / (tp + fp + 1e-7) pr, tp / (tp + fn + 1e-7) re from t), f as (select *, 2 * pr * re / (pr + re + 1e-7) f1 from v),
n as (select sum(tp) tp, sum(fp) fp, sum(fn) fn from t), z as (select tp / (tp + fp + 1e-7) pr, tp / (tp + fn + 1e-7) re from n)
"""


def _classes(spark, d):
    score = lambda c: (F.col("vec_id") * 31 + c * 17) % 97 / F.lit(97.0) + F.when(F.col("label") == c, 0.3).otherwise(0.0)
    df = read_table(spark, d, "embeddings").select("label", "vec_id").withColumn("s", F.array(*[score(c) for c in range(10)]))
    return df.select(F.col("label").alias("y"), "s", metrics.predicted_class(F.col("s")).cast("int").alias("p"))


@query("accuracy", _C + "select round(avg((y = p)::int), 6) accuracy from k")
def accuracy(spark, d):
    return metrics.Evaluator().get_metrics(["accuracy"])["accuracy"](_classes(spark, d)).select(F.round("accuracy", 6).alias("accuracy"))


@query("confusion", _C + "select cast(c as int) as \"class\", tp, fp, fn from t")
def confusion(spark, d):
    return metrics.confusion(_classes(spark, d))


_SQL_OF = {"precision": "pr", "recall": "re", "f1": "f1"}


def _averaged(metric: str, average: str) -> None:
    x = _SQL_OF[metric]
    name = f"{metric}_{average}"
    micro = "2 * pr * re / (pr + re + 1e-7)" if metric == "f1" else x
    text = {"macro": f"avg({x}), 6) {name} from f", "weighted": f"sum({x} * (tp + fn)) / sum(tp + fn), 6) {name} from f", "micro": f"{micro}, 6) {name} from z"}[average]

    @query(name, _C + f"select round({text}")
    def run(spark, d):
        return metrics.averaged(_classes(spark, d), metric, average).select(F.round(name, 6).alias(name))


for _metric in _SQL_OF:
    for _average in ("macro", "micro", "weighted"):
        _averaged(_metric, _average)


@query("roc_auc", _C + """, e as (select y, c, s[c + 1] sc from k, cls), g as (select c, sc, count(*) filter (y = c) pos, count(*) filter (y <> c) neg from e group by 1, 2),
w as (select c, pos, neg, pos * (coalesce(sum(neg) over (partition by c order by sc rows between unbounded preceding and 1 preceding), 0) + neg / 2) won from g),
h as (select c, sum(won) / (sum(pos) * sum(neg)) auc from w group by c) select round(avg(auc), 6) roc_auc from h""")
def roc_auc(spark, d):
    return metrics.roc_auc(_classes(spark, d)).select(F.round("roc_auc", 6).alias("roc_auc"))


@query("cross_entropy", _C + "select round(avg(-ln(s[y + 1] / list_sum(s))), 6) cross_entropy from k")
def cross_entropy(spark, d):
    df = _classes(spark, d)
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x)
    return metrics.cross_entropy(df.withColumn("s", F.transform("s", lambda x: x / total))).select(F.round("cross_entropy", 6).alias("cross_entropy"))


@query("cross_entropy_logits", _C + "select round(avg(ln(list_sum([exp(x) for x in s])) - s[y + 1]), 6) cross_entropy from k")
def cross_entropy_logits(spark, d):
    return metrics.cross_entropy(_classes(spark, d), logits=True).select(F.round("cross_entropy", 6).alias("cross_entropy"))


@query("label_counts", "select label, count(*) n from embeddings group by label")
def label_counts(spark, d):
    return read_table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


@query("weighted_metric", "with b as (select l_linenumber k, avg(abs(l_extendedprice - 1400 * l_quantity)) m, count(*) n from lineitem group by 1) select round(sum(m * n) / sum(n), 4) m from b")
def weighted_metric(spark, d):
    b = read_table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.avg(F.abs(F.col("l_extendedprice") - 1400 * F.col("l_quantity"))).alias("m"), F.count("*").alias("n"))
    return metrics.weighted_average(b, "m", "n").select(F.round("m", 4).alias("m"))
