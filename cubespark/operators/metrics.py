"""Regression and classification metrics as aggregates; one canonical definition, variants where frameworks differ."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _error() -> Column:
    return F.col("y") - F.col("p")


def mae() -> Column:
    return F.avg(F.abs(_error()))


def mse() -> Column:
    return F.avg(_error() * _error())


def rmse() -> Column:
    return F.sqrt(mse())


def r2() -> Column:
    return 1 - F.sum(_error() * _error()) / F.nullif(F.var_pop("y") * F.count("y"), F.lit(0.0))


def huber(delta: float = 1.0) -> Column:
    a = F.abs(_error())
    return F.avg(F.when(a <= delta, 0.5 * a * a).otherwise(delta * (a - 0.5 * delta)))


def mape() -> Column:
    """Percent; rows whose true value is 0 have no percentage and are skipped."""
    return F.avg(F.abs(_error() / F.nullif(F.col("y"), F.lit(0.0)))) * 100


def explained_variance() -> Column:
    return 1 - F.var_pop(_error()) / F.nullif(F.var_pop("y"), F.lit(0.0))


def accuracy() -> Column:
    return F.avg((F.col("y") == F.col("p")).cast("double"))


REGRESSION: dict[str, Callable[..., Column]] = {"mae": mae, "mse": mse, "rmse": rmse, "r2": r2, "huber_loss": huber, "mape": mape, "explained_variance": explained_variance, "accuracy": accuracy}


def _first_bucket(e: Column) -> Column:
    """About e ** (1 / 1024) in steps of 2 ** -17: roots are rounded exactly, so the order holds; infinity and NaN last."""
    root = reduce(lambda x, _: F.sqrt(x), range(10), e)
    return F.floor(F.when(F.isnan(e), 4.0).when(e == float("inf"), 3.0).otherwise(root) * 2**17)


def _hold(buckets: DataFrame, rank: Column) -> DataFrame:
    """The bucket of each sought rank (counted from 0): its extremes lo and hi, and the rank in it."""
    below = F.sum("n").over(Window.partitionBy("sought").orderBy("bucket")) - F.col("n")
    b = buckets.select("sought", "lo", "hi", "n", below.alias("below"), rank.alias("rank"))
    return b.where("below <= rank and rank < below + n").selectExpr("sought", "lo", "hi", "rank - below as rank")


def _middle_errors(df: DataFrame, sought: tuple[str, ...]) -> DataFrame:
    """A row for each of lower and upper that is sought, with that middle error in lo and hi; none without errors.

    df is read four times, as a task holds counts of buckets and no list of errors: a first bucket spans at most 2 ** 47.1 steps
    between doubles, each reading after it parts the held one in 2 ** 16, and the fourth leaves one value.
    """
    errors = df.select(F.abs(_error()).cast("double").alias("e")).where("e is not null")
    counts = [F.count("*").alias("n"), F.min("e").alias("lo"), F.max("e").alias("hi")]
    first = errors.groupBy(_first_bucket(F.col("e")).alias("bucket")).agg(*counts)
    half = F.expr("(sum(n) over (partition by sought) - int(sought = 'lower')) div 2")
    held = _hold(first.withColumn("sought", F.explode(F.array(*map(F.lit, sought)))), half)
    part = F.when(F.col("lo") < F.col("hi"), F.floor((F.col("e") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 2**16)).otherwise(0)
    for _ in range(3):
        held = _hold(errors.join(F.broadcast(held), F.col("e").between(F.col("lo"), F.col("hi"))).groupBy("sought", "rank", part.alias("bucket")).agg(*counts), F.col("rank"))
    return held


def median_ae(df: DataFrame, kind: str = "lower") -> DataFrame:
    """lower, middle or upper of the two middle errors."""
    ends = F.min("lo"), F.max("lo")
    middle = F.when(ends[0] == ends[1], ends[0]).otherwise(0.5 * ends[0] + 0.5 * ends[1])
    return _middle_errors(df, ("lower", "upper") if kind == "middle" else (kind,)).agg(middle.alias("med_ae"))


def predicted_class(scores: Column) -> Column:
    """The class of the highest score, the first of equals."""
    return F.array_position(scores, F.array_max(scores)) - 1


def cross_entropy(df: DataFrame, logits: bool = False) -> DataFrame:
    """Mean -ln of the true class's probability; y is the class, s the scores (probabilities, or logits)."""
    own = F.element_at("s", F.col("y").cast("int") + 1)
    if logits:
        top = F.array_max("s")
        total = F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x - top))
        return df.agg(F.avg(F.log(total) + top - own).alias("cross_entropy"))
    return df.agg(F.avg(-F.log(own)).alias("cross_entropy"))


def confusion(df: DataFrame) -> DataFrame:
    """class, tp, fp, fn of the classes 0 .. max(y)."""
    both = df.select(F.explode(F.array(F.struct(F.col("y").alias("class"), (F.col("y") == F.col("p")).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp"), (F.col("y") != F.col("p")).cast("bigint").alias("fn")), F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("tp"), (F.col("y") != F.col("p")).cast("bigint").alias("fp"), F.lit(0).cast("bigint").alias("fn")))).alias("c")).select("c.*")
    counts = both.groupBy("class").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])
    top = df.agg(F.max("y").alias("_top"))
    classes = top.select(F.explode(F.sequence(F.lit(0), F.col("_top").cast("int"))).alias("class"))
    return classes.join(counts, "class", "left").na.fill(0)


EPSILON = 1e-7


def averaged(df: DataFrame, metric: str, average: str = "macro") -> DataFrame:
    """precision, recall or f1 over classes: macro, micro or weighted by true support."""
    c = confusion(df).withColumn("support", F.col("tp") + F.col("fn"))

    def value(tp: Column, fp: Column, fn: Column) -> Column:
        precision, recall = tp / (tp + fp + EPSILON), tp / (tp + fn + EPSILON)
        return {"precision": precision, "recall": recall, "f1": 2 * precision * recall / (precision + recall + EPSILON)}[metric]

    name = f"{metric}_{average}"
    if average == "micro":
        return c.agg(value(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias(name))
    each = value(F.col("tp"), F.col("fp"), F.col("fn"))
    if average == "macro":
        return c.agg(F.avg(each).alias(name))
    return c.agg((F.sum(each * F.col("support")) / F.sum("support")).alias(name))


def roc_auc(df: DataFrame, average: str = "macro") -> DataFrame:
    """One-vs-rest area under the curve, ties counted half: rows are grouped by class and score before any order is made.

    df has y and s, an array of scores a class.
    """
    rows = df.select("y", F.posexplode("s").alias("class", "score"))
    grouped = rows.groupBy("class", "score").agg(F.sum((F.col("y") == F.col("class")).cast("bigint")).alias("pos"), F.count("*").alias("n"))
    below = F.sum(F.col("n") - F.col("pos")).over(Window.partitionBy("class").orderBy("score")) - (F.col("n") - F.col("pos"))
    parts = grouped.withColumn("won", F.col("pos") * (below + (F.col("n") - F.col("pos")) / 2))
    each = parts.groupBy("class").agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum(F.col("n") - F.col("pos")).alias("neg")).where("pos > 0 and neg > 0")
    auc = F.col("won") / (F.col("pos").cast("double") * F.col("neg"))
    if average == "weighted":
        return each.agg((F.sum(auc * F.col("pos")) / F.sum("pos")).alias("roc_auc"))
    return each.agg(F.avg(auc).alias("roc_auc"))


def weighted_average(df: DataFrame, value: str, weight: str) -> DataFrame:
    """Mean of batch metrics weighted by batch sizes."""
    return df.agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(value))


class Evaluator:
    """Metrics by name over columns y and p; framework picks the median's variant."""

    def __init__(self, framework: str = "pytorch"):
        self.median = {"pytorch": "lower", "sklearn": "middle", "tensorflow": "upper"}[framework]

    def get_metrics(self, names: list[str], average: str = "macro", delta: float = 1.0) -> dict[str, Callable[[DataFrame], DataFrame]]:
        """KeyError for an unknown name."""
        special = {"huber_loss": partial(huber, delta)}
        tables = {"roc_auc": partial(roc_auc, average=average), "cross_entropy": cross_entropy, "med_ae": partial(median_ae, kind=self.median), **{m: partial(averaged, metric=m, average=average) for m in ("precision", "recall", "f1")}}
        return {n: tables[n] if n in tables else partial(_one, n, special.get(n) or REGRESSION[n]) for n in names}


def _one(name: str, metric: Callable[[], Column], df: DataFrame) -> DataFrame:
    return df.agg(metric().alias(name))
