"""Evaluation scorecard.

A case passes when its layer is among the expected layers and its validator holds;
validators are data (contains-any / contains-all / minimum length) instead of lambdas.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata import rules as R
from strata.operators import ordered
from strata.operators.vote import side_by_side


def validator(answer: Column, any_of: Column | None = None, all_of: Column | None = None,
              min_len: Column | None = None) -> Column:
    """contains any of / contains all of (lowercased) / longer than min_len."""
    a = F.lower(F.coalesce(answer, F.lit("")))
    ok = F.lit(True)
    if any_of is not None:
        ok = ok & ((F.coalesce(F.size(any_of), F.lit(0)) == 0) | F.exists(any_of, lambda s: a.contains(F.lower(s))))
    if all_of is not None:
        ok = ok & F.forall(F.coalesce(all_of, F.array()), lambda s: a.contains(F.lower(s)))
    if min_len is not None:
        ok = ok & (F.length(F.coalesce(answer, F.lit(""))) > F.coalesce(min_len, F.lit(-1)))
    return ok


def judged(cases: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Cases (keys, category, weight, expected, any_of, all_of, min_len) with ``passed``: the decision's layer is among the
    expected ones and its answer passes the validator."""
    ok = F.array_contains("expected", F.col("layer")) & validator(F.col("answer"), F.col("any_of"), F.col("all_of"), F.col("min_len"))
    return cases.join(decisions.select(*keys, "layer", "answer"), keys).withColumn("passed", F.coalesce(ok, F.lit(False)))


def bursts(events: DataFrame, by: str, ts: str, ok: Column, gap: str) -> DataFrame:
    """(by, start_us, n, n_ok, span_us, points) of every session, events with gaps below ``gap``: full points if all
    succeeded and the mean time is under the bound, fewer if all succeeded, else none."""
    us = F.unix_micros(F.col(ts))
    s = (events.withColumn("__ok", ok).groupBy(by, F.session_window(ts, gap).alias("s"))
         .agg(F.min(us).alias("start_us"), F.count("*").alias("n"), F.count_if("__ok").alias("n_ok"), (F.max(us) - F.min(us)).alias("span_us")).drop("s"))
    fast = F.col("span_us") / F.col("n") < 1000 * R.EVAL_BURST_FAST_MS
    points = F.when(F.col("n") != F.col("n_ok"), 0).when(fast, R.EVAL_BURST_FAST_POINTS).otherwise(R.EVAL_BURST_OK_POINTS)
    return s.withColumn("points", points.cast("int"))


def scorecard(results: DataFrame, category: str = "category", passed: str = "passed",
              weight: str = "weight") -> DataFrame:
    """A5: per category total, passed, weight, earned, pct."""
    g = results.groupBy(category).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(passed)).alias("passed"),
        F.sum(F.col(weight).cast("long")).alias("weight"),
        F.sum(F.when(F.col(passed), F.col(weight).cast("long")).otherwise(F.lit(0))).alias("earned"))
    return g.withColumn("pct", F.expr("(earned * 2000 + weight) div (weight * 2)") / 10.0)


def final_score(results: DataFrame, burst_ok: Column, burst_avg_ms: Column, passed: str = "passed",
                weight: str = "weight") -> DataFrame:
    """earned/total_weight x 90 + burst points (10 if ok and avg < 150 ms, 8 if ok, else 0), round 1."""
    t = results.agg(F.sum(F.col(weight).cast("long")).alias("total_weight"),
                    F.sum(F.when(F.col(passed), F.col(weight).cast("long")).otherwise(0)).alias("earned"))
    pts = (F.when(burst_ok & (burst_avg_ms < R.EVAL_BURST_FAST_MS), F.lit(R.EVAL_BURST_FAST_POINTS))
           .when(burst_ok, F.lit(R.EVAL_BURST_OK_POINTS)).otherwise(F.lit(0)))
    return (t.withColumn("burst_points", pts.cast("int"))
            .withColumn("score", F.round(F.col("earned") / F.col("total_weight") * R.EVAL_FUNCTIONAL_POINTS
                                         + F.col("burst_points"), 1)))


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 3) -> DataFrame:
    """``df`` with ``fold``: a row's place among the rows of its label (by key) modulo ``folds``. Places come from a running
    count over (label, key) in range partitions and the labels' totals, so no task holds a label."""
    placed = ordered.running_totals(df, [label, key], {"__place": F.lit(1)})
    first = ordered.running_totals(df.groupBy(label).agg(F.count("*").alias("__n")), [label], {"__upto": F.col("__n")}).select(
        F.col(label).alias("__label"), (F.col("__upto") - F.col("__n")).alias("__before"))
    out = placed.join(first, F.col(label).eqNullSafe(F.col("__label")))
    return out.select(*df.columns, F.pmod(F.col("__place") - 1 - F.col("__before"), F.lit(folds)).cast("int").alias("fold"))


def cv_results(df: DataFrame, key: str, label: str, fit_predict, folds: int = 3, by: list[str] | None = None) -> DataFrame:
    """(fold, by..., n, correct) of stratified k-fold cross-validation. ``fit_predict(train, test) -> DataFrame(key, by...,
    prediction)``: several models of a fold are told apart by ``by``. The folds are fitted side by side."""
    x = stratified_folds(df, key, label, folds).checkpoint()

    def result(k: int) -> DataFrame:
        test = x.where(F.col("fold") == k)
        return (test.select(key, label).join(fit_predict(x.where(F.col("fold") != k), test), key).groupBy(*(by or []))
                .agg(F.count("*").alias("n"), F.count_if(F.col("prediction") == F.col(label)).alias("correct")).select(F.lit(k).alias("fold"), *(by or []), "n", "correct"))

    return reduce(DataFrame.unionAll, side_by_side(result, range(folds)))


def cv_accuracy(df: DataFrame, key: str, label: str, fit_predict, folds: int = 3, by: list[str] | None = None) -> DataFrame:
    """(fold, by..., accuracy) of stratified k-fold cross-validation; mean and std are the caller's avg and stddev_pop."""
    return cv_results(df, key, label, fit_predict, folds, by).select("fold", *(by or []), (F.col("correct") / F.col("n")).alias("accuracy"))
