"""Score curves: ROC, precision-recall, thresholds, calibration, policies. Rows carry a 0/1 label ``y`` and a ``score``.

All curves start from counts per distinct score, ordered by range partitioning, so they hold for any number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarlake.operators.evaluation import f1, ratio
from sonarlake.plans.ordered import exact_quantiles, running_sums
from sonarlake.plans.totals import with_totals


def _by_score(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys, "score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(keys)) if keys else (df.withColumn("_all", F.lit(1)), ["_all"])


def roc_auc(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rank statistic with ties averaged; null if one of the two labels is missing."""
    df, k = _keyed(df, keys)
    run = running_sums(_by_score(df, k), k, ["score"], {"neg_upto": "neg"})
    won = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") + F.col("neg") / 2.0))
    n = F.sum("pos") * F.sum("neg")
    return run.groupBy(*k).agg(F.when(n > 0, won / n).alias("roc_auc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")).drop("_all")


def ovr_auc(df: DataFrame, truth: str = "y_true") -> DataFrame:
    """One-vs-rest AUC per class from ``probs`` with its support; average it plainly (macro) or by support."""
    # the outer form adds no condition on the array, which would work it out again; rows without one are dropped after it
    long = df.select(truth, F.posexplode_outer("probs").alias("cls", "score")).filter("cls IS NOT NULL").withColumn("y", (F.col(truth) == F.col("cls")).cast("int"))
    return roc_auc(long, ["cls"])


def ovr_summary(per_class: DataFrame) -> DataFrame:
    return per_class.agg(F.avg("roc_auc").alias("macro_auc"), (F.sum(F.col("roc_auc") * F.col("n_pos")) / F.sum("n_pos")).alias("weighted_auc"))


def pr_auc(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Average precision: sum of precision times recall step over distinct scores, best first."""
    df, k = _keyed(df, keys)
    run = running_sums(_by_score(df, k), k, [F.col("score").desc()], {"tp": "pos", "fp": "neg"})
    return run.groupBy(*k).agg(F.when(F.sum("pos") > 0, F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("pos")).alias("pr_auc")).drop("_all")


def _metrics(df: DataFrame) -> DataFrame:
    out = df.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
                          "fpr": ratio(F.col("fp"), F.col("fp") + F.col("tn")), "fnr": ratio(F.col("fn"), F.col("fn") + F.col("tp"))})
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def detection_metrics(df: DataFrame, threshold: float) -> DataFrame:
    """Counts and rates when scores above the threshold are called positive."""
    hit, pos = F.col("score") > threshold, F.col("y") == 1
    return _metrics(df.agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"),
                           F.count_if(~hit & ~pos).alias("tn"))).withColumn("threshold", F.lit(float(threshold)))


def threshold_candidates(df: DataFrame, steps: int = 200) -> DataFrame:
    """Distinct percentiles of the negative scores (50 .. 99.9) and of the positive scores (1 .. 99)."""
    lin = lambda lo, hi: [(lo + (hi - lo) * i / (steps - 1)) / 100.0 for i in range(steps)]
    neg = exact_quantiles(df.filter("y = 0"), [], "score", lin(50.0, 99.9), "threshold")
    pos = exact_quantiles(df.filter("y = 1"), [], "score", lin(1.0, 99.0), "threshold")
    return neg.select("threshold").union(pos.select("threshold")).distinct()


def select_threshold(df: DataFrame, max_fpr: float = 0.10, steps: int = 200) -> DataFrame:
    """Candidate with the best F1 among those within the false-positive limit (lowest wins ties).

    If none qualifies, the (1 - limit) quantile of the negative scores. Candidates are placed among the distinct scores
    in the same ordered pass that counts them, so rows are never crossed with candidates.
    """
    cands = threshold_candidates(df, steps)
    fallback = exact_quantiles(df.filter("y = 0"), [], "score", [1.0 - max_fpr], "threshold").select("threshold", F.lit(True).alias("fallback"))
    marks = cands.withColumn("fallback", F.lit(False)).unionByName(fallback)
    counts = _by_score(df, []).select("score", "pos", "neg", F.lit(None).cast("boolean").alias("fallback"), F.lit(0).alias("kind"))
    both = counts.unionByName(marks.select(F.col("threshold").alias("score"), F.lit(0).alias("pos"), F.lit(0).alias("neg"), "fallback", F.lit(1).alias("kind")).select(
        "score", F.col("pos").cast("bigint"), F.col("neg").cast("bigint"), "fallback", "kind"))
    run = running_sums(both.withColumn("_all", F.lit(1)), ["_all"], ["score", "kind", "fallback"], {"fn": "pos", "tn": "neg"})
    totals = counts.agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    m = with_totals(run.filter("kind = 1"), totals).withColumns({"tp": F.col("_p") - F.col("fn"), "fp": F.col("_n") - F.col("tn")})
    m = _metrics(m.select(F.col("score").alias("threshold"), "fallback", "tp", "fp", "fn", "tn"))
    good = (~F.col("fallback")) & (F.col("fpr") <= max_fpr)
    ranked = m.filter(good | F.col("fallback")).agg(F.max(F.struct(
        good.alias("g"), F.when(good, F.col("f1")).alias("f"), (-F.col("threshold")).alias("t"), F.struct(*m.columns).alias("r"))).alias("_m"))
    return ranked.select("_m.r.*")


def calibration_bins(df: DataFrame, bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Reliability bins (the first closed, the others open on the left); empty bins show their midpoint and accuracy 0."""
    df, k = _keyed(df, keys)
    b = F.greatest(F.lit(1), F.ceil(F.col("score") * bins)).cast("int")
    have = df.groupBy(*k, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("conf"), F.avg("y").alias("acc"))
    grid = have.select(*k).distinct().withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    full = grid.join(have, [*k, "bin"], "left").na.fill(0, ["n"])
    return full.withColumns({"conf": F.coalesce("conf", (F.col("bin") - 0.5) / bins), "acc": F.coalesce("acc", F.lit(0.0))}).drop("_all")


def calibration(df: DataFrame, bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Expected and maximum calibration error."""
    gap = F.abs(F.col("acc") - F.col("conf"))
    b = calibration_bins(df, bins, keys)
    return b.groupBy(*keys).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(F.when(F.col("n") > 0, gap).otherwise(F.lit(0.0))).alias("mce"))


def reliability_comparison(df: DataFrame, scaled: Column, bins: int = 10) -> DataFrame:
    """Bins of the raw and of the scaled scores, one table keyed by ``curve``."""
    both = df.select("y", F.explode(F.array(F.struct(F.lit("raw").alias("curve"), F.col("score").alias("score")),
                                            F.struct(F.lit("scaled").alias("curve"), scaled.alias("score")))).alias("_x")).select("y", "_x.*")
    return calibration_bins(both, bins, ["curve"])


def verification_auc(df: DataFrame, n_classes: int, truth: str = "y_true", seed: int = 1, ident: str = "pred_id") -> DataFrame:
    """Can the scores tell the true class from a wrong one? The wrong class is drawn per row by a seeded hash."""
    shift = 1 + F.pmod(F.xxhash64(F.lit(seed), ident), F.lit(n_classes - 1))
    wrong = F.pmod(F.col(truth) + shift, F.lit(n_classes))
    pair = F.array(F.struct(F.lit(1).alias("y"), F.get("probs", F.col(truth).cast("int")).alias("score")),
                   F.struct(F.lit(0).alias("y"), F.get("probs", wrong.cast("int")).alias("score")))
    return roc_auc(df.select(F.inline(pair)))


def select_policy(df: DataFrame, ratios: Sequence[float] = (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0), ranks: Sequence[int] = (3, 5, 8, 12),
                  taus: Sequence[float] = (0.005, 0.01, 0.02, 0.03, 0.05, 0.08), max_flagged: float = 0.10) -> DataFrame:
    """Verification policy from rows (p, rank, ratio, ok): confirm ratio by Youden's J, mismatch rule by errors caught.

    First setting wins ties. If no mismatch rule stays within the limit, the strictest one is used.
    """
    r = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(float(x)).alias("v")) for i, x in enumerate(ratios)])
    conf = df.select("ok", "ratio", F.explode(r).alias("o")).groupBy("o").agg(
        F.avg(F.when(F.col("ok"), (F.col("ratio") >= F.col("o.v")).cast("int"))).alias("a"),
        F.avg(F.when(~F.col("ok"), (F.col("ratio") >= F.col("o.v")).cast("int"))).alias("b"))
    conf = conf.withColumn("j", F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))
    best_c = conf.agg(F.max(F.struct(F.col("j"), (-F.col("o.no")).alias("t"), F.col("o.v").alias("confirm_ratio"))).alias("m")).select(
        F.col("m.confirm_ratio"), F.col("m.j").alias("youden_j"), F.lit(1).alias("_k"))
    combos = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(k).alias("k"), F.lit(float(x)).alias("tau"))
                       for i, (k, x) in enumerate((k, x) for k in ranks for x in taus)])
    flag = ((F.col("rank") >= F.col("o.k")) & (F.col("p") < F.col("o.tau"))).cast("int")
    mis = df.select("ok", "rank", "p", F.explode(combos).alias("o")).groupBy("o").agg(
        F.coalesce(F.avg(F.when(F.col("ok"), flag)), F.lit(0.0)).alias("fp"), F.coalesce(F.avg(F.when(~F.col("ok"), flag)), F.lit(0.0)).alias("tp"))
    best_m = mis.agg(F.max(F.when(F.col("fp") <= max_flagged, F.struct(
        F.col("tp"), (-F.col("o.no")).alias("t"), F.col("o.k").alias("k"), F.col("o.tau").alias("tau"), F.col("fp")))).alias("m")).select(
        F.coalesce("m.k", F.lit(max(ranks))).alias("mismatch_rank"), F.coalesce("m.tau", F.lit(min(taus))).alias("mismatch_p"),
        F.coalesce("m.tp", F.lit(0.0)).alias("errors_flagged"), F.coalesce("m.fp", F.lit(0.0)).alias("correct_flagged"), F.lit(1).alias("_k"))
    return with_totals(best_c.drop("_k"), best_m.drop("_k"))
