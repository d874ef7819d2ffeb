"""Evaluation metrics over prediction tables, native aggregates and windows throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geosweep.functions import scoring


#: Score ranges by which a label's curve is dealt to tasks.
RANGES = 4096


def precision_recall(preds: DataFrame, truth_counts: DataFrame, label: str = "label") -> DataFrame:
    """Running precision and recall of each label by falling score (ties by pred_id).

    Counts run within score ranges, in parallel, on top of the totals of the ranges before; only
    those totals, at most RANGES per label, are summed in one window.
    """
    part = F.greatest(F.lit(-RANGES), F.least(F.lit(RANGES), F.floor(-F.col("score") * RANGES)))
    rows = preds.select(label, "score", "pred_id", F.col("is_tp").cast("long").alias("hit"), part.alias("__part"))
    before = Window.partitionBy(label).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(label, "__part").agg(F.sum("hit").alias("tp0"), F.count(F.lit(1)).alias("n0"))
    totals = totals.select(label, "__part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("tp0", "n0")))
    w = Window.partitionBy(label, "__part").orderBy(F.desc("score"), "pred_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.select(label, "__part", "score", "pred_id", F.sum("hit").over(w).alias("tp"), F.count(F.lit(1)).over(w).alias("n"))
    run = run.join(totals, [label, "__part"]).withColumn("tp", F.col("tp") + F.col("tp0")).withColumn("n", F.col("n") + F.col("n0"))
    return run.join(truth_counts, label).select(label, "pred_id", "score", (F.col("tp") / F.col("n")).alias("precision"), (F.col("tp") / F.col("n_gt")).alias("recall"), "tp", "n")


def average_precision(curve: DataFrame, label: str = "label", points: int | None = 11) -> DataFrame:
    """AP per label: mean of the best precision at recalls 0, 0.1, ... 1, or (None) the area under the envelope."""
    if points:
        # the best precision of each tenth of recall, then of all tenths from there on
        steps = F.array(*(F.lit(k / (points - 1)) for k in range(points)))
        reached = F.size(F.filter(steps, lambda at: F.col("recall") >= at))
        tenth = curve.groupBy(label, reached.alias("reached")).agg(F.max("precision").alias("p"))
        listed = tenth.groupBy(label).agg(F.collect_list(F.struct("reached", "p")).alias("best"))  # points + 1 entries at most
        at = lambda k: F.coalesce(F.array_max(F.transform(F.filter("best", lambda b: b.reached > k), lambda b: b.p)), F.lit(0.0))
        return listed.select(label, (sum((at(k) for k in range(1, points)), at(0)) / points).alias("ap"))
    # only where hits are does recall grow: the envelope there, from the far end, by score ranges as above
    part = F.greatest(F.lit(-RANGES), F.least(F.lit(RANGES), F.floor(-F.col("score") * RANGES)))
    rows = curve.withColumn("__part", part)
    after = Window.partitionBy(label).orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(label, "__part").agg(F.max("precision").alias("m"))
    tops = tops.select(label, "__part", F.coalesce(F.max("m").over(after), F.lit(0.0)).alias("beyond"))
    w = Window.partitionBy(label, "__part").orderBy(F.desc("n"))
    envelope = F.max("precision").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # the row before in the curve has one prediction less: its hits follow from this row's own
    step = rows.withColumn("envelope", envelope).join(tops, [label, "__part"]).withColumn("envelope", F.greatest("envelope", "beyond"))
    hit = F.col("tp") - F.coalesce(F.lag("tp").over(Window.partitionBy(label, "__part").orderBy("n")), F.col("tp0"))
    firsts = rows.groupBy(label, "__part").agg(F.max("tp").alias("last"))
    base = firsts.select(label, "__part", F.coalesce(F.max("last").over(Window.partitionBy(label).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("tp0"))
    gain = hit * F.when(F.col("tp") > 0, F.col("recall") / F.col("tp")).otherwise(F.lit(0.0))
    return step.join(base, [label, "__part"]).withColumn("gain", gain).groupBy(label).agg(F.sum(F.col("gain") * F.col("envelope")).alias("ap"))


def box_metrics(preds: DataFrame, truth_counts: DataFrame, label: str = "label") -> DataFrame:
    """Precision, recall and F1 per label of the truth."""
    p = preds.groupBy(label).agg(F.sum(F.col("is_tp").cast("long")).alias("tp"), F.count(F.lit(1)).alias("n"))
    m = truth_counts.join(p, label, "left").na.fill(0, ["tp", "n"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    m = m.withColumn("precision", ratio(F.col("tp"), F.col("n"))).withColumn("recall", ratio(F.col("tp"), F.col("n_gt")))
    return m.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def calibration_bins(preds: DataFrame, bins: int = 15) -> DataFrame:
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    out = preds.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("confidence"), F.avg(F.col("is_tp").cast("double")).alias("accuracy"))
    return out.withColumn("gap", F.abs(F.col("confidence") - F.col("accuracy")))


def expected_calibration_error(preds: DataFrame, bins: int = 15) -> DataFrame:
    return calibration_bins(preds, bins).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def fit_temperature(preds: DataFrame) -> DataFrame:
    """Temperature of least log loss on the grid 0.25, 0.30 ... 4.20 and 1; 1 wins ties, then the smallest."""
    grid = preds.sparkSession.range(80).select(F.round(0.25 + 0.05 * F.col("id"), 2).alias("t"))
    grid = grid.unionByName(preds.sparkSession.range(1).select(F.lit(1.0).alias("t"))).distinct()
    p = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), scoring.calibrate("score", "t")))
    loss = preds.crossJoin(F.broadcast(grid)).groupBy("t").agg(F.sum(-F.when(F.col("is_tp"), F.log(p)).otherwise(F.log(1 - p))).alias("nll"))
    return loss.orderBy(F.round("nll", 6), F.col("t") != 1.0, "t").limit(1)


def ranking_quality(ranked: DataFrame, k: int = 5) -> DataFrame:
    """Top-1, top-k and mean reciprocal rank of (query, rank, hit) rows."""
    per = ranked.groupBy("query").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"))
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return per.agg(share(F.col("first") == 1).alias("top1"), share(F.col("first") <= k).alias("topk"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"), F.count(F.lit(1)).alias("n"))


def regression_gate(base: DataFrame, new: DataFrame, key: str, metric: str, tolerance: float) -> DataFrame:
    """Keys whose metric fell by more than the tolerance, or vanished."""
    j = base.select(key, F.col(metric).alias("before")).join(new.select(key, F.col(metric).alias("after")), key, "left")
    return j.where(F.round(F.coalesce(F.col("after"), F.lit(0.0)), 9) < F.round(F.col("before") - tolerance, 9))


def separation(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """Mean similarity of unit vectors within and between labels, from per-label sums alone.

    The sum over all pairs of dot products is the squared length of the sum, so no pair is formed.
    """
    unit = F.transform(vector, lambda x: x.cast("double") / F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))))
    parts = vectors.select(label, F.posexplode(unit).alias("pos", "v")).groupBy(label, "pos").agg(F.sum("v").alias("s"))
    within = parts.groupBy(label).agg(F.sum(F.col("s") * F.col("s")).alias("ss")).join(vectors.groupBy(label).agg(F.count(F.lit(1)).alias("n")), label)
    all_ = parts.groupBy("pos").agg(F.sum("s").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("total"))
    agg = within.agg(F.sum("ss").alias("ss"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    out = agg.crossJoin(all_).select(((F.col("ss") - F.col("n")) / (F.col("nn") - F.col("n"))).alias("intra"), ((F.col("total") - F.col("ss")) / (F.col("n") * F.col("n") - F.col("nn"))).alias("inter"))
    return out.withColumn("separation", F.col("intra") - F.col("inter"))


def latency(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Median and nearest-rank 95th percentile per key, of keys of any size."""
    from geosweep.operators.quantiles import quantiles

    return quantiles(rows, [key], value, {"p50": 0.5}, {"p95": 0.95}).drop("n")
