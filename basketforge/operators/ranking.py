"""Ranking over score tables (sample_id, item, score), and its evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketforge.operators.sequences import draw


def ranked(scores: DataFrame) -> DataFrame:
    order = Window.partitionBy("sample_id").orderBy(F.desc("score"), "item")
    return scores.withColumn("rank", F.row_number().over(order))


def topk(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best items of each sample; ties go to the smaller item."""
    return ranked(scores).where(F.col("rank") <= k)


def above_threshold(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.where(F.col("score") > threshold)


def sample_from_scores(scores: DataFrame, temperature: float = 1.0, seed: int = 5) -> DataFrame:
    """One item per sample drawn from the softmax of score / temperature (Gumbel maximum)."""
    u = (draw(F.lit(seed), F.col("sample_id"), F.col("item")) * 4294967296.0 + 1) / 4294967297.0
    noisy = F.col("score") / temperature - F.log(-F.log(u))
    return scores.withColumn("noisy", noisy).groupBy("sample_id").agg(F.max_by("item", F.struct("noisy", "item")).alias("item"))


def basket_metrics(scores: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Precision, recall, F1, hit rate and NDCG at each k, averaged over samples with scores."""
    best = topk(scores, max(ks)).join(truth.select("sample_id", "item", F.lit(1.0).alias("hit")), ["sample_id", "item"], "left")
    per = best.groupBy("sample_id").agg(
        *(F.sum(F.when(F.col("rank") <= k, F.coalesce("hit", F.lit(0.0))).otherwise(0.0)).alias(f"h{k}") for k in ks),
        *(F.sum(F.when(F.col("rank") <= k, F.coalesce("hit", F.lit(0.0)) / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"d{k}") for k in ks),
    )
    actual = truth.groupBy("sample_id").agg(F.count("*").alias("n"))
    per = per.join(actual, "sample_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = []
    for k in ks:
        p, rec = F.col(f"h{k}") / k, F.col(f"h{k}") / F.greatest("n", F.lit(1))
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("n", F.lit(k)).cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
        ndcg = F.when(F.col("n") > 0, F.col(f"d{k}") / ideal).otherwise(0.0)
        for name, v in (("precision", p), ("recall", rec), ("f1", 2 * p * rec / (p + rec + 1e-8)), ("hit_rate", (F.col(f"h{k}") > 0).cast("double")), ("ndcg", ndcg)):
            out.append(F.avg(v).alias(f"{name}_{k}"))
    return per.agg(*out)


def target_ranks(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """Rank of each sample's target among its scored items; null where it is not scored."""
    return targets.join(ranked(scores).select("sample_id", F.col("item").alias("target"), "rank"), ["sample_id", "target"], "left")


def _hits(k: int) -> Column:
    return F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0)))


def masked_metrics(scores: DataFrame, targets: DataFrame, by: list[str] = ()) -> DataFrame:
    """Accuracy, hit rates and the reciprocal rank cut at 10, over all masked items, or by columns of ``targets``."""
    df = target_ranks(scores, targets)
    mrr = F.avg(F.when(F.col("rank") <= 10, 1 / F.col("rank")).otherwise(0.0))
    return df.groupBy(*by).agg(F.count("*").alias("items"), _hits(1).alias("accuracy"), _hits(5).alias("hit_at_5"), _hits(10).alias("hit_at_10"), mrr.alias("mrr"))


def store_metrics(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """Accuracy at 1, 3, 5 and 10 and the full reciprocal rank."""
    df = target_ranks(scores, targets)
    return df.agg(*(_hits(k).alias(n) for k, n in ((1, "accuracy"), (3, "top_3_accuracy"), (5, "top_5_accuracy"), (10, "top_10_accuracy"))), F.avg(1 / F.col("rank")).alias("mrr"))


def predictions(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """Best item and target of each sample, with the other columns of ``targets``."""
    best = topk(scores, 1).select("sample_id", F.col("item").alias("predicted"))
    return targets.join(best, "sample_id")


def label_accuracy(pred: DataFrame) -> DataFrame:
    """Accuracy by task; rows of label 0 are unknown and ignored."""
    return pred.where("label <> 0").groupBy("task").agg(F.count("*").alias("n"), F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("accuracy"))


def per_store_metrics(pred: DataFrame) -> DataFrame:
    """Per target: samples, accuracy, and how often it is predicted."""
    made = pred.groupBy(F.col("predicted").alias("store")).agg(F.count("*").alias("times_predicted"))
    real = pred.groupBy(F.col("target").alias("store")).agg(F.count("*").alias("samples"), F.avg((F.col("predicted") == F.col("target")).cast("double")).alias("accuracy"))
    return real.join(made, "store", "left").fillna(0, ["times_predicted"])


def per_store_summary(stores: DataFrame) -> DataFrame:
    return stores.agg(F.avg("accuracy").alias("mean"), F.median("accuracy").alias("median"), F.min("accuracy").alias("lowest"), F.max("accuracy").alias("highest"), F.sum(F.when(F.col("accuracy") == 0, 1).otherwise(0)).alias("zero_stores"))


def transition_metrics(pred: DataFrame) -> DataFrame:
    """Accuracy and share of samples that stay at the previous store, and of those that change."""
    df = pred.withColumn("same_store", F.col("previous") == F.col("target"))
    out = df.groupBy("same_store").agg(F.count("*").alias("samples"), F.avg((F.col("predicted") == F.col("target")).cast("double")).alias("accuracy"))
    total = df.agg(F.count("*").alias("total"))
    return out.crossJoin(F.broadcast(total)).select("same_store", "samples", "accuracy", (F.col("samples") / F.col("total")).alias("share"))


def confusions(pred: DataFrame, k: int = 10) -> DataFrame:
    """The most frequent wrong predictions."""
    wrong = pred.where("predicted <> target").groupBy("predicted", "target").agg(F.count("*").alias("n"))
    return wrong.orderBy(F.desc("n"), "predicted", "target").limit(k)


def prediction_examples(scores: DataFrame, targets: DataFrame, n: int = 10) -> DataFrame:
    """Previous, target and the five best items with probability, for the first ``n`` samples."""
    chosen = targets.orderBy("sample_id").limit(n)
    own = scores.join(F.broadcast(chosen.select("sample_id")), "sample_id", "left_semi")
    # Scores are shifted by the sample's largest, so that no exponential overflows.
    top = own.groupBy("sample_id").agg(F.max("score").alias("top"))
    z = own.join(top, "sample_id").groupBy("sample_id").agg(F.first("top").alias("top"), F.sum(F.exp(F.col("score") - F.col("top"))).alias("z"))
    best = topk(own, 5).join(z, "sample_id").withColumn("p", F.exp(F.col("score") - F.col("top")) / F.col("z"))
    listed = best.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item", "p"))).alias("best"))
    return chosen.join(listed, "sample_id")


def log_loss(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """Mean softmax cross-entropy of the target's score; targets without a score are left out."""
    top = scores.withColumn("top", F.max("score").over(Window.partitionBy("sample_id")))
    z = top.groupBy("sample_id").agg((F.max("top") + F.log(F.sum(F.exp(F.col("score") - F.col("top"))))).alias("z"))
    own = targets.join(scores.toDF("sample_id", "target", "score"), ["sample_id", "target"]).join(z, "sample_id")
    return own.agg(F.avg(F.col("z") - F.col("score")).alias("log_loss"))


def class_weights(samples: DataFrame, column: str, smoothing: float = 0.1) -> DataFrame:
    """(total / count) ^ smoothing per class, scaled to mean 1 over the classes."""
    counts = samples.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    raw = counts.crossJoin(F.broadcast(total)).withColumn("raw", F.pow(F.col("total") / F.col("n"), F.lit(smoothing)))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select(column, "n", (F.col("raw") / F.col("mean")).alias("weight"))
