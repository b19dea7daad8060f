"""Detection quality against known labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ratio(part, whole):
    return F.when(whole > 0, part / whole)


def confusion_metrics(labelled: DataFrame, label: str = "is_attack",
                      flagged: str = "is_anomalous") -> DataFrame:
    """One row: recall, false positive rate, precision and F1 of the flag."""
    hit, miss = F.col(flagged), ~F.col(flagged)
    counts = labelled.agg(
        F.count_if(F.col(label) & hit).alias("tp"),
        F.count_if(~F.col(label) & hit).alias("fp"),
        F.count_if(F.col(label) & miss).alias("fn"),
        F.count_if(~F.col(label) & miss).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "tp", "fp", "fn", "tn",
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(fp, fp + tn).alias("false_positive_rate"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp * 2, tp * 2 + fp + fn).alias("f1"),
    )


def area_under_roc(labelled: DataFrame, label: str = "is_attack",
                   score: str = "anomaly_score") -> DataFrame:
    """One row: area under the ROC curve of the scores at six decimals.

    The ordered pass runs over at most a million and one distinct scores, whatever the
    number of rows; scores that differ only further down count as equal.
    """
    positive = F.col(label)
    per_score = labelled.groupBy(F.round(score, 6).alias("s")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    return area_of_counts(per_score)


def area_of_counts(per_score: DataFrame) -> DataFrame:
    """The area from counts of positive and negative rows of each score (s, pos, neg).

    Products of counts are taken as doubles, since whole numbers of pairs overflow.
    """
    below = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    counted = per_score.select("s", F.col("pos").cast("double"), F.col("neg").cast("double"))
    ranked = counted.withColumn("neg_below", F.coalesce(F.sum("neg").over(below), F.lit(0.0)))
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / F.lit(2.0)))
    return ranked.agg(_ratio(wins, F.sum("pos") * F.sum("neg")).alias("auc"))


def detection_rate(labelled: DataFrame, attack: str = "attack", flagged: str = "is_anomalous") -> DataFrame:
    """Share of every attack kind's rows that were flagged."""
    return labelled.filter(F.col(attack).isNotNull()).groupBy(attack).agg(
        F.count("*").alias("n"), F.avg(F.col(flagged).cast("double")).alias("detection_rate"))
