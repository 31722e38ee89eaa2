"""From scores, rules and model answers to decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.joins import attach

KEYS = ["dataset", "category"]


def decide(test: DataFrame, thresholds: DataFrame, keys=KEYS) -> DataFrame:
    """Anomalous when the score exceeds the category's threshold; categories without one are left out."""
    return (
        attach(test, thresholds.select(*keys, "threshold"), keys)
        .withColumn("prediction", (F.col("score") > F.col("threshold")).cast("int"))
        .withColumn("correct", F.col("prediction") == F.col("label"))
    )


def verifier_prediction(raw: Column, fallback: Column) -> Column:
    """Verifier output as 0/1; unusable output falls back to the threshold decision."""
    return F.coalesce((raw.try_cast("int") != 0).cast("int"), fallback)


def fuse_prediction(threshold_pred: Column, verifier_pred: Column, policy: str = "anomaly_or") -> Column:
    chosen = {
        "replace": verifier_pred,
        "audit": threshold_pred,
        "anomaly_or": F.greatest((threshold_pred != 0).cast("int"), (verifier_pred != 0).cast("int")),
    }
    name = (policy or "anomaly_or").strip().lower()
    if name not in chosen:
        raise ValueError(f"unsupported verifier policy: {policy}")
    return chosen[name]


def answer_keys(options: Column) -> tuple[Column, Column]:
    """Keys of the "yes" and the "no" option of a map column (last one wins)."""

    def last_key(word: str) -> Column:
        entries = F.filter(
            F.map_entries(options),
            lambda e: F.regexp_replace(F.lower(F.trim(F.coalesce(e["value"], F.lit("")))), r"\.+$", "") == word,
        )
        return F.get(F.transform(entries, lambda e: e["key"]), F.size(entries) - 1)

    return last_key("yes"), last_key("no")


def override_answer(
    task: Column,
    options: Column,
    pred_key: Column,
    *,
    regions: Column,
    crops: Column,
    heat: Column,
    threshold: Column,
    report_normal: Column,
    veto: Column,
) -> Column:
    """Audited correction of a yes/no anomaly answer by local evidence (null when not applicable)."""
    yes, no = answer_keys(options)
    applies = (F.lower(F.trim(F.coalesce(task, F.lit("")))) == "anomaly detection") & yes.isNotNull() & no.isNotNull()
    local = (regions > 0) & (crops > 0) & (heat >= threshold)
    gap = threshold - heat
    margin = F.when(threshold > 0, F.greatest(F.lit(0.01), threshold * 0.01)).otherwise(F.lit(0.0))
    clear = (threshold > 0) & (gap >= margin)
    says_yes = pred_key == yes
    vetoed = ~local & says_yes & veto
    below = ~local & says_yes & report_normal & clear
    near = ~local & says_yes & report_normal & (threshold > 0) & (heat < threshold) & ~clear
    kept = ~local | says_yes
    reason = (
        F.when(vetoed, "sam3_normal_part_veto_corrects_yes_to_no")
        .when(below, "clearly_below_threshold_and_normal_phase1_corrects_yes_to_no")
        .when(kept & near, "near_threshold_uncertainty_keeps_original_yes")
        .when(kept & ~local, "no_override_without_stable_local_evidence")
        .when(kept, "already_yes_with_local_evidence")
        .otherwise("stable_local_evidence_corrects_no_to_yes")
    )
    return F.when(
        applies,
        F.struct(
            (vetoed | below | ~kept).alias("applied"),
            F.when(vetoed | below, no).when(kept, pred_key).otherwise(yes).alias("override_key"),
            reason.alias("reason"),
            local.alias("local_evidence"),
            F.round(gap, 6).alias("score_gap"),
            F.round(margin, 6).alias("uncertainty_margin"),
        ),
    )
