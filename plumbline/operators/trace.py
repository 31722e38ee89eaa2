"""Nested audit records from flat counters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def method_trace(columns: dict[str, Column], *, prompt: Column, response: Column, level: str = "method") -> Column:
    """Trace struct with defaults; the full level also keeps the prompt and the raw response."""
    defaults = {
        "heatmap_score": F.lit(0.0),
        "threshold_used": F.lit(0.0),
        "threshold_source": F.lit("unknown"),
        "retrieval_mode": F.lit("full"),
        "phase_1_result": F.lit("N/A"),
        "crop_count": F.lit(0),
        "region_proposal_count": F.lit(0),
    }
    fields = [F.coalesce(columns.get(n, d), d).alias(n) for n, d in defaults.items()]
    fields += [c.alias(n) for n, c in columns.items() if n not in defaults]
    if level.lower() == "full":
        fields += [F.coalesce(prompt, F.lit("")).alias("final_prompt"), F.coalesce(response, F.lit("")).alias("raw_response")]
    return F.struct(*fields)


def with_verifier(trace: Column, *, threshold: Column, verifier: Column, final: Column, policy: str, name: Column) -> Column:
    """Record the threshold decision, the verifier's and the fused one in a trace."""
    word = lambda c: F.when(c != 0, "anomaly").otherwise("normal")
    audit = F.struct(
        F.concat(F.lit(f"{policy}:"), name).alias("policy"),
        threshold.alias("threshold_prediction"),
        verifier.alias("verifier_prediction"),
        final.alias("prediction"),
        word(final).alias("prediction_text"),
        word(verifier).alias("verifier_prediction_text"),
    )
    return trace.withField("threshold_decision", F.struct(threshold.alias("prediction"))).withField("final_decision", audit).withField("prediction", final)
