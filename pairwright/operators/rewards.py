"""Preference losses and rewards over stored log-probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.numbers import finite, share, softplus
from pairwright.operators.guards import require

LOGPS = ("policy_chosen", "policy_rejected", "reference_chosen", "reference_rejected")


def dpo_rows(df: DataFrame, beta: float, label_smoothing: float = 0.0, normalization: str = "sum") -> DataFrame:
    """loss, rewards and margin of each row of log-probabilities (LOGPS; for "mean" also token counts)."""
    if beta < 0 or not 0 <= label_smoothing < 0.5:
        raise ValueError("beta or label smoothing out of range")
    pc, pr, rc, rr = (F.col(c).cast("double") for c in LOGPS)
    df = require(df, finite(pc) & finite(pr) & finite(rc) & finite(rr), "a log-probability is not finite")
    if normalization == "mean":
        df = require(df, (F.col("chosen_tokens") > 0) & (F.col("rejected_tokens") > 0), "a completion has no tokens")
        pc, rc, pr, rr = pc / F.col("chosen_tokens"), rc / F.col("chosen_tokens"), pr / F.col("rejected_tokens"), rr / F.col("rejected_tokens")
    scaled = F.lit(beta) * ((pc - pr) - (rc - rr))
    loss = softplus(-scaled) if not label_smoothing else (1 - label_smoothing) * softplus(-scaled) + label_smoothing * softplus(scaled)
    chosen, rejected = beta * (pc - rc), beta * (pr - rr)
    return df.withColumns({"loss": loss, "chosen_reward": chosen, "rejected_reward": rejected, "reward_margin": chosen - rejected})


def dpo_metrics(df: DataFrame, beta: float, label_smoothing: float = 0.0, normalization: str = "sum", by: str | None = None) -> DataFrame:
    """Means of loss, rewards and margin, and the part of rows with a margin over zero."""
    rows = dpo_rows(df, beta, label_smoothing, normalization)
    keys = [by] if by else []
    means = [F.avg(c).alias(c) for c in ("loss", "chosen_reward", "rejected_reward", "reward_margin")]
    return rows.groupBy(*keys).agg(*means, share(F.col("reward_margin") > 0).alias("reward_accuracy"))


def anchored_loss(df: DataFrame, dpo_loss: Column, weight: float) -> DataFrame:
    """dpo_loss, chosen_sft_loss and their weighted sum over chosen log-probabilities and token counts."""
    if weight < 0:
        raise ValueError("the weight of chosen responses is negative")
    df = require(df, finite(F.col("policy_chosen")) & (F.col("chosen_tokens") > 0), "a chosen response has no finite log-probability or no tokens")
    anchor = F.avg(-F.col("policy_chosen") / F.col("chosen_tokens"))
    return df.agg(dpo_loss.alias("dpo_loss"), anchor.alias("chosen_sft_loss")).withColumn("loss", F.col("dpo_loss") + weight * F.col("chosen_sft_loss"))


def sequence_logp(logits: Column, targets: Column, mask: Column) -> Column:
    """struct<logp, tokens> from logits array<array<double>>, target places and a 0/1 mask."""
    top = lambda row: F.array_max(row)
    log_sum = lambda row: top(row) + F.log(F.aggregate(row, F.lit(0.0), lambda s, v: s + F.exp(v - top(row))))
    rows = F.arrays_zip(logits.alias("l"), targets.alias("t"), mask.alias("m"))
    picked = F.transform(rows, lambda r: F.element_at(r["l"], r["t"].cast("int") + 1) - log_sum(r["l"]))
    total = F.aggregate(F.zip_with(picked, mask, lambda p, m: p * m), F.lit(0.0), lambda s, v: s + v)
    tokens = F.aggregate(mask, F.lit(0), lambda s, v: s + v.cast("int"))
    return F.struct(F.when(tokens > 0, total).otherwise(F.raise_error(F.lit("a sequence has no completion to score"))).alias("logp"), tokens.alias("tokens"))


def promotion(metrics: DataFrame) -> DataFrame:
    """Whether a trained policy passes: margin grown and over zero, accuracy at least 0.6, adapter changed.

    metrics: initial_margin, final_margin, reward_accuracy, initial_hash, final_hash.
    """
    ok = (F.col("final_margin") > F.col("initial_margin")) & (F.col("final_margin") > 0) & (F.col("reward_accuracy") >= 0.6) & (F.col("final_hash") != F.col("initial_hash"))
    return metrics.withColumn("promoted", F.coalesce(ok, F.lit(False)))
