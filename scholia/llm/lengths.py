"""Exact histogram of encoded lengths, with suffix sums that answer every context limit.

Scale: one pass that counts tokens, one aggregation by length with partial sums (rows: distinct lengths, however many documents), then
sums over the histogram in spans, so that neither documents nor the whole histogram meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import running_sums, stored

SPAN = 1024


def histogram(counts: DataFrame, length: str = "n_tokens") -> DataFrame:
    """One row per length that occurs, from rows with a ``length`` (nulls are left out; an empty table gives no rows).

    n_tokens: the length, also taken as context limit; n_docs: documents of this length; docs_longer, tokens_longer: suffix sums;
    total_tokens: of all documents; kept_tokens: when each document is cut to n_tokens; cut_tokens: what that loses;
    quantile: share of documents of at most this length.
    """
    bars = counts.filter(F.col(length).isNotNull()).groupBy(F.col(length).cast("long").alias("n_tokens")).agg(F.count("*").alias("n_docs"))
    # Written once: what follows reads it several times, and the documents must not be encoded for each.
    bars = stored(bars.withColumn("tokens", F.col("n_docs") * F.col("n_tokens")), "lengths")
    totals = bars.agg(F.sum("n_docs").alias("_docs"), F.sum("tokens").alias("_all"))
    summed = running_sums(bars, "n_tokens", ["n_docs", "tokens"], SPAN, after=True)
    out = summed.join(F.broadcast(totals), F.lit(True))  # one row
    cut = F.col("tokens_after") - F.col("n_docs_after") * F.col("n_tokens")
    return out.select("n_tokens", "n_docs", F.col("n_docs_after").alias("docs_longer"), F.col("tokens_after").alias("tokens_longer"),
                      F.col("_all").alias("total_tokens"), (F.col("_all") - cut).alias("kept_tokens"), cut.alias("cut_tokens"),
                      (1 - F.col("n_docs_after") / F.col("_docs")).alias("quantile"))


def at_limits(bars: DataFrame, limits: DataFrame) -> DataFrame:
    """For every row of ``limits`` (a small table with a column ``context``): total_tokens, kept_tokens, cut_tokens and docs_cut.

    Between two lengths the answer is linear: each document that is longer than the next smaller length keeps more. Nulls are left out; limits below
    every length keep ``context`` tokens of each document, negative ones none.
    """
    wanted = limits.select(F.greatest(F.col("context").cast("long"), F.lit(0)).alias("at"), "context").filter("context is not null").distinct()
    # Sorted limits are few; every length adds to the limits below it, summed before the shuffle.
    longer = (bars.join(F.broadcast(wanted), bars["n_tokens"] > wanted["at"])
              .groupBy("context", "at").agg(F.sum("n_docs").alias("docs_cut"), F.sum(F.col("n_docs") * (F.col("n_tokens") - F.col("at"))).alias("cut_tokens")))
    total = bars.agg(F.coalesce(F.max("total_tokens"), F.lit(0)).alias("total_tokens"))
    return (wanted.join(longer.drop("at"), "context", "left").join(F.broadcast(total), F.lit(True))
            .select("context", "total_tokens", (F.col("total_tokens") - F.coalesce("cut_tokens", F.lit(0))).alias("kept_tokens"),
                    F.coalesce("cut_tokens", F.lit(0)).alias("cut_tokens"), F.coalesce("docs_cut", F.lit(0)).alias("docs_cut")))


def quantile(bars: DataFrame, share: float) -> DataFrame:
    """One row: the smallest length that at least ``share`` of the documents do not exceed; null without documents."""
    return bars.filter(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))
