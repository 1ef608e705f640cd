"""Mixing sources to target shares of the total size."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tokens import VOCABULARY, sizes
from tessera.staging import stage


def source_key(name: Column) -> Column:
    """Sources are the same whatever their case, outer blanks and ``-`` for ``_``."""
    return F.translate(F.lower(F.trim(name)), "-", "_")


@dataclass(frozen=True)
class Mixture:
    """``copies``: ``(id, source, n_tokens, copies)`` of the documents used at least once.

    ``report``: a row per target: ``source, target_share, max_repeats, source_tokens, rate`` (copies per document), ``mixed_tokens,
    actual_share`` (of the mixture), ``missed`` (target less actual share), ``short`` (even ``max_repeats`` times its content is less than
    its share of the total), ``wanted_total`` (tokens the mixture was to have), ``reachable_total`` (the most at which no source
    is short) and ``offset`` (the random offset)."""

    copies: DataFrame
    report: DataFrame

    def rows(self) -> DataFrame:
        """``(id, source, copy)``: one row per use of a document."""
        return self.copies.select("id", "source", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))


def mix(df: DataFrame, id_col: str, text_col: str, source_col: str, targets: DataFrame, seed: int = 42, within_reach: bool = False, vocabulary: str = VOCABULARY) -> Mixture:
    """Copies of documents such that each source of ``targets`` ``(source, target_share, max_repeats)`` has its share.

    The size of the mixture is that of all texts or, with ``within_reach``, the largest up to it at which every source can give its
    share, so that all targets hold.  A source's documents are expected ``rate`` times each, the target's tokens
    over the source's, at most ``max_repeats``.  Systematic sampling: with the prefix sums of the expected copies in a fixed order
    within the source and one random offset, drawn once from ``seed``, a document is emitted once per integer its interval crosses, which is ``rate`` rounded up
    or down; so no document is used more than ``max_repeats`` times.

    The prefix sum has two levels, so that a source with a third of all rows is no single task: rows are ranked
    within ``(source, split)``, by size, and the splits' counts are summed beforehand.  Sizes are staged once, which also fixes
    the splits if an executor is lost.

    Documents of a null or unlisted source count in the total only; null and empty texts have no tokens and are not used.
    Repeated targets are an error; an empty table gives zero shares.
    """
    target = targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("bigint").alias("max_repeats"))
    target = stage(target.where("source is not null"), "targets")
    if target.groupBy("source").count().where("count > 1").head(1):
        raise ValueError("a source has two targets")
    sized = sizes(df, id_col, text_col, vocabulary, source=source_col)
    sized = stage(sized.select("id", "n_tokens", source_key(F.col("source")).alias("source"), F.spark_partition_id().alias("split")), "sizes")
    per_split = stage(sized.groupBy("source", "split").agg(F.count(F.when(F.col("n_tokens") > 0, 1)).alias("n"), F.sum("n_tokens").alias("tokens")), "splits")
    total = per_split.agg(F.sum("tokens")).first()[0] or 0
    own = per_split.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    offset = random.Random(seed).random()
    plan = target.join(own, "source", "left").withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0).cast("bigint")))
    most = F.col("source_tokens") * F.col("max_repeats")
    reach = plan.where("target_share > 0").agg(F.min(most / F.col("target_share"))).first()[0] or 0.0
    size = min(float(total), reach) if within_reach else float(total)
    wanted = F.col("target_share") * F.lit(size)
    plan = stage(
        plan.withColumn("rate", F.coalesce(F.least(F.try_divide(wanted, F.col("source_tokens")), F.col("max_repeats").cast("double")), F.lit(0.0))).withColumn(
            "short", most < F.col("target_share") * F.lit(float(total))
        ),
        "plan",
    )
    before = Window.partitionBy("source").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_split.where("source is not null").select("source", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # the rates of the few targets, with the offsets of their splits: one row per source and split
    start = offsets.join(plan.select("source", "rate"), "source")
    rank = F.row_number().over(Window.partitionBy("source", "split").orderBy("n_tokens", "id"))
    ranked = sized.where("source is not null and n_tokens > 0").withColumn("r", rank).join(start, ["source", "split"])
    last = (F.col("base") + F.col("r")) * F.col("rate") + offset
    copies = (F.floor(last) - F.floor((F.col("base") + F.col("r") - 1) * F.col("rate") + offset)).alias("copies")
    used = stage(ranked.select("id", "source", "n_tokens", copies).where("copies > 0"), "mixture")
    mixed = used.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"))
    whole = mixed.agg(F.sum("mixed_tokens")).first()[0] or 0
    report = plan.join(mixed, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0).cast("bigint")))
    share = F.coalesce(F.try_divide(F.col("mixed_tokens"), F.lit(float(whole))), F.lit(0.0))
    names = ["source", "target_share", "max_repeats", "source_tokens", "rate", "mixed_tokens", "actual_share"]
    told = [(F.col("target_share") - F.col("actual_share")).alias("missed"), "short", F.lit(size).alias("wanted_total"), F.lit(float(reach)).alias("reachable_total"), F.lit(offset).alias("offset")]
    return Mixture(used, report.withColumn("actual_share", share).select(*names, *told))
