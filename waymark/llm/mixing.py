"""Mixing sources to target weights down a tree such as domain, language, source, in DataFrame operations only.

A budget of tokens enters at the root. Every node shares what it gets among its children by weight; a child takes no
more than its whole subtree can give, `epochs` passes over its documents, and what it leaves goes to its siblings by
weight. Only where all children of a node are exhausted does the rest go to the node's own siblings, so a shortage is
made up as near to its leaf as possible. All sums are whole numbers; shares round down.

A leaf reads its documents epoch by epoch, each time in the order of a hash of seed, epoch and doc_id (of the text, where
that is null), and takes the
prefix that fills its quota, cutting the last document. The prefix is found without sorting a leaf: token sums of 65,536
ranges of the hash locate the range in which the quota ends, and only that range is ordered.

Cases: a null level counts as an empty name. Null text counts as empty; every document has at least one token (bytes / 4
rounded up, and one). Repeated rows are drawn each; equal doc_ids follow each other, by tokens and a digest of the text, so
the draw does not depend on the order of the rows. No rows, no budget or a weight of zero give no rows. `draw` passes
other columns through, whatever their names, but replaces those it adds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.llm.common import stage, work_dir

#: Columns that `draw` adds: tokens of the document, the pass, tokens taken.
TOKENS, EPOCH, TAKEN = "mix_tokens", "mix_epoch", "mix_taken"
SEED, EPOCHS = 17, 3


def tokens(text: str = "text") -> Column:
    """A document's tokens, estimated by its size: a quarter of its bytes, rounded up, and the end."""
    return F.expr(f"(octet_length(coalesce({text}, '')) + 3) div 4 + 1")


def _whole(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(19,0)")


def _shared(nodes: DataFrame, parent: Sequence[str], own: Sequence[str]) -> DataFrame:
    """Add `quota`, the node's part of its parent's `budget`, from `weight` and the greatest amount `most`."""
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    by_need = siblings.orderBy(F.col("most") / F.col("weight"), *own)
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0)), F.lit(0))
    weights = F.sum("weight").over(siblings) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    full = _whole("most") * _whole(weights) <= _whole(left) * _whole("weight")
    nodes = nodes.where("weight > 0").withColumn("_full", full)
    rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("most"))).over(siblings), F.lit(0))
    among = F.coalesce(F.sum(F.when(~F.col("_full"), F.col("weight"))).over(siblings), F.lit(0))
    nodes = nodes.withColumn("_part", _whole(rest) * _whole("weight")).withColumn("_among", _whole(among))
    return nodes.withColumn("quota", F.when(F.col("_full"), F.col("most")).otherwise(F.expr("_part div _among")))


def quotas(leaves: DataFrame, levels: Sequence[str], weights: Sequence[Column], budget: int, epochs: int) -> DataFrame:
    """The leaves with `quota`. `leaves` has the levels and `supply`; `weights` are whole numbers, one rule per level."""
    leaves = leaves.withColumn("most", F.col("supply") * epochs)
    given = None
    for depth, weight in enumerate(weights):
        parent, own = list(levels[:depth]), list(levels[: depth + 1])
        nodes = leaves.groupBy(*own).agg(F.sum("most").alias("most")).withColumn("weight", weight.cast("long"))
        nodes = nodes.withColumn("budget", F.lit(budget).cast("long")) if given is None else nodes.join(given, parent)
        given = _shared(nodes, parent, own).select(*own, F.col("quota").alias("budget"))
    return leaves.join(given.withColumnRenamed("budget", "quota"), list(levels)).drop("most")


def draw(
    docs: DataFrame, levels: Sequence[str], weights: Sequence[Column], share: float, seed: int = SEED, epochs: int = EPOCHS
) -> DataFrame:
    """The documents drawn, once per pass, with TOKENS, EPOCH and TAKEN. The budget is this share of all tokens."""
    spark = docs.sparkSession
    folder = work_dir(spark, "mixing")
    given = docs.drop(TOKENS, EPOCH, TAKEN)
    # the caller's columns travel in one, so that none can clash with those used here
    named = [F.coalesce(F.col(level).cast("string"), F.lit("")).alias(f"mix_{n}") for n, level in enumerate(levels)]
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("mix_text")
    identity = F.col("doc_id").cast("string").alias("mix_id")
    rows = given.select(F.struct(*given.columns).alias("mix_row"), *named, identity, text, tokens().alias(TOKENS))
    own = [f"mix_{n}" for n in range(len(levels))]
    leaves = stage(rows.groupBy(*own).agg(F.sum(TOKENS).alias("supply")), folder, "leaves")
    whole = leaves.agg(F.sum("supply")).first()[0] or 0
    plan = quotas(leaves, own, weights, int(whole * share), epochs)
    plan = plan.withColumn("mix_full", F.expr("quota div supply")).withColumn("mix_part", F.expr("quota % supply"))
    plan = stage(plan.select(*own, "mix_full", "mix_part"), folder, "plan")

    # where the last, partial pass of each leaf ends
    keyed = rows.join(plan, own)
    key = F.md5(F.concat_ws("|", F.lit(seed), "mix_full", F.coalesce("mix_id", "mix_text")))
    keyed = keyed.withColumn("mix_key", key).withColumn("mix_range", F.conv(F.substring("mix_key", 1, 4), 16, 10).cast("int"))
    sums = keyed.where("mix_part > 0").groupBy(*own, "mix_range", "mix_part").agg(F.sum(TOKENS).alias("mix_sum"))
    ordered = Window.partitionBy(*own).orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("mix_before", F.coalesce(F.sum("mix_sum").over(ordered), F.lit(0)))
    ends = sums.where("mix_before < mix_part AND mix_before + mix_sum >= mix_part")
    ends = stage(ends.select(*own, F.col("mix_range").alias("mix_end"), "mix_before"), folder, "ends")

    passes = keyed.where("mix_full > 0").withColumn(EPOCH, F.explode(F.sequence(F.lit(0), F.col("mix_full").cast("int") - 1)))
    passes = passes.withColumn(TAKEN, F.col(TOKENS))
    last = keyed.where("mix_part > 0").join(ends, own).withColumn(EPOCH, F.col("mix_full").cast("int"))
    inside = last.where("mix_range < mix_end").withColumn(TAKEN, F.col(TOKENS))
    in_order = Window.partitionBy(*own).orderBy("mix_key", F.col("mix_row.doc_id"), TOKENS, "mix_text")
    before = F.coalesce(F.sum(TOKENS).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = last.where("mix_range = mix_end").withColumn("mix_left", F.col("mix_part") - F.col("mix_before") - before)
    edge = edge.where("mix_left > 0").withColumn(TAKEN, F.least(TOKENS, "mix_left"))
    columns = ["mix_row.*", TOKENS, EPOCH, TAKEN]
    return passes.select(*columns).unionByName(inside.select(*columns)).unionByName(edge.select(*columns))
