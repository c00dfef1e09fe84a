"""Draw records so that every source has its target share of the total size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.running import running_sums
from ..plans.stages import write_stage


def draw_mixture(sized: DataFrame, targets: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``sized(id, source, size, weight)``, ``targets(source, target_share, max_repeats)`` -> ``(draw, report)``.

    Each source is to contribute ``target_share`` of the size of *all* records.  It
    first gives complete epochs (every record once), as many as fit and at most
    ``max_repeats``; the rest is filled with a weighted sample without replacement:
    records in the order of exponential keys ``-ln(u) / weight``
    (Efraimidis-Spirakis), their sizes prefix-summed, taken while the middle of a
    record lies within the budget, so a source misses its target by at most half a
    record unless it runs out of repeats.

    ``draw`` has ``id, source, size, times`` of the records taken; ``report`` one row
    a target source with the shares reached.  A null, zero or negative weight counts
    as 1e-6; records without size, with a null source or one without a target are
    never drawn but count in the total; a null share or repeat count is 0.  A source
    given twice in ``targets`` counts once, with its largest values.
    """
    d = sized.select("id", "source", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"), "weight")
    goal = targets.groupBy("source").agg(F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("max_repeats")).filter("source is not null")
    have = d.groupBy("source").agg(F.sum("size").alias("available"), F.count(F.lit(1)).alias("documents"))
    total = have.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("total"))
    plan = goal.join(have, "source", "left").join(F.broadcast(total), how="cross")  # total is one row
    got = F.coalesce("available", F.lit(0))
    want = F.col("target_share") * F.col("total")
    epochs = F.when(got > 0, F.least(F.floor(want / F.greatest(got, F.lit(1))), F.col("max_repeats").cast("long"))).otherwise(F.lit(0).cast("long"))
    plan = plan.select("source", "target_share", "max_repeats", "total", got.alias("available"), F.coalesce("documents", F.lit(0)).alias("documents"), want.alias("target"), epochs.alias("epochs"))
    rest = F.when(F.col("epochs") < F.col("max_repeats"), F.col("target") - F.col("epochs") * F.col("available")).otherwise(F.lit(0.0))
    plan = write_stage(plan.withColumn("rest", rest), "mixplan")
    u = (F.xxhash64("id", F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) + 1) / float(1 << 53)
    weight = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(1e-6))
    keyed = d.join(plan.select("source", "epochs", "rest"), "source").filter("size > 0").withColumn("_key", -F.log(u) / weight)
    run = running_sums(keyed.select("id", "source", "size", "epochs", "rest", "_key"), "source", [F.col("_key"), F.col("id")], "size")
    times = F.col("epochs") + ((F.col("rest") > 0) & (F.col("running") - F.col("size") / 2 <= F.col("rest"))).cast("long")
    draw = write_stage(run.select("id", "source", "size", times.alias("times")).filter("times > 0"), "mixdraw")
    taken = draw.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("taken"), F.count(F.lit(1)).alias("documents_taken"), F.max("times").alias("times_max"))
    all_taken = taken.agg(F.sum("taken").alias("all_taken"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    report = plan.join(taken, "source", "left").join(F.broadcast(all_taken), how="cross").select(
        "source", "target_share", "max_repeats", "documents", "available", "target", "epochs", zero("taken"), zero("documents_taken"), zero("times_max"),
        F.coalesce(F.try_divide("taken", "all_taken"), F.lit(0.0)).alias("actual_share"),
    )
    return draw, report
