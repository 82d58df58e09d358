"""Evaluation of scored pixels.

A score table has one row per pixel: `prob` in [0, 1], `target` 0/1, class code columns, and grouping keys such as split,
partition or permuted channel. Everything is a partial aggregate on (keys, class); classes never meet in one task.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilerain.functions.bands import d, predicted
from tilerain.operators.losses import segmentation_losses
from tilerain.operators.ranking import Fold, joined, running_folds, value_levels
from tilerain.schema import CLASS_SYSTEMS, class_group

CELLS = ["tn", "fp", "fn", "tp"]
RATES = ["acc", "prec", "rec", "f1", "iou"]


def confusion(scores: DataFrame, keys: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    pred, hit = predicted(F.col("prob"), threshold), F.col("target")
    return scores.groupBy(*keys).agg(
        F.count_if((hit == 0) & (pred == 0)).alias("tn"), F.count_if((hit == 0) & (pred == 1)).alias("fp"),
        F.count_if((hit == 1) & (pred == 0)).alias("fn"), F.count_if((hit == 1) & (pred == 1)).alias("tp"))


def _rates(undefined: Column) -> list[Column]:
    tn, fp, fn, tp = (F.col(c).cast("double") for c in CELLS)

    def share(up: Column, down: Column, name: str) -> Column:
        return F.when(down > 0, up / down).otherwise(undefined).alias(name)

    return [share(tp + tn, tn + fp + fn + tp, "acc"), share(tp, tp + fp, "prec"), share(tp, tp + fn, "rec"),
            share(2 * tp, 2 * tp + fp + fn, "f1"), share(tp, tp + fp + fn, "iou")]


def group_rates() -> list[Column]:
    """Per-class and per-group rates: NULL where the denominator is 0."""
    return _rates(F.lit(None).cast("double"))


def core_rates() -> list[Column]:
    """Overall rates: 0 where the denominator is 0."""
    return _rates(d(0))


def confusion_by_class(scores: DataFrame, system: str, keys: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """One row per (keys, class) with zeros for classes that never occur.

    The counts of one key are at most one struct per class code, so they are folded into a map and read back per class.
    """
    counts = confusion(scores.where(F.col(system).isNotNull()), [*keys, F.col(system).cast("int").alias("code")], threshold)
    folded = counts.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("code", F.struct(*CELLS).alias("cells")))).alias("_by_code"))
    codes = F.array(*[F.lit(c) for c in CLASS_SYSTEMS[system][0]])
    cells = F.try_element_at(F.col("_by_code"), F.col("code"))
    return folded.select(*keys, F.explode(codes).alias("code"), "_by_code").select(
        *keys, "code", *[F.coalesce(cells[c], F.lit(0).cast("bigint")).alias(c) for c in CELLS])


def group_of(code: Column, system: str) -> Column:
    """Group name of a class code, NULL outside all groups; a literal map instead of a join."""
    pairs = [F.lit(v) for item in class_group(system).items() for v in item]
    return F.try_element_at(F.create_map(*pairs), code.cast("int"))


def confusion_by_group(scores: DataFrame, system: str, keys: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """Group sums of the class counts with rates; classes outside groups drop out."""
    per_class = confusion_by_class(scores, system, keys, threshold)
    return (per_class.withColumn("class_group", group_of(F.col("code"), system)).where(F.col("class_group").isNotNull())
            .groupBy(*keys, "class_group").agg(*[F.sum(c).alias(c) for c in CELLS])
            .select(*keys, "class_group", *CELLS, *group_rates()))


def confusion_levels(scores: DataFrame, system: str, threshold: float = 0.5) -> DataFrame:
    """Class, group and overall rows from one pass, as grouping sets over the per-class counts."""
    counts = confusion(scores, [F.col(system).cast("int").alias("code")], threshold)
    named = counts.withColumn("class_group", group_of(F.col("code"), system))
    return (named.groupingSets([["code", "class_group"], ["class_group"], []], "code", "class_group")
            .agg(F.grouping_id().alias("level"), *[F.sum(c).alias(c) for c in CELLS])
            .where((F.col("level") != 2) | F.col("class_group").isNotNull())
            .select(F.when(F.col("level") == 0, "class").when(F.col("level") == 2, "group").otherwise("overall")
                    .alias("scope"), "code", "class_group", *CELLS, *group_rates()))


def auprc(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Exact area under the precision-recall curve over distinct scores, NULL without positives.

    Rows with a NULL key (a class outside all groups) are left out.

    Pixels collapse to one row per distinct score before any ordering; the running totals use nested score buckets.
    """
    curve = scores.groupBy(*keys, "prob").agg(F.sum(F.col("target").cast("bigint")).alias("pos"),
                                              F.count(F.lit(1)).alias("n"))
    falling = -F.col("prob")
    run = running_folds(curve, keys, value_levels(falling), falling, {
        "pos_upto": Fold("sum", F.col("pos"), inclusive=True), "n_upto": Fold("sum", F.col("n"), inclusive=True)})
    precision = F.col("pos_upto") / F.col("n_upto")
    weighted = F.sum(F.col("pos") * precision) / F.nullif(F.sum("pos"), F.lit(0))
    return run.groupBy(*keys).agg(weighted.alias("auprc"))


def core_row(scores: DataFrame, losses: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Loss, accuracy, precision, recall, F1, IoU and AUPRC per (keys); `losses` has (keys, loss)."""
    rates = confusion(scores, keys).select(*keys, *core_rates())
    area = auprc(scores, keys)
    row = joined(rates, area, keys)
    return row if losses is None else joined(row, losses, keys)


def permutation_importance(scores: DataFrame, losses: DataFrame | None = None, baseline: str = "none", channel: str = "channel") -> DataFrame:
    """Confusion cells, core rates and, from `losses` (channel, loss), the loss per permuted channel, and the change of rates and
    loss against the unpermuted run."""
    rates = confusion(scores, [channel]).select(channel, *CELLS, *core_rates())
    measures = [*RATES]
    if losses is not None:
        rates, measures = rates.join(losses.select(channel, "loss"), channel), [*RATES, "loss"]
    # one row per channel by now, so a single group holds the whole table
    every = Window.partitionBy(F.lit(0))
    base = {r: F.max(F.when(F.col(channel) == baseline, F.col(r))).over(every) for r in measures}
    return rates.select(channel, *CELLS, *measures, *[(F.col(r) - base[r]).alias(f"delta_{r}") for r in measures])


def mean_batch_loss(pixels: DataFrame, keys: Sequence[str], batch: str, logit: str, target: str, loss: str = "bce_dice",
                    pos_weight: float = 1.0) -> DataFrame:
    """(keys, loss): the mean over batches of a loss that is taken of each batch as a whole."""
    per = segmentation_losses(pixels, [*keys, batch], logit, target, pos_weight)
    return per.groupBy(*keys).agg(F.avg(loss).alias("loss"))


def permutation_groups(scores: DataFrame, systems: Sequence[str] = ("nlcd", "scl"), channel: str = "channel") -> DataFrame:
    """(channel, system, class_group, cells, rates): the group metrics of every class system for each permuted channel."""
    parts = [confusion_by_group(scores, s, [channel]).withColumn("system", F.lit(s)) for s in systems]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def shift_distribution(shifts: DataFrame, side: int) -> DataFrame:
    """Count per (row, col) shift, zeros included; the dense grid has side * side rows."""
    counts = shifts.groupBy("row_shift", "col_shift").agg(F.count(F.lit(1)).alias("_n"))
    grid = shifts.sparkSession.range(side * side).select(
        F.floor(F.col("id") / side).cast("int").alias("row_shift"), (F.col("id") % side).cast("int").alias("col_shift"))
    return grid.join(counts, ["row_shift", "col_shift"], "left").select(
        "row_shift", "col_shift", F.coalesce("_n", F.lit(0)).alias("n"))


def metric_name(prefix: Column | str, group: Column, metric: Column | str) -> Column:
    """`{prefix}_{group}_{metric}` with blanks and slashes of the group as underscores."""
    lift = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.concat_ws("_", lift(prefix), F.regexp_replace(group, "[ /]", "_"), lift(metric))


def flattened(group_rows: DataFrame, prefix: str, keys: Sequence[str] = ()) -> DataFrame:
    """Long (keys, name, value) rows of group metrics."""
    pairs = F.array(*[F.struct(F.lit(r).alias("m"), F.col(r).alias("value")) for r in RATES])
    return (group_rows.select(*keys, "class_group", F.explode(pairs).alias("p"))
            .select(*keys, metric_name(prefix, F.col("class_group"), F.col("p.m")).alias("name"),
                    F.col("p.value").alias("value")))


def flat_names(df: DataFrame, sep: str = ".") -> DataFrame:
    """Flattens nested structs into top-level columns named by their path."""
    from pyspark.sql import types as T

    def leaves(struct: T.StructType, path: tuple[str, ...]) -> list[Column]:
        out = []
        for field in struct.fields:
            here = (*path, field.name)
            if isinstance(field.dataType, T.StructType):
                out += leaves(field.dataType, here)
            else:
                column = F.col(".".join(f"`{p}`" for p in here))
                out.append(column.alias(sep.join(here)))
        return out
    return df.select(*leaves(df.schema, ()))


def trial_summary(trials: DataFrame, metrics: Sequence[str], keys: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """Mean and sample std per metric column, NULL and NaN dropped; trial and seed columns are simply not listed."""
    aggregates = []
    for m in metrics:
        value = F.when(~F.isnan(F.col(m).cast("double")), F.col(m).cast("double"))
        aggregates += [F.avg(value).alias(f"mean_{prefix}_{m}"), F.stddev_samp(value).alias(f"std_{prefix}_{m}")]
    return trials.groupBy(*keys).agg(*aggregates)


def trial_summary_long(trials: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The same summary as (metric, mean, std) rows; only the aggregated row is unpivoted."""
    wide = trial_summary(trials, metrics, keys)
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"mean__{m}").alias("mean"),
                              F.col(f"std__{m}").alias("std")) for m in metrics])
    return wide.select(*keys, F.inline(rows))


def joined_summaries(parts: Sequence[DataFrame]) -> DataFrame:
    """Summaries of several configurations one under the other; absent metrics become NULL."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def early_stopping(history: DataFrame, patience: int, min_delta: float = 0.0, keys: Sequence[str] = ("run",),
                   count_from: int = 0) -> DataFrame:
    """Best epoch so far, patience counter and stop flag per epoch of each run (columns: keys, epoch, loss).

    A loss below the best so far resets the counter; one above best + min_delta adds to it, from epoch `count_from` on
    (the end of the annealing cycles where cycles do not count).
    """
    order = Window.partitionBy(*keys).orderBy("epoch")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = (history.withColumn("_prev", F.min("loss").over(earlier))
              .withColumn("is_best", F.col("_prev").isNull() | (F.col("loss") < F.col("_prev")))
              .withColumn("best_loss", F.min("loss").over(upto))
              .withColumn("_grp", F.sum(F.col("is_best").cast("int")).over(upto)))
    since = Window.partitionBy(*keys, "_grp").orderBy("epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    worse = (~F.col("is_best")) & (F.col("loss") > F.col("best_loss") + d(min_delta)) & (F.col("epoch") >= count_from)
    counted = marked.withColumn("counter", F.sum(worse.cast("int")).over(since).cast("int")).withColumn(
        "best_epoch", F.first("epoch").over(since))
    return counted.withColumn("stopped", F.max(F.col("counter") >= patience).over(upto)).select(
        *history.columns, "is_best", "best_loss", "best_epoch", "counter", "stopped")


def annealed_epochs(history: DataFrame, period: int, cycles: int) -> DataFrame:
    """Under cyclical annealing only ends of cycles and epochs past the last cycle are judged."""
    return history.where(((F.col("epoch") + 1) % period == 0) | (F.col("epoch") >= cycles * period))


def best_trial(trials: DataFrame, objective: str = "objective", keys: Sequence[str] = ()) -> DataFrame:
    """Parameter columns (`p:` prefix) of the trial with the highest objective, first trial on a tie."""
    params = [c for c in trials.columns if c.startswith("p:")]
    picked = F.struct(*[F.col(f"`{c}`") for c in params], F.col(objective))
    order = F.struct(F.col(objective), (-F.col("trial")).alias("t"))
    return trials.groupBy(*keys).agg(F.max_by(picked, order).alias("_b")).select(
        *keys, *[F.col(f"_b.`{c}`").alias(c) for c in params], F.col(f"_b.{objective}").alias(objective))
