"""Per-patch losses, shift-invariant alignment and latent diagnostics."""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilerain.functions.bands import d, log_sigmoid, sigmoid
from tilerain.operators.ranking import exact_median, joined

# ---- fixed values: loss weights ----
TVERSKY_ALPHA = 0.3
TVERSKY_BETA = 0.7
FOCAL_GAMMA = 4.0 / 3.0


def reconstruction_terms(output: Column, target: Column, c: float = 0.03, eps: float = 1e-6) -> dict[str, Column]:
    diff = output - target
    size = F.abs(diff)
    return {
        "mse": diff * diff,
        "l1": size,
        "huber": F.when(size < 1, d(0.5) * diff * diff).otherwise(size - d(0.5)),
        "pseudo_huber": F.sqrt(diff * diff + d(c * c)) - d(c),
        "log_cosh": F.log(F.cosh(diff + d(1e-12))),
        "charbonnier": F.sqrt(diff * diff + d(eps * eps)),
    }


def reconstruction_losses(pixels: DataFrame, keys: Sequence[str], patch: Sequence[str], output: str,
                          target: str) -> DataFrame:
    """Sum per patch, mean over patches."""
    terms = reconstruction_terms(F.col(output), F.col(target))
    per_patch = pixels.groupBy(*keys, *patch).agg(*[F.sum(t).alias(n) for n, t in terms.items()])
    return per_patch.groupBy(*keys).agg(*[F.avg(n).alias(n) for n in terms])


def bce_term(logit: Column, target: Column, pos_weight: float = 1.0) -> Column:
    return -(d(pos_weight) * target * log_sigmoid(logit) + (d(1) - target) * log_sigmoid(-logit))


def loss_from_sums(n: Column, bce: Column, tp: Column, p: Column, y: Column, alpha: float = TVERSKY_ALPHA,
                   beta: float = TVERSKY_BETA, gamma: float = FOCAL_GAMMA, smooth: float = 1.0) -> dict[str, Column]:
    """All segmentation losses of one pixel set from five sums: pixels, BCE, sum(p*y), sum(p), sum(y)."""
    if not 1 <= gamma <= 3:
        raise ValueError("gamma must be in [1, 3]")
    dice = d(1) - (d(2) * tp + d(smooth)) / (p + y + d(smooth))
    tversky = d(1) - (tp + d(smooth)) / (tp + d(alpha) * (p - tp) + d(beta) * (y - tp) + d(smooth))
    return {"bce": bce / n, "bce_dice": bce / n + dice, "tversky": tversky, "focal_tversky": F.pow(tversky, d(gamma))}


def segmentation_losses(pixels: DataFrame, keys: Sequence[str], logit: str, target: str,
                        pos_weight: float = 1.0) -> DataFrame:
    """Losses per `keys`; give the patch key for the per-patch form, a batch key for the batch form."""
    x, y = F.col(logit), F.col(target).cast("double")
    p = sigmoid(x)
    sums = pixels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(bce_term(x, y, pos_weight)).alias("_bce"), F.sum(p * y).alias("_tp"),
        F.sum(p).alias("_p"), F.sum(y).alias("_y"))
    out = loss_from_sums(*[F.col(c) for c in ("_n", "_bce", "_tp", "_p", "_y")])
    return sums.select(*keys, *[c.alias(n) for n, c in out.items()])


def _placement_sums(window: int, size: int, placements: Sequence[tuple[int, int]], pos_weight: float):
    """UDF (logit, label) -> array of (row_shift, col_shift, bce, tp, p, y), one entry per placement.

    What a placement adds to the sums is the correlation of the label's water mask with three score maps, so all
    placements of all patches of a batch are a few products over shifted views.
    """
    @F.pandas_udf("array<struct<row_shift:int,col_shift:int,bce:double,tp:double,p:double,y:double>>")
    def sums(logits: pd.Series, labels: pd.Series) -> pd.Series:
        whole = [x is not None and y is not None for x, y in zip(logits, labels)]
        blank = [{"row_shift": i, "col_shift": j, "bce": None, "tp": None, "p": None, "y": None} for i, j in placements]
        out = [blank] * len(whole)
        at = [i for i, ok in enumerate(whole) if ok]
        if at:
            x = np.stack([np.asarray(logits.iloc[i], np.float64) for i in at]).reshape(len(at), window, window)
            water = np.stack([np.asarray(labels.iloc[i], np.float64) for i in at]).reshape(len(at), size, size) == 1
            spread = np.log1p(np.exp(-np.abs(x)))
            log_p, log_q = np.minimum(x, 0) - spread, np.minimum(-x, 0) - spread
            p = np.exp(log_p)
            gain, dry, total = log_q - pos_weight * log_p, -log_q.sum((1, 2)), p.sum((1, 2))
            found = []
            for i, j in placements:
                under = water[:, i:i + window, j:j + window].astype(np.float64)
                found.append((dry + np.einsum("nrc,nrc->n", under, gain), np.einsum("nrc,nrc->n", under, p), under.sum((1, 2))))
            for k, row in enumerate(at):
                out[row] = [{"row_shift": i, "col_shift": j, "bce": b[k], "tp": t[k], "p": total[k], "y": y[k]}
                            for (i, j), (b, t, y) in zip(placements, found)]
        return pd.Series(out)
    return sums


def _placed_losses(patches: DataFrame, patch: Sequence[str], window: int, size: int, placements: Sequence[tuple[int, int]], loss: str, pos_weight: float) -> DataFrame:
    sums = patches.select(*patch, F.inline(_placement_sums(window, size, placements, pos_weight)(F.col("logit").cast("array<double>"), F.col("label").cast("array<double>"))))
    value = loss_from_sums(d(window * window), F.col("bce"), F.col("tp"), F.col("p"), F.col("y"))[loss]
    return sums.select(*patch, "row_shift", "col_shift", value.alias("loss"))


def shift_losses(patches: DataFrame, patch: Sequence[str], window: int, size: int, loss: str = "bce",
                 pos_weight: float = 1.0) -> DataFrame:
    """Loss of every placement of a window x window score inside a size x size label.

    Input is one row per patch: `logit` (window^2 doubles) and `label` (size^2 ints), both row-major. The rows never leave
    their task: no pixel join and no shuffle takes place. A null array gives null losses; one of another length fails.
    """
    side = range(size - window + 1)
    return _placed_losses(patches, patch, window, size, [(i, j) for i in side for j in side], loss, pos_weight)


def centered_losses(patches: DataFrame, patch: Sequence[str], window: int, size: int, loss: str = "bce", pos_weight: float = 1.0) -> DataFrame:
    """Loss of the center placement alone; no other placement is computed."""
    offset = (size - window) // 2
    return _placed_losses(patches, patch, window, size, [(offset, offset)], loss, pos_weight)


def best_shift(losses: DataFrame, patch: Sequence[str], side: int, digits: int | None = None) -> DataFrame:
    """Placement with the lowest loss; on a tie the center, then the first in row-major order.

    Losses are compared exactly, or at `digits` decimals, where equal windows tie whatever the order of their sums.
    """
    center = side // 2
    is_center = (F.col("row_shift") == center) & (F.col("col_shift") == center)
    order = F.struct((F.col("loss") if digits is None else F.round("loss", digits)).alias("l"), F.when(is_center, 0).otherwise(1).alias("c"),
                     (F.col("row_shift") * side + F.col("col_shift")).alias("f"))
    return losses.groupBy(*patch).agg(F.min_by(F.struct("row_shift", "col_shift", "loss"), order).alias("_b")).select(
        *patch, "_b.*")


def center_crop(pixels: DataFrame, size: int, window: int) -> DataFrame:
    """Central window of size x size pixels, re-indexed to 0."""
    start = (size - window) // 2
    inside = F.col("r").between(start, start + window - 1) & F.col("c").between(start, start + window - 1)
    return pixels.where(inside).withColumn("r", F.col("r") - start).withColumn("c", F.col("c") - start)


def aligned_windows(pixels: DataFrame, shifts: DataFrame, patch: Sequence[str], window: int) -> DataFrame:
    """Sub-window of each patch at its own (row_shift, col_shift), re-indexed to 0."""
    r, c = F.col("r") - F.col("row_shift"), F.col("c") - F.col("col_shift")
    inside = r.between(0, window - 1) & c.between(0, window - 1)
    return (pixels.join(shifts.select(*patch, "row_shift", "col_shift"), list(patch)).where(inside)
            .withColumn("r", r).withColumn("c", c).drop("row_shift", "col_shift"))


def active_units(latents: DataFrame, mu: str = "mu", keys: Sequence[str] = ()) -> DataFrame:
    """Latent dimensions whose sample variance of the posterior mean exceeds 1e-2 / 1e-3."""
    per_dim = (latents.select(*keys, F.posexplode(mu).alias("dim", "v")).groupBy(*keys, "dim")
               .agg(F.coalesce(F.greatest(F.var_samp("v"), d(0)), d(0)).alias("var")))
    return per_dim.groupBy(*keys).agg(F.count_if(F.col("var") > 1e-2).alias("au_strict"),
                                      F.count_if(F.col("var") > 1e-3).alias("au_lenient"))


def kl_per_sample(mu: Column, log_var: Column) -> Column:
    """0.5 * sum(mu^2 + exp(lv) - 1 - lv) with lv clamped to [-6, 6]."""
    def term(m: Column, v: Column) -> Column:
        lv = F.least(F.greatest(v, d(-6)), d(6))
        return m * m + F.exp(lv) - d(1) - lv
    return d(0.5) * F.aggregate(F.zip_with(mu, log_var, term), d(0), lambda a, x: a + x)


def posterior_summary(latents: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Lower median and small-share of the KL, and the raw log-variance range. `keys` name the runs (not null)."""
    rows = latents.select(*keys, kl_per_sample(F.col("mu"), F.col("log_var")).alias("kl"),
                          F.array_min("log_var").alias("_lo"), F.array_max("log_var").alias("_hi"))
    middle = exact_median(rows, keys, "kl", "lower").withColumnRenamed("median", "median_kl")
    rest = rows.groupBy(*keys).agg(
        F.avg((F.col("kl") < 1e-3).cast("double")).alias("small_kl_share"), F.min("_lo").alias("log_var_min"),
        F.max("_hi").alias("log_var_max"), F.avg("kl").alias("mean_kl"))
    return joined(middle, rest, keys)


def elbo(recon: DataFrame, latents: DataFrame, keys: Sequence[str], beta: float) -> DataFrame:
    """Reconstruction + beta * batch-mean KL, per key."""
    kl = latents.groupBy(*keys).agg(F.avg(kl_per_sample(F.col("mu"), F.col("log_var"))).alias("kld"))
    return joined(recon, kl, keys).withColumn("elbo", F.col("recon") + d(beta) * F.col("kld"))


def ablation_delta(pixels: DataFrame, keys: Sequence[str], patch: Sequence[str], with_mu: str, with_zero: str, target: str,
                   loss: str = "mse") -> DataFrame:
    """Loss of the output decoded from zeros minus that of the output decoded from the posterior mean, in one pass."""
    mu = reconstruction_terms(F.col(with_mu), F.col(target))[loss]
    zero = reconstruction_terms(F.col(with_zero), F.col(target))[loss]
    per_patch = pixels.groupBy(*keys, *patch).agg(F.sum(mu).alias("_mu"), F.sum(zero).alias("_zero"))
    return per_patch.groupBy(*keys).agg((F.avg("_zero") - F.avg("_mu")).alias("ablation_delta"))
