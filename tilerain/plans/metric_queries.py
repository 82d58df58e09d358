"""Registered queries on evaluation, losses, latent diagnostics and training logs."""

from pyspark.sql import functions as F

from tilerain.functions import bands as B
from tilerain.operators import losses as L
from tilerain.operators import metrics as M
from tilerain.operators import neighborhood as N
from tilerain.plans import fixtures as X
from tilerain.plans.registry import query, rounded
from tilerain.schema import NLCD_CLASSES, class_group

CELLS = """count(*) FILTER (target=0 AND NOT prob > 0.5) tn, count(*) FILTER (target=0 AND prob > 0.5) fp,
count(*) FILTER (target=1 AND NOT prob > 0.5) fn, count(*) FILTER (target=1 AND prob > 0.5) tp"""


def _rates_sql(none: str = "NULL") -> str:
    share = lambda up, down, name: f"CASE WHEN {down} > 0 THEN round(({up})/({down})::double, 6) ELSE {none} END {name}"
    return ", ".join([share("tp+tn", "(tn+fp+fn+tp)", "acc"), share("tp", "(tp+fp)", "prec"), share("tp", "(tp+fn)", "rec"),
                      share("2*tp", "(2*tp+fp+fn)", "f1"), share("tp", "(tp+fp+fn)", "iou")])


def _group_sql(system: str, column: str) -> str:
    return "CASE {} {} END".format(column, " ".join(f"WHEN {k} THEN '{v}'" for k, v in class_group(system).items()))


AP = """c AS (SELECT {k}, prob, sum(target)::bigint pos, count(*) n FROM {t} GROUP BY ALL), u AS (SELECT {k}, prob, pos, sum(pos) OVER w tp, sum(n) OVER w pp FROM c
WINDOW w AS (PARTITION BY {k} ORDER BY prob DESC ROWS UNBOUNDED PRECEDING)), ap AS (SELECT {k}, round(sum(pos*(tp/pp::double))/nullif(sum(pos),0), 6) auprc FROM u GROUP BY ALL)"""


@query("confusion_matrix", f"SELECT tn, fp, fn, tp, {_rates_sql('0')} FROM (SELECT {CELLS} FROM pixel_ext)", "pixel_ext")
def confusion_matrix(spark, sf):
    counts = M.confusion(X.pixel_ext(spark, sf))
    return rounded(counts.select("*", *M.core_rates()))


@query("confusion_by_class", f", d AS (SELECT unnest({NLCD_CLASSES}) code), g AS (SELECT tile_id, nlcd code, {CELLS} FROM pixel_ext GROUP BY tile_id, nlcd) SELECT t.tile_id, d.code, coalesce(tn,0) tn, coalesce(fp,0) fp, coalesce(fn,0) fn, coalesce(tp,0) tp FROM (SELECT DISTINCT tile_id FROM g) t CROSS JOIN d LEFT JOIN g ON g.tile_id=t.tile_id AND g.code=d.code", "pixel_ext")
def confusion_by_class(spark, sf):
    """Per tile, where most classes don't occur."""
    return M.confusion_by_class(X.pixel_ext(spark, sf), "nlcd", ["tile_id"])


@query("confusion_by_group", f", g AS (SELECT tile_id % 2 part, {_group_sql('scl', 'scl')} class_group, {CELLS} FROM pixel_ext GROUP BY ALL) SELECT part, class_group, tn, fp, fn, tp, {_rates_sql()} FROM g WHERE class_group IS NOT NULL", "pixel_ext")
def confusion_by_group(spark, sf):
    rows = X.pixel_ext(spark, sf).withColumn("part", F.col("tile_id") % 2)
    return rounded(M.confusion_by_group(rows, "scl", ["part"]))


@query("confusion_levels", f""", a AS (SELECT nlcd code, {_group_sql('nlcd', 'nlcd')} class_group, {CELLS} FROM pixel_ext GROUP BY ALL), z AS (SELECT 'class' scope, * FROM a UNION ALL
SELECT 'group', NULL, class_group, sum(tn)::bigint, sum(fp)::bigint, sum(fn)::bigint, sum(tp)::bigint FROM a WHERE class_group IS NOT NULL GROUP BY class_group UNION ALL SELECT 'overall', NULL, NULL, sum(tn)::bigint, sum(fp)::bigint, sum(fn)::bigint, sum(tp)::bigint FROM a)
SELECT scope, code, class_group, tn, fp, fn, tp, {_rates_sql()} FROM z""", "pixel_ext")
def confusion_levels(spark, sf):
    return rounded(M.confusion_levels(X.pixel_ext(spark, sf), "nlcd"))


@query("group_metric_names", f""", g AS (SELECT {_group_sql('nlcd', 'nlcd')} class_group, {CELLS} FROM pixel_ext GROUP BY ALL), h AS (SELECT class_group, {_rates_sql()} FROM g WHERE class_group IS NOT NULL)
SELECT concat('nlcd_', replace(replace(class_group, ' ', '_'), '/', '_'), '_', m) "name", value FROM h UNPIVOT INCLUDE NULLS (value FOR m IN (acc, prec, rec, f1, iou))""", "pixel_ext")
def group_metric_names(spark, sf):
    return rounded(M.flattened(M.confusion_by_group(X.pixel_ext(spark, sf), "nlcd"), "nlcd"))


@query("auprc_overall", ", t AS (SELECT 1 k, prob, target FROM pixel_ext), " + AP.format(k="k", t="t") + " SELECT auprc FROM ap", "pixel_ext")
def auprc_overall(spark, sf):
    return rounded(M.auprc(X.pixel_ext(spark, sf)))


@query("auprc_by_group", f", t AS (SELECT {_group_sql('nlcd', 'nlcd')} class_group, prob, target FROM pixel_ext), " + AP.format(k="class_group", t="t") + " SELECT class_group, auprc FROM ap", "pixel_ext")
def auprc_by_group(spark, sf):
    rows = X.pixel_ext(spark, sf).withColumn("class_group", M.group_of(F.col("nlcd"), "nlcd"))
    return rounded(M.auprc(rows, ["class_group"]))


PARTS = """, t AS (SELECT ['shift_invariant','non_shift_invariant','aligned'][cast(tile_id % 3 AS int)+1] part, tile_id, prob, target FROM pixel_ext),
ls AS (SELECT part, round(avg(l), 6) loss FROM (SELECT part, tile_id, avg(-(target*ln(least(greatest(prob,1e-7::double),1-1e-7::double)) + (1-target)*ln(1-least(greatest(prob,1e-7::double),1-1e-7::double)))) l FROM t GROUP BY ALL) GROUP BY part),
"""


@query("evaluation_row", PARTS + AP.format(k="part", t="t") + f", cm AS (SELECT part, {CELLS} FROM t GROUP BY part) SELECT cm.part, {_rates_sql('0')}, auprc, loss FROM cm JOIN ap ON ap.part=cm.part JOIN ls ON ls.part=cm.part", "pixel_ext")
def evaluation_row(spark, sf):
    rows = X.pixel_ext(spark, sf).withColumn("part", F.element_at(F.array(*[F.lit(p) for p in ("shift_invariant", "non_shift_invariant", "aligned")]), (F.col("tile_id") % 3 + 1).cast("int")))
    p = F.least(F.greatest(F.col("prob"), F.lit(1e-7)), F.lit(1 - 1e-7))
    term = -(F.col("target") * F.log(p) + (1 - F.col("target")) * F.log(1 - p))
    losses = rows.groupBy("part", "tile_id").agg(F.avg(term).alias("l")).groupBy("part").agg(F.avg("l").alias("loss"))
    return rounded(M.core_row(rows, losses, ["part"]))


PERMUTED = X.permutation_sql(9) + f""", s AS (SELECT 'none' channel, tile_id, b03, b08, target, nlcd, scl FROM pixel_ext UNION ALL SELECT 'green', p.tile_id, q.b03, p.b08, p.target, p.nlcd, p.scl FROM pixel_ext p JOIN pm ON pm.pos=p.pos JOIN pixel_ext q ON q.tile_id=p.tile_id AND q.pos=pm.src
UNION ALL SELECT 'nir', p.tile_id, p.b03, q.b08, p.target, p.nlcd, p.scl FROM pixel_ext p JOIN pm ON pm.pos=p.pos JOIN pixel_ext q ON q.tile_id=p.tile_id AND q.pos=pm.src),
z AS (SELECT channel, tile_id % 10 batch, (b03-b08)/1000.0::double x, 1/(1+exp(-(b03-b08)/1000.0::double)) prob, target, nlcd, scl FROM s)"""


def _permuted_scores(spark, sf):
    from tilerain.operators.patches import permutation_runs
    from tilerain.operators.stacking import exploded
    t, data = F.col("tile_id"), F.col("data")
    dn = lambda v: F.floor((v + 1) * 5000).cast("int")
    codes = F.array(*[F.lit(c) for c in NLCD_CLASSES])
    tiles = X.tile(spark, sf).select(
        t, "w", F.transform(data, lambda v, p: (dn(v) * 3 + p * 211) % 10000).alias("b03"), F.transform(data, lambda v, p: (dn(v) * 7 + p * 97) % 10000).alias("b08"),
        F.transform(data, lambda v: F.when((dn(v) * 7) % 11 < 3, 1).otherwise(0)).alias("target"), F.transform(data, lambda v: dn(v) % 12).alias("scl"),
        F.transform(data, lambda v: F.element_at(codes, (dn(v) % 20 + 1).cast("int"))).alias("nlcd"))
    runs = permutation_runs(tiles, {"green": "b03", "nir": "b08"}, 8, 9, "mix")
    px = exploded(runs, ["b03", "b08", "target", "scl", "nlcd"], ["channel", "tile_id"])
    x = (F.col("b03") - F.col("b08")) / F.lit(1000.0)
    return px.select("channel", (t % 10).alias("batch"), x.alias("logit"), B.sigmoid(x).alias("prob"), "target", "scl", "nlcd")


@query("permutation_importance", PERMUTED + f""", g AS (SELECT channel, {CELLS} FROM z GROUP BY channel),
bl AS (SELECT channel, batch, sum(-(target*ln(prob) + (1-target)*ln(1-prob)))/count(*) + 1 - (2*sum(prob*target) + 1)/(sum(prob) + sum(target) + 1) l FROM z GROUP BY 1, 2),
lo AS (SELECT channel, avg(l) loss FROM bl GROUP BY 1),
h AS (SELECT g.channel, tp, tn, fp, fn, (tp+tn)/(tp+tn+fp+fn)::double acc, tp/(tp+fp)::double prec, tp/(tp+fn)::double rec, 2*tp/(2*tp+fp+fn)::double f1, tp/(tp+fp+fn)::double iou, loss FROM g JOIN lo ON lo.channel=g.channel)
SELECT h.channel, h.tp, h.tn, h.fp, h.fn, round(h.acc,6) acc, round(h.prec,6) prec, round(h.rec,6) rec, round(h.f1,6) f1, round(h.iou,6) iou, round(h.loss,6) loss, round(h.acc-b.acc,6) delta_acc, round(h.prec-b.prec,6) delta_prec, round(h.rec-b.rec,6) delta_rec, round(h.f1-b.f1,6) delta_f1, round(h.iou-b.iou,6) delta_iou, round(h.loss-b.loss,6) delta_loss
FROM h, h b WHERE b.channel='none'""", "pixel_ext")
def permutation_importance(spark, sf):
    scored = _permuted_scores(spark, sf)
    return rounded(M.permutation_importance(scored, M.mean_batch_loss(scored, ["channel"], "batch", "logit", "target")))


@query("permutation_groups", PERMUTED + f""", gg AS (SELECT channel, 'nlcd' AS system, {_group_sql('nlcd', 'nlcd')} class_group, {CELLS} FROM z GROUP BY ALL UNION ALL SELECT channel, 'scl', {_group_sql('scl', 'scl')}, {CELLS} FROM z GROUP BY ALL)
SELECT channel, system, class_group, tn, fp, fn, tp, {_rates_sql()} FROM gg WHERE class_group IS NOT NULL""", "pixel_ext")
def permutation_groups(spark, sf):
    return rounded(M.permutation_groups(_permuted_scores(spark, sf)))


@query("trial_summary", "SELECT config, round(avg(f1),6) mean_f1, round(stddev_samp(f1),6) std_f1, round(avg(recall),6) mean_recall, round(stddev_samp(recall),6) std_recall FROM trial GROUP BY config", "trial")
def trial_summary(spark, sf):
    out = M.trial_summary(X.trial(spark, sf), ["f1", "recall"], ["config"])
    return rounded(out.select("config", *[F.col(f"{s}__{m}").alias(f"{s}_{m}") for m in ("f1", "recall") for s in ("mean", "std")]))


@query("trial_summary_long", "SELECT 'f1' metric, round(avg(f1),6) mean, round(stddev_samp(f1),6) std FROM trial UNION ALL SELECT 'recall', round(avg(recall),6), round(stddev_samp(recall),6) FROM trial UNION ALL SELECT 'loss', round(avg(loss),6), round(stddev_samp(loss),6) FROM trial", "trial")
def trial_summary_long(spark, sf):
    return rounded(M.trial_summary_long(X.trial(spark, sf), ["f1", "recall", "loss"]))


@query("joined_summaries", """SELECT 'all' run, round(avg(f1),6) mean__f1, round(stddev_samp(f1),6) std__f1, NULL::double mean__loss, NULL::double std__loss FROM trial
UNION ALL SELECT config, round(avg(f1),6), round(stddev_samp(f1),6), round(avg(loss),6), round(stddev_samp(loss),6) FROM trial GROUP BY config""", "trial")
def joined_summaries(spark, sf):
    t = X.trial(spark, sf)
    return rounded(M.joined_summaries([M.trial_summary(t, ["f1"]).withColumn("run", F.lit("all")),
                                       M.trial_summary(t, ["f1", "loss"], ["config"]).withColumnRenamed("config", "run")]))


@query("pending_trials", "SELECT trial, seed FROM trial t WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = t.trial)", "trial")
def pending_trials(spark, sf):
    from tilerain.sources.sinks import pending
    done = X.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("trial"))
    return pending(X.trial(spark, sf), done, ["trial"]).select("trial", "seed")


@query("best_trial", "SELECT config, seed \"p:seed\", loss \"p:loss\", f1 objective FROM (SELECT *, row_number() OVER (PARTITION BY config ORDER BY f1 DESC, trial) rn FROM trial) WHERE rn=1", "trial")
def best_trial(spark, sf):
    t = X.trial(spark, sf).select("config", "trial", F.col("seed").alias("p:seed"), F.col("loss").alias("p:loss"), F.col("f1").alias("objective"))
    return M.best_trial(t, keys=["config"])


@query("early_stopping", """WITH h AS (SELECT event_id epoch, user_id run, round(value*(1 + 1.0::double/(1+event_id % 7)), 4) loss FROM events), m AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pv, min(loss) OVER (PARTITION BY run ORDER BY epoch) best_loss FROM h),
g AS (SELECT *, pv IS NULL OR loss < pv is_best, sum(CASE WHEN pv IS NULL OR loss < pv THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY epoch) grp FROM m),
q AS (SELECT *, cast(sum(CASE WHEN NOT is_best AND loss > best_loss + 25 THEN 1 ELSE 0 END) OVER (PARTITION BY run, grp ORDER BY epoch) AS int) counter, first_value(epoch) OVER (PARTITION BY run, grp ORDER BY epoch) best_epoch FROM g)
SELECT epoch, run, loss, is_best, best_loss, best_epoch, counter, max(counter) OVER (PARTITION BY run ORDER BY epoch) >= 6 stopped FROM q""")
def early_stopping(spark, sf):
    e = F.col("event_id")
    h = X.table(spark, sf, "events").select(e.alias("epoch"), F.col("user_id").alias("run"), F.round(F.col("value") * (1 + F.lit(1.0) / (1 + e % 7)), 4).alias("loss"))
    return M.early_stopping(h, 6, 25)


@query("annealed_epochs", "SELECT event_id epoch, user_id run, value loss FROM events WHERE (event_id + 1) % 10 = 0 OR event_id >= 4000")
def annealed_epochs(spark, sf):
    return M.annealed_epochs(X.table(spark, sf, "events").select(F.col("event_id").alias("epoch"), F.col("user_id").alias("run"), F.col("value").alias("loss")), 10, 400)


@query("active_units", ", d AS (SELECT run, unnest(range(32)) dim, unnest(mu)::double v FROM latent), q AS (SELECT run, dim, coalesce(var_samp(v), 0) x FROM d GROUP BY 1, 2) SELECT run, count(*) FILTER (x > 1e-2) au_strict, count(*) FILTER (x > 1e-3) au_lenient FROM q GROUP BY run", "latent")
def active_units(spark, sf):
    return L.active_units(X.latent(spark, sf), keys=["run"])


KL = """, z AS (SELECT sample_id, run, unnest(mu)::double m, unnest(log_var)::double*20 lv FROM latent), kl AS (SELECT sample_id, run, 0.5::double*sum(m*m + exp(least(greatest(lv,-6),6)) - 1 - least(greatest(lv,-6),6)) kl, min(lv) lo, max(lv) hi FROM z GROUP BY 1, 2)"""


@query("posterior_summary", KL + " SELECT run, round(quantile_disc(kl, 0.5), 6) median_kl, avg(CASE WHEN kl < 1e-3 THEN 1 ELSE 0 END) small_kl_share, round(min(lo),6) log_var_min, round(max(hi),6) log_var_max, round(avg(kl),6) mean_kl FROM kl GROUP BY run", "latent")
def posterior_summary(spark, sf):
    return rounded(L.posterior_summary(X.latent(spark, sf), ["run"]))


@query("elbo_parts", KL + ", q AS (SELECT run, avg(s) recon FROM (SELECT label run, tile_id, sum((v-prob)*(v-prob)) s FROM (SELECT e.label, p.* FROM pixel_ext p JOIN embeddings e ON e.vec_id=p.tile_id) GROUP BY 1, 2) GROUP BY 1) SELECT q.run, round(recon,5) recon, round(avg(kl),5) kld, round(recon + 0.1::double*avg(kl),5) elbo FROM q JOIN kl ON kl.run=q.run GROUP BY q.run, recon", "latent pixel_ext")
def elbo_parts(spark, sf):
    labels = X.latent(spark, sf).select(F.col("sample_id").alias("tile_id"), "run")
    px = X.pixel_ext(spark, sf).join(labels, "tile_id")
    recon = L.reconstruction_losses(px, ["run"], ["tile_id"], "v", "prob").select("run", F.col("mse").alias("recon"))
    return rounded(L.elbo(recon, X.latent(spark, sf), ["run"], 0.1), 5)


@query("reconstruction_losses", """, t AS (SELECT tile_id, vv_db/10 - vh_db/10 d FROM pixel_ext WHERE vv_db > -9999 AND vh_db > -9999), s AS (SELECT tile_id, sum(d*d) a, sum(abs(d)) b, sum(CASE WHEN abs(d) < 1 THEN 0.5*d*d ELSE abs(d)-0.5 END) c, sum(sqrt(d*d+0.0009::double)-0.03::double) e, sum(ln((exp(d+1e-12::double)+exp(-d-1e-12::double))/2)) f, sum(sqrt(d*d+1e-12::double)) g FROM t GROUP BY 1)
SELECT round(avg(a),5) mse, round(avg(b),5) l1, round(avg(c),5) huber, round(avg(e),5) pseudo_huber, round(avg(f),5) log_cosh, round(avg(g),5) charbonnier FROM s""", "pixel_ext")
def reconstruction_losses(spark, sf):
    px = X.pixel_ext(spark, sf).where("vv_db > -9999 AND vh_db > -9999").select("tile_id", (F.col("vv_db") / 10).alias("a"), (F.col("vh_db") / 10).alias("b"))
    return rounded(L.reconstruction_losses(px, [], ["tile_id"], "a", "b"), 5)


@query("segmentation_losses", """, t AS (SELECT tile_id, v*8 x, target::double y, 1/(1+exp(-v*8)) p FROM pixel_ext), s AS (SELECT tile_id, count(*) n, sum(-(2*y*ln(p) + (1-y)*ln(1-p))) b, sum(p*y) tp, sum(p) sp, sum(y) sy FROM t GROUP BY 1),
u AS (SELECT *, 1-(2*tp+1)/(sp+sy+1) dice, 1-(tp+1)/(tp+0.3::double*(sp-tp)+0.7::double*(sy-tp)+1) tv FROM s) SELECT tile_id, round(b/n,6) bce, round(b/n+dice,6) bce_dice, round(tv,6) tversky, round(pow(tv,4.0::double/3.0::double),6) focal_tversky FROM u""", "pixel_ext")
def segmentation_losses(spark, sf):
    px = X.pixel_ext(spark, sf).withColumn("x", F.col("v") * 8)
    return rounded(L.segmentation_losses(px, ["tile_id"], "x", "target", 2.0))


SHIFT = """, lo AS (SELECT tile_id, r-1 r, c-1 c, v*8 x FROM pixel_ext WHERE r BETWEEN 1 AND 6 AND c BETWEEN 1 AND 6), sh AS (SELECT cast(a.range AS int) i, cast(b.range AS int) j FROM range(3) a, range(3) b),
pl AS (SELECT lo.tile_id, i, j, x, y.target::double y, 1/(1+exp(-x)) p FROM lo CROSS JOIN sh JOIN pixel_ext y ON y.tile_id=lo.tile_id AND y.r=lo.r+i AND y.c=lo.c+j),
s AS (SELECT tile_id, i, j, count(*) n, sum(-(2*y*ln(p)+(1-y)*ln(1-p))) b, sum(p*y) tp, sum(p) sp, sum(y) sy FROM pl GROUP BY ALL),
u AS (SELECT tile_id, i row_shift, j col_shift, b/n bce, b/n + 1-(2*tp+1)/(sp+sy+1) bce_dice, 1-(tp+1)/(tp+0.3::double*(sp-tp)+0.7::double*(sy-tp)+1) tversky FROM s)"""
BEST = "bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY round({m},7), CASE WHEN row_shift=1 AND col_shift=1 THEN 0 ELSE 1 END, row_shift*3+col_shift) rn FROM u) WHERE rn=1)"


def _patch_rows(spark, sf):
    tiles = X.tile(spark, sf)
    data = F.col("data")
    inner = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda r: F.slice(data, (r * 8 + 2).cast("int"), F.lit(6))))
    dn = lambda v: F.floor((v + 1) * 5000).cast("int")
    return tiles.select("tile_id", F.transform(inner, lambda v: v * 8).alias("logit"), F.transform(data, lambda v: F.when((dn(v) * 7) % 11 < 3, 1).otherwise(0)).alias("label"))


def _shift(spark, sf, loss="bce"):
    return L.shift_losses(_patch_rows(spark, sf), ["tile_id"], 6, 8, loss, 2.0)


@query("shift_losses", SHIFT + " SELECT tile_id, row_shift, col_shift, round(bce_dice, 6) loss FROM u", "pixel_ext")
def shift_losses(spark, sf):
    return rounded(_shift(spark, sf, "bce_dice"))


@query("shift_invariant_loss", SHIFT + ", " + BEST.format(m="bce") + " SELECT tile_id, row_shift, col_shift, round(bce, 6) loss FROM bs", "pixel_ext")
def shift_invariant_loss(spark, sf):
    return rounded(L.best_shift(_shift(spark, sf), ["tile_id"], 3, 7))


@query("shift_invariant_total", SHIFT + ", " + BEST.format(m="tversky") + " SELECT round(sum(tversky), 5) loss, count(*) patches FROM bs", "pixel_ext")
def shift_invariant_total(spark, sf):
    best = L.best_shift(_shift(spark, sf, "tversky"), ["tile_id"], 3, 7)
    return rounded(best.agg(F.sum("loss").alias("loss"), F.count(F.lit(1)).alias("patches")), 5)


@query("centered_loss", SHIFT + " SELECT tile_id, round(tversky, 6) loss FROM u WHERE row_shift=1 AND col_shift=1", "pixel_ext")
def centered_loss(spark, sf):
    return rounded(L.centered_losses(_patch_rows(spark, sf), ["tile_id"], 6, 8, "tversky", 2.0).select("tile_id", "loss"))


@query("shift_distribution", SHIFT + ", " + BEST.format(m="bce") + " SELECT i row_shift, j col_shift, count(bs.tile_id) n FROM sh LEFT JOIN bs ON bs.row_shift=i AND bs.col_shift=j GROUP BY 1, 2", "pixel_ext")
def shift_distribution(spark, sf):
    return M.shift_distribution(L.best_shift(_shift(spark, sf), ["tile_id"], 3, 7), 3)


@query("aligned_windows", SHIFT + ", " + BEST.format(m="bce") + " SELECT p.tile_id, p.r-row_shift r, p.c-col_shift c, p.scl FROM pixel_ext p JOIN bs ON bs.tile_id=p.tile_id WHERE p.r-row_shift BETWEEN 0 AND 5 AND p.c-col_shift BETWEEN 0 AND 5", "pixel_ext")
def aligned_windows(spark, sf):
    best = L.best_shift(_shift(spark, sf), ["tile_id"], 3, 7)
    return L.aligned_windows(X.pixel_ext(spark, sf).select("tile_id", "r", "c", "scl"), best, ["tile_id"], 6)


@query("center_crop", "SELECT tile_id, r-2 r, c-2 c, dn FROM pixel WHERE r BETWEEN 2 AND 5 AND c BETWEEN 2 AND 5", "pixel")
def center_crop(spark, sf):
    return L.center_crop(X.pixel(spark, sf).select("tile_id", "r", "c", "dn"), 8, 4)


@query("patch_psnr", ", a AS (SELECT tile_id, least(greatest((sqrt(pow(10,vv_db/10)) - pow(10,-1.5))/(1-pow(10,-1.5)),0),1) x, least(greatest((sqrt(pow(10,vh_db/10)) - pow(10,-1.5))/(1-pow(10,-1.5)),0),1) y FROM pixel_ext) SELECT tile_id, round(10*log10(1/(avg((x-y)*(x-y))+1e-10)),6) psnr FROM a GROUP BY 1", "pixel_ext")
def patch_psnr(spark, sf):
    px = X.pixel_ext(spark, sf).select("tile_id", N.unit_amplitude(F.col("vv_db"), "vv").alias("x"), N.unit_amplitude(F.col("vh_db"), "vv").alias("y"))
    return rounded(N.psnr(px, "x", "y"))


@query("equivalent_looks", "SELECT tile_id, round(avg(pow(10,vv_db/10))*avg(pow(10,vv_db/10))/var_samp(pow(10,vv_db/10)),5) enl FROM pixel_ext GROUP BY 1", "pixel_ext")
def equivalent_looks(spark, sf):
    return rounded(N.equivalent_looks(X.pixel_ext(spark, sf), "vv_db"), 5)


@query("suppression_index", "SELECT tile_id, round((stddev_samp(pow(10,vh_db/10))/avg(pow(10,vh_db/10)))*(avg(pow(10,vv_db/10))/stddev_samp(pow(10,vv_db/10))),6) ssi FROM pixel_ext GROUP BY 1", "pixel_ext")
def suppression_index(spark, sf):
    return rounded(N.suppression_index(X.pixel_ext(spark, sf), "vv_db", "vh_db"))


def _around(a: str) -> str:
    return f"""coalesce(lag({a}) OVER d,0)+coalesce(lead({a}) OVER d,0)+coalesce(lag({a}) OVER e,0)+coalesce(lead({a}) OVER e,0)-4*{a}"""


@query("laplacian_variance", f", l AS (SELECT tile_id, {_around('v')} l FROM pixel_ext WINDOW d AS (PARTITION BY tile_id, c ORDER BY r), e AS (PARTITION BY tile_id, r ORDER BY c)) SELECT tile_id, round(var_samp(l),6) var_laplacian FROM l GROUP BY 1", "pixel_ext")
def laplacian_variance(spark, sf):
    return rounded(N.laplacian_variance(X.pixel_ext(spark, sf).select("tile_id", "r", "c", "v"), "v"))


@query("total_variation", ", l AS (SELECT tile_id, coalesce(pow(v-lag(v) OVER d,2),0)+coalesce(pow(v-lag(v) OVER e,2),0) l FROM pixel_ext WINDOW d AS (PARTITION BY tile_id, c ORDER BY r), e AS (PARTITION BY tile_id, r ORDER BY c)) SELECT tile_id, round(sum(l),6) tv, round(sum(l)/count(*),6) tv_per_pixel FROM l GROUP BY 1", "pixel_ext")
def total_variation(spark, sf):
    return rounded(N.total_variation(X.pixel_ext(spark, sf).select("tile_id", "r", "c", "v"), "v"))


@query("ablation_delta", ", s AS (SELECT tile_id % 4 run, tile_id, sum(pow(b03/10000.0::double - prob, 2)) z, sum(pow(v - prob, 2)) m FROM pixel_ext GROUP BY 1, 2) SELECT run, round(avg(z) - avg(m), 5) ablation_delta FROM s GROUP BY run", "pixel_ext")
def ablation_delta(spark, sf):
    px = X.pixel_ext(spark, sf).select("tile_id", (F.col("tile_id") % 4).alias("run"), "v", "prob", (F.col("b03") / F.lit(10000.0)).alias("z"))
    return rounded(L.ablation_delta(px, ["run"], ["tile_id"], "v", "z", "prob"), 5)


@query("annealed_stopping", """WITH h AS (SELECT event_id epoch, user_id run, value loss FROM events WHERE (event_id + 1) % 10 = 0 OR event_id >= 4000), m AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pv, min(loss) OVER (PARTITION BY run ORDER BY epoch) best_loss FROM h),
g AS (SELECT *, pv IS NULL OR loss < pv is_best, sum(CASE WHEN pv IS NULL OR loss < pv THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY epoch) grp FROM m),
q AS (SELECT *, cast(sum(CASE WHEN NOT is_best AND loss > best_loss AND epoch >= 4000 THEN 1 ELSE 0 END) OVER (PARTITION BY run, grp ORDER BY epoch) AS int) counter FROM g)
SELECT epoch, run, counter, max(counter) OVER (PARTITION BY run ORDER BY epoch) >= 9 stopped FROM q""")
def annealed_stopping(spark, sf):
    logged = X.table(spark, sf, "events").select(F.col("event_id").alias("epoch"), F.col("user_id").alias("run"), F.col("value").alias("loss"))
    return M.early_stopping(M.annealed_epochs(logged, 10, 400), 9, count_from=4000).select("epoch", "run", "counter", "stopped")
