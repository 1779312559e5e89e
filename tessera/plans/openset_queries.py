"""Open-set scoring over the embeddings table: the first five dimensions, times ten, are logits; labels of five and above
are unknown (-1); years alternate by id; every third row is for training."""

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vector import argmax
from ..operators import openset
from .common import rounded, table

CLASSES = 5
SCALAR = ["msp", "maxlogit", "energy", "entropy"]


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    logits = F.transform(F.slice("embedding", 1, CLASSES), lambda x: x.cast("double") * 10)
    out = e.select(
        F.col("vec_id").alias("id"), F.when(F.col("label") < CLASSES, F.col("label")).otherwise(openset.UNKNOWN).alias("label"), F.concat(F.lit("U"), F.col("label")).alias("class"),
        F.col("embedding").alias("features"), logits.alias("logits"), (2023 + 2 * (F.col("vec_id") % 2)).cast("int").alias("year"), (F.col("vec_id") % 3 == 0).alias("train"),
    )
    return out.withColumn("predicted", argmax("logits"))


def train(df: DataFrame) -> DataFrame:
    return df.where("train and label >= 0")


def logit_scores(spark, sf_dir):
    return rounded(openset.logit_scores(rows(spark, sf_dir)).select("id", *SCALAR))


def knn(spark, sf_dir):
    df = rows(spark, sf_dir)
    return rounded(openset.knn_score(df.where("not train"), train(df)).select("id", "knn"))


def mahalanobis(spark, sf_dir):
    df = rows(spark, sf_dir)
    found = openset.Mahalanobis.fit(train(df)).score(df.where("not train"))
    return rounded(found.select("id", "mahalanobis", "nearest"), 4)


def vim(spark, sf_dir):
    df = rows(spark, sf_dir)
    return rounded(openset.ViM.fit(train(df), CLASSES).score(df.where("not train")).select("id", "vim"), 5)


def react(spark, sf_dir):
    df = rows(spark, sf_dir)
    clipping = openset.percentile_clip(train(df))
    head = np.zeros((CLASSES, 64))
    head[range(CLASSES), range(CLASSES)] = 10
    return rounded(openset.react_energy(df.where("not train"), head, np.zeros(CLASSES), clipping).select("id", "react"))


def percentile_clip(spark, sf_dir):
    clipping = openset.percentile_clip(train(rows(spark, sf_dir)))
    return rounded(spark.createDataFrame(list(enumerate(clipping)), "dimension int, clip double"), 8)


def _evaluated(spark, sf_dir):
    return openset.evaluate(openset.logit_scores(rows(spark, sf_dir).where("not train")), SCALAR, [2023, 2025])


def osr_metrics(spark, sf_dir):
    return rounded(_evaluated(spark, sf_dir)[0])


def closed_set_metrics(spark, sf_dir):
    return rounded(_evaluated(spark, sf_dir)[1])


def all_methods(spark, sf_dir):
    """AUROC and OSCR of all eight methods, over all features."""
    df = rows(spark, sf_dir)
    fitted, test = train(df), openset.logit_scores(df.where("not train"))
    head = np.zeros((CLASSES, 64))
    head[range(CLASSES), range(CLASSES)] = 10
    scored = openset.Mahalanobis.fit(fitted).score(openset.knn_score(test, fitted))
    scored = openset.react_energy(openset.ViM.fit(fitted, CLASSES).score(scored), head, np.zeros(CLASSES), openset.percentile_clip(fitted))
    return rounded(openset.evaluate(scored, [*SCALAR, "mahalanobis", "knn", "vim", "react"], [2023, 2025])[0], 4)


def per_unknown_class(spark, sf_dir):
    df = rows(spark, sf_dir)
    scored = openset.Mahalanobis.fit(train(df)).score(df.where("not train"))
    return rounded(openset.per_unknown_class(scored.withColumnRenamed("mahalanobis", "score"), CLASSES))


def class_centroids(spark, sf_dir):
    found = openset.centroids(rows(spark, sf_dir), ["class"])
    return found.select("class", "samples", F.transform("centroid", lambda x: F.round(x, 6) + 0.0).alias("centroid"))


def centroid_shift(spark, sf_dir):
    df = rows(spark, sf_dir).where("label >= 0").withColumn("domain", F.col("year"))
    found = openset.centroid_shift(df, 2023, 2025)
    flat = found.select("mean_cross_year_centroid_shift", "mean_between_class_centroid_distance", "cross_year_to_between_class_ratio", *[F.col("per_class_cross_year_shift")[str(i)].alias(f"shift_{i}") for i in range(CLASSES)])
    return rounded(flat)


def domain_auc(spark, sf_dir):
    found = openset.domain_auc(rows(spark, sf_dir).withColumn("domain", (F.col("year") == 2025).cast("int")))
    return rounded(spark.createDataFrame([(found,)], "domain_auc double"), 3)


def contrastive_loss(spark, sf_dir):
    return rounded(openset.supervised_contrastive_loss(rows(spark, sf_dir).where("label >= 0")))


def early_stopping(spark, sf_dir):
    """Months of events as epochs, the share of clicks as the score, event types as stages."""
    days = table(spark, sf_dir, "events").select("event_type", F.dayofmonth("ts").alias("epoch"), "value")
    history = days.groupBy("event_type", "epoch").agg(F.round(F.avg(F.col("value").cast("double")), 6).alias("validation_macro_f1"))
    return openset.early_stopping(history, 3, ["event_type"]).select("event_type", "epoch", "improved", F.col("stale").cast("int").alias("stale"), "ran")


def epoch_loss(spark, sf_dir):
    """Mean loss of an epoch over batches, weighted by their sizes."""
    e = table(spark, sf_dir, "events").select(F.dayofmonth("ts").alias("epoch"), F.col("value").cast("double").alias("loss"), (F.col("user_id") % 32 + 1).alias("n"))
    return rounded(openset.epoch_losses(e, ["epoch"]))


QUERIES = {
    "score_logits": logit_scores, "score_knn": knn, "score_mahalanobis": mahalanobis, "score_vim": vim, "score_react": react, "percentile_clip": percentile_clip,
    "osr_metrics": osr_metrics, "closed_set_metrics": closed_set_metrics, "osr_all_methods": all_methods, "per_unknown_class": per_unknown_class,
    "class_centroids": class_centroids, "centroid_shift": centroid_shift, "domain_auc": domain_auc, "contrastive_loss": contrastive_loss, "early_stopping": early_stopping, "epoch_loss": epoch_loss,
}

ROWS = f"""
r as materialized (
  select vec_id as id, case when label < {CLASSES} then label else -1 end as label, 'U' || label as class, list_transform(embedding, lambda x: cast(x as double)) as f,
    list_transform(embedding[1:{CLASSES}], lambda x: cast(x as double) * 10) as z, cast(2023 + 2 * (vec_id % 2) as int) as year, vec_id % 3 = 0 as train
  from embeddings),
p as materialized (select *, cast(list_position(z, list_max(z)) - 1 as int) as predicted, list_transform(z, lambda x: exp(x - list_max(z))) as x from r),
s as materialized (
  select *, list_max(x) / list_sum(x) as msp, list_max(z) as maxlogit, list_max(z) + ln(list_sum(x)) as energy,
    list_sum(list_transform(x, lambda v: v / list_sum(x) * ln(v / list_sum(x) + 1e-12))) as entropy
  from p)"""

LONG = f"""{ROWS},
sets as (select *, unnest(['combined', cast(year as varchar)]) as "set" from s where not train),
long as (
  unpivot (select "set", label >= 0 as known, label = predicted as correct, msp, maxlogit, energy, entropy from sets) on msp, maxlogit, energy, entropy into name method value score)"""

#: Mahalanobis distances over all features; the covariance is inverted by Gauss-Jordan steps.
DISTANCES = f"""{ROWS},
t as materialized (select id, label, f from s where train and label >= 0),
m as materialized (select label, list(v order by i) as mean from (select label, i, avg(f[i]) as v from t, range(1, 65) as g(i) group by label, i) group by label),
e as materialized (select list_transform(list_zip(f, mean), lambda p: p[1] - p[2]) as d from t join m using (label)),
cov as (select i, j, sum(d[i] * d[j]) / (count(*) - 1) + case when i = j then 1e-6 else 0 end as v from e, range(1, 65) as gi(i), range(1, 65) as gj(j) group by i, j),
wide as (select i, list(v order by j) || list_transform(range(1, 65), lambda j: case when j = i then 1.0::double else 0.0::double end) as r from cov group by i),
step as (
  select cast(0 as bigint) as k, list(r order by i) as a from wide
  union all
  select k + 1, list_transform(a, lambda r, i: case when i = k + 1 then list_transform(r, lambda x: x / r[k + 1])
    else list_transform(list_zip(r, a[k + 1]), lambda p: p[1] - r[k + 1] * p[2] / a[k + 1][k + 1]) end)
  from step where k < 64),
inv as materialized (select list_transform(a, lambda r: r[65:128]) as p from step where k = 64),
d as (
  select id, label, class, to_label, list_dot_product(v, list_transform(p, lambda r: list_dot_product(r, v))) as dist
  from (select s.id, s.label, s.class, m.label as to_label, list_transform(list_zip(f, mean), lambda x: x[1] - x[2]) as v from s, m where not train), inv),
maha as materialized (select id, any_value(label) as label, any_value(class) as class, -min(dist) as score, cast(arg_min(to_label, dist) as int) as nearest from d group by id)"""

ORACLE_SQL = {
    "score_logits": f"with {ROWS} select id, round(msp, 6) + 0.0 as msp, round(maxlogit, 6) + 0.0 as maxlogit, round(energy, 6) + 0.0 as energy, round(entropy, 6) + 0.0 as entropy from s",
    "score_knn": f"""
with {ROWS},
n as (select id, label, train, list_transform(f, lambda x: x / greatest(sqrt(list_dot_product(f, f)), 1e-12)) as u from s),
d as (
  select q.id, sqrt(list_sum(list_transform(list_zip(q.u, t.u), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) as dist
  from n q, n t where not q.train and t.train and t.label >= 0),
k as (select *, row_number() over (partition by id order by dist) as rk from d)
select id, round(-sum(dist) / 5, 6) + 0.0 as knn from k where rk <= 5 group by id""",
    "score_mahalanobis": f"with recursive {DISTANCES} select id, round(score, 4) + 0.0 as mahalanobis, nearest from maha",
    "score_react": f"""
with {ROWS},
c as (select i, quantile_cont(f[i], 0.9) as q from s, range(1, {CLASSES + 1}) as g(i) where train and label >= 0 group by i),
z2 as (select id, list(10 * least(f[i], q) order by i) as z from s, c where not train group by id)
select id, round(list_max(z) + ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))), 6) + 0.0 as react from z2""",
    "percentile_clip": f"""
with {ROWS}
select cast(i - 1 as int) as dimension, round(quantile_cont(f[i], 0.9), 8) + 0.0 as clip from s, range(1, 65) as g(i) where train and label >= 0 group by i""",
    "osr_metrics": f"""
with {LONG},
pairs as (
  select k."set", k.method, count(*) as n, sum(case when k.score > u.score then 1.0 when k.score = u.score then 0.5 else 0.0 end) as above,
    sum(case when k.correct and k.score > u.score then 1.0 when k.correct and k.score = u.score then 0.5 else 0.0 end) as area
  from long k join long u on k."set" = u."set" and k.method = u.method and k.known and not u.known group by all),
sizes as (select "set", method, count(*) filter (known) as known_samples, count(*) filter (not known) as unknown_samples from long group by all)
select "set", method, known_samples, unknown_samples, round(above / n, 6) + 0.0 as auroc, round(area / n, 6) + 0.0 as oscr from pairs join sizes using ("set", method)""",
    "closed_set_metrics": f"""
with {LONG},
k as (select * from sets where label >= 0),
labels as (select "set", label as l from k union select "set", predicted from k),
each as (
  select l."set", l.l, count(*) filter (label = l.l) as t, count(*) filter (predicted = l.l) as p, count(*) filter (label = l.l and predicted = l.l) as hit
  from labels l join k on k."set" = l."set" group by all)
select "set", cast(sum(t) as bigint) as samples, round(sum(hit) / sum(t), 6) + 0.0 as accuracy, round(avg(2 * hit / (t + p)), 6) + 0.0 as macro_f1 from each group by "set" """,
    "per_unknown_class": f"""
with recursive {DISTANCES},
u as (select * from maha where label < 0),
auc as (
  select u.class, avg(case when k.score > u.score then 1.0 when k.score = u.score then 0.5 else 0.0 end) as auroc
  from u, maha k where k.label >= 0 group by u.class),
near as (select class, nearest, count(*) as n, row_number() over (partition by class order by count(*) desc, nearest) as rk, sum(count(*)) over (partition by class) as samples from u group by class, nearest)
select class, cast(samples as bigint) as samples, round(auroc, 6) + 0.0 as auroc, nearest, round(n / samples, 6) + 0.0 as nearest_fraction from near join auc using (class) where rk = 1""",
    "class_centroids": f"""
with {ROWS}, d as (select class, i, avg(f[i]) as m, count(*) as n from s, range(1, 65) as g(i) group by all)
select class, any_value(n) as samples, list(round(m, 6) + 0.0 order by i) as centroid from d group by class""",
    "centroid_shift": f"""
with {ROWS},
d as (select year, label, i, avg(f[i]) as m from s, range(1, 65) as g(i) where label >= 0 group by all),
shift as (select a.label, sqrt(sum((a.m - b.m) * (a.m - b.m))) as d from d a join d b on a.label = b.label and a.i = b.i and a.year = 2023 and b.year = 2025 group by a.label),
between_ as (select a.label, b.label as r, sqrt(sum((a.m - b.m) * (a.m - b.m))) as d from d a join d b on a.label < b.label and a.i = b.i and a.year = 2023 and b.year = 2023 group by all),
o as (select (select avg(d) from shift) as x, (select avg(d) from between_) as y)
select round(x, 6) + 0.0 as mean_cross_year_centroid_shift, round(y, 6) + 0.0 as mean_between_class_centroid_distance, round(x / y, 6) + 0.0 as cross_year_to_between_class_ratio,
  {', '.join(f'(select round(d, 6) + 0.0 from shift where label = {i}) as shift_{i}' for i in range(CLASSES))}
from o""",
    "contrastive_loss": f"""
with {ROWS},
b as (select id, label, f from s where label >= 0),
sims as (select a.id, a.label = c.label as same, a.id = c.id as self, list_dot_product(a.f, c.f) / 0.1 as v from b a, b c),
most as (select id, max(v) as m from sims group by id),
each as (select id, ln(sum(exp(v - m)) + 1e-12) as log_all, avg(case when same then v - m end) as positive from sims join most using (id) where not self group by id)
select count(*) as anchors, round(-avg(positive - log_all), 6) + 0.0 as loss from each where positive is not null""",
    "early_stopping": """
with h as (select event_type, cast(dayofmonth(ts) as int) as epoch, round(avg(cast(value as double)), 6) as v from events group by all),
b as (select *, max(v) over (partition by event_type order by epoch rows between unbounded preceding and 1 preceding) as best from h),
i as (select *, best is null or v > best as improved from b),
s as (select *, epoch - max(case when improved then epoch end) over (partition by event_type order by epoch) as stale from i)
select event_type, epoch, improved, cast(stale as int) as stale,
  coalesce(max(cast(stale >= 3 as int)) over (partition by event_type order by epoch rows between unbounded preceding and 1 preceding), 0) = 0 as ran
from s""",
    "epoch_loss": """
select cast(dayofmonth(ts) as int) as epoch, round(sum(cast(value as double) * (user_id % 32 + 1)) / sum(user_id % 32 + 1), 6) + 0.0 as loss from events group by 1""",
}
