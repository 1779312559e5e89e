"""Data-set construction over orders: an order is a detection or a tile, its customer's nation a site."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import sampling
from .common import rounded, table

KNOWN, UNKNOWN = ["URGENT", "HIGH", "MEDIUM"], ["NOT SPECIFIED", "LOW"]
#: Detection columns as expressions that both engines read.
DETECTION = {
    "id": "o_orderkey",
    "year": "cast(year(o_orderdate) as int)",
    "tif": "concat('plot', cast(o_custkey % 20 as string), '_a.tif')",
    "source_path": "concat('/rasters/plot', cast(o_custkey % 20 as string), '_a.tif')",
    "class": "substring(o_orderpriority, 3, 20)",
    "confidence": "cast((o_orderkey * 7919) % 1000 as double) / 1000",
    "center_x_geo": "cast((o_orderkey * 31) % 97 as double) / 4",
    "center_y_geo": "cast((o_orderkey * 17) % 89 as double) / 4",
    "tile_x": "cast((o_custkey % 8) * 1024 as int)",
    "tile_y": "cast((o_custkey % 5) * 1024 as int)",
    "x1": "cast(o_orderkey % 900 as int)",
    "y1": "cast(o_orderkey % 800 as int)",
    "x2": "cast(o_orderkey % 900 + o_custkey % 120 as int)",
    "y2": "cast(o_orderkey % 800 + o_orderkey % 130 as int)",
}
SELECT = ", ".join(f"{e.replace('as string', 'as varchar')} as {n}" for n, e in DETECTION.items())


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e} as {n}" for n, e in DETECTION.items()])


def thresholded(spark, sf_dir):
    return sampling.threshold(detections(spark, sf_dir), KNOWN, UNKNOWN)


def detections_threshold(spark, sf_dir):
    return thresholded(spark, sf_dir).select("id", "class", "confidence")


def dedup_greedy(spark, sf_dir):
    return sampling.deduplicate(thresholded(spark, sf_dir)).select("id", "source_path", "class")


def source_split(spark, sf_dir):
    return sampling.source_splits(detections(spark, sf_dir))


def cap_per_class_year(spark, sf_dir):
    return sampling.cap_groups(detections(spark, sf_dir), 50).select("id", "class", "year")


def validation_split(spark, sf_dir):
    return sampling.validation_split(detections(spark, sf_dir)).select("id", "class", "year", "validation")


def _manifest(spark, sf_dir):
    return sampling.build_manifest(detections(spark, sf_dir), KNOWN, UNKNOWN, train_cap=40, unknown_cap=20)


def dataset_manifest(spark, sf_dir):
    return _manifest(spark, sf_dir).select("id", "kind", "split", "class", "year", "source_path")


def dataset_counts(spark, sf_dir):
    return sampling.manifest_counts(_manifest(spark, sf_dir))


def role_labels(spark, sf_dir):
    """Training rows of a manifest made of all detections, by year filter, split and label."""
    df = detections(spark, sf_dir).withColumn("split", F.when(F.col("id") % 5 == 0, "test").otherwise("train"))
    return sampling.role(df, "train", KNOWN + UNKNOWN, years=[1995, 1996, 1997]).select("id", "class", "year", "label")


def class_weights(spark, sf_dir):
    return rounded(sampling.class_weights(detections(spark, sf_dir)).select("id", "class", "weight"), 10)


def weighted_sample(spark, sf_dir):
    """Ten thousand draws by class weight: how often each row was drawn."""
    df = sampling.class_weights(detections(spark, sf_dir).select("id", "class"))
    return sampling.weighted_sample(df, 10_000).groupBy("id", "class").agg(F.count(F.lit(1)).alias("draws"))


def example_sample(spark, sf_dir):
    return sampling.example_sample(detections(spark, sf_dir).where("class = 'HIGH'"), 4).select("id", "class")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("site"))
    joined = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).join(F.broadcast(nations), "c_nationkey")  # 25 nations
    return joined.select(
        F.col("o_orderkey").cast("string").alias("key"), "site", (2023 + 2 * (F.col("o_orderkey") % 2)).cast("int").alias("year"), (F.col("o_orderstatus") == "P").cast("int").alias("is_positive"),
        (F.col("o_custkey") % 7).cast("int").alias("other_crown_count"),
    )


def site_positive_counts(spark, sf_dir):
    return sampling.site_positive_counts(tiles(spark, sf_dir), 2023)


def ablation_holdout(spark, sf_dir):
    return sampling.held_out_sites(tiles(spark, sf_dir))


def ablation_split(spark, sf_dir):
    t = tiles(spark, sf_dir)
    return sampling.split_counts(t, sampling.ablation_split(t, sampling.held_out_sites(t)))


def deploy_split(spark, sf_dir):
    return sampling.deployment_split(tiles(spark, sf_dir))


def deploy_counts(spark, sf_dir):
    t = tiles(spark, sf_dir)
    return sampling.split_counts(t, sampling.deployment_split(t))


def balanced_folds(spark, sf_dir):
    return sampling.balanced_folds(tiles(spark, sf_dir))


def fold_roles(spark, sf_dir):
    t = tiles(spark, sf_dir)
    return sampling.fold_roles(t, sampling.balanced_folds(t)).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("tiles"))


def cross_year(spark, sf_dir):
    return sampling.cross_year_roles(tiles(spark, sf_dir))


def negative_sampling(spark, sf_dir):
    t = tiles(spark, sf_dir)
    return sampling.sample_negatives(t.where("is_positive = 0"), t.where("is_positive = 1 and year = 2023").count() // 4).select("key", "other_crown_count", "hard")


def site_names(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "concat('/in/', replace(s_name, '#', '_'), '_x.tif') as path", "cast(2023 + 2 * (s_suppkey % 2) as int) as year")
    return s.select("s_suppkey", text.site_name("path", "year").alias("site"), text.stem("path").alias("stem"), text.state_name("path").alias("state"))


def class_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.class_name(F.regexp_replace("p_name", " ", "_")).alias("class"))


def safe_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.safe_id("url").alias("safe"))


def percent_labels(spark, sf_dir):
    return detections(spark, sf_dir).select("id", text.percent_label("confidence").alias("label"))


def tile_keys(spark, sf_dir):
    t = detections(spark, sf_dir)
    return t.select("id", text.tile_key("year", F.lit("s"), "source_path", "tile_y", "tile_x").alias("key"), text.tile_key("year", F.lit("s"), "source_path", "y1", "x1", centred=True).alias("centred"))


def crop_names(spark, sf_dir):
    return detections(spark, sf_dir).select("id", text.crop_name("class", "year", "source_path", "id").alias("name"))


def source_entries(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "case when s_suppkey % 10 = 0 then s_name else concat(cast(2000 + s_suppkey % 30 as string), '=/in/a=', cast(s_suppkey as string)) end as entry")
    return s.select("s_suppkey", text.parse_source("entry").alias("s")).select("s_suppkey", "s.year", "s.path")


def site_lists(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "concat(' a', cast(s_suppkey as string), ', ,b ,,', s_name, ' ') as t")
    return s.select("s_suppkey", F.array_join(text.site_list("t"), "|").alias("sites"))


def messages(spark, sf_dir):
    table_ = {"es": {"RAIL": "carril"}, "en": {"RAIL": "rail", "AIR": "air"}}
    r = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "es").otherwise("en").alias("l"), F.when(F.col("p_size") % 3 == 0, "RAIL").when(F.col("p_size") % 3 == 1, "AIR").otherwise("SEA").alias("k"))
    return r.select("p_partkey", text.translate(table_, "l", "k").alias("message"))


QUERIES = {
    f.__name__: f
    for f in (
        detections_threshold, dedup_greedy, source_split, cap_per_class_year, validation_split, dataset_manifest, dataset_counts, role_labels, class_weights, weighted_sample, example_sample, site_positive_counts,
        ablation_holdout, ablation_split, deploy_split, deploy_counts, balanced_folds, fold_roles, cross_year, negative_sampling, site_names, class_names, safe_ids, percent_labels, tile_keys, crop_names, source_entries,
        site_lists, messages,
    )
}

THRESHOLD = f"""(class in ('URGENT', 'HIGH', 'MEDIUM') and confidence >= 0.45) or (class in ('NOT SPECIFIED', 'LOW') and confidence >= 0.55)"""
DET = f"det as materialized (select {SELECT} from orders)"
HASH = lambda seed, *keys: f"md5(concat_ws('|', '{seed}', {', '.join(f'cast({k} as varchar)' for k in keys)})), {', '.join(keys)}"
DEDUP = f"""{DET},
sel as materialized (select *, row_number() over (partition by source_path, class order by confidence desc, id) as k from det where {THRESHOLD}),
walk as (
  select source_path, class, cast(0 as bigint) as k, cast([] as struct(id bigint, x double, y double)[]) as kept from (select distinct source_path, class from sel)
  union all
  select w.source_path, w.class, s.k, case when len(list_filter(w.kept, lambda p: sqrt((s.center_x_geo - p.x) * (s.center_x_geo - p.x) + (s.center_y_geo - p.y) * (s.center_y_geo - p.y)) < 3.0)) = 0
    then list_append(w.kept, {{'id': s.id, 'x': s.center_x_geo, 'y': s.center_y_geo}}) else w.kept end
  from walk w join sel s on s.source_path = w.source_path and s.class = w.class and s.k = w.k + 1),
ends as (select *, row_number() over (partition by source_path, class order by k desc) as r from walk),
ids as (select unnest(list_transform(kept, lambda p: p.id)) as id from ends where r = 1),
kept as materialized (select det.* from det join ids using (id))"""


def splits(source: str) -> str:
    return f"""
ranked as (select year, source_path, row_number() over (partition by year order by {HASH(42, 'year', 'source_path')}) as rk, count(*) over (partition by year) as n from (select distinct year, source_path from {source})),
splits as (select source_path, arg_max(case when rk <= greatest(1, cast(floor(n * 0.2) as bigint)) then 'test' else 'train' end, year) as split from ranked group by source_path)"""


MANIFEST = f"""with recursive {DEDUP}, {splits('kept')},
s as (select kept.*, split from kept join splits using (source_path)),
capped as (
  select *, row_number() over (partition by split, class, year order by {HASH(42, 'id')}) as rk from s),
manifest as (
  select id, 'known' as kind, split, class, year, source_path from capped where class in ('URGENT', 'HIGH', 'MEDIUM') and (split = 'test' or rk <= 40)
  union all
  select id, 'unknown', 'test_unknown', class, year, source_path from capped where class in ('NOT SPECIFIED', 'LOW') and split = 'test' and rk <= 20)"""

TILES = """
tiles as materialized (
  select cast(o_orderkey as varchar) as key, n_name as site, cast(2023 + 2 * (o_orderkey % 2) as int) as year, cast(o_orderstatus = 'P' as int) as is_positive, cast(o_custkey % 7 as int) as other_crown_count
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""

HOLDOUT = f"""{TILES},
counts as (select site, count(*) as n from tiles where is_positive = 1 and year = 2023 group by site),
r as (select *, row_number() over (order by n desc, site) as rk, sum(n) over () as total from counts),
b as (select *, coalesce(sum(case when rk > 1 then n else 0 end) over (order by rk rows between unbounded preceding and 1 preceding), 0) as before from r),
held as (select site from b where rk > 1 and not (before >= 0.2 * total and rk - 2 >= 2))"""

FOLDS = f"""{TILES},
counts as (select site, count(*) as n, row_number() over (order by count(*) desc, site) as k from tiles group by site),
walk as (
  select cast(0 as bigint) as k, cast([0, 0, 0, 0, 0] as bigint[]) as sizes, cast(null as varchar) as site, cast(null as int) as fold
  union all
  select c.k, list_transform(w.sizes, lambda v, i: case when i = list_position(w.sizes, list_min(w.sizes)) then v + c.n else v end), c.site, cast(list_position(w.sizes, list_min(w.sizes)) - 1 as int)
  from walk w join counts c on c.k = w.k + 1),
folds as (select site, fold from walk where site is not null)"""

STEM = "regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '')"
DEPLOY = f"""{TILES},
r as (select *, row_number() over (partition by is_positive order by {HASH(0, 'key')}) as rk, count(*) over (partition by is_positive) as n from tiles),
parts as (select key, is_positive, case when rk <= greatest(1, cast(round_even(n * cast(0.1 as double), 0) as int)) then 'validation' else 'train' end as part from r)"""

ORACLE_SQL = {
    "detections_threshold": f"with {DET} select id, class, confidence from det where {THRESHOLD}",
    "dedup_greedy": f"with recursive {DEDUP} select id, source_path, class from kept",
    "source_split": f"with {DET}, {splits('det')} select * from splits",
    "cap_per_class_year": f"with {DET} select id, class, year from det qualify row_number() over (partition by class, year order by {HASH(42, 'id')}) <= 50",
    "validation_split": f"""
with {DET} select id, class, year, row_number() over (partition by class, year order by {HASH(42, 'id')}) <= greatest(1, cast(round_even(count(*) over (partition by class, year) * cast(0.15 as double), 0) as int)) as validation from det""",
    "dataset_manifest": f"{MANIFEST} select * from manifest",
    "dataset_counts": f"""{MANIFEST}
select kind, case when kind = 'known' then split || '/' else '' end || class || '/' || year as key, count(*) as n from manifest group by all""",
    "role_labels": f"""
with {DET}, t as (select * from det where id % 5 <> 0 and year in (1995, 1996, 1997)),
r as (select *, row_number() over (partition by class, year order by {HASH(42, 'id')}) <= greatest(1, cast(round_even(count(*) over (partition by class, year) * cast(0.15 as double), 0) as int)) as validation from t)
select id, class, year, cast(list_position(['URGENT', 'HIGH', 'MEDIUM', 'NOT SPECIFIED', 'LOW'], class) - 1 as int) as label from r where not validation""",
    "class_weights": f"with {DET} select id, class, round(1 / count(*) over (partition by class), 10) + 0.0 as weight from det",
    "weighted_sample": f"""
with {DET},
w as (select id, class, 1 / count(*) over (partition by class) as w from det),
line as materialized (select id, class, sum(w) over (order by id) - w as low, sum(w) over () as whole from w),
drawn as (select i, cast('0x' || substring(md5('42|' || i), 1, 12) as bigint) / pow(16, 12) as u from range(10000) as r(i)),
fell as (select u * (select max(whole) from line) as p from drawn)
select l.id, l.class, count(*) as draws from fell asof join line l on fell.p >= l.low group by all""",
    "example_sample": f"with {DET} select id, class from det where class = 'HIGH' order by {HASH(42, 'id')} limit 4",
    "site_positive_counts": f"with {TILES} select site, count(*) as positives from tiles where is_positive = 1 and year = 2023 group by site",
    "ablation_holdout": f"with {HOLDOUT} select site from held",
    "ablation_split": f"""
with {HOLDOUT},
parts as (
  select *, 'test' as part from tiles where year = 2023 and site in (select site from held)
  union all select *, 'train_first' from tiles where year = 2023 and site not in (select site from held)
  union all select *, 'train_both' from tiles where year = 2025 or site not in (select site from held))
select part, count(*) filter (is_positive = 1) as positive, count(*) filter (is_positive <> 1) as negative, count(*) as total from parts group by part""",
    "deploy_split": f"with {DEPLOY} select key, part from parts",
    "deploy_counts": f"with {DEPLOY} select part, count(*) filter (is_positive = 1) as positive, count(*) filter (is_positive <> 1) as negative, count(*) as total from parts group by part",
    "balanced_folds": f"with recursive {FOLDS} select site, fold from folds",
    "fold_roles": f"""
with recursive {FOLDS}
select cast(g.f as int) as fold, case when folds.fold = g.f then 'val' else 'train' end as role, count(*) as tiles from tiles join folds using (site), range(5) as g(f) group by all""",
    "cross_year": f"with {TILES} select key, case when year = 2023 then 'train' else 'val' end as role from tiles",
    "negative_sampling": f"""
with {TILES},
t as (select cast(3.0 * (count(*) // 4) as int) as target from tiles where is_positive = 1 and year = 2023),
c as (select key, other_crown_count, row_number() over (order by other_crown_count desc, key) as rk from tiles where is_positive = 0),
h as (select *, rk <= (select cast(round_even(cast(0.7 as double) * target, 0) as int) from t) as hard from c),
r as (select *, row_number() over (partition by hard order by {HASH(42, 'key')}) as k, count(*) filter (hard) over () as n from h)
select key, other_crown_count, hard from r, t where hard or k <= target - n""",
    "site_names": f"""
with s as (select s_suppkey, '/in/' || replace(s_name, '#', '_') || '_x.tif' as path, 2023 + 2 * (s_suppkey % 2) as year from supplier)
select s_suppkey, case when year = 2025 then '2025-' || coalesce(string_split({STEM}, '_')[2], 'unknown') else string_split({STEM}, '_')[1] end as site, {STEM} as stem,
  substring({STEM}, 1, 60) || '__' || substring(md5(path), 1, 16) || '.json' as state from s""",
    "class_names": "select p_partkey, upper(split_part(replace(p_name, ' ', '_'), '_', 1)) as class from part",
    "safe_ids": "select page_id, regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g') as safe from pages",
    "percent_labels": f"with {DET} select id, cast(cast(round(confidence * 100) as int) as varchar) || '%' as label from det",
    "tile_keys": f"""
with {DET}, p as (select *, source_path as path from det)
select id, year || '__s__' || {STEM} || '__r' || tile_y || '_c' || tile_x as key, year || '__s__' || {STEM} || '__center_r' || y1 || '_c' || x1 as centred from p""",
    "crop_names": f"with {DET}, p as (select *, source_path as path from det) select id, class || '_' || year || '_' || {STEM} || '_' || lpad(cast(id as varchar), 6, '0') || '.png' as name from p",
    "source_entries": "select s_suppkey, case when s_suppkey % 10 <> 0 then cast(2000 + s_suppkey % 30 as int) end as year, case when s_suppkey % 10 <> 0 then '/in/a=' || s_suppkey end as path from supplier",
    "site_lists": "select s_suppkey, 'a' || s_suppkey || '|b|' || trim(s_name) as sites from supplier",
    "messages": "select p_partkey, case p_size % 3 when 0 then case when p_partkey % 2 = 0 then 'carril' else 'rail' end when 1 then 'air' else 'SEA' end as message from part",
}
