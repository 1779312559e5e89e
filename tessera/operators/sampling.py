"""Data-set construction: thresholds, distance de-duplication, leak-free splits, caps, folds and negative sampling.

Random choices order rows by a hash of a seed and the row's key: the same sizes, strata and disjointness as a seeded
shuffle, the same on any number of executors. Fractions are rounded half to even, or cut, as each operator says.
"""

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise

DETECTION_COLUMNS = ("year", "tif", "source_path", "class", "confidence", "center_x_geo", "center_y_geo", "tile_x", "tile_y", "x1", "y1", "x2", "y2")


def require(df: DataFrame, columns) -> DataFrame:
    missing = set(columns) - set(df.columns)
    if missing:
        raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
    return df


def shuffled(seed: int, *keys: str) -> list[Column]:
    """An order that a seed and the keys decide."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return [F.md5(text), *[F.col(k) for k in keys]]


def threshold(df: DataFrame, known: list[str], unknown: list[str], known_confidence: float = 0.45, unknown_confidence: float = 0.55) -> DataFrame:
    if set(known) & set(unknown):
        raise ValueError("known and unknown classes must not overlap")
    c = F.col("confidence")
    return df.where((F.col("class").isin(known) & (c >= known_confidence)) | (F.col("class").isin(unknown) & (c >= unknown_confidence)))


def greedy(df: DataFrame, by: list[str], order: list[Column], clash, needs: list[str]) -> DataFrame:
    """The rows a greedy pass keeps: in order, each row that clashes with no row kept before it in its group.

    clash() gives a fresh state with take(values) -> bool for each group. Rows stream through in sorted order, so that a
    task holds the kept rows of one group, not the group."""
    schema = df.schema
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        import pyarrow as pa

        current, state = None, None
        for batch in batches:
            groups = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in by)))
            values = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in needs))
            keep = []
            for g, v in zip(groups, values):
                if g != current or state is None:
                    current, state = g, clash()
                keep.append(state.take(v))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.repartition(n, *by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


class _Near:
    """Kept points by grid cell; a point is taken if every kept one is at least d away."""

    def __init__(self, d: float):
        self.d, self.cells = d, {}

    def take(self, v) -> bool:
        from math import floor, hypot

        x, y = v[:2]
        if self.d <= 0:
            return True
        cx, cy = floor(x / self.d), floor(y / self.d)
        for i in (cx - 1, cx, cx + 1):
            for j in (cy - 1, cy, cy + 1):
                for px, py in self.cells.get((i, j), ()):
                    if not hypot(x - px, y - py) >= self.d:
                        return False
        self.cells.setdefault((cx, cy), []).append((x, y))
        return True


def deduplicate(df: DataFrame, distance: float = 3.0, seq: str = "id", by: tuple[str, ...] = ("source_path", "class")) -> DataFrame:
    """Of each source and class, in order of falling confidence (then seq): every detection at least distance away from
    all kept before it."""
    return greedy(df, list(by), [F.desc("confidence"), F.asc(seq)], lambda: _Near(distance), ["center_x_geo", "center_y_geo"])


def source_splits(df: DataFrame, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """(source_path, split): in each year the first max(1, int(n * fraction)) sources of a shuffle are for testing. A source
    of several years has the split of its last."""
    sources = df.select("year", "source_path").distinct()
    ranked = sources.withColumn("rk", F.row_number().over(Window.partitionBy("year").orderBy(*shuffled(seed, "year", "source_path")))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("year")))
    split = ranked.withColumn("split", F.when(F.col("rk") <= F.greatest(F.lit(1), F.floor(F.col("n") * fraction)), "test").otherwise("train"))
    return split.groupBy("source_path").agg(F.max_by("split", "year").alias("split"))


def places_in_shuffle(df: DataFrame, by: list[str], mixed: Column, key: str) -> DataFrame:
    """df with place, from 1 in its group in order of mixed (hexadecimal text) and key, and size, that of its group.

    A group is cut by the first digits of mixed: places are ranks within a cut, and the rows of the cuts before it."""
    cut = df.withColumn("__mixed", mixed).withColumn("__cut", F.substring("__mixed", 1, CUT_DIGITS))
    sums = cut.groupBy(*by, "__cut").agg(F.count(F.lit(1)).alias("__n"))  # so many rows a group at most
    upto = Window.partitionBy(*by).orderBy("__cut")
    before = sums.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__cut").alias("__of"), (F.sum("__n").over(upto) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy(*by)).alias("size"))
    ranked = cut.withColumn("__rank", F.row_number().over(Window.partitionBy(*by, "__cut").orderBy("__mixed", key)))
    joined = ranked.join(before, [*[F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], F.col("__cut") == F.col("__of")])
    return joined.select(*df.columns, (F.col("__before") + F.col("__rank")).alias("place"), "size")


#: Digits that cut a group in a shuffle: 256 cuts.
CUT_DIGITS = 2


def take_of_each(df: DataFrame, by: list[str], count: Callable[[Column], Column], seed: int, key: str) -> DataFrame:
    """df with taken: whether the row is among the first count(size of its group) rows of its group in a shuffle."""
    mixed, *_ = shuffled(seed, key)
    placed = places_in_shuffle(df, by, mixed, key)
    return placed.select(*df.columns, (F.col("place") <= count(F.col("size"))).alias("taken"))


def cap_groups(df: DataFrame, cap: int | None, seed: int = 42, key: str = "id", by: tuple[str, ...] = ("class", "year")) -> DataFrame:
    """At most cap rows of each group (None: all)."""
    return df if cap is None else take_of_each(df, list(by), lambda n: F.lit(cap), seed, key).where("taken").drop("taken")


def validation_split(df: DataFrame, fraction: float = 0.15, seed: int = 42, key: str = "id", by: tuple[str, ...] = ("class", "year")) -> DataFrame:
    """df with validation: in each group, max(1, round half even (n * fraction)) rows."""
    return take_of_each(df, list(by), lambda n: F.greatest(F.lit(1), F.bround(n * F.lit(fraction)).cast("int")), seed, key).withColumnRenamed("taken", "validation")


def build_manifest(detections: DataFrame, known: list[str], unknown: list[str], *, known_confidence: float = 0.45, unknown_confidence: float = 0.55, distance: float = 3.0, test_fraction: float = 0.2, train_cap: int | None = 300, unknown_cap: int | None = 200, seed: int = 42, key: str = "id") -> DataFrame:
    """The crops of a data set: thresholds, de-duplication, splits by source, caps. Known training crops are capped, known
    test crops are not; unknown crops come from test sources alone, capped. Adds kind and split."""
    kept = deduplicate(threshold(require(detections, DETECTION_COLUMNS), known, unknown, known_confidence, unknown_confidence), distance, key)
    split = kept.join(source_splits(kept, test_fraction, seed), "source_path")
    old = split.where(F.col("class").isin(known))
    train, test = (old.where(F.col("split") == s) for s in ("train", "test"))
    new = split.where(F.col("class").isin(unknown) & (F.col("split") == "test")).withColumn("split", F.lit("test_unknown"))
    out = cap_groups(train, train_cap, seed, key).unionByName(test).withColumn("kind", F.lit("known"))
    return out.unionByName(cap_groups(new, unknown_cap, seed, key).withColumn("kind", F.lit("unknown")))


def manifest_counts(manifest: DataFrame) -> DataFrame:
    """(kind, key, n): known crops by split/class/year, unknown ones by class/year."""
    known = manifest.where("kind = 'known'").groupBy("kind", F.concat_ws("/", "split", "class", "year").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return known.unionByName(manifest.where("kind = 'unknown'").groupBy("kind", F.concat_ws("/", "class", "year").alias("key")).agg(F.count(F.lit(1)).alias("n")))


def role(manifest: DataFrame, which: str, known: list[str], years=None, classes=None, fraction: float = 0.15, seed: int = 42, key: str = "id") -> DataFrame:
    """The rows of a role (train, validation, test_known, test_unknown) with label: the class's place, -1 for unknown ones.
    Years and classes are filtered first; an empty role is an error."""
    df = manifest
    if years is not None:
        df = df.where(F.col("year").isin(list(years)))
    if classes is not None:
        df = df.where(F.col("class").isin(list(classes)))
    if which in ("train", "validation"):
        marked = validation_split(df.where("split = 'train'"), fraction, seed, key)
        df = marked.where("validation" if which == "validation" else "not validation").drop("validation")
    elif which in ("test_known", "test_unknown"):
        df = df.where(F.col("split") == ("test" if which == "test_known" else which))
    else:
        raise ValueError(f"a role is train, validation, test_known or test_unknown, not {which}")
    place = F.array_position(F.array(*[F.lit(c) for c in known]), F.col("class"))
    out = df.withColumn("label", F.lit(-1) if which == "test_unknown" else F.when(place > 0, place - 1).cast("int"))
    if not out.limit(1).count():
        raise ValueError(f"the role {which} has no rows in the years {years}")
    return out


def class_weights(df: DataFrame, by: str = "class") -> DataFrame:
    """df with weight = 1 / size of its class."""
    return df.join(df.groupBy(by).agg((1 / F.count(F.lit(1))).alias("weight")), by)


def weighted_sample(df: DataFrame, draws: int, seed: int = 42, weight: str = "weight", key: str = "id") -> DataFrame:
    """draws rows with replacement, in proportion to weight: (draw, columns). Draw i falls at a point that its hash decides
    on the line of the weights, laid end to end in order of key.

    The line is cut into the range partitions of one written table, whose totals place them on it; rows and draws of a
    partition are then merged in order."""
    spark = df.sparkSession
    dealt = df.where(F.col(weight) > 0).repartitionByRange(F.col(key)).sortWithinPartitions(key)
    placed = materialise(dealt.select(F.struct(*df.columns).alias("row"), F.col(weight).cast("double").alias("w"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "line")
    totals = placed.groupBy("part").agg(F.sum("w").alias("t"))  # a row a partition
    tops = [(r.part, r.t) for r in totals.orderBy("part").collect()]
    ends, whole = [], 0.0
    for _, t in tops:
        whole += t
        ends.append(whole)
    bases = spark.createDataFrame([(p, e - t) for (p, t), e in zip(tops, ends)], "part int, base double")

    @F.arrow_udf("int")
    def part_of(points: pa.Array) -> pa.Array:
        import numpy as np

        found = np.minimum(np.searchsorted(np.array(ends), points.to_numpy(zero_copy_only=False), "right"), len(tops) - 1)
        return pa.array(np.array([p for p, _ in tops], np.int32)[found], pa.int32())

    share = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "id")), 1, 12), 16, 10).cast("double") / float(16**12)
    fell = spark.range(draws if tops else 0).select(F.col("id").alias("draw"), (share * F.lit(whole)).alias("p")).withColumn("part", part_of("p"))
    run = F.sum("w").over(Window.partitionBy("part").orderBy("at")) - F.col("w")
    rows = placed.join(F.broadcast(bases), "part").select("part", (F.col("base") + run).alias("p"), F.lit(None).cast("bigint").alias("draw"), "row")
    both = rows.unionByName(fell.select("part", "p", "draw", F.lit(None).cast(placed.schema["row"].dataType).alias("row")))
    under = F.last("row", ignorenulls=True).over(Window.partitionBy("part").orderBy("p", F.col("draw").isNotNull(), "draw"))
    return both.withColumn("row", under).where("draw is not null").select("draw", "row.*")


def example_sample(df: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    return df.orderBy(*shuffled(seed, key)).limit(n)


# Tile manifests: key, site, year, is_positive, other_crown_count, source_tif


def site_positive_counts(manifest: DataFrame, year: int | None = None) -> DataFrame:
    df = manifest.where("is_positive = 1")
    return (df.where(F.col("year") == year) if year else df).groupBy("site").agg(F.count(F.lit(1)).alias("positives"))


def held_out_sites(manifest: DataFrame, fraction: float = 0.2, year: int = 2023, sites: list[str] | None = None) -> DataFrame:
    """Sites held out: those asked for, or, by falling count of positive tiles and without the largest, as many as reach
    the fraction of all, two at least."""
    counts = site_positive_counts(manifest, year)
    if sites:
        asked = manifest.sparkSession.createDataFrame([(s,) for s in sites], "site string")
        strange = [r.site for r in asked.join(counts, "site", "left_anti").collect()]
        if strange:
            raise ValueError(f"held-out sites without positive tiles: {sorted(strange)}")
        return asked
    order = Window.orderBy(F.desc("positives"), "site")  # a row a site
    ranked = counts.withColumn("rk", F.row_number().over(order)).withColumn("all", F.sum("positives").over(Window.partitionBy()))
    before = F.coalesce(F.sum(F.when(F.col("rk") > 1, F.col("positives")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a site is held out unless the sites before it (from the second on) already do
    return ranked.withColumn("before", before).where((F.col("rk") > 1) & ~((F.col("before") >= fraction * F.col("all")) & (F.col("rk") - 2 >= 2))).select("site")


def ablation_split(manifest: DataFrame, sites: DataFrame, first: int = 2023, second: int = 2025) -> DataFrame:
    """(key, part): test, train_first and train_both; a key may be in several parts."""
    of = manifest.select(F.col("key").cast("string").alias("key"), "site", "year")
    test = of.where(F.col("year") == first).join(F.broadcast(sites), "site", "left_semi")
    rest = of.where(F.col("year") == first).join(F.broadcast(sites), "site", "left_anti")
    name = lambda df, part: df.select("key", F.lit(part).alias("part"))
    return name(test, "test").unionByName(name(rest, "train_first")).unionByName(name(rest.unionByName(of.where(F.col("year") == second)), "train_both"))


def split_counts(manifest: DataFrame, parts: DataFrame) -> DataFrame:
    """(part, positive, negative, total) over the rows of the manifest whose key is in the part."""
    rows = manifest.select(F.col("key").cast("string").alias("key"), "is_positive").join(parts.distinct(), "key")
    positive = F.sum((F.col("is_positive") == 1).cast("bigint"))
    return rows.groupBy("part").agg(positive.alias("positive"), (F.count(F.lit(1)) - positive).alias("negative"), F.count(F.lit(1)).alias("total"))


def deployment_split(manifest: DataFrame, fraction: float = 0.1, seed: int = 0) -> DataFrame:
    """(key, part): of positive and of negative tiles max(1, round half even (n * fraction)) are for validation."""
    marked = validation_split(manifest, fraction, seed, "key", ("is_positive",))
    return marked.select(F.col("key").cast("string").alias("key"), F.when(F.col("validation"), "validation").otherwise("train").alias("part"))


def balanced_folds(manifest: DataFrame, folds: int = 5) -> DataFrame:
    """(site, fold): sites by falling count of tiles go to the fold that is smallest so far, the first of ties."""
    counts = manifest.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    listed = counts.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "site"))).alias("sites"))  # a row a site
    start = F.struct(F.array_repeat(F.lit(0).cast("bigint"), folds).alias("sizes"), F.array().cast("array<struct<site:string,fold:int>>").alias("out"))

    def step(acc, x):
        fold = F.array_position(acc["sizes"], F.array_min(acc["sizes"])).cast("int") - 1
        sizes = F.transform(acc["sizes"], lambda v, i: F.when(i == fold, v - x["less"]).otherwise(v))
        return F.struct(sizes.alias("sizes"), F.concat(acc["out"], F.array(F.struct(x["site"].alias("site"), fold.alias("fold")))).alias("out"))

    return listed.select(F.inline(F.aggregate("sites", start, step, lambda acc: acc["out"])))


def fold_roles(manifest: DataFrame, site_folds: DataFrame, folds: int = 5) -> DataFrame:
    """(fold, key, role): in each fold, val for the tiles of its sites, else train."""
    tiles = manifest.select("key", "site").join(F.broadcast(site_folds.withColumnRenamed("fold", "own")), "site")
    return tiles.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).select("fold", "key", F.when(F.col("own") == F.col("fold"), "val").otherwise("train").alias("role"))


def cross_year_roles(manifest: DataFrame, train: int = 2023, val: int = 2025) -> DataFrame:
    return manifest.where(F.col("year").isin(train, val)).select("key", F.when(F.col("year") == train, "train").otherwise("val").alias("role"))


def sample_negatives(candidates: DataFrame, positives: int, ratio: float = 3.0, hard_fraction: float = 0.7, seed: int = 42, key: str = "key") -> DataFrame:
    """int(ratio * positives) candidates: first round half even (hard_fraction of them) by falling other_crown_count (then
    key), the rest by a shuffle of what remains. Adds hard."""
    target = int(ratio * positives)
    hard = round(hard_fraction * target)
    # both takes are of the driver's two counts: sorts end in limits, no window over one partition
    first = candidates.orderBy(F.desc("other_crown_count"), key).limit(hard).withColumn("hard", F.lit(True))
    held = first.count()
    rest = candidates.join(first.select(key), key, "left_anti").orderBy(*shuffled(seed, key)).limit(max(0, target - held)).withColumn("hard", F.lit(False))
    return first.unionByName(rest)
