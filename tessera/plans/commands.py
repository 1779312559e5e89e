"""The commands: each reads tables, runs operators and returns a DataFrame; registered with its parameters."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import importlib

from ..functions import geometry, text
from ..operators import detection, openset, retrieval, sampling, spatial
from ..registry import register
from ..sources import raster, sinks, tables, vector
from ..storage import materialise


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True) if path.endswith(".csv") else spark.read.parquet(path)


@register("build-index", candidates=..., output=..., id_column="fid", overwrite=False)
def build_index(spark, candidates, output, id_column, overwrite):
    """An index of candidate vectors (Parquet with an id and an embedding column) at output."""
    rows = _read(spark, candidates)
    built = retrieval.build_index(rows, id_column)
    sinks.write_index(built, output, overwrite)
    failed = retrieval.failures(rows, id_column)
    check = retrieval.index_check(spark.read.parquet(output))
    return check.crossJoin(failed.agg(F.count(F.lit(1)).alias("failed")))  # one row each


@register("query", index=..., query_id=..., id_column="source_id", top_k=100)
def query(spark, index, query_id, id_column, top_k):
    """The rows of an index nearest to one of them."""
    return retrieval.query(retrieval.load_index(spark.read.parquet(index)), query_id, id_column, top_k)


def _labelled(spark, index, annotations, id_column, label_column, month_column=None):
    return retrieval.labelled(retrieval.load_index(spark.read.parquet(index)), tables.read_annotations(spark, annotations, id_column), id_column, label_column, month_column)


@register("evaluate", index=..., annotations=..., id_column="id", label_column="class_id", month_column=None, max_k=100, output=None)
def evaluate(spark, index, annotations, id_column, label_column, month_column, max_k, output):
    """Ranking metrics of annotated rows; with output, query, class and monthly metrics are written there."""
    rows = materialise(_labelled(spark, index, annotations, id_column, label_column, month_column), "labelled")
    metrics = materialise(retrieval.query_metrics(rows, max_k), "metrics")
    if output:
        sinks.write_csv(metrics.drop("hits").join(rows.select("retrieval_id", "source_id", "month"), "retrieval_id"), f"{output}/query_metrics")
        sinks.write_csv(retrieval.class_summary(metrics, rows).orderBy(F.desc("mean_average_precision")), f"{output}/class_metrics")
        if month_column:
            sinks.write_csv(retrieval.monthly(metrics, rows), f"{output}/monthly_metrics")
        sinks.write_report(retrieval.summary(metrics, rows), f"{output}/summary")
    return retrieval.summary(metrics, rows)


@register("similarity", index=..., annotations=..., id_column="id", label_column="class_id", min_samples=20)
def similarity(spark, index, annotations, id_column, label_column, min_samples):
    """Mean and deviation of the similarity of every pair of frequent classes."""
    return retrieval.class_similarity(retrieval.frequent_classes(_labelled(spark, index, annotations, id_column, label_column), min_samples))


@register("build-manifest", detections=..., known=..., unknown=..., distance=3.0, train_cap=300, unknown_cap=200, seed=42, output=None)
def build_manifest(spark, detections, known, unknown, distance, train_cap, unknown_cap, seed, output):
    """The crop manifest of a detections table; its counts are returned."""
    rows = tables.read_detections(spark, detections)
    key = F.concat_ws("|", *tables_key())
    made = sampling.build_manifest(rows.withColumn("id", F.md5(key)), known.split(","), unknown.split(","), distance=distance, train_cap=train_cap, unknown_cap=unknown_cap, seed=seed)
    made = materialise(made, "manifest")
    if output:
        sinks.write_csv(made.where("kind = 'known'"), f"{output}/metadata_known")
        sinks.write_csv(made.where("kind = 'unknown'"), f"{output}/metadata_unknown")
    return sampling.manifest_counts(made)


def tables_key() -> list[str]:
    """Columns that tell detections apart."""
    return ["year", "source_path", "class", "tile_x", "tile_y", "x1", "y1", "x2", "y2"]


@register("evaluate-openset", features=..., train="train", years="2023,2025", knn_k=5, regularization=1e-6)
def evaluate_openset(spark, features, train, years, knn_k, regularization):
    """AUROC and OSCR of all eight scores over stored features: a table of id, label (-1 unknown), year, split, features and
    logits; split names the training rows. The head of the clipped score is fitted on the training rows."""
    rows = _read(spark, features).withColumn("predicted", openset.argmax("logits"))
    fitted, test = rows.where((F.col("split") == train) & (F.col("label") >= 0)), rows.where(F.col("split") != train)
    classes = fitted.agg(F.max("label")).first()[0] + 1
    head, bias = openset.train_head(fitted, classes)
    scored = openset.Mahalanobis.fit(fitted, regularization=regularization).score(openset.knn_score(openset.logit_scores(test), fitted, knn_k))
    scored = openset.react_energy(openset.ViM.fit(fitted, classes).score(scored), head, bias, openset.percentile_clip(fitted))
    methods = ["msp", "maxlogit", "energy", "entropy", "mahalanobis", "knn", "vim", "react"]
    return openset.evaluate(scored, methods, [int(y) for y in years.split(",")])[0]


@register("split-ablation", dataset=None, manifest=None, test_sites="", test_fraction=0.2, output=None)
def split_ablation(spark, dataset, manifest, test_sites, test_fraction, output):
    """Held-out sites of the first year and what the parts of the split hold."""
    root, path = tables.dataset_root(dataset, manifest)
    rows = tables.read_manifest(spark, path)
    sites = sampling.held_out_sites(rows, test_fraction, sites=[s.strip() for s in test_sites.split(",") if s.strip()] or None)
    parts = sampling.ablation_split(rows, sites)
    if output:
        sinks.write_partitioned_text(sinks.split_lists(parts.withColumnRenamed("part", "role"), "ablation", root), output, "file")
    return sampling.split_counts(rows, parts)


@register("split-deploy", dataset=None, manifest=None, validation_fraction=0.1, seed=0, output=None)
def split_deploy(spark, dataset, manifest, validation_fraction, seed, output):
    """A split of all tiles for watching a training run: its sites overlap, so it measures no generalisation."""
    root, path = tables.dataset_root(dataset, manifest)
    rows = tables.read_manifest(spark, path)
    parts = sampling.deployment_split(rows, validation_fraction, seed)
    if output:
        sinks.write_partitioned_text(sinks.split_lists(parts.withColumnRenamed("part", "role"), "deploy", root), output, "file")
    return sampling.split_counts(rows, parts)


def _callable(name: str):
    """A callable given as module:name, or an ONNX file as a segmenter."""
    if name.endswith(".onnx"):
        return detection.onnx_segmenter(name)
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


@register("crown-metrics", predictions=..., ground_truth=..., rasters=None, species_field="species", species_pattern="", mode="iou", iou_threshold=0.5, minimum_confidence=0.0, cell=50.0)
def crown_metrics(spark, predictions, ground_truth, rasters, species_field, species_pattern, mode, iou_threshold, minimum_confidence, cell):
    """Precision, recall and F1 of predicted against true crowns. predictions and rasters are lists of paths, held together by
    commas, in the same order: each layer is a plot, whose true crowns are those with their centroid on its raster. Without
    rasters, all true crowns count in each plot."""
    if mode not in ("iou", "centroid"):
        raise ValueError("mode must be iou or centroid")
    layers, grounds = predictions.split(","), rasters.split(",") if rasters else None
    if grounds and len(grounds) != len(layers):
        raise ValueError(f"{len(layers)} layers of predictions do not go with {len(grounds)} rasters")
    crowns = spatial.repaired(vector.species(vector.read_layer(spark, ground_truth), field=species_field, pattern=species_pattern), only_invalid=False)
    # a system of coordinates a file: two short answers for each of the files that were named
    system = lambda df: (df.select("crs").where("crs is not null").first() or [None])[0]
    true_crs, found, true = system(crowns), [], []
    for plot, path in enumerate(layers):
        layer = spatial.repaired(vector.read_layer(spark, path).withColumn("confidence", F.col("attributes")["confidence"].cast("double")), only_invalid=False)
        crs = system(layer) or true_crs
        mine = spatial.with_bounds(vector.to_crs(crowns, true_crs or crs, crs) if crs else crowns)
        mine = mine.select(F.lit(plot).alias("plot"), F.concat_ws("/", "file", "feature", "part").alias("id"), "ring", *spatial.BOX)
        if grounds:
            meta = raster.mapped_metadata(spark.createDataFrame([(grounds[plot],)], "path string"))
            box = raster.world_window(width="width", height="height", col="zero", row="zero")
            ground = meta.withColumn("zero", F.lit(0)).withColumn("b", box).select(F.lit(plot).alias("plot"), "crs", geometry.box_ring(tuple(F.col(f"b.{c}") for c in spatial.BOX)).alias("ring"))
            ground = spatial.with_bounds(vector.to_crs(ground, system(ground) or crs, crs) if crs else ground)
            mine = spatial.centroid_inside(mine, ground.select("plot", *spatial.BOX))
        found.append(spatial.with_bounds(layer).select(F.lit(plot).alias("plot"), F.concat_ws("/", "file", "feature", "part").alias("id"), "ring", *spatial.BOX, "confidence"))
        true.append(mine)
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    found, true = materialise(spatial.confident(union(found), minimum_confidence), "found"), materialise(union(true), "true")
    pairs = spatial.polygon_iou_pairs(found, true, cell, by=("plot",)) if mode == "iou" else spatial.polygon_centroid_pairs(found, true, cell, ("plot",))
    matches = spatial.match(pairs, iou_threshold if mode == "iou" else 1.0)
    return spatial.match_totals(spatial.match_counts(matches, found, true))


@register("scan", detector=..., source=..., output=..., tile_size=1024, stride=1024, margin_ratio=0.05, min_valid_ratio=0.5, confidence=0.45, iou=0.45)
def scan(spark, detector, source, output, tile_size, stride, margin_ratio, min_valid_ratio, confidence, iou):
    """The detections of a detector (module:name) on the tiles of all rasters of the sources (YEAR=PATH, by commas), written
    as CSV; their number by year and class is returned."""
    entries = [e.partition("=") for e in source.split(",")]
    if any(not mark or not year.strip().lstrip("+-").isdigit() for year, mark, _ in entries):
        raise ValueError("a source is given as YEAR=PATH")
    listed = raster.list_rasters(spark, [(int(year), path) for year, _, path in entries], "*.{tif,tiff}")
    if not listed.limit(1).count():
        raise ValueError("the sources hold no TIFF files")
    meta = raster.mapped_metadata(listed).join(listed, "path")
    at = lambda n: F.explode(geometry.inset_offsets(n, F.lit(tile_size), margin_ratio, F.lit(stride)))
    windows = meta.select("path", "year", "transform", "width", "height").withColumn("row_off", at("height")).withColumn("col_off", at("width"))
    tiles = raster.with_cover(raster.read_windows(windows.select("path", "row_off", "col_off", F.lit(tile_size).alias("width"), F.lit(tile_size).alias("height"))), min_valid_ratio)
    found = detection.scan_tiles(tiles, meta, _callable(detector), confidence, iou).drop("year").join(listed.withColumnRenamed("path", "source_path"), "source_path")
    found = materialise(found.select(*sampling.DETECTION_COLUMNS), "scan")
    sinks.write_csv(found, output)
    return found.groupBy("year", "class").agg(F.count(F.lit(1)).alias("detections"))


@register("detect", rasters=..., model=..., output=None, detection_confidence=0.25, keep_confidence=0.5, least_area=30.0, tile_m=56.0, overlap=0.5, centre_tolerance=2.0, size=1024, cell=32.0)
def detect(spark, rasters, model, output, detection_confidence, keep_confidence, least_area, tile_m, overlap, centre_tolerance, size, cell):
    """The crown layer of rasters (a folder, or a file): tiles are segmented, outlines that meet are stitched, stitched crowns
    are looked at again in a window about their centre, and what holds is kept. model is an ONNX file or module:name."""
    segmenter = _callable(model)
    listed = raster.list_rasters(spark, [(None, rasters)])
    meta = materialise(raster.mapped_metadata(listed), "rasters")
    look = lambda windows: detection.segment_tiles(raster.read_windows(windows), meta, segmenter, detection_confidence, size)
    outlines = spatial.repaired(look(detection.tile_windows(meta, tile_m, overlap, 8)))
    raw = materialise(spatial.with_bounds(outlines).withColumn("id", F.monotonically_increasing_id()), "outlines")
    # coordinates of rasters of other places do not meet; those of one place do, as on one raster
    labels, touching = spatial.dissolve(raw, cell)
    parts = spatial.stitched(raw, labels, touching)
    home = raw.join(labels, "id").groupBy("component").agg(F.min("path").alias("path"))
    stitched = parts.where("n_frag > 1").join(home, "component")
    centres = stitched.select("component", "path", ((F.col("minx") + F.col("maxx")) / 2).alias("x"), ((F.col("miny") + F.col("maxy")) / 2).alias("y"))
    again = spatial.repaired(look(detection.centred_windows(meta, centres, tile_m, 8).dropDuplicates(["path", "row_off", "col_off"])))
    again = materialise(spatial.with_bounds(again).withColumn("id", F.monotonically_increasing_id()), "again")
    judged = spatial.polygon_outcomes(parts, spatial.polygon_hits(parts, again, cell, centre_tolerance), keep=keep_confidence, least_area=least_area)
    layer = spatial.polygon_layer(judged)
    if output:
        sinks.write_geojson(layer, output)
    return layer


def _in_each_system(layer: DataFrame, systems: list[str]) -> DataFrame:
    """The polygons of a layer in each of the systems of the rasters, with their boxes."""
    own = (layer.select("crs").where("crs is not null").first() or ["OGC:CRS84"])[0]
    out = None
    for crs in systems:
        part = spatial.with_bounds(vector.to_crs(layer, own, crs)).withColumn("crs", F.lit(crs))
        out = part if out is None else out.unionByName(part)
    return out


@register("build-tiles", config=..., limit=0)
def build_tiles(spark, config, limit):
    """A data set of training tiles from a configuration (YAML): images, labels, manifest, folds and a split across years
    below output_dir, a folder that all executors see. Counts by year and kind are returned."""
    with open(config) as f:
        c = tables.load_config(tables.DatasetConfig, f.read())
    listed = raster.list_rasters(spark, [(2023, c.tif_root_2023), (2025, c.tif_root_2025)])
    if limit:
        listed = listed.limit(limit)
    meta = materialise(raster.plausible(raster.mapped_metadata(listed)).join(listed, "path"), "rasters")
    systems = sorted(r.crs for r in meta.select("crs").distinct().collect())  # the systems of the rasters
    layers = {}
    for year, path in ((2023, c.shapefile_2023), (2025, c.shapefile_2025)):
        whole = vector.read_layer(spark, path)
        if c.species_field not in {k for r in whole.select(F.map_keys("attributes").alias("k")).limit(1).collect() for k in r.k}:
            raise ValueError(f"{path} has no attribute {c.species_field}")
        for target in (True, False):
            if target or year == 2023:
                rows = _in_each_system(spatial.repaired(vector.species(whole, c.species_field, c.target_species_substring, target)), systems)
                rows = rows.select(F.lit(year).alias("year"), "crs", F.concat_ws("/", "file", "feature", "part").alias("id"), "ring", *spatial.BOX)
                layers[target] = layers[target].unionByName(rows) if target in layers else rows
    targets, others = (materialise(layers[t], "crowns") for t in (True, False))
    by, cell = ("year", "crs"), c.tile_size_m
    grid = detection.tile_windows(meta, c.tile_size_m, c.overlap).withColumn("centred", F.lit(False))
    if c.include_centered_tiles and systems:
        near = spatial.grid_join(targets, grid.select("path", *by, "raster_w", *spatial.BOX), cell, by).select(F.col("l.ring").alias("ring"), F.col("r.path").alias("path")).dropDuplicates(["path", "ring"])
        centre = geometry.centroid("ring")
        centres = near.select("path", centre["x"].alias("x"), centre["y"].alias("y"))
        grid = grid.unionByName(detection.centred_windows(meta, centres, c.tile_size_m).withColumn("centred", F.lit(True)).dropDuplicates(["path", "row_off", "col_off"]))
    site = text.site_name("path", "year")
    named = lambda centred: text.tile_key("year", site, "path", "row_off", "col_off", centred=centred)
    grid = grid.withColumn("site", site).withColumn("key", F.when(F.col("centred"), named(True)).otherwise(named(False)))
    shown = raster.with_data(raster.read_windows(grid), c.maximum_nodata_fraction).select("path", "row_off", "col_off").distinct()
    tiles = materialise(grid.join(shown, ["path", "row_off", "col_off"]), "tiles")
    lines = materialise(spatial.label_lines(tiles, targets, cell, by, "key", "id", c.minimum_crown_fraction, down=True), "lines")
    record = [F.col(x) for x in ("key", "site", "year")]
    positive = tiles.join(lines.select("key").distinct(), "key", "left_semi")
    seen = spatial.polygon_cover(tiles.where("not centred"), targets, cell, by, "key").where(F.col("visible") <= c.negative_exclusion_fraction).join(lines.select("key").distinct(), "key", "left_anti")
    candidates = spatial.polygon_cover(seen.drop("visible", "crowns"), others, cell, by, "key").withColumn("other_crown_count", F.col("crowns").cast("int")).drop("visible", "crowns")
    negative = sampling.sample_negatives(materialise(candidates, "candidates"), positive.count(), c.negative_to_positive_ratio, c.hard_negative_fraction, c.seed)
    chosen = positive.select(*tiles.columns, F.lit(1).alias("is_positive"), F.lit(0).alias("other_crown_count")).unionByName(negative.select(*tiles.columns, F.lit(0).alias("is_positive"), "other_crown_count"))
    chosen = materialise(chosen, "chosen")
    manifest = chosen.select(*record, "is_positive", "other_crown_count", F.col("path").alias("source_tif"))
    pixels = sinks.encode_tiles(raster.read_windows(chosen).join(chosen.select("path", "row_off", "col_off", "key").distinct(), ["path", "row_off", "col_off"]), c.output_pixels)
    sinks.write_files(pixels.select(F.concat(F.lit("images/"), "key", F.lit(".png")).alias("name"), F.col("image").alias("data")), c.output_dir)
    labels = sinks.label_files(lines, manifest)
    sinks.write_files(labels.select(F.concat(F.lit("labels/"), "key", F.lit(".txt")).alias("name"), F.col("value").alias("data")), c.output_dir)
    sinks.write_csv(manifest, f"{c.output_dir}/manifest")
    folds = sampling.fold_roles(manifest, sampling.balanced_folds(manifest)).select(F.concat(F.lit("fold"), "fold").alias("split"), "key", "role")
    roles = folds.unionByName(sampling.cross_year_roles(manifest).select(F.lit("crossyear").alias("split"), "key", "role"))
    sinks.write_csv(roles, f"{c.output_dir}/splits")
    return manifest.groupBy("year", "is_positive").agg(F.count(F.lit(1)).alias("tiles"))


@register("per-class", features=..., train="train", regularization=1e-6)
def per_class(spark, features, train, regularization):
    """How hard each unknown class is to tell from the known ones, and which of them it looks like: a table as for
    evaluate-openset, with class."""
    rows = _read(spark, features)
    fitted = rows.where((F.col("split") == train) & (F.col("label") >= 0))
    scorer = openset.Mahalanobis.fit(fitted, regularization=regularization)
    scored = scorer.score(rows.where(F.col("split") != train), name="score")
    # the place of the nearest mean stands for the label of that class
    label = F.array(*[F.lit(int(x)) for x in scorer.labels])
    return openset.per_unknown_class(scored.withColumn("nearest", F.get(label, F.col("nearest"))), len(scorer.labels))


@register("domain-gap", features=..., first=2023, second=2025)
def domain_gap(spark, features, first, second):
    """How far two years stand apart in the features of known test rows: a classifier's AUC, and shifts of class means."""
    rows = _read(spark, features).where(F.col("label") >= 0).where(F.col("year").isin(first, second))
    auc = openset.domain_auc(rows.withColumn("domain", (F.col("year") == second).cast("int")))
    return openset.centroid_shift(rows.withColumn("domain", F.col("year")), first, second).withColumn("domain_auc", F.lit(auc))


@register("visualize", index=..., annotations=..., output=..., id_column="id", label_column="class_id", min_samples=20)
def visualize(spark, index, annotations, output, id_column, label_column, min_samples):
    """The data of the figures, written below output: the cells of the class similarity map, and a point for each row (two
    principal components). Their numbers are returned."""
    rows = materialise(retrieval.frequent_classes(_labelled(spark, index, annotations, id_column, label_column), min_samples), "frequent")
    if rows.limit(3).count() < 3:
        raise ValueError("fewer than three rows belong to classes of that size")
    cells = retrieval.class_similarity(rows).withColumn("cell", F.format_string("%.2f\n±%.2f", "mean", "std"))
    points = retrieval.projection(rows)
    sinks.write_report(cells, f"{output}/class_similarity")
    sinks.write_report(points, f"{output}/points")
    return cells.agg(F.count(F.lit(1)).alias("cells")).crossJoin(points.agg(F.count(F.lit(1)).alias("points")))  # one row each


@register("lookalikes", root=..., pairs=..., examples=4)
def lookalikes(spark, root, pairs, examples):
    """Example crops of unknown classes and of the known classes they look like, from the manifests below root; pairs is
    UNKNOWN:KNOWN:AUROC by commas."""
    manifest = tables.read_crops(spark, root, "train").unionByName(tables.read_crops(spark, root, "test_unknown"))
    told = [(u, k, float(a)) for u, k, a in (x.split(":") for x in pairs.split(","))]
    return openset.lookalikes(manifest, told, examples)
