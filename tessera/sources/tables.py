"""Table sources: CSV with explicit schemas and checks, saved state, configuration files."""

from collections.abc import Callable
from dataclasses import dataclass, fields
from typing import Any, ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import require

DETECTIONS = (
    "year int, tif string, source_path string, class string, confidence double, center_x_geo double, center_y_geo double,"
    " tile_x int, tile_y int, x1 int, y1 int, x2 int, y2 int"
)
CROPS = "class string, year int, tif string, split string, confidence double, source_path string, relative_path string"
MANIFEST = "key string, site string, year int, is_positive int, other_crown_count int, source_tif string"
STATE = "positives array<struct<key: string, site: string, year: int, is_positive: int, source_tif: string>>, negatives array<struct<key: string, site: string, year: int, is_positive: int, source_tif: string, other_crown_count: int, column_offset: int, row_offset: int, width: int, height: int>>, _corrupt string"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, its columns taken by name in the types of the schema; a missing column is an error. NaN is null."""
    raw = spark.read.csv(path, header=True)
    wanted = [x.strip().split(" ") for x in schema.split(", ")]
    require(raw, [n for n, _ in wanted])
    rest = [c for c in raw.columns if c not in {n for n, _ in wanted}]
    number = lambda n, t: F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast(t)) if t in ("double", "int") else F.col(n).cast(t)
    return raw.select(*[number(n, t).alias(n) for n, t in wanted], *rest)


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, DETECTIONS)


def read_crops(spark: SparkSession, root: str, role: str) -> DataFrame:
    """The manifest of unknown crops for the role test_unknown, else that of known ones."""
    return read_csv(spark, f"{root}/metadata_{'unknown' if role == 'test_unknown' else 'known'}.csv", CROPS)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, MANIFEST)


def read_annotations(spark: SparkSession, path: str, id_col: str = "id") -> DataFrame:
    """Annotations with unique ids, as text."""
    df = require(spark.read.csv(path, header=True), [id_col]).withColumn(id_col, F.col(id_col).cast("string"))
    if df.groupBy(id_col).count().where("count > 1").limit(1).count():
        raise ValueError("annotation ids must be unique")
    return df


def dataset_root(dataset: str | None = None, manifest: str | None = None) -> tuple[str, str]:
    """(root, manifest): an explicit manifest wins over a directory."""
    if manifest:
        return manifest.rpartition("/")[0] or ".", manifest
    if dataset:
        return dataset.rstrip("/"), f"{dataset.rstrip('/')}/manifest.csv"
    raise ValueError("give a dataset or a manifest")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Per-raster state files that are whole: file, positives, negatives. Corrupt files count as unfinished work."""
    raw = spark.read.schema(STATE).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    return raw.select(F.input_file_name().alias("file"), "*").where("_corrupt is null and positives is not null and negatives is not null").drop("_corrupt")


def unfinished(jobs: DataFrame, state: DataFrame, key: str = "path") -> DataFrame:
    """Jobs without a finished state, matched by the state's name."""
    from ..functions.text import file_name, state_name

    return jobs.withColumn("__s", state_name(key)).join(state.select(file_name("file").alias("__s")), "__s", "left_anti").drop("__s")


@dataclass(frozen=True)
class Bound:
    """What a configuration value must keep to: words for it, and a test of the value and the whole configuration."""

    says: str
    holds: Callable[[Any, Any], bool]


POSITIVE, NOT_NEGATIVE = Bound("above 0", lambda v, _: v > 0), Bound("0 or more", lambda v, _: v >= 0)
SHARE = Bound("from 0 to 1", lambda v, _: 0 <= v <= 1)
INSIDE = Bound("between 0 and 1, without both", lambda v, _: 0 < v < 1)


def checked(config):
    """config, if each of its fields keeps to the bounds that its class lists."""
    wrong = [f"{name} = {getattr(config, name)!r} is not {b.says}" for name, bounds in config.BOUNDS.items() for b in bounds if not b.holds(getattr(config, name), config)]
    if wrong:
        raise ValueError("; ".join(wrong))
    return config


@dataclass(frozen=True)
class DatasetConfig:
    """How training tiles are cut; paths name the layer of crowns and the folder of rasters of each year."""

    output_dir: str = ""
    shapefile_2023: str = ""
    shapefile_2025: str = ""
    tif_root_2023: str = ""
    tif_root_2025: str = ""
    species_field: str = "species"
    target_species_substring: str = ""
    tile_size_m: float = 56.0
    overlap: float = 0.5
    output_pixels: int = 1024
    maximum_nodata_fraction: float = 0.30
    minimum_crown_fraction: float = 0.5
    negative_exclusion_fraction: float = 0.05
    include_centered_tiles: bool = True
    negative_to_positive_ratio: float = 3.0
    hard_negative_fraction: float = 0.7
    jpeg_quality: int = 95
    seed: int = 42
    BOUNDS: ClassVar = {
        **{name: (POSITIVE,) for name in ("tile_size_m", "output_pixels")},
        **{name: (SHARE,) for name in ("maximum_nodata_fraction", "minimum_crown_fraction", "hard_negative_fraction")},
        "overlap": (Bound("0 or more and below 1", lambda v, _: 0 <= v < 1),),
        "negative_exclusion_fraction": (NOT_NEGATIVE, Bound("below minimum_crown_fraction", lambda v, c: v < c.minimum_crown_fraction)),
        "negative_to_positive_ratio": (NOT_NEGATIVE,),
        "jpeg_quality": (Bound("from 1 to 100", lambda v, _: 1 <= v <= 100),),
    }


@dataclass(frozen=True)
class ExperimentConfig:
    """What decides an open-set data set and its scores."""

    dataset_root: str = ""
    artifacts_dir: str = "artifacts"
    known_classes: tuple[str, ...] = ()
    unknown_classes: tuple[str, ...] = ()
    seed: int = 42
    known_confidence: float = 0.45
    unknown_confidence: float = 0.55
    test_tif_fraction: float = 0.20
    train_cap_per_class_year: int | None = 300
    unknown_test_cap_per_class_year: int | None = 200
    crop_padding_ratio: float = 0.20
    image_size: int = 224
    batch_size: int = 32
    early_stopping_patience: int = 10
    supcon_temperature: float = 0.1
    knn_k: int = 5
    covariance_regularization: float = 1e-6
    BOUNDS: ClassVar = {
        "test_tif_fraction": (INSIDE,),
        "known_classes": (Bound("free of overlap with unknown_classes", lambda v, c: not set(v) & set(c.unknown_classes)),),
        **{name: (POSITIVE,) for name in ("image_size", "batch_size", "supcon_temperature", "knn_k")},
        **{name: (NOT_NEGATIVE,) for name in ("crop_padding_ratio", "covariance_regularization")},
    }


def load_config(kind, text: str | dict[str, Any]):
    """A configuration from YAML text (or a dict): keys it does not know are an error."""
    if isinstance(text, str):
        import yaml

        text = yaml.safe_load(text) or {}
    unknown = sorted(set(text) - {f.name for f in fields(kind)})
    if unknown:
        raise ValueError(f"unknown keys: {', '.join(unknown)}")
    return checked(kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in text.items()}))
