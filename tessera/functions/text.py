"""String expressions of the data sets: names, keys and labels."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vector import col


def file_name(path) -> Column:
    return F.regexp_extract(col(path), r"([^/]*)$", 1)


def stem(path) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def site_name(path, year) -> Column:
    """In 2025: "2025-" and the second part of the stem; else the first part of the stem."""
    parts = F.split(stem(path), "_")
    return F.when(col(year) == 2025, F.concat(F.lit("2025-"), F.coalesce(F.get(parts, F.lit(1)), F.lit("unknown")))).otherwise(parts[0])


def class_name(name) -> Column:
    return F.upper(F.split_part(col(name), F.lit("_"), F.lit(1)))


def tile_key(year, site, path, row, column, centred: bool = False) -> Column:
    mark = "__center_r" if centred else "__r"
    return F.concat(col(year).cast("string"), F.lit("__"), col(site), F.lit("__"), stem(path), F.lit(mark), col(row).cast("string"), F.lit("_c"), col(column).cast("string"))


def crop_name(name, year, path, number) -> Column:
    return F.concat(col(name), F.lit("_"), col(year).cast("string"), F.lit("_"), stem(path), F.lit("_"), F.lpad(col(number).cast("string"), 6, "0"), F.lit(".png"))


def safe_id(value) -> Column:
    return F.regexp_replace(col(value).cast("string"), "[^A-Za-z0-9_.-]+", "_")


def state_name(path) -> Column:
    return F.concat(F.substring(stem(path), 1, 60), F.lit("__"), F.substring(F.md5(col(path)), 1, 16), F.lit(".json"))


def site_list(text) -> Column:
    return F.filter(F.transform(F.split(col(text), ","), lambda x: F.trim(x)), lambda x: x != "")


def percent_label(confidence) -> Column:
    return F.concat(F.round(col(confidence) * 100).cast("int").cast("string"), F.lit("%"))


def parse_source(entry) -> Column:
    """(year, path) of "YEAR=PATH"; null where it is not of that form."""
    m = F.regexp_extract(col(entry), r"^\s*([+-]?[0-9]+)\s*=(.*)$", 1)
    return F.when(m != "", F.struct(m.cast("int").alias("year"), F.regexp_extract(col(entry), r"^[^=]*=(.*)$", 1).alias("path")))


def translate(messages: dict[str, dict[str, str]], language, key, fallback: str = "en") -> Column:
    """A message in a language, else in the fallback language, else its key."""
    table = F.create_map(*[F.lit(x) for lang, m in messages.items() for k, v in m.items() for x in (f"{lang}:{k}", v)])
    return F.coalesce(table[F.concat(col(language), F.lit(":"), col(key))], table[F.concat(F.lit(f"{fallback}:"), col(key))], col(key))


def data_uri(data, mime: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.base64(col(data)))
