"""What the operators share: input tables, column packing and worker caches."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from ..storage import materialise, shared_dir

__all__ = ["ID", "REST", "TEXT", "ddl", "hot_keys", "in_small_batches", "materialise", "pack", "partitions", "shared_dir", "spread_join", "table", "trim", "unpack", "worker_cache"]

ID, TEXT, REST = "__id", "__text", "__rest"
BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def in_small_batches(spark: SparkSession) -> None:
    """Rows that hold whole texts go to Python workers in batches of BATCH_ROWS at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def ddl(kind: DataType) -> str:
    """A type as text for a schema, with every field name quoted."""
    if isinstance(kind, StructType):
        quoted = lambda n: "`" + n.replace("`", "``") + "`"
        return "struct<" + ", ".join(f"{quoted(f.name)}: {ddl(f.dataType)}" for f in kind) + ">"
    if isinstance(kind, ArrayType):
        return f"array<{ddl(kind.elementType)}>"
    if isinstance(kind, MapType):
        return f"map<{ddl(kind.keyType)}, {ddl(kind.valueType)}>"
    return kind.simpleString()


def pack(docs: DataFrame, id_col: str, text_col: str, own: list[str]) -> DataFrame:
    """Id, text and the other columns as one struct, so that no name of the input meets a name of ours.

    Input columns named as one of ``own`` give way to the operator's result of that name."""
    in_small_batches(docs.sparkSession)
    taken = {x.lower() for x in (id_col, text_col, *own)}
    rest = [c for c in docs.columns if c.lower() not in taken]
    packed = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(None).cast("int").alias("__none"))
    return docs.select(F.col(f"`{id_col}`").alias(ID), F.col(f"`{text_col}`").alias(TEXT), packed.alias(REST))


def unpack(df: DataFrame, like: DataFrame, id_col: str, text_col: str, own: dict) -> DataFrame:
    """The columns of ``like`` in their order, then the operator's own."""
    names = {x.lower() for x in own}
    out = []
    for c in like.columns:
        if c.lower() in names:
            continue
        at = {id_col.lower(): ID, text_col.lower(): TEXT}.get(c.lower())
        out.append(F.col(at).alias(c) if at else F.col(REST)[c].alias(c))
    return df.select(*out, *[v.alias(k) for k, v in own.items()])


def hot_keys(counts: DataFrame, key: str, spark: SparkSession) -> DataFrame:
    """(key, parts) of the keys that hold so many of the rows that one task should not: counts holds key and n.

    A key is hot from a quarter of a partition's even share on, so that there are at most four times as many hot keys as
    shuffle partitions: they may be broadcast whatever the size of the data."""
    share = 4 * partitions(spark)
    whole = counts.agg(F.sum("n").alias("whole"))  # one row
    parts = F.ceil(F.col("n") * share / F.col("whole")).cast("int")
    return counts.crossJoin(F.broadcast(whole)).where(F.col("n") * share > F.col("whole")).select(F.col(key), parts.alias("parts"))


def spread_join(many: DataFrame, one: DataFrame, key: str, hot: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """many joined with one (a row a key) on key, the rows of hot keys dealt over parts by a hash of the columns by; one's
    rows of hot keys are sent to each part."""
    salt = F.pmod(F.xxhash64(*by), F.coalesce("parts", F.lit(1))).cast("int")
    left = many.join(F.broadcast(hot), key, "left").withColumn("__salt", salt).drop("parts")
    right = one.join(F.broadcast(hot), key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return left.join(right, [key, "__salt"], how).drop("__salt")


def worker_cache(owner: str) -> dict:
    """A dict that lives across the tasks of a Python worker, for one operator at a time: the next operator's call frees it."""
    import pyspark

    held = pyspark.__dict__.get("_tessera_worker_cache")
    if held is None or held[0] != owner:
        pyspark._tessera_worker_cache = held = (owner, {})
        trim()
    return held[1]


def trim() -> None:
    """Hands memory that Python has freed back to the system, where the C library can."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
