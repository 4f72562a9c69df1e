"""Sources and sinks: JSON lines and documents, CSV with nested cells, journals, keyed score lookups, content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Object rows; blank lines are skipped; a damaged row fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_list(spark: SparkSession, path: str, schema: StructType | str, field: str | None = None) -> DataFrame:
    """A list of objects, or an object that holds one under `field`."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    if not field:
        return reader.schema(schema).json(path)
    inner = schema if isinstance(schema, str) else schema.simpleString()[7:-1]
    return reader.schema(f"{field} array<struct<{inner}>>").json(path).select(F.inline(field))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line, keys sorted."""
    df.select(*sorted(df.columns)).write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Nested cells as JSON."""
    nested = {f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")}
    df.select(*[F.to_json(c).alias(c) if c in nested else c for c in df.columns]).write.mode(mode).option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def union_sources(sources: dict[str, DataFrame], label: str = "source_label", key: str = "response_id") -> DataFrame:
    """All rows with their source's name; keys become label::key."""
    out = None
    for name, df in sources.items():
        df = df.withColumn(label, F.lit(name)).withColumn(key, F.concat_ws("::", F.lit(name), F.col(key).cast("string")))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def pending(work: DataFrame, journal: DataFrame, key: str) -> DataFrame:
    """Work that the journal doesn't hold yet."""
    return work.join(journal.select(key).distinct(), key, "left_anti")


def row_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("row_sha256", F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256))
