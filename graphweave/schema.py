"""The fixed property-graph schema: node and edge tables, identifiers, and the bounds of call parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR = T.ArrayType(T.DoubleType(), False)
_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "timestamp": T.TimestampType(), "vector": VECTOR}


def _struct(spec: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in map(str.split, spec.split(", "))])


NODES: dict[str, T.StructType] = {
    "Article": _struct("title string, category string, word_count int, expansion_state string, expansion_depth int, claimed_at timestamp, processed_at timestamp, retry_count int"),
    "Section": _struct("section_id string, title string, content string, embedding vector, level int, word_count int"),
    "Category": _struct("name string, article_count int"),
    "Entity": _struct("entity_id string, name string, type string, description string"),
    "Fact": _struct("fact_id string, content string"),
    "Chunk": _struct("chunk_id string, content string, embedding vector, article_title string, section_index int, chunk_index int"),
}
EDGES: dict[str, T.StructType] = {
    "HAS_SECTION": _struct("src string, dst string, section_index int"),
    "LINKS_TO": _struct("src string, dst string, link_type string"),
    "IN_CATEGORY": _struct("src string, dst string"),
    "HAS_ENTITY": _struct("src string, dst string"),
    "HAS_FACT": _struct("src string, dst string"),
    "ENTITY_RELATION": _struct("src string, dst string, relation string, context string"),
    "HAS_CHUNK": _struct("src string, dst string, section_index int, chunk_index int"),
}
STATES = ("discovered", "claimed", "loaded", "processed", "failed")


def create_tables(spark: SparkSession, prefix: str = "") -> list[str]:
    """Empty tables of the whole schema in the session's catalog; existing ones are left alone."""
    made = []
    for name, shape in {**NODES, **EDGES}.items():
        full = f"{prefix}{name}".lower()
        if not spark.catalog.tableExists(full):
            spark.createDataFrame([], shape).write.format("parquet").saveAsTable(full)
            made.append(full)
    return made


def drop_tables(spark: SparkSession, prefix: str = "") -> None:
    for name in (*EDGES, *NODES):
        spark.sql(f"DROP TABLE IF EXISTS `{prefix}{name}`".lower())


def missing_tables(spark: SparkSession, prefix: str = "") -> list[str]:
    """Names of the schema that the catalog lacks."""
    there = {t.name for t in spark.catalog.listTables()}
    return sorted(n for n in (f"{prefix}{x}".lower() for x in (*NODES, *EDGES)) if n not in there)


def section_id(title: Column, index: Column) -> Column:
    return F.concat(title, F.lit("#"), index.cast("string"))


def chunk_id(title: Column, section: Column, chunk: Column) -> Column:
    return F.concat(title, F.lit("|s"), section.cast("string"), F.lit("|c"), chunk.cast("string"))


def article_of(section: Column) -> Column:
    """The title inside a section id; a title that holds # itself is cut there."""
    return F.substring_index(section, "#", 1)


def bounded(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}, got {value}")
    return value


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df marked for broadcast if it has no more than `most` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def top(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each key in the given order, numbered from 1.

    The number is filtered right where it is made, so Spark keeps only k rows of a key in every task
    before it shuffles.
    """
    from pyspark.sql import Window

    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
