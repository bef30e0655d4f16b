"""Reading exports and writing tables: archives, categories, CSV, managed tables, TSV, model files."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Suffixes of exported files and the category of each.
CATEGORIES = {"_alarms": "alarms", "_annotations": "annotations", "_eventlog": "eventlog", "_liftlog": "liftlog", "_raw": "raw"}

RAW_SCHEMA = "timestamp_utc timestamp, tagname string, bool_val boolean, int_val int, float_val double"
LIFTLOG_SCHEMA = "movementid long, movementtype int, started timestamp, movementduration double"
ALARM_SCHEMA = "timestamp_utc timestamp, id int, text string"


def read_csv(spark: SparkSession, path: str | list[str], schema: str | StructType | None, category: str | None = None, file_column: str | None = None) -> DataFrame:
    """CSV files with a header. category keeps the files of that suffix; file_column names their origin."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    if category is not None:
        suffix = next(s for s, c in CATEGORIES.items() if c == category)
        reader = reader.option("pathGlobFilter", f"*{suffix}.csv").option("recursiveFileLookup", True)
    df = reader.csv(path)
    return df if file_column is None else df.withColumn(file_column, F.col("_metadata.file_path"))


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length, category of the files below path, without their content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    category = F.lit(None).cast("string")
    for suffix, value in CATEGORIES.items():
        category = F.when(name.endswith(f"{suffix}.csv"), value).otherwise(category)
    return files.select("path", "length", name.alias("name"), category.alias("category"))


def unzip_lines(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    """archive, member, category, line_number, line of all CSV members of the archives below path.

    An archive is one task's work; members are read as streams, line by line.
    """
    archives = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.namelist():
                        category = next((c for s, c in CATEGORIES.items() if member.endswith(f"{s}.csv")), None)
                        with archive.open(member) as stream:
                            rows: list[tuple] = []
                            for n, line in enumerate(io.TextIOWrapper(stream, "utf-8")):
                                rows.append((name, member, category, n, line.rstrip("\r\n")))
                                if len(rows) == 50_000:
                                    yield pd.DataFrame(rows, columns=COLUMNS)
                                    rows = []
                            if rows:
                                yield pd.DataFrame(rows, columns=COLUMNS)

    return archives.select("path", "content").mapInPandas(run, "archive string, member string, category string, line_number long, line string")


COLUMNS = ["archive", "member", "category", "line_number", "line"]


def save_table(df: DataFrame, name: str, format: str = "parquet", partition_by: list[str] | None = None, merge_schema: bool = False) -> None:
    """Overwrite a managed table. The new table has df's columns; with merge_schema, the old one's
    others follow them, as nulls (a column of both has df's type). df must not read the table."""
    spark = df.sparkSession
    if merge_schema and spark.catalog.tableExists(name):
        old = spark.table(name).schema
        have = {c.lower() for c in df.columns}
        df = df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in old if f.name.lower() not in have])
    writer = df.write.mode("overwrite").format(format).option("overwriteSchema", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text with a header; one file per partition."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).schema(schema).csv(path)


def write_model(spark: SparkSession, path: str, config: dict, tables: dict[str, DataFrame]) -> None:
    """A model as files: its settings as JSON, its tables (trees, scalers, weights) as Parquet."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    row = [(json.dumps({"config": config, "tables": sorted(tables)}),)]
    spark.createDataFrame(row, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def read_model(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame]]:
    head = json.loads(spark.read.text(f"{path}/config").first()["value"])
    return head["config"], {name: spark.read.parquet(f"{path}/{name}") for name in head["tables"]}
