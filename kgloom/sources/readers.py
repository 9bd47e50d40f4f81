"""Sources: parquet tables, JSON lines, CSV with a byte-order mark, whole texts."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("label", T.StringType())])
KB = "entity_id STRING, name STRING, aliases ARRAY<STRING>, type STRING, description STRING"
NER = "text STRING, entities ARRAY<STRUCT<start:INT,end:INT,label:STRING>>"
RE = "text STRING, head STRUCT<start:INT,end:INT,label:STRING>, tail STRUCT<start:INT,end:INT,label:STRING>, label STRING"
MENTION = ("mention STRING, entity_type STRING, start INT, end INT, source_file STRING, entity_id STRING, kb_name STRING, kb_type STRING, "
           "link_score DOUBLE, normalized_entity STRING, disambiguation_confidence DOUBLE, disambiguation_method STRING, source STRING")
CANDIDATE = "entity STRING, entity_type STRING, start INT, end INT, source_file STRING, source STRING"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of a test-data folder (one file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a fixed schema; blank lines give no row."""
    df = spark.read.schema(schema).json(path)
    return df.where(F.coalesce(*[F.col(c).isNotNull() for c in df.columns]) & ~F.forall(F.array(*[F.col(c).isNull() for c in df.columns]), lambda x: x))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with header, quoted line breaks and an optional byte-order mark; an empty cell is null."""
    names = [f.strip().split()[0] for f in schema.split(",")]
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    typed = dict(zip(names, [f.strip().split()[1] for f in schema.split(",")]))
    return raw.select(*[F.expr(f"CAST(nullif(`{c}`, '') AS {typed[c]})").alias(c) for c in names])


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: ``source_file``, ``text``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("text"))
