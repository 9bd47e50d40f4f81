"""Sinks: JSON lines, CSV with fixed columns, the nested graph document, tables in the shared folder."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """Fixed column order, header, nulls as empty cells."""
    df.select(*[F.col(c).cast("string") for c in fields]).na.fill("").write.mode("overwrite").csv(path, header=True, emptyValue="")


def graph_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per graph: counts, and nodes and relations in output order. A report of a bounded view (top-k), not of a whole graph."""
    n = nodes.agg(F.count("*").cast("int").alias("node_count"), F.sort_array(F.collect_list(F.struct("node_id", "name", "type", "link_score"))).alias("nodes"))
    e = edges.agg(F.count("*").cast("int").alias("edge_count"), F.sort_array(F.collect_list(F.struct("head", "relation", "tail", "confidence"))).alias("relations"))
    return n.crossJoin(e)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``. Where that is unset a local session (tests, bench) gets a folder of its own; a cluster is refused, as its machines share no temporary folder."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="kgloom-")
        spark.conf.set("spark.checkpoint.dir", own)
    return own


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it again: lineage is cut, the loss of an executor loses nothing."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
