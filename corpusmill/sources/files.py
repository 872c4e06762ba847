"""Sources and sinks: article shards, line-delimited JSON, exam tables, raw lines, manifests."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmill.functions import text as T

EXAM = "question string, A string, B string, C string, D string, answer string"
PERSONA = (
    "persona_id string, profile map<string,string>, sessions array<struct<session_id int, date string, turns array<string>, annotations array<struct<turn int, type string, key string, value string>>>>, "
    "questions array<struct<qid string, type string, question string, options map<string,string>, answer string, keys array<string>, evidence array<array<int>>>>"
)
TOOLS = "tools array<struct<name string, description string, parameters string>>"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; in local mode without one, in a local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
    return f"{root.rstrip('/')}/corpusmill/{name}-{uuid.uuid4().hex}"


def shards(template: str, count: int, seed: int | None = None) -> list[str]:
    """Paths of numbered shards; {index} and {count} stand in the template.  With a seed, in its order."""
    order = range(count) if seed is None else sorted(range(count), key=lambda i: hashlib.sha256(f"{seed}:{i}".encode()).digest())
    return [template.format(index=i, count=count) for i in order]


def articles(spark: SparkSession, *paths: str, column: str = "markdown") -> DataFrame:
    """One column of Parquet shards, rows with text only; no other column is read."""
    return spark.read.parquet(*paths).select(column).where(F.col(column) != "")


def lines(spark: SparkSession, *paths: str, head: int | None = None) -> DataFrame:
    df = spark.read.text(list(paths))
    return df if head is None else df.limit(head)


def json_lines(spark: SparkSession, schema: str | StructType, *paths: str) -> tuple[DataFrame, DataFrame]:
    """Rows of well-formed lines, and the malformed lines apart; blank lines are neither."""
    raw = lines(spark, *paths).where(F.length(T.utrim("value")) > 0).withColumn("_good", T.is_json("value"))
    good = raw.where("_good").select(F.from_json("value", schema).alias("row")).select("row.*")
    return good, raw.where("not _good").select("value")


def exam_tables(spark: SparkSession, folder: str, splits: Iterable[str] = ("train", "val")) -> DataFrame:
    """All <subject>_<split>.csv of a folder as one table with subject and split; other splits are never opened."""
    paths = [f"{folder}/*_{s}.csv" for s in splits]
    rows = spark.read.csv(paths, schema=EXAM, header=True, multiLine=True, escape='"').withColumn("_file", F.regexp_extract("_metadata.file_name", r"([^/]+)_([a-z]+)\.csv$", 0))
    name = lambda n: F.regexp_extract("_file", r"^(.*)_([a-z]+)\.csv$", n)
    return rows.select(name(1).alias("subject"), name(2).alias("split"), *[c.split()[0] for c in EXAM.split(", ")])


def subjects(spark: SparkSession, folder: str, split: str = "train") -> list[str]:
    """Sorted names of the subjects that have a table of a split."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*_{split}.csv").load(folder).select(F.regexp_extract("path", rf"([^/]+)_{split}\.csv$", 1).alias("subject"))
    return [r["subject"] for r in found.distinct().orderBy("subject").collect()]


def hub_split(spark: SparkSession, path: str, subject: str, split: str) -> DataFrame:
    """The seven columns of one subject's split, from Parquet or lines of JSON."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.schema(EXAM).json(path)
    return df.select(F.lit(subject).alias("subject"), *[c.split()[0] for c in EXAM.split(", ")]).withColumn("split", F.lit(split))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """A local question file, by its extension; a missing column or an answer that is no letter fails the job."""
    df = spark.read.csv(path, header=True) if path.endswith(".csv") else spark.read.json(path)
    need = {"subject", "question", "A", "B", "C", "D", "answer"}
    if missing := need - set(df.columns):
        raise ValueError(f"columns missing: {sorted(missing)}")
    good = F.coalesce(F.col("answer").isin("A", "B", "C", "D"), F.lit(False))
    return df.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("answer isn't A-D: "), F.coalesce("answer", F.lit("null"))))))


def tool_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOOLS).option("multiLine", True).json(path).select(F.explode("tools").alias("tool")).select("tool.*")


def merged(*tables: DataFrame) -> DataFrame:
    """UNION ALL by name; columns that some lack are null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def json_text(*columns: str | Column) -> Column:
    """A row as JSON text, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def write_text(df: DataFrame, path: str, pretty: bool = False) -> None:
    """A table of one row, such as a run's summary, as one JSON document."""
    options = {"ignoreNullFields": "false", "pretty": str(pretty).lower()}
    df.coalesce(1).select(F.to_json(F.struct(*df.columns), options).alias("value")).write.text(path)


def write_run(summary: DataFrame, root: str, **predictions: DataFrame) -> None:
    """A run's folder: summary.json, and lines of JSON for each table of predictions."""
    write_text(summary, f"{root}/summary.json", pretty=True)
    for name, rows in predictions.items():
        write_json_lines(rows, f"{root}/{name}.jsonl")


def read_run(spark: SparkSession, root: str, summary: str | StructType, **schemas: str | StructType) -> tuple[DataFrame, dict[str, DataFrame]]:
    """What write_run() wrote."""
    return spark.read.schema(summary).option("multiLine", True).json(f"{root}/summary.json"), {n: spark.read.schema(s).json(f"{root}/{n}.jsonl") for n, s in schemas.items()}


def aligned(df: DataFrame, *columns: str, width: int = 14, digits: int = 4) -> DataFrame:
    """A report's lines (`line`): columns padded to one width, numbers with a fixed number of digits."""
    kinds = dict(df.dtypes)
    cell = lambda c: F.lpad(F.format_number(c, digits) if kinds[c] in ("double", "float") else F.coalesce(F.col(c).cast("string"), F.lit("-")), width, " ")
    return df.select(F.concat(*map(cell, columns)).alias("line"))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.select(json_text(*df.columns).alias("value")).write.text(path)


def checksum(df: DataFrame) -> DataFrame:
    """One row: how many rows, and 16 hex digits that any change of a row, but no order of rows, changes.

    Each row's SHA-256 counts, in two sums of 31 bits of it, so that no row is gathered anywhere.
    """
    row = F.sha2(json_text(*df.columns).cast("binary"), 256)
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring(row, at, 8), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    sums = df.agg(F.count(F.lit(1)).alias("rows"), part(1).alias("_a"), part(9).alias("_b"))
    return sums.select("rows", F.substring(F.sha2(F.concat_ws(":", "rows", "_a", "_b").cast("binary"), 256), 1, 16).alias("checksum"))
