"""Sources (S01-S07)."""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators.normalize import WAZUH_SCHEMA
from .heads import file_heads

ACTIVITY_SCHEMA = (
    "activity_id string, timestamp timestamp, dataset_id string, dataset_name string, operation string, "
    "actor string, actor_host string, source_ip string, destination_ip string, records_accessed bigint, "
    "records_modified bigint, sensitive_columns array<string>, export_size_bytes bigint, "
    "export_destination string, context map<string,string>"
)
FEED_SCHEMA = (
    "ioc_type string, ioc_value string, classification string, threat_category string"
)


def read_csv_headered(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV with a header row; every value is text, short rows are filled with ``""``.

    Files are split among tasks unless ``multi_line`` says that quoted values hold line breaks; then
    each file is one task. Raises ValueError when the header is blank.
    """
    df = (
        spark.read.option("header", True).option("mode", "PERMISSIVE").option("multiLine", multi_line)
        .option("escape", '"').option("emptyValue", "").option("nullValue", "\u0000").csv(path)
    )
    # Spark names a blank header cell _c<position>
    if not df.columns or all(c.strip() == "" or c == f"_c{i}" for i, c in enumerate(df.columns)):
        raise ValueError("CSV file has no header row")
    return df.na.fill("")


def _heads(spark: SparkSession, path: str) -> DataFrame:
    """Openings of all files; of a store that only Spark reads, by its whole files, empty ones from its listing."""
    found = file_heads(spark, path)
    if found is not None:
        return found
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    # the listing has encoded addresses, the source plain ones with fewer slashes
    listed = spark.createDataFrame([(re.sub(r"^(\w+):/+", r"\1:/", unquote(f)),) for f in files.inputFiles()], "path string")
    files = files.withColumn("path", F.regexp_replace("path", r"^(\w+):/+", "$1:/"))
    nothing = F.lit("").cast("binary")
    empty = listed.join(files.select("path"), "path", "left_anti").select("path", F.lit(0).cast("bigint").alias("length"), nothing.alias("content"))
    line = F.regexp_replace(F.decode("content", "ISO-8859-1"), r"^(\x{EF}\x{BB}\x{BF})?[ \t\n\r\x0b\f]+", "")
    return files.select("path", "length", "content").unionByName(empty).withColumn("first", F.substring(line, 1, 1)).withColumn(
        # a closing bracket at the end of the first line
        "whole_line", F.when(F.col("first") == "{", F.rtrim(F.split(line, r"[\r\n]", 2)[0]).endswith("}"))
    )


def read_json_auto(spark: SparkSession, path: str, on_error: str = "raise", single: str = "auto") -> DataFrame:
    """JSON array, single object or JSON Lines, told apart by the files' openings; the data are read once for the schema.

    A malformed row makes the whole read fail (``on_error="raise"``) or is kept in
    ``_corrupt_record`` (``"keep"``). ``single`` says whether ``{`` files hold one object
    (``"object"``), lines (``"lines"``) or are told by their first line (``"auto"``): lines if its brackets are all closed.
    """
    found = {(r["first"], r["whole_line"]) for r in _heads(spark, path).where("first <> ''").select("first", "whole_line").distinct().limit(4).collect()}
    firsts = {first for first, _ in found}
    if not firsts or not firsts <= {"[", "{"}:
        raise ValueError("File does not appear to be valid JSON (expected object or array)")
    whole = "[" in firsts or single == "object" or (single == "auto" and any(line is False for _, line in found))
    reader = spark.read.option("multiLine", whole)
    if on_error != "raise":
        return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    try:
        return reader.option("mode", "FAILFAST").json(path)
    except (PySparkException, Py4JJavaError) as error:  # the schema is inferred by a job, whose error comes as it is
        if "MALFORMED_RECORD" not in str(error):
            raise
        raise ValueError("Malformed JSON") from error


def read_parquet_profile(spark: SparkSession, path: str) -> DataFrame:
    """Parquet as it is; row count and schema come from the footers."""
    return spark.read.parquet(path)


def validate_files(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """One verdict row per file below ``path``, empty ones included: extension, size, content versus extension.

    Files are refused for their size only beyond ``max_bytes``, if given (uploads take ``UPLOAD_MAX_BYTES``).
    Tasks read a file's opening bytes only.
    """
    return file_verdicts(_heads(spark, path).select("path", "length", "content"), max_bytes)


def file_verdicts(files: DataFrame, max_bytes: int | None = fv.UPLOAD_MAX_BYTES) -> DataFrame:
    name = F.element_at(F.split(F.regexp_replace("path", r"\\", "/"), "/"), -1)
    suffix = F.lower(F.when(name.rlike(r".\.[^.]+$"), F.substring_index(name, ".", -1)).otherwise(F.lit("")))
    # 64 bytes tell, unless they are all blank
    start = F.decode(F.substring("content", 1, 64), "ISO-8859-1")
    head = F.when(start.rlike(r"^[ \t\n\r\x0b\f]*$"), F.decode(F.col("content"), "ISO-8859-1")).otherwise(start)
    magic = F.substring(head, 1, 4) == "PAR1"
    opening = F.substring(F.regexp_replace(head, r"^[ \t\n\r\x0b\f]+", ""), 1, 1)
    json_like = opening.isin("{", "[")
    problem = (
        F.when(~suffix.isin(*fv.UPLOAD_EXTENSIONS), "unsupported extension")
        .when(F.lit(False) if max_bytes is None else F.col("length") > max_bytes, "too large")
        .when(F.col("length") == 0, "empty")
        .when((suffix == "parquet") & ~magic, "not parquet: missing magic bytes")
        .when(suffix.isin("json", "jsonl") & ~json_like, "not json")
        .when((suffix == "csv") & magic, "parquet content in csv")
        .when((suffix == "csv") & json_like, "json content in csv")
    )
    return files.select(
        "path", name.alias("file_name"), suffix.alias("extension"), F.col("length").alias("size_bytes"),
        problem.isNull().alias("accepted"), F.coalesce(problem, F.lit("")).alias("problem"),
    )


def read_wazuh_alerts(spark: SparkSession, path: str) -> DataFrame:
    """SIEM agent alerts, one JSON object a line; blank lines are skipped."""
    return spark.read.schema(WAZUH_SCHEMA).json(path)


def read_wazuh_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(WAZUH_SCHEMA).json(path)


def parse_wazuh_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Alert JSON held in a text column, e.g. from a message queue."""
    text = F.col(column)
    return lines.where(F.trim(text) != "").select(F.from_json(text, WAZUH_SCHEMA).alias("a")).select("a.*")


def read_dataset_activity(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.format(fmt).schema(ACTIVITY_SCHEMA).load(path)


def read_ti_feed(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Indicator feed: a Parquet table, or the small built-in development feed."""
    if path is not None:
        return spark.read.schema(FEED_SCHEMA).parquet(path)
    return spark.createDataFrame(list(fv.FEED), FEED_SCHEMA)


def from_adapter(raw: DataFrame, adapter: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Custom telemetry (U05): any function DataFrame -> normalized DataFrame."""
    return adapter(raw)
