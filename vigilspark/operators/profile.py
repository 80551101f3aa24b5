"""Dataset profiling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fv
from ..functions import short_id, words_in
from ..functions.redaction import strip

# fixed values: names of the column types in profiles of Parquet data
_TYPE_NAMES = {
    "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float",
    "double": "double", "string": "string", "boolean": "bool", "binary": "binary", "date": "date32[day]",
    "timestamp": "timestamp[us, tz=UTC]", "timestamp_ntz": "timestamp[us]",
}


def type_name(data_type: T.DataType) -> str:
    if isinstance(data_type, T.ArrayType):
        return f"list<element: {type_name(data_type.elementType)}>"
    text = data_type.simpleString()
    return _TYPE_NAMES.get(text, text.replace("decimal(", "decimal128(").replace(",", ", "))


def normal_name(name: Column) -> Column:
    return F.translate(F.lower(strip(name)), "- ", "__")


def _any(text: Column, patterns: Sequence[str]) -> Column:
    """One of the patterns occurs; ``\\b`` borders are those of Unicode words."""
    return text.rlike("(?iU)" + "|".join(f"(?:{p})" for p in patterns))


def _kind(text: Column, table: Sequence[tuple[list[str], str]], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for words, kind in reversed(table):
        hit = words_in(text, words)
        if kind == "pan":
            hit = hit | (text == "pan")
        out = F.when(hit, F.lit(kind)).otherwise(out)
    return out


def classify_column_name(name: Column) -> Column:
    """STRUCT<pii_type, sensitivity> for a column name, null when the name says nothing."""
    text = normal_name(name)
    return (
        F.when(
            text.isin(*fv.CRITICAL_EXACT) | _any(text, fv.CRITICAL_NAMES),
            F.struct(_kind(text, fv.CRITICAL_KINDS, "credential_or_identity").alias("pii_type"), F.lit("CRITICAL").alias("sensitivity")),
        )
        .when(
            _any(text, fv.HIGH_NAMES),
            F.struct(_kind(text, fv.HIGH_KINDS, "financial").alias("pii_type"), F.lit("HIGH").alias("sensitivity")),
        )
        .when(
            text.isin(*fv.MEDIUM_EXACT) | _any(text, fv.MEDIUM_NAMES),
            F.struct(_kind(text, fv.MEDIUM_KINDS, "personal_identifier").alias("pii_type"), F.lit("MEDIUM").alias("sensitivity")),
        )
    )


def classify_value(value: Column) -> Column:
    """STRUCT<pii_type, sensitivity> for one trimmed value, null when nothing matches."""
    out = F.lit(None)
    for pattern, kind, level in reversed(fv.VALUE_KINDS):
        out = F.when(
            value.rlike("(?U)" + pattern), F.struct(F.lit(kind).alias("pii_type"), F.lit(level).alias("sensitivity"))
        ).otherwise(out)
    return out


def is_integer_text(value: Column) -> Column:
    return value.rlike(r"(?U)^[+-]?\d+(_\d+)*\z")


def is_float_text(value: Column) -> Column:
    return value.rlike(
        r"(?iU)^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?\z|^[+-]?(inf|infinity|nan)\z"
    )


def numbered_sample(df: DataFrame, order_by: Sequence[str], rows: int = fv.SAMPLE_ROWS) -> DataFrame:
    """First rows in an explicit order, numbered. At most ``rows`` rows reach one task."""
    order = [F.col(c) for c in order_by]
    return df.orderBy(*order).limit(rows).withColumn("_row_no", F.row_number().over(Window.orderBy(*order)))


def column_facts(df: DataFrame, row_no: Column, sample_values: int | None = fv.SAMPLE_VALUES) -> DataFrame:
    """Statistics, type and value class per column (P02-P04): (position, name, sampled_rows, null_ratio, ...).

    One aggregate over all columns side by side, whose partial results are one row a task: no value leaves
    its task. Distinct values are counted by 8-byte hashes per column, merged before they
    are shuffled by column and hash, so neither a wide table nor a dominant value is one task's.
    ``sample_values`` limits value classification to the first non-empty values in the order of
    ``row_no``, for samples that fit in a task; None looks at all of them.
    """
    names = [c for c in df.columns if c != "_row_no"]
    text = [strip(F.col(f"`{c}`").cast("string")) for c in names]
    wide = df.select(row_no.alias("at"), *[F.when(t != "", t).alias(f"t{i}") for i, t in enumerate(text)])
    if sample_values is not None:
        upto = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        wide = wide.select("*", *[F.count(f"t{i}").over(upto).alias(f"r{i}") for i in range(len(names))])
    facts = [F.count("*").alias("rows")]
    for i in range(len(names)):
        value = F.col(f"t{i}")
        kind = classify_value(value)
        looked = kind.isNotNull() if sample_values is None else kind.isNotNull() & (F.col(f"r{i}") <= sample_values)
        facts.append(F.struct(
            F.count(value).alias("filled"),
            F.coalesce(F.bool_and(is_integer_text(value)), F.lit(False)).alias("all_int"),
            F.coalesce(F.bool_and(is_float_text(value)), F.lit(False)).alias("all_float"),
            F.min_by(kind, F.when(looked, F.col("at"))).alias("value_kind"),
        ).alias(f"f{i}"))
    columns = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"), F.col(f"f{i}").alias("f")) for i, c in enumerate(names)])
    found = wide.agg(*facts).select("rows", F.explode(columns).alias("c")).select("rows", "c.position", "c.name", "c.f.*")
    hashes = F.array(*[F.struct(F.lit(i).alias("its"), F.when(F.col(f"t{i}").isNotNull(), F.xxhash64(f"t{i}")).alias("hash")) for i in range(len(names))])
    distinct = (
        wide.select(F.explode(hashes).alias("h")).select("h.*").where("hash is not null").distinct()
        .groupBy("its").agg(F.count("*").alias("unique_values"))
    )
    unique = F.coalesce("unique_values", F.lit(0))
    return found.where("rows > 0").join(distinct, F.col("position") == F.col("its"), "left").select(
        "position", "name", F.col("rows").alias("sampled_rows"),
        F.round(1 - F.col("filled") / F.col("rows"), 4).alias("null_ratio"),
        F.when(F.col("filled") > 0, F.round(1 - unique / F.col("filled"), 4)).otherwise(0.0).alias("duplicate_ratio"),
        F.when(F.col("all_int"), "integer").when(F.col("all_float"), "float").otherwise("string").alias("inferred_type"),
        "value_kind",
    )


def profile_columns(
    df: DataFrame, order_by: Sequence[str], sample_rows: int | None = fv.SAMPLE_ROWS,
    sample_values: int | None = fv.SAMPLE_VALUES, declared_types: bool = True,
) -> DataFrame:
    """Column profiles of one dataset. ``sample_rows=None`` scans everything."""
    if sample_rows is None:
        facts = column_facts(df, F.struct(*order_by), None)
    else:
        facts = column_facts(numbered_sample(df, order_by, sample_rows), F.col("_row_no"), sample_values)
    declared = {f.name: type_name(f.dataType) for f in df.schema.fields}
    types = F.create_map(*[F.lit(x) for kv in declared.items() for x in kv])
    kind = F.coalesce(classify_column_name(F.col("name")), F.col("value_kind"))
    return facts.select(
        "position", "name",
        (types[F.col("name")] if declared_types else F.col("inferred_type")).alias("data_type"),
        kind.isNotNull().alias("is_sensitive"),
        kind["pii_type"].alias("pii_type"),
        F.coalesce(kind["sensitivity"], F.lit("LOW")).alias("sensitivity"),
        "sampled_rows", "null_ratio", "duplicate_ratio", "inferred_type",
    )


LEVELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level)


def file_bytes(df: DataFrame) -> DataFrame:
    """One row with the summed size of the files that ``df`` reads; 0 where it reads none or none is left in its plan."""
    try:
        files = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    except AnalysisException:
        return df.groupBy().agg(F.lit(0).cast("bigint").alias("size_bytes"))
    return files.groupBy("file").agg(F.max("bytes").alias("bytes")).agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("size_bytes"))


def profile_dataset(
    df: DataFrame, file_name: str, fmt: str, order_by: Sequence[str], sample_rows: int | None = fv.SAMPLE_ROWS,
    size_bytes: int | None = None, name: str | None = None,
) -> DataFrame:
    """One catalog row for a dataset, its columns nested (bounded by the schema's width).

    ``size_bytes`` defaults to the size of the files that ``df`` reads.
    """
    columns = profile_columns(df, order_by, sample_rows, declared_types=fmt == "parquet")
    column = F.struct(
        "position", "name", "data_type", "is_sensitive", "pii_type", "sensitivity", "null_ratio", "duplicate_ratio",
    )
    nested = columns.groupBy().agg(F.array_sort(F.collect_list(column)).alias("columns"))
    counted = df.groupBy().agg(F.count("*").alias("record_count"))
    sized = file_bytes(df) if size_bytes is None else counted.select(F.lit(size_bytes).cast("bigint").alias("size_bytes"))
    by_name = F.array_sort(F.transform("columns", lambda c: F.struct(c["name"].alias("name"), c["data_type"].alias("type"))))
    signature = F.array_join(F.transform(by_name, lambda c: F.concat(c["name"], F.lit(":"), c["type"])), ":")
    stem = file_name.rsplit(".", 1)[0]
    return (
        nested.withColumn("k", F.lit(1)).join(counted.withColumn("k", F.lit(1)), "k").join(sized.withColumn("k", F.lit(1)), "k").drop("k")
        .withColumn("schema_hash", short_id("", signature))
        .select(
            short_id("ds-", F.lit(file_name), ":", F.col("schema_hash"), length=12).alias("dataset_id"),
            F.lit(name or stem).alias("name"), F.lit(fmt).alias("format"), F.lit("not-persisted").alias("file_path"),
            "size_bytes", "record_count",
            F.size("columns").alias("column_count"), "columns",
            F.transform(F.filter("columns", lambda c: c["is_sensitive"]), lambda c: c["name"]).alias("sensitive_columns"),
            F.element_at(
                F.array(*[F.lit(x) for x in LEVELS]),
                F.array_max(F.transform("columns", lambda c: level_rank(c["sensitivity"]))).cast("int"),
            ).alias("sensitivity"),
            "schema_hash",
        )
    )


def profile_catalog(assets: Sequence[DataFrame]) -> DataFrame:
    """Catalog of many datasets; one row per dataset id, of equal ids the first by name, format, records and size."""
    catalog = assets[0]
    for asset in assets[1:]:
        catalog = catalog.unionByName(asset)
    first = F.min_by(F.struct("*"), F.struct("name", "format", "record_count", "size_bytes"))
    return catalog.groupBy("dataset_id").agg(first.alias("row")).select("row.*")


def catalog_columns(catalog: DataFrame) -> DataFrame:
    """Columns of a catalog in long form."""
    return catalog.select("dataset_id", F.col("name").alias("dataset_name"), F.explode("columns").alias("c")).select(
        "dataset_id", "dataset_name", "c.*"
    )
