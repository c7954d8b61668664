"""Panels and codebooks from text files; result tables to files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from panelwise.functions.guards import clean
from panelwise.operators.views import duplicate_keys
from panelwise.panel import Hierarchy, Panel


def to_number(col):
    """Text to DOUBLE; text that is no number, NaN and infinities become NULL."""
    return clean(F.expr(f"try_cast(`{col}` AS DOUBLE)"))


def read_period_files(
    spark: SparkSession,
    folder: str,
    hierarchy: Hierarchy,
    entity: str = "entity",
    pattern: str = r"(\d{4})\.csv$",
) -> Panel:
    """One CSV per period, the period in the file name; its first line is the header.

    Columns may differ between files in number, order and name: files with equal
    headers are read together with that schema, and a column absent in a period is
    NULL there. The driver sees file names and header lines only, one per period.
    """
    own = hierarchy.indicators
    layouts: dict[tuple[str, ...], list[str]] = {}
    for file in spark.read.text(f"{folder}/[0-9][0-9][0-9][0-9].csv").inputFiles():
        names = tuple(c.strip() for c in spark.read.option("header", True).csv(file).columns)
        layouts.setdefault(names, []).append(file)
    data = None
    for names, files in sorted(layouts.items()):
        if entity not in names:
            raise ValueError(f"no column {entity!r} in {files}")
        places = {n: f"_c{i}" for i, n in reversed(list(enumerate(names)))}
        schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))])
        rows = spark.read.option("header", True).schema(schema).csv(files)
        period = F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).cast("int")
        values = [(to_number(places[c]) if c in places else F.lit(None).cast("double")).alias(c) for c in own]
        part = rows.select(F.trim(F.col(places[entity])).alias("entity"), period.alias("period"), *values)
        data = part if data is None else data.unionByName(part)
    if data is None:
        raise ValueError(f"no file named by a year in {folder}")
    return Panel(data.where((F.col("entity") != "") & F.col("period").isNotNull()), hierarchy)


def check_unique(panel: Panel) -> Panel:
    """Fail on an entity that occurs twice in a period."""
    found = duplicate_keys(panel.data).head(1)
    if found:
        raise ValueError(f"duplicate entity in a period: {found[0].asDict()}")
    return panel


def read_codebook(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """A codebook CSV: strings trimmed, blank rows dropped, required columns checked."""
    raw = spark.read.option("header", True).csv(path)
    missing = [c for c in required if c not in raw.columns]
    if missing:
        raise ValueError(f"codebook {path} lacks columns {missing}")
    trimmed = raw.select(*[F.trim(F.col(c)).alias(c) for c in required])
    return trimmed.where(F.coalesce(F.col(required[0]), F.lit("")) != "")


def hierarchy_from(codebook: DataFrame, indicator: str, criterion: str, cost: Sequence[str] = ()) -> Hierarchy:
    """The hierarchy is schema: one row per indicator column, read to the driver.

    A table wider than any schema is refused."""
    rows = codebook.select(indicator, criterion).distinct().limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("a hierarchy has one row per indicator column; this table has more than 10000")
    groups: dict[str, list[str]] = {}
    for row in sorted(rows):
        groups.setdefault(row[1], []).append(row[0])
    return Hierarchy({k: tuple(v) for k, v in sorted(groups.items())}, frozenset(cost))


def read_prediction_matrix(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A matrix whose first column names the entity; every other column to numbers."""
    reader = spark.read.option("header", True)
    raw = reader.schema(schema).csv(path) if schema else reader.csv(path)
    first, *others = raw.columns
    return raw.select(F.trim(F.col(first)).alias("entity"), *[to_number(c).alias(c) for c in others])


def write_table(
    df: DataFrame,
    path: str,
    format: str = "parquet",
    digits: int | None = None,
    partition_by: Sequence[str] = (),
    mode: str = "errorifexists",
) -> str:
    """Write a result as parquet, csv or json; ``digits`` rounds the doubles."""
    if digits is not None:
        doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
        df = df.select(*[F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns])
    writer = df.write.mode(mode).partitionBy(*partition_by) if partition_by else df.write.mode(mode)
    if format == "csv":
        writer = writer.option("header", True)
    writer.format(format).save(path)
    return path


def write_all(
    tables: Mapping[str, DataFrame], folder: str, format: str = "parquet", digits: int | None = None
) -> DataFrame:
    """Write every table under its own folder; returns the manifest ``(name, path, format, n_rows)``."""
    spark = next(iter(tables.values())).sparkSession
    manifest = None
    for name, df in tables.items():
        path = write_table(df, f"{folder}/{name}", format, digits)
        back = spark.read.schema(df.schema).format(format).option("header", format == "csv").load(path)
        line = back.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("name"), F.lit(path).alias("path"), F.lit(format).alias("format"), "n_rows"
        )
        manifest = line if manifest is None else manifest.unionByName(line)
    return manifest
