"""CSV and Parquet readers, schema reports and pre-flight checks."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lakeward.functions import columns as c

# Tokens the reference names as missing, and the ones its CSV
# reader treats as missing on its own.
NA_VALUES = ["", "NULL", "null", "NA"]
DEFAULT_NA_VALUES = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    separator: str = ",",
    encoding: str = "utf-8",
    header: bool = True,
    na_values: Sequence[str] = NA_VALUES,
    multiline: bool = False,
) -> DataFrame:
    """CSV with several missing-value tokens.

    Spark's own ``nullValue`` knows one token, so fields are read as text,
    the tokens nulled, and the columns cast: to ``schema`` when given (no
    extra pass), else to the types one pass over the data finds. ``multiline``
    allows line breaks in quoted fields, at the price of unsplittable files.
    """
    cleaned = without_tokens(csv_text(spark, path, separator, encoding, header, multiline), na_values)
    if schema is None:
        return cast_to(cleaned, infer_types(cleaned))
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if len(schema.fields) != len(cleaned.columns):
        raise ValueError(f"{len(schema.fields)} declared columns, {len(cleaned.columns)} in the file")
    return cast_to(cleaned.toDF(*schema.names), schema)


def csv_text(
    spark: SparkSession,
    path: str,
    separator: str = ",",
    encoding: str = "utf-8",
    header: bool = True,
    multiline: bool = False,
) -> DataFrame:
    """CSV fields as text; quotes inside quoted fields are doubled."""
    return spark.read.csv(
        path, sep=separator, encoding=encoding, header=header, quote='"', escape='"', multiLine=multiline
    )


def without_tokens(text: DataFrame, na_values: Sequence[str] = NA_VALUES) -> DataFrame:
    """Text columns with the missing-value tokens as nulls."""
    tokens = list(dict.fromkeys([*na_values, *DEFAULT_NA_VALUES]))
    return text.select(
        *[F.when(~F.col(f"`{n}`").isin(tokens), F.col(f"`{n}`")).alias(n) for n in text.columns]
    )


def cast_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns as the types of ``schema``; a value that has not its type is an error."""

    def strict(f: T.StructField) -> Column:
        value = F.col(f"`{f.name}`")
        cast = value.try_cast(f.dataType)
        reason = F.concat(F.lit(f"{f.name} is not {f.dataType.simpleString()}: "), value)
        bad = value.isNotNull() & cast.isNull()
        return F.when(bad, F.raise_error(reason).cast(f.dataType)).otherwise(cast).alias(f.name)

    return df.select(*[strict(f) for f in schema.fields])


def infer_types(df: DataFrame) -> T.StructType:
    """Narrowest of bigint, double, boolean and string that fits each text column.

    One aggregate over all columns; only its single row reaches the driver.
    """
    tests = {
        "bigint": (T.LongType(), c.lenient_bigint),
        "double": (T.DoubleType(), c.lenient_double),
        "boolean": (T.BooleanType(), lambda text: F.when(F.lower(text).isin("true", "false"), text)),
    }
    counts = []
    for i, name in enumerate(df.columns):
        column = F.col(f"`{name}`")
        counts.append(F.count(column).alias(f"n{i}"))
        counts += [F.count(parse(column)).alias(f"{kind}{i}") for kind, (_, parse) in tests.items()]
    found = df.agg(*counts).first()
    schema = T.StructType()
    for i, name in enumerate(df.columns):
        fitting = [kind for kind in tests if found[f"{kind}{i}"] == found[f"n{i}"]]
        # A column without values fits everything; it stays text.
        schema.add(name, tests[fitting[0]][0] if fitting and found[f"n{i}"] else T.StringType())
    return schema


def csv_schema(spark: SparkSession, path: str, **options) -> dict[str, str]:
    """Column types that fit all rows; one aggregate over the file."""
    cleaned = without_tokens(csv_text(spark, path, **options), ())
    return {f.name: f.dataType.simpleString() for f in infer_types(cleaned).fields}


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and Spark's own type inference; only empty fields are null."""
    return spark.read.csv(path, header=True, inferSchema=True, quote='"', escape='"')


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*[f"`{c}`" for c in columns])


def schema_of(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def schema_report(df: DataFrame) -> DataFrame:
    """Columns in order with their type and number of values, in one pass."""
    counts = df.agg(*[F.count(F.col(f"`{n}`")).alias(f"c{i}") for i, n in enumerate(df.columns)])
    lines: list[Column] = [
        F.struct(
            F.lit(i + 1).cast("bigint").alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col(f"c{i}").alias("filled"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return counts.select(F.inline(F.array(*lines)))


def file_sizes(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """Path and length of the files below a path; contents are not read."""
    listing = spark.read.format("binaryFile").options(
        pathGlobFilter=pattern, recursiveFileLookup="true"
    )
    return listing.load(path).select("path", "length")


def check_source(spark: SparkSession, path: str, kind: str) -> tuple[bool, str]:
    """Whether a source can be read, and why not. Reads footers at most."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(target):
        return False, f"not found: {path}"
    if kind == "csv":
        # A folder of part files is how Spark writes one CSV.
        readable = files.getFileStatus(target).isFile() or files.listStatus(target)
        return (True, "") if readable else (False, f"no files: {path}")
    try:
        spark.read.format(kind).load(path).schema
    except (PySparkException, Py4JJavaError) as error:
        reason = next(line for line in str(error).splitlines() if line.strip())
        return False, f"unreadable {kind}: {reason}"
    return True, ""
