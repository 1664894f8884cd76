"""Dataset tables and prediction shards."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sftprep.config import ColumnNames, check_format, check_split
from sftprep.sources.quoted_lines import quoted_records

# The cell texts that count as missing in a CSV file.
NA_VALUES = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


def messages_type(names: ColumnNames = ColumnNames()) -> T.ArrayType:
    turn = [T.StructField(names.role, T.StringType()), T.StructField(names.content, T.StringType())]
    return T.ArrayType(T.StructType(turn))


def record_schema(
    data_type: str, preference: bool = False, names: ColumnNames = ColumnNames()
) -> T.StructType:
    """Schema of the four record kinds: structural or conversational, with or without pairs."""
    if data_type == "structural":
        targets = [names.chosen, names.rejected] if preference else [names.target]
        fields = [(c, T.StringType()) for c in (names.instruction, names.data, *targets)]
    elif data_type == "conversational":
        columns = [names.chosen, names.rejected] if preference else [names.messages]
        fields = [(c, messages_type(names)) for c in columns]
    else:
        raise ValueError(f"unknown data type: {data_type!r}")
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_json(
    spark: SparkSession, path: str, lines: bool, schema: T.StructType | None = None
) -> DataFrame:
    """JSON Lines, or files that hold one array of objects each."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.option("multiLine", not lines).json(path)


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """Guess the delimiter from the header line; a comma if nothing stands out."""
    header = spark.read.text(path).first()
    try:
        return csv.Sniffer().sniff(header.value if header else "").delimiter
    except csv.Error:
        return ","


def missing_to_null(cell: Column, na_values: Sequence[str] = NA_VALUES) -> Column:
    return F.when(~cell.isin(list(na_values)), cell)


def read_csv(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    na_values: Sequence[str] = NA_VALUES,
    multi_line: bool = False,
) -> DataFrame:
    """CSV with a header and doubled quotes, every column a string, missing markers null.

    Without ``sep`` the delimiter is guessed. ``multi_line`` accepts line breaks in quoted
    cells; files are still read in splits, at the price of a pass that counts quotes and of
    Arrow batches. It expects every quote inside a cell to be doubled and the cell quoted, and
    all files to have the header of the first. Cells beyond the header's are dropped, missing
    ones null.
    """
    sep = sep or sniff_delimiter(spark, path)
    options = {"sep": sep, "quote": '"', "escape": '"'}
    reader = spark.read.options(header=True, multiLine=multi_line, **options)
    raw = reader.csv(path)
    if multi_line:
        raw = _parsed_records(quoted_records(spark, path), raw.columns, options)
    return raw.select(*[missing_to_null(raw[f"`{c}`"], na_values).alias(c) for c in raw.columns])


def _parsed_records(records: DataFrame, columns: list[str], options: dict[str, str]) -> DataFrame:
    """The cells of records; blank ones are left out."""
    fields = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(columns))])
    record = F.regexp_replace("record", "\\r$", "")
    cells = F.from_csv(record, fields.simpleString()[7:-1].replace(":", " "), {**options, "maxCharsPerColumn": "-1"})
    parsed = records.filter(F.trim("record") != "").select(cells.alias("x"))
    return parsed.select(*[F.col(f"x.c{k}").alias(c) for k, c in enumerate(columns)])


def parse_messages(df: DataFrame, column: str, names: ColumnNames = ColumnNames()) -> DataFrame:
    """Turn JSON text (a conversation kept in a CSV cell) into a message list."""
    return df.withColumn(column, F.from_json(column, messages_type(names), {"mode": "FAILFAST"}))


def load_dataset(
    spark: SparkSession,
    data_path: str,
    dataset_name: str,
    dataset_format: str,
    split: str,
    schema: T.StructType | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Read ``<data_path>/<dataset_name>.<dataset_format>`` with the reader of its format.

    Wrong splits and formats are rejected before any Spark job. ``multi_line`` is that of
    ``read_csv``.
    """
    check_split(split)
    check_format(dataset_format)
    path = f"{data_path}/{dataset_name}.{dataset_format}"
    if dataset_format == "parquet":
        return read_parquet(spark, path, schema)
    if dataset_format in ("json", "jsonl"):
        return read_json(spark, path, lines=dataset_format == "jsonl", schema=schema)
    sep = "\t" if dataset_format == "tsv" else None
    return read_csv(spark, path, sep, multi_line=multi_line)


def read_prediction_shards(
    spark: SparkSession,
    path: str,
    target: str = "response",
    na_values: Sequence[str] = NA_VALUES,
) -> DataFrame:
    """All shards below ``path``: index, target, device from the path, batch from there or a column.

    Takes partition directories (``device_num=0/batch_idx=3/``) as well as flat names
    (``device_num=0-batch_idx=3.csv``). Generations hold no line breaks, so files split.
    """
    location = F.col("_metadata.file_path")

    def from_path(name: str) -> Column:
        digits = F.regexp_extract(location, rf"{name}=(\d+)", 1)
        return F.when(digits != "", digits.cast("bigint")).alias(name)

    schema = T.StructType(
        [
            T.StructField("index", T.LongType()),
            T.StructField(target, T.StringType()),
            T.StructField("batch_idx", T.LongType()),
        ]
    )
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .csv(path)
        .select(
            "index",
            missing_to_null(F.col(target), na_values).alias(target),
            from_path("device_num").cast("int").alias("device_num"),
            F.coalesce(from_path("batch_idx"), F.col("batch_idx")).alias("batch_idx"),
        )
    )
