"""Delimited source scan and typed table files."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline import schema
from harborline.operators.quality import QualityError, missing_columns
from harborline.session import SPREAD

# Cell texts read as null.
NULL_TOKENS = [
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
]

# One- and two-digit months and days are both accepted.
DATE_FORMAT = "M/d/yyyy"
ENCODING = "windows-1252"
# Of stored tables; smaller than Spark's default.
PARQUET_CODEC = "zstd"
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
OPEN_FOLDERS = 16


def read_source(
    spark: SparkSession,
    path: str | Sequence[str],
    encoding: str = ENCODING,
    date_format: str = DATE_FORMAT,
    null_tokens: Iterable[str] = tuple(NULL_TOKENS),
    multi_line: bool = False,
) -> DataFrame:
    """Order lines from delimited text, with our names and types.

    Columns are found by header name in any order. A malformed row, date or
    number fails the job. ``multi_line`` allows line breaks inside quotes, at
    the price of one task per file.
    """
    charset, stored, meant = _charset(encoding)
    reader = spark.read.options(
        header=True, encoding=charset, escape='"', multiLine=multi_line,
        mode="FAILFAST", enforceSchema=False,
    )
    # Without inference this reads the first line only.
    text = reader.csv(path)
    absent = missing_columns(text, schema.SOURCE_NAMES)
    if absent:
        raise QualityError(f"Missing columns: {', '.join(absent)}")
    tokens = list(null_tokens)
    return text.select(
        *[
            _typed(
                F.col(f"`{source}`"), schema.LINES[name].dataType, tokens, date_format, stored, meant
            ).alias(name)
            for source, name in schema.SOURCE_NAMES.items()
        ]
    )


def _charset(encoding: str) -> tuple[str, str, str]:
    """A charset that Spark reads by itself, and the characters to put for others.

    Windows code pages of one byte a character are read and written as Latin-1, which
    maps bytes to the first 256 code points; those that the code page means otherwise
    are exchanged afterwards. So no setting of the session is touched.
    """
    page = encoding.lower().removeprefix("windows-")
    if page == encoding.lower() or not page.isdigit():
        return encoding, "", ""
    pairs = []
    for byte in range(0x80, 0x100):
        meant = bytes([byte]).decode(f"cp{page}", "replace")
        if meant != chr(byte) and meant != "\ufffd":
            pairs.append((chr(byte), meant))
    return "ISO-8859-1", "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def _typed(
    cell: Column, kind: T.DataType, tokens: list[str], date_format: str, stored: str, meant: str
) -> Column:
    value = F.when(~cell.isin(tokens), cell) if tokens else cell
    if isinstance(kind, T.StringType):
        return F.translate(value, stored, meant) if stored else value
    if isinstance(kind, T.DateType):
        return F.to_date(value, date_format)
    return value.cast(kind)


def read_table(spark: SparkSession, path: str, table: T.StructType | None = None) -> DataFrame:
    """A typed table written by :func:`write_table`."""
    reader = spark.read.schema(table) if table is not None else spark.read
    return reader.parquet(path)


def read_delimited_table(spark: SparkSession, path: str, table: T.StructType) -> DataFrame:
    """A delimited table with known columns, such as an exported summary."""
    return spark.read.schema(table).csv(
        path, header=True, escape='"', mode="FAILFAST", enforceSchema=False
    )


def spread(spark: SparkSession, path: str) -> int:
    """How many times more shuffle partitions stored text needs: compressed, its rows are wide."""
    return SPREAD if any(f.endswith(".gz") for f in spark.read.text(path).inputFiles()) else 1


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet, one file per task; ``partition_by`` gives folder pruning.

    A task keeps a file open per folder, up to ``OPEN_FOLDERS``; it sorts its rows by
    folder, which can spill all of them, only where there are more.
    """
    writer = df.write.mode("overwrite").option("compression", PARQUET_CODEC)
    if not partition_by:
        writer.parquet(path)
        return
    conf = df.sparkSession.conf
    before = conf.get(OPEN_FILES, None)
    conf.set(OPEN_FILES, str(OPEN_FOLDERS))
    try:
        writer.partitionBy(*partition_by).parquet(path)
    finally:
        conf.unset(OPEN_FILES) if before is None else conf.set(OPEN_FILES, before)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table this package wrote."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


MANIFEST = "manifest.json"


def publish(spark: SparkSession, output: str, run: str, tables: dict[str, T.StructType]) -> None:
    """Make the tables of a finished run the current ones, all at once.

    The manifest is written aside and renamed over the old one, so a reader finds one
    whole set or the other. Runs before the one that is replaced are removed; the
    replaced one stays for those who still read it.
    """
    before = manifest(spark, output)
    fs = spark._jvm.org.apache.hadoop.fs
    context = fs.FileContext.getFileContext(fs.Path(output).toUri(), spark._jsc.hadoopConfiguration())
    aside = fs.Path(f"{output}/{run}/{MANIFEST}")
    system = aside.getFileSystem(spark._jsc.hadoopConfiguration())
    entry = {"run": run, "tables": {name: table.json() for name, table in tables.items()}}
    stream = system.create(aside, True)
    stream.write(json.dumps(entry).encode())
    stream.close()
    renames = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    renames[0] = fs.Options.Rename.OVERWRITE
    context.rename(system.makeQualified(aside), system.makeQualified(fs.Path(f"{output}/{MANIFEST}")), renames)
    kept = {run, before["run"] if before else run}
    for status in system.globStatus(fs.Path(f"{output}/run-*")) or []:
        if status.getPath().getName() not in kept:
            system.delete(status.getPath(), True)


def manifest(spark: SparkSession, output: str) -> dict | None:
    """The current run of ``output`` and its tables' schemas; None before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{output}/{MANIFEST}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return json.loads(spark.read.text(f"{output}/{MANIFEST}", wholetext=True).first()[0])


def published(spark: SparkSession, output: str) -> dict[str, DataFrame]:
    """The tables of the last run that finished."""
    current = manifest(spark, output)
    if current is None:
        raise FileNotFoundError(f"no finished run under {output}")
    found = {}
    for name, text in current["tables"].items():
        table = T.StructType.fromJson(json.loads(text))
        found[name] = read_table(spark, f"{output}/{current['run']}/{name}", table).select(*table.names)
    return found


def write_delimited(df: DataFrame, path: str, compression: str | None = None) -> None:
    """UTF-8 text with a header and ISO dates; readers know a ``compression`` by itself."""
    _text(df, compression).csv(path, header=True, dateFormat="yyyy-MM-dd", escape='"')


# A compressed file is read by one task, so it holds no more rows than this.
COMPRESSED_ROWS = 1_000_000


def _text(df: DataFrame, compression: str | None) -> DataFrameWriter:
    writer = df.write.mode("overwrite")
    if compression is None:
        return writer
    return writer.options(compression=compression, maxRecordsPerFile=COMPRESSED_ROWS)


def write_source(
    lines: DataFrame,
    path: str,
    encoding: str = ENCODING,
    date_format: str = DATE_FORMAT,
    compression: str | None = None,
) -> None:
    """Order lines in the layout :func:`read_source` reads."""
    charset, stored, meant = _charset(encoding)

    def written(name: str) -> Column:
        text = stored and isinstance(lines.schema[name].dataType, T.StringType)
        return F.translate(F.col(name), meant, stored) if text else F.col(name)

    named = lines.select(
        *[written(name).alias(source) for source, name in schema.SOURCE_NAMES.items()]
    )
    _text(named, compression).csv(
        path, header=True, encoding=charset, dateFormat=date_format, escape='"'
    )
