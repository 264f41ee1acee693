"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import shutil
import site
import string
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import harborline

# The ASCII white space \x20 and \x09-\x0D that separates words and pads lines.
SPACES = " \t\n\x0b\f\r"
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Application -> folder of the archive it serves to its workers, kept until Python ends.
_sent: dict[str, tempfile.TemporaryDirectory] = {}


def with_package(spark: SparkSession) -> SparkSession:
    """Sends this package to Python workers, unless they start with it on their path:
    installed, on PYTHONPATH, or below the working directory of a local master."""
    context = spark.sparkContext
    home = os.path.dirname(os.path.dirname(os.path.abspath(harborline.__file__)))
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), *site.getsitepackages()]
    if context.master.startswith("local"):
        known.append(os.getcwd())
    there = home in [os.path.abspath(path) for path in known if path]
    if not there and context.applicationId not in _sent:
        folder = _sent[context.applicationId] = tempfile.TemporaryDirectory()
        context.addPyFile(shutil.make_archive(f"{folder.name}/harborline", "zip", home, "harborline"))
    return spark


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct ``row``, so that no name meets an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def held_out(doc_id: Column) -> Column:
    """Rows no model may learn from; a row without an id is not among them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def same(*pairs: tuple[Column, Column]) -> Column:
    """Join condition under which nulls are equal."""
    condition = F.lit(True)
    for position, (left, right) in enumerate(pairs):
        equal = left.eqNullSafe(right)
        condition = equal if position == 0 else condition & equal
    return condition


def uniform(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the columns alone."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 12)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(1 << 48))
