"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot order or product is split inside the join even when the next
    # aggregate then needs one more exchange. That exchange only appears when a
    # skewed partition was actually measured, and the partial aggregate in front
    # of it has already folded the hot key.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# Sizing by stored input. Shuffles start with one partition per 128 MB, and
# adaptive execution merges those that turn out small; the upper limits, parameters
# of size_for, keep the number of shuffle blocks (scan tasks times partitions)
# manageable at 100 TB.
MB = 1 << 20
PARTITION_BYTES = 128 * MB
MAX_SHUFFLE_PARTITIONS = 32_768
MAX_SCAN_TASKS = 100_000
MAX_SCAN_BYTES = 1024 * MB
DEFAULT_SPLIT = "134217728b"

# A stored line of some 20 bytes becomes a row of 100 to 500 in an exchange, a sort or an
# aggregate. Where such rows are shuffled, there are SPREAD times as many partitions, and
# adaptive execution merges them up to ADVISORY_BYTES (its own default: 64 MB).
SPREAD = 16
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
ADVISORY_BYTES = 16 * MB

FIRST_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
SPLIT = "spark.sql.files.maxPartitionBytes"

_local_folder: str | None = None
# Paths handed out since the innermost temporary() began.
_handed_out: list[list[str]] = []


def build(app: str = "harborline", cores: int | str = "*") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else str(cores))
        .getOrCreate()
    )


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings this package relies on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shuffle_partitions(
    stored: int, configured: int, most: int | None = None
) -> int:
    """First number of shuffle partitions for an input of that many bytes."""
    return max(configured, min(-(-stored // PARTITION_BYTES), most or MAX_SHUFFLE_PARTITIONS))


def scan_bytes(stored: int) -> int:
    """Bytes per scan task, larger for inputs that would need very many tasks."""
    return min(max(stored // MAX_SCAN_TASKS, PARTITION_BYTES), MAX_SCAN_BYTES)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of the files behind a path or pattern."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.globStatus(target) or []
    return sum(system.getContentSummary(status.getPath()).getLength() for status in found)


def size_for(spark: SparkSession, path: str, most: int | None = None, spread: int = 1) -> None:
    """Set the partition settings to the stored size of ``path``.

    ``spread`` says how many times more shuffle partitions the stored bytes need, as rows
    in memory are wider; merged partitions are then kept small too, unless the session's
    owner gave their size. Settings of the session's owner are never lowered. What an earlier call raised
    for another input is taken back first, so each input gets its own sizes. ``most``
    replaces the upper limit of shuffle partitions.
    """
    stored = stored_bytes(spark, path)
    for key, default in ((FIRST_PARTITIONS, None), (SPLIT, DEFAULT_SPLIT)):
        raised = spark.conf.get(f"harborline.raised.{key}", None)
        if raised is not None and spark.conf.get(key, default) == raised:
            spark.conf.unset(key)
        spark.conf.unset(f"harborline.raised.{key}")
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = shuffle_partitions(stored * spread, configured, most)
    if spread > 1 and spark.conf.get(ADVISORY, None) is None:
        spark.conf.set(ADVISORY, f"{ADVISORY_BYTES}b")
    if partitions > configured and spark.conf.get(FIRST_PARTITIONS, None) is None:
        _raise(spark, FIRST_PARTITIONS, str(partitions))
    if scan_bytes(stored) > PARTITION_BYTES and spark.conf.get(SPLIT) == DEFAULT_SPLIT:
        _raise(spark, SPLIT, str(scan_bytes(stored)))


def _raise(spark: SparkSession, key: str, value: str) -> None:
    spark.conf.set(key, value)
    spark.conf.set(f"harborline.raised.{key}", value)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder.
    """
    global _local_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="harborline-")
    return _local_folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _handed_out[-1:]:
        paths.append(path)
    return path


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside are removed at the end, also after a failure.

    For work that writes its results elsewhere: nothing returned from inside may
    still read an intermediate table.
    """
    _handed_out.append([])
    try:
        yield
    finally:
        for path in _handed_out.pop():
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once and return the written table.

    Used where a result is read several times or where a computed position must
    not be computed again. The files outlive any executor.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
