"""Session settings and the shared folder for stored intermediate tables."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def local_session(
    cores: int | str = "*", app: str = "hostloom", partitions: int = 8, shared: str | None = None
) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own settings.

    ``shared`` sets the folder for stored tables. Driver memory is left to the environment
    (``spark-submit``, ``PYSPARK_SUBMIT_ARGS``).
    """
    builder = SparkSession.builder
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    spark = (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Recording the Python call site of every column expression costs more than planning itself.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # Small test files: one task per file instead of several files per task.
        .config("spark.sql.files.openCostInBytes", "262144")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's own folder below ``spark.checkpoint.dir``; it is removed when the application ends.

    Without that setting the folder lies in the warehouse, which every executor reaches too.
    """
    application = spark.sparkContext.applicationId
    if application not in _folders:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
        folder = f"{root.rstrip('/')}/hostloom-{application}"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        # With its scheme, so that readers outside Spark open the same store.
        _folders[application] = files.makeQualified(path).toString()
    return _folders[application]


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Loops read their input many times; from here on a lost executor costs a re-read of the
    table, not a re-run of the plan behind it.
    """
    spark = df.sparkSession
    path = new_table_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver was started from."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    path = f"{shared_folder(spark)}/{root.name}.zip"
    files, inner = fs.FileSystem.from_uri(path)
    with files.open_output_stream(inner) as sink:
        sink.write(packed.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(application)
