"""Reading and writing grids, rule tables and stages."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Keyed stages and result tables are full-width grids, mostly doubles; stages of the llm operators keep the session's codec
CODEC = "zstd"

# Spark keeps the shuffle files of a finished write until the driver happens to collect its garbage
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_scope: ContextVar[list | None] = ContextVar("stages", default=None)


def read_grid(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Scenario grid from a Parquet directory, names lower-cased.

    With ``schema`` the declared columns are read (the rest pruned by the
    scan); filters applied later are pushed into the Parquet reader."""
    from rategrid.operators.prep import conform, normalise_names

    df = normalise_names(spark.read.parquet(path))
    return df if schema is None else conform(df, schema)


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",",
                   strict: bool = True, missing: str = "error") -> DataFrame:
    """CSV with header: the columns of ``schema``, found by header name in any
    case and order (others are ignored) and cast to its types.  A missing column
    raises at once, malformed text when it is read; ``strict=False`` and
    ``missing="null"`` ask for nulls instead."""
    from rategrid.operators.prep import conform, normalise_names

    text = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path)
    return conform(normalise_names(text), schema, strict=strict, missing=missing)


def write_stage(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    dynamic: bool = True,
) -> None:
    """Overwrite a Parquet stage.  With ``partition_by`` and ``dynamic`` only
    the partitions present in ``df`` are replaced, so runs for other months or
    campaigns survive.  A partition column ``df`` lacks is an error: writing
    without it would replace the other runs."""
    absent = [c for c in partition_by if c not in df.columns]
    if absent:
        raise ValueError(f"partition columns missing: {', '.join(absent)}")
    w = df.write.mode("overwrite").option("compression", CODEC)
    if partition_by:
        w = w.partitionBy(*partition_by)
        if dynamic:
            w = w.option("partitionOverwriteMode", "dynamic")
    with shuffles_dropped(df.sparkSession):
        w.parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes inside delete the shuffle files they made as soon as they end.  A write
    is planned anew, so no other plan reads these files."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV export with header (one file per partition)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared lineage-cut folder named by ``spark.checkpoint.dir`` (see
    :func:`rategrid.session.configure` for sessions that set none)."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        raise RuntimeError("spark.checkpoint.dir is not set; set it to a shared folder")
    return d


def stage(df: DataFrame, name: str | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet under the shared checkpoint folder
    and read it back.

    Every call writes a new folder (the name gets a unique suffix), so a
    stage is never overwritten while an earlier plan still reads it.  The
    stage lives in shared storage and survives executor loss, unlike a local
    checkpoint; later scans of it prune columns and push filters.  Inside a
    :func:`stage_scope` its path is noted there."""
    spark = df.sparkSession
    path = _new_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def _new_path(spark: SparkSession, name: str | None) -> str:
    path = f"{checkpoint_dir(spark).rstrip('/')}/stage-{name or 'df'}-{uuid.uuid4().hex}"
    paths = _scope.get()
    if paths is not None:
        paths.append(path)
    return path


def _table_name(path: str) -> str:
    return "stage_" + path.rsplit("-", 1)[-1]


MAX_BUCKETS = 100_000


def stage_by(df: DataFrame, by: Sequence[str], name: str | None = None) -> DataFrame:
    """:func:`stage` bucketed and sorted by ``by``: rows are exchanged once, here, and
    plans that group by or join on these columns read them where they are.

    As many buckets as the session has shuffle partitions (one file each).  The
    stage is an external table of the session's catalog over a new folder in the
    checkpoint folder; :func:`drop_stages` removes both."""
    spark = df.sparkSession
    path = _new_path(spark, name)
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_BUCKETS)
    with shuffles_dropped(spark):
        (df.repartition(n, *by).write.mode("errorifexists").format("parquet").bucketBy(n, *by).sortBy(*by)
         .option("path", path).option("compression", CODEC).saveAsTable(_table_name(path)))
    return spark.table(_table_name(path))


@contextmanager
def stage_scope() -> Iterator[list[str]]:
    """Collects the paths of the stages written inside, for :func:`drop_stages`."""
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield paths
    finally:
        _scope.reset(token)


def drop_stages(spark: SparkSession, paths: list[str]) -> None:
    """Delete stages by path (only paths a :func:`stage_scope` noted)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = paths.pop()
        spark.sql(f"DROP TABLE IF EXISTS {_table_name(path)}")
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
