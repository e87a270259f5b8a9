"""Session helpers: a builder for local runs, the shared folder, and staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; production code receives its session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("basketforge")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where the cluster names none, a local session (tests, one machine) gets a
    temporary one; any other master is an error, since a machine-local folder
    would not be visible to the other executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-basketforge-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def staging_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/basketforge/{name}-{uuid.uuid4().hex}"


#: Spark's own switch for removing a query's shuffle files when the query ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's own switch that deals both sides of a join anew unless they are dealt by all of its keys.
ALL_JOIN_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"

#: Where the tables behind staged DataFrames are.
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def staged(df: DataFrame, name: str, switches: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of that table.

    Cuts the lineage, so that a lost executor costs the tasks it ran and not
    the whole history, and keeps costly columns from being computed twice. The
    write's shuffle files go when it ends: what follows reads the table.
    ``switches`` are settings of Spark that hold for the write alone.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    switches = {SHUFFLE_CLEANUP: "true"} | (switches or {})
    before = {k: spark.conf.get(k, None) for k in switches}
    for k, v in switches.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    made = spark.read.schema(df.schema).parquet(path)
    _places[made] = path
    return made


def dropped(*tables: DataFrame | None) -> None:
    """Delete staged tables that nothing will read again (whatever was made of them is written by then)."""
    for made in tables:
        path = _places.pop(made, None) if made is not None else None
        if path:
            spark = made.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of a task that sorts or groups them, and how many such tasks a table must make before their number is set by its rows.
ROWS_A_TASK, LEAST_TASKS = 250_000, 8


#: How many rows a DataFrame has, where its maker knows (about) that.
_rows: WeakKeyDictionary[DataFrame, int] = WeakKeyDictionary()


def told_rows(df: DataFrame, rows: int) -> DataFrame:
    _rows[df] = rows
    return df


def rows_of(df: DataFrame) -> int:
    """What ``told_rows`` said of ``df``, else its count (of a staged table, what its files tell)."""
    return _rows[df] if df in _rows else df.count()


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df`` in so many partitions by the columns that each has about ROWS_A_TASK of its ``rows``.

    The number of shuffle partitions is the session's and does not grow with a table;
    a small table is left as it is.
    """
    tasks = -(-rows // ROWS_A_TASK)
    if tasks < LEAST_TASKS:
        return df
    return df.repartition(max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)


_held: ContextVar[dict | None] = ContextVar("held", default=None)


def computed_once(query: Callable) -> Callable:
    """Within one call of ``query``, tables that ``once`` names are computed and written once."""

    @wraps(query)
    def run(*args):
        if _held.get() is not None:
            return query(*args)
        token = _held.set({})
        try:
            return query(*args)
        finally:
            _held.reset(token)

    return run


def once(name: str, make: Callable[[], DataFrame], *key: str) -> DataFrame:
    """``make()``; inside a query under ``computed_once``, a new reader of the table that its first call wrote."""
    held = _held.get()
    if held is None:
        return make()
    if (name, *key) not in held:
        made = staged(make(), name)
        held[(name, *key)] = (made.sparkSession, made.schema, _places[made])
    spark, schema, path = held[(name, *key)]
    return spark.read.schema(schema).parquet(path)
