"""Intermediate results as Parquet tables in the folder all executors share, each removed when its scope ends."""

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar
from functools import cache
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

#: says that a `file:` folder is a mount that all executors share, on a master that is not local
MOUNTED = "spark.millwright.sharedFolderIsMounted"

#: with this Spark removes what a query shuffled when the query ends, not when the driver's memory is next cleaned up
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="millwright-")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`; a temporary folder only in local mode.

    On a cluster a folder of the machines' own disks would lose what other executors wrote, so `file:` is
    refused there unless MOUNTED is true.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    local = spark.sparkContext.master.startswith("local")
    if not folder:
        if local:
            return _local_folder()
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if urlparse(folder).scheme == "file" and not local and spark.conf.get(MOUNTED, "false") != "true":
        raise ValueError(f"{folder} is on each machine's own disk; if it is a shared mount, set {MOUNTED} to true")
    return folder


class Scope:
    """Folders of stored tables that are removed together."""

    def __init__(self, outer: "Scope | None") -> None:
        self.outer = outer
        self.folders: dict[str, SparkSession] = {}

    def keep(self, table: DataFrame) -> DataFrame:
        """Hand a stored table on to the scope around this one."""
        for folder in _folders_of(table) & self.folders.keys():
            (self.outer or self).folders[folder] = self.folders.pop(folder)
        return table

    def close(self) -> None:
        while self.folders:
            _remove(*self.folders.popitem())


_process = Scope(None)  # of tables stored outside of any other scope
_scope: ContextVar[Scope] = ContextVar("scope", default=_process)


@atexit.register
def _close_process() -> None:
    with suppress(Exception):  # the JVM may have gone first; then the folders stay
        _process.close()


@contextmanager
def stored_tables() -> Iterator[Scope]:
    """Everything that `write_shared` stores inside is removed at the end, also after an error.

    So the last reader must have run by then: collect or write results inside. A DataFrame whose stored table
    is still needed afterwards is handed on by `Scope.keep`. Scopes may be nested; code that opens none belongs to its caller's.
    """
    scope = Scope(_scope.get())
    token = _scope.set(scope)
    try:
        yield scope
    finally:
        _scope.reset(token)
        scope.close()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of every query run inside leave the executors' disks when it ends."""
    before = spark.conf.get(_SHUFFLES_GO, "false")
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(_SHUFFLES_GO, before)


def write_shared(df: DataFrame) -> DataFrame:
    """Run `df` once and return a scan of its result.

    Later steps read only the columns they need, do not repeat the work, and a lost executor
    costs a re-read instead of a re-computation. What was shuffled for it goes at once. The table lives as long as the innermost `stored_tables`, without
    one as long as the Python process, or until `drop_shared`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/millwright-{uuid.uuid4().hex}"
    _scope.get().folders[path] = spark
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shared(*tables: DataFrame) -> None:
    """Remove stored tables now; nothing may read them afterwards. Other tables that a plan reads are left alone."""
    for table in tables:
        for folder in _folders_of(table):
            scope = _scope.get()
            while scope is not None:
                scope.folders.pop(folder, None)
                scope = scope.outer
            _remove(folder, table.sparkSession)


def _folders_of(table: DataFrame) -> set[str]:
    """Folders that `write_shared` made and the plan of `table` scans, spelled as they were written."""
    root = shared_folder(table.sparkSession).rstrip("/")
    found = set()
    for file in table.inputFiles():
        name = next((part for part in file.split("/") if part.startswith("millwright-") and len(part) == 43), None)
        if name:
            found.add(f"{root}/{name}")
    return found


def _remove(folder: str, spark: SparkSession) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    settings = spark._jsc.hadoopConfiguration() if spark._jsc else spark._jvm.org.apache.hadoop.conf.Configuration()
    path.getFileSystem(settings).delete(path, True)
