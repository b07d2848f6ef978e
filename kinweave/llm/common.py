"""What the corpus operators share: table access, the shared folder, lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside an operator; outputs show null again.
NULL_ID = -(2**63)
_REMOVERS: dict[str, Callable] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not at:
        at = context.getCheckpointDir()
    if not at:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="kinweave-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(at)
    return at


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended; the folder is scratch space
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _REMOVERS[path] = partial(_remove, spark, path)
    atexit.register(_REMOVERS[path])
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lost executors lose nothing of it."""
    return cut_at(df, name)[0]


def cut_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As `cut`, with the path, so that a table that nothing reads any more can be removed early."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Free a scratch table before the driver ends."""
    atexit.unregister(_REMOVERS.pop(path, None))
    _remove(spark, path)


def placed(docs: DataFrame, replaced: Iterable[str] = ()) -> DataFrame:
    """docs with its columns renamed c0, c1, ... by place: no name can clash, hold a dot or repeat.

    Columns of the names in `replaced`, which the operator adds itself, are left out.
    """
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]).select(*own_columns(docs, replaced))


def own_columns(docs: DataFrame, replaced: Iterable[str] = ()) -> list[str]:
    gone = {x.lower() for x in replaced}
    return [f"c{k}" for k, c in enumerate(docs.columns) if c.lower() not in gone]


def place_of(docs: DataFrame, column: str) -> str:
    """The name that a column has in `placed(docs)`; a name that repeats means its first place."""
    for k, c in enumerate(docs.columns):
        if c == column:
            return f"c{k}"
    raise ValueError(f"no column {column!r} among {docs.columns}")


def renamed(rows: DataFrame, docs: DataFrame, replaced: Iterable[str] = ()) -> DataFrame:
    """The columns of `placed(docs)` under their own names again, then those of `replaced`, which rows holds as they are."""
    own, added = own_columns(docs, replaced), list(replaced)
    return rows.select(*own, *added).toDF(*[docs.columns[int(c[1:])] for c in own], *added)


def free_name(docs: DataFrame, wanted: str) -> str:
    """A column name that docs does not hold."""
    held = {c.lower() for c in docs.columns}
    while wanted.lower() in held:
        wanted += "_"
    return wanted


def node_id(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(NULL_ID)).cast("long")


def shown_id(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c != NULL_ID, c)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
