"""Helpers that every corpus operator shares: tables in the shared folder, Arrow batches, text access."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to Python; whole texts can be long, so batches stay small.
ARROW_ROWS, ARROW_BYTES = 256, 8 << 20
#: Bytes of a staged table, as its files have them, up to which it may be sent to every task.
SENT_BYTES = 12 << 20
#: Tables staged between two calls of ``tidy``.
TIDY = 8
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a local master (one machine, as in tests) gets a temporary folder; on a cluster
    this is an error, as executors wouldn't see such a folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(context, "_loomrank_shared", None)
    if own is None:
        own = context._loomrank_shared = f"file://{tempfile.mkdtemp(prefix='loomrank-')}"
    return own


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is deleted when the application ends."""
    context = spark.sparkContext
    own = getattr(context, "_loomrank_own", None)
    if own is None:
        own = context._loomrank_own = f"{shared_folder(spark)}/loomrank-{uuid.uuid4().hex}"
        atexit.register(lambda: context._jsc is not None and delete(spark, own))
    return own


def delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception as e:  # what is left over costs room only
        print(f"not deleted: {path}: {e}")


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def tidy(spark: SparkSession) -> None:
    """Has the driver and each executor collect its garbage: heaps that sorts and texts have filled go back to the system
    before Python workers and the next stage need room, and Spark lets go of broadcasts that no plan names any more."""
    spark.sparkContext._jvm.System.gc()
    n = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)  # the driver is counted there; tasks go to executors in turn
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def tidy_at_times(spark: SparkSession) -> None:
    """``tidy`` once in TIDY calls; not where all is one process, whose heap is the user's own affair."""
    context = spark.sparkContext
    context._loomrank_turn = (getattr(context, "_loomrank_turn", 0) + 1) % TIDY
    if context._loomrank_turn == 0 and not re.match(r"local(\[|$)", context.master):
        tidy(spark)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder as Parquet and reads it back.

    Cuts the lineage: a lost executor costs at most the stage in hand, and a plan that uses the
    result several times reads columns of a file instead of computing it again. The shuffle files of the
    write are let go as soon as it has ended. Now and then the heaps are tidied.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    with setting(spark, CLEANUP, "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomrank_path = path
    tidy_at_times(spark)
    return out


def done(*tables: DataFrame | None) -> None:
    """Deletes staged tables after their last reader."""
    for t in tables:
        path = getattr(t, "_loomrank_path", None)
        if path:
            delete(t.sparkSession, path)


def in_batches(rows: DataFrame, run, schema: str) -> DataFrame:
    """``rows.mapInArrow(run, schema)`` with batches bounded by ARROW_ROWS rows, and by ARROW_BYTES where more than one row is left."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return rows.mapInArrow(run, schema)


def text_of(docs: DataFrame, name: str = "text") -> Column:
    """The column as text, null taken as empty."""
    return F.coalesce(docs[name].cast("string"), F.lit(""))


def once(value: Column, make: Callable[[Column], Column]) -> Column:
    """What ``make`` gives of ``value``, which is worked out one time however often ``make`` names it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def row_name(docs: DataFrame, text: str = "text") -> list[Column]:
    """128 bits that name a row by its doc_id and text, as two longs ``r1`` and ``r2``."""
    body = text_of(docs, text)
    return [F.xxhash64(docs["doc_id"], body).alias("r1"), F.xxhash64(F.lit(7), body, docs["doc_id"]).alias("r2")]


def fresh(docs: DataFrame, prefix: str) -> str:
    """A column name with this prefix that ``docs`` doesn't have."""
    name, n = prefix, 0
    while name.lower() in {c.lower() for c in docs.columns}:
        n += 1
        name = f"{prefix}_{n}"
    return name


def small(keys: DataFrame, most: int = 1_000_000) -> bool:
    """Whether a staged table may be sent to every task: at most ``most`` rows and SENT_BYTES bytes, by its rows where they are of fixed width, else as its files have them."""
    size = int(str(keys._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    width = {"long": 8, "double": 8, "integer": 4, "date": 4, "boolean": 1}
    widths = [width.get(f.dataType.typeName()) for f in keys.schema]
    fixed = None not in widths
    if not fixed and size > SENT_BYTES:
        return False
    rows = keys.count()
    return rows <= most and (not fixed or sum(widths) * rows <= SENT_BYTES)


def one_each(found: DataFrame, ids: DataFrame, label: str) -> DataFrame:
    """``found`` staged, with one row for each of the staged ``ids``: rows beyond these come from repeated rows of a table and are equal."""
    out = staged(found, label)
    if out.count() <= ids.count():
        return out
    once = staged(out.dropDuplicates(["id"]), label)
    done(out)
    return once


def beside(rows: DataFrame, keys: DataFrame, on: str | list[str], how: str, most: int = 1_000_000) -> DataFrame:
    """Joins wide ``rows`` with ``keys`` (already staged): by broadcast while that is ``small``, else by shuffle. Narrow rows are cheap to shuffle, so ``most`` can be lower for them."""
    return rows.join(F.broadcast(keys) if small(keys, most) else keys, on, how)
