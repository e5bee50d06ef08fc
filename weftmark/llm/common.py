"""Shared plumbing of the training-data operators: row mapping, scratch tables, session settings."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


#: Rows of an Arrow batch: texts and sets of shingles are long, and a batch is held several times over on its way to Python.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000
#: Bytes of one; very long texts come in smaller batches.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let the session send batches of so many rows and bytes at most; a smaller number of rows or its own bytes stay."""
    name, most = BATCH_ROWS
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > most:
        spark.conf.set(name, str(most))
    name, most = BATCH_BYTES
    if not spark.sparkContext.getConf().contains(name):
        spark.conf.set(name, str(most))


def map_rows(df: DataFrame, schema: str, start: Callable[[], Callable[[list[list]], list[tuple]]]) -> DataFrame:
    """Narrow Arrow map. ``start()`` runs once a task and returns a function from column
    lists to output rows; only ``df``'s own columns travel, so select first."""
    out = schema_of(schema)
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        step = start()
        for batch in batches:
            # small slices keep the Python copies of very long texts bounded
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = step([c.to_pylist() for c in part.columns])
                if rows:
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, out)


def per_text(df: DataFrame, schema: str, start: Callable[[], Callable[[str | None], tuple]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One output row per input row: the id, then what ``start()(text)`` returns."""

    def begin():
        one = start()
        return lambda cols: [(i, *one(t)) for i, t in zip(*cols)]

    return map_rows(df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), schema, begin)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, from the session. Where none is set a local session gets one of its own; a cluster's
    executors could not read each other's, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        held = context._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="weftmark-checkpoint-")
        context.setCheckpointDir(folder)
    return folder


class Scratch:
    """Intermediate tables, written as Parquet to the shared folder so that lost executors
    cost no recomputation. ``drop()`` removes those whose readers are done."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths = spark, f"{shared_folder(spark)}/weftmark-{name}-{uuid.uuid4().hex}", []
        _opened.append(self)
        bound_batches(spark)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{len(self.paths)}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_only(self, *names: str) -> None:
        """Delete all tables but those written under these names: what a lazy result still reads."""
        self.drop(*[k for k, path in enumerate(self.paths) if path.rsplit("/", 1)[-1].rsplit("-", 1)[0] not in names])

    def drop(self, *frames: int) -> None:
        """Delete the tables with these ordinal numbers."""
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for k in frames:
            path = jvm.org.apache.hadoop.fs.Path(self.paths[k])
            path.getFileSystem(conf).delete(path, True)

    def close(self) -> None:
        """Delete all tables."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_opened: list[Scratch] = []


def close_since(mark: int) -> None:
    """Delete the tables of every ``Scratch`` opened since ``mark`` (see ``opened``): for callers whose results are stored."""
    while len(_opened) > mark:
        _opened.pop().close()


def opened() -> int:
    return len(_opened)


def salted_join(left: DataFrame, right: DataFrame, key: str, salt_by: str, salts: int = 16) -> DataFrame:
    """An inner join on ``key`` whose left rows of one key are spread over ``salts`` tasks by ``salt_by``; for right sides with
    one narrow row a key, which travels ``salts`` times."""
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return spread.join(copies, [key, "_salt"]).drop("_salt")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


class Capped(dict):
    """A per-task memo with a bounded number of entries; it starts afresh when full."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def room(self, n: int = 1) -> None:
        if len(self) + n > self.limit:
            self.clear()
