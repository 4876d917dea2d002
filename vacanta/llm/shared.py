"""Tables in the shared folder, and the package on the executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ROOT = str(Path(__file__).resolve().parents[2])


BATCH_SETTING, DEFAULT_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it, and bound the batches they get.

    A cluster installs it (or gets --py-files); this covers drivers that were started from another folder. Arrow batches
    are set to BATCH_BYTES unless the session has a size of its own: by default a batch may be 64 MB of text, which the
    JVM and the worker both hold beside what is made of it.
    """
    if spark.conf.get(BATCH_SETTING) == DEFAULT_BATCH:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH"), ROOT) if x)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, the folder that all executors share.

    Only a local session without that setting (a test) gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="vacanta-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/vacanta/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: its lineage ends there, and a lost executor costs nothing that was finished."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that written() made, once what was derived from them is itself written."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def beside(docs: DataFrame, text: str, values: Callable[[pa.Array], list[pa.Array]], kinds: list[T.DataType], most: int = 1 << 20) -> DataFrame:
    """The columns of docs as c0, c1, ... and what values() makes of their texts as v0, v1, ...

    Rows stay whole and where they are: nothing is joined back by a key, so rows without one are kept too.
    """
    from vacanta.llm.text import pieces

    names = [f"c{i}" for i in range(len(docs.columns))]
    at = names[docs.columns.index(text)]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields, strict=True)] + [T.StructField(f"v{i}", k) for i, k in enumerate(kinds)])

    def run(batches):
        for b in pieces(batches, at, most):
            yield pa.RecordBatch.from_arrays([*b.columns, *values(b.column(at))], schema.names)

    ship(docs.sparkSession)
    return docs.toDF(*names).mapInArrow(run, schema)


def restored(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns that docs gave to beside(), under their own names."""
    return found.select(*(found[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
