"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder of each local session without spark.checkpoint.dir.
_OWN: dict[str, str] = {}
DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Only a session
    whose executors run in the driver's own process (local mode, as in tests) may leave it
    unset: such a session gets one folder of its own, which all its parts see."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        where = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-"))
    if not where:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here,
    so a lost executor costs no more than the tasks that read it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_slices(batches, rows: int = 512):
    """Arrow batches in pieces, so that the texts of a few rows only are Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def give_back() -> None:
    """Return to the system what this process has freed; Arrow and the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def tidy(run, *forget):
    """run, for mapInArrow, with calls to forget at the end of each task. Python workers outlive
    their tasks, and what idle ones hold counts in their executor's memory while other stages
    run, so they keep no more than they need to begin the next task."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            for f in forget:
                f()
            give_back()

    return tidied


def salted_join(left: DataFrame, right: DataFrame, key: str | list[str], *by: str, salts: int = 8) -> DataFrame:
    """left joined to the one row of right with its key, if there is one. Rows of a frequent key
    are dealt to so many copies of that row, by a hash of the columns by."""
    dealt = left.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    copies = right.withColumn("__salt", F.explode(F.array(*map(F.lit, range(salts)))))
    return dealt.join(copies, [*([key] if isinstance(key, str) else key), "__salt"], "left").drop("__salt")


def held_out(doc_id: str = "doc_id"):
    """True for the rows that no training may see: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def document_columns(docs: DataFrame, **changed) -> DataFrame:
    """The columns of documents, in order, with some of them replaced."""
    return docs.select(*[(changed[c] if c in changed else F.col(c)).alias(c) for c in DOC_COLUMNS])
