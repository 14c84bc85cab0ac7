"""Tables that grow by whole appends.

A table is a folder of parts and a log.  An append writes its part first, checks it, and then
adds one numbered log entry by a rename that fails if the number is taken.  Readers see
the parts that the log names: all rows of an append or none, also while it runs and after it
failed.  Two appends at once cannot both take a number; the later one checks its keys again
against what the first has added.

The rename is atomic on file systems where a rename is (HDFS, POSIX); a store without atomic
renames needs a conditional put in its place.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weirline.sources.sinks import write_text


class KeyViolation(ValueError):
    """Rows whose key is NULL, repeated in the append or already in the table."""


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def entries(spark: SparkSession, path: str) -> list[dict]:
    """The log of a table, oldest first (number, part, rows); empty without a log."""
    folder, fs = _path(spark, f"{path.rstrip('/')}/_log")
    if not fs.exists(folder):
        return []
    out = []
    for s in fs.listStatus(folder):
        name = s.getPath().getName()
        if name.isdigit():
            stream = fs.open(s.getPath())
            try:
                out.append({"number": int(name), **json.loads(bytes(stream.readAllBytes()).decode())})
            finally:
                stream.close()
    return sorted(out, key=lambda e: e["number"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """All committed rows.  A folder without a log is read as plain Parquet."""
    parts = [f"{path.rstrip('/')}/{e['part']}" for e in entries(spark, path)]
    return spark.read.parquet(*(parts or [path]))


def violations(new: DataFrame, key: str, old: DataFrame | None = None) -> int:
    """How many rows of ``new`` break the uniqueness of ``key``."""
    per_key = new.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    bad = F.col("_k").isNull() | (F.col("_n") > 1)
    if old is not None:
        taken = old.select(F.col(key).alias("_k"), F.lit(True).alias("_taken"))
        per_key, bad = per_key.join(taken, "_k", "left"), bad | F.col("_taken").isNotNull()
    return per_key.where(bad).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"]


def append(df: DataFrame, path: str, key: str | None = None) -> int:
    """Append all rows of ``df`` or none; returns how many.  With ``key``, rows with a NULL,
    repeated or known key end the append with a ``KeyViolation``."""
    spark, base = df.sparkSession, path.rstrip("/")
    part = f"part-{uuid.uuid4().hex}"
    staged, fs = _path(spark, f"{base}/{part}")
    written = Observation()
    log = entries(spark, path)
    if key is not None and log and (bad := violations(df.select(key), key, read(spark, path))):
        raise KeyViolation(f"{bad} rows of the append to {path} break the key {key}")     # before anything is written
    try:
        df.observe(written, F.count(F.lit(1)).alias("n")).write.parquet(f"{base}/{part}")
        n = int(written.get["n"])
        while True:
            log = entries(spark, path)
            if key is not None:
                bad = violations(spark.read.parquet(f"{base}/{part}"), key, read(spark, path) if log else None)
                if bad:
                    raise KeyViolation(f"{bad} rows of the append to {path} break the key {key}")
            if _commit(spark, base, log[-1]["number"] + 1 if log else 1, {"part": part, "rows": n}):
                return n
    except BaseException:
        fs.delete(staged, True)     # no reader has seen it
        raise


def _commit(spark: SparkSession, base: str, number: int, entry: dict) -> bool:
    """Add the entry under its number; False if another append has taken it."""
    draft, fs = _path(spark, write_text(spark, f"{base}/_log/_{uuid.uuid4().hex}", json.dumps(entry)))
    to, _ = _path(spark, f"{base}/_log/{number:010d}")
    jvm = spark.sparkContext._jvm
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.rename(draft, to, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "AlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False
    return True
