"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from weirline.session import ensure_checkpoint_dir

BITMAP_BITS = 1 << 26   # 8 MB: the bound of what ``maybe_among`` sends to the tasks


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One given table, pruned to ``columns`` (all when none are named)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor makes later stages read the files again
    instead of recomputing what produced them.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables written by ``stored`` that nothing will read again."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t.stored_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def extended(df: DataFrame, *more: str) -> StructType:
    """The schema of ``df``, all nullable, with more columns, each given as ``"name type"``."""
    return StructType([StructField(f.name, f.dataType) for f in df.schema.fields] + StructType.fromDDL(", ".join(more)).fields)


def maybe_among(rows: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """``rows`` without most of those whose ``columns`` are not among ``keys``.

    A filter before a join that shuffles long texts for a few keys: a bitmap of hashed
    keys, of at most ``BITMAP_BITS`` bits whatever the number of keys.  It never drops a
    matching row, so the join that follows decides; with very many keys it only drops
    less.
    """
    bits = min(BITMAP_BITS, max(1 << 16, 1 << (16 * keys.count()).bit_length()))
    place = lambda: F.pmod(F.xxhash64(*columns), F.lit(bits)) + 1
    marks = keys.select(place().alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()
    table = np.zeros((bits >> 15 or 1, 4096), np.uint8)
    for r in marks:
        table[r["b"] - 1] = np.frombuffer(r["m"], np.uint8)
    table = table.ravel()

    @F.pandas_udf("boolean")
    def among(p: pd.Series) -> pd.Series:
        at = p.to_numpy(np.int64) - 1
        return pd.Series((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return rows.filter(among(place()))


def smallest(rows: DataFrame, by: str, order: list[Column], k: int, salts: int = 64) -> DataFrame:
    """The ``k`` first rows of each group ``by``.  Each task's, then each salt's are taken first, so
    that the last step sees at most ``k * salts`` rows of a group, whatever it holds."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns, F.lit("salt")), F.lit(salts)))
    for keys in ([by, "_salt"], [by]):
        salted = salted.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= k).drop("_n")
    return salted.drop("_salt")


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes of ``column``.

    Every row is in exactly one run; a single longer row is a run of its own.
    Bounds the memory of a task whatever the number of rows Spark batches.
    """
    col = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total + n > limit and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start, len(sizes) - start)
