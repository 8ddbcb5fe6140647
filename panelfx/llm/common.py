"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than ASCII white space.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where both run in one process may it be a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="panelfx-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Tables that ``save`` has written and nothing has dropped yet, innermost scope last: path to the session.
_SAVED: list[dict[str, SparkSession]] = [{}]


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    The files go with ``drop_saved``, at the end of the innermost ``scratch`` scope, or when Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/panelfx/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SAVED[-1][path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_saved(*frames: DataFrame | None) -> None:
    """Delete the files behind ``save`` results that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path:
            _delete(df.sparkSession, path)
            for scope in _SAVED:
                scope.pop(path, None)


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes at its end all that was saved within, but for what ``keep_saved`` has handed out."""
    _SAVED.append({})
    try:
        yield
    finally:
        for path, spark in _SAVED.pop().items():
            _delete(spark, path)


def keep_saved(df: DataFrame) -> DataFrame:
    """Hand the files behind a ``save`` to the scope around the innermost one."""
    path = df._scratch
    _SAVED[-2][path] = _SAVED[-1].pop(path)
    return df


@atexit.register
def _at_end() -> None:
    for scope in _SAVED:
        for path, spark in scope.items():
            if spark.sparkContext._jsc is not None:  # else the session has been stopped
                _delete(spark, path)


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """``(_id, label, _text, *extra)``: one row for each of at most ``sample`` labelled documents, those of least hash.

    Of labels that name an id more than once the least counts; of documents that share an id one is
    used, by the hash of its text. So neither order nor partitioning matters and no second limit is needed.
    """
    named = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(F.col(label_col).cast("int")).alias("label"))
    picked = named.orderBy(F.xxhash64("_id", F.lit("sample")), "_id").limit(sample)
    own = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *extra)
    rows = own.join(F.broadcast(picked), own["_doc"] == picked["_id"])
    held = F.struct("_text", *extra)
    one = rows.groupBy("_id", "label").agg(F.min_by(held, F.struct(F.xxhash64("_text", *extra), "_text")).alias("r"))
    return one.select("_id", "label", "r.*")


def id_remainder(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (null for a null id)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(n)


def uniform(*cols: Column) -> Column:
    """A reproducible number in [0, 1) from the columns' values."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))
