"""What the operators of this subpackage share: tables, scratch space, words."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the standard tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can read and write.

    A cluster names it in ``spark.checkpoint.dir``; only on a single machine
    (tests) is one made here where that is unset.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="strandlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Tables of this process that ``stored`` has written and ``dropped`` has not deleted.
WRITTEN: list[str] = []


def stored(df: DataFrame, name: str, partitions_by: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage, so a lost executor costs a re-read and not a re-run, and
    gives later counts and joins a table of known size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandlake/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partitions_by:
        writer = writer.partitionBy(partitions_by)
    writer.parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, paths: Sequence[str]) -> None:
    """Delete stored tables that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        WRITTEN.remove(path)


def free_name(taken: Iterable[str], wanted: str) -> str:
    """``wanted``, with as many underscores as it takes to be none of ``taken`` in any case."""
    known = {c.lower() for c in taken}
    while wanted.lower() in known:
        wanted += "_"
    return wanted


def by_class(rows: DataFrame, classes: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows``, ``total`` of them at most, joined to ``classes``: one row a ``key`` with the number ``size`` of its rows.

    A class of over ``max(256, total / 10,000)`` rows is hot: there are 10,000 of
    those at most, so they are broadcast and their rows never shuffled by key.
    """
    is_hot = F.col(size) > max(256, total // 10_000)
    hot = classes.where(is_hot)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(classes.where(~is_hot), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def small_batches(spark: SparkSession, rows: int = 512, megabytes: int = 8) -> None:
    """Bound what an Arrow batch of long texts can take in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def lower_ascii(column):
    """A-Z lower-cased, every other character left alone."""
    return F.translate(column, UPPER, LOWER)


def words(text: str) -> list[bytes]:
    """The maximal runs of characters outside U+0009-U+000D and U+0020, A-Z lower-cased.

    ``bytes.lower`` and ``bytes.split`` know ASCII only, which is that definition.
    """
    return text.encode("utf-8", "surrogatepass").lower().split()


def crc_fold(column, modulus: int):
    """crc32 of the id written in decimal, modulo ``modulus``; a null id counts as ''."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def shards_for(rows: int, per_shard: int) -> int:
    """How many shards keep each at about ``per_shard`` rows."""
    return max(1, -(-rows // per_shard))


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Place of a public vocabulary file; ``folder`` overrides the installed package."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


#: What a worker process remembers from task to task, by operator.
HELD: dict[str, object] = {}


def forget(holds: str) -> None:
    """Let go of what operators other than ``holds`` remember in this process."""
    for other in [k for k in HELD if k != holds]:
        del HELD[other]


def map_texts(docs: DataFrame, work: Callable[[list[str]], Sequence], schema: str, keep: Sequence[str] = ("doc_id",), holds: str = "") -> DataFrame:
    """The columns ``keep`` of ``docs`` untouched, with what ``work`` makes of the texts.

    ``work`` gets the texts of a batch, nulls as '', and returns one sequence for
    each column of ``schema`` in order.  The kept columns never leave Arrow, so
    nulls and large integers come back as they were; ``schema`` must not name any
    of them.  A worker forgets what other operators than ``holds`` remember in
    ``HELD`` when it begins.
    """
    small_batches(docs.sparkSession)
    names = list(keep)
    made = StructType.fromDDL(schema)
    text = free_name(names, "text")
    kept = docs.select(*[f"`{n}`" for n in names])
    out = StructType([*kept.schema.fields, *made.fields])
    arrow = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(holds)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            columns = work([t or "" for t in batch.column(text).to_pylist()])
            arrays = [batch.column(n) for n in names] + [pa.array(c, f.type, from_pandas=False) for c, f in zip(columns, arrow)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *arrow.names])

    return docs.select(*[f"`{n}`" for n in names], F.col("text").cast("string").alias(text)).mapInArrow(run, out)


def long_ids(docs: DataFrame) -> DataFrame:
    """``doc_id`` as a long and ``text``; whatever else the table has is left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def bounded_sample(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """The ``rows`` distinct rows of least hash of ``keys``, or all if there are fewer; rows of equal keys count as one.

    The hash's range is narrowed first, from a count, and only hashes are
    ordered to find how far it reaches, never the rows.
    """
    hashed = F.xxhash64(*keys)
    hashes = stored(df.select(hashed.alias("h")).groupBy("h").agg(F.count("*").alias("n")), "sample-hashes")
    total = hashes.count()
    if total > rows:
        share = min(1.0, 1.2 * rows / total + 30 / total)
        near = hashes.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
        last = near.orderBy("h").limit(rows).agg(F.max("h")).first()[0]
        df = df.where((F.pmod(hashed, F.lit(1 << 30)) < int(share * (1 << 30))) & (hashed <= last))
    return df.withColumn("_h", hashed).dropDuplicates(["_h"]).drop("_h")
