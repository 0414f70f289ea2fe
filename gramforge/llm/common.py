"""What several operators of this subpackage share: tables, the shared folder, slices of Arrow batches, labelled samples."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters between words; every other character belongs to a word.
SPACE = "[\\x20\\x09-\\x0D]"
#: Bytes of text that Python holds at once.
SLICE_BYTES = 4 << 20
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this library where the driver can, and sets a checkpoint folder only if the session has none."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))
    shared(spark)
    return spark


def shared(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where that is unset, a local session gets a
    new folder of its own (tests); a cluster has no folder that would do."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="gramforge-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    to = f"{shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(to)
    return spark.read.schema(df.schema).parquet(to)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """written(), dealt out by a key into as many files as the session has shuffle partitions: joins and cogroups by that
    key read it without another exchange. The catalog forgets the table at once; its files stay."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mark = uuid.uuid4().hex
    as_table = f"gramforge_{name.replace('-', '_')}_{mark}"
    own = df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("compression", "zstd")
    own.option("path", f"{shared(spark).rstrip('/')}/{name}-{mark}").saveAsTable(as_table)
    out = spark.table(as_table)
    spark.sql(f"DROP TABLE {as_table}")
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of at most `most` bytes of one text column; a longer text gets a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def trim() -> None:
    """Gives memory that a Python worker has freed back to the system: workers live on after a task, and what several of
    them hold unused counts against their executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn, id_col: str, text_col: str, per_class: int, max_bytes: int) -> list[tuple[bytes, int]]:
    """Whole texts and labels of a bounded sample for fitting: the `per_class` ids of each class that come first by
    xxhash64 among those where `learn` (a condition on the id) holds, then as many texts as fit in max_bytes, alternating
    between the classes. Labels of an id that are null or contradict each other are left out. A function of the rows alone."""
    ids = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).filter("_y = _z")
    ids = ids.filter(learn(F.col("_id"))).withColumn("_h", F.xxhash64("_id"))
    picked = None
    for y in (0, 1):
        part = ids.filter(F.col("_y") == y).orderBy("_h", "_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    rows = picked.select("_id", "_y", "_h").collect()  # 2 * per_class ids at most
    spark = docs.sparkSession
    ids = spark.createDataFrame([(r._id, r._y, r._h) for r in rows], "_id long, _y int, _h long")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_t")).join(F.broadcast(ids), "_id")
    texts = texts.withColumn("_n", F.octet_length("_t"))
    # the bound in bytes is applied to lengths first, so that no more than max_bytes ever reach the driver
    sizes = sorted((r._y, r._h, r._id, r._n) for r in texts.groupBy("_id", "_y", "_h").agg(F.max("_n").alias("_n")).collect())
    take, held = [], 0
    by = [[r for r in sizes if r[0] == y] for y in (0, 1)]
    for i in range(max(map(len, by), default=0)):
        for own in by:
            if i < len(own) and held + own[i][3] <= max_bytes:
                held += own[i][3]
                take.append(own[i][2])
    if not take:
        return []
    keep = spark.createDataFrame([(x,) for x in take], "_id long")
    got = texts.join(F.broadcast(keep), "_id").groupBy("_id", "_y", "_h").agg(F.max("_t").alias("_t")).collect()
    return [(bytes(r._t), r._y) for r in sorted(got, key=lambda r: (r._h, r._id))]
