"""Helpers shared by the text operators: written tables, skew-safe ranks and word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of our own only where that is unset."""
    found = spark.conf.get(_SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_SETTING} must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(_SETTING, found)
    return found.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Lets no batch of rows that goes to Python exceed some megabytes, however long texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, allows column pruning."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def drop(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more, so that shared storage holds few of them at a time."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text: Column) -> Column:
    """Number of words in a text as a long; null counts as empty."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


#: Rows of a class that are ranked in one task, about, if it is the only class.
CELL_ROWS = 1 << 18


def class_rank(df: DataFrame, classes: list[str], order: list[str]) -> DataFrame:
    """df with column rank: a row's place from 0 in its class, gapless.

    A class may hold any share of the rows, so each is cut into salted cells, more of them the more rows there are, that
    are ranked apart and joined to the cells' offsets.  df is read three times, so it should be a written table.  Class
    columns must not be null.
    """
    salts = max(64, -(-df.count() // CELL_ROWS))
    cells = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    sums = cells.groupBy(*classes, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*classes).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*classes, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*classes, "_salt").orderBy(*order)
    ranked = cells.withColumn("_inside", F.row_number().over(inside) - 1)
    return (
        ranked.join(offsets, [*classes, "_salt"])
        .withColumn("rank", (F.col("_before") + F.col("_inside")).cast("long"))
        .drop("_salt", "_inside", "_before")
    )


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text modulo n; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def text_hash() -> Column:
    """A hash of the column text, to tell rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def without(documents: DataFrame, fates: DataFrame) -> DataFrame:
    """documents without the rows that fates (doc_id, text_hash, kept; a written table) drops; all columns.

    Only rows that hit a bitmap of the dropped ones go through the exact join, so most texts are not shuffled.  Of
    rows that repeat both id and text, of which one is kept and others are not, one stays.
    """
    keys = ["doc_id", "text_hash"]
    dropped = fates.filter(~F.col("kept")).select(F.xxhash64(*keys).alias("_key"), *keys).distinct()
    named = documents.select("*", text_hash().alias("_hash")).withColumn("_key", F.xxhash64(F.col("doc_id").cast("long"), "_hash"))
    hit = passes(documents.sparkSession, id_filter(dropped, "_key"), "_key")
    split = fates.filter("kept").select(F.col("doc_id").alias("k"), F.col("text_hash").alias("h"))
    gone = dropped.select(F.col("doc_id").alias("k"), F.col("text_hash").alias("h"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("k")) & (F.col("_hash") == F.col("h"))
    maybe = named.filter(hit)
    out = named.filter(~hit).union(maybe.join(gone, same, "left_anti"))
    both = gone.intersect(split)
    if not both.isEmpty():
        out = out.union(maybe.join(both, same, "left_semi").dropDuplicates(["doc_id", "_hash"]))
    return out.select(*documents.columns)


def id_filter(ids: DataFrame, column: str, bits: int = 1 << 23, hashed: bool = False) -> bytes:
    """A bitmap of hashed ids: bits / 8 bytes whatever the number of ids, to leave most other rows out of a shuffle.

    It passes every id of the set, and others at the rate at which bits are set; the exact join follows it.
    hashed: the column has places of bits already.
    """
    place = F.col(column) if hashed else F.pmod(F.xxhash64(F.col(column)), F.lit(bits))
    parts = (
        ids.select((place + 1).alias("p"))  # the bitmap functions count from 1
        .groupBy(F.bitmap_bucket_number("p").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap"))
        .collect()
    )
    size = len(parts[0]["bitmap"]) if parts else 4096
    out = bytearray(bits // 8 + 2 * size)
    for row in parts:
        at = (row["bucket"] - 1) * size
        out[at : at + size] = row["bitmap"]
    return bytes(out)


def passes(spark: SparkSession, bitmap: bytes, column: str, bits: int = 1 << 23) -> Column:
    """Whether the hashed value of a column is in a bitmap of id_filter().

    The bitmap is a broadcast of fixed size; only the places go to Python, not the rows.
    """
    held = spark.sparkContext.broadcast(np.frombuffer(bitmap, dtype=np.uint8))

    @F.pandas_udf("boolean")
    def hit(place: pd.Series) -> pd.Series:
        at = place.to_numpy()
        return pd.Series((held.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return hit(F.pmod(F.xxhash64(F.col(column)), F.lit(bits)))


def lean(run):
    """A function over batches that gives freed memory back when a task is over, as workers outlive their tasks."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def slices(texts: pa.Array, max_bytes: int = 1 << 20):
    """(first, last) row bounds of runs of texts with at most max_bytes together; a longer text is alone."""
    n = len(texts)
    sizes = np.zeros(n, dtype=np.int64)
    if n:
        sizes[:] = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i in range(n):
        if i > start and total + sizes[i] > max_bytes:
            yield start, i
            start, total = i, 0
        total += int(sizes[i])
    if start < n:
        yield start, n


_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Longest word in bytes that is hashed as a number, and the bytes of a number that words of each length have.
_SHORT = 7
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(_SHORT + 1)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(texts: list[str | None], lower: bool = True) -> tuple[list[bytes], np.ndarray]:
    """The words of all texts (A-Z lower-cased) and where each text's words start (with the end at last)."""
    words: list[bytes] = []
    bounds = [0]
    for text in texts:
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
        words += (raw.translate(_LOWER) if lower else raw).split()  # bytes are split at SPACE_CHARS alone
        bounds.append(len(words))
    return words, np.array(bounds)


def word_hashes(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all texts' words, and where each text's words start (with the end at last).

    A word's hash depends on its bytes alone, so equal words of different tasks have equal hashes.  Words of at most seven
    bytes are mixed as one number with their length, one to one, so no two of them collide; longer ones are hashed as
    byte strings.
    """
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    data = b" ".join(raw) + b" " * 8
    if lower:
        data = data.translate(_LOWER)
    edges = np.flatnonzero(np.diff(_IS_SPACE[np.frombuffer(data, dtype=np.uint8)], prepend=True))
    starts, ends = edges[0::2], edges[1::2]
    sizes = ends - starts
    eights = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))  # the eight bytes from each on
    hashes = mix((eights[starts] & _BYTES[np.minimum(sizes, _SHORT)]) | (sizes.astype(np.uint64) << np.uint64(56)))
    long = np.flatnonzero(sizes > _SHORT)
    words = [data[i:j] for i, j in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    hashes[long] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    offsets = np.cumsum([0, *(len(x) + 1 for x in raw)])
    return hashes, np.searchsorted(starts, offsets)
