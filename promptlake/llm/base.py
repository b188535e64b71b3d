"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text handled at once inside a task, in UTF-8 bytes.
CHUNK_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, where
    driver and executors are one process, may go without.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = f"file://{tempfile.mkdtemp(prefix='promptlake-')}"
    spark.conf.set("spark.checkpoint.dir", where)
    spark.sparkContext.setCheckpointDir(where)
    return where


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/promptlake/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def discard(df: DataFrame) -> None:
    """Delete what `stored` wrote, once nothing will read it again."""
    hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    hadoop.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def apart(df: DataFrame) -> DataFrame:
    """df for a join in which it is never broadcast: for tables that grow with the input, whose files are small only as they are compressed."""
    return df.hint("merge")


def hidden(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ranked(df: DataFrame, order: list, column: str) -> DataFrame:
    """df with row numbers from 1 in this order, sorted in ranges by many tasks.

    Row numbers within a range come with the sort; each range then moves on by the sizes
    of the ranges before it, a table of one row a range. The sorted rows are stored, so the
    caller may discard what is returned by `stored_at`. Rows equal in `order` lie in one range
    and are numbered in any order: add a random last key where many may be equal.
    """
    place = hidden(df, "place__")
    told = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id()), "ranked")
    part, bits = F.shiftright(place, 33), F.lit((1 << 33) - 1)
    sizes = told.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    start = F.map_from_entries(F.collect_list(F.struct("part", "before")))
    starts = before.agg(start).first()[0]
    if not starts:
        return told.withColumn(column, F.lit(0).cast("bigint")).drop(place)
    moved = F.element_at(F.create_map(*(F.lit(x).cast("bigint") for pair in starts.items() for x in pair)), part)
    found = told.withColumn(column, moved + F.col(place).bitwiseAND(bits) + 1).drop(place)
    found.stored_at = told.stored_at
    return found


def held_out(remainder: int, modulus: int, column: str = "doc_id"):
    """True where crc32 of the id as text leaves this remainder; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(modulus)) == remainder, F.lit(False))


def strings(array: pa.Array) -> list[str]:
    """The texts of a column, null as empty."""
    return [x or "" for x in array.to_pylist()]


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying the texts; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if array.null_count:
        array = array.fill_null("")
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK_BYTES):
    """Yield (bytes, owner of each byte) in pieces of about `size`, every text whole or cut after a blank.

    A text longer than a piece continues in the next one, so memory stays bounded
    whatever a text's length; what callers gather per text must therefore add up.
    """
    start, end = 0, len(data)
    while start < end:
        stop = min(end, start + size)
        if stop < end:
            blanks = np.flatnonzero(data[start:stop] <= 32)
            edge = offsets[np.searchsorted(offsets, stop, "right") - 1]
            stop = int(edge) if edge > start else start + int(blanks[-1]) + 1 if len(blanks) else stop
        first = np.searchsorted(offsets, start, "right") - 1
        last = np.searchsorted(offsets, stop, "left")
        inside = np.clip(offsets[first : last + 1], start, stop)
        yield data[start:stop], np.repeat(np.arange(first, last), np.diff(inside))
        start = stop


def slices(texts: pa.Array, size: int = CHUNK_BYTES):
    """Yield consecutive parts of a text column of about `size` bytes each (one row at least)."""
    offsets = utf8(texts)[1]
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
        yield texts[start : min(n, stop)]
        start = stop


#: ASCII capitals to small letters, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Digits, letters and every byte of a character beyond ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True


def fold(data: np.ndarray) -> np.ndarray:
    """Small letters for A-Z and for the accented capitals U+00C0 to U+00DE."""
    low = LOWER[data]
    if len(low) > 1:
        tail = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][tail] += 32
    return low


def multipliers(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(low: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each run of word bytes within one text."""
    is_word = WORD[low]
    if not len(low):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = np.concatenate([[False], owner[1:] == owner[:-1]])
    begins = is_word & ~(np.concatenate([[False], is_word[:-1]]) & same)
    after = np.concatenate([is_word[1:] & same[1:], [False]])
    return np.flatnonzero(begins), np.flatnonzero(is_word & ~after) + 1


def texts_of(docs: DataFrame, chosen: DataFrame, key: str, text: str) -> DataFrame:
    """chosen (column `key`, a bounded number of different ids) with one text each: of several, the smallest.

    The ids are broadcast to the documents, so no other text is shuffled.
    """
    told = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return told.join(F.broadcast(chosen), "key").groupBy(*chosen.columns).agg(F.min("text").alias("text"))
