"""What several text operators need: work tables, words, fixed-size bitmaps, row keys."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_LOCAL_DIR: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's spark.checkpoint.dir. Only a local[...] session that names none gets a
    temporary folder; on a cluster the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append(tempfile.mkdtemp(prefix="tidemark-"))
        atexit.register(shutil.rmtree, _LOCAL_DIR[0], ignore_errors=True)
    return f"file://{_LOCAL_DIR[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application's JVM ends."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage ends there, and a lost
    executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, df: DataFrame) -> None:
    """Remove the files of a table from stored() that no later step reads."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(conf).delete(hadoop, True)


#: A-Z become a-z; every other byte that is not 0-9, a-z or part of a non-ASCII character becomes a
#: space. Splitting at spaces then gives the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the lower-cased text.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a UTF-8 text; null has none."""
    return text.translate(_WORD_BYTES).split() if text else []


def word_hashes(ws: list[bytes]) -> np.ndarray:
    """CRC-32 of each word as uint64."""
    return np.fromiter(map(zlib.crc32, ws), dtype=np.uint64, count=len(ws))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all runs of `size` words, from their word hashes; none if there are fewer."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(size), np.uint64)
    for i in range(size):
        out = out * _ODD + mixed(h[i : i + n] + np.uint64(i + 1))
    return mixed(out)


#: Address bits of a Bloom bitmap with one hash: 2 MB whatever the number of keys. Where a bitmap follows the number
#: of its keys, 16 bits for each, up to 16 MB.
BITMAP_BITS, MOST_BITMAP_BITS = 24, 27


def bits_for(keys: int) -> int:
    """Address bits of a bitmap for so many keys."""
    return min(MOST_BITMAP_BITS, max(16, (16 * keys).bit_length()))


def bitmap(hashes: DataFrame, column: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap with so many address bits over the 64-bit hashes of a column, built by a distributed
    bit_or. Only its words that are not zero reach the driver, whatever the input: 2**(bits - 6) rows at most."""
    slot = F.shiftrightunsigned(F.col(column), 64 - bits)
    rows = (
        hashes.where(F.col(column).isNotNull())
        .groupBy(F.shiftright(slot, 6).alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 as int))")).alias("bits"))
        .toPandas()
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def in_bitmap(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash may be among those of the bitmap; never false for one that is."""
    at = h >> np.uint64(64 - 5 - len(words).bit_length())
    return ((words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def free_name(df: DataFrame, base: str) -> str:
    """base, with underscores after it until no column of df has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def row_key(id_col: str, text_col: str):
    """A key for a row: equal ids share it only if their texts are equal too, so repeated ids with
    different texts stay apart, and a null id is a key like any other."""
    return F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.xxhash64(F.col(text_col)).cast("string"))


#: Bytes of a batch that are worked on together.
PART = 1 << 23


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about PART bytes, of a row at least."""
    rows = max(1, batch.num_rows * PART // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


#: How to drop what an operator keeps in this Python worker for its next tasks, by the operator's name.
_KEPT: dict[str, Callable[[], None]] = {}
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def kept_in_worker(owner: str, drop: Callable[[], None]) -> None:
    """drop() is called before tasks of other operators begin in the same Python worker."""
    _KEPT[owner] = drop


def give_back() -> None:
    """Return freed memory to the system: else an idle worker holds all that its largest part took."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def keep_only(owner: str | None) -> None:
    """Drop what all operators but this one keep in this Python worker."""
    for name, drop in _KEPT.items():
        if name != owner:
            drop()
    give_back()


def in_worker(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str | None = None):
    """work for mapInArrow, in a worker that keeps at most what owner's tasks before it have kept, and no freed memory after it.

    Workers outlive a query: each executor has as many as cores, beside a heap that grows to its limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(owner)
        yield from work(batches)
        give_back()

    return run


def map_arrow(df: DataFrame, each: Callable[[pa.RecordBatch], dict], schema: str, owner: str | None = None) -> DataFrame:
    """mapInArrow with one dict of columns per part of a batch (see PART). Columns that pass through keep their Arrow
    form, so null or large integer ids stay exact. owner: see in_worker()."""
    target = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                yield pa.RecordBatch.from_pydict(each(part), schema=target)

    return df.mapInArrow(in_worker(run, owner), schema)


def type_of(df: DataFrame, column: str) -> str:
    """A column's type as DDL."""
    return df.schema[column].dataType.simpleString()
