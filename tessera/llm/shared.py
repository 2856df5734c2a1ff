"""What the operators of this subpackage share: the shared folder, stored tables,
and vectorised reading of words out of Arrow string batches."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ship_package

#: The word and space classes of the contracts (ASCII white space only).
SPACE_CLASS = r"[\x20\x09-\x0D]+"

#: Bytes of an Arrow batch that a Python worker gets.
BATCH_BYTES = 8 << 20

_local_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the
    session. Where it is unset, a local session (tests) gets a temporary folder; on a
    cluster there is no folder to choose, and it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="tessera-shared-"))
    return "file://" + _local_root[0]


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{shared_root(spark)}/tessera/{tag}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut,
    and a lost executor costs a re-read, not a recomputation. Small row groups keep the
    writers' memory low."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*frames: DataFrame) -> None:
    """Delete stored tables that no later step reads."""
    for df in frames:
        if getattr(df, "_stored_at", None):
            remove(df.sparkSession, df._stored_at)


def clean_up(spark: SparkSession) -> None:
    """Delete all stored tables, once no result of this subpackage is read any more."""
    remove(spark, f"{shared_root(spark)}/tessera")


def _row_bytes(small: DataFrame) -> Column:
    """About the bytes of a row: 8 a number, the bytes of strings, 8 an array element."""
    size = F.lit(0)
    for f in small.schema.fields:
        kind = f.dataType.simpleString()
        own = F.octet_length(f.name) if kind in ("string", "binary") else 8 * F.size(f.name) if kind.startswith("array") else F.lit(8)
        size = size + F.coalesce(own, F.lit(0))
    return size.cast("long")


def with_small(big: DataFrame, small: DataFrame, on: str, how: str = "left", most_rows: int = 100_000, most_bytes: int = 16 << 20) -> DataFrame:
    """Join a stored table by a string key. It is broadcast only if its rows and their
    bytes, counted first, are within the bounds, so that a hot key of ``big`` needs no
    shuffle; beyond them the join shuffles both sides and AQE splits hot keys."""
    rows, size = small.agg(F.count(F.lit(1)), F.coalesce(F.sum(_row_bytes(small)), F.lit(0))).first()
    return big.join(F.broadcast(small) if rows <= most_rows and size <= most_bytes else small, on, how)


#: A group with over one in so many rows is joined by broadcast.
HOT_SHARE = 1000


def with_groups(rows: DataFrame, groups: DataFrame, on: str | list[str]) -> DataFrame:
    """``rows`` with the columns of their group, by the stored ``groups`` (on, n, others), n
    being the group's rows; rows without a group go. Groups with over 1 / ``HOT_SHARE`` of all
    rows are fewer than ``HOT_SHARE`` at any size: those are broadcast, so no task gets a whole
    hot group; the others meet by a shuffle."""
    keys = [on] if isinstance(on, str) else on
    total = groups.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_SHARE > total
    large = F.broadcast(groups.where(hot).drop("n"))
    small = groups.where(~hot).drop("n")
    return rows.join(large, keys).unionByName(rows.join(large.select(*keys), keys, "left_anti").join(small, keys))


def prepare(spark: SparkSession) -> None:
    """Make this package importable in Python workers, and bound the bytes of an Arrow
    batch between the JVM and Python."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def whole_text(col: str = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def text_slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20):
    """Cut a record batch so that each slice holds about ``most_bytes`` of text (a
    single longer text is its own slice): hashing takes some 80 bytes a byte of text."""
    col = batch.column(column)
    if not len(col):
        return
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    start = 0
    while start < len(col):
        end = int(np.searchsorted(offs, offs[start] + most_bytes, "right")) - 1
        end = min(max(end, start + 1), len(col))
        yield batch.slice(start, end - start)
        start = end


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (rebased to 0) of a string array without copying texts.
    Nulls count as empty."""
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    n = len(col)
    offs = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8) if n else np.zeros(1, np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return raw, (offs - offs[0]).astype(np.int64)


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


#: Rolling hashes are polynomials modulo this prime, in two lanes with bases of their own.
PRIME = (1 << 31) - 1
_PRIME, _SHIFT = np.uint64(PRIME), np.uint64(31)


def _folded(x: np.ndarray) -> np.ndarray:
    """A smaller number that is equal modulo the prime."""
    return (x & _PRIME) + (x >> _SHIFT)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo the prime, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    step = base % PRIME
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(step) % _PRIME
        done += take
        step = step * step % PRIME
    return out[:n].astype(np.uint32)


_kept_powers: dict[int, np.ndarray] = {}


def kept_powers(base: int, n: int) -> np.ndarray:
    """As ``powers``; arrays of usual length are kept for the next batch."""
    if n > 3 << 19:
        return powers(base, n)
    have = _kept_powers.get(base)
    if have is None or len(have) < n:
        _kept_powers[base] = have = powers(base, n)
    return have[:n]


@lru_cache
def _lane(salt: int, lane: int) -> tuple[int, int, np.ndarray]:
    """The base of a lane, its inverse, and the lane's values of the 256 bytes."""
    seed = mix64(np.arange(257, dtype=np.uint64) + np.uint64((2 * salt + lane + 1) << 32))
    base = 2 + int(seed[256]) % (PRIME - 3)
    return base, pow(base, -1, PRIME), 1 + seed[:256] % np.uint64(PRIME - 1)


#: Symbols that are hashed at a time.
STEP = 1 << 16


class Rolling:
    """Hashes of any stretch of a symbol array (bytes, or 64-bit hashes) from prefix sums:
    in each of two lanes a polynomial in a base modulo a prime, divided by the power of
    the start, so equal stretches agree wherever they stand. Hashes under different salts
    have different bases. Of symbols with two columns, a salt takes one."""

    def __init__(self, symbols: np.ndarray, salt: int = 0):
        if symbols.ndim == 2:
            symbols = np.ascontiguousarray(symbols[:, salt % 2])
        n = len(symbols)
        self.lanes = []
        for lane in (0, 1):
            base, inverse, table = _lane(salt, lane)
            ways = kept_powers(base, n)
            prefix = np.zeros(n + 1, np.uint64)
            # Some symbols at a time, so that what is computed on the way stays small.
            for lo in range(0, n, STEP):
                part = symbols[lo : lo + STEP]
                values = table[part] if part.dtype == np.uint8 else (part >> np.uint64(31 * lane)) & _PRIME
                upto = prefix[lo + 1 : lo + 1 + len(part)]
                np.cumsum(_folded(values * ways[lo : lo + len(part)]), out=upto)
                upto += prefix[lo]
            self.lanes.append((prefix, kept_powers(inverse, n + 1)))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), np.uint64)
        for lo in range(0, len(a), STEP):
            x, y = a[lo : lo + STEP], b[lo : lo + STEP]
            hashed = (y - x).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for lane, (prefix, inverse) in enumerate(self.lanes):
                h = _folded(_folded(prefix[y] - prefix[x])) * inverse[x]
                h = _folded(_folded(h))
                h[h >= _PRIME] -= _PRIME
                hashed ^= h << np.uint64(32 * lane)
            out[lo : lo + STEP] = mix64(hashed)
        return out


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_bounds(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word of a batch, and each row's first word number
    (length rows + 1)."""
    space = _IS_SPACE[raw]
    begins = ~space
    begins[1:] &= space[:-1]
    row_starts = offs[:-1][offs[:-1] < offs[1:]]
    begins[row_starts] = ~space[row_starts]
    starts = np.flatnonzero(begins)
    ends_mask = np.zeros(len(raw) + 1, bool)
    ends_mask[1:] = ~space
    last = ends_mask.copy()
    last[1:-1] &= space[1:]
    last[-1:] = ends_mask[-1:]
    row_ends = offs[1:][offs[1:] > offs[:-1]]
    last[row_ends] = ends_mask[row_ends]
    last[0] = False
    ends = np.flatnonzero(last)
    return starts, ends, np.searchsorted(starts, offs)


#: Words are hashed over about so many bytes at a time; longer words one by one.
WORD_BYTES = 1 << 20


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of every word."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = int(np.searchsorted(ends, lo + WORD_BYTES, "right"))
        if j <= i:
            word = raw[lo : int(ends[i])]
            digest = hashlib.blake2b((_LOWER[word] if lower else word).tobytes(), digest_size=8, salt=salt.to_bytes(16, "little")).digest()
            out[i] = int.from_bytes(digest, "little")
            i += 1
            continue
        part = raw[lo : int(ends[j - 1])]
        out[i:j] = Rolling(_LOWER[part] if lower else part, salt).of(starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return out


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
