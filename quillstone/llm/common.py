"""Shared helpers: table access, staged tables, Arrow text views and vectorised word hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.session import ship

U = np.uint64
#: Bytes of text that one numpy pass takes at once; a longer text is taken alone.
CHUNK_BYTES = 500_000


# ---------------------------------------------------------------- tables
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def column(df: DataFrame, name: str, kind: str):
    """The column cast to kind, or nulls where the table lacks it."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def others(df: DataFrame, *taken: str) -> list[str]:
    """The columns of df whose names are not taken; case does not tell names apart."""
    low = {t.lower() for t in taken}
    return [c for c in df.columns if c.lower() not in low]


_staged: dict[str, SparkSession] = {}


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset and all runs on one machine (tests), a folder that is set here."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillstone-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends there, and lost executors cost nothing before it."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/staged-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged[path] = spark
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_at = path
    return back


def drop_staged(*frames: DataFrame) -> None:
    """Delete staged tables that nothing later reads."""
    for df in frames:
        path = getattr(df, "_staged_at", None)
        if path:
            _delete(path, df.sparkSession)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of stages that nothing refers to any more; it does so once their handles are collected.

    What the last call to the JVM returned is held until the next one, so it takes two passes; the pauses let executors delete.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def _delete(path: str, spark: SparkSession) -> None:
    if _staged.pop(path, None) is not None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for path, spark in list(_staged.items()):
        try:
            _delete(path, spark)
        except Exception:  # the JVM may be gone already
            return


def partitions(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions of the session: grows with the cluster's settings, not with a constant here."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def trim() -> None:
    """Give memory that a worker no longer uses back to the machine: idle workers of earlier stages would hold it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


# ---------------------------------------------------------------- Arrow text
def utf8_view(arr) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of strings or bytes; null counts as empty. offsets are relative to the returned bytes."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if pa.types.is_binary(arr.type) or pa.types.is_string(arr.type):
        arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = pc.fill_null(arr, pa.scalar(b"" if pa.types.is_large_binary(arr.type) else "", arr.type))
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64, len(arr) + 1, arr.offset * 8) if off is not None and off.size else np.zeros(1, np.int64)
    if data is None or not len(offsets) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    return np.frombuffer(data, np.uint8, hi - lo, lo), offsets - lo


def text_chunks(arr, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of at most limit bytes, or one row if it is longer."""
    buf, off = utf8_view(arr)
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b, buf[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b
    trim()


# ---------------------------------------------------------------- hashing
def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_fold = np.arange(256)
_fold[65:91] += 32
BYTE_HASH = mix((np.arange(256, dtype=np.uint64) + U(1)) * U(0x9E3779B97F4A7C15))
#: Hash of each byte with A-Z taken as a-z.
FOLD_HASH = BYTE_HASH[_fold]
_pow: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _pow.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), base, np.uint64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if n <= 8 * CHUNK_BYTES:
            _pow[base] = have
    return have[:n]


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """256 booleans, true in the given inclusive ranges."""
    lut = np.zeros(256, bool)
    for a, b in ranges:
        lut[a : b + 1] = True
    return lut


#: Bytes of words between white space: all but \x20 and \x09-\x0D.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Bytes of lower-cased alphanumeric words; A-Z count as they are folded.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def words(buf: np.ndarray, off: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of lut's bytes; runs end where a row ends."""
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = lut[buf]
    here, before, after = inside[1:-1], inside[:-2].copy(), inside[2:].copy()
    cut = off[(off > 0) & (off < len(buf))]
    before[cut] = False
    after[cut - 1] = False
    starts, ends = np.flatnonzero(here & ~before), np.flatnonzero(here & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, by_byte: np.ndarray = FOLD_HASH) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums of a polynomial over the bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(by_byte[buf] * powers(_BASE, len(buf)), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * powers(_INV, len(buf))[starts]
    return mix(raw ^ ((ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93)))


_STEP = U(0xA0761D6478BD642F | 1)


def ngram_hashes(wh: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of each run of n words of one row."""
    m = len(wh) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(m, n, np.uint64)
    for i in range(n):
        h = h * _STEP + wh[i : i + m]
    first = np.flatnonzero(rows[:m] == rows[n - 1 :])
    return mix(h[first]), first


def shingles(buf: np.ndarray, off: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each row's distinct size-word shingles, sorted by both; a row of fewer words has its whole sequence as one."""
    s, e, rows = words(buf, off, NOT_SPACE)
    wh = word_hashes(buf, s, e)
    h, first = ngram_hashes(wh, rows, size)
    hs, rs = [h], [rows[first]]
    count = np.bincount(rows, minlength=len(off) - 1)
    begin = np.cumsum(count) - count
    for k in range(1, size):
        short = np.flatnonzero(count == k)
        if len(short):
            x = np.full(len(short), k, np.uint64)
            for i in range(k):
                x = x * _STEP + wh[begin[short] + i]
            hs.append(mix(x))
            rs.append(short)
    h, r = np.concatenate(hs), np.concatenate(rs).astype(np.int64)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return r[keep], h[keep]


def spark_type(kind: str) -> T.StructType:
    return T._parse_datatype_string(kind)


# ---------------------------------------------------------------- components
#: Links that one task finishes: some 16 MB of ids, checked before they meet there.
FINISHED = 1_000_000


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node that each reaches): labels sink along links and then along labels until none changes."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return nodes, nodes[label]
        x, y = x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label = label[label]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(np.asarray(b.column("u")), np.asarray(b.column("v"))) for b in batches]
    if got:
        nodes, least = least_reached(*(np.concatenate(x) for x in zip(*got, strict=True)))
        for a in range(0, len(nodes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[a : a + 100_000]), pa.array(least[a : a + 100_000])], names=["node", "component"])


def components(links: DataFrame, a: str = "a", b: str = "b", label: str = "components", most_rounds: int = 60, finished: int = FINISHED) -> DataFrame:
    """(node, component): the smallest node that each node of the links reaches.

    Alternating large-star and small-star steps; each step sends a node's
    neighbours to the smallest of them with a grouped minimum joined back, so
    no neighbourhood is gathered. Once no more than `finished` links are left,
    one task follows them to their ends. Only a change count reaches the driver.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = stage(edges, label)
    last = None
    for _ in range(most_rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum((F.xxhash64("u", "v", F.lit(7)) % 1000003).cast("long"))).first()
        if now[0] <= finished:
            return edges.coalesce(1).mapInArrow(_finish, "node long, component long")
        if last == now:
            break
        last = now
        # large star: every neighbour above a node goes to the least neighbour (the node included)
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: a node and its lower neighbours go to the least of them
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = stage(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct(), label)
        drop_staged(edges)
        edges = nxt
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
