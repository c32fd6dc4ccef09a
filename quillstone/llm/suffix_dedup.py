"""Removal of repeated byte strings by suffix arrays over shards.

Every byte that lies in a `length`-byte string starting at two or more places
of the corpus is removed.

1. A window (length bytes) belongs to the least hash of its grams, so equal
   windows share it whatever surrounds them. Windows in a row with one least
   hash form a run; only runs of a hash that stands at two places or more can
   hold repeats. Texts are known by their digest: copies count once here.
2. Each such run's segment is cut out. Segments of equal bytes are one segment
   from here on: if it stands at two places, all its windows repeat.
3. The distinct segments of a hash go to one shard, whose suffix order and
   common prefixes come from external induced sorting (suffixes.py): windows
   whose neighbour agrees on length bytes repeat. There are as many shards as
   hold SHARD_BYTES each.
4. A hash with too many distinct segments (a passage that countless texts
   share, with other bytes around it each time) would fill one shard. Its
   segments are cut anew as texts of their own, with such hashes, and the
   grams that many segments of a sample share, last in the order: a window
   then goes by a gram that is not common, and windows of common grams alone
   are the shared passages, whose segments are equal. This is repeated for
   hashes that come out common in turn. Which grams count as common moves
   work, but never decides what repeats.
5. Texts that occur twice and hold a window are removed whole.

Null or empty text: no bytes, nothing removed; texts shorter than length are
kept; texts of any length are taken whole; repeated rows are copies of each
other; an empty table gives no rows. Columns of the input stay, but text and
those named as a result (n_bytes, spans, n_removed, kept_sha256) give way.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from itertools import groupby, islice
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import _BASE, _INV, BYTE_HASH, column, drop_staged, mix, others, partitions, powers, release, shared_root, stage, table, utf8_view
from quillstone.llm.suffixes import SEPARATOR, Scratch, repeats

LENGTH, GRAM = 400, 16
#: Distinct segments that make a hash common, at least, and common hashes that one round can find, at most: the bound grows with the segments of all.
HOT, MOST_HOT = 256, 100_000
#: Segments of a common hash that are looked at for further common grams, and such grams that a round takes at most.
SAMPLED, MOST_GRAMS = 64, 200_000
#: Rounds of cutting anew; what is common still is sorted as it is.
ROUNDS = 4
#: Copies that are joined apart: a text that more than one in so many rows repeat.
COPIED = 10_000
#: Memory of a shard's sort before it goes on in files.
SORT_MEMORY = 256_000_000
#: Shards for each shuffle partition where a shard has LEAST_BYTES, and bytes of a shard at most: a sort holds some 50 for each.
SHARDS, LEAST_BYTES, SHARD_BYTES = 4, 1_000_000, 16_000_000
SPANS = "array<struct<start:long,end:long>>"


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each position."""
    sums = np.empty(len(b) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(BYTE_HASH[b] * powers(_BASE, len(b)), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers(_INV, len(b))[: len(b) - k + 1])


def sliding_least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values in a row, from prefix and suffix minima of blocks."""
    m = len(h) - w + 1
    x = np.concatenate([h, np.full(-len(h) % w, ~np.uint64(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(x, 1).ravel()
    behind = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:m], ahead[w - 1 : w - 1 + m])


def window_runs(b: np.ndarray, length: int, gram: int, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(least hash, first window, number of windows, places of the hash) of each run; hashes in common (sorted) come last, with the highest bit set."""
    h = gram_hashes(b, gram) >> np.uint64(1)
    if common is not None and len(common):
        h = np.where(common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h, h | np.uint64(1 << 63), h)
    least = sliding_least(h, length - gram + 1)
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    size = np.diff(np.append(start, len(least)))
    key = least[start]
    span = length - gram
    places = np.array([np.count_nonzero(h[s : s + n + span] == k) for s, n, k in zip(start.tolist(), size.tolist(), key, strict=True)])
    return key, start, size, places


def _runs(length: int, gram: int, common: np.ndarray | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = utf8_view(b.column("text"))
            own = [np.frombuffer(t.as_buffer(), np.uint64)[0] for t in b.column("tk")]
            cols, row = [], []
            for i in range(b.num_rows):
                text = buf[off[i] : off[i + 1]]
                if len(text) >= length:
                    key, start, size, places = window_runs(text, length, gram, common)
                    cols.append((key.view(np.int64), mix(own[i] ^ (start.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64), start, size, places))
                    row.append(np.full(len(key), i))
            if cols:
                at = pa.array(np.concatenate(row))
                key, rid, start, size, places = (np.concatenate(c) for c in zip(*cols, strict=True))
                yield pa.RecordBatch.from_arrays([b.column("tk").take(at), b.column("did").take(at), pa.array(key), pa.array(rid), pa.array(start), pa.array(size), pa.array(places > 1)], names=["tk", "did", "key", "rid", "start", "windows", "inner"])

    return run


def _shared_grams(gram: int, least: int):
    """Of segments in the order of their hash: the grams that `least` segments of one hash or more hold, and how many do. Counted as the segments pass, so no row is made for a gram that is not shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k, x.as_buffer()) for b in batches for k, x in zip(b.column("key").to_pylist(), b.column("text"), strict=True))
        for _, own in groupby(rows, key=lambda r: r[0]):
            held = [np.unique(gram_hashes(np.frombuffer(x, np.uint8), gram) >> np.uint64(1)).view(np.int64) for _, x in own]
            found, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found[n >= least]), pa.array(n[n >= least])], names=["gram", "n"])

    return run


def _cut(length: int):
    kind = pa.schema([("key", pa.int64()), ("sh", pa.binary()), ("rid", pa.int64()), ("tk", pa.binary()), ("start", pa.int64()), ("windows", pa.int64()), ("inner", pa.bool_()), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # rows that repeat a text's row add nothing
        for b in batches:
            rows, size = [], 0
            for tk, text, runs in zip(b.column("tk").to_pylist(), b.column("text"), b.column("runs").to_pylist(), strict=True):
                if tk in seen:
                    continue
                seen.add(tk)
                raw = text.as_py()
                for i, r in enumerate(runs):
                    seg = raw[r["start"] : r["start"] + r["windows"] + length - 1]
                    sh = hashlib.blake2b(seg, digest_size=16, key=r["key"].to_bytes(8, "little", signed=True)).digest()
                    rows.append((r["key"], sh, r["rid"], tk, r["start"], r["windows"], r["inner"], raw if i == 0 else None))
                size += len(raw)
                if size > 16_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    return run


def _segments(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, runs in zip(b.column("text"), b.column("runs").to_pylist(), strict=True):
                raw = text.as_py()
                rows += [(r["key"], r["sh"], raw[r["start"] : r["start"] + r["windows"] + length - 1]) for r in runs]
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 10_000], strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["key", "sh", "seg"])

    return run


def _flag_rows(found: list[tuple[bytes, np.ndarray]]) -> pa.RecordBatch:
    """(sh, runs of repeating windows) from a mask a segment."""
    hashes, values, sizes = [], [], [0]
    for sh, mask in found:
        edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(s):
            hashes.append(sh)
            values.append((s, e))
            sizes.append(sizes[-1] + len(s))
    s, e = (np.concatenate([v[k] for v in values]) if values else np.zeros(0, np.int64) for k in (0, 1))
    spans = pa.StructArray.from_arrays([pa.array(s, pa.int64()), pa.array(e, pa.int64())], names=["start", "end"])
    return pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), spans)], names=["sh", "flags"])


def mounted(root: str, default: str | None = None) -> str | None:
    """The mounted path of a folder (file:///x, file:/x, or /x where files are the default), or None."""
    uri = urlsplit(root)
    kind = uri.scheme or urlsplit(default or "file:///").scheme
    path = unquote(uri.path)
    return path if kind == "file" and not uri.netloc and path.startswith("/") and not path.startswith("//") else None


def _sorted_shard(length: int, folder: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[bytes, tuple[int, int]] = {}

        def pieces() -> Iterator[bytes]:
            at = 0
            for b in batches:
                for sh, seg in zip(b.column("sh").to_pylist(), b.column("seg"), strict=True):
                    if sh not in places:
                        raw = seg.as_py()
                        places[sh] = (at, len(raw) - length + 1)
                        at += len(raw) + 1
                        yield raw + bytes([SEPARATOR])

        scratch = Scratch(folder, SORT_MEMORY if folder else sys.maxsize)  # no file on a machine's own disk
        try:
            text = scratch.gathered(pieces())
            if not places:
                return
            flags = repeats(text, length, scratch)
            found = iter(places.items())
            while some := list(islice(found, 5000)):
                yield _flag_rows([(sh, np.asarray(flags[a : a + n])) for sh, (a, n) in some])
        finally:
            scratch.close()

    return run


def _removed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, flags in zip(b.column("text"), b.column("flags").to_pylist(), strict=True):
                raw = text.as_buffer()
                spans = []
                for s, e in sorted({(f["start"], f["end"] - 1 + length) for f in flags}):
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], e)
                    else:
                        spans.append([s, e])
                view, at, kept = memoryview(raw), 0, hashlib.sha256()
                for s, e in spans:
                    kept.update(view[at:s])
                    at = e
                kept.update(view[at:])
                rows.append(([{"start": s, "end": e} for s, e in spans], sum(e - s for s, e in spans), kept.hexdigest()))
            spans, removed, kept = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column("tk"), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["tk", "spans", "n_removed", "kept_sha256"])

    return run


def repeated_windows(long: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, common: np.ndarray | None = None, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Of texts (tk: digest, did, text: bytes): (tk and flags, the ranges of windows that repeat; tk and text of those that may hold some)."""
    spark, parts = long.sparkSession, partitions(long)
    scratch = mounted(shared_root(spark), spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS"))
    runs = stage(long.mapInArrow(_runs(length, gram, common), "tk binary, did long, key long, rid long, start long, windows long, inner boolean"), "runs")
    twice = runs.groupBy("key").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi"), F.max("inner").alias("in_")).where("lo <> hi or in_").select("key")
    wanted = stage(runs.join(twice, "key").groupBy("tk").agg(F.min("did").alias("did"), F.collect_set(F.struct("key", "rid", "start", "windows", "inner")).alias("runs")), "wanted")
    drop_staged(runs)
    # by merging, so rows that repeat a text's row meet in a task, which takes the first
    cut = stage(long.join(wanted.hint("merge"), ["tk", "did"]).mapInArrow(_cut(length), "key long, sh binary, rid long, tk binary, start long, windows long, inner boolean, text binary"), "segments")
    drop_staged(wanted)
    release(spark)

    places = stage(cut.groupBy("key", "sh").agg(F.min("rid").alias("first"), F.max("rid").alias("last"), F.max("inner").alias("inner")), "places")
    keys = places.groupBy("key").agg(F.count("*").alias("segments"), F.max("inner").alias("any_inner")).where("segments > 1 or any_inner")
    active = places.select("key", F.col("sh"), F.col("first").alias("rid")).join(keys.select("key", "segments"), "key").select("sh", "rid", "segments")
    texts = cut.where("text is not null").select("tk", "text")
    chosen = stage(cut.select("sh", "rid", "key", "tk", "start", "windows").join(active, ["sh", "rid"]), "chosen")
    segments, size = chosen.agg(F.count("*"), F.coalesce(F.sum(F.col("windows") + length - 1), F.lit(0))).first()
    # a hash whose highest bit is set is common already
    is_hot = (F.col("segments") > max(hot, segments // MOST_HOT)) & (F.col("key") >= 0) if rounds else F.lit(False)
    found = [r.key for r in chosen.where(is_hot).select("key").distinct().collect()]  # MOST_HOT of them at most

    def bodies(which: DataFrame) -> DataFrame:
        """key, sh, seg of one place of each segment, cut from the texts anew: no segment is written before it is known to be wanted."""
        by = which.groupBy("tk").agg(F.collect_set(F.struct("key", "sh", "start", "windows")).alias("runs"))
        return texts.join(by, "tk").mapInArrow(_segments(length), "key long, sh binary, seg binary")

    shards = max(1, min(SHARDS * parts, -(-size // LEAST_BYTES)), -(-size // SHARD_BYTES))
    cold = bodies(chosen.where(~is_hot)).repartition(shards, "key")
    flags = cold.select("sh", "seg").mapInArrow(_sorted_shard(length, scratch), f"sh binary, flags {SPANS}")
    if found:
        warm = stage(bodies(chosen.where(is_hot)).select("key", F.col("sh").alias("tk"), F.lit(0).cast("long").alias("did"), F.col("seg").alias("text")), "hot-segments")
        # the window leaves a hash's rows in one task and in a row
        some = warm.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("tk"))).where(F.col("rank") <= SAMPLED)
        shared = some.select("key", "text").mapInArrow(_shared_grams(gram, max(2, min(hot, SAMPLED) // 4)), "gram long, n long")
        shared = shared.groupBy("gram").agg(F.max("n").alias("n")).orderBy(F.col("n").desc(), "gram").limit(MOST_GRAMS).select("gram").toArrow()["gram"]
        both = np.unique(np.concatenate([np.array(found, np.int64).view(np.uint64), np.asarray(shared, np.int64).view(np.uint64), common if common is not None else np.zeros(0, np.uint64)]))
        again, _ = repeated_windows(warm.drop("key"), length, gram, hot, both, rounds - 1)
        flags = flags.unionByName(again.select(F.col("tk").alias("sh"), "flags"))
    flagged = stage(flags, "flags")
    release(spark)

    all_windows = places.where("first <> last").select("sh").withColumn("whole", F.lit(True))
    of = flagged.dropDuplicates(["sh"]).join(all_windows, "sh", "full").select("sh", "flags", "whole")
    member = cut.select("sh", "tk", "start", "windows").join(of, "sh")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("windows").alias("end")))
    moved = F.transform(F.when(F.col("whole"), whole).otherwise(F.col("flags")), lambda f: F.struct((f["start"] + F.col("start")).alias("start"), (f["end"] + F.col("start")).alias("end")))
    return member.select("tk", F.explode(moved).alias("f")).groupBy("tk").agg(F.collect_set("f").alias("flags")), texts


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, copied: int = COPIED) -> DataFrame:
    """docs' columns without text, plus n_bytes, spans (removed byte ranges), n_removed and kept_sha256."""
    keep = others(docs, "text", "n_bytes", "spans", "n_removed", "kept_sha256")
    row = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.struct(F.lit(0).alias("none"))
    raw = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    known = docs.select(row.alias("row"), raw.alias("text"), F.unhex(F.md5(raw)).alias("tk"), F.coalesce(column(docs, "doc_id", "long"), F.lit(-(2**63))).alias("did"))
    long = known.where(F.octet_length("text") >= length)
    by_text, texts = repeated_windows(long.select("tk", "did", "text"), length, gram, hot)
    result = stage(texts.join(by_text, "tk").mapInArrow(_removed(length), f"tk binary, spans {SPANS}, n_removed long, kept_sha256 string").dropDuplicates(["tk"]), "removed")

    copies = stage(long.groupBy("tk").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    rows = docs.count()
    # copies are removed whole; those of a text that many rows repeat, of which there are few, need not meet in one task to know it
    many = F.broadcast(copies.where(F.col("copies") > max(1, rows // copied)).select("tk", F.lit(True).alias("many")))
    told = known.select("row", "tk", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own_sha256")).join(many, "tk", "left")
    apart = told.where("many").select("row", "n_bytes", F.lit(2).alias("copies"), F.expr(f"cast(null as {SPANS})").alias("spans"), F.lit(None).cast("long").alias("n_removed"), F.lit(None).cast("string").alias("kept_sha256"), "own_sha256")
    met = told.where("many is null").join(copies, "tk", "left").join(result, "tk", "left").select(*apart.columns)
    twice = F.coalesce(F.col("copies") > 1, F.lit(False))
    n = F.col("n_bytes")
    return apart.unionByName(met).select(
        *(F.col(f"row.`{c}`") for c in keep),
        "n_bytes",
        F.when(twice, F.array(F.struct(F.lit(0).cast("long").alias("start"), n.alias("end")))).otherwise(F.coalesce("spans", F.expr(f"cast(array() as {SPANS})"))).alias("spans"),
        F.when(twice, n).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(twice, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "own_sha256")).alias("kept_sha256"),
    )


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
