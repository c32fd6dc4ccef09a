"""Exact Jaccard self-join over word shingles with several global orders.

Two texts link when 100 * |A & B| >= PERCENT * |A | B| over their sets of
distinct SIZE-word shingles; components are taken over the links.

1. Every text's shingle hashes travel in packed arrays, one for each bucket of
   hashes, and are counted by sorting a bucket. A shingle that only one text
   holds matches nothing; it leads every order below. What repeats goes back
   to its text, and a text whose repeating part is under PERCENT of its set
   cannot link: it is done.
2. Texts with equal sets are one class from here on.
3. Of each class the prefix under a global order is its first
   r - ceil(0.8 n) + 1 repeating shingles. Linked sets share a prefix shingle
   under every order. The first order takes rare shingles first and makes the
   candidates; two more (by the magnitude of the count, then another hash;
   by a third hash alone) must each agree before a pair is verified by
   intersecting the whole sets. A shingle's place in the first order bounds
   what two sets can share if they first meet there, and drops most pairs.
4. Each prefix shingle first pairs its classes with a few centres only, and
   the verified links give components; a second turn takes other centres for
   shingles that still join several components; then every pair that shares a
   shingle but not a component is tried, unless the sets' sizes lie in bands
   that do not touch or their bitmaps differ in more bits than linked sets
   can. So a group of m near copies costs some m pairs, and no link between
   components is lost.

Null, empty or blank text: an empty set that links with nothing. Fewer words
than SIZE: the sequence is the one shingle. Repeated rows are rows of their
own; ties go by row id; an empty table gives no rows; texts of any length are
taken whole. near_duplicates returns its own columns alone; keep_one keeps all
columns of the input, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import components, drop_staged, mix, partitions, release, shingles, stage, table, text_chunks, trim

SIZE, PERCENT = 5, 80
#: Rows that each prefix shingle pairs its classes with in a turn, and turns before all pairs that are left are tried.
CENTRES, TURNS = 3, 3
#: Hashes that a map task holds before it sends them off.
FLUSH = 800_000
SHUFFLED = "part int, kind int, data binary"
SETS = "uid long, doc_id long, digest binary, n long, repeats long, same binary, hashes binary, counts binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after another; whole numbers other than hashes (unsigned 64-bit) as their distance from the least, in as few bytes as hold it."""
    head, body = [], []
    for x in arrays:
        least = 0
        if x.dtype != np.uint64:
            x = x.astype(np.int64)
            span = int(x.max()) - int(x.min()) if len(x) else 0
            kind = next((t for t in (np.uint8, np.uint16, np.uint32) if span <= np.iinfo(t).max), None)
            if kind and len(x):
                least = int(x.min())
                x = (x - least).astype(kind)
        head += [len(x), x.itemsize, least]
        body.append(np.ascontiguousarray(x).tobytes())
    return struct.pack(f"<{len(head)}q", *head) + b"".join(body)


def _unpack(data: bytes, *dtypes) -> list[np.ndarray]:
    head = struct.unpack_from(f"<{3 * len(dtypes)}q", data)
    at, out = 24 * len(dtypes), []
    for i, t in enumerate(dtypes):
        n, width, least = head[3 * i : 3 * i + 3]
        x = np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64 if t == np.uint64 else np.int64}[width], n, at)
        out.append(x if t == np.uint64 else (x.astype(np.int64) + least).astype(t))
        at += n * width
    return out


def _sent(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "kind", "data"])


def _batched(rows: Iterator[tuple[int, int, bytes]], most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[2])
        if size >= most:
            yield _sent(held)
            held, size = [], 0
    if held:
        yield _sent(held)


def _by_part(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(stable order by part, bounds of each part in it)."""
    order = np.argsort(part.astype(np.uint16), kind="stable") if parts <= 1 << 16 else np.argsort(part, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])


def _home(uid: np.ndarray, parts: int) -> np.ndarray:
    return (mix(uid.astype(np.uint64) ^ np.uint64(0x5DEECE66D)) % np.uint64(parts)).astype(np.int64)


def _split(parts: int, size: int):
    """Texts to packed hashes by bucket (kind 0) and to (uid, id, set size) by the text's own part (kind 1)."""

    def flush(uids, hashes, meta) -> Iterator[tuple[int, int, bytes]]:
        if uids:
            u, h = np.concatenate(uids), np.concatenate(hashes)
            order, bounds = _by_part((h % np.uint64(parts)).astype(np.int64), parts)
            u, h = u[order], h[order]
            for p in range(parts):
                a, z = bounds[p], bounds[p + 1]
                if a < z:  # each text once, with its number of hashes
                    first = np.flatnonzero(np.concatenate([[True], u[a + 1 : z] != u[a : z - 1]]))
                    yield p, 0, _pack(u[a:z][first], np.diff(np.append(first, z - a)).astype(np.uint32), h[a:z])
        if meta:
            u, d, known, n, m1, m2 = (np.concatenate(x) for x in zip(*meta, strict=True))
            order, bounds = _by_part(_home(u, parts), parts)
            for p in range(parts):
                o = order[bounds[p] : bounds[p + 1]]
                if len(o):
                    yield p, 1, _pack(u[o], d[o], known[o], n[o], m1[o], m2[o])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uids, hashes, meta, held = [], [], [], 0
        for b in batches:
            uid = np.asarray(b.column("uid"))
            known = np.asarray(b.column("doc_id").is_valid()).astype(np.uint8)
            ids = np.asarray(b.column("doc_id").fill_null(0))
            for a, z, buf, off in text_chunks(b.column("text")):
                rows, h = shingles(buf, off, size)
                uids.append(uid[a:z][rows])
                hashes.append(h)
                raw = buf.tobytes()
                digest = np.frombuffer(b"".join(hashlib.md5(raw[x:y]).digest() for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)), np.int64).reshape(-1, 2)
                meta.append((uid[a:z], ids[a:z], known[a:z], np.bincount(rows, minlength=z - a).astype(np.int64), digest[:, 0], digest[:, 1]))
                held += len(h)
                if held >= FLUSH:
                    yield from _batched(flush(uids, hashes, meta))
                    uids, hashes, meta, held = [], [], [], 0
        yield from _batched(flush(uids, hashes, meta))

    return run


def _count(parts: int):
    """A bucket's hashes to those that two or more texts hold, with their counts, sent to the texts' parts (kind 2)."""

    def repeated(blobs: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        got = [_unpack(x, np.int64, np.uint32, np.uint64) for x in blobs]
        u = np.concatenate([np.repeat(x[0], x[1]) for x in got])
        h = np.concatenate([x[2] for x in got])
        got.clear()
        order = np.argsort(h)
        h = h[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(h)))
        keep = np.repeat(count >= 2, count)
        u, h, c = u[order][keep], h[keep], np.repeat(count, count)[keep].astype(np.uint32)
        order, bounds = _by_part(_home(u, parts), parts)
        for p in range(parts):
            o = order[bounds[p] : bounds[p + 1]]
            if len(o):  # each text once, with its number of hashes
                o = o[np.argsort(u[o], kind="stable")]
                first = np.flatnonzero(np.concatenate([[True], u[o[1:]] != u[o[:-1]]]))
                yield p, 2, _pack(u[o[first]], np.diff(np.append(first, len(o))), h[o], c[o])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = []
        for b in batches:
            kinds = b.column("kind").to_pylist()
            for kind, part, data in zip(kinds, b.column("part").to_pylist(), b.column("data"), strict=True):
                if kind == 0:
                    blobs.append(data.as_py())
                else:
                    yield _sent([(part, kind, data.as_py())])
        if blobs:
            yield from _batched(repeated(blobs))
            blobs.clear()
        trim()

    return run


def _sets(percent: int):
    """A part's texts with their repeating hashes; hashes are dropped where too few repeat for any link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meta, found = [], []
        for b in batches:
            for kind, data in zip(b.column("kind").to_pylist(), b.column("data"), strict=True):
                if kind == 1:
                    meta.append(_unpack(data.as_py(), np.int64, np.int64, np.uint8, np.int64, np.int64, np.int64))
                else:
                    one, size, *rest = _unpack(data.as_py(), np.int64, np.int64, np.uint64, np.uint32)
                    found.append((np.repeat(one, size), *rest))
        if not meta:
            return
        uid, ids, known, n, m1, m2 = (np.concatenate(x) for x in zip(*meta, strict=True))
        order = np.argsort(uid)
        uid, ids, known, n, digest = uid[order], ids[order], known[order], n[order], np.stack([m1[order], m2[order]], 1)
        if found:
            u, h, c = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
        else:
            u, h, c = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        row = np.searchsorted(uid, u)
        repeats = np.bincount(row, minlength=len(uid))
        alive = (repeats > 0) & (100 * repeats >= percent * n)
        keep = alive[row]
        row, h, c = row[keep], h[keep], c[keep]
        order = np.lexsort((h, row))
        row, h, c = row[order], h[order], c[order]
        bounds = np.searchsorted(row, np.arange(len(uid) + 1))
        for a in range(0, len(uid), 2000):
            z = min(a + 2000, len(uid))
            same, hashes, counts = [], [], []
            for i in range(a, z):
                if not alive[i]:
                    same.append(None), hashes.append(None), counts.append(None)
                    continue
                raw = h[bounds[i] : bounds[i + 1]].tobytes()
                # equal sets have no shingle of their own; other texts are a class of one
                whole = repeats[i] == n[i]
                same.append(hashlib.blake2b(raw if whole else struct.pack("<q", uid[i]), digest_size=16, person=b"set" if whole else b"row").digest())
                hashes.append(raw)
                counts.append(c[bounds[i] : bounds[i + 1]].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid[a:z]), pa.array(ids[a:z], mask=known[a:z] == 0), pa.array([x.tobytes() for x in digest[a:z]], pa.binary()), pa.array(n[a:z]), pa.array(repeats[a:z].astype(np.int64)), pa.array(same, pa.binary()), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())],
                names=["uid", "doc_id", "digest", "n", "repeats", "same", "hashes", "counts"],
            )
        trim()

    return run


def prefixes(h: np.ndarray, c: np.ndarray, n: int, percent: int) -> list[np.ndarray]:
    """The prefix under each global order: the first in that order, the others sorted by hash."""
    size = len(h) - -(-percent * n // 100) + 1
    orders = [np.lexsort((h, c)), np.lexsort((mix(h ^ np.uint64(0xA5A5A5A5)), np.log2(c).astype(int))), np.argsort(mix(h ^ np.uint64(0x3C3C3C3C3C)))]
    return [h[orders[0][:size]], *(np.sort(h[o[:size]]) for o in orders[1:])]


def parity_bits(h: np.ndarray) -> np.ndarray:
    """Whether an odd number of hashes falls on each of 512 bits, as 8 integers: two sets differ in as many hashes as bits at least."""
    return np.packbits(np.bincount((h >> np.uint64(55)).astype(np.int64), minlength=512) & 1).view(">i8").astype(np.int64)


def _prefixed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [[], [], [], [], []]
            for n, h, c in zip(b.column("n").to_pylist(), b.column("hashes"), b.column("counts"), strict=True):
                p = prefixes(np.frombuffer(h.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.uint32), n, percent)
                cols[0].append(p[0].view(np.int64))
                cols[1].append(p[1].tobytes())
                cols[2].append(p[2].tobytes())
                cols[3].append(len(h.as_buffer()) // 8)
                cols[4].append(parity_bits(np.frombuffer(h.as_buffer(), np.uint64)))
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("n"), b.column("hashes"), pa.array(cols[0], pa.list_(pa.int64())), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.list_(pa.int64()))], names=["uid", "n", "hashes", "p1", "p2", "p3", "r", "bits"])

    return run


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _pairs(b: pa.RecordBatch, keep: list[bool], names: list[str]) -> pa.RecordBatch:
    at = pa.array(np.flatnonzero(keep))
    return pa.RecordBatch.from_arrays([b.column(c).take(at) for c in names], names=names)


def _hashes(cell) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), np.uint64)


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose prefixes share a shingle under each other order."""
    for b in batches:
        keep = [_shared(_hashes(a2), _hashes(b2)) > 0 and _shared(_hashes(a3), _hashes(b3)) > 0 for a2, b2, a3, b3 in zip(*(b.column(k) for k in ("a2", "b2", "a3", "b3")), strict=True)]
        yield _pairs(b, keep, ["a", "b", "an", "bn"])
        trim()


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for ah, bh, an, bn in zip(b.column("ah"), b.column("bh"), b.column("an").to_pylist(), b.column("bn").to_pylist(), strict=True):
                both = _shared(_hashes(ah), _hashes(bh))
                keep.append(100 * both >= percent * (an + bn - both))
            yield _pairs(b, keep, ["a", "b"])
            trim()

    return run


def _near_enough(percent: int):
    """Whether sets of ar and br repeating hashes with bitmaps as and bs can share enough: they differ in as many hashes as bits at least."""
    differ = reduce(lambda x, y: x + y, (F.bit_count(F.col("as")[i].bitwiseXOR(F.col("bs")[i])) for i in range(8)))
    return (100 + percent) * (F.col("ar") + F.col("br") - differ) >= 2 * percent * (F.col("an") + F.col("bn"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of class ids that pass the bitmaps, then the other orders' prefixes, then the exact test; each travels only to what the one before leaves."""

    def side(x: str, **columns: str) -> DataFrame:
        return sets.select(F.col("uid").alias(x), *(F.col(c).alias(x + k) for k, c in columns.items()))

    few = pairs.join(side("b", n="n", r="r", s="bits"), "b").join(side("a", n="n", r="r", s="bits"), "a").where(_near_enough(percent)).select("a", "b", "an", "bn")
    two = {"2": "p2", "3": "p3"}
    few = few.join(side("b", **two), "b").join(side("a", **two), "a").mapInArrow(_agree, "a long, b long, an long, bn long")
    return few.join(side("b", h="hashes"), "b").join(side("a", h="hashes"), "a").mapInArrow(_verify(percent), "a long, b long")


def _band(percent: int) -> F.Column:
    """Number of a set size's band: sizes of linked sets lie in one band or in two that touch."""
    return F.floor(F.log(F.col("n")) / math.log(100 / percent)) if percent < 100 else F.col("n")


def link_classes(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts: uid, doc_id, digest, n, same; classes: same, uid of the representative; links between representatives a, b)."""
    parts = partitions(docs)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    sent = rows.mapInArrow(_split(parts, size), SHUFFLED).repartitionById(parts, F.col("part"))
    back = sent.mapInArrow(_count(parts), SHUFFLED).repartitionById(parts, F.col("part"))
    sets = stage(back.mapInArrow(_sets(percent), SETS), "shingle-sets")
    del sent, back
    release(docs.sparkSession)
    alive = sets.where("same is not null")
    classes = stage(alive.groupBy("same").agg(F.min("uid").alias("uid")), "classes")
    reps = stage(alive.join(classes.select("uid"), "uid").select("uid", "n", "hashes", "counts").mapInArrow(_prefixed(percent), "uid long, n long, hashes binary, p1 array<long>, p2 binary, p3 binary, r long, bits array<long>"), "prefixes")
    # left: this shingle and what repeats after it in the first order. Where two sets first meet at a shingle they share no more than the lesser left.
    index = reps.select("uid", "n", F.posexplode("p1").alias("at", "t"), "r").select("t", "uid", "n", (F.col("r") - F.col("at")).alias("left"))
    fits = (100 + percent) * F.least("al", "bl") >= percent * (F.col("an") + F.col("bn"))
    links, placed = [], index.withColumn("component", F.col("uid"))
    for turn in range(TURNS):
        # CENTRES rows of each shingle, the least under a hash of the row, so shingles of one group choose alike; cut before the shuffle
        order = Window.partitionBy("t").orderBy(F.xxhash64("uid", F.lit(turn)), "uid")
        some = placed.withColumn("rank_", F.row_number().over(order)).where(F.col("rank_") <= CENTRES)
        centres = stage(some.select("t", F.col("uid").alias("a"), F.col("n").alias("an"), F.col("left").alias("al"), F.col("component").alias("ac")), "centres")
        met = placed.select("t", F.col("uid").alias("b"), F.col("n").alias("bn"), F.col("left").alias("bl"), F.col("component").alias("bc")).join(centres, "t")
        star = met.where((F.col("ac") != F.col("bc")) & fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links.append(stage(verified(star, reps, percent), "links"))
        release(docs.sparkSession)
        near = components(reduce(DataFrame.unionByName, links)).select(F.col("node").alias("uid"), "component")
        known = index.join(near, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
        mixed = known.groupBy("t").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("t")
        placed = stage(known.join(mixed, "t"), "across")
        drop_staged(centres)
        if placed.isEmpty():  # no shingle joins two components
            return sets.select("uid", "doc_id", "digest", "n", "same"), classes, reduce(DataFrame.unionByName, links)
    marked = placed.join(reps.select("uid", "r", "bits"), "uid").withColumn("band", _band(percent))
    as_side = lambda x: marked.select("t", "band", *(F.col(c).alias(x + k) for c, k in (("uid", ""), ("n", "n"), ("left", "l"), ("component", "c"), ("r", "r"), ("bits", "s"))))
    beside = as_side("b").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    across = as_side("a").join(beside, ["t", "band"]).where((F.col("ac") < F.col("bc")) & fits & _near_enough(percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links.append(stage(verified(across, reps, percent), "links"))
    release(docs.sparkSession)
    return sets.select("uid", "doc_id", "digest", "n", "same"), classes, reduce(DataFrame.unionByName, links)


def near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """uid (a row's number here), doc_id, digest (md5 of the text), n_shingles, component_id (least doc_id of the component), keeper (one row of each component)."""
    texts, classes, links = link_classes(docs, size, percent, text, doc_id)
    near = components(links)
    known = texts.where("same is not null").groupBy("same").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first"))
    of = classes.join(near.withColumnRenamed("node", "uid"), "uid", "left").select("same", F.coalesce("component", "uid").alias("component"))
    of = stage(of.join(known, "same"), "class-components")
    least = of.groupBy("component").agg(F.min("first").alias("least"))
    place = stage(of.select("same", "component").join(least, "component").select("same", F.col("least.doc_id").alias("component_id"), F.col("least.uid").alias("keeper_uid")), "places")
    linked = texts.where("same is not null").join(place, "same").select("uid", "doc_id", "digest", F.col("n").alias("n_shingles"), "component_id", (F.col("uid") == F.col("keeper_uid")).alias("keeper"))
    alone = texts.where("same is null").select("uid", "doc_id", "digest", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("keeper"))
    return alone.unionByName(linked)


#: A text with a word; others are linked with nothing.
WORDED = r"[^\x20\x09-\x0D]"


def keep_one(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: its least doc_id (nulls last). Rows without words stay. Columns stay.

    A row is known by doc_id and text, so rows that repeat both are one; the
    first of them stays, taken before anything is shuffled by key.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    worded = docs.where(text.rlike(WORDED))
    found = near_duplicates(worded, size, percent).where("keeper").select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "digest")
    found = stage(found.distinct(), "kept")
    release(docs.sparkSession)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = worded.select(row.alias("row"), F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("digest"))
    once = rows.dropDuplicates(found.columns).join(found, found.columns, "left_semi")
    return docs.where(~text.rlike(WORDED)).unionByName(once.select(*(F.col(f"row.`{c}`") for c in docs.columns)))


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
