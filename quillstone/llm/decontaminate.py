"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are symbols: 64-bit hashes of the lower-cased bytes steer the search,
and the bytes themselves decide. Patterns are the windows of the benchmark's
items, one table for each pattern length m: a block of the last B words looks
up how far the search may jump; where the jump is 0, the block's hash picks a
bucket of patterns, the hash of the other words picks its members, and the
words of each are compared byte by byte. A pattern is a place in the items'
words, so no word is stored twice. All stretches of a batch advance together,
so a jump is one numpy operation over many cursors.

Patterns are bounded: items are cut into blocks of at most PATTERN_BYTES and
the documents are searched once for each block, whose hits are merged.

Null or empty texts and items have no words and no hits; an item of fewer
words than a window is one window; repeated items count by item id; no
benchmark rows: nothing is hit. Each document row, repeated ones too, gives
one row, however long its text; a table without rows gives none. Columns of
the input stay, but for search text and those named as a result (n_words,
n_hit, hit_runs, items) give way; clean keeps every column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import ALNUM, column, drop_staged, mix, others, stage, table, text_chunks, utf8_view, word_hashes, words

WINDOW = 10
#: Benchmark text that one set of tables is built from, at most.
PATTERN_BYTES = 8_000_000
#: Words of a stretch that one cursor searches.
STRETCH = 512
#: Pairs of a place and a pattern that are compared at once.
COMPARED = 200_000
_LOWER_BYTE = np.arange(256, dtype=np.uint8)
_LOWER_BYTE[65:91] += 32
_STEP = np.uint64(0x8CB92BA72F3D8DD7)


def _block(wh: np.ndarray, end: np.ndarray, b: int) -> np.ndarray:
    """Hash of the b words that end at each position."""
    h = np.zeros(len(end), np.uint64)
    for i in range(b - 1, -1, -1):
        h = h * _STEP + wh[end - i]
    return mix(h)


class Words:
    """The words of some texts: places in their bytes, hashes, and the row of each."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf = buf
        self.start, self.end, self.row = words(buf, off, ALNUM)
        self.hash = word_hashes(buf, self.start, self.end)
        self.count = np.bincount(self.row, minlength=len(off) - 1)
        self.begin = np.cumsum(self.count) - self.count

    def __len__(self) -> int:
        return len(self.start)


def equal_words(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether words i of a and j of b are the same but for the case of A-Z."""
    size = a.end[i] - a.start[i]
    same = size == b.end[j] - b.start[j]
    i, j, size = i[same], j[same], size[same]
    if len(i):
        first = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(first, size)
        differ = _LOWER_BYTE[a.buf[np.repeat(a.start[i], size) + step]] != _LOWER_BYTE[b.buf[np.repeat(b.start[j], size) + step]]
        same[same] = ~np.logical_or.reduceat(differ, first)
    return same


def equal_windows(a: Words, i: np.ndarray, b: Words, j: np.ndarray, m: int) -> np.ndarray:
    """Whether the m words from i of a and from j of b are the same."""
    left = np.arange(len(i))
    for k in range(m):
        left = left[equal_words(a, i[left] + k, b, j[left] + k)]
    out = np.zeros(len(i), bool)
    out[left] = True
    return out


class WuManber:
    """Shift and bucket tables for the windows of m of the items' words that begin at first; owners[i] is the item of window i."""

    def __init__(self, items: Words, first: np.ndarray, owners: np.ndarray, m: int):
        self.items, self.m, self.b = items, m, min(2, m)
        whole, last = _block(items.hash, first + m - 1, m), _block(items.hash, first + m - 1, self.b)
        # buckets by the last block; in one, members by the hash of all words and the item
        order = np.lexsort((owners, whole, last))
        first, owners, whole, last = first[order], owners[order], whole[order], last[order]
        twice = np.flatnonzero((whole[1:] == whole[:-1]) & (last[1:] == last[:-1]) & (owners[1:] == owners[:-1])) + 1
        keep = np.ones(len(first), bool)
        keep[twice[equal_windows(items, first[twice], items, first[twice - 1], m)]] = False
        self.first, self.owners, self.whole, self.suffix = first[keep], owners[keep], whole[keep], last[keep]
        bits = max(10, int(np.ceil(np.log2(max(len(self.first) * m, 2)))) + 3)
        self.mask = np.uint64((1 << min(bits, 24)) - 1)
        self.shift = np.full(int(self.mask) + 1, m - self.b + 1, np.uint8)
        for j in range(self.b - 1, m):
            np.minimum.at(self.shift, (_block(items.hash, self.first + j, self.b) & self.mask).astype(np.int64), np.uint8(m - 1 - j))

    def _members(self, suffix: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the members of each bucket that have the given hash."""
        ends = []
        for side in ("left", "right"):
            lo, hi = np.searchsorted(self.suffix, suffix, "left"), np.searchsorted(self.suffix, suffix, "right")
            while (more := np.flatnonzero(lo < hi)).size:
                mid = (lo[more] + hi[more]) // 2
                up = self.whole[mid] < whole[more] if side == "left" else self.whole[mid] <= whole[more]
                lo[more[up]], hi[more[~up]] = mid[up] + 1, mid[~up]
            ends.append(lo)
        return ends[0], ends[1]

    def search(self, docs: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, item) of each occurrence."""
        m, wh = self.m, docs.hash
        # cursors stand on the last word of a window; a stretch ends where the next begins or its row does
        pieces = -(-docs.count // STRETCH)
        row = np.repeat(np.arange(len(pieces)), pieces)
        begin = docs.begin[row] + (np.arange(len(row)) - (np.cumsum(pieces) - pieces)[row]) * STRETCH
        pos = begin + m - 1
        stop = np.minimum(begin + STRETCH + m - 1, (docs.begin + docs.count)[row])
        at, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        live = pos < stop
        pos, stop = pos[live], stop[live]
        while len(pos):
            block = _block(wh, pos, self.b)
            jump = self.shift[(block & self.mask).astype(np.int64)].astype(np.int64)
            zero = np.flatnonzero(jump == 0)
            if len(zero):
                lo, hi = self._members(block[zero], _block(wh, pos[zero], m))
                size = np.cumsum(hi - lo)
                a = 0
                while a < len(zero):  # direct comparison, some pairs at a time
                    z = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + COMPARED, "right")))
                    n = hi[a:z] - lo[a:z]
                    member = np.repeat(lo[a:z] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    place = np.repeat(pos[zero[a:z]] - m + 1, n)
                    same = equal_windows(docs, place, self.items, self.first[member], m)
                    at.append(place[same])
                    items.append(self.owners[member[same]])
                    a = z
            pos = pos + np.maximum(jump, 1)
            live = pos < stop
            pos, stop = pos[live], stop[live]
        return np.concatenate(at), np.concatenate(items)


def compile_items(texts: pa.Array, window: int = WINDOW) -> list[WuManber]:
    """Tables for each pattern length; owners are positions in texts."""
    items = Words(*utf8_view(texts))
    tables = []
    for m in range(1, window + 1):
        if m < window:
            owner = np.flatnonzero(items.count == m)
            first = items.begin[owner]
        else:
            runs = np.maximum(items.count - window + 1, 0)
            owner = np.repeat(np.arange(len(runs)), runs)
            first = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs) + items.begin[owner]
        if len(first):
            tables.append(WuManber(items, first, owner, m))
    return tables


def _searcher(tables: list[WuManber], names: list[str]):
    in_order = sorted(set(names))
    place = {n: i for i, n in enumerate(in_order)}
    sorted_rank = np.array([place[n] for n in names], int)  # an id that comes again is one item

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z, buf, off in text_chunks(batch.column("text")):
                n, w = z - a, Words(buf, off)
                delta = np.zeros(len(w) + 1, np.int64)
                hit_rows, hit_items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for t in tables:
                    at, items = t.search(w)
                    np.add.at(delta, at, 1)
                    np.add.at(delta, at + t.m, -1)
                    hit_rows.append(w.row[at])
                    hit_items.append(sorted_rank[items])
                hit = np.cumsum(delta)[:-1] > 0
                # maximal runs of hit words, in words and in bytes of the row
                edge = np.flatnonzero(hit)
                new = np.ones(len(edge), bool)
                new[1:] = (edge[1:] != edge[:-1] + 1) | (w.row[edge[1:]] != w.row[edge[:-1]])
                run_first = edge[new]
                run_last = edge[np.append(np.flatnonzero(new)[1:] - 1, len(edge) - 1)] if len(edge) else edge
                run_row = w.row[run_first]
                lists = np.concatenate([[0], np.cumsum(np.bincount(run_row, minlength=n))]).astype(np.int32)
                spans = pa.StructArray.from_arrays(
                    [pa.array(run_first - w.begin[run_row]), pa.array(run_last + 1 - w.begin[run_row]), pa.array(w.start[run_first] - off[run_row]), pa.array(w.end[run_last] - off[run_row])],
                    names=["first_word", "end_word", "first_byte", "end_byte"],
                )
                pairs = np.unique(np.stack([np.concatenate(hit_rows), np.concatenate(hit_items)], 1), axis=0)
                item_lists = np.concatenate([[0], np.cumsum(np.bincount(pairs[:, 0], minlength=n))]).astype(np.int32)
                item_values = pa.array([in_order[r] for r in pairs[:, 1].tolist()], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(a, n) for c, k in zip(batch.columns, batch.schema.names, strict=True) if k != "text"), pa.array(w.count.astype(np.int64)), pa.array(np.bincount(w.row, weights=hit, minlength=n).astype(np.int64)), pa.ListArray.from_arrays(lists, spans), pa.ListArray.from_arrays(item_lists, item_values)],
                    names=[*(k for k in batch.schema.names if k != "text"), "n_words", "n_hit", "hit_runs", "items"],
                )

    return run


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, limit: int = PATTERN_BYTES) -> DataFrame:
    """The rows of docs without a hit; columns stay. Blocks of patterns are filters one after another."""

    def without(tables: list[WuManber]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for a, z, buf, off in text_chunks(b.column("text")):
                    w = Words(buf, off)
                    fine = np.ones(z - a, bool)
                    for t in tables:
                        fine[w.row[t.search(w)[0]]] = False
                    yield b.slice(a, z - a).filter(pa.array(fine))

        return run

    for _, texts in benchmark_blocks(items, limit):
        docs = docs.mapInArrow(without(compile_items(texts, window)), docs.schema)
    return docs


HIT_RUNS = "array<struct<first_word:long,end_word:long,first_byte:long,end_byte:long>>"


def benchmark_blocks(items: DataFrame, limit: int = PATTERN_BYTES) -> Iterator[tuple[list[str], pa.Array]]:
    """(item ids, texts) in blocks whose size is checked before any is fetched."""
    b = items.select(F.coalesce(column(items, "item_id", "string"), F.lit("")).alias("item_id"), F.coalesce(column(items, "text", "string"), F.lit("")).alias("text")).distinct()
    total = b.agg(F.sum(F.octet_length("text") + F.octet_length("item_id") + 16)).first()[0] or 0
    n = max(1, -(-int(total) * 2 // limit)) if total > limit else 1
    for i in range(n):
        part = b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else b
        t = part.toArrow()
        yield t["item_id"].to_pylist(), t["text"].combine_chunks()


def search(docs: DataFrame, items: DataFrame, window: int = WINDOW, limit: int = PATTERN_BYTES) -> DataFrame:
    """docs without text, plus n_words, n_hit, hit_runs (words and bytes of the text) and items (sorted item ids)."""
    keep = others(docs, "text", "n_words", "n_hit", "hit_runs", "items")
    row = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.struct(F.lit(0).alias("none"))
    told = docs.select(row.alias("row"), F.monotonically_increasing_id().alias("number"), "text")
    kind = f"row {told.schema['row'].dataType.simpleString()}, number long, n_words long, n_hit long, hit_runs {HIT_RUNS}, items array<string>"
    blocks = benchmark_blocks(items, limit)
    (names, texts), more = next(blocks), next(blocks, None)
    if more is not None:
        told = stage(told, "searched")
    found = told.mapInArrow(_searcher(compile_items(texts, window), names), kind)
    while more is not None:
        names, texts = more
        other = told.mapInArrow(_searcher(compile_items(texts, window), names), kind).select("number", F.col("hit_runs").alias("runs2"), F.col("items").alias("items2"))
        merged = found.join(other, "number").withColumn("items", F.sort_array(F.array_union("items", "items2"))).withColumn("hit_runs", _merged(F.sort_array(F.concat("hit_runs", "runs2"))))
        before, found = found, stage(merged.withColumn("n_hit", F.aggregate("hit_runs", F.lit(0).cast("long"), lambda n, r: n + r["end_word"] - r["first_word"])).drop("runs2", "items2"), "hits")
        drop_staged(before)
        more = next(blocks, None)
    return found.select(*(F.col(f"row.`{c}`") for c in keep), "n_words", "n_hit", "hit_runs", "items")


def _merged(runs):
    """Sorted runs with overlapping or touching ones joined."""
    empty = F.expr(f"cast(array() as {HIT_RUNS})")

    def put(acc, r):
        last = F.element_at(acc, -1)
        joined = F.struct(last["first_word"].alias("first_word"), F.greatest(last["end_word"], r["end_word"]).alias("end_word"), last["first_byte"].alias("first_byte"), F.greatest(last["end_byte"], r["end_byte"]).alias("end_byte"))
        touching = (F.size(acc) > 0) & F.coalesce(F.when(F.size(acc) > 0, r["first_word"] <= last["end_word"]), F.lit(False))
        return F.when(touching, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(runs, empty, put)


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
pat AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS m, list_slice(w, i, i + least(len(w), {WINDOW}) - 1) AS p
  FROM b, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS r(i) WHERE len(w) > 0
),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (
  SELECT doc_id, m, i, list_slice(w, i, i + m - 1) AS p
  FROM d, (SELECT DISTINCT m FROM pat), unnest(range(1, len(w) - m + 2)) AS r(i)
),
occ AS (SELECT win.doc_id, win.i, win.m, pat.item_id FROM win JOIN pat USING (m, p)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM occ, unnest(range(i, i + m)) AS r(j) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
