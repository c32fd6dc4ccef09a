"""Packing along a Hilbert curve.

Each document becomes token ids and a hashed vector (the mean of its ids'
pseudo-random signs) in few dimensions; the vector's cell gives a Hilbert
key. Documents are range-sorted by that key and laid end to end along the
curve; every SEQUENCE ids a new sequence begins, so neighbouring documents
share sequences and only the last sequence has room left.

Texts are tokenised once and written; only (row, key, length) is sorted. A
row's place on the curve is its partition's offset (one number a partition
reaches the driver) plus a running sum inside the partition. Ties of the key
go by row id, so a third of all rows with one key is split like any others.

Null or empty text: the end id alone; repeated rows are packed each; an empty
table has no pieces.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import mix, partitions, stage, table

SEQUENCE, END_ID = 2048, 1
DIMENSIONS, BITS, SPREAD = 4, 12, 8.0
#: Words whose ids a worker keeps; longer words are not kept.
CACHE_WORDS, CACHE_CHARS, KEPT_CHARS = 600_000, 64, 9
#: White space to Python but not to the tokenizer; texts with these are encoded whole.
_ODD = re.compile("[\x1c-\x1f]")
#: How the tokenizer splits lower-cased text.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
WORD_END = b"\xff"
#: Words with characters from here on go to the tokenizer itself: its tables of letters may be of another Unicode version.
OTHER_SCRIPTS = "\u0530"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """ids of whole texts by encoding each distinct word once: the tokenizer never joins across white space."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        vocab = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.piece = self._pieces(vocab)

    def _ids(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _pieces(self, vocab: dict[str, int]):
        """The same merges in a byte-pair coder that takes one piece at a time. A byte that UTF-8 never has stands for the end of a word; joining it to a letter comes before every merge, as in the vocabulary's order."""
        import tiktoken

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks, known = {bytes([b]): 1 << 20 | b for b in range(256)}, True
        for token, i in vocab.items():
            body = token.removesuffix("</w>")
            if all(c in byte_of for c in body) and body:
                ranks[bytes(byte_of[c] for c in body) + (WORD_END if token != body else b"")] = i
            elif not token.startswith("<|"):
                known = False
        if not known or len(ranks) < len(vocab) - 2 or len(set(ranks.values())) < len(ranks):
            return None
        return tiktoken.Encoding("words", pat_str=r".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def _encode_new(self, new: list[str]) -> dict[str, bytes]:
        """ids of each word: split as the tokenizer's own pattern splits it, and each piece coded alone."""
        odd, out, kind, piece = [], {}, "H" if self.dtype.itemsize == 2 else "I", self.piece
        if piece is None:
            odd = new
        for w in () if piece is None else new:
            if "<|" in w or not w.isascii() and max(w) >= OTHER_SCRIPTS:
                odd.append(w)
                continue
            v = w.lower() if w.isascii() else "".join(c.lower() for c in unicodedata.normalize("NFC", w))
            if v.isalpha():
                ids = piece(v.encode() + WORD_END)
            else:
                ids = [i for p in _PIECES.findall(v) for i in piece(p.encode() + WORD_END)]
            out[w] = array(kind, ids).tobytes()
        for w, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            out[w] = self._ids(e.ids)
        return out

    def encode(self, texts: list[str], end: int | None = END_ID) -> list[bytes]:
        split = [None if _ODD.search(t) else t.split() for t in texts]
        if len(self.known) > CACHE_WORDS:  # short words come again most often
            self.known = {w: x for w, x in self.known.items() if len(w) <= KEPT_CHARS}
            if len(self.known) > CACHE_WORDS // 2:
                self.known.clear()
        known, once = self.known, {}
        for w, x in self._encode_new([w for w in set(chain.from_iterable(words for words in split if words)) if w not in known]).items():
            (known if len(w) <= CACHE_CHARS else once)[w] = x
        get = known.__getitem__ if not once else lambda w: known[w] if w in known else once[w]
        tail = b"" if end is None else self._ids([end])
        return [(self._ids(self.tokenizer.encode(t, add_special_tokens=False).ids) if words is None else b"".join(map(get, words))) + tail for t, words in zip(texts, split, strict=True)]


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer cells (rows x dimensions), by the transpose method, all rows at once."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0]) ^ swap
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


_signs: dict[int, np.ndarray] = {}


def doc_cells(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Cells of documents from their concatenated ids: the mean of hashed signs, squeezed to BITS bits a dimension."""
    top = 1 << 16
    ids = ids if ids.itemsize == 2 else (ids % top).astype(np.uint16)
    if not _signs:
        h = mix(np.arange(top * DIMENSIONS, dtype=np.uint64) + np.uint64(77))
        _signs[0] = (h / 2.0**63 - 1.0).reshape(DIMENSIONS, top).astype(np.float32)
    owner = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    mean = np.stack([np.add.reduceat(_signs[0][i][ids], owner) for i in range(DIMENSIONS)], 1) / sizes[:, None]
    return np.clip((np.tanh(mean * SPREAD) + 1) * (1 << (BITS - 1)), 0, (1 << BITS) - 1).astype(np.int64)


_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """This worker's encoder: a worker runs many tasks, and the words of one help the next."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _tokenize(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                blobs = encoder.encode([t or "" for t in part.column("text").to_pylist()])
                sizes = np.array([len(x) // encoder.dtype.itemsize for x in blobs], np.int64)
                keys = hilbert_key(doc_cells(np.frombuffer(b"".join(blobs), encoder.dtype), sizes), BITS)
                yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("doc_id"), pa.array(keys), pa.array(sizes), pa.array(blobs, pa.binary())], names=["uid", "doc_id", "key", "n", "ids"])

    return run


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = 0
    for b in batches:
        n = np.asarray(b.column("n"))
        starts = total + np.cumsum(n) - n
        total += int(n.sum())
        yield pa.RecordBatch.from_arrays([b.column("pid"), b.column("uid"), pa.array(starts), b.column("n")], names=["pid", "uid", "inside", "n"])


def _cut(wide: bool):
    dtype = np.dtype("<u4" if wide else "<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, place, blob in zip(b.column("doc_id").to_pylist(), b.column("place").to_pylist(), b.column("ids"), strict=True):
                ids = np.frombuffer(blob.as_buffer(), dtype).astype("<u4")
                at = 0
                while at < len(ids):
                    seq, offset = divmod(place + at, SEQUENCE)
                    size = min(SEQUENCE - offset, len(ids) - at)
                    rows.append((doc, at, size, len(ids), seq, offset, ids[at : at + size].tobytes()))
                    at += size
            names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
            kinds = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=names)

    return run


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row a piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit)."""
    spark = docs.sparkSession
    path = path or tokenizer_path()
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = stage(rows.mapInArrow(_tokenize(path), "uid long, doc_id long, key long, n long, ids binary"), "tokens")
    curve = tokens.select("uid", "key", "n").repartitionByRange(partitions(docs), "key", "uid").sortWithinPartitions("key", "uid")
    order = stage(curve.select(F.spark_partition_id().alias("pid"), "uid", "n").mapInArrow(_running, "pid int, uid long, inside long, n long"), "curve")
    sums, before, at = order.groupBy("pid").agg(F.sum("n").alias("n")).orderBy("pid").collect(), [], 0
    for r in sums:  # one number for each partition
        before.append((r.pid, at))
        at += r.n
    offsets = spark.createDataFrame(before or [(-1, 0)], "pid int, ahead long")
    placed = order.join(F.broadcast(offsets), "pid").select("uid", (F.col("inside") + F.col("ahead")).alias("place"))
    wide = WordEncoder(path).dtype.itemsize == 4
    return tokens.select("uid", "doc_id", "ids").join(placed, "uid").select("doc_id", "place", "ids").mapInArrow(_cut(wide), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids (concatenated), used and padded length: SEQUENCE, or the used length where that is a power of two."""
    got = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("used"))
    power = F.col("used").bitwiseAND(F.col("used") - 1) == 0
    return got.select("sequence_id", F.aggregate("parts", F.expr("cast('' as binary)"), lambda a, p: F.concat(a, p["ids"])).alias("ids"), "used", F.when(power, F.col("used")).otherwise(F.lit(SEQUENCE)).alias("padded"))


def op5_pack(spark, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
