"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words; only the bag has a label.
Each passage is encoded (style measures and the mean log-odds of its words'
hashes, through one hidden layer); gated attention weighs the passages; the
weighted passage representation gives the score. The encoder, the attention
and the head are trained together from document labels.

Training takes at most SAMPLE_DOCS labelled documents of any length, chosen by
hash among those whose crc32(doc_id) mod 5 is not 0; of a text with more than
SAMPLE_PASSAGES passages as many, evenly spread over the whole of it, are
learned from. Both bounds are parameters. Every whole text is scored. Inputs
are the text alone.

Null or empty text: a bag of one empty passage. Repeated rows score alike.
Several labels of one document: the largest; null labels are left out. With
no usable labels every score is 0.5. A table without rows gives none. Columns
of the input stay, but for score text and those named as a result (score,
passage_weights) give way; accepted keeps every column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import BYTE_HASH, NOT_SPACE, byte_class, others, table, text_chunks, word_hashes, words

PASSAGE = 64
SAMPLE_DOCS, SAMPLE_PASSAGES = 3_000, 200
THRESHOLD = 0.3
BUCKETS, HIDDEN, ATTENTION = 1 << 16, 16, 8
_CLASSES = [byte_class((0x30, 0x39)), byte_class((0x41, 0x5A)), byte_class((0x61, 0x7A)), byte_class((0x80, 0xFF)), byte_class((0x2E, 0x2E), (0x2C, 0x2C), (0x21, 0x21), (0x3F, 0x3F)), byte_class((0x23, 0x26), (0x2A, 0x2B), (0x3D, 0x3D), (0x40, 0x40), (0x5E, 0x60), (0x7E, 0x7E)), byte_class((0x7C, 0x7C)), byte_class((0x3C, 0x3C), (0x3E, 0x3E), (0x5B, 0x5D), (0x7B, 0x7B), (0x7D, 0x7D))]
#: Class number of each byte, 0 for none.
_CLASS_OF = np.zeros(256, np.uint8)
for _i, _lut in enumerate(_CLASSES, 1):
    _CLASS_OF[_lut] = _i
STYLE = len(_CLASSES) + 7


def passages(buf: np.ndarray, off: np.ndarray, odds: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(measures, document of each passage, bucket of each word, passage of each word); a document without words has one empty passage."""
    n = len(off) - 1
    s, e, rows = words(buf, off, NOT_SPACE)
    wh = word_hashes(buf, s, e, BYTE_HASH)
    count = np.bincount(rows, minlength=n)
    per = np.maximum(1, -(-count // PASSAGE))
    first = np.cumsum(per) - per
    doc_of = np.repeat(np.arange(n), per)
    inside = np.arange(len(wh)) - (np.cumsum(count) - count)[rows]
    of = first[rows] + inside // PASSAGE
    m = int(per.sum())
    size = np.bincount(of, minlength=m)
    safe = np.maximum(size, 1)
    chars = np.bincount(of, weights=e - s, minlength=m)
    same = np.zeros(len(wh), bool)
    same[1:] = (wh[1:] == wh[:-1]) & (of[1:] == of[:-1])
    two = np.zeros(len(wh), bool)
    two[2:] = (wh[2:] == wh[:-2]) & (of[2:] == of[:-2])
    order = np.lexsort((wh, of))
    fresh = np.ones(len(wh), bool)
    fresh[1:] = (wh[order][1:] != wh[order][:-1]) | (of[order][1:] != of[order][:-1])
    x = np.zeros((m, STYLE + 1))
    if len(s):
        held = np.repeat(of, e - s)  # the passage of each byte that belongs to a word
        at = np.arange(len(held)) + np.repeat(s - (np.cumsum(e - s) - (e - s)), e - s)
        by_class = np.bincount(held * (len(_CLASSES) + 1) + _CLASS_OF[buf[at]], minlength=m * (len(_CLASSES) + 1)).reshape(m, -1)
        x[:, : len(_CLASSES)] = by_class[:, 1:] / np.maximum(chars, 1)[:, None]
    k = len(_CLASSES)
    x[:, k] = chars / safe / 10
    x[:, k + 1] = np.bincount(of, weights=same, minlength=m) / safe
    x[:, k + 2] = np.bincount(of, weights=two, minlength=m) / safe
    x[:, k + 3] = np.bincount(of[order], weights=fresh, minlength=m) / safe
    x[:, k + 4] = size / PASSAGE
    x[:, k + 5] = (np.log1p(count) / 10)[doc_of]
    x[:, k + 6] = np.sqrt(np.bincount(of, weights=(e - s) ** 2.0, minlength=m) / safe) / 20
    bucket = (wh % np.uint64(BUCKETS)).astype(np.int64)
    if odds is not None:
        x[:, k + 7] = np.bincount(of, weights=odds[bucket], minlength=m) / safe
    return x, doc_of, bucket, of


class Model:
    """odds: log-odds of each word bucket; the rest: centre, scale and weights of the network."""

    def __init__(self, odds, centre, scale, w):
        self.odds, self.centre, self.scale, self.w = odds, centre, scale, w

    @staticmethod
    def forward(w, x, doc_of, n):
        h = np.tanh(x @ w["enc"] + w["enc_b"])
        g, s = np.tanh(h @ w["att_v"]), 1 / (1 + np.exp(-(h @ w["att_u"])))
        a = (g * s) @ w["att_w"]
        start = np.searchsorted(doc_of, np.arange(n))
        a = np.exp(a - np.maximum.reduceat(a, start)[doc_of])
        a /= np.add.reduceat(a, start)[doc_of]
        z = np.add.reduceat(a[:, None] * h, start, axis=0)
        return h, g, s, a, z, z @ w["out"] + w["out_b"], start

    def score(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score of each document, attention of each passage, document of each passage)."""
        n = len(off) - 1
        if not n:
            return np.zeros(0), np.zeros(0), np.zeros(0, int)
        x, doc_of, _, _ = passages(buf, off, self.odds)
        x = (x - self.centre) / self.scale
        *_, a, _, logit, _ = self.forward(self.w, x, doc_of, n)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30))), a, doc_of


def fit(texts: list[str], labels: list[int], epochs: int = 120, rate: float = 0.05, l2: float = 1e-4) -> Model:
    y = np.array(labels, float)
    zero = {"enc": np.zeros((STYLE + 1, HIDDEN)), "enc_b": np.zeros(HIDDEN), "att_v": np.zeros((HIDDEN, ATTENTION)), "att_u": np.zeros((HIDDEN, ATTENTION)), "att_w": np.zeros(ATTENTION), "out": np.zeros(HIDDEN), "out_b": np.zeros(())}
    if not len(y) or y.min() == y.max():
        if len(y):
            zero["out_b"] = np.array(3.0 if y[0] else -3.0)
        return Model(np.zeros(BUCKETS), np.zeros(STYLE + 1), np.ones(STYLE + 1), zero)
    arr = pa.array(texts, pa.large_string())
    parts = [(a, *passages(buf, off, None)) for a, _, buf, off in text_chunks(arr)]
    # words: smoothed log-odds over documents that hold them
    seen = np.zeros((2, BUCKETS))
    for a, _, doc_of, bucket, of in parts:
        pairs = np.unique((doc_of[of] + a) * BUCKETS + bucket)
        np.add.at(seen, (y[pairs // BUCKETS].astype(int), pairs % BUCKETS), 1)
    n1, n0 = y.sum(), len(y) - y.sum()
    odds = np.log((seen[1] + 3 * n1 / len(y)) / n1) - np.log((seen[0] + 3 * n0 / len(y)) / n0)
    xs, docs = [], []
    for a, x, doc_of, bucket, of in parts:
        size = np.maximum(np.bincount(of, minlength=len(x)), 1)
        # a training document's own words are left out of its odds
        own = np.zeros(len(bucket))
        if len(bucket):
            lab = y[doc_of[of] + a]
            s1, s0 = seen[1][bucket] - (lab == 1), seen[0][bucket] - (lab == 0)
            own = np.log((s1 + 3 * n1 / len(y)) / n1) - np.log((s0 + 3 * n0 / len(y)) / n0)
        x[:, STYLE] = np.bincount(of, weights=own, minlength=len(x)) / size
        xs.append(x)
        docs.append(doc_of + a)
    x, doc_of = np.concatenate(xs), np.concatenate(docs)
    centre, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - centre) / scale
    rng = np.random.default_rng(7)
    w = {k: v if v.ndim == 0 else rng.normal(0, 0.3, v.shape) for k, v in zero.items()}
    first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    for t in range(1, epochs + 1):
        h, g, s, a, z, logit, start = Model.forward(w, x, doc_of, len(y))
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        d_logit = (p - y) / len(y)
        d_z = d_logit[:, None] * w["out"]
        d_a = (d_z[doc_of] * h).sum(1)
        d_att = a * (d_a - np.add.reduceat(a * d_a, start)[doc_of])
        d_gate = d_att[:, None] * w["att_w"]
        d_g, d_s = d_gate * s * (1 - g**2), d_gate * g * s * (1 - s)
        d_h = a[:, None] * d_z[doc_of] + d_g @ w["att_v"].T + d_s @ w["att_u"].T
        d_pre = d_h * (1 - h**2)
        grad = {"enc": x.T @ d_pre, "enc_b": d_pre.sum(0), "att_v": h.T @ d_g, "att_u": h.T @ d_s, "att_w": (g * s).T @ d_att, "out": z.T @ d_logit, "out_b": d_logit.sum()}
        for k in w:
            gk = grad[k] + l2 * w[k]
            first[k] = 0.9 * first[k] + 0.1 * gk
            second[k] = 0.999 * second[k] + 0.001 * gk * gk
            w[k] = w[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return Model(odds, centre, scale, w)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def _spread(most: int):
    """Texts with at most `most` passages, evenly spread where there are more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for _, _, buf, off in text_chunks(b.column("text")):
                s, e, rows = words(buf, off, NOT_SPACE)
                count = np.bincount(rows, minlength=len(off) - 1)
                for first, n, x, y in zip((np.cumsum(count) - count).tolist(), count.tolist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                    if n <= most * PASSAGE:
                        out.append(buf[x:y].tobytes())
                        continue
                    begin = first + np.linspace(0, -(-n // PASSAGE) - 1, most).astype(int) * PASSAGE
                    out.append(b" ".join(buf[s[i] : e[min(i + PASSAGE, first + n) - 1]].tobytes() for i in begin.tolist()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id_"), b.column("quality_"), pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id_", "quality_", "text"])

    return run


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS, most_passages: int = SAMPLE_PASSAGES) -> Model:
    """A model from at most `most` labelled documents that are not held out."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    picked = usable.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality_")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    ids = docs.sparkSession.createDataFrame([tuple(r) for r in picked.collect()], "doc_id_ long, quality_ int")  # at most `most` rows
    texts = docs.select(F.col("doc_id").alias("doc_id_"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id_").select("doc_id_", "quality_", "text")
    texts = texts.mapInArrow(_spread(most_passages), "doc_id_ long, quality_ int, text string")
    rows = sorted(texts.groupBy("doc_id_").agg(F.min(F.struct("text", "quality_")).alias("x")).select("doc_id_", "x.*").collect())
    return fit([r.text for r in rows], [r.quality_ for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs without text, plus score and passage_weights (the attention of each passage)."""
    keep = others(docs, "text", "score", "passage_weights")
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, buf, off in text_chunks(b.column("text")):
                p, weights, doc_of = model.score(buf, off)
                lists = np.concatenate([[0], np.cumsum(np.bincount(doc_of, minlength=z - a))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(a, z - a) for c in keep), pa.array(p), pa.ListArray.from_arrays(lists, pa.array(weights.astype(np.float32)))], names=[*keep, "score", "passage_weights"])

    return docs.select(*(F.col(f"`{c}`") for c in (*keep, "text"))).mapInArrow(run, ", ".join([*fields, "score double", "passage_weights array<float>"]))


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches threshold; columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, buf, off in text_chunks(b.column("text")):
                yield b.slice(a, z - a).filter(pa.array(model.score(buf, off)[0] >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
