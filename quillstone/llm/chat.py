"""Chat formatting by columnar byte assembly.

Template, per turn:  <|ROLE|>\\n TEXT <|end|>\\n
A backslash goes before the backslash itself and into every control string
inside a text or role (<|, <s>, </s>, [INST], [/INST], <<SYS>>, <</SYS>>), so
that no text can open or close a turn; dropping each escaping backslash gives
the text back.

Each batch of whole conversations becomes one preallocated buffer: segment
lengths are summed to destination offsets, and one gather with scattered
indices copies headers and contents into it. Memory follows a batch and the
longest conversation, not the table.

Defined cases: rows by turn (null last), ties by role, then text; repeated
rows are turns of their own; null text or role: empty; null conv_id: one
conversation of its own; no rows: no conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import partitions, table, utf8_view

#: (control string, how it stands inside a text); the backslash comes first.
ESCAPES = [("\\", "\\\\"), ("<|", "<\\|"), ("<s>", "<\\s>"), ("</s>", "<\\/s>"), ("[INST]", "[\\INST]"), ("[/INST]", "[\\/INST]"), ("<<SYS>>", "<\\<SYS>>"), ("<</SYS>>", "<\\</SYS>>")]
HEAD, HEAD_END, END = "<|", "|>\n", "<|end|>\n"
ASSISTANT = "assistant"
#: Bytes that one gather copies at once; a longer segment is copied as a slice.
GATHER_BYTES = 4_000_000
TYPE = "conv_id long, n_turns long, formatted string, loss_starts array<long>, loss_ends array<long>"
_TURN = re.compile(r"<\|((?:[^<|\\]|\\.|<(?!\|)|\|(?!>))*)\|>\n((?:[^<\\]++|\\.|<(?!\|))*+)<\|end\|>\n", re.S)


def escape(col):
    for plain, inside in ESCAPES:
        col = pc.replace_substring(col, plain, inside)
    return col


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def gather(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The pool's segments one after another, in one preallocated buffer."""
    dest = np.cumsum(length) - length
    out = np.empty(int(length.sum()), np.uint8)
    a, n = 0, len(length)
    while a < n:
        b = max(a + 1, int(np.searchsorted(dest, dest[a] + GATHER_BYTES, "right")) - 1)
        if b == a + 1:
            out[dest[a] : dest[a] + length[a]] = pool[start[a] : start[a] + length[a]]
        else:
            size = int(length[a:b].sum())
            index = np.repeat(start[a:b] - (dest[a:b] - dest[a]), length[a:b]) + np.arange(size)
            out[dest[a] : dest[a] + size] = pool[index]
        a = b
    return out


def assemble(rows: pa.Table) -> pa.RecordBatch:
    """One row a conversation from rows that are sorted by conversation and turn."""
    conv = rows["conv_id"].combine_chunks()
    role = pc.fill_null(rows["role"].combine_chunks(), "")
    is_loss = np.asarray(pc.equal(role, ASSISTANT))
    (rb, ro), (tb, to) = utf8_view(escape(role)), utf8_view(escape(pc.fill_null(rows["text"].combine_chunks(), "")))
    fixed = (HEAD + HEAD_END + END).encode()
    pool = np.concatenate([np.frombuffer(fixed, np.uint8), rb, tb])
    at_role, at_text = len(fixed), len(fixed) + len(rb)
    n, h, he = len(conv), len(HEAD), len(HEAD_END)
    start, length = np.empty((n, 5), np.int64), np.empty((n, 5), np.int64)
    start[:, 0], length[:, 0] = 0, h
    start[:, 1], length[:, 1] = at_role + ro[:-1], np.diff(ro)
    start[:, 2], length[:, 2] = h, he
    start[:, 3], length[:, 3] = at_text + to[:-1], np.diff(to)
    start[:, 4], length[:, 4] = h + he, len(END)
    out = gather(pool, start.ravel(), length.ravel())
    dest = np.concatenate([[0], np.cumsum(length.ravel())])
    null = np.asarray(conv.is_null())
    ids = np.asarray(pc.fill_null(conv, 0))
    first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])]))
    bounds = np.append(first, n)
    offsets = dest[bounds * 5]
    text = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)])
    loss = np.flatnonzero(is_loss)
    owner = np.searchsorted(bounds, loss, "right") - 1
    base = offsets[owner]
    lists = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(first)))]).astype(np.int32)
    listed = lambda k: pa.ListArray.from_arrays(lists, pa.array(dest[loss * 5 + k] - base, pa.int64()))
    return pa.RecordBatch.from_arrays(
        [conv.take(pa.array(first)), pa.array(np.diff(bounds), pa.int64()), text.cast(pa.string()), listed(3), listed(4)],
        names=["conv_id", "n_turns", "formatted", "loss_starts", "loss_ends"],
    )


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: list[pa.RecordBatch] = []  # the last conversation may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(0)
        last = conv[-1].as_py()
        same = pc.is_null(conv) if last is None else pc.fill_null(pc.equal(conv, last), False)
        cut = int(np.flatnonzero(~np.asarray(same))[-1]) + 1 if not pc.all(same).as_py() else 0
        if cut or (kept and kept[-1].column(0)[-1].as_py() != last):
            done = pa.Table.from_batches([*kept, batch.slice(0, cut)])
            kept = []
            yield assemble(done)
        kept.append(batch.slice(cut))
    if kept:
        yield assemble(pa.Table.from_batches(kept))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, and loss_starts/loss_ends: byte ranges of the assistant texts in formatted."""
    cols = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    dealt = cols.repartition(partitions(rows), "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    return dealt.select("conv_id", "role", "text").mapInArrow(_format, TYPE)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation, unescaped."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for conv, text, starts, ends in zip(*(b.column(k).to_pylist() for k in ("conv_id", "formatted", "loss_starts", "loss_ends")), strict=True):
            turns, raw = parse(text), text.encode()
            loss = "".join(unescape(raw[s:e].decode()) for s, e in zip(starts, ends, strict=True))
            whole = "".join(f"{r}\n{t}\n" for r, t in turns)
            out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 6, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what parsing the formatted conversations gives."""
    return formatted.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return read_back(format_conversations(rows.unionByName(probe)))


def _sql_escaped(col: str) -> str:
    for plain, inside in ESCAPES:
        col = f"replace({col}, '{plain}', '{inside}')"
    return col


OP3_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS LAST, role, text), '')) AS loss_sha256,
  CAST(sum({len(HEAD + HEAD_END + END)} + length({_sql_escaped('role')}) + length({_sql_escaped('text')})) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
