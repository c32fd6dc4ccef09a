"""Report sinks: flat CSV tables, nested JSON, atomic files."""

from __future__ import annotations

import json
import os
import re
import uuid
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Column lists of the flat exports.
EXPORTS = {
    "leg_flags": ["leg_key", "entry_id", "leg_num", "date", "account", "amount", "signal_count", "severity", "reasons"],
    "gap_flags": ["vch_type", "missing_count", "first_missing", "last_missing", "group_size", "severity", "missing_numbers"],
    "trial_balance_flags": ["account", "side", "tb_amount", "gl_amount", "mismatch", "severity"],
    "ml_flags": ["entry_id", "leg_num", "account", "amount", "date", "dr_cr", "severity", "anomaly_score", "anomaly_rank_pct"],
    "tax_flags": ["deductor_name", "claimed", "reported", "mismatch", "severity"],
}
PROTECTED = ("data/raw",)


def flat(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that are there, arrays joined by '; '."""
    out = []
    for c in columns:
        if c in df.columns:
            kind = df.schema[c].dataType.simpleString()
            if kind.startswith("array<struct"):
                out.append(F.array_join(F.transform(c, lambda x: x["reason"]), "; ").alias(c))
            elif kind.startswith("array"):
                out.append(F.array_join(F.col(c).cast("array<string>"), "; ").alias(c))
            else:
                out.append(F.col(c))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, export: str, label: str | None = None) -> str:
    """Write an export as CSV; a label keeps reports of several ledgers apart."""
    target = f"{path}/{export}" + (f"_{label.replace(' ', '_')}" if label else "")
    flat(df, EXPORTS[export]).write.mode("overwrite").csv(target, header=True)
    return target


def write_json(report: dict, path: str) -> None:
    """Whole or not at all: written beside the target and moved over it. A frame becomes the list of all its rows, of which one partition at a time is here."""
    guard(path)
    temp = f"{path}.{uuid.uuid4().hex}"
    try:
        with open(temp, "w") as f:
            f.write("{")
            for i, (name, value) in enumerate(report.items()):
                f.write(f"{',' if i else ''}\n {json.dumps(name)}: ")
                if isinstance(value, DataFrame):
                    f.write("[")
                    for j, row in enumerate(value.toLocalIterator()):
                        f.write(f"{',' if j else ''}\n  {json.dumps(row.asDict(recursive=True), default=str)}")
                    f.write("\n ]")
                else:
                    f.write(json.dumps(value, default=str, indent=1))
            f.write("\n}")
        os.replace(temp, path)
    finally:
        Path(temp).unlink(missing_ok=True)


def guard(path: str, protected: tuple[str, ...] = PROTECTED) -> None:
    """Refuse to write under protected folders."""
    if any(f"/{p}/" in f"/{os.path.abspath(path)}/" for p in protected):
        raise PermissionError(f"{path} is protected")


def save_upload(folder: str, name: str, data: bytes, protected: frozenset[str] = frozenset()) -> tuple[str, str]:
    """(path, saved | replaced | saved_alongside) of an uploaded PDF; a protected name is never overwritten."""
    name = os.path.basename(name.replace("\\", "/"))
    if not re.fullmatch(r"(?i).+\.pdf", name):
        raise ValueError("only PDF files are taken")
    target, how, k = Path(folder, name), "saved", 2
    if name in protected:
        how = "saved_alongside"
        while target.exists() or target.name in protected:
            target, k = Path(folder, f"{name[:-4]}_{k}.pdf"), k + 1
    elif target.exists():
        how = "replaced"
    temp = target.with_name(f"{target.name}.{uuid.uuid4().hex}")
    temp.write_bytes(data)
    os.replace(temp, target)
    return str(target), how
