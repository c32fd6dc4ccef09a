"""Reports put together from the rules, steps that fail alone, a single-worker job queue."""

from __future__ import annotations

import datetime as dt
import threading
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import exprs as X
from quillstone.operators import anomaly
from quillstone.operators import reconstruct as V
from quillstone.operators import rules as R


def ledger_report(legs: DataFrame, label: str, keys: list | None = None) -> tuple[dict, dict[str, DataFrame]]:
    """(report, tables) of a ledger: flags of the leg rules together, gaps, first digits, anomalies; the report holds small aggregates, and all leg flags as a sorted frame that sinks.write_json streams."""
    keys = keys or [F.trim("date_raw") if "date_raw" in legs.columns else F.col("date"), F.trim("account"), F.col("amount"), F.col("dr_cr")]
    flags = R.converge(legs, [R.segregation(legs), R.round_amounts(legs), R.duplicates(legs, keys)])
    vouchers = legs.withColumns({"prefix": X.voucher_prefix("vch_no"), "number": X.voucher_number("vch_no")}).where("vch_type is not null and number is not null")
    gaps = R.sequence_gaps(vouchers, ["vch_type", "prefix"]) if "row_idx" in legs.columns else None
    benford = R.benford(legs).first()
    counts = {r.severity: r["count"] for r in flags.groupBy("severity").count().collect()}
    one = flags.agg(F.count("*").alias("n"), F.count_if(F.col("signal_count") > 1).alias("multi")).first()
    report = {
        "generated_at": dt.datetime.now(dt.timezone.utc).isoformat(),
        "dataset": {"total_legs": legs.count(), "report_label": label},
        "benford": None if benford is None else {**benford.asDict(), "mad_conformity": _band(benford.mad)},
        "summary": {"total_legs_flagged": one.n, "multi_signal": one.multi, "single_signal": one.n - one.multi, "by_severity": {s: counts.get(s, 0) for s in X.SEVERITIES[1:]}},
        "ledger_leg_flags": flags.orderBy(F.col("signal_count").desc(), X.rank_of("severity").desc(), "entry_id", "leg_num"),
    }
    tables = {"leg_flags": flags}
    if gaps is not None:
        tables["gap_flags"] = gaps
    return report, tables


def _band(mad: float) -> str:
    return "Close conformity" if mad < 0.006 else "Acceptable conformity" if mad < 0.012 else "Marginally acceptable" if mad < 0.015 else "Nonconformity"


def anomaly_report(legs: DataFrame) -> DataFrame:
    return anomaly.flags(anomaly.features(legs))


def confidence(stats: dict, least_vouchers: int = 20, unresolved: float = 10.0, unbalanced: float = 1.0) -> tuple[str, list[str]]:
    """low with its reasons, or ok, from counts of vouchers, legs, unresolved lines and unbalanced vouchers."""
    reasons = []
    if stats["vouchers"] < least_vouchers:
        reasons.append(f"only {stats['vouchers']} vouchers")
    if stats["legs"] and 100 * stats["unresolved"] / stats["legs"] > unresolved:
        reasons.append(f"{stats['unresolved']} unresolved lines")
    if stats["vouchers"] and 100 * stats["unbalanced"] / stats["vouchers"] > unbalanced:
        reasons.append(f"{stats['unbalanced']} unbalanced vouchers")
    return ("low" if reasons else "ok"), reasons


def drifted(stats: dict, known_unbalanced: int | None) -> bool:
    """Whether a ledger has another number of unbalanced vouchers than was found and looked into before; not an error, but worth a look."""
    return known_unbalanced is not None and stats["unbalanced"] != known_unbalanced


def canonical(parts: dict[str, DataFrame], label: str) -> DataFrame:
    """Reconstructed legs in the columns of a ledger, with day, vouchers' type and number and whether they balance."""
    legs = parts["legs"].join(V.balances(parts["legs"]), "entry_id")
    cut = F.split("entry_id", "_")
    return legs.select(
        F.lit(label).alias("ledger_id"), "entry_id", F.col("particulars").alias("account"), "dr_cr", F.col("amount").cast("decimal(18,2)").alias("amount"), X.any_date(F.col("first_date")).alias("date"),
        cut[0].alias("vch_type"), cut[1].alias("vch_no"), F.lit(None).cast("string").alias("entered_by"), F.lit(None).cast("string").alias("approved_by"), "source_pages", "corroboration_count", F.col("balanced").alias("entry_balanced"),
    ).withColumn("leg_num", F.row_number().over(Window.partitionBy("entry_id").orderBy("account", "dr_cr", "amount")))


def process_ledger(page_lines: DataFrame, label: str, folder: str | None = None, known_unbalanced: int | None = None) -> dict:
    """One ledger from page lines to its report: reconstruct, judge, adapt, report, and write three tables where a folder is given. Nothing raises: status tells the step that failed; a ledger without vouchers ends after the first."""
    out: dict = {"label": label, "status": "ok"}

    def reconstructed():
        out["parts"] = V.reconstruct(page_lines)
        out["stats"] = V.statistics(out["parts"])
        if not out["stats"]["vouchers"]:
            raise ValueError("no vouchers found")
        out["confidence"], out["reasons"] = confidence(out["stats"])
        out["drifted"] = drifted(out["stats"], known_unbalanced)

    def written():
        if folder:
            for name in ("legs", "unresolved", "state_events"):
                out["parts"][name].write.mode("overwrite").json(f"{folder}/{label}_{name}")

    def reported():
        out["legs"] = canonical(out["parts"], label)
        out["report"], out["tables"] = ledger_report(out["legs"], label)

    for name, step in (("reconstruct", reconstructed), ("write", written), ("report", reported)):
        done = run_steps([(name, step)])[name]
        if done["status"] != "ok":
            out["status"], out["reason"] = f"{name} {done['status']}", done["reason"]
            break
    return out


def run_steps(steps: list[tuple[str, Callable[[], object]]], progress: Callable[[str], None] | None = None) -> dict[str, dict]:
    """Each step alone: a missing file skips it, any other failure marks it, later steps run."""
    out = {}
    for name, step in steps:
        if progress:
            progress(name)
        try:
            out[name] = {"status": "ok", "result": step()}
        except FileNotFoundError as e:
            out[name] = {"status": "skipped", "reason": str(e)}
        except ImportError as e:
            out[name] = {"status": "unavailable", "reason": str(e)}
        except Exception as e:
            out[name] = {"status": "failed", "reason": str(e)}
    return out


class Jobs:
    """One worker, first in first out; a job that waits already is not queued twice."""

    def __init__(self, keep: int = 40):
        self.keep, self.waiting, self.jobs, self.lock, self.next = keep, deque(), {}, threading.Condition(), 0
        threading.Thread(target=self._work, daemon=True).start()

    def submit(self, kind: str, key: str, work: Callable[[], object]) -> int:
        with self.lock:
            for i in self.waiting:
                if (self.jobs[i]["kind"], self.jobs[i]["key"]) == (kind, key):
                    return i
            self.next += 1
            self.jobs[self.next] = {"id": self.next, "kind": kind, "key": key, "state": "queued", "work": work, "result": None}
            self.waiting.append(self.next)
            self.lock.notify()
            return self.next

    def _work(self) -> None:
        while True:
            with self.lock:
                while not self.waiting:
                    self.lock.wait()
                job = self.jobs[self.waiting.popleft()]
                job["state"] = "running"
            try:
                result, state = job["work"](), "done"
            except Exception as e:
                result, state = str(e), "failed"
            with self.lock:
                job["result"], job["state"] = result, state
                ended = [i for i, j in self.jobs.items() if j["state"] in ("done", "failed")]
                for i in ended[: max(0, len(ended) - self.keep)]:
                    del self.jobs[i]
                self.lock.notify_all()

    def snapshot(self) -> list[dict]:
        with self.lock:
            return [{k: v for k, v in j.items() if k != "work"} for j in self.jobs.values()]

    def wait(self, i: int, seconds: float = 60) -> dict:
        with self.lock:
            self.lock.wait_for(lambda: i not in self.jobs or self.jobs[i]["state"] in ("done", "failed"), seconds)
            return {k: v for k, v in self.jobs.get(i, {}).items() if k != "work"}
