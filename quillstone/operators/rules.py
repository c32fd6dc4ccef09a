"""Detection rules over a ledger of legs; each returns flags in long form, one row a leg and rule."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions import exprs as X


@dataclass(frozen=True)
class Config:
    """Thresholds of the rules."""

    round_multiple: int = 10_000
    round_exempt: tuple[str, ...] = ("Rent Expense",)
    tolerance: float = 10.0
    balance_tolerance: float = 1.0
    chi_threshold: float = 15.5
    gap_digits: int | None = 6
    gap_least: int = 3
    related_shown: int = 3


#: Numbers of a range that one window takes.
GAP_RANGE = 100_000

LONG = ["entry_id", "leg_num", "rule", "reason", "severity"]


def _same_person():
    return F.coalesce(X.blank_to_null("entered_by") == X.blank_to_null("approved_by"), F.lit(False))


def _round(amount, cfg: Config):
    return F.coalesce(X.is_round(amount, cfg.round_multiple) & ~F.col("account").isin(*cfg.round_exempt), F.lit(False))


def _segregation_reason():
    return F.concat(F.lit("entered and approved by "), F.trim("entered_by"))


def _round_reason(cfg: Config):
    return F.concat(F.lit("multiple of "), F.lit(str(cfg.round_multiple)))


def _duplicate_reason(least, cfg: Config):
    others = F.slice(F.array_except(least, F.array("entry_id")), 1, cfg.related_shown)
    return F.concat(F.lit("matches voucher(s) "), F.array_join(others, ", "), F.lit(" on "), F.col("date").cast("string"))


def segregation(legs: DataFrame) -> DataFrame:
    """Legs that one person both entered and approved."""
    return legs.where(_same_person()).select("entry_id", "leg_num", F.lit("segregation_of_duties").alias("rule"), _segregation_reason().alias("reason"), X.amount_severity("amount").alias("severity"))


def round_amounts(legs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Legs of round amounts outside exempt accounts; weak alone, so always LOW."""
    return legs.where(_round("amount", cfg)).select("entry_id", "leg_num", F.lit("round_number").alias("rule"), _round_reason(cfg).alias("reason"), F.lit("LOW").alias("severity"))


def _not_rounding(amount):
    return ~F.coalesce(X.invoice_rounding("account", amount), F.lit(False))


def _with_keys(legs: DataFrame, keys: list) -> tuple[DataFrame, list[str]]:
    """(legs with columns of the key, their names). None is null: text that is missing is empty, and which of the others are missing is told by bits of kn. Days, integers and decimals stay numbers, as text would be several times longer."""
    out, bits = {}, F.lit(0)
    for i, (k, field) in enumerate(zip(keys, legs.select(*keys).schema, strict=True)):
        kind = field.dataType
        if isinstance(kind, (T.DateType, T.IntegralType, T.DecimalType)):
            bits = bits + F.when(k.isNull(), 1 << i).otherwise(0)
            k = F.unix_date(k) if isinstance(kind, T.DateType) else k
            out[f"k{i}"] = F.coalesce(k, F.lit(0) if isinstance(kind, T.DateType) else F.lit(0).cast(kind))
        else:
            out[f"k{i}"] = F.coalesce(k.cast("string"), F.lit(""))
    return legs.withColumns({**out, "kn": bits}), [*out, "kn"]


def duplicate_classes(legs: DataFrame, keys: list, amount="amount", shown: int | None = Config.related_shown, voucher: str = "entry_id", named=None) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """(legs with their key, once: vouchers with their repeated keys and maybe others, the keys that several vouchers have, names of the key): vouchers counts them, least holds the first shown + 1 ids (shown None: no ids).

    Invoice rounding repeats by nature and is left alone. Most keys are alone
    under their hash, so only short rows of hashes are grouped for all legs, and
    keys themselves only where a hash has several vouchers. Vouchers of a key are
    counted and its least ids cut before the shuffle, so a frequent key costs
    no array of all its vouchers. voucher may be a shorter column than entry_id
    that names the same vouchers and is never null; named makes entry_id of it.
    """
    keyed, names = _with_keys(legs.where(_not_rounding(amount)), keys)
    pairs = keyed.select(voucher, *names, F.xxhash64(*names).alias("h"))
    who = F.coalesce(F.concat(F.lit("v"), "entry_id"), F.lit("")) if voucher == "entry_id" else F.col(voucher)
    met = pairs.groupBy("h").agg(F.min(who).alias("lo"), F.max(who).alias("hi")).where("lo <> hi").select("h")
    once = pairs.join(met, "h", "left_semi").drop("h").distinct()
    classes = once.groupBy(*names).agg(F.count("*").cast("int").alias("vouchers")).where("vouchers > 1")
    if shown is not None:
        first = once.select(*names, (F.col("entry_id") if named is None else named).alias("entry_id"))
        first = first.withColumn("rank", F.row_number().over(Window.partitionBy(*names).orderBy("entry_id"))).where(F.col("rank") <= shown + 1)
        classes = classes.join(first.groupBy(*names).agg(F.sort_array(F.collect_list("entry_id")).alias("least")), names)
    return keyed, once, classes, names


def _duplicate_severity(amount, vouchers):
    sev = X.amount_severity(amount)
    return F.when(vouchers > 2, X.escalate(sev)).otherwise(sev)


def duplicates(legs: DataFrame, keys: list, amount="amount", cfg: Config = Config()) -> DataFrame:
    """Legs whose key occurs in other vouchers too; more than two vouchers escalate."""
    keyed, _, classes, names = duplicate_classes(legs, keys, amount, cfg.related_shown)
    return keyed.join(classes, names).select(
        "entry_id", "leg_num", F.lit("duplicate_transaction").alias("rule"),
        _duplicate_reason("least", cfg).alias("reason"), _duplicate_severity(amount, F.col("vouchers")).alias("severity"), "vouchers",
    )


def related(legs: DataFrame, keys: list, amount="amount") -> DataFrame:
    """entry_id, first_id, vouchers: each voucher of a repeated key with the key's first voucher, which stands for all of them, and their number."""
    _, once, classes, names = duplicate_classes(legs, keys, amount, 0)
    return once.join(classes, names).select("entry_id", F.col("least")[0].alias("first_id"), "vouchers").distinct()


def benford(df: DataFrame, amount="amount", by: list[str] = ()) -> DataFrame:
    """n, chi_square, mad, deviates of first digits, for each group of `by`; digits that never occur count as 0."""
    digits = df.select(*by, X.first_digit(amount).alias("digit")).where("digit is not null").groupBy(*by).pivot("digit", list(range(1, 10))).count().na.fill(0)
    n = sum((F.col(str(i)) for i in range(1, 10)), F.lit(0))
    shares = [(F.col(str(i)), p / 100) for i, p in enumerate(X.BENFORD_PERCENT, 1)]
    chi = sum((F.pow(o - F.col("n") * p, 2) / (F.col("n") * p) for o, p in shares), F.lit(0.0))
    mad = sum((F.abs(o / F.col("n") - p) for o, p in shares), F.lit(0.0)) / 9
    return digits.withColumn("n", n).where("n > 0").select(*by, "n", F.round(chi, 6).alias("chi_square"), F.round(mad, 9).alias("mad"), (chi > 15.5).alias("deviates"))


def sequence_gaps(vouchers: DataFrame, series: list[str], number="number", cfg: Config = Config()) -> DataFrame:
    """Missing numbers of each series with the neighbours that are there; short or long-numbered series are skipped (gap_digits None: no number is too long)."""
    first = vouchers.where(F.col(number).isNotNull()).groupBy(*series, F.col(number).alias("num")).agg(F.min_by("entry_id", "row_idx").alias("entry_id"), F.min_by("date", "row_idx").alias("date"))
    size = first.groupBy(*series).agg(F.count("*").alias("group_size"), F.max("num").alias("top")).where(F.col("group_size") >= cfg.gap_least)
    if cfg.gap_digits is not None:
        size = size.where(F.length(F.col("top").cast("string")) <= cfg.gap_digits)
    near = first.join(F.broadcast(size) if not series else size, series) if series else first.crossJoin(F.broadcast(size))
    near = near.withColumn("range", F.floor(F.col("num") / GAP_RANGE))
    # a window holds one range of numbers; the last number of a range is followed by the first one of the next range that has any
    heads = near.groupBy(*series, "range").agg(F.min("num").alias("head"), F.min_by("entry_id", "num").alias("head_id"))
    w = Window.partitionBy(*series).orderBy("range")
    heads = heads.select(*series, "range", F.lead("head").over(w).alias("head"), F.lead("head_id").over(w).alias("head_id"))
    w = Window.partitionBy(*series, "range").orderBy("num")
    near = near.withColumns({"next": F.lead("num").over(w), "after_id": F.lead("entry_id").over(w)}).join(heads, [*series, "range"])
    near = near.withColumns({"after_id": F.when(F.col("next").isNull(), F.col("head_id")).otherwise(F.col("after_id")), "next": F.coalesce("next", "head")})
    lo, hi = (F.col("num") + 1).cast("long"), (F.col("next") - 1).cast("long")
    # a wide gap is cut into pieces, so no array is longer than a range
    near = near.where(F.col("next") - F.col("num") > 1).withColumns({"hi": hi, "lo": F.explode(F.sequence(lo, hi, F.lit(GAP_RANGE).cast("long")))})
    return near.select(*series, F.explode(F.sequence("lo", F.least(F.col("lo") + GAP_RANGE - 1, "hi"))).alias("missing"), F.col("num").cast("long").alias("before"), F.col("entry_id").alias("before_id"), F.col("next").cast("long").alias("after"), "after_id", "group_size")


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], measures: list[str], tolerance: float, reference: str = "right", how: str = "inner", never_none: bool = False, missing: str | None = None) -> DataFrame:
    """Flags where a measure differs by more than tolerance; severity by its share of the reference side.

    With how = "full" or "left" a missing side counts as 0, or, where missing
    names a check, gives one CRITICAL flag of that name instead.
    """
    l_ = left.select(*keys, F.lit(True).alias("in_l"), *(F.col(m).alias(f"l_{m}") for m in measures))
    r_ = right.select(*keys, F.lit(True).alias("in_r"), *(F.col(m).alias(f"r_{m}") for m in measures))
    both = l_.join(r_, keys, how)
    absent = F.lit(False) if missing is None else F.col("in_l").isNull() | F.col("in_r").isNull()
    cells = [F.struct(F.lit(m).alias("check"), F.coalesce(f"l_{m}", F.lit(0)).alias("left_amount"), F.coalesce(f"r_{m}", F.lit(0)).alias("right_amount")) for m in measures]
    if missing is not None:
        hole = F.array(cells[0].withField("check", F.lit(missing)))
        flat = F.when(absent, hole).otherwise(F.array(*cells))
    else:
        flat = F.array(*cells)
    flat = both.select(*keys, absent.alias("absent"), F.explode(flat).alias("x")).select(*keys, "absent", "x.*")
    gap = F.col("left_amount") - F.col("right_amount")
    ref = F.col("right_amount" if reference == "right" else "left_amount")
    sev = X.percent_severity(gap.cast("double"), ref.cast("double"))
    if never_none:
        sev = F.when(sev == "NONE", "MEDIUM").otherwise(sev)
    flags = flat.withColumn("mismatch", F.when(~F.col("absent"), gap)).where(F.col("absent") | (F.abs("mismatch") > tolerance))
    return flags.withColumn("severity", F.when(F.col("absent"), "CRITICAL").otherwise(sev)).drop("absent")


def converge(legs: DataFrame, flags: list[DataFrame]) -> DataFrame:
    """All rules' flags of a leg together: reasons in rule order, how many, and the largest severity."""
    long = None
    for i, f in enumerate(flags):
        part = f.select("entry_id", "leg_num", F.struct(F.lit(i).alias("ord"), "rule", "reason", "severity").alias("x"))
        long = part if long is None else long.unionByName(part)
    per = long.groupBy("entry_id", "leg_num").agg(F.sort_array(F.collect_list("x")).alias("reasons"))
    per = per.select("entry_id", "leg_num", "reasons", F.size("reasons").alias("signal_count"), X.worst(F.transform("reasons", lambda x: x["severity"])).alias("severity"))
    return legs.select("entry_id", "leg_num", "date", "account", "amount").join(per, ["entry_id", "leg_num"])


def converge_rules(legs: DataFrame, keys: list, cfg: Config = Config(), round_amount="amount", repeat_amount="amount", voucher: str = "entry_id", named=None, told: bool = True) -> DataFrame:
    """What converge says of segregation, round_amounts and duplicates, and the column voucher, for legs whose entry_id and leg_num name one leg.

    Two rules need nothing but the leg. Repeated keys go back to their vouchers,
    so the legs, which are put together by voucher, are shuffled by nothing else
    and are not grouped by leg. told False leaves out reasons, which counts do
    without. Keys are looked up within their voucher, which has few.
    """
    _, once, classes, names = duplicate_classes(legs, keys, repeat_amount, cfg.related_shown if told else None, voucher, named)
    shared = once.join(classes, names).groupBy(voucher).agg(F.collect_list(F.struct(*names, *(c for c in classes.columns if c not in names))).alias("shared_"))
    keyed, _ = _with_keys(legs, keys)
    same = F.filter("shared_", lambda x: functools.reduce(lambda a, b: a & b, (x[n] == F.col(n) for n in names)))
    marked = keyed.join(shared, voucher, "left").withColumns({"same_person_": _same_person(), "round_": _round(round_amount, cfg), "class_": F.when(F.col("shared_").isNotNull() & _not_rounding(repeat_amount), F.get(same, F.lit(0)))})
    repeated = F.col("class_").isNotNull()
    marked = marked.where(F.col("same_person_") | F.col("round_") | repeated)
    sev = {"segregation_of_duties": X.amount_severity("amount"), "round_number": F.lit("LOW"), "duplicate_transaction": _duplicate_severity(repeat_amount, F.col("class_")["vouchers"])}
    hits = dict(zip(sev, (F.col("same_person_"), F.col("round_"), repeated), strict=True))
    out = ["entry_id", "leg_num", "date", "account", "amount", *([voucher] if voucher != "entry_id" else [])]
    more = {"signal_count": sum((hits[r].cast("int") for r in sev), F.lit(0)), "severity": X.severity_of(F.greatest(*(F.when(hits[r], X.rank_of(sev[r])).otherwise(0) for r in sev)))}
    if told:
        reason = dict(zip(sev, (_segregation_reason(), _round_reason(cfg), _duplicate_reason(F.col("class_")["least"], cfg)), strict=True))
        more["reasons"] = F.array_compact(F.array(*(F.when(hits[r], F.struct(F.lit(i).alias("ord"), F.lit(r).alias("rule"), reason[r].alias("reason"), sev[r].alias("severity"))) for i, r in enumerate(sev))))
    return marked.select(*out, *(c.alias(n) for n, c in more.items()))


def severest(flags: DataFrame, voucher: str = "entry_id") -> DataFrame:
    """A row a voucher: entry_id, rank of the largest severity, largest amount, first date, flagged legs, and all accounts and reasons for tell. A voucher has few legs."""
    said = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("leg_num", "reasons"))), lambda x: x["reasons"])) if "reasons" in flags.columns else F.lit(None)
    who = [F.first("entry_id").alias("entry_id")] if voucher != "entry_id" else []
    return flags.groupBy(voucher).agg(*who, F.max(X.rank_of("severity")).alias("rank"), F.max("amount").alias("amount"), F.collect_set("account").alias("accounts"), F.min("date").alias("date"), F.count("*").alias("leg_count"), said.alias("said"))


def tell(vouchers: DataFrame) -> DataFrame:
    """severest's rows with severity, accounts, checks and reasons as text: best made of the rows that are shown."""
    texts = lambda part: F.array_distinct(F.transform("said", lambda x: x[part]))
    return vouchers.withColumns({"severity": X.severity_of("rank"), "accounts": F.array_join(F.array_sort("accounts"), ", "), "checks": F.array_join(F.array_sort(texts("rule")), ", "), "reasons": F.array_join(texts("reason"), "; ")}).drop("said")


def by_voucher(flags: DataFrame) -> DataFrame:
    """A row a voucher: largest severity and amount, accounts, checks, reasons as first seen, first date, flagged legs."""
    return tell(severest(flags))
