"""Secret scan with multipart credential linking, in DataFrame functions only.

Base kinds (assign, access, hex) are always reported. Weak parts - an access
identifier, a secret or an endpoint whose form alone proves nothing - are
reported only where a complementary part lies in the same scope, found by an
interval join on (document, bin).

Offsets without Python: the pieces between matches (split) and the matches
themselves (regexp_extract_all) have lengths whose running sum gives each
match's start in code points. The sum runs over blocks of BLOCK matches, so a
text of very many matches copies no long array for each of them.

Null and empty texts have no spans; a table without rows gives none. Repeated
rows are each reported, and equal spans of one kind count once. Rows are told
apart by a row id, so equal or null ids never mix. Texts of any length are
taken whole. Columns of the input stay, but for scan those named as a result
(row_id, base, linked) give way; redact keeps every column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import others, stage

ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: The same matches as [0-9a-f]+ of 24 or more: a run that is long enough is taken from its first character.
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
#: Weak parts. identifiers: a short or temporary key id, or a named id; secrets: a quoted or named run of base64; endpoints: a URL.
WEAK_ID = r"""\b(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{6,}|\b(?i:(?:access|client|account)[_-]?(?:key)?[_-]?id)["']?\x20{0,4}[:=]\x20{0,4}["']?[A-Za-z0-9_-]{6,}"""
#: A quoted run of 16 or more, or one after the name of a secret, with its padding; bare runs have 40 characters, or 16 to 23 of hex.
_RUN = r"[A-Za-z0-9+/_-]{16,}+={0,2}+"
_QUOTED = rf"""(?<=["'])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Za-z+/_-]*+[0-9]){_RUN}(?=["'])"""
_NAMED = rf"""(?<=(?i:key|secret|token|passw(?:or)?d|pwd|credentials?|signature)["']?\x20{{0,4}}[:=]\x20{{0,4}}["']?)(?=[a-z+/_-]*+[A-Z0-9]){_RUN}"""
WEAK_SECRET = rf"""(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{{16}})(?:{_QUOTED}|{_NAMED})|(?<![A-Za-z0-9+/])(?=[a-z0-9+/]{{0,39}}[A-Z])(?=[A-Za-z+/]{{0,39}}[0-9])[A-Za-z0-9+/]{{40}}(?![A-Za-z0-9+/])|(?<![0-9A-Za-z])[0-9a-f]{{16,23}}(?![0-9A-Za-z])"""
ENDPOINT = r"""\b(?:https?|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+"""
#: Code points between the starts of parts that belong to one credential.
SCOPE = 512
#: Matches of a block of the running sum.
BLOCK = 256
_SPANS = "array<struct<s:int,r:int,k:string,e:int>>"


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def _once(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _matches(text: Column, pattern: str, keep=None, group: int | None = None) -> Column:
    """array<struct<s,e,g>> of the pattern's matches, leftmost and non-overlapping; keep filters by start, end and length of the group."""
    # the piece before each match, and the match; the last piece has none
    sizes = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda b, w: F.struct(F.length(b).alias("gap"), F.length(w).alias("n"), F.length(w).alias("g")))
    if group is not None:
        sizes = F.zip_with(sizes, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x, g: F.struct(x["gap"].alias("gap"), x["n"].alias("n"), F.length(g).alias("g")))
    spans = _once(F.filter(sizes, lambda x: x["n"].isNotNull()), lambda z: F.flatten(_block_spans(F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(z) - 1, F.lit(0)) / BLOCK).cast("int")), lambda i: F.slice(z, i * BLOCK + 1, F.lit(BLOCK))))))
    return F.filter(spans, keep) if keep is not None else spans


def _block_spans(blocks: Column) -> Column:
    """Blocks of (gap, n, g) to blocks of spans: each starts at the sum of those before it."""
    begun = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), _none("array<struct<b:array<struct<gap:int,n:int,g:int>>,at:int>>").alias("out")),
        lambda acc, b: F.struct(F.aggregate(b, acc["at"], lambda n, x: n + x["gap"] + x["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct(b.alias("b"), acc["at"].alias("at")))).alias("out")),
        lambda acc: acc["out"],
    )

    def spans(block: Column) -> Column:
        return F.aggregate(
            block["b"],
            F.struct(block["at"].alias("at"), _none("array<struct<s:int,e:int,g:int>>").alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + x["n"]).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("s"), (acc["at"] + x["gap"] + x["n"]).alias("e"), x["g"].alias("g")))).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    return F.transform(begun, spans)


def _as(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("r"), F.lit(kind).alias("k"), x["e"].alias("e")))


def found_parts(t: Column) -> dict[str, Column]:
    """base (array of start, rank, kind, end) and weak (the same for weak parts) of a text."""
    t = F.coalesce(t, F.lit(""))
    none = _none("array<struct<s:int,e:int,g:int>>")

    def cheap(mark: Column, spans: Column) -> Column:
        return F.when(mark, spans).otherwise(none)

    assign = cheap(t.rlike(ASSIGN), _matches(t, ASSIGN, lambda x: x["g"] >= 6, 2))
    access = cheap(t.contains("AKIA"), _matches(t, ACCESS, lambda x: x["e"] - x["s"] >= 20))
    hexes = cheap(t.rlike(HEX), _matches(t, HEX))
    weak_id = cheap(t.rlike(WEAK_ID), _matches(t, WEAK_ID))
    weak_secret = cheap(t.rlike(WEAK_SECRET), _matches(t, WEAK_SECRET))
    endpoint = cheap(t.contains("://"), _matches(t, ENDPOINT))
    return {
        "base": F.sort_array(F.concat(_as(assign, "assign", 0), _as(access, "access", 1), _as(hexes, "hex", 2))),
        "weak": F.concat(_as(weak_id, "link_id", 3), _as(weak_secret, "link_secret", 4), _as(endpoint, "link_endpoint", 5)),
    }


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row_id, linked array) for rows whose weak parts have complements within scope.

    A weak identifier needs a secret, a weak secret an identifier, an endpoint
    both. Parts inside a base span of their own role are not weak. The join is
    a semi-join on (row, bin) whose bins hold at most scope characters, so a
    bin's parts are bounded whatever the document's length.
    """
    seen = F.col("base")
    loose = F.filter("weak", lambda w: ~F.exists(seen, lambda b: (w["s"] < b["e"]) & (b["s"] < w["e"])))
    some = found.where(F.size("weak") > 0).select("row_id", F.explode(F.concat(seen, loose)).alias("p")).select("row_id", "p", F.col("p.s").alias("at"), F.floor(F.col("p.s") / scope).alias("bin"))
    role = F.when(F.col("p.k").isin("access", "link_id"), "id").when(F.col("p.k") == "link_endpoint", "endpoint").otherwise("secret")
    some = some.withColumn("role", role)
    near = some.select("row_id", "role", F.col("at").alias("near"), F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    ids, secrets = near.where("role = 'id'").drop("role"), near.where("role = 'secret'").drop("role")

    def within(parts: DataFrame, others: DataFrame) -> DataFrame:
        o = others.select(F.col("row_id").alias("o_row"), F.col("bin").alias("o_bin"), "near")
        return parts.join(o, (F.col("row_id") == F.col("o_row")) & (F.col("bin") == F.col("o_bin")) & (F.abs(F.col("at") - F.col("near")) <= scope), "left_semi")

    hit = within(some.where("p.k = 'link_id'"), secrets).unionByName(within(some.where("p.k = 'link_secret'"), ids)).unionByName(within(within(some.where("p.k = 'link_endpoint'"), ids), secrets))
    return hit.groupBy("row_id").agg(F.collect_set("p").alias("linked"))


def _parts(docs: DataFrame, text: str, kept: list[str], scope: int) -> DataFrame:
    """row_id, row (a struct of the kept columns), base and linked of each row. All patterns are tried once; rows without weak parts need no join."""
    row = F.struct(*(F.col(f"`{c}`") for c in kept)) if kept else F.struct(F.lit(None).alias("none"))
    cells = {"row_id": F.monotonically_increasing_id(), "row": row, **found_parts(F.col(f"`{text}`"))}
    found = stage(docs.select(*(c.alias(k) for k, c in cells.items())), "secrets")
    plain = found.where(F.size("weak") == 0).withColumn("linked", _none(_SPANS))
    mixed = found.where(F.size("weak") > 0).join(linked(found.select("row_id", "base", "weak"), scope), "row_id", "left").withColumn("linked", F.coalesce("linked", _none(_SPANS)))
    return plain.unionByName(mixed).select("row_id", "row", "base", "linked")


def scan(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """docs' other columns with row_id, base and linked spans (arrays of start s, rank r, kind k, end e); text is left out."""
    kept = others(docs, text, "row_id", "base", "linked")
    return _parts(docs, text, kept, scope).select(*(F.col(f"row.`{c}`") for c in kept), "row_id", "base", "linked")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _without(text: Column, spans: Column, mark: str) -> Column:
    """text with each of the sorted spans replaced by mark, overlapping ones once."""
    cut = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.struct(
            F.greatest(acc["at"], x["e"]).alias("at"),
            F.when(x["s"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        ),
    )
    return F.concat(cut["out"], F.substring(text, cut["at"] + 1, F.length(text)))


def redact(docs: DataFrame, mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """docs with every base or linked span of text replaced by mark and n_chars counted anew; rows and columns stay, in their order."""
    found = _parts(docs, "text", docs.columns, scope).select("row", F.sort_array(F.concat("base", "linked")).alias("spans"))
    text, hit = F.col("row.text"), F.size("spans") > 0
    changed = found.select("row", hit.alias("hit"), F.when(hit, _without(text, F.col("spans"), mark)).otherwise(text).alias("new"))

    def cell(c: str) -> Column:
        old = F.col(f"row.`{c}`")
        if c == "n_chars":
            return F.when(F.col("hit"), F.length("new").cast(docs.schema[c].dataType)).otherwise(old).alias(c)
        return F.col("new").alias(c) if c == "text" else old.alias(c)

    return changed.select(*map(cell, docs.columns))


def op10_secret_links(spark, sf_dir: str) -> DataFrame:
    from quillstone.llm.common import table

    rows = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return rows.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "linked")).alias("spans"),
    )
