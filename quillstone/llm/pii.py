"""Personal data by patterns and a skip-chain conditional random field.

Base spans (email, ip, card, phone) come from patterns and always stay. The
field adds spans that no pattern takes:

* nodes: the tokens of a document that hold a digit or '@'; every other token
  is outside by definition, so no node stands for it. The groups of a number
  that a base span writes in groups, or that begins with '+', are one node;
* node potentials: a multinomial logistic model of the token's shape and the
  word before it, trained here on a bounded sample whose labels are the base
  spans (patterns are never a feature; a token that a pattern takes only by
  itself has no label). Each base span also gives near misses (a part over
  255, a wrong check digit, too few digits) that are outside;
* chain edges join nodes at most GAP tokens apart, with a table of label
  counts; skip edges join each node to the one before it with the same or a
  similar key (the token's letters and digits, or its last digits) and to the
  first of that key which a pattern took. Agreement has one weight, learned
  from pairs of one key: a form of a base span's number that no pattern takes
  has the span's label beside it and is outside beside a token that is, as a
  near miss is; pairs of the text count where a pattern took both or neither
  (where it took one, the other's label is not known);
* nodes in base spans are clamped; loopy sum-product with damping gives the
  marginals, so a bare repetition of a known number takes its label, and so
  does a number that its own form and neighbours give away.

A node is added where the marginal of its label is at least CONFIDENT. Null
or empty text and tables without rows: no spans. Repeated rows are each
reported; equal spans of one kind count once. Columns of the input stay but
for text and those named as a result (KIND_base, KIND_added), which give way.
Work is linear in the text, however long: every pattern is anchored or
possessive, and each node has four skip edges at most.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import others, table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
#: Documents of the training sample at most, of any length, and distinct rows that are learned from at most.
SAMPLE_DOCS, SAMPLE_ROWS = 400, 50_000
GAP, ROUNDS, DAMPING, CONFIDENT = 3, 12, 0.3, 0.9
FEATURES = 512

# The same matches as the contract's patterns, written so that no start is tried twice.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
#: A group of digits of a number, and what may stand between two groups.
_GROUP, _BETWEEN = re.compile(r"[0-9+().-]+"), re.compile(r"[ \u00a0().-]{1,4}")
#: Digits of a number at most.
DIGITS = 20
_NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        if m:
            s = at
            while s > done and text[s - 1] in _LOCAL:
                s -= 1
            if s < at:
                out.append((s, m.end()))
                done = m.end()
        floor = max(at + 1, done)
        if not m or s == at:
            done = max(done, at + 1)
        at = text.find("@", floor)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind in code points, end exclusive."""
    if not text or not _MARK.search(text):
        return [[], [], [], []]
    out = [emails(text), [], [], []]
    for m in _IP.finditer(text):
        if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups()):
            out[1].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out[2].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out[3].append(m.span())
    return out


@lru_cache(1 << 16)
def _bucket(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % FEATURES


def nodes(text: str, base: list[list[tuple[int, int]]] | None = None) -> tuple[list[tuple[int, int]], list[int], list[str]]:
    """(spans, token numbers, previous words) of the tokens that hold a digit or '@', without outer punctuation; the digit groups of a number are one node."""
    spans, numbers, before = [], [], []
    last = ""
    for k, m in enumerate(_TOKEN.finditer(text)):
        token = m[0]
        if _MARK.search(token):
            s = m.start() + len(token) - len(token.lstrip("\"'([{<,;:!?|*&%$#"))
            e = m.end() - (len(token) - len(token.rstrip("\"')]}>,;:!?|*&%$#.")))
            if s < e:
                spans.append((s, e))
                numbers.append(k)
                before.append(last)
        last = token.lower()
    if base and (base[2] or base[3]):
        spans, numbers, before = _grouped(text, spans, numbers, before, base)
    return _led(text, spans, numbers, before, base) if "+" in text else (spans, numbers, before)


def _put_together(spans, numbers, before, first: list[int]):
    """The nodes with node i joined to the one before it where first[i] < i."""
    out: tuple[list, list, list] = ([], [], [])
    fewer = 0
    for i, (s, e) in enumerate(spans):
        if first[i] < i:
            out[0][-1] = (out[0][-1][0], e)
            fewer += 1
            continue
        out[0].append((s, e))
        out[1].append(numbers[i] - fewer)
        out[2].append(before[i])
    return out


def _octets(token: str) -> bool:
    parts = token.split(".")
    return len(parts) == 4 and all(p.isdecimal() and len(p) <= 3 and int(p) <= 255 for p in parts)


def _led(text: str, spans, numbers, before, base):
    """The nodes with the groups after a '+' put together that make 9 to 15 digits, where no base span is."""
    label = labels_of(spans, base or [[], [], [], []])
    first = list(range(len(spans)))
    i = 0
    while i < len(spans):
        s, e = spans[i]
        j, size = i, 0
        if text[s] == "+" and not label[i] and _GROUP.fullmatch(text, s, e):
            size = len(_NOT_DIGIT.sub("", text[s:e]))
            while j + 1 < len(spans) and not label[j + 1] and _BETWEEN.fullmatch(text, spans[j][1], spans[j + 1][0]):
                more = text[slice(*spans[j + 1])]
                digits = len(_NOT_DIGIT.sub("", more))
                if not _GROUP.fullmatch(more) or "+" in more or _octets(more) or size + digits > 15:
                    break
                j, size = j + 1, size + digits
        if size >= 9:
            for k in range(i + 1, j + 1):
                first[k] = i
        i = j + 1
    return _put_together(spans, numbers, before, first)


def _grouped(text: str, spans, numbers, before, base):
    """The nodes with the groups of each base number put together, and elsewhere those that spell a base number or its end again."""
    known: dict[str, set[str]] = {}
    for s, e in base[2] + base[3]:
        digits = _NOT_DIGIT.sub("", text[s:e])
        known.setdefault(digits[-7:], set()).add(digits)
    label = labels_of(spans, [sorted(base[2] + base[3])])
    groups = [_NOT_DIGIT.sub("", text[s:e]) if _GROUP.fullmatch(text, s, e) else "" for s, e in spans]
    # whether a node goes on from the one before
    near = [i > 0 and bool(groups[i] and groups[i - 1]) and label[i] == label[i - 1] and bool(_BETWEEN.fullmatch(text, spans[i - 1][1], spans[i][0])) for i in range(len(spans))]
    first = list(range(len(spans)))
    at = 0
    for s, e in sorted(base[2] + base[3]):
        while at < len(spans) and spans[at][1] <= s:
            at += 1
        i = at
        while i + 1 < len(spans) and spans[i + 1][0] < e and near[i + 1]:
            i += 1
            first[i] = at
    i = len(spans) - 1
    while i > 0:
        best, digits, j = i, groups[i], i
        while not label[i] and near[j] and len(digits) < DIGITS:
            j -= 1
            digits = groups[j] + digits
            if len(digits) >= 7 and any(d.endswith(digits.lstrip("0") or "-") for d in known.get(digits[-7:], ())):
                best = j
        for k in range(best + 1, i + 1):
            first[k] = best
        i = best - 1
    out = _put_together(spans, numbers, before, first)
    # a bracket that the number closes itself belongs to it
    out[0][:] = [(s - 1, e) if s and text[s - 1] == "(" and ")" in text[s:e] and "(" not in text[s:e] else (s, e) for s, e in out[0]]
    return out


def features(token: str, previous: str) -> list[int]:
    digits = _NOT_DIGIT.sub("", token[:200])
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[A-Za-z]+", "a", token[:60]))
    told = [
        "bias",
        f"n={min(len(digits), 24)}",
        f"luhn={len(digits) >= 13 and luhn(digits)}",
        f"at={'@' in token}",
        f"dots={min(token.count('.'), 5)}",
        f"octets={_octets(token)}",
        f"plus={token[:1] == '+'}",
        f"sep={'-' in token}{'(' in token}",
        f"shape={shape}",
        f"prev={previous[:20].rstrip(':=')}",
    ]
    return [_bucket(x) for x in told]


def labels_of(spans: list[tuple[int, int]], base: list[list[tuple[int, int]]]) -> np.ndarray:
    """Of each node the kind of the base span that it overlaps, or 0."""
    out = np.zeros(len(spans), int)
    starts = np.array([s for s, _ in spans], int)
    ends = np.array([e for _, e in spans], int)
    for k, found in enumerate(base, 1):
        for s, e in found:
            out[np.searchsorted(ends, s, "right") : np.searchsorted(starts, e, "left")] = k
    return out


def keys(token: str) -> list[str]:
    """What two tokens share to be tied: the whole, and the last seven digits."""
    digits = _NOT_DIGIT.sub("", token)
    out = []
    if "@" in token or len(digits) >= 6:
        out.append("t" + re.sub(r"[^0-9a-z@]+", "", token.lower()))
    if len(digits) >= 7:
        out.append("d" + digits[-7:])
    return out


def edges(text: str, spans, numbers, label) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(chain, skip) pairs of nodes; a skip pair names the later or untaken node first."""
    chain = [(i, i + 1) for i in range(len(spans) - 1) if numbers[i + 1] - numbers[i] <= GAP]
    groups: dict[str, list[int]] = {}
    for i, (s, e) in enumerate(spans):
        for key in keys(text[s:e]):
            groups.setdefault(key, []).append(i)
    skip = set()
    for members in groups.values():
        skip.update(zip(members[1:], members, strict=False))
        taken = next((i for i in members if label[i]), None)
        if taken is not None:
            skip.update((i, taken) for i in members if i != taken and (taken, i) not in skip)
    return chain, sorted(skip)


def again(token: str) -> list[str]:
    """Forms in which a text may repeat a number that a pattern took: its digits, and the last ten and seven of them."""
    digits = _NOT_DIGIT.sub("", token)
    own = set(keys(token))
    return [x for x in dict.fromkeys((digits, digits[-10:], digits[-7:], f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}", f"{digits[-7:-4]}-{digits[-4:]}")) if x != token and own & set(keys(x))]


def near_misses(kind: int, token: str) -> list[str]:
    """The token changed so that its pattern would not take it."""
    if kind == 1:
        local, _, domain = token.partition("@")
        return [f"@{domain}", f"{local}@{domain.split('.')[0]}"]
    if kind == 2 and _octets(token):
        return [f"{int(token.split('.')[0]) + 256}.{token.split('.', 1)[1]}"]
    if kind == 3 and token[-1].isdecimal():
        return [token[:-1] + str((int(token[-1]) + 1) % 10)]
    return [token[: len(token) // 2].rstrip(" ().-")] if kind == 4 else []


class Field:
    """Trained potentials, in logarithms."""

    def __init__(self, node: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.node, self.chain, self.skip = node, chain, skip

    def marginals(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Loopy sum-product over both kinds of pairs; messages of one kind share its table."""
        sides = [(a, b, np.exp(t)) for pairs, t in ((chain, self.chain), (skip, self.skip)) if len(pairs) for a, b in ((pairs[:, 0], pairs[:, 1]), (pairs[:, 1], pairs[:, 0]))]
        msgs = [np.zeros((len(a), unary.shape[1])) for a, _, _ in sides]
        belief = unary.copy()
        for _ in range(ROUNDS if sides else 0):
            new = []
            for i, (a, _, t) in enumerate(sides):
                out = belief[a] - msgs[i ^ 1]  # sides of one kind stand beside each other
                out = np.exp(out - out.max(1, keepdims=True)) @ t
                out = np.log(out + 1e-30)
                new.append(DAMPING * msgs[i] + (1 - DAMPING) * (out - out.max(1, keepdims=True)))
            msgs = new
            belief = unary.copy()
            for (_, b, _), m in zip(sides, msgs, strict=True):
                np.add.at(belief, b, m)
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def added(self, text: str, base: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
        """Spans of each kind beside the base ones."""
        out: list[list[tuple[int, int]]] = [[], [], [], []]
        if not text or not _MARK.search(text):
            return out
        spans, numbers, before = nodes(text, base)
        label = labels_of(spans, base)
        if not len(spans) or label.all():
            return out
        chain, skip = edges(text, spans, numbers, label)
        unary = self.node[np.array([features(text[s:e], p) for (s, e), p in zip(spans, before, strict=True)])].sum(1)
        unary = np.where(label[:, None] > 0, np.where(np.arange(len(LABELS)) == label[:, None], 0.0, -30.0), unary)
        p = self.marginals(unary, np.array(chain, int).reshape(-1, 2), np.array(skip, int).reshape(-1, 2))
        for i in np.flatnonzero((label == 0) & (p[:, 1:].max(1) >= CONFIDENT)):
            out[int(p[i, 1:].argmax())].append(spans[i])
        return out


#: What is learned from a text: (0, features, 0, label) of nodes, (1, none, label, label) of chain pairs and (2, features, label, label of these) of skip pairs.
Seen = tuple[int, tuple[int, ...], int, int]


def observed(text: str) -> Counter[Seen]:
    out: Counter[Seen] = Counter()
    base = base_spans(text)
    spans, numbers, before = nodes(text, base)
    label = labels_of(spans, base).tolist()
    told = [tuple(features(text[s:e], p)) for (s, e), p in zip(spans, before, strict=True)]
    # what a pattern takes by itself, but not here, is of unknown label
    out.update((0, f, 0, y) for f, y, (s, e) in zip(told, label, spans, strict=True) if y or not any(base_spans(text[s:e])))
    chain, skip = edges(text, spans, numbers, label)
    for i, j in chain:
        out[1, (), label[i], label[j]] += 1
        out[1, (), label[j], label[i]] += 1
    for i, j in skip:
        if bool(label[i]) == bool(label[j]):
            out[2, told[i], label[j], label[i]] += 1
            out[2, told[j], label[i], label[j]] += 1
    for (s, e), p, y in zip(spans, before, label, strict=True):
        if y:
            for x in again(text[s:e]):
                told_again = tuple(features(x, p))
                out.update([(2, told_again, y, y), (2, told_again, 0, 0)])
            for x in near_misses(y, text[s:e]):
                told_wrong = tuple(features(x, p))
                out.update([(0, told_wrong, 0, 0), (2, told_wrong, 0, 0)])
    return out


def fit(seen: dict[Seen, int], epochs: int = 300, rate: float = 2.0, l2: float = 1e-4, tie_l2: float = 1e-3) -> Field:
    """Node weights by multinomial logistic regression, then the weight of agreement over a skip edge by the likelihood of a node's label given its partner's; the chain table from label counts."""
    n = len(LABELS)
    chains, eye = np.ones((n, n)), np.eye(n)
    for (kind, _, a, b), m in seen.items():
        if kind == 1:
            chains[a, b] += m

    def taken(kind):
        rows = sorted((x, m) for x, m in seen.items() if x[0] == kind)
        return np.array([x[1] for x, _ in rows]), np.array([x[2] for x, _ in rows]), np.array([x[3] for x, _ in rows]), np.array([m for _, m in rows], float)

    def softmax(z):
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    w, skips = np.zeros((FEATURES, n)), np.zeros((n, n))
    x, _, y, m = taken(0)
    if len(x):
        m /= m.sum()
        for _ in range(epochs):
            g = l2 * w
            np.add.at(g, x, ((softmax(w[x].sum(1)) - eye[y]) * m[:, None])[:, None, :])
            w -= rate * g
    x, a, y, m = taken(2)
    if len(x):
        m /= m.sum()
        own, agree = w[x].sum(1), 0.0
        for _ in range(epochs):
            p = softmax(own + agree * eye[a])
            agree -= rate * (((p[np.arange(len(a)), a] - (y == a)) * m).sum() + tie_l2 * agree)
        skips = agree * eye
    lift = np.log(chains * chains.sum() / (chains.sum(1, keepdims=True) * chains.sum(0, keepdims=True)))
    return Field(w, np.clip(lift, -1, 1), skips)


def train(texts: list[str]) -> Field:
    seen: Counter[Seen] = Counter()
    for text in texts:
        seen.update(observed(text))
    return fit(seen)


def sample(docs: DataFrame, text: str = "text") -> dict[Seen, int]:
    """What is learned from at most SAMPLE_DOCS texts with digits or '@', of any length, chosen by hash: the same for any partitioning. Counts alone reach the driver."""
    t = F.col(f"`{text}`")
    some = docs.select(t.alias("t")).where(F.col("t").rlike(r"[0-9]{2,}[.)-]?[0-9]|@")).withColumn("h", F.xxhash64("t"))
    # hashes find the cut, so no partition sends more than are taken
    least = [r.h for r in some.select("h").distinct().orderBy("h").limit(SAMPLE_DOCS).collect()]
    if not least:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell in b.column("t"):
                got = observed(cell.as_py())
                kind, told, a, z = zip(*got, strict=True) if got else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(told, pa.list_(pa.int32())), pa.array(a, pa.int32()), pa.array(z, pa.int32()), pa.array(got.values(), pa.int64())], names=["kind", "told", "a", "b", "n"])

    texts = some.where(F.col("h") <= least[-1]).select("t").distinct()
    rows = texts.mapInArrow(run, "kind int, told array<int>, a int, b int, n long").groupBy("kind", "told", "a", "b").agg(F.sum("n").alias("n"))
    rows = rows.orderBy(F.xxhash64("kind", "told", "a", "b"), "kind", "told", "a", "b").limit(SAMPLE_ROWS)
    return {(r.kind, tuple(r.told), r.a, r.b): r.n for r in rows.collect()}


SPANS = "array<struct<start:int,end:int>>"


def find(docs: DataFrame, text: str = "text", field: Field | None = None) -> DataFrame:
    """docs without text, plus for each kind KIND_base and KIND_added: arrays of start and end in code points."""
    field = field or fit(sample(docs, text))
    results = [f"{k}_{w}" for k in KINDS for w in ("base", "added")]
    keep = others(docs, text, *results)
    kind = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"{r} {SPANS}" for r in results)])
    pair = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(2 * len(KINDS))]
            for cell in b.column(text):
                t = cell.as_py() or ""
                base = base_spans(t)
                more = field.added(t, base)
                for k in range(len(KINDS)):
                    cols[2 * k].append([{"start": s, "end": e} for s, e in base[k]])
                    cols[2 * k + 1].append([{"start": s, "end": e} for s, e in more[k]])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(c, pair) for c in cols)], names=[*keep, *results])

    return docs.select(*(F.col(f"`{c}`") for c in (*keep, text))).mapInArrow(run, kind)


def _written(kind: str, spans: F.Column) -> F.Column:
    """array of kind:start:end; transform's function takes one parameter, as a second would be the place."""
    return F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))


def _joined(kinds_to_cols) -> F.Column:
    return F.array_join(F.concat(*(_written(k, c) for k, c in kinds_to_cols)), ",")


def op1_pii(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *(F.size(f"{k}_base").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_joined([(k, F.col(f"{k}_base")) for k in KINDS]), 256).alias("base_sha256"),
        _joined([(k, F.concat(f"{k}_base", f"{k}_added")) for k in KINDS]).alias("spans"),
    )
