"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import re

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def pii(x):
    x = x or ""
    return [
        [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)],
        [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))],
        [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)],
        [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15],
    ]


ASSIGN = re.compile(r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(x):
    x = x or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(x) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24]
    return sorted(found)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in spans).encode()).hexdigest()


def shingle_set(x):
    w = re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(sets):
    """Component number of each set, by all pairs."""
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def removed(texts, length):
    """Mask of removed bytes of each text."""
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        mask = [False] * len(b)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                mask[i : i + length] = [True] * length
        out.append(mask)
    return raw, out


def hits(text, items, window=10):
    """(words, hit words, items hit) of a text; items: (id, text)."""
    split = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(LOWER))
    w, marked, found = split(text), set(), set()
    for item, t in items:
        p = split(t)
        m = min(window, len(p))
        for k in range(len(p) - m + 1) if m else ():
            for i in range(len(w) - m + 1):
                if w[i : i + m] == p[k : k + m]:
                    marked |= set(range(i, i + m))
                    found.add(str(item))
    return len(w), len(marked), sorted(found)


def quality_score(text, model, hash_of):
    """The score of one text by loops: passages of 64 words, their measures, the encoder, gated attention, the head."""
    import math

    import numpy as np

    from quillstone.llm import quality

    raw = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    groups = [raw[i : i + 64] for i in range(0, len(raw), 64)] or [[]]
    encoded = []
    for g in groups:
        n, chars = max(len(g), 1), sum(map(len, g))
        row = [sum(1 for w in g for c in w if quality._CLASS_OF[c] == k) / max(chars, 1) for k in range(1, len(quality._CLASSES) + 1)]
        row += [chars / n / 10, sum(a == b for a, b in zip(g, g[1:], strict=False)) / n, sum(a == b for a, b in zip(g, g[2:], strict=False)) / n, len(set(g)) / n, len(g) / 64, math.log1p(len(raw)) / 10, math.sqrt(sum(len(w) ** 2 for w in g) / n) / 20]
        row.append(sum(model.odds[hash_of(w) % quality.BUCKETS] for w in g) / n)
        x = (np.array(row) - model.centre) / model.scale
        encoded.append(np.tanh(x @ model.w["enc"] + model.w["enc_b"]))
    gates = [math.exp(float((np.tanh(h @ model.w["att_v"]) / (1 + np.exp(-(h @ model.w["att_u"])))) @ model.w["att_w"])) for h in encoded]
    z = sum(g * h for g, h in zip(gates, encoded, strict=True)) / sum(gates)
    return 1 / (1 + math.exp(-float(z @ model.w["out"] + model.w["out_b"])))


def redacted(text, mark="[SECRET]"):
    """text with its base secrets replaced, overlapping ones once."""
    out, at = "", 0
    for s, _, _, e in secrets(text):
        if s >= at:
            out += text[at:s] + mark
        at = max(at, e)
    return out + text[at:] if text is not None else None
