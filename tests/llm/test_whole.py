"""Places where a training-data operator once did less than the whole job."""

import base64
import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from quillstone.llm import pii, secrets, suffix_dedup, suffixes

from . import brute
from .test_operators import prose

DOCS = "doc_id long, text string"


def run_of(n):
    """n characters of base64 with padding where n asks for it, holding an upper-case letter and a digit."""
    return ("Q7" + base64.b64encode(random.Random(n).randbytes(n)).decode().replace("=", "x"))[: n - 1] + ("=" if n in (44, 88) else "z")


@pytest.mark.parametrize("n", [20, 32, 40, 43, 44, 64, 86, 88, 1500])
@pytest.mark.parametrize("form", ['"{}"', "'{}'", "secret_access_key={}", "AccountKey: {}", '"signing-key": "{}"'])
def test_weak_secrets_of_all_lengths(spark, n, form):
    hid, run = "access_key_id = ABCD1234", run_of(n)
    told = form.format(run)
    rows = [(1, f"https://db.example.com/x {hid} and {told}"), (2, f"{told} alone"), (3, hid + " word" * 300 + " " + told)]
    got = {r.doc_id: r.linked for r in secrets.scan(spark.createDataFrame(rows, DOCS)).collect()}
    text = rows[0][1]
    assert sorted(x.k for x in got[1]) == ["link_endpoint", "link_id", "link_secret"] and not got[2] and not got[3]
    assert [text[x.s : x.e] for x in got[1] if x.k == "link_secret"] == [run]


def test_what_is_no_weak_secret(spark):
    hid = "access_key_id = ABCD1234 "
    rows = [(i, hid + t) for i, t in enumerate(['"a-plain-lower-case-name"', "some/ordinary/path/with/words", '"Short1"', "key = value", '"twenty words 1 A of prose here in quotes"'])]
    assert not any(r.linked for r in secrets.scan(spark.createDataFrame(rows, DOCS)).collect())


@pytest.fixture(scope="module")
def field():
    r = random.Random(8)
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    return pii.train([f"{prose(20, k)} mail{number(2)}@x{k}.example.com {prose(5, k)} +1 ({number(3)}) 555-{number(4)} {prose(9, k + 1)} 10.{k}.3.{k} {number(3)} {number(6)} {prose(4, k)}" for k in range(80)])


@pytest.mark.parametrize(
    "told,again",
    [
        ("+44 20 7946 0958", "020 7946 0958"), ("+44 20 7946 0958", "02079460958"), ("+44 20 7946 0958", "20-7946-0958"), ("+1 (415) 555-0100", "415 555-0100"), ("+1 (415) 555-0100", "(415) 555-0100"),
        ("+1 415 555 0100", "415.555.0100"), ("+49 30 12 34 56 78", "030 12 34 56 78"), ("+33 1 23 45 67 89", "01 23 45 67 89"), ("+1 (017) 555-7713", "555-7713"),
    ],
)
@pytest.mark.parametrize("around", ["call {} or later {} again", "call {} or 12 {} 34 again", "in 2021 {}, then {}."])
def test_spaced_numbers(field, told, again, around):
    text = around.format(told, again)
    base = pii.base_spans(text)
    spans, numbers, _ = pii.nodes(text, base)
    label = pii.labels_of(spans, base)
    said = [text[s:e] for s, e in spans]
    assert [text[s:e] for s, e in base[3]] == [told] and (said.index(again), said.index(told)) in pii.edges(text, spans, numbers, label)[1]
    if "12 {} 34" not in around and "." not in again:  # numbers beside it, or dots, may speak against a phone
        assert [[text[s:e] for s, e in x] for x in field.added(text, base)] == [[], [], [], [again]]


def test_other_numbers_stay_apart(field):
    text = "call +44 20 7946 0958 or 4155550100 4155550101 and 12 34 56 78 90 12 or 020 7946 0959"
    assert not any(field.added(text, pii.base_spans(text)))
    base = pii.base_spans(text)
    assert [text[s:e] for s, e in pii.nodes(text, base)[0]][:4] == ["+44 20 7946 0958", "4155550100", "4155550101", "12"]


@pytest.mark.parametrize("root,default,path", [("file:///a/b", None, "/a/b"), ("file:/a/b", "hdfs://n", "/a/b"), ("/a/b", "file:///", "/a/b"), ("/a/b", "hdfs://n:8020", None), ("hdfs://n/a", "file:///", None), ("file://host/a", None, None), ("file:////a", None, None)])
def test_mounted(root, default, path):
    assert suffix_dedup.mounted(root, default) == path


def test_shards_are_streamed(tmp_path, monkeypatch):
    """Segments beyond the bound go to a file while they arrive, one that comes again counts once, and the flags are those of a shard in memory."""
    r = random.Random(3)
    segs = [bytes(r.choice(b"abcdefgh ") for _ in range(400)) for _ in range(40)]
    segs += [s[50:200] + b"tail" * 30 for s in segs[:9]] + segs[:5]
    batches = [pa.RecordBatch.from_arrays([pa.array([s[:32] for s in part], pa.binary()), pa.array(part, pa.binary())], names=["sh", "seg"]) for part in (segs[:25], segs[25:])]
    inside = [b.to_pylist() for b in suffix_dedup._sorted_shard(50, None)(iter(batches))]
    monkeypatch.setattr(suffix_dedup, "SORT_MEMORY", 3_000)
    sizes, gathered = [], suffixes.Scratch.gathered
    monkeypatch.setattr(suffixes.Scratch, "gathered", lambda self, x: sizes.append(type(y := gathered(self, x))) or y)
    assert [b.to_pylist() for b in suffix_dedup._sorted_shard(50, str(tmp_path))(iter(batches))] == inside and sizes == [np.memmap]
    assert sum(map(len, inside)) >= 18 and not list(tmp_path.iterdir())
    assert not list(suffix_dedup._sorted_shard(50, None)(iter([batches[0].slice(0, 0)])))


def test_grams_of_common_hashes_make_no_rows(spark):
    """Which grams a common hash's segments share is found without a row for each gram of each segment."""
    passage = prose(45, 8000)
    t = [f"{prose(60, 8100 + i)} {passage} {prose(60, 8300 + i)}" for i in range(80)]
    store = spark._jsparkSession.sharedState().statusStore()
    began = store.executionsCount()
    removed = {r.doc_id: r.n_removed for r in suffix_dedup.repeated_spans(spark.createDataFrame(list(enumerate(t)), DOCS), hot=8).collect()}
    assert removed == {i: sum(m) for i, m in enumerate(brute.removed(t, 400)[1])}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    made = 0
    runs = store.executionsList()
    for k in range(began, runs.size()):
        run = runs.apply(k).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if node.name() == "Generate":
                for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        made += int(values.apply(m.accumulatorId()).replace(",", ""))
    assert made < 80 * 64  # and a segment has some 400 grams or more


def test_shared_grams():
    """Segments of a hash that come in several batches are counted together, those of the next hash apart."""
    a, b, c = (prose(30, 8500 + i).encode() for i in range(3))
    rows = [(1, a + b), (1, b + c), (1, b + b), (2, a + b), (2, c), (3, a)]
    batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows[i : i + 2]], pa.int64()), pa.array([x for _, x in rows[i : i + 2]], pa.binary())], names=["key", "text"]) for i in (0, 2, 4)]
    got = sorted((r["gram"], r["n"]) for x in suffix_dedup._shared_grams(16, 2)(iter(batches)) for r in x.to_pylist())
    want = []
    for key in (1, 2, 3):
        texts = [x for k, x in rows if k == key]
        count = collections.Counter(g for x in texts for g in {x[i : i + 16] for i in range(len(x) - 15)})
        want += [(int(suffix_dedup.gram_hashes(np.frombuffer(g, np.uint8), 16)[0] >> np.uint64(1)), n) for g, n in count.items() if n >= 2]
    assert got == sorted(want) and got
