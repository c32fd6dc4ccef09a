"""The pipeline and its stages against plain versions on planted cases, and the queries' names."""

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from quillstone.llm import common, packing, quality
from tests.llm import brute
from tests.llm.test_operators import ITEMS, bags, edited, prose

COLS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t) for i, t, _ in bags(240, 9)]
    base = prose(150, 4242)
    rows += [(1000 + k, edited(base, 1, k)) for k in range(5)] + [(1100, prose(40, 1) + " " + ITEMS[0][1]), (1101, prose(60, 2) + " token = abcdef123456 " + prose(20, 3)), (1102, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, _, q in bags(240, 9)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(ITEMS[:2], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    (_, classify), (_, join), (_, decontaminate), (_, scan), (_, pack) = corpus_pipeline.STAGES
    kept = classify(spark, docs, folder)
    assert kept.columns == COLS
    truth = {i: q for i, _, q in bags(240, 9)}
    ids = {r.doc_id for r in kept.collect()}
    assert sum(truth[i] == 1 for i in truth if i in ids) >= 0.97 * sum(truth.values())
    assert sum(truth[i] == 0 for i in truth if i in ids) <= 0.1 * sum(q == 0 for q in truth.values())
    one = join(spark, docs, folder)
    rows = {r.doc_id: r.text for r in docs.collect()}
    order = sorted(rows)
    comp = brute.components([brute.shingle_set(rows[i]) for i in order])
    assert sorted(r.doc_id for r in one.collect()) == sorted({order[c] for c in comp}) and one.columns == COLS
    clean = decontaminate(spark, docs, folder)
    assert {r.doc_id for r in clean.collect()} == {i for i, t in rows.items() if not brute.hits(t, ITEMS[:2])[1]} and clean.columns == COLS
    safe = {r.doc_id: r for r in scan(spark, docs, folder).collect()}
    assert set(safe) == set(rows) and "abcdef123456" not in safe[1101].text and safe[1101].n_chars == len(safe[1101].text)
    assert all(safe[i].text == t for i, t in rows.items() if not brute.secrets(t))
    pieces = pack(spark, docs, folder)
    assert pieces.select("doc_id").distinct().count() == len(rows)


def hash_of(word):
    buf = np.frombuffer(word, np.uint8)
    return int(common.word_hashes(buf, np.array([0]), np.array([len(word)]), common.BYTE_HASH)[0])


def test_scores(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert set(got) == set(texts) and all(abs(got[i] - brute.quality_score(t, model, hash_of)) < 1e-9 for i, t in texts.items())


def test_run(spark, folder):
    """All stages one after another, against plain versions of each; the ids of a document's pieces spell its text."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    left = {r.doc_id: r.text for r in docs.collect() if brute.quality_score(r.text, model, hash_of) >= quality.THRESHOLD}
    order = sorted(left)
    first = brute.components([brute.shingle_set(left[i]) for i in order])
    left = {order[k]: left[order[k]] for k in sorted(set(first))}
    left = {i: brute.redacted(t) for i, t in left.items() if not brute.hits(t, ITEMS[:2])[1]}
    tok, got = Tokenizer.from_file(packing.tokenizer_path()), {}
    for r in corpus_pipeline.run(spark, folder).collect():
        got.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    assert {i: sum((x for _, x in sorted(p)), []) for i, p in got.items()} == {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in left.items()}
    assert 1100 not in got and 1101 in got and len(set(got) & set(range(1000, 1005))) == 1


def test_stages_keep_all_columns(spark, folder):
    """Columns named as what an operator makes pass through every stage but the last."""
    more = ["base", "weak", "row_id", "row", "score", "passage_weights", "items", "n_hit", "uid", "digest", "keeper", "spans", "linked", "number"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id >= 1000")
    for c in more:
        docs = docs.selectExpr("*", f"concat('{c}', doc_id) as {c}")
    for _, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, folder)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in more)


def test_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in __spark_entry__.queries()


