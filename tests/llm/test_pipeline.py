"""The pipeline's stages against plain versions over sf0.001, and awkward rows through all of them."""

import hashlib

import corpus_pipeline as p
from gramforge.llm import toxicity
from gramforge.llm.common import written
from tests.llm.conftest import AWKWARD
from tests.llm.test_pairs import dedup_rows, jaccard_rows

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(p.STAGES)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}

    one = written(stages["toxicity"](spark, docs, SF), "t")
    left = {r.doc_id for r in one.collect()}
    gone = {r.doc_id for r in docs.collect()} - left
    assert one.columns == docs.columns
    assert sum(labels.get(i) == 0 for i in gone) <= 1 and all(labels[i] != 1 or i in gone for i in labels if i in left | gone) or sum(labels.get(i) == 1 for i in left) <= 1

    two = written(stages["near_copies"](spark, one, SF), "t")
    want = {i for i, _, c in jaccard_rows([(r.doc_id, r.text) for r in one.collect()]) if i == c}
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == want

    three = written(stages["repeats"](spark, two, SF), "t")
    plain = {i: x for i, *x in dedup_rows([(r.doc_id, r.text) for r in two.collect()])}
    assert three.columns == docs.columns
    assert {r.doc_id for r in three.collect()} == {i for i, (n, removed, _) in plain.items() if removed == 0 or removed < n}
    source = {r.doc_id: r for r in two.collect()}
    for r in three.collect():
        n, removed, digest = plain[r.doc_id]
        assert hashlib.sha256(b" ".join(r.text.encode().split())).hexdigest() == digest
        assert (r.text == source[r.doc_id].text) == (removed == 0) or removed
        assert r.n_chars == len(r.text) and (r.lang, r.source) == (source[r.doc_id].lang, source[r.doc_id].source)

    four = written(stages["mixing"](spark, three, SF), "t")
    assert four.columns == docs.columns
    assert {r.doc_id for r in four.collect()} <= {r.doc_id for r in three.collect()}

    five = stages["encoding"](spark, four, SF).collect()
    texts = {r.doc_id: r.text for r in four.collect()}
    assert len(five) == four.count() and all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in five)
    assert sorted((r.doc_id, r.ids_sha256) for r in five) == sorted((r.doc_id, r.ids_sha256) for r in p.run(spark, SF).collect())


def test_awkward(spark, awkward, no_documents):
    for docs in (awkward, no_documents):
        rows = docs
        for name, stage in p.STAGES[:-1]:
            rows = written(stage(spark, rows, SF), "t")
            assert rows.columns == docs.columns, name
        out = p.STAGES[-1][1](spark, rows, SF)
        assert out.count() == rows.count() <= 2 * len(AWKWARD)


def test_near_copies_of_null_and_repeated_ids(spark):
    """One row of each group stays, and no other row goes with it."""
    words = lambda k: " ".join(f"g{k}w{i}" for i in range(30))
    rows = [(1, words(0)), (1, words(0)), (None, words(0) + " end"), (None, words(1)), (None, words(1)), (2, words(0) + " end"), (2, words(2)), (7, words(3)), (6, words(3)), (None, words(3)), (8, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r.doc_id or -1, r.text or "") for r in dict(p.STAGES)["near_copies"](spark, docs, SF).collect()))
    assert got == sorted([(1, words(0)), (-1, words(1)), (2, words(2)), (6, words(3)), (8, ""), (-1, "")])


def test_model_for_nothing():
    assert len(toxicity.Scorer(toxicity.fit([])).scores(["a b", ""])) == 2
