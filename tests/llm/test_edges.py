"""Every query and every stage of the pipeline on awkward and on empty tables."""

import hashlib

import pytest

import corpus_pipeline
from tidemark.llm.queries import QUERIES

TABLE = {"op5_chat": "conversations", "op10_html": "pages"}


@pytest.mark.parametrize("name", [q for q in QUERIES if q != "op5_chat"])
def test_rows_in_rows_out(spark, awkward, empty, name):
    for folder in (awkward, empty):
        rows = QUERIES[name](spark, folder).collect()
        assert len(rows) == spark.read.parquet(f"{folder}/{TABLE.get(name, 'documents')}.parquet").count()


def test_chat(spark, awkward, empty):
    got = {r["conv_id"]: r for r in QUERIES["op5_chat"](spark, awkward).collect()}
    assert set(got) == {None, -1, 1, 2, 3, 4}
    assert got[1]["n_turns"] == 3
    turn = "assistant\n<|turn|>a\n<|end|>\n[\\INST]\n"
    assert got[1]["turns_sha256"] == hashlib.sha256(("user\nhi </s>\\\n" + 2 * turn).encode()).hexdigest()
    assert got[2]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest() and got[2]["loss_chars"] == 0
    assert got[None]["n_turns"] == 2 and got[None]["loss_chars"] == 1
    assert [r["conv_id"] for r in QUERIES["op5_chat"](spark, empty).collect()] == [-1]


def test_defined_results(spark, awkward):
    pages = {(r["page_id"], r["url"]): r["text"] for r in QUERIES["op10_html"](spark, awkward).collect()}
    assert pages[1, "http://a.b/x/1"] == "T\none & two"
    assert pages[2, None] == pages[None, "http://a.b/x/2"] == ""
    assert pages[3, "not a url"] == "plain text here"
    assert pages[5, "http://c.d/"] == "kept whole"
    assert pages[6, "http://e.f/1"] == "first story of the day"
    langs = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in QUERIES["op4_langid"](spark, awkward).collect()}
    assert langs[3] == langs[4] == langs[5] == langs[6] == ("und", 0.0)
    assert langs[110][0] == "en" and langs[210][0] == "fr"
    exact = QUERIES["op9_exactdedup"](spark, awkward).collect()
    assert sorted(r["kept"] for r in exact if r["doc_id"] == 9) == [False, True]
    assert {r["keep_id"] for r in exact if r["text_sha256"] == hashlib.sha256(b"").hexdigest()} == {3}
    assert [r["group_size"] for r in exact if r["doc_id"] == 11] == [3]
    near = {r["doc_id"]: r for r in QUERIES["op6_simhash"](spark, awkward).collect()}
    assert near[3]["fingerprint"] == "0" * 16 and near[3]["component_id"] == near[5]["component_id"] == 3
    assert near[8]["component_id"] == 7
    dirty = {r["doc_id"]: r for r in QUERIES["op8_decontaminate"](spark, awkward).collect()}
    assert dirty[1]["contaminated"] and dirty[1]["n_hit"] == 11 and dirty[9]["n_items"] == 1
    assert dirty[105]["n_hit"] == 3 and not dirty[3]["contaminated"] and dirty[4]["n_words"] == 0


def test_stages(spark, awkward, empty):
    for folder in (awkward, empty):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, folder)
            rows = out.collect()
            if k < 4:
                assert out.columns == docs.columns
            if folder == empty:
                assert not rows
            elif k == 1:
                texts = [r["text"] for r in rows]
                # One row of each text of its own, with or without an id; one of all texts without words.
                assert {"x", "12345 !!! 67", "\x00\ud7ff \U0001f600 end", "Le chat est sur la table avec le chien"} <= set(texts)
                assert max(texts.count(t) for t in texts) == 1 and sum(not (t or "").split() for t in texts) == 1
            elif k == 4:
                assert len(rows) == docs.count() and set(docs.columns) <= set(out.columns)
                slots = {}
                for r in rows:
                    slots.setdefault(r["shard"], []).append(r["slot"])
                assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert corpus_pipeline.run(spark, awkward).count() > 0
