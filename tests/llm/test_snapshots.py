"""Stored filters screen batches of later runs."""

from tidemark.llm import exactdedup


def test_a_second_run_is_screened_by_stored_filters(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    known, new = docs.where("doc_id % 3 > 0"), docs.where("doc_id % 3 = 0")
    new = new.unionByName(spark.range(3000).selectExpr("10000 + id AS doc_id", "concat('unseen text ', id) AS text")).unionByName(docs.where("doc_id % 3 = 1").selectExpr("20000 + doc_id AS doc_id", "concat(text, ' ') AS text").limit(20))
    new = new.unionByName(spark.createDataFrame([(30000, None), (30001, ""), (None, "unseen text 5")], "doc_id long, text string"))
    path = str(tmp_path / "snapshot")
    exactdedup.write_snapshot(known, path, filter_keys=20)
    stored = spark.read.parquet(f"{path}/filters").count()
    assert stored > 1
    # The filters alone: let through all that is known, and few others.
    passed = {r[0] for r in exactdedup.screen_batch(new, path).collect()}
    digests = {r[0] for r in spark.read.parquet(f"{path}/digests").select("digest").collect()}
    plain = lambda t: __import__("re").sub("[ \t-\r]+", " ", t or "")
    theirs = {}
    for r in known.collect():
        theirs[plain(r["text"])] = min(r["doc_id"], theirs.get(plain(r["text"]), r["doc_id"]))
    rows = new.collect()
    mine = {plain(r["text"]) for r in rows}
    assert passed & digests and len(passed & digests) == len(mine & set(theirs))
    assert len(passed - digests) <= 0.02 * len(mine)
    # The whole: against plain groups.
    least = {}
    for r in rows:
        if r["doc_id"] is not None:
            least[plain(r["text"])] = min(r["doc_id"], least.get(plain(r["text"]), r["doc_id"]))
    got = exactdedup.later_duplicates(new, path, known).collect()
    assert len(got) == len(rows)
    texts = {r["doc_id"]: plain(r["text"]) for r in rows}
    for r in got:
        text = texts[r["doc_id"]]
        assert r["known"] == (text in theirs) and r["keep_id"] == theirs.get(text, least[text])
        assert r["kept"] == (text not in theirs and r["doc_id"] == least[text])
