"""Near-dedup of the pipeline keeps one row of each component, whatever doc_ids repeat or lack."""

import random

import corpus_pipeline


def story(seed):
    draw = random.Random(seed)
    return " ".join(draw.choice("abcdefghij") + str(draw.randrange(1000)) for _ in range(60))


def test_one_row_of_each_component(spark):
    a, b, c, d, e, f = map(story, range(6))
    rows = [(None, a, "p"), (None, b, "p"), (None, b, "p"), (None, c, "p"), (9, c, "p"), (3, d, "p"), (5, d, "p"), (5, e, "p"), (5, f, "p"), (5, f, "q"), (None, None, "x"), (None, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for many in (docs, docs.repartition(7).unionByName(docs)):
        kept = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, many, "").collect()]
        assert sorted((i or 0, t or "") for i, t, _ in kept) == sorted([(0, a), (0, b), (9, c), (3, d), (5, e), (5, f), (0, "")])
    assert sorted(map(repr, kept)) == sorted(repr(tuple(r)) for r in corpus_pipeline.drop_near_duplicates(spark, docs.orderBy("source"), "").collect())


def test_columns_that_have_no_hash(spark):
    docs = spark.createDataFrame([(None, story(0), {"k": 1}), (None, story(1), {"k": 2}), (None, story(1), {"k": 2})], "doc_id long, text string, more map<string,int>")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r["text"], r["more"]["k"]) for r in kept) == sorted([(story(0), 1), (story(1), 2)])


def test_edited_copies_go(spark):
    """Of texts in which a few words are changed nine in ten go at least; texts that share half of their shingles stay."""
    draw, rows = random.Random(7), []
    word = lambda: draw.choice("abcdefghij") + str(draw.randrange(1000))
    for g in range(40):
        words = [word() for _ in range(draw.randint(80, 400))]
        rows.append((100 * g, " ".join(words), "a"))
        for k in range(1, 6):
            edited = list(words)
            for _ in range(max(1, len(words) // 100)):
                edited[draw.randrange(len(words))] = word()
            rows.append((100 * g + k, " ".join(edited), "b"))
        half = words[: len(words) // 2] + [word() for _ in range(len(words) // 2)]
        rows.append((100 * g + 50, " ".join(half), "c"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [r["source"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert kept.count("a") == kept.count("c") == 40 and kept.count("b") <= 20


def test_a_repeated_doc_id_loses_no_text(spark):
    docs = spark.createDataFrame([(1, story(k), "s") for k in range(20)] + [(None, story(k), "s") for k in range(20, 40)], "doc_id long, text string, source string")
    for name, stage in corpus_pipeline.STAGES[1:2] + corpus_pipeline.STAGES[4:]:
        out = stage(spark, docs, "").collect()
        assert {r["text"] for r in out} == {story(k) for k in range(40)}, name
