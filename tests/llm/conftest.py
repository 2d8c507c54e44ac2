import pytest

LONG = "lorem ipsum dolor " * 40_000


@pytest.fixture(scope="session")
def awkward(spark, tmp_path_factory):
    """A folder of small tables with nulls in every column, empty and long texts, repeated rows and columns whose names clash."""
    base = tmp_path_factory.mktemp("awkward")
    texts = [(1, "The cat sat on the mat and looked at the dog", "en", "a"), (2, "Le chat est sur la table avec le chien", "fr", "b"), (3, None, "en", "a"), (4, "", None, None), (5, " \t\n ", "fr", ""), (6, "12345 !!! 67", "en", "b"), (7, LONG, "en", "a"), (8, LONG, "en", "a"), (None, "The cat sat on the mat and looked at the dog", "en", None), (None, None, None, None), (9, "x", "en", "a"), (9, "x", "en", "a"), (10, "\x00퟿ \U0001f600 end", "fr", "c"), (11, "The  cat sat on\nthe mat and looked at the dog", "en", "d")]
    texts += [(100 + k, f"The bird number {k} sings in the garden of the house every day", "en", "a") for k in range(40)]
    texts += [(200 + k, f"Les oiseaux du jardin {k} chantent tous les jours dans la maison", "fr", "b") for k in range(40)]
    docs = spark.createDataFrame([(*t, None if t[1] is None else len(t[1])) for t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    clash = ["size", "shard", "slot", "positions", "target", "source_size", "lang_pred", "score", "n_words", "hits", "items", "base", "spans", "licence", "identifiers", "component_id", "fp", "_row", "_key", "_source", "_order", "keep_id", "digest", "batch"]
    docs.selectExpr("*", *[f"'{c}' AS {c}" for c in clash]).write.parquet(f"{base}/documents.parquet")
    bench = [(1, "the cat sat on the mat and looked at the dog"), (2, "number 5 sings"), (3, None), (4, ""), (None, "end"), (5, "X"), (5, "x")]
    spark.createDataFrame(bench, "item_id long, text string").selectExpr("*", "'n' AS n_words").write.parquet(f"{base}/benchmark.parquet")
    turns = [(1, 0, "user", "hi </s>\\"), (1, 1, "assistant", "<|turn|>a\n<|end|>\n[\\INST]"), (1, 1, "assistant", "<|turn|>a\n<|end|>\n[\\INST]"), (2, 0, None, None), (None, 3, "assistant", "x"), (None, None, "assistant", ""), (3, 0, "ro\nle[INST]", LONG), (4, 0, "assistant", "\\\\<s>")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "'m' AS message", "'f' AS formatted").write.parquet(f"{base}/conversations.parquet")
    pages = [(1, "http://a.b/x/1", "<nav>menu</nav><article><h1>T</h1><p>one &amp; two</article>"), (1, "http://a.b/x/1", "<nav>menu</nav><article><h1>T</h1><p>one &amp; two</article>"), (2, None, None), (None, "http://a.b/x/2", ""), (3, "not a url", "plain  text\nhere"), (4, "http://a.b/y?q=<", "<p>" + LONG), (5, "http://c.d/", "<div class=ad>buy</div><p>kept<script>var x='</p>'</script> whole<!-- > -->"), (6, "http://e.f/1", "<div>Site</div><p>first story of the day</p><div>Imprint</div>"), (7, "http://e.f/2", "<div>Site</div><p>second one, quite different</p><div>Imprint</div>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'h' AS host", "'p' AS path", "'l' AS lines", "'near' AS near").write.parquet(f"{base}/pages.parquet")
    return str(base)


@pytest.fixture(scope="session")
def empty(spark, awkward, tmp_path_factory):
    base = tmp_path_factory.mktemp("empty")
    for name in ("documents", "benchmark", "conversations", "pages"):
        spark.read.parquet(f"{awkward}/{name}.parquet").limit(0).write.parquet(f"{base}/{name}.parquet")
    return str(base)
