"""Parts of the operators against brute force."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, exactdedup, html, langid, pii, simhash
from tidemark.llm.components import components


def test_link_and_trees_find_what_all_pairs_join(spark):
    draw = np.random.default_rng(3)
    centres = draw.integers(0, 2**64, 60, dtype=np.uint64)
    flips = np.uint64(1) << draw.integers(0, 64, (60, 12, 3), dtype=np.uint64)
    chain = [centres[0]]
    for k in range(0, 40, 2):
        chain.append(chain[-1] ^ np.uint64(3 << k))
    values = np.unique(np.concatenate([centres, np.bitwise_xor.reduce(np.tile(centres[:, None, None], (1, 12, 3)) ^ flips, axis=2).ravel(), (centres[:, None] ^ flips[:, :, 0]).ravel(), np.array(chain, np.uint64)]))
    near, label = np.bitwise_count(values[:, None] ^ values[None]) <= 3, np.arange(len(values))
    while not np.array_equal(new := np.array([label[near[k]].min() for k in range(len(values))]), label):
        label = new
    fps = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    edges = simhash.near_edges(fps, leaf_rows=40, stored_rows=16, query_rows=32)
    roots = {}
    for node, root in components(edges).collect():
        roots.setdefault(root, set()).add(node)
    signed = values.view(np.int64).tolist()
    want = {}
    for k, v in enumerate(signed):
        want.setdefault(label[k], set()).add(v)
    assert sorted(map(sorted, roots.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_tree_routes_to_all_leaves_within_the_radius():
    draw = np.random.default_rng(1)
    values = draw.integers(0, 2**32, 3000, dtype=np.uint64).astype(np.uint32)
    tree = simhash.Tree(values[:800], 32, 1)
    assert tree.leaves >= 16
    seen, homes = set(), []
    for index, leaf, home in tree.route(values):
        seen |= {(int(k), leaf) for k in index}
        homes += index[home].tolist()
    assert sorted(homes) == list(range(len(values)))
    for k in range(200):
        around = values[k] ^ (np.uint32(1) << np.arange(32, dtype=np.uint32))
        for _, leaf, home in tree.route(around):
            assert not home.any() or (k, leaf) in seen


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 50)] + [(100, 101), (101, 102), (5, 5)], [(k, (k * 7) % 41) for k in range(41)] + [(-9, 7)]])
def test_components(spark, edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted([root(a), root(b)])
            parent[high] = low
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: root(x) for x in list(parent)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=30), min_size=1, max_size=6), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=5), min_size=1, max_size=6))
def test_index_counts_and_locates(fragments, phrases):
    starts = np.concatenate([[0], np.cumsum([len(f) for f in fragments])[:-1]])
    fm = decontaminate.FMIndex(np.concatenate(fragments).astype(np.int64), starts, 4)
    rows = np.zeros((len(phrases), 5), np.int64)
    for k, p in enumerate(phrases):
        rows[k, 5 - len(p) :] = p
    low, high = fm.search(rows)
    for k, p in enumerate(phrases):
        want = sorted(int(s) + i for s, f in zip(starts, fragments) for i in range(len(f) - len(p) + 1) if f[i : i + len(p)] == p)
        assert sorted(fm.locate(np.arange(low[k], high[k])).tolist()) == want


def test_scan_in_blocks_is_the_scan_in_one():
    draw = random.Random(2)
    docs = [[b"%d" % draw.randrange(5) for _ in range(draw.randrange(60))] for _ in range(30)]
    items = [(str(k), [b"%d" % draw.randrange(5) for _ in range(draw.randint(1, 6))]) for k in range(12)]

    def group(*parts):
        vocabulary = {}
        blocks = [decontaminate.Phrases(p, vocabulary, 4) for p in parts]
        return vocabulary, min(b.shortest for b in blocks), blocks

    whole = list(decontaminate.scan(docs, [group(items)], 4))
    assert whole == list(decontaminate.scan(docs, [group(items[:5], items[5:])], 4))
    assert whole == list(decontaminate.scan(docs, [group(items[:5]), group(items[5:])], 4))
    for doc, (spans, names) in zip(docs, whole):
        hit, want = set(), set()
        for name, ws in items:
            for w in ([ws[k : k + 4] for k in range(len(ws) - 3)] if len(ws) >= 4 else [ws]):
                for k in range(len(doc) - len(w) + 1):
                    if doc[k : k + len(w)] == w:
                        hit |= set(range(k, k + len(w)))
                        want.add(name)
        assert {i for a, b in spans for i in range(a, b)} == hit and names == sorted(want)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_binary_fuse_filter():
    for n in (0, 1, 2, 3, 17, 1000, 30_000):
        keys = np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64)
        made = exactdedup.BinaryFuseFilter.from_bytes(exactdedup.BinaryFuseFilter.build(keys).to_bytes())
        assert made.contains(keys).all()
        assert made.contains(np.random.default_rng(n + 1).integers(0, 2**64, 20_000, dtype=np.uint64)).mean() < 0.02


def test_exact_dedup_by_shuffles_agrees(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    some = lambda **k: sorted(exactdedup.exact_duplicates(docs, F.pmod("doc_id", F.lit(3)), 3, **k).collect())
    assert some() == some(filter_keys=10, broadcast_digests=0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14), st.sampled_from([8, 1 << 26]))
def test_lcs(a, b, cells):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    chosen = html.lcs(a, b, cells)
    there = iter(b)
    assert chosen == sorted(set(chosen)) and len(chosen) == table[-1][-1] and all(a[k] in there for k in chosen)


def test_page_lines():
    page = '<title>x</title><body><header>Top</header><p>A &lt;b&gt;<br>c<p><b>Q</b><div class="ad box">buy</div><ul id=sideBar><li>s</ul><article><header><h1>T</h1></header><p>x<script>var t="</p>";</script>y<form>f</form></article><footer>f'
    kept = [(text, article) for text, shown, article, _ in html.page_lines(page) if shown]
    assert kept == [("A <b> c", False), ("Q", False), ("T", True), ("xy", True)]
    page = '<body class="has-sidebar comments-open"><div class="content with-sidebar"><div class=menu>m</div><article><p>one <span class="ad">AD</span>two <button>Share</button></p><div class="share">s</div></article><section class="comments"><article class="c"><p>reader</p></article></section></div>'
    assert [text for text, shown, *_ in html.page_lines(page) if shown] == ["one two"]
    assert html.page_lines(None) == [] and html.page_lines("<p") == [("<p", True, False, False)]


def test_pages_of_one_host_are_cut_and_neighbours_found(spark):
    pages = spark.createDataFrame([(k, f"http://h.x/{'a' if k < 60 else 'same'}/{k if k < 60 else 0}", f"<div>Frame</div><p>story {k} is told here</p><div>End of frame</div>") for k in range(120)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(pages, group_rows=10).collect()}
    assert got == {k: f"story {k} is told here" for k in range(120)}


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "ro\nle", "[INST]", ""]), st.text(alphabet="ab\\\n<|>[]/INSTturnends_im", max_size=30) | st.sampled_from(chat.CONTROL)), max_size=6))
def test_template_reads_back(turns):
    out = "".join(chat.render(r, t)[0] for r, t in turns)
    assert chat.read_back(out) == turns
    for role, text in turns:
        rendered, start, end = chat.render(role, text)
        assert not any(c in rendered[len(chat.START) : -len(chat.END) - 1] for c in chat.CONTROL)
        assert chat.unescape(rendered[start:end]) == (text if role == "assistant" else "")


def test_events_fold(spark):
    log = [(1, 1, 0, "delta", "user", "Hel"), (1, 1, 1, "delta", None, "lo"), (1, 2, 2, "delta", "assistant", "first"), (1, 2, 4, "delta", None, " answer"), (1, 2, 3, "regenerate", None, None), (1, 1, 5, "edit", None, "Hello!"), (1, 1, 6, "delta", None, "?"), (2, 1, 0, "edit", "user", None), (None, 1, 0, "what", None, "x")]
    rows = chat.fold_events(spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, text string")).collect()
    assert {(r["conv_id"], r["message"]): (r["role"], r["text"]) for r in rows} == {(1, 1): ("user", "Hello!?"), (1, 2): ("assistant", " answer"), (2, 1): ("user", ""), (None, 1): ("", "x")}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a1+.-@ ()%_é", max_size=40))
def test_rules_are_the_plain_expressions(text):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    got = pii.base_spans(text)
    assert got["email"] == [m.span() for m in re.finditer(plain["email"], text)]
    assert got["ip"] == [m.span() for m in re.finditer(plain["ip"], text) if all(int(p) <= 255 for p in m.group().split("."))]
    assert got["phone"] == [m.span() for m in re.finditer(plain["phone"], text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_field_adds_what_rules_miss(spark):
    field = pii.fit(pii.labelled_table(spark))
    finder = pii.Finder(field)
    texts = ["call (319) 555-5132 now", "write anna [at] example [dot] com please", "at 10[.]0[.]3[.]7 today", "pay 4111.1111.1111.1111 here", "mail x@y.org and +1 (319) 555-5132", "in 2024 we sold 12,500 of v1.2.3 (see 4)", "password=f2f5acd241f026fd29 token", "plain words only"]
    spans = [[(k, t[a:b]) for k, found in every.items() for a, b in found] for t, (_, every) in zip(texts, finder.spans(texts))]
    assert spans == [[("phone", "(319) 555-5132")], [("email", "anna [at] example [dot] com")], [("ip", "10[.]0[.]3[.]7")], [("card", "4111.1111.1111.1111")], [("email", "x@y.org"), ("phone", "+1 (319) 555-5132")], [], [], []]
    # Runs around marked tokens give what decoding all tokens gives.
    finder.certain = not finder.certain
    assert spans == [[(k, t[a:b]) for k, found in every.items() for a, b in found] for t, (_, every) in zip(texts, finder.spans(texts))]


def test_viterbi_is_the_best_path():
    draw, n = np.random.default_rng(0), len(pii.TAGS)
    scores, transitions, lengths = draw.normal(size=(20, 4, n)), draw.normal(size=(n, n)), draw.integers(1, 5, 20)
    import itertools

    value = lambda s, path: sum(s[k, t] for k, t in enumerate(path)) + sum(transitions[a, b] for a, b in zip((0, *path), (*path, 0)))
    for s, length, tags in zip(scores, lengths, pii.viterbi(scores, lengths, transitions)):
        best = max(itertools.product(range(n), repeat=int(length)), key=lambda p: value(s, p))
        assert tuple(tags[:length]) == best


def test_ngrams_in_chunks(monkeypatch):
    text = "Abc dé 12 fgh! ijk  lm" * 30
    whole = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "CHUNK", 7)
    assert np.array_equal(langid.ngram_counts(text), whole)
    assert langid.ngram_counts("123 !") is None and langid.ngram_counts("") is None and langid.ngram_counts(None) is None


def test_temperature():
    draw = np.random.default_rng(0)
    logits = draw.normal(size=(4000, 3))
    targets = np.array([draw.choice(3, p=p) for p in langid._softmax(logits)])
    assert 0.8 < langid.fit_temperature(logits, targets) < 1.25
    assert 2.4 < langid.fit_temperature(3 * logits, targets) < 3.75


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1(" * 100_000, "a@" * 150_000, "1 " * 150_000):
        pii.base_spans(text)
    html.page_lines("<div>" * 3000 + "x" + "<p>y" * 20_000)


def test_benchmark_in_blocks_and_vocabularies(spark):
    items = spark.createDataFrame([(k, f"a{k} b c{k} d e{k % 3}") for k in range(30)] + [(99, None), (None, "x y")], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"z a{k} b c{k} d e{k % 3} x y") for k in range(40)], "doc_id long, text string")
    whole = sorted(map(tuple, decontaminate.find_contamination(docs, items, 3).collect()))
    for sizes in ({"block_words": 7}, {"block_words": 7, "most_words": 20}):
        groups = decontaminate.benchmark_groups(spark, items, 3, **sizes)
        assert sum(len(b) for _, _, b in groups) > 10 and (len(groups) > 1) == ("most_words" in sizes)
        found = decontaminate.scan([decontaminate.words(f"z a{k} b c{k} d e{k % 3} x y") for k in range(40)], [(v.value, s, [b.value for b in bs]) for v, s, bs in groups], 3)
        assert [([tuple(h) for h in r[3]], r[4]) for r in whole] == list(found)


def test_ftrl_is_the_plain_rule():
    """Weights against the rule applied to one number at a time."""
    draw = np.random.default_rng(5)
    rows = []
    for _ in range(12):
        index = np.sort(draw.choice(40, 6, replace=False))
        rows.append((index, draw.random(6), int(draw.integers(3))))
    alpha, beta, l1, l2 = 2.0, 1.0, 0.02, 0.01
    z, n = {}, {}

    def weight(i, c):
        a, penalty = z.get((i, c), 0.0), 0.0 if i == langid.FEATURES else l1
        return 0.0 if abs(a) <= penalty else -(a - np.sign(a) * penalty) / ((beta + n.get((i, c), 0.0) ** 0.5) / alpha + l2)

    order = np.random.default_rng(0)
    for _ in range(4):
        for k in order.permutation(len(rows)):
            index, values, target = rows[k]
            at = [*zip(index.tolist(), values.tolist()), (langid.FEATURES, 0.1)]
            now = {(i, c): weight(i, c) for i, _ in at for c in range(3)}
            scores = [sum(x * now[i, c] for i, x in at) for c in range(3)]
            total = sum(np.exp(s) for s in scores)
            for i, x in at:
                for c in range(3):
                    g = x * (np.exp(scores[c]) / total - (c == target))
                    before = n.get((i, c), 0.0)
                    z[i, c] = z.get((i, c), 0.0) + g - ((before + g * g) ** 0.5 - before**0.5) / alpha * now[i, c]
                    n[i, c] = before + g * g
    weights, bias = langid.fit_ftrl(rows, 3)
    assert np.allclose(bias, [0.1 * weight(langid.FEATURES, c) for c in range(3)])
    assert np.allclose(weights[:40], [[weight(i, c) for c in range(3)] for i in range(40)], atol=1e-6) and (weights[:40] != 0).any()


def test_ngrams_are_the_plain_ones():
    text, mask = "Ab Ç1b  a", (1 << 32) - 1
    letters = "".join(c.lower() if c.isalpha() else " " for c in text)
    plain = re.sub(" +", " ", f" {letters} ")
    want = np.zeros(langid.FEATURES, np.int64)
    for n in langid.ORDERS:
        for k in range(len(plain) - n + 1):
            h = 0
            for c in plain[k : k + n]:
                h = (h * 0x01000193 + ord(c)) & mask
            want[((h ^ n) * 0x9E3779B1 & mask) >> 17] += 1
    assert np.array_equal(langid.ngram_counts(text), want)


def test_a_sample_of_rows_that_repeat(spark):
    rows = [(1, "the same words again", "en")] * 500 + [(None, f"les mots {chr(97 + k % 26)} du jour {chr(97 + k // 26)}", "fr") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = langid.train(docs), langid.train(docs.repartition(7).orderBy(F.rand(3)))
    assert np.array_equal(one.weights, two.weights) and one.temperature == two.temperature


def test_logs_of_turns_fold_back(spark):
    """Against a fold in plain Python; the log holds all kinds of events."""
    turns = [(c, t, ["user", "assistant", None][(c + t) % 3], None if t == 5 else "".join(chr(97 + (c * t + k) % 26) for k in range(c * t * 97 % 1500)) + ("\n😀" if t % 2 else "")) for c in range(12) for t in range(6)]
    log = chat.message_events(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    events = log.collect()
    kinds = [e["kind"] for e in events]
    assert min(kinds.count(k) for k in ("delta", "edit", "regenerate")) > 10 and len(events) > 2 * len(turns)
    plain = {}
    for e in sorted(events, key=lambda e: e["seq"]):
        role, text = plain.get((e["conv_id"], e["message"]["turn"]), ("", ""))
        plain[e["conv_id"], e["message"]["turn"]] = (e["role"] or role, (text if e["kind"] == "delta" else "") + (e["text"] or ""))
    assert plain == {(c, t): (r or "", x or "") for c, t, r, x in turns}
    assert {(r["conv_id"], r["message"]["turn"]): (r["role"], r["text"]) for r in chat.fold_events(log).collect()} == plain


@pytest.mark.parametrize("kind", ["string", "int", "decimal(20,0)", "date"])
def test_conversations_of_any_key(spark, kind):
    turns = spark.createDataFrame([(20000 + k // 3, k % 3, "assistant", f"t{k}") for k in range(12)], "conv_id int, turn long, role string, text string")
    turns = turns.withColumn("conv_id", F.date_from_unix_date("conv_id") if kind == "date" else F.col("conv_id").cast(kind))
    got = chat.conversation_digests(chat.format_messages(chat.fold_events(chat.message_events(turns)))).collect()
    assert len(got) == 4 and {r["n_turns"] for r in got} == {3} and {r["conv_id"] for r in got} == {r["conv_id"] for r in turns.collect()}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_joined_apart(spark, how):
    from tidemark.llm.common import join_hot

    rows = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(7)).otherwise(F.col("id") % 900).alias("k"), F.lit("x").alias("y"), F.col("id"))
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("k <> 11")
    got, plain = join_hot(rows, table, "k", "n", how=how), rows.join(table, "k", how)
    assert got.columns == plain.columns and sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "BroadcastHashJoin" in plan
