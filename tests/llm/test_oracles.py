"""Queries against their SQL, or against brute force, over a whole small scale."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
import xxhash

from tidemark.llm.queries import ORACLES, QUERIES

TABLES = ("documents", "benchmark", "pages", "conversations", "labels")


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, sf_dir, con, name):
    got = QUERIES[name](spark, sf_dir)
    want = con.sql(ORACLES[name])
    names = sorted(got.columns)
    assert sorted(want.columns) == names
    order = [want.columns.index(c) for c in names]
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(repr, (tuple(r[k] for k in order) for r in want.fetchall())))


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def test_pii(spark, sf_dir, con):
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(digits):
        doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
        return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0

    def holds(kind, text):
        digits = re.sub("[^0-9]", "", text)
        return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in text.split(".")), "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()

    texts = dict(con.sql("SELECT doc_id, text FROM documents").fetchall())
    for r in QUERIES["op1_pii"](spark, sf_dir).collect():
        base = [f"{kind}:{m.start()}:{m.end()}" for kind, rule in rules.items() for m in re.finditer(rule, texts[r["doc_id"]] or "") if holds(kind, m.group())]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r["spans"].split(",")) | {""}


def test_sharding(spark, sf_dir, con):
    texts = dict(con.sql("SELECT doc_id, text FROM documents").fetchall())

    def best(doc_id, shards):
        scores = []
        for s in range(shards):
            h = xxhash.xxh64_intdigest(int(s).to_bytes(4, "little"), xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little"), 42))
            scores.append((-np.log(((h >> 11) + 0.5) / (1 << 53)), s))
        return min(scores)[1]

    slots = {}
    import zlib

    for r in QUERIES["op2_sharding"](spark, sf_dir).collect():
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 8, zlib.crc32(data), "key")
        assert r["shard"] == best(r["doc_id"], 24) and r["grown_shard"] == best(r["doc_id"], 25)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_langid(spark, sf_dir, con):
    langs = dict(con.sql("SELECT doc_id, lang FROM documents").fetchall())
    rows = [r for r in QUERIES["op4_langid"](spark, sf_dir).collect() if r["held_out"]]
    assert len(rows) > 20 and sum(langs[r["doc_id"]] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_simhash(spark, sf_dir, con):
    def fingerprint(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", lower(text).encode())
        shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] * bool(words)
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    want = {i: fingerprint(t) for i, t in con.sql("SELECT doc_id, text FROM documents").fetchall()}
    ids = sorted(want)
    values = np.array([want[i] for i in ids], np.uint64)
    linked, label = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3, np.arange(len(ids))
    while not np.array_equal(new := np.array([label[linked[k]].min() for k in range(len(ids))]), label):
        label = new
    for r in QUERIES["op6_simhash"](spark, sf_dir).collect():
        assert r["fingerprint"] == format(want[r["doc_id"]], "016x") and r["component_id"] == ids[label[ids.index(r["doc_id"])]]


def test_decontaminate(spark, sf_dir, con):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    windows = {}
    for item, text in con.sql("SELECT item_id, text FROM benchmark").fetchall():
        ws = words(text)
        for k in range(max(1, len(ws) - 12) if ws else 0):
            windows.setdefault(tuple(ws[k : k + 13]), set()).add(str(item))
    lengths, found = {len(w) for w in windows}, 0
    texts = dict(con.sql("SELECT doc_id, text FROM documents").fetchall())
    for r in QUERIES["op8_decontaminate"](spark, sf_dir).collect():
        ws, hit, items = words(texts[r["doc_id"]]), set(), set()
        for n in lengths:
            for k in range(len(ws) - n + 1):
                if names := windows.get(tuple(ws[k : k + n])):
                    hit |= set(range(k, k + n))
                    items |= names
        sha = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(ws), len(hit), len(items), sha, bool(hit) and 20 * len(hit) >= len(ws))
        found += bool(hit)
    assert found


def test_html(spark, sf_dir, con):
    """Pages whose main text an article element holds."""
    from html import unescape

    sources = dict(con.sql("SELECT page_id, html FROM pages").fetchall())
    for r in QUERIES["op10_html"](spark, sf_dir).collect():
        article = re.search("<article>(.*?)</article>", sources[r["page_id"]], re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]+>", " ", re.sub("</?b>", "", b))).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])
