"""The pipeline against brute force, stage by stage and as a whole."""

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

import corpus_pipeline
from tidemark.llm import langid


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def mixed_hash(h, k):
    """The k-th hash made of h."""
    if not k:
        return h
    h = (h + k * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    h = (h ^ h >> 31) * 0x94D049BB133111EB & (1 << 64) - 1
    return h ^ h >> 29


def prints(text):
    """Prints of 64 and of 256 bits, of distinct words and of five-word shingles."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", lower(text).encode())
    shingles = [b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))] if words else []
    out = []
    for strings, count in ((set(words), 1), (shingles, 4)):
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in strings]
        out += [sum(1 << b for b in range(64) if 2 * sum(mixed_hash(h, k) >> b & 1 for h in hashes) > len(hashes)) for k in range(count)]
    return out


def near_groups(texts):
    """Least doc_id of each document's component, over all pairs."""
    ids = sorted(texts)
    values = np.array([prints(texts[i]) for i in ids], np.uint64)
    bits = np.bitwise_count(values[:, None] ^ values[None, :]).astype(int)
    linked, label = (bits[:, :, 0] <= 5) & (bits[:, :, 1:].sum(axis=2) <= 42), np.arange(len(ids))
    while not np.array_equal(new := np.array([label[row].min() for row in linked]), label):
        label = new
    return {i: ids[label[k]] for k, i in enumerate(ids)}


def is_contaminated(text, windows):
    words, hit = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text)), set()
    for n in {len(w) for w in windows}:
        for k in range(len(words) - n + 1):
            if tuple(words[k : k + n]) in windows:
                hit |= set(range(k, k + n))
    return bool(hit) and 20 * len(hit) >= len(words)


def mixed(docs):
    """How often each doc_id is taken."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) for i, (text, _) in docs.items()}
    sources = sorted({s for _, s in docs.values()}, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    whole = {s: sum(size[i] for i in docs if docs[i][1] == s) for s in sources}
    target, still_open = {}, set(sources)
    while still_open:
        left = 1.5 * sum(whole.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[o] for o in still_open) for s in still_open}
        full = {s for s in still_open if share[s] > 2 * whole[s]}
        target |= {s: 2 * whole[s] for s in full} if full else share
        still_open -= full or still_open
    taken = Counter()
    for s in sources:
        before = 0
        for i in sorted((i for i in docs if docs[i][1] == s), key=lambda i: hashlib.md5(f"mix|{i}".encode()).hexdigest()):
            taken[i] += sum(epoch * whole[s] + before + size[i] / 2 < target[s] for epoch in (0, 1))
            before += size[i]
    return +taken


def shard_of(doc_id):
    key = xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little"), 42)
    return min((-np.log(((xxhash.xxh64_intdigest(s.to_bytes(4, "little"), key) >> 11) + 0.5) / (1 << 53)), s) for s in range(24))[1]


def test_pipeline_is_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = {r["doc_id"]: (r["text"], r["source"]) for r in table.collect()}
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(r["text"]))
        windows |= {tuple(words[k : k + 13]) for k in range(max(1, len(words) - 12))} if words else set()

    # The model is the operator's; that it is right, held-out accuracy says.
    model = langid.train(table)
    found = {i: model.predict(text) for i, (text, _) in docs.items()}
    kept = {i: docs[i] for i, (lang, score) in found.items() if lang != "und" and score >= langid.MIN_SCORE}
    stages = [Counter(list(kept))]
    root = near_groups({i: text for i, (text, _) in kept.items()})
    kept = {i: d for i, d in kept.items() if root[i] == i}
    stages.append(Counter(list(kept)))
    kept = {i: d for i, d in kept.items() if not is_contaminated(d[0], windows)}
    stages.append(Counter(list(kept)))
    stages += [mixed(kept)] * 2
    assert len(docs) >= len(stages[0]) > len(stages[1]) > len(stages[2])

    stored = table
    for (name, stage), want in zip(corpus_pipeline.STAGES, stages):
        stored = corpus_pipeline.cut_lineage(stage(spark, stored, sf_dir))
        assert Counter(r[0] for r in stored.select("doc_id").collect()) == want, name
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r["doc_id"] for r in rows) == stages[-1]
    slots = {}
    for r in rows:
        assert (r["text"], r["source"]) == docs[r["doc_id"]] and r["shard"] == shard_of(r["doc_id"])
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
