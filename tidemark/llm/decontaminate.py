"""Benchmark decontamination by an FM-index over each shard of training text.

The alphabet of an index is the test phrases' words; whatever else a document says separates
fragments, and fragments shorter than the shortest phrase can't hold one. Phrases are searched backward, word by word, all
at a time, by ranks in a wavelet tree; sampled suffix positions give the places; merged spans cover them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

WINDOW = 13
#: A document is contaminated if hit words are a twentieth of its words.
SHARE = 20
#: Words in one index, words read before one is built, words of test phrases in one block, and different words of the blocks that share an index.
INDEX_WORDS, SHARD_WORDS, BLOCK_WORDS, VOCABULARY = 1 << 19, 1 << 21, 1 << 20, 1 << 21
SAMPLED = 16

#: A-Z to lower case; what is no letter, digit or code point from 128 to a blank.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split() if text else []


class FMIndex:
    """Backward search over a sequence of numbers from 1 on, in fragments.

    ``fragments`` come concatenated; ``starts`` are the places where one begins. The text gets a
    separator before each fragment; separators differ from each other, so that suffixes stay apart.
    """

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, sigma: int):
        n = len(symbols) + len(starts) + 1
        text, gap = np.zeros(n, np.int64), starts + np.arange(len(starts))
        inside = np.ones(n, bool)
        inside[gap], inside[n - 1] = False, False
        text[inside] = symbols
        self.origin = np.cumsum(inside) - 1  # of a place in the text, the place in symbols
        separators = np.flatnonzero(~inside)
        first = np.where(inside, text + len(separators), 0)
        first[separators] = np.arange(len(separators))
        suffixes = self._sort(first)
        self.bwt = text[suffixes - 1]
        self.base = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])
        # Places that are sampled; all that follow a separator are, so that no walk crosses one.
        kept = (suffixes % SAMPLED == 0) | (self.bwt == 0)
        self.marked, self.places = np.concatenate([[0], np.cumsum(kept)]), suffixes[kept]
        self.levels, row = [], self.bwt
        for bit in reversed(range(max(1, int(sigma).bit_length()))):
            ones = ((row >> bit) & 1).astype(bool)
            self.levels.append((bit, np.concatenate([[0], np.cumsum(ones)]).astype(np.int32), int(len(row) - ones.sum())))
            row = np.concatenate([row[~ones], row[ones]])

    @staticmethod
    def _sort(rank: np.ndarray) -> np.ndarray:
        """The suffix array, by doubling the length that ranks compare."""
        n, length = len(rank), 1
        while True:
            after = np.zeros(n, np.int64)
            after[: n - length] = rank[length:] + 1
            key = rank * (n + int(rank.max()) + 2) + after
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            if fresh[-1] == n - 1:
                return order
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            length *= 2

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the place of the transform beside it."""
        start, end = np.zeros_like(at), at
        for bit, ones, zeros in self.levels:
            is_one, s, e = (symbol >> bit) & 1 == 1, ones[start], ones[end]
            start, end = np.where(is_one, zeros + s, start - s), np.where(is_one, zeros + e, end - e)
        return end - start

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 row of the suffixes that begin with each phrase: rows of ``phrases``, 0 fills up on the left."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        for k in reversed(range(phrases.shape[1])):
            live = np.flatnonzero((phrases[:, k] > 0) & (low < high))
            symbol = phrases[live, k]
            low[live] = self.base[symbol] + self.rank(symbol, low[live])
            high[live] = self.base[symbol] + self.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in symbols of the suffixes in these rows: each walks back to a sampled one."""
        place, steps, open_rows, at = np.empty(len(rows), np.int64), 0, np.arange(len(rows)), rows.copy()
        while len(open_rows):
            done = self.marked[at + 1] > self.marked[at]
            place[open_rows[done]] = self.places[self.marked[at[done]]] + steps
            open_rows, at, steps = open_rows[~done], at[~done], steps + 1
            symbol = self.bwt[at]
            at = self.base[symbol] + self.rank(symbol, at)
        return self.origin[place]


class Phrases:
    """Windows of a block of benchmark items: of 13 words, or of all words of an item that has fewer. Words that ``vocabulary`` lacks are added to it."""

    def __init__(self, items: list[tuple[str, list[bytes]]], vocabulary: dict[bytes, int], window: int = WINDOW):
        self.ids = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.ids)}
        found: dict[tuple, set[int]] = {}
        for name, ws in items:
            coded = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in ws]
            for k in range(max(1, len(coded) - window + 1) if coded else 0):
                found.setdefault(tuple(coded[k : k + window]), set()).add(number[name])
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.rows = np.zeros((len(found), window), np.int64)
        for k, w in enumerate(found):
            self.rows[k, window - len(w) :] = w
        self.of = np.repeat(np.arange(len(found)), [len(v) for v in found.values()])
        self.items = np.array([i for v in found.values() for i in sorted(v)], np.int64)
        self.first = np.searchsorted(self.of, np.arange(len(found) + 1))
        self.shortest = int(self.lengths.min()) if len(found) else window


#: The vocabulary that blocks of phrases share, the length of their shortest phrase, and the blocks.
Group = tuple[dict[bytes, int], int, Iterable[Phrases]]


class Shard:
    """FM-indexes over a shard's documents in one vocabulary, searched for any number of blocks."""

    def __init__(self, docs: list[list[bytes]], vocabulary: dict[bytes, int], shortest: int, window: int):
        self.indexes: list[tuple[FMIndex, np.ndarray, np.ndarray, np.ndarray]] = []
        get, waiting, held, sigma = vocabulary.get, [], 0, len(vocabulary)

        def index() -> None:
            if waiting:
                starts = np.concatenate([[0], np.cumsum([len(w[2]) for w in waiting])[:-1]])
                fm = FMIndex(np.concatenate([w[2] for w in waiting]), starts, sigma)
                self.indexes.append((fm, starts, np.array([w[0] for w in waiting]), np.array([w[1] for w in waiting])))
                waiting.clear()

        for k, ws in enumerate(docs):
            coded = np.fromiter((get(w, 0) for w in ws), np.int64, len(ws))
            breaks = np.flatnonzero(np.concatenate([[True], coded == 0, [True]]))
            for at in np.flatnonzero(np.diff(breaks) - 1 >= shortest):
                first, last = int(breaks[at]), int(breaks[at + 1]) - 1
                # A fragment longer than an index goes into several, which overlap by a window less one word.
                for begin in range(first, last, INDEX_WORDS):
                    end = min(last, begin + INDEX_WORDS + window - 1)
                    if end - begin >= shortest:
                        waiting.append((k, begin, coded[begin:end]))
                        held += end - begin
                        if held >= INDEX_WORDS:
                            index()
                            held = 0
        index()

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of windows: document, first word, window."""
        found = []
        for fm, starts, document, word in self.indexes:
            low, high = fm.search(phrases.rows)
            counts = high - low
            window = np.repeat(np.arange(len(counts)), counts)
            place = fm.locate(np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(len(window)))
            fragment = np.searchsorted(starts, place, side="right") - 1
            found.append((document[fragment], word[fragment] + place - starts[fragment], window))
        return tuple(map(np.concatenate, zip(*found))) if found else (np.zeros(0, np.int64),) * 3


def _occurrences(docs: list[list[bytes]], groups: Iterable[Group], window: int) -> Iterator[tuple[Phrases, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks with their occurrences; a shard is indexed once for all blocks of a vocabulary."""
    for vocabulary, shortest, blocks in groups:
        shard = Shard(docs, vocabulary, shortest, window)
        for phrases in blocks if shard.indexes else ():
            yield phrases, *shard.search(phrases)


def scan(docs: list[list[bytes]], groups: Iterable[Group], window: int = WINDOW) -> Iterator[tuple[list[tuple[int, int]], list[str]]]:
    """For each document of a shard, the merged spans of hit words (end exclusive) and the items whose windows occur, sorted."""
    spans: list[list[np.ndarray]] = [[] for _ in docs]
    items: list[set[str]] = [set() for _ in docs]
    for phrases, document, word, which in _occurrences(docs, groups, window):
        if not len(document):
            continue
        pairs = np.unique(document * len(phrases.lengths) + which)
        owner, kind = pairs // len(phrases.lengths), pairs % len(phrases.lengths)
        sizes = phrases.first[kind + 1] - phrases.first[kind]
        at = np.repeat(phrases.first[kind] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        for pair in np.unique(np.repeat(owner, sizes) * len(phrases.ids) + phrases.items[at]).tolist():
            items[pair // len(phrases.ids)].add(phrases.ids[pair % len(phrases.ids)])
        order = np.argsort(document, kind="stable")
        document, ends = document[order], np.stack([word, word + phrases.lengths[which]], axis=1)[order]
        for part in np.split(np.arange(len(document)), np.flatnonzero(np.diff(document)) + 1):
            spans[document[part[0]]].append(ends[part])
    for found, names in zip(spans, items):
        merged: list[tuple[int, int]] = []
        if found:
            both = np.concatenate(found)
            both = both[np.argsort(both[:, 0], kind="stable")]
            reach = np.maximum.accumulate(both[:, 1])
            cut = np.flatnonzero(np.concatenate([[True], both[1:, 0] > reach[:-1]]))
            merged = list(zip(both[cut, 0].tolist(), reach[np.concatenate([cut[1:] - 1, [len(both) - 1]])].tolist()))
        yield merged, sorted(names)


def benchmark_groups(spark: SparkSession, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, most_words: int = VOCABULARY) -> list:
    """Groups of broadcast blocks, each with its broadcast vocabulary and the length of its shortest phrase. Items without words have none; a null id is ``null``.

    The benchmark comes to the driver a partition at a time, and goes out again in blocks of bounded size; a vocabulary that has got large is closed, and the next block begins another.
    """
    groups, vocabulary, blocks, shortest, waiting, held = [], {}, [], window, [], 0

    def flush(close: bool) -> None:
        nonlocal vocabulary, blocks, shortest, waiting, held
        if waiting:
            phrases = Phrases(waiting, vocabulary, window)
            shortest = min(shortest, phrases.shortest)
            blocks.append(spark.sparkContext.broadcast(phrases))
            waiting, held = [], 0
        if blocks and (close or len(vocabulary) >= most_words):
            groups.append((spark.sparkContext.broadcast(vocabulary), shortest, blocks))
            vocabulary, blocks, shortest = {}, [], window

    for row in benchmark.select("item_id", "text").toLocalIterator():
        ws = words(row["text"])
        if ws:
            waiting.append(("null" if row["item_id"] is None else str(row["item_id"]), ws))
            held += len(ws)
        if held >= block_words:
            flush(False)
    flush(True)
    return groups


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The columns of ``docs`` (with text), and n_words, hits (spans of word numbers) and items (sorted ids).

    Null and empty texts have no words, spans or items. Each row counts for itself, repeated or not. New columns replace those of their names.
    """
    groups = benchmark_groups(docs.sparkSession, benchmark, window)
    docs = docs.drop("n_words", "hits", "items")
    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, *StructType.fromDDL("n_words long, hits array<struct<start:long,end:long>>, items array<string>").fields])
    hits_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = 0
            while begin < batch.num_rows:
                shard, held = [], 0
                while begin + len(shard) < batch.num_rows and held < SHARD_WORDS:
                    shard.append(words(batch.column(at)[begin + len(shard)].as_py()))
                    held += len(shard[-1])
                found = list(scan(shard, ((v.value, shortest, (b.value for b in blocks)) for v, shortest, blocks in groups), window))
                rows = batch.slice(begin, len(shard))
                hits = [[{"start": a, "end": b} for a, b in spans] for spans, _ in found]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([len(ws) for ws in shard], pa.int64()), pa.array(hits, hits_type), pa.array([names for _, names in found], pa.list_(pa.string()))], names=schema.names)
                begin += len(shard)

    return docs.mapInArrow(shards, schema)


def contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and SHARE * n_hit >= n_words


def with_verdict(found: DataFrame) -> DataFrame:
    """Adds n_hit and contaminated."""
    n_hit = "aggregate(hits, 0L, (n, h) -> n + h.end - h.start)"
    return found.selectExpr("*", f"{n_hit} AS n_hit").selectExpr("*", f"n_hit > 0 AND {SHARE} * n_hit >= n_words AS contaminated")


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    """The contract's digest."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = with_verdict(find_contamination(docs.select("doc_id", "text"), benchmark).drop("text"))
    return found.selectExpr("doc_id", "n_words", "n_hit", "CAST(size(items) AS LONG) AS n_items", "sha2(array_join(items, ','), 256) AS items_sha256", "contaminated")


OP8_SQL = r"""
WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM lowered),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT item, ws, least(len(ws), 13) AS n, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS k FROM b WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(list_slice(ws, k, k + n - 1), ' ') AS phrase FROM i),
places AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM windows) WHERE len(ws) >= n),
phrases AS (SELECT doc_id, n, k, array_to_string(list_slice(ws, k, k + n - 1), ' ') AS phrase FROM places),
hits AS (SELECT doc_id, n, k, item FROM phrases JOIN windows USING (n, phrase)),
spans AS (SELECT DISTINCT doc_id, n, k FROM hits),
hit_words AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS word FROM spans) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN found USING (doc_id)
"""
