"""Near-duplicates by SimHash fingerprints of 64 bits, linked exactly by vantage-point trees.

Two fingerprints that differ in 3 bits at most differ in 1 bit at most in one of their halves. So
each half has a vantage-point tree of its own over the distinct fingerprints, with radius 1, in which the Hamming distances
of 32 bits spread far enough for triangle bounds to prune. A tree's leaves are the shards: a
fingerprint is stored in the leaf that holds it and queries, beyond that one, every leaf that the
bounds can't exclude. Within a shard, rings of distance to one more vantage point prune again, and
exact distances of the whole 64 bits decide.

A second pair of prints finds copies that were edited: the SimHash of a text's distinct words, which an edit changes little, within 5 bits, searched by
three trees over thirds; and one of 256 bits over five-word shingles, whose distance tells the similarity of the shingle sets and decides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import cut_lineage, join_hot
from tidemark.llm.components import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Copies that were edited: bits in which their distinct words' prints may differ, words of a shingle, and bits of 256 in which the shingles' prints may differ.
#: Sets of similarity 0.8 are expected to differ in 38.7 of these, give or take 5.7.
WORD_BITS, SIMILAR_SHINGLE, SIMILAR_BITS = 5, 5, 42
SKETCH = ["s0", "s1", "s2", "s3"]
#: Rows of a shard that one task compares at a time; more are tiled.
STORED_ROWS, QUERY_ROWS = 8_192, 32_768
LEAF_ROWS = 4_096
#: Fingerprints that the trees are built from: about so many at most, 8 bytes each.
SAMPLE = 1 << 20
SAMPLES_PER_LEAF = 16
#: Fingerprints that go through a tree at a time, since each of its nodes costs a few array operations.
ROUTED = 1 << 19


def _words(text: str | None) -> list[bytes]:
    """Words between blanks and the code points 9 to 13, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _hashes(words: list[bytes], shingle: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles, some at a time; fewer words than a shingle are one."""
    size, hashed = min(shingle, len(words)), xxhash.xxh64_intdigest
    for at in range(0, len(words) - size + 1, 1 << 16):
        part = words[at : at + (1 << 16) + size - 1]
        yield np.fromiter((hashed(s, seed) for s in map(b" ".join, zip(*(part[k:] for k in range(size))))), np.uint64)


def _majority(parts: Iterable[np.ndarray], bits: int = 64) -> np.ndarray:
    """Bits that over half of the hashes have, as words of 64; hashes beyond 64 bits are mixed from the first."""
    counts, total = np.zeros((bits // 64, 64), np.int64), 0
    for values in parts:
        total += len(values)
        for k in range(bits // 64):
            h = values
            if k:
                h = (h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                h ^= h >> np.uint64(29)
            counts[k] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > total, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text: unsigned, 0 for a null text and one without words.

    A-Z are lower-cased; words lie between blanks and the code points 9 to 13; a text of fewer words than
    a shingle is one shingle. A bit is 1 if over half of the shingles' XXH64 have it.
    """
    words = _words(text)
    return int(_majority(_hashes(words, shingle, seed))[0]) if words else 0


def edit_prints(text: str | None) -> np.ndarray:
    """The print of the distinct words, and the four words of the print of five-word shingles; all 0 without words."""
    words = _words(text)
    if not words:
        return np.zeros(1 + len(SKETCH), np.uint64)
    return np.concatenate([_majority(_hashes(sorted(set(words)), 1, SEED)), _majority(_hashes(words, SIMILAR_SHINGLE, SEED), 64 * len(SKETCH))])


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *keys, texts = batch.columns
        values = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*keys, pa.array(values.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])


def _edit_prints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *keys, texts = batch.columns
        values = np.array([edit_prints(t.as_py()) for t in texts], np.uint64).reshape(batch.num_rows, 1 + len(SKETCH)).view(np.int64)
        yield pa.RecordBatch.from_arrays([*keys, *(pa.array(np.ascontiguousarray(column)) for column in values.T)], names=[*batch.schema.names[:-1], "fp", *SKETCH])


class Tree:
    """A vantage-point tree over 32-bit values: at each node, those within ``mu`` of ``point`` go left."""

    def __init__(self, sample: np.ndarray, leaves: int, radius: int):
        self.radius, self.leaves = radius, 0
        self.root = self._grow(np.sort(sample), max(2, len(sample) // max(leaves, 1)))

    def _grow(self, sample: np.ndarray, small: int):
        if len(sample) > small:
            # Of a few points spread over the sample, the one whose distances spread most.
            points = sample[:: max(1, len(sample) // 12)]
            distances = np.bitwise_count(points[:, None] ^ sample[None, :]).astype(np.int16)
            best = int(np.argmax(distances.var(axis=1)))
            distance = distances[best]
            mu = int(np.median(distance))
            if mu == distance.max():
                mu -= 1
            near = distance <= mu
            if near.any() and not near.all():
                return points[best], mu, self._grow(sample[near], small), self._grow(sample[~near], small)
        self.leaves += 1
        return self.leaves - 1

    def route(self, values: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """For each leaf: index of the values that it may hold neighbours of, the leaf, and which of them it holds itself."""
        waiting = [(self.root, np.arange(len(values)), np.ones(len(values), bool))]
        while waiting:
            node, index, home = waiting.pop()
            if not len(index):
                continue
            if isinstance(node, int):
                yield index, node, home
                continue
            point, mu, left, right = node
            distance = np.bitwise_count(values[index] ^ point).astype(np.int16)
            near = distance <= mu
            # Whatever is within the radius of a value is no nearer to the point than distance - radius, no farther than distance + radius.
            to_left, to_right = distance - self.radius <= mu, distance + self.radius > mu
            waiting.append((right, index[to_right], (home & ~near)[to_right]))
            waiting.append((left, index[to_left], (home & near)[to_left]))


def _part(values: np.ndarray, part: int, parts: int) -> np.ndarray:
    """One of so many even parts of 64-bit values."""
    low, high = 64 * part // parts, 64 * (part + 1) // parts
    return ((values >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)).astype(np.uint32)


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after nodes a[i] and b[i] have met; a label is the least index of its set."""
    while len(a):
        ra, rb = label[a], label[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        label = parent[label]
    return label


@dataclass
class Prints:
    """Nodes with their fingerprints and, if wanted, wider ones that decide."""

    nodes: np.ndarray
    fps: np.ndarray
    sketches: np.ndarray | None = None

    @classmethod
    def of(cls, frame: pd.DataFrame, rows: np.ndarray) -> Prints:
        column = lambda c: frame[c].to_numpy()[rows].view(np.uint64)
        there = SKETCH[0] in frame
        return cls(frame["node" if "node" in frame else "fp"].to_numpy()[rows], column("fp"), np.stack([column(c) for c in SKETCH], axis=1) if there else None)

    def take(self, order) -> Prints:
        return Prints(self.nodes[order], self.fps[order], None if self.sketches is None else self.sketches[order])


def link(stored: Prints, queries: Prints, max_bits: int = MAX_BITS, similar_bits: int = SIMILAR_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its set) that join what the pairs within ``max_bits``, and within ``similar_bits`` of the wider prints, join: a forest, not all pairs."""
    nodes = np.union1d(stored.nodes, queries.nodes)
    if not len(stored.nodes) or len(nodes) < 2:
        return nodes[:0], nodes[:0]
    point = stored.fps[0]
    stored = stored.take(np.argsort(np.bitwise_count(stored.fps ^ point), kind="stable"))
    ring = np.bitwise_count(stored.fps ^ point).astype(np.int16)
    queries = queries.take(np.argsort(np.bitwise_count(queries.fps ^ point), kind="stable"))
    query_ring = np.bitwise_count(queries.fps ^ point).astype(np.int16)
    at, query_at, label = np.searchsorted(nodes, stored.nodes), np.searchsorted(nodes, queries.nodes), np.arange(len(nodes))
    for r in np.unique(query_ring):
        low, high = np.searchsorted(ring, r - max_bits), np.searchsorted(ring, r + max_bits, side="right")
        first, last = np.searchsorted(query_ring, r), np.searchsorted(query_ring, r, side="right")
        for k in range(first, last, step := max(1, (1 << 20) // max(1, high - low))):
            part = slice(k, min(k + step, last))
            i, j = np.nonzero(np.bitwise_count(queries.fps[part, None] ^ stored.fps[None, low:high]) <= max_bits)
            if stored.sketches is not None:
                apart = label[query_at[part][i]] != label[at[low:high][j]]
                i, j = i[apart], j[apart]
                near = np.bitwise_count(queries.sketches[part][i] ^ stored.sketches[low:high][j]).sum(axis=1, dtype=np.int64) <= similar_bits
                i, j = i[near], j[near]
            label = _merge(label, query_at[part][i], at[low:high][j])
    joined = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[joined], nodes[label[joined]]


def near_edges(fps: DataFrame, max_bits: int = MAX_BITS, leaf_rows: int = LEAF_ROWS, stored_rows: int = STORED_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Edges a, b between nodes that connect just what the pairs within ``max_bits`` connect.

    ``fps`` has distinct nodes: a column fp, which is the node's number as well unless there is a column node; if it has the columns SKETCH, they must be within SIMILAR_BITS, too.
    The bits are cut into (max_bits + 1) / 2 parts, rounded up, so that of two that link one part differs in one bit at most.
    """
    parts = (max_bits + 2) // 2
    n = fps.count()
    leaves = max(1, min(SAMPLE // SAMPLES_PER_LEAF, n // leaf_rows))
    share = min(1.0, leaves * SAMPLES_PER_LEAF / max(n, 1))
    drawn = fps.where(F.shiftrightunsigned(F.xxhash64("fp"), 11) < F.lit(int(share * (1 << 53)))).select("fp").limit(2 * SAMPLE)
    sample = drawn.toArrow().column(0).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    trees = [Tree(_part(sample, part, parts), leaves, max_bits // parts) for part in range(parts)]
    fps = fps.select(*[c for c in ("fp", "node", *SKETCH) if c in fps.columns])
    names = ["shard", "home", *fps.columns]

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            held = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            values = held.column("fp").to_numpy().view(np.uint64)
            for part, tree in enumerate(trees):
                for index, leaf, home in tree.route(_part(values, part, parts)):
                    for k in range(0, len(index), 1 << 17):
                        cut = slice(k, k + (1 << 17))
                        taken = held.take(pa.array(index[cut])).combine_chunks()
                        columns = [c.chunk(0) for c in taken.columns]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(index[cut]), leaf * parts + part, np.int32)), pa.array(home[cut]), *columns], names=names)

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= ROUTED:
                yield from flush()
        if waiting:
            yield from flush()

    routed = fps.mapInArrow(route, StructType([*StructType.fromDDL("shard int, home boolean").fields, *fps.schema.fields]))
    # As many rows as the trees have leaves: some parts x SAMPLE / SAMPLES_PER_LEAF at most, whatever the input.
    counts = routed.groupBy("shard").agg(F.ceil(F.count_if("home") / stored_rows).cast("int").alias("s_tiles"), F.ceil(F.count("*") / query_rows).cast("int").alias("q_tiles"))
    tiled = routed.join(F.broadcast(counts), "shard")
    node = F.xxhash64("node" if "node" in fps.columns else "fp")
    s_tile, q_tile = F.pmod(node, F.col("s_tiles")).cast("int"), F.pmod(node, F.col("q_tiles")).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
    stored = tiled.where("home").withColumn("s", s_tile).withColumn("q", F.explode(upto(F.col("q_tiles")))).withColumn("query", F.lit(False))
    asking = tiled.where("s_tiles > 0").withColumn("q", q_tile).withColumn("s", F.explode(upto(F.col("s_tiles")))).withColumn("query", F.lit(True))
    columns = ["shard", "s", "q", "query", *fps.columns]
    shards = stored.select(*columns).unionByName(asking.select(*columns))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        query = frame["query"].to_numpy(bool)
        a, b = link(Prints.of(frame, ~query), Prints.of(frame, query), max_bits)
        return pd.DataFrame({"a": a, "b": b})

    return shards.groupBy("shard", "s", "q").applyInPandas(compare, "a long, b long")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, whose last is text; its fingerprint takes the text's place."""
    return cut_lineage(docs.mapInArrow(_fingerprints, StructType([*docs.schema.fields[:-1], StructField("fp", LongType())])))


def rooted(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) with the root, one of them, of their component."""
    linked = components(near_edges(fps))
    return fps.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id for each row of ``docs`` (doc_id and text; other columns are left out).

    Fingerprints link if they differ in 3 bits at most; component_id is the least doc_id of all rows that
    links connect, itself included. Null texts and texts without words have fingerprint 0. Rows that repeat a doc_id each
    count; a component whose doc_ids are all null has a null id.
    """
    hashed = fingerprinted(docs.select("doc_id", "text"))
    fps = cut_lineage(hashed.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("rows")))
    nodes = rooted(fps)
    roots = nodes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return join_hot(hashed, nodes.join(roots, "root").select("fp", "rows", "component_id"), "fp", "rows").drop("rows")


def edited_copies(docs: DataFrame, keys: list[str]) -> DataFrame:
    """The least row of each group of copies, edited ones too: struct ``least`` of the ``keys``, columns of ``docs`` in order of precedence.

    Texts link if the prints of their distinct words differ in WORD_BITS at most and those of their five-word shingles in SIMILAR_BITS of 256 at most; texts of equal prints are copies. All texts without words make one group.
    """
    schema = StructType([*docs.select(*keys).schema.fields, *(StructField(c, LongType()) for c in ("fp", *SKETCH))])
    hashed = docs.select(*keys, "text").mapInArrow(_edit_prints, schema)
    distinct = hashed.groupBy("fp", *SKETCH).agg(F.min(F.struct(*keys)).alias("least"))
    # Stored, so that a node keeps its number.
    nodes = cut_lineage(distinct.withColumn("node", F.monotonically_increasing_id()))
    linked = components(near_edges(nodes.select("node", "fp", *SKETCH), WORD_BITS)).withColumnRenamed("node", "_node")
    found = nodes.select("node", "least").join(linked, F.col("node") == F.col("_node"), "left")
    return found.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least")).select("least")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """The contract's digest."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
