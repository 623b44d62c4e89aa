"""Near-duplicate join on word n-grams: MinHash bands propose pairs, full n-gram sets decide.

Texts with equal n-gram sets are one node. Band hashes are shuffled, and the nodes of a bucket are tied to
its smallest node, which makes one row a node and band instead of all pairs. Nodes tied together, directly or
over others, form a candidate group. In each group, of any size, the full sets of every pair are compared, by
blocks: a task holds two blocks at most and returns a row for each node of them, never pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from cairn.llm.common import connected, matched, small, written

N, SIMILARITY, RECALL = 5, 0.8, 0.999
#: Nodes and bytes of n-grams that a block of a candidate group holds, about, and blocks of a group beyond which they grow: the
#: more nodes in a block, the less often each is sent. Columns of the incidence matrix multiplied at once; words remembered.
BLOCK, BLOCK_BYTES, MANY_BLOCKS, COLUMNS, CACHE_ENTRIES = 192, 16_000_000, 64, 8192, 100_000


def plan_bands(similarity: float = SIMILARITY, recall: float = RECALL, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose bands, enough of them for the recall at that similarity, need at most most_hashes hashes."""
    best = None
    for rows in range(1, 33):
        bands = ceil(log(1 - recall) / log(1 - similarity**rows)) if similarity < 1 else 1
        if bands * rows <= most_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("most_hashes is too small for this recall")
    return best


class Shingles:
    """Texts to sorted arrays of distinct n-gram hashes. Words stand between white space, in lower case."""

    def __init__(self, n: int = N):
        self.n = n

        class Words(dict):
            def __missing__(self, word: str) -> int:
                if len(self) >= CACHE_ENTRIES:
                    self.clear()
                h = self[word] = xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
                return h

        self.words = Words()

    def __call__(self, text: str | None) -> np.ndarray:
        """A text of fewer than n words, but not none, is one n-gram; a text without words has none."""
        words = (text or "").lower().split()
        w = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        size = min(self.n, len(w))
        if not size:
            return w
        h = np.full(len(w) - size + 1, size, np.uint64)
        for i in range(size):
            h = (h ^ w[i : len(w) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        return np.unique(h * np.uint64(0xBF58476D1CE4E5B9))


def signature(grams: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """MinHash values, by multiplication with odd numbers; long sets go by parts."""
    low = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(grams), 4096):
        np.minimum(low, (grams[i : i + 4096, None] * multipliers[None, :]).min(axis=0), out=low)
    return low


def signatures(docs: DataFrame, n: int, bands: int, rows: int, seed: int = 29) -> DataFrame:
    """doc_id, set_hash (null without n-grams), n_grams, bands (a hash for each) for every row of docs with an id."""
    multipliers = np.random.default_rng(seed).integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(n)
        for batch in small(arrow):
            sets, sizes, keys = [], [], []
            for x in batch.column("text"):
                grams = shingles(x.as_py())
                sizes.append(len(grams))
                sets.append(hashlib.blake2b(grams.tobytes(), digest_size=16).hexdigest() if len(grams) else None)
                keys.append([xxh64_intdigest(part.tobytes(), seed=b) - 2**63 for b, part in enumerate(signature(grams, multipliers).reshape(bands, rows))] if len(grams) else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.string()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "set_hash", "n_grams", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, f"doc_id {kind}, set_hash string, n_grams long, bands array<long>")


def similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the Jaccard similarity of sets[i], sets[j] reaches the threshold, for i in left and j in right.

    Only n-grams that two of the sets share can be in an intersection; these are the columns of a
    0/1 matrix whose products with itself, a slice of columns at a time, count the intersections.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(n > 1) - 1
    keep = n[column] > 1
    row, column = row[keep], shared[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(shared[-1]) + 1 if len(shared) else 0, COLUMNS):
        a, b = np.searchsorted(column, (low, low + COLUMNS))
        m = np.zeros((len(sets), min(COLUMNS, int(shared[-1]) + 1 - low)), np.float32)
        m[row[a:b], column[a:b] - low] = 1
        both += m[left] @ m[right].T
    both = both.astype(np.int64)
    union = sizes[left][:, None] + sizes[right][None, :] - both
    return both >= similarity * union - 1e-9


def compare(nodes: np.ndarray, first: np.ndarray, second: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """For each node of a block `first` and another or the same, `second` (their places): the smallest node it is tied to here, and its links to documents of others."""
    near = np.zeros((len(nodes), len(nodes)), bool)
    near[np.ix_(first, second)] = similar(sets, first, second, similarity)
    near |= near.T
    near &= nodes[:, None] != nodes[None, :]
    links = near @ copies
    root = nodes.copy()
    tied = near | np.eye(len(nodes), dtype=bool)
    top = nodes.max()
    while True:
        low = np.where(tied, root[None, :], top).min(axis=1)
        if (low == root).all():
            return root, links
        root = low


def near_duplicates(docs: DataFrame, n: int = N, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its near-duplicates and theirs), n_links (documents at least `similarity` alike) for every row of docs (doc_id, text).

    Similarity is the Jaccard similarity of the sets of n-word n-grams. Pairs that share no band, at most
    1 - recall of those at the threshold, may be missed unless others bring them into one group; every pair of a
    group is compared, however large it is. A group's blocks hold about `block` texts, up to four times as many where there
    are more than MANY_BLOCKS blocks, and BLOCK_BYTES of n-grams, or one longer text; a task holds two blocks.
    Texts without words (null, empty) are alone in their classes. doc_id must be an integer:
    rows that repeat an id share a class, and identical repeats count as copies; rows with a null id have a null
    class and 0 links. Other columns are ignored.
    """
    bands, rows = plan_bands(similarity, recall)
    signed = written(signatures(docs, n, bands, rows))
    sets = written(signed.where("set_hash is not null").groupBy("set_hash").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.max("n_grams").alias("n_grams")))

    one = signed.select("doc_id", "set_hash", "bands").join(sets.select(F.col("node").alias("doc_id"), "set_hash"), ["doc_id", "set_hash"])
    one = one.select(F.col("doc_id").alias("node"), "bands")
    banded = written(one.select("node", F.explode("bands").alias("bucket")))
    hubs = banded.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("bucket", "hub")
    edges = banded.join(hubs, "bucket").where("node <> hub").select("node", "hub")
    groups = connected(edges, "node", "hub")

    counted = groups.join(sets.groupBy("node").agg(F.sum("copies").alias("copies"), F.sum("n_grams").alias("n_grams")), "node")
    nodes, grams_bytes = F.count("*"), 8 * F.sum("n_grams")
    held = F.least(F.lit(4 * block), F.greatest(F.lit(block), nodes / MANY_BLOCKS))
    size = counted.groupBy("root").agg(F.ceil(F.greatest(nodes / held, grams_bytes / BLOCK_BYTES)).cast("int").alias("n_blocks"))
    members = counted.drop("n_grams").join(size, "root")
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))

    def grams(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(n)
        for batch in small(arrow):
            packed = pa.array([shingles(x.as_py()).tobytes() for x in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), packed], [*kept, "grams"])

    kept = ("root", "node", "copies", "n_blocks", "block")
    texts = docs.select(F.col("doc_id").alias("node"), "text").where("doc_id is not null").join(members, "node").select(*kept, "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    shingled = texts.mapInArrow(grams, f"root {kind}, node {kind}, copies long, n_blocks int, block int, grams binary")
    each = shingled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    each = each.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def compared(group: pa.Table) -> pa.Table:
        sets_here = [np.frombuffer(b, np.uint64) for b in group["grams"].to_pylist()]
        block = group["block"].to_numpy()
        first, second = (np.flatnonzero(block == group[c][0].as_py()) for c in ("low", "high"))
        root, links = compare(group["node"].to_numpy(), first, second, group["copies"].to_numpy(), sets_here, similarity)
        return pa.table({"node": group["node"], "tied": pa.array(root, group["node"].type), "links": pa.array(links, pa.int64())})

    found = written(each.drop("n_blocks", "other").groupBy("root", "low", "high").applyInArrow(compared, f"node {kind}, tied {kind}, links long"))
    classes = connected(found, "node", "tied").select("node", F.col("root").alias("class_id"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    of_set = sets.join(classes, "node", "left").join(links, "node", "left")
    of_set = of_set.select("set_hash", F.coalesce("class_id", "node").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rows_out = signed.select("doc_id", "set_hash").join(of_set, "set_hash", "left")
    rows_out = rows_out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    nameless = docs.where("doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return rows_out.unionByName(nameless)


def one_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs, all columns, that keep one document of each class: the one with the smallest id.

    Rows that repeat a kept id stay if their texts differ; of those with equal texts one stays, whichever. Rows with a null id stay.
    Texts are shuffled only where an id repeats, as long as the ids that go and those that repeat are few enough to be sent to every task.
    """
    named = docs.where("doc_id is not null")
    others = written(near_duplicates(docs, **parameters).where("class_id <> doc_id").select(F.col("doc_id").alias("_other")).distinct())
    again = written(named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_again")))
    firsts = matched(named, others, F.col("doc_id") == F.col("_other"), "left_anti")
    once, more = (matched(firsts, again, F.col("doc_id") == F.col("_again"), how) for how in ("left_anti", "left_semi"))
    return once.unionByName(more.dropDuplicates(["doc_id", "text"])).unionByName(docs.where("doc_id is null"))
