"""Benchmark decontamination over a positional inverted index.

The index is sharded by documents: a shard lists, for each term of a group of documents, the positions at
which it stands, so that building it needs no shuffle and no term's list meets in one task. A phrase is
looked up from its rarest term in the shard: that term's list, moved back by the term's offset, is
intersected with the moved lists of the other terms, the next rarest first. What is left are the phrase's beginnings.
The index is written once, and all that is asked of it reads it there: documents are read once, however many items there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from cairn.llm.common import matched, small, written

WINDOW = 10
#: Bytes of text in a shard and of items in a block, about: one text or item may hold more. Terms of all items that are sent
#: to every task, at most; beyond, all terms are indexed. Candidate beginnings that are looked at together.
SHARD_BYTES, BLOCK_BYTES, MOST_TERMS, CANDIDATES = 2_000_000, 4_000_000, 1_000_000, 1_000_000
#: Fixed value: words, in the UTF-8 of a text whose A-Z are lower-cased.
_WORD = regex.compile(rb"[0-9a-z\x80-\xff]+")

INDEX = "shard string, doc_ids array<{id}>, n_words array<int>, terms array<string>, ends array<int>, steps binary"


def words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def build_index(docs: DataFrame, terms: set[bytes] | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row for each shard of docs (doc_id, text): its documents, their word counts, its terms and their positions.

    With `terms`, only these are indexed; they are sent to every task. Null and empty texts have no positions; repeated rows and
    null ids are rows of their own; a very long text is a shard of its own. Positions count through the shard's
    documents, with one left free behind each, so that no phrase spans two. `steps` holds each position less the
    one before it, all terms' lists behind each other; `ends` where each list ends.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    given = None if terms is None else {t: i for i, t in enumerate(sorted(terms))}
    names = None if given is None else [t.decode("utf-8", "replace") for t in given]

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, number = TaskContext.get().partitionId(), 0
        ids: list = []
        tokens: list[list[bytes]] = []
        size = 0

        def shard() -> pa.RecordBatch:
            of, labels = given, names
            if of is None:
                of = {t: i for i, t in enumerate(sorted({w for t in tokens for w in t}))}
                labels = [t.decode("utf-8", "replace") for t in of]
            counts = np.array([len(t) for t in tokens], np.int64)
            starts = np.cumsum(counts + 1) - counts - 1
            total = int(counts.sum())
            term = np.fromiter((of.get(w, -1) for t in tokens for w in t), np.int32, total)
            at = np.arange(total) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
            keep = term >= 0
            term, at = term[keep], at[keep]
            order = np.argsort(term, kind="stable")
            term, at = term[order], at[order]
            present, n = np.unique(term, return_counts=True)
            steps = np.diff(at, prepend=0).astype(np.int32)
            row = {"shard": f"{partition}-{number}", "doc_ids": list(ids), "n_words": counts.tolist(), "terms": [labels[i] for i in present], "ends": np.cumsum(n).tolist(), "steps": steps.tobytes()}
            types = {"shard": pa.string(), "doc_ids": pa.list_(id_type), "n_words": pa.list_(pa.int32()), "terms": pa.list_(pa.string()), "ends": pa.list_(pa.int32()), "steps": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in types.items()], list(types))

        for batch in small(arrow):
            id_type = batch.column("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                t = text.as_py()
                ids.append(doc_id)
                tokens.append(words(t))
                size += len(t or "") + 64
                if size >= shard_bytes:
                    yield shard()
                    number, size = number + 1, 0
                    ids.clear()
                    tokens.clear()
        if ids:
            yield shard()

    return docs.select("doc_id", "text").mapInArrow(run, INDEX.format(id=kind))


class Shard:
    """One row of the index, opened."""

    def __init__(self, row: dict):
        self.doc_ids, self.n_words = row["doc_ids"], np.array(row["n_words"], np.int64)
        self.starts = np.cumsum(self.n_words + 1) - self.n_words - 1
        self.at = np.cumsum(np.frombuffer(row["steps"], np.int32), dtype=np.int64)
        ends = row["ends"]
        self.span = {t.encode(): (b, e) for t, b, e in zip(row["terms"], [0, *ends[:-1]], ends)}

    def __len__(self) -> int:
        return int(self.starts[-1] + self.n_words[-1]) + 1

    def postings(self, term: bytes) -> np.ndarray:
        b, e = self.span.get(term, (0, 0))
        return self.at[b:e]

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1

    def phrase(self, terms: list[bytes]) -> np.ndarray:
        """Where the terms stand one behind the other: positions of the first."""
        lists = sorted(((self.postings(t), i) for i, t in enumerate(terms)), key=lambda x: len(x[0]))
        begin = lists[0][0] - lists[0][1]
        for at, i in lists[1:]:
            if not len(begin):
                break
            moved = begin + i
            where = np.searchsorted(at, moved)
            begin = begin[(where < len(at)) & (at[np.minimum(where, len(at) - 1)] == moved)]
        return begin

    def near(self, terms: list[bytes], slop: int) -> list[tuple[int, int]]:
        """(first, last) positions of spans that hold the terms in order with at most slop other words between them; the shortest from each beginning."""
        first = last = self.postings(terms[0])
        for t in terms[1:]:
            at = self.postings(t)
            where = np.searchsorted(at, last, side="right")
            ok = where < len(at)
            first, last = first[ok], at[where[ok]]
        ok = (last - first <= len(terms) - 1 + slop) & (self.doc_of(first) == self.doc_of(last))
        return list(zip(first[ok].tolist(), last[ok].tolist()))


def phrase_matches(index: DataFrame, phrases: dict[str, str], slop: int = 0) -> DataFrame:
    """doc_id, phrase (its name), first, last: every exact match, or with slop proximity match, of a few phrases; word positions count from 0.

    Phrases without words have no match; repeated rows and null ids are matched row by row.
    """
    wanted = {name: words(text) for name, text in phrases.items()}

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            kind = batch.schema.field("doc_ids").type.value_type
            for row in batch.to_pylist():
                shard, out = Shard(row), []
                for name, terms in wanted.items():
                    spans = shard.near(terms, slop) if slop and terms else [(b, b + len(terms) - 1) for b in (shard.phrase(terms).tolist() if terms else [])]
                    for b, e in spans:
                        d = int(shard.doc_of(np.array([b]))[0])
                        out.append((shard.doc_ids[d], name, b - int(shard.starts[d]), e - int(shard.starts[d])))
                columns = list(zip(*out)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], ["doc_id", "phrase", "first", "last"])

    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    return index.mapInArrow(run, f"doc_id {kind}, phrase string, first long, last long")


class Windows:
    """The windows of a block of items: places in the row of all the items' terms, with their sizes and items."""

    def __init__(self, items: list[Row], window: int):
        texts = [w for r in items if (w := words(r["text"]))]
        self.window = window
        self.items = [None if r["item_id"] is None else str(r["item_id"]) for r in items if words(r["text"])]
        self.number = {t: i for i, t in enumerate(sorted({t for w in texts for t in w}))}
        # the last number is that of no term, behind the last item
        self.terms = np.array([*(self.number[t] for w in texts for t in w), *[len(self.number)] * window], np.int64)
        lengths = np.array([len(w) for w in texts], np.int64)
        each = np.maximum(1, lengths - window + 1)
        self.item = np.repeat(np.arange(len(texts)), each)
        self.begin = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each - (np.cumsum(lengths) - lengths), each)
        self.size = np.minimum(lengths, window)[self.item]

    def found(self, shard: Shard) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows and where they begin in the shard, for many windows at a time."""
        n = len(self.number)
        first, count = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        #: Of each place in the shard its term: the lists of all terms in one.
        term_at = np.full(len(shard) + self.window, -1, np.int64)
        for t, (b, e) in shard.span.items():
            if (i := self.number.get(t)) is not None:
                first[i], count[i] = b, e - b
                term_at[shard.at[b:e]] = i
        # a place behind a short window's end is never the rarest
        count[n] = np.iinfo(np.int64).max
        rarest = count[self.terms[self.begin]]
        for i in range(1, self.window):
            np.minimum(rarest, np.where(i < self.size, count[self.terms[self.begin + i]], count[n]), out=rarest)
        live = np.flatnonzero(rarest > 0)
        # a window costs some room of its own, besides its candidates
        room = np.cumsum(rarest[live] + 2 * self.window)
        cuts = np.searchsorted(room, np.arange(CANDIDATES, (int(room[-1]) if len(room) else 0) + CANDIDATES, CANDIDATES))
        for some in np.split(live, cuts):
            if len(some):
                yield self._matched(some, first, count, term_at, shard.at)

    def _matched(self, some: np.ndarray, first: np.ndarray, count: np.ndarray, term_at: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rarest terms' lists, moved back by their offsets and intersected with the others', the next rarest first."""
        offsets = np.arange(self.window)
        terms = self.terms[self.begin[some][:, None] + offsets]
        terms[offsets >= self.size[some][:, None]] = len(self.number)
        order = np.argsort(count[terms], axis=1, kind="stable")
        rows = np.arange(len(some))
        lead = terms[rows, order[:, 0]]
        n = count[lead]
        which = np.repeat(rows, n)
        begin = at[np.arange(int(n.sum())) + np.repeat(first[lead] - (np.cumsum(n) - n), n)] - order[which, 0]
        ok = begin >= 0
        which, begin = which[ok], begin[ok]
        for k in range(1, self.window):
            offset = order[which, k]
            ok = (offset >= self.size[some[which]]) | (term_at[begin + offset] == terms[which, offset])
            which, begin = which[ok], begin[ok]
        return some[which], begin


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[Row]]:
    """The items in blocks of about block_bytes of text, chosen by the hash of id and text; only one block is in the driver at a time."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + size // block_bytes
    for i in range(n):
        part = items.select("item_id", "text").where("text is not null")
        yield (part.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else part).collect()


def vocabulary(items: DataFrame, most_terms: int = MOST_TERMS) -> set[bytes] | None:
    """The terms of all items, or None if there are more than most_terms."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(arrow):
            found = sorted({w for x in batch.column("text") for w in words(x.as_py())})
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found], pa.string())], ["term"])

    found = items.select("text").mapInArrow(run, "term string").distinct().limit(most_terms + 1).toArrow()["term"].to_pylist()
    return None if len(found) > most_terms else {t.encode() for t in found}


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES, most_terms: int = MOST_TERMS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs (doc_id, text), against items (item_id, text).

    A window is `window` consecutive words of an item, or a shorter item's words; a document's word inside
    any occurrence of one is hit. The index of docs is written once, with the items' terms or, if these are more than
    most_terms, all. Items are looked up in it in blocks of bounded size; one block needs no shuffle, more of them
    are put together by a document's place in the written index. Null and empty texts have no words and
    null and empty items no windows; null item ids hit words but aren't listed; repeated rows and null doc ids are
    searched row by row; other columns are ignored. A very long text is a shard of its own, held by one task.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    index = written(build_index(docs, vocabulary(items, most_terms), shard_bytes))
    blocks = [Windows(block, window) for block in item_blocks(items, block_bytes)]
    out = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    if len(blocks) == 1:
        # one function: each of two in a row has a worker of its own in every task, and a session's workers stay and are used by turns
        search = _search(blocks[0])
        return index.mapInArrow(lambda arrow: _digest(map(_alone, search(arrow))), out)
    every = searched(index, blocks[0])
    for b in blocks[1:]:
        every = every.unionByName(searched(index, b))
    merged = every.groupBy("shard", "slot").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    return merged.mapInArrow(_digest, out)


def searched(index: DataFrame, windows: Windows) -> DataFrame:
    """A row for each document of an index: merged [begin, end) spans of hit words, one behind the other, and the items found."""
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    return index.mapInArrow(_search(windows), f"shard string, slot int, doc_id {kind}, n_words long, spans array<long>, items array<string>")


def _search(windows: Windows) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            id_type = batch.schema.field("doc_ids").type.value_type
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                shard = Shard(row)
                edges = np.zeros(len(shard) + windows.window, np.int64)
                items: list[set[str]] = [set() for _ in shard.doc_ids]
                for which, begin in windows.found(shard):
                    edges += np.bincount(begin, minlength=len(edges)) - np.bincount(begin + windows.size[which], minlength=len(edges))
                    pairs = np.unique(shard.doc_of(begin) * len(windows.items) + windows.item[which])
                    for d, item in zip(*(x.tolist() for x in np.divmod(pairs, len(windows.items)))):
                        if windows.items[item] is not None:
                            items[d].add(windows.items[item])
                edge = np.flatnonzero(np.diff((np.cumsum(edges) > 0).astype(np.int8), prepend=0))
                owner = shard.doc_of(edge[::2])
                spans: list[list[int]] = [[] for _ in items]
                for d, b, e in zip(owner.tolist(), edge[::2].tolist(), edge[1::2].tolist()):
                    spans[d] += [b - int(shard.starts[d]), e - int(shard.starts[d])]
                n = len(items)
                columns = [pa.array([row["shard"]] * n), pa.array(range(n), pa.int32()), pa.array(shard.doc_ids, id_type), pa.array(shard.n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "slot", "doc_id", "n_words", "spans", "items"])

    return run


def _alone(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of one block's search as those of several blocks look when put together."""
    ends = pa.array(range(batch.num_rows + 1), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, batch.column(c)) for c in ("spans", "items")]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), *lists], ["doc_id", "n_words", "spans", "items"])


def _digest(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrow:
        n_hit, n_items, digests = [], [], []
        for blocks, items in zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist()):
            end = n = 0
            for b, e in sorted(s for x in blocks for s in zip(x[::2], x[1::2])):
                n += max(0, e - max(b, end))
                end = max(e, end)
            found = sorted({i for x in items for i in x})
            n_hit.append(n)
            n_items.append(len(found))
            digests.append(hashlib.sha256(",".join(found).encode()).hexdigest())
        columns = [batch.column("doc_id"), batch.column("n_words"), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digests, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def clean(docs: DataFrame, items: DataFrame, **parameters) -> DataFrame:
    """The rows of docs, all columns, that aren't contaminated.

    Rows are judged one by one, those that repeat an id or have none too: a row is told by its id and its text's hashes
    and length together. Null and empty texts stay. Only contaminated rows' ids and hashes meet docs again.
    """
    told = ("doc_id", "text_hash", "text_sum", "n_bytes")
    sums = F.xxhash64("text").alias("text_hash"), F.crc32(F.col("text").cast("binary")).alias("text_sum"), F.octet_length("text").alias("n_bytes")
    rows = docs.where("text is not null").select(F.struct("doc_id", *sums).alias("doc_id"), "text")
    hit = contamination(rows, items, **parameters).where("contaminated").select("doc_id.*").distinct()
    hit = written(hit.toDF(*(f"_hit_{c}" for c in told)))
    same = [F.col("doc_id").eqNullSafe(F.col("_hit_doc_id")), sums[0] == F.col("_hit_text_hash"), sums[1] == F.col("_hit_text_sum"), sums[2] == F.col("_hit_n_bytes")]
    return matched(docs, hit, same, "left_anti")
