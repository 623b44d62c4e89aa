"""Quality rules as a ledger: every rule is evaluated once, its outcome kept as a bit beside the measurements.

Policies are versioned masks over those bits, so that a policy's verdict, or what a rule alone
changes, comes from the ledger by bitwise operations and never from the texts again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import small

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 5
#: What counts as a word and as a symbol.
WORD, SYMBOLS = regex.compile(r"[^ \t-\r]+"), "#*$%&|<>"
_SPACE = regex.compile(r"[ \t-\r]")
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Characters of a text whose words are strings at a time, about.
STRETCH = 1_000_000

#: Rules in bit order: name, and what fails. The order never changes; new rules are appended.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
    ("symbols", "2 * n_symbols > n_words"),
    ("repeated_lines", "20 * n_dup_lines > n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A version's rules: a document fails if one of them fails."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [n for n, _ in RULES]
        return sum(1 << names.index(r) for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_words"))
POLICIES = {p.version: p for p in (BASE, Policy("2", ("few_words", "repeated_words", "short_words", "long_words", "symbols", "repeated_lines")))}


def stretches(text: str) -> Iterator[str]:
    """A text in parts of about STRETCH characters that begin at white space, so that no word is cut."""
    begin = 0
    while begin < len(text):
        m = _SPACE.search(text, begin + STRETCH)
        end = m.start() if m else len(text)
        yield text[begin:end] if end - begin < len(text) else text
        begin = end


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """The five measurements of a whole text; null has no words. Words are held as numbers, not as strings."""
    text = text or ""
    number: dict[str, int] = {}
    parts, chars = [], 0
    for part in stretches(text):
        words = WORD.findall(part)
        chars += sum(map(len, words))
        parts.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
    words = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    # with no word twice no window is
    n_repeat = repeated(words) if len(number) < len(words) else 0
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup_lines(text), n_repeat


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    n = begin = 0
    seen: set[str] = set()
    while "\n" in text and begin <= len(text):
        end = text.find("\n", begin)
        end = len(text) if end < 0 else end
        line = text[begin:end]
        if line in seen:
            n += WORD.search(line) is not None
        seen.add(line)
        begin = end + 1
    return n


def repeated(words: np.ndarray, n: int = WINDOW) -> int:
    """Words inside windows of n words that occur twice or more, the first occurrence included. words: equal numbers for equal words.

    Windows are hashed and sorted; those with equal hashes are compared word by word.
    """
    size = len(words) - n + 1
    if size < 2:
        return 0
    h = np.zeros(size, np.uint64)
    for i in range(n):
        h = (h ^ words[i : i + size].astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(32)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    a, b = order[:-1][same], order[1:][same]
    if any((words[a + i] != words[b + i]).any() for i in range(n)):
        # two different windows with one hash: sort the windows themselves
        order = np.lexsort([words[i : i + size] for i in range(n)])
        same = np.logical_and.reduce([words[order[1:] + i] == words[order[:-1] + i] for i in range(n)])
        a, b = order[:-1][same], order[1:][same]
    starts = np.zeros(len(words), np.int64)
    starts[a] = starts[b] = 1
    inside = np.cumsum(starts)
    inside[n:] -= inside[:-n].copy()
    return int((inside > 0).sum())


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and `failed` (a bit for each of RULES) for every row of docs (doc_id, text).

    One pass without a shuffle. Null and empty texts have no words and fail few_words; repeated rows
    and null ids are measured row by row; other columns are ignored. Texts are measured whole, one at a time.
    """

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(arrow):
            rows = [measure(x.as_py()) for x in batch.column("text")]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *MEASURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    measured = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured.withColumn("failed", failed.cast("int"))


def fails(failed: Column, policy: Policy) -> Column:
    return failed.bitwiseAND(F.lit(policy.mask)) != 0


def verdicts(rows: DataFrame, version: str = "2") -> DataFrame:
    """A ledger's rows with base_failed and kept under a policy version; null ids and repeated rows are judged row by row."""
    base = fails(F.col("failed"), BASE)
    return rows.select("doc_id", *MEASURES, base.alias("base_failed"), (~base & ~fails(F.col("failed"), POLICIES[version])).alias("kept"), "failed")


def ablations(rows: DataFrame, version: str = "2") -> DataFrame:
    """A row for each rule of a policy: documents that fail it, that fail it alone, and that the policy keeps with and without it.

    The ledger is first counted by its bits, of which there are at most 2 ** len(RULES) kinds. An empty ledger gives no rows.
    """
    policy = POLICIES[version]
    kinds = rows.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    names = [n for n, _ in RULES]
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).alias("bit")) for r in policy.rules))
    each = kinds.select("bits", "n", F.inline(rules))
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    return each.groupBy("rule", "bit").agg(
        some(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        some(F.col("bits") == F.col("bit")).alias("n_failed_alone"),
        some(F.col("bits") == 0).alias("n_kept"),
        some(rest == 0).alias("n_kept_without"),
    )
