"""Language identification by rank-order profiles of letter n-grams and their out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import small

UNKNOWN = "und"
NS = (1, 2, 3)
#: Most letters that get a number of their own while n-grams are counted densely.
DENSE = 120
_NOT_LETTERS = regex.compile(r"[^\p{L}]+")


def letters(text: str) -> str:
    """Lower-cased words between single spaces, one at either end; empty if there is no letter."""
    found = _NOT_LETTERS.sub(" ", text.lower()).strip(" ")
    return f" {found} " if found else ""


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_counts(text: str) -> dict[str, int]:
    """How often each n-gram occurs in a cleaned text; n-grams that are or span a space between words don't count."""
    cp = code_points(text)
    present = np.flatnonzero(np.bincount(cp)) if len(cp) else cp
    of = np.zeros(int(present[-1]) + 1 if len(present) else 1, np.int64)
    of[present] = np.arange(len(present))
    at, size, out = of[cp], max(1, len(present)), {}
    space = at == of[32] if len(of) > 32 else np.zeros(len(at), bool)
    for n in NS:
        keys, keep = np.zeros(max(0, len(at) - n + 1), np.int64), np.ones(max(0, len(at) - n + 1), bool)
        for i in range(n):
            keys = keys * size + at[i : len(at) - n + 1 + i]
        if n == 1:
            keep &= ~space
        else:  # a space may only stand at one end, and a pair of them is no n-gram
            for i in range(1, n - 1):
                keep &= ~space[i : len(at) - n + 1 + i]
            keep &= ~(space[: len(keep)] & space[n - 1 : n - 1 + len(keep)] & (n == 2))
        keys = keys[keep]
        if size <= DENSE:
            counts = np.bincount(keys, minlength=1)
            kinds = np.flatnonzero(counts)
            counts = counts[kinds]
        else:
            kinds, counts = np.unique(keys, return_counts=True)
        digits = []
        rest = kinds
        for _ in range(n):
            digits.append(present[rest % size])
            rest = rest // size
        for k in zip(counts.tolist(), *(d.tolist() for d in reversed(digits))):
            out["".join(map(chr, k[1:]))] = k[0]
    return out


@dataclass(frozen=True)
class Profiles:
    """For each language, its most frequent n-grams in order; at most `size` of them."""

    languages: tuple[str, ...]
    ranked: dict[str, tuple[str, ...]]
    size: int

    def matrix(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The letters in use, the sorted keys of all n-grams, and each one's rank by language (size where it is absent)."""
        alphabet = np.array(sorted({ord(c) for grams in self.ranked.values() for g in grams for c in g} | {32}), np.uint32)
        keys = sorted({int(self.key(alphabet, g)) for grams in self.ranked.values() for g in grams})
        where = {k: i for i, k in enumerate(keys)}
        ranks = np.full((len(keys), len(self.languages)), self.size, np.int64)
        for j, lang in enumerate(self.languages):
            for rank, g in enumerate(self.ranked[lang]):
                ranks[where[int(self.key(alphabet, g))], j] = rank
        return alphabet, np.array(keys, np.int64), ranks

    @staticmethod
    def key(alphabet: np.ndarray, gram: str) -> int:
        """n-grams as numbers: letters count from 1, so that lengths differ; letters outside the alphabet share the last."""
        at, base = 0, len(alphabet) + 2
        for c in gram:
            i = int(np.searchsorted(alphabet, ord(c)))
            at = at * base + (i + 1 if i < len(alphabet) and alphabet[i] == ord(c) else len(alphabet) + 1)
        return at


def fit(docs: DataFrame, profile_size: int = 400, flush_grams: int = 300_000, most_languages: int = 2_000) -> Profiles:
    """Profiles from every row of docs (text, lang) with a text and a language.

    Tasks count the n-grams of their own rows by language, sums are combined before they shuffle, and only
    profile_size n-grams of each language reach the driver; more than most_languages of these are an error,
    as the profiles are sent to every task. Ties go to the shorter n-gram, then to the one that sorts first, as in documents.
    """

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, int]] = {}

        def out() -> pa.RecordBatch:
            rows = [(lang, g, n) for lang, grams in held.items() for g, n in grams.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "gram", "n"])

        for batch in small(arrow):
            texts: dict[str, list[str]] = {}
            size = 0
            for text, lang in zip(batch.column("text"), batch.column("lang")):
                clean = letters(text.as_py())
                texts.setdefault(lang.as_py(), []).append(clean)
                size += len(clean)
                if size > 8_000_000:
                    _count(texts, held)
                    size = 0
            _count(texts, held)
            if sum(map(len, held.values())) > flush_grams:
                yield out()
        if held:
            yield out()

    counted = docs.select("text", "lang").where("text is not null and lang is not null").mapInArrow(run, "lang string, gram string, n long")
    sums = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.length("gram"), "gram")
    top = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= profile_size)
    rows = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "gram"))).alias("grams")).limit(most_languages + 1).collect()
    if len(rows) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    ranked = {r["lang"]: tuple(g["gram"] for g in r["grams"]) for r in rows}
    return Profiles(tuple(sorted(ranked)), ranked, profile_size)


def _count(texts: dict[str, list[str]], held: dict[str, dict[str, int]]) -> None:
    for lang, each in texts.items():
        grams = held.setdefault(lang, {})
        for g, n in gram_counts("".join(each)).items():
            grams[g] = grams.get(g, 0) + n
    texts.clear()


def nearest(profiles: Profiles, most_frequent: int = 300):
    """A function from a text to (language, score): the profile at the least out-of-place distance."""
    alphabet, keys, ranks = profiles.matrix()
    base = len(alphabet) + 2
    of = np.full(int(alphabet[-1]) + 2, len(alphabet) + 1, np.int64)
    of[alphabet] = np.arange(1, len(alphabet) + 1)
    space = int(of[32])

    def predict(text: str | None) -> tuple[str, float]:
        clean = letters(text or "")
        if not clean or not profiles.languages:
            return UNKNOWN, 0.0
        at = of[np.minimum(code_points(clean), len(of) - 1)]
        blank = at == space
        two = at[:-1] * base + at[1:]
        three = two[:-1] * base + at[2:]
        grams, counts = np.unique(np.concatenate([at[~blank], two, three[~blank[1:-1]]]), return_counts=True)
        # ties go to the smaller key: np.unique sorts and the sort by count is stable
        top = grams[np.argsort(-counts, kind="stable")[:most_frequent]]
        where = np.minimum(np.searchsorted(keys, top), len(keys) - 1)
        of_lang = np.where((keys[where] == top)[:, None], ranks[where], profiles.size)
        own = np.arange(len(top))[:, None]
        away = np.where(of_lang < profiles.size, np.abs(of_lang - own), profiles.size).sum(axis=0)
        best = int(np.argmin(away))
        return profiles.languages[best], float(1 - away[best] / (profiles.size * len(top)))

    return predict


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs (doc_id, text), in one pass without a shuffle.

    The score is 1 less the distance's share of its largest value. A null text, one without a letter and
    any text when there are no profiles are `und` with score 0. Ties go to the language that sorts first.
    Repeated rows and null ids are predicted row by row; other columns are never read.
    """

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = nearest(profiles)
        for batch in small(arrow):
            found = [near(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
