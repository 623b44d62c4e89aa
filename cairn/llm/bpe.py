"""BPE encoding and decoding by dynamic programming over prefixes.

Every prefix of a word has exactly one last token in its encoding. A prefix's candidates are the
vocabulary's suffix matches at its end, found with an automaton over the tokens; a candidate is right
if it may follow the last token of the prefix before it, which only depends on the two tokens.
Back-pointers from the word's end give the ids.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cairn.llm.common import small

#: Fixed values of the tokenizer's definition: its split pattern, Unicode's white space, its word end.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\p{L}\p{N}]+"
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
WORD_END = "</w>"
#: Entries that each worker remembers, of texts between white space and of pairs.
CACHE_ENTRIES, PAIR_ENTRIES = 300_000, 150_000
#: A private-use character that stands for the end of a word.
CLOSE = "\ue000"


def byte_symbols() -> list[str]:
    """The printable stand-in for each byte that byte-level vocabularies use."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 0x100
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class WordBpe:
    """One vocabulary: words to ids, ids to text."""

    def __init__(self, definition: dict):
        model = definition["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in definition["added_tokens"]}
        self.text_of = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.symbol = byte_symbols()
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for n, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            pair, whole = (self.vocab[a], self.vocab[b]), self.vocab[a + b]
            self.rank[pair], self.parts[whole] = n, (n, *pair)
        self.compatible: dict[int, bool] = {}
        #: Symbols of each reachable token, and the symbol of each byte as a translation of Latin-1.
        self.size = [0] * (1 + max(self.vocab.values()))
        self.table = dict(enumerate(self.symbol))
        self.matches = self._automaton()
        self._word = regex.compile(SPLIT)

    def _automaton(self):
        """An automaton over the reachable tokens, which reports those that end at each place of a word.

        A closing mark behind the word tells tokens that end a word from those that don't.
        """
        found = ahocorasick.Automaton()
        for token, i in self.vocab.items():
            if self._reachable(i):
                text = token[: -len(WORD_END)] + CLOSE if token.endswith(WORD_END) else token
                found.add_word(text, i)
                self.size[i] = len(text)
        found.make_automaton()
        return found

    def _reachable(self, token: int) -> bool:
        """Whether the token's own text encodes to it: its two parts are reachable and may meet in a merge."""
        found = self.parts.get(token)
        return found is None or (self._reachable(found[1]) and self._reachable(found[2]) and self._meet(found[1], found[2], found[0]))

    def _meet(self, left: int, right: int, before: int) -> bool:
        """Whether no merge across the border between two tokens would come before rank `before` while they form.

        Going back in time, the part that was merged last is undone first. The two tokens that then face
        each other across the border were there until the part undone last came about; if a merge of
        theirs has a lower rank than that, it would have happened first.
        """
        end = before
        while True:
            n = self.rank.get((left, right))
            if n is not None and n < end:
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[0] > b[0]):
                end, left = a[0], a[2]
            else:
                # of two equal merges the left one goes first, so the border's pair needs to be no later than this
                end, right = b[0] + 1, b[1]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether left and right stay two tokens when their texts stand side by side."""
        known = self.compatible.get(left << 20 | right)
        if known is None:
            if len(self.compatible) >= PAIR_ENTRIES:
                self.compatible.clear()
            known = self.compatible[left << 20 | right] = self._meet(left, right, len(self.rank))
        return known

    def word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        plain = word.isascii() and word.isprintable()
        symbols = (word if plain else word.encode().decode("latin-1").translate(self.table)) + CLOSE
        last = [-1] * len(symbols)
        may, size = self.compatible, self.size
        for end, token in self.matches.iter(symbols):
            if last[end] < 0:
                begin = end - size[token]
                if begin >= 0:
                    before = last[begin]
                    if before < 0:
                        continue
                    ok = may.get(before << 20 | token)
                    if not (self.may_follow(before, token) if ok is None else ok):
                        continue
                last[end] = token
        # the tokens' sizes are the back-pointers
        ids, at = [], len(symbols) - 1
        while at >= 0:
            ids.append(last[at])
            at -= size[last[at]]
        return ids[::-1]

    def chunk(self, chunk: str) -> list[int]:
        """Ids of a text without special strings."""
        if not chunk.isascii() and not unicodedata.is_normalized("NFC", chunk):
            chunk = unicodedata.normalize("NFC", chunk)
        # lower case letter by letter, without the final-sigma rule
        chunk = chunk.replace("Σ", "σ").lower()
        if chunk.isalpha():
            return self.word(chunk)
        return [i for w in self._word.findall(chunk) for i in self.word(w)]


class Encoder:
    """Whole texts to ids and back, remembering what chunks between white space became."""

    def __init__(self, bpe: WordBpe, cache_entries: int = CACHE_ENTRIES):
        self.bpe, self.most = bpe, cache_entries
        self._special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(bpe.special, key=len, reverse=True)) + ")") if bpe.special else None
        self._space = regex.compile(SPACE)
        self._odd = regex.compile("[\x1c-\x1f]")
        encoder = self

        class Cache(dict):
            """The newer half of what is remembered; the older half goes when this one is full, but for what was met again."""

            older: dict[str, bytes] = {}

            def __missing__(self, chunk: str) -> bytes:
                ids = self.older.get(chunk)
                if ids is None:
                    ids = array("I", encoder.bpe.chunk(chunk)).tobytes()
                if len(chunk) <= 200:
                    if 2 * len(self) >= encoder.most:
                        self.older = dict(self)
                        self.clear()
                    self[chunk] = ids
                return ids

        self.cache = Cache()

    def encode(self, text: str) -> array:
        """Ids of a whole text; special strings inside it are their own ids."""
        out = array("I")
        pieces = self._special.split(text) if self._special and any(s in text for s in self.bpe.special) else [text]
        for piece in pieces:
            if piece in self.bpe.special:
                out.append(self.bpe.special[piece])
            elif piece:
                chunks = self._space.split(piece) if self._odd.search(piece) else piece.split()
                out.frombytes(b"".join(map(self.cache.__getitem__, chunks)))
        return out

    def decode(self, ids: array) -> str:
        """The text of ids: without a decoder, tokens stand side by side with spaces between."""
        return " ".join(map(self.bpe.text_of.__getitem__, ids))


def load(path: str) -> Encoder:
    with open(path, encoding="utf-8") as f:
        return Encoder(WordBpe(json.load(f)))


_LOADED: dict[str, Encoder] = {}


def encoder_at(model: str) -> Encoder:
    """One encoder for each worker and file; model is a public tokenizer's name or a path."""
    if model not in _LOADED:
        import public_tokenizers

        _LOADED[model] = load(model if os.path.isabs(model) else public_tokenizers.path(model))
    return _LOADED[model]


def encode(docs: DataFrame, model: str, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids, for every row of docs (doc_id, text).

    One pass without a shuffle. Null and empty texts have no ids. Repeated rows and null ids are
    encoded row by row; other columns are ignored. Memory holds a batch's results, the vocabulary and a
    bounded cache, so very long texts cost no more than their own ids.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_at(model)
        for batch in small(arrow):
            found, lengths, hashes, texts = [], [], [], []
            for x in batch.column("text"):
                got = enc.encode(x.as_py() or "")
                lengths.append(len(got))
                hashes.append(hashlib.sha256(got.tobytes()).hexdigest())
                texts.append(hashlib.sha256(enc.decode(got).encode()).hexdigest())
                if ids:
                    found.append(got)
            columns = [batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(hashes, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [_lists(found)] * ids, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)


def _lists(found: list[array]) -> pa.ListArray:
    """Ids of several texts as one column."""
    ends = np.cumsum([0, *map(len, found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text for rows of (doc_id, ids): the inverse of encode up to what the tokenizer drops. Null ids give empty texts."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_at(model)
        for batch in arrow:
            texts = [enc.decode(x.as_py() or []) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")
