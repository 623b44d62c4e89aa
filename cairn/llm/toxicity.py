"""Toxicity by a convolutional text classifier: hashed word embeddings, filters of several widths, max pooling, trained in numpy.

A word's embedding is the sum of the embeddings of its hash and of its prefixes' hashes, so that unseen
forms of a word are near those seen. Hashes have 32 bits; only those met in training have a vector, the
rest are zero. Narrow filters see words beside each other; wide ones sum a narrow filter's positive responses over SPAN
words, so that what single words can't decide is decided by how thickly they stand. Thresholds are calibrated for each
language, which is told from the text by words that are frequent in one language's training texts and rare in the others'.

Everything is learned from all labelled documents: words are counted by Spark, tasks train networks from a common start on parts
of the texts, their parameters are averaged, and the thresholds come from what networks say of documents that they didn't learn from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from uuid import uuid4
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import SENT_BYTES, matched, released, scored, shared_dir, small, written
from cairn.tables import dropped

#: Widths of the narrow filters and how many there are of each, wide filters and the words that these span, dimensions, prefixes.
WIDTHS, FILTERS, WIDE, SPAN, DIM, PREFIXES = (1, 2, 3), 8, 4, 100, 12, range(3, 8)
FEATURES = 1 + len(PREFIXES)
POOLED = FILTERS * len(WIDTHS) + WIDE
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_WORD_OR_END = regex.compile(_WORD.pattern + r"|\n")
#: Characters of texts whose words are numbered together, and whose vectors are held at once, where texts are scored.
READ_CHARS, HELD_CHARS = 4_000_000, 1_000_000
#: Texts' worth of belief that a hash says nothing, parts of the documents that calibrate, the hash of no prefix,
#: and how far the shares of the classes weigh errors where thresholds are chosen.
PRIOR, FOLDS, ABSENT, WEIGHT = 16.0, 3, 0, 0.75
#: Words that tell a language, at most; languages told apart, at most; their labelled texts, at least.
TELLING, LANGUAGES, LANGUAGE_TEXTS = 200, 64, 12
#: Texts that a hash with a vector of its own stands in, at least, and of how many texts: more texts, more of these. Steps of a logit, and bytes of text whose words are numbered together.
SEEN, SEEN_OF, LOGIT_STEPS, NUMBERED = 3, 16_000, 1024, 8_000_000
#: Hashes whose counts are shuffled in one row agree in all but the last bits; vectors that are shuffled in one row stand next to each other.
LAST_BITS, BESIDE = 24, 2048
#: Rows that are looked up or drawn at once, so that what a step needs besides its result is small.
STRETCH = 20_000


def word_hashes(word: str) -> list[int]:
    """Hashes of a lower-cased word and of its prefixes, 0 for those longer than it."""
    whole, size = word.encode("utf-8", "surrogatepass"), len(word)
    if len(whole) > size:
        return [crc32(whole), *[crc32(word[:n].encode("utf-8", "surrogatepass"), n) if n <= size else 0 for n in PREFIXES]]
    if size < PREFIXES[-1]:
        return [crc32(whole), *[crc32(whole[:n], n) if n <= size else 0 for n in PREFIXES]]
    out = [crc32(whole)]
    for n in PREFIXES:
        out.append(crc32(whole[:n], n))
    return out


#: Longest word, in bytes, that is hashed beside others; the checksum's step for each byte, and what starting from n and not from 0 changes after so many bytes.
_BESIDE_BYTES, _ALL = 64, np.uint32(0xFFFFFFFF)
_STEPS = np.array([crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)
_FROM = np.array([[crc32(bytes(size), n) ^ crc32(bytes(size)) for size in range(4 * max(PREFIXES) + 1)] for n in PREFIXES], np.uint32)


def hashed(words: pa.StringArray) -> np.ndarray:
    """word_hashes of each word in a row, of many words at once: a checksum's steps are taken byte by byte for all of them."""
    out = np.zeros((len(words), FEATURES), np.uint32)
    for low in range(0, len(words), STRETCH):
        part = words.slice(low, STRETCH)
        offsets = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1].astype(np.int64)
        data = np.frombuffer(part.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        begins, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
        # longest first, so that those with another byte stand in front
        order = np.argsort(-sizes, kind="stable")
        order = order[np.searchsorted(-sizes[order], -_BESIDE_BYTES) :]
        begin, size = begins[order], sizes[order]
        after = np.empty((size.max(initial=0) + 1, len(order)), np.uint32)
        after[0] = _ALL
        for i in range(len(after) - 1):
            n = np.searchsorted(-size, -i)
            was = after[i, :n]
            after[i + 1, :n] = _STEPS[was.astype(np.uint8) ^ data[begin[:n] + i]] ^ was >> np.uint32(8)
        after ^= _ALL
        rows = np.zeros((len(order), FEATURES), np.uint32)
        rows[:, 0] = after[size, np.arange(len(order))]
        # where characters begin: a prefix ends where the next one does
        chars = np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))
        first, last = np.searchsorted(chars, begin), np.searchsorted(chars, begin + size)
        for j, n in enumerate(PREFIXES):
            some = np.flatnonzero(last - first >= n)
            ends = chars[first[some] + n] - begin[some]
            rows[some, 1 + j] = after[ends, some] ^ _FROM[j, ends]
        out[low + order] = rows
        for i in np.flatnonzero(sizes > _BESIDE_BYTES):
            out[low + i] = word_hashes(part[i].as_py())
    return out


def numbered(texts: list[str]) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """The distinct words of lower-cased texts, all words of all texts as numbers of these, and how many words each text has.

    Chunks between white space are told apart first; each one that isn't a word of ASCII letters is searched for words once.
    """
    split = pc.utf8_split_whitespace(pa.array([t.lower() for t in texts], pa.string()))
    chunks, offsets = split.flatten().dictionary_encode(), split.offsets.to_numpy().copy()
    del split
    at, plain = chunks.indices.to_numpy(), pc.ascii_is_alpha(chunks.dictionary)
    mixed = chunks.dictionary.filter(pc.invert(plain))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(mixed)], pa.int32()), mixed), "\n")[0].as_py()
    found = pa.array(_WORD_OR_END.findall(joined + "\n") if len(mixed) else [], pa.string())
    end = pc.equal(found, "\n")
    words = pa.concat_arrays([chunks.dictionary.filter(plain), found.filter(pc.invert(end))]).dictionary_encode()
    # of each chunk how many words it has, and where these begin
    plain = plain.to_numpy(zero_copy_only=False)
    n, first = np.ones(len(plain), np.int32), np.empty(len(plain), np.int32)
    n[~plain] = np.diff(np.flatnonzero(end.to_numpy(zero_copy_only=False)), prepend=-1) - 1
    first[plain], first[~plain] = np.arange(plain.sum()), plain.sum() + np.cumsum(n[~plain]) - n[~plain]
    n = n.take(at)
    before = np.zeros(len(n) + 1, np.int32)
    np.cumsum(n, out=before[1:])
    places = np.repeat(first.take(at) - before[:-1], n)
    places += np.arange(before[-1], dtype=np.int32)
    return words.dictionary, words.indices.to_numpy().take(places), np.diff(before[offsets])


@dataclass
class Network:
    """hashes: sorted, with a row of `vectors` each; kernels: by width (width, DIM, FILTERS); wide: (DIM, WIDE); out: weights of the pooled filters.

    languages: a number for each hash of a word that tells one; thresholds: of each language, and last of texts that tell none.
    """

    hashes: np.ndarray
    vectors: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    wide: np.ndarray
    wide_bias: np.ndarray
    out: np.ndarray
    bias: float
    languages: dict[int, int] = field(default_factory=dict)
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def pooled(self, words: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each text. words: vectors of all texts, each followed by max(WIDTHS) rows of zeros."""
        tops = []
        for k, b in zip(self.kernels, self.biases):
            tops.append(np.maximum(np.maximum.reduceat(responses(words, begins, k), begins, axis=0) + b, 0))
        sums, _, _ = self.spans(words, begins)
        tops.append(np.maximum.reduceat(sums, begins, axis=0))
        return np.concatenate(tops, axis=1)

    def spans(self, words: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The wide filters' sums from each word on, the responses summed, and where each sum ends: after SPAN words or with the text."""
        r = np.maximum(words @ self.wide + self.wide_bias, 0)
        total = np.concatenate([np.zeros((1, WIDE)), np.cumsum(r, axis=0, dtype=np.float64)])
        ends = np.append(begins[1:], len(words)) - max(WIDTHS)
        stop = np.minimum(np.arange(len(words)) + SPAN, np.repeat(ends, np.diff(np.append(begins, len(words)))))
        stop = np.maximum(stop, np.arange(len(words)))
        return (total.take(stop, axis=0) - total[:-1]).astype(np.float32), r, stop

    def logits(self, words: np.ndarray, begins: np.ndarray) -> np.ndarray:
        return self.pooled(words, begins) @ self.out + self.bias


def responses(words: np.ndarray, begins: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """A narrow filter's response at each place but the last; 0, as where only zeros are, where a window reaches into the next text."""
    n = len(words) - len(kernel) + 1
    r = words[:n] @ kernel[0]
    for i in range(1, len(kernel)):
        r += words[i : n + i] @ kernel[i]
    for i in range(1, len(kernel)):
        r[begins[1:] - i] = 0
    return r


class Reader:
    """Texts to the vectors of the words that fit() reads in them."""

    def __init__(self, network: Network):
        self.network = network
        self.telling = np.array(sorted(network.languages), np.int64)
        self.n_languages = len(network.thresholds) - 1
        self.told = np.array([self.n_languages, *(network.languages[h] for h in sorted(network.languages))], np.int64)

    def parts(self, texts: list[str], most_chars: int = HELD_CHARS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of texts in turn, about most_chars together: word vectors with zeros behind each text, where each begins, and each text's language. Words are looked up once for all parts."""
        words, numbers, length = numbered(texts)
        hashes = hashed(words).astype(np.int64)
        # no word, behind each text, has the last row
        known = _embedded(self.network, hashes, 1)
        spoken = np.append(self.told[_known(hashes[:, 0], self.telling)], self.n_languages)
        del words, hashes
        ends, chars, n = np.cumsum(length), np.cumsum([len(t) for t in texts]), self.n_languages
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(chars, (chars[low - 1] if low else 0) + most_chars, side="right")))
            own, size = numbers[ends[low] - length[low] : ends[high - 1]], length[low:high]
            begins = np.cumsum(size + max(WIDTHS)) - size - max(WIDTHS)
            at = np.full(len(own) + max(WIDTHS) * (high - low), len(known) - 1, np.int64)
            at[np.arange(len(own)) + np.repeat(max(WIDTHS) * np.arange(high - low), size)] = own
            text_of = np.repeat(np.arange(high - low), size)
            told = np.bincount(text_of * (n + 1) + spoken[own], minlength=(high - low) * (n + 1)).reshape(high - low, n + 1)[:, :n]
            yield known.take(at, axis=0), begins, np.where(told.max(axis=1, initial=0) > 0, told.argmax(axis=1) if n else n, n)
            low = high

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All texts as one part."""
        return next(self.parts(texts, max(1, sum(map(len, texts)))))


def scores(network: Network, reader: Reader, texts: list[str]) -> np.ndarray:
    """0 to 1; the threshold of the text's language is at 0.5. Texts go in groups of bounded length."""
    out, group, size = [], [], 0
    for t in [*texts, None]:
        if group and (t is None or size + len(t) > READ_CHARS):
            for words, begins, language in reader.parts(group):
                z = np.clip(network.logits(words, begins) - network.thresholds[language], -30, 30)
                out.append(1 / (1 + np.exp(-z)))
            group, size = [], 0
        if t is not None:
            group.append(t)
            size += len(t)
    return np.concatenate(out) if out else np.zeros(0)


@dataclass
class Start:
    """Where all tasks begin to train: hashes with vectors of their own, sorted as signed numbers, their log-odds of toxic texts, and the toxic share of the texts."""

    hashes: np.ndarray
    odds: np.ndarray
    share: float

    def network(self, seed: int = 3) -> tuple[Network, np.random.Generator]:
        """The same for each seed: log-odds on dimension 0 of the vectors and noise on the others, and the first filters as what dimension 0 says, of one word and of many."""
        rng = np.random.default_rng(seed)
        kernels = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        wide = rng.normal(0, 0.2, (DIM, WIDE)).astype(np.float32)
        out = rng.normal(0, 0.1, POOLED)
        vectors = np.empty((len(self.hashes), DIM), np.float32)
        for low in range(0, len(vectors), STRETCH):
            vectors[low : low + STRETCH] = rng.normal(0, 0.05, vectors[low : low + STRETCH].shape)
        net = Network(self.hashes, vectors, kernels, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], wide, np.full(WIDE, -1, np.float32), out, -10.0)
        if not 0 < self.share < 1:
            out[:] = 0
            return net, rng
        vectors[:, 0] = self.odds / 4
        net.bias = float(np.log(self.share / (1 - self.share)))
        kernels[0][0, :, 0] = wide[:, 0] = np.eye(DIM)[0]
        out[0], out[len(WIDTHS) * FILTERS] = 1.0, 0.5
        return net, rng


def begun(hashes: np.ndarray, n: np.ndarray, n_toxic: np.ndarray, texts: int, toxic: int) -> Start:
    """From each hash's number of texts, and of toxic ones, and those of all texts: a hash in few texts has no vector, and its shorter prefixes speak for it."""
    keep = (n >= max(SEEN, -(-SEEN * texts // SEEN_OF))) & (hashes != ABSENT)
    hashes, n, n_toxic = hashes[keep], n[keep], n_toxic[keep]
    share = toxic / texts if texts else 0.0
    if not 0 < share < 1:
        return Start(np.zeros(0, np.int32), np.zeros(0, np.float32), share)
    odds = np.log((n_toxic + PRIOR * share) / (n - n_toxic + PRIOR * (1 - share))) - np.log(share / (1 - share))
    return Start(hashes, odds.astype(np.float32), share)


def _summed(vectors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sum of the vectors that each row of numbers names."""
    out = vectors.take(rows[:, 0], axis=0)
    for j in range(1, rows.shape[1]):
        out += vectors.take(rows[:, j], axis=0)
    return out


def _embedded(net: Network, table: np.ndarray, more: int = 0) -> np.ndarray:
    """The sum of the vectors of each row of hashes, and so many rows of zeros behind; without a copy of all vectors."""
    out = np.zeros((len(table) + more, DIM), np.float32)
    if not len(net.hashes):
        return out
    for low in range(0, len(table), STRETCH):
        rows = _known(table[low : low + STRETCH], net.hashes)
        part = out[low : low + len(rows)]
        for j in range(rows.shape[1]):
            some = np.flatnonzero(rows[:, j])
            part[some] += net.vectors.take(rows[some, j] - 1, axis=0)
    return out


def _dense(net: Network) -> np.ndarray:
    """All parameters but the vectors, filled up with zeros to a multiple of DIM numbers."""
    flat = np.concatenate([*(k.ravel() for k in net.kernels), *net.biases, net.wide.ravel(), net.wide_bias, net.out, [net.bias]])
    return np.append(flat, np.zeros(-len(flat) % DIM)).reshape(-1, DIM)


def _set_dense(net: Network, rows: np.ndarray) -> None:
    flat, at = rows.ravel(), 0
    for a in [*net.kernels, *net.biases, net.wide, net.wide_bias, net.out]:
        a[...] = flat[at : at + a.size].reshape(a.shape)
        at += a.size
    net.bias = float(flat[at])


def _known(table: np.ndarray, hashes: np.ndarray, more: int = 0) -> np.ndarray:
    """For each hash in table its row of vectors, from 1, or 0; and so many rows of zeros behind."""
    out = np.zeros((len(table) + more, *table.shape[1:]), np.int32)
    if len(hashes):
        for low in range(0, len(table), STRETCH):
            part = table[low : low + STRETCH]
            at = np.minimum(np.searchsorted(hashes, part), len(hashes) - 1)
            out[low : low + len(part)] = np.where(hashes[at] == part, at + 1, 0)
    return out


def learned(start: Start, texts: list[np.ndarray], table: np.ndarray, toxic: np.ndarray, seed: int = 3, least_steps: int = 250, batch: int = 64, rate: float = 0.02) -> Network:
    """A network by Adam on the logistic loss, from all texts once, or up to twelve times until least_steps batches are done. Max pooling sends each filter's gradient to one window a text.

    texts: for each text, or piece of one, its words' rows in table, which has FEATURES hashes for each.
    """
    net, rng = start.network(seed)
    if not len(texts) or not 0 < start.share < 1:
        return net
    # row 0 is the zero vector of hashes that have none
    vectors = np.vstack([np.zeros((1, DIM), np.float32), net.vectors])
    net.vectors = vectors[1:]
    # the last row is that of no word, which stands behind each text
    known = _known(table, net.hashes, 1)
    pad = np.full(max(WIDTHS), len(table), np.int32)
    moments: dict = {}
    place = np.zeros(len(known), np.int32)
    step, most = 0, rate
    # all texts once at least, and twelve times at most
    epoch = -(-len(texts) // batch)
    steps = min(12 * epoch, max(epoch, least_steps))
    for _ in range(-(-steps // epoch)):
        order = rng.permutation(len(texts))
        for low in range(0, min(len(order), (steps - step) * batch), batch):
            # steps shrink to a twentieth, so that the last batches don't decide
            rate = most * (1 - 0.95 * step / steps)
            step += 1
            chosen = order[low : low + batch]
            at = np.concatenate([x for i in chosen for x in (texts[i], pad)])
            begins = np.concatenate([[0], np.cumsum([len(texts[i]) + len(pad) for i in chosen])[:-1]])
            ends = np.append(begins[1:], len(at))
            # a word's vectors are summed once, however often it stands in the batch
            place[at] = -1
            own = np.flatnonzero(place)
            place[own] = np.arange(len(own))
            words = _summed(vectors, known.take(own, axis=0)).take(place[at], axis=0)
            place[own] = 0
            pools, tops = [], []
            for k, b in zip(net.kernels, net.biases):
                r = responses(words, begins, k)
                top = np.stack([lo + r[lo:hi].argmax(axis=0) for lo, hi in zip(begins, ends)])
                tops.append(top)
                pools.append(np.maximum(np.take_along_axis(r, top, 0) + b, 0))
            sums, single, stop = net.spans(words, begins)
            top = np.stack([lo + sums[lo:hi].argmax(axis=0) for lo, hi in zip(begins, ends)])
            pools.append(np.take_along_axis(sums, top, 0))
            p = np.concatenate(pools, axis=1)
            error = (1 / (1 + np.exp(-np.clip(p @ net.out + net.bias, -30, 30))) - toxic[chosen]) / len(chosen)
            d_pool = error[:, None] * net.out * (p > 0)
            gradients = {"out": p.T @ error + 1e-4 * net.out, "bias": error.sum()}
            touched, pushed = [], []
            for w, (k, t) in enumerate(zip(net.kernels, tops)):
                d = d_pool[:, w * FILTERS : (w + 1) * FILTERS]
                gradients["b", w] = d.sum(axis=0)
                gradients["k", w] = np.stack([np.einsum("tfd,tf->df", words[t + i], d) for i in range(len(k))]) + 1e-4 * k
                for i in range(len(k)):
                    touched.append(known[at[t + i]].reshape(-1))
                    pushed.append((d[:, :, None] * k[i].T[None]).reshape(-1, DIM))
            # a wide filter moves by all words that it sums up; their vectors stay as they are
            d_single = np.zeros_like(single)
            for t, d in zip(top, d_pool[:, len(WIDTHS) * FILTERS :]):
                for f in range(WIDE):
                    d_single[t[f] : stop[t[f]], f] += d[f]
            d_single *= single > 0
            gradients["wide"] = words.T @ d_single + 1e-4 * net.wide
            gradients["wide_bias"] = d_single.sum(axis=0)
            # gradients of each vector that was touched, summed; row 0 stays zero
            rows = np.concatenate(touched)
            one = np.flatnonzero(rows)
            one = one[np.argsort(rows[one], kind="stable")]
            rows, where = rows[one], np.unique(rows[one])
            g = np.add.reduceat(np.concatenate(pushed).astype(np.float32)[one // FEATURES], np.searchsorted(rows, where), axis=0) if len(where) else np.zeros((0, DIM), np.float32)
            vectors[where] -= _adam(moments, "v", g, step, rate / 4, where, vectors.shape)
            net.out -= _adam(moments, "out", gradients["out"], step, rate)
            net.bias -= float(_adam(moments, "bias", np.array(gradients["bias"]), step, rate))
            net.wide -= _adam(moments, "wide", gradients["wide"], step, rate / 4).astype(np.float32)
            net.wide_bias -= _adam(moments, "wide_bias", gradients["wide_bias"], step, rate / 4).astype(np.float32)
            for w in range(len(WIDTHS)):
                net.kernels[w] -= _adam(moments, ("k", w), gradients["k", w], step, rate).astype(np.float32)
                net.biases[w] -= _adam(moments, ("b", w), gradients["b", w], step, rate).astype(np.float32)
    return net


def _adam(moments: dict, key, g: np.ndarray, step: int, rate: float, where=None, shape=None) -> np.ndarray:
    if key not in moments:
        moments[key] = np.zeros(shape or g.shape, np.float32), np.zeros(shape or g.shape, np.float32)
    m, v = moments[key]
    at = ... if where is None else where
    m[at] = 0.9 * m[at] + 0.1 * g
    v[at] = 0.99 * v[at] + 0.01 * g * g
    return rate * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.99**step)) + 1e-7)


def calibrate(logits: np.ndarray, languages: np.ndarray, n_toxic: np.ndarray, n_clean: np.ndarray, n_languages: int, least: int = 12) -> np.ndarray:
    """For each language, and last for none, the logit with the least errors, in the middle of the gap there; a language with under
    `least` texts of a class has that of all. A toxic text missed weighs more than a clean one called toxic, by the number of clean texts for each to the power WEIGHT.

    Each place stands for n_toxic and n_clean texts of a language, -1 for none, that have this logit.
    """

    def best(own: np.ndarray) -> float:
        z, where = np.unique(logits[own], return_inverse=True)
        bad, good = (np.bincount(where, weights=n[own], minlength=len(z)) for n in (n_toxic, n_clean))
        # errors if the texts of the first i logits are called clean
        errors = np.concatenate([[0], np.cumsum(bad)]) * max(1.0, good.sum() / bad.sum()) ** WEIGHT + good.sum() - np.concatenate([[0], np.cumsum(good)])
        i = np.flatnonzero(errors <= errors.min() + 1e-9 * max(1.0, good.sum()))
        i = int(i[len(i) // 2])
        return float((z[max(0, i - 1)] + z[min(len(z) - 1, i)]) / 2)

    out = np.full(n_languages + 1, best(np.ones(len(logits), bool)))
    for k in range(n_languages):
        own = languages == k
        if min(n_toxic[own].sum(), n_clean[own].sum()) >= least:
            out[k] = best(own)
    return out


def pieces(words: list[str], most_words: int, most_pieces: int | None = None) -> list[list[str]]:
    """A text's words in stretches of most_words; of more than most_pieces of these, if given, as many from all over the text."""
    found = [words[i : i + most_words] for i in range(0, max(1, len(words)), most_words)]
    return found if most_pieces is None or len(found) <= most_pieces else [found[i * (len(found) - 1) // (most_pieces - 1)] for i in range(most_pieces)]


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, np.int32)]), kind))


def _sliced(rows: DataFrame, most_words: int) -> DataFrame:
    """rows (doc_id, toxic, fold, lang, text) as words: a row for each slice of about NUMBERED bytes of text, with all pieces of its texts.

    words: of all pieces, as numbers of their own in the slice; length: each piece's words; hashes: FEATURES of each number.
    """

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: list[pa.RecordBatch] = []
        read: list[tuple[pa.StringArray, np.ndarray, np.ndarray]] = []

        def slice_() -> pa.RecordBatch:
            # the same words of other batches get the same numbers
            words, lows = pa.concat_arrays([w for w, _, _ in read]).dictionary_encode(), np.cumsum([0, *(len(w) for w, _, _ in read)])
            same = words.indices.to_numpy()
            numbers, length = np.concatenate([same[low:].take(n) for low, (_, n, _) in zip(lows, read)]), np.concatenate([n for _, _, n in read])
            read.clear()
            out, row = [], []
            for i, part in enumerate(np.split(numbers, np.cumsum(length)[:-1])):
                found = pieces(part, most_words)
                out += found
                row += [i] * len(found)
            rows = pa.Table.from_batches(taken).combine_chunks().to_batches()[0].take(pa.array(row, pa.int64()))
            each = [pa.ListArray.from_arrays(pa.array([0, len(out)], pa.int32()), c) for c in rows.columns]
            flat = [_lists([a], pa.int32()) for a in (np.array([len(a) for a in out], np.int32), numbers, hashed(words.dictionary).view(np.int32).ravel())]
            return pa.RecordBatch.from_arrays([pa.array([uuid4().hex]), *each, *flat], ["slice", "doc_id", "toxic", "fold", "lang", "length", "words", "hashes"])

        size = 0
        for batch in small(arrow):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            size += sum(map(len, texts))
            read.append(numbered(texts))
            # a copy, so that no text is held by the columns beside it
            taken.append(batch.select(["doc_id", "toxic", "fold", "lang"]).take(pa.array(np.arange(batch.num_rows))))
            del batch, texts
            if size >= NUMBERED:
                yield slice_()
                taken, size = [], 0
        if taken:
            yield slice_()

    return rows.select("doc_id", "toxic", "fold", "lang", "text").mapInArrow(run, f"slice string, doc_id array<{dict(rows.dtypes)['doc_id']}>, toxic array<int>, fold array<int>, lang array<string>, length array<int>, words array<int>, hashes array<int>")


def _texts(row: dict) -> tuple[list[np.ndarray], np.ndarray]:
    """Pieces of a slice, as rows of its table of hashes."""
    words = row["words"].values.to_numpy()
    return np.split(words, np.cumsum(row["length"].values.to_numpy())[:-1]), row["hashes"].values.to_numpy().reshape(-1, FEATURES)


def _runs(part: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[pa.ListArray]]:
    """Of sorted numbers each one once, and the columns cut into a list for each of them."""
    at = np.flatnonzero(np.diff(part, prepend=part[:1] - 1))
    ends = np.append(at, len(part))
    return part[at], [pa.ListArray.from_arrays(pa.array(ends * (c.size // max(1, len(c))), pa.int32()), pa.array(np.ascontiguousarray(c).ravel())) for c in columns]


def _packed(numbers: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(numbers, np.int32), codec="zstd", asbytes=True)


def _unpacked(data: pa.Scalar, n: int) -> np.ndarray:
    """n numbers."""
    return np.frombuffer(pa.decompress(data.as_buffer(), 4 * n, codec="zstd"), np.int32)


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return pc.list_flatten(column).to_numpy()


def _rows(table: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    for i in range(table.num_rows):
        yield {name: table.column(name)[i] for name in table.column_names}


def _counted(slices: DataFrame, told: dict[str, int]) -> DataFrame:
    """hash, language, n0 .., n_toxic0 ..: in how many pieces, and toxic ones, of each fold each hash stands (language -1), and of each language the words' own hashes (in n0)."""
    names = [f"{c}{f}" for c in ("n", "n_toxic") for f in range(FOLDS)]

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for row in _rows(batch):
                texts, table = _texts(row)
                hashes, local = np.unique(table, return_inverse=True)
                local = local.reshape(table.shape)
                groups: dict[tuple, list[np.ndarray]] = {}
                for t, y, f, lang in zip(texts, *(row[c].as_py() for c in ("toxic", "fold", "lang"))):
                    own = np.unique(t)
                    groups.setdefault((f, y), []).append(np.unique(local[own]))
                    if lang in told:
                        groups.setdefault((lang,), []).append(np.unique(local[own, 0]))
                n = {k: np.bincount(np.concatenate(g), minlength=len(hashes)) for k, g in groups.items()}
                none = np.zeros(len(hashes), np.int64)
                bad = [n.get((f, 1), none) for f in range(FOLDS)]
                counts = [(-1, [*(n.get((f, 0), none) + bad[f] for f in range(FOLDS)), *bad])]
                counts += [(told[k[0]], [n[k], *[none] * (2 * FOLDS - 1)]) for k in sorted((k for k in n if len(k) == 1))]
                for language, each in counts:
                    some = np.flatnonzero(sum(each))
                    part = hashes[some] >> LAST_BITS
                    at = np.flatnonzero(np.diff(part, prepend=part[:1] - 1))
                    # in each part the first hash and the steps to the next ones
                    steps = np.diff(hashes[some], prepend=np.int32(0))
                    steps[at] = hashes[some][at]
                    columns, ends = np.vstack([steps, *(c[some] for c in each)]), np.append(at, len(part))
                    bodies = pa.array([_packed(columns[:, a:b]) for a, b in zip(ends, ends[1:])], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(part[at], pa.int32()), pa.array(np.full(len(at), language), pa.int32()), pa.array(np.diff(ends), pa.int32()), bodies], ["part", "language", "n", "body"])

    def added(group: pa.Table) -> pa.Table:
        n = group["n"].to_numpy()
        each = [_unpacked(x, size * (1 + len(names))).reshape(-1, size) for x, size in zip(group["body"], n.tolist())]
        hashes = np.concatenate([np.cumsum(x[0], dtype=np.int32) for x in each]).view(np.uint32)
        keys, where = np.unique(np.repeat(group["language"].to_numpy(), n).astype(np.int64) << 32 | hashes, return_inverse=True)
        sums = [np.bincount(where, weights=np.concatenate([x[i] for x in each]), minlength=len(keys)).astype(np.int64) for i in range(1, 1 + len(names))]
        return pa.table([keys.astype(np.uint32).view(np.int32), (keys >> 32).astype(np.int32), *sums], ["hash", "language", *names])

    # a row for many hashes: one for each takes several times as much of the shuffle
    parts = slices.select("toxic", "fold", "lang", "length", "words", "hashes").mapInArrow(run, "part int, language int, n int, body binary")
    return parts.groupBy("part").applyInArrow(added, "hash int, language int, " + ", ".join(f"{c} long" for c in names))


def tell(counts: DataFrame, texts: list[int]) -> dict[int, int]:
    """Hashes of words that tell a language: those in the most of its texts, and nine times as thick there as in all others. counts: of _counted; texts: of each language."""
    if len(texts) < 2:
        return {}
    share = F.col("n0") / F.element_at(F.array(*[F.lit(float(n)) for n in texts]), F.col("language") + 1)
    shares = counts.where("language >= 0").select("hash", "language", share.alias("share"))
    # only the language in most of whose texts a word stands can have nine times as many
    top = shares.groupBy("hash").agg(F.max_by("language", "share").alias("language"), F.max("share").alias("share"), F.sum("share").alias("all"))
    rank = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("share"), "hash"))
    got = top.where("share >= 9 * (all - share)").withColumn("rank", rank).where(F.col("rank") <= TELLING)
    return {r["hash"] % 2**32: r["language"] for r in got.select("hash", "language").collect()}


def _trained(slices: DataFrame, starts: list[Start], out: list[int | None]) -> DataFrame:
    """stream, key, v0 .. : what networks learned, averaged over the tasks that changed it: vectors by their place among the start's hashes, all else by negative keys.

    Stream k begins at starts[k] and learns from all pieces but those of fold out[k].
    """
    kept = np.unique(np.concatenate([s.hashes for s in starts]))

    def narrowed(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes without a vector go, and words that are the same then have one number; hashes and words are packed, n numbers in all."""
        for batch in arrow:
            for i, row in enumerate(_rows(batch)):
                table = row["hashes"].values.to_numpy().reshape(-1, FEATURES)
                table, number = np.unique(np.where(_known(table, kept) > 0, table, np.int32(ABSENT)), axis=0, return_inverse=True)
                words = number.reshape(-1).astype(np.int32)[row["words"].values.to_numpy()]
                both = np.concatenate([table.ravel(), words])
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns[:-2], pa.array([len(both)], pa.int32()), pa.array([_packed(both)], pa.binary())], [*batch.schema.names[:-2], "n", "body"])

    def run(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        texts, tables, ids, toxic, folds, at, task = [], [], [], [], [], 0, 0
        for batch in group:
            for row in _rows(batch):
                length, task = row["length"].values.to_numpy(), row["task"].as_py()
                table, words = np.split(_unpacked(row["body"], row["n"].as_py()), [row["n"].as_py() - int(length.sum())])
                texts += np.split(words + np.int32(at), np.cumsum(length)[:-1])
                tables.append(table.reshape(-1, FEATURES).copy())
                at += len(tables[-1])
                ids += row["doc_id"].as_py()
                toxic += row["toxic"].as_py()
                folds += row["fold"].as_py()
        # what the slices came in goes before anything is learned
        batch = row = words = None
        table = np.concatenate(tables)
        tables.clear()
        # the same order in every run, whatever order slices come in
        ordered = sorted(range(len(ids)), key=ids.__getitem__)
        ids, labels = None, np.array(toxic, bool)
        for stream, start in enumerate(starts):
            order = [i for i in ordered if folds[i] != out[stream]]
            if not order:
                continue
            net = learned(start, [texts[i] for i in order], table, labels[order])
            dense, begin = _dense(net).astype(np.float32), start.network()[0].vectors
            moved = np.flatnonzero((net.vectors != begin).any(axis=1))
            del begin
            keys = np.concatenate([np.arange(-len(dense), 0), moved]).astype(np.int32)
            values = np.concatenate([dense[::-1], net.vectors[moved]])
            del net
            # each stream's results go before the next one begins
            part, lists = _runs(keys // BESIDE, keys, values)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), stream, np.int32)), pa.array(part), pa.array(np.full(len(part), task, np.int32)), *lists], schema=schema)
            del keys, values, part, lists, moved
            released()

    def mean(group: pa.Table) -> pa.Table:
        # the same sums in every run
        group = group.sort_by("task")
        keys, where, n = np.unique(_flat(group["keys"]), return_inverse=True, return_counts=True)
        values = _flat(group["values"]).reshape(-1, DIM)
        sums = [np.bincount(where, weights=values[:, i]) / n for i in range(DIM)]
        return pa.table([np.full(len(keys), group["stream"][0].as_py(), np.int32), keys, *(c.astype(np.float32) for c in sums)], ["stream", "key", *(f"v{i}" for i in range(DIM))])

    schema = pa.schema([("stream", pa.int32()), ("part", pa.int32()), ("task", pa.int32()), ("keys", pa.list_(pa.int32())), ("values", pa.list_(pa.float32()))])
    n = slices.agg(F.max("task")).first()[0] + 1
    each = slices.select("task", "doc_id", "toxic", "fold", "length", "words", "hashes")
    # a task for each group, however small the shuffle's parts would be
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in each.schema if f.name not in ("words", "hashes"))
    parts = each.mapInArrow(narrowed, f"{kind}, n int, body binary").repartition(4 * n, "task").groupBy("task")
    learnt = parts.applyInArrow(run, "stream int, part int, task int, keys array<int>, values array<float>")
    return learnt.groupBy("stream", "part").applyInArrow(mean, "stream int, key int, " + ", ".join(f"v{i} float" for i in range(DIM)))


def _logits(slices: DataFrame, networks: list[Network], told: dict[str, int]) -> DataFrame:
    """logit, language, n_toxic, n_clean: what each fold's network says of the fold's texts, to a step of 1 / LOGIT_STEPS. A text's pools are the largest of its pieces' pools."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for row in _rows(batch):
                texts, table = _texts(row)
                ids, toxic, langs = (row[c].as_py() for c in ("doc_id", "toxic", "lang"))
                folds = np.array(row["fold"].as_py())
                out: list[tuple[float, int, int]] = []
                for k, net in enumerate(networks):
                    own = np.flatnonzero(folds == k)
                    if not len(own):
                        continue
                    # no word, behind each piece, has the last row
                    vectors = _embedded(net, table, 1)
                    pad, pools = np.full(max(WIDTHS), len(table), np.int32), []
                    for low in range(0, len(own), 64):
                        some = [texts[i] for i in own[low : low + 64]]
                        begins = np.concatenate([[0], np.cumsum([len(t) + len(pad) for t in some])[:-1]])
                        pools.append(net.pooled(vectors.take(np.concatenate([x for t in some for x in (t, pad)]), axis=0), begins))
                    # pieces of a text follow each other
                    firsts = [j for j, i in enumerate(own) if j == 0 or ids[own[j - 1]] != ids[i]]
                    z = np.maximum.reduceat(np.concatenate(pools), firsts, axis=0) @ net.out + net.bias
                    out += [(x, toxic[own[j]], told.get(langs[own[j]], -1)) for x, j in zip((np.round(z * LOGIT_STEPS) / LOGIT_STEPS).tolist(), firsts)]
                z, y, lang = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(z, pa.float64()), pa.array(y, pa.int32()), pa.array(lang, pa.int32())], ["logit", "toxic", "language"])

    each = slices.drop("slice").mapInArrow(run, "logit double, toxic int, language int")
    return each.groupBy("logit", "language").agg(F.sum("toxic").alias("n_toxic"), F.sum(1 - F.col("toxic")).alias("n_clean"))


def fit(docs: DataFrame, labels: DataFrame, most_words: int = 2_000, task_words: int = 6_000_000) -> Network:
    """Learn from docs (doc_id, text and, if there is one, lang) and labels (doc_id, toxic 0/1): from every word of every labelled document.

    Texts are learned from in stretches of most_words words, as texts of their own. A written table holds their words; tasks train on task_words to twice as many words
    each, and parameters are averaged. Of the documents, the driver has numbers of the slices of 4 MB, and a logit's counts; of the words, the hashes that stand
    in at least SEEN of SEEN_OF texts. Languages are those of `lang` with LANGUAGE_TEXTS labelled texts, and serve only to find words that tell them: a score is
    made from the text alone. Without both classes no text is toxic. Null labels don't count; of repeated labels the larger holds, and of rows that repeat an id
    the text and language that sort first; null texts are texts without words; null ids have no label; other columns are ignored.
    """
    spark = docs.sparkSession
    each = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    # ids that go to every task where there are few, so that only labelled texts are shuffled
    few = each.select(F.sum(F.lit(32) + F.octet_length(F.col("doc_id").cast("string")))).first()[0] or 0
    rows = docs.select("doc_id", lang.alias("lang"), "text").join(F.broadcast(each) if few <= SENT_BYTES else each, "doc_id")
    at, again_at, counts_at = shared_dir(spark), shared_dir(spark), shared_dir(spark)
    # only texts of ids that repeat are shuffled to see which is learned from
    again = written(rows.groupBy("doc_id").count().where("count > 1").select("doc_id"), again_at)
    if not again.isEmpty():
        firsts = matched(rows, again, "doc_id", "left_semi").groupBy("doc_id", "toxic").agg(F.min("lang").alias("lang"), F.min("text").alias("text"))
        rows = matched(rows, again, "doc_id", "left_anti").unionByName(firsts)
    rows = rows.select("*", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))
    try:
        slices = _sliced(rows, most_words)
        slices.write.option("compression", "zstd").parquet(at)
        slices = spark.read.schema(slices.schema).parquet(at)
        # slices fall to tasks by a hash, so that ids that follow each other don't
        sizes = slices.select("slice", F.size("words").alias("n"), F.xxhash64(F.col("doc_id")[0]).alias("place")).orderBy("place", "n").collect()
        total = max(1, sum(r["n"] for r in sizes))
        n_tasks = max(1, total // task_words)
        before = np.cumsum([0, *(r["n"] for r in sizes)])
        tasks = [(r["slice"], int(min(n_tasks - 1, (a + r["n"] // 2) * n_tasks // total))) for r, a in zip(sizes, before.tolist())]
        piece = slices.select(F.explode(F.arrays_zip("fold", "toxic", "lang")).alias("x")).select("x.*").groupBy("fold", "toxic", "lang").count().collect()
        totals = np.zeros((FOLDS, 2), np.int64)
        spoken: dict[str, int] = {}
        for r in piece:
            totals[r["fold"], r["toxic"]] += r["count"]
            if r["lang"] is not None:
                spoken[r["lang"]] = spoken.get(r["lang"], 0) + r["count"]
        often = sorted(x for x, n in sorted(spoken.items(), key=lambda x: (-x[1], x[0]))[:LANGUAGES] if n >= LANGUAGE_TEXTS)
        told = {x: i for i, x in enumerate(often)}
        if not totals.sum(axis=0).all():
            return Start(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0).network()[0]
        # of each stream, what is left without its fold; one whose rest has a single class takes all
        sums = [totals.sum(axis=0) - (totals[k - 1] if k else 0) for k in range(FOLDS + 1)]
        out = [k - 1 if k and sums[k].all() else None for k in range(FOLDS + 1)]
        sums = [sums[k] if out[k] is not None else sums[0] for k in range(FOLDS + 1)]
        kept = min(max(SEEN, -(-SEEN * int(s.sum()) // SEEN_OF)) for s in sums)
        # hashes that no stream gives a vector aren't written
        often_enough = sum((F.col(f"n{f}") for f in range(FOLDS)), F.lit(0)) >= F.when(F.col("language") < 0, kept).otherwise(1)
        counts = written(_counted(slices, told).where(often_enough), counts_at)
        found = counts.where("language < 0").toArrow().sort_by("hash")
        hashes = found["hash"].to_numpy()
        n, n_toxic = ([found[f"{c}{f}"].to_numpy() for f in range(FOLDS)] for c in ("n", "n_toxic"))
        starts = []
        for k in range(FOLDS + 1):
            some = [f for f in range(FOLDS) if f != out[k]]
            starts.append(begun(hashes, sum(n[f] for f in some), sum(n_toxic[f] for f in some), int(sums[k].sum()), int(sums[k][1])))
        del found, hashes, n, n_toxic
        tasked = slices.join(F.broadcast(spark.createDataFrame(tasks, "slice string, task int")), "slice")
        learnt = _trained(tasked, starts, out).toArrow()
        networks = []
        stream, keys = learnt["stream"].to_numpy(), learnt["key"].to_numpy()
        values = np.stack([learnt[f"v{i}"].to_numpy() for i in range(DIM)], axis=1)
        for k, start in enumerate(starts):
            net = start.network()[0]
            own = np.flatnonzero(stream == k)
            dense, moved = own[keys[own] < 0], own[keys[own] >= 0]
            net.vectors[keys[moved]] = values[moved]
            _set_dense(net, values[dense[np.argsort(-keys[dense])]])
            networks.append(net)
        del learnt, values
        network = networks[0]
        network.languages = tell(counts, [spoken[x] for x in often])
        z = _logits(slices, networks[1:], told).toArrow()
        network.thresholds = calibrate(*(z[c].to_numpy() for c in ("logit", "language", "n_toxic", "n_clean")), len(often))
    finally:
        dropped(spark, [at, again_at, counts_at])
    # tasks send hashes as signed numbers
    network.hashes = network.hashes.astype(np.int32).view(np.uint32).astype(np.int64)
    order = np.argsort(network.hashes, kind="stable")
    network.hashes, network.vectors = network.hashes[order], network.vectors[order]
    return network


def score(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, score, predicted (1 from 0.5) for every row of docs (doc_id, text), in one pass without a shuffle.

    Whole texts are scored; null and empty texts are those without words. Repeated rows and null ids are
    scored row by row; other columns are never read. Ties at a threshold are predicted toxic.
    """

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(network)
        for batch in small(arrow):
            s = scores(network, reader, [x.as_py() or "" for x in batch.column("text")])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def keep_clean(docs: DataFrame, network: Network) -> DataFrame:
    """The rows of docs, all columns, not predicted toxic; only texts go to Python.

    Whole texts are judged, null and empty ones as texts without words; repeated rows and null ids row by row.
    """

    def begin():
        reader = Reader(network)
        return lambda texts: scores(network, reader, [x or "" for x in texts])

    return docs.where(scored(begin)(docs["text"]) < 0.5)
