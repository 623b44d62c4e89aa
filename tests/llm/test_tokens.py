"""BPE and token counts against the libraries themselves."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cairn.llm import bpe, token_counts
from cairn.llm.queries import PIECE_BPE, WORD_BPE

TEXTS = ["", " ", "It's THE cat's 12 dogs!!", "a<|endoftext|>B <|startoftext|>", "<|ENDOFTEXT|>", "İΣΣ σς Å ǅ́ 日本 🙂 ﬁ", "a\x1cb\x85c\xa0d e", "h" * 5000, " x", "tab\tnew\n\nline", "of the of the of the"]


@pytest.fixture(scope="module")
def encoder():
    return bpe.load(public_tokenizers.path(WORD_BPE))


def fuzz(n, seed=3):
    rng = random.Random(seed)
    letters = "abcdeéßñİΣσÅ🙂日 \t\n\x1c\x85'sΩ12½,.!<|>ﬁ́̈"
    yield from ("".join(rng.choice(letters) for _ in range(rng.randint(1, 50))) for _ in range(n))
    yield from ("".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 40))) for _ in range(n))


def test_bpe_is_the_library(encoder):
    library = Tokenizer.from_file(public_tokenizers.path(WORD_BPE))
    for t in [*TEXTS, *fuzz(1500)]:
        want = library.encode(t, add_special_tokens=False).ids
        got = encoder.encode(t)
        assert got.tolist() == want, t
        assert encoder.decode(got) == library.decode(want, skip_special_tokens=False), t


def test_bpe_small_cache():
    small = bpe.load(public_tokenizers.path(WORD_BPE))
    whole = [small.encode(t).tolist() for t in TEXTS]
    small.most = 3
    assert [small.encode(t).tolist() for t in TEXTS] == whole


def test_bpe_rows(spark, encoder):
    rows = [(1, "The cat", 5), (1, "The cat", 5), (None, "x", 6), (3, None, 7), (4, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    got = sorted(bpe.encode(docs, WORD_BPE).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert [r["n_tokens"] for r in got] == [2, 2, 0, 0, 1]
    ids = encoder.encode("The cat")
    assert got[0]["ids"] == ids.tolist() and got[0]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs, WORD_BPE), WORD_BPE).collect()}
    assert back[1] == "the</w> cat</w>" and back[3] == ""
    assert bpe.encode(docs.limit(0), WORD_BPE).count() == 0


def test_counts(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECE_BPE))
    texts = [*TEXTS, "a b  c ▁ d ", "<s> </s> <unk>", *fuzz(150)]
    docs = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string").selectExpr("*", "1 AS n_tokens")
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs, PIECE_BPE, limit=3).collect()}
    for i, t in enumerate(texts):
        n = len(sp.encode(t))
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len(t.encode()), n > 3)
    assert (got[len(texts)]["n_tokens"], got[len(texts)]["n_bytes"]) == (0, 0)
    assert token_counts.token_counts(docs.limit(0), PIECE_BPE).count() == 0


@pytest.mark.parametrize("size", [1, 2, 5, 9])
def test_safe_parts(size):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECE_BPE))
    token_counts.check_marks(sp)
    for t in [*TEXTS, "a b  c ▁ d ", " lead", "trail ", "x  ", *fuzz(300, 8)]:
        assert sum(len(sp.encode(p)) for p in token_counts.safe_parts(t, size)) == len(sp.encode(t)), repr(t)
