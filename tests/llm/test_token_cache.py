"""Units and caches against the tokenizers library on whole texts."""

import random

import numpy as np
import pytest

from lodestate.llm import bpe_segment, pretokens, token_cache
from lodestate.llm.queries import tokenizer

ODD = ["", "  ", "\n", "a\n\n b", "İstanbul É ÑÑ Ⱥ x", "don't we'll\tI'M", "a<|endoftext|>b <|endoftext|> <|start", "Å Σας ΌΣΟΣ", "x y z", "\x1ca b\x00c d\x85e", "１２ 3½ ǅ", "  two  spaces\r\n", "ß ẞ é À×÷ß", "\U0001f600 hi", "a　b", "'s 'S 't", "word " * 3000 + "x" * 5000, "q᜕́ ᪿ́e"]
#: Characters of every kind that a rule of the vocabularies looks at.
ALPHABET = list("abEXs'tl019 .,!-_<|>\n\t\r\v\f\x00\x1c\x7f") + list("éÉßÀ×÷ªº½²ıİſΣσς̸᜕ᪿ́  　​᠎中あ한\U0001f600\U00010d24Ǆǆ") + ["<|endoftext|>", "  ", " the", "'re"]
KINDS = [("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")]


def fuzz(n: int) -> list[str]:
    rng = random.Random(5)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 24))) for _ in range(n)]


def library(name: str, texts: list[str]) -> list[list[int]]:
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(tokenizer(name)).encode_batch_fast(texts, add_special_tokens=False)]


@pytest.mark.parametrize(("kind", "name"), KINDS)
def test_ids_equal_the_library(kind, name, monkeypatch):
    monkeypatch.setattr(token_cache, "CACHE_UNITS", 5)
    monkeypatch.setattr(pretokens, "BUFFER_BYTES", 1000)
    enc, want = token_cache.Encoder(tokenizer(name), kind), library(name, ODD)
    assert [x.tolist() for x in enc.encode(ODD)] == want
    for _ in range(2):  # generations turn over
        assert [enc.encode([t])[0].tolist() for t in ODD] == want


@pytest.mark.parametrize(("kind", "name"), KINDS)
def test_fuzzed_texts(kind, name):
    texts = fuzz(20_000)
    for got, want, t in zip(token_cache.Encoder(tokenizer(name), kind).encode(texts), library(name, texts), texts, strict=True):
        assert got.tolist() == want, repr(t)


def test_segment_tree_on_fuzzed_texts(monkeypatch):
    name, texts = "word_bpe_49k.json", ODD + fuzz(10_000)
    monkeypatch.setattr(bpe_segment, "CACHE_UNITS", 500)
    bpe, want = bpe_segment.SegmentTreeBPE(tokenizer(name)), library(name, texts)
    assert bpe.encode(texts) == want
    for (n, ids, text), w in zip(bpe.printed(texts), want, strict=True):
        assert (n, ids.decode(), text.decode()) == (len(w), " ".join(map(str, w)), bpe.tokenizer.decode(w, skip_special_tokens=False))


@pytest.mark.parametrize(("kind", "name"), KINDS)
def test_hash_collisions_are_noticed(kind, name, monkeypatch):
    texts = ["ab cd ef", "gh ij <|endoftext|> kl", ""]
    monkeypatch.setattr(pretokens, "power", lambda n: [np.zeros(n, np.uint64)] * 2)
    assert pretokens.distinct([t.encode() for t in texts], kind) is None
    assert [x.tolist() for x in token_cache.Encoder(tokenizer(name), kind).encode(texts)] == library(name, texts)
    if kind == "word":
        assert bpe_segment.SegmentTreeBPE(tokenizer(name)).encode(texts) == library(name, texts)
