"""Pieces of text that are looked up once, for the byte-level vocabulary."""

import random

import numpy as np
import pytest

from tessera.llm import tokens
from tessera.llm.queries import tokenizer

NAME = "byte_bpe_50k.json"


def test_marks_and_digits_are_pieces_of_their_own():
    words, marks = [f"w{a}{b}" for a in "abcdefgh" for b in "éxyz"], [",", ".", ".%%%", "!!", "7", "42)", "'", ":-"]
    texts = [" ".join(w + x for w in words) for x in marks]
    m = tokens.Memo(tokenizer(NAME))
    assert m.encode(texts) == [m.whole(t) for t in texts]
    assert len(m.pieces) <= len(words) + 1 + len(marks) + 2  # 32 words once each, not once with each of the marks


def test_equal_pieces_are_looked_up_once(monkeypatch):
    asked = []

    class Counted(tokens.Pieces):
        def __getitem__(self, piece):
            asked.append(piece)
            return super().__getitem__(piece)

    monkeypatch.setattr(tokens, "Pieces", Counted)
    m = tokens.Memo(tokenizer(NAME))
    texts = ["one two\none two " * 50 + "three", "one two"] * 20
    assert m.encode(texts) == [m.whole(t) for t in texts]
    assert len(asked) < 10


@pytest.mark.parametrize("block", [3, 50, 1 << 20])
def test_cut_texts_equal_whole_ones(monkeypatch, block):
    monkeypatch.setattr(tokens, "BLOCK", block)
    r = random.Random(block)
    own = [chr(c) for c in range(0x100)] + ["'s", "'t", "'re", "'LL", "×", "÷", "Ã", "ÿ", "ā", "…", "“", "”", "‘s", "½", "٣", "日", "é́", "́", "😀", "ªº", "<|endoftext|>"]
    often = [*"aZé019.,'%-(|", " ", " ", "\n", "'s", "'ve"]
    texts = ["".join(r.choice(own if r.random() < 0.3 else often) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    texts += ["", "", "a" * 5000, " x" * 3000, "", "\n", " ", "é'é.'s 'tis×2÷3"]
    m = tokens.Memo(tokenizer(NAME), most=300)
    assert [x for i in range(0, len(texts), 500) for x in m.encode(texts[i : i + 500])] == [m.whole(t) for t in texts]
    assert m.encode([]) == [] and m.encode([""]) == [b""]


def test_cuts_stay_with_the_expression():
    data = "don't a-b x1 é.\n\n×y".encode()
    at = np.array([0, len(data)])
    starts = tokens.cuts(np.frombuffer(data, np.uint8), at).tolist()
    assert [data[a:b].decode() for a, b in zip(starts, [*starts[1:], len(data)], strict=True)] == ["don", "'t", " a", "-", "b", " x", "1", " é", ".", "\n", "\n", "×y"]
