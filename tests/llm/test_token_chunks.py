"""Token ids by chunks are those of the library, and a word is encoded once whatever mark follows it."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gradeloom.llm import token_files

PATH = "byte_bpe_50k.json"


@pytest.fixture
def ids_of():
    token_files.tokenizer.cache_clear()
    return token_files.tokenizer(public_tokenizers.path(PATH), public_tokenizers.PATTERN)[0]


def test_ids_are_those_of_the_library(ids_of):
    own = Tokenizer.from_file(public_tokenizers.path(PATH))
    parts = ["a", "don", "'t", "'s,", "'", ",", ".", ";", ":", "!", "?", "?!", " ", "  ", "\n", "\t", "é", "é", " ", "　", "中", "7", "<|endoftext|>", "<|", "|>", "Zz", "\U0001f600", ",'s", "_"]
    rng = random.Random(2)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)] + [None, "", ",", ".a", "a.", "a,b", " ,"]
    ids, at = ids_of(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == own.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_a_word_is_learnt_once_with_any_mark(ids_of):
    from gradeloom.llm.pieces import PieceEncoder

    encoder = next(c.cell_contents for c in ids_of.__closure__ if isinstance(c.cell_contents, PieceEncoder))
    words = ["".join(np.random.default_rng(i).choice(list("aeiortn"), 9)) for i in range(50)]
    ids_of(pa.array([" ".join(f"x {w}{m}" for w in words for m in ("", *",.;:!?"))]))
    assert len(encoder.index) < 2 * len(set(words))


def test_new_words_go_to_the_model_alone(ids_of, monkeypatch):
    """The library cuts only what is not one word; words are all Latin letters, and are learnt once beside lines and other marks too."""
    from gradeloom.llm import pieces

    encoder = next(c.cell_contents for c in ids_of.__closure__ if isinstance(c.cell_contents, pieces.PieceEncoder))
    cut = []
    monkeypatch.setattr(encoder, "encode", lambda texts, encode=encoder.encode: cut.extend(texts) or encode(texts))
    words = [f"{w}{x}" for i in range(40) for w in ["".join(np.random.default_rng(i).choice(list("aeiortnÀÖØöøÿñ"), 9))] for x in ("", "é")]
    texts = [" ".join(f"x {w}{m}" for m in ("", ",", "&&&", "_", ".\nA")) for w in words] + ["", "×÷", "a×b", "×a &", ""]
    ids, at = ids_of(pa.array(texts))
    own = Tokenizer.from_file(public_tokenizers.path(PATH))
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == own.encode(text, add_special_tokens=False).ids, repr(text)
    assert len(encoder.index) < len(words) + 20
    assert not any(w in t for w in words for t in cut)


def test_letters_marks_and_lines_are_cut_as_the_library_does(ids_of):
    own = Tokenizer.from_file(public_tokenizers.path(PATH))
    parts = ["a", "É", "é", "ÿ", "×", "÷", "Ā", "ª", "'", "'s", "’", "_", "&", "<", "#", "0", "²", "\n", "\r\n", " ", " ", "\x85", "\x00", "z"]
    rng = random.Random(3)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(6000)]
    ids, at = ids_of(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == own.encode(text, add_special_tokens=False).ids, repr(text)
    assert ids_of(pa.array(["", None]))[1].tolist() == [0, 0, 0]
    assert ids_of(pa.array(["\nb", ""]))[0].tolist() == own.encode("\nb", add_special_tokens=False).ids
