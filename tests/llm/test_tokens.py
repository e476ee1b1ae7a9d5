"""Ids of texts that spell out a special token."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from meterloom.llm import attribution, packing
from meterloom.llm.tokens import encoder, vocabulary_path

TEXTS = ["a<|endoftext|>b", "<|endoftext|>", " x <|endoftext|> y\n", "é日本<|endoftext|><|endoftext|>.", "<|endoftext", "plain words"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_and_spans_of_special_tokens(text):
    own = encoder(vocabulary_path())
    ids = own.ids(text)
    expected = Tokenizer.from_file(vocabulary_path()).encode(text, add_special_tokens=False).ids
    assert ids.tolist() == expected and own.ends(ids)[-1] == len(text.encode())


def test_packed_pieces_hold_the_contract_ids(documents):
    plain = Tokenizer.from_file(vocabulary_path())
    rows = {r["doc_id"]: r for r in packing.pack(documents(list(enumerate(TEXTS)))).collect()}
    for number, text in enumerate(TEXTS):
        ids = [*plain.encode(text, add_special_tokens=False).ids, 0]
        row = rows[number]
        assert (row["start"], row["length"], row["doc_tokens"]) == (0, len(ids), len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_sections_count_special_tokens(documents):
    rows = attribution.by_section(documents(list(enumerate(TEXTS))))
    assert rows.count() >= len(TEXTS)
