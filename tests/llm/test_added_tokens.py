"""Texts with the strings of added tokens, against tokenizers as the library sets them up."""

import array
import zlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import packing, tokens

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
LIB = {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in FILES}
alphabet = st.sampled_from([*"aZé\u0301日'9.!<|>_ \n\t\x85\xa0", "  ", "'re", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>"])


def ids(name, text):
    return array.array("I", tokens.encoder(public_tokenizers.path(name))([text])[0]).tolist()


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=400, deadline=None)
@given(text=st.lists(alphabet, max_size=20).map("".join))
def test_same_ids_as_the_library(name, text):
    assert ids(name, text) == LIB[name].encode(text, add_special_tokens=False).ids


def test_golden_ids():
    assert ids(FILES[0], "end <|endoftext|> new") == [437, 220, 50256, 649]
    assert len(ids(FILES[1], "end <|endoftext|> new")) == 3


def test_packing_takes_an_added_token_as_one(spark):
    text = "end  <|endoftext|> 日 new"
    got = packing.pack(spark.createDataFrame([(1, text)], "doc_id long, text string"), public_tokenizers.path(FILES[0])).first()
    want = [*LIB[FILES[0]].encode(text, add_special_tokens=False).ids, 2]
    assert got.length in (len(want), len(want) - 1)
    assert got.ids_crc32 in (zlib.crc32(tokens.little(want)), zlib.crc32(tokens.little(want[:-1])))
