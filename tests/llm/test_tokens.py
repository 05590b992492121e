"""Word-wise token ids against the library's ids of whole texts."""

import array
import json

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import tokens

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


LIB = {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in FILES}
alphabet = st.sampled_from(list("aAzZéÉßµªº×÷²½ 0 9'sStT.,!?#<|>_-\n\t\r\x0b\x1c\x1f\x85\xa0") + ["  ", "'re", "'LL", " ", "　", "ǅ", "Σ", "ς", "İ", "日本", "😀", "é", "́", "<|endoftext|>", "ﬁ", "٣", "​", "’"])


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=400, deadline=None)
@given(text=st.lists(alphabet, max_size=30).map("".join) | st.text(max_size=40))
def test_same_ids_as_the_library(name, text):
    got = array.array("I", tokens.encoder(public_tokenizers.path(name))([text])[0]).tolist()
    assert got == LIB[name].encode(text, add_special_tokens=False).ids


def test_the_cache_bound_changes_nothing():
    path = public_tokenizers.path(FILES[0])
    small = tokens.WordEncoder(path, limit=2)
    texts = ["the cat sat on the mat", "naïve “quotes” here", "", "the the the"]
    assert small(texts) == tokens.encoder(path)(texts)


def test_any_vocabulary_and_path(tmp_path):
    texts = ["the cat  sat <|endoftext|> on", "naïve “quotes” 日本", "", "\t a"]
    for name in FILES:
        moved = tmp_path / "another name.json"
        moved.write_bytes(open(public_tokenizers.path(name), "rb").read())
        assert tokens.WordEncoder(str(moved))(texts) == tokens.encoder(public_tokenizers.path(name))(texts)
    setup = json.loads(moved.read_text())
    setup["normalizer"] = {"type": "Lowercase"}
    moved.write_text(json.dumps(setup))
    other = tokens.WordEncoder(str(moved))
    lib = Tokenizer.from_file(str(moved))
    assert other.known is None and other(texts) == [tokens.little(lib.encode(t, add_special_tokens=False).ids) for t in texts]
