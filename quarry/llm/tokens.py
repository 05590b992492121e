"""Token ids by the tokenizers library, with a bounded cache of words.

Both vocabularies cut a text into words before they merge, and never merge across them.  So a text's ids are the
concatenation of its words' ids, and a worker needs to run the library's model on a word once.  Texts of Latin-1
characters are cut here into the same words as the library does; others are cut at spaces only, and the library encodes
those parts.  The strings of added tokens in a text are one id each, as the library's defaults have it; the text between
them is encoded by itself.  ``tests/llm`` hold all of it against the library's ids for whole texts.
"""

from __future__ import annotations

import array
import json
import re
import sys

#: What the libraries' regular expressions take as \\s: the White_Space property.
WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Latin-1's lower-case and other letters, upper-case letters, numbers and spaces.
LOW, UP, NUM, GAP = "a-zªµºß-öø-ÿ", "A-ZÀ-ÖØ-Þ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
SHORT = "'(?:[stmd]|re|ve|ll)"
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
#: Rules that are known: normalizer, pre-tokenizer, words of Latin-1 texts, parts of others, what is done to a Latin-1 text first.
CUTS = [
    (
        None,
        {**_BYTES, "use_regex": True},
        re.compile(f"{SHORT}| ?[{LOW}{UP}]+| ?[{NUM}]+| ?[^{GAP}{LOW}{UP}{NUM}]+|[{GAP}]+(?![^{GAP}])|[{GAP}]+"),
        re.compile(f" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+"),
        str,
    ),
    (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
                {**_BYTES, "use_regex": False},
            ],
        },
        re.compile(f"{SHORT}|[{LOW}]+|[{NUM}]|[^{GAP}{LOW}{NUM}]+"),
        re.compile(f"[^{WS}]+"),
        str.lower,
    ),
]


def cuts(setup: dict):
    """(words, parts, first) of a tokenizer's own description, None if its rules aren't known."""
    model = setup["model"]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    if not plain or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in setup["added_tokens"]):
        return None
    return next((c[2:] for c in CUTS if c[:2] == (setup["normalizer"], setup["pre_tokenizer"])), None)


def _byte_signs() -> dict[int, str]:
    """The characters by which byte-level models write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


SIGNS = _byte_signs()


def little(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    a = array.array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


class Memo(dict):
    """What ``find`` gives for a word, kept for the first ``limit`` words that turn up; later rare ones are found anew."""

    def __init__(self, find, limit: int):
        self.find, self.limit = find, limit

    def __missing__(self, word: str) -> bytes:
        out = self.find(word)
        if len(self) < self.limit:
            self[word] = out
        return out


class WordEncoder:
    """Encodes texts with one vocabulary file; ``limit`` bounds the cached words (about 200 bytes each).

    A file whose rules aren't known here is left to the library, text by text.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known = cuts(json.loads(self.tokenizer.to_str()))
        if self.known is None:
            return
        self.words, self.parts, self.first = self.known
        self.added = {t.content: little([i]) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.marks = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or "(?!)")
        model = self.tokenizer.model.tokenize
        self.word_ids = Memo(lambda w: little([t.id for t in model(w.encode().decode("latin-1").translate(SIGNS))]), limit).__getitem__
        self.part_ids = Memo(lambda w: little(self.tokenizer.encode(w, add_special_tokens=False).ids), limit // 4).__getitem__

    def __call__(self, texts: list[str]) -> list[bytes]:
        """For each text its ids' bytes."""
        if self.known is None:
            return [little(self.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
        out = []
        for text in texts:
            at, found = 0, []
            for m in self.marks.finditer(text):
                found += self._plain(text[at : m.start()]), self.added[m[0]]
                at = m.end()
            out.append(b"".join([*found, self._plain(text[at:])]) if found else self._plain(text))
        return out

    def _plain(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        try:
            text.isascii() or text.encode("latin-1")
        except UnicodeEncodeError:
            return b"".join(map(self.part_ids, self.parts.findall(text)))
        return b"".join(map(self.word_ids, self.words.findall(self.first(text))))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder of a vocabulary file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def slices(batch, rows: int = 1024):
    """A record batch in parts of few rows, so that what Python builds for one part stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
