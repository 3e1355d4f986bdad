"""Public tokenizers loaded from their files, and texts cut where both sides encode as they would together.

A ``.json`` file is read by ``tokenizers``, a ``.model`` file by ``sentencepiece``. The files are only read: their path
is a parameter and must be readable on every executor.

Where a text may be cut:

* Byte-level BPE applies its merges inside pre-tokens, and no pre-token holds white space behind another character. The
  text may be cut in front of the first space or line break of a run. In a stretch without any, it may also be cut
  between a letter and a digit, or between a letter and a closing punctuation mark: no pre-token holds both.
* A sentencepiece model writes a space as U+2581. If no entry of the vocabulary holds U+2581 behind another character,
  nothing is merged across the front of a space, and the space itself is what the model puts before any text; so it is
  left out when the parts are encoded.

A tokenizer for which these conditions do not hold (another normalizer or pre-tokenizer, added tokens that take white
space with them) encodes whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

# White space as Python knows it includes all that the tokenizers' patterns call white space.
_SPACE_OR_BREAK = re.compile(r"(?<=\S)(?=[ \n])")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏЀ-ҁぁ-ゖァ-ヺ一-龥가-힣"
_CLASS_CHANGE = re.compile(rf"(?<=[{_LETTERS}])(?=[0-9,.;:!?、。！，？])|(?<=[0-9])(?=[{_LETTERS}])")
_ONE_SPACE = re.compile(r"(?<=[^\s▁]) (?=[\s\S])")

# Characters of text cut or encoded at a time. A stretch without any place to cut is encoded whole.
SLAB = 1 << 18


def runs(texts: list[str], limit: int = SLAB) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` characters in all, at least one text each."""
    start = size = 0
    for at, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, at
            start, size = at, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def slabs(text: str, cut: re.Pattern | None, limit: int = SLAB) -> Iterator[str]:
    """The text in parts of about ``limit`` characters, cut where ``cut`` matches; what it matches is left out."""
    start = 0
    while cut is not None and len(text) - start > limit:
        found = cut.search(text, start + limit)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.end()
    yield text[start:] if start else text


class ByteLevel:
    """A tokenizer of the ``tokenizers`` library."""

    def __init__(self, path: str, special: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core already
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._tokenizer.encode_special_tokens = not special
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        before = rules["pre_tokenizer"] or {}
        added = rules["added_tokens"]
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or _SPACE_OR_BREAK.search(t["content"]) or t["content"] != t["content"].strip() for t in added)
        self.byte_level = before.get("type") == "ByteLevel"
        safe = self.byte_level and before["use_regex"] and not before["add_prefix_space"] and not rules["normalizer"] and plain
        self.cut = _SPACE_OR_BREAK if safe else None
        self.finer_cut = _CLASS_CHANGE if safe and not any(_CLASS_CHANGE.search(t["content"]) for t in added) else None

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def token_bytes(self) -> list[bytes]:
        """The bytes each id stands for; only for a byte-level vocabulary."""
        if not self.byte_level:
            raise ValueError("the tokenizer has no byte-level vocabulary")
        # Bytes that print stand for themselves; the others follow in order from U+0100.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in set(plain)]
        value = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}
        entries = [b""] * self._tokenizer.get_vocab_size(with_added_tokens=True)
        for token, i in self._tokenizer.get_vocab(with_added_tokens=True).items():
            entries[i] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
        return entries


class Pieces:
    """A model of the ``sentencepiece`` library."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self._names = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        joined = any("▁" in name.lstrip("▁") for name in self._names)
        # Two spaces, a space at either end and a compatibility letter stay as they are only under the identity rule.
        probe = "a  ﬁ b "
        self.adds_space = self._model.decode(self._model.encode(probe)) == probe and self._model.encode("a", out_type=str)[0][0] == "▁"
        self.cut = _ONE_SPACE if self.adds_space and not joined else None
        self.finer_cut = None

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)

    def counts(self, texts: list[str]) -> list[int]:
        return list(map(len, self.ids(texts)))

    def token_bytes(self) -> list[bytes]:
        """The bytes each id stands for: its piece, U+2581 as a space and <0xHH> as a byte."""
        return [
            bytes([int(name[3:5], 16)]) if self._model.is_byte(i) else name.replace("▁", " ").encode()
            for i, name in enumerate(self._names)
        ]


@lru_cache(maxsize=8)
def load(path: str, special: bool = True) -> ByteLevel | Pieces:
    """The tokenizer at ``path``; strings of special tokens in a text are plain text unless ``special``."""
    return Pieces(path) if path.endswith(".model") else ByteLevel(path, special)
