"""Token ids of whole texts by a vocabulary file of the ``tokenizers`` library, as little-endian 32-bit bytes.

Where a file's normaliser and splitter let white space end a word, a text's ids are those
of its words one after the other, and each word need be encoded once. Words of plain Latin
letters, digits and punctuation then skip normaliser and splitter, which they would pass
unchanged but for case; any other word goes through the whole tokenizer. With any other
file whole texts do.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable

#: Words, and parts of words, held by a worker at most; a store is emptied when full. A word of over 64 bytes is not held.
MAX_WORDS, MAX_BYTES = 200_000, 64

_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿßŒœ]*")
#: Pieces of a plain, lower-case word, by the split pattern of ``WORDWISE``.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿßœ]+|[0-9]|[^a-zà-öø-ÿßœ0-9]+")
#: The normaliser and splitter, as a file states them, for which words can be encoded one by one.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def _byte_letters() -> dict[int, str]:
    """The usual printable stand-ins of byte-level vocabularies: printable Latin-1 stays, the rest moves to U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _stated(part) -> dict | None:
    """What a vocabulary file states about a part of its tokenizer."""
    return None if part is None else json.loads(part.__getstate__())


class WordIds(dict):
    """Word (bytes) -> its ids (bytes); ``text_ids`` gives those of a text."""

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.pieces, self.letters = self.tokenizer.model, _Pieces(self._piece), _byte_letters()
        marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # A mark within a word is found by the whole tokenizer; one with a blank in it would not be.
        self.wordwise = all(_stated(getattr(self.tokenizer, k)) == v for k, v in WORDWISE.items()) and not any(c.isspace() for m in marks for c in m)
        self.marked = re.compile("|".join(map(re.escape, marks)) or "(?!)").search

    def text_ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode().split())) if self.wordwise else self._whole(text)

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if not _PLAIN.fullmatch(text) or self.marked(text):
            ids = self._whole(text)
        else:
            text = text.lower()
            ids = self._piece(text) if text.isalpha() else b"".join(map(self.pieces.__getitem__, _PIECES.findall(text)))
        if len(word) <= MAX_BYTES:
            if len(self) >= MAX_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        return _packed([t.id for t in self.model.tokenize(shown)])


class _Pieces(dict):
    """Parts of words -> their ids (bytes)."""

    def __init__(self, ids_of: Callable[[str], bytes]) -> None:
        super().__init__()
        self.ids_of = ids_of

    def __missing__(self, piece: str) -> bytes:
        ids = self.ids_of(piece)
        if len(piece) <= MAX_BYTES:
            if len(self) >= MAX_WORDS:
                self.clear()
            self[piece] = ids
        return ids


_PACKERS = [struct.Struct(f"<{n}I") for n in range(32)]


def _packed(ids: list[int]) -> bytes:
    return _PACKERS[len(ids)].pack(*ids) if len(ids) < 32 else struct.pack(f"<{len(ids)}I", *ids)


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per worker and file."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]
