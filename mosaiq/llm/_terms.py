"""Lower-cased words of whole texts as bytes: letters, digits and whatever is not ASCII."""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np

#: A word where A to Z are lower case already, and one before that.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: UTF-8 bytes, A to Z lowered, what is in no word a blank.
LOWERED = bytes(c | 0x20 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Words that a worker remembers at most before it starts anew.
MAX_HELD = 200_000


def terms(data: bytes) -> list[bytes]:
    return data.translate(LOWERED).split()


class Buckets(dict):
    """Buckets of features: CRC-32 of one to ``run`` words joined by blanks, modulo ``buckets``."""

    def __init__(self, run: int, buckets: int) -> None:
        super().__init__()
        self.run, self.buckets = run, buckets

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_HELD:
            self.clear()
        self[word] = bucket = crc32(word) % self.buckets
        return bucket

    def of(self, data: bytes) -> tuple[np.ndarray, int]:
        """Buckets of all features of a text, repeats included, and its number of words."""
        words = terms(data)
        found = [np.fromiter(map(self.__getitem__, words), np.int64, len(words))]
        for n in range(2, self.run + 1):
            runs = zip(*(words[i:] for i in range(n)))
            found.append(np.fromiter((crc32(b" ".join(r)) % self.buckets for r in runs), np.int64, max(0, len(words) - n + 1)))
        return np.concatenate(found), len(words)
