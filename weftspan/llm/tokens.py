"""Token ids of whole texts, as bytes of fixed-width unsigned integers.

The tokenizer splits text at white space before it merges anything, so a text
is encoded word by word: each distinct word passes the library once and is then
looked up. A tokenizer whose pieces may span white space must not be used here.
"""

from __future__ import annotations

import os
import struct
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np

END_ID = 2
CACHED_WORDS = 600_000
#: ASCII marks but the apostrophe, which may begin a contraction.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def id_type(path: str) -> np.dtype:
    """Two bytes an id where the vocabulary allows it, else four."""
    return np.dtype("<u2" if _library(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies:
    itself if it prints, else the next one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(256 + n) for n, b in enumerate(rest)}


def _plain(text: str) -> bool:
    """Lower-case letters alone, which the tokenizer takes as they are."""
    return text.isalpha() and text == text.lower() and is_normalized("NFC", text)


def _plain_ascii(word: bytes) -> bool:
    """Letters from a to z alone."""
    return word.isalpha() and word.islower()


class WordEncoder(dict):
    """Word -> ids as bytes, encoded on first use; keeps ``CACHED_WORDS`` words.

    ASCII letters are lowered first and marks after a run of letters are encoded
    apart: the tokenizer does both itself, so ids stay the same and more words
    are met again. A text with a special token's opening keeps its case.
    """

    def __init__(self, path: str):
        super().__init__()
        self.library = _library(path)
        self.model = self.library.model
        self.shown = byte_letters()
        self.type = id_type(path)
        self.code = "H" if self.type.itemsize == 2 else "I"

    def __missing__(self, word: bytes) -> bytes:
        stem = word.rstrip(MARKS)
        if stem and stem != word and (_plain_ascii(stem) or _plain(stem.decode())):
            self[word] = found = self[stem] + self[word[len(stem) :]]
            return found
        text = word.decode()
        if _plain_ascii(word):
            # One run of letters that stand for themselves.
            ids = [t.id for t in self.model.tokenize(text)]
        elif _plain(text):
            # One run of letters: nothing to normalise or split before merging.
            ids = [t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.shown))]
        else:
            ids = self.library.encode(text, add_special_tokens=False).ids
        self[word] = found = struct.pack(f"<{len(ids)}{self.code}", *ids)
        return found

    def encode(self, text: bytes, end_id: int | None = END_ID) -> bytes:
        """Ids of a text, followed by the end id, as bytes of ``self.type``."""
        if len(self) > CACHED_WORDS:
            self.clear()
        if b"<|" not in text:
            text = text.lower()
        end = b"" if end_id is None else np.array([end_id], self.type).tobytes()
        return b"".join(map(self.__getitem__, text.split())) + end


@lru_cache(maxsize=2)
def encoder_of(path: str) -> WordEncoder:
    """The encoder of this Python worker, kept from task to task."""
    return WordEncoder(path)


def widened(ids: bytes, kind: np.dtype) -> bytes:
    """The same ids as little-endian unsigned 32-bit integers."""
    return ids if kind.itemsize == 4 else np.frombuffer(ids, kind).astype("<u4").tobytes()
