"""Token ids of whole texts, through the ``tokenizers`` library.

``WordEncoder`` encodes each distinct blank-delimited chunk once and joins the cached
ids. That equals encoding the whole text for a tokenizer whose pre-tokens never cross
white space, such as one that drops it (``tests/llm/test_tokens.py`` compares the two).
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

_TAIL = ".,;:!?"
_CHUNKS, _CORES, _SHORT = 120_000, 200_000, 64


def _byte_level() -> dict[int, str]:
    """Latin-1 characters as byte-level tokenizers spell their UTF-8 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
    return {c: "".join(spelled[b] for b in chr(c).encode()) for c in range(256)}


class _Cores(dict):
    """Ids of letters without punctuation, of punctuation, and of whatever is neither."""

    def __init__(self, tokenizer: Tokenizer, code: str):
        self._tokenizer, self._model, self._code, self._spelling = tokenizer, tokenizer.model, code, _byte_level()

    def __missing__(self, text: str) -> bytes:
        if len(self) > _CORES:
            self.clear()
        if text.isalpha() and text.islower() and max(text) < "Ā":  # one pre-token of letters: only the model is left to apply
            ids = [t.id for t in self._model.tokenize(text if text.isascii() else text.translate(self._spelling))]
        else:
            ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        coded = array(self._code, ids).tobytes()
        if len(text) <= _SHORT:
            self[text] = coded
        return coded


class _Chunks(dict):
    """Ids of blank-delimited chunks."""

    def __init__(self, cores: _Cores):
        self._cores = cores

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > _CHUNKS:
            self.clear()
        core = chunk.rstrip(_TAIL)
        if len(core) < len(chunk) and core.isalpha():
            coded = self._cores[core] + self._cores[chunk[len(core) :]]
        else:
            coded = self._cores[chunk] if chunk else b""
        if len(chunk) <= _SHORT:
            self[chunk] = coded
        return coded


class WordEncoder:
    """Encodes texts to little-endian unsigned ids of the narrowest width that holds the vocabulary.

    special_as_text: whether the strings of special tokens in a text are ordinary text.
    The caches hold short strings only and are emptied when full, so memory stays bounded whatever the texts.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = special_as_text
        self._raw_marker = None if special_as_text else "<|"
        narrow = tokenizer.get_vocab_size() <= 1 << 16
        self.dtype = np.dtype("<u2" if narrow else "<u4")
        self._chunks = _Chunks(_Cores(tokenizer, "H" if narrow else "I"))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; none for a null or blank one."""
        get = self._chunks.__getitem__
        return [b"".join(map(get, self._split(text))) if text else b"" for text in texts]

    def _split(self, text: str) -> list[str]:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return _blanks(text)
        if self._raw_marker and self._raw_marker in text:
            return _blanks(text)
        return _blanks(text.lower())  # of Latin-1 text, lower() is what the tokenizer's own step does


def _blanks(text: str) -> list[str]:
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


@lru_cache(maxsize=2)
def encoder(path: str, special_as_text: bool = False) -> WordEncoder:
    """The encoder of this Python worker, kept from one task to the next."""
    return WordEncoder(path, special_as_text)
