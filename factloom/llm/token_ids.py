"""Token ids of texts by a public tokenizer, for use inside tasks.

``word_bpe_49k`` drops white space and never joins what white space parts, so
a text's ids are those of its words one after another. A task keeps the ids of
words it has met, up to a bound, which saves most calls of the tokenizer.
"""

from __future__ import annotations

from array import array

#: Words whose ids a worker keeps before they become the older half of its cache.
CACHE_WORDS = 400_000

_encoders: dict[str, WordEncoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Bytes of small letters that are their own normal form and that byte-level BPE writes as they are: a-z, and most of U+00E1 to U+00FF.
_LETTERS = bytes(range(ord("a"), ord("z") + 1)) + b"\xc3" + bytes(b for b in range(0xA1, 0xC0) if b not in (0xAD, 0xB7))
#: Marks that form runs of their own at a word's end; those of special tokens and of contractions are left out.
_MARKS = b".,;:!?#*$%&()[]{}-_+=/@"


class WordEncoder(dict):
    """From a word's UTF-8 bytes to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.old: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        ids = self[word] = self._ids(word) if ids is None else ids
        return ids

    def _ids(self, word: bytes) -> bytes:
        if not word.translate(None, _LETTERS):  # one run of small letters goes straight to the merges
            return array("I", [t.id for t in self.model.tokenize(word.decode("latin-1"))]).tobytes()
        letters = word.rstrip(_MARKS)
        if letters and len(letters) < len(word) and not letters.translate(None, _LETTERS):
            return self[letters] + self[word[len(letters) :]]  # letters and marks are parted before merging
        text = word.decode("utf-8", "replace")
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def text(self, text: bytes | None) -> bytes:
        if len(self) > CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        if not text:
            return b""
        # ASCII capitals first, which spares their words a turn; special tokens are written as they are
        return b"".join(map(self.__getitem__, (text if b"<|" in text else text.lower()).split()))


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for the file at ``path``."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
