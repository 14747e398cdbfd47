"""Token ids of texts by a public word-level tokenizer, through a worker cache of words."""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks use the cores

TOKENIZER = "word_bpe_49k.json"
CACHE = 200_000  # words a worker remembers; beyond it the cache starts anew, which changes no result
SHORT = 64  # longer words are not remembered


@functools.cache
def tokenizer(name: str) -> Tokenizer:
    """The tokenizer as its file gives it: special strings in a text become special tokens."""
    found = Tokenizer.from_file(public_tokenizers.path(name))
    found.no_truncation()
    found.no_padding()
    return found


#: Words of ASCII signs and Latin-1 letters, in which the tokenizer's normaliser only lowers the case.
_PLAIN = re.compile("[!-~\xa1-\xff]+")
#: The tokenizer's own pattern, with its letter and number classes written out for such words.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")


@functools.cache
def byte_letters() -> dict[int, str]:
    """str.translate table from code points below 256 to the letters that byte-level models have for their bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    return {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}


class WordIds:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space before it merges anything, so a text's ids are those of its words in
    turn. Only ASCII white space parts words here. Words are remembered, and so are the pieces of plain
    words, which go straight to the library's merge model; all other words go through the whole library.
    """

    def __init__(self, name: str = TOKENIZER):
        self.name, self.words, self.pieces = name, {}, {}
        self.model, self.letters = tokenizer(name).model, byte_letters()
        self.packed = [i.to_bytes(4, "little") for i in range(tokenizer(name).get_vocab_size())]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """One entry for each text; null is empty."""
        return [self._ids((t or "").encode("utf-8", "surrogatepass").split()) for t in texts]

    def _ids(self, words: list[bytes]) -> bytes:
        if len(self.words) > CACHE:
            self.words.clear()
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        known = self.words
        found = list(map(known.get, words))
        for i in [i for i, ids in enumerate(found) if ids is None]:
            word = words[i]
            found[i] = ids = known.get(word) or self._word(word.decode("utf-8", "surrogatepass"))
            if len(word) <= SHORT:
                known[word] = ids
        return b"".join(found)

    def _word(self, word: str) -> bytes:
        if not _PLAIN.fullmatch(word) or "<|" in word:
            ids = tokenizer(self.name).encode(word, add_special_tokens=False).ids
            return np.array(ids, dtype="<u4").tobytes()
        return b"".join([self.pieces.get(p) or self._piece(p) for p in _PIECES.findall(word.lower())])

    def _piece(self, piece: str) -> bytes:
        tokens = self.model.tokenize(piece if piece.isascii() else piece.translate(self.letters))
        ids = b"".join([self.packed[t.id] for t in tokens])
        if len(piece) <= SHORT:
            self.pieces[piece] = ids
        return ids


@functools.cache
def word_ids(name: str = TOKENIZER) -> WordIds:
    """This worker's encoder; its cache outlives the task."""
    return WordIds(name)
