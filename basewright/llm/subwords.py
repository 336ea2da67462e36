"""Subword ids of whole texts by a public tokenizer file, word by word.

The tokenizer drops white space and never merges across it, so the ids of a text are the ids of its words in
order. Words repeat, so a batch of texts is split into its different words by Arrow, each is coded once, and a task
keeps the ids of the words it met. A new word made of plain letters, digits and
signs is cut into its pre-tokens here and only the merges are left to the library's model; every other word
goes through the library's whole chain (normaliser, splitter, merges).
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

DEFAULT_FILE = "word_bpe_49k.json"
END_ID = 2

_PLAIN = re.compile(r"[\x21-\x7EÀ-ÖØ-öø-ÿ]+")
#: Most words: letters, then signs that stand in no contraction and no special token.
_SIMPLE = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:;=?@\[-`{}~]*)")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def tokenizer_path(name: str = DEFAULT_FILE) -> str:
    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """Letters that stand for bytes in byte-level vocabularies: printable bytes for themselves, the rest from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def as_coded(texts: pa.Array) -> pa.Array:
    """Texts with A-Z in lower case, but as they are written where they hold a special token's mark."""
    lower = pc.ascii_lower(texts)
    marked = pc.match_substring(texts, "<|")
    return pc.if_else(marked, texts, lower) if pc.any(marked).as_py() else lower


def split(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words of some texts, the number of the word at each place, and each text's number of places.

    The last word is empty and stands for the end of a text, its last place.
    """
    parts = pc.ascii_split_whitespace(texts)
    found = parts.flatten().dictionary_encode()
    words, index = found.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()
    sizes = np.diff(parts.offsets.to_numpy()).astype(np.int64)
    if b"" in words:  # beside white space at the edges of a text
        real = index != words.index(b"")
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[real], minlength=len(sizes))
        index = index[real]
    sizes += 1
    places = np.full(int(sizes.sum()), len(words), np.int32)
    inner = np.ones(len(places), bool)
    inner[np.cumsum(sizes) - 1] = False
    places[inner] = index
    return [*words, b""], places, sizes


class WordCoder:
    """Ids of a text as an unsigned 16 or 32 bit array. At most ``2 * keep`` words are remembered."""

    def __init__(self, path: str, keep: int = 300_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.letter = "H" if self.dtype.itemsize == 2 else "I"
        self.end = np.array([END_ID], self.dtype).tobytes()
        self.keep, self.young, self.old = keep, {}, {}
        self.pieces: dict[str, bytes] = {}
        letters = _byte_letters()
        self.latin = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            found = self.model.tokenize(piece if piece.isascii() else piece.translate(self.latin))
            ids = array(self.letter, [t.id for t in found]).tobytes()
            if len(self.pieces) >= self.keep // 2:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def word(self, word: bytes) -> bytes:
        """Ids of one word, A-Z in lower case unless it holds a special token's mark."""
        ids = self.young.get(word)
        if ids is not None:
            return ids
        ids = self.old.get(word)
        if ids is None:
            text = word.decode("utf-8", "replace")
            low = text.lower()
            if word.isalpha():  # ASCII letters
                ids = self._piece(low)
            elif simple := _SIMPLE.fullmatch(low):
                ids = self._piece(simple[1]) + self._piece(simple[2]) if simple[2] else self._piece(low)
            elif _PLAIN.fullmatch(text) and "<|" not in text:
                ids = b"".join([self._piece(p) for p in _PIECES.findall(low)])
            else:
                ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        if len(self.young) >= self.keep:
            self.old, self.young = self.young, {}
        self.young[word] = ids
        return ids

    def encode(self, text: bytes | None, end: bool = True) -> np.ndarray:
        """Ids of a text in UTF-8 (null: empty), by default with the end id after them."""
        text = text or b""
        words = (text if b"<|" in text else text.lower()).split()
        known = list(map(self.young.get, words))
        if None in known:
            known = [self.word(w) if ids is None else ids for w, ids in zip(words, known)]
        if end:
            known.append(self.end)
        return np.frombuffer(b"".join(known), self.dtype)

    def encode_words(self, words: list[bytes], places: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """Ids of each text, with the end id, from what ``split`` gives."""
        known = list(map(self.young.get, words[:-1]))
        ids = [self.word(w) if found is None else found for w, found in zip(words, known)]
        ids.append(self.end)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        starts, known = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(ids), self.dtype)
        texts, edges = [], [0, *np.cumsum(sizes).tolist()]
        for k in range(0, len(sizes), 64):  # few texts at a time, so that what is held for their ids stays small
            part = edges[k : k + 65]
            some = places[part[0] : part[-1]]
            n = lengths[some]
            ends = np.cumsum(n)
            at = np.repeat(starts[some] - ends + n, n)
            at += np.arange(len(at))
            texts += np.split(known[at], ends[np.array(part[1:]) - part[0] - 1][:-1])
        return texts

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """As ``encode``, for texts without nulls."""
        return self.encode_words(*split(as_coded(texts))) if len(texts) else []


_coders: dict[tuple, WordCoder] = {}


#: Words that token files remember (twice as many at most): new words are what costs most. Queries that hold more besides take fewer.
MANY = 400_000


def coder(path: str, keep: int = 300_000) -> WordCoder:
    """The coder of this process: workers keep it from task to task."""
    if (path, keep) not in _coders:
        _coders.clear()
        _coders[path, keep] = WordCoder(path, keep)
    return _coders[path, keep]
