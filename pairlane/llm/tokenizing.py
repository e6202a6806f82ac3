"""Token ids of whole texts by public tokenizers, with word ids remembered between texts."""
from __future__ import annotations

import base64
import functools
import re

import numpy as np

CACHE_WORDS, CACHE_PIECES = 600_000, 1_000_000
#: Unicode white space ends a word for the tokenizer; str.split() also splits at these four, so such texts take the long way.
ODD_SPACE = re.compile("[\x1c-\x1f]")


#: Letters, digits and the rest of Latin-1 in lower case, as the tokenizer parts them; words with other characters, with an
#: apostrophe or with what may be a special token are encoded whole.
PIECE = re.compile("[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")
WHOLE = re.compile(r"[^\x00-\xff]|'|<\|")


class WordTokenizer:
    """Ids of a tokenizer that drops white space and never joins over it, so that a text's ids are its words' ids in
    order, and a word's ids those of its letter runs, digits and sign runs, each of which ends in an id that only ends
    one.  Words and pieces are remembered (a bounded number), and new pieces of a text are encoded together."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of the whole text; none for null or empty."""
        if not text:
            return b""
        if ODD_SPACE.search(text):
            return np.array(self._encode(text), "<u4").tobytes()
        words = text.split()
        known = self.known
        new = {w for w in words if w not in known}
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = set(words)
        if new:
            self._learn(new)
        return b"".join(map(known.__getitem__, words))

    def _learn(self, words: set[str]) -> None:
        parts, known, pieces = {}, self.known, self.pieces
        for w in words:
            if w.isascii() and w.isalpha():
                parts[w] = (w.lower(),)
            elif WHOLE.search(w):
                known[w] = np.array(self._encode(w), "<u4").tobytes()
            else:
                parts[w] = PIECE.findall(w.lower())
        new = list({p for ps in parts.values() for p in ps if p not in pieces})
        if len(pieces) + len(new) > CACHE_PIECES:
            pieces.clear()
            new = list({p for ps in parts.values() for p in ps})
        if new:
            self._learn_pieces(new)
        for w, ps in parts.items():
            known[w] = pieces[ps[0]] if len(ps) == 1 else b"".join(map(pieces.__getitem__, ps))

    def _learn_pieces(self, new: list[str]) -> None:
        ids = np.array(self._encode(" ".join(new)), "<u4")
        ends = (np.flatnonzero(self.last[ids]) + 1) * 4
        if len(ends) == len(new):
            raw, start = ids.tobytes(), 0
            for w, end in zip(new, ends.tolist()):
                self.pieces[w] = raw[start:end]
                start = end
            return
        for w in new:
            self.pieces[w] = np.array(self._encode(w), "<u4").tobytes()


@functools.lru_cache(maxsize=4)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class ByteTokenizer:
    """Byte-level ids of whole texts from a file of ranks, and the bytes each id stands for."""

    def __init__(self, path: str, pattern: str):
        import tiktoken
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """Byte offset at which each token of the text ends."""
        return np.cumsum(self.sizes[np.array(self.encoding.encode_ordinary(text), np.int64)])


@functools.lru_cache(maxsize=4)
def byte_tokenizer(path: str, pattern: str) -> ByteTokenizer:
    return ByteTokenizer(path, pattern)
