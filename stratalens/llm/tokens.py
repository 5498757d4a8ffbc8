"""Whole-text encoding with the tokenizers library, each piece between white space encoded once.

Both vocabularies never merge across the places where ``PIECES`` cuts: there is a pre-token boundary.
So the ids of a text are those of its pieces joined, and a process keeps the ids of the pieces it has
met in a table of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

#: White space as the tokenizers' patterns have it (Unicode's White_Space property).
SPACE = "\t-\r \x85\xa0  -     　"
#: Letters that both patterns know as such. A word of them ends a pre-token ahead of white space and of any ASCII character that is no letter.
LETTERS, OTHER = "A-Za-zÀ-ÖØ-öø-ÿ", r"\x00-@\[-`{-\x7f"
#: Byte-level pre-tokens take one blank ahead of a word; of more white space the last character stands alone.
BLANK_AHEAD = re.compile(f" ?[{LETTERS}]++(?![^{OTHER}{SPACE}])| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Where white space is dropped, the words between are the pieces.
WORDS_ONLY = re.compile(f"[{LETTERS}]++(?![^{OTHER}{SPACE}])|[^{SPACE}]+")
#: A special token's string; stands between the pieces that are encoded together.
SEPARATOR = "<|endoftext|>"


class Encoder:
    """Encodes with one vocabulary file; ``most`` bounds the pieces that each of two tables keeps."""

    def __init__(self, path: str, most: int = 500_000) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.separator = self.tokenizer.token_to_id(SEPARATOR)
        kind = self.tokenizer.normalizer
        self.cut, self.lower = (BLANK_AHEAD, False) if kind is None else (WORDS_ONLY, True)
        self.most, self.known, self.older = most, {}, {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _learn(self, pieces: list[str]) -> None:
        plain = [p for p in pieces if len(p) < 200] if self.separator is not None else []
        for at in range(0, len(plain), 256):
            some = plain[at : at + 256]
            (joined,) = self.tokenizer.encode_batch_fast([SEPARATOR.join(some)], add_special_tokens=False)
            ids = np.array(joined.ids, np.uint32)
            ends = np.flatnonzero(ids == self.separator)
            if len(ends) != len(some) - 1:
                plain = []
                break
            raw, ends = ids.tobytes(), [*(4 * ends).tolist(), 4 * len(ids)]
            begin = 0
            for p, end in zip(some, ends):
                self.known[p] = raw[begin:end]
                begin = end + 4
        for p in pieces:
            if p not in self.known:
                self.known[p] = self._whole(p)

    def encode_many(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each whole text, each id as four bytes, little-endian."""
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and size < 2_000_000:  # characters cut at a time, and one text more
                size += len(texts[end])
                end += 1
            # "<|": perhaps a special token, which ends white space as the end of a text does
            cut = [[] if "<|" in text else self.cut.findall(self._folded(text)) for text in texts[at:end]]
            found = [list(map(self.known.get, pieces)) for pieces in cut]
            gaps = [self._gaps(ids) for ids in found]
            self._meet({pieces[i] for pieces, own in zip(cut, gaps) for i in own})
            for text, pieces, ids, own in zip(texts[at:end], cut, found, gaps):
                for i in own:
                    ids[i] = self.known[pieces[i]]
                yield b"".join(ids) if pieces else self._whole(text)
            at = end

    @staticmethod
    def _gaps(ids: list) -> list[int]:
        """Where the list has None."""
        out, at = [], -1
        try:
            while True:
                at = ids.index(None, at + 1)
                out.append(at)
        except ValueError:
            return out

    def _folded(self, text: str) -> str:
        """The text in lower case if the vocabulary wants that, and nothing in it can compose or change length."""
        if self.lower:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text
            return text.lower()
        return text

    def _meet(self, new: set[str]) -> None:
        """Learn these pieces."""
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        if self.older:
            again = {p: self.older[p] for p in new if p in self.older}
            self.known |= again
            new = new.difference(again)
        self._learn(list(new))

    def encode(self, text: str) -> bytes:
        return next(self.encode_many([text]))


@lru_cache(maxsize=4)
def encoder(path: str, most: int = 500_000) -> Encoder:
    """This process's encoder for a vocabulary file."""
    return Encoder(path, most)
