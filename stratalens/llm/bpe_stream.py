"""Byte-pair encoding as a streaming transducer with bounded lookahead, and incremental decoding.

The transducer reads bytes one by one. For each position it knows the last token of the encoding of
what has been read so far: the longest vocabulary entry ending there that may follow the last token at
the place where it begins. Two tokens may stand side by side if merging their bytes gives them back;
a sequence is the encoding of its bytes exactly if all neighbours may. What comes later can change a
token only as far back as the merge list's lookahead reaches: a merge takes its left part away from a
lower merge, which may thereby lose its own left part, and so on down the list of ranks. Once more
than that has been read, the paths back from the last positions have met, and all before is final:
it is given out and forgotten. So memory is bounded by the merge list, not by the text.

A text streams through in chunks, pre-tokens and all. What is sure to be whole pre-tokens goes on, the
rest waits for the next chunk; a pre-token that doesn't end for thousands of characters is fed to the
transducer as it comes. Neither the text nor its pre-tokens are ever held together.
"""

from __future__ import annotations

import codecs
import json
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm.common import documents, free_name, text_or_empty, trimmed, without
from stratalens.llm.tokens import BLANK_AHEAD, LETTERS

#: How byte-level vocabularies split a text before merging.
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

#: The kinds of characters that runs are of: letters, numbers, others; and white space.
RUNS = tuple(map(regex.compile, (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+")))
SPACE_RUN = regex.compile(r"\s+")
#: Characters of a chunk; of the beginning of a pre-token that waits for its end, at most, before it is fed on.
CHUNK, WAITING = 1 << 16, 1 << 12
#: A pre-token's kind is decided by so many characters.
DECIDED = 3

#: A piece that is one pre-token for sure.
ONE_WORD = re.compile(f" ?[{LETTERS}]+").fullmatch


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others, in order, from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class MergeList:
    """A byte-level vocabulary: bytes of the tokens, the merges by rank, and what follows from them."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        of = _byte_of_character()
        raw = {t: bytes(map(of.__getitem__, t)) for t in file["model"]["vocab"]}
        self.id_of = {raw[t]: i for t, i in file["model"]["vocab"].items()}
        self.bytes_of: dict[int, bytes] = {i: t for t, i in self.id_of.items()}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}  # of each merged token
        self.made_at: dict[int, int] = {}  # rank of the merge that makes a token; single bytes: -1
        for n, merge in enumerate(file["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            a, b = self.id_of[raw[a]], self.id_of[raw[b]]
            whole = self.id_of[self.bytes_of[a] + self.bytes_of[b]]
            self.rank[a, b] = n
            if whole not in self.made_at:
                self.halves[whole], self.made_at[whole] = (a, b), n
        for i, t in self.bytes_of.items():
            if len(t) == 1:
                self.made_at[i] = -1
        #: Tokens that their own bytes give; in text no other occurs.
        self.reachable = {t: i for t, i in self.id_of.items() if len(t) == 1}
        for (a, b), n in self.rank.items():
            whole = self.bytes_of[a] + self.bytes_of[b]
            if self.made_at[self.id_of[whole]] == n and self.bytes_of[a] in self.reachable and self.bytes_of[b] in self.reachable and self._check(a, b, n):
                self.reachable[whole] = self.id_of[whole]
        self.size_of = {i: len(t) for i, t in self.bytes_of.items()}
        self._automaton()
        self.longest = max(map(len, self.reachable))
        self.lookahead = self._lookahead()
        self.fits_known: dict[int, bool] = {}

    def _lookahead(self) -> int:
        """Bytes after which a token is final: the longest chain of merges in which each takes away the right part of the next, in bytes, and the longest token."""
        reach: dict[int, int] = {}  # by left part, of the merges so far
        most = 0
        for a, b in self.rank:  # by rank
            here = len(self.bytes_of[b]) + reach.get(b, 0)
            reach[a] = max(reach.get(a, 0), here)
            most = max(most, here)
        return most + self.longest

    def _automaton(self) -> None:
        """States are the beginnings of tokens; a state knows the longest token that ends with it, a token the next shorter one that ends it."""
        self.step: dict[int, int] = {}  # state << 8 | byte -> state
        back, self.ends_with, ends_here = [0], [-1], {}
        for t, i in self.reachable.items():
            state = 0
            for byte in t:
                key = state << 8 | byte
                if key not in self.step:
                    self.step[key] = len(back)
                    back.append(0)
                state = self.step[key]
            ends_here[state] = i
        self.ends_with = [-1] * len(back)
        self.shorter: dict[int, int] = {}
        level = [0]
        children: dict[int, list[tuple[int, int]]] = {}
        for key, state in self.step.items():
            children.setdefault(key >> 8, []).append((key & 255, state))
        while level:
            deeper = []
            for state in level:
                for byte, child in children.get(state, ()):
                    at = back[state]
                    while state and at and at << 8 | byte not in self.step:
                        at = back[at]
                    back[child] = self.step.get(at << 8 | byte, 0) if state else 0
                    below = self.ends_with[back[child]]
                    if child in ends_here:
                        self.ends_with[child] = ends_here[child]
                        self.shorter[ends_here[child]] = below
                    else:
                        self.ends_with[child] = below
                    deeper.append(child)
            level = deeper
        self.back, self.learned = back, len(self.step)

    def go(self, state: int, byte: int) -> int:
        """The state after a byte that no token goes on with; kept for the next time."""
        at = state
        while at and at << 8 | byte not in self.step:
            at = self.back[at]
        at = self.step.get(at << 8 | byte, 0)
        if len(self.step) < self.learned + 1_000_000:
            self.step[state << 8 | byte] = at
        return at

    def fits(self, a: int, b: int) -> bool:
        """Whether the bytes of ``a`` and ``b`` together are encoded as just these two tokens."""
        if len(self.fits_known) > 1_000_000:
            self.fits_known.clear()
        known = self.fits_known[a << 20 | b] = self._check(a, b, len(self.rank))
        return known

    def _check(self, left: int, right: int, limit: int) -> bool:
        """Undo the merges inside both tokens, latest first: no merge across the border may come before the one undone, the first before ``limit``."""
        while True:
            across = self.rank.get((left, right))
            if across is not None and across < limit:
                return False
            on_left, on_right = self.made_at[left], self.made_at[right]
            if on_left < 0 and on_right < 0:
                return True
            # of equal ranks the left one merges first, so the right one is undone first
            if on_left > on_right:
                limit, left = on_left, self.halves[left][1]
            else:
                # a merge across the border with this rank starts further left, and would come first
                limit, right = on_right + 1, self.halves[right][0]


class Transducer:
    """Encodes one pre-token, given in chunks of bytes, and emits ids as they become final."""

    def __init__(self, merges: MergeList) -> None:
        self.merges = merges
        self.begin()

    def begin(self) -> None:
        self.window = b""  # bytes that aren't given out yet, and some before them
        self.last: list[int] = []  # by position of the window, the last token of what ends there
        self.state = 0  # of the automaton
        self.done = 0  # bytes at the window's start that have been given out
        self.most_held = 0

    def feed(self, chunk: bytes) -> Iterator[int]:
        """Take these bytes; give the ids that nothing to come can change."""
        merges = self.merges
        for at in range(0, len(chunk), 1024):
            self._read(chunk[at : at + 1024])
            self.most_held = max(self.most_held, len(self.window))
            if len(self.window) - self.done > 2 * merges.lookahead:
                yield from self._emit(self._stable())
                keep = max(0, self.done - merges.longest)
                self.window, self.last, self.done = self.window[keep:], self.last[keep:], self.done - keep

    def end(self) -> Iterator[int]:
        """No more bytes: all that is left is final."""
        yield from self._emit(len(self.window))
        self.begin()

    def whole(self, raw: bytes) -> list[int]:
        """The ids of a pre-token that is at hand; of one within the lookahead nothing is final before its end."""
        if len(raw) > self.merges.lookahead:
            return [*self.feed(raw), *self.end()]
        last: list[int] = []
        self._step(raw, last, 0, 0, 0)
        found, at, size = [], len(raw), self.merges.size_of
        while at:
            token = last[at - 1]
            found.append(token)
            at -= size[token]
        found.reverse()
        return found

    def _read(self, chunk: bytes) -> None:
        self.state = self._step(chunk, self.last, self.state, len(self.window), self.done)
        self.window += chunk

    def _step(self, chunk: bytes, last: list[int], state: int, end: int, done: int) -> int:
        """Append to ``last`` for each byte; ``end``: bytes before; tokens begin at ``done`` or later. The automaton's new state."""
        merges = self.merges
        step, ends_with, shorter, size, known, fits = merges.step, merges.ends_with, merges.shorter, merges.size_of, merges.fits_known, merges.fits
        for byte in chunk:
            end += 1
            after = step.get(state << 8 | byte)
            state = merges.go(state, byte) if after is None else after
            token = ends_with[state]
            while True:
                begin = end - size[token]
                if begin == 0:
                    break
                if begin >= done:
                    before = last[begin - 1]
                    ok = known.get(before << 20 | token)
                    if fits(before, token) if ok is None else ok:
                        break
                token = shorter[token]
            last.append(token)
        return state

    def _stable(self) -> int:
        """How far all paths back from the last positions agree: none of what comes can reach behind that."""
        size = self.merges.size_of
        at = {len(self.window) - i for i in range(self.merges.longest)}
        while len(at) > 1:
            far = max(at)
            at.discard(far)
            if far > self.done:
                at.add(far - size[self.last[far - 1]])
        return max(at.pop(), self.done)

    def _emit(self, upto: int) -> Iterator[int]:
        found, at, size = [], upto, self.merges.size_of
        while at > self.done:
            token = self.last[at - 1]
            found.append(token)
            at -= size[token]
        self.done = upto
        return reversed(found)


class Codec:
    """Encodes whole texts and decodes ids, with a table of bounded size of the pieces met."""

    def __init__(self, path: str, most: int = 350_000) -> None:
        self.merges = MergeList(path)
        self.transducer = Transducer(self.merges)
        self.most = most
        self.known: dict[str, bytes] = {}  # ids of pieces, each id as four bytes
        self.older: dict[str, bytes] = {}
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.merges.special)) + ")") if self.merges.special else None

    def _piece(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            stream, found = self.transducer, []
            for word in (piece,) if ONE_WORD(piece) else PRE_TOKENS.findall(piece):
                found += stream.whole(word.encode("utf-8", "surrogatepass"))
            ids = array("I", found).tobytes()
        if len(piece) < 200:
            self.known[piece] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        pieces = BLANK_AHEAD.findall(text)
        found = list(map(self.known.get, pieces))
        at = -1
        try:
            while True:
                at = found.index(None, at + 1)
                found[at] = self.known.get(pieces[at]) or self._piece(pieces[at])
        except ValueError:
            return b"".join(found)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        return np.frombuffer(b"".join(self.stream(text[at : at + CHUNK] for at in range(0, len(text), CHUNK))), np.uint32)

    def stream(self, chunks: Iterable[str]) -> Iterator[bytes]:
        """The ids of the text that the chunks make up, four bytes each, as they become final."""
        most, machine, rest = max((len(x) for x in self.merges.special), default=1) - 1, PreTokens(self), ""
        for chunk in chunks:
            rest += chunk
            while self.special is not None and (found := self.special.search(rest)):
                # a special token's string is one token, and ends what is before it as the text's end does
                yield from machine.feed(rest[: found.start()])
                yield from machine.end()
                yield array("I", [self.merges.special[found[0]]]).tobytes()
                rest = rest[found.end() :]
            sure = max(0, len(rest) - most) if self.special is not None and "<" in rest[-most:] else len(rest)
            yield from machine.feed(rest[:sure])
            rest = rest[sure:]
        yield from machine.feed(rest)
        yield from machine.end()

    def decode(self, ids: Sequence[int]) -> str:
        return "".join(self.decoded(ids))

    def decoded(self, ids: Sequence[int], chunk: int = 4096) -> Iterator[str]:
        """The text in parts: each token moves the byte-to-text machine on, which holds back at most an unfinished character."""
        machine, of = codecs.getincrementaldecoder("utf-8")("replace"), self.merges.bytes_of
        for at in range(0, len(ids), chunk):
            yield machine.decode(b"".join(map(of.__getitem__, ids[at : at + chunk])))
        yield machine.decode(b"", True)


class PreTokens:
    """Cuts a text that comes in chunks into pre-tokens and encodes them; holds back what may go on."""

    def __init__(self, own: Codec) -> None:
        self.own, self.stream = own, own.transducer
        self.waiting = ""  # begins where a pre-token begins
        self.run: regex.Pattern | None = None  # the kind of a pre-token that is being fed to the transducer
        self.blank = ""  # of a run of white space, its last character

    def feed(self, text: str) -> Iterator[bytes]:
        text, self.waiting = self.waiting + text, ""
        while text:
            if self.run is not None:
                got = self.run.match(text)
                size = got.end() if got else 0
                yield self._go_on(text[:size])
                if size == len(text):
                    return
                yield array("I", self.stream.end()).tobytes()
                text, blank, self.run, self.blank = text[size:], self.blank, None, ""
                if blank == " ":  # goes with what follows
                    text = blank + text
                elif blank:  # any other last one is a pre-token by itself
                    yield self.own._plain(blank)
                continue
            cut = self._sure(text)
            if cut:
                yield self.own._plain(text[:cut])
                text = text[cut:]
            if len(text) <= WAITING:
                self.waiting = text
                return
            text = self._open(text)

    def end(self) -> Iterator[bytes]:
        """Nothing more comes, as at the end of the text."""
        if self.run is not None:
            yield array("I", self.stream.feed(self.blank.encode("utf-8", "surrogatepass"))).tobytes()
            yield array("I", self.stream.end()).tobytes()
            self.run, self.blank = None, ""
        if self.waiting:
            yield self.own._plain(self.waiting)
            self.waiting = ""

    @staticmethod
    def _sure(text: str) -> int:
        """How much of it is whole pre-tokens, whatever comes next."""
        at = len(text)
        while (at := text.rfind(" ", 1, at)) > 0:  # a blank between two others: a pre-token ends ahead of it
            if at + 1 < len(text) and not text[at - 1].isspace() and not text[at + 1].isspace():
                return at
        sure = 0
        for found in PRE_TOKENS.finditer(text):
            if found.start() + DECIDED > len(text) or found.end() == len(text):
                break
            if not SPACE_RUN.match(text, found.end() - 1):  # white space depends on what follows it
                sure = found.end()
        return sure

    def _open(self, text: str) -> str:
        """Begin to feed the pre-token that ``text`` is the beginning of: one run of a kind, perhaps after a blank. What is to be read next."""
        if SPACE_RUN.match(text) and (text[0] != " " or SPACE_RUN.match(text, 1)):
            self.run = SPACE_RUN
            return text
        at = int(text[0] == " ")
        self.run = next(kind for kind in RUNS if kind.match(text, at))
        list(self.stream.feed(text[:at].encode()))  # a byte alone is never final
        return text[at:]

    def _go_on(self, some: str) -> bytes:
        if self.run is SPACE_RUN and some:  # the last one may belong to what follows
            some, self.blank = self.blank + some[:-1], some[-1]
        return array("I", self.stream.feed(some.encode("utf-8", "surrogatepass"))).tobytes()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """This process's codec for a vocabulary file."""
    return Codec(path)


def _encode(path: str, at: int, batch_bytes: int = 4_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            begin, size, ids, texts = 0, 0, [], []
            for row, text in enumerate(batch.column(at)):
                text = text.as_py()
                ids.append(own.encode(text))
                texts.append(own.decode(ids[-1].tolist()))
                size += len(text)
                if size > batch_bytes or row + 1 == batch.num_rows:
                    columns = batch.slice(begin, row + 1 - begin).columns
                    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([*columns[:at], *columns[at + 1 :], lists, pa.array(texts, pa.string())], [*(n for i, n in enumerate(batch.schema.names) if i != at), "ids", "decoded"])
                    begin, size, ids, texts = row + 1, 0, [], []

    return run


def encode_and_decode(df: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """``df`` and the columns ids (array of int) of each whole text, and decoded, the text they give.

    Ids are those of the vocabulary's merge list; a special token's string in a text is that token.

    Nulls: a null text counts as empty, without ids; nulls elsewhere stay. A very long text streams
    through in constant memory; only its row (the text, its ids, the text again) is held whole. Ties
    can't occur: a text has one encoding. Repeated rows are encoded each. An empty table gives an empty result. Existing columns called ids or decoded are replaced.
    """
    whole = without(df, "ids", "decoded")
    name = free_name(whole, "text_to_encode")
    asked = whole.withColumn(name, text_or_empty(text_col))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema.fields)
    return asked.mapInArrow(trimmed(_encode(tokenizer_path, len(whole.columns))), f"{fields}, ids array<int>, decoded string")


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = encode_and_decode(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
