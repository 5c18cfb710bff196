"""Byte-pair encoding as a streaming transducer with bounded lookahead, and its decoder.

A sequence of tokens is the encoding of its bytes exactly if every two neighbours are the
encoding of theirs, so the last token of the encoding of each prefix follows from the last
tokens of shorter prefixes.  A token can't be longer than the longest of the vocabulary;
that length is the sufficient lookahead: what the encodings of the last ``lookahead``
prefixes share can't change any more and is emitted.  Memory doesn't grow with the text.
"""

from __future__ import annotations

import base64
import codecs
import os
from collections.abc import Iterable, Iterator

import regex

#: Where the public tokenizers are on this machine; every function takes another path.
VOCABULARY = os.path.join("/opt/tokenizers", "byte_bpe_50k.tiktoken")

#: The public pre-tokenizer of byte-level BPE vocabularies: pieces that are encoded apart.
PIECES = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

_CACHE = 300_000  # pieces and pairs remembered at most, in each worker


class Vocabulary:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {k: b for b, k in self.rank.items()}
        self.lookahead = max(map(len, self.rank))
        lengths: dict[int, set[int]] = {}
        for b in self.rank:
            lengths.setdefault(b[-1], set()).add(len(b))
        self.lengths = {k: sorted(v) for k, v in lengths.items()}
        self.alone: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, list[int]] = {}

    def merged(self, b: bytes) -> list[int]:
        """The encoding by the merge list itself, lowest rank first; for short byte strings."""
        parts = [b[k : k + 1] for k in range(len(b))]
        while len(parts) > 1:
            best, at = min((self.rank.get(parts[k] + parts[k + 1], 1 << 40), k) for k in range(len(parts) - 1))
            if best == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def stands(self, token: int) -> bool:
        """Whether a token's bytes are encoded as that token."""
        ok = self.alone.get(token)
        if ok is None:
            ok = self.alone[token] = self.merged(self.bytes_of[token]) == [token]
        return ok

    def neighbours(self, a: int, b: int) -> bool:
        """Whether the bytes of two tokens are encoded as these two."""
        key = a << 24 | b
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > _CACHE:
                self.pairs.clear()
            ok = self.pairs[key] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return ok

    def stream(self, data: Iterable[bytes]) -> Iterator[int]:
        """The tokens of a byte stream, each as soon as it is stable."""
        last: dict[int, int] = {}  # by place: the last token of the encoding of the bytes up to there
        window, base, place, done = bytearray(), 0, 0, 0
        for chunk in data:
            for byte in chunk:
                window.append(byte)
                place += 1
                for n in self.lengths[byte]:
                    start = place - n
                    if start < done:
                        break
                    token = self.rank.get(bytes(window[start - base :]))
                    if token is None or start and start not in last:
                        continue
                    if self.neighbours(last[start], token) if start else self.stands(token):
                        last[place] = token
                        break
                if place - done >= 4 * self.lookahead:
                    stable = self.shared(last, place, done)
                    yield from self.path(last, stable, done)
                    last = {p: t for p, t in last.items() if p >= stable}
                    done = stable
                    del window[: max(0, done - self.lookahead - base)]
                    base = max(base, done - self.lookahead)
        yield from self.path(last, place, done)

    def shared(self, last: dict[int, int], place: int, done: int) -> int:
        """The place up to which the encodings of the last ``lookahead`` prefixes agree."""
        open_ends = {p for p in range(place - self.lookahead + 1, place + 1) if p in last}
        while len(open_ends) > 1:
            p = max(open_ends)
            open_ends.discard(p)
            open_ends.add(max(done, p - len(self.bytes_of[last[p]])))
        return open_ends.pop()

    def path(self, last: dict[int, int], place: int, done: int) -> list[int]:
        out = []
        while place > done:
            out.append(last[place])
            place -= len(self.bytes_of[last[place]])
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, no special tokens; [] for an empty or null text. Strings of special tokens are ordinary text."""
        out: list[int] = []
        if not text:
            return out
        pieces = self.pieces
        for piece in PIECES.findall(text) if len(text) < 1 << 16 else (m.group() for m in PIECES.finditer(text)):
            ids = pieces.get(piece)
            if ids is None:
                ids = list(self.stream([piece.encode("utf-8", "surrogatepass")]))
                if len(piece) <= 48:
                    if len(pieces) > _CACHE:
                        pieces.clear()
                    pieces[piece] = ids
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as soon as its bytes are whole: a byte-to-text state machine that keeps three bytes at most."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for k in ids:
            if part := machine.decode(self.bytes_of[k]):
                yield part
        if part := machine.decode(b"", True):
            yield part


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """The vocabulary at path, loaded once in each worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]
