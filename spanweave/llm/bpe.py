"""Byte-pair encoding by backtracking over longest matches.

A greedy longest match is not what byte-pair merging gives. A sequence of tokens is
exactly the merged form of its bytes when each adjacent pair is *compatible*: merging
the pair's bytes by rank would not join across their border. The encoder walks left to
right, tries the longest token an Aho-Corasick automaton found at the position, falls
back to shorter prefixes, and steps back once if none is compatible; positions known to
fail are struck out, so each is left at most once and the work is linear.
"""

from __future__ import annotations

import base64
import re
from itertools import chain

import ahocorasick
import numpy as np
import regex

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the published split pattern of this vocabulary.
SPLIT_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A lone space between two other signs always opens a split word, so a text may be cut
#: there and each run encoded (and remembered) by itself.
CUT = re.compile(r"(?<=\S) (?=\S)")

#: A worker's memo of split words holds this many before it starts anew.
MEMO_WORDS = 1 << 17
MEMO_LENGTH = 48


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by id, from a file of base64 tokens and ranks."""
    by_id: dict[int, bytes] = {}
    with open(path, "rb") as f:
        for line in f:
            token, rank = line.split()
            by_id[int(rank)] = base64.b64decode(token)
    return [by_id[i] for i in range(len(by_id))]


class Encoder:
    """Exact byte-pair encoder of one vocabulary."""

    def __init__(self, path: str = DEFAULT_VOCABULARY):
        self.tokens = load_ranks(path)
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        self.lengths = [len(t) for t in self.tokens]
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(self.tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self._build_tables()
        self.split = regex.compile(SPLIT_PATTERN).findall
        self._memo = _Memo(self)
        self._pieces = _Pieces(self)
        ends = np.cumsum([0, *self.lengths])
        self.offsets = ends.astype(np.int64)
        self.blob = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)

    def _build_tables(self) -> None:
        """The next shorter prefix of each token, the pair each was merged from, and
        the pairs that merge."""
        ids, n = self.ids, len(self.tokens)
        self.shorter = [-1] * n
        for i, t in enumerate(self.tokens):
            for k in range(len(t) - 1, 0, -1):
                j = ids.get(t[:k])
                if j is not None:
                    self.shorter[i] = j
                    break
        self.parts = [(i, i) for i in range(n)]
        self.merged: dict[tuple[int, int], int] = {}
        for i, t in enumerate(self.tokens):
            left = self.shorter[i]
            while left >= 0:
                right = ids.get(t[self.lengths[left]:])
                if right is not None and left < i and right < i and self.compatible(left, right):
                    self.parts[i] = (left, right)
                    self.merged[left, right] = i
                    break
                left = self.shorter[left]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank keeps the border between tokens ``a`` and ``b``.

        The merges that made both are undone from the latest back; a pair that meets at
        the border must not have been mergeable before the later of them came about."""
        limit = len(self.tokens) + 1
        merged, parts = self.merged, self.parts
        while True:
            if merged.get((a, b), limit) < limit:
                return False
            if a > b and parts[a][1] != a:
                limit, a = a, parts[a][1]
            elif parts[b][0] != b:
                limit, b = b + 1, parts[b][0]
            elif parts[a][1] != a:
                limit, a = a, parts[a][1]
            else:
                return True

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one split word."""
        data = word.encode("utf-8", "surrogatepass")
        whole = self.ids.get(data)
        if whole is not None:
            return (whole,)
        n, lengths, shorter = len(data), self.lengths, self.shorter
        longest = [-1] * n
        for end, i in self.automaton.iter(data.decode("latin-1")):
            start = end + 1 - lengths[i]
            if longest[start] < 0 or lengths[longest[start]] < lengths[i]:
                longest[start] = i
        open_at = bytearray(b"\1" * (n + 1))
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + lengths[token]
            if open_at[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return tuple(out)
                token = longest[at]
                continue
            if shorter[token] >= 0:
                token = shorter[token]
                continue
            open_at[at] = 0
            token = out.pop()
            at -= lengths[token]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for a null or empty one."""
        if not text:
            return []
        first, *rest = CUT.split(text)
        ids = list(chain.from_iterable(map(self._memo.__getitem__, self.split(first))))
        ids.extend(chain.from_iterable(map(self._pieces.__getitem__, rest)))
        return ids

    def count(self, text: str | None) -> int:
        """Number of ids of a text."""
        if not text:
            return 0
        first, *rest = CUT.split(text)
        return sum(map(len, map(self._memo.__getitem__, self.split(first)))) + sum(map(len, map(self._pieces.__getitem__, rest)))

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, gathered through the offset table."""
        if not len(ids):
            return b""
        ids = np.asarray(ids, dtype=np.int64)
        start, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(size)
        index = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
        return self.blob[index].tobytes()

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, dtype=np.int64)).decode("utf-8", "surrogatepass")


class _Memo(dict):
    """Split words met so far, with their ids; bounded."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.encoder.encode_word(word)
        if len(word) <= MEMO_LENGTH:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = ids
        return ids


class _Pieces(_Memo):
    """Runs that follow a lone space, with the ids of the space and the run."""

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(chain.from_iterable(map(self.encoder._memo.__getitem__, self.encoder.split(" " + piece))))
        if len(piece) <= MEMO_LENGTH:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[piece] = ids
        return ids


_loaded: dict[str, Encoder] = {}


def encoder(path: str = DEFAULT_VOCABULARY) -> Encoder:
    """The worker's encoder of a vocabulary, built once."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
