"""Byte-level BPE: exact merges in linear time by backtracking over longest vocabulary matches.

A sequence of tokens is what the merges give if and only if each pair of neighbours is what the merges give for
the two joined (compatible neighbours). So the encoder takes the longest token at a place, by an automaton over the
vocabulary with bytes mapped to Latin-1 characters; if it isn't compatible with its left neighbour it tries the next
shorter one, and if none fits it steps back. Compatibility of two tokens is found by undoing merges and remembered.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import struct

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_row, text_bytes


#: A space between two characters that are none.
BORDER = re.compile(r"(?<=\S) (?=\S)")


class Tokenizer:
    """The tokens of a rank file (base64 token and rank in each line), for bytes."""

    #: Parts and pieces up to so many characters are remembered, so many of each, and so many pairs of tokens: some 100 MB.
    SHORT, KEPT, PAIRS = 40, 200_000, 200_000

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.rank, self.split = ranks, regex.compile(pattern).findall
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        self.trie = ahocorasick.Automaton()
        for data, rank in ranks.items():
            self.token[rank] = data
            self.trie.add_word(data.decode("latin-1"), rank)
        self.trie.make_automaton()
        self.halves = [self._halves(x) for x in self.token]
        self.fits, self.done, self.known = {}, {}, {}
        # the next shorter token that a token begins with
        self.shorter = [next((ranks[x[:n]] for n in range(len(x) - 1, 0, -1) if x[:n] in ranks), -1) for x in self.token]

    def _halves(self, data: bytes) -> tuple[int, int] | None:
        """The two tokens whose merge made this one: the last merge when its bytes are merged by rank."""
        if len(data) < 2:
            return None
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[at] + parts[at + 1] not in self.rank:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (self.rank[parts[0]], self.rank[parts[1]]) if all(x in self.rank for x in parts) else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges, applied to the two tokens' bytes, leave just these two."""
        if (known := self.fits.get(key := (left, right))) is None:
            if len(self.fits) >= self.PAIRS:
                self.fits.clear()
            known = self.fits[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        limit = 1 << 60
        while True:
            # a merge across the border that comes before the merge undone last would have been made instead of it
            made = self.rank.get(self.token[left] + self.token[right])
            if made is not None and made < limit:
                return False
            of_left, of_right = self.halves[left], self.halves[right]
            if of_left is None and of_right is None:
                return True
            if of_right is None or of_left is not None and left > right:
                limit, left = left, of_left[1]
            else:  # of equal merges the one further left comes first
                limit, right = right + 1, of_right[0]

    def encode_piece(self, data: bytes) -> list[int]:
        """The ids of a piece; the longest matches one after the other, if all neighbours are compatible."""
        if (whole := self.rank.get(data)) is not None:
            return [whole]
        text, fits = data.decode("latin-1"), self.fits
        out = [rank for _, rank in self.trie.iter_long(text)]
        last = out[0]
        for now in out[1:]:
            if not fits.get((last, now)) and not self.compatible(last, now):
                return self._backtrack(text)
            last = now
        return out

    def _backtrack(self, text: str) -> list[int]:
        """As encode_piece: the longest token that is compatible with the one before, and back where none is."""
        token, shorter, compatible, iter_long, n = self.token, self.shorter, self.compatible, self.trie.iter_long, len(text)
        dead = bytearray(n + 1)  # places from which no way leads to the end
        out: list[int] = []
        at, now = 0, next(iter_long(text))[1]
        while True:
            last = out[-1] if out else -1
            while now >= 0:
                to = at + len(token[now])
                if not dead[to] and (last < 0 or compatible(last, now)):
                    break
                now = shorter[now]
            if now >= 0:
                out.append(now)
                at = to
                if at == n:
                    return out
                now = next(iter_long(text, at))[1]
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                dead[at] = 1
                now = out.pop()
                at -= len(token[now])
                now = shorter[now]

    def _pieces(self, text: str) -> bytes:
        """The ids of text, as little-endian unsigned 32-bit integers."""
        pieces = self.split(text)
        out = list(map(self.known.get, pieces))
        if None in out:
            for i, piece in enumerate(pieces):
                if out[i] is None:
                    found = self.encode_piece(piece.encode("utf-8", "surrogateescape"))
                    out[i] = struct.pack(f"<{len(found)}I", *found)
                    self._keep(self.known, piece, out[i])
        return b"".join(out)

    def _keep(self, kept: dict[str, bytes], key: str, ids: bytes) -> None:
        if len(key) <= self.SHORT:
            if len(kept) >= self.KEPT:
                kept.clear()
            kept[key] = ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers.

        The pattern never joins across a space between two other characters but puts that space before the second,
        so what stands between such spaces is encoded by itself and remembered.
        """
        first, *rest = text.split(" ")
        found = list(map(self.done.get, rest))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    if not rest[i] or rest[i][0].isspace() or rest[i][-1].isspace():
                        return self._encode_at(BORDER.split(text))
                    found[i] = self._remembered(rest[i])
        if rest and (not first or first[-1].isspace()):
            return self._encode_at(BORDER.split(text))
        return self._pieces(first) + b"".join(found)

    def _encode_at(self, parts: list[str]) -> bytes:
        return self._pieces(parts[0]) + b"".join([self.done.get(x) or self._remembered(x) for x in parts[1:]])

    def _remembered(self, part: str) -> bytes:
        ids = self._pieces(" " + part)
        self._keep(self.done, part, ids)
        return ids

    def forget(self) -> None:
        """Drop what is remembered: a worker that runs other tasks next needs its memory."""
        for kept in (self.fits, self.done, self.known):
            kept.clear()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, memoryview(ids).cast("I")))


@functools.lru_cache(2)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One for each Python worker; the file is installed with the library on every machine."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return Tokenizer(ranks, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary): each whole text's token ids, four little-endian bytes each.

    Null and empty texts have no ids; other columns are not read; repeated rows give repeated rows; an empty table
    gives an empty one. Texts may be of any length: a piece takes time in proportion to its bytes.
    """
    source = docs.select(F.col(id_col), text_bytes(text_col).alias("data"))
    return per_row(source, lambda x: (tokenizer(path, pattern).encode(x.decode("utf-8", "surrogateescape")),), "ids binary", id_col, after=lambda: tokenizer(path, pattern).forget())


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of what they decode to."""

    def digest(data: bytes) -> tuple[int, str, str]:
        own = tokenizer(path, pattern)
        ids = own.encode(data.decode("utf-8", "surrogateescape"))
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()

    source = docs.select(F.col(id_col), text_bytes(text_col).alias("data"))
    return per_row(source, digest, "n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, after=lambda: tokenizer(path, pattern).forget())
