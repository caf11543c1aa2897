"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece the encoding ends in one token only, so that token is
all there is to store. It is the token that ends the prefix and may follow the
last token of the prefix before it; two tokens may follow one another if the
plain merge procedure leaves their joined bytes as these two. The encoding is read
off backwards. Appending adds entries and changes none; after an edit, entries are
computed anew until as many in a row as the longest token has bytes agree with the
old ones.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covarium.llm.common import text_or_empty

MEMO_ENTRIES, MEMO_CHARS, PAIRS = 600_000, 12_000_000, 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class PrefixBpe:
    """Encoder and decoder over a table of byte strings and their ranks."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        #: Tokens that merging their own bytes gives; others arise only as whole pieces.
        self.whole: dict[bytes, int] = {}
        #: The two tokens whose merge makes a token.
        self.halves: dict[int, tuple[int, int]] = {}
        for data, token in ranks.items():
            parts, joined = self._merged(data)
            if len(parts) == 1:
                self.whole[data] = token
                if joined:
                    self.halves[token] = ranks[joined[0]], ranks[joined[1]]
        self._follows: dict[int, bool] = {}

    def _merged(self, piece: bytes) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
        parts, ranks, joined = [piece[i : i + 1] for i in range(len(piece))], self.ranks, None
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            joined = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, joined

    def merge(self, piece: bytes) -> list[int]:
        """The plain procedure: merge the adjacent pair of lowest rank, leftmost first, while there is one."""
        return [self.ranks[p] for p in self._merged(piece)[0]]

    def follows(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` and ``b`` leaves these two.

        The merges that made the two are undone from the last one; at every
        stage the tokens that meet at the boundary must not merge before the
        merge just undone, the left of two equal ranks coming first.
        """
        bound = len(self.ranks) + 1 << 32
        while True:
            joined = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if joined is not None and joined < bound:
                return False
            left, right = self.halves.get(a), self.halves.get(b)
            if left is not None and (right is None or a > b):
                bound, a = a, left[1]
            elif right is not None:
                bound, b = b + 1, right[0]
            else:
                return True

    def extend(self, piece: bytes, last: list[int], upto: int | None = None) -> list[int]:
        """Add to ``last`` the last tokens of the prefixes of ``piece`` that it doesn't have yet."""
        whole, known, follows, longest = self.whole.get, self._follows, self.follows, self.longest
        if len(known) > PAIRS:
            known.clear()
        for end in range(len(last) + 1, (len(piece) if upto is None else upto) + 1):
            # short tokens are the likelier ones, and only one fits
            for start in range(end - 1, (end - longest if end > longest else 0) - 1, -1):
                token = whole(piece[start:end])
                if token is None:
                    continue
                if start:
                    before = last[start - 1]
                    fits = known.get(before << 32 | token)
                    if fits is None:
                        fits = known[before << 32 | token] = follows(before, token)
                    if not fits:
                        continue
                last.append(token)
                break
            else:
                raise ValueError("no token ends this prefix")
        return last

    def tokens(self, last: list[int]) -> list[int]:
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= len(self.bytes_of[last[at - 1]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece; a piece that is a token is that token."""
        token = self.ranks.get(piece)
        return [token] if token is not None else self.tokens(self.extend(piece, []))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class PrefixTable:
    """The stored last tokens of one byte string without piece bounds, for appends and edits."""

    def __init__(self, bpe: PrefixBpe, data: bytes = b"") -> None:
        self.bpe, self.data = bpe, data
        self.last = bpe.extend(data, [])
        self.computed = len(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.bpe.extend(self.data, self.last)
        self.computed = len(more)

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Put ``new`` in the place of ``data[start:end]``."""
        old, self.data = self.last, self.data[:start] + new + self.data[end:]
        shift, self.last, agree = len(new) - (end - start), self.last[:start], 0
        while len(self.last) < len(self.data):
            at = len(self.last)
            self.bpe.extend(self.data, self.last, at + 1)
            agree = agree + 1 if at >= start + len(new) and old[at - shift] == self.last[at] else 0
            if agree >= self.bpe.longest:
                self.computed = at + 1 - start
                self.last += old[at + 1 - shift :]
                return
        self.computed = len(self.data) - start

    def tokens(self) -> list[int]:
        return self.bpe.tokens(self.last)


#: The pattern (a fixed value) that words behind single spaces can be cut by on their own.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TextEncoder:
    """Encodes whole texts: each match of the pattern is a piece.

    With any other pattern than ``SPACED`` texts are cut as a whole. With it, a match that ends before a single space between two other characters ends
    there whatever follows, so words behind such spaces are memoised with their
    space; a text with any other white space beside a space is cut by the pattern
    as a whole. Memos are bounded and of two generations, so that what was used
    since the last turnover survives the next one. New pieces are encoded in
    sorted order: an entry of the prefix table stays true under appends, so each
    piece takes over those of the prefix it shares with the one before.
    """

    def __init__(self, bpe: PrefixBpe, pattern: str) -> None:
        self.bpe, self.pattern, self.spaced = bpe, regex.compile(pattern), pattern == SPACED
        self.words: dict[str, bytes | None] = {}
        self.words_old: dict[str, bytes | None] = {}
        self.pieces: dict[str, bytes] = {}
        self.pieces_old: dict[str, bytes] = {}
        self.held = self.piece_chars = 0

    def _cut(self, word: str) -> list[str] | None:
        """The pieces of a word and the space before it; None if other white space touches a space."""
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        if word.isascii() or max(word) < "\u0250":  # letters and what may follow them, cut as the pattern would
            if word.isalpha():
                return [" " + word]
            if word[-1] in ".,;:!?" and word[:-1].isalpha():
                return [" " + word[:-1], word[-1]]
        return self.pattern.findall(" " + word)

    def _learn_pieces(self, wanted: set[str]) -> None:
        pieces, old, bpe = self.pieces, self.pieces_old, self.bpe
        for p in wanted:
            if p in old:
                pieces[p] = old[p]
        before, last = b"", []
        for data, piece in sorted((p.encode(), p) for p in wanted if p not in pieces):
            if (token := bpe.ranks.get(data)) is not None:
                pieces[piece] = array("I", (token,)).tobytes()
                continue
            same = 0
            for x, y in zip(before, data):
                if x != y:
                    break
                same += 1
            last = bpe.extend(data, last[:same])
            before = data
            pieces[piece] = array("I", bpe.tokens(last)).tobytes()
            self.piece_chars += len(data)

    def _codes(self, parts: list[str]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, parts))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.words) > MEMO_ENTRIES or self.held > MEMO_CHARS:
            self.words, self.words_old, self.held = {}, self.words, 0
        if len(self.pieces) > MEMO_ENTRIES // 2 or self.piece_chars > MEMO_CHARS:
            self.pieces, self.pieces_old, self.piece_chars = {}, self.pieces, 0
        if not self.spaced:
            cut = [[m[0] for m in self.pattern.finditer(t)] for t in texts]
            self._learn_pieces({p for parts in cut for p in parts})
            return [np.frombuffer(self._codes(parts), "<u4") for parts in cut]
        words, old = self.words, self.words_old
        split, new = [], {}
        for text in texts:
            first, *rest = text.split(" ")
            codes = list(map(words.get, rest))
            if None in codes:
                for w, c in zip(rest, codes):
                    if c is None and w not in words and w not in new:
                        if w in old:
                            words[w] = old[w]
                        else:
                            new[w] = self._cut(w)
                        self.held += len(w)
            split.append((first, rest, codes))
        firsts = [None if not f or f[-1].isspace() else self.pattern.findall(f) for f, _, _ in split]
        self._learn_pieces({p for parts in (*new.values(), *firsts) if parts for p in parts})
        for w, parts in new.items():
            words[w] = None if parts is None else self._codes(parts)
        out = []
        for text, (_, rest, codes), head in zip(texts, split, firsts):
            if head is not None:
                codes = [words[w] if c is None else c for w, c in zip(rest, codes)] if None in codes else codes
                if None not in codes:
                    out.append(np.frombuffer(self._codes(head) + b"".join(codes), "<u4"))
                    continue
            parts = self.pattern.findall(text)
            self._learn_pieces(set(parts))
            out.append(np.frombuffer(self._codes(parts), "<u4"))
        return out


_encoders: dict[tuple[str, str], TextEncoder] = {}


def encoder(path: str, pattern: str) -> TextEncoder:
    """One encoder for each Python worker."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = TextEncoder(PrefixBpe(load_ranks(path)), pattern)
    return _encoders[path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str, digests: bool = False) -> DataFrame:
    """Encode every whole text and decode its ids again.

    Returns one row per input row: ``doc_id, n_tokens``, and ``ids`` (array of
    int) with ``decoded`` (binary), or with ``digests`` their SHA-256 as
    ``ids_sha256`` (of the decimal ids joined by commas) and ``decoded_sha256``.
    Null text counts as empty: no tokens. Texts of any length are encoded whole;
    repeated rows and null doc_ids come back as they are; an empty table gives
    an empty one. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks_path, pattern)
        numerals = {i: str(i) for i in coder.bpe.bytes_of} if digests else {}
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                count, left, right = [], [], []
                for ids in coder.encode(part.column(1).to_pylist()):
                    ids = ids.tolist()
                    decoded = coder.bpe.decode(ids)
                    count.append(len(ids))
                    left.append(hashlib.sha256(",".join(map(numerals.__getitem__, ids)).encode()).hexdigest() if digests else ids)
                    right.append(hashlib.sha256(decoded).hexdigest() if digests else decoded)
                kinds = (pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count, pa.int64()), pa.array(left, kinds[0]), pa.array(right, kinds[1])], names)

    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    kinds = ("string", "string") if digests else ("array<int>", "binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_tokens long, {names[2]} {kinds[0]}, {names[3]} {kinds[1]}")
