"""Sequence packing in space-filling-curve order.

A document's token ids are hashed to a fixed table of random directions; the
direction of their mean, whatever its length, is a point of a few dimensions, near
that of documents with like words. The points are ranked along a Hilbert curve, the
rows range-sorted by that rank, ranges holding equal numbers of tokens, and each
range is laid end to end and cut into sequences, so that neighbours on the curve
share sequences and only the last sequence of a range is short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covarium.llm.common import materialise, text_or_empty, thinned

DIMENSIONS, BITS = 4, 10
END_ID = 2
SEQUENCE = 4096
#: Tokens of a range, such that one task holds some megabytes and its padding is under a thousandth, and rows (about; twice as many at most) by which ranges are cut.
RANGE_TOKENS, SAMPLE_ROWS = 1 << 22, 1 << 16
#: Bytes of text that are encoded at once.
SLICE_BYTES = 8 << 20
#: Entries and characters at which a worker's memo of encoded words is emptied.
MEMO_ENTRIES, MEMO_CHARS = 500_000, 12_000_000
#: Punctuation that the tokenizer keeps in one piece behind letters.
MARKS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"


class WordEncoder:
    """Ids of whole texts by a `tokenizers` file that never joins across a space and ends words by ``</w>``.

    Words are memoised in two generations, so that what was used since the last
    turnover survives the next one. New words of Latin letters and the marks
    behind them need no normalising but lower case and are cut at one place, so
    many of them go through the tokenizer's model in one call and are told apart
    by the word ends among their ids.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.chars = 0

    def _alone(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        young, old = self.young, self.old
        names, parts, ends = [], [], []
        for w in words:
            if w in old:
                young[w] = old[w]
                continue
            stem = w.rstrip(MARKS)
            if stem.isalpha() and (stem.isascii() or max(stem) < "\u0100"):
                names.append(w)
                parts.append(stem)
                if len(stem) < len(w):
                    parts.append(w[len(stem) :])
                    ends.append(2)
                else:
                    ends.append(1)
            else:
                young[w] = self._alone(w) if w else b""
        at = 0
        for k in range(0, len(names), 512):
            some, counts = names[k : k + 512], ends[k : k + 512]
            upto = at + sum(counts)
            joined = " ".join(parts[at:upto]).lower()
            at = upto
            ids = np.array(self.plain.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            places = np.flatnonzero(self.ends[ids]) + 1
            if len(places) == sum(counts):
                cuts = (4 * places[np.cumsum(counts) - 1]).tolist()
                raw = ids.tobytes()
                young.update(zip(some, [raw[a:b] for a, b in zip([0, *cuts], cuts)]))
            else:
                young.update((w, self._alone(w)) for w in some)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's begin and the last one's end.

        Arrow splits the texts and numbers their different words; only those are
        looked up, and their ids are laid out by their numbers.
        """
        if len(self.young) > MEMO_ENTRIES or self.chars > MEMO_CHARS:
            self.young, self.old, self.chars = {}, self.young, 0
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        number = coded.indices.to_numpy(zero_copy_only=False)
        bounds = np.r_[0, np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]
        young = self.young
        codes = list(map(young.get, words))
        if None in codes:
            pending = {w for w, c in zip(words, codes) if c is None}
            self.chars += sum(map(len, pending))
            self._learn(pending)
            codes = list(map(young.__getitem__, words))
        flat = np.frombuffer(b"".join(codes), "<u4")
        size = np.fromiter(map(len, codes), np.int64, len(codes)) >> 2
        start = np.cumsum(size) - size
        sizes = size[number]
        ends = np.cumsum(sizes)
        place = np.repeat(start[number] - ends + sizes, sizes)
        place += np.arange(len(place))
        return flat[place], np.r_[0, ends][bounds]


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Ranks on the Hilbert curve of integer ``points`` (rows, dimensions) below ``2**bits`` each.

    Skilling's transposition ("Programming the Hilbert curve", 2004), over whole columns.
    """
    x = points.astype(np.uint64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint64(q - 1)
        for i in range(n):
            high = (x[i] & np.uint64(q)) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low).astype(np.uint64)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & np.uint64(q)) != 0, np.uint64(q - 1), np.uint64(0))
        q >>= 1
    x ^= flip
    rank = np.zeros_like(flip)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            rank = (rank << np.uint64(1)) | ((x[i] >> np.uint64(bit)) & np.uint64(1))
    return rank.astype(np.int64)


def directions(ids: int, dimensions: int = DIMENSIONS, seed: int = 20) -> np.ndarray:
    """One fixed random direction for each token id."""
    return np.random.default_rng(seed).standard_normal((ids, dimensions)).astype(np.float32)


def curve_keys(ids: np.ndarray, bounds: np.ndarray, table: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Grid coordinates of each text: the direction of the mean of its words' directions. Texts without words are the middle."""
    out = np.full((len(bounds) - 1, table.shape[1]), 1 << (bits - 1), np.int64)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        sums = np.add.reduceat(table[ids], bounds[some], axis=0, dtype=np.float64)
        unit = sums / np.maximum(np.sqrt((sums**2).sum(axis=1)), 1e-12)[:, None]
        out[some] = np.minimum((1 << bits) - 1, ((1 << bits) * (1 + unit) / 2).astype(np.int64))
    return out


_encoders: dict[str, tuple[WordEncoder, np.ndarray]] = {}


def _encoded(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            encoder = WordEncoder(path)
            _encoders[path] = encoder, directions(encoder.tokenizer.get_vocab_size())
        encoder, table = _encoders[path]
        seen = 0
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:  # rows of some megabytes, one at least
                upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES)))
                part = batch.slice(at, upto - at)
                at = upto
                ids, bounds = encoder.encode(part.column(1))
                keys = hilbert_index(curve_keys(ids, bounds, table), BITS)
                stored = [_thin(np.append(ids[a:b], np.uint32(end_id))) for a, b in zip(bounds[:-1], bounds[1:])]
                number = np.arange(seen, seen + part.num_rows)
                seen += part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys), pa.array(np.diff(bounds) + 1), pa.array(number), pa.array(stored, pa.binary())], ["doc_id", "curve", "tokens", "number", "ids"])

    return run


def _thin(ids: np.ndarray) -> bytes:
    """Two bytes for each id where all fit, else four, after a byte that says which."""
    return b"\2" + ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else b"\4" + ids.tobytes()


def _wide(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, "<u2" if stored[0] == 2 else "<u4", offset=1).astype("<u4")


def _cut(sequence: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, used = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            for doc, stored in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                ids, start = _wide(stored.as_py()), 0
                while start < len(ids):
                    take = min(len(ids) - start, sequence - used)
                    piece = ids[start : start + take].tobytes()
                    for column, value in zip(rows, (doc, start, take, zlib.crc32(piece), len(ids), number, used, piece)):
                        column.append(value)
                    start, used = start + take, used + take
                    if used == sequence:
                        number, used = number + 1, 0
            arrays = [pa.array(c, pa.int64()) for c in rows[:7]] + ([pa.array(rows[7], pa.binary())] if with_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, [*PIECE, "ids"][: len(arrays)])

    return run


PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def ranges(coded: DataFrame, range_tokens: int = RANGE_TOKENS) -> tuple[Column, DataFrame, int]:
    """The number of each row's range, the rows it is a column of, and how many ranges there are.

    Bounds are quantiles by tokens of a bounded sample of the rows. Where one place
    on the curve spans several ranges, its rows are dealt to them in turn.
    """
    total, rows = coded.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    n = max(1, min(-(-(total or 0) // range_tokens), SAMPLE_ROWS // 16))
    some = coded.where(thinned(F.xxhash64("doc_id", "number"), rows, SAMPLE_ROWS)).select("curve", "tokens").collect() if n > 1 else []
    curve, tokens = np.array(sorted(map(tuple, some)), np.int64).reshape(-1, 2).T
    if not len(curve):
        return F.lit(0), coded, 1
    upto = np.cumsum(tokens)
    bounds = curve[np.searchsorted(upto, upto[-1] * np.arange(1, n) / n).clip(0, len(curve) - 1)]
    places, times = np.unique(bounds, return_counts=True)
    last = np.cumsum(times)
    cut = Bucketizer(splits=[-float("inf"), *map(float, places), float("inf")], inputCol="place", outputCol="cut")
    dealt = cut.transform(coded.withColumn("place", F.col("curve").cast("double")))
    at = F.col("cut").cast("int")
    number = F.element_at(F.lit([0, *last.tolist()]), at + 1)
    if (times > 1).any():
        shared = F.element_at(F.lit([1, *times.tolist()]), at + 1)
        tied = F.col("place") == F.element_at(F.lit([-1.0, *map(float, places)]), at + 1)
        number = number - F.when(tied, F.pmod("number", shared)).otherwise(0).cast("int")
    return number, dealt, int(last[-1]) + 1


def pack(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pack all ``docs`` into sequences of at most ``sequence`` tokens along the Hilbert curve.

    One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset`` (longs), and with ``with_ids`` the piece's ids as little-endian
    unsigned 32-bit integers. Null and empty texts are the lone ``end_id``; a long
    text is cut over as many sequences as it needs; equal texts and repeated rows
    are packed each, ties on the curve in doc_id order within a range; a null doc_id
    stays null. An empty table gives no pieces. Other columns are not read.
    ``sequence_id`` has the task's number in its upper bits.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    coded, _ = materialise(rows.mapInArrow(_encoded(tokenizer_path, end_id), "doc_id long, curve long, tokens long, number long, ids binary"))
    number, dealt, n = ranges(coded)
    schema = ", ".join(f"{c} long" for c in PIECE) + (", ids binary" if with_ids else "")
    return (
        dealt.select("doc_id", "curve", "ids", number.alias("range")).repartitionById(n, "range").sortWithinPartitions("range", "curve", "doc_id").mapInArrow(_cut(sequence, with_ids), schema)
    )
