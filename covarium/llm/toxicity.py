"""Toxicity by compression distance: dictionaries of toxic and of ordinary text, compared over windows.

A word (lower-cased, bare of punctuation) is written as eight-byte codes: one of
its first four letters, one of its first six and one of the whole, so that the
inflections of a stem share bytes and chance syllables do not. Zstandard gets two
dictionaries, one trained on windows of ordinary and one on windows of toxic
documents. A window's advantage is its compressed length with the ordinary
dictionary less that with the toxic one. Windows are short, since what repeats
within one costs nothing under either dictionary. A logistic curve, fitted to
advantages of documents that the dictionaries compared were not trained on, turns
a text's advantages into a calibrated score.

Zstandard's own trainer weighs every byte offset, so that most of what it picks
straddles two codes. The segments of a dictionary are therefore picked at the
bounds of codes, by the same rule: the most frequent of the class's windows, best
ones last. A code that one class has significantly more often stays out of the
other class's dictionary, where it would cancel; of codes that tell nothing both
have the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covarium.llm.common import text_or_empty, thinned
from covarium.llm.simhash import shingle_hashes

WINDOW = 8
LEVEL = 6
CODE = 8
#: Letters of the word starts that have codes beside the whole word.
STARTS = (4, 6)
#: Codes that both dictionaries have, and those that one has alone at most.
SHARED_CODES, TELLING_CODES = 1024, 2048
#: Chance that any one code counts as telling which is not.
LEVEL_OF_CHANCE = 0.01
#: Bounds of the learning sample: documents of each class and bytes of a document in it.
TOXIC_DOCS, ORDINARY_DOCS, DOC_BYTES = 3000, 6000, 16384
FOLDS, PARTS = 5, 5
MEMO_ENTRIES = 300_000
FEATURES = 5
EDGE = re.compile(r"^\W+|\W+$")


class Coder:
    """Texts as windows of word codes; codes are memoised, up to a bound."""

    def __init__(self) -> None:
        self.memo: dict[str, bytes] = {}

    def windows(self, text: str, window: int = WINDOW) -> tuple[int, list[bytes]]:
        """The number of words and the windows of all of them."""
        words = text.split()
        memo = self.memo
        if new := {w for w in words if w not in memo}:
            if len(memo) + len(new) > MEMO_ENTRIES:
                memo.clear()
                new = set(words)
            for w in new:
                memo[w] = word_codes(w)
        codes = list(map(memo.__getitem__, words))
        return len(words), [b"".join(codes[i : i + window]) for i in range(0, len(codes), window)]


def word_codes(word: str) -> bytes:
    """The codes of a word's starts and of the whole; none for punctuation."""
    bare = EDGE.sub("", word.lower())
    if not bare:
        return b""
    starts = [xxhash.xxh64_digest(bare[:k], k) for k in STARTS if len(bare) > k]
    return b"".join([*starts, xxhash.xxh64_digest(bare)])


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model, coder: Coder | None = None) -> None:
        self.coder, self.weights = coder or Coder(), np.array(model.weights)
        self.ordinary, self.toxic = _compressor(model.ordinary), _compressor(model.toxic)

    def advantages(self, windows: list[bytes]) -> np.ndarray:
        """Bytes that each window is shorter with the toxic dictionary than with the ordinary one."""
        ordinary, toxic = self.ordinary.compress, self.toxic.compress
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows], float)

    def features(self, text: str) -> np.ndarray:
        """Advantage by word and by the root of the words, of the best windows, of all that have one, and the length."""
        n, windows = self.coder.windows(text)
        if not n:
            return np.zeros(FEATURES)
        gain = self.advantages(windows)
        total = gain.sum()
        return np.array([total / n, total / n**0.5, np.sort(gain)[-3:].sum() / 10, np.log1p(gain[gain > 0].sum()), np.log(n)])

    def score(self, text: str) -> float:
        z = float(self.weights[0] + self.features(text) @ self.weights[1:])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(dictionary) >= CODE else None
    return zstandard.ZstdCompressor(dict_data=data, compression_params=params)


def _evidence(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
    """G of shares ``a / n`` against ``b / m``, with the sign of their difference."""

    def part(k: np.ndarray, total: float, rate: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(rate), 0) + np.where(total > k, (total - k) * np.log(1 - rate), 0)

    both = (a + b) / (n + m)
    g = 2 * (part(a, n, a / n) + part(b, m, b / m) - part(a, n, both) - part(b, m, both))
    return g * np.sign(a / n - b / m)


@dataclass(frozen=True)
class Counts:
    """Of some documents: how often each code occurs, and how many have it and have it twice."""

    docs: int
    codes: np.ndarray
    numbers: np.ndarray  # a row each: occurrences, documents, documents with two

    @staticmethod
    def of(docs: list[list[bytes]]) -> Counts:
        """``docs``: each document as its windows."""
        every = [np.frombuffer(b"".join(w), "<u8") for w in docs]
        if not sum(map(len, every)):
            return Counts(len(docs), np.empty(0, np.uint64), np.zeros((3, 0)))
        codes, number = np.unique(np.concatenate(every), return_inverse=True)
        doc = np.repeat(np.arange(len(every)), [len(e) for e in every])
        pairs, times = np.unique(doc * len(codes) + number, return_counts=True)
        of = pairs % len(codes)
        return Counts(len(docs), codes, np.stack([np.bincount(of, weights, len(codes)) for weights in (times, None, times > 1)]))

    @staticmethod
    def sum(some: list[Counts]) -> Counts:
        codes, number = np.unique(np.concatenate([c.codes for c in some]), return_inverse=True)
        numbers = np.concatenate([c.numbers for c in some], axis=1)
        return Counts(sum(c.docs for c in some), codes, np.stack([np.bincount(number, row, len(codes)) for row in numbers]))

    def at(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((3, len(codes)))
        out[:, np.searchsorted(codes, self.codes)] = self.numbers
        return out


def dictionaries(toxic: Counts, ordinary: Counts) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary of windows so counted.

    A code is telling if the shares of documents that have it, or that have it
    twice, differ by more than chance, all codes considered.
    """
    codes = np.union1d(toxic.codes, ordinary.codes)
    if not len(codes) or not toxic.docs or not ordinary.docs:
        return b"", b""
    bar = 2 * np.log(2 * len(codes) / LEVEL_OF_CHANCE)
    t, o = toxic.at(codes), ordinary.at(codes)
    once, twice = (_evidence(t[k], toxic.docs, o[k], ordinary.docs) for k in (1, 2))
    strongest = np.where(np.abs(once) >= np.abs(twice), once, twice)
    # each class's windows count as much as the other's
    by = np.lexsort((codes, -(t[0] / max(1, t[0].sum()) + o[0] / max(1, o[0].sum()))))
    plain = by[np.abs(strongest[by]) <= bar][:SHARED_CODES]
    telling = [by[sign * strongest[by] > bar][:TELLING_CODES] for sign in (-1, 1)]
    # what both have stands at equal distances from the end
    return tuple(codes[np.r_[own[::-1], plain[::-1]]].astype("<u8").tobytes() for own in telling)


def _curve(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton steps, on columns brought to one scale; the weights are those of ``x`` itself."""
    middle, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    x = np.c_[np.ones(len(x)), (x - middle) / scale]
    b = np.zeros(x.shape[1])
    keep = ridge * w.sum() * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (w * (y - p)) - keep @ b
        step = np.linalg.solve(x.T @ (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]) + keep + 1e-9 * np.eye(len(b)), grad)
        b += step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    slopes = b[1:] / scale
    return np.r_[b[0] - slopes @ middle, slopes]


def _apart(texts: list[str]) -> list[int]:
    """Places of the texts that aren't near copies of an earlier one: that don't share half of their eight smallest shingle hashes with others kept."""
    known: set[int] = set()
    out = []
    for i, text in enumerate(texts):
        least = np.unique(shingle_hashes(text.encode(), 5))[:8].tolist()
        if 2 * sum(h in known for h in least) < max(1, len(least)):
            out.append(i)
            known.update(least)
    return out


def train(rows: list[tuple[str, int]], share: float) -> Model:
    """Dictionaries of all labelled texts, and the curve of advantages that each had under dictionaries of the others.

    ``share`` is that of toxic labels; the classes are weighted to it. Without both
    classes in every part the score is that share for every text.
    """
    parts = [rows[k::PARTS] for k in range(PARTS)]
    if any(len({y for j, p in enumerate(parts) if j != k for _, y in p}) < 2 for k in range(PARTS)):
        return Model(b"", b"", (float(np.log(share / (1 - share))) if 0 < share < 1 else -10.0, *[0.0] * FEATURES))
    coder = Coder()
    # a window that a document repeats counts once
    counted = [[Counts.of([list(dict.fromkeys(coder.windows(text)[1])) for text, y in part if y == label]) for label in (1, 0)] for part in parts]

    def of(chosen: list[int]) -> tuple[bytes, bytes]:
        return dictionaries(*(Counts.sum([counted[k][side] for k in chosen]) for side in (0, 1)))

    x, y = [], []
    for k, part in enumerate(parts):
        scorer = Scorer(Model(*of([j for j in range(PARTS) if j != k]), (0.0,)), coder)
        x += [scorer.features(text) for text, _ in part]
        y += [label for _, label in part]
    x, y = np.array(x), np.array(y, float)
    w = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    return Model(*of(list(range(PARTS))), tuple(map(float, _curve(x, y, w))))


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def learn(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, ordinary_docs: int = ORDINARY_DOCS) -> Model:
    """Train on a bounded sample of the labelled documents that aren't held out.

    The sample is the first so many different texts of each class by a hash of
    doc_id, of those of at most ``DOC_BYTES``, near copies once. Labels without a
    document, a doc_id or a value are not used; a document of several labels is
    toxic if any says so. Classes are weighted by their numbers among all such
    labels. Without both classes the score is that share for every text.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text_or_empty()).alias("size"), F.xxhash64(text_or_empty()).alias("same")).join(known, "doc_id")
    # of copies one, by whatever label most of them have
    single = sized.where(F.col("size") <= DOC_BYTES).groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.avg("toxic").alias("toxic"))
    small = single.select("doc_id", (F.col("toxic") > 0.5).cast("int").alias("toxic"), F.xxhash64("doc_id").alias("h"))
    share = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [small.where((F.col("toxic") == k) & thinned(F.col("h"), share.get(k, 0), n)).orderBy("h", "doc_id").limit(n) for k, n in ((1, toxic_docs), (0, ordinary_docs))]
    chosen = picked[0].unionByName(picked[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).where(F.octet_length("text") <= DOC_BYTES)
    rows = sorted(((r["h"], r["doc_id"], r["toxic"], r["text"]) for r in texts.join(F.broadcast(chosen), "doc_id").collect()))
    total = sum(share.values())
    rate = (share.get(1, 0) + 0.5) / (total + 1) if total else 0.0
    return train([(rows[i][3], rows[i][2]) for i in _apart([r[3] for r in rows])], rate)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, from its whole text alone.

    Null and empty texts have the score of no advantage. Repeated rows and null
    doc_ids are scored as they are; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            scores = np.array([scorer.score(t.as_py()) for t in batch.column(2)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_ordinary(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose score is under a half, with all their columns.

    Null and empty texts have the score of no advantage and null doc_ids don't
    matter; repeated rows stay or go together; an empty table gives an empty one.
    """
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t.as_py() or "") < 0.5 for t in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
