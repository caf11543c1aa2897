"""Near-duplicate grouping by SimHash fingerprints and vantage-point trees.

A 64-bit fingerprint is a point of Hamming space. A vantage-point tree splits the
points by their distance to vantage points; those of the inner side whose distance
lies within the radius of the cut visit the outer side as well, so two points
within the radius meet in a leaf: the triangle bound rules out all others. Leaves
are the shards, each searched by a tree of its own.

Random fingerprints lie 32 +- 4 bits apart, so at radius 4 a split sends a third of
the points to both sides and a tree over all bits prunes little. Two fingerprints
within 4 bits differ by one bit at most in one of three parts of 21 or 22 bits, so
there are three trees, one over the distance in each part, at radius 1: a split
then sends a sixth to both sides.

A leaf that can't be split further is dealt to tasks as pairs of chunks. Every
search returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covarium.llm.common import fresh, join_counted, materialise, text_or_empty, thinned
from covarium.llm.components import connected_components

SEED = 42
LEAF = 256
#: Entries at which a worker's memo of hashed words is emptied.
WORD_MEMO = 300_000
#: Members that a leaf of the tree should have, and those of a task's chunk of a leaf that stays larger.
SHARD, CHUNK = 2048, 16384
#: Fingerprints from which the tree is built (about; twice as many at most), parts of a fingerprint that have a tree each, and levels.
SAMPLE, PARTS, DEPTH = 1 << 16, 3, 18


def shingle_hashes(text: bytes, width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every ``width``-word shingle of ``text`` with A-Z lower-cased.

    ``bytes.split`` and ``bytes.lower`` know only the ASCII white space and
    letters of the contract. Fewer words than ``width`` make one shingle, no
    words none.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    of = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([of(joined, seed)], np.uint64)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends[: len(words) - width])]
    return np.array([of(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :])], np.uint64)


class _WordHashes(dict):
    """XXH64 of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return value


_word_hashes = _WordHashes()
#: Fixed odd multipliers, one for each word of a shingle.
PLACES = np.random.default_rng(64).integers(0, 1 << 63, 32).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(z: np.ndarray) -> np.ndarray:
    """SplitMix64's finish, on unsigned longs."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingles(text: bytes, width: int) -> np.ndarray:
    """Hashes of the same shingles as ``shingle_hashes`` has, made of the hashes of their words: for use where the kind of hash is free."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))
    out = np.zeros(max(1, len(h) - width + 1), np.uint64)
    for k in range(min(width, len(h))):
        out += h[k : k + len(out)] * PLACES[k]
    return mixed(out + np.uint64(min(width, len(h))))


def fingerprint(text: bytes, width: int = 4, seed: int = SEED) -> int:
    """The SimHash: bit i is set if it is in over half of the shingle hashes; zero for no words."""
    h = shingle_hashes(text, width, seed)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = h[k : k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view(np.uint64)[0])


def _apart(x: np.ndarray, a: np.ndarray, v) -> np.ndarray:
    """Hamming distances of the rows ``a`` to the row ``v``; a row is one 64-bit word or several."""
    d = np.bitwise_count(x[a] ^ x[v]).astype(np.int64)
    return d if x.ndim == 1 else d.sum(axis=1)


def _grid(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if x.ndim == 1:
        return np.bitwise_count(x[a][:, None] ^ x[b][None, :])
    out = np.zeros((len(a), len(b)), np.uint16)
    for k in range(x.shape[1]):
        out += np.bitwise_count(x[a, k][:, None] ^ x[b, k][None, :])
    return out


class _Forest:
    """Union-find that remembers the links that joined two trees."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.parent[b] = a
            self.links.append((i, j))


def _compare(x: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, forest: _Forest) -> None:
    """Link what lies within ``radius``, in blocks of bounded size; pairs of one tree are skipped."""
    step = max(1, (1 << 18) // max(1, len(b)))
    for k in range(0, len(a), step):
        rows = a[k : k + step]
        near = _grid(x, rows, b) <= radius
        near &= rows[:, None] != b[None, :]
        if near.any():
            ra = np.array([forest.find(i) for i in rows.tolist()])
            rb = np.array([forest.find(i) for i in b.tolist()])
            i, j = np.nonzero(near & (ra[:, None] != rb[None, :]))
            if len(i):
                # one witness for each pair of trees
                _, first = np.unique(ra[i] * np.int64(len(x)) + rb[j], return_index=True)
                for r, c in zip(rows[i[first]].tolist(), b[j[first]].tolist()):
                    forest.join(r, c)


def vantage_links(x: np.ndarray, radius: int = 4, leaf: int = LEAF) -> list[tuple[int, int]]:
    """A spanning forest of the graph that links entries of ``x`` differing in at most ``radius`` bits.

    Self nodes split their members by the distance to a vantage point; what lies
    within ``radius`` of it is linked to it at once. Cross nodes hold the two sides
    of a boundary, whose distances to the vantage point differ by at most
    ``radius``: the triangle bound rules out every other pair.
    """
    forest = _Forest(len(x))
    todo: list[tuple[np.ndarray, np.ndarray | None]] = [(np.arange(len(x)), None)]
    while todo:
        a, b = todo.pop()
        if b is None:
            if len(a) <= leaf:
                _compare(x, a, a, radius, forest)
                continue
            v = a[len(a) // 2]
            d = _apart(x, a, v)
            ball, rest, dr = a[(d <= radius) & (a != v)], a[d > radius], d[d > radius]
            for i in ball.tolist():
                forest.join(int(v), i)
            if not len(rest):
                continue
            todo.append((ball, rest[dr <= 2 * radius]))
            cut = np.median(dr)
            inner, outer = dr <= cut, dr > cut
            todo += [(rest[inner], None), (rest[outer], None), (rest[inner & (dr > cut - radius)], rest[outer & (dr <= cut + radius)])]
        elif len(a) and len(b):
            if len(a) * len(b) <= 4 * leaf * leaf:
                _compare(x, a, b, radius, forest)
                continue
            big = a if len(a) >= len(b) else b
            v = big[len(big) // 2]
            da, db = _apart(x, a, v), _apart(x, b, v)
            cut = np.median(da if big is a else db)
            if (da <= cut).all() and (db <= cut).all():
                _compare(x, a, b, radius, forest)
                continue
            for sa, sb in (
                (da <= cut, db <= cut),
                (da > cut, db > cut),
                ((da <= cut) & (da > cut - radius), (db > cut) & (db <= cut + radius)),
                ((da > cut) & (da <= cut + radius), (db <= cut) & (db > cut - radius)),
            ):
                todo.append((a[sa], b[sb]))
    return forest.links


def _signatures(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py().encode(), width, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return run


def signatures(docs: DataFrame, width: int = 4, seed: int = SEED) -> DataFrame:
    """``(doc_id, fp)`` of every row; null text counts as empty. ``fp`` is the fingerprint as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(_signatures(width, seed), "doc_id long, fp long")


def _runs(radius: int):
    """Search each run of rows with one cell key; the rows come sorted by it."""

    def flush(node: list[np.ndarray], fp: list[np.ndarray]) -> pa.RecordBatch | None:
        x, ids = np.concatenate(fp), np.concatenate(node)
        if len(x) < 2:
            return None
        links = vantage_links(x, radius)
        if not links:
            return None
        ends = np.array(links)
        return pa.RecordBatch.from_arrays([pa.array(ids[ends[:, 0]]), pa.array(ids[ends[:, 1]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, node, fp = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            if pa.types.is_integer(batch.column(2).type):
                x = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            else:
                x = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8").reshape(len(ids), -1)
            cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            for a, b in zip(cuts, cuts[1:]):
                if node and cell[a] != last:
                    if (out := flush(node, fp)) is not None:
                        yield out
                    node, fp = [], []
                last = cell[a]
                node.append(ids[a:b])
                fp.append(x[a:b])
        if node and (out := flush(node, fp)) is not None:
            yield out

    return run


class VantageTree:
    """A tree over the distance in the bits of ``mask``, to deal points to leaves.

    ``sample`` is a sample of all ``total`` points; the expected size of a node is
    its share. A node is split by the vantage point and cut, of a few tried, that
    leave least to compare; where the sample has run out, by a random point at
    half of the bits. A leaf of more than ``chunk`` expected points is as many
    cells as its chunks have pairs.
    """

    def __init__(self, sample: np.ndarray, total: int, mask: int, radius: int, shard: int = SHARD, chunk: int = CHUNK, seed: int = SEED) -> None:
        self.mask, self.radius = np.uint64(mask), radius
        self.chunk = chunk
        rng = np.random.default_rng(seed)
        each = total / max(1, len(sample))
        point, cut, inner, outer, chunks = [], [], [], [], []
        todo = [(sample & self.mask, float(total), 0, -1, False)]
        while todo:
            p, size, depth, parent, is_outer = todo.pop()
            here = len(point)
            if parent >= 0:
                (outer if is_outer else inner)[parent] = here
            best = None
            if size > shard and depth < DEPTH:
                best = self._split(p, rng)
            point.append(best[0] if best else np.uint64(0))
            cut.append(best[1] if best else -1)
            inner.append(-1)
            outer.append(-1)
            chunks.append(1 if best else max(1, -(-int(size) // chunk)))
            if best:
                d = np.bitwise_count(p ^ best[0])
                a, b = p[d <= best[1]], p[d > best[1] - radius]
                sizes = (len(a) * each, len(b) * each) if len(p) >= 16 else (size * 0.6, size * 0.6)
                todo += [(a, sizes[0], depth + 1, here, False), (b, sizes[1], depth + 1, here, True)]
        self.point, self.cut = np.array(point, np.uint64), np.array(cut, np.int64)
        self.inner, self.outer = np.array(inner, np.int64), np.array(outer, np.int64)
        self.chunks = np.array(chunks, np.int64)
        cells = self.chunks * (self.chunks + 1) // 2
        self.first = np.cumsum(cells) - cells
        self.cells = int(cells.sum())

    def _split(self, p: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
        bits = int(self.mask).bit_count()
        if len(p) < 16:
            return np.uint64(rng.integers(0, 1 << 63)) & self.mask, bits // 2
        best, least = None, 0.9 * len(p) ** 2
        for v in p[rng.integers(0, len(p), 4)]:
            upto = np.cumsum(np.bincount(np.bitwise_count(p ^ v).astype(np.int64), minlength=bits + 1))
            inside = upto[:-1]
            visited = len(p) - np.r_[np.zeros(self.radius, np.int64), upto][: len(inside)]
            cost = np.where((inside > 0) & (visited > 0), inside.astype(float) ** 2 + visited.astype(float) ** 2, np.inf)
            if cost.min() < least:
                best, least = (v, int(cost.argmin())), cost.min()
        return best

    def deal(self, x: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cells: each row in every cell in which it may meet a point within the radius. ``salt`` picks chunks."""
        p = x & self.mask
        rows, at = np.arange(len(p)), np.zeros(len(p), np.int64)
        out = []
        while len(rows):
            ends = self.cut[at] < 0
            out += self._cells(rows[ends], at[ends], salt)
            rows, at = rows[~ends], at[~ends]
            d = np.bitwise_count(p[rows] ^ self.point[at]).astype(np.int64)
            inside, outside = d <= self.cut[at], d > self.cut[at] - self.radius
            rows, at = np.r_[rows[inside], rows[outside]], np.r_[self.inner[at[inside]], self.outer[at[outside]]]
        return np.concatenate([r for r, _ in out]), np.concatenate([c for _, c in out])

    def _cells(self, rows: np.ndarray, leaf: np.ndarray, salt: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        whole = self.chunks[leaf] == 1
        out = [(rows[whole], self.first[leaf[whole]])]
        for k in np.unique(leaf[~whole]).tolist():
            mine, n = rows[leaf == k], int(self.chunks[k])
            own = (salt[mine] % np.uint64(n)).astype(np.int64)
            for other in range(n):  # two chunks meet in one cell, in which all of both is compared
                met = own != other
                low, high = np.minimum(own[met], other), np.maximum(own[met], other)
                out.append((mine[met], self.first[k] + high * (high + 1) // 2 + low))
        return out


def _masks(parts: int) -> list[int]:
    cuts = [64 * k // parts for k in range(parts + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]


def plant(sample: np.ndarray, total: int, radius: int, shard: int = SHARD, chunk: int = CHUNK) -> list[VantageTree]:
    """The trees: one over all bits of few points, else one for each part, in one of which the radius is a share of the whole."""
    parts = 1 if total <= shard else min(PARTS, radius + 1)
    return [VantageTree(sample, total, mask, radius // parts, shard, chunk) for mask in _masks(parts)]


def _dealt(trees: list[VantageTree]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, x = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            x = x.view(np.uint64)
            salt = (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
            base = 0
            for tree in trees:
                rows, cell = tree.deal(x, salt)
                yield pa.RecordBatch.from_arrays([pa.array(base + cell), pa.array(node[rows]), pa.array(x[rows].view(np.int64))], ["cell", "node", "fp"])
                base += tree.cells

    return run


def links(prints: DataFrame, radius: int = 4, shard: int = SHARD, chunk: int = CHUNK) -> DataFrame:
    """``(a, b)``: node pairs that connect all of ``prints (node, fp)`` with differing bits at most ``radius``.

    The trees are built from a bounded sample; every fingerprint is dealt to their leaves.
    """
    total = prints.count()
    sample = [r["fp"] for r in prints.where(thinned(F.xxhash64("fp"), total, SAMPLE)).select("fp").collect()]
    trees = plant(np.array(sorted(sample), np.int64).view(np.uint64), total, radius, shard, chunk)
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = prints.select("node", "fp").mapInArrow(_dealt(trees), "cell long, node long, fp long")
    return cells.repartition(n, "cell").sortWithinPartitions("cell", "fp").mapInArrow(_runs(radius), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, seed: int = SEED) -> DataFrame:
    """Group documents whose fingerprints are connected by steps of at most ``radius`` bits.

    Returns ``(doc_id, fingerprint, component_id)``, one row per input row:
    ``fingerprint`` as 16 lower-case hex digits and ``component_id`` the smallest
    doc_id reachable. Null and blank texts have the fingerprint zero and are
    linked by it. Repeated rows are grouped with each other; rows with a null
    doc_id keep their fingerprint and take part through their copies only. An
    empty table gives an empty table; other columns are not read.
    """
    signed, _ = materialise(signatures(docs, width, seed))
    prints, _ = materialise(signed.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")))
    known = prints.where("node is not null")
    parts = connected_components(links(known, radius))
    classes = known.join(parts, F.col("node") == F.col("vertex"), "left").select("fp", F.coalesce("component", "node").alias("component_id"), "n")
    return join_counted(signed, classes, "fp", signed.count(), "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Words of 64 bits of a wide fingerprint, shingle hashes that are its keys, least similarity, and standard deviations of bits allowed over its mean.
WIDE_WORDS, KEYS, SIMILARITY, SLACK = 4, 8, 0.8, 1.0


def wide_fingerprint(hashes: np.ndarray, words: int = WIDE_WORDS) -> np.ndarray:
    """A SimHash of 64 bits a word, each word's bits from another mixing of the shingle hashes (SplitMix64)."""
    out = np.zeros(words, np.uint64)
    if not len(hashes):
        return out
    for w in range(words):
        ones = np.zeros(64, np.int64)
        for k in range(0, len(hashes), 1 << 16):
            z = mixed(hashes[k : k + (1 << 16)] + np.uint64(0x9E3779B97F4A7C15 * (w + 1) & (1 << 64) - 1))
            ones += np.unpackbits(z.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def wide_radius(similarity: float, words: int = WIDE_WORDS) -> int:
    """Bits by which fingerprints of texts of such a cosine similarity differ, and ``SLACK`` standard deviations.

    SimHash tells the angle between the shingle vectors of two texts (Charikar,
    2002): a bit differs with a chance of the angle's share of a half turn.
    """
    share = np.arccos(similarity) / np.pi
    bits = 64 * words
    return int(round(bits * share + SLACK * (bits * share * (1 - share)) ** 0.5))


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints, keys = [], []
        for t in batch.column(2):
            h = np.unique(shingles(t.as_py().encode(), 5))  # likeness is one of sets
            prints.append(wide_fingerprint(h).tobytes())
            keys.append(h[:KEYS].view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "same", "fp", "keys"])


def _grouped(docs: DataFrame, similarity: float, chunk: int) -> DataFrame:
    """``(doc_id, same, component)`` of every row: ``same`` is a hash of the text, the component the least ``(doc_id, same)`` reachable."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("same"), text_or_empty().alias("text"))
    signed, _ = materialise(rows.mapInArrow(_wide, "doc_id long, same long, fp binary, keys array<long>"))
    # texts of one fingerprint are linked whatever their keys; of each set of keys one text is searched
    name = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "same"))
    kinds = signed.groupBy("fp", "keys").agg(F.min(name).alias("name"), F.count(F.lit(1)).alias("n")).where("name is not null")
    kinds, _ = materialise(kinds.withColumn("node", F.monotonically_increasing_id()))
    searched = kinds.count()
    dealt = kinds.select("node", "fp", F.explode("keys").alias("key"))
    crowds = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk)
    crowds, _ = materialise(crowds.withColumn("chunks", F.ceil(F.col("n") / chunk).cast("long")))
    # members of a crowd are dealt to the pairs of its chunks
    own, other = F.pmod(F.col("node"), F.col("chunks")), F.col("other")
    met = join_counted(dealt, crowds, "key", KEYS * searched, "left").withColumn("other", F.explode(F.expr("if(chunks is null, array(-1L), sequence(0L, chunks - 1))")))
    shards = met.where((other < 0) | (own != other)).select(F.xxhash64("key", F.least(own, other), F.greatest(own, other)).alias("cell"), "node", "fp")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = shards.repartition(n, "cell").sortWithinPartitions("cell", "fp").mapInArrow(_runs(wide_radius(similarity)), "a long, b long")
    equal = kinds.groupBy("fp").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    same = kinds.join(equal, "fp").select(F.col("node").alias("a"), "b")
    parts = connected_components(found.unionByName(same))
    joined = kinds.join(parts, F.col("node") == F.col("vertex"), "left").select("fp", "keys", "n", "name", F.coalesce("component", "node").alias("part"))
    least = joined.groupBy("part").agg(F.min("name").alias("component"), F.count(F.lit(1)).alias("n"))
    classes = join_counted(joined.withColumnRenamed("n", "rows"), least, "part", searched).select("fp", "keys", "component", F.col("rows").alias("n"))
    # a row without a doc_id whose text no other row has is in no class
    return join_counted(signed, classes, ["fp", "keys"], signed.count(), "left").select("doc_id", "same", "component")


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """``(doc_id, component_id)``: groups of documents whose SimHash similarity in five-word shingles is ``similarity`` or more.

    At such similarity 64 bits are too few: the distances of like and unlike texts
    overlap in what a search can reach. So fingerprints of 256 bits are compared,
    which lie 128 +- 8 bits apart for unlike texts and within 59 for a cosine
    similarity of 0.8, one standard deviation included. No tree prunes at such a
    radius, so the shards that vantage-point trees search are of documents that
    share one of their eight smallest shingle hashes; texts of that similarity
    share none with a chance of two in ten thousand. A shingle of very many
    documents is searched as pairs of chunks. Rows, nulls and ties are taken as by
    ``near_duplicates``.
    """
    return _grouped(docs, similarity, chunk).select("doc_id", F.col("component.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents that stay: of each group of near copies the one with the smallest doc_id, with all columns of ``docs``.

    Rows with a null doc_id can't be told apart and stay. Rows that repeat doc_id
    and text stay once; of a doc_id with several texts each is judged by itself,
    and of two in one group the smaller hash of its text stays. An empty table
    gives an empty one.
    """
    same, kept_id, kept_same = fresh(docs, "same"), fresh(docs, "kept_id"), fresh(docs, "kept_same")
    kept = _grouped(docs, similarity, CHUNK).where((F.col("doc_id") == F.col("component.doc_id")) & (F.col("same") == F.col("component.same"))).select(F.col("doc_id").alias(kept_id), F.col("same").alias(kept_same)).distinct()
    marked = docs.withColumn(same, F.xxhash64(text_or_empty()))
    known = marked.join(kept, (marked["doc_id"].cast("long") == kept[kept_id]) & (marked[same] == kept[kept_same]), "left_semi").dropDuplicates(["doc_id", same])
    return known.drop(same).unionByName(docs.where(F.col("doc_id").isNull()))
