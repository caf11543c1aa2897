"""The text operators against brute force on small whole fixtures."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash

from covarium.llm import bpe, packing, quality, sharding, simhash, sketches

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, node long, h long, bucket int, part int, ids string, size string"
BASE = "The quick brown fox jumps over the lazy dog while seven wizards mix potions under a violet moon and sing to the quiet river stones"


def rows():
    texts = [
        BASE,
        BASE,
        BASE + " today",
        "",
        None,
        " \n\t ",
        "one",
        "two words",
        "a  b \n c\td",
        "Größe ÆØÅ 東京 and İstanbul Σίσυφος don't DON'T it'll 123 4567 á  x y",
        "x" * 5000,
        " ".join(f"w{i % 97}" for i in range(6000)),
        "same line\nsame line\n\n \nother line\nsame line",
        " leading and trailing ",
        "<|endoftext|> ordinary <|startoftext|> text",
        "#$ % & | <> ** ##",
    ]
    out = [(i, t, "en" if i % 2 else None, "s", 1, 7, 7, 7, 7, 7, "x", "y") for i, t in enumerate(texts)]
    return [*out, out[0], (None, "no id here at all", "en", None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


# packing


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("which", ["edge", "real"])
def test_pack(spark, docs, which):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    marked = spark.createDataFrame([(900, "a <|endoftext|> b"), (901, "x<|startoftext|>y's <|EndOfText|>")], "doc_id long, text string")
    frame = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(marked, allowMissingColumns=True) if which == "edge" else real(spark)
    want = {r.doc_id: ids_of(tokenizer, r.text) for r in frame.collect()}
    pieces = packing.pack(frame, path, with_ids=True).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
        assert p.ids_crc32 == zlib.crc32(bytes(p.ids)) and p.doc_tokens == len(want[p.doc_id]) and 4 * p.length == len(p.ids)
    assert by_doc.keys() == want.keys()
    for doc, own in by_doc.items():
        got = b"".join(bytes(p.ids) for p in sorted(own, key=lambda p: p.start))
        assert got == struct.pack(f"<{len(want[doc])}I", *want[doc])
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
    total = sum(map(len, want.values()))
    assert 4096 * len(by_seq) - total < 4096


def test_curve_keys_tell_direction_not_length():
    table = packing.directions(500)
    rng = np.random.default_rng(3)
    one = rng.integers(0, 500, 80)
    ids, bounds = np.r_[one, np.tile(one, 40)], np.array([0, 80, 80 + 3200])
    assert (np.diff(packing.curve_keys(ids, bounds, table), axis=0) == 0).all()
    many = [rng.integers(0, 500, 5000) for _ in range(50)]
    keys = packing.curve_keys(np.concatenate(many), np.arange(51) * 5000, table)
    assert ((keys > 0) & (keys < 1023)).all(axis=1).mean() > 0.9
    assert packing.curve_keys(ids[:0], np.array([0, 0]), table).tolist() == [[512] * 4]


def test_ranges_hold_equal_tokens(spark):
    """Rows of very different lengths, and a third of all at one place."""
    rng = np.random.default_rng(6)
    rows = [(i, int(rng.integers(0, 1 << 40)) if i % 3 else 12345, int(rng.integers(1, 30) ** 3), i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, curve long, tokens long, number long")
    total = sum(r[2] for r in rows)
    number, dealt, n = packing.ranges(frame, total // 40)
    assert 40 <= n <= 42
    got = dealt.select("curve", "tokens", number.alias("range")).collect()
    sizes = np.bincount([r.range for r in got], [r.tokens for r in got], n)
    assert sizes.max() < 2.5 * total / n
    upper, lower = defaultdict(int), defaultdict(lambda: 1 << 60)
    for r in got:
        upper[r.range], lower[r.range] = max(upper[r.range], r.curve), min(lower[r.range], r.curve)
    assert all(upper[k] <= lower[k + 1] for k in range(n - 1))


def test_pack_empty(empty, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.pack(empty, path).count() == 0
    assert packing.pack(docs, path).where("start = 0").count() == docs.count()


def test_hilbert_steps_are_unit():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    rank = packing.hilbert_index(grid, 3)
    assert sorted(rank.tolist()) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(rank)], axis=0)).sum(axis=1) == 1).all()


# SimHash


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints, radius=4):
    ids = list(prints)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if label[a] != label[b] and (prints[a] ^ prints[b]).bit_count() <= radius:
                    low = min(label[a], label[b])
                    label[a] = label[b] = low
                    changed = True
    return label


@pytest.mark.parametrize(("shard", "chunk"), [(simhash.SHARD, simhash.CHUNK), (8, simhash.CHUNK), (2, 3)])
def test_near_duplicates(spark, docs, shard, chunk, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (4, shard, chunk))
    frame = docs.unionByName(real(spark).limit(150).selectExpr("doc_id + 100 as doc_id", "text", "lang", "source", "n_chars"), allowMissingColumns=True)
    got = simhash.near_duplicates(frame).collect()
    assert len(got) == frame.count()
    prints = {r.doc_id: brute_fingerprint(r.text) for r in frame.where("doc_id is not null").collect()}
    label = brute_components(prints)
    for r in got:
        if r.doc_id is not None:
            assert (int(r.fingerprint, 16), r.component_id) == (prints[r.doc_id], label[r.doc_id])
    assert label[1] == 0 and label[4] == 3


def test_near_duplicates_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0


def test_keep_one(docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({r.component_id for r in simhash.near_copies(docs).collect() if r.doc_id is not None})


@pytest.mark.parametrize("limit", [simhash.CHUNK, 3])
def test_near_copies(spark, limit):
    rng = np.random.default_rng(21)
    prose = lambda n: [f"t{w}" for w in rng.integers(0, 3000, n)]
    texts, group = {}, {}
    for g in range(30):
        base = prose(int(rng.integers(60, 400)))
        for copy in range(int(rng.integers(1, 6))):
            words = list(base)
            for at in rng.choice(len(words), int(0.012 * len(words)) if copy else 0, replace=False):
                words[at] = "edited"
            texts[len(texts)] = " ".join(words)
            group[len(texts) - 1] = g
    extra = {1000: "", 1001: None, 1002: " ", 1003: "short text"}
    frame = spark.createDataFrame([*texts.items(), *extra.items(), (0, texts[0]), (None, texts[0])], "doc_id long, text string")
    got = simhash.near_copies(frame, chunk=limit).collect()
    assert len(got) == frame.count()
    label = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    first = {}
    for i, g in group.items():
        first.setdefault(g, i)
    prints = {i: simhash.wide_fingerprint(np.unique(simhash.shingles(t.encode(), 5))) for i, t in texts.items()}
    for i, g in group.items():
        if np.bitwise_count(prints[i] ^ prints[first[g]]).sum() <= simhash.wide_radius(0.8):
            assert label[i] == first[g]
        assert group[label[i]] == g
    assert label[1000] == label[1001] == label[1002] == 1000 and label[1003] == 1003
    assert simhash.near_copies(frame.limit(0)).count() == 0


def test_wide_keys_of_repeated_lines():
    """A text whose smallest shingle hashes stand in a line it repeats has the keys and bits of its set of shingles."""
    import pyarrow as pa

    words = [f"w{k}" for k in range(400)]
    lines = [" ".join(words[k : k + 5]) for k in range(0, 400, 5)]
    line = min(lines, key=lambda x: simhash.shingles(x.encode(), 5)[0])
    text = " ".join([*words, *[line] * 200])
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0]), pa.array([text])], ["doc_id", "same", "text"])
    (out,) = simhash._wide(iter([batch]))
    distinct = np.unique(simhash.shingles(text.encode(), 5))
    assert out.column(3).to_pylist() == [distinct[: simhash.KEYS].view(np.int64).tolist()]
    assert out.column(2).to_pylist() == [simhash.wide_fingerprint(distinct).tobytes()]


def test_doc_id_of_several_texts(spark):
    rng = np.random.default_rng(4)
    a, b = (" ".join(f"t{w}" for w in rng.integers(0, 900, 200)) for _ in range(2))
    rows = [(1, a, "x"), (1, b, "y"), (1, b, "z"), (2, b + " more", "u"), (3, a + " more", "v"), (None, a, "n"), (None, "alone", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, same string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text) for r in kept.collect())
    assert got == sorted([(1, a), (1, b), (0, a), (0, "alone")])
    one_fingerprint = simhash.near_copies(spark.createDataFrame([(i, "same words here again and again") for i in range(5)], "doc_id long, text string"))
    assert {r.component_id for r in one_fingerprint.collect()} == {0}


def test_recall_of_similar_texts(spark):
    """Pairs of a cosine similarity of 0.8 and more in sets of five-word shingles, by brute force over real rows."""
    rows = real(spark).where("doc_id < 400").collect()
    sets = {r.doc_id: frozenset(np.unique(simhash.shingle_hashes((r.text or "").encode(), 5)).tolist()) for r in rows}
    frame = spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string")
    label = {r.doc_id: r.component_id for r in simhash.near_copies(frame).collect()}
    alike = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * (len(sets[a]) * len(sets[b])) ** 0.5 > 0]
    assert len(alike) > 5
    assert sum(label[a] == label[b] for a, b in alike) >= 0.9 * len(alike)


def test_trees_prune_and_lose_nothing():
    """Every pair within the radius meets in a cell of one tree; the triangle bound rules out nearly all others."""
    rng = np.random.default_rng(9)
    x = rng.integers(0, 1 << 63, 30_000).astype(np.uint64)
    near = x[:300] ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)) for _ in range(300)], np.uint64)
    points = np.r_[x, near]
    trees = simhash.plant(points[::3], len(points), 4, shard=256)
    compared, met = 0, np.zeros(300, bool)
    for tree in trees:
        rows, cell = tree.deal(points, points)
        assert tree.radius == 1 and len(set(rows.tolist())) == len(points)
        compared += int((np.bincount(cell).astype(float) ** 2 / 2).sum())
        cells = defaultdict(set)
        for r, c in zip(rows.tolist(), cell.tolist()):
            cells[r].add(c)
        met |= np.array([bool(cells[k] & cells[len(x) + k]) for k in range(300)])
    assert met.all()
    assert compared < 0.1 * len(points) ** 2 / 2


def test_wide_fingerprints_tell_likeness():
    assert simhash.wide_radius(0.8) == 59
    rng = np.random.default_rng(22)
    x = rng.integers(0, 2**63, 4000).astype(np.uint64)
    for share, near in ((0.9, 30), (0.8, 39), (0.5, 68), (0.0, 128)):
        n = 1000
        m = int(2 * share * n / (1 + share))
        a, b = x[:n], np.r_[x[:m], x[2000 : 2000 + n - m]]
        d = int(np.bitwise_count(simhash.wide_fingerprint(a) ^ simhash.wide_fingerprint(b)).sum())
        assert abs(d - near) < 30


@pytest.mark.parametrize("seed", range(4))
def test_vantage_links_connect_all(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 12).astype(np.uint64)
    near = [int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for c in centres for _ in range(60)]
    x = np.array([*near, *rng.integers(0, 2**63, 500).tolist()], np.uint64)
    parent = simhash._Forest(len(x))
    for i, j in simhash.vantage_links(x, 4, 16):
        assert int(x[i] ^ x[j]).bit_count() <= 4
        parent.join(i, j)
    close = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
    for i, j in zip(*np.nonzero(close)):
        assert parent.find(int(i)) == parent.find(int(j))


# quality


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("bits", [quality.POSITION_BITS, 3])
def test_quality_counts(spark, docs, bits, monkeypatch):
    monkeypatch.setattr(quality, "POSITION_BITS", bits)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    for frame in (docs, real(spark)):
        texts = {r.doc_id: r.text for r in frame.collect()}
        got = quality.judge(frame, labels).collect()
        assert len(got) == frame.count()
        for r in got:
            n, chars, symbols, lines, repeats = brute_counts(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
            assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
            assert not (r.kept and r.base_failed)


def test_quality_empty_and_columns(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge(empty, labels).count() == 0
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.judge(docs, labels).where("kept").collect()}


def test_binomial_tail(spark):
    from math import comb

    from pyspark.sql import functions as F

    cases = [(0, 10), (3, 400), (7, 900), (0, 0), (40, 300), (5, 5000)]
    frame = spark.createDataFrame(cases, "k long, n long").withColumn("p", quality.binomial_tail(F.col("k"), F.col("n"), 0.02))
    for r in frame.collect():
        exact = sum(comb(r.n, j) * 0.02**j * 0.98 ** (r.n - j) for j in range(r.k + 1)) if r.k < 0.02 * r.n else 1.0
        assert r.p == pytest.approx(exact, rel=1e-8)


def test_cutoffs_are_certified(spark):
    rng = np.random.default_rng(1)
    n = 4000
    good = rng.random(n) < 0.8
    symbols = np.where(good, rng.integers(0, 5, n), rng.integers(0, 60, n))
    counted = spark.createDataFrame([(i, "en", 200, 300, int(s), 10, 0, 0) for i, s in enumerate(symbols)], "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")
    labels = spark.createDataFrame([(i, int(g), 0) for i, g in enumerate(good)], "doc_id long, quality int, toxic int")
    chosen = {r.rule: r for r in quality.certified_cutoffs(counted, labels).collect()}
    assert set(chosen) == {"symbols"}
    assert chosen["symbols"].k_good <= 0.0125 * chosen["symbols"].n_good and chosen["symbols"].k_bad > 400


# sharding


def test_shuffle(spark, docs, empty):
    for frame in (docs, real(spark)):
        out = sharding.external_shuffle(frame, bucket_bytes=20_000).collect()
        assert Counter((r.record.doc_id, r.record.text) for r in out) == Counter((r.doc_id, r.text) for r in frame.collect())
        slots = defaultdict(list)
        for r in out:
            slots[r.shard].append(r.slot)
            assert r.size == len((r.record.text or "").encode()) + 8
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(map(len, slots.values())) - min(len(slots[k]) for k in range(min(24, len(out)))) <= 1
    again = sharding.external_shuffle(real(spark), bucket_bytes=20_000).selectExpr("record.doc_id", "shard", "slot")
    assert sorted(again.collect()) == sorted((r.record.doc_id, r.shard, r.slot) for r in out)
    assert sharding.external_shuffle(empty).count() == 0


def fisher_yates(n, seed):
    """Places of the shuffled, inside out: draws of a Mersenne twister seeded with the halves of a long."""
    bits = np.random.RandomState([seed >> 32 & 0xFFFFFFFF, seed & 0xFFFFFFFF])
    draw = lambda: int(bits.randint(0, 1 << 32, dtype=np.uint32)) >> 1

    def below(k):
        if k & -k == k:
            return k * draw() >> 31
        while True:
            x = draw()
            if x - x % k + k - 1 < 1 << 31:
                return x % k

    at = []
    for i in range(n):
        j = below(i + 1)
        at.append(at[j] if j < i else i)
        at[j] = i
    return at


def test_shuffle_against_a_plain_model(spark):
    """Buckets by hash, a Fisher-Yates permutation of each and slots in turn."""
    from pyspark.sql import functions as F

    frame = real(spark)
    hashed = frame.select("doc_id", F.xxhash64(F.lit(7), *frame.columns).alias("h"), (F.octet_length(F.coalesce("text", F.lit(""))) + 8).alias("size")).collect()
    n = -(-sum(r.size for r in hashed) // 20_000)
    buckets = defaultdict(list)
    for r in sorted(hashed, key=lambda r: r.h):
        buckets[r.h % n].append(r.doc_id)
    dealt = [own[k] for b, own in sorted(buckets.items()) for k in fisher_yates(len(own), 7 + b)]
    want = sorted((doc, k % 24, k // 24) for k, doc in enumerate(dealt))
    assert n > 20 and sorted(map(tuple, sharding.external_shuffle(frame, bucket_bytes=20_000).select("record.doc_id", "shard", "slot").collect())) == want


def test_shuffle_of_rows_alike(spark, monkeypatch):
    """Half of all rows null in every column: they are dealt over the buckets by their number."""
    monkeypatch.setattr(sharding, "GROUP", 3)
    rows = [(i, f"text {i}") for i in range(500)] + [(None, None)] * 500
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.external_shuffle(frame, shards=5, bucket_bytes=400).collect()
    assert sorted((r.record.doc_id or -1, r.record.text or "") for r in out) == sorted((i or -1, t or "") for i, t in rows)
    assert sorted((r.shard, r.slot) for r in out) == [(k, j) for k in range(5) for j in range(200)]
    scattered, counts = sharding._scattered(frame, F_size(), 7, 30, 400)
    assert max(r.n for r in counts.collect()) < 120 and counts.agg({"n": "sum"}).first()[0] == 1000


def F_size():
    from pyspark.sql import functions as F

    return F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 8


def test_write_shards(spark, docs, tmp_path):
    sharding.write_shards(sharding.external_shuffle(docs, shards=3), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 3


# byte-level BPE


def reference_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("pattern", [r"\p{L}{1,3}|\s+|[^\s\p{L}]+", r" ?[a-m]+| ?(?:[n-z]|\p{Lu})+|\s|.", public_tokenizers.PATTERN])
def test_bpe_of_other_patterns(pattern):
    """Patterns that cut inside words and leave characters out, as the library has them."""
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    want = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = [r[1] or "" for r in rows()]
    got = bpe.TextEncoder(bpe.PrefixBpe(bpe.load_ranks(path)), pattern).encode(texts)
    assert bpe.SPACED == public_tokenizers.PATTERN
    assert [g.tolist() for g in got] == [want.encode_ordinary(t) for t in texts]


def test_bpe(spark, docs, empty):
    plain = reference_encoding()
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    for frame in (docs, real(spark)):
        texts = {r.doc_id: r.text or "" for r in frame.collect()}
        for r in bpe.encode(frame, path, public_tokenizers.PATTERN, digests=True).collect():
            ids = plain.encode_ordinary(texts[r.doc_id])
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.encode(empty, path, public_tokenizers.PATTERN).count() == 0


@pytest.fixture(scope="module")
def coder():
    return bpe.PrefixBpe(bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))


def test_follows_is_merging(coder):
    rng = np.random.default_rng(5)
    tokens = list(coder.whole.values())
    for a, b in rng.choice(tokens[:5000], (3000, 2)).tolist() + rng.choice(tokens, (3000, 2)).tolist():
        assert coder.follows(a, b) == (coder.merge(coder.bytes_of[a] + coder.bytes_of[b]) == [a, b])


def test_bpe_appends_and_edits(coder):
    rng = np.random.default_rng(3)
    data = bytes(rng.choice(np.frombuffer(b"abcdefgh thein", np.uint8), 400))
    table = bpe.PrefixTable(coder, data[:200])
    table.append(data[200:])
    assert table.tokens() == coder.merge(data)
    for _ in range(10):
        a = int(rng.integers(0, 300))
        data = data[:a] + b"the end" + data[a + 5 :]
        table.edit(a, a + 5, b"the end")
        assert table.data == data and table.tokens() == coder.merge(data)


# sketches


def test_edit_likeness(spark, docs, empty):
    for frame in (docs.where("doc_id is not null").dropDuplicates(["doc_id"]), real(spark)):
        order = sorted(((r.doc_id, r.text or "") for r in frame.collect()), reverse=True)
        texts = dict(order)
        following = {a[0]: b[1] for a, b in zip(order, [*order[1:], order[0]])}
        got = sketches.edit_likeness(frame).collect()
        assert sorted(r.doc_id for r in got) == sorted(texts)
        for r in got:
            text, more = texts[r.doc_id], following[r.doc_id]
            half = len(text) // 2
            edited = text[: len(text) - half] + more[:half]
            assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert sketches.from_text(r.fingerprint).tolist() == sketches.sketch(text).tolist()
            assert r.near_edited == sketches.resemblance(sketches.sketch(text), sketches.sketch(edited))
            assert r.near_next == sketches.resemblance(sketches.sketch(text), sketches.sketch(more))
    assert sketches.edit_likeness(empty).count() == 0
    assert sketches.edit_likeness(docs).count() == docs.count()


def literal_sketch(text, k=128):
    """The k least of all hashes of five-word shingles, by a plain sort of the set."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    return sorted(xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles)[:k]


def test_likeness_against_sets_and_a_plain_sort(spark):
    frame = real(spark).where("doc_id < 60")
    order = sorted(((r.doc_id, r.text or "") for r in frame.collect()), reverse=True)
    following = {a[0]: b[1] for a, b in zip(order, [*order[1:], order[0]])}
    texts = dict(order)
    for r in sketches.edit_likeness(frame).collect():
        text = texts[r.doc_id]
        edited = text[: len(text) - len(text) // 2] + following[r.doc_id][: len(text) // 2]
        a, b, c = map(literal_sketch, (text, edited, following[r.doc_id]))
        assert (r.fingerprint, r.edited_fingerprint) == tuple("".join(f"{h:016x}" for h in x) for x in (a, b))
        for got, other in ((r.near_edited, b), (r.near_next, c)):
            least = sorted({*a, *other})[:128]
            assert got == (sum(h in a and h in other for h in least) / len(least) if least else 1.0)
            if len(least) < 128:  # then it is the likeness of the sets of shingles
                assert got == (len({*a} & {*other}) / len({*a} | {*other}) if a or other else 1.0)


def test_likeness_of_crowded_doc_ids(spark):
    """A third of all rows without a doc_id, a third with one: all follow one another by hash and text."""
    from pyspark.sql import functions as F

    made = [(None, f"nothing {i} of {i % 7} all {i * i}") for i in range(200)] + [(77, f"same {i} id here {i % 5}") for i in range(200)] + [(i, f"text {i} by itself") for i in range(150)] + [(77, "same")] * 9
    frame = spark.createDataFrame(made, "doc_id long, text string")
    hashed = frame.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = sorted(hashed, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h, r.text))
    want = []
    for r, after in zip(order, [*order[1:], order[0]]):
        edited = r.text[: len(r.text) - len(r.text) // 2] + after.text[: len(r.text) // 2]
        want.append((r.doc_id or -1, len(r.text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((r.doc_id or -1, r.n_chars, r.edited_sha256) for r in sketches.edit_likeness(frame).collect()) == sorted(want)


def test_sketch_estimates():
    words = [f"w{i}" for i in range(4000)]
    a, b = " ".join(words[:3000]), " ".join(words[1000:])
    sa, sb = sketches.sketch(a), sketches.sketch(b)
    assert sketches.resemblance(sa, sb) == pytest.approx(0.5, abs=0.15)
    assert sketches.containment(sa, sb) == pytest.approx(2 / 3, abs=0.2)
    assert sketches.distinct(sa) == pytest.approx(2996, rel=0.3)
    halves = sketches.merge(sketches.bottom_k(sketches.shingle_hashes(" ".join(words[:1504]).encode(), 5)), sketches.bottom_k(sketches.shingle_hashes(" ".join(words[1500:3000]).encode(), 5)))
    assert halves.tolist() == sa.tolist()
    assert sketches.bottom_k(np.full(10_000, 5, np.uint64)).tolist() == [5]
