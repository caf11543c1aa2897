"""Quality rules with risk-controlled cutoffs, with DataFrame functions only.

Counts are taken from whole texts. Each rule compares a ratio of counts with a
cutoff, one for every stratum (language). A cutoff is certified on the labelled
holdout if the exact binomial test rejects "it rejects more than the allowed share
of good documents" at a level divided by the number of all cutoffs tested
(Bonferroni), so all certified cutoffs hold at once and any of them may be chosen:
the one that rejects most bad documents, each good one weighing against it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covarium.llm.common import SPACES, materialise, text_or_empty

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Share of good documents that all rules together may reject in a stratum, the chance of exceeding it, and the weight of a good one.
RISK, LEVEL, WEIGHT = 0.05, 0.05, 4
POSITION_BITS = 22
#: Strata with cutoffs, a row of some numbers each, up to which they are sent to the rows.
FEW_STRATA = 4096

#: Ratios that are high in bad documents, and the cutoffs that are tested for each.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", [k / 100 for k in range(1, 31)]),
    "duplicate_lines": ("n_dup_lines / greatest(n_lines, 1)", [k / 20 for k in range(1, 20)]),
    "repeated_words": ("n_repeat_words / greatest(n_words, 1)", [k / 50 for k in range(1, 25)]),
    "long_words": ("word_chars / greatest(n_words, 1)", [k / 2 for k in range(10, 31)]),
}


def _repeat_words(n: Column, words: Column, bits: int) -> tuple[Column, Column]:
    """Windows as sorted longs of a hash above a position, and the test of entry x at place j."""
    last = F.lit((1 << bits) - 1)
    packed = F.when(
        n >= 3,
        F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(1))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.lit(-1 << bits)).bitwiseOR(i.cast("long"))),
    ).otherwise(F.array().cast("array<bigint>"))
    return F.sort_array(packed), last


def counts(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` and the counts of every row: ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words`` (longs).

    Words are runs of ``[^\\x20\\x09-\\x0D]``. Repeated windows are found by
    sorting hashes with their positions; neighbours of like hash are compared
    word by word, so a collision adds none. Texts of four million words and more
    are sorted as structs, with as large positions as need be.
    """
    text = F.col("text")
    bare = F.btrim(text, F.lit(BLANKS))
    base = docs.select(*keep, text_or_empty().alias("text")).select(
        "*",
        F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACES}]+")).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("lines"),
    )
    words, n = F.col("words"), F.size("words")
    spaces = sum((F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in BLANKS), F.lit(0))
    symbols = sum((F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in SYMBOLS), F.lit(0))
    packed, last = _repeat_words(n, words, POSITION_BITS)
    small = n < (1 << POSITION_BITS)
    names = [c for c in base.columns if c not in ("text", "words", "lines")]
    sized = base.select(
        *names,
        "words",
        n.cast("long").alias("n_words"),
        (F.length(text) - spaces).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(small, packed).otherwise(F.array().cast("array<bigint>")).alias("packed"),
    )
    row = F.col("packed")

    def at(p: Column, k: int) -> Column:
        return F.get(words, (p.bitwiseAND(last) + k).cast("int"))

    def like(a: Column, b: Column) -> Column:
        near = F.shiftright(a, POSITION_BITS) == F.shiftright(b, POSITION_BITS)
        return F.coalesce(near, F.lit(False)) & (at(a, 0) == at(b, 0)) & (at(a, 1) == at(b, 1)) & (at(a, 2) == at(b, 2))

    twice = F.filter(row, lambda x, j: like(x, F.get(row, j + 1)) | like(x, F.when(j > 0, F.get(row, j - 1))))
    few = F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(last)))
    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(1))), lambda w, i: F.struct(w.alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.cast("long").alias("i")))
    many = F.array_sort(windows)

    def same(a: Column, b: Column) -> Column:
        return (a["a"] == b["a"]) & (a["b"] == b["b"]) & (a["c"] == b["c"])

    placed = sized.select(
        *(c for c in sized.columns if c not in ("words", "packed")),
        F.when(F.size(words) < (1 << POSITION_BITS), few)
        .otherwise(F.aggregate(many, F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(None).cast("struct<a:string,b:string,c:string,i:bigint>").alias("was")), lambda s, x: F.struct(F.when(F.coalesce(same(x, s["was"]), F.lit(False)), F.concat(s["out"], F.array(s["was"]["i"], x["i"]))).otherwise(s["out"]).alias("out"), x.alias("was")), lambda s: F.sort_array(F.array_distinct(s["out"]))))
        .alias("places"),
    )
    places = F.col("places")
    covered = F.aggregate(F.transform(places, lambda x, j: F.least(F.lit(3).cast("long"), F.coalesce(F.get(places, j + 1) - x, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda a, x: a + x)
    return placed.select(*(c for c in placed.columns if c != "places"), covered.alias("n_repeat_words"))


def _log_gamma(x: Column) -> Column:
    """ln gamma for x >= 1: Stirling's series at x + 8, brought down by the recurrence."""
    z = x + 8
    down = F.lit(0.0)
    for k in range(8):
        down = down + F.log(x + k)
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - down


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of the binomial distribution for k < n p, else 1.

    From k downwards each term is the one above times a ratio below 1; twenty
    standard deviations of terms hold all that a double can.
    """
    k, n = k.cast("double"), n.cast("double")
    top = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log1p(F.lit(-p))
    steps = F.least(k, F.floor(20 * F.sqrt(n)) + 200).cast("int")
    total = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda s, j: F.struct((s["term"] * (k - j) * (1 - p) / ((n - k + j + 1) * p)).alias("term"), (s["sum"] + s["term"] * (k - j) * (1 - p) / ((n - k + j + 1) * p)).alias("sum")),
        lambda s: s["sum"],
    )
    return F.when((n > 0) & (k < n * p), F.least(F.lit(1.0), F.exp(top) * total)).otherwise(F.lit(1.0))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def certified_cutoffs(counted: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL, weight: int = WEIGHT) -> DataFrame:
    """``(stratum, rule, cutoff, n_good, k_good, k_bad, p_value)``: the chosen certified cutoffs.

    ``counted`` has doc_id, row_key, stratum and the counts; ``labels`` doc_id and
    quality. Copies of a text are no independent trials: they are one, bad if any
    label says so. A document is judged by a rule only if the base rules keep it. A stratum with
    too few labels, or a rule that finds nothing worth its harm, has no cutoff.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    held = counted.where(~base_failed()).join(known, "doc_id")
    ratios = {rule: F.expr(ratio) for rule, (ratio, _) in RULES.items()}
    held = held.select("stratum", "row_key", "quality", *(v.alias(k) for k, v in ratios.items())).groupBy("stratum", "row_key").agg(F.min("quality").alias("quality"), *(F.first(k).alias(k) for k in ratios))
    level_of = [F.struct(F.lit(r).alias("rule"), sum((F.when(F.col(r) > c, 1).otherwise(0) for c in grid), F.lit(0)).alias("above")) for r, (_, grid) in RULES.items()]
    cells, _ = materialise(held.select("stratum", "quality", F.explode(F.array(*level_of)).alias("x")).groupBy("stratum", "x.rule", "x.above").agg(F.count_if(F.col("quality") > 0).alias("good"), F.count_if(F.col("quality") <= 0).alias("bad")))
    spark = counted.sparkSession
    grid = spark.createDataFrame([(r, k + 1, c) for r, (_, g) in RULES.items() for k, c in enumerate(g)], "rule string, place int, cutoff double")
    tests = sum(len(g) for _, g in RULES.values()) * max(1, cells.select("stratum").distinct().count())
    sums = cells.join(grid, "rule").groupBy("stratum", "rule", "place", "cutoff").agg(
        F.sum("good").alias("n_good"),
        F.sum(F.when(F.col("above") >= F.col("place"), F.col("good")).otherwise(0)).alias("k_good"),
        F.sum(F.when(F.col("above") >= F.col("place"), F.col("bad")).otherwise(0)).alias("k_bad"),
    )
    tested = sums.withColumn("p_value", binomial_tail(F.col("k_good"), F.col("n_good"), risk / len(RULES)))
    gain = F.col("k_bad") - weight * F.col("k_good")
    best = Window.partitionBy("stratum", "rule").orderBy(gain.desc(), F.col("place").desc())
    return (
        tested.where((F.col("p_value") <= level / tests) & (gain > 0))
        .withColumn("rank", F.row_number().over(best))
        .where("rank = 1")
        .select("stratum", "rule", "cutoff", "n_good", "k_good", "k_bad", "p_value")
    )


def _key() -> Column:
    return F.xxhash64("text", "lang")


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """Counts and verdict of every row: ``doc_id, row_key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``.

    ``row_key`` is a hash of text and lang.
    Null text has no words and fails; a null lang is a stratum. Repeated rows are
    judged each; null doc_ids are judged and label nothing. An empty table gives
    an empty one; without labels only the base rules hold.
    """
    judged = _judged(docs, labels, [], risk, level)
    return judged.select("doc_id", "row_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _judged(docs: DataFrame, labels: DataFrame, extra: list[Column], risk: float, level: float) -> DataFrame:
    """The counts, ``extra`` columns of ``docs``, ``base_failed`` and ``kept``."""
    keep = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), _key().alias("row_key"), *extra]
    counted, _ = materialise(counts(docs, keep))
    chosen = certified_cutoffs(counted, labels, risk, level)
    limits = chosen.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"max_{r}") for r in RULES))
    fails = F.lit(False)
    for r, (ratio, _) in RULES.items():
        fails = fails | F.coalesce(F.expr(ratio) > F.col(f"max_{r}"), F.lit(False))
    limits, _ = materialise(limits)
    if limits.count() <= FEW_STRATA:  # so that no text is shuffled
        limits = F.broadcast(limits)
    return counted.join(limits, "stratum", "left").withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~fails)


def keep(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    They are carried through the table of the counts, so no text is shuffled unless
    there are over ``FEW_STRATA`` strata. Null
    and empty texts fail the base rules; repeated rows stay or go together; null
    doc_ids are judged; names that clash don't matter; an empty table gives an
    empty one.
    """
    judged = _judged(docs, labels, [F.struct(*docs.columns).alias("record")], risk, level)
    return judged.where("kept").select("record.*")
