"""Quality rules by robust multivariate outliers: minimum-covariance-determinant estimates per language and source.

DataFrame functions only. Words are runs of characters other than space and the controls 9 to 13. A document's rates
become a vector of transformed statistics; each group's centre and scatter come from the share of its documents that
lie closest together, and documents far from them by Mahalanobis distance are rejected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import written

# Production settings: least words, greatest share of repeated words, share of a group that the estimate is fitted to,
# concentration steps, least documents of a group, squared distance that rejects (chi-square with 4 degrees of freedom
# has 0.9999 of its mass below 23.5), floor of each variance so that rates that are all zero can be inverted.
MIN_WORDS, MAX_REPEAT_PERCENT, SUBSET, STEPS, MIN_GROUP, CUTOFF, FLOOR = 10, 20, 0.75, 6, 40, 23.5, 0.04
WINDOW = 5
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"
_BLANK_CLASS = r"[\x20\x09-\x0D]+"
UNIT = 1024.0
FEATURES = ("x0", "x1", "x2", "x3")


def base_statistics(docs: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """``doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of every whole text, and a
    struct ``carried`` of the columns named, if any are.

    A null text has no words. Lines are what line feeds part; a line is a duplicate if it has a word and equals an
    earlier line. Repeated words are those inside a window of five words that occurs more than once in the text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    along = [F.struct(*[F.col(f"`{c}`") for c in carried]).alias("carried")] if carried else []
    bare = docs.select(*along, "doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"))
    trimmed = F.btrim("text", F.lit(_BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _BLANK_CLASS))
    lines = F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(_BLANKS)) != "")
    along = ["carried"] if carried else []
    counted = bare.select(
        *along, "doc_id", "lang", "source", words.alias("words"), lines.alias("lines"),
        F.length(F.translate("text", _BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"))
    last = F.size("words") - WINDOW
    window = F.transform(
        F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]))
    windows = counted.select(
        *along, "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), window.alias("windows"))
    return windows.select(*along, "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", _repeated("windows").alias("n_repeat_words"))


def _repeated(windows: str) -> Column:
    """Words inside windows that occur more than once; the sort only runs where some window does."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    size = F.size(windows)

    def twice(s: Column, j: Column) -> Column:
        own = F.get(s, j)["h"]
        return (F.coalesce(F.get(s, j - 1)["h"] == own, F.lit(False))) | (F.coalesce(F.get(s, j + 1)["h"] == own, F.lit(False)))

    def positions(s: Column) -> Column:
        return F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), size - 1), lambda j: twice(s, j)), lambda j: F.get(s, j)["i"]))

    # Each covered start adds the words up to the next one, five at most.
    def covered(s: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("at"))
        return F.aggregate(
            positions(s), zero,
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["at"])).cast("long").alias("n"), i.alias("at")), lambda acc: acc["n"])

    once = F.transform(F.array(placed), covered)  # binds the sorted windows to a name, so that they are sorted once
    return F.when(size <= F.size(F.array_distinct(windows)), F.lit(0).cast("long")).otherwise(F.get(once, F.lit(0)))


def _rounded(value: Column) -> Column:
    """On a grid of 1/1024, so that sums over a group are exact and do not depend on their order."""
    return F.floor(value * F.lit(UNIT) + F.lit(0.5)).cast("long")


def transformed(stats: DataFrame) -> DataFrame:
    """Adds the statistic vector, logarithms in units of 1/1024: word length, symbols, duplicate lines and repeats."""
    words = F.greatest("n_words", F.lit(1)).cast("double")
    return stats.withColumns({
        "x0": _rounded(F.lit(4.0) * F.log((F.col("word_chars") + F.lit(1.0)) / words)),
        "x1": _rounded(F.log(F.lit(1.0) + F.lit(100.0) * F.col("n_symbols") / F.greatest("word_chars", F.lit(1)))),
        "x2": _rounded(F.log(F.lit(1.0) + F.lit(20.0) * F.col("n_dup_lines") / words)),
        "x3": _rounded(F.log(F.lit(1.0) + F.lit(5.0) * F.col("n_repeat_words") / words)),
    })


def _distance(prefix: str = "") -> Column:
    """Squared Mahalanobis distance by forward substitution with the Cholesky factor in columns l00 .. l33, m0 .. m3."""
    p = len(FEATURES)
    z: list[Column] = []
    for i in range(p):
        rest = (F.col(FEATURES[i]) / F.lit(UNIT)) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * z[j]
        z.append(rest / F.col(f"l{i}{i}"))
    total = F.lit(0.0)
    for value in z:
        total = total + value * value
    return total


def _factor(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Centre and Cholesky factor from the count ``n`` and the exact sums of a subset; one select per column of the factor."""
    p = len(FEATURES)
    frame = sums.select(*keys, "n", *[(F.col(f"s{i}").cast("double") / F.col("n") / F.lit(UNIT)).alias(f"m{i}") for i in range(p)],
                        *[F.col(f"q{i}{j}") for i in range(p) for j in range(i + 1)])
    frame = frame.select(*keys, "n", *[f"m{i}" for i in range(p)], *[
        (F.col(f"q{i}{j}").cast("double") / F.col("n") / F.lit(UNIT * UNIT) - F.col(f"m{i}") * F.col(f"m{j}") + F.lit(FLOOR if i == j else 0.0)).alias(f"c{i}{j}")
        for i in range(p) for j in range(i + 1)])
    for j in range(p):
        done = F.col(f"c{j}{j}")
        for k in range(j):
            done = done - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        frame = frame.withColumn(f"l{j}{j}", F.sqrt(F.greatest(done, F.lit(FLOOR / 2))))
        for i in range(j + 1, p):
            off = F.col(f"c{i}{j}")
            for k in range(j):
                off = off - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            frame = frame.withColumn(f"l{i}{j}", off / F.col(f"l{j}{j}"))
    return frame.select(*keys, *[f"m{i}" for i in range(p)], *[f"l{i}{j}" for i in range(p) for j in range(i + 1)])


def _sums() -> list[Column]:
    wide = lambda c: c.cast("decimal(38,0)")
    return [F.count("*").alias("n"), *[F.sum(wide(F.col(x))).cast("decimal(38,0)").alias(f"s{i}") for i, x in enumerate(FEATURES)],
            *[F.sum(wide(F.col(FEATURES[i]) * F.col(FEATURES[j]))).cast("decimal(38,0)").alias(f"q{i}{j}") for i in range(len(FEATURES)) for j in range(i + 1)]]


def robust_estimates(vectors: DataFrame, subset: float = SUBSET, steps: int = STEPS) -> DataFrame:
    """Centre and Cholesky factor of each ``pool``'s minimum-covariance subset.

    Starts from the documents nearest to the pool's medians (whole numbers on a grid, so each median needs only counts of
    few values) and takes ``steps`` concentration steps: estimate from the subset, measure every document, keep the nearest ``subset`` share.
    The share is cut at the edge of a bin of the logarithm of the distance (1/16 of a power of two), so one pre-aggregated
    shuffle of sums per pool and bin does a whole step; no pool is gathered or sorted.
    """
    medians = vectors.groupBy("pool").agg(*[F.percentile(x, F.lit(0.5)).alias(f"s{i}") for i, x in enumerate(FEATURES)])
    identity = [F.lit(1.0 if i == j else 0.0).alias(f"l{i}{j}") for i in range(len(FEATURES)) for j in range(i + 1)]
    estimate = written(medians.select("pool", *[(F.col(f"s{i}") / F.lit(UNIT)).alias(f"m{i}") for i in range(len(FEATURES))], *identity))
    ordered = Window.partitionBy("pool").orderBy("bin")
    for _ in range(steps + 1):
        bins = vectors.join(estimate, "pool").withColumn("distance", _distance()).withColumn("bin", F.floor(F.log2(F.col("distance") + F.lit(1e-6)) * F.lit(16.0))).groupBy("pool", "bin").agg(*_sums())
        names = [c for c in bins.columns if c not in ("pool", "bin")]
        upto = bins.withColumn("before", F.sum("n").over(ordered) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy("pool")))
        inside = upto.filter(F.col("before") < F.col("all") * F.lit(subset)).groupBy("pool").agg(*[F.sum(c).cast(bins.schema[c].dataType).alias(c) for c in names])
        estimate = written(_factor(inside, ["pool"]))
    return estimate


def quality_rules(docs: DataFrame, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT_PERCENT, cutoff: float = CUTOFF,
                  min_group: int = MIN_GROUP, subset: float = SUBSET, steps: int = STEPS, carried: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, the base statistics, ``base_failed``, ``distance`` (squared) and ``kept`` for every row of ``docs``.

    A row fails the base rules with fewer than ``min_words`` words or with more than ``max_repeat`` per cent of them in
    repeated windows. The others are measured against their language and source; a pair of these with fewer than
    ``min_group`` such rows is pooled with the small ones of its language, and a language with too few with all such
    languages. What is still too few rejects nobody. ``distance`` is null for rows that failed or whose pool is too
    small. Null languages and sources are groups of their own. Repeated rows count as often as they occur. With ``carried``
    the result also has a struct of these columns of the row, which travel with the statistics, so that no join brings
    them back.
    """
    stats = written(transformed(base_statistics(docs, carried)).withColumn(
        "base_failed", (F.col("n_words") < min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(max_repeat) * F.col("n_words"))))
    label = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    judged = stats.withColumns({"lang_key": label("lang"), "source_key": label("source")})
    groups = judged.filter("not base_failed").groupBy("lang_key", "source_key").agg(F.count("*").alias("n"))
    small = F.col("n") < min_group
    by_lang = Window.partitionBy("lang_key")
    pooled = groups.withColumn("n_lang", F.sum(F.when(small, F.col("n")).otherwise(0)).over(by_lang))
    pools = pooled.select("lang_key", "source_key", F.when(~small, F.concat_ws("|", "lang_key", "source_key"))
                          .when(F.col("n_lang") >= min_group, F.concat("lang_key", F.lit("|*"))).otherwise(F.lit("*|*")).alias("pool"), "n")
    sizes = pools.groupBy("pool").agg(F.sum("n").alias("n_pool")).filter(F.col("n_pool") >= min_group)
    pools = written(pools.join(sizes, "pool").select("lang_key", "source_key", "pool"))
    vectors = judged.filter("not base_failed").join(pools, ["lang_key", "source_key"]).select("pool", *FEATURES)
    estimates = robust_estimates(vectors, subset, steps)
    # Written, so that its size is known and Spark sends it to the documents' tasks where it is small.
    known = written(pools.join(estimates, "pool"))
    measured = judged.join(known, ["lang_key", "source_key"], "left")
    distance = F.when(~F.col("base_failed"), _distance())
    return measured.select(
        *(["carried"] if carried else []), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", distance.alias("distance"),
        (~F.col("base_failed") & F.coalesce(distance <= F.lit(cutoff), F.lit(True))).alias("kept"))
