"""Quality rules: base rules, then robust multivariate outliers by minimum covariance determinant, native throughout.

Each document becomes a vector of transformed statistics. For every language and source the estimator looks for the
``SUBSET`` share of documents whose covariance has the smallest determinant: it starts from medians and median absolute
deviations and repeats concentration steps (distances, the nearest share, mean and covariance of that share). A document
goes when its squared Mahalanobis distance to its group exceeds ``CUTOFF``. Before that each statistic is measured from the
median of its language in units of the language's own tail, and shrunk as far as chance alone moves it in a short document.

Everything is an aggregate of a few numbers a group, so a source that holds a third of all documents is summed in
partial aggregates like any other. Estimates are broadcast when their number is counted to be small. Groups with fewer than ``MIN_GROUP`` documents use the estimate of their language, and
small languages that of all documents.

Null text: no words, so it fails the base rules. Null language or source: a group of its own. Repeated rows count
each time and get the same verdict. An empty table gives an empty result. Only doc_id, text, lang and source are read,
so further columns of any name do no harm.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import WORD_GAP, let
from feedlake.session import cut_lineage

MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"
#: Statistics and what is added to the deviation of each, in units of the language's own scale: some 14 per cent of a variance
#: of one. It is the tolerance of a statistic that is equal in most documents, such as a rate of digits.
FEATURES = dict.fromkeys(("f_length", "f_symbols", "f_upper", "f_punctuation", "f_digits", "f_variety", "f_dup_lines", "f_repeat"), 0.4)
NAMES = list(FEATURES)
#: A statistic's scale is the deviation that this share of a language's documents stays within, read as a Gaussian's.
TAIL, TAIL_Z = 0.9, 1.6449
#: Least scales. Symbols and digits are often zero in more than that share: five characters a thousand are then 0.94 and 0.47 of it.
#: So are the shares of repeated lines and words: a quarter is one scale.
LEAST = {"f_symbols": 0.075, "f_digits": 0.15, "f_variety": 0.01, "f_dup_lines": 0.25, "f_repeat": 0.25}
RESOLUTION = 0.001
#: Words at which a rate varies by chance as much as between documents: deviations shrink by sqrt(n / (n + NOISE_WORDS)).
NOISE_WORDS = 100
SUBSET, STEPS, MIN_GROUP = 0.75, 3, 60
#: Rows of some 300 bytes.
BROADCAST_GROUPS = 20_000


def chi_square_cdf(x: float, df: int) -> float:
    """Chi-square distribution function, by the series of the incomplete gamma function."""
    a, z = df / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    for k in range(1, 500):
        term *= z / (a + k)
        total += term
        if term < total * 1e-16:
            break
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a))


def chi_square_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


#: Distances beyond this have a chance of one in a hundred thousand in a clean Gaussian group.
CUTOFF = chi_square_quantile(1 - 1e-5, len(NAMES))
#: The covariance of the nearest share is too small by this factor when the group is Gaussian.
CONSISTENCY = SUBSET / chi_square_cdf(chi_square_quantile(SUBSET, len(NAMES)), len(NAMES) + 2)


def _repeated(words: Column) -> Column:
    """Words that lie in a window of ``WINDOW`` words found twice or more; windows are compared by a 64-bit hash."""
    def covered(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            marked = F.transform(s, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
            return F.array_sort(F.filter(marked, lambda x: x.isNotNull()))

        def lengths(at: Column) -> Column:
            each = F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW))))
            return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(pairs, places), lengths)

    def count(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(covered(windows))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW),
                           lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > WINDOW, let(let(hashes, windows), count)).otherwise(F.lit(0).cast("long"))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts and the transformed statistics of every whole text."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select("doc_id", "lang", "source", text.alias("text"),
                        F.filter(F.split(text, WORD_GAP), lambda w: w != "").alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = split.select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct"))).alias("lines"),
        _repeated(F.col("words")).alias("n_repeat_words"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).alias("n_upper"),
        F.length(F.regexp_replace("text", r"[^\p{P}\p{S}]+", "")).alias("n_marks"),
        F.length(F.regexp_replace("text", r"[^0-9]+", "")).alias("n_digits"))
    counts = counts.withColumn("n_dup_lines", (F.col("lines.n") - F.col("lines.distinct")).cast("long"))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    some = F.greatest(F.col("n_words"), F.lit(2))
    return _scaled(_without_length(cut_lineage(counts.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
         ).alias("base_failed"),
        F.log(chars / F.greatest(F.col("n_words"), F.lit(1))).alias("f_length"),
        F.sqrt(F.col("n_symbols") / chars).alias("f_symbols"),
        F.sqrt(F.col("n_upper") / chars).alias("f_upper"),
        F.sqrt(F.greatest(F.col("n_marks") - F.col("n_symbols"), F.lit(0)) / chars).alias("f_punctuation"),
        F.sqrt(F.col("n_digits") / chars).alias("f_digits"),
        F.log(F.greatest(F.col("n_distinct"), F.lit(1))).alias("f_variety"),
        (F.col("n_dup_lines") / F.greatest(F.col("lines.n"), F.lit(1))).alias("f_dup_lines"),
        (F.col("n_repeat_words") / some).alias("f_repeat")))))


def _without_length(stats: DataFrame) -> DataFrame:
    """``f_variety`` as the distance of the log of distinct words from what texts of that language and length have.

    Vocabulary grows as a power of the length: a line through the logs, drawn again without the texts far from it. What is
    left of a curve goes by the medians of half octaves of length that have ``MIN_GROUP`` texts.
    """
    language = F.coalesce(F.concat(F.lit("v"), F.col("lang")), F.lit("")).alias("g_lang")
    size = F.log(F.greatest(F.col("n_words"), F.lit(1)))
    rows = stats.select("*", language)
    fitted = rows.where(~F.col("base_failed")).select("g_lang", size.alias("x"), F.col("f_variety").alias("y"))

    def line(points: DataFrame) -> DataFrame:
        slope = F.coalesce(F.regr_slope("y", "x"), F.lit(0.0))
        return points.groupBy("g_lang").agg(slope.alias("slope"), (F.avg("y") - slope * F.avg("x")).alias("level"))

    def apart(points: DataFrame, lines: DataFrame) -> DataFrame:
        return points.join(_sized(lines), "g_lang").withColumn("r", F.col("y") - F.col("level") - F.col("slope") * F.col("x"))

    first = cut_lineage(line(fitted))
    spread = apart(fitted, first)
    limits = cut_lineage(spread.groupBy("g_lang").agg(F.percentile_approx(F.abs("r"), TAIL).alias("limit")))
    lines = cut_lineage(line(spread.join(_sized(limits), "g_lang").where(F.abs("r") <= F.col("limit")).select("g_lang", "x", "y")))
    octave = F.floor(2 * F.log2(F.greatest(F.col("n_words"), F.lit(1)))).cast("int")
    bends = cut_lineage(apart(rows.where(~F.col("base_failed")).select("g_lang", size.alias("x"), F.col("f_variety").alias("y"), octave.alias("octave")), lines)
                        .groupBy("g_lang", "octave").agg(F.percentile_approx("r", 0.5).alias("bend"), F.count(F.lit(1)).alias("times"))
                        .where(F.col("times") >= MIN_GROUP).drop("times"))
    out = rows.withColumn("octave", octave).join(_sized(lines), "g_lang", "left").join(_sized(bends), ["g_lang", "octave"], "left")
    expected = F.coalesce(F.col("level") + F.col("slope") * size, F.lit(0.0)) + F.coalesce("bend", F.lit(0.0))
    return out.withColumn("f_variety", F.col("f_variety") - expected).select(*stats.columns)


def _scaled(stats: DataFrame) -> DataFrame:
    """Every statistic as deviation from its language's median, evened out over lengths, in units of the language's tail."""
    language = F.coalesce(F.concat(F.lit("v"), F.col("lang")), F.lit("")).alias("g_lang")
    usable = stats.where(~F.col("base_failed"))
    centres = cut_lineage(usable.groupBy(language).agg(*(F.percentile_approx(c, 0.5).alias(f"m_{c}") for c in NAMES)))
    share = F.sqrt(F.col("n_words") / (F.col("n_words") + NOISE_WORDS))

    def deviations(rows: DataFrame) -> DataFrame:
        # A language without a usable row has no centre, and its rows need none.
        rows = rows.select("*", language).join(_sized(centres), "g_lang", "left")
        return rows.withColumns({c: (F.col(c) - F.coalesce(f"m_{c}", F.lit(0.0))) * share for c in NAMES}).select("g_lang", *stats.columns)

    scales = cut_lineage(deviations(usable).groupBy("g_lang").agg(*(
        F.greatest(F.percentile_approx(F.abs(c), TAIL) / TAIL_Z, F.lit(LEAST.get(c, RESOLUTION))).alias(f"s_{c}") for c in NAMES)))
    rows = deviations(stats).join(_sized(scales), "g_lang", "left")
    return rows.withColumns({c: F.col(c) / F.coalesce(f"s_{c}", F.lit(1.0)) for c in NAMES}).select(*stats.columns)


def _sized(groups: DataFrame) -> DataFrame:
    """A written table of groups, to be broadcast if it is counted to be small; else joined by Spark's choice."""
    return F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups


def _grouped(stats: DataFrame) -> DataFrame:
    """Usable rows once for each level (language and source, language, all), with the level's key."""
    nothing = F.lit("")
    pair = [F.concat(F.lit("v"), c) for c in (F.col("lang"), F.col("source"))]
    lang, source = (F.coalesce(c, nothing) for c in pair)
    levels = F.array(F.struct(F.lit(0).alias("level"), lang.alias("g_lang"), source.alias("g_source")),
                     F.struct(F.lit(1).alias("level"), lang.alias("g_lang"), nothing.alias("g_source")),
                     F.struct(F.lit(2).alias("level"), nothing.alias("g_lang"), nothing.alias("g_source")))
    return stats.where(~F.col("base_failed")).select(F.explode(levels).alias("g"), *NAMES).select("g.*", *NAMES)


KEY = ["level", "g_lang", "g_source"]


def _distance(prefix: str = "") -> Column:
    """Squared length of W (x - m): W is the inverse of the covariance's Cholesky factor, held row by row."""
    rows = []
    for i in range(len(NAMES)):
        rows.append(sum((F.col(f"{prefix}w{i}{j}") * (F.col(NAMES[j]) - F.col(f"{prefix}m{j}")) for j in range(i + 1)),
                        F.lit(0.0)))
    return sum((r * r for r in rows), F.lit(0.0))


def _with_whitening(moments: DataFrame) -> DataFrame:
    """Add W from the covariances c_ij of each group, by elimination in the rows of the covariance beside the unit matrix."""
    d = len(NAMES)
    start = F.array(*(F.array(*(F.col(f"c{max(i, j)}{min(i, j)}") for j in range(d)), *(F.lit(float(i == j)) for j in range(d)))
                      for i in range(d)))

    def eliminate(rows: Column, k: Column) -> Column:
        pivot = F.get(rows, k)

        def below(row: Column, i: Column) -> Column:
            return F.when(i <= k, row).otherwise(F.zip_with(row, pivot, lambda x, y: x - y * F.get(row, k) / F.get(pivot, k)))

        return F.transform(rows, below)

    centre = [f"m{i}" for i in range(d)]
    done = moments.select(*KEY, "n", *centre, F.aggregate(F.sequence(F.lit(0), F.lit(d - 2)), start, eliminate).alias("rows"))
    return done.select(*KEY, "n", *centre, *((F.col("rows")[i][d + j] / F.sqrt(F.col("rows")[i][i])).alias(f"w{i}{j}")
                                             for i in range(d) for j in range(i + 1)))


def estimates(stats: DataFrame) -> DataFrame:
    """Robust centre and whitening matrix of every group: one row a group and level."""
    rows, d = _grouped(stats), len(NAMES)
    medians = cut_lineage(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), *(
        F.percentile_approx(c, 0.5).alias(f"m{i}") for i, c in enumerate(NAMES))))
    spread = rows.join(_sized(medians), KEY).groupBy(*KEY).agg(F.first("n").alias("n"), *(F.first(f"m{i}").alias(f"m{i}") for i in range(d)), *(
        F.percentile_approx(F.abs(F.col(c) - F.col(f"m{i}")), 0.5).alias(f"s{i}") for i, c in enumerate(NAMES)))
    # 1.4826 turns a median absolute deviation into a standard deviation.
    spread = spread.select("*", *((F.pow(F.col(f"s{i}") * 1.4826, 2) + FEATURES[c] ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}")
                                  for i, c in enumerate(NAMES) for j in range(i + 1)))
    current = cut_lineage(_with_whitening(spread))
    for _ in range(STEPS):
        near = rows.join(_sized(current), KEY).select(*KEY, "n", *NAMES, _distance().alias("d2"))
        limit = near.groupBy(*KEY).agg(F.percentile_approx("d2", SUBSET).alias("limit"))
        chosen = near.join(limit, KEY).where(F.col("d2") <= F.col("limit"))
        moments = chosen.groupBy(*KEY).agg(
            F.first("n").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(NAMES)),
            *(F.covar_pop(a, NAMES[j]).alias(f"v{i}{j}") for i, a in enumerate(NAMES) for j in range(i + 1)))
        moments = moments.select("*", *((F.col(f"v{i}{j}") * CONSISTENCY + (FEATURES[c] ** 2 if i == j else 0.0)).alias(f"c{i}{j}")
                                        for i, c in enumerate(NAMES) for j in range(i + 1)))
        current = cut_lineage(_with_whitening(moments))
    return current


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """One row a document: the base counts, base_failed, kept and distance2 (null where no group has an estimate)."""
    stats = cut_lineage(statistics(docs))
    current = estimates(stats)
    small = current.count() <= BROADCAST_GROUPS
    found = current.where(F.col("n") >= F.when(F.col("level") == 2, 1).otherwise(MIN_GROUP))
    lang = F.coalesce(F.concat(F.lit("v"), F.col("lang")), F.lit(""))
    source = F.coalesce(F.concat(F.lit("v"), F.col("source")), F.lit(""))
    out = stats.withColumns({"k_lang": lang, "k_source": source})
    parts = [c for c in found.columns if c not in KEY]
    for level in range(3):
        own = found.where(F.col("level") == level).select(
            F.col("g_lang").alias(f"gl{level}"), F.col("g_source").alias(f"gs{level}"), *(F.col(c).alias(f"p{level}_{c}") for c in parts))
        on = (F.lit("") if level == 2 else F.col("k_lang")) == F.col(f"gl{level}")
        on &= (F.col("k_source") if level == 0 else F.lit("")) == F.col(f"gs{level}")
        # The last level is one row.
        out = out.join(F.broadcast(own) if small or level == 2 else own, on, "left")
    d2 = F.coalesce(*(_distance(f"p{level}_") for level in range(3)))
    out = out.withColumn("distance2", d2)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= cutoff)).alias("kept"), "distance2")
