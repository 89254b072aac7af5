"""Quality rules: base counts, and robust multivariate outliers by language and source.

For each (language, source) the minimum covariance determinant of transformed statistic vectors is
searched from several starts around coordinate medians. A concentration step keeps the half of the rows
with the least Mahalanobis distance and re-estimates. After a few steps each group goes on from the start
whose determinant is least, and steps are repeated until no group's determinant falls any more. A group's
moments are shrunk to those of its language by a fixed number of pseudo-rows, so small groups need no rule
of their own, and a ridge added to each variance keeps statistics that are constant among clean texts from
being singular. Rows farther than a chi-squared quantile are rejected.

DataFrame expressions only: a step is one scan of the statistic vectors and one partial aggregate by group
and cell of the distances' histogram, so a hot source costs a bounded number of rows a task. Defined results: null or empty text has all counts 0 and fails the
base rule; texts are read whole; null language or source is a group of its own, apart from the empty
string's; rows at equal distances, or in one cell of the distances' histogram, are inside the subset
together, so ties don't hang on any order; of starts with equal determinants the first counts; repeated rows stay and count each; columns beyond the key,
text, language and source are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetmill.llm.common import materialize

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Statistics, with the ridge on each one's variance as a standard deviation; also the first scales.
VECTOR = {"length": 0.12, "symbols": 0.3, "dup_lines": 0.9, "repeats": 0.7, "capitals": 0.35}
#: Share of a group in the concentrated subset; steps from each start; pseudo-rows of the language.
SUBSET, STEPS, PSEUDO = 0.5, 2, 20.0
#: A group's steps have come to rest when the logarithm of its determinant falls by less.
REST = 0.01
#: Chance that a Gaussian row is rejected.
ALPHA = 1e-5
KEYS = ("g_lang", "g_source")
#: Up to so many groups (some 300 bytes each) are sent to all executors, so a hot source stays spread;
#: beyond, rows are joined by group and skewed joins are split at run time.
BROADCAST_GROUPS = 50_000


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_window_words(words: Column, width: int = 5) -> Column:
    """Words inside windows of ``width`` words that stand twice or more in the array."""

    def covered(st: Column) -> Column:
        spans = F.transform(st, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(st, i + 1) - p, F.lit(width))))
        return F.aggregate(spans, F.lit(0), lambda a, b: a + b)

    def starts(s: Column) -> Column:
        twin = lambda x, j: F.coalesce(F.get(s, j)["v"] == x["v"], F.lit(False))
        return F.array_sort(F.array_compact(F.transform(s, lambda x, i: F.when(twin(x, i - 1) | twin(x, i + 1), x["i"]))))

    def count(five: Column) -> Column:
        ordered = F.array_sort(F.transform(five, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(five)) == F.size(five), F.lit(0)).otherwise(_let(ordered, lambda s: _let(starts(s), covered)))

    def windows(h: Column) -> Column:
        hashed = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
        return F.when(F.size(h) < width, F.lit(0)).otherwise(_let(hashed, count))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and helper columns."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, SPACE), lambda w: F.length(w) > 0)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    squeezed = F.regexp_replace(t, SPACE, "")
    counted = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_window_words(w).cast("long").alias("n_repeat_words")))
    dup = _let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return docs.select(
        "*",
        counted.alias("_w"),
        dup.alias("_l"),
        F.length(squeezed).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", ""))).alias("_upper"),
    ).select("*", "_w.*", "_l.*").drop("_w", "_l")


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words").cast("double"), F.lit(1.0))
    per = lambda c, d=n: F.log1p(20.0 * F.col(c) / d)
    size = F.log(F.greatest(F.col("word_chars") / n, F.lit(0.5))) - math.log(5.0)
    return [
        size * F.sqrt(n / (n + 100.0)),
        per("n_symbols"),
        per("n_dup_lines", F.greatest(F.col("n_lines").cast("double"), F.lit(1.0))),
        per("n_repeat_words"),
        per("_upper", F.greatest(F.col("word_chars").cast("double"), F.lit(1.0))),
    ]


def chi2_cdf(x: float, p: int) -> float:
    """By the series of the lower incomplete gamma function."""
    a, h = p / 2, x / 2
    term = total = 1 / a
    for k in range(1, 1000):
        term *= h / (a + k)
        total += term
        if term < total * 1e-15:
            break
    return min(1.0, total * math.exp(-h + a * math.log(h) - math.lgamma(a))) if h > 0 else 0.0


def chi2_quantile(q: float, p: int) -> float:
    lo, hi = 0.0, 500.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, p) < q else (lo, mid)
    return hi


def _moment_names(dims: int) -> list[str]:
    return ["n", *[f"s{i}" for i in range(dims)], *[f"q{i}_{j}" for i in range(dims) for j in range(i + 1)]]


def _concentrate(rows: DataFrame, dims: int) -> DataFrame:
    """By group and start: the moments of the nearest share of the rows (z, d2), whole cells of a histogram of
    log distances. Moments are added up by cell, so one scan gives the cut and what is inside."""
    z = [F.col("z")[i] for i in range(dims)]
    by, names = (*KEYS, "start"), _moment_names(dims)
    cell = F.least(F.floor(8 * F.log2(1 + 1000 * F.col("d2"))), F.lit(400)).cast("int").alias("cell")
    values = [F.count("*").cast("double"), *map(F.sum, z), *[F.sum(z[i] * z[j]) for i in range(dims) for j in range(i + 1)]]
    cells = rows.groupBy(*by, cell).agg(*[v.alias(c) for v, c in zip(values, names)])
    group = Window.partitionBy(*by)
    before = F.sum("n").over(group.orderBy("cell")) - F.col("n")
    inside = cells.select("*", before.alias("before"), F.sum("n").over(group).alias("total")).where(F.col("before") < SUBSET * F.col("total"))
    return inside.groupBy(*by).agg(*[F.sum(c).alias(c) for c in names])


def _estimates(sums: DataFrame, dims: int) -> DataFrame:
    """By group and start: ``logdet``, mean m0.. and the Cholesky factor c_ij of the covariance with its ridge;
    moments are shrunk to the language's, and those to everything's."""
    pairs = [(i, j) for i in range(dims) for j in range(i + 1)]
    names, by = _moment_names(dims), (*KEYS, "start")
    language = sums.groupBy("g_lang", "start").agg(*[F.sum(c).alias(f"l_{c}") for c in names])
    whole = sums.groupBy("start").agg(*[F.sum(c).alias(f"w_{c}") for c in names])
    language = language.join(F.broadcast(whole), "start")  # a row a start
    half = [F.col(f"l_{c}") + PSEUDO * F.col(f"w_{c}") / F.greatest(F.col("w_n"), F.lit(1.0)) for c in names]
    language = language.select("g_lang", "start", *[v.alias(f"l_{c}") for v, c in zip(half, names)])
    out = sums.join(language, ["g_lang", "start"]).select(*by, *[(F.col(c) + PSEUDO * F.col(f"l_{c}") / F.greatest(F.col("l_n"), F.lit(1.0))).alias(c) for c in names])
    out = out.select("*", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(dims)])
    # Consistency at the normal distribution for a subset of this share.
    scale = SUBSET / chi2_cdf(chi2_quantile(SUBSET, dims), dims + 2)
    ridge = list(VECTOR.values())
    means = [f"m{i}" for i in range(dims)]
    out = out.select(*by, *means, *[(scale * (F.col(f"q{i}_{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) + (ridge[i] ** 2 if i == j else 0.0)).alias(f"v{i}_{j}") for i, j in pairs])
    for i, j in pairs:  # row by row, so each entry needs only those before it
        rest = F.col(f"v{i}_{j}")
        for k in range(j):
            rest = rest - F.col(f"c{i}_{k}") * F.col(f"c{j}_{k}")
        out = out.withColumn(f"c{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-6))) if i == j else rest / F.col(f"c{j}_{j}"))
    logdet = sum((2 * F.log(f"c{i}_{i}") for i in range(1, dims)), 2 * F.log("c0_0"))
    return out.select(*by, logdet.alias("logdet"), *means, *[f"c{i}_{j}" for i, j in pairs])


def _by_group(rows: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(groups) if few else groups, list(KEYS))


def _distances(rows: DataFrame, model: DataFrame, dims: int, few: bool) -> DataFrame:
    """``rows`` with ``start`` and ``d2``, the squared Mahalanobis distance under each model of their group."""
    out = _by_group(rows, model, few)
    y: list[Column] = []
    for i in range(dims):
        rest = F.col("z")[i] - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"c{i}_{j}") * F.col(f"y{j}")
        out = out.withColumn(f"y{i}", rest / F.col(f"c{i}_{i}"))
        y.append(F.col(f"y{i}"))
    return out.select(*rows.columns, "start", sum((v * v for v in y[1:]), y[0] * y[0]).alias("d2"))


def _starts(rows: DataFrame, quartiles: DataFrame, dims: int, few: bool) -> DataFrame:
    """``rows`` with ``start`` and ``d2``, the first distances: from the medians in fixed scales, in scales by
    the group's quartiles, and by the farthest coordinate in those scales."""
    off = [F.col("z")[i] - F.col(f"p{i}")[1] for i in range(dims)]
    own = [(F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349 + ridge for i, ridge in enumerate(VECTOR.values())]
    fixed = [(x / ridge) ** 2 for x, ridge in zip(off, VECTOR.values())]
    scaled = [(x / w) ** 2 for x, w in zip(off, own)]
    total = lambda parts: sum(parts[1:], parts[0])
    first = F.posexplode(F.array(total(fixed), total(scaled), F.greatest(*scaled))).alias("start", "d2")
    return _by_group(rows, quartiles, few).select(*rows.columns, first)


def _least(models: DataFrame) -> DataFrame:
    """Each group's model of the least determinant, of equal ones the first start's, as start 0; ``gain`` is by
    how much its logarithm lies below that of start 0."""
    rest = [c for c in models.columns if c not in (*KEYS, "start", "logdet")]
    best = models.groupBy(*KEYS).agg(F.min(F.struct("logdet", "start", *rest)).alias("b"), F.max(F.when(F.col("start") == 0, F.col("logdet"))).alias("was"))
    return best.select(*KEYS, F.lit(0).alias("start"), "b.logdet", *[F.col(f"b.{c}").alias(c) for c in rest], (F.col("was") - F.col("b.logdet")).alias("gain"))


def estimates(stats: DataFrame) -> tuple[DataFrame, bool]:
    """The robust model of each group of ``stats`` (z, g_lang, g_source), and whether they are few."""
    dims = len(VECTOR)
    narrow = stats.select(*KEYS, "z")
    quartiles = narrow.groupBy(*KEYS).agg(*[F.percentile_approx(F.col("z")[i], [0.25, 0.5, 0.75], 1000).alias(f"p{i}") for i in range(dims)])
    quartiles = materialize(quartiles, "quartiles")
    few = quartiles.count() <= BROADCAST_GROUPS

    def step(rows: DataFrame) -> DataFrame:
        return _estimates(materialize(_concentrate(rows, dims), "moments"), dims)

    model = step(_starts(narrow, quartiles, dims, few))
    for _ in range(STEPS - 1):
        model = step(_distances(narrow, materialize(model, "mcd"), dims, few))
    model = materialize(_least(model).drop("gain"), "mcd")
    while True:
        new = step(_distances(narrow, model, dims, few)).withColumn("start", F.lit(1))
        both = materialize(_least(model.unionByName(new)), "mcd")
        model = both.drop("gain")
        if (both.agg(F.max("gain")).first()[0] or 0.0) < REST:
            return model, few


def outliers(stats: DataFrame) -> DataFrame:
    """``stats`` (with z, g_lang, g_source) plus ``d2`` under the robust estimates of the groups."""
    model, few = estimates(stats)
    return _distances(stats, model, len(VECTOR), few).drop("start")


def _group(column: str) -> Column:
    """A value as the name of a group; null has one that no value has."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", key: str = "doc_id") -> DataFrame:
    """Base counts, ``base_failed``, ``distance2`` and ``kept`` of every row."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), _group(lang).alias("g_lang"), _group(source).alias("g_source"))
    counted = base_counts(rows).select("key", *KEYS, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.array(*_vector()).alias("z"))
    stats = materialize(counted, "quality-rules")
    cutoff = chi2_quantile(1 - ALPHA, len(VECTOR))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return outliers(stats).select(
        F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("d2") <= cutoff)).alias("kept"), F.col("d2").alias("distance2"),
    )
