"""Quality rules and robust multivariate outliers, all in SQL functions.

Fixed rules come first: too few words, or too many of them in repeated windows. Of what is left, each language and source
gets a minimum-covariance-determinant estimate of the documents' transformed statistics: the centre and covariance of the
three quarters of the documents that lie closest together. It is found by concentration steps from two starts; a step
keeps the documents nearest to the current centre, by Mahalanobis distance, and estimates anew from them. A document far
from the centre of its group is rejected.

A step is one grouped sum: distances are binned finely on a logarithmic scale, counts and sums of products are added up
per bin, and the bins up to the one that completes the three quarters make the next estimate. Statistics are whole
numbers of thousandths, so sums are exact in any order and reruns agree. Only groups go on that the last step improved.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stowage.llm.common import cut_lineage

WINDOW = 8
MIN_WORDS, REPEAT_PERCENT = 20, 30

# The statistics' names and their least standard deviations, below which no difference counts as one.
STATISTICS = {"x_words": 0.5, "x_length": 0.05, "x_symbols": 0.05, "x_lines": 0.15, "x_repeats": 0.15}
UNITS = 1024
# Share of a group's documents that an estimate rests on. The share of a normal distribution's variance that five
# dimensions keep within it, 0.5311, makes the factor 0.75 / 0.5311.
CORE, CONSISTENT = 0.75, 1.4121
# Squared distance from which a document is an outlier: one in 100,000 of a normal distribution of five dimensions.
CUTOFF = 30.86
# Documents that a group must have for an estimate of its own; those of smaller groups are pooled by language.
MIN_GROUP = 50
# A step must lower the logarithm of the determinant by this much, or the group is done.
GAIN = 1e-3
# Groups that are broadcast, with their estimates some 10 MB.
FEW_GROUPS = 20_000
# Distance bins per doubling.
BINS = 16

_WHITE = " \t\n\x0b\x0c\r"
_SYMBOLS = "[#*$%&|<>]+"
_NAMES = list(STATISTICS)
_PAIRS = [(i, j) for i in range(len(_NAMES)) for j in range(i + 1)]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words between ASCII white space, as they are."""
    trimmed = F.btrim(text, F.lit(_WHITE))
    return F.when(trimmed != "", F.split(trimmed, "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))


def repeated_words(found: Column, width: int = WINDOW) -> Column:
    """How many of the words are in a window of ``width`` words that is found twice or more, its first place included.

    Windows are compared by 64-bit hashes.
    """

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(every: Column) -> Column:
            again = lambda p, k: (p["h"] == F.get(every, k - 1)["h"]) | (p["h"] == F.get(every, k + 1)["h"])
            return F.sort_array(F.transform(F.filter(every, lambda p, k: F.coalesce(again(p, k), F.lit(False))), lambda p: p["i"]))

        def added(at: Column) -> Column:
            fresh = F.transform(at, lambda x, k: F.coalesce(F.least(F.lit(width), x - F.get(at, k - 1)), F.lit(width)))
            return F.aggregate(fresh, F.lit(0).cast("long"), lambda total, n: total + n)

        return _let(_let(placed, places), added)

    n = F.size(found)
    every = F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(F.slice(found, i, width)))
    twice = lambda hashes: F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered(hashes)).otherwise(0)
    return F.when(n > width, _let(every, twice)).otherwise(0).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the statistics of ``text`` in place of it, and ``base_failed``."""
    text = F.col("text")
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    chars = lambda found: F.length(F.array_join(found, "")).cast("long")
    counted = _let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), chars(w).alias("chars"), repeated_words(w).alias("again")))
    told = _let(lines, lambda found: F.struct(F.size(found).alias("n"), F.size(F.array_distinct(found)).alias("distinct")))
    # Symbols are rare, so cutting them out is little more than looking for them.
    n_symbols = F.length(text) - F.length(F.regexp_replace(text, _SYMBOLS, ""))
    measured = docs.select(
        *[c for c in docs.columns if c != "text"],
        counted.alias("counted"),
        told.alias("told"),
        n_symbols.cast("long").alias("n_symbols"),
    )
    n_words, again = F.col("counted.n"), F.col("counted.again")
    return measured.withColumns(
        {
            "n_words": n_words,
            "word_chars": F.col("counted.chars"),
            "n_dup_lines": (F.col("told.n") - F.col("told.distinct")).cast("long"),
            "n_lines": F.col("told.n").cast("long"),
            "n_repeat_words": again,
            "base_failed": (n_words < MIN_WORDS) | (100 * again > REPEAT_PERCENT * n_words),
        }
    ).drop("counted", "told")


def transformed(measured: DataFrame) -> DataFrame:
    """``measured`` with the vector: logarithms of counts, square roots of shares, in whole ``UNITS``."""
    share = lambda part, whole: F.sqrt(F.col(part) / F.greatest(F.col(whole), F.lit(1)))
    values = {
        "x_words": F.log(1.0 + F.col("n_words")),
        "x_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        "x_symbols": share("n_symbols", "word_chars"),
        "x_lines": share("n_dup_lines", "n_lines"),
        "x_repeats": share("n_repeat_words", "n_words"),
    }
    return measured.withColumns({name: F.round(UNITS * values[name]).cast("long") for name in _NAMES})


def _factored(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` with the inverse Cholesky factor ``f_i_j`` of the covariances ``c_i_j``, and ``log_det``."""
    size = range(len(_NAMES))
    dot = lambda parts: " - ".join(["", *parts])
    # The lower factor by columns, each from those before it.
    for j in size:
        under = dot(f"l_{j}_{k} * l_{j}_{k}" for k in range(j))
        rows = rows.withColumn(f"l_{j}_{j}", F.expr(f"sqrt(greatest(c_{j}_{j}{under}, 1e-12D))"))
        below = {f"l_{i}_{j}": f"(c_{i}_{j}{dot(f'l_{i}_{k} * l_{j}_{k}' for k in range(j))}) / l_{j}_{j}" for i in size[j + 1 :]}
        rows = rows.withColumns({name: F.expr(value) for name, value in below.items()})
    # Its inverse by forward substitution, row by row.
    for i in size:
        row = {f"f_{i}_{j}": f"({float(i == j)}D{dot(f'l_{i}_{k} * f_{k}_{j}' for k in range(j, i))}) / l_{i}_{i}" for j in range(i + 1)}
        rows = rows.withColumns({name: F.expr(value) for name, value in row.items()})
    log_det = " + ".join(f"2 * ln(l_{i}_{i})" for i in size)
    return rows.select(*keep, *[f"f_{i}_{j}" for i, j in _PAIRS], F.expr(log_det).alias("log_det"))


def _squared_distance() -> Column:
    """The squared Mahalanobis distance of the vector from the means ``m_i`` by the inverse factor."""
    off = [f"({name} / {float(UNITS)}D - m_{i})" for i, name in enumerate(_NAMES)]
    turned = [" + ".join(f"f_{i}_{j} * {off[j]}" for j in range(i + 1)) for i in range(len(off))]
    return F.expr(" + ".join(f"pow({z}, 2)" for z in turned))


_MEANS = [f"m_{i}" for i in range(len(_NAMES))]
_CENTRES = [f"centre_{i}" for i in range(len(_NAMES))]
_ESTIMATE = [*_MEANS, *[f"f_{i}_{j}" for i, j in _PAIRS], "log_det"]
_GROUP = ["lang", "source"]


def _small(groups: DataFrame) -> DataFrame:
    """``groups`` for a join with documents: sent to all tasks if they are few, so that no document moves to its group.

    More than ``FEW_GROUPS`` are joined by a shuffle, in which Spark splits a group that is large.
    """
    return F.broadcast(groups) if groups.count() <= FEW_GROUPS else groups


def _of_group(rows: DataFrame, groups: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their language and source; a null is a value of its own."""
    named = _small(groups).withColumnsRenamed({name: f"of_{name}" for name in _GROUP})
    same = [F.col(name).eqNullSafe(F.col(f"of_{name}")) for name in _GROUP]
    return rows.join(named, same[0] & same[1], how).drop(*[f"of_{name}" for name in _GROUP])


def _groups(good: DataFrame) -> DataFrame:
    """(lang, source, group): groups of at least ``MIN_GROUP`` documents, small sources pooled by language."""
    sizes = good.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n"))
    own = F.to_json(F.struct(*_GROUP, F.lit(False).alias("pooled")))
    pooled = F.to_json(F.struct("lang", F.lit(True).alias("pooled")))
    named = sizes.withColumn("group", F.when(F.col("n") >= MIN_GROUP, own).otherwise(pooled))
    return cut_lineage(named.select(*_GROUP, "group"))


def _centres(grouped: DataFrame) -> DataFrame:
    """Per group its size, and of each statistic the median and the spread that a normal one's quartiles have.

    Values are at most some thousand sixteenths here, so the exact quantiles hold few of them.
    """
    found = grouped.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.percentile(F.round(F.col(name) * 16 / UNITS), [0.25, 0.5, 0.75]).alias(f"q_{i}") for i, name in enumerate(_NAMES)],
    )
    floors = list(STATISTICS.values())
    at = lambda i, k: F.get(f"q_{i}", F.lit(k)) / 16
    columns = [F.round(at(i, 1) * UNITS).cast("long").alias(f"centre_{i}") for i in range(len(floors))]
    spreads = [F.sqrt(((at(i, 2) - at(i, 0)) / 1.349) ** 2 + floor**2).alias(f"spread_{i}") for i, floor in enumerate(floors)]
    return cut_lineage(found.where(F.col("n") >= MIN_GROUP).select("group", "n", *columns, *spreads))


def _starts(grouped: DataFrame, centres: DataFrame) -> DataFrame:
    """Two estimates per group around its medians: independent spreads, and the covariance of the directions."""
    size = range(len(_NAMES))
    means = [(F.col(f"centre_{i}") / UNITS).alias(f"m_{i}") for i in size]
    spread = lambda i, j: F.col(f"spread_{i}") * F.col(f"spread_{j}")
    apart = centres.select("group", *means, *[(spread(i, j) if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in _PAIRS])
    beside = grouped.join(_small(centres), "group")
    off = [(F.col(name) - F.col(f"centre_{i}")) / UNITS / F.col(f"spread_{i}") for i, name in enumerate(_NAMES)]
    scaled = beside.select("group", *[x.alias(f"u_{i}") for i, x in enumerate(off)])
    squares = F.greatest(sum((F.col(f"u_{i}") ** 2 for i in size), F.lit(0.0)), F.lit(1e-9))
    # Directions are summed in whole millionths, so their sums too are exact in any order.
    products = [F.sum(F.round(F.col(f"u_{i}") * F.col(f"u_{j}") / F.col("squares") * 1e6).cast("long")).alias(f"p_{i}_{j}") for i, j in _PAIRS]
    turned = scaled.withColumn("squares", squares).groupBy("group").agg(*products).join(centres, "group")
    floors = list(STATISTICS.values())
    together = lambda i, j: len(floors) * spread(i, j) * F.col(f"p_{i}_{j}") / 1e6 / F.col("n")
    directed = turned.select("group", *means, *[(together(i, j) + (floors[i] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}") for i, j in _PAIRS])
    starts = apart.withColumn("start", F.lit(0)).unionByName(directed.withColumn("start", F.lit(1)))
    factored = _factored(starts, ["group", "start", *_MEANS])
    # Nothing is compared with the determinant of a start, which rests on other documents.
    return factored.withColumn("log_det", F.lit(float("inf"))).withColumn("active", F.lit(True))


def _step(grouped: DataFrame, centres: DataFrame, state: DataFrame) -> DataFrame:
    """The estimates of each group's nearest three quarters of documents by the active estimates of ``state``."""
    active = centres.select("group", "n", *_CENTRES).join(state.where("active").drop("active", "log_det"), "group")
    near = grouped.join(_small(cut_lineage(active)), "group")
    off = [(F.col(name) - F.col(f"centre_{i}")).alias(f"d_{i}") for i, name in enumerate(_NAMES)]
    binned = near.select("group", "start", "n", *off, F.floor(BINS * F.log2(_squared_distance() + 2.0**-10)).alias("bin"))
    sums = [F.sum(f"d_{i}").alias(f"s_{i}") for i in range(len(off))]
    products = [F.sum(F.col(f"d_{i}") * F.col(f"d_{j}")).alias(f"s_{i}_{j}") for i, j in _PAIRS]
    summed = binned.groupBy("group", "start", "n", "bin").agg(F.count(F.lit(1)).alias("k"), *sums, *products)
    # A group has some hundred bins at most.
    nearer = Window.partitionBy("group", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    core = summed.withColumn("before", F.coalesce(F.sum("k").over(nearer), F.lit(0))).where(F.col("before") < F.ceil(CORE * F.col("n")))
    names = ["k", *[f"s_{i}" for i in range(len(off))], *[f"s_{i}_{j}" for i, j in _PAIRS]]
    total = core.groupBy("group", "start").agg(*[F.sum(name).alias(name) for name in names]).join(centres.select("group", *_CENTRES), "group")
    mean = lambda i: F.col(f"s_{i}") / F.col("k")
    floors = list(STATISTICS.values())
    covariance = lambda i, j: CONSISTENT * (F.col(f"s_{i}_{j}") / F.col("k") - mean(i) * mean(j)) / UNITS**2
    estimated = cut_lineage(total).select(
        "group",
        "start",
        *[((F.col(f"centre_{i}") + mean(i)) / UNITS).alias(f"m_{i}") for i in range(len(off))],
        *[(covariance(i, j) + (floors[i] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}") for i, j in _PAIRS],
    )
    return _factored(estimated, ["group", "start", *_MEANS])


def estimates(grouped: DataFrame) -> DataFrame:
    """Per group the estimate of least determinant: means ``m_i``, the inverse factor ``f_i_j`` and ``log_det``.

    Every step that is kept lowers a determinant that the least deviations bound from below, so the steps end.
    """
    centres = _centres(grouped)
    state = cut_lineage(_starts(grouped, centres))
    while state.where("active").limit(1).count():
        found = _step(grouped, centres, state).withColumnsRenamed({name: f"new_{name}" for name in _ESTIMATE})
        better = F.coalesce(F.col("new_log_det") < F.col("log_det") - GAIN, F.lit(False))
        chosen = [F.when(better, F.col(f"new_{name}")).otherwise(F.col(name)).alias(name) for name in _ESTIMATE]
        state = cut_lineage(state.join(found, ["group", "start"], "left").select("group", "start", *chosen, better.alias("active")))
    best = state.groupBy("group").agg(F.min_by(F.struct(*_ESTIMATE), F.struct("log_det", "start")).alias("best"))
    return cut_lineage(best.select("group", "best.*"))


def judge(
    docs: DataFrame, cutoff: float = CUTOFF, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """One row per document: its statistics, ``base_failed``, its squared ``distance`` in its group, and ``kept``.

    A document is kept if it passes the fixed rules and its distance is at most ``cutoff``. Sources with fewer than
    ``MIN_GROUP`` documents of a language that pass the rules are one group of that language; where that too is smaller,
    there is no estimate, the distance is null and only the fixed rules decide. A null language or source is a value of
    its own. A null or empty text has no words and fails. Texts of any length are taken whole; their windows and lines
    are arrays of one row. Repeated rows and rows of equal distance are judged alike, null ids as any other. Other
    columns, whatever their names, are not read. An empty table gives an empty table.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    measured = cut_lineage(transformed(statistics(rows)))
    good = measured.where(~F.col("base_failed")).select(*_GROUP, *_NAMES)
    groups = _groups(good)
    grouped = cut_lineage(_of_group(good, groups).select("group", *_NAMES))
    found = cut_lineage(groups.join(estimates(grouped), "group").select(*_GROUP, *_ESTIMATE))
    placed = _of_group(measured, found, "left").withColumn("distance", _squared_distance())
    near = F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return placed.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & near).alias("kept"), "distance", *_GROUP
    )
