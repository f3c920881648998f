"""One-permutation MinHash fingerprints of word shingles, all in SQL functions.

Each shingle is hashed once. The highest bits of the hash name one of the bins, and each bin keeps its smallest hash. An
empty bin takes the value of a bin that pseudo-random probes find (optimal densification): the probes of a bin are the
same for every text, so equal occupancy gives equal donors. Of each bin the eight lowest bits are kept and packed as hex,
and the share of equal bins is corrected for those that agree by chance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stowage.llm.common import text_rows

BINS = 128
LOW_BITS = 8
WORDS = 5
# Probes of an empty bin; the bin that none of them fills takes the non-empty bin of least hash.
PROBES = 16
# Ranges of ids per shuffle partition, in which the next document is looked for.
RANGES = 4

_SHIFT = 64 - BINS.bit_length() + 1
_LOWEST = -(1 << 63)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bin(value: Column) -> Column:
    """The bin of a hash; bins rise with the signed order of the hashes."""
    return F.shiftrightunsigned(value.bitwiseXOR(F.lit(_LOWEST)), _SHIFT).cast("int")


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """The sorted hashes of all shingles of ``words`` words; fewer words are one shingle, and no words none."""

    def hashes(found: Column) -> Column:
        n = F.size(found)
        every = F.transform(F.sequence(F.lit(1), F.greatest(n - words + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(found, i, words)))
        return F.when(n > 0, every).otherwise(F.array().cast("array<bigint>"))

    split = F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda word: word != "")
    return F.sort_array(_let(split, hashes))


def bins(hashes: Column) -> Column:
    """The low bits of each bin's smallest hash, empty bins filled, as bytes; an empty array for no hashes."""

    def smallest(every: Column) -> Column:
        return F.filter(every, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(every, i - 1))))

    def dense(firsts: Column) -> Column:
        """One entry per bin, null where it is empty."""
        last = _bin(F.element_at(firsts, -1))
        gap = lambda h, i: _bin(h) - F.when(i == 0, 0).otherwise(_bin(F.get(firsts, i - 1)) + 1)
        none = F.lit(None).cast("bigint")
        runs = F.transform(firsts, lambda h, i: F.concat(F.array_repeat(none, gap(h, i)), F.array(h)))
        return F.concat(F.flatten(runs), F.array_repeat(none, BINS - 1 - last))

    def filled(firsts: Column, every: Column) -> Column:
        def entry(j: Column) -> Column:
            probes = [F.get(every, F.pmod(F.xxhash64(j, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(PROBES)]
            ranked = F.array_min(F.transform(firsts, lambda h: F.struct(F.xxhash64(j, _bin(h)).alias("rank"), h.alias("hash"))))
            return F.coalesce(F.get(every, j), *probes, ranked["hash"])

        low = lambda j: entry(j).bitwiseAND(F.lit((1 << LOW_BITS) - 1)).cast("smallint")
        return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), low)

    def packed(every: Column) -> Column:
        return _let(smallest(every), lambda firsts: _let(dense(firsts), lambda spread: filled(firsts, spread)))

    return F.when(F.size(hashes) == 0, F.array().cast("array<smallint>")).otherwise(_let(hashes, packed))


def pack(low: Column) -> Column:
    """The bins as hex digits, two to a bin."""
    return F.lower(F.array_join(F.transform(low, lambda v: F.lpad(F.hex(v), 2, "0")), ""))


def likeness(one: Column, other: Column) -> Column:
    """The estimated Jaccard similarity of two texts' shingles from their bins; texts without words are alike."""
    chance = 1.0 / (1 << LOW_BITS)
    equal = F.size(F.filter(F.zip_with(one, other, lambda a, b: a.eqNullSafe(b)), lambda same: same))
    share = (equal / F.lit(float(BINS)) - chance) / (1 - chance)
    estimated = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    nothing = (F.size(one) == 0).cast("int") + (F.size(other) == 0).cast("int")
    return F.when(nothing == 2, F.lit(1.0)).when(nothing == 1, F.lit(0.0)).otherwise(estimated)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text, low): the texts with the low bits of their bins."""
    hashed = docs.withColumn("hashes", shingle_hashes(F.col("text"), words))
    return hashed.withColumn("low", bins(F.col("hashes"))).drop("hashes")


def _range_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many bounds lie below the id, by steps first and then inside one step; a null id is in the first range."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    every = F.array(*[F.lit(b) for b in bounds])
    coarse = F.array(*[F.lit(b) for b in bounds[step - 1 :: step]])
    below = F.size(F.filter(coarse, lambda b: b < doc_id)) * step
    return below + F.size(F.filter(F.slice(every, below + 1, step), lambda b: b < doc_id))


def with_next(spark: SparkSession, docs: DataFrame, carried: list[str]) -> DataFrame:
    """``docs`` with ``next_<name>`` of the carried columns of the next document in descending order of id.

    After the last document comes the first. Ids are cut into ranges of about equal numbers of rows, and the first
    document of each range is copied to the range before it, so that one shuffle by range brings neighbours together.
    Equal ids are ordered by text, null ids come last.
    """
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / ranges for i in range(1, ranges)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 10 * ranges)).first()[0] if shares else None
    bounds = sorted(set(found or []))
    ranged = docs.withColumn("range", _range_of(F.col("doc_id"), bounds))
    # A row per range.
    firsts = {row["range"]: row["first"] for row in ranged.groupBy("range").agg(F.max("doc_id").alias("first")).collect()}
    order = sorted(firsts, reverse=True)
    copies = [(firsts[after], at) for at, after in zip(order, [*order[1:], *order[:1]])]
    copied = spark.createDataFrame(copies, "first long, copy_to int")
    joined = ranged.join(F.broadcast(copied), F.col("doc_id").eqNullSafe(F.col("first")), "left").drop("first")
    own, copy = F.struct(F.col("range"), F.lit(0).alias("copy")), F.struct(F.col("copy_to").alias("range"), F.lit(1).alias("copy"))
    places = F.when(F.col("copy_to").isNull(), F.array(own)).otherwise(F.array(own, copy))
    placed = joined.withColumn("place", F.explode(places)).drop("range", "copy_to").select("*", "place.*").drop("place")
    beside = Window.partitionBy("range").orderBy("copy", F.desc_nulls_last("doc_id"), "text")
    led = placed.select("*", *[F.lead(name).over(beside).alias(f"next_{name}") for name in carried])
    return led.where("copy = 0").drop("range", "copy")


def compare_edited(
    spark: SparkSession, docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Fingerprints of each text and of its edit by the next document's text, with how alike they are.

    A row that is first in the order of ``with_next`` may stand there several times under one id; each copy is a row of
    its own. A null or empty text has the empty fingerprint, which is like the empty one (1) and unlike any other (0). A
    single document is its own next. An empty table gives an empty table.
    """
    own = fingerprints(text_rows(docs, id_col, text_col), words)
    beside = with_next(spark, own, ["text", "low"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    kept = F.col("text").substr(F.lit(1), n - third)
    edited = F.concat(kept, F.coalesce(F.col("next_text").substr(F.lit(1), third), F.lit("")))
    changed = beside.withColumn("n_chars", n.cast("long")).withColumn("edited", edited).drop("text", "next_text")
    hashed = changed.withColumn("edited_sha256", F.sha2("edited", 256)).withColumn("hashes", shingle_hashes(F.col("edited"), words))
    both = hashed.drop("edited").withColumn("edited_low", bins(F.col("hashes"))).drop("hashes")
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        pack(F.col("low")).alias("fingerprint"),
        pack(F.col("edited_low")).alias("edited_fingerprint"),
        likeness(F.col("low"), F.col("edited_low")).alias("near_edited"),
        likeness(F.col("low"), F.col("next_low")).alias("near_next"),
    )
