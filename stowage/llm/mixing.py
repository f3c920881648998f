"""Sources mixed to target weights by entropy balancing.

The mix takes each document at a rate between 0 and 2. Of all rates whose words add up to every source's target, it takes
those nearest to one by relative entropy. Their dual is convex and has one unknown per source: a document's rate is
exp(tilt * size / mean size), at most 2. The tilts are found by Newton steps, each a distributed sum over the distinct
(source, size) pairs, kept inside a bracket that every step narrows. Rates are then rounded to copies in order of size,
the error of one document carried to the next, so that a source's words stay near its target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stowage.llm.common import cut_lineage, fresh

# Weights of the sources in their order, repeating, and the share of all words that the mix asks for.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
# Documents that are rounded one after another, about; their number does not change what a source's total may miss by.
CHUNK_DOCUMENTS = 4_096
TOLERANCE = 1e-7
MOST_STEPS = 60
WORD = "[^\\x20\\x09-\\x0D]+"


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size): the words of each document."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """One row per source: number, documents, words, and the words the mix should take of it.

    Sources are ordered by code point, null last, and weighted in turn. Words are shared by weight; no source gets more
    than ``MOST_COPIES`` times its own, and what is over goes to the others by weight. A source is full exactly if its
    limit for each unit of weight is at most what the sources after it in that order get for theirs.
    """
    by_source = sized.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("size").alias("source_size"))
    # Windows over one row per source.
    number = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    rows = by_source.withColumn("source_no", number).withColumn("weight", turn)
    rows = rows.withColumn("most", F.col("source_size") * float(MOST_COPIES))
    total = F.sum("source_size").over(Window.partitionBy()) * share
    rising = Window.orderBy(F.col("most") / F.col("weight"), "source_no")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    left = total - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("unit", left / weight_left)
    open_unit = F.when(F.col("most") > F.col("unit") * F.col("weight"), F.col("unit"))
    rows = rows.withColumn("unit", F.first(open_unit, ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("most"), F.coalesce(F.col("unit") * F.col("weight"), F.col("most")))
    return rows.select("source", "source_no", "documents", "source_size", target.alias("target"))


def _rate(tilt: Column) -> Column:
    """The rate of a document of ``size`` words in a source of ``mean`` words on average."""
    return F.least(F.lit(float(MOST_COPIES)), F.exp(F.least(tilt * F.col("size") / F.col("mean"), F.lit(700.0))))


def _exact(value: Column) -> Column:
    """The sum of doubles, each to nine decimal places; it is the same in whatever order they are added up."""
    return F.sum(value.cast("decimal(38,9)")).cast("double")


def balance(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_no, tilt): the tilt at which the rates of each source's documents add up to its target.

    Sources without words have no tilt to find. The tilt of a source whose target is its limit is infinite.
    """
    pairs = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    mean = (F.col("source_size") / F.col("documents")).alias("mean")
    facts = sources.select("source", "source_no", "target", "source_size", mean)
    full = F.col("target") >= F.col("source_size") * float(MOST_COPIES) * (1 - 1e-12)
    wanted = facts.where(F.col("source_size") > 0).where(~full)
    spread = pairs.join(wanted.select("source", "source_no", "mean"), pairs["source"].eqNullSafe(wanted["source"])).select("source_no", "size", "mean", "n")
    spread = cut_lineage(spread.where("size > 0"))
    none = F.lit(None).cast("double")
    state = cut_lineage(wanted.select("source_no", "target", F.lit(0.0).alias("tilt"), none.alias("low"), none.alias("high")))
    for _ in range(MOST_STEPS):
        rate = _rate(F.col("tilt"))
        words = F.col("n") * F.col("size") * rate
        curve = F.when(rate < float(MOST_COPIES), words * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = spread.join(state.select("source_no", "tilt"), "source_no").groupBy("source_no").agg(_exact(words).alias("words"), _exact(curve).alias("curve"))
        state = cut_lineage(_newton(state.join(sums, "source_no")))
        worst = state.agg(F.max("miss")).first()[0]
        state = state.drop("miss")
        if worst is None or worst <= TOLERANCE:
            break
    found = state.select("source_no", F.round("tilt", 12).alias("tilt"))
    return found.unionByName(facts.where(F.col("source_size") > 0).where(full).select("source_no", F.lit(float("inf")).alias("tilt")))


def _newton(state: DataFrame) -> DataFrame:
    """One Newton step of each source; a step out of the bracket goes to its middle, or doubles it where it is open."""
    over = F.col("words") - F.col("target")
    low = F.when(over <= 0, F.col("tilt")).otherwise(F.col("low"))
    high = F.when(over >= 0, F.col("tilt")).otherwise(F.col("high"))
    bound = state.withColumn("miss", F.abs(over) / F.greatest("target", F.lit(1.0))).withColumn("low", low).withColumn("high", high)
    newton = F.when(F.col("curve") > 0, F.col("tilt") - over / F.col("curve"))
    inside = F.coalesce(newton > F.col("low"), newton.isNotNull()) & F.coalesce(newton < F.col("high"), newton.isNotNull())
    middle = (F.col("low") + F.col("high")) / 2
    wider = F.when(F.col("high").isNull(), F.col("tilt") + 1 + F.abs("tilt")).otherwise(F.col("tilt") - 1 - F.abs("tilt"))
    # An open side may be far off, so a Newton step goes no further than doubling would.
    least, most = F.col("tilt") - 1 - F.abs("tilt"), F.col("tilt") + 1 + F.abs("tilt")
    moved = F.when(inside, F.greatest(F.least(newton, most), least)).otherwise(F.coalesce(middle, wider))
    tilt = F.when(F.col("miss") <= TOLERANCE, F.col("tilt")).otherwise(moved)
    return bound.withColumn("tilt", tilt).select("source_no", "target", "tilt", "low", "high", "miss")


def round_copies(rated: DataFrame) -> DataFrame:
    """Turn ``rate`` into whole ``copies``: in each chunk from large to small, the error in words goes to the next.

    Rows of equal id and size are next to each other and get equal copies. Memory does not grow with a chunk.
    """
    names = ["doc_id", "source_no", "source", "size", "source_size", "target", "rate"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, last, over, copies = None, None, 0.0, 0
        for batch in batches:
            given = [batch[name].to_pylist() for name in ("source_no", "chunk", "size", "doc_id", "rate")]
            out = np.empty(batch.num_rows, dtype=np.int64)
            for at, (source_no, chunk, size, doc_id, rate) in enumerate(zip(*given)):
                if (source_no, chunk) != place:
                    place, last, over = (source_no, chunk), None, 0.0
                if (size, doc_id) != last:
                    last = (size, doc_id)
                    copies = min(MOST_COPIES, max(0, int((rate * size + over) / size + 0.5))) if size else int(rate + 0.5)
                over += (rate - copies) * size
                out[at] = copies
            yield pa.RecordBatch.from_arrays([*[batch[name] for name in names], pa.array(out)], [*names, "copies"])

    chunks = F.ceil(F.col("documents") / CHUNK_DOCUMENTS)
    chunked = rated.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), chunks).cast("int"))
    order = ["source_no", "chunk", F.desc("size"), F.asc_nulls_first("doc_id")]
    tasks = int(rated.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunked.repartition(tasks, "source_no", "chunk").sortWithinPartitions(*order)
    schema = "doc_id long, source_no int, source string, size long, source_size long, target double, rate double, copies long"
    return dealt.select(*names, "chunk").mapInArrow(run, schema)


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: size, its source's words and target, its rate, the copies and the words the mix takes.

    A null text has no words, as has an empty one; a document without words is taken once and adds none. A null source is
    a source of its own, a null id an id like others. Rows of equal id, source and size get equal copies. Reruns agree,
    however the rows are dealt out: sums are exact in any order. A very long text counts with all its words. Other columns,
    whatever their names, are not read. An empty table gives an empty table.
    """
    sized = cut_lineage(sizes(docs, id_col, text_col, source_col))
    sources = cut_lineage(targets(sized, weights, share))
    tilts = balance(sized, sources)
    tilted = cut_lineage(sources.join(tilts, "source_no", "left").withColumn("mean", F.col("source_size") / F.col("documents")))
    renamed = tilted.withColumnRenamed("source", "of")
    joined = sized.join(renamed, F.col("source").eqNullSafe(F.col("of")))
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(_rate(F.col("tilt")))
    copied = round_copies(joined.withColumn("rate", rate))
    return copied.withColumn("taken", F.col("size") * F.col("copies"))


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns, whatever their names, as they are.

    Rows are told apart by id, source and number of words, as :func:`mix` does: repeated rows, and rows of null ids that
    agree in the others, are taken equally often. A null or empty text is taken once. A very long text is taken whole, as
    often as the rate of its size says. An empty table gives an empty table.
    """
    taken = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how).where("copies > 0")
    plan = cut_lineage(taken.select("doc_id", "source", "size", "copies").distinct())
    names = {name: fresh(f"mix_{name}", docs.columns) for name in ("doc_id", "source", "size", "copies", "copy")}
    renamed = plan.select(*[F.col(name).alias(names[name]) for name in plan.columns])
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    same = (
        F.col(id_col).cast("long").eqNullSafe(F.col(names["doc_id"]))
        & F.col(source_col).cast("string").eqNullSafe(F.col(names["source"]))
        & (size == F.col(names["size"]))
    )
    # The plan grows with the documents, so it is merged at every size and never broadcast.
    copied = docs.join(renamed.hint("merge"), same).withColumn(names["copy"], F.explode(F.sequence(F.lit(1), F.col(names["copies"]))))
    return copied.select(*docs.columns)
