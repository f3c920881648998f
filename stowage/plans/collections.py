"""Members of very many saved predicates, found through an index of the predicates.

A predicate is a table of terms that must all hold: (collection_id, path, op, text, number). Each has a key: an equality and
a numeric range if it has them, else a prefix, else a numeric range, else that a path has a value. Every object gives the
keys that it meets, and the two meet in one equi-join, so what the key decides makes no pair that is not a hit. The other
terms are columns that are checked on these pairs alone. The plan grows with the paths and operations that predicates name
and not with the predicates.

A range is a segment tree's nodes. The bounds of all ranges of a path, in order, cut the numbers into slots, a slot for each
bound and one between each two; a range covers some slots, which are at most two nodes per level, and a value is in one
node of each level. So each pair of a value and a range around it meets exactly once.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stowage.operators.predicates import FIELDS, NUMERIC, ObjectFields
from stowage.operators.scopes import starts
from stowage.session import cut_lineage

TERMS = "collection_id string, path string, op string, text string, number double"
LOWER, UPPER = (">=", ">"), ("<=", "<")
NULLS = ("is null", "is not null")
OPERATIONS = ("=", "!=", *LOWER, *UPPER, "prefix", *NULLS)
# The path of a value that every object has, for predicates that ask for none.
ANYTHING = ""


@dataclass(frozen=True)
class Term:
    """A comparison of an object's field, or of an attribute by its path, with a value."""

    path: str
    op: str
    value: str | int | float | bool | datetime | None = None

    def row(self, collection_id: str) -> tuple:
        if self.op not in OPERATIONS:
            raise ValueError(f"{self.op!r} is not an operation of saved predicates")
        text = number = None
        if isinstance(self.value, bool):
            text = str(self.value).lower()
        elif isinstance(self.value, datetime):
            number = (self.value.astimezone(timezone.utc)).timestamp()
        elif isinstance(self.value, (int, float)):
            number = float(self.value)
        else:
            text = self.value
        return collection_id, self.path, self.op, text, number


def terms_table(spark: SparkSession, predicates: Iterable[tuple[str, Sequence[Term]]]) -> DataFrame:
    """The terms of predicates that are given as such; a predicate without terms holds for every object."""
    rows = [term.row(name) for name, terms in predicates for term in (terms or [Term(ANYTHING, "is not null")])]
    return spark.createDataFrame(rows, TERMS)


def _values(objects: DataFrame, paths: Sequence[str], catalog: Mapping[str, str] | None) -> dict[str, tuple[Column, Column]]:
    """The object's value at each path, as text and as number."""
    fields = ObjectFields(objects, catalog, strict=False)
    values = {ANYTHING: (F.lit(""), F.lit(None).cast("double"))}
    for path in paths:
        if path == ANYTHING:
            continue
        operand = fields.field(path) if path in FIELDS else fields.attr(path)
        value, number = operand.column, F.lit(None).cast("double")
        if operand.type == "timestamp":
            number = F.unix_micros(value) / 1e6
        elif operand.type in NUMERIC:
            number = value.cast("double")
        values[path] = value.cast("string"), number
    return values


@dataclass(frozen=True)
class Test:
    """The terms of one path and operation that keys do not decide: a column of all predicates, null for those without."""

    path: str
    op: str
    numeric: bool

    def wanted(self, rest: str) -> Column:
        """What a predicate asks for by these terms: of bounds the tightest one, of texts and prefixes all."""
        own = F.filter(rest, lambda t: (t["path"] == self.path) & (t["op"] == self.op) & (t["number"].isNotNull() == F.lit(self.numeric)))
        if self.op in NULLS:
            return F.when(F.size(own) > 0, True)
        of = F.transform(own, lambda t: t["number"] if self.numeric else t["text"])
        if self.op in LOWER:
            return F.array_max(of)
        return F.array_min(of) if self.op in UPPER else F.when(F.size(of) > 0, of)

    def met(self, wanted: Column, text: Column, number: Column) -> Column:
        """Whether a value is as wanted; like any comparison it is not where the value is missing."""
        value = number if self.numeric else text
        found = {
            "=": lambda: (value == F.array_min(wanted)) & (value == F.array_max(wanted)),
            "!=": lambda: ~F.array_contains(wanted, value),
            ">=": lambda: value >= wanted,
            ">": lambda: value > wanted,
            "<=": lambda: value <= wanted,
            "<": lambda: value < wanted,
            "prefix": lambda: F.forall(wanted, lambda start: F.startswith(value, start)),
            "is null": lambda: text.isNull() & number.isNull(),
            "is not null": lambda: text.isNotNull() | number.isNotNull(),
        }[self.op]()
        return wanted.isNull() | F.coalesce(found, F.lit(False))


# Bounds of which a lookup compares one by one at each level, and predicates that one task makes into an index.
FAN, PREDICATES = 1 << 4, 1 << 12


class Bounds:
    """The sorted bounds of a path's ranges, as constants of the plan, and the slots that they cut the numbers into."""

    def __init__(self, numbers: Sequence[float]):
        self.count = len(numbers)
        # The last of every FAN bounds, the last of every FAN of those, and so on, the fewest first.
        steps = [list(numbers)]
        while len(steps[0]) > FAN:
            steps.insert(0, steps[0][FAN - 1 :: FAN])
        self.steps, self.last = F.array(*[self._constant(step) for step in steps]), len(steps) - 1
        # Slots are numbered from 0 to twice the count.
        self.slots = 2 * self.count + 1
        self.levels = self.slots.bit_length()

    @staticmethod
    def _constant(numbers: Sequence[float]) -> Column:
        # One literal: a text to be read would be read for every value.
        return F.lit(np.array(numbers, dtype=np.float64)) if len(numbers) else F.array().cast("array<double>")

    def slot(self, value: Column) -> Column:
        """The slot of a number: of the bounds below it, those of one step say which FAN of the next to look at."""

        def closer(below: Column, step: Column) -> Column:
            return below * FAN + F.size(F.filter(F.slice(step, below * FAN + 1, F.lit(FAN)), lambda bound: bound < value))

        def placed(below: Column) -> Column:
            at_bound = F.get(F.get(self.steps, F.lit(self.last)), below) == value
            return (2 * below + F.coalesce(at_bound, F.lit(False)).cast("int")).cast("long")

        return F.aggregate(self.steps, F.lit(0), closer, placed)

    def end(self, after: str):
        """The slot of a bound, or the one after it where the operation is ``after``."""
        return lambda term: self.slot(term["number"]) + (term["op"] == after).cast("int")


def _nodes(first: Column, after: Column, levels: int) -> Column:
    """The nodes, as (level, node), that make up the slots from ``first`` to before ``after``."""

    def level(at: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1).cast("long"), at)
        low, high = F.ceil(first / width), F.floor(after / width)
        left = F.when((low % 2 == 1) & (low < high), F.struct(at.alias("level"), low.alias("node")))
        right = F.when((high % 2 == 1) & (low + low % 2 < high), F.struct(at.alias("level"), (high - 1).alias("node")))
        return F.array(left, right)

    every = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), level))
    return F.filter(every, lambda node: node.isNotNull())


def _node_of(slot: Column):
    """The node of each level that a slot is in."""
    return lambda level: F.struct(level.alias("level"), F.call_function("shiftright", slot, level).alias("node"))


def _keyed(terms: DataFrame) -> DataFrame:
    """(collection_id, kind, path, text, ranged, bounds, rest): the key of each predicate that an object can meet, and the
    terms that the key does not decide."""
    bounded = F.col("op").isin(*LOWER, *UPPER) & F.col("number").isNotNull()
    rank = F.when(F.col("op") == "=", 0).when(F.col("op") == "prefix", 1).when(bounded, 2).when(F.col("op") == "is null", 4).otherwise(3)
    # Nothing meets a comparison with no value, nor an operation that is none.
    without = F.col("text").isNull() & (F.col("number").isNull() | (F.col("op") == "prefix"))
    vain = F.coalesce(~F.col("op").isin(*OPERATIONS) | (~F.col("op").isin(*NULLS) & without), F.lit(True))
    term = F.struct(rank.alias("rank"), "path", "op", "text", "number")
    # A predicate's terms are what somebody has written down.
    grouped = terms.where("collection_id IS NOT NULL").groupBy("collection_id").agg(F.array_sort(F.collect_set(term)).alias("terms"), F.max(vain).alias("vain"))
    first, is_bound = F.get("terms", 0), lambda t: t["rank"] == 2
    ranged = F.when(first["rank"].isin(0, 2), F.get(F.filter("terms", is_bound), 0)["path"])
    keyed = grouped.where("NOT vain").select("collection_id", "terms", first.alias("first"), ranged.alias("ranged"))
    rank, number = F.col("first.rank"), F.col("first.number")
    kind = F.when((rank == 0) & number.isNotNull(), "#").when(rank == 0, "=").when(rank == 1, "^").when(rank == 2, "").otherwise("*")
    path = F.when(rank.isin(2, 4), F.lit(ANYTHING)).otherwise(F.col("first.path"))
    text = F.when(rank > 1, F.lit("")).when((rank == 0) & number.isNotNull(), number.cast("string")).otherwise(F.col("first.text"))
    decided = lambda t: F.coalesce(is_bound(t) & (t["path"] == F.col("ranged")), F.lit(False))
    # The first term of the set is decided too if the key holds its value.
    rest = F.filter(F.when(rank < 2, F.slice("terms", 2, F.size("terms"))).otherwise(F.col("terms")), lambda t: ~decided(t))
    return keyed.select("collection_id", kind.alias("kind"), path.alias("path"), text.alias("text"), "ranged", F.filter("terms", decided).alias("bounds"), rest.alias("rest"))


# A key: the shape of a predicate's key, and a text and a node of a range for the shapes that have them.
KEY = ["shape", "text", "level", "node"]
# Objects, and predicates, of one key that are compared as one piece of work, and pairs for which there is a task.
CHUNK, TASK_PAIRS = 1 << 10, 1 << 20


def _no_node() -> Column:
    return F.struct(F.lit(0).alias("level"), F.lit(0).cast("long").alias("node"))


def _key(shape: int, text: Column, level: Column, node: Column) -> Column:
    return F.struct(F.lit(shape).alias("shape"), text.alias("text"), level.cast("int").alias("level"), node.cast("long").alias("node"))


def _text_key(shape: int):
    return lambda text: _key(shape, text, F.lit(0), F.lit(0))


def _node_key(shape: int, text: Column):
    return lambda node: _key(shape, text, node["level"], node["node"])


def indexed_members(objects: DataFrame, terms: DataFrame, catalog: Mapping[str, str] | None = None) -> DataFrame:
    """(collection_id, object_id) for every predicate of ``terms`` that an object meets.

    Numbers are compared as doubles, times in seconds; an attribute is a number or a time if ``catalog`` says so. Text is
    compared by bytes. A path without a predicate is not read. What is collected are paths, prefix lengths, and the distinct
    bounds of ranges, eight bytes each, which are constants of the plan. Keys and their numbers are written once.
    """
    keyed = cut_lineage(_keyed(terms))
    used = keyed.groupBy("kind", "path", "ranged").agg(F.collect_set(F.length("text")).alias("lengths")).collect()
    shapes = sorted(((row["kind"], row["path"], row["ranged"]) for row in used), key=lambda shape: (*shape[:2], shape[2] or "", shape[2] is not None))
    lengths = {row["path"]: sorted(row["lengths"]) for row in used if row["kind"] == "^"}
    left = keyed.select(F.explode("rest").alias("t")).select("t.path", "t.op", F.col("t.number").isNotNull().alias("numeric")).distinct().collect()
    tests = [Test(*row) for row in sorted(left)]
    cuts = keyed.select("ranged", F.explode("bounds.number").alias("number")).distinct().collect()
    ranged = sorted({row["ranged"] for row in cuts})
    bounds = {path: Bounds(sorted(row["number"] for row in cuts if row["ranged"] == path)) for path in ranged}

    paths = sorted({path for _, path, _ in shapes} | {test.path for test in tests} | set(ranged))
    values = _values(objects, paths, catalog)
    known = objects.select(F.col("id").alias("object_id"), *[c.alias(f"_{kind}{at}") for at, path in enumerate(paths) for kind, c in zip("tn", values[path])])
    place = {path: at for at, path in enumerate(paths)}
    text, number = (lambda path: F.col(f"_t{place[path]}")), (lambda path: F.col(f"_n{place[path]}"))
    # A slot is a column of its own, so that it is looked up once.
    slots = {path: f"_slot{at}" for at, path in enumerate(ranged)}
    rows = known.withColumns({slots[path]: F.when(number(path).isNotNull(), bounds[path].slot(number(path))) for path in ranged}) if ranged else known

    none = F.array().cast("array<struct<shape:int,text:string,level:int,node:bigint>>")
    lists = []
    for shape, (kind, path, range_path) in enumerate(shapes):
        whole = {"=": lambda: text(path), "#": lambda: number(path).cast("string"), "*": lambda: F.when(text(path).isNotNull() | number(path).isNotNull(), ""), "": lambda: F.lit("")}
        if kind == "^":
            found = F.transform(starts(text(path), lengths[path]), _text_key(shape))
        elif range_path is None:
            found = F.when(whole[kind]().isNotNull(), F.array(_text_key(shape)(whole[kind]())))
        else:
            slot = F.col(slots[range_path])
            up = F.transform(F.sequence(F.lit(0), F.lit(bounds[range_path].levels)), _node_of(slot))
            found = F.when(slot.isNotNull() & whole[kind]().isNotNull(), F.transform(up, _node_key(shape, whole[kind]())))
        lists.append(F.coalesce(found, none))
    tested = sorted({f"_{kind}{place[test.path]}" for test in tests for kind in "tn"})
    rows = rows.select("object_id", *tested, F.explode(F.concat(*lists) if lists else none).alias("_key")).select("object_id", *tested, "_key.*")

    # A lower bound starts at its own slot or after it, an upper one ends before or after it.
    numbered = F.lit(None).cast("int")
    for shape, (kind, path, range_path) in enumerate(shapes):
        same = (F.col("kind") == kind) & (F.col("path") == path) & F.col("ranged").eqNullSafe(F.lit(range_path))
        numbered = F.when(same, shape).otherwise(numbered)
    low, high = F.lit(0).cast("long"), F.lit(0).cast("long")
    for path in ranged:
        of = bounds[path]
        starts_at = F.array_max(F.transform(F.filter("bounds", lambda t: t["op"].isin(*LOWER)), of.end(">")))
        ends_at = F.array_min(F.transform(F.filter("bounds", lambda t: t["op"].isin(*UPPER)), of.end("<=")))
        low = F.when(F.col("ranged") == path, F.coalesce(starts_at, F.lit(0).cast("long"))).otherwise(low)
        high = F.when(F.col("ranged") == path, F.coalesce(ends_at, F.lit(of.slots).cast("long"))).otherwise(high)
    levels = max((of.levels for of in bounds.values()), default=0)
    nodes = F.when(F.col("ranged").isNull(), F.array(_no_node())).otherwise(_nodes(F.col("_low"), F.col("_high"), levels))
    wanted = [test.wanted("rest").alias(f"_wanted{at}") for at, test in enumerate(tests)]
    # The ends are columns of their own too. A predicate without much text is much work here, so rows tell the tasks.
    dealt = keyed.repartition(1 + keyed.count() // PREDICATES)
    ends = dealt.select("collection_id", "ranged", "text", "rest", numbered.alias("shape"), low.alias("_low"), high.alias("_high"))
    index = ends.select("collection_id", *wanted, "shape", "text", F.explode(nodes).alias("_node"))
    index = cut_lineage(index.select("collection_id", *[f"_wanted{at}" for at in range(len(tests))], "shape", "text", F.col("_node.level").cast("int").alias("level"), F.col("_node.node").cast("long").alias("node")))

    rows = cut_lineage(rows.join(index.select(*KEY), KEY, "left_semi").select("object_id", *tested, *KEY))
    hits = _meetings(rows, index)
    met = F.lit(True)
    for at, test in enumerate(tests):
        met = met & test.met(F.col(f"_wanted{at}"), text(test.path), number(test.path))
    return hits.where(met).select("collection_id", "object_id")


def _meetings(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Each of ``rows`` with each of ``index`` of the same key.

    A key of very many objects and predicates is a grid of pieces: an object goes to the pieces of its row and a predicate to
    those of its column, so no task has more than a few pieces, and few rows are sent for the pairs that come of them.
    """
    per_key = [side.groupBy(*KEY).agg(F.count(F.lit(1)).alias(name)) for side, name in ((rows, "_objects"), (index, "_predicates"))]
    counted = cut_lineage(per_key[0].join(per_key[1], KEY))
    total = counted.agg(F.sum(F.col("_objects").cast("double") * F.col("_predicates"))).first()[0] or 0
    tasks = 1 + int((total + counted.agg(F.sum(F.col("_objects") + F.col("_predicates"))).first()[0]) // TASK_PAIRS) if total else 1
    pieces = lambda n: F.ceil(F.col(n) / CHUNK).cast("int")
    large = cut_lineage(
        counted.where((F.col("_objects") > CHUNK) | (F.col("_predicates") > CHUNK)).select(*KEY, pieces("_objects").alias("_down"), pieces("_predicates").alias("_across"))
    )

    def placed(side: DataFrame, name: str, own: str, own_pieces: str, other: str, other_pieces: str) -> DataFrame:
        cut = side.join(large, KEY, "left")
        mine = F.pmod(F.xxhash64(name), F.coalesce(own_pieces, F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(other_pieces, F.lit(1)) - 1))
        return cut.select(*side.columns, mine.alias(own), every.alias(other)).repartition(tasks, *KEY, "_piece_down", "_piece_across")

    down = placed(rows, "object_id", "_piece_down", "_down", "_piece_across", "_across")
    across = placed(index, "collection_id", "_piece_across", "_across", "_piece_down", "_down")
    return down.join(across, [*KEY, "_piece_down", "_piece_across"])
