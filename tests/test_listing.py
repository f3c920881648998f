"""Chains of listing pages, and what an incomplete one allows."""

import pytest

from stowage.operators.reconcile import plan_mutations
from stowage.sources import listing as L

ENTRY = "<Contents><Key>{}</Key><ETag>e</ETag><Size>1</Size><LastModified>2026-01-01T00:00:00Z</LastModified></Contents>"


def page(own="", after="", keys=("k",), truncated=None, version=2, prefix="", start_after=""):
    names = ("ContinuationToken", "NextContinuationToken") if version == 2 else ("Marker", "NextMarker")
    more = bool(after) if truncated is None else truncated
    parts = [f"<{names[0]}>{own}</{names[0]}>" if own else "", f"<{names[1]}>{after}</{names[1]}>" if after else ""]
    parts += [f"<Prefix>{prefix}</Prefix>", f"<StartAfter>{start_after}</StartAfter>", f"<IsTruncated>{str(more).lower()}</IsTruncated>"]
    return f"<ListBucketResult>{''.join(parts)}{''.join(ENTRY.format(k) for k in keys)}</ListBucketResult>"


CHAIN = [page("", "a"), page("a", "b"), page("b", "c"), page("c", "d"), page("d")]
CASES = {
    "one": ([page()], None),
    "chain": (CHAIN, None),
    "shuffled": (CHAIN[::-1], None),
    "repeated": (CHAIN + [CHAIN[2]] * 2, None),
    "long": ([page(f"{i}" if i else "", f"{i + 1}" if i < 1000 else "") for i in range(1001)], None),
    "marker": ([page("", "a", version=1), page("a", version=1)], None),
    # Version 1 without a delimiter names no next marker: the last key is the next one's.
    "last key": ([page(keys=("a", "b"), truncated=True), page("b", keys=("c",), version=1)], None),
    "empty page": ([page("", "a", keys=()), page("a", keys=())], None),
    "middle lost": (CHAIN[:2] + CHAIN[3:], L.BROKEN),
    "end lost": (CHAIN[:-1], L.BROKEN),
    "start lost": (CHAIN[1:], L.NO_FIRST),
    "cursor lost": ([page(keys=(), truncated=True)], L.BROKEN),
    "two chains": (CHAIN + [page("", "x"), page("x")], L.MANY_FIRST),
    "two ends": ([*CHAIN, page("z")], L.BROKEN),
    "circle beside": ([*CHAIN, page("x", "y"), page("y", "x")], L.CIRCLE),
    "circle": ([page("", "a"), page("a", "b"), page("b", "a")], L.BROKEN),
    "fork": ([*CHAIN, page("a", "c")], L.FORK),
    "started later": ([page(start_after="m")], L.NO_FIRST),
    "prefixes": ([page("", "a", prefix="p/"), page("a", prefix="q/")], L.PREFIXES),
}


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(name, "aws", 200, body) for name, (bodies, _) in CASES.items() for body in bodies]
    rows += [("failed", "aws", 503, "<Error/>"), *[("failed", "aws", 200, body) for body in CHAIN], (None, "aws", 200, page())]
    return spark.createDataFrame(rows, "bucket_id string, upstream string, status int, body string").repartition(4)


def test_chains(pages):
    found = {r.bucket_id: r for r in L.listing_chains(pages).collect()}
    want = {name: reason for name, (_, reason) in CASES.items()} | {"failed": L.FAILED, None: None}
    assert {name: r.reason for name, r in found.items()} == want
    assert all(r.complete == (r.reason is None) for r in found.values())
    assert (found["repeated"].pages, found["repeated"].pages_read, found["failed"].pages_failed) == (5, 7, 1)
    assert found["long"].pages == 1001


def test_no_pages(pages):
    assert L.listing_chains(pages.where("false")).collect() == []


def test_runs_told_apart(spark):
    rows = [("b", run, "aws", 200, body) for run, bodies in (("r1", CHAIN), ("r2", CHAIN[:3])) for body in bodies]
    pages = spark.createDataFrame(rows, "bucket_id string, run string, upstream string, status int, body string")
    assert {r.run: r.complete for r in L.listing_chains(pages, ("bucket_id", "run")).collect()} == {"r1": True, "r2": False}
    # Told apart by nothing, what r2 has is in r1.
    assert [r.complete for r in L.listing_chains(pages).collect()] == [True]


def test_removals_need_a_complete_chain_of_their_prefix(spark):
    local = spark.createDataFrame([(f"o{b}{k}", b, k) for b in ("whole", "cut", "part", "unknown") for k in ("k", "p/gone", "z/gone")], "id string, bucket_id string, key string")
    objects = local.selectExpr("*", "parse_json('{}') AS attributes")
    bodies = {"whole": [page()], "cut": [page("", "a"), page("b")], "part": [page(keys=("p/here",), prefix="p/")]}
    pages = spark.createDataFrame([(b, "aws", 200, body) for b, found in bodies.items() for body in found], "bucket_id string, upstream string, status int, body string")
    listing = L.read_listing(pages, ("bucket_id",))
    planned = plan_mutations(listing, objects, L.listing_chains(pages)).where("action = 'remove'").collect()
    assert sorted((r.bucket_id, r.key) for r in planned) == [("part", "p/gone"), ("whole", "p/gone"), ("whole", "z/gone")]
