"""Content hashes, verification partitions and event dedupe keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stowage.functions.text import format_rfc3339_nano

# The published FNV-1a 32-bit parameters.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
FNV_MASK = 0xFFFFFFFF

DEFAULT_PARTITIONS = 256


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def fnv1a32(text: Column) -> Column:
    """FNV-1a over the UTF-8 bytes: decoding them as Latin-1 gives one character per byte."""
    octets = F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "")
    mixed = F.aggregate(
        octets,
        F.lit(FNV_OFFSET).cast("bigint"),
        lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("bigint")) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(FNV_MASK)),
    )
    # Splitting '' yields one empty string, which would still be mixed in.
    return F.when(text == "", F.lit(FNV_OFFSET).cast("bigint")).otherwise(mixed)


def partition_index(key: Column, partitions: int = DEFAULT_PARTITIONS) -> Column:
    if partitions <= 0:
        raise ValueError("the number of partitions must be greater than zero")
    return F.pmod(fnv1a32(key), F.lit(partitions)).cast("int")


def partition_id(index: Column, partitions: int = DEFAULT_PARTITIONS) -> Column:
    """``042/256``: the index padded to the width of the largest one."""
    if partitions <= 0:
        raise ValueError("the number of partitions must be greater than zero")
    width = len(str(partitions - 1))
    return F.concat(F.lpad(index.cast("string"), width, "0"), F.lit(f"/{partitions}"))


def parse_partition_id(text: Column) -> Column:
    """Struct(index, modulus), or NULL where the text is malformed or out of range."""
    parts = F.split(text, "/")
    index, modulus = F.get(parts, 0).try_cast("bigint"), F.get(parts, 1).try_cast("bigint")
    valid = text.rlike(r"^\d+/\d+$") & (modulus > 0) & (modulus <= FNV_MASK) & (index < modulus)
    return F.when(valid, F.struct(index.alias("index"), modulus.alias("modulus")))


def dedupe_key(bucket_id: Column, event_name: Column, key: Column, event_id: Column, event_time: Column) -> Column:
    """The provider's event id where there is one, else a hash over what identifies the change."""
    named = F.concat_ws(":", bucket_id, event_name, key, event_id)
    # A notification without a time carries the zero time.
    stamp = F.coalesce(format_rfc3339_nano(event_time), F.lit("0001-01-01T00:00:00Z"))
    hashed = sha256_hex(F.concat_ws("|", bucket_id, event_name, key, stamp))
    return F.when(F.coalesce(event_id, F.lit("")) != "", named).otherwise(hashed)
