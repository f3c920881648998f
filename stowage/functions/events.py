"""Reading of storage change events: names, sources and keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stowage.functions.text import blank_to_null

# Parts of a lower-cased event name that mean an object appeared or vanished.
IMPORT_TOKENS = (
    "object created",
    "objectcreated",
    "putobject",
    "completemultipartupload",
    "copyobject",
    "object_finalize",
    "objectcreatedupload",
    "objectcreatedmultipartupload",
)
REMOVE_TOKENS = ("object deleted", "objectremoved", "deleteobject", "object_delete", "objectdeleted")

CATEGORIES = ("created", "removed", "metadata_changed", "other")

IMPORT_JOB, REFRESH_JOB, REMOVE_JOB = "import_objects", "refresh_objects", "remove_objects"


def _is_created(name: Column) -> Column:
    return name.startswith("ObjectCreated:") | name.startswith("s3:ObjectCreated:")


def _is_removed(name: Column) -> Column:
    return name.startswith("ObjectRemoved:") | name.startswith("s3:ObjectRemoved:")


def _is_metadata(name: Column) -> Column:
    return name.contains("Tagging") | name.startswith("ObjectAcl:")


def _names_any(name: Column, tokens: tuple[str, ...]) -> Column:
    """Whether the name contains one of the tokens in any case; one pattern, so the name is walked once."""
    return F.coalesce(name.rlike("(?i)" + "|".join(tokens)), F.lit(False))


def event_action(name: Column) -> Column:
    """import, remove or ignore, whatever the provider's spelling."""
    appeared, vanished = _names_any(name, IMPORT_TOKENS), _names_any(name, REMOVE_TOKENS)
    return F.when(appeared, "import").when(vanished, "remove").otherwise("ignore")


def event_category(name: Column) -> Column:
    return (
        F.when(_is_created(name), "created")
        .when(_is_removed(name), "removed")
        .when(_is_metadata(name), "metadata_changed")
        .otherwise("other")
    )


def event_job_type(name: Column, unified: bool = False) -> Column:
    """Job that applies the event, or NULL.

    By default only the prefixed spellings count, which is narrower than :func:`event_action`; ``unified`` lets the
    action decide where the prefixes do not.
    """
    strict = (
        F.when(_is_created(name), IMPORT_JOB).when(_is_removed(name), REMOVE_JOB).when(_is_metadata(name), REFRESH_JOB)
    )
    if not unified:
        return strict
    action = event_action(name)
    return F.coalesce(strict, F.when(action == "import", IMPORT_JOB).when(action == "remove", REMOVE_JOB))


def event_provider(source: Column) -> Column:
    """Sources ending in ``:s3`` speak the aws dialect, and so does everything unknown."""
    return F.when(F.lower(source) == "rustfs:s3", "rustfs").otherwise("aws")


def decode_payload(encoded: Column) -> Column:
    """Base64 text to the JSON value in it; NULL where either is malformed."""
    return F.try_parse_json(F.try_to_binary(blank_to_null(F.trim(encoded)), F.lit("base64")).cast("string"))


def decode_key(raw: Column) -> Column:
    """URL-decoded key with ``+`` read as a space; NULL where an escape is malformed."""
    malformed = raw.rlike("%(?![0-9A-Fa-f]{2})")
    return F.when(~malformed, F.try_url_decode(raw))
