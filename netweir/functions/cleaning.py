"""Label, time, protocol and unit expressions for raw flow tables (session time zone UTC)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from netweir.functions import contract
from netweir.functions.numbers import NUMBER_TEXT, finite

CLOCK_TEXT = r"^\s*\d+/\d+/\d+ +(\d+):\d+(:\d+)?\s*$"
ZONE_SUFFIX = r"(Z|[+-]\d{2}:?\d{2}(:?\d{2})?)$"
ISO_TEXT = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def clean_label(label: Column) -> Column:
    """The dash some files store as byte 0x96 becomes '-', surrounding space goes."""
    return F.trim(F.replace(label.cast("string"), F.lit("\x96"), F.lit("-")))


def clock_hour(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, CLOCK_TEXT, 1), F.lit("")).try_cast("int")


def repair_12h_timestamp(text: Column, strict: bool = False) -> Column:
    """Time of a ``d/m/yyyy H:MM[:SS]`` text whose clock ran 8 to 5 without AM or PM.

    Hours 1 to 5 are afternoon. Hours 6 and 7 and those outside 1..12 cannot be told
    apart: null, or an error when ``strict``.
    """
    hour = clock_hour(text)
    trimmed = F.trim(text)
    parsed = F.coalesce(F.try_to_timestamp(trimmed, F.lit("d/M/yyyy H:m:s")),
                        F.try_to_timestamp(trimmed, F.lit("d/M/yyyy H:m")))
    known = hour.between(1, 5) | hour.between(8, 12)
    value = F.when(hour <= 5, parsed + F.expr("INTERVAL 12 HOURS")).otherwise(parsed)
    if not strict:
        return F.when(known, value)
    problem = F.concat(F.lit("hour of day cannot be told: "), text)
    return F.when(known & parsed.isNotNull(), value).otherwise(
        F.raise_error(problem).cast("timestamp"))


def parse_timestamp(value: Column, zone: str | None = None, assume_utc: bool = True) -> Column:
    """Instant of a text in ISO form, one of the capture formats, or epoch seconds.

    A text without an offset is placed in ``zone``, else in UTC, else it is null.
    """
    text = F.trim(value.cast("string"))
    aware = text.rlike(ISO_TEXT) & text.rlike(ZONE_SUFFIX) & ~text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    iso = F.when(text.rlike(ISO_TEXT), F.replace(text, F.lit(","), F.lit(".")).try_cast("timestamp"))
    compact = F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
    listed = [F.try_to_timestamp(text, F.lit(f)) for f in contract.CAPTURE_TIME_FORMATS]
    naive = F.coalesce(iso, compact, *listed)
    if zone:
        naive = F.to_utc_timestamp(naive, F.lit(zone))
    elif not assume_utc:
        naive = F.lit(None).cast("timestamp")
    seconds = F.when(text.rlike(NUMBER_TEXT), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
    in_range = (seconds >= -62135596800) & (seconds < 253402300800)
    epoch = F.timestamp_micros(F.when(in_range, F.bround(seconds * 1000000).cast("long")))
    return F.when(aware, iso).when(naive.isNotNull(), naive).when(
        F.coalesce(iso, compact, *listed).isNull(), epoch)


def protocol_name(number: Column) -> Column:
    """Name of a protocol number, the number itself for others, UNKNOWN for non-numbers."""
    value = F.when(F.trim(number.cast("string")).rlike(NUMBER_TEXT),
                   number.cast("string").try_cast("double"))
    whole = finite(value).try_cast("int")
    names = F.create_map(*[F.lit(x) for kv in contract.PROTOCOL_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, whole), whole.cast("string"), F.lit("UNKNOWN"))


def to_int(number: Column, default: int = 0) -> Column:
    value = F.when(F.trim(number.cast("string")).rlike(NUMBER_TEXT),
                   number.cast("string").try_cast("double"))
    return F.coalesce(finite(value).try_cast("int"), F.lit(default))


def first_present(columns: list[Column]) -> Column:
    return reduce(lambda a, b: F.coalesce(a, b), columns)
