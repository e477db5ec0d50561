"""Scalar functions as columns: validators, names, identifiers, numbers, tiles."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def non_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def number(text: Column) -> Column:
    """Whole number, 0 if it is none."""
    return F.coalesce(F.try_to_number(text, F.lit("999999999")).cast("int"), F.lit(0))


def part(text: Column, at: int, size: int) -> Column:
    return F.coalesce(F.substring(text, at, size).try_cast("int"), F.lit(0))


def is_leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def days_in_month(year: Column, month: Column) -> Column:
    return F.when(month == 2, F.when(is_leap(year), 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).when(month.between(1, 12), 31).otherwise(0)


def valid_date(year: Column, month: Column, day: Column) -> Column:
    return (year > 0) & month.between(1, 12) & (day >= 1) & (day <= days_in_month(year, month))


def valid_da(text: Column) -> Column:
    """YYYYMMDD that is in the calendar; empty is valid."""
    return (text == "") | (text.rlike("^[0-9]{8}$") & valid_date(part(text, 1, 4), part(text, 5, 2), part(text, 7, 2)))


def valid_tm(text: Column) -> Column:
    """HH[MM[SS[.F]]] with one to six digits of fraction; empty is valid."""
    shape = text.rlike(r"^[0-9]{2}([0-9]{2}([0-9]{2}(\.[0-9]{1,6})?)?)?$")
    return (text == "") | (shape & (part(text, 1, 2) <= 23) & (part(text, 3, 2) <= 59) & (part(text, 5, 2) <= 59))


def valid_dt(text: Column) -> Column:
    """YYYY[MM[DD[HH[MM[SS[.F]]]]]] with an optional zone of at most 14 hours; empty is valid."""
    shape = text.rlike(r"^[0-9]{4}([0-9]{2}([0-9]{2}([0-9]{2}([0-9]{2}([0-9]{2}(\.[0-9]{1,6})?)?)?)?)?)?([+-][0-9]{4})?$")
    main, zone = F.regexp_extract(text, "^[0-9]*", 0), F.regexp_extract(text, "[+-]([0-9]{4})$", 1)
    month = F.when(F.length(main) >= 6, part(main, 5, 2)).otherwise(1)
    day = F.when(F.length(main) >= 8, part(main, 7, 2)).otherwise(1)
    clock = (part(main, 9, 2) <= 23) & (part(main, 11, 2) <= 59) & (part(main, 13, 2) <= 59)
    hours, minutes = part(zone, 1, 2), part(zone, 3, 2)
    return (text == "") | (shape & valid_date(part(main, 1, 4), month, day) & clock & (hours <= 14) & (minutes <= 59) & ((hours < 14) | (minutes == 0)))


def valid_cs(text: Column) -> Column:
    """At most 16 of A-Z, 0-9, underscore and space."""
    return text.rlike("^[A-Z0-9_ ]{0,16}$")


def valid_text(text: Column, most: int) -> Column:
    """At most so many characters and no control characters but tab, line feed and carriage return."""
    return (F.char_length(text) <= most) & ~text.rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]")


def valid_ui(text: Column) -> Column:
    """At most 64 bytes of digit groups joined by dots; empty is valid."""
    return (text == "") | (text.rlike(r"^[0-9]+(\.[0-9]+)*$") & (F.octet_length(text) <= 64))


def slug(text: Column) -> Column:
    """Lower-case file-name part: letters and digits of any script, dot, underscore and hyphen; anything else is a hyphen, runs of them are one.

    Letters and digits are those of the JVM's Unicode version. Characters are lowered one by one, so a capital sigma at a word's end
    has no form of its own.
    """
    kept = F.lower(F.translate(F.regexp_replace(text, r"[^\p{L}\p{N}._]+", "-"), "\u03a3", "\u03c3"))
    return F.coalesce(non_empty(F.regexp_replace(kept, "^-|-$", "")), F.lit("slide"))


def uid(seed: Column) -> Column:
    """`2.25.` and the decimal form of the first 128 bits of the seed's SHA-256."""
    return uid_of_digest(F.sha2(seed, 256))


def uid_of_digest(digest: Column) -> Column:
    """`2.25.` and the decimal form of the first 32 hexadecimal digits.

    39 digits are more than a decimal holds, so the nine last are kept apart: of the halves a and b, a * 2**64 + b is a * 18446744073 * 10**9 + a * 709551616 + b.
    """
    a, b = (F.conv(F.substring(digest, i, 16), 16, 10).cast("decimal(20,0)") for i in (1, 17))
    low = a * F.lit(Decimal(709551616)) + b
    last = (low % F.lit(Decimal(10**9))).cast("decimal(9,0)")
    first = a * F.lit(Decimal(18446744073)) + ((low - last) / F.lit(Decimal(10**9))).cast("decimal(28,0)")
    text = F.when(first > 0, F.concat(first.cast("string"), F.lpad(last.cast("string"), 9, "0"))).otherwise(last.cast("string"))
    return F.concat(F.lit("2.25."), text)


def decimal_string(value: float) -> str:
    """At most 16 characters: as many of 12 decimals as fit, without trailing zeros; else scientific with eight decimals."""
    for places in range(12, -1, -1):
        text = f"{value:.{places}f}"
        text = text.rstrip("0").rstrip(".") if "." in text else text
        if len(text) <= 16:
            return "0" if text == "-0" else text
    return f"{value:.8e}"


def json_text(body: Column, pointer: str) -> Column:
    """A non-empty JSON string at a path; null for numbers, other kinds and empty strings."""
    v = F.try_parse_json(body)
    kind = F.schema_of_variant(F.try_variant_get(v, pointer, "variant"))
    return F.when(kind == "STRING", non_empty(F.try_variant_get(v, pointer, "string")))


def pad_tile(values: Column, w: int, h: int, out_w: int, out_h: int) -> Column:
    """Row-major w x h values copied into out_w x out_h; what is outside is 0, what does not fit is cut."""
    def at(i: Column) -> Column:
        x, y = i % out_w, F.call_function("div", i, F.lit(out_w))
        return F.when((x < w) & (y < h), F.coalesce(F.get(values, (y * w + x).cast("int")), F.lit(0.0).cast("float"))).otherwise(F.lit(0.0).cast("float"))

    return F.transform(F.sequence(F.lit(0), F.lit(out_w * out_h - 1)), at)


def restart_interval(w: Column, h: Column, mcu: int = 16) -> Column:
    """64 if the picture has more than 64 MCUs, else null."""
    across = F.call_function("div", w + mcu - 1, F.lit(mcu))
    return F.when(across * F.call_function("div", h + mcu - 1, F.lit(mcu)) > 64, 64)


def buffer_bytes(threads: Column) -> Column:
    """32 MiB a thread, between 64 and 256 MiB."""
    return F.least(F.greatest(threads * (32 << 20), F.lit(64 << 20)), F.lit(256 << 20))


def seconds_text(value: Column) -> Column:
    return F.coalesce(F.format_string("%.3f", value), F.lit(""))


def speedup(numerator: Column, denominator: Column) -> Column:
    return F.when(numerator.isNotNull() & (denominator > 0), numerator / denominator)


def is_slide_path(path: Column) -> Column:
    from lodestrata.functions.dims import SLIDE_EXTENSIONS

    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)).isin(*SLIDE_EXTENSIONS)
