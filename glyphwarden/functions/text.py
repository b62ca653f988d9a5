"""Text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from glyphwarden import rules

def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends (only looks at the ends, unlike a pattern)."""
    return F.trim(text, F.lit(rules.WHITESPACE_CHARS))


def fold_newlines(text: Column) -> Column:
    """Universal newlines: CR LF and lone CR become LF."""
    return F.when(text.contains("\r"), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def decode_file(content: Column) -> Column:
    """File bytes to text: UTF-8 with U+FFFD for invalid bytes, newlines folded."""
    return fold_newlines(F.make_valid_utf8(content.cast("string")))


def unleet(text: Column) -> Column:
    """Lower-case and undo character substitution.

    One simultaneous translation equals replacing character by character, because no
    replacement is itself a replaced character.
    """
    return F.translate(F.lower(text), rules.LEET_FROM, rules.LEET_TO)


def has_leet(text: Column) -> Column:
    return text.rlike(r"[013456789@$!+]")


def base64_text_sql(run: str) -> str:
    """Text of one Base64 run (a SQL expression), or null where its padding makes it undecodable.

    With n alphabet characters and p pads a run decodes iff n % 4 = 0, or n % 4 = 2 and
    p = 2, or n % 4 = 3 and p >= 1. Bytes that are not UTF-8 are dropped.
    """
    body = f"rtrim('=', {run})"
    n, pads = f"char_length({body})", f"(char_length({run}) - char_length({body}))"
    padded = f"concat({body}, repeat('=', (4 - {n} % 4) % 4))"
    return (
        f"CASE WHEN {n} % 4 = 0 OR ({n} % 4 = 2 AND {pads} = 2) OR ({n} % 4 = 3 AND {pads} >= 1) "
        f"THEN replace(make_valid_utf8(cast(unbase64({padded}) as string)), '\\uFFFD', '') END"
    )


def base64_text(run: str) -> Column:
    return F.expr(base64_text_sql(run))


def escape_html(text: Column) -> Column:
    """Escape markup characters for display."""
    for raw, escaped in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&quot;")]:
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def mask_email(email: Column) -> Column:
    """First three characters of the name, then the domain after the first '@'."""
    name = F.substring_index(email, "@", 1)
    return F.concat(F.left(name, F.lit(3)), F.lit("***@"), F.substring(email, F.instr(email, "@") + 1, F.char_length(email)))


def iso_timestamp(ts: Column) -> Column:
    """ISO 8601; the fraction (six digits) is left out when it is zero."""
    fraction = F.date_format(ts, "SSSSSS")
    seconds = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(fraction == "000000", seconds).otherwise(F.concat_ws(".", seconds, fraction))


def percent_of(part: Column, whole: Column) -> Column:
    """Share in percent, one decimal, half to even; 0 for an empty whole."""
    return F.when(whole > 0, F.bround(part / whole * 100, 1)).otherwise(F.lit(0.0))
