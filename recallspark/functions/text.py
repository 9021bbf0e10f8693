"""Text helpers: blanks, broken UTF-8, file kinds, exact rounding, model output in code fences."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Blanks that str.strip() removes, and the code fence of model output.
BLANKS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
FENCE = "```"
JSON_FENCE = "```json"

# A legitimate U+FFFD in the input must survive the removal of those that mark bad bytes.
_REPLACEMENT = "\ufffd"
_KEEP = "\u0001\ufdd0\u0001"


def strip_blanks(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS, "")


def decode_utf8(content: Column) -> Column:
    """Bytes as text; bytes that are not UTF-8 are left out."""
    raw = content.cast("string")
    shielded = F.replace(raw, F.lit(_REPLACEMENT), F.lit(_KEEP))
    cleaned = F.replace(F.make_valid_utf8(shielded), F.lit(_REPLACEMENT), F.lit(""))
    return F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(cleaned, F.lit(_KEEP), F.lit(_REPLACEMENT)))


def document_kind(file_name: Column, mime_type: Column) -> Column:
    """``pdf`` by MIME type or extension, ``text`` otherwise."""
    by_type = F.coalesce(mime_type, F.lit("")).contains("pdf")
    by_name = F.lower(F.coalesce(file_name, F.lit(""))).endswith(".pdf")
    return F.when(by_type | by_name, F.lit("pdf")).otherwise(F.lit("text"))


def unfence(raw: Column, bare: Column) -> Column:
    """Model output without the Markdown code fence around it, if there is one.

    ``bare`` is ``raw`` without outer blanks.
    """

    def inside(opening):
        body = F.substring(bare, F.lit(len(opening) + 1), F.char_length(bare))
        closed = F.when(body.endswith(FENCE), F.left(body, F.char_length(body) - len(FENCE))).otherwise(body)
        return strip_blanks(closed)

    return (
        F.when(bare.startswith(JSON_FENCE), inside(JSON_FENCE))
        .when(bare.startswith(FENCE), inside(FENCE))
        .otherwise(raw)
    )


def round_to_cents(value: Column) -> Column:
    """Two decimals, judged on the exact binary value (ties to even), as Python rounds."""
    return F.replace(F.format_number(value, 2), F.lit(","), F.lit("")).cast("double")


def float_text(value: Column) -> Column:
    """A double as Python spells it: plain from 1e-4 to 1e16, else with a signed exponent of two digits or more."""
    text = value.cast("string")
    mantissa, exponent = F.regexp_extract(text, r"^-?([0-9.]+)E", 1), F.regexp_extract(text, r"E(-?[0-9]+)$", 1).cast("int")
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), r"(?<=.)0+$", "")
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    count = F.char_length(digits)
    whole = exponent + 1
    plain = (
        F.when(exponent < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -whole), digits))
        .when(count <= whole, F.concat(F.rpad(digits, whole, F.lit("0")), F.lit(".0")))
        .otherwise(F.concat(F.left(digits, whole), F.lit("."), F.substring(digits, whole + 1, count)))
    )
    rest = F.when(count > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), count))).otherwise(F.lit(""))
    power = F.concat(F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
                     F.when(F.abs(exponent) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(exponent).cast("string"))
    scientific = F.concat(F.left(digits, F.lit(1)), rest, power)
    return (
        F.when(~text.contains("E"), F.replace(text, F.lit("Infinity"), F.lit("inf")))
        .otherwise(F.concat(sign, F.when((exponent >= -4) & (exponent < 16), plain).otherwise(scientific)))
    )
