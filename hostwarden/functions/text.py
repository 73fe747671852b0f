"""Text functions on columns: case folding, tokens, ILIKE, hashes, ids."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, functions as F

_SPACE = r"[\s\x1c-\x1f]"
_TOKEN_EDGE = "\"'(),;"


@lru_cache(maxsize=1)
def _beyond_lowercase() -> dict[str, str]:
    """Characters that stay as they are in lower case but still fold to something else.

    Built from the Unicode rules of the running Python rather than written out.
    """
    table = {}
    for code in range(128, 0x20000):  # no letter with case lies beyond the first two planes
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        if char.lower() == char and char.casefold() != char:
            table[char] = char.casefold()
    return table


def fold(text: Column) -> Column:
    """Full Unicode case folding. ASCII text, the common case, only pays ``lower``."""
    table = _beyond_lowercase()
    lowered = F.lower(text)
    # One foldable text instead of hundreds of literals keeps the plan small.
    listed = "\x01".join(f"{char}\x02{folded}" for char, folded in table.items())
    mapping = F.str_to_map(F.lit(listed), F.lit("\x01"), F.lit("\x02"))
    special = "[" + "".join(re.escape(char) for char in table) + "]"
    folded = F.array_join(
        F.transform(F.split(lowered, ""), lambda c: F.coalesce(mapping[c], c)), ""
    )
    return F.when(
        (F.octet_length(text) == F.char_length(text)) | ~lowered.rlike(special), lowered
    ).otherwise(folded)


def has_token(text: Column, values: tuple[str, ...]) -> Column:
    """Whether some whitespace-separated token, without the quotes, brackets, commas and
    semicolons around it, equals a value.

    One regular expression: it stays in generated code, unlike splitting the text
    into an array. A value with whitespace or with such a character at its edge
    can equal no token.
    """
    possible = [v for v in values if v == v.strip(_TOKEN_EDGE) and not re.search(_SPACE, v)]
    if not possible:
        return F.lit(False)
    edge = "[" + re.escape(_TOKEN_EDGE) + "]"
    quoted = "|".join(f"{edge}*{re.escape(v)}{edge}*" if v else f"{edge}+" for v in possible)
    return text.rlike(f"(?U)(?:^|{_SPACE})(?:{quoted})(?:$|{_SPACE})")


def ilike_pattern(term: str) -> str:
    """``%term%`` with the wildcards of the term alive.

    A backslash before an ordinary character means that character, and Spark
    refuses such an escape, so it is dropped here; the escapes of ``%``, ``_``
    and the backslash itself stay.
    """
    kept = ("\\%", "\\_", "\\\\")
    return re.sub(r"\\.", lambda pair: pair[0] if pair[0] in kept else pair[0][1], f"%{term}%", flags=re.DOTALL)


def ilike(column: Column, term: str) -> Column:
    """Case-insensitive search for ``term`` anywhere in the column."""
    return column.ilike(ilike_pattern(term))


def sha256_of(hashes: Column) -> Column:
    """The SHA256 entry of a ``NAME=value,NAME=value`` list, empty when there is none."""
    found = F.regexp_extract(hashes, r"(?i)(?:^|,)\s*SHA256=([^,]*)", 1)
    return F.coalesce(F.regexp_replace(found, r"\s+$", ""), F.lit(""))


def stable_uuid(kind: str, natural_key: Column) -> Column:
    """A UUID-shaped id derived from a natural key, equal on every replay."""
    digest = F.sha2(F.concat(F.lit(f"{kind}|"), natural_key), 256)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in cuts])


def json_string(text: Column) -> Column:
    """One string as a quoted and escaped JSON value."""
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.char_length(listed) - 2)


def json_list(*elements: Column) -> Column:
    """A JSON list of elements that are JSON text already."""
    return F.concat(F.lit("["), F.concat_ws(",", *elements), F.lit("]"))


def time_text(moment: Column) -> Column:
    """``YYYY-MM-DD hh:mm:ss`` with six fraction digits only where they are not zero."""
    micros = F.unix_micros(moment) % F.lit(1_000_000)
    shown = F.when(micros == 0, F.date_format(moment, "yyyy-MM-dd HH:mm:ss")).otherwise(
        F.date_format(moment, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    )
    return F.coalesce(shown, F.lit("None"))
