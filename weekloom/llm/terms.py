"""Terms of texts: maximal runs of ASCII letters, ASCII digits and whatever is not ASCII, with A-Z lower-cased."""

from __future__ import annotations

#: The bytes of ASCII terms as they are in lower case; every other ASCII character ends a term.
_LOWER = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in bytes(range(256)).lower())

#: The same as SQL, for a text column or literal in braces.
TERMS_SQL = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order, with repeats; none of a null."""
    return text.translate(_LOWER).split() if text else []
