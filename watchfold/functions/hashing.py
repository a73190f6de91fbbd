"""Hash and canonical-form columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Control characters whose escape has a hex letter; the canonical form wants it in lower case.
_LETTER_ESCAPES = ("000B", "000E", "000F", "001A", "001B", "001C", "001D", "001E", "001F")


def _as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical_json(cols: Sequence[str] | dict[str, Column], keep_nulls: bool = True) -> Column:
    """JSON with sorted keys, no spaces and non-ASCII text kept as it is."""
    named = {c: F.col(c) for c in cols} if not isinstance(cols, dict) else cols
    record = F.struct(*[named[k].alias(k) for k in sorted(named)])
    text = F.to_json(record, {"ignoreNullFields": "false" if keep_nulls else "true"})
    fixed = text
    for code in _LETTER_ESCAPES:
        # an even run of backslashes before it would mean a literal "\\u001F"
        fixed = F.regexp_replace(fixed, rf"(?<!\\)((?:\\\\)*)\\u{code}", rf"$1\\u{code.lower()}")
    return F.when(text.rlike(r"\\u00[01][A-F]"), fixed).otherwise(text)


def canonical_document(json_text: Column | str) -> Column:
    """Any JSON text in canonical form; null if it is not JSON.

    A VARIANT object keeps its fields sorted by name at every level, so writing
    it out again gives sorted keys without spaces.
    """
    return F.to_json(F.try_parse_json(_as_column(json_text)))


def sha256(text: Column | str) -> Column:
    return F.sha2(_as_column(text), 256)


def payload_sha256(cols: Sequence[str] | dict[str, Column]) -> Column:
    """Fingerprint of a payload: SHA-256 of its canonical JSON."""
    return sha256(canonical_json(cols))


def doc_id(source: Column | str, event_id: Column | str) -> Column:
    """Document id that makes a repeated delivery the same document."""
    return sha256(F.concat(_as_column(source), F.lit(":"), _as_column(event_id).cast("string")))


def event_id_or_hash(
    event_id: Column | str, app: Column | str, time: Column | str, etag: Column | str
) -> Column:
    """The source's own id, or a hash of app, time and etag where it has none."""
    parts = [_as_column(c).cast("string") for c in (app, time, etag)]
    return F.coalesce(
        _as_column(event_id).cast("string"), sha256(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]))
    )


def hmac_sha256(key: bytes, message: Column | str) -> Column:
    """HMAC-SHA256 in hex, as two nested hashes with the key pads as literals."""
    import hashlib

    block = hashlib.sha256(key).digest() if len(key) > 64 else key
    block = block.ljust(64, b"\0")
    inner_pad = bytearray(b ^ 0x36 for b in block)
    outer_pad = bytearray(b ^ 0x5C for b in block)
    inner = F.sha2(F.concat(F.lit(inner_pad), F.encode(_as_column(message), "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer_pad), F.unhex(inner)), 256)
