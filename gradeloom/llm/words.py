"""Words of a text as bytes: lower-case A-Z, then runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]."""

from __future__ import annotations

_WORD = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Every byte of a word as itself or its lower case, any other byte as a space.
TABLE = bytes(c if (c := b + 32 * (0x41 <= b <= 0x5A)) in _WORD else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Null has no words. All bytes of non-ASCII characters belong to words, so bytes suffice."""
    return text.encode().translate(TABLE).split() if text else []
