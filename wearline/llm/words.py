"""Words of whole texts as bytes, for the operators that compare documents with `benchmark`.

A word is a maximal run of digits, letters a-z and characters beyond ASCII after A-Z are
lower-cased. Every byte of a character beyond ASCII is above 0x7F, so bytes can be mapped one by
one: what is no part of a word becomes a space.
"""

from __future__ import annotations

import pyarrow as pa

_PART = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _PART else 0x20 for b in range(256))


def split_words(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text; null has none."""
    return text.translate(TO_WORDS).split() if text else []


def texts_of(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow column as UTF-8, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()
