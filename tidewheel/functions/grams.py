"""Character trigrams of texts as numbers, an Arrow batch at a time."""

from __future__ import annotations

import numpy as np

#: Bits of a code point in a trigram's number; numbers sort as the trigrams do by code point.
BITS = 21


def trigrams(text: str | None) -> np.ndarray:
    """The trigrams of a text in order, repeats included; A-Z count as a-z, other characters as they are."""
    c = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    c = np.where((c >= 65) & (c <= 90), c + 32, c)
    return (c[:-2] << 2 * BITS) | (c[1:-1] << BITS) | c[2:]
