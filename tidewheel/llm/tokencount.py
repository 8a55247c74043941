"""Token counts by offset-mapped attribution.

A whole text is encoded once with a byte-level vocabulary. The lengths of its
tokens' bytes add up to the text's bytes, so running sums are the tokens' spans; an
interval join by binary search of the two sorted lists, tokens and sections, finds
the sections that each token meets. A token inside one section counts there. A
token that crosses boundaries goes to one section by the rule named: ``largest``
(most of its bytes, the earlier section on a tie), ``start`` (its first byte) or
``end`` (its last byte).
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.common import buffers

RULES = ("largest", "start", "end")
_CODERS: dict[tuple[str, str], tuple] = {}


def default_vocabulary() -> tuple[str, str]:
    """Path of the installed 50k byte-level vocabulary and its split pattern."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def coder(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoder and the byte length of each token id, loaded once per process."""
    if (path, pattern) not in _CODERS:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _CODERS[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes
    return _CODERS[path, pattern]


def attribute(stops: np.ndarray, sections: np.ndarray, rule: str = "largest") -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens cross a boundary.

    ``stops`` are the tokens' end bytes, ascending and without gaps from 0;
    ``sections`` the end bytes of consecutive sections that cover the text. Empty
    sections get no token.
    """
    starts = np.concatenate(([0], stops[:-1])).astype(np.int64)
    first = np.searchsorted(sections, starts, "right")
    last = np.searchsorted(sections, stops - 1, "right")
    home = {"start": first, "end": last}.get(rule)
    crossing = np.flatnonzero(first != last)
    if home is None:
        home = first.copy()
        begins = np.concatenate(([0], sections[:-1]))
        for i in crossing:  # few: at most one token a boundary
            k = np.arange(first[i], last[i] + 1)
            home[i] = k[np.argmax(np.minimum(sections[k], stops[i]) - np.maximum(begins[k], starts[i]))]
    return np.bincount(home, minlength=len(sections)).astype(np.int64), len(crossing)


def line_ends(raw: np.ndarray) -> np.ndarray:
    """End bytes of the lines of a text, newline included; the default sections."""
    ends = np.flatnonzero(raw == 10) + 1
    return ends if len(ends) and ends[-1] == len(raw) else np.append(ends, len(raw))


_KIND = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_crossing", T.LongType()), T.StructField("section_bytes", T.ArrayType(T.LongType())), T.StructField("section_tokens", T.ArrayType(T.LongType()))])
_ARROW = pa.struct([("n_tokens", pa.int64()), ("n_crossing", pa.int64()), ("section_bytes", pa.list_(pa.int64())), ("section_tokens", pa.list_(pa.int64()))])


def with_token_counts(docs: DataFrame, sections: str | None = None, rule: str = "largest", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Add ``tokens``: struct(n_tokens, n_crossing, section_bytes, section_tokens) of each whole text.

    Sections are the lines of the text, or, with ``sections``, given by an array
    column of ascending end offsets in code points; what lies behind the last one
    is a section more. The sections' tokens add up to n_tokens. Null and empty
    texts have no token and one empty section. Repeated rows are counted each.
    Other columns pass; one named ``tokens`` is replaced. ``vocabulary`` is a
    path on every executor and a split pattern.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path, pattern = vocabulary or default_vocabulary()

    @F.arrow_udf(_KIND)
    def count(texts: pa.Array, ends: pa.Array) -> pa.Array:
        encoding, sizes = coder(path, pattern)
        data, offsets = buffers(texts)
        rows = []
        given = ends.to_pylist() if sections else None
        for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            raw = data[a:b]
            ids = np.array(encoding.encode_ordinary(raw.tobytes().decode()), np.int64)
            stops = np.cumsum(sizes[ids])
            if given is None:
                own = line_ends(raw)
            else:
                lead = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
                own = lead[np.clip(np.array(given[k] or [], np.int64), 0, len(lead) - 1)]
                own = own if len(own) and own[-1] == len(raw) else np.append(own, len(raw))
            tokens, crossing = attribute(stops, own, rule) if len(ids) else (np.zeros(len(own), np.int64), 0)
            rows.append({"n_tokens": len(ids), "n_crossing": crossing, "section_bytes": np.diff(own, prepend=0), "section_tokens": tokens})
        return pa.array(rows, _ARROW)

    return docs.withColumn("tokens", count("text", sections if sections else F.lit(None).cast("array<long>")))
