"""Counts of the scoring rules' terms: one automaton reads a text once for all term lists."""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel import lexicons as L

#: Term lists by the name of their count.
LISTS = {"high": L.HIGH_NOVELTY, "moderate": L.MODERATE_NOVELTY, "promo": L.PROMOTIONAL, "access": L.ACCESS_FRICTION, "method": L.METHOD_OR_RESULT, "commentary": L.COMMENTARY} | {f"type_{k}": v for k, v in L.CONTENT_TYPES.items()}
_KIND = T.StructType([T.StructField(name, T.IntegerType()) for name in LISTS])
_TERMS = sorted({t for terms in LISTS.values() for t in terms})
#: For each term, the lists that it is in.
_MEMBER = np.array([[t in terms for terms in LISTS.values()] for t in _TERMS], np.int32)
_MACHINE: list[ahocorasick.Automaton] = []


def _machine() -> ahocorasick.Automaton:
    if not _MACHINE:
        made = ahocorasick.Automaton()
        for k, t in enumerate(_TERMS):
            made.add_word(t, k)
        made.make_automaton()
        _MACHINE.append(made)
    return _MACHINE[0]


@F.arrow_udf(_KIND)
def _counted(texts: pa.Array) -> pa.Array:
    machine, known = _machine(), {}
    out = np.zeros((len(texts), len(LISTS)), np.int32)
    for row, text in enumerate(texts.to_pylist()):
        found = frozenset(k for _, k in machine.iter(text)) if text else None
        if found:
            if found not in known:
                known[found] = _MEMBER[list(found)].sum(0)
            out[row] = known[found]
    return pa.StructArray.from_arrays([pa.array(out[:, k]) for k in range(len(LISTS))], list(LISTS))


def term_counts(text: Column) -> Column:
    """How many terms of each list a text contains as substrings, in any case; a term counts once, null has none.

    Uses of the same text in one select are computed once.
    """
    return _counted(F.lower(text))
