"""Terms that stand in a text, all found in one pass by an Aho-Corasick automaton."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import ahocorasick
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Bytes of a lexicon that travels with a plan; larger ones are tables, see operators.lexicon.
MOST_BYTES = 4 << 20

#: Rows and bytes of texts that Spark sends to Python in a batch at most: texts take some times their bytes there.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1024, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}

_automata: dict[str, tuple[object, list[int]]] = {}


def automaton(terms: list[str]):
    """(automaton over the terms' numbers, or None, numbers of terms that every text holds: the empty one)."""
    name = hashlib.sha256("\0".join(f"{len(t)}:{t}" for t in terms).encode()).hexdigest()
    if name not in _automata:
        if len(_automata) > 64:
            _automata.clear()
        made, empty = ahocorasick.Automaton(), []
        for i, term in enumerate(terms):
            if term:
                made.add_word(term, i)
            else:
                empty.append(i)
        if len(made):
            made.make_automaton()
        _automata[name] = (made if len(made) else None, empty)
    return _automata[name]


def numbers_in(text: str, terms) -> list[int]:
    """Numbers of the terms of an automaton that stand in text, rising."""
    made, empty = terms
    return sorted({i for _, i in made.iter(text)}.union(empty)) if made is not None and text else list(empty)


def small_batches() -> None:
    """Keep batches of whole texts within BATCH. The settings are the session's, read when a plan runs, and only ever made smaller."""
    spark = SparkSession.getActiveSession()
    for name, most in BATCH.items() if spark else ():
        number, unit = re.fullmatch(r"(-?\d+)\s*([kmgt]?)b?", spark.conf.get(name).lower()).groups()
        if not 0 < int(number) << 10 * " kmgt".index(unit or " ") <= most:
            spark.conf.set(name, str(most))


def found(text: Column, terms: Iterable[str]) -> Column:
    """The lexicon's distinct terms that stand in text as substrings, in the lexicon's order; an array, empty for a null text.

    Equal to asking contains for each term, in time that does not depend on their number. Case counts. The terms are part of
    the plan and take MOST_BYTES at most. Batches of texts are kept small for good, see small_batches.
    """
    small_batches()
    words = list(dict.fromkeys(terms))
    if sum(len(w.encode()) for w in words) > MOST_BYTES:
        raise ValueError(f"a lexicon of over {MOST_BYTES} bytes must be a table")

    def search(texts: pd.Series) -> pd.Series:
        known = automaton(words)
        return pd.Series([[] if t is None else [words[i] for i in numbers_in(t, known)] for t in texts], dtype=object)

    return F.pandas_udf(search, "array<string>")(text)


def hits(found_terms: Column, terms: Iterable[str]) -> Column:
    """How many of the terms are among those found."""
    return F.size(F.array_intersect(found_terms, F.array(*[F.lit(w) for w in dict.fromkeys(terms)])))
