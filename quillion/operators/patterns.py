"""Many terms at once: which terms of a vocabulary occur in each text, anywhere, as substrings.

An Aho-Corasick automaton reads a text once, however many terms there are, where a join on ``contains`` compares each
text with each term. Tasks get the terms as a broadcast table of bounded size and build the automaton from it once a
worker. A vocabulary beyond that size is cut into shards by a hash of the term, and texts are read once a shard.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillion.functions.vocabulary import TAXONOMY

#: Terms, and bytes of terms, of one shard, about.
SHARD_TERMS, SHARD_BYTES = 500_000, 16_000_000
#: Matches of one batch that goes on.
MATCHES = 500_000

#: The automaton that this worker built last, by the number of its broadcast table.
_BUILT: dict[int, ahocorasick.Automaton] = {}


def automaton(values: dict[str, object]) -> ahocorasick.Automaton:
    """Finds the keys of values (none empty) in texts and gives their values."""
    found = ahocorasick.Automaton()
    for term, value in values.items():
        found.add_word(term, value)
    found.make_automaton()
    return found


def _of(shared) -> ahocorasick.Automaton:
    if shared.value and shared.id not in _BUILT:
        _BUILT.clear()
        _BUILT[shared.id] = automaton({t: i for i, t in enumerate(shared.value)})
    return _BUILT.get(shared.id)


class _Table:
    """A broadcast list of terms with a number that is the same in all workers."""

    def __init__(self, broadcast, number: int):
        self.broadcast, self.id = broadcast, number

    @property
    def value(self) -> list[str]:
        return self.broadcast.value


def occurring(texts: DataFrame, text_col: str, terms: DataFrame, term_col: str = "term", shard_terms: int = SHARD_TERMS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """texts' columns and ``term``: a row for each distinct term in a text, compared as they are written.

    The empty term is in every text; a null text holds no term, and a null term is in none. Repeated rows and terms:
    each row has its own matches, each term is one. A text column named ``term`` would clash and is an error.
    """
    if "term" in texts.columns:
        raise ValueError("texts have a column named term")
    every = terms.select(F.col(term_col).cast("string").alias("term")).where(F.col("term").isNotNull()).distinct()
    size = every.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes"), F.max(F.col("term") == "").alias("empty")).first()
    shards = max(1, -(-size["n"] // shard_terms), -(-size["bytes"] // shard_bytes))
    schema = T.StructType([*texts.schema.fields, T.StructField("term", T.StringType())])

    def searched(shared: _Table, empty: bool):
        def run(batches):
            search = _of(shared)
            names = pa.array([*shared.value, ""], pa.string())
            for batch in batches:
                rows: list[int] = []
                hits: list[int] = []
                for i, text in enumerate(batch.column(text_col).to_pylist()):
                    if text is None:
                        continue
                    own = {v for _, v in search.iter(text)} if search is not None and text else set()
                    if empty:
                        own.add(len(names) - 1)
                    rows += [i] * len(own)
                    hits += sorted(own)
                    if len(rows) >= MATCHES:
                        yield matched(batch, rows, hits, names)
                        rows, hits = [], []
                yield matched(batch, rows, hits, names)

        return run

    def matched(batch: pa.RecordBatch, rows: list[int], hits: list[int], names: pa.Array) -> pa.RecordBatch:
        kept = batch.take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays([*kept.columns, names.take(pa.array(hits, pa.int64()))], [*batch.schema.names, "term"])

    out = None
    for shard in range(shards):
        part = every.where((F.col("term") != "") & (F.pmod(F.xxhash64("term"), F.lit(shards)) == shard))
        held = part.toArrow()["term"].to_pylist()  # at most about a shard's size
        shared = _Table(texts.sparkSession.sparkContext.broadcast(held), np.random.default_rng().integers(1 << 62).item())
        found = texts.mapInArrow(searched(shared, bool(size["empty"]) and shard == 0), schema)
        out = found if out is None else out.unionByName(found)
    return out


def labelled(texts: DataFrame, text_col: str, taxonomy: dict[str, list[str]] | None = None) -> DataFrame:
    """texts with a boolean column for each name of the taxonomy: whether the text holds one of its words. Null texts have nulls.

    For word lists too long for ``route.matches``, which compares each in an expression. A taxonomy is a file of the
    installation; its words go out with the function.
    """
    taxonomy = TAXONOMY if taxonomy is None else taxonomy
    names, labels = list(taxonomy), {}
    for at, name in enumerate(names):
        for word in taxonomy[name]:
            labels.setdefault(word, set()).add(at)
    always = labels.pop("", set())
    schema = T.StructType([*texts.schema.fields, *(T.StructField(name, T.BooleanType()) for name in names)])

    def run(batches):
        search = automaton(labels) if labels else None
        for batch in batches:
            held = np.zeros((len(names), batch.num_rows), bool)
            for i, text in enumerate(batch.column(text_col).to_pylist()):
                hits = set(always) if text is not None else set()
                for _, more in search.iter(text) if search is not None and text else ():
                    hits |= more
                held[list(hits), i] = True
            none = batch.column(text_col).is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(h, pa.bool_(), mask=none) for h in held)], [*batch.schema.names, *names])

    return texts.mapInArrow(run, schema)
