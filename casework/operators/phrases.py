"""Screen texts for a table of phrases in one pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Characters of phrases that one automaton takes; a longer table is cut into
# blocks of this size, each with a pass of its own over the texts.
BLOCK_CHARS = 1 << 21


class PhraseBlock:
    """Phrases by what they look like in lower case; the automaton is made where it is used, once per worker."""

    def __init__(self, phrases: dict[str, list[str]]) -> None:
        self.phrases = phrases
        self._automaton: ahocorasick.Automaton | None = None

    def __getstate__(self) -> dict:
        return {"phrases": self.phrases, "_automaton": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    @property
    def automaton(self) -> ahocorasick.Automaton:
        if self._automaton is None:
            made = ahocorasick.Automaton()
            for lowered in self.phrases:
                made.add_word(lowered, (lowered, len(lowered)))
            made.make_automaton()
            self._automaton = made
        return self._automaton

    def counts(self, text: str) -> dict[str, int]:
        """How often each lower-case phrase stands in a lower-case text; its own matches do not overlap."""
        found: dict[str, int] = {}
        free: dict[str, int] = {}
        for last, (phrase, length) in self.automaton.iter(text):
            if last - length + 1 >= free.get(phrase, 0):
                found[phrase] = found.get(phrase, 0) + 1
                free[phrase] = last + 1
        return found


def _blocks(phrases: DataFrame, phrase: str, size: int) -> Iterator[PhraseBlock]:
    """The table in blocks of bounded size, one of them on the driver at a time."""
    rows = phrases.select(F.col(phrase).cast("string").alias("p")).where("p <> ''").distinct()
    held: dict[str, list[str]] = {}
    chars = 0
    for original, lowered in rows.select("p", F.lower("p")).sort("p").toLocalIterator():
        held.setdefault(lowered, []).append(original)
        chars += len(lowered)
        if chars >= size:
            yield PhraseBlock(held)
            held, chars = {}, 0
    if held:
        yield PhraseBlock(held)


def phrase_hits(
    df: DataFrame, text: str, keys: Sequence[str], phrases: DataFrame, phrase: str = "phrase", block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """One row per text and phrase of the table that it holds: ``keys, phrase, n_hits``.

    Matching ignores case; occurrences of one phrase are counted from the left
    without overlap, those of different phrases may overlap. Null and empty
    phrases and null texts match nothing, a repeated phrase counts once.

    An automaton over all phrases reads each text once, whatever their number;
    it is shipped as plain phrases, at most ``block_chars`` of them at a time,
    so a table of any size needs bounded memory and one pass for each block.
    """
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("phrase", T.StringType()), T.StructField("n_hits", T.LongType())])
    arrow = to_arrow_schema(schema)
    read = df.select(*keys, F.lower(F.col(text)).alias("_lowered")).where("_lowered <> ''")
    hits = None
    for block in _blocks(phrases, phrase, block_chars):
        shared = df.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = shared.value
                row, names, counts = [], [], []
                for i, value in enumerate(batch.column("_lowered")):
                    for lowered, n in held.counts(value.as_py()).items():
                        for original in held.phrases[lowered]:
                            row.append(i)
                            names.append(original)
                            counts.append(n)
                if row:
                    kept = [batch.column(k).take(pa.array(row)) for k in keys]
                    columns = [*kept, pa.array(names, pa.string()), pa.array(counts, pa.int64())]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        found = read.mapInArrow(run, schema)
        hits = found if hits is None else hits.union(found)
    return df.sparkSession.createDataFrame([], schema) if hits is None else hits


def phrase_report(df: DataFrame, text: str, source: str, phrases: DataFrame, phrase: str = "phrase", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Texts and occurrences per source and phrase."""
    hits = phrase_hits(df, text, [source], phrases, phrase, block_chars)
    return hits.groupBy(source, "phrase").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("n_hits").alias("n_hits"))
