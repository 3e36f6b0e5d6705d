"""Joins and ordered scans that survive a key holding a large share of all rows.

Nothing here drops or samples rows: a hot key is cut into ordered chunks or
salted, every other key takes the plain plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.text import any_of

# Up to this many hot keys are held on the driver and broadcast (a few dozen
# bytes each); beyond it the same table is joined by shuffle, with every key
# spread over this many salts.
MAX_LISTED_KEYS = 100_000
LISTED_SALTS = 256
ROWS_PER_CHUNK = 1_000_000
# The same for rows that carry texts or lists.
WIDE_ROWS_PER_CHUNK = 100_000
# Ranges that one round cuts a key into at most; rounds go on until all fit.
MAX_CHUNKS = 4_096
# Marks by which a chunk's worth of rows is told in one pass.
MARKS = 64
# Bounds under which a dimension is broadcast.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
# Estimates are taken at their word only if they are this far beyond a bound.
FAR = 64
# Bytes of a row of key and order at least, by which a small table is told to have no hot key.
LEAST_ROW_BYTES = 16
# Ranges that a hot key is cut into for each that its rows would fill: an uneven
# order then fits in one round, mostly.
RANGES = 4


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's estimate from file sizes and the plan; no data is read."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files and rows that ``df`` is made from, as the optimiser knows them; no data is read."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def _value_bytes(field: T.StructField) -> Column:
    """Bytes that a value takes, about; texts by their length, nested values by that of their JSON."""
    value = F.col("`" + field.name.replace("`", "``") + "`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 4
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(value))), F.lit(0))
    return F.lit(16 if isinstance(field.dataType, T.DecimalType) else 8)


def fits_broadcast(dim: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``dim`` has at most so many rows and bytes.

    What the optimiser takes for ``FAR`` times too large is not read at all;
    its estimate may be wrong by less. Else rows and bytes are counted in one
    pass, of which only partial counts are shuffled.
    """
    if rows <= 0 or size <= 0 or estimated_bytes(dim) > FAR * size:
        return False
    record = reduce(lambda a, b: a + b, [_value_bytes(f) for f in dim.schema.fields], F.lit(0))
    n, n_bytes = dim.agg(F.count(F.lit(1)), F.coalesce(F.sum(record.cast("bigint")), F.lit(0))).first()
    return n <= rows and n_bytes <= size


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row, the same on every retry; maps cannot be hashed."""
    plain = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain])


def _left(rows: DataFrame, other: DataFrame, keys: Sequence[str], nulls: bool) -> DataFrame:
    """Left join on ``keys``; with ``nulls`` a null key meets a null key."""
    if not nulls:
        return rows.join(other, list(keys), "left")
    renamed = other.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    met = [F.col(f"`{k}`").eqNullSafe(F.col(f"`_of_{k}`")) for k in keys]
    return rows.join(renamed, met, "left").drop(*[f"_of_{k}" for k in keys])


@dataclass(frozen=True)
class HotKeys:
    """A table of one row per hot key, and the join that adds it to rows."""

    table: DataFrame
    keys: tuple[str, ...]
    listed: bool
    nulls: bool

    @classmethod
    def of(cls, stats: DataFrame, keys: Sequence[str]) -> HotKeys | None:
        """None if ``stats`` has no rows; few rows become a local table."""
        rows = stats.limit(MAX_LISTED_KEYS + 1).collect()
        if not rows:
            return None
        if len(rows) > MAX_LISTED_KEYS:
            return cls(stats, tuple(keys), False, not stats.where(any_of([F.col(k).isNull() for k in keys])).isEmpty())
        nulls = any(r[k] is None for r in rows for k in keys)
        return cls(F.broadcast(stats.sparkSession.createDataFrame(rows, stats.schema)), tuple(keys), True, nulls)

    def added_to(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the columns of their hot key, null for other keys."""
        if self.listed:
            return _left(rows, self.table, self.keys, self.nulls)
        # Too many to broadcast: a shuffle on the key alone would bring its rows together.
        copies = self.table.withColumn("_spread", F.explode(F.sequence(F.lit(0), F.lit(LISTED_SALTS - 1))))
        salted = rows.withColumn("_spread", F.pmod(row_hash(rows), F.lit(LISTED_SALTS)).cast("int"))
        return _left(salted, copies, [*self.keys, "_spread"], self.nulls).drop("_spread")


def lookup(
    facts: DataFrame,
    dim: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    broadcast_rows: int = BROADCAST_ROWS,
    rows_per_task: int | None = ROWS_PER_CHUNK,
) -> DataFrame:
    """Join ``facts`` to ``dim`` on ``on``; ``how`` is left, inner, left_semi or left_anti.

    ``dim`` is unique on ``on``. A small one is broadcast, so ``facts`` is not
    shuffled. A larger one is joined by shuffle, hashed on the side of ``dim``
    so that ``facts`` need no sort. Rows of a hot key are then spread over as
    many salts as their count asks for, with ``dim`` repeated for just those
    keys; ``rows_per_task=None`` saves the counting pass and leaves hot keys
    to the skew handling of adaptive execution. Null keys never match and are
    always spread by row hash.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if fits_broadcast(dim, rows=broadcast_rows):
        return facts.join(F.broadcast(dim), keys, how)
    if facts.isStreaming:
        # Keys cannot be counted ahead of a stream; a micro-batch is bounded.
        return facts.join(dim, keys, how)

    hashed = row_hash(facts)
    salt = F.when(any_of([F.col(k).isNull() for k in keys]), F.pmod(hashed, F.lit(1 << 20)))
    hot = None
    if rows_per_task is not None:
        counts = facts.na.drop(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        n_salts = F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_salts")
        hot = HotKeys.of(counts.where(F.col("_n") > rows_per_task).select(*keys, n_salts), keys)
    if hot is not None:
        facts, dim = hot.added_to(facts), hot.added_to(dim)
        salt = salt.when(F.col("_salts") > 1, F.pmod(hashed, F.col("_salts")))
        copies = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
        dim = dim.withColumn("_salt", F.explode(copies)).drop("_salts")
    else:
        # A literal would be folded out of the join keys, and null keys would
        # then meet in one task again.
        dim = dim.withColumn("_salt", F.explode(F.array(F.lit(0))))
    salted = facts.withColumn("_salt", F.coalesce(salt, F.lit(0)).cast("int")).drop("_salts")
    # Measured as too large: keep Spark from broadcasting it on an estimate.
    return salted.join(dim.hint("shuffle_hash"), [*keys, "_salt"], how).drop("_salt")


@dataclass(frozen=True)
class OrderedLog:
    """Rows of a table in ``seq`` order per ``key``, ready for prefix computations.

    ``chunks`` are extra columns that cut hot keys into consecutive ranges of
    ``seq``; empty when no key is hot, and then every method is one plain
    window over the key. ``seq`` is an integer column, ``ties`` are integer
    columns that order rows that share it. A null key is a key like others;
    ``nulls`` says that it was cut.
    """

    df: DataFrame
    key: str
    seq: str
    chunks: tuple[str, ...] = ()
    ties: tuple[str, ...] = ()
    nulls: bool = False

    @classmethod
    def of(
        cls,
        df: DataFrame,
        key: str,
        seq: str,
        ties: Sequence[str] = (),
        rows_per_chunk: int = ROWS_PER_CHUNK,
        counts_from: DataFrame | None = None,
    ) -> OrderedLog:
        """Find hot keys and cut them.

        The look at the data reads ``key`` and ``seq`` only; ``counts_from``
        names a cheaper table with the same or more rows to take it from. The
        cut uses counts and bounds alone, so it is the same on every retry. A
        chunk still too large, from an uneven ``seq``, is cut again; each
        round at least halves its range. What shares one ``seq`` is cut by
        ``ties`` and then by a hash of the row, as such rows have no order
        among themselves; only rows equal in every column stay together. A
        table made from inputs too small to have a hot key is not looked at:
        without a cut results are the same.
        """
        counted = (df if counts_from is None else counts_from).select(key, seq)
        if input_bytes(counted) <= rows_per_chunk * LEAST_ROW_BYTES:
            return cls(df, key, seq, (), tuple(ties))
        hashed = row_hash(df)
        chunks: list[str] = []
        nulls = False
        while True:
            by = [key, *chunks]
            stats = (
                counted.groupBy(*by)
                .agg(
                    F.count(F.lit(1)).alias("_n"),
                    F.min(seq).cast("bigint").alias("_lo"),
                    F.max(seq).cast("bigint").alias("_hi"),
                )
                .where(F.col("_n") > rows_per_chunk)
            )
            parts = F.least(F.ceil(F.col("_n") / rows_per_chunk) * RANGES, F.lit(MAX_CHUNKS))
            width = F.greatest(F.ceil((F.col("_hi") - F.col("_lo") + 1) / parts), F.lit(1)).cast("bigint")
            hot = HotKeys.of(stats.where("_hi > _lo").select(*by, "_lo", width.alias("_width")), by)
            if hot is None:
                break
            name = f"_chunk{len(chunks)}"
            position = F.coalesce(F.expr(f"(cast(`{seq}` as bigint) - _lo) div _width"), F.lit(0))
            counted, df = (hot.added_to(rows).withColumn(name, position).drop("_lo", "_width") for rows in (counted, df))
            chunks.append(name)
            nulls |= hot.nulls
        flat = HotKeys.of(stats.select(*by, F.ceil(F.col("_n") / rows_per_chunk).cast("bigint").alias("_parts")), by)
        if flat is not None:
            df = flat.added_to(df.withColumn("_hash", hashed))
            for tie in ties:
                name = f"_chunk{len(chunks)}"
                place = F.coalesce(F.col(tie).cast("bigint"), F.lit(-1 << 63))
                df = df.withColumn(name, F.when(F.col("_parts").isNotNull(), place).otherwise(F.lit(0)))
                chunks.append(name)
            name = f"_chunk{len(chunks)}"
            df = df.withColumn(name, F.coalesce(F.pmod("_hash", "_parts"), F.lit(0))).drop("_parts", "_hash")
            chunks.append(name)
            nulls |= flat.nulls
        return cls(df, key, seq, tuple(chunks), tuple(ties), nulls)

    @classmethod
    def ranged(
        cls,
        df: DataFrame,
        key: str,
        seq: str,
        ties: Sequence[str] = (),
        rows_per_chunk: int = ROWS_PER_CHUNK,
        counts_from: DataFrame | None = None,
    ) -> OrderedLog:
        """The same cut as part of the plan: no job runs before the one that uses the result.

        About ``MARKS`` rows of every ``rows_per_chunk`` are marks, chosen by a
        hash of the row. A key with more marks than one chunk has is cut at
        every ``MARKS``-th of them in order, however uneven ``seq`` is; its
        chunks are about as large, not exactly. The bounds are broadcast: one
        for each chunk, so fewer than rows in the table by ``rows_per_chunk``.
        Where rows at one moment fill several chunks they are dealt by
        ``ties`` and a hash of the row, those after them are chunks of their
        own. Marks follow from the rows alone, the same on every retry.
        """
        counted = (df if counts_from is None else counts_from).select(key, seq)
        if input_bytes(counted) <= rows_per_chunk * LEAST_ROW_BYTES:
            return cls(df, key, seq, (), tuple(ties))
        step = max(1, rows_per_chunk // MARKS)
        per = rows_per_chunk // step
        source = df if counts_from is None else counts_from
        mark = F.pmod(row_hash(source), F.lit(step)) == 0
        marks = source.where(mark).select(key, F.col(seq).cast("bigint").alias("_m")).groupBy(key).agg(F.sort_array(F.collect_list("_m")).alias("_marks"))
        bounds = F.expr(f"transform(sequence(1, (size(_marks) - 1) div {per}), i -> _marks[i * {per}])")
        # With the bounds go the steps of a search by halving, and whether some are equal.
        halves = "transform(sequence(0, int(floor(log2(size(_bounds))))), i -> shiftleft(1, int(floor(log2(size(_bounds)))) - i))"
        hot = marks.where(F.size("_marks") > per).select(F.col(key).alias("_hot"), bounds.alias("_bounds"))
        hot = hot.withColumns({"_halves": F.expr(halves), "_repeat": F.size(F.array_distinct("_bounds")) < F.size("_bounds")})
        at = F.col(seq).cast("bigint")

        def bounds_before(below) -> Column:
            """How many bounds fulfil a condition that the first ones do and the others do not."""
            def step(n: Column, h: Column) -> Column:
                return F.when((n + h <= F.size("_bounds")) & below(F.get("_bounds", n + h - 1)), n + h).otherwise(n)

            return F.aggregate("_halves", F.lit(0), step)

        rows = df.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot")), "left").withColumn("_cut", F.col("_bounds").isNotNull())
        rows = rows.withColumn("_chunk0", F.when(F.col("_cut"), bounds_before(lambda b: b <= at)).otherwise(0))
        rows = rows.withColumn("_bound", F.when(F.col("_repeat") & (F.col("_chunk0") > 0), F.get("_bounds", F.col("_chunk0") - 1)))
        equal = F.when(F.col("_bound").isNotNull(), F.col("_chunk0") - bounds_before(lambda b: b < F.col("_bound")))
        rows = rows.withColumn("_same", F.coalesce(equal, F.lit(0)))
        flat = (F.col("_same") > 1) & (at == F.col("_bound"))
        rows = rows.withColumn("_chunk1", F.coalesce(((F.col("_same") > 1) & (at > F.col("_bound"))).cast("int"), F.lit(0)))
        chunks = ["_cut", "_chunk0", "_chunk1"]
        for i, tie in enumerate(ties):
            rows = rows.withColumn(f"_chunk{2 + i}", F.when(flat, F.coalesce(F.col(tie).cast("bigint"), F.lit(-1 << 63))).otherwise(F.lit(0)))
            chunks.append(f"_chunk{2 + i}")
        dealt = F.pmod(row_hash(df), F.greatest(F.col("_same"), F.lit(1)).cast("bigint"))
        rows = rows.withColumn("_dealt", F.when(flat, dealt).otherwise(F.lit(0)))
        chunks.append("_dealt")
        rows = rows.drop("_hot", "_bounds", "_halves", "_repeat", "_bound", "_same").repartition(key, *chunks)
        return cls(rows, key, seq, tuple(chunks), tuple(ties), True)

    @property
    def cut_rows(self) -> DataFrame:
        """Rows of the keys that are cut, where the plan tells them apart; only these need a carry."""
        return self.df.where("_cut") if "_cut" in self.chunks else self.df

    def with_df(self, df: DataFrame) -> OrderedLog:
        """The same cut over changed columns or filtered rows."""
        return replace(self, df=df)

    @property
    def group(self) -> list[str]:
        """The grouping that holds all rows of a key, or one chunk of a hot key."""
        return [self.key, *self.chunks]

    @property
    def result(self) -> DataFrame:
        return self.df.drop(*self.chunks)

    def window(self):
        """Rows of one group in order."""
        return Window.partitionBy(*self.group).orderBy(self.seq, *self.ties)

    def with_carry(self, rows: DataFrame, carry: DataFrame) -> DataFrame:
        """``rows`` of the log with the columns of a table of one row per group."""
        if "_cut" in self.chunks:
            # One row for each chunk of a cut key; so the rows stay where they are.
            carry = F.broadcast(carry)
        return _left(rows, carry, self.group, self.nulls)

    def chunk_window(self, backwards: bool = False):
        """All earlier (or later) chunks of a key, over a table of one row per chunk."""
        order = [F.col(c) for c in self.chunks]
        return (
            Window.partitionBy(self.key)
            .orderBy(*[c.desc() if backwards else c for c in order])
            .rowsBetween(Window.unboundedPreceding, -1)
        )

    def _scan(self, name: str, agg, merge, value: Column, inclusive: bool) -> OrderedLog:
        frame = self.window().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        inside = self.df.withColumn(name, agg(value).over(frame))
        if not self.chunks:
            return self.with_df(inside)
        # One row per chunk: what all earlier chunks of the key amount to.
        carry = (
            self.cut_rows.groupBy(*self.group)
            .agg(agg(value).alias("_total"))
            .withColumn("_carry", agg("_total").over(self.chunk_window()))
            .drop("_total")
        )
        joined = self.with_carry(inside, carry)
        return self.with_df(joined.withColumn(name, merge(F.col("_carry"), F.col(name))).drop("_carry"))

    def running_sum(self, name: str, value: Column, inclusive: bool = True) -> OrderedLog:
        zero = F.lit(0).cast("bigint")

        def merge(a: Column, b: Column) -> Column:
            return F.coalesce(a, zero) + F.coalesce(b, zero)

        log = self._scan(name, F.sum, merge, value, inclusive)
        return log.with_df(log.df.withColumn(name, F.coalesce(F.col(name), zero)))

    def running_max(self, name: str, value: Column, inclusive: bool = True) -> OrderedLog:
        """Also the last value of a struct led by the order, since max skips nulls."""
        return self._scan(name, F.max, F.greatest, value, inclusive)

    def neighbour(self, columns: Mapping[str, str], ahead: bool = False) -> OrderedLog:
        """Add columns of the row just before (or just after) in the same key.

        ``columns`` maps new names to columns of the log. They are taken one by
        one, as a struct of them would go through the shuffle beside them.
        """
        window = self.window()
        pick = F.lead if ahead else F.lag
        inside = self.df.withColumns({name: pick(c).over(window) for name, c in columns.items()})
        if not self.chunks:
            return self.with_df(inside)
        # Inside a chunk that is all; its first row needs the nearest row of
        # the chunks before it.
        inside = inside.withColumn("_found", pick(self.seq).over(window).isNotNull())
        order = [F.col(c) for c in (self.seq, *self.ties)]
        entry = F.struct(*order, *[F.col(c).alias(name) for name, c in columns.items()])
        edge, nearest = (F.min(entry), F.min) if ahead else (F.max(entry), F.max)
        carry = (
            self.cut_rows.groupBy(*self.group)
            .agg(edge.alias("_edge"))
            .withColumn("_carry", nearest("_edge").over(self.chunk_window(backwards=ahead)))
            .drop("_edge")
        )
        joined = self.with_carry(inside, carry)
        merged = {n: F.when(F.col("_found"), F.col(n)).otherwise(F.col("_carry")[n]) for n in columns}
        return self.with_df(joined.withColumns(merged).drop("_found", "_carry"))
