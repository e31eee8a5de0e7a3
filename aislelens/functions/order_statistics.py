"""Exact quantiles and tiles as lazy plans, without sorting everything into one task.

To find the rows at a few ranks, rows are counted per part of their range (a grouped count,
combined on the map side), the part that each rank falls in is picked, and the values in that
part are counted; ties go on with the unique id in the same way. The number of steps is fixed,
so all of them are one plan: nothing runs while it is defined, and the result always follows
the data. Parts are shares of a doubling, ``PARTS`` of them to each: a step sorts the counts of
some doublings, or the different values of one part, and only one row per wanted rank goes from
step to step. Of a table that Spark estimates at ``SMALL_BYTES`` or less, one task sorts the
different values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, DoubleType, FloatType, NumericType

#: Parts of a doubling: integers below 2 ** 38 have at most some millions of values in one part.
PARTS = 1 << 16
#: Estimated size up to which one task may sort all values.
SMALL_BYTES = 64 << 20
#: Above and below the logarithms of all doubles.
LOG_RANGE = 1_100.0


# ---- parts -----------------------------------------------------------------------------

def _part(x: Column) -> Column:
    """A number that rises with a double; infinities lie beyond all others and NaN above them."""
    size = F.least(F.log2(F.abs(x)), F.lit(LOG_RANGE - 1)) + LOG_RANGE
    placed = F.when(F.isnan(x), F.lit(3 * LOG_RANGE)).when(x == 0, F.lit(0.0)).when(x < 0, -size).otherwise(size)
    return F.floor(placed * PARTS)


def _common_type(kinds: list[DataType]) -> str:
    """The type in which values of several columns are compared."""
    if any(isinstance(k, (DoubleType, FloatType)) for k in kinds):
        return "double"
    scales = [k.scale for k in kinds if isinstance(k, DecimalType)]
    return f"decimal(38,{max(scales)})" if scales else "bigint"


#: Steps in which a value is settled; rows without a value come last.
VALUE_STEPS = [["absent", "part"], ["exact"]]
#: Ties: the parts of ids are counted with the values, few of which share a part.
TIE_STEPS = [["absent", "part"], ["exact", "id_part"], ["id"]]


def _ordered(x: Column, kind: DataType, common: str, descending: bool = False) -> dict[str, Column]:
    """Columns that together have the order of a value, NULLs last."""
    if not isinstance(kind, NumericType):
        raise TypeError(f"no quantiles of {kind.simpleString()}")
    part, exact = _part(x.cast("double")), x.cast(common)
    if descending:
        part, exact = -part, F.bitwise_not(exact) if common == "bigint" else -exact
    return {"absent": x.isNull(), "part": F.coalesce(part, F.lit(0).cast("bigint")), "exact": F.coalesce(exact, F.lit(0).cast(common))}


def _few(rows: DataFrame) -> bool:
    """Whether one task may sort the rows; the estimate runs no job."""
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_BYTES


# ---- ranks -----------------------------------------------------------------------------

def _rows_at(keyed: DataFrame, steps: list[list[str]], ranks: Callable[[Column], Column], payload: list[str]) -> DataFrame:
    """Per measure the rows at some 0-based ranks, with the columns of ``steps`` and ``payload``.

    ``keyed`` has a column ``measure``. ``ranks`` maps the number of a measure's rows to an
    array of structs whose field ``rank`` says which rows are wanted; its other fields come
    with the rows found.
    """
    path = ["measure"]
    state = None
    for step in steps:
        last = step is steps[-1]
        rows = keyed if state is None else keyed.join(F.broadcast(state), path)  # at most one row per wanted rank
        held = [] if state is None else ["wanted"]
        counts = rows.groupBy(*path, *held, *step).agg(
            F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in payload if last]
        )
        in_path = Window.partitionBy(*path)
        before = F.coalesce(F.sum("n").over(in_path.orderBy(*step).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = counts.withColumn("before", before)
        if state is None:
            placed = placed.withColumn("wanted", ranks(F.sum("n").over(in_path)))
        here = F.filter("wanted", lambda w: (w["rank"] >= F.col("before")) & (w["rank"] < F.col("before") + F.col("n")))
        left = F.transform(here, lambda w: w.withField("rank", w["rank"] - F.col("before")))
        path = [*path, *step]
        kept = [*path, *[c for c in payload if last]]
        state = placed.select(*kept, left.alias("wanted")).filter(F.size("wanted") > 0)
    return state.select(*kept, F.inline("wanted"))


def _measures(rows: DataFrame, values: list[str], descending: bool, others: list[str], more: dict[str, Column]) -> DataFrame:
    """One row per row and value column, with the column's number as ``measure``: all columns are read in one pass."""
    kinds = {f.name: f.dataType for f in rows.schema}
    common = _common_type([kinds[c] for c in values])
    structs = [
        F.struct(F.lit(n).alias("measure"), F.col(c).cast("double").alias("value"), *[
            d.alias(name) for name, d in {**_ordered(F.col(c), kinds[c], common, descending), **more}.items()
        ])
        for n, c in enumerate(values)
    ]
    return rows.select(*others, *values).select(F.inline(F.array(*structs)))


def quantiles(rows: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """Linearly interpolated quantiles of each column's non-null values, as (column_name, q0, q1, ...).

    A column without values has no row. Infinities and NaN (the greatest value) take part.
    """
    def wanted(size: Column) -> Column:
        structs = []
        for n, p in enumerate(probs):
            at = F.lit(float(p)) * (size - 1)
            for side, rank in enumerate((F.floor(at), F.ceil(at))):
                structs.append(F.struct(F.lit(2 * n + side).alias("no"), rank.cast("bigint").alias("rank"), (at - F.floor(at)).alias("share")))
        return F.array(*structs)

    keyed = _measures(rows, columns, False, [], {}).filter(~F.col("absent"))
    found = _rows_at(keyed, [["exact"]] if _few(rows) else VALUE_STEPS, wanted, ["value"])

    def one(n: int) -> Column:
        low, high = (F.max(F.when(F.col("no") == 2 * n + side, F.col("value"))) for side in (0, 1))
        share = F.max(F.when(F.col("no") == 2 * n, F.col("share")))
        return F.when(low == high, low).otherwise(low + (high - low) * share).alias(f"q{n}")

    names = F.array(*map(F.lit, columns))
    per_measure = found.groupBy("measure").agg(*[one(n) for n in range(len(probs))])
    return per_measure.select(F.element_at(names, F.col("measure") + 1).alias("column_name"), *[f"q{n}" for n in range(len(probs))])


def with_tiles(df: DataFrame, tiles: int, names: dict[str, str], unique_id: str) -> DataFrame:
    """Number rows 1..tiles in equal shares, by value descending and then id ascending.

    ``names`` maps each value column to the name of its tile. The first (rows mod tiles) tiles
    hold one row more. Only the first row of each tile is looked for; a row's tile is then the
    count of tile starts it has reached. Rows without a value come last, by id, an integer.
    A small table is numbered by a window over all its rows.
    """
    if _few(df):
        return df.withColumns({
            name: F.ntile(tiles).over(Window.orderBy(F.desc_nulls_last(value), unique_id)) for value, name in names.items()
        })
    def starts(size: Column) -> Column:
        more = size % tiles
        every = [
            F.struct(F.lit(t).alias("no"), (t * F.floor(size / tiles) + F.least(F.lit(t), more)).cast("bigint").alias("rank")) for t in range(1, tiles)
        ]
        return F.filter(F.array(*every), lambda w: w["rank"] < size)

    if tiles < 2:
        return df.withColumns({name: F.lit(1) for name in names.values()})
    kinds = {f.name: f.dataType for f in df.schema}
    common = _common_type([kinds[c] for c in names])
    own_id = F.col(unique_id).cast("bigint")
    keyed = _measures(df, list(names), True, [unique_id], {"id_part": _part(own_id.cast("double")), "id": own_id})
    found = _rows_at(keyed, TIE_STEPS, starts, []).groupBy().agg(
        F.collect_list(F.struct("measure", F.struct("absent", "part", "exact", "id").alias("at"))).alias("_starts")
    )

    def tile(number: int, column: str) -> Column:
        ordered = _ordered(F.col(column), kinds[column], common, True)
        own = F.struct(*[c.alias(n) for n, c in {**ordered, "id": own_id}.items()])
        reached = F.filter("_starts", lambda s: (s["measure"] == number) & (s["at"] <= own))
        return 1 + F.coalesce(F.size(reached), F.lit(0))

    started = df.join(F.broadcast(found))  # one row, with an entry per tile
    return started.withColumns({name: tile(n, column) for n, (column, name) in enumerate(names.items())}).drop("_starts")


def with_quantiles(df: DataFrame, column: str, names: dict[str, float]) -> DataFrame:
    """The rows with quantiles of one of their columns; no rows if it has no values."""
    found = quantiles(df, [column], list(names.values())).select(*[F.col(f"q{n}").alias(name) for n, name in enumerate(names)])
    return df.join(F.broadcast(found))  # one row
