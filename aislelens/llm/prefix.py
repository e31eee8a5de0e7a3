"""Prefix sums over more rows than one task can hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows in a seeded order are cut into slices by this many hex digits of their hash.
SLICE_DIGITS = 4

WORD = r"[^\x20\x09-\x0D]+"


WHITE_SPACE = " \t\n\x0b\x0c\r"


def word_count(text: str) -> Column:
    """Words between white space; 0 for null.

    Each word and the space after it becomes one sign: counting matches would hold every word
    of a text as an object.
    """
    marks = F.regexp_replace(F.btrim(F.col(text), F.lit(WHITE_SPACE)), WORD + r"[\x20\x09-\x0D]*", "x")
    return F.coalesce(F.length(marks), F.lit(0)).cast("bigint")


def seeded_order(seed: int, *columns: Column) -> Column:
    """A hash that orders rows at random, the same in every run."""
    parts = [F.coalesce(c.cast("string"), F.lit("null")) for c in columns]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary"))


def row_identity(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What a row's place in a seeded order is drawn from: its id, or a hash of its text if it has none.

    Any share of the rows may lack an id and still spreads over all slices.
    """
    unnamed = F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    return F.coalesce(F.col(doc_id).cast("string"), unnamed)


def seeded_slices(order: str) -> dict[str, Column]:
    """Slices of rows sorted by ``seeded_order``: fine ones, and 256 coarse ones that hold them."""
    return {"slice": F.substring(order, 1, SLICE_DIGITS), "coarse": F.substring(order, 1, 2)}


def with_prefix(
    rows: DataFrame, group: list[str], slices: list[str], order: list[str | Column], sums: dict[str, str], facts: DataFrame | None = None,
) -> DataFrame:
    """Sum of a column over all rows before a row, in its group: ``sums`` maps new names to columns.

    ``slices`` are columns that are constant or rise along ``order``, each within the next.
    Totals per slice are formed before the shuffle and summed up, slices within slices; then
    only the rows of one slice are sorted together, so a group may hold any share of all
    rows. ``group`` must not hold nulls. ``facts``, one row per group, is joined to the
    totals, so that no row has to travel by its group alone.
    """
    if not slices:
        earlier = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        placed = rows.withColumns({n: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for n, c in sums.items()})
        return placed if facts is None else placed.join(facts, group)
    keys = [*group, *slices]
    totals = rows.groupBy(*keys).agg(*[F.sum(c).alias(f"_of_{n}") for n, c in sums.items()])
    offsets = with_prefix(totals, group, slices[1:], [slices[0]], {f"_to_{n}": f"_of_{n}" for n in sums}, facts)
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    placed = local.join(offsets, keys).withColumns({n: F.col(n) + F.col(f"_to_{n}") for n in sums})
    return placed.drop(*[f"_{x}_{n}" for n in sums for x in ("of", "to")])
