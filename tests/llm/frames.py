"""Small tables with awkward rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Extra columns named like columns that operators use inside.
CLASHING = "kept, size, uid, hash, sha, fp, slot, shard, taken, node, order, slice, coarse, body, words, piece, n_words, _key, key, _sha, _copy, copy, uses, use, row, a.b, component_id"


def documents(spark: SparkSession, rows: list[tuple], clashing: bool = False) -> DataFrame:
    """Rows of (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, *[None] * (4 - len(r)))[:4] for r in rows]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in full], SCHEMA).repartition(3)
    if clashing:
        for name in CLASHING.split(", "):
            df = df.selectExpr("*", f"'x' as `{name}`")
    return df


AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "a"),
    (2, "the  quick brown\tfox jumps over the lazy dog", "en", "b"),
    (3, None, None, None), (4, "", "en", "a"), (5, " \n ", None, "a"),
    (6, "MIT License", "en", "c"), (6, "MIT License", "en", "c"),
    (None, "no id here", "en", "b"), (None, None, None, None),
    (7, "x" * 50_000, None, "a"), (8, "wörd " * 30_000, "de", "b"), (9, "123 456 !!", "fr", "é"),
]
