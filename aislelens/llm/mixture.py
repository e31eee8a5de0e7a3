"""Mixing sources to target weights by Sainte-Laguë apportionment.

Equal-token blocks go to sources by highest quotients. Every source gets an integer quota of
blocks, divided over the output shards; its documents are laid end to end in a seeded order
and the quota is taken as blocks of that stream. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislelens.llm.prefix import WORD, row_identity, seeded_order, seeded_slices, with_prefix, word_count
from aislelens.sources.files import cut_lineage

# Weights by rank of the source, share of all words, uses of one document.
WEIGHTS, VOLUME, MAX_USES = (5, 2, 1), 1.5, 2

#: Words in a block, output shards, seed of the order.
BLOCK, SHARDS, SEED = 16, 8, 42


def targets(sources: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, volume: float = VOLUME) -> DataFrame:
    """``sources`` (source, source_size) with rank, weight and target.

    Weights repeat along the sources in code-point order, null last. A target stops at
    ``MAX_USES`` times its source's size and the rest is reshared by weight: all targets below
    that are ``level * weight``. One row per source is the largest thing sorted here.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    rank = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", MAX_USES * F.col("source_size"))
    # Sources in the order in which they reach their caps as the level rises.
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    below, whole = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    capped = F.coalesce(F.sum("cap").over(below), F.lit(0))
    heavy = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(below), F.lit(0))
    levels = ranked.withColumn("level", (F.lit(float(volume)) * F.sum("source_size").over(whole) - capped) / heavy)
    target = F.least(F.col("cap").cast("double"), F.max("level").over(whole) * F.col("weight"))
    return levels.withColumn("target", target).drop("cap", "level")


def quotas(aimed: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """``aimed`` (rank, source_size, target) with its number of blocks and its quota of them.

    The seats are all blocks of the mixture. A divisor that surely gives too few seats fixes
    most of them; the rest go one by one to the highest quotients target / (2 seats + 1), of
    which each source offers as many as it could still win. Equal quotients go by rank.
    """
    whole = Window.partitionBy()
    seats = F.floor(F.round(F.sum("target").over(whole), 3) / block + 0.5)
    half = F.count("*").over(whole) / 2
    known = aimed.withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("seats", seats)
    sure = F.floor(F.col("target") * (F.col("seats") - half) / F.sum("target").over(whole) + 0.5)
    known = known.withColumn("sure", F.when((F.col("seats") > half) & (F.col("target") > 0), sure).otherwise(F.lit(0)).cast("bigint"))
    known = known.withColumn("open", F.col("seats") - F.sum("sure").over(whole))
    more = F.ceil(F.col("target") / F.sum("target").over(whole) * half * 2) + 2
    offers = known.filter("target > 0").withColumn("more", more).select(
        "rank", "open", F.col("target"), F.explode(F.sequence(F.col("sure"), F.col("sure") + F.col("more"))).alias("won")
    )
    quotient = F.col("target") / (2 * F.col("won") + 1)
    best = Window.orderBy(quotient.desc(), "rank")
    won = offers.withColumn("place", F.row_number().over(best)).filter("place <= open").groupBy("rank").agg(F.count("*").alias("extra"))
    quota = F.least(F.col("sure") + F.coalesce("extra", F.lit(0)), MAX_USES * F.col("blocks"))
    return known.join(won, "rank", "left").withColumn("quota", quota).drop("sure", "open", "seats", "extra")


def _overlap(low: Column, high: Column) -> Column:
    """Words of a document between two places of its source's stream."""
    start, end = F.col("start"), F.col("start") + F.col("size")
    return F.greatest(F.lit(0), F.least(end, high) - F.greatest(start, low))


def mix(docs: DataFrame, *, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """What the mixture takes of every document, one row per input row.

    Columns: doc_id, identity (the id, or a hash of the text), source, size (words, 0 for null text), source_size, target (its
    source's), taken, uses (times the whole document is taken), from_word and n_words (the
    part taken once more: words after the first ``from_word``, from its beginning again where
    the part passes the end; at most the two documents at the ends of a source's run are cut), shard (of its first block; null if nothing is
    taken). Repeated rows are separate documents; documents of size 0 are taken 0 words.

    Blocks are whole passes over the source's stream and one run of neighbouring blocks from
    a seeded place. Because the stream's order is seeded, the run is a random choice. The last
    block of a source may be short, so taken words miss the target by less than two blocks.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    order = seeded_order(seed, row_identity())
    rows = cut_lineage(
        docs.select("doc_id", "source", row_identity().alias("identity"), word_count("text").alias("size"), key.alias("key"), order.alias("order"))
        .withColumns(seeded_slices("order"))
    )
    sources = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    plan = quotas(targets(sources), block=block)
    place = F.conv(F.substring(seeded_order(seed, F.lit("run"), F.col("key")), 1, 8), 16, 10).cast("bigint")
    plan = plan.select(
        "key", "source_size", "target", "blocks", "quota",
        F.when(F.col("blocks") > 0, F.expr("quota div blocks")).otherwise(F.lit(0)).alias("passes"),
        F.when(F.col("blocks") > 0, F.col("quota") % F.col("blocks")).otherwise(F.lit(0)).alias("run"),
        F.when(F.col("blocks") > 0, place % F.col("blocks")).otherwise(F.lit(0)).alias("first"),
    )
    placed = with_prefix(rows, ["key"], ["slice", "coarse"], ["order", "size"], {"start": "size"}, plan)
    low, high = F.col("first") * block, F.least((F.col("first") + F.col("run")) * block, F.col("source_size"))
    wrapped = F.greatest(F.lit(0), F.col("first") + F.col("run") - F.col("blocks")) * block
    begun = F.expr(f"start div {block}")
    ordinal = F.when(F.col("passes") > 0, begun).otherwise(F.greatest(F.lit(0), (begun - F.col("first") + F.col("blocks")) % F.col("blocks")))
    tail, head = _overlap(low, high), _overlap(F.lit(0), wrapped)
    placed = placed.withColumns({"tail": tail, "head": head, "ordinal": ordinal})
    once_more = F.col("tail") + F.col("head")
    whole = (F.col("size") > 0) & (once_more == F.col("size"))
    taken = F.col("passes") * F.col("size") + once_more
    return placed.select(
        "doc_id", "identity", "source", "size", "source_size", "target", taken.alias("taken"),
        (F.col("passes") + whole.cast("bigint")).alias("uses"),
        F.when(whole | (once_more == 0), 0).when(F.col("tail") > 0, F.greatest(F.lit(0), low - F.col("start"))).otherwise(F.lit(0)).alias("from_word"),
        F.when(whole, 0).otherwise(once_more).alias("n_words"),
        F.when(taken > 0, F.least(F.lit(shards - 1), F.expr(f"ordinal * {shards} div quota"))).cast("int").alias("shard"),
    )


def _document_key() -> Column:
    """Rows with the same key are the same to the mixture: id (or text), size and source."""
    return F.concat_ws(":", "identity", "size", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))


def mixed(docs: DataFrame, **options: int) -> DataFrame:
    """The mixture itself: the columns of ``docs``, a row for every use of a document.

    A part of a document is its words joined by one space. A column n_chars follows the text;
    all other columns, whatever their names, are kept as they are. Rows of one key are numbered and take
    the uses that the mixture has for them in turn: few different ones, as only the documents at
    the ends of a run are cut.
    """
    plan = mix(docs, **options).filter("taken > 0").withColumn("key", _document_key())
    kinds = plan.groupBy("key", "uses", "from_word", "n_words").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("key").orderBy("uses", "from_word", "n_words").rowsBetween(Window.unboundedPreceding, -1)
    kinds = kinds.withColumn("after", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    by_key = kinds.groupBy("key").agg(F.collect_list(F.struct("after", "n", "uses", "from_word", "n_words")).alias("kinds"))
    rows = docs.select(F.struct("*").alias("row"), row_identity().alias("identity"), "source", word_count("text").alias("size"))
    rows = rows.select("row", _document_key().alias("key"))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("row.text"))))
    own = F.filter("kinds", lambda k: (F.col("copy") > k["after"]) & (F.col("copy") <= k["after"] + k["n"]))
    found = rows.join(by_key, "key").withColumn("own", F.get(own, F.lit(0))).filter("own is not null").select("row", "own.uses", "own.from_word", "own.n_words")
    uses = F.explode(F.sequence(F.lit(1), (F.col("uses") + (F.col("n_words") > 0).cast("int")).cast("int")))
    words = F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0))
    part = F.array_join(F.slice(F.concat(words, words), (F.col("from_word") + 1).cast("int"), F.col("n_words").cast("int")), " ")
    cut = F.col("use") > F.col("uses")
    out = found.select("row", "uses", "from_word", "n_words", uses.alias("use")).withColumn("text", F.when(cut, part).otherwise(F.col("row.text")))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        n_chars = F.when(cut, F.length("text")).otherwise(F.col("row.n_chars"))
        row = row.withField("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    return out.select(row.alias("row")).select("row.*")
