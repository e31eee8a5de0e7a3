"""The corpus operators as registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from aislelens.llm import centroids, embedding_dedup, exact_dedup, html_text, language, license_scan, merkle, mixture, packing, personal_data, sharding, simhash, token_files


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_documents(spark, sf_dir))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_documents(spark, sf_dir))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(personal_data.scan(_documents(spark, sf_dir)))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(_documents(spark, sf_dir))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "shard")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(_documents(spark, sf_dir))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_documents(spark, sf_dir), claim=merkle.tampered_claim())


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(_documents(spark, sf_dir))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digest(centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    **{
        f.__name__: f
        for f in (
            op1_language_id, op2_license_scan, op3_personal_data, op4_exact_dedup, op5_source_mix, op6_sharding, op7_embedding_dedup,
            op8_packing, op9_simhash, op10_html_text, op11_merkle_manifest, op12_token_files, op13_centroid_clusters,
        )
    },
}


def _clusters_sql(centroids: int = 16, rounds: int = 3) -> str:
    """Rounds of nearest centroids as one statement per step."""
    steps = [f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
    SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL
    QUALIFY c < {centroids}
)"""]
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (
    SELECT rid, any_value(k.v) AS v, any_value(vec_id) AS vec_id,
           min(struct_pack(d := (list_inner_product(k.v, k.v) + list_inner_product(m.v, m.v) - 2 * list_inner_product(k.v, m.v))::BIGINT, c := c)) AS best
    FROM kept k CROSS JOIN c{r} m GROUP BY rid
), sums{r} AS (
    SELECT c, i, floor(sum(x) / count(*)) AS x
    FROM (SELECT best.c AS c, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM near{r}) GROUP BY c, i
), c{r + 1} AS MATERIALIZED (
    SELECT m.c, coalesce(any_value(n.v), any_value(m.v)) AS v
    FROM c{r} m LEFT JOIN (SELECT c, list(x ORDER BY i) AS v FROM sums{r} GROUP BY c) n ON n.c = m.c GROUP BY m.c
)""")
    return ", ".join(steps) + f"""
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
       (sum(best.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(list_transform(m.v, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM near{rounds} JOIN c{rounds} m ON m.c = best.c
"""


def _manifest_sql(levels: int = 10, root_levels: int = 4) -> str:
    """The tree level by level: each level is one grouping, each path one join a level."""

    def leaf(text: str) -> str:
        parts = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(parts)})"

    table = "range(256)"
    for _ in range(8):
        table = f"list_transform({table}, lambda x: xor(x >> 1, (x & 1) * 3988292384))"
    others = "left(s, 64 * (i % 8)) || {} || substr(s, 64 * (i % 8) + 65)"
    steps = [f"""
WITH crc AS (SELECT {table} AS t), docs AS (
    SELECT *, xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
                              lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 3 = 0 AS drawn,
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered
    FROM documents, crc
), leaves AS (
    SELECT doc_id, lang, {leaf("text")} AS leaf, CASE WHEN drawn AND text IS NOT NULL THEN {leaf("lowered")} END AS claim FROM docs
), a0 AS (
    SELECT row_number() OVER () AS rid, *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
           count(*) OVER (PARTITION BY lang) AS n, leaf AS h, coalesce(claim, leaf) AS cur, '' AS proof
    FROM leaves
), t0 AS (SELECT lang, i, n, h FROM a0)"""]
    for k in range(levels):
        steps.append(f"""r{k} AS MATERIALIZED (SELECT lang, i // 8 AS r, string_agg(h, '' ORDER BY i) AS s, any_value(n) AS n FROM t{k} GROUP BY lang, r)""")
        steps.append(f"""t{k + 1} AS (SELECT lang, r AS i, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN sha256(s) ELSE s END AS h FROM r{k})""")
        steps.append(f"""a{k + 1} AS MATERIALIZED (
    SELECT a.* EXCLUDE (i, n, cur, proof), i // 8 AS i, (r.n + 7) // 8 AS n, CASE WHEN r.n > 1 THEN sha256({others.format("cur")}) ELSE cur END AS cur,
           CASE WHEN r.n > 1 THEN proof || {others.format("''")} ELSE proof END AS proof
    FROM a{k} a JOIN r{k} r ON a.lang IS NOT DISTINCT FROM r.lang AND a.i // 8 = r.r
)""")
    steps.append(f"""b0 AS (
    SELECT h AS subroot, lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h, '' AS proof FROM t{levels}
), u0 AS (SELECT i, n, h FROM b0), c0 AS (
    SELECT a.* EXCLUDE (i, n), b.subroot, b.i, b.n FROM a{levels} a JOIN b0 b ON a.lang IS NOT DISTINCT FROM b.lang
)""")
    for k in range(root_levels):
        steps.append(f"""v{k} AS MATERIALIZED (SELECT i // 8 AS r, string_agg(h, '' ORDER BY i) AS s, any_value(n) AS n FROM u{k} GROUP BY r)""")
        steps.append(f"""u{k + 1} AS (SELECT r AS i, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN sha256(s) ELSE s END AS h FROM v{k})""")
        steps.append(f"""c{k + 1} AS MATERIALIZED (
    SELECT c.* EXCLUDE (i, n, cur, proof), i // 8 AS i, (v.n + 7) // 8 AS n, CASE WHEN v.n > 1 THEN sha256({others.format("cur")}) ELSE cur END AS cur,
           CASE WHEN v.n > 1 THEN proof || {others.format("''")} ELSE proof END AS proof
    FROM c{k} c JOIN v{k} v ON c.i // 8 = v.r
)""")
    return ", ".join(steps) + f"""
SELECT doc_id, leaf, subroot, u.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = u.h AS verified
FROM c{root_levels}, u{root_levels} u
"""


ORACLE: dict[str, str] = {
    "op11_merkle_manifest": _manifest_sql(),
    "op13_centroid_clusters": _clusters_sql(),
    "op4_exact_dedup": r"""
WITH texts AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept,
       sha256(body) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY body)
""",
    "op5_source_mix": r"""
WITH docs AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           md5('42:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))) AS place
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM docs GROUP BY source
), weighed AS (
    SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap,
           ceil(source_size / 16)::BIGINT AS blocks FROM sources
), levels AS (
    SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER rising, 0)::DOUBLE)
              / (sum(weight) OVER () - coalesce(sum(weight) OVER rising, 0))::DOUBLE AS level
    FROM weighed
    WINDOW rising AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), aimed AS (
    SELECT *, least(cap::DOUBLE, max(level) OVER () * weight) AS target FROM levels
), seats AS (
    SELECT floor(round(sum(target), 3) / 16 + 0.5)::BIGINT AS n FROM aimed
), offers AS (
    SELECT rank, target / (2 * won + 1) AS quotient FROM (SELECT rank, target, unnest(range(2 * blocks + 64)) AS won FROM aimed WHERE target > 0)
), winners AS (
    SELECT rank FROM (SELECT rank, row_number() OVER (ORDER BY quotient DESC, rank) AS place FROM offers) WHERE place <= (SELECT n FROM seats)
), quotas AS (
    SELECT a.*, least(2 * blocks, coalesce(won, 0)) AS quota
    FROM aimed a LEFT JOIN (SELECT rank, count(*) AS won FROM winners GROUP BY rank) w USING (rank)
), runs AS (
    SELECT *, CASE WHEN blocks > 0 THEN quota // blocks ELSE 0 END AS passes, CASE WHEN blocks > 0 THEN quota % blocks ELSE 0 END AS run,
           CASE WHEN blocks > 0 THEN ('0x' || substr(md5('42:run:' || coalesce('=' || source, '')), 1, 8))::BIGINT % blocks ELSE 0 END AS first
    FROM quotas
), placed AS (
    SELECT d.doc_id, d.size, q.* EXCLUDE (source),
           coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
    FROM docs d JOIN runs q ON d.source IS NOT DISTINCT FROM q.source
), parts AS (
    SELECT *, greatest(0, least(start + size, least((first + run) * 16, source_size)) - greatest(start, first * 16)) AS tail,
           greatest(0, least(start + size, greatest(0, first + run - blocks) * 16) - start) AS head,
           CASE WHEN passes > 0 THEN start // 16 ELSE greatest(0, (start // 16 - first + blocks) % nullif(blocks, 0)) END AS ordinal
    FROM placed
), taken AS (SELECT *, passes * size + tail + head AS taken FROM parts)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
       CASE WHEN taken > 0 THEN least(7, ordinal * 8 // quota)::INTEGER END AS shard
FROM taken
""",
    "op7_embedding_dedup": """
WITH RECURSIVE vectors AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
), usable AS (
    SELECT * FROM vectors
    WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), reach(id, there) AS (
    SELECT vec_id, vec_id FROM vectors UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.there = l.a
), least AS (SELECT id, min(there) AS component_id FROM reach GROUP BY id)
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM vectors v JOIN least ON id = v.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) c ON c.a = v.vec_id
""",
}
