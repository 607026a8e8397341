"""The operators as queries over the driver's tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kgloom.llm import chat, exact, mixing, packing, pii, quality, scoring, sharding, simhash, substring

#: Whole percentages: the four sources under contract, and all others together.
MIX_WEIGHTS = {"src0": 5, "src1": 5, "src2": 5, "src3": 5, "*": 80}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_disguised_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"))


def op4_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffle_into_shards(_table(spark, sf_dir, "documents"), shards=64, seed=2024)


def op5_bloom_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(_table(spark, sf_dir, "documents"))


def op6_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.remove_frequent_lines(_table(spark, sf_dir, "documents"))


def op7_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op8_difference_cover_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(_table(spark, sf_dir, "documents"))


def op9_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), MIX_WEIGHTS)


def op10_cuckoo_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    ops = [
        op1_best_fit_packing,
        op2_disguised_pii,
        op3_simhash_near_dedup,
        op4_hypergeometric_sharding,
        op5_bloom_lm_scores,
        op6_line_frequency,
        op7_role_repair,
        op8_difference_cover_passages,
        op9_pfair_mixing,
        op10_cuckoo_exact_dedup,
        pipeline,
    ]
    return {f.__name__: f for f in ops}


OP9_SQL = """
WITH RECURSIVE weights(s, w) AS (VALUES ('src0', 5::BIGINT), ('src1', 5), ('src2', 5), ('src3', 5), ('*', 80)),
docs AS (SELECT *, CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN source ELSE '*' END AS s FROM documents),
have AS (SELECT s, w, n FROM weights JOIN (SELECT s, count(*) AS n FROM docs GROUP BY s) x USING (s)),
-- a step fills one slot of a phase's period with the released block due first; the step after the last slot ends the phase
-- where a source lacks its block, and starts another with the sources that have some left
steps(phase, t, p, start, live, n, used, done, picks) AS (
  SELECT 0, 0::BIGINT, sum(w)::BIGINT, 0::BIGINT, map(list(s ORDER BY s), list(w ORDER BY s)), map(list(s ORDER BY s), list(n ORDER BY s)),
         map(list(s ORDER BY s), list(0::BIGINT ORDER BY s)), map(list(s ORDER BY s), list(0::BIGINT ORDER BY s)), []::VARCHAR[]
  FROM have HAVING count(*) > 0
  UNION ALL
  SELECT CASE WHEN going THEN phase ELSE phase + 1 END, CASE WHEN going THEN t + 1 ELSE 0 END, CASE WHEN going THEN p ELSE list_sum(map_values(rest))::BIGINT END,
         CASE WHEN going THEN start ELSE start + slots END, rest, n, gone,
         CASE WHEN going THEN map_from_entries(list_transform(map_entries(done), lambda e: {'k': e.key, 'v': e.value + CASE WHEN e.key = c THEN 1 ELSE 0 END}))
              ELSE map_from_entries(list_transform(map_keys(rest), lambda s: {'k': s, 'v': 0::BIGINT})) END,
         CASE WHEN going THEN list_append(picks, c) ELSE []::VARCHAR[] END
  FROM (SELECT *, CASE WHEN going THEN live ELSE map_from_entries(list_filter(map_entries(live), lambda e: n[e.key] > gone[e.key])) END AS rest
        FROM (SELECT *, CASE WHEN going THEN used ELSE map_from_entries(list_transform(map_entries(used), lambda e: {'k': e.key, 'v': e.value + CASE WHEN live[e.key] IS NULL THEN 0 ELSE
                          (slots // p) * live[e.key] + len(list_filter(range(slots % p), lambda i: picks[i + 1] = e.key)) END})) END AS gone
              FROM (SELECT *, t < p AS going,
                           list_sort(list_transform(list_filter(map_keys(live), lambda s: done[s] < live[s] AND (done[s] * p) // live[s] <= t),
                                                    lambda s: {'due': ((done[s] + 1) * p + live[s] - 1) // live[s], 's': s}))[1].s AS c,
                           list_min(list_transform(map_keys(live), lambda s: ((n[s] - used[s]) // live[s]) * p
                                                   + list_filter(range(p), lambda i: picks[i + 1] = s)[(n[s] - used[s]) % live[s] + 1])) AS slots
                    FROM steps) a) b) c
  WHERE len(map_keys(rest)) > 0),
ends AS (SELECT *, list_min(list_transform(map_keys(live), lambda s: ((n[s] - used[s]) // live[s]) * p
                                           + list_filter(range(p), lambda i: picks[i + 1] = s)[(n[s] - used[s]) % live[s] + 1])) AS slots FROM steps WHERE t = p),
places AS (SELECT phase, start, slots, p, slot, picks[slot + 1] AS s, live[picks[slot + 1]] AS w, used[picks[slot + 1]] AS lo,
                  row_number() OVER (PARTITION BY phase, picks[slot + 1] ORDER BY slot) - 1 AS nth FROM (SELECT *, unnest(range(p)) AS slot FROM ends) x),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY md5('mix|' || coalesce(doc_id::VARCHAR, 'null'))) - 1 AS r FROM docs)
SELECT doc_id, text, lang, source, n_chars, s AS mix_source, (start + ((r - lo) // w) * p + slot)::BIGINT AS mix_position, phase AS mix_phase
FROM ranked JOIN places USING (s) WHERE r >= lo AND nth = (r - lo) % w AND ((r - lo) // w) * p + slot < slots
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op6_line_frequency": quality.ORACLE,
        "op9_pfair_mixing": OP9_SQL,
        "op10_cuckoo_exact_dedup": "SELECT DISTINCT doc_id, dup_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS dup_of FROM documents) WHERE doc_id <> dup_of",
    }
