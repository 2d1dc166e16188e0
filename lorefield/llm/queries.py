"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .cotraining import score_quality
from .exact_dedup import exact_groups
from .forest import near_duplicates
from .html_extract import extract_main_text
from .jaccard_join import jaccard_components
from .line_dedup import line_dedup
from .merkle import manifest
from .mixing import mix
from .packing import pack
from .quality_rules import quality_rules
from .runs import collapse_runs
from .sharding import shard_by_size
from .sql import COMPONENTS, MANIFEST, RUNS
from .surrogates import surrogate_pii


#: Session setting that holds the secret key of op8's surrogates.
KEY_SETTING = "spark.lorefield.surrogates.key"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op4_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry_text=False)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_size(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(KEY_SETTING, "for tests only")
    return surrogate_pii(table(spark, sf_dir, "documents"), key=key)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_runs(table(spark, sf_dir, "documents"), plant=True, digest=True)


def op12_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=5, percent=85)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_mix_sources, op2_html_extraction, op3_jaccard_join, op4_cotraining, op5_quality_rules, op6_sampled_splitters, op7_line_dedup,
    op8_surrogates, op9_exact_dedup, op10_pack, op11_periodic_runs, op12_lsh_forest, op13_merkle_manifest)}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op7_line_dedup"] = rf"""
with lines as (select rowid as r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as n from (select row_number() over () as rowid, doc_id, text from documents)),
keyed as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
common as (select key from keyed where length(key) >= 1 group by key having count(distinct r) >= 10)
select doc_id, count(*) as n_lines, count(*) filter (key in (select key from common)) as n_dropped,
 sha256(coalesce(string_agg(case when key not in (select key from common) then line end, chr(10) order by n), '')) as kept_sha256 from keyed group by r, doc_id"""
ORACLE_SQL["op9_exact_dedup"] = r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
g as (select *, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size from d)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from g"""
ORACLE_SQL["op3_jaccard_join"] = COMPONENTS.format(width=4, kept="")
ORACLE_SQL["op11_periodic_runs"] = RUNS
ORACLE_SQL["op12_lsh_forest"] = COMPONENTS.format(width=5, kept=", coalesce(doc_id = component_id, doc_id is null and component_id is null) as kept")
ORACLE_SQL["op13_merkle_manifest"] = MANIFEST
