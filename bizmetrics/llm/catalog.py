"""The queries of this subpackage by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizmetrics.llm import sql, warc
from bizmetrics.llm.decontamination import contaminated
from bizmetrics.llm.files import output_folder
from bizmetrics.llm.filter_audit import FIVE, filter_audit, five_filters
from bizmetrics.llm.html_extraction import extract
from bizmetrics.llm.jaccard_join import near_duplicates
from bizmetrics.llm.license_scan import license_scan
from bizmetrics.llm.line_dedup import line_dedup
from bizmetrics.llm.quality_model import score_quality
from bizmetrics.llm.quality_rules import quality_rules
from bizmetrics.llm.source_mixing import mix_sources
from bizmetrics.llm.spelling_variants import spelling_variants
from bizmetrics.llm.substring_dedup import substring_dedup
from bizmetrics.llm.text import table
from bizmetrics.llm.token_files import read_ids, write_ids

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_ids(table(spark, sf_dir, "documents"), default_tokenizer())
    return read_ids(manifest, ids=False).drop("ids")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 4) for c in ("class_distance", "word_distance")})


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_removed", F.md5("kept_text").alias("kept_md5"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = output_folder(spark, "warc")
    warc.write_bundles(warc.mark_revisits(table(spark, sf_dir, "pages")), folder=folder)
    records = warc.read_bundles(spark, folder)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = five_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit(judged, FIVE, ("good", "toxic"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2(F.coalesce("kept_text", F.lit("")), 256)
    return cut.select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))


def queries() -> dict[str, Query]:
    named = [
        op1_license_scan,
        op2_token_files,
        op3_quality_rules,
        op4_jaccard_join,
        op5_line_dedup,
        op6_benchmark_decontamination,
        op7_warc_bundles,
        op8_quality_classifier,
        op9_source_mixing,
        op10_html_extraction,
        op11_filter_audit,
        op12_spelling_variants,
        op13_substring_dedup,
    ]
    return {q.__name__: q for q in named}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": sql.license_scan(),
        "op3_quality_rules": sql.quality_rules(),
        "op5_line_dedup": sql.line_dedup(),
        "op7_warc_bundles": sql.warc_bundles(),
        "op9_source_mixing": sql.source_mixing(),
        "op11_filter_audit": sql.filter_audit(),
        "op13_substring_dedup": sql.substring_dedup(),
    }
