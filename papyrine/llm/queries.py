"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from papyrine.llm import bfd_segment_tree, chroma, factorization_machine, fill_in_middle, filter_audit, line_frequency, linear_grouping, piece_merges, run_length_index, simhash_vp, suffix_automaton, template_tree, water_filling
from papyrine.llm.common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_automaton.digest(table(spark, sf_dir, "documents"))


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.judged(table(spark, sf_dir, "documents"))


def op3_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return factorization_machine.scored(docs, factorization_machine.train(docs, table(spark, sf_dir, "labels")))


def op4_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test tables hold no audio: the bytes of a text are taken as 8-bit PCM."""
    docs = table(spark, sf_dir, "documents")
    return chroma.search(docs.select("doc_id", F.col("text").cast("binary").alias("media")))


def op5_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_length_index.digest(table(spark, sf_dir, "documents"))


def op6_simhash_vp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vp.near_duplicates(table(spark, sf_dir, "documents"))


def op7_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_tree.summary(table(spark, sf_dir, "documents"))


def op8_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return water_filling.mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op9_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear_grouping.packed(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_bfd_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bfd_segment_tree.digest(bfd_segment_tree.sequences(table(spark, sf_dir, "documents"), tokenizer_path()))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_piece_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_merges.digest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_automaton": suffix_automaton.ORACLE,
        "op2_line_frequency": line_frequency.ORACLE,
        "op5_run_length_index": run_length_index.ORACLE,
        "op7_template_tree": template_tree.ORACLE,
        "op11_fill_in_middle": fill_in_middle.ORACLE,
        "op12_filter_audit": filter_audit.ORACLE,
    }
