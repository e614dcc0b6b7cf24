"""The corpus pipeline: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chartloom.llm import bpe, line_dedup, mixing, quality_rules, simhash
from chartloom.llm.runtime import scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that fail them.

    Null, empty and blank texts fail. Rows are judged one by one, so nulls elsewhere, ties and repeated rows change nothing.
    Here as in all stages an empty table gives no rows, and all columns of documents, and any others, pass through.
    """
    return quality_rules.clean(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that copy an earlier one, by document id (null first) and line number. No document goes; null texts stay null, and rows of one id keep the same lines."""
    return line_dedup.dedup_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more: that of the smallest id.

    Candidates come from SimHash fingerprints that meet at an anchor, and are verified on the sets: no link is wrong, but some one in
    fifteen of those just over 0.8 is missed, and hardly any from 0.85 on. Texts without words are one group; rows equal in id
    and text are one; a row with a null id stays only where its whole group has none.
    """
    return simhash.keep_similar(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the sources' target proportions, as often as the mix takes them and in the order of its schedule.

    Null sources are one source, last in order. Texts without words aren't taken. Rows alike in id, source and text share what
    falls to them.
    """
    return mixing.mix_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the counts and digests of each row's token ids and of what they decode to. Null texts are empty; every row gives a row, repeated ones and ties too; texts of any length are encoded whole; other columns, whatever their names, are ignored."""
    import public_tokenizers

    return bpe.digests(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality rules", quality_stage), ("line dedup", line_stage), ("SimHash near-dedup", near_duplicate_stage), ("mixing sources", mixing_stage), ("byte-level BPE", encoding_stage)]

#: SQL has no XXH64 with a seed, nor the mix's shuffle; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each other stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    at = scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{at}/{k}")
            docs = spark.read.parquet(f"{at}/{k}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
