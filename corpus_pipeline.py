"""The training-data pipeline: language ID, line dedup, near-dedup, decontamination and packing of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellforge.llm.common import fresh, settled, table, written
from cellforge.llm.decontaminate import decontaminate
from cellforge.llm.language_id import UNKNOWN, fit_language_model, held_out, identify_languages
from cellforge.llm.line_dedup import dedup_lines
from cellforge.llm.packing import pack_documents
from cellforge.llm.simhash import dedup_near, dedup_similar

#: Least words of a line in which a word edit is let pass.
CLEAN_WORDS = 8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter go, null and empty texts among them.

    Learned from the labelled documents that are not held out; with nothing learned no document has a language, and all go.
    Repeated rows are judged alike. Any other columns pass through, whatever their names.
    """
    model = fit_language_model(docs.where(~held_out("doc_id", 5, 0)))
    lang, score, bits = (fresh(docs.columns, n) for n in ("__lang", "__score", "__bits"))
    found = identify_languages(docs, model, out=(lang, score, bits))
    return found.where(F.col(lang) != UNKNOWN).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one (see line_dedup.line_decisions); n_chars follows the text.

    Documents that lose their last line go; null and empty texts stay; without a column n_chars there is none to follow. A word edit is let pass in lines of CLEAN_WORDS words
    or more: in shorter ones a word is over an eighth of the line, and many clean short lines differ in one.
    """
    out = dedup_lines(docs, fuzzy_words=CLEAN_WORDS)
    kinds = {c.lower(): k for c, k in docs.dtypes}
    return out.withColumn("n_chars", F.length("text").cast(kinds["n_chars"])).select(*docs.columns) if "n_chars" in kinds else out


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, by SimHash of 5-word shingles and then by their similarity of 0.8 or more.

    The least id of a group stays (ties: the least text hash; null ids last). Rows equal in id and text stay or go together.
    Null and word-less texts are one group. Any other columns pass through; an empty table gives no rows.
    """
    return dedup_similar(written(dedup_near(docs, shingle=5)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item; null and empty texts overlap none. All columns and repeated rows stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the remaining documents with their place in the training sequences (see packing.pack_documents).

    A null or empty text is the closing id alone; repeated rows are packed as often as they appear; an empty table gives no
    rows.
    """
    return pack_documents(docs, keep_ids=False)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can express neither the language model nor the tokenizer; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written and read again by the next, which then replaces it."""

    def after(n: int) -> DataFrame:
        """The written result of the first n stages."""
        return settled(spark, lambda: STAGES[n - 1][1](spark, after(n - 1), sf_dir)) if n else table(spark, sf_dir, "documents")

    return STAGES[-1][1](spark, after(len(STAGES) - 1), sf_dir)
