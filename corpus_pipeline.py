"""A corpus prepared for training, stage by stage.

Documents that no language explains go, lines that many documents share go, one document of each
group of near duplicates stays, sources are mixed to their target weights, and the result is
packed into sequences. Every stage takes `(spark, docs, sf_dir)`; its result is written as
Parquet and read again as the next one's `docs`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tacitrec.llm.common import documents, word_count
from tacitrec.llm.language import UNKNOWN, fit, held_out, identify
from tacitrec.llm.line_dedup import drop_frequent_lines
from tacitrec.llm.mixing import emit, mix
from tacitrec.llm.packing import pack
from tacitrec.llm.queries import pack_params
from tacitrec.llm.simhash import one_per_component
from tacitrec.tables import write_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts and texts without letters go, and texts that no mixture of languages explains.

    The model learns from the rows of `docs` that are labelled and not held out. A text goes if its
    n-grams are less likely, under the best mixture of learned languages, than text of these languages
    of its length is; one in several learned languages stays. Without any label nothing can be told,
    and all rows with letters stay. Repeated rows are judged alike; columns of any name are kept.
    """
    model = fit(docs.filter(~held_out()))
    if not model.languages:
        return docs.filter(F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False)))
    found = identify(docs.select(F.struct("*").alias("doc"), "text"), model)
    known = (F.col("lang_pred") != UNKNOWN) & (F.col("fit_score") >= F.col("expected_fit"))
    return found.filter(known).select("doc.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more go; `n_chars` follows the text; emptied documents stay.

    Repeated rows count as documents each; columns of any name are kept.
    """
    kept = drop_frequent_lines(docs.select(F.struct("*").alias("doc"), "text"), min_docs=10)
    fields = [
        F.col("text") if name == "text"
        else F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias(name) if name == "n_chars"
        else F.col(f"doc.`{name}`")
        for name in docs.columns
    ]
    return kept.select(*fields)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked fingerprints stays.

    Of rows with that same id one stays; null ids come last. Columns of any name are kept.
    """
    return one_per_component(docs, shingle=4, seed=42, distance=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated so that the words of the sources come near their targets.

    Rows of equal ids are drawn alike; columns of any name are kept.
    """
    wrapped = docs.select(F.struct("*").alias("doc"), "doc_id", "source", word_count(F.col("text")).alias("words"))
    return emit(mix(wrapped, "doc_id", "source", F.col("words")).select("doc", "copies")).select("doc.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 tokens; copies of a document are pieces of their own."""
    pieces = pack(docs, pack_params())
    return pieces.select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("language", identify_language),
    ("lines", drop_lines),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Language shares, fingerprints and tokens are beyond SQL; the tests hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; returns the pieces."""
    docs = documents(spark, sf_dir)
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = write_table(docs, f"stage-{place}")
    return docs
