"""A training corpus from the table ``documents``, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the
next stage's ``docs``.  All but the last return the columns of ``documents``.

1. language ID drops documents without a letter (nothing can be told about them) and sets ``lang`` to the language
   found in the others;
2. line dedup removes repeated stretches of lines from the texts; a document of which nothing stays goes;
3. MinHash keeps the smallest doc_id of each group of near-duplicates;
4. benchmark decontamination drops documents that hold a passage of ``benchmark``;
5. BPE encodes and decodes what is left and returns the digests of both.

Cases, in every stage: null texts count as empty and go with the first stage; rows without a doc_id can't be named as
copies or leaks and stay; of rows that repeat a doc_id each is judged by its own text by stages 1 and 2, while 3 and 4 drop
the id with all its rows or none; ties go to the smallest doc_id; very long texts are taken whole; an empty table gives
an empty table; columns that documents have beside its own pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm import bpe, decontaminate, langid, linededup, minhash
from palaver.llm.shared import crc_mod, discard, fresh, materialize, new_path, scratch, stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a letter; ``lang`` becomes the language found.  Learned from three quarters of the rows."""
    model = langid.learn(langid.training_sample(docs.where(crc_mod("doc_id", 4) != 2), "doc_id", "text", "lang"))
    found, score = fresh(docs, "found"), fresh(docs, "score")
    out = langid.identify(docs, model, pred_col=found, score_col=score).where(F.col(found) != langid.UNKNOWN)
    return out.withColumn("lang", F.col(found)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated stretches of lines; documents of which only white space stays go."""
    out = linededup.dedup(docs, whole=True).where(F.col("text").rlike(r"\S"))
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, the one with the smallest doc_id."""
    dropped = materialize(minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct(), "dropped")
    return decontaminate.without(docs, dropped)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each text's ids and of the text decoded from them."""
    return bpe.encode_documents(docs, bpe.read_vocabulary(bpe.default_vocabulary()), digests=True)


STAGES = [("language ID", language), ("line dedup", lines), ("MinHash near-dedup", near), ("benchmark decontamination", clean), ("BPE", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = new_path(spark, f"stage{k + 1}")
        with scratch():
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        discard(before)
        docs = before = stored(spark, path, out.schema)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
