"""From raw documents to packed training sequences, five operators in a row.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept, and is
written as Parquet before the next one reads it.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm import dedup, langid, mixing, packing, toxicity
from panelweave.llm.common import hold, table
from panelweave.llm.queries import vocabulary_file


COLUMNS = ("text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a known language; null texts, texts without letters and undecided ones go.

    Repeated rows and rows that share an id stay; other columns go; an empty table gives an empty one.
    """
    model = langid.train(docs, vocabulary_path=vocabulary_file("piece_bpe_32k.model"))
    found = langid.predict(docs, model, keep=COLUMNS)
    return found.filter("lang_pred <> 'und' and score >= 0.5").select("doc_id", *COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine does not call toxic. It learns from all labelled rows: none is held out here.

    Null and empty texts are not toxic and stay, as do repeated rows; without labels all rows stay.
    """
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), out=F.lit(False))
    found = toxicity.predict(docs.withColumn("none", F.col("text").isNull()), machine, keep=("none", *COLUMNS))
    return found.filter("predicted = 0").withColumn("text", F.when(~F.col("none"), F.col("text"))).select("doc_id", *COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by five-word shingles at a similarity of 0.8: that of the smallest id.

    A repeated row stays once; different texts under one id that is kept stay; rows without an id stay, equal ones once.
    Null and empty texts are copies of nothing.
    """
    kept = dedup.group(docs, words=5, share=80).filter("kept").select("doc_id")
    named = docs.filter("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.filter("doc_id is null").dropDuplicates(["text"])).select("doc_id", *COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture wants them; rarer domains are raised and no document is dropped.

    Rows of one id share its rate; rows without an id, and those without tokens, come once.
    """
    labelled = mixing.domains_of(docs, table(spark, sf_dir, "labels"))
    copies = mixing.mix(docs, labelled, power=0.8, least=1.0).filter("doc_id is not null").groupBy("doc_id").agg(F.max("copies").alias("copies"))
    named = docs.join(copies, "doc_id").withColumn("again", F.explode(F.expr("array_repeat(0, copies)")))
    return named.select("doc_id", *COLUMNS).unionByName(docs.filter("doc_id is null").select("doc_id", *COLUMNS))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens. Null and empty texts are the end id alone; an empty table gives no rows."""
    return packing.pack(docs, tokenizer=vocabulary_file("word_bpe_49k.json"), capacity=4096, end_id=2)


STAGES = [
    ("language", language),
    ("toxicity", toxic),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("packing", sequences),
]

#: Models and union-find have no SQL form; the tests hold run() against a plain single-process version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = hold(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
