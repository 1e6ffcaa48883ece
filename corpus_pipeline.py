"""A training corpus from raw documents, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opweave.llm import jaccard, mixing, pieces, pii, toxicity
from opweave.llm._spark import written
from opweave.llm.mixing import WORD
from opweave.session import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half; labels of all folds train the scorer."""
    scorer = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    name = "toxic_score"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return toxicity.scored(docs, scorer, name).where(F.col(name) < 0.5).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-word shingles link at 0.8 or more: that of the smallest doc_id (a null
    one comes last), if that is repeated, of the smallest row key. Documents without words are in no group and stay."""
    groups = written(jaccard.linked_rows(docs, 5, 80)).where("component is not null")
    rows = groups.groupBy("component", "key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key", "n")).alias("x")).select("x.key", "x.n")
    keyed = docs.select(jaccard.row_key().alias("key"), F.coalesce(F.col("text").cast("string").rlike(WORD), F.lit(False)).alias("worded"), F.struct("*").alias("row"))
    out = keyed.where("worded").join(first.select("key").hint("merge"), "key", "left_semi")
    if first.where("n > 1").head(1):  # rows equal in doc_id and text: one of them
        out = out.dropDuplicates(["key"])
    return out.unionByName(keyed.where("not worded")).select("row.*")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with e-mail addresses, IP addresses, card and phone numbers masked."""
    return pii.masked(docs, pii.train(docs.select("doc_id", "text")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents whose tokens follow the target weights, as large as the scarcest cell allows."""
    rows = docs.select("doc_id", "text", "lang", "source", F.struct("*").alias("row"))  # no column of docs can clash
    return mixing.calibrated(rows, share=None).where("mix_kept").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces: doc_id, n_pieces, pieces, the best segmentations, round_trip."""
    return pieces.encoded(docs, pieces.Vocabulary.of_file())


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", mask_personal_data),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]
#: Learned scores and loopy inference are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
