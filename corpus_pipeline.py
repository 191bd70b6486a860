"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents; the last adds the number of copies to take. doc_id may be
null or repeated: a row is a document of its own. Where every row has an id of its own, the stages work with that; only else they write
their input once with row numbers. Further columns pass through unchanged, whatever their names. An empty table passes through all
stages as an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from masklake.llm import decontaminate, language, linededup, mixing, ngramjoin
from masklake.llm.common import crc_bucket, slots
from masklake.operators.prefix import row_numbers
from masklake.session import checkpoint_root, delete, materialize, scratch

#: A text whose best language contains a smaller share of its n-grams is not prose of any language that was learned.
LEAST_SCORE = 0.2
#: A text of fewer letters has too few n-grams to be rejected by their share.
SHORTEST = 40
_READ = ("text", "source", "lang")


class Rows:
    """The rows of `docs` as `table`: a unique number as doc_id, the columns that operators read, all others under neutral names.

    Numbers grow with doc_id, null last. `back` are the columns of `docs`, to be selected from a table with those of `table`.
    """

    def __init__(self, docs: DataFrame, numbered: bool = True):
        kept = {c: f"kept{k}" for k, c in enumerate(docs.columns) if c not in _READ}
        self.names = kept
        self.back = [F.col(kept.get(c, c)).alias(c) for c in docs.columns]
        plain = docs.select(*[F.col(c).alias(kept.get(c, c)) for c in docs.columns], F.col("doc_id").cast("bigint").alias("doc_id"))
        self.table = plain
        if numbered and not docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
            order = [F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64(*[c for c in plain.columns if c != "doc_id"])]
            apart = plain.repartitionByRange(slots(plain), *order).sortWithinPartitions(*order)
            fixed = materialize(apart.withColumn("doc_id", F.monotonically_increasing_id()), "keyed")
            # a row's place in the order does not depend on the number of partitions, as the draws of the mix need
            places = materialize(row_numbers(fixed.select("doc_id"), [F.col("doc_id")], "place"), "places")
            self.table = fixed.join(places, "doc_id").drop("doc_id").withColumnRenamed("place", "doc_id")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that have letters and look like one of the languages learned from the labelled ones, or are too short to tell."""
    rows = Rows(docs, numbered=False)
    filters = language.train(docs.where(crc_bucket(F.col("doc_id"), 4) != 2))
    found = language.identify(rows.table.drop("doc_id"), filters)
    letters = F.length(F.regexp_replace("text", r"\P{L}+", ""))
    return found.where((F.col("lang_pred") != "und") & ((F.col("lang_score") >= LEAST_SCORE) | (letters < SHORTEST))).select(*rows.back)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that an earlier line of the corpus repeats; a document with nothing left but white space goes."""
    rows = Rows(docs)
    cut = linededup.dedup_lines(rows.table).where((F.size("lines_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    count = rows.names.get("n_chars")
    if count:
        cut = cut.withColumn(count, F.when(F.size("lines_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col(count)))
    return cut.select(*rows.back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id (one without an id only if none has one), of each class of near duplicates."""
    rows = Rows(docs)
    kept = ngramjoin.near_duplicates(rows.table.select("doc_id", "text")).where("doc_id = class_id").select("doc_id")
    return rows.table.join(kept, "doc_id", "left_semi").select(*rows.back)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of the benchmark occurs."""
    rows = Rows(docs)
    hits = decontaminate.find_benchmark(rows.table.select("doc_id", "text"), spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))
    hit = materialize(hits.where(F.size("spans") > 0).select("doc_id"), "contaminated")
    return rows.table.join(hit, "doc_id", "left_anti").select(*rows.back)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with `copies`, how often (in place of a column of that name). It draws by the row's number, the same in every run."""
    rows = Rows(docs)
    taken = mixing.mix(rows.table.select("doc_id", "text", "source")).where("copies > 0").select("doc_id", "copies")
    back: list[Column] = [c for c, name in zip(rows.back, docs.columns, strict=True) if name.lower() != "copies"]
    return rows.table.join(taken, "doc_id").select(*back, "copies")


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminate_benchmark),
    ("mixing sources to target weights", mix_sources),
]

#: SQL cannot express MinHash pruning, Bloom filters and the random mix; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns. A stage's intermediate tables and its input are deleted once its output is written."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    root = f"{checkpoint_root(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        if k:
            delete(spark, [f"{root}/{k - 1}"])
        docs = spark.read.parquet(f"{root}/{k}")
    return docs
