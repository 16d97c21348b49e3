"""Documents to a training mixture: five stages, each written as Parquet and read by the next.

Toxic documents go, of near copies one stays, documents with benchmark passages
go, personal data is replaced, and the rest is mixed to target weights. Every stage keeps
rows with nulls: a null text is an empty one. Empty tables stay empty; repeated rows are copies; of rows that tie
as copies the first by id and then by its place in the table stays; texts of any length are used whole; columns that clash with
those a stage makes for itself keep their values in all stages but the last. ORACLE_SQL is None: the
classifier, the alignments and the fitted rates cannot be said in SQL; the tests
hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import decontaminate, mixing, overlap_join, surrogates, toxicity
from glyphmill.llm.queries import TARGETS, domains, table
from glyphmill.session import bounded, settle

ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents that the classifier rejects.

    It is fitted on the labelled rows of the whole table of documents.
    """
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, name="_score")
    return scored.filter(F.col("_score") < toxicity.THRESHOLD).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of every group of linked documents one row, that with the smallest id (null comes last).

    Rows are told apart by a number of their own, so equal or null ids decide nothing about other
    rows. Empty texts are linked with nothing and all stay.
    """
    rows = settle(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    classes = settle(overlap_join.classes(rows.select("_row", "text"), key="_row"), "classes")
    linked = classes.filter("n_shingles > 0").select(F.col("doc_id").alias("_row"), "component_id")
    # Of a group by itself nothing goes; the rows of the others are ranked by an aggregate, not gathered.
    groups = linked.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component_id")
    linked = settle(linked.join(groups, "component_id"), "linked")
    named = rows.select("_row", F.col("doc_id").isNull().alias("none"), "doc_id").join(linked, "_row")
    first = named.groupBy("component_id").agg(F.min(F.struct("none", "doc_id", "_row"))["_row"].alias("_row")).select("_row")
    copies = bounded(linked.select("_row").join(first, "_row", "left_anti"), "copies", F.lit(8), 16 * 1024 * 1024)
    return rows.join(copies, "_row", "left_anti").drop("_row")


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents that hold a benchmark item."""
    found = decontaminate.with_leaks(docs, table(spark, sf_dir, "benchmark"), name="_leaks")
    return found.filter(F.size("_leaks") == 0).select(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data; ``n_chars`` follows the new text."""
    replaced = surrogates.replace_entities(docs, count="_entities")
    chars = F.when(F.col("_entities") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return replaced.withColumn("n_chars", chars).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its rate in the mixture and a whole number of copies drawn by that rate.

    The copies are the rate rounded up or down by a hash of the id, so their mean is the rate;
    a document of rate 0 has no part in the mixture and goes. The rates are settled before anything is asked of them,
    so no later step computes them again. Columns of documents named like the added ones give way to them.
    """
    found, _ = mixing.mix(docs, domains(docs, table(spark, sf_dir, "labels")), TARGETS)
    found = settle(found.select("row", "tokens", "rate"), "mixture")
    chance = F.pmod(F.xxhash64("row.doc_id"), F.lit(1 << 20)) / (1 << 20)
    copies = (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("bigint")).alias("copies")
    own = [F.col("row").getField(name).alias(name) for name in docs.columns if name not in ("tokens", "rate", "copies")]
    return found.filter(F.col("rate") > 0).select(*own, "tokens", "rate", copies)


STAGES = [
    ("toxicity", toxic),
    ("jaccard_join", near_copies),
    ("decontamination", contaminated),
    ("pii", private),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
