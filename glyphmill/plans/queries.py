"""The registered queries: every operator over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import ids as I
from glyphmill.functions import text as X
from glyphmill.functions import vectors as V
from glyphmill.operators import batches, evaluate, lexicon, profile, quality, tokens
from glyphmill.operators.distinct import embed_distinct as embed_different_texts
from glyphmill.operators.embed import embed as embed_texts
from glyphmill.operators.embed import encode as encode_texts
from glyphmill.operators.table_function import register_texts
from glyphmill.operators.words import word_table
from glyphmill.plans.fixture import MixingEncoder, PickyEncoder, table, texts, vocabulary
from glyphmill.session import settle, shared_folder, spread
from glyphmill.sinks import files
from glyphmill.sources import texts as text_sources
from glyphmill.sources.vocabulary import forward, special_tokens, token_lines
from glyphmill.streaming import lexicon_state

Query = Callable[[SparkSession, str], DataFrame]


def joined(values: str | Column) -> Column:
    """An array as text, so that every engine compares the same value."""
    return F.array_join(F.transform(values, lambda x: x.cast("string")), " ")


def rounded(value: str | Column) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, 6)


def exploded(vectors: DataFrame, key: str, vector: Column) -> DataFrame:
    rows = vectors.select(key, F.posexplode(vector).alias("pos", "value"))
    return rows.select(key, F.col("pos").cast("bigint").alias("pos"), rounded("value").alias("value"))


# --- text functions -------------------------------------------------------


def _text_query(function: Callable[[Column], Column], name: str) -> Query:
    return lambda spark, folder: texts(spark, folder).select("text_id", function(F.col("text")).alias(name))


ascii_lower = _text_query(X.ascii_lower, "lowered")
isolate_punct = _text_query(X.isolate_punctuation, "isolated")
collapse_ws = _text_query(X.collapse_whitespace, "collapsed")
trim_ends = _text_query(X.trim_ends, "trimmed")
preprocess = _text_query(X.preprocess, "processed")
preview = _text_query(X.preview, "shown")


def words(spark: SparkSession, folder: str) -> DataFrame:
    found = word_table(texts(spark, folder))
    return found.select("text_id", F.col("wpos").cast("bigint").alias("wpos"), "word")


# --- sources --------------------------------------------------------------


def _blobs(spark: SparkSession, folder: str, delimiter: str) -> DataFrame:
    """Each document as one delimited value: its lines are the texts, a newline ends it."""
    blob = F.concat(F.replace(F.col("text"), F.lit("\n"), F.lit(delimiter)), F.lit("\n"))
    return texts(spark, folder).select("text_id", blob.alias("blob"))


def _split(spark: SparkSession, folder: str, delimiter: str, **options) -> DataFrame:
    found = text_sources.split_blobs(_blobs(spark, folder, delimiter), "text_id", "blob", delimiter, **options)
    return found.select("text_id", F.col("position").cast("bigint").alias("position"), "text")


def split_nul(spark: SparkSession, folder: str) -> DataFrame:
    return _split(spark, folder, text_sources.NUL)


def split_custom(spark: SparkSession, folder: str) -> DataFrame:
    return _split(spark, folder, "|||")


def split_keep_empty(spark: SparkSession, folder: str) -> DataFrame:
    return _split(spark, folder, ". ", drop_empty=False)


def _delimited(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of each language as one delimited file in parts, in order of their ids, read back: ``(file, position, text)``."""
    path = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    named = table(spark, folder, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), "doc_id", "text")
    ordered = named.repartitionByRange("lang", "doc_id").sortWithinPartitions("lang", "doc_id").select("lang", "text")
    ordered.write.partitionBy("lang").option("lineSep", text_sources.NUL).text(path)
    return text_sources.read_delimited(spark, path, parts=True).withColumn("file", F.regexp_extract("file", "lang=([^/]+)", 1))


def delimited_file(spark: SparkSession, folder: str) -> DataFrame:
    return _delimited(spark, folder)


def file_to_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Delimited files to lines of numbers, in the order of the files: the line of a vector is the place of its text."""
    listed = _delimited(spark, folder)
    path = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    own = embed_texts(listed, vocabulary(spark, folder), MixingEncoder(), keys=("file", "position"))
    files.write_text(own, path, "file", "position")
    lines = files.read_text(spark, path).select("line", F.col("value").alias("vector"), "status")
    paired = text_sources.with_line(listed.select("file", "position")).join(lines, "line", "left")
    return paired.select("file", "position", "line", "vector", "status")


def _vocabulary_files(spark: SparkSession, folder: str) -> DataFrame:
    """Each document as a vocabulary file: a token per line, tabs inside, a special token at the end."""
    documents = table(spark, folder, "documents")
    lines = F.replace(F.col("text"), F.lit(", "), F.lit("\t"))
    ending = F.when(F.col("lang") == "en", F.lit("\n[UNK]\n")).otherwise(F.lit(""))
    content = F.concat(lines, F.lit("\n\n[CLS]\nthe\n"), ending)
    rows = documents.select("doc_id", F.posexplode(token_lines(content)).alias("token_id", "token"))
    return rows.select("doc_id", F.col("token_id").cast("bigint").alias("token_id"), "token")


def vocab_reverse(spark: SparkSession, folder: str) -> DataFrame:
    return _vocabulary_files(spark, folder)


def vocab_forward(spark: SparkSession, folder: str) -> DataFrame:
    return forward(_vocabulary_files(spark, folder), "doc_id")


def special_ids(spark: SparkSession, folder: str) -> DataFrame:
    return special_tokens(_vocabulary_files(spark, folder), "doc_id")


def learnt_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return vocabulary(spark, folder).entries.select("token", F.col("token_id").cast("bigint").alias("token_id"))


# --- tokens ---------------------------------------------------------------


def wordpiece(spark: SparkSession, folder: str) -> DataFrame:
    distinct = lexicon.count_words(word_table(texts(spark, folder)))
    pieces = lexicon.segment(distinct, vocabulary(spark, folder), value="token", named=True)
    return pieces.select("word", "n", F.array_join("pieces", " ").alias("pieces"))


def token_ids(spark: SparkSession, folder: str) -> DataFrame:
    distinct = lexicon.count_words(word_table(texts(spark, folder)))
    found = tokens.lookup_ids(distinct, vocabulary(spark, folder), "word")
    return found.select("word", F.col("token_id").cast("bigint").alias("token_id"))


def _tokenized(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.tokenize(texts(spark, folder), vocabulary(spark, folder))


def tokenize(spark: SparkSession, folder: str) -> DataFrame:
    return _tokenized(spark, folder).select("text_id", joined("token_ids").alias("token_ids"))


def tokenize_by_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    """The same result with almost nothing broadcast: rare words are joined by a shuffle."""
    found = tokens.tokenize(texts(spark, folder), vocabulary(spark, folder), limit=64 * 1024)
    return found.select("text_id", joined("token_ids").alias("token_ids"))


def tokenize_conversations(spark: SparkSession, folder: str) -> DataFrame:
    turns = spread(table(spark, folder, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")
    found = tokens.tokenize(turns, vocabulary(spark, folder), keys=("conv_id", "turn"))
    return found.select("conv_id", "turn", joined("token_ids").alias("token_ids"))


def tokenize_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as a stream of three micro-batches, a file for every core each: words met before are looked up in the stream's state."""
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    documents, files_at_once = texts(spark, folder), spark.sparkContext.defaultParallelism
    documents.repartition(3 * files_at_once, "text_id").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(documents.schema).option("maxFilesPerTrigger", files_at_once).parquet(f"{path}/in")
    lexicon_state.tokenize_stream(stream, vocabulary(spark, folder), f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("text_id", joined("token_ids").alias("token_ids"))


def token_table(spark: SparkSession, folder: str) -> DataFrame:
    found = tokens.token_table(texts(spark, folder), vocabulary(spark, folder))
    return found.select("text_id", *[F.col(c).cast("bigint").alias(c) for c in ("pos", "token_id")])


def token_head(spark: SparkSession, folder: str) -> DataFrame:
    return _tokenized(spark, folder).select(
        "text_id",
        joined(I.token_head(F.col("token_ids"))).alias("head"),
        F.size("token_ids").cast("bigint").alias("tokens"),
    )


def encode(spark: SparkSession, folder: str) -> DataFrame:
    encoded = tokens.encode_ids(texts(spark, folder), vocabulary(spark, folder))
    return encoded.select("text_id", joined(I.widen(F.col("input_ids"))).alias("input_ids"))


def attention_mask(spark: SparkSession, folder: str) -> DataFrame:
    """Masks with the id of "." as pad id, so that tokens inside a text are masked as well."""
    learnt = vocabulary(spark, folder)
    period = learnt.entries.filter(F.col("token") == ".").head().token_id
    special = learnt.special
    changed = learnt.with_special(period, special.unk, special.cls, special.sep)
    encoded = encode_texts(texts(spark, folder), changed)
    return encoded.select("text_id", joined("attention_mask").alias("attention_mask"))


def token_types(spark: SparkSession, folder: str) -> DataFrame:
    encoded = encode_texts(texts(spark, folder), vocabulary(spark, folder))
    return encoded.select("text_id", joined("token_type_ids").alias("token_type_ids"))


def batch_ids(spark: SparkSession, folder: str) -> DataFrame:
    batched = batches.with_batch(texts(spark, folder).select("text_id"), "text_id")
    return batched.select("text_id", "batch_id", "batch_row")


def batch_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return batches.batch_sizes(batch_ids(spark, folder))


def flat_batch(spark: SparkSession, folder: str) -> DataFrame:
    encoded = tokens.encode_ids(texts(spark, folder), vocabulary(spark, folder))
    return batches.flat_batch(encoded.join(batch_ids(spark, folder), "text_id"), ["text_id"])


def detokenize(spark: SparkSession, folder: str) -> DataFrame:
    # Tokenising leaves the texts spread by their key, in tasks of a bounded size.
    return tokens.detokenize(_tokenized(spark, folder), vocabulary(spark, folder), distributed=True)


# --- embedding ------------------------------------------------------------


def _embedded(spark: SparkSession, folder: str) -> DataFrame:
    return embed_texts(texts(spark, folder), vocabulary(spark, folder), MixingEncoder())


def embed(spark: SparkSession, folder: str) -> DataFrame:
    return exploded(_embedded(spark, folder), "text_id", F.col("embedding").cast("array<double>"))


def embed_conversations(spark: SparkSession, folder: str) -> DataFrame:
    turns = spread(table(spark, folder, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")
    found = embed_texts(turns, vocabulary(spark, folder), MixingEncoder(), keys=("conv_id", "turn"))
    rows = found.select("conv_id", "turn", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "value"))
    return rows.select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), rounded("value").alias("value"))


def run_counts(spark: SparkSession, folder: str) -> DataFrame:
    return profile.run_counts(texts(spark, folder), _embedded(spark, folder), vocabulary(spark, folder))


def embed_checked(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors that pass the checks; the model runs once, in front of them."""
    good, _ = quality.quarantine(_embedded(spark, folder))
    return exploded(good, "text_id", F.col("embedding").cast("array<double>"))


def embed_sql(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors of a table of texts asked for in SQL alone."""
    register_texts(spark, "embed_texts", vocabulary(spark, folder), MixingEncoder())
    source = f"documents_{uuid.uuid4().hex}"
    spread(table(spark, folder, "documents"), "doc_id").createOrReplaceTempView(source)
    found = spark.sql(f"select * from embed_texts(table(select doc_id as text_id, text as body from {source}), text => 'body')")
    return exploded(found, "text_id", F.col("embedding").cast("array<double>"))


def embed_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Copies share the vector of one run of the model; little is broadcast, so both ways back are taken."""
    found = embed_different_texts(texts(spark, folder), vocabulary(spark, folder), MixingEncoder(), limit=64 * 1024)
    return exploded(found, "text_id", F.col("embedding").cast("array<double>"))


def embed_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """A model that fails on some texts: these alone have no vector, and tell why."""
    found = embed_texts(texts(spark, folder), vocabulary(spark, folder), PickyEncoder(), report_errors=True)
    rows = found.select("text_id", "error", F.posexplode_outer(F.col("embedding").cast("array<double>")).alias("pos", "value"))
    return rows.select("text_id", F.col("pos").cast("bigint").alias("pos"), rounded("value").alias("value"), "error")


# --- vectors --------------------------------------------------------------


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "embeddings"), "vec_id")


def l2_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors scaled by their label, which leaves zero vectors for label 0."""
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * F.col("label"))
    return exploded(_vectors(spark, folder), "vec_id", V.l2_normalize(scaled))


def _damaged(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of three labels spoilt: emptied, with a NaN, with an infinity."""
    vector = F.col("embedding").cast("array<double>")

    def opening_with(value: str) -> Column:
        return F.concat(F.array(F.lit(float(value))), F.slice(vector, 2, 2**31 - 1))

    spoilt = (
        F.when(F.col("label") == 0, F.array().cast("array<double>"))
        .when(F.col("label") == 1, opening_with("nan"))
        .when(F.col("label") == 2, opening_with("-inf"))
        .otherwise(vector)
    )
    return _vectors(spark, folder).select("vec_id", "label", spoilt.alias("embedding"))


def bad_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return quality.with_status(_damaged(spark, folder)).select("vec_id", "status")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors as lines; some are blank, some have a field that is no number."""
    line = V.format_vector(F.col("embedding"))
    word = F.concat(F.lit("  1.5 x "), line, F.lit(" 2"))
    value = F.when(F.col("label") == 8, F.lit("  ")).when(F.col("label") == 9, word).otherwise(line)
    return _damaged(spark, folder).select("vec_id", value.alias("value"))


def bad_lines(spark: SparkSession, folder: str) -> DataFrame:
    read = quality.read_lines(_lines(spark, folder))
    return read.select(
        "vec_id",
        "status",
        F.size("embedding").cast("bigint").alias("fields"),
        F.when(F.col("status") == "unreadable", F.col("value")).alias("raw"),
    )


def parse_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    read = quality.read_lines(_lines(spark, folder)).filter(F.col("status") == "ok")
    rows = read.select("vec_id", F.posexplode("embedding").alias("pos", "value"))
    return rows.select("vec_id", F.col("pos").cast("bigint").alias("pos"), "value")


def format_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors over a wide range of sizes as lines of text."""
    power = F.pow(F.lit(10.0), F.col("label") * 2 - 8)
    stretched = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * power)
    return _vectors(spark, folder).select("vec_id", V.format_vector(stretched).alias("line"))


def text_sink(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    files.write_text(_vectors(spark, folder), path, "vec_id")
    return files.read_text(spark, path).select(
        F.col("line").alias("place"), F.col("value").alias("line"), "status", F.size("embedding").cast("bigint").alias("dimension")
    )


def parquet_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as Parquet, a folder per label, and back without loss."""
    path = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    files.write_parquet(_vectors(spark, folder), path, "label")
    read = files.read_parquet(spark, path)
    rows = read.select("vec_id", F.col("label").cast("bigint").alias("label"), F.posexplode("embedding").alias("pos", "value"))
    return rows.select("vec_id", "label", F.col("pos").cast("bigint").alias("pos"), F.col("value").cast("double").alias("value"))


def throughput(spark: SparkSession, folder: str) -> DataFrame:
    """Embedding with 1, 2 and 8 texts per model call; the seconds are a measurement, so only their sign is a result."""
    corpus, known = texts(spark, folder), vocabulary(spark, folder)
    measured = profile.throughput(corpus, known, MixingEncoder(), lexicon.build_lexicon(corpus, known, max_words=I.MAX_LENGTH - 1))
    return measured.select("batch_size", "texts", "vectors", (F.col("seconds") > 0).alias("measured"))


def cardinality(spark: SparkSession, folder: str) -> DataFrame:
    """The parts of documents between letters e against those that are kept: empty ones get no vector."""
    sides = _line_sides(spark, folder)
    return quality.cardinality(*sides, "text_id", "text")


def unpaired(spark: SparkSession, folder: str) -> DataFrame:
    return quality.unpaired(*_line_sides(spark, folder), "text_id", "text")


def _line_sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    blobs = _blobs(spark, folder, "e")
    listed = text_sources.split_blobs(blobs, "text_id", "blob", "e", drop_empty=False)
    return listed, text_sources.split_blobs(blobs, "text_id", "blob", "e")


def embedding_profile(spark: SparkSession, folder: str) -> DataFrame:
    own = profile.vector_profile(_vectors(spark, folder), "vec_id")
    return own.select(
        "vec_id", "dimension", "lowest", "highest", rounded("mean").alias("mean"),
        F.array_join(F.transform("head", lambda x: F.format_string("%.6f", x)), " ").alias("head"),
    )


def table_profile(spark: SparkSession, folder: str) -> DataFrame:
    return profile.table_profile(_vectors(spark, folder)).withColumn("mean", rounded("mean"))


def cosine(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector against its successor by id."""
    vectors = _vectors(spark, folder)
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    pairs = vectors.join(following, "vec_id")
    return pairs.select("vec_id", rounded(V.cosine(F.col("embedding"), F.col("next"))).alias("similarity"))


# --- evaluation -----------------------------------------------------------


def few_shot(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.few_shot(_vectors(spark, folder), "vec_id")


def _predictions(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _vectors(spark, folder)
    drawn = settle(evaluate.few_shot(vectors, "vec_id"), "few-shot")
    predicted = evaluate.nearest_centroid(vectors, evaluate.centroids(vectors, drawn, "vec_id"), "vec_id")
    return evaluate.held_out(predicted, drawn, "vec_id")


def nearest_centroid(spark: SparkSession, folder: str) -> DataFrame:
    return _predictions(spark, folder)


def linear_probe(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _vectors(spark, folder)
    drawn = settle(evaluate.few_shot(vectors, "vec_id"), "few-shot")
    return evaluate.held_out(evaluate.linear_probe(vectors, drawn, "vec_id"), drawn, "vec_id")


def _score(name: str) -> Query:
    return lambda spark, folder: evaluate.experiment_scores(_predictions(spark, folder)).select(
        "experiment", rounded(name).alias(name)
    )


def linear_probe_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Per experiment what is known without a fit: rows, ids, their labels, and predictions outside the labels."""
    labels = [row.label for row in _vectors(spark, folder).select("label").distinct().collect()]
    return linear_probe(spark, folder).groupBy("experiment").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("vec_id").alias("ids"),
        F.sum("label").cast("bigint").alias("labels"),
        F.count(F.when(~F.col("prediction").isin(labels), 1)).alias("strange"),
    )


def probe_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The scores of the probe, as a benchmark reports them."""
    scores = evaluate.experiment_scores(linear_probe(spark, folder))
    return scores.select("experiment", *[rounded(c).alias(c) for c in ("accuracy", "f1", "f1_weighted")])


accuracy = _score("accuracy")
macro_f1 = _score("f1")
weighted_f1 = _score("f1_weighted")


def label_scores(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.label_scores(_predictions(spark, folder)).withColumn("f1", rounded("f1"))


def score_summary(spark: SparkSession, folder: str) -> DataFrame:
    means = evaluate.summary(evaluate.experiment_scores(_predictions(spark, folder)))
    return means.select(*[rounded(c).alias(c) for c in means.columns])


def score_report(spark: SparkSession, folder: str) -> DataFrame:
    """The report written as JSON and read back."""
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    report = evaluate.score_report(evaluate.experiment_scores(_predictions(spark, folder)), "embeddings")
    files.write_report(report, path)
    test = spark.read.schema(report.schema).json(path).select("task_name", F.explode("scores.test").alias("test"))
    return test.select(
        "task_name",
        rounded("test.main_score").alias("main_score"),
        rounded("test.f1").alias("f1"),
        rounded("test.f1_weighted").alias("f1_weighted"),
        F.size("test.scores_per_experiment").cast("bigint").alias("experiments"),
    )


QUERIES: dict[str, Query] = {
    query: globals()[query]
    for query in (
        "ascii_lower", "isolate_punct", "collapse_ws", "trim_ends", "preprocess", "words", "preview",
        "split_nul", "split_custom", "split_keep_empty", "delimited_file", "file_to_vectors",
        "vocab_forward", "vocab_reverse", "special_ids", "learnt_vocabulary",
        "wordpiece", "token_ids", "tokenize", "tokenize_by_shuffle", "tokenize_stream", "tokenize_conversations",
        "token_table", "token_head", "encode", "attention_mask", "token_types",
        "batch_ids", "batch_sizes", "flat_batch", "detokenize",
        "embed", "embed_sql", "embed_distinct", "embed_checked", "embed_quarantine", "embed_conversations", "run_counts",
        "l2_normalize", "bad_vectors", "bad_lines", "parse_embeddings", "format_embeddings", "text_sink", "parquet_sink", "throughput",
        "cardinality", "unpaired", "embedding_profile", "table_profile", "cosine",
        "few_shot", "nearest_centroid", "linear_probe", "linear_probe_facts", "probe_scores", "label_scores",
        "accuracy", "macro_f1", "weighted_f1", "score_summary", "score_report",
    )
}
