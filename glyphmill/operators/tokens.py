"""Tokenising and encoding whole tables of texts.

The word rows of a text have to come back together. The texts are therefore
distributed by their key once, before they are exploded: the broadcast join and
the regrouping then keep that distribution and move nothing more. A regrouping
holds the word rows of its task, so the number of tasks follows the number of tokens.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.ids import MAX_LENGTH, pad, truncate
from glyphmill.operators.lexicon import Lexicon, build_lexicon
from glyphmill.operators.words import first_words, split_words, word_key, word_table
from glyphmill.session import BROADCAST_BYTES
from glyphmill.sources.vocabulary import INNER, Vocabulary

KEYS = ("text_id",)

# Fixed value: tokens whose rows a task gathers in memory, some 100 MB of rows.
TASK_TOKENS = 1 << 19
# A token is a byte at least, and in most texts about four.
TOKEN_BYTES = 4


def task_count(tokens: int) -> int:
    """Tasks that gather so many tokens without spilling them."""
    return max(-(-tokens // TASK_TOKENS), 1)


def _many(df: DataFrame, tasks: int) -> bool:
    """Whether Spark, which sizes partitions by their bytes, might make fewer than ``tasks``."""
    return tasks > df.sparkSession.sparkContext.defaultParallelism


def _tasks_of(texts: DataFrame, text: str, lexicon: Lexicon) -> int:
    """Tasks for texts with a lexicon that the caller gives: it may be that of far more texts, so these are measured."""
    tasks = task_count(lexicon.tokens)
    if not _many(texts, tasks):
        return tasks
    size = texts.agg(F.sum(F.octet_length(text))).head()[0] or 0
    return min(tasks, task_count(size // TOKEN_BYTES))


def lookup_ids(tokens: DataFrame, vocabulary: Vocabulary, column: str = "token", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``token_id``: the id of a token, or the unknown id."""
    table = vocabulary.by_token(limit).withColumnRenamed("token", "_token")
    joined = tokens.join(table, tokens[column] == table["_token"], "left_outer").drop("_token")
    return joined.withColumn("token_id", F.coalesce("token_id", F.lit(vocabulary.special.unk)))


def in_order(pairs: str | Column) -> Column:
    """The id lists of ``(wpos, ids)`` pairs, joined in word order; two texts under one key are an error."""
    ordered = F.sort_array(pairs)
    once = F.size(F.array_distinct(F.transform(ordered, lambda pair: pair["wpos"]))) == F.size(ordered)
    joined = F.flatten(F.transform(ordered, lambda pair: pair["ids"]))
    return F.when(once, joined).otherwise(F.raise_error(F.lit("two texts have one key")).cast("array<int>"))


def _pair_list(resolved: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    pair = F.when(F.col("ids").isNotNull(), F.struct("wpos", "ids"))
    return resolved.groupBy(*keys).agg(F.collect_list(pair).alias(name))


def _piece_ids(
    texts: DataFrame,
    lexicon: Lexicon,
    keys: Sequence[str],
    text: str,
    max_words: int | None,
    limit: int,
    distributed: bool,
    tasks: int,
) -> DataFrame:
    """``(keys, piece_ids)``: the ids of all pieces of a text, in order."""
    # Only the words that count travel.
    placed = texts.select(*keys, F.col(text) if max_words is None else first_words(F.col(text), max_words).alias(text))
    if not distributed:
        placed = placed.repartition(*([tasks] if _many(placed, tasks) else []), *keys)
    listed = split_words(F.col(text)) if max_words is not None else None
    rows = word_table(placed, keys, text, listed=listed).withColumn("word_key", word_key(F.col("word")))
    near, far = lexicon.split(limit)
    looked_up = rows.join(F.broadcast(near), "word_key", "left_outer")
    if far is None:
        # All words have an entry, unless the lexicon is of other texts: then say so.
        ids = F.when(
            F.col("word").isNotNull() & F.col("ids").isNull(), F.raise_error(F.lit("word missing from the lexicon"))
        ).otherwise(F.col("ids"))
        return _pair_list(looked_up.withColumn("ids", ids), keys, "pairs").select(
            *keys, in_order("pairs").alias("piece_ids")
        )
    # Only the occurrences of rare words are shuffled, by word and back by text. They are
    # read from the texts as they lie, which costs a second scan but no second shuffle.
    scanned = word_table(texts, keys, text, max_words).filter(F.col("word").isNotNull())
    rare = scanned.withColumn("word_key", word_key(F.col("word"))).join(
        F.broadcast(near.select("word_key")), "word_key", "left_anti"
    )
    many = _many(texts, tasks)
    if many:
        rare, far = (side.repartition(tasks, "word_key") for side in (rare, far))
    # What is left may be larger than the limit, so Spark must not broadcast it by an estimate of its own.
    found = rare.join(far.hint("merge"), "word_key", "left_outer").withColumn(
        "ids", F.coalesce("ids", F.raise_error(F.lit("word missing from the lexicon")).cast("array<int>"))
    )
    if many:
        found = found.select(*keys, "wpos", "ids").repartition(tasks, *keys)
    pairs = _pair_list(looked_up, keys, "pairs").join(_pair_list(found, keys, "rare_pairs"), list(keys), "left_outer")
    both = F.when(F.col("rare_pairs").isNull(), F.col("pairs")).otherwise(F.concat("pairs", "rare_pairs"))
    return pairs.select(*keys, in_order(both).alias("piece_ids"))


def tokenize(
    texts: DataFrame,
    vocabulary: Vocabulary,
    lexicon: Lexicon | None = None,
    keys: Sequence[str] = KEYS,
    text: str = "text",
    limit: int = BROADCAST_BYTES,
    distributed: bool = False,
) -> DataFrame:
    """``(keys, token_ids)``: class token, pieces of all words in order, separator.

    ``keys`` identify a text: two texts under one key fail the job. ``distributed`` says that the
    texts are already spread by ``keys`` (a table bucketed by them), so no shuffle is asked for.
    """
    return _tokenize(texts, vocabulary, lexicon, keys, text, limit, distributed, None)


def _tokenize(
    texts: DataFrame,
    vocabulary: Vocabulary,
    lexicon: Lexicon | None,
    keys: Sequence[str],
    text: str = "text",
    limit: int = BROADCAST_BYTES,
    distributed: bool = False,
    max_words: int | None = None,
) -> DataFrame:
    if lexicon is None:
        lexicon = build_lexicon(texts, vocabulary, text, max_words, limit)
        tasks = task_count(lexicon.tokens)
    else:
        tasks = _tasks_of(texts, text, lexicon)
    special = vocabulary.special
    ids = F.concat(F.array(F.lit(special.cls)), F.col("piece_ids"), F.array(F.lit(special.sep)))
    pieces = _piece_ids(texts, lexicon, keys, text, max_words, limit, distributed, tasks)
    return pieces.select(*keys, ids.alias("token_ids"))


def token_table(
    texts: DataFrame, vocabulary: Vocabulary, lexicon: Lexicon | None = None, keys: Sequence[str] = KEYS, **options
) -> DataFrame:
    """``(keys, pos, token_id)``: one row per token."""
    tokens = tokenize(texts, vocabulary, lexicon, keys, **options)
    return tokens.select(*keys, F.posexplode("token_ids").alias("pos", "token_id"))


def model_ids(
    texts: DataFrame,
    vocabulary: Vocabulary,
    lexicon: Lexicon | None = None,
    keys: Sequence[str] = KEYS,
    length: int = MAX_LENGTH,
    **options,
) -> DataFrame:
    """``(keys, token_ids)`` cut to ``length``, not yet padded.

    A word gives at least one piece, so the words that can reach the first
    ``length`` ids, or show that there are more, are the first ``length - 1``.
    The result is that of cutting the whole token list; long texts cost less.
    """
    tokens = _tokenize(texts, vocabulary, lexicon, keys, max_words=max(length - 1, 1), **options)
    return tokens.withColumn("token_ids", truncate(F.col("token_ids"), vocabulary.special.sep, length))


def encode_ids(
    texts: DataFrame,
    vocabulary: Vocabulary,
    lexicon: Lexicon | None = None,
    keys: Sequence[str] = KEYS,
    length: int = MAX_LENGTH,
    **options,
) -> DataFrame:
    """``(keys, input_ids)``: exactly ``length`` ids per text, cut or padded."""
    ids = model_ids(texts, vocabulary, lexicon, keys, length, **options)
    return ids.select(*keys, pad(F.col("token_ids"), vocabulary.special.pad, length).alias("input_ids"))


def detokenize(
    tokens: DataFrame,
    vocabulary: Vocabulary,
    keys: Sequence[str] = KEYS,
    ids: str = "token_ids",
    limit: int = BROADCAST_BYTES,
    distributed: bool = False,
) -> DataFrame:
    """``(keys, text)``: tokens joined by spaces, inner pieces glued to their word.

    Padding, class and separator ids and ids without a token are left out.
    """
    special = vocabulary.special
    placed = tokens.select(*keys, ids)
    if not distributed:
        placed = placed.repartition(*keys)
    rows = placed.select(*keys, F.posexplode_outer(ids).alias("pos", "token_id"))
    named = rows.join(vocabulary.by_id(limit), "token_id", "left_outer")
    printed = F.col("token").isNotNull() & ~F.col("token_id").isin(special.pad, special.cls, special.sep)
    listed = named.groupBy(*keys).agg(
        F.collect_list(F.when(printed, F.struct("pos", "token"))).alias("pairs")
    )

    def inner(pair: Column) -> Column:
        return pair["token"].startswith(INNER)

    def content(pair: Column) -> Column:
        unmarked = F.substring(pair["token"], len(INNER) + 1, 2**31 - 1)
        return F.when(inner(pair), unmarked).otherwise(pair["token"])

    def spaced(pair: Column) -> Column:
        return F.when(inner(pair), content(pair)).otherwise(F.concat(F.lit(" "), pair["token"]))

    ordered = listed.select(*keys, F.sort_array("pairs").alias("pairs"))
    # No space before the first token that puts out anything.
    first = F.array_position(F.transform("pairs", lambda pair: content(pair) != ""), True).cast("int")
    opening = F.transform(F.slice("pairs", F.col("first"), F.lit(1)), content)
    following = F.transform(F.slice("pairs", F.col("first") + 1, F.size("pairs")), spaced)
    text = F.when(F.col("first") > 0, F.array_join(F.concat(opening, following), "")).otherwise("")
    return ordered.withColumn("first", first).select(*keys, text.alias("text"))
