"""The same operators on texts that keep arriving.

Text functions, id functions and vector checks are stateless and apply to a
streaming DataFrame as they are. Tokenising settles the words of its texts
first, so it runs per micro-batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from glyphmill.operators.embed import Encoder, embed
from glyphmill.operators.tokens import KEYS
from glyphmill.session import settled_scope
from glyphmill.sources.vocabulary import Vocabulary


def embed_stream(
    texts: DataFrame,
    vocabulary: Vocabulary,
    encoder: Encoder,
    path: str,
    checkpoint: str,
    keys: Sequence[str] = KEYS,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Embed a stream of texts into Parquet; each micro-batch has a folder of its own.

    A micro-batch that is repeated after a failure overwrites its own folder, so
    every text has one vector in the end.
    """

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()  # read twice: for its words, and for its vectors
        try:
            with settled_scope(batch.sparkSession):
                vectors = embed(kept, vocabulary, encoder, keys=keys, **options)
                vectors.write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            kept.unpersist()

    writer = texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
