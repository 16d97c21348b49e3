"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from check import session
from glyphmill import TextModel
from glyphmill.plans.fixture import MixingEncoder, table, texts, vocabulary, vocabulary_entries
from glyphmill.plans.queries import QUERIES

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "preprocess", "words", "split_custom", "wordpiece", "tokenize", "token_table", "encode", "detokenize",
    "batch_ids", "embed", "embed_conversations", "l2_normalize", "format_embeddings", "parse_embeddings",
    "cosine", "few_shot", "score_summary",
]
RUNS = 2


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def best(action) -> float:
    times = []
    for _ in range(RUNS):
        start = time.perf_counter()
        action()
        times.append(time.perf_counter() - start)
    return round(min(times), 3)


def main() -> None:
    spark = session(CPUS)
    count = texts(spark, FOLDER).count()
    taken = {"learn_vocabulary": best(lambda: drain(vocabulary_entries(texts(spark, FOLDER))))}
    vocabulary(spark, FOLDER)
    for name in HEADLINE:
        taken[name] = best(lambda: drain(QUERIES[name](spark, FOLDER)))
    model = TextModel(vocabulary(spark, FOLDER), MixingEncoder())
    strings = [row.text for row in table(spark, FOLDER, "benchmark").orderBy("item_id").limit(8).collect()]
    calls = {n: best(lambda: model.encode(strings[:n])) for n in (1, 2, 8)}
    result = {
        "metric": "seconds for all headline queries, best of two runs each",
        "value": round(sum(taken.values()), 3),
        "unit": "sec",
        "queries": taken,
        "sf": Path(FOLDER).name,
        "cpus": int(CPUS),
        "texts": count,
        "texts_per_second": {name: round(count / taken[name], 1) for name in ("tokenize", "encode", "embed")},
        "seconds_per_call_of_strings": calls,
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
