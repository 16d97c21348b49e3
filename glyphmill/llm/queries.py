"""One query per operator over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import decontaminate, hard_negatives, licenses, mixing, neighbours, overlap_join, phrases, prefix_trie
from glyphmill.llm import suffix_dedup, surrogates, tool_calls, toxicity, warc


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(table(spark, folder, "documents"))
    starts, stated = F.transform("base", lambda b: b["start"].cast("bigint")), F.transform("base", lambda b: b["label"])
    labels = F.concat(stated, F.coalesce(F.transform("found", lambda d: d["label"]), F.array().cast("array<string>")))

    def joined(values: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(values)), ",")

    return found.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(stated).alias("base_labels"), joined(labels).alias("labels"), "score",
    )


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = surrogates.replace_entities(table(spark, folder, "documents"))
    return found.select("doc_id", "n_entities", F.col("text").alias("replaced"))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    read = warc.round_trip(spark, table(spark, folder, "pages"))
    return read.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", (F.col("status") == "ok").alias("verified")
    )


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.with_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return overlap_join.classes(table(spark, folder, "documents").select("doc_id", "text"))


def op6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = toxicity.fit(documents, table(spark, folder, "labels"))
    return toxicity.score(documents.select("doc_id", "text"), model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, folder, "documents")).drop("kept")


# Shares of tokens that a training mixture asks for, by language and quality.
TARGETS = {
    "en-good": 0.50, "fr-good": 0.16, "de-good": 0.16, "es-good": 0.12,
    "en-poor": 0.03, "fr-poor": 0.01, "de-poor": 0.01, "es-poor": 0.01,
}


def domains(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, domain`` of the labelled documents: language and quality; without a language there is no domain."""
    known = labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    quality = F.when(F.col("quality") > 0, "good").otherwise("poor")
    joined = documents.select("doc_id", "lang").distinct().join(known, "doc_id")
    return joined.select("doc_id", F.concat("lang", F.lit("-"), quality).alias("domain"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    mixed, names = mixing.mix(documents, domains(documents, table(spark, folder, "labels")), TARGETS)
    shares = [F.col("p")[k].alias("p_" + name.replace("-", "_")) for k, name in enumerate(names)]
    return mixed.select("row.doc_id", "tokens", "rate", *shares)


SCHEMAS = [
    ("open", "text", "string", True), ("open", "words", "integer", True), ("open", "hurry", "boolean", False),
    ("reply", "text", "string", True), ("reply", "words", "integer", True), ("reply", "after", "object", True),
]


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every user turn as a call that refers to the user turn before it, every assistant turn as its result."""

    def name(turn: str) -> Column:
        # Null if a part is: such turns link with nothing.
        return F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.expr(turn).cast("string"))

    opening = F.col("turn") <= 1
    after = F.when(~opening & F.col("conv_id").isNotNull(), F.map_from_arrays(F.array(F.lit("$ref")), F.array(name("turn - 2"))))
    arguments = F.struct(F.size(F.split("text", " ")).alias("words"), F.col("text"), after.alias("after"))
    calls = conversations.filter("role = 'user'").select(
        name("turn").alias("call_id"), "conv_id", F.col("turn").alias("position"),
        F.when(opening, "open").otherwise("reply").alias("tool"), F.to_json(arguments).alias("arguments"),
    )
    results = conversations.filter("role = 'assistant'").select(
        name("turn - 1").alias("call_id"), F.col("turn").alias("position"), F.col("text").alias("content")
    )
    return calls, results


def op9_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    """A row for every turn that is no answer, which its call's row holds; turns of other roles have status ``other``."""
    conversations = table(spark, folder, "conversations")
    calls, results = conversation_calls(conversations)
    schemas = spark.createDataFrame(SCHEMAS, "tool string, field string, type string, required boolean")
    linked = tool_calls.link_all(calls, results, schemas)
    spoken = F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))
    others = conversations.filter(~spoken).select(
        "conv_id", F.col("turn").alias("position"), F.lit("other").alias("status"), F.to_json(F.struct("role", "text")).alias("json")
    )
    linked = linked.unionByName(others, True)
    return linked.withColumn("level", F.col("level").cast("bigint")).withColumn("problems", F.array_join("problems", ","))


def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.deduplicate(table(spark, folder, "documents")).drop("kept")


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.nodes(table(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_licenses, op2_pii, op3_warc, op4_decontamination, op5_jaccard_join, op6_neighbours, op7_toxicity, op8_mixing,
        op9_tool_calls, op10_suffix_dedup, op11_phrases, op12_hard_negatives, op13_prefix_trie,
    )
}

ORACLES: dict[str, str] = {
    "op3_warc": """
        with p as (
          select page_id, encode(coalesce(html, '')) payload from pages
        ), d as (
          select page_id, octet_length(payload) payload_bytes, sha256(payload) payload_digest from p
        ), f as (
          select *, min(page_id) over (partition by payload_digest) first_id from d
        )
        select page_id, payload_bytes, payload_digest,
          case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end record_type,
          case when payload_bytes >= 100 and page_id <> first_id then first_id end refers_to,
          true verified
        from f
    """,
    "op5_jaccard_join": """
        with recursive split as (
          select doc_id, list_filter(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') w
          from documents
        ), sets as (
          select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
            else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end s
          from split
        ), rows_ as (
          select doc_id, len(s) n, unnest(s) shingle from sets
        ), shared as (
          select a.doc_id x, b.doc_id y, any_value(a.n) nx, any_value(b.n) ny, count(*) c
          from rows_ a join rows_ b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2
        ), links as (
          select x, y from shared where 100 * c >= 80 * (nx + ny - c)
          union all select y, x from shared where 100 * c >= 80 * (nx + ny - c)
        ), reach as (
          select doc_id, doc_id other from documents
          union select r.doc_id, l.y from reach r join links l on l.x = r.other
        )
        select s.doc_id, len(s.s) n_shingles, min(r.other) component_id
        from sets s join reach r using (doc_id) group by 1, 2
    """,
    "op10_suffix_dedup": """
        with h as (
          select doc_id, hex(encode(coalesce(text, ''))) h, octet_length(encode(coalesce(text, ''))) n from documents
        ), windows as (
          select doc_id, i, md5(substr(h, 2 * i + 1, 400)) w from (select doc_id, h, unnest(range(n - 199)) i from h where n >= 200)
        ), starts as (
          select doc_id, i from windows where w in (select w from windows group by 1 having count(*) > 1)
        ), marked as (
          select doc_id, i, case when i > lag(i) over (partition by doc_id order by i) + 200 then 1 else 0 end fresh from starts
        ), grouped as (
          select doc_id, i, sum(fresh) over (partition by doc_id order by i) g from marked
        ), spans as (
          select doc_id, min(i) low, max(i) + 200 high from grouped group by doc_id, g
        ), gaps as (
          select doc_id, low, high, coalesce(lag(high) over (partition by doc_id order by low), 0) before from spans
        ), kept as (
          select doc_id, count(*) n_spans, sum(high - low) removed, max(high) last_,
            string_agg(substr(h, 2 * before + 1, 2 * (low - before)), '' order by low) k
          from gaps join h using (doc_id) group by doc_id
        )
        select h.doc_id, n n_bytes, coalesce(removed, 0)::bigint n_removed, coalesce(n_spans, 0) n_spans,
          sha256(unhex(coalesce(k || substr(h.h, 2 * last_ + 1), h.h))) kept_sha256
        from h left join kept using (doc_id)
    """,
    "op11_phrases": """
        with d as (
          select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') w from documents
        ), windows as (
          select doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) h from (select doc_id, w, unnest(range(1, len(w) - 33)) i from d where len(w) >= 35)
        ), starts as (
          select doc_id, i from windows where h in (select h from windows group by 1 having count(*) > 1)
        ), covered as (
          select doc_id, list_distinct(flatten(list(range(i, i + 35)))) c from starts group by 1
        ), gone as (
          select doc_id, unnest(c) i from covered
        ), kept as (
          select x.doc_id, list(x.word order by x.i) k
          from (select doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) i from d) x anti join gone g on g.doc_id = x.doc_id and g.i = x.i
          group by 1
        )
        select d.doc_id, len(w) n_words, len(w) - coalesce(len(k), 0) n_removed, sha256(coalesce(array_to_string(k, ' '), '')) kept_sha256
        from d left join kept using (doc_id)
    """,
    "op12_hard_negatives": """
        with e as (
          select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label,
            list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v
          from embeddings
          where label is not null and embedding is not null
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), scored as (
          select a.vec_id anchor_id, b.vec_id, a.label = b.label same,
            list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::bigint score
          from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
        ), positives as (
          select * from scored where same
          qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
        )
        select p.anchor_id, p.vec_id positive_id,
          row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id)::int rank,
          n.vec_id negative_id, p.score positive_score, n.score negative_score
        from positives p join scored n on p.anchor_id = n.anchor_id and not n.same
          and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score
        qualify row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id) <= 10
    """,
    "op13_prefix_trie": """
        with t as (
          select conv_id, turn, coalesce(text, '') x, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) e
          from conversations where conv_id is not null
        ), own as (
          select conv_id, list(e order by turn nulls first, e) es, list(length(x) order by turn nulls first, e) ns from t group by 1
        ), hashed as (
          select *, xor(list_reduce(list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint),
            lambda r, byte: list_reduce(range(8), lambda s, k: case when s & 1 = 1 then xor(s >> 1, 3988292384) else s >> 1 end,
              xor(r, byte)), 4294967295::bigint), 4294967295::bigint) % 6 h
          from own
        ), rebuilt as (
          select o.conv_id, list_concat(coalesce(b.es[1:o.h], []), o.es[o.h + 1:]) es,
            list_concat(coalesce(b.ns[1:o.h], []), o.ns[o.h + 1:]) ns
          from hashed o left join own b on b.conv_id = o.conv_id - o.conv_id % 100
        ), prefixes as (
          select conv_id, d, es[1:d] es, ns[d] n, len(es) = d ends from (select *, unnest(range(len(es) + 1)) d from rebuilt)
        ), found as (
          select es, d depth, min(conv_id) conv_id, count(*) n_convs, coalesce(any_value(n), 0) tokens,
            coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '') ids
          from prefixes group by 1, 2
        ), childless as (
          select f.*, not exists (select 1 from found c where c.depth = f.depth + 1 and c.es[1:f.depth] = f.es) leaf from found f
        ), sums as (
          select es[1:d] es, sum(leaf::int)::bigint n_leaves, sum((n_convs - 1) * tokens)::bigint saved_tokens
          from (select *, unnest(range(depth + 1)) d from childless) group by 1
        ), kids as (
          select es[1:depth - 1] es, count(*) n_children from found where depth > 0 group by 1
        )
        select f.conv_id, f.depth, p.conv_id parent_conv_id, f.n_convs, coalesce(n_children, 0) n_children, n_leaves, saved_tokens,
          sha256(f.ids) ends_sha256
        from found f join sums s on s.es = f.es left join kids k on k.es = f.es
        left join found p on p.depth = f.depth - 1 and p.es = f.es[1:f.depth - 1]
    """,
}
