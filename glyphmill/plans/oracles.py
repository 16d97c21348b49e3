"""The same results in SQL, for DuckDB over the same tables."""

from __future__ import annotations

LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"""regexp_replace({}, '([.,!?;:()\[\]{{}}"''])', ' \1 ', 'g')"""
COLLAPSED = r"regexp_replace({}, '[ \t\n\x0B\f\r]+', ' ', 'g')"
PROCESSED = f"trim({COLLAPSED.format(SPACED.format(LOWERED))})"

TEXTS = "texts as (select doc_id as text_id, text from documents)"
TURNS = "texts as (select conv_id * 1000000 + turn as text_id, conv_id, turn, text from conversations)"


def _words(name: str, source: str) -> str:
    return f"""
{name}_lists as (
  select text_id, list_filter(string_split({PROCESSED}, ' '), lambda w: w <> '') as ws from {source}),
{name} as materialized (
  select text_id, unnest(range(len(ws))) as wpos, unnest(ws) as word from {name}_lists)"""


# Learnt from the documents, whatever texts are tokenised.
VOCABULARY = (
    _words("learnt_words", "(select doc_id as text_id, text from documents)")
    + r""",
counted as (select word, count(*) as n from learnt_words group by 1),
plain as (select * from counted where regexp_full_match(word, '[a-z0-9]+')),
learnt as (
  select word as t from plain where n >= 5
  union select substr(word, 1, 3) from plain
  union select '##' || right(word, 2) from plain where length(word) > 3
  union select word from counted where regexp_full_match(word, '[^a-z0-9]')
  union select '##' || chr(97 + i::int) from range(26) r(i)),
vocab as materialized (
  select t as token, row_number() over (order by t) + 3 as token_id from learnt
  union all select * from (values ('[PAD]', 0), ('[UNK]', 1), ('[CLS]', 2), ('[SEP]', 3)))"""
)

PIECES = """
distinct_words as materialized (select word, count(*) as n from words group by 1),
cut(word, k, rest, piece) as (
  select word, 0, word, null::varchar from distinct_words where word not in (select token from vocab)
  union all
  select word, k + 1,
         case when size is null then '' else substr(rest, size + 1) end,
         case when size is null then '[UNK]' else mark || substr(rest, 1, size) end
  from (
    select c.word, c.k, c.rest, case when c.k = 0 then '' else '##' end as mark,
           max(l.size) filter (where v.token is not null) as size
    from cut c cross join range(1, 21) l(size)
    left join vocab v on v.token = (case when c.k = 0 then '' else '##' end) || substr(c.rest, 1, l.size)
      and l.size <= length(c.rest) and strlen(substr(c.rest, 1, l.size)) <= 20
    where c.rest <> ''
    group by c.word, c.k, c.rest)),
pieces as materialized (
  select word, k, piece from cut where k > 0
  union all select word, 1, word from distinct_words where word in (select token from vocab))"""

TOKENS = """
inner_tokens as (
  select w.text_id, row_number() over (partition by w.text_id order by w.wpos, p.k) as pos, v.token_id
  from words w join pieces p on p.word = w.word join vocab v on v.token = p.piece),
tokens as materialized (
  select text_id, 0 as pos, 2 as token_id from texts
  union all select * from inner_tokens
  union all
  select t.text_id, coalesce(n, 0) + 1, 3
  from texts t left join (select text_id, count(*) as n from inner_tokens group by 1) c using (text_id)),
token_lists as materialized (
  select text_id, list(token_id order by pos) as ids from tokens group by 1)"""


def _encoded(pad: str = "0") -> str:
    return f"""
encoded as materialized (
  select text_id, pad, case
    when len(ids) > 512 then list_concat(ids[1:511], [3])
    else list_concat(ids, list_transform(range(512 - len(ids)), lambda i: pad)) end as input_ids
  from token_lists, (select {pad} as pad))"""


EMBEDDED = """
places as (
  select text_id, unnest(input_ids) as id from encoded),
weights as (
  select text_id, id, count(*) as n from places where id <> 0 group by 1, 2),
summed as (
  select text_id, d as pos, sum(n * ((31 * id + 17 * d + 7 * id * d) % 101 - 50))::double as total
  from weights, range(16) r(d) group by 1, 2),
lengths as (select text_id, sqrt(sum(total * total)) as length from summed group by 1),
embedded as (
  select text_id, pos, (case when length > 0 then total / length else total end)::float as value
  from summed join lengths using (text_id))"""


def _six(x: str) -> str:
    """Rounded to six digits; what rounds to zero has no sign."""
    return f"(case when abs({x}) < 0.0000005 then 0.0::double else round({x}, 6) end)"


def _chain(*parts: str, last: str) -> str:
    return "with recursive " + ",\n".join(part.strip() for part in parts) + "\n" + last


def _tokenised(last: str, *more: str, source: str = TEXTS) -> str:
    return _chain(source, VOCABULARY, _words("words", "texts"), PIECES, TOKENS, *more, last=last)


def _blobs(delimiter: str) -> str:
    return f"""
blobs as (
  select doc_id as text_id, replace(text, chr(10), {delimiter}) || chr(10) as blob from documents),
parts as (
  select text_id, string_split(left(blob, length(blob) - 1), {delimiter}) as all_parts from blobs)"""


def _split(delimiter: str, keep_empty: bool = False) -> str:
    kept = "all_parts" if keep_empty else "list_filter(all_parts, lambda t: t <> '')"
    return _chain(
        _blobs(delimiter),
        f"kept as (select text_id, {kept} as texts from parts)",
        last="select text_id, unnest(range(len(texts))) as position, unnest(texts) as text from kept",
    )


VOCABULARY_FILES = r"""
files as (
  select doc_id, list_filter(string_split(
    replace(text, ', ', chr(9)) || chr(10) || chr(10) || '[CLS]' || chr(10) || 'the' || chr(10)
      || case when lang = 'en' then chr(10) || '[UNK]' || chr(10) else '' end,
    chr(10)), lambda l: l <> '') as lines
  from documents),
entries as (
  select doc_id, unnest(range(len(lines))) as token_id,
         unnest(list_transform(lines, lambda l: string_split(l, chr(9))[1])) as token
  from files)"""

DAMAGED = """
damaged as (
  select vec_id, label, case label
    when 0 then []::double[]
    when 1 then list_concat(['nan'::double], embedding[2:]::double[])
    when 2 then list_concat(['-inf'::double], embedding[2:]::double[])
    else embedding::double[] end as v
  from embeddings)"""


def _g(vector: str) -> str:
    shown = "case when isnan(x) then 'nan' when isinf(x) then case when x > 0 then 'inf' else '-inf' end else printf('%g', x) end"
    return f"array_to_string(list_transform({vector}, lambda x: {shown}), ' ')"


LINES = f"""
lines as (
  select vec_id, case label when 8 then '  ' when 9 then '  1.5 x ' || {_g('v')} || ' 2' else {_g('v')} end as value
  from damaged),
fields as (
  select vec_id, value, list_filter(string_split(value, ' '), lambda f: f <> '') as fs
  from lines where trim(value) <> ''),
parsed as (
  select vec_id, value, fs, list_transform(fs, lambda f: try_cast(f as double)) as v from fields),
judged as (
  select *, case
    when len(list_filter(v, lambda x: x is null)) > 0 then 'unreadable'
    when len(v) = 0 then 'empty'
    when len(list_filter(v, lambda x: isnan(x) or isinf(x))) > 0 then 'not_finite'
    else 'ok' end as status
  from parsed)"""

DRAWN = """
ranked as (
  select experiment, vec_id, label, row_number() over (
    partition by experiment, label
    order by (((vec_id % 2147483647 + (experiment + 1) * 7919) * 48271) % 2147483647)
      * (experiment * 1009 + 69621) % 2147483647, vec_id) as place
  from embeddings, range(10) r(experiment)),
drawn as (select experiment::int as experiment, vec_id, label from ranked where place <= 8)"""

PREDICTED = (
    DRAWN
    + """,
drawn_values as (
  select d.experiment, d.label, unnest(range(len(e.embedding))) as pos, unnest(e.embedding::double[]) as value
  from drawn d join embeddings e using (vec_id)),
mean_values as (select experiment, label, pos, avg(value) as value from drawn_values group by 1, 2, 3),
centroids as (select experiment, label, list(value order by pos) as centroid from mean_values group by 1, 2),
scored as (
  select c.experiment, e.vec_id, e.label, c.label as candidate,
         list_cosine_similarity(e.embedding::double[], c.centroid) as score
  from embeddings e, centroids c
  where not exists (select 1 from drawn d where d.experiment = c.experiment and d.vec_id = e.vec_id)),
predictions as materialized (
  select experiment, vec_id, label, candidate as prediction from scored
  qualify row_number() over (partition by experiment, vec_id order by score desc, candidate) = 1)"""
)

_SCORES = """,
counted_classes as (
  select experiment, label as class from predictions union select experiment, prediction from predictions),
class_counts as (
  select c.experiment, c.class,
         count(*) filter (where p.label = c.class) as support,
         count(*) filter (where p.prediction = c.class) as predicted,
         count(*) filter (where p.label = c.class and p.prediction = c.class) as hits
  from counted_classes c join predictions p on p.experiment = c.experiment group by 1, 2),
class_scores as (select *, 2.0::double * hits / (support + predicted) as f1 from class_counts),
scores as (
  select s.experiment, a.accuracy, avg(s.f1) as f1, sum(s.f1 * s.support) / sum(s.support) as f1_weighted
  from class_scores s
  join (select experiment, avg((label = prediction)::int) as accuracy from predictions group by 1) a
    on a.experiment = s.experiment
  group by 1, 2)"""
SCORED = PREDICTED + _SCORES

# Thirty accelerated gradient steps from zero; ``w`` and ``b`` are the weights after a step and before it.
PROBED = (
    DRAWN
    + """,
sample as materialized (
  select d.experiment, d.vec_id, d.label, list_append(e.embedding::double[], 1.0) as x from drawn d join embeddings e using (vec_id)),
bounds as (select experiment, 0.5 * sum(list_inner_product(x, x)) + 1.0 as bound from sample group by 1),
classes as (select distinct experiment, label from sample),
steps(step, experiment, label, w, b) as (
  select 0, experiment, label, list_transform(range(65), lambda i: 0.0::double), list_transform(range(65), lambda i: 0.0::double) from classes
  union all
  select step + 1, experiment, label, list_transform(range(1, 66), lambda i: y[i] - (g[i] + (case when i < 65 then y[i] else 0 end)) / bound), w
  from (
    with ahead as (
      select step, experiment, label, w,
        list_transform(range(1, 66), lambda i: w[i] + step::double / (step + 3) * (w[i] - b[i])) as y
      from steps where step < 30),
    scores as (
      select a.experiment, a.label, s.vec_id, s.label as own, s.x, list_inner_product(a.y, s.x) as score
      from ahead a join sample s on s.experiment = a.experiment),
    parts as (
      select experiment, label, own, x, exp(score - max(score) over r) as part, score, vec_id,
        sum(exp(score - top)) over r as total
      from (select *, max(score) over (partition by experiment, vec_id) as top from scores) window r as (partition by experiment, vec_id)),
    slopes as (
      select experiment, label, pos, sum((part / total - (label = own)::int) * value) as g
      from (select experiment, label, own, part, total, unnest(range(65)) as pos, unnest(x) as value from parts) group by 1, 2, 3),
    gradients as (select experiment, label, list(g order by pos) as g from slopes group by 1, 2)
    select a.step, a.experiment, a.label, a.w, a.y, gradients.g, bounds.bound
    from ahead a join gradients on gradients.experiment = a.experiment and gradients.label = a.label
    join bounds on bounds.experiment = a.experiment)),
answers as (
  select c.experiment, e.vec_id, e.label, c.label as candidate,
    list_inner_product(list_append(e.embedding::double[], 1.0), c.w) as score
  from embeddings e, (select * from steps where step = 30) c
  where not exists (select 1 from drawn d where d.experiment = c.experiment and d.vec_id = e.vec_id)),
predictions as materialized (
  select experiment, vec_id, label, candidate as prediction from answers
  qualify row_number() over (partition by experiment, vec_id order by score desc, candidate) = 1)"""
)

LINE_SIDES = (
    _blobs("'e'")
    + """,
listed as (select text_id, unnest(all_parts) as text from parts),
pairs as (
  select text_id, text, count(*) as texts, count(*) filter (where text <> '') as vectors from listed group by 1, 2)"""
)

# Ids of a list as text.
IDS = "array_to_string({}, ' ')"

ORACLES: dict[str, str] = {
    "ascii_lower": f"select doc_id as text_id, {LOWERED} as lowered from documents",
    "isolate_punct": f"select doc_id as text_id, {SPACED.format('text')} as isolated from documents",
    "collapse_ws": f"select doc_id as text_id, {COLLAPSED.format('text')} as collapsed from documents",
    "trim_ends": "select doc_id as text_id, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) as trimmed from documents",
    "preprocess": f"select doc_id as text_id, {PROCESSED} as processed from documents",
    "words": _chain(
        TEXTS,
        _words("words", "texts"),
        last="select t.text_id, w.wpos, w.word from texts t left join words w using (text_id)",
    ),
    "preview": """
        select doc_id as text_id, case when strlen(text) <= 50 then text else
          substr(text, 1, list_max(list_filter(range(51), lambda k: strlen(substr(text, 1, k)) <= 50))) || '...'
        end as shown from documents""",
    "split_nul": _split("chr(0)"),
    "split_custom": _split("'|||'"),
    "split_keep_empty": _split("'. '", keep_empty=True),
    "delimited_file": """
        select coalesce(lang, 'none') as file, row_number() over (partition by lang order by doc_id) - 1 as position, text
        from documents where text <> ''""",
    "file_to_vectors": _tokenised(
        """
        select d.file, row_number() over (partition by d.file order by text_id) - 1 as position,
               row_number() over (order by d.file, text_id) - 1 as line, l.vector, 'ok' as status
        from (select doc_id as text_id, coalesce(lang, 'none') as file from documents where text <> '') d
        join (select text_id, string_agg(printf('%g', value::double), ' ' order by pos) as vector from embedded group by 1) l using (text_id)""",
        _encoded(),
        EMBEDDED,
    ),
    "vocab_reverse": _chain(VOCABULARY_FILES, last="select doc_id, token_id, token from entries"),
    "vocab_forward": _chain(
        VOCABULARY_FILES, last="select doc_id, token, max(token_id) as token_id from entries group by 1, 2"
    ),
    "special_ids": _chain(
        VOCABULARY_FILES,
        last="""
        select doc_id,
               coalesce(max(token_id) filter (where token = '[PAD]'), 0) as pad,
               coalesce(max(token_id) filter (where token = '[UNK]'), 100) as unk,
               coalesce(max(token_id) filter (where token = '[CLS]'), 101) as cls,
               coalesce(max(token_id) filter (where token = '[SEP]'), 102) as sep
        from entries group by 1""",
    ),
    "learnt_vocabulary": _chain(VOCABULARY, last="select token, token_id from vocab"),
    "wordpiece": _chain(
        TEXTS, VOCABULARY, _words("words", "texts"), PIECES,
        last="""
        select p.word, any_value(d.n) as n, string_agg(p.piece, ' ' order by p.k) as pieces
        from pieces p join distinct_words d on d.word = p.word group by 1""",
    ),
    "token_ids": _chain(
        VOCABULARY,
        last="select word, coalesce(token_id, 1) as token_id from counted left join vocab on token = word",
    ),
    "tokenize": _tokenised(f"select text_id, {IDS.format('ids')} as token_ids from token_lists"),
    "tokenize_by_shuffle": _tokenised(f"select text_id, {IDS.format('ids')} as token_ids from token_lists"),
    "tokenize_conversations": _tokenised(
        f"select conv_id, turn, {IDS.format('ids')} as token_ids from token_lists join texts using (text_id)",
        source=TURNS,
    ),
    "token_table": _tokenised("select text_id, pos, token_id from tokens"),
    "token_head": _tokenised(
        f"select text_id, {IDS.format('ids[1:10]')} as head, len(ids) as tokens from token_lists"
    ),
    "encode": _tokenised(f"select text_id, {IDS.format('input_ids')} as input_ids from encoded", _encoded()),
    "attention_mask": _tokenised(
        "select text_id, array_to_string(list_transform(input_ids, lambda x: (x <> pad)::int), ' ') as attention_mask from encoded",
        _encoded("(select token_id from vocab where token = '.')"),
    ),
    "token_types": "select doc_id as text_id, '0' || repeat(' 0', 511) as token_type_ids from documents",
    "batch_ids": """
        select doc_id as text_id, (row_number() over (order by doc_id) - 1) // 64 as batch_id,
               (row_number() over (order by doc_id) - 1) % 64 as batch_row
        from documents""",
    "batch_sizes": """
        select batch_id, count(*) as texts
        from (select (row_number() over (order by doc_id) - 1) // 64 as batch_id from documents) group by 1""",
    "flat_batch": _tokenised(
        """select n // 64 as batch_id, (n % 64) * 512 + unnest(range(512)) as place, unnest(input_ids) as value
        from numbered""",
        _encoded(),
        "numbered as (select row_number() over (order by text_id) - 1 as n, input_ids from encoded)",
    ),
    "detokenize": _tokenised(
        """
        select t.text_id, coalesce(r.text, '') as text from texts t left join (
          select text_id, ltrim(string_agg(
            case when starts_with(token, '##') then substr(token, 3) else ' ' || token end, '' order by pos)) as text
          from tokens join vocab using (token_id) where token_id not in (0, 2, 3) group by 1) r
        using (text_id)"""
    ),
    "embed": _tokenised(
        f"select text_id, pos, {_six('value::double')} as value from embedded", _encoded(), EMBEDDED
    ),
    "embed_quarantine": _tokenised(
        f"""
        select e.text_id, pos, {_six('value::double')} as value, null::varchar as error
        from embedded e join encoded c using (text_id) where c.input_ids[2] % 7 <> 3
        union all select text_id, null, null, 'a text the model refuses' from encoded where input_ids[2] % 7 = 3""",
        _encoded(),
        EMBEDDED,
    ),
    "embed_conversations": _tokenised(
        f"select conv_id, turn, pos, {_six('value::double')} as value from embedded join texts using (text_id)",
        _encoded(),
        EMBEDDED,
        source=TURNS,
    ),
    "run_counts": _chain(
        VOCABULARY,
        last="""
        select (select count(*) from documents) as texts, (select count(*) from documents) as embeddings,
               16::bigint as dimension, (select count(*) from vocab) as vocabulary_size,
               0::bigint as pad_id, 1::bigint as unk_id, 2::bigint as cls_id, 3::bigint as sep_id""",
    ),
    "l2_normalize": f"""
        with scaled as (
          select vec_id, unnest(range(len(embedding))) as pos, unnest(embedding::double[]) * label as x from embeddings),
        lengths as (select vec_id, sqrt(sum(x * x)) as length from scaled group by 1)
        select vec_id, pos, {_six('(case when length > 0 then x / length else x end)')} as value
        from scaled join lengths using (vec_id)""",
    "bad_vectors": _chain(
        DAMAGED,
        last="""
        select vec_id, case when len(v) = 0 then 'empty'
          when len(list_filter(v, lambda x: isnan(x) or isinf(x))) > 0 then 'not_finite' else 'ok' end as status
        from damaged""",
    ),
    "bad_lines": _chain(
        DAMAGED,
        LINES,
        last="""
        select vec_id, status, len(fs) as fields, case when status = 'unreadable' then value end as raw from judged""",
    ),
    "parse_embeddings": _chain(
        DAMAGED,
        LINES,
        last="""
        select vec_id, unnest(range(len(v))) as pos, unnest(v) as value from judged where status = 'ok'""",
    ),
    "format_embeddings": f"""
        with stretched as (
          select vec_id, list_transform(embedding::double[], lambda x: x * pow(10.0, label * 2 - 8)) as v from embeddings)
        select vec_id, {_g('v')} as line from stretched""",
    "text_sink": f"""
        select row_number() over (order by vec_id) - 1 as place, {_g('embedding::double[]')} as line, 'ok' as status,
               len(embedding) as dimension from embeddings""",
    "parquet_sink": """
        select vec_id, label::bigint as label, unnest(range(len(embedding))) as pos, unnest(embedding)::double as value from embeddings""",
    "throughput": """
        select unnest([1, 2, 8])::int as batch_size, (select count(*) from documents) as texts,
               (select count(*) from documents) as vectors, true as measured""",
    "cardinality": _chain(
        LINE_SIDES,
        last="""
        select sum(texts)::bigint as texts, sum(vectors)::bigint as vectors,
               sum(texts - vectors)::bigint as missing, 0::bigint as extra, sum(texts) = sum(vectors) as complete
        from pairs""",
    ),
    "unpaired": _chain(LINE_SIDES, last="select text_id, text, texts, vectors from pairs where texts <> vectors"),
    "embedding_profile": f"""
        select vec_id, len(embedding) as dimension, list_min(embedding)::double as lowest,
               list_max(embedding)::double as highest,
               {_six('(list_sum(embedding::double[]) / len(embedding))')} as mean,
               array_to_string(list_transform(embedding[1:5], lambda x: printf('%.6f', x::double)), ' ') as head
        from embeddings""",
    "table_profile": f"""
        select count(*) as vectors, min(len(embedding)) as least_dimension, max(len(embedding)) as most_dimension,
               min(list_min(embedding))::double as lowest, max(list_max(embedding))::double as highest,
               {_six('(sum(list_sum(embedding::double[])) / sum(len(embedding)))')} as mean
        from embeddings""",
    "cosine": f"""
        select a.vec_id, {_six('list_cosine_similarity(a.embedding::double[], b.embedding::double[])')} as similarity
        from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""",
    "few_shot": _chain(DRAWN, last="select experiment, vec_id, label from drawn"),
    "linear_probe_facts": _chain(
        DRAWN,
        last="""select x.experiment, count(*) as rows, sum(e.vec_id)::bigint as ids, sum(e.label)::bigint as labels, 0::bigint as strange
        from embeddings e cross join (select distinct experiment from drawn) x
        where not exists (select 1 from drawn d where d.experiment = x.experiment and d.vec_id = e.vec_id) group by 1""",
    ),
    "linear_probe": _chain(PROBED, last="select experiment, vec_id, label, prediction from predictions"),
    "probe_scores": _chain(
        PROBED + _SCORES,
        last="""
        select experiment, round(accuracy, 6) as accuracy, round(f1, 6) as f1, round(f1_weighted, 6) as f1_weighted from scores""",
    ),
    "nearest_centroid": _chain(PREDICTED, last="select experiment, vec_id, label, prediction from predictions"),
    "label_scores": _chain(
        SCORED,
        last="select experiment, class as label, support, predicted, hits, round(f1, 6) as f1 from class_scores",
    ),
    "accuracy": _chain(SCORED, last="select experiment, round(accuracy, 6) as accuracy from scores"),
    "macro_f1": _chain(SCORED, last="select experiment, round(f1, 6) as f1 from scores"),
    "weighted_f1": _chain(SCORED, last="select experiment, round(f1_weighted, 6) as f1_weighted from scores"),
    "score_summary": _chain(
        SCORED,
        last="""
        select round(avg(accuracy), 6) as accuracy, round(avg(f1), 6) as f1,
               round(avg(f1_weighted), 6) as f1_weighted, round(avg(accuracy), 6) as main_score from scores""",
    ),
    "score_report": _chain(
        SCORED,
        last="""
        select 'embeddings' as task_name, round(avg(accuracy), 6) as main_score, round(avg(f1), 6) as f1,
               round(avg(f1_weighted), 6) as f1_weighted, count(*) as experiments from scores""",
    ),
}
ORACLES["tokenize_stream"] = ORACLES["tokenize"]
for _same in ("embed_checked", "embed_distinct", "embed_sql"):
    ORACLES[_same] = ORACLES["embed"]
