"""The registered queries over the whole driver tables, and their DuckDB counterparts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, chat, exact_dedup, jaccard, langid, license_scan, mixing, quality, ranked_search, runs, token_file, topk, viterbi_count
from corvane.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, ([5, 2, 1])[((row_number() over (order by source nulls last) - 1) % 3) + 1] as weight, source_size * 2 as cap from s),
l as (select *, ((sum(source_size) over ())::double * 1.5 - coalesce(sum(cap) over e, 0)::double)
    / ((sum(weight) over ()) - coalesce(sum(weight) over e, 0))::double as level
  from w window e as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
f as (select *, max(case when cap / weight > level then level end) over () as final from l),
t as (select source, source_size, least(cap::double, coalesce(final * weight, cap::double)) as target from f),
c as (select d.*, floor(ln(size + 1) * 1000)::bigint as x from d),
m as (select source, case when sum(size) > 0 then sum(size * x)::double / sum(size)::double else 0.0 end as middle, min(x) as low, max(x) as high from c group by source),
r as (select t.*, middle, greatest(high - middle, middle - low) as widest, case when source_size > 0 then target / source_size else 0.0 end as rate
  from t join m on t.source is not distinct from m.source),
k as (select c.doc_id, c.size, r.*, rate + 0.5::double * least(rate, 2 - rate) * case when widest > 0 then (x - middle) / widest else 0.0 end as expected,
  ((('0x' || substr(md5('mix:' || coalesce(c.doc_id::varchar, '')), 1, 13))::bigint) + 0.5::double) / 4503599627370496::double as u
  from c join r on c.source is not distinct from r.source),
p as (select *, floor(expected) as whole, expected - floor(expected) as p from k),
o as (select *, case when p > 0 then (u / (1 - u)) / (p / (1 - p)) end as rank, greatest(0.0, target - sum(whole * size) over (partition by source)) as rest from p),
q as (select *, coalesce(sum(size) over (partition by source, rank is null order by rank, u, doc_id nulls last, size
    rows between unbounded preceding and 1 preceding), 0) as ahead from o)
select doc_id, size, source_size, target,
  (size * (whole + case when rank is not null and ahead * 2 + size <= rest * 2 then 1 else 0 end))::bigint as taken from q
"""


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = r"""
with t as (select doc_id, length(coalesce(text, '')) as n,
  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as text_sha256 from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size,
  row_number() over w = 1 as kept, text_sha256
from t window w as (partition by text_sha256 order by n desc, doc_id)
"""

def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"), words=4, percent=85)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return viterbi_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def _op7_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    none = r"[^\p{L}\p{N}]*"
    sentence = rf"regexp_matches(l, '^{none}copyright\b{none}(?:{'|'.join(license_scan.CONTINUES)})\b')"
    held = rf"(regexp_matches(l, '^{none}copyright\b[^\n]*[\p{{L}}\p{{N}}]') and not {sentence}) or regexp_matches(l, '^{none}(?:\x{{A9}}|\(c\){none}(?:[0-9]{{4}}|copyright\b)|all rights reserved{none}$)')"

    def canonical(x: str) -> str:
        lines = rf"list_transform(string_split(lower(coalesce({x}, '')), chr(10)), lambda l: case when {held} then '' else regexp_replace(l, '[^\p{{L}}\p{{N}}]+', ' ', 'g') end)"
        out = f"array_to_string({lines}, chr(10))"
        for a, b in license_scan.REPLACED:
            out = f"replace({out}, {quoted(a)}, {quoted(b)})"
        return f"string_split(trim({out}), chr(10))"

    whole = "array_to_string(list_filter(lines, lambda x: x <> ''), ' ')"
    known = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in [*license_scan.KNOWN, *license_scan.full_texts()])
    return f"""
with k as (select sha256({whole}) as digest, min(i) as license_id from (select i, {canonical('t')} as lines from (values {known}) v(i, t)) where {whole} <> '' group by 1),
d as (select doc_id, {canonical('text')} as lines from documents),
u as (select doc_id, 0::bigint as line_no, {whole} as unit from d
  union all select doc_id, unnest(range(1, len(lines) + 1)) as line_no, unnest(lines) as unit from d where len(lines) > 1)
select doc_id, line_no, license_id, digest from (select doc_id, line_no, sha256(unit) as digest from u) join k using (digest)
"""


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *(F.round(c, 6).alias(c) for c in ("evidence", "prior", "p_good")), "good")


def _op8_sql() -> str:
    binned = lambda x: f"least(20, floor({x}))::int"
    share = lambda pattern: f"(length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))) / n"
    columns = {
        "marks": binned(share(r"[^\p{L}\p{N}\x20\x09-\x0D]+") + " * 20 * 2"),
        "capitals": binned(share(r"\p{Lu}+") + " * 20"),
        "digits": binned(share(r"\p{N}+") + " * 20"),
        "distinct_words": binned("len(list_distinct(ws)) / greatest(len(ws), 1) * 20"),
        "word_length": binned("n / greatest(len(ws), 1)"),
        "line_length": binned("length(bin(greatest(1, n // len(string_split(t, chr(10)))))) - 1"),
        "length": binned("length(bin(n)) - 1"),
    }
    levels = ("l0", "l1", "l2")
    same = lambda a, b, keys: " and ".join(f"{a}.{c} is not distinct from {b}.{c}" for c in keys)
    parts = [
        "t as (select *, coalesce(text, '') as t, greatest(length(coalesce(text, '')), 1) as n, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as ws from documents)",
        "r as (select doc_id, row_number() over () as i, source as l0, lang as l1, (length(bin(n)) - 1)::varchar as l2, " + ", ".join(f"{x} as {c}" for c, x in columns.items()) + " from t)",
        "y as (select doc_id, (quality > 0)::int as good from labels where quality is not null)",
        "s as (select r.*, y.good from r join y using (doc_id))",
        "a as (select coalesce(sum(good), 0)::double as good, count(*)::double as n from s)",
        "o as (select doc_id, sum(good) as g, count(*) as c from y group by 1)",
        "d as (select r.*, coalesce(o.g, 0) as g, coalesce(o.c, 0) as c, a.good as total_good, a.n as total_n, (a.good - coalesce(o.g, 0) + 1) / (a.n - coalesce(o.c, 0) + 2) as rate from r left join o using (doc_id), a)",
        "x as (" + " union all ".join(f"select i, '{c}' as m, {c} as bin from r" for c in columns) + ")",
        "b as (" + " union all ".join(f"select '{c}' as m, {c} as bin, sum(good) as k, count(*) as n from s group by 2" for c in columns) + ")",
        "e as (select d.i, sum(coalesce(ln(((b.k - g + rate) / (total_good - g + 1)) / ((b.n - b.k - (c - g) + 1 - rate) / (total_n - total_good - (c - g) + 1))), 0)) as evidence from d join x using (i) left join b using (m, bin) group by 1)",
        "s0 as (select s.*, (a.good + 1) / (a.n + 2) as above from s, a)",
        "p0 as (select *, rate as prior from d)",
    ]
    for i in range(len(levels)):
        keys = levels[: i + 1]
        parts += [
            f"g{i} as (select {', '.join(keys)}, sum(good) as k, count(*) as n, avg(above) as p from s{i} group by all)",
            f"h{i} as (select case when count(*) > 1 then least(1000.0, greatest(1.0, sum(n * p * (1 - p)) / sum(n) / greatest((sum(n * (k / n - p) ** 2) - sum(p * (1 - p))) / sum(n), 1e-9))) else 10.0 end::double as h from g{i})",
            f"s{i + 1} as (select s{i}.* exclude (above), (k + h * p) / (n + h) as above from s{i} join g{i} on {same(f's{i}', f'g{i}', keys)}, h{i})",
            f"p{i + 1} as (select p{i}.* exclude (prior), coalesce((k - g + h * prior) / (n - c + h), prior) as prior from p{i} left join g{i} on {same(f'p{i}', f'g{i}', keys)}, h{i})",
        ]
    return "with " + ",\n".join(parts) + """,
z as (select doc_id, evidence, prior, ln(least(greatest(prior, 1e-6), 1 - 1e-6::double) / (1 - least(greatest(prior, 1e-6), 1 - 1e-6::double))) as logit from p3 join e using (i))
select doc_id, round(evidence, 6) as evidence, round(prior, 6) as prior, round(1 / (1 + exp(-(evidence + logit))), 6) as p_good, 1 / (1 + exp(-(evidence + logit))) >= 0.5 as good from z"""


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    out = chat.format_chat(turns.unionByName(hard))
    said = F.array_join(F.transform(chat.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = chat.read_learned(F.col("formatted"), F.col("loss_spans"))
    return out.select(
        "conv_id",
        F.size(chat.read_turns(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, length(replace(text, '\', '\0')) + 2 * len(regexp_extract_all(text, '<\||</?s>|\[/?INST\]|<</?SYS>>')) as inside,
  length(replace(replace(role, '\', '\0'), chr(10), '\1')) + 2 * len(regexp_extract_all(role, '<\||</?s>|\[/?INST\]|<</?SYS>>')) as head from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls last, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls last, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(8 + head + 1 + inside + 8)::bigint as formatted_chars
from e group by conv_id
"""


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


OP10_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s
qualify rank <= 10
"""


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


OP11_SQL = r"""
with w as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
d as (select *, len(terms)::bigint as n from w where len(terms) > 0),
c as (select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from d),
q as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark where text is not null),
i as (select item_id, term, count(*) as times from q group by all),
t as (select r, term, count(*)::bigint as tf from (select r, unnest(terms) as term from d) where term in (select term from i) group by all),
f as (select term, count(*)::bigint as df from t group by all),
s as (select i.item_id, d.doc_id, d.r, sum(i.times * floor(1000 * ln((2 * c.n_docs + 2)::double / (2 * f.df + 1)::double))::bigint
    * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (25 + (75 * d.n * c.n_docs) // c.n_terms::bigint))))::bigint as score
  from i join t using (term) join f using (term) join d using (r), c group by all)
select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last)::int as rank, doc_id, score from s where score > 0
qualify rank <= 10
"""


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf_dir, "documents"), plant=True)


def op13_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/corvane-ids-{uuid.uuid4().hex}"
    token_file.write(token_file.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2), path)
    return token_file.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Query] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_language_id": op2_language_id,
    "op3_source_mix": op3_source_mix,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_bpe_round_trip": op6_bpe_round_trip,
    "op7_license_scan": op7_license_scan,
    "op8_quality": op8_quality,
    "op9_chat_format": op9_chat_format,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_ranked_search": op11_ranked_search,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_file": op13_token_file,
}
ORACLES: dict[str, str] = {"op3_source_mix": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op7_license_scan": _op7_sql(), "op8_quality": _op8_sql(), "op9_chat_format": OP9_SQL, "op10_exact_top_k": OP10_SQL, "op11_ranked_search": OP11_SQL}
