"""Queries of retrieval over questions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import graph, infer, search, text_index, vectors
from corvane.plans.registry import query
from corvane.session import shared_dir, written
from corvane.sources.fixtures import Tables

WORDS = r"'[\p{L}\p{N}]+'"
BM25 = rf"""q as (select query_id, unnest(list_distinct(regexp_extract_all(lower(question), {WORDS}))) as term from v_queries),
dt as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), {WORDS}) as terms from documents), ln as (select doc_id, len(terms) as length from dt), st as (select count(*) as n_docs, avg(length) as mean_length from ln),
tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(terms) as term from dt) where term in (select term from q) group by 1, 2), df as (select term, count(*) as df from tf group by 1),
po as (select doc_id, term, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean_length)) as w from tf join df using (term) join ln using (doc_id), st),
sc as (select query_id, doc_id, round(sum(w), 6) as score from q join po using (term) group by 1, 2),
kw as (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from sc qualify rank <= 10)"""


def keyword(t: Tables) -> DataFrame:
    return search.top(search.bm25(t("v_queries"), t("documents")), 10)


@query("keyword_bm25_topk", f"with {BM25} select * from kw", "v_queries")
def keyword_bm25_topk(t: Tables) -> DataFrame:
    return keyword(t)


@query("indexed_bm25_topk", f"with {BM25} select * from kw", "v_queries")
def indexed_bm25_topk(t: Tables) -> DataFrame:
    """Through a stored index that held other texts for a third of the documents before it was brought up to date."""
    path = f"{shared_dir(t.spark)}/corvane-text-{uuid.uuid4().hex}"
    docs = t("documents").select("doc_id", "text")
    text_index.update(path, docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("earlier draft "), F.reverse("text"))).otherwise(F.col("text"))))
    text_index.update(path, docs)
    return text_index.search(t.spark, path, t("v_queries"), 10)


VEC = """vq as (select query_id, list_transform(embedding, lambda x: x::double) as q from v_vec_queries), vd as (select vec_id as doc_id, list_transform(embedding, lambda x: x::double) as d from embeddings),
vs as (select query_id, doc_id, round(list_cosine_similarity(q, d), 6) as score from vq, vd where query_id <> doc_id), vt as (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from vs qualify rank <= 10)"""


def _vectors(t: Tables) -> DataFrame:
    return t("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


@query("vector_topk", f"with {VEC} select * from vt", "v_vec_queries")
def vector_topk(t: Tables) -> DataFrame:
    return search.vector_top_k(t("v_vec_queries"), _vectors(t))


@query("lsh_topk")
def lsh_topk(t: Tables) -> DataFrame:
    return search.lsh_top_k(t("v_vec_queries"), _vectors(t))


@query("cells_topk")
def cells_topk(t: Tables) -> DataFrame:
    """Through a stored index of cells by label; recall is measured against the exact search."""
    path, items = f"{shared_dir(t.spark)}/corvane-cells-{uuid.uuid4().hex}", _vectors(t)
    vectors.build_index(path, items)
    return vectors.search_index(t.spark, path, t("v_vec_queries"))


NAMES = "nm as (select p_partkey as doc_id, lower(p_name) as key from part), qk as (select doc_id as query_id, substr(key, 1, 6) as key from nm where doc_id % 100 = 0)"


def _names(t: Tables) -> tuple[DataFrame, DataFrame]:
    names = t("part").select(F.col("p_partkey").alias("doc_id"), F.lower("p_name").alias("key"))
    return names.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.substring("key", 1, 6).alias("key")), names


@query("prefix_match", f"with {NAMES} select query_id, doc_id from qk join nm on starts_with(nm.key, qk.key)")
def prefix_match(t: Tables) -> DataFrame:
    return search.lookup_prefix(*_names(t))


@query("exact_match", "with nm as (select p_partkey as doc_id, lower(p_name) as key from part) select a.doc_id as query_id, b.doc_id from nm a join nm b on a.key = b.key where a.doc_id % 100 = 0")
def exact_match(t: Tables) -> DataFrame:
    names = _names(t)[1]
    return search.lookup_exact(names.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "key"), names)


@query(
    "trigram_match",
    """with nm as (select p_partkey as doc_id, lower(p_name) as key from part), g as (select doc_id, list_distinct(list_transform(range(1, greatest(length(key) - 2, 1) + 1), lambda i: substr(key, i, 3))) as g from nm),
s as (select a.doc_id as query_id, b.doc_id, len(list_intersect(a.g, b.g)) as shared, len(a.g) as n, len(b.g) as m from g a, g b where a.doc_id % 100 = 0)
select query_id, doc_id, round(shared / (n + m - shared), 6) as similarity from s where round(shared / (n + m - shared), 6) >= 0.5""",
)
def trigram_match(t: Tables) -> DataFrame:
    names = _names(t)[1]
    return search.trigram_match(names.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "key"), names, 0.5)


INTENT = "case " + " ".join(f"when regexp_matches(lower(coalesce(text, '')), '{p}') then '{n}'" for n, p in tx.INTENTS) + " else 'mixed' end"
MODE = lambda i: "case intent " + " ".join(f"when '{k}' then {w[i]}" for k, w in search.MODES.items()) + " end"
HYBRID = f"""{BM25}, hq as (select query_id, list_transform(embedding, lambda x: x::double) as q from v_queries join embeddings on vec_id = query_id), hd as (select vec_id as doc_id, list_transform(embedding, lambda x: x::double) as d from embeddings),
hs as (select query_id, doc_id, round(list_cosine_similarity(q, d), 6) as score from hq, hd where query_id <> doc_id), hv as (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from hs qualify rank <= 10),
he as (select distinct src, dst from v_imports), g0 as (select query_id, doc_id from kw where rank = 1), g1 as (select query_id, dst as doc_id from g0 join he on src = doc_id), g2 as (select query_id, dst as doc_id from g1 join he on src = doc_id),
gp as (select query_id, doc_id, round(1 / (1 + min(depth)), 6) as score from (select *, 0 as depth from g0 union all select *, 1 from g1 union all select *, 2 from g2) group by 1, 2), gr as (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from gp qualify rank <= 10),
rt as (select query_id, ({MODE(0)})::double as wk, ({MODE(1)})::double as wv, ({MODE(2)})::double as wg from (select query_id, {INTENT.replace("text", "question")} as intent from v_queries)),
pt as (select query_id, doc_id, wk / (60 + rank) as part from kw join rt using (query_id) union all select query_id, doc_id, wv / (60 + rank) from hv join rt using (query_id) union all select query_id, doc_id, wg / (60 + rank) from gr join rt using (query_id)),
hy as (select query_id, doc_id, round(sum(part), 8) as score from pt group by 1, 2), ht as (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from hy qualify rank <= 10)"""


def hybrid(t: Tables) -> DataFrame:
    """Keyword, vector and graph retrieval, fused with the weights of each question's intent.

    Documents, vectors and files share ids: a question's vector is that of its own id, and the graph is walked from its best keyword hit.
    """
    questions = t("v_queries")
    words = written(keyword(t))
    asked = questions.select("query_id").join(t("embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")
    near = search.vector_top_k(asked, _vectors(t))
    seeds = words.where("rank = 1").select("query_id", F.col("doc_id").alias("seed"))
    hops = graph.neighbors(seeds.select(F.col("seed").alias("node")).distinct(), t("v_imports"), 2, None).join(seeds, "seed")
    around = search.top(search.proximity(hops.select("query_id", F.col("node").alias("doc_id"), "depth")), 10)
    return search.top(search.fuse({"keyword": words, "vector": near, "graph": around}, search.route(questions)), 10)


@query("hybrid_rrf", f"with {HYBRID} select * from ht", "v_queries", "v_imports")
def hybrid_rrf(t: Tables) -> DataFrame:
    return hybrid(t)


SCOPED = VEC.replace("select query_id, list", "select query_id, label, list").replace("select vec_id as doc_id, list", "select vec_id as doc_id, label, list").replace("from vq, vd where query_id <> doc_id", "from vq join vd using (label) where query_id <> doc_id")


@query("vector_scoped", f"with {SCOPED} select * from vt", "v_vec_queries")
def vector_scoped(t: Tables) -> DataFrame:
    items = t("embeddings").select(F.col("vec_id").alias("doc_id"), "label", "embedding")
    return search.vector_top_k(t("v_vec_queries"), items, scope=("label",))


BUDGET = "bu as (select query_id, doc_id, rank, score, length as tokens, sum(length) over (partition by query_id order by rank) as running from kw join ln using (doc_id))"


@query("context_budget", f"with {BM25}, {BUDGET} select query_id, doc_id, rank, tokens::int as tokens, running::bigint as running from bu where running <= 1500", "v_queries")
def context_budget(t: Tables) -> DataFrame:
    tokens = t("documents").select("doc_id", F.size(tx.tokens(F.col("text"))).alias("tokens"))
    return search.assemble(keyword(t).join(tokens, "doc_id"), 1500).select("query_id", "doc_id", "rank", "tokens", "running")


@query("graph_proximity", "with recursive e as (select distinct src, dst from v_imports), r as (select distinct src as query_id, src as doc_id, 0 as depth from e where src % 100 = 0 union select r.query_id, e.dst, r.depth + 1 from r join e on e.src = r.doc_id where r.depth < 2) select query_id, doc_id, round(1 / (1 + min(depth)), 6) as score from r group by 1, 2".replace("with recursive ", "with "), "v_imports", recursive=True)
def graph_proximity(t: Tables) -> DataFrame:
    seeds = t("v_imports").where("src % 100 = 0").select(F.col("src").alias("node")).distinct()
    near = graph.neighbors(seeds, t("v_imports"), 2, None)
    return search.proximity(near.select(F.col("seed").alias("query_id"), F.col("node").alias("doc_id"), "depth"))


@query("intent_router", f"select discussion_id, turn, intent, ({MODE(0)})::double as w_keyword from (select *, {INTENT} as intent from v_discussions where role = 'user')", "v_discussions")
def intent_router(t: Tables) -> DataFrame:
    return search.route(t("v_discussions").where("role = 'user'"), "text").select("discussion_id", "turn", "intent", "w_keyword")


@query("entities_in_questions", rf"with w as (select item_id as query_id, regexp_extract_all(lower(text), {WORDS}) as t from benchmark), r as (select distinct query_id, array_to_string(t[i:i + 1], ' ') as key from (select query_id, t, unnest(range(1, greatest(len(t) - 1, 1) + 1)) as i from w)), d as (select doc_id, array_to_string(regexp_extract_all(lower(coalesce(text, '')), {WORDS})[1:2], ' ') as key from documents) select distinct query_id, doc_id from r join d using (key)")
def entities_in_questions(t: Tables) -> DataFrame:
    names = t("documents").select("doc_id", F.array_join(F.slice(tx.tokens(F.col("text")), 1, 2), " ").alias("key"))
    return search.resolve_entities(search.valid_questions(t("v_queries")), names)


CITED = r"""ci as (select query_id * 1000000 + doc_id as claim_id, case when doc_id % 7 = 0 then -doc_id - 1 else doc_id end as doc_id, case when doc_id % 5 = 0 then 2 else 1 end as snapshot, question || case when doc_id % 3 = 0 then ' ' || repeat('zq' || query_id || ' ', 1) || md5(question) || ' ' || md5(question || 'a') else '' end as claim from v_gold join v_queries using (query_id)),
cw as (select ci.*, d.doc_id is not null as found, list_distinct(regexp_extract_all(lower(claim), '[\p{L}\p{N}]+')) as cwords, regexp_extract_all(lower(coalesce(d.text, '')), '[\p{L}\p{N}]+') as dwords from ci left join documents d on d.doc_id = ci.doc_id),
ck as (select claim_id, doc_id, round(len(list_intersect(cwords, dwords)) / len(cwords), 6) as support, case when not found or snapshot <> 1 then 'limitation' when round(len(list_intersect(cwords, dwords)) / len(cwords), 6) < 0.8 then 'downgraded' else 'kept' end as outcome from cw)"""


def checked(t: Tables) -> DataFrame:
    n, q = F.col("doc_id"), F.col("question")
    noise = F.concat(F.lit(" zq"), F.col("query_id").cast("string"), F.lit(" "), F.lit(" "), F.md5(q), F.lit(" "), F.md5(F.concat(q, F.lit("a"))))
    claims = t("v_gold").join(t("v_queries"), "query_id").select((F.col("query_id") * 1000000 + n).alias("claim_id"), F.when(n % 7 == 0, -n - 1).otherwise(n).alias("doc_id"), F.when(n % 5 == 0, 2).otherwise(1).alias("snapshot"), F.concat(q, F.when(n % 3 == 0, noise).otherwise("")).alias("claim"))
    evidence = t("documents").select("doc_id", F.lit(1).alias("snapshot"), "text")
    return search.verify_citations(claims, evidence, 0.8)


@query("citation_check", f"with {CITED} select * from ck", "v_gold", "v_queries")
def citation_check(t: Tables) -> DataFrame:
    return checked(t)


@query(
    "answer_records",
    f"with {BM25}, ev as (select query_id, count(*) as n, string_agg(doc_id, ',' order by rank) as src, round(1 - exp(sum(ln(1 - least(score / (score + 10), 0.999)))) + 1e-9, 6) as confidence from kw where rank <= 3 and score > 5 group by 1) select query_id, question, coalesce(n, 0) as n_evidence, src as sources, coalesce(confidence, 0.0) as confidence, n is null as insufficient from v_queries left join ev using (query_id)",
    "v_queries",
)
def answer_records(t: Tables) -> DataFrame:
    kept = keyword(t).where("rank <= 3 and score > 5").withColumn("confidence", F.col("score") / (F.col("score") + 10))
    out = search.answers(t("v_queries"), kept)
    return out.select("query_id", "question", "n_evidence", F.array_join(F.transform("sources", lambda s: s.cast("string")), ",").alias("sources"), "confidence", "insufficient")


@query("reranked", f"with {BM25}, e as (select l_orderkey as doc_id, case l_returnflag when 'A' then 'artifact' when 'R' then 'source_span' else 'model_inference' end as evidence_type, round(l_discount * 10, 2) as confidence from lineitem) select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, confidence desc nulls last, case evidence_type when 'artifact' then 0 when 'source_span' then 1 else 2 end, doc_id)::int as place from kw left join (select doc_id, min(evidence_type) as evidence_type, max(confidence) as confidence from e group by 1) using (doc_id)", "v_queries")
def reranked(t: Tables) -> DataFrame:
    evidence = t("v_evidence").groupBy(F.col("decision_id").alias("doc_id")).agg(F.min("evidence_type").alias("evidence_type"), F.max("confidence").alias("confidence"))
    return search.rerank(keyword(t), evidence).select("query_id", "doc_id", "score", "place")


@query("search_filtered", "select decision_id, evidence_id, evidence_type from v_evidence where evidence_type in ('artifact', 'source_span') and confidence >= 0.5", "v_evidence")
def search_filtered(t: Tables) -> DataFrame:
    return t("v_evidence").where(F.col("evidence_type").isin("artifact", "source_span") & (F.col("confidence") >= 0.5)).select("decision_id", "evidence_id", "evidence_type")


@query("release_contents", r"with r as (select discussion_id * 1000 + turn as artifact_id, 'see #' || (discussion_id % 50) || ' and #' || (turn + 1000000) as text from v_discussions) select distinct artifact_id, x::bigint as number from (select artifact_id, unnest(regexp_extract_all(text, '#(\d+)', 1)) as x from r) where x::bigint in (select query_id from v_queries)", "v_discussions", "v_queries")
def release_contents(t: Tables) -> DataFrame:
    d, n = F.col("discussion_id"), F.col("turn")
    notes = t("v_discussions").select((d * 1000 + n).alias("id"), F.concat(F.lit("see #"), (d % 50).cast("string"), F.lit(" and #"), (n + 1000000).cast("string")).alias("notes"))
    return infer.release_contents(notes, t("v_queries").select(F.col("query_id").alias("number")))


@query("error_codes", "select cast(json_extract_string(props, '$.k') as int) % 4 as code, case cast(json_extract_string(props, '$.k') as int) % 4 when 0 then 'not_found' when 1 then 'conflict' when 2 then 'rate_limited' else 'internal' end as error, (cast(json_extract_string(props, '$.k') as int) % 4 >= 2) as retryable, count(*) as n from events group by all")
def error_codes(t: Tables) -> DataFrame:
    codes = t.spark.createDataFrame([(0, "not_found", False), (1, "conflict", False), (2, "rate_limited", True), (3, "internal", True)], "code int, error string, retryable boolean")
    seen = t("events").select((F.element_at(F.from_json("props", "map<string,int>"), "k") % 4).alias("code"))
    return seen.join(F.broadcast(codes), "code").groupBy("code", "error", "retryable").agg(F.count(F.lit(1)).alias("n"))


@query("semantic_cohesion", "with m as (select label::varchar as subsystem, vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), p as (select subsystem, vec_id, unnest(range(1, 65)) as i, unnest(v) as x from m), c as (select subsystem, i, avg(x) as x from p group by 1, 2), k as (select subsystem, list(x order by i) as c from c group by 1) select subsystem, round(avg(list_cosine_similarity(v, c)), 6) as cohesion from m join k using (subsystem) group by 1")
def semantic_cohesion(t: Tables) -> DataFrame:
    members = t("embeddings").select(F.col("label").cast("string").alias("subsystem"), F.col("vec_id").alias("file_id"))
    return infer.semantic_cohesion(members, t("embeddings").select(F.col("vec_id").alias("file_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding")))
