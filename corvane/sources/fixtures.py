"""Views over the driver tables (FIXTURES.md). The same text runs in Spark and in DuckDB, and gives the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from corvane.operators import search
from corvane.session import written

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    "v_submissions": """
select page_id as request_id, case page_id % 8
 when 0 then concat('https://github.com', p) when 1 then concat('https://www.github.com', p, '.git/')
 when 2 then concat('http://GitHub.com', p, '/') when 3 then concat('https://gitlab.com', p)
 when 4 then concat('https://github.com', p, '/tree/main') when 5 then concat('https://github.com/', split_part(p, '/', 2))
 when 6 then concat('https://u:x@github.com:443', p, '?x=1#f') else url end as raw_url
from (select page_id, url, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) as p from pages) t
""",
    "v_repositories": """
select c_custkey as id, concat('https://github.com/', c_mktsegment, '/', replace(c_name, '#', '-')) as github_url,
 c_mktsegment as owner, replace(c_name, '#', '-') as name from customer
""",
    "v_snapshots": """
select o_orderkey as id, o_custkey as repository_id, md5(cast(o_orderkey % 997 as varchar(20))) as commit_sha, 'main' as default_branch,
 case o_orderstatus when 'O' then 'pending' when 'F' then 'ready' else 'failed' end as status, o_orderdate as created_at from orders
""",
    "v_jobs": """
select o_orderkey as id, o_custkey as repository_id, case when o_orderkey % 101 = 0 then o_orderkey + 1000000000 else o_orderkey end as snapshot_id,
 case o_orderstatus when 'O' then 'running' when 'F' then 'completed' else 'failed' end as status,
 case o_orderstatus when 'F' then 100 else cast(o_orderkey % 103 as int) end as progress,
 case o_orderstatus when 'P' then 'error' end as error_message, o_orderdate as created_at from orders
""",
    "v_job_updates": """
select user_id as job_id, event_id as seq, ts,
 case event_type when 'signup' then 'queued' when 'view' then 'running' when 'click' then 'running' when 'purchase' then 'completed' else 'failed' end as status,
 case when event_type = 'purchase' and event_id % 2 = 0 then 100 else cast(floor(value / 5) as int) end as progress,
 case when event_type = 'error' and event_id % 3 <> 0 then 'e' end as error_message from events
""",
    "v_stage_events": """
select user_id as job_id, cast(event_id % 14 as int) as stage, ts,
 case event_type when 'error' then 'failed' when 'purchase' then 'completed' else 'running' end as status, value as cost from events
""",
    "v_commits": """
select o_orderkey as sha, o_custkey as author_id, o_orderdate as ts from orders
""",
    "v_commit_files": """
select distinct l_orderkey as sha, l_partkey as file_id from lineitem
""",
    "v_reviews": """
select distinct l_orderkey as sha, l_suppkey as reviewer_id from lineitem
""",
    "v_files": """
select p_partkey as file_id, concat(p_brand, '/', p_type, '/', p_name, '-', cast(p_partkey as varchar(20))) as path, p_brand as directory, p_type as language, p_size as n_lines from part
""",
    "v_imports": """
select distinct src, dst from (select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as dst
 from lineitem) t where dst is not null
""",
    "v_queries": """
select item_id as query_id, text as question from benchmark
""",
    "v_gold": """
select b.item_id as query_id, d.doc_id from documents d join benchmark b on contains(d.text, b.text)
""",
    "v_vec_queries": """
select vec_id as query_id, embedding, label from embeddings where vec_id % 100 = 0
""",
    "v_discussions": """
select conv_id as discussion_id, turn, role, text from conversations
""",
    "v_evidence": """
select l_orderkey as decision_id, l_linenumber as evidence_id, case l_returnflag when 'A' then 'artifact' when 'R' then 'source_span' else 'model_inference' end as evidence_type,
 round(l_discount * 10, 2) as confidence from lineitem
""",
    "v_signals": """
select p_brand as subsystem, p_partkey as file_id, p_size > 25 as directory_signal, p_partkey % 3 = 0 as import_signal, p_partkey % 5 = 0 as docs_signal, p_retailprice > 1000 as cochange_signal from part
""",
    # provider responses per repository: status code and body for the metadata and for the head commit
    "v_payloads": """
select id as repository_id, case id % 11 when 3 then 404 when 4 then 403 when 5 then 500 else 200 end as status_code,
 case when id % 11 in (3, 4, 5) then null when id % 13 = 0 then concat('{"id": ', cast(id as varchar(20)), ', "name": "', name, '"}')
 else concat('{"id": "', cast(id as varchar(20)), '", "name": "', name, '", "full_name": "', owner, '/', name,
  '", "default_branch": "main", "private": ', case when id % 17 = 0 then 'true' else 'false' end, ', "size": 3}') end as repo_raw,
 case when id % 7 = 0 then '{"message": "none"}' else concat('{"sha": "', md5(cast(id as varchar(20))), '", "node": 1}') end as commit_raw
from (select c_custkey as id, c_mktsegment as owner, replace(c_name, '#', '-') as name from customer) t
""",
}


#: Views that sort a whole table or search all texts: written once a query, however often it reads them.
KEPT = ("v_imports", "v_gold")


class Tables:
    """Driver tables and views of one folder, as DataFrames by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.kept: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name in KEPT and name in self.kept:
            return self.kept[name]
        if name == "v_gold":  # the same rows without comparing every document with every item
            found = search.containing(self("documents"), self("v_queries"))
            self.kept[name] = written(found.select("query_id", "doc_id"))
            return self.kept[name]
        if name not in VIEWS:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        text = VIEWS[name]
        used = {b: self(b) for b in BASE if re.search(rf"\b(?:from|join) {b}\b", text)}
        text = text.replace("{", "{{").replace("}", "}}")
        for b in used:
            text = re.sub(rf"\b(from|join) {b}\b", rf"\1 {{{b}}}", text)
        rows = self.spark.sql(text, **used)
        if name in KEPT:
            rows = self.kept[name] = written(rows)
        return rows


def with_views(body: str, *names: str, recursive: bool = False) -> str:
    """DuckDB text of ``body`` with the named views in front."""
    body = body.strip()
    ctes = [f"{n} as ({VIEWS[n].strip()})" for n in names]
    start = "with recursive " if recursive else "with "
    if body.startswith("with "):
        return start + ",\n".join([*ctes, body[5:]])
    return start + ",\n".join(ctes) + "\n" + body if ctes else body
