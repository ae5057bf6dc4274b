"""Scholarly views over the star schema, in SQL that Spark and DuckDB both read; the oracle uses the very same text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from folioscope.tables import read

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

VIEWS: dict[str, str] = {
    "first_lines": """
        select l_orderkey, l_partkey from (
            select l_orderkey, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as rn from {lineitem}) x
        where rn = 1""",
    "works": """
        select o_orderkey as work_id,
               case when o_orderkey % 5 = 0 then null else 'https://doi.org/10.5555/' || cast(o_orderkey as string) end as doi,
               p_type || ' ' || p_name as title, cast(o_orderdate as date) as publication_date, cast(year(o_orderdate) as int) as publication_year,
               cast(floor(o_totalprice / 5000) as int) as cited_by_count, o_orderpriority as venue, o_orderstatus as work_type
        from {orders} left join {first_lines} on o_orderkey = l_orderkey left join {part} on l_partkey = p_partkey""",
    "authorships": """
        select work_id, scholar_id, cast(rn - 1 as int) as position_index, cast(n as int) as author_count,
               case when rn = 1 then 'first' when rn = n then 'last' else 'middle' end as author_position, is_corresponding
        from (select work_id, scholar_id, is_corresponding, row_number() over (partition by work_id order by first_line, scholar_id) as rn,
                     count(*) over (partition by work_id) as n
              from (select l_orderkey as work_id, l_suppkey as scholar_id, min(l_linenumber) as first_line, bool_or(l_returnflag = 'A') as is_corresponding
                    from {lineitem} group by l_orderkey, l_suppkey) g) x""",
    "scholars": """
        select s_suppkey as scholar_id, s_name as display_name, 'scholar ' || cast(s_suppkey % 20 as string) as name_key, s_nationkey as institution_id,
               case when s_suppkey % 4 = 0 then '0000-0000-0000-' || lpad(cast(s_suppkey as string), 4, '0') end as orcid
        from {supplier}""",
    "institutions": """
        select n_nationkey as institution_id, n_name as display_name, r_name as country_code from {nation} join {region} on n_regionkey = r_regionkey""",
    "byline_institutions": """
        select a.work_id, a.scholar_id, c_nationkey as institution_id, cast(year(o_orderdate) as int) as year
        from {authorships} a join {orders} on a.work_id = o_orderkey join {customer} on o_custkey = c_custkey""",
    "work_topics": """
        select work_id, topic, rn = 1 as is_primary, cast(1 as double) / rn as score
        from (select work_id, topic, row_number() over (partition by work_id order by first_line, topic) as rn
              from (select l_orderkey as work_id, p_name || ' ' || p_brand as topic, min(l_linenumber) as first_line
                    from {lineitem} join {part} on l_partkey = p_partkey group by l_orderkey, p_name || ' ' || p_brand) g) x""",
    "work_citations": """
        select citing_work_id, cited_work_id from (
            select o_orderkey as citing_work_id, lag(o_orderkey, 1) over (partition by o_custkey order by o_orderdate, o_orderkey) as cited_work_id from {orders}
            union all
            select o_orderkey as citing_work_id, lag(o_orderkey, 2) over (partition by o_custkey order by o_orderdate, o_orderkey) as cited_work_id from {orders}) x
        where cited_work_id is not null""",
    "focus": "select scholar_id from {scholars}",
    "abstracts": "select doc_id as work_id, text as abstract, lang as language from {documents}",
    "usage_events": """
        select event_id, sha256_hex(user_id) as visitor_hash, case when user_id % 5 = 0 then null else user_id end as user_id,
               case event_type when 'view' then 'page_view' when 'click' then 'search' when 'purchase' then 'profile_view'
                               when 'signup' then 'signup' else 'server_error' end as event_type,
               cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as scholar_id, cast(ts as timestamp) as created_at
        from {events}""",
    "jobs": """
        select o_orderkey as job_id, o_custkey % 100 as scholar_id, case o_orderstatus when 'P' then 'pending' when 'F' then 'failed' else 'succeeded' end as status,
               cast(o_orderdate as timestamp) as updated_at from {orders}""",
}
#: Functions that the two engines spell differently: (name, Spark, DuckDB), of one argument.
SPELLED = [("sha256_hex", "sha2(cast({} as string), 256)", "sha256(cast({} as varchar))")]


def _spelled(sql: str, engine: int) -> str:
    for name, *forms in SPELLED:
        sql = re.sub(rf"{name}\((\w+)\)", lambda m: forms[engine].format(m[1]), sql)  # noqa: B023
    return sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or one of the views as a DataFrame."""
    if name in TABLES:
        return read(spark, sf_dir, name)
    text = _spelled(VIEWS[name], 0)
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", text))})


def oracle(sql: str) -> str:
    """DuckDB SQL over the views."""
    views = ", ".join(f"{n} as ({re.sub(r'[{}]', '', _spelled(t, 1))})" for n, t in VIEWS.items())
    sql = sql.strip()
    if sql.lower().startswith("with recursive "):
        return f"with recursive {views}, {sql[15:]}"
    return f"with {views}, {sql[5:]}" if sql.lower().startswith("with ") else f"with {views} {sql}"
