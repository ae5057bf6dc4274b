"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate,
    html_text,
    jaccard_join,
    katz,
    neighbours,
    packing,
    prefix_trie,
    secrets,
    structure_repair,
    suffix_dedup,
    token_files,
    toxicity,
    url_filters,
)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


#: The rules of op3: (host, path, verdict).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_read(spark, sf_dir, "documents"), end_id=1)


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), width=5, percent=80)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), end_id=2, capacity=4096)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per repeated passage: the document that repeats it, where, and a document that keeps it."""
    found = suffix_dedup.repeated_passages(_read(spark, sf_dir, "documents"), least=50)
    return found.select("doc_id", F.explode("spans").alias("s")).select(
        "doc_id",
        F.col("s.start").cast("long").alias("start_word"),
        F.col("s.end").cast("long").alias("end_word"),
        F.col("s.first").alias("first_doc_id"),
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(_read(spark, sf_dir, "documents"), width=5, percent=80)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"), _fold(5) != 0)
    held_out = (_fold(5) == 0).alias("held_out")
    return toxicity.score(docs, model, keep=["doc_id"]).select(
        "doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "rejected"
    )


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(_read(spark, sf_dir, "documents"), _fold(10) == 0)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(prefix_trie.rebuilt_with_shared_heads(_read(spark, sf_dir, "conversations")))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "novel")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair.audits(structure_repair.damaged(_read(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_files, op2_nearest_neighbours, op3_url_filters, op4_html_extraction, op5_decontaminate, op6_packing, op7_suffix_dedup, op8_jaccard_join, op9_toxicity, op10_katz, op11_prefix_trie, op12_secret_scan, op13_structure_repair)
}



def _sql_crc32(text: str) -> str:
    """Unsigned crc32 of ASCII text, bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))"
    step = "xor(xor(a, b) >> 1, case when xor(a, b) & 1 = 1 then 3988292384::bigint else 0::bigint end)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {bits}), lambda a, b: {step}), 4294967295::bigint)"


def _sql_prepend(rest: str, cost: str, letters: str, lines: str) -> str:
    """A repair (six digits of cost, its audit, chr(1), its lines) that begins with these edits."""
    return (
        f"(lpad(cast(cast({rest}[1:6] as int) + {cost} as varchar), 6, '0') || {letters} || substr({rest}, 7, strpos({rest}, chr(1)) - 7) || chr(1) || {lines} || substr({rest}, strpos({rest}, chr(1)) + 1))"
    )


def _sql_repairs() -> str:
    """The cheapest repair of a row and all behind it, from each state of the grammar (begun, after a system, user, assistant turn): from the last row to the first.

    Of equal costs the least audit comes first, as strings compare.
    """
    onward = {"z": "u", "s": "u", "u": "a", "a": "u"}
    told = {"u": "'user:'", "a": "'assistant:'"}
    moves = []
    for q, to in onward.items():
        keeps = [f"when initial = '{to}' then {_sql_prepend(f'n{to}', 'extra', chr(39) + 'K' + chr(39), 'line')}"]
        if q == "z":
            keeps.append(f"when initial = 's' then {_sql_prepend('ns', 'extra', chr(39) + 'K' + chr(39), 'line')}")
        rerole = _sql_prepend(f"n{to}", "(3 + extra)", "'R'", f"{told[to]} || text || chr(10)")
        moves.append(f"least({_sql_prepend(f'n{q}', '4', chr(39) + 'D' + chr(39), chr(39) * 2)}, case when stays then {rerole} else '9' end, case when not stays then '9' {' '.join(keeps)} else '9' end) as m{q}")
    inserts = []
    for q, to in onward.items():
        after = onward[to]
        one = _sql_prepend(f"m{to}", "3", "'I'", f"{told[to]} || chr(10)")
        two = _sql_prepend(f"m{after}", "6", "'II'", f"{told[to]} || chr(10) || {told[after]} || chr(10)")
        inserts.append(f"least(m{q}, {one}, {two}) as n{q}")
    return f"""repairs as (
            select conv_id, last as i, '000000' || chr(1) as nz, '000006II' || chr(1) || 'user:' || chr(10) || 'assistant:' || chr(10) as ns, '000003I' || chr(1) || 'assistant:' || chr(10) as nu, '000000' || chr(1) as na
            from (select conv_id, max(i) as last from judged group by 1)
            union all
            select conv_id, i, {', '.join(inserts)} from (
                select j.conv_id, j.i - 1 as i, {', '.join(moves)}
                from repairs p join (select *, role || ':' || text || chr(10) as line, role[1:1] as initial, fault not in ('B', 'D') as stays, case when fault = 'T' then 3 else 0 end as extra from judged) j on j.conv_id = p.conv_id and j.i = p.i))"""


ORACLE: dict[str, str] = {
    "op13_structure_repair": f"""
        with recursive drawn as (
            select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                   {_sql_crc32("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as x from conversations),
        damaged as (
            select conv_id, turn, case when x = 4 then 'user' else role end as role, case when x = 1 then '' when x = 2 then translate(text, '.!?', '') else text end as text
            from drawn, unnest(range(0, case x when 0 then 0 when 3 then 2 else 1 end))),
        placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body from damaged),
        judged as (
            select conv_id, i, turn, role, text, case when body = '' then 'B' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'D' when right(body, 1) not in ('.', '!', '?') then 'T' else ' ' end as fault,
                   lag(role[1:1]) over (partition by conv_id order by i) || role[1:1] as neighbours from placed),
        {_sql_repairs()},
        counts as (
            select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'B') as blank, count(*) filter (fault = 'D') as duplicate, count(*) filter (fault = 'T') as truncated,
                   count(*) filter (neighbours not in ('su', 'ua', 'au')) as illegal from judged group by 1),
        best as (select conv_id, nz, strpos(nz, chr(1)) as cut from repairs where i = 0)
        select conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cast(nz[1:6] as bigint), 0) as cost,
               coalesce(substr(nz, 7, cut - 7), '') as audit, sha256(case when length(nz) > cut then substr(nz, cut + 1, length(nz) - cut - 1) else '' end) as repaired_sha256
        from (select distinct conv_id from conversations) left join counts using (conv_id) left join best using (conv_id)
    """,
    "op11_prefix_trie": f"""
        with turns as (
            select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as x,
                   row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as n
            from conversations where conv_id is not null),
        heads as (select c, {_sql_crc32("cast(c as varchar)")} % 6 as h from (select distinct c from turns)),
        rebuilt as (
            select heads.c, n, r, x from heads join turns on turns.c = heads.c - heads.c % 100 and n <= h
            union all select c, n, r, x from heads join turns using (c) where n > h),
        numbered as (select c, row_number() over (partition by c order by n) as d, r, x from rebuilt),
        prefixes as (
            select c, d, length(x) as points,
                   string_agg(sha256(length(r) || ':' || r || x), '') over (partition by c order by d rows between unbounded preceding and current row) as k from numbered
            union all select c, 0, 0, '' from heads),
        lengths as (select c, max(d) as last from prefixes group by c),
        nodes as (
            select k, any_value(d) as d, min(c) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(points) as saved,
                   sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (d = last), '')) as ends_sha256
            from prefixes join lengths using (c) group by k),
        children as (select k[:64 * (d - 1)] as k, count(*) as n_children from nodes where d > 0 group by 1),
        counted as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join children using (k)),
        below as (
            select k[:64 * a] as k, cast(count(*) filter (n_children = 0) as bigint) as n_leaves, cast(sum(saved) as bigint) as saved_tokens
            from counted, unnest(range(0, d + 1)) as u(a) group by 1)
        select n.conv_id, n.d as depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
        from counted n join below using (k) left join counted p on n.d > 0 and p.k = n.k[:64 * (n.d - 1)]
    """,
    "op2_nearest_neighbours": """
        with usable as (
            select vec_id, min(embedding) as v from embeddings
            where vec_id is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
              and len(list_filter(embedding, lambda x: x <> 0)) > 0
            group by vec_id),
        pairs as (
            select q.vec_id as query_id, c.vec_id,
                   list_reduce(list_prepend(0::double, list_transform(list_zip(q.v, c.v), lambda p: p[1]::double * p[2]::double)), lambda a, b: a + b) as score
            from usable q join usable c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 20 = 0)
        select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
        from pairs qualify rank <= 20
    """,
    "op3_url_filters": """
        with parts as (
            select page_id,
                   translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                   regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') as path
            from pages),
        rules(rule_host, rule_path, verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
            ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        best as (
            select page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) as rule,
                   max_by(verdict, length(rule_host || rule_path)) as verdict
            from parts join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
            group by page_id)
        select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parts left join best using (page_id)
    """,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
