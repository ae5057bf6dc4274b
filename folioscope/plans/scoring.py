"""Registered queries of impact, quality and recommendation scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import rollups as R
from folioscope.operators import scoring as S
from folioscope.operators.graph import kept

from .fixtures import oracle, view

QUERIES: dict = {}
ORACLE: dict = {}

#: Categories of the fixtures' invented titles: few enough of them that scholars differ.
KEYWORDS = {"method": ["economy old ring", "small new gear"], "system": ["large hot bolt"], "data": ["promo red anvil", "medium cold rod"], "application": ["standard blue plate"]}


def rounded(df, *columns: str, digits: int = 6):
    return df.withColumns({c: F.round(F.round(c, 9), digits) for c in columns})


def _add(name: str, run, sql: str) -> None:
    QUERIES[name], ORACLE[name] = run, oracle(sql)


def _value_sets(works, authorships):
    """(categories, method tokens, problem tokens) of the corpus: from titles, and from venues."""
    w = works.select("work_id", F.lower("title").alias("title"), F.lower("venue").alias("venue"), "publication_year")
    own = authorships.select("scholar_id", "work_id").join(w, "work_id")
    kinds = F.array(*[F.when(F.exists(F.array(*map(F.lit, words)), lambda k: F.contains("title", k)), kind) for kind, words in KEYWORDS.items()])
    categories = own.select("scholar_id", F.explode(F.array_compact(kinds)).alias("value")).distinct()
    tokens = lambda c: own.filter("publication_year >= 1998").select("scholar_id", F.explode(F.regexp_extract_all(c, F.lit("[a-z0-9]{3,}"), 0)).alias("value")).distinct()
    return categories, tokens(F.col("title")), tokens(F.col("venue"))


def _scholars(spark, d):
    """The scholars and whether their graph is ready."""
    return view(spark, d, "scholars").withColumn("graph_ready", F.col("scholar_id") % 7 != 0)


def _corpus(spark, d):
    """What the features of pairs need of works, authorships and topics; each is read several times."""
    columns = {"works": ["work_id", "title", "venue", "publication_year"], "authorships": ["work_id", "scholar_id"], "work_topics": ["work_id", "topic"]}
    return [kept(view(spark, d, n).select(c)) for n, c in columns.items()]


def features(spark, d, *best, points=None):
    """The pairs that can be on one of the lists ``best``."""
    works, authorships, topics = _corpus(spark, d)
    return S.pair_features(works, authorships, topics, _scholars(spark, d), view(spark, d, "focus"), *_value_sets(works, authorships), best=best, points=points)


def all_features(spark, d):
    """Every pair that shares a topic, with the collaborations of all works."""
    works, authorships, topics = _corpus(spark, d)
    return S.pair_features(works, authorships, topics, _scholars(spark, d), view(spark, d, "focus"), *_value_sets(works, authorships), least_overlap=0.0, least_recent=0.0)


IMPACT = """imp as (select work_id, round(ln(1 + greatest(0, coalesce(cited_by_count, 0)))::double / sqrt(coalesce(greatest(1, (select max(publication_year) from {W}) - publication_year + 1), 3)::double), 12) as impact from {W}),
    pooled as (select t.topic, i.work_id, (rank() over (partition by topic order by impact) - 1 + 0.5 * count(*) over (partition by topic, impact)) / count(*) over (partition by topic) as p, count(*) over (partition by topic) as size
               from (select distinct work_id, topic from {T}) t join imp i using (work_id)),
    overall as (select work_id, (rank() over (order by impact) - 1 + 0.5 * count(*) over (partition by impact)) / count(*) over () as p from imp),
    pct as (select o.work_id, coalesce(t.p, o.p) as percentile from overall o left join (select work_id, avg(p) as p from pooled where size >= 3 group by 1) t using (work_id)),
    inc as (select cited_work_id as work_id, count(*) as incoming from work_citations where cited_work_id in (select work_id from {W}) and citing_work_id in (select work_id from {W}) group by 1)"""
OWN = """own as (select distinct a.scholar_id, a.work_id, w.publication_year as year from {A} a join {W} w using (work_id)),
    ot as (select o.scholar_id, o.work_id, o.year, t.topic from own o join (select distinct work_id, topic from {T}) t using (work_id))"""
FIELD = """tt as (select scholar_id, topic, count(distinct work_id) as n, count(distinct year) as y from ot group by 1, 2),
    ts as (select *, n >= 2 or y >= 2 as sus, bool_or(n >= 2 or y >= 2) over (partition by scholar_id) as any_sus from tt),
    field as (select scholar_id, topic from ts where sus or not any_sus qualify row_number() over (partition by scholar_id order by (y >= 2)::int desc, n desc, topic) <= 8)"""
LATER = """seq as (select scholar_id, work_id, row_number() over (partition by scholar_id order by coalesce(year, 0), work_id) as ord from own),
    later as (select x.scholar_id, x.work_id, count(distinct t2.work_id) as n from seq x join ot t1 on t1.scholar_id = x.scholar_id and t1.work_id = x.work_id
              join ot t2 on t2.scholar_id = t1.scholar_id and t2.topic = t1.topic join seq z on z.scholar_id = t2.scholar_id and z.work_id = t2.work_id and z.ord > x.ord group by 1, 2)"""
REP = """nts as (select scholar_id, work_id, count(*) as nt from ot group by 1, 2), nfs as (select scholar_id, count(*) as nf from field group by 1),
    shs as (select scholar_id, work_id, count(*) as sh from ot join field using (scholar_id, topic) group by 1, 2),
    rep0 as (select a.scholar_id, a.work_id, w.publication_year as year, coalesce(i.incoming, 0) as incoming, p.percentile,
        case when author_count <= 1 then 1.0 when is_corresponding then 1.0 when author_position = 'first' or position_index = 0 then 0.95 when author_position = 'last' or position_index = author_count - 1 then 0.9 else 0.45 end::double as contribution,
        coalesce(nts.nt, 0) as nt, coalesce(nfs.nf, 0) as nf, coalesce(shs.sh, 0) as sh,
        least(1.0, coalesce(i.incoming, 0) / 3.0)::double as downstream, least(1.0, coalesce(l.n, 0) / 3.0)::double as continuation
      from {A} a join {W} w using (work_id) join pct p using (work_id) left join inc i using (work_id) left join later l on l.scholar_id = a.scholar_id and l.work_id = a.work_id
        left join nts on nts.scholar_id = a.scholar_id and nts.work_id = a.work_id left join nfs on nfs.scholar_id = a.scholar_id left join shs on shs.scholar_id = a.scholar_id and shs.work_id = a.work_id),
    rep as (select *, round(round(greatest(0, least(100, 100 * (case when nt + nf - sh > 0 then sh / (nt + nf - sh)::double else 0 end * 0.28::double + percentile * 0.30::double + contribution * 0.18::double + downstream * 0.14::double + continuation * 0.10::double))), 9), 1) as index from rep0)"""


def sql(text: str, works="works", authorships="authorships", topics="work_topics") -> str:
    return text.replace("{W}", works).replace("{A}", authorships).replace("{T}", topics)


#: Millionths are cut at no fraction that a percentile (a mean of few small fractions) can have, so that no engine's last bit decides.
OFF_MIDPOINTS = 0.3819660112

CORPUS = ("works", "authorships", "work_topics")


def _v(*names):
    return lambda spark, d: [view(spark, d, n) for n in names]


_add("G1_raw_impact", lambda s, d: rounded(S.raw_impact(view(s, d, "works")), "impact"), sql(f"with {IMPACT} select work_id, round(impact, 6) as impact from imp"))
_add("G2_topic_percentile", lambda s, d: S.impact_percentile(*_v("works", "work_topics")(s, d)).select("work_id", F.floor(F.col("percentile") * 1e6 + OFF_MIDPOINTS).cast("long").alias("percentile_ppm")), sql(f"with {IMPACT} select work_id, cast(floor(percentile * 1e6 + {OFF_MIDPOINTS}) as bigint) as percentile_ppm from pct"))
_add("G3_incoming_internal", lambda s, d: S.incoming_internal(*_v("work_citations", "works")(s, d)), sql(f"with {IMPACT} select * from inc"))
_add(
    "G4_later_same_topic",
    lambda s, d: S.later_same_topic(*_v(*CORPUS)(s, d)),
    sql(f"with {OWN}, {LATER} select scholar_id, work_id, coalesce(n, 0) as later from own left join later using (scholar_id, work_id)", *CORPUS),
)
_add(
    "G5_representative_works",
    lambda s, d: S.representative_works(*_v(*CORPUS, "work_citations")(s, d)).select("scholar_id", "rank", "work_id", "index", *[F.round(c, 6).alias(c) for c in ("relevance", "percentile", "contribution", "downstream", "continuation")]),
    sql(
        f"""with {IMPACT}, {OWN}, {FIELD}, {LATER}, {REP}
        select scholar_id, cast(row_number() over (partition by scholar_id order by index desc, coalesce(year, 0) desc, work_id) as int) as rank, work_id, index,
            round(case when nt + nf - sh > 0 then sh / (nt + nf - sh)::double else 0 end, 6) as relevance, round(percentile, 6) as percentile, contribution, round(downstream, 6) as downstream, round(continuation, 6) as continuation
        from rep qualify rank <= 5""",
        *CORPUS,
    ),
)
_add(
    "G7_topic_profiles",
    lambda s, d: S.topic_profiles(*_v("works", "authorships", "work_topics")(s, d)),
    sql(f"with {OWN} select scholar_id, topic, count(*) as n, count(*) filter (year >= (select max(publication_year) from works) - 3) as n_recent from ot group by 1, 2"),
)
CONF = """cown as (select distinct scholar_id, work_id, publication_year as year from {A} join {W} using (work_id)),
    cn as (select s.scholar_id, s.scholar_id % 7 <> 0 as ready, count(work_id) as works, coalesce(max(year) - min(year) + 1, 0) as year_span,
                 count(work_id) filter (work_id in (select work_id from {T})) as tc, count(work_id) filter (work_id in (select work_id from abstracts where abstract <> '')) as ac
          from scholars s left join cown o on o.scholar_id = s.scholar_id group by 1, 2),
    cx as (select *, case when works > 0 then tc / works::double else 0 end as tr, case when works > 0 then ac / works::double else 0 end as ar from cn),
    cy as (select *, least(1.0, works / 12.0)::double * 0.35::double + least(1.0, year_span / 6.0)::double * 0.2::double + tr * 0.25::double + ar * 0.15::double + case when ready then 0.05 else 0 end::double as sc from cx),
    conf as (select scholar_id, works, year_span, round(tr, 3) as topic_coverage, round(ar, 3) as abstract_coverage, round(sc, 3) as score,
           case when not ready or works < 3 or tc < 2 then 'insufficient' when sc >= 0.8 then 'high' when sc >= 0.58 then 'medium' else 'low' end as level from cy)"""
_add("H1_data_confidence", lambda s, d: S.data_confidence(*_v(*CORPUS, "abstracts")(s, d), _scholars(s, d)), sql(f"with {CONF} select * from conf", *CORPUS))
CONT = """tc as (select scholar_id, topic, count(distinct work_id) as n, count(distinct year) as y, min(year) as lo, max(year) as hi from ot group by 1, 2),
    sus as (select * from tc where n >= 3 and y >= 3),
    prof as (select scholar_id, topic, count(*) as n, count(*) filter (coalesce(year, 0) >= (select max(publication_year) from {W}) - 3) as r from ot group by 1, 2),
    cparts as (select o.scholar_id, count(distinct o.work_id) as works,
        (select count(distinct ot.work_id) from ot join sus using (scholar_id, topic) where ot.scholar_id = o.scholar_id) as lasting,
        coalesce((select max(hi - lo + 1) from sus where sus.scholar_id = o.scholar_id), 0) as longest,
        coalesce((select sum(case when n >= 2 then n else 0 end) / sum(n)::double from tc where tc.scholar_id = o.scholar_id), 0) as repeat_,
        coalesce((select sum(least(n - r, r)) / sum(greatest(n - r, r))::double from prof where prof.scholar_id = o.scholar_id), 0) as stab from own o group by o.scholar_id),
    cont as (select scholar_id, round(round(100 * (lasting / works::double * 0.45::double + least(1.0, longest / 8.0)::double * 0.25::double + repeat_ * 0.20::double + stab * 0.10::double), 9), 1) as continuity, longest, repeat_, stab from cparts)"""
_add(
    "H2_continuity_index",
    lambda s, d: S.continuity_index(*_v("works", "authorships", "work_topics")(s, d)).drop("sustained_topics", "sustained_share"),
    sql(f"with {OWN}, {CONT} select scholar_id, continuity, cast(longest as int) as longest_span, round(repeat_, 6) as topic_repeat, round(stab, 6) as stability from cont"),
)
IMPIDX = """iw as (select o.scholar_id, o.work_id, w.cited_by_count as c, p.percentile, coalesce(i.incoming, 0) as incoming from own o join {W} w using (work_id) join pct p using (work_id) left join inc i using (work_id)),
    up as (select scholar_id, avg(percentile) as u from (select * from iw qualify row_number() over (partition by scholar_id order by percentile desc, work_id) <= 5) group by 1),
    ix as (select scholar_id, u, count(*) filter (incoming > 0) / count(*)::double as spread, count(*) filter (c > 0) / count(*)::double as cs, max(c) / greatest(1, sum(c))::double as conc from iw join up using (scholar_id) group by 1, 2),
    impi as (select *, round(round(100 * (u * 0.5::double + spread * 0.3::double + cs * 0.2::double), 9), 1) as impact from ix)"""
_add(
    "H3_impact_index",
    lambda s, d: S.impact_index(*_v("works", "authorships", "work_topics", "work_citations")(s, d)),
    sql(f"with {IMPACT}, {OWN}, {IMPIDX} select scholar_id, impact, round(u, 6) as upper_impact, round(spread, 6) as spread, round(cs, 6) as cited_share, case when impact >= 70 and conc < 0.65 then 'distributed' when conc >= 0.65 then 'concentrated' else 'moderate' end as note from impi"),
)
QUAL = """sig as (select scholar_id, avg(index) / 100 as s from (select * from rep qualify row_number() over (partition by scholar_id order by index desc, coalesce(year, 0) desc, work_id) <= 3) group by 1),
    upr as (select scholar_id, avg(percentile) as u from (select * from rep qualify row_number() over (partition by scholar_id order by percentile desc, work_id) <= 5) group by 1),
    qx as (select scholar_id, s, u, count(*) filter (contribution >= 0.9) / count(*)::double as strong, count(*) filter (incoming > 0) / count(*)::double as spread from rep join sig using (scholar_id) join upr using (scholar_id) group by 1, 2, 3),
    qual as (select *, round(round(100 * (s * 0.4::double + strong * 0.25::double + u * 0.2::double + spread * 0.15::double), 9), 1) as quality from qx)"""
_add(
    "H4_quality_index",
    lambda s, d: S.quality_index(*_v(*CORPUS, "work_citations")(s, d)).drop("upper_impact", "spread"),
    sql(f"with {IMPACT}, {OWN}, {FIELD}, {LATER}, {REP}, {QUAL} select scholar_id, quality, case when quality >= 70 then 'strong' when quality >= 48 then 'moderate' else 'limited' end as band, round(s, 6) as signal, round(strong, 6) as strong_role_share from qual", *CORPUS),
)
COLLAB = """pairs as (select x.scholar_id as a, y.scholar_id as b, x.work_id from authorships x join authorships y on x.work_id = y.work_id and x.scholar_id <> y.scholar_id),
    edges as (select distinct a, b from pairs), two as (select f.a as focus_id, g.b as candidate_id, count(*) as shared from edges f join edges g on f.b = g.a and f.a <> g.b where f.a in (select scholar_id from focus) group by 1, 2),
    direct as (select a as focus_id, b as candidate_id, count(*) as direct_count from pairs group by 1, 2)"""
_cats = " union all ".join(f"select '{kind}' as kind, '{word}' as word" for kind, words in KEYWORDS.items() for word in words)
FEATURES = f"""pairs as (select x.scholar_id as a, y.scholar_id as b, x.work_id from authorships x join authorships y on x.work_id = y.work_id and x.scholar_id <> y.scholar_id where x.author_count = 2),
    edges as (select distinct a, b from pairs), two as (select f.a as focus_id, g.b as candidate_id, count(*) as shared from edges f join edges g on f.b = g.a and f.a <> g.b where f.a in (select scholar_id from focus) group by 1, 2),
    direct as (select a as focus_id, b as candidate_id, count(*) as direct_count from pairs group by 1, 2), prof as (select scholar_id, topic, count(*) as n, count(*) filter (coalesce(year, 0) >= (select max(publication_year) from {{W}}) - 3) as r from ot group by 1, 2),
    tot as (select scholar_id, sum(n) as n, sum(r) as r from prof group by 1),
    met as (select f.scholar_id as focus_id, c.scholar_id as candidate_id, sum(least(f.n, c.n)) as l, sum(least(f.r, c.r)) as lr from prof f join prof c on f.topic = c.topic and f.scholar_id <> c.scholar_id
            where f.scholar_id in (select scholar_id from focus) group by 1, 2),
    kinds as ({_cats}),
    text as (select distinct a.scholar_id, lower(title) as title, lower(venue) as venue, publication_year as year from authorships a join works using (work_id)),
    vals as (select distinct scholar_id, 'y' as k, cast(year as varchar) as v from text where year is not null
        union all select distinct scholar_id, 'c', kind from text join kinds on contains(title, word)
        union all select distinct scholar_id, 'm', v from (select scholar_id, unnest(regexp_extract_all(title, '[a-z0-9]{{3,}}')) as v from text where year >= 1998)
        union all select distinct scholar_id, 'p', v from (select scholar_id, unnest(regexp_extract_all(venue, '[a-z0-9]{{3,}}')) as v from text where year >= 1998)),
    tops as (select focus_id, candidate_id, string_agg(topic, '|' order by r) as shared_topics from (
        select f.scholar_id as focus_id, c.scholar_id as candidate_id, f.topic, row_number() over (partition by f.scholar_id, c.scholar_id order by least(f.n, c.n) desc, f.topic) as r
        from prof f join prof c on f.topic = c.topic and f.scholar_id <> c.scholar_id where f.scholar_id in (select scholar_id from focus)) where r <= 2 group by 1, 2),
    vn as (select scholar_id, k, count(*) as n from vals group by 1, 2),
    vs as (select m.focus_id, m.candidate_id, x.k, count(*) as s from met m join vals x on x.scholar_id = m.focus_id join vals y on y.scholar_id = m.candidate_id and y.k = x.k and y.v = x.v group by 1, 2, 3),
    jac as (select m.focus_id, m.candidate_id, kk.k, coalesce(coalesce(s, 0) / nullif(coalesce(a.n, 0) + coalesce(b.n, 0) - coalesce(s, 0), 0)::double, 0) as j, coalesce(a.n, 0) > 0 and coalesce(b.n, 0) > 0 as known
        from met m cross join (values ('y'), ('c'), ('m'), ('p')) kk(k) left join vs on vs.focus_id = m.focus_id and vs.candidate_id = m.candidate_id and vs.k = kk.k
        left join vn a on a.scholar_id = m.focus_id and a.k = kk.k left join vn b on b.scholar_id = m.candidate_id and b.k = kk.k),
    feat0 as (select m.focus_id, m.candidate_id, coalesce(l / nullif(f.n + c.n - l, 0)::double, 0) as topic_overlap, coalesce(lr / nullif(f.r + c.r - lr, 0)::double, 0) as recent_overlap,
        jy.j as temporal, coalesce(direct_count, 0) as direct_count, coalesce(shared, 0) as shared_collaborators, jm.j as method_similarity, jp.j as problem_similarity,
        case when jc.known then 1 - jc.j else 0 end as complementarity, coalesce(sf.institution_id = sc.institution_id, false) as same_institution, sc.institution_id is not null as has_institution,
        coalesce(sc.scholar_id % 7 <> 0, false) as graph_ready, shared_topics
      from met m join tot f on f.scholar_id = m.focus_id join tot c on c.scholar_id = m.candidate_id
      join jac jy on jy.k = 'y' and jy.focus_id = m.focus_id and jy.candidate_id = m.candidate_id join jac jm on jm.k = 'm' and jm.focus_id = m.focus_id and jm.candidate_id = m.candidate_id
      join jac jp on jp.k = 'p' and jp.focus_id = m.focus_id and jp.candidate_id = m.candidate_id join jac jc on jc.k = 'c' and jc.focus_id = m.focus_id and jc.candidate_id = m.candidate_id
      left join direct d on d.focus_id = m.focus_id and d.candidate_id = m.candidate_id left join two on two.focus_id = m.focus_id and two.candidate_id = m.candidate_id
      left join tops on tops.focus_id = m.focus_id and tops.candidate_id = m.candidate_id left join scholars sf on sf.scholar_id = m.focus_id left join scholars sc on sc.scholar_id = m.candidate_id),
    feat as (select * from feat0 where topic_overlap >= 0.15 or recent_overlap >= 0.25)"""
#: All pairs that share a topic, and the collaborations of all works.
FEATURES_WHOLE = FEATURES.replace(" where x.author_count = 2", "").replace(" where topic_overlap >= 0.15 or recent_overlap >= 0.25", "")
_ratios = ("topic_overlap", "recent_overlap", "temporal", "method_similarity", "problem_similarity", "complementarity")
_add(
    "H7_pair_features",
    lambda s, d: (lambda f: f.withColumns({c: F.round(c, 6) for c in _ratios} | {"shared_topics": F.array_join("shared_topics", "|")}))(all_features(s, d)),
    sql(f"with {OWN}, {FEATURES_WHOLE} select focus_id, candidate_id, direct_count, shared_collaborators, same_institution, has_institution, graph_ready, shared_topics, {', '.join(f'round({c}, 6) as {c}' for c in _ratios)} from feat", *CORPUS),
)
PEERS = "select focus_id, candidate_id, round(round(100 * (topic_overlap * 0.45::double + temporal * 0.20::double + recent_overlap * 0.25::double + case when has_institution then 0.1 else 0 end::double), 9), 1) as index from feat where graph_ready and topic_overlap >= 0.18 and temporal >= 0.15"
LEADS = "select focus_id, candidate_id, round(round(100 * (topic_overlap * 0.25::double + complementarity * 0.25::double + least(1.0, shared_collaborators / 3.0)::double * 0.20::double + least(1.0, direct_count / 4.0)::double * 0.20::double + temporal * 0.10::double), 9), 1) as index from feat where graph_ready and direct_count <= 1 and shared_collaborators >= 1 and topic_overlap >= 0.15 and complementarity >= 0.15"
RIVALS = f"select focus_id, candidate_id, round(round(100 * (recent_overlap * 0.35::double + problem_similarity * 0.25::double + method_similarity * 0.20::double + temporal * 0.15::double + case when direct_count = 0 then 0.05 else 0 end::double), 9), 1) as index from feat where graph_ready and direct_count < 2 and recent_overlap >= 0.25 and problem_similarity >= 0.08 and method_similarity >= 0.08 and temporal >= 0.15 and (focus_id, candidate_id) not in (select (focus_id, candidate_id) from ({LEADS}))"
RANK = "select focus_id, candidate_id, index, cast(row_number() over (partition by focus_id order by index desc, candidate_id) as int) as rank from ({}) qualify rank <= 20"
_add("H9_recommend_peers", lambda s, d: S.recommend_peers(features(s, d, "peer")), sql(f"with {OWN}, {FEATURES_WHOLE} {RANK.format(PEERS)}", *CORPUS))
_add("H10_recommend_collaborators", lambda s, d: S.recommend_collaborators(features(s, d, "potential_collaborator")), sql(f"with {OWN}, {FEATURES_WHOLE} {RANK.format(LEADS)}", *CORPUS))
_add("H11_recommend_competitors", lambda s, d: S.recommend_competitors(features(s, d, "potential_competitor")), sql(f"with {OWN}, {FEATURES_WHOLE} {RANK.format(RIVALS)}", *CORPUS))


def index_tables(s, d):
    """(confidence, quality, continuity, impact) of every scholar."""
    w, a, t, c = (kept(view(s, d, n)) for n in (*CORPUS, "work_citations"))
    # one row a scholar each, written, so that no table's shuffle files stay while the next one is made
    return tuple(kept(x) for x in (S.data_confidence(w, a, t, view(s, d, "abstracts"), _scholars(s, d)), S.quality_index(w, a, t, c), S.continuity_index(w, a, t), S.impact_index(w, a, t, c)))


def _dimensions(s, d):
    return S.scholar_dimensions(*index_tables(s, d)).select("scholar_id", "quality", "continuity", "impact")


DIMS = f"""{IMPACT}, {OWN}, {FIELD}, {LATER}, {REP}, {QUAL}, {CONT}, {IMPIDX}, {CONF},
    dims as materialized (select scholar_id, level, case when level <> 'insufficient' then quality end as quality, case when level <> 'insufficient' then continuity end as continuity, case when level <> 'insufficient' then impact end as impact
        from conf left join qual using (scholar_id) left join cont using (scholar_id) left join impi using (scholar_id))"""
FEATURES_ONLY = FEATURES.replace("prof as (select scholar_id, topic, count(*) as n, count(*) filter (coalesce(year, 0) >= (select max(publication_year) from {W}) - 3) as r from ot group by 1, 2),", "")
REFS = """select focus_id, candidate_id, round(round(100 * (topic_overlap * 0.30::double + quality / 100 * 0.20::double + coalesce(continuity, 0) / 100 * 0.15::double + coalesce(impact, 0) / 100 * 0.15::double
        + least(1.0, recent / 4.0)::double * 0.10::double + down * 0.10::double), 9), 1) as index
    from feat join dims on dims.scholar_id = candidate_id
    join (select scholar_id, count(*) as works, count(*) filter (coalesce(year, 0) >= (select max(publication_year) from {W}) - 3) as recent, count(*) filter (work_id in (select work_id from inc)) / count(*)::double as down from own group by 1) n
      on n.scholar_id = candidate_id where graph_ready and quality is not null and topic_overlap >= 0.15 and works >= 4"""
def _references(s, d):
    w, a, _, c = _v(*CORPUS, "work_citations")(s, d)
    dimensions = kept(_dimensions(s, d))
    return S.recommend_references(reference_features(s, d, dimensions), w, a, dimensions, c)


def reference_features(s, d, dimensions):
    w, a, _, c = _v(*CORPUS, "work_citations")(s, d)
    return features(s, d, "reference", points=S.reference_points(w, a, dimensions, c))


_add("H8_recommend_references", _references, sql(f"with {DIMS}, {FEATURES_ONLY} {RANK.format(REFS)}", *CORPUS))


def _merged(s, d):
    f = kept(features(s, d, "peer", "potential_collaborator", "potential_competitor"))
    found = S.merge_recommendations({"peer": S.recommend_peers(f), "potential_collaborator": S.recommend_collaborators(f), "potential_competitor": S.recommend_competitors(f)})
    return found.withColumn("categories", F.array_join("categories", "|"))


_add(
    "H13_merge_recommendations",
    _merged,
    sql(
        f"""with {OWN}, {FEATURES_WHOLE}, every as (select *, 'peer' as category from ({RANK.format(PEERS)}) union all select *, 'potential_collaborator' from ({RANK.format(LEADS)}) union all select *, 'potential_competitor' from ({RANK.format(RIVALS)}))
        select focus_id, candidate_id, string_agg(category, '|' order by category) as categories, first(category order by index desc, category) as best_category, max(index) as index from every group by 1, 2""",
        *CORPUS,
    ),
)
_add(
    "D10_shared_collaborators",
    lambda s, d: S.shared_collaborators(R.dealt_coauthors(view(s, d, "authorships")), view(s, d, "focus")).withColumnRenamed("other_id", "candidate_id"),
    f"with {COLLAB} select * from two",
)
