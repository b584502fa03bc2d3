"""Common tables of the SQL counterparts, for DuckDB."""

from __future__ import annotations

TOKENS = r"""
tok as (select doc_id, unnest(l) t0, generate_subscripts(l, 1) pos from (select doc_id, regexp_extract_all(lower(text), '([a-z0-9]+\.)*[a-z0-9]+') l from documents)),
tokens as (select doc_id, pos, case when regexp_full_match(t0, '([a-z]\.)+[a-z]') then t0 || '.' else t0 end term from tok)"""

INDEX = TOKENS + r""",
post as (select term, doc_id, count(*) tf from tokens group by all),
terms as (select term, count(*) df, sum(tf)::bigint ttf from post group by all),
docs as (select d.doc_id, coalesce(t.n, 0)::bigint dl from documents d left join (select doc_id, count(*) n from tokens group by all) t using (doc_id)),
stats as (select (select count(*) from docs) n_docs, (select sum(dl)::bigint from docs) total_len, (select avg(dl) from docs) avgdl, (select count(*) from terms) vocabulary)"""

_QUERY_TERMS = r"""
qraw as (select query_id, unnest(terms) x from topics where query_id is not null),
qtok as (select query_id, unnest(regexp_extract_all(lower(x), '([a-z0-9]+\.)*[a-z0-9]+')) t0 from qraw),
qall as (select query_id, case when regexp_full_match(t0, '([a-z]\.)+[a-z]') then t0 || '.' else t0 end term from qtok),
q as (select query_id, term, count(*) qtf from qall group by all)"""

SEARCH = INDEX + "," + _QUERY_TERMS + ",\nmet as (select * from q join terms using (term) join post using (term) join docs using (doc_id) cross join stats),\nqn as (select query_id, sum(qtf)::bigint q_len from q group by all)"

# The models' formulas, with the constants of `ranking.py`; the token pattern above is that of `analysis.py`.
OKAPI = "tf / (tf + 0.5 + 1.5 * dl / avgdl)"
BM25 = "2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) * ln((n_docs + 0.5) / (df + 0.5))"


def ranked(scores: str, depth: int = 1000, order: str = "doc_id") -> str:
    """A run of the query ``scores`` (query_id, doc_id, s)."""
    return f"select query_id, doc_id, rank, score from (select *, row_number() over (partition by query_id order by score desc, {order}) rank from (select query_id, doc_id, round(s, 6) score from ({scores}))) where rank <= {depth}"


# A run from the feature table (documents by BM25) and the grades, both by clean document id.
CLEAN = "nullif(upper(regexp_replace(doc_id, '\\s+', '', 'g')), '')"
RUN = f"""
clean_tf as (select query_id, {CLEAN} did, bm25 from training_features),
best as (select query_id, did doc_id, max(bm25) score from clean_tf where did is not null and query_id is not null and bm25 is not null and not isnan(bm25) and not isinf(bm25) group by query_id, did),
run as (select query_id, doc_id, rank, score from (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from best) where rank <= 1000)"""
GRADES = f"""
clean_q as (select query_id, {CLEAN} did, grade from qrels),
grades as (select query_id, did doc_id, sum(coalesce(grade, 0)) grade, did pos from clean_q where did is not null and query_id is not null group by query_id, did),
nrel as (select query_id, count(*) filter (grade >= 1) n_rel from grades group by all)"""
JUDGED = RUN + "," + GRADES + """,
j0 as (select run.*, n_rel, coalesce(grade, 0) grade, case when grade >= 1 then 1 else 0 end rel from run join nrel using (query_id) left join (select query_id, doc_id, grade from grades) g using (query_id, doc_id)),
j1 as (select *, sum(rel) over (partition by query_id order by rank rows unbounded preceding) num_rel from j0),
j as (select *, num_rel / rank as precision, num_rel / nullif(n_rel, 0) as recall from j1)"""

# Supplier to part: hubs and authorities; part to part of an order: cycles.
BIPARTITE = "edges as (select distinct 's' || l_suppkey src, 'p' || l_partkey dst from lineitem)"
SUCCESSOR = "edges as (select distinct a.l_partkey src, b.l_partkey dst from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1 where a.l_partkey <> b.l_partkey)"
DEGREES = "deg as (select id, sum(i)::bigint in_degree, sum(o)::bigint out_degree from (select src id, 0 i, 1 o from edges union all select dst, 1, 0 from edges) group by all)"


def pagerank(steps: int) -> str:
    ctes = ["v as (select id, out_degree from deg)", "p0 as (select id, out_degree, 1.0::double / (select count(*) from v) pr from v)"]
    for i in range(steps):
        ctes.append(f"p{i + 1} as (select v.id, v.out_degree, 0.15 / (select count(*) from v) + 0.85 * (select coalesce(sum(pr), 0) from p{i} where out_degree = 0) / (select count(*) from v) + 0.85 * coalesce(x.x, 0) pr from v left join (select dst id, sum(pr / out_degree) x from edges join p{i} on id = src group by dst) x using (id))")
    return ",\n".join(ctes)


def hits(steps: int) -> str:
    ctes = ["v as (select id from deg)", "h0 as (select id, 1.0::double auth, 1.0::double hub from v)"]
    for i in range(steps):
        ctes.append(f"x{i} as (select v.id, coalesce(a.a, 0) a, coalesce(h.h, 0) h from v left join (select dst id, sum(hub) a from edges join h{i} on id = src group by dst) a using (id) left join (select src id, sum(auth) h from edges join h{i} on id = dst group by src) h using (id))")
        ctes.append(f"h{i + 1} as (select id, a / (select sqrt(sum(a * a)) from x{i}) auth, h / (select sqrt(sum(h * h)) from x{i}) hub from x{i})")
    return ",\n".join(ctes)


# The page table as HTML, as a crawler would hold it.
HTML = """
html as (select distinct page_id, url, '<html><head><title>' || coalesce(title, '') || '</title><style>p { margin: 0 }</style></head><body><script>var a = "</p>";</script><h1>' || coalesce(title, '') || '</h1><p>' || replace(text, chr(10), '</p>' || chr(10) || '<p>') || '</p><a href="' || coalesce(url, '/') || '">here</a> &amp; <a class="x" href="/archive/">there</a></body></html>' html from page_text_table where page_id is not null)"""
