"""Registered queries of the library's own operators over the shared test tables, with DuckDB SQL where SQL can say them.

The tables hold no Markdown, so structural queries make texts from columns by the same rule in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import mentions as M
from ..functions import text as T
from ..operators import chunk, clean, graph, parse, retrieve, validate
from ..sources.shared import new_folder
from . import pipeline

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _joined(x: Column) -> Column:
    return F.array_join(x, ",")


# ---- retrieval over vectors


def _nearest(spark: SparkSession, d: str, by_label: bool) -> DataFrame:
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"), (F.col("label") if by_label else F.lit(0)).alias("bucket"))
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "bucket")
    found = retrieve.nearest(asked, e, retrieve.TOP_K, key="vec_id")
    return found.select("query_id", "vec_id", "rank", F.round("distance", 4).alias("distance"))


_NEAREST = """
with q as (select vec_id as query_id, embedding::double[] as q, label from embeddings where vec_id % 20 = 0),
d as (select query_id, e.vec_id, list_distance(q, embedding::double[]) ** 2 as distance from q join embeddings e on {on}),
r as (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from d)
select query_id, vec_id, rank::int as rank, round(distance, 4) as distance from r where rank <= 20"""


@query(_NEAREST.format(on="e.label = q.label"))
def topk_bucket_routed(spark, d):
    return _nearest(spark, d, True)


@query(_NEAREST.format(on="true"))
def topk_no_structure(spark, d):
    return _nearest(spark, d, False)


@query("""
with q as (select vec_id as query_id, embedding::double[] as q, label from embeddings where vec_id % 20 = 0),
s as (select query_id, e.vec_id, round(list_cosine_similarity(q, embedding::double[]), 6) as score from q join embeddings e on e.label = q.label),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, vec_id, rank::int as rank, score from r where rank <= 5""")
def caption_cosine_topk(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", retrieve.unit(F.col("embedding")).alias("v"), "label")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "label")
    return retrieve.captions(asked, e, 5, "label", "vec_id").select("query_id", "vec_id", "rank", "score")


# ---- lexical retrieval and query understanding


@query("""
with t as (select item_id as query_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9一-鿿+-]+', ' ', 'g'), ' '), lambda x: length(x) >= 2) as terms from benchmark),
s as (select query_id, doc_id, list_sum(list_transform(terms, lambda w: case when contains(lower(text), w) then 1 else 0 end))::int as score from t, documents),
r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s where score > 0)
select query_id, doc_id, score, rank::int as rank from r where rank <= 20""")
def lexical_retrieve(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "text", F.lit("all").alias("bucket"), F.lit(1).alias("global_order"))
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("normalized_query"), F.array(F.lit("all")).alias("retrieval_buckets"))
    return retrieve.lexical(asked, rows).select("query_id", "doc_id", "score", "rank")


def _words(words) -> str:
    return "(" + " or ".join(f"contains(low, '{w}')" for w in words) + ")"


_KIND = "case " + " ".join(f"when {_words(w)} then '{k}'" for k, w in retrieve.QUERY_TYPES) + " else 'fact' end"
_ROUTE = "case " + " ".join(f"when kind = '{k}' then '{','.join(b)}'" for k, b in retrieve.ROUTES.items()) + f" when {_words(retrieve.METHOD_HINTS)} then 'method,results' else 'results,discussion' end"


@query(f"""
with a as (select conv_id, turn, lower(text) as low, text from conversations where role = 'user'), b as (select *, {_KIND} as kind from a)
select conv_id, turn, kind as query_type, {_ROUTE} as buckets, {", ".join(f"{_words(w)} as {n}" for n, w in retrieve.NEEDS.items())} from b""")
def query_analyze(spark, d):
    rows = read(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    return retrieve.analyze(rows).select("conv_id", "turn", "query_type", _joined(F.col("retrieval_buckets")).alias("buckets"), *retrieve.NEEDS)


@query("""
with s as (select p_partkey, case p_partkey % 9 when 0 then 'Introduction' when 1 then 'Materials and Methods' when 2 then 'Results' when 3 then 'Discussion' when 4 then 'Results & Discussion'
 when 5 then 'Concluding remarks' when 6 then 'Background' when 7 then 'Experimental details' else p_name end as title from part),
b as (select p_partkey, title, lower('3 ' || title || ' ' || title) as f from s)
select p_partkey, title, case when contains(f, 'results & discussion') or contains(f, 'results and discussion') then 'results_discussion' when contains(f, 'introduction') or contains(f, 'background') then 'intro'
 when contains(f, 'method') or contains(f, 'experimental') or contains(f, 'materials') then 'method' when contains(f, 'results') then 'results' when contains(f, 'discussion') then 'discussion'
 when contains(f, 'concluding remarks') then 'conclusion' else 'other' end as bucket from b""")
def bucket_classify(spark, d):
    names = ("Introduction", "Materials and Methods", "Results", "Discussion", "Results & Discussion", "Concluding remarks", "Background", "Experimental details")
    title = F.coalesce(F.get(F.array(*map(F.lit, names)), (F.col("p_partkey") % 9).cast("int")), F.col("p_name"))
    rows = read(spark, d, "part").select("p_partkey", title.alias("title"))
    return rows.withColumn("bucket", retrieve.bucket(F.col("title"), F.concat(F.lit("3 "), "title")))


# ---- mentions, over prose made of orders


def _prose(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    n = lambda m: (k % m + 1).cast("string")
    text = F.concat(
        F.lit("See Figs. "), n(7), F.lit(", S"), n(5), F.lit(" and "), n(12), F.lit("a, Table "), F.get(F.array(*map(F.lit, ("I", "IV", "X"))), (k % 3).cast("int")), F.lit(". By Eq. ("), n(4), F.lit("."), n(3),
        F.lit(") and [EQUATION:eq_"), n(6), F.lit("], as in ["), n(5), F.lit("-"), n(9), F.lit(", "), n(20), F.lit("]."),
    )
    return read(spark, d, "orders").select("o_orderkey", text.alias("text"))


_N = "(o_orderkey % {} + 1)"


def _n(m: int) -> str:
    return f"(o_orderkey % {m} + 1)::varchar"


def _sorted_sql(items: list[str]) -> str:
    return f"array_to_string(list_sort(list_distinct([{', '.join(items)}])), ',')"


@query(f"select o_orderkey, {_sorted_sql([f"'Fig. ' || {_n(7)}", f"'Fig. S' || {_n(5)}", f"'Fig. ' || {_n(12)} || 'a'"])} as found from orders")
def mention_figures(spark, d):
    return _prose(spark, d).select("o_orderkey", _joined(M.figures(F.col("text"))).alias("found"))


@query("select o_orderkey, 'Table ' || case o_orderkey % 3 when 0 then 'I' when 1 then 'IV' else 'X' end as found from orders")
def mention_tables(spark, d):
    return _prose(spark, d).select("o_orderkey", _joined(M.tables(F.col("text"))).alias("found"))


@query(f"select o_orderkey, {_sorted_sql([f"'eq_' || {_n(6)}", f"'eqnum::' || {_n(4)} || '.' || {_n(3)}"])} as found from orders")
def mention_equations(spark, d):
    return _prose(spark, d).select("o_orderkey", _joined(M.equations(F.col("text"))).alias("found"))


@query("""
select o_orderkey, array_to_string(list_sort(list_distinct(list_transform(list_concat(case when o_orderkey % 9 >= o_orderkey % 5 then range(o_orderkey % 5 + 1, o_orderkey % 9 + 2) else [] end,
 [o_orderkey % 20 + 1]), lambda x: 'ref_' || x))), ',') as found from orders""")
def citation_ranges(spark, d):
    return _prose(spark, d).select("o_orderkey", _joined(M.citations(F.col("text"))).alias("found"))


# ---- text functions


@query(r"""
select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')) as digest
from documents""")
def normalized_texts(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("digest"))


@query("""
select p_partkey, '## ' || p_brand as heading, p_size || ' μm at ' || p_size || ' °C of Cr' as measures, '[' || p_size || ',' || (p_size + 1) || '-' || (p_size + 3) || ']' as cited, 'a (b), ' || p_name || '.' as spaced from part""")
def cleaned_fragments(spark, d):
    s = F.col("p_size").cast("string")
    more = lambda k: (F.col("p_size") + k).cast("string")
    measures = F.concat(F.lit("${"), s, F.lit(r"\mu }\mathrm{m}$ at ${"), s, F.lit(r"}^{ \circ  }\mathrm{C}$ of $\mathrm{{Cr}}$"))
    cited = F.concat(F.lit(r"\left\lbrack {{"), s, F.lit("},{"), more(1), F.lit("} - {"), more(3), F.lit(r"}}\right\rbrack"))
    spaced = F.concat(F.lit("a  ( b ) , "), "p_name", F.lit(" ."))
    return read(spark, d, "part").select(
        "p_partkey", T.clean_headings(F.concat(F.lit("## "), s, F.lit(".1. "), "p_brand")).alias("heading"), T.normalize_elements(T.normalize_temperatures(T.normalize_units(measures))).alias("measures"),
        T.normalize_citations(cited).alias("cited"), T.normalize_spacing(spaced).alias("spaced"),
    )


@query("""
select c_custkey, 'd' || c_custkey || '::' || c_name as uid, 'f' || c_custkey || '.md' as label, regexp_replace(regexp_replace(lower(c_name || ' / ' || c_mktsegment), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as slug,
 'paper' || c_custkey as stem, '1 Introduction > 1.' || c_custkey || ' ' || c_name as path from customer""")
def identifiers(spark, d):
    k = F.col("c_custkey").cast("string")
    part = lambda n, t: F.struct(n.alias("section_number"), t.alias("section_title"))
    return read(spark, d, "customer").select(
        "c_custkey", T.evidence_uid(F.concat(F.lit("d"), k), F.col("c_name")).alias("uid"), T.source_label(F.concat(F.lit("a\\b/f"), k, F.lit(".md/"))).alias("label"), T.slug(F.concat("c_name", F.lit(" / "), "c_mktsegment")).alias("slug"),
        T.document_id(F.concat(F.lit("paper"), k, F.lit("_cleaned"))).alias("stem"), T.section_path(F.array(part(F.lit("1"), F.lit("Introduction")), part(F.concat(F.lit("1."), k), F.col("c_name")))).alias("path"),
    )


@query(r"""
with m as (select doc_id, regexp_extract_all(text, '(?s)\$\$(.*?)\$\$', 1) as b from documents)
select doc_id, i::int as ord, 'eq_' || i as equation_id, md5(regexp_replace(b[i], '^[ \n\t\r\f\v]+|[ \n\t\r\f\v]+$', '', 'g')) as latex from m, unnest(range(1, len(b) + 1)) as u(i)""")
def equation_extract(spark, d):
    found = parse.equations(read(spark, d, "documents").select("doc_id", "text"))
    return found.select("doc_id", "ord", "equation_id", F.md5("latex").alias("latex"))


# ---- chunks, graphs and budgets


@query("""
with s as (select l_orderkey::varchar as doc_id, l_suppkey as section, row_number() over (partition by l_orderkey, l_suppkey order by l_linenumber, l_partkey) as n, l_linenumber, l_partkey from lineitem)
select doc_id, 's' || section || '__chunk_' || n as id, case when n > 1 then 's' || section || '__chunk_' || (n - 1) end as prev_chunk_id, lead('s' || section || '__chunk_' || n) over (partition by doc_id, section order by n) as next_chunk_id,
 (row_number() over (partition by doc_id order by section, n))::int as global_order, 'Line ' || l_linenumber || ' of ' || l_partkey || '.' as text from s""")
def chunk_links(spark, d):
    line = F.concat(F.lit("Line "), "l_linenumber", F.lit(" of "), "l_partkey", F.lit("."))
    rows = read(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("x")))), lambda r: r["x"]), "\n\n").alias("content"))
    none = F.lit(None).cast("string")
    sections = rows.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.lit("f").alias("source_file"), F.col("l_suppkey").cast("int").alias("ord"), F.concat(F.lit("s"), "l_suppkey").alias("section_id"), none.alias("section_number"), none.alias("section_title"), none.alias("section_title_full"), none.alias("parent_section_id"), F.array().cast("array<string>").alias("hierarchy"), "content")
    return chunk.chunks(sections).select("doc_id", F.col("node_id").alias("id"), "prev_chunk_id", "next_chunk_id", "global_order", "text")


@query("""
with t as (select o_orderpriority, len(regexp_extract_all('See ' || o_orderpriority || ', order ' || o_orderkey || '.', '[A-Za-z0-9_]+|[^A-Za-z0-9_ ]')) + 2 as n from orders)
select o_orderpriority, count(*) as chunks, max(n)::int as max_tokens, round(avg(n), 2) as mean_tokens from t group by all""")
def token_stats(spark, d):
    text = F.concat(F.lit("See "), "o_orderpriority", F.lit(", order "), "o_orderkey", F.lit("."))
    rows = read(spark, d, "orders").select("o_orderpriority", chunk.token_count(text).alias("n"))
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("chunks"), F.max("n").alias("max_tokens"), F.round(F.avg("n"), 2).alias("mean_tokens"))


@query("""
with recursive l as (select l_orderkey, l_linenumber, l_partkey, l_quantity::bigint as n, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity) as k from lineitem),
f as (select l_orderkey, l_linenumber, l_partkey, n, k, n <= 60 as keep, case when n <= 60 then n else 0 end as used from l where k = 1
 union all select l.l_orderkey, l.l_linenumber, l.l_partkey, l.n, l.k, f.used + l.n <= 60, case when f.used + l.n <= 60 then f.used + l.n else f.used end from f join l on l.l_orderkey = f.l_orderkey and l.k = f.k + 1)
select l_orderkey, l_linenumber, l_partkey, n from f where keep""")
def text_budget_greedy(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("n"))
    return retrieve.greedy_budget(rows, "l_orderkey", ["l_linenumber", "l_partkey", "n"], "n", 60)


@query("""
with e as (select l_suppkey as query_id, l_orderkey * 10 + l_linenumber as id, case l_partkey % 5 when 0 then 'chunks' when 1 then 'figures' when 2 then 'tables' when 3 then 'equations' else 'references' end as bucket,
 case l_orderkey % 3 when 0 then 'primary_hit' when 1 then 'context_next' else 'nearby_chunk' end as role, l_orderkey % 11 as hit_rank, l_orderkey * 10 + l_linenumber as position from lineitem),
p as (select *, case when bucket = 'chunks' then case role when 'primary_hit' then 0 when 'context_next' then 2 else 3 end when bucket = 'references' then 4 else 1 end as priority,
 bucket in ('figures', 'tables') as vis, list_position(['chunks', 'figures', 'tables', 'equations', 'references'], bucket) as turn from e),
v as (select *, row_number() over (partition by query_id, vis order by priority, hit_rank, position, turn) as n from p),
k as (select *, row_number() over (partition by query_id order by priority, hit_rank, position, turn) as kept_rank from v where not vis or n <= 5)
select query_id, id, bucket, kept_rank::int as kept_rank from k where kept_rank <= 20""")
def object_cap(spark, d):
    names = F.array(*map(F.lit, ("chunks", "figures", "tables", "equations", "references")))
    roles = F.array(*map(F.lit, ("primary_hit", "context_next", "nearby_chunk")))
    ident = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("query_id"), ident.alias("id"), F.get(names, (F.col("l_partkey") % 5).cast("int")).alias("bucket"), F.get(roles, (F.col("l_orderkey") % 3).cast("int")).alias("expand_role"), (F.col("l_orderkey") % 11).alias("hit_rank"), ident.alias("position"))
    return retrieve.cap_objects(rows).select("query_id", "id", "bucket", "kept_rank")


@query("""
with h as (select o_custkey as doc_id, o_orderkey, (row_number() over w)::int as ord, case when row_number() over w = 1 then 1 else o_orderkey % 3 + 1 end as level from orders window w as (partition by o_custkey order by o_orderkey)),
a as (select *, sum((level = 1)::int) over (partition by doc_id order by ord) as c1 from h),
b as (select *, sum((level = 2)::int) over (partition by doc_id, c1 order by ord) as c2 from a),
c as (select *, sum((level = 3)::int) over (partition by doc_id, c1, c2 order by ord) as c3 from b)
select doc_id::varchar as doc_id, ord, level::int as level, 'T' || o_orderkey as title, array_to_string(list_filter(case level when 1 then [c1] when 2 then [c1, c2] else [c1, c2, c3] end, lambda x: x > 0), '.') as number from c""")
def section_counters(spark, d):
    h = read(spark, d, "orders").withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    level = F.when(F.col("n") == 1, 1).otherwise(F.col("o_orderkey") % 3 + 1).cast("int")
    head = F.concat(F.repeat(F.lit("#"), level + 1), F.lit(" T"), "o_orderkey", F.lit("\nBody."))
    md = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", head.alias("x")))), lambda r: r["x"]), "\n\n")
    docs = h.groupBy("o_custkey").agg(md.alias("md_text")).select(F.col("o_custkey").cast("string").alias("doc_id"), F.lit("f").alias("source_file"), "md_text")
    return parse.exploded(parse.documents(docs), "sections").select("doc_id", "ord", "level", F.col("section_title").alias("title"), F.col("section_number").alias("number"))


def _orders_graph(spark, d) -> tuple[DataFrame, DataFrame]:
    """Orders as chunks of their customer's document, parts as figures, lines as citations; lines of parts beyond 90 in a hundred dangle."""
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    s = lambda c: F.col(c).cast("string")
    chunks = o.select(s("o_custkey").alias("doc_id"), F.concat(F.lit("o"), "o_orderkey").alias("node_id"), F.lit("section_chunk").alias("node_type"))
    lines = li.join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select(s("o_custkey").alias("doc_id"), F.concat(F.lit("o"), "l_orderkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), F.col("l_partkey"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("edge_id"), F.lit("cites_figure").alias("relation"))
    figures = lines.where("l_partkey % 100 < 90").select("doc_id", F.col("target").alias("node_id"), F.lit("figure").alias("node_type")).distinct()
    nodes = chunks.union(figures).withColumn("source_file", F.lit("f")).withColumn("evidence_uid", T.evidence_uid(F.col("doc_id"), F.col("node_id"))).withColumn("section_id", F.lit(None).cast("string")).withColumn("parent_section_id", F.lit(None).cast("string"))
    return nodes, lines.drop("l_partkey")


_LINES = "select o_custkey::varchar as doc_id, 'o' || l_orderkey as source, 'p' || l_partkey as target, l_partkey, l_orderkey || '-' || l_linenumber as edge_id from lineitem join orders on o_orderkey = l_orderkey"


@query(f"""
with l as ({_LINES}), a as (select doc_id, 'error' as severity, 'EDGE_DANGLING_ENDPOINT' as code, count(*) as n from l where l_partkey % 100 >= 90 group by all),
b as (select doc_id, 'error' as severity, 'EDGE_ID_DUPLICATE' as code, count(*) as n from (select doc_id, edge_id from l group by all having count(*) > 1) group by all)
select * from a union all select * from b""")
def dangling_edges(spark, d):
    nodes, edges = _orders_graph(spark, d)
    meta = nodes.select("doc_id", "source_file").distinct()
    found = validate.findings(validate.graph_rules(meta, nodes, edges)).where(F.col("code").isin("EDGE_DANGLING_ENDPOINT", "EDGE_ID_DUPLICATE"))
    return found.groupBy("doc_id", "severity", "code").agg(F.count("*").alias("n"))


@query(f"with l as ({_LINES}) select doc_id, source, array_to_string(list_sort(list_distinct(list(target))), ',') as nearby from l group by all")
def nearby_ids(spark, d):
    nodes, edges = _orders_graph(spark, d)
    near = graph.with_nearby(nodes.where("node_type = 'section_chunk'").select("doc_id", "node_id"), edges)
    return near.where(F.size("nearby_evidence_ids") > 0).select("doc_id", F.col("node_id").alias("source"), _joined(F.col("nearby_evidence_ids")).alias("nearby"))


@query(f"""
with l as ({_LINES}), c as (select o_custkey::varchar as doc_id, 'o' || o_orderkey as id, o_orderkey, lag('o' || o_orderkey) over w as p, lead('o' || o_orderkey) over w as n from orders window w as (partition by o_custkey order by o_orderkey)),
h as (select doc_id as query_id, doc_id, id, p, n, (row_number() over (partition by doc_id order by o_orderkey desc))::int as rank from c qualify rank <= 3),
s as (select query_id, doc_id, id as node, rank, 0 as step, id as hit from h union all select query_id, doc_id, p, rank, 1, id from h where p is not null union all select query_id, doc_id, n, rank, 2, id from h where n is not null),
f as (select query_id, 'chunks' as bucket, node as node_id, arg_min(case step when 0 then 'primary_hit' when 1 then 'context_prev' else 'context_next' end, rank * 10 + step) as expand_role, arg_min(hit, rank * 10 + step) as expanded_from from s group by all),
o as (select h.query_id, 'figures' as bucket, target as node_id, '' as expand_role, arg_min(h.id, rank) as expanded_from from h join l on l.doc_id = h.doc_id and l.source = h.id where l_partkey % 100 < 90 group by all)
select * from f union all select * from o""")
def expand_1hop(spark, d):
    nodes, edges = _orders_graph(spark, d)
    o = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), "o_orderkey", F.concat(F.lit("o"), "o_orderkey").alias("node_id"))
    w = Window.partitionBy("doc_id").orderBy("o_orderkey")
    chunked = o.select("doc_id", "node_id", F.lag("node_id").over(w).alias("prev_chunk_id"), F.lead("node_id").over(w).alias("next_chunk_id"), F.array().cast("array<string>").alias("nearby_evidence_ids"))
    hits = o.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("o_orderkey")))).where("rank <= 3").select(F.col("doc_id").alias("query_id"), "rank", "doc_id", "node_id")
    return retrieve.expand(hits, nodes, edges, chunked).select("query_id", "bucket", "node_id", "expand_role", "expanded_from")


@query("""
with c as (select o_custkey::varchar as doc_id, count(*) as n from orders group by all), m as (select c_custkey::varchar as doc_id, c_custkey % 2 = 0 as old from customer where c_custkey in (select o_custkey from orders))
select doc_id, n as chunks, case when old or doc_id::bigint % 3 = 0 then 1 else 0 end as profiles, case when doc_id::bigint % 3 = 0 then 'new' when old then 'old' else '' end as title from c join m using (doc_id)""")
def metadata_upsert(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), F.concat(F.lit("o"), "o_orderkey").alias("node_id"), F.lit("section_chunk").alias("node_type"), F.lit("").alias("title"), F.lit(1).alias("rank"))
    docs = o.select("doc_id").distinct()
    key = F.col("doc_id").cast("long")
    profile = lambda rows, t: rows.select("doc_id", F.lit("metadata_structured").alias("node_id"), F.lit("metadata_structured").alias("node_type"), F.lit(t).alias("title"), F.lit(-1).alias("rank"))
    merged = graph.upsert_metadata(o.union(profile(docs.where(key % 2 == 0), "old")), profile(docs.where(key % 3 == 0), "new"))
    kind = F.col("node_type") == "metadata_structured"
    return merged.groupBy("doc_id").agg(F.count_if(~kind).alias("chunks"), F.count_if(kind).cast("int").alias("profiles"), F.coalesce(F.max(F.when(kind, F.col("title"))), F.lit("")).alias("title"))


@query("""
select event_id, case event_id % 4 when 3 then null else json_extract_string(props, '$.k') end as k from events""")
def lenient_json(spark, d):
    from ..functions.json import first_object

    said = F.get(F.array(F.concat(F.lit("```json\n"), "props", F.lit("\n```")), F.concat(F.lit("Here: "), "props", F.lit(" - done")), F.col("props"), F.lit("no object")), (F.col("event_id") % 4).cast("int"))
    return read(spark, d, "events").select("event_id", F.get_json_object(first_object(said), "$.k").alias("k"))


# ---- whole documents: a Markdown paper around each text (no SQL: sentence and table parsing run in Python)


def papers(spark, d) -> DataFrame:
    """A paper in Markdown around each document's text: sections, a figure, a table, an equation, mentions and references."""
    k = F.col("doc_id").cast("string")
    md = F.concat(
        F.lit("# Paper "), k, F.lit("\n\n## Abstract\nShort.\n\n## 1. Introduction\nAs [1-3] show, Fig. 1 and Table 1 hold.\n\n![](images/a.png)\nFig. 1. A curve.\n\n## 2. Experimental details\nBy Eq. (1) with $$a = b \\tag{1}$$ done.\n\nTable 1\nMeasured values\n"),
        F.lit("<table><tr><th>Name</th><th>Value</th></tr><tr><td>a</td><td>"), k, F.lit("</td></tr></table>\n\n## 3. Results\n"), F.regexp_replace(F.coalesce("text", F.lit("")), r"\n", "\n\n"),
        F.lit("\n\n### 3.1. Details\nSee Fig. 1.\n\n## References\n[1] A first one.\n[2] A second\none.\n[3] A third one.\n"),
    )
    return read(spark, d, "documents").select(k.alias("doc_id"), F.lit("paper.md").alias("source_file"), md.alias("md_text"))


def _built(spark, d) -> pipeline.Built:
    return pipeline.build(papers(spark, d), keep=new_folder(spark, "built"))


@query()
def corpus_statistics(spark, d):
    return _built(spark, d).statistics()


@query()
def corpus_findings(spark, d):
    return validate.report(pipeline.checked(_built(spark, d), keep=new_folder(spark, "findings")))


@query("select doc_id::varchar as doc_id, 'Table 1' as table_number, 'Name,Value' as columns, 'a,' || doc_id as cells, 1 as header_rows from documents")
def table_grids(spark, d):
    parsed = parse.documents(clean.clean_markdown(papers(spark, d)))
    return parse.exploded(parsed, "tables").select("doc_id", "table_number", _joined(F.col("data.columns")).alias("columns"), _joined(F.flatten("data.rows")).alias("cells"), F.col("data.data_start_row").alias("header_rows"))


@query()
def retrieve_expand(spark, d):
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("Why? "), F.col("text")).alias("query"))
    found = pipeline.answer(_built(spark, d), asked, keep=new_folder(spark, "answered"))
    return found.evidence.select("query_id", "bucket", "doc_id", "node_id", "expand_role", "kept_rank", "tokens", "display")
