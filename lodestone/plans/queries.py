"""Queries over the driver's tables, each with the same in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import audit, chunking, dialog, evaluation, lookup, ranking, search, store

WORDS = "list_transform(regexp_extract_all({0}, '([0-9A-Za-zА-Яа-яЁё]+)', 1), lambda w: lower(w))"
TERMS = ("the", "of")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


#: Queries of the searches: every row whose id is divisible by 50, against all rows. The search string of a document is
#: its two longest words.
_VEC = """q as (select vec_id as query_id, embedding::double[] as q from embeddings where vec_id % 50 = 0),
v as (select query_id, vec_id as chunk_id, round(list_cosine_similarity(embedding::double[], q), 9) as vector_score from embeddings, q),
vr as (select * from (select *, row_number() over (partition by query_id order by vector_score desc, chunk_id) as vector_rank from v where vector_score is not null) where vector_rank <= {k})"""
_LONG = f"""w_ as (select doc_id as chunk_id, {WORDS.format('text')} as ws from documents),
q2 as (select chunk_id as query_id, term, row_number() over (partition by chunk_id order by length(term) desc, term) as n from (select chunk_id, unnest(list_distinct(ws)) as term from w_ where chunk_id % 50 = 0))"""
_TEXT = f"""{_LONG},
tok as (select chunk_id, unnest(ws) as term, unnest(range(len(ws))) as p from w_),
h0 as (select query_id, chunk_id, p, n from tok join q2 using (term) where n <= 2),
many_ as (select query_id, count(*) as many from q2 where n <= 2 group by 1),
h as (select *, row_number() over w as k, max(p) filter (n = 1) over w as t0, max(p) filter (n = 2) over w as t1 from h0 window w as (partition by query_id, chunk_id order by p rows unbounded preceding)),
e as (select query_id, chunk_id, case when many = 1 then t0 else least(t0, t1) end as l, min(p) as r, min(k) as nr from h join many_ using (query_id) where t0 is not null and (many = 1 or t1 is not null) group by 1, 2, 3),
ts as (select e.query_id, e.chunk_id, round(sum(0.1e0 / (1 + (r - l) - (nr - s.k))), 9) as text_score from e join h s on s.query_id = e.query_id and s.chunk_id = e.chunk_id and s.p = e.l group by 1, 2),
tr as (select * from (select *, row_number() over (partition by query_id order by text_score desc, chunk_id) as text_rank from ts) where text_rank <= {{k}})"""
_FUSED = """f as (select query_id, chunk_id, coalesce(vector_score, 0e0) as vector_score, coalesce(text_score, 0e0) as text_score, coalesce(vector_rank, 999999) as vector_rank, coalesce(text_rank, 999999) as text_rank from vr full join tr using (query_id, chunk_id)),
g as (select *, round(case when vector_rank < 999999 then 0.72e0 / (60e0 + vector_rank) else 0e0 end + case when text_rank < 999999 then 0.28e0 / (60e0 + text_rank) else 0e0 end, 12) as hybrid_score from f)"""


def _chunks(t: Callable[[str], DataFrame]) -> DataFrame:
    return t("documents").withColumnRenamed("doc_id", "chunk_id")


def _near(t: Callable[[str], DataFrame], k: int) -> DataFrame:
    e = t("embeddings").withColumnRenamed("vec_id", "chunk_id")
    return search.vector_topk(e, e.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q")), k, by="query_id")


def _longest(n: int) -> Column:
    """The n longest words of a text, ties by alphabet."""
    ranked = F.array_sort(F.transform(F.array_distinct(tx.words(F.col("text"))), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.transform(F.slice(ranked, 1, n), lambda x: x["w"])


def _said(t: Callable[[str], DataFrame], k: int) -> DataFrame:
    queries = t("documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.array_join(F.transform(_longest(2), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " ").alias("s"))
    return search.text_topk(search.text_search(_chunks(t), queries, stemmed=False, by="query_id", k=k), k, by="query_id")


@query(f"with {_VEC.format(k=40)} select query_id, chunk_id, round(vector_score, 6) as vector_score, cast(vector_rank as bigint) as vector_rank from vr")
def vector_topk(t):
    """The 40 vectors nearest to every vector whose id is divisible by 50."""
    return _near(t, 40).select("query_id", "chunk_id", *_r6("vector_score"), F.col("vector_rank").cast("bigint").alias("vector_rank"))


@query(f"with {_TEXT.format(k=40)} select query_id, chunk_id, round(text_score, 6) as text_score, cast(text_rank as bigint) as text_rank from tr")
def text_rank_cover_density(t):
    """The 40 documents with the densest covers of the two longest words of every document whose id is divisible by 50."""
    return _said(t, 40).select("query_id", "chunk_id", *_r6("text_score"), F.col("text_rank").cast("bigint").alias("text_rank"))


@query(f"with {_VEC.format(k=40)}, {_TEXT.format(k=40)}, {_FUSED}, o as (select *, row_number() over (partition by query_id order by hybrid_score desc, vector_score desc, text_score desc, chunk_id) as n from g join documents on doc_id = chunk_id) select query_id, chunk_id, source, round(vector_score, 6) as vector_score, round(text_score, 6) as text_score, round(hybrid_score, 6) as hybrid_score from o where n <= 8")
def hybrid_rrf(t):
    """Vector and text candidates of every id divisible by 50, fused by reciprocal ranks: the best 8 documents each."""
    docs = _chunks(t).select("chunk_id", "source")
    rows = search.fuse(_near(t, 40), _said(t, 40), 80, by="query_id").join(docs, "chunk_id")
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hybrid_score"), F.desc("vector_score"), F.desc("text_score"), "chunk_id"))
    return rows.withColumn("n", n).where("n <= 8").select("query_id", "chunk_id", "source", *_r6("vector_score", "text_score", "hybrid_score"))


@query(f"""with {_VEC.format(k=180)}, {_TEXT.format(k=180)}, {_FUSED},
rows_ as (select query_id, source as doc_id, vector_score, text_score, hybrid_score, vector_rank, text_rank, chunk_id as position from g join documents on doc_id = chunk_id),
a as (select query_id, doc_id, greatest(max(vector_score), 0e0) as bv, greatest(max(text_score), 0e0) as bt, greatest(max(hybrid_score), 0e0) as bh, count(*) as matched_chunks,
  count(*) filter (vector_score > 0 and vector_rank < 999999) as vector_matched_chunks, count(*) filter (text_score > 0 and text_rank < 999999) as text_matched_chunks,
  count(*) filter (vector_score > 0.1e0 or text_score > 0.01e0) as evidence, min(position) as first_position from rows_ group by 1, 2),
s as (select *, case when bv <= 0.1e0 then 0e0 else least(1e0, (bv - 0.1e0) / 0.9e0) end as v, case when bt <= 0.01e0 then 0e0 else least(1e0, (bt - 0.01e0) / (0.15e0 - 0.01e0)) end as t from a),
d as (select *, least(1e0, greatest(v, t) * (1e0 + 0.06e0 * least(1e0, log2(greatest(1, evidence)) / 2e0)) + 0.1e0 * least(v, t)) as raw from s),
k as (select *, round(raw, 8) as score, round(v, 8) as v8, round(t, 8) as t8 from d where (bv > 0.1e0 or bt > 0.01e0) and raw >= 0.05e0),
m as (select *, max(score) over w as ms, max(v8) over w as mv, max(t8) over w as mt from k window w as (partition by query_id)),
o as (select *, row_number() over (partition by query_id order by score desc, bh desc, bv desc, bt desc, first_position, doc_id) as place from m
  where score >= ms * 0.55e0 or (mv >= 0.25e0 and v8 >= mv * 0.55e0) or (mt >= 0.25e0 and t8 >= mt * 0.55e0))
select query_id, doc_id, cast(matched_chunks as bigint) as matched_chunks, cast(vector_matched_chunks as bigint) as vector_matched_chunks, cast(text_matched_chunks as bigint) as text_matched_chunks, cast(evidence as bigint) as evidence, round(score, 6) as score, cast(place as bigint) as place from o where place <= 20""")
def rank_documents(t):
    """Sources ranked by the scores of their 180 best documents on each side, for every id divisible by 50."""
    rows = search.fuse(_near(t, 180), _said(t, 180), 360, by="query_id").join(_chunks(t).select("chunk_id", "source"), "chunk_id")
    rows = rows.select("query_id", F.col("source").alias("doc_id"), "vector_score", "text_score", "hybrid_score", "vector_rank", "text_rank", F.col("chunk_id").alias("position"))
    got = ranking.rank_documents(rows, 20, min_vector=0.1, by="query_id")
    return got.select("query_id", "doc_id", *(F.col(c).cast("bigint").alias(c) for c in ("matched_chunks", "vector_matched_chunks", "text_matched_chunks", "evidence", "place")), *_r6("score"))


@query("select cast(label as varchar) as model, len(embedding) as dimension, count(*) as chunks from embeddings group by 1, 2")
def embedding_profile(t):
    """Vectors by model and dimension."""
    got = store.embedding_profile(t("embeddings").withColumn("model", F.col("label").cast("string")), "model")
    return got.select("model", F.col("dimension").cast("bigint").alias("dimension"), "chunks")


@query("select doc_id, source as source_name, lang as index_code, split_part(text, chr(10), 1) as document_title from documents")
def catalog(t):
    """All documents with their titles (the first line)."""
    docs = t("documents").select("doc_id", F.col("source").alias("source_name"), F.col("lang").alias("index_code"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("document_title"))
    return lookup.catalog(docs)


@query("select source as doc_id, string_agg(text, chr(10) || chr(10) order by doc_id) as full_text, count(*) as chunks from documents where text is not null group by source")
def full_document(t):
    """The texts of each source in order."""
    return lookup.full_text(t("documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("raw_text")))


_GRAMS = "list_distinct(flatten(list_transform({0}, lambda x: list_transform(range(1, len(x) + 2), lambda i: substr('  ' || x || ' ', i, 3)))))"
_SIM = f"""n_ as (select p_partkey, p_name, {_GRAMS.format(WORDS.format('p_name'))} as gs from part where p_name is not null),
s0 as (select q.p_partkey as query_id, d.p_partkey as doc_id, d.p_name as document_title, lower(trim(d.p_name)) = lower(trim(q.p_name)) as exact,
  round(coalesce(len(list_intersect(d.gs, q.gs)) / nullif(len(d.gs) + len(q.gs) - len(list_intersect(d.gs, q.gs)), 0)::double, 0), 9) as score from n_ q, n_ d where q.p_partkey % 50 = 0),
s as (select *, row_number() over (partition by query_id order by exact desc, score desc, lower(trim(document_title)), doc_id) as place from s0 where exact or score > 0)"""


def _parts(t: Callable[[str], DataFrame]) -> DataFrame:
    return t("part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("document_title"))


@query(f"with {_SIM} select query_id, doc_id, exact, round(score, 6) as score, cast(place as bigint) as place from s where place <= 5")
def fuzzy_find(t):
    """The five parts whose names are most like that of every part whose key is divisible by 50."""
    names = _parts(t)
    got = lookup.find_each(names, names.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("document_title").alias("s")))
    return got.select("query_id", "doc_id", "exact", *_r6("score"), F.col("place").cast("bigint").alias("place"))


_ITEMS = """i as (select l_orderkey as doc_id, cast(l_orderkey as varchar) || '.' || cast(l_linenumber as varchar) as item_number, cast(l_orderkey as varchar) as heading_number, l_partkey as chunk_id, l_returnflag as appendix_number from lineitem)"""


def _items(t):
    key = F.col("l_orderkey").cast("string")
    return t("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat_ws(".", key, F.col("l_linenumber").cast("string")).alias("item_number"), key.alias("heading_number"), F.col("l_partkey").alias("chunk_id"), F.col("l_returnflag").alias("appendix_number"), F.lit("numbered_item").alias("chunk_type"), F.array(key).alias("section_path"))


@query(f"with {_ITEMS} select doc_id, chunk_id, item_number, 'item' as structural_match from i where item_number = '7.1'")
def structural_item(t):
    """One item by its number."""
    return lookup.structural(_items(t), "item", "7.1").select("doc_id", "chunk_id", "item_number", "structural_match")


@query(f"with {_ITEMS} select doc_id, chunk_id, item_number, 'item' as structural_match from i where item_number = '7' or starts_with(item_number, '7.')")
def structural_subtree(t):
    """An item with everything below it."""
    return lookup.structural(_items(t), "item", "7", descendants=True).select("doc_id", "chunk_id", "item_number", "structural_match")


@query(f"with {_ITEMS} select doc_id, chunk_id, item_number, 'section' as structural_match from i where heading_number = '7'")
def structural_fallback(t):
    """An item that no chunk has is found as a section."""
    return lookup.structural(_items(t), "item", "7").select("doc_id", "chunk_id", "item_number", "structural_match")


@query(f"with {_ITEMS} select doc_id, appendix_number as appendix, item_number as anchor, count(*) as chunks from i where starts_with(item_number, '7.') group by all")
def distinct_anchors(t):
    """The places that a reference hits."""
    got = lookup.anchors(lookup.structural(_items(t), "item", "7", descendants=True).withColumn("section_path", F.array().cast("array<string>")))
    # an anchor is path, number and blocks; there are neither paths nor blocks here
    return got.select("doc_id", "appendix", F.split_part("anchor", F.lit("|"), F.lit(2)).alias("anchor"), "chunks")


@query(f"""with {_SIM}, c as (select *, count(*) filter (exact) over (partition by query_id) as n, lead(score) over (partition by query_id order by score desc, doc_id) as next_, row_number() over (partition by query_id order by score desc, doc_id) as top from s where place <= 5)
select query_id, doc_id, document_title from c where case when n = 1 then exact when n > 1 then false else top = 1 and score >= 0.2 and (next_ is null or round(score - next_, 9) >= 0.035) end""")
def select_document(t):
    """The part that the name of every part whose key is divisible by 50 means, if it is only one."""
    names = _parts(t)
    queries = names.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("document_title").alias("s"))
    found = lookup.find_each(names, queries).join(names, "doc_id").join(queries, "query_id")
    return lookup.select(found, F.col("s"), ("document_title",), by="query_id").select("query_id", "doc_id", "document_title")


@query()
def chunk_pack(t):
    """All documents in pieces of at most 1800 characters."""
    return chunking.chunk_text(t("documents"))


@query("select doc_id, cast(doc_id as varchar) || '::chunk-' || left(sha1(cast(doc_id as varchar) || '|' || text), 12) as chunk_id from documents")
def chunk_ids(t):
    """Stable ids from id and content."""
    i = F.col("doc_id").cast("string")
    return t("documents").select("doc_id", F.concat(i, F.lit("::chunk-"), tx.sha1_prefix(F.concat(i, F.lit("|"), F.col("text")))).alias("chunk_id"))


@query("""select page_id, case when s = '' then 'document' else s end as slug from (select page_id, regexp_replace(regexp_replace(lower(url), '[^a-zа-яё0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as s from pages)""")
def slug(t):
    """Slugs of addresses."""
    return t("pages").select("page_id", tx.slug(F.col("url")).alias("slug"))


@query("""select doc_id, trim(regexp_replace(translate(text, chr(160), ' '), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) as text from documents""")
def normalize_space(t):
    """Texts with single spaces."""
    return t("documents").select("doc_id", tx.normalize_space(F.col("text")).alias("text"))


@query(f"select doc_id, cast(len({WORDS.format('text')}) as bigint) as n_words, cast(len(list_distinct({WORDS.format('text')})) as bigint) as n_kinds from documents")
def word_tokens(t):
    """Words and kinds of words."""
    w = tx.words(F.col("text"))
    return t("documents").select("doc_id", F.size(w).cast("bigint").alias("n_words"), F.size(F.array_distinct(w)).cast("bigint").alias("n_kinds"))


_BAG = "select unnest({0}) as token from {1}".format(WORDS.format("text"), "{0}")


@query(f"""with a as (select token, count(*) as n from ({_BAG.format('benchmark')}) group by 1), b as (select token, count(*) as m from ({_BAG.format("documents")}) group by 1)
select token, cast(n - coalesce(m, 0) as bigint) as missing from a left join b using (token) where n > coalesce(m, 0) order by missing desc, token limit 50""")
def missing_tokens(t):
    """Words of the benchmark that all documents, whatever their language, say less often, the 50 most frequent."""
    got = audit.missing_tokens(t("benchmark"), t("documents"))
    return got.select("token", F.col("missing").cast("bigint").alias("missing"))


@query(f"""with a as (select conv_id, token, count(*) as n from (select conv_id, unnest({WORDS.format('text')}) as token from conversations where role = 'user') group by all),
b as (select conv_id, token, count(*) as m from (select conv_id, unnest({WORDS.format('text')}) as token from conversations where role = 'assistant') group by all),
c as (select conv_id, sum(n) as expected, sum(least(n, coalesce(m, 0))) as covered from a left join b using (conv_id, token) group by 1)
select conv_id, cast(coalesce(expected, 0) as bigint) as expected, cast(coalesce(covered, 0) as bigint) as covered, round(coalesce(covered / expected, 1e0), 6) as coverage from (select distinct conv_id from conversations where role = 'user') left join c using (conv_id)""")
def token_coverage(t):
    """How much of what users say the answers say too."""
    c = t("conversations")
    got = audit.token_coverage(c.where("role = 'user'"), c.where("role = 'assistant'"), "conv_id")
    return got.select("conv_id", F.col("expected").cast("bigint").alias("expected"), F.col("covered").cast("bigint").alias("covered"), *_r6("coverage"))


@query(f"""with n as (select item_id as needle, {WORDS.format('text')} as w from benchmark), d as (select doc_id as document, {WORDS.format('text')} as h from documents),
c as (select n.needle, d.document, w, h from n join d on len(w) > 0 and len(h) >= len(w) and contains(' ' || array_to_string(h, ' ') || ' ', ' ' || array_to_string(w, ' ') || ' '))
select needle, document, cast(len(list_filter(range(1, len(h) - len(w) + 2), lambda i: h[i] = w[1] and h[i : i + len(w) - 1] = w)) as bigint) as n from c""")
def ngram_occurrences(t):
    """How often each benchmark passage occurs in each document."""
    got = audit.occurrences(t("documents"), t("benchmark"), "doc_id", "item_id")
    return got.select("needle", "document", F.col("n").cast("bigint").alias("n"))


@query("""with f as (select doc_id, upper(lang) as lang, source from documents where doc_id % 10 != 3 union all select doc_id + 1000000000, lang, source from documents where doc_id % 10 = 3),
f2 as (select doc_id, case when doc_id % 10 = 5 then lang else lower(lang) end as lang, source from f)
select doc_id, case when a.doc_id is null then 'missing' when b.doc_id is null then 'stale' else 'changed' end as status, case when a.doc_id is not null and b.doc_id is not null then concat_ws(',', case when a.lang is distinct from b.lang then 'lang' end, case when a.source is distinct from b.source then 'source' end) else '' end as changed
from documents a full join f2 b using (doc_id) where a.doc_id is null or b.doc_id is null or a.lang is distinct from b.lang or a.source is distinct from b.source""")
def snapshot_diff(t):
    """Documents that a changed copy lacks, has more, or has otherwise."""
    d = t("documents").select("doc_id", "lang", "source")
    three = F.col("doc_id") % 10 == 3
    fresh = d.where(~three).withColumn("lang", F.when(F.col("doc_id") % 10 == 5, F.upper("lang")).otherwise(F.col("lang"))).union(d.where(three).withColumn("doc_id", F.col("doc_id") + 1000000000))
    return audit.snapshot_diff(d, fresh, "doc_id", ["lang", "source"])


@query("select sha256(text) as sha256, count(*) as n from documents where text is not null group by 1 having count(*) > 1")
def duplicates(t):
    """Texts that occur more than once."""
    return audit.duplicates(t("documents").select(F.sha2("text", 256).alias("sha256")), "sha256")


@query("""select * from (select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey % 3 != 0 union all select o_orderkey, 'U', o_totalprice * 2 from orders where o_orderkey % 3 = 0)""")
def upsert_latest(t):
    """Orders with every third replaced by the newer of two versions."""
    o = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    third = o.where("o_orderkey % 3 = 0")
    batch = third.withColumn("o_orderstatus", F.lit("U")).withColumn("v", F.lit(1)).withColumn("o_totalprice", F.col("o_totalprice") * 3).union(third.withColumn("o_orderstatus", F.lit("U")).withColumn("v", F.lit(2)).withColumn("o_totalprice", F.col("o_totalprice") * 2))
    return store.upsert(o, batch, "o_orderkey", "v")


@query("""select o_custkey, o_orderkey from orders where o_custkey % 2 = 1 union all select o_custkey, min(o_orderkey) from orders where o_custkey % 2 = 0 group by 1""")
def replace_documents(t):
    """The orders of every second customer replaced by one each."""
    o = t("orders").select("o_custkey", "o_orderkey")
    batch = o.where("o_custkey % 2 = 0").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    return store.replace_documents(o, batch, "o_custkey")


@query("""with r as (select * from conversations where role in ('user', 'assistant') and trim(text) != ''), m as (select *, max(turn) filter (role = 'user') over (partition by conv_id) as last_ from r),
k as (select *, row_number() over (partition by conv_id order by turn desc) as back from m where last_ is null or turn != last_) select conv_id, turn, role, text, back from k where back <= 3""")
def history_last_n(t):
    """The last three turns before the open question."""
    return dialog.last_turns(t("conversations"), 3).select("conv_id", "turn", "role", "text", F.col("back").cast("bigint").alias("back"))


@query("""with r as (select conv_id, turn, role, trim(regexp_replace(translate(text, chr(160), ' '), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) as text from conversations where role in ('user', 'assistant')),
c as (select conv_id, turn, role, case when length(text) > 200 then left(text, 66) || ' [...] ' || right(text, 127) else text end as text from r where text != ''),
u as (select *, sum(length(text)) over (partition by conv_id order by turn desc) as used from c) select conv_id, turn, text, cast(used as bigint) as used from u where used <= 600""")
def history_budget(t):
    """The newest turns that fit in 600 characters."""
    return dialog.history_budget(t("conversations"), 600, 200).select("conv_id", "turn", "text", F.col("used").cast("bigint").alias("used"))


@query("select conv_id, max(turn) as turn, arg_max(text, turn) as text from conversations where role = 'assistant' group by 1")
def latest_assistant(t):
    """The last answer of each conversation."""
    return dialog.latest_assistant(t("conversations"))


@query("""select conv_id, turn, case when length(text) > 90 then left(text, 30) || ' [...] ' || right(text, 53) else text end as text from conversations""")
def truncate_middle(t):
    """Texts cut in the middle to 90 characters."""
    return t("conversations").select("conv_id", "turn", tx.middle_truncate(F.col("text"), 90).alias("text"))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as l, unnest(range(len(string_split(text, chr(10))))) as pos from documents where text is not null)
select doc_id, pos, cast(regexp_extract(l, '^\\s*(\\d{1,3})[.)]\\s+(.+?)\\s*$', 1) as bigint) as label, regexp_extract(l, '^\\s*(\\d{1,3})[.)]\\s+(.+?)\\s*$', 2) as line from l where regexp_matches(l, '^\\s*\\d{1,3}[.)]\\s+.+?\\s*$')""")
def numbered_lines(t):
    """Lines of numbered lists."""
    got = dialog.numbered_lines(t("documents"), ["doc_id"]).where("kind = 'list'")
    return got.select("doc_id", F.col("at").cast("bigint").alias("pos"), F.col("label").cast("bigint").alias("label"), "line")


@query("""select item_id, case when item_id % 7 in (0, 2, 6) then '2' else '2,' || (item_id % 7) end as cited from benchmark""")
def citations_in_text(t):
    """Citation numbers within range, once each."""
    told = F.concat(F.lit("as [2] and ["), (F.col("item_id") % 7).cast("string"), F.lit("] or [2] say"))
    return t("benchmark").select("item_id", F.array_join(tx.citations(told, 5).cast("array<string>"), ",").alias("cited"))


@query("""with b as (select page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) as a, unnest(range(len(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')))) as pos from pages)
select page_id, pos, regexp_extract(a, 'href="([^"]*)"', 1) as href, regexp_extract(a, '>([^<]*)<', 1) as body from b""")
def source_blocks(t):
    """Marked-up blocks with an attribute."""
    b = t("pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('(<a href="[^"]*">[^<]*</a>)'), 1)).alias("pos", "a"))
    return b.select("page_id", F.col("pos").cast("bigint").alias("pos"), F.regexp_extract("a", 'href="([^"]*)"', 1).alias("href"), F.regexp_extract("a", ">([^<]*)<", 1).alias("body"))


@query("""with r as (select doc_id, quality = 1 as route_ok, quality as hit, 1 as want, toxic = 0 as ok from labels)
select count(*) as cases, count(*) filter (ok) as passed, count(*) filter (not ok) as failed, round(count(*) filter (route_ok) / count(route_ok)::double, 4) as route_accuracy, round(sum(hit) / sum(want)::double, 4) as source_recall, cast(null as double) as title_recall from r""")
def eval_summary(t):
    """Accuracy and recall over labelled cases."""
    r = t("labels").select((F.col("quality") == 1).alias("route_ok"), F.col("quality").alias("sources_hit"), F.lit(1).alias("sources_want"), F.lit(0).alias("titles_hit"), F.lit(0).alias("titles_want"), (F.col("toxic") == 0).alias("passed"))
    return evaluation.summarize(r)


@query("select event_type, count(value) as n, round(avg(value), 6) as mean_ms, round(median(value), 6) as p50_ms, round(quantile_disc(value, 0.95), 6) as p95_ms, round(max(value), 6) as max_ms from events group by 1")
def latency_summary(t):
    """Latencies by kind of event."""
    return evaluation.latencies(t("events"), "value", "event_type").select("event_type", "n", *_r6("mean_ms", "p50_ms", "p95_ms", "max_ms"))


@query("""with d as (select item_id, text, cast(ceil(length(text) / 40.0) as bigint) as n from benchmark) select item_id, cast(i as bigint) as frame, 'data: ' || substr(text, cast(i * 40 + 1 as bigint), 40) as line from (select item_id, text, unnest(range(n)) as i from d) union all select item_id, n, 'data: [DONE]' from d""")
def sse_frames(t):
    """Texts as a series of event-stream frames."""
    d = t("benchmark").withColumn("n", F.ceil(F.length("text") / 40).cast("int"))
    frames = d.where("n > 0").select("item_id", "text", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    body = frames.select("item_id", F.col("i").cast("bigint").alias("frame"), F.concat(F.lit("data: "), F.substring("text", F.col("i") * 40 + 1, F.lit(40))).alias("line"))
    return body.union(d.select("item_id", F.col("n").cast("bigint"), F.lit("data: [DONE]")))


@query("select doc_id, sha256(text) as sha256, left(sha1(text), 16) as sha1_16 from documents")
def content_hash(t):
    """Hashes of texts."""
    return audit.content_hash(t("documents"), "doc_id")


@query("""with recursive n as (select distinct p_size as n from part), v(k, value, sign) as (values (1,1000,'M'),(2,900,'CM'),(3,500,'D'),(4,400,'CD'),(5,100,'C'),(6,90,'XC'),(7,50,'L'),(8,40,'XL'),(9,10,'X'),(10,9,'IX'),(11,5,'V'),(12,4,'IV'),(13,1,'I')),
r as (select n, n as rest, 1 as k, '' as s from n union all select n, rest % value, r.k + 1, s || repeat(sign, cast(rest // value as bigint)) from r join v on v.k = r.k)
select cast(n as bigint) as n, s as roman, case when n <= 26 then chr(cast(96 + n as integer)) else chr(cast(96 + (n - 1) // 26 as integer)) || chr(cast(97 + (n - 1) % 26 as integer)) end as letters from r where k = 14""")
def roman_letters(t):
    """Numbers as Roman numerals and letters."""
    n = t("part").select(F.col("p_size").alias("n")).distinct()
    return n.select(F.col("n").cast("bigint").alias("n"), tx.roman(F.col("n")).alias("roman"), tx.letters(F.col("n")).alias("letters"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_extract(t):
    """A field of JSON text."""
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("""select role, case when position('the' in lower(text)) > 0 then 'rag' else 'documents' end as route, count(*) as n from conversations group by all""")
def route_decisions(t):
    """Routes read from replies that hold JSON somewhere."""
    told = F.when(F.instr(F.lower("text"), "the") > 0, F.lit('{"route": "nonsense"}')).otherwise(F.lit('sure: {bad {"route": "documents", "retrieval_query": "which?"} ok'))
    got = dialog.decisions(t("conversations").select("role", told.alias("text")))
    return got.groupBy("role", "route").agg(F.count(F.lit(1)).alias("n"))


@query("""with a as (select doc_id, 'short' as code, 'warning' as level from documents where not coalesce(length(text) >= 200, false) union all select doc_id, 'count', 'error' from documents where not coalesce(n_chars = length(text), false) union all select doc_id, 'lang', 'error' from documents where not coalesce(lang in ('en', 'de'), false)) select * from a""")
def audit_issues(t):
    """Broken rules of documents."""
    return audit.issues(t("documents"), "doc_id", {"short": ("warning", "length(text) >= 200"), "count": ("error", "n_chars = length(text)"), "lang": ("error", "lang in ('en', 'de')")})


@query(f"""with {_LONG}, l as (select query_id, max(term) filter (n = 1) as a, max(term) filter (n = 2) as b, max(term) filter (n = 3) as c from q2 where n <= 3 group by 1 having count(*) = 3),
x as (select l.*, a || ' ' || ws[list_position(ws, a) + 1] as phrase from l join w_ on chunk_id = query_id),
j as (select chunk_id, ' ' || array_to_string(ws, ' ') || ' ' as said from w_)
select query_id, chunk_id from x, j where (phrase is not null and contains(said, ' ' || phrase || ' ')) or (phrase is null and contains(said, ' ' || a || ' ')) or (contains(said, ' ' || b || ' ') and not contains(said, ' ' || c || ' '))""")
def websearch_match(t):
    """Documents that a search string of every document whose id is divisible by 50 matches: its longest word with the one
    after it as a phrase, or its second one without its third one."""
    w = tx.words(F.col("text"))
    x = t("documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), w.alias("ws"), _longest(3).alias("l")).where("size(l) = 3")
    after = F.get("ws", F.array_position("ws", F.element_at("l", 1)).cast("int"))
    s = F.concat(F.lit('"'), F.concat_ws(" ", F.element_at("l", 1), after), F.lit('" or "'), F.element_at("l", 2), F.lit('" -"'), F.element_at("l", 3), F.lit('"'))
    return search.text_search(_chunks(t), x.select("query_id", s.alias("s")), stemmed=False, by="query_id", scored=False).select("query_id", "chunk_id")


@query("""with c as (select *, max(turn) over (partition by conv_id) as m from conversations where role = 'assistant') select conv_id, turn, text from c where turn = m""")
def resolve_latest(t):
    """Rows of the last answer by a window, as references are resolved."""
    c = t("conversations").where("role = 'assistant'")
    return c.withColumn("m", F.max("turn").over(Window.partitionBy("conv_id"))).where("turn = m").select("conv_id", "turn", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
