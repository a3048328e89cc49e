"""Queries for retrieval: R1-R6, W3, A26, A28, F7, F9, F15, S13.

Corpus over the driver tables: every document is a clause (id = doc_id,
scheme = language, corpus order = doc_id).  Version v1.0 holds all documents;
the older v0.1 holds only the English ones.  Benchmark items are the queries.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import postings as PS
from ..operators import retrieval as RT
from ..operators import vector_index as VX
from ..session import fresh_scratch, materialize
from ..sources import landing as L
from ..sources.keyed_table import KeyedTable
from .catalog import ORACLES, register, rounded
from .views import cte

ACTIVE = "v1.0"
OLD = "v0.1"


def corpus(t, versions=(ACTIVE,)):
    d = t.documents.select(F.col("doc_id").alias("clause_id"), F.col("lang").alias("scheme"),
                           F.col("doc_id").alias("clause_pos"), "text")
    parts = []
    if ACTIVE in versions:
        parts.append(d.withColumn("corpus_version", F.lit(ACTIVE)))
    if OLD in versions:
        parts.append(d.filter(F.col("scheme") == "en").withColumn("corpus_version", F.lit(OLD)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bench_queries(t, per_scheme: bool):
    b = t.benchmark
    if per_scheme:
        langs = t.documents.agg(F.sort_array(F.collect_set("lang"))).scalar()  # closed, tiny set
        b = b.select("item_id", "text", F.explode(F.concat(langs, F.array(F.lit(None).cast("string"))))
                     .alias("scheme"))
    else:
        b = b.withColumn("scheme", F.lit(None).cast("string"))
    return b.select(F.concat_ws(":", F.col("item_id").cast("string"), F.coalesce("scheme", F.lit("*")))
                    .alias("query_id"), "item_id", "scheme", F.col("text").alias("query"))


def _stop_sql() -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in RT.stop_words()) + "]"


def _tok_sql(col: str) -> str:
    return (f"list_filter(regexp_extract_all(lower(coalesce({col}, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'), "
            f"lambda x: NOT list_contains({_stop_sql()}, x))")


def _terms_sql(tok: str) -> str:
    return f"list_concat({tok}, list_transform(range(1, len({tok})), lambda i: {tok}[i] || ' ' || {tok}[i + 1]))"


def _index_sql(corpus_sql: str) -> str:
    return f"""corpus AS ({corpus_sql}),
ct AS (SELECT corpus_version, clause_id, scheme, clause_pos, {_tok_sql('text')} AS tok FROM corpus),
cterms AS (SELECT corpus_version, clause_id, scheme, clause_pos, {_terms_sql('tok')} AS terms FROM ct),
occ AS (SELECT corpus_version, clause_id, scheme, clause_pos, unnest(terms) AS term FROM cterms),
tf AS (SELECT corpus_version, clause_id, scheme, clause_pos, term, count(*) AS tf FROM occ GROUP BY ALL),
nd AS (SELECT corpus_version, count(*) AS n FROM corpus GROUP BY corpus_version),
dfq AS (SELECT corpus_version, term, count(*) AS df FROM tf GROUP BY corpus_version, term),
idf AS (SELECT dfq.corpus_version, term, ln((1 + n) / (1 + df)) + 1 AS idf FROM dfq JOIN nd USING (corpus_version)),
w AS (SELECT tf.*, tf.tf * idf.idf AS w FROM tf JOIN idf USING (corpus_version, term)),
idx AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY corpus_version, clause_id)) AS weight FROM w)
"""


_CORPUS_ACTIVE = f"SELECT '{ACTIVE}' AS corpus_version, doc_id AS clause_id, lang AS scheme, doc_id AS clause_pos, " \
                 "text FROM documents"
_CORPUS_BOTH = _CORPUS_ACTIVE + f" UNION ALL SELECT '{OLD}', doc_id, lang, doc_id, text FROM documents " \
                                "WHERE lang = 'en'"


def _retrieve_sql(queries_sql: str) -> str:
    return f""",
q AS ({queries_sql}),
qt AS (SELECT query_id, corpus_version, unnest({_terms_sql(_tok_sql('query'))}) AS term FROM q),
qtf AS (SELECT query_id, corpus_version, term, count(*) AS tf FROM qt GROUP BY ALL),
qw AS (SELECT qtf.*, tf * idf AS w FROM qtf JOIN idf USING (corpus_version, term)),
qv AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY query_id, corpus_version)) AS qweight FROM qw),
sc AS (SELECT qv.query_id, qv.corpus_version, idx.clause_id, idx.scheme, idx.clause_pos,
         sum(idx.weight * qv.qweight) AS score
       FROM qv JOIN idx USING (corpus_version, term) GROUP BY ALL),
ranked AS (SELECT sc.*, row_number() OVER (PARTITION BY sc.query_id, sc.corpus_version
                                           ORDER BY round(score, 12) DESC, clause_pos) AS rank
           FROM sc JOIN q ON sc.query_id = q.query_id AND sc.corpus_version = q.corpus_version
           WHERE (q.scheme IS NULL OR sc.scheme = q.scheme) AND score >= 0.05),
res AS (SELECT q.query_id, q.corpus_version, q.scheme AS query_scheme, CAST(r.rank AS BIGINT) AS rank, r.clause_id,
          r.scheme AS clause_scheme, round_even(r.score, 4) AS score, r.clause_id IS NULL AS retrieval_failed
        FROM q LEFT JOIN (SELECT * FROM ranked WHERE rank <= 3) r
          ON q.query_id = r.query_id AND q.corpus_version = r.corpus_version)
"""


_Q_PER_SCHEME = f"""SELECT CAST(item_id AS VARCHAR) || ':' || coalesce(s.scheme, '*') AS query_id,
  '{ACTIVE}' AS corpus_version, s.scheme, text AS query
FROM benchmark, (SELECT unnest(list_append(list_sort(list_distinct(list(lang))), NULL)) AS scheme FROM documents) s"""

_Q_ALL = f"""SELECT CAST(item_id AS VARCHAR) || ':*' AS query_id, '{ACTIVE}' AS corpus_version,
  CAST(NULL AS VARCHAR) AS scheme, text AS query FROM benchmark"""

_Q_VERSIONS = f"""SELECT CAST(item_id AS VARCHAR) || ':*' AS query_id, v.corpus_version, CAST(NULL AS VARCHAR) AS scheme,
  text AS query FROM benchmark, (SELECT unnest(['{ACTIVE}', '{OLD}']) AS corpus_version) v"""


def _index(t, versions=(ACTIVE,)):
    return RT.tfidf_index(corpus(t, versions), extra=["scheme", "clause_pos"])


def _parts(t, versions=(ACTIVE,)):
    return RT.tfidf_parts(corpus(t, versions), extra=["scheme", "clause_pos"])


@register("R1_tfidf_index", "WITH " + _index_sql(_CORPUS_ACTIVE) + """
SELECT clause_id, count(*) AS n_terms, round(sum(weight * weight), 6) AS sum_sq, round(max(weight), 6) AS max_weight
FROM idx GROUP BY clause_id""")
def r1(t):
    """R1 summarised per clause: term count, squared norm (1.0) and largest weight."""
    return rounded(_index(t).summary().select("clause_id", "n_terms", "sum_sq", "max_weight"))      # one version


@register("R2_tfidf_retrieve", "WITH " + _index_sql(_CORPUS_ACTIVE) + _retrieve_sql(_Q_PER_SCHEME)
          + "SELECT * FROM res")
def r2(t):
    """R2 + W3: every benchmark query against every scheme (and unfiltered), top 3."""
    q = bench_queries(t, per_scheme=True).withColumn("corpus_version", F.lit(ACTIVE))
    return RT.retrieve(q, _parts(t))


@register("W3_topk_clauses", "WITH " + _index_sql(_CORPUS_ACTIVE) + _retrieve_sql(_Q_ALL) + """
SELECT query_id, rank, clause_id, score FROM res WHERE NOT retrieval_failed""")
def w3(t):
    """The ranked top-3 list per query over the whole corpus (ties in corpus order)."""
    q = bench_queries(t, per_scheme=False).withColumn("corpus_version", F.lit(ACTIVE))
    r = RT.retrieve(q, _parts(t))
    return r.filter(~F.col("retrieval_failed")).select("query_id", F.col("rank").cast("bigint").alias("rank"),
                                                        "clause_id", "score")


@register("R3_versioned_retrieve", "WITH " + _index_sql(_CORPUS_BOTH) + _retrieve_sql(_Q_VERSIONS)
          + "SELECT * FROM res")
def r3(t):
    """The same queries replayed against the active and the older corpus version."""
    q = bench_queries(t, per_scheme=False)
    q = q.select("*", F.explode(F.array(F.lit(ACTIVE), F.lit(OLD))).alias("corpus_version"))
    return RT.retrieve(q, _parts(t, (ACTIVE, OLD)))


def stored_index(t, versions=(ACTIVE,)) -> PS.PostingStore:
    store = PS.PostingStore(t.spark)
    for v in versions:
        store.register(v, corpus(t, (v,)).drop("corpus_version"))
    return store


@register("R2_stored_retrieve", "WITH " + _index_sql(_CORPUS_ACTIVE) + _retrieve_sql(_Q_PER_SCHEME) + "SELECT * FROM res")
def r2_stored(t):
    """R2 over the stored index: posting lists read by their bounds, every text scored once for all schemes."""
    q = bench_queries(t, per_scheme=True).withColumn("corpus_version", F.lit(ACTIVE))
    return rounded(stored_index(t).retrieve(q))


@register("R3_version_switch", "WITH " + _index_sql(_CORPUS_BOTH) + _retrieve_sql(_Q_VERSIONS) + "SELECT * FROM res")
def r3_switch(t):
    """The stored versions replayed: the active one, switched to the older one, and asked without a name."""
    store = stored_index(t, (OLD, ACTIVE))
    q = bench_queries(t, per_scheme=False).withColumn("corpus_version", F.lit(None).cast("string"))
    newest = store.retrieve(q)
    store.activate(OLD)
    return rounded(newest.unionByName(store.retrieve(q)))


@register("A28_corpus_metadata", f"""WITH c AS ({_CORPUS_BOTH})
SELECT corpus_version, list_sort(list_distinct(list(scheme))) AS schemes, count(*) AS clause_count
FROM c GROUP BY corpus_version""")
def a28(t):
    return RT.corpus_metadata(corpus(t, (ACTIVE, OLD)))


@register("S13_register_versions", f"""WITH c AS ({_CORPUS_BOTH}),
meta AS (SELECT corpus_version, 'documents.parquet' AS source_file, count(*) AS clause_count FROM c GROUP BY 1)
SELECT * FROM meta WHERE corpus_version <> '{OLD}'""")
def s13(t):
    """v0.1 is already registered; registering both versions adds only v1.0."""
    meta = corpus(t, (ACTIVE, OLD)).groupBy("corpus_version").agg(F.count(F.lit(1)).alias("clause_count")) \
        .withColumn("source_file", F.lit("documents.parquet"))
    existing = meta.filter(F.col("corpus_version") == OLD)
    return L.register_versions(existing, meta).select("corpus_version", "source_file", "clause_count")


@register("F15_clause_lookup", "WITH " + _index_sql(_CORPUS_ACTIVE) + _retrieve_sql(_Q_ALL) + """
SELECT DISTINCT r.corpus_version, r.clause_id, c.scheme, length(c.text) AS text_chars
FROM res r JOIN corpus c ON r.corpus_version = c.corpus_version AND r.clause_id = c.clause_id
WHERE r.rank = 1""")
def f15(t):
    """fetch the top-1 clause of every query by (version, id) for citation."""
    q = bench_queries(t, per_scheme=False).withColumn("corpus_version", F.lit(ACTIVE))
    top1 = RT.retrieve(q, _parts(t)).filter(F.col("rank") == 1)
    got = RT.clause_lookup(corpus(t), top1)
    return got.select("corpus_version", "clause_id", "scheme", F.length("text").cast("bigint").alias("text_chars"))


_EXPECTED_SQL = """expected AS (SELECT CAST(b.item_id AS VARCHAR) || ':*' AS query_id, d.doc_id AS clause_id
  FROM benchmark b JOIN documents d ON contains(d.text, b.text))
"""


@register("A26_retrieval_quality", "WITH " + _index_sql(_CORPUS_ACTIVE) + _retrieve_sql(_Q_ALL) + ", " + _EXPECTED_SQL + """,
per AS (SELECT e.query_id,
          max(CASE WHEN r.rank = 1 AND r.clause_id IN (SELECT clause_id FROM expected x WHERE x.query_id = e.query_id)
              THEN 1 ELSE 0 END) AS hit1,
          max(CASE WHEN r.clause_id IN (SELECT clause_id FROM expected x WHERE x.query_id = e.query_id)
              THEN 1 ELSE 0 END) AS hitk,
          max(CASE WHEN r.retrieval_failed THEN 1 ELSE 0 END) AS failed
        FROM (SELECT DISTINCT query_id FROM expected) e LEFT JOIN res r ON r.query_id = e.query_id
        GROUP BY e.query_id),
m AS (SELECT count(*) AS n_cases, round_even(sum(hit1) / count(*), 4) AS context_precision,
        round_even(sum(hitk) / count(*), 4) AS context_recall,
        round_even(sum(failed) / count(*), 4) AS retrieval_failure_rate FROM per)
SELECT *, list_filter([
  CASE WHEN context_precision < 0.85 THEN 'context_precision ' || CAST(CAST(round(context_precision * 100) AS BIGINT)
    AS VARCHAR) || '% below 85% floor' END,
  CASE WHEN context_recall < 0.85 THEN 'context_recall ' || CAST(CAST(round(context_recall * 100) AS BIGINT)
    AS VARCHAR) || '% below 85% floor' END,
  CASE WHEN retrieval_failure_rate > 0.05 THEN 'retrieval_failure_rate '
    || CAST(CAST(round(retrieval_failure_rate * 100) AS BIGINT) AS VARCHAR) || '% above 5% ceiling' END],
  lambda x: x IS NOT NULL) AS alerts,
  (context_precision >= 0.85 AND context_recall >= 0.85 AND retrieval_failure_rate <= 0.05) AS healthy
FROM m""")
def a26(t):
    """Benchmark passages found verbatim in documents label the expected
    clause(s); retrieval over the whole corpus is scored against them."""
    q = bench_queries(t, per_scheme=False).withColumn("corpus_version", F.lit(ACTIVE))
    res = RT.retrieve(q, _parts(t))
    exp = RT.containing_docs(t.benchmark, t.documents).select(
        F.concat(F.col("item_id").cast("string"), F.lit(":*")).alias("query_id"),
        F.col("doc_id").alias("clause_id"))
    return RT.retrieval_quality(res, exp)


@register("R4_vector_topk", """WITH c AS (SELECT label, pos, avg(x) AS m FROM (
  SELECT label, unnest(range(1, len(embedding) + 1)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY ALL),
q AS (SELECT label AS query_id, label, list(m ORDER BY pos) AS embedding FROM c GROUP BY label),
it AS (SELECT vec_id AS item_id, label, embedding FROM embeddings),
sc AS (SELECT q.query_id, it.item_id,
         list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(it.embedding AS DOUBLE[]))
         / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))
            * sqrt(list_dot_product(CAST(it.embedding AS DOUBLE[]), CAST(it.embedding AS DOUBLE[])))) AS score
       FROM q JOIN it ON q.label = it.label),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM sc
      WHERE score >= 0.35)
SELECT q.query_id, CAST(r.rank AS BIGINT) AS rank, r.item_id, round_even(r.score, 4) AS score,
  r.item_id IS NULL AS retrieval_failed
FROM q LEFT JOIN (SELECT * FROM r WHERE rank <= 3) r ON q.query_id = r.query_id""")
def r4(t):
    """The mean vector of every label queries all vectors of that label (payload filter)."""
    e = t.embeddings
    c = e.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    c = c.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("v"))      # one vector per label
    q = c.select(F.col("label").alias("query_id"), "label", F.transform("v", lambda x: x.m).alias("embedding"))
    items = e.select(F.col("vec_id").alias("item_id"), "label", "embedding")
    return rounded(RT.vector_topk(q, items))


@register("R4_vector_topk_approx")
def r4_approx(t):
    """R4 through the stored hash buckets: every twentieth vector asked among the items of its label; ``recall`` is
    the share of the exact answer's items that were found, over all queries."""
    e = t.embeddings
    items = e.select(F.col("vec_id").alias("item_id"), "label", "embedding")
    q = e.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "label", "embedding")
    index = VX.VectorIndex(t.spark)
    index.build(items)
    found = materialize(index.search(q), "approx")
    exact = RT.vector_topk(q, items).where("NOT retrieval_failed").select("query_id", "item_id")
    hits = exact.join(found.select("query_id", "item_id", F.lit(1).alias("hit")), ["query_id", "item_id"], "left")
    recall = hits.agg((F.coalesce(F.sum("hit"), F.lit(0)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("recall"))       # one row
    return rounded(found.join(F.broadcast(recall)))


_NS = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


@register("F9_uuid5_id", f"""WITH c AS ({_CORPUS_BOTH}),
h AS (SELECT corpus_version, clause_id,
        substr(sha1(unhex('{_NS.replace('-', '')}') || encode(corpus_version || ':' || CAST(clause_id AS VARCHAR))), 1, 32)
          AS x FROM c)
SELECT corpus_version, clause_id,
  substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-5' || substr(x, 14, 3) || '-'
  || lower(printf('%x', ((('0x' || substr(x, 17, 1))::INTEGER) & 3) | 8)) || substr(x, 18, 3) || '-' || substr(x, 21, 12)
    AS point_id
FROM h""")
def f9(t):
    """deterministic point id of every (version, clause) pair."""
    c = corpus(t, (ACTIVE, OLD)).select("corpus_version", "clause_id")
    return RT.point_ids(c.withColumn("clause_id", F.col("clause_id")), _NS).select(
        "corpus_version", "clause_id", "point_id")


@register("R5_vector_index_upsert", f"""WITH c AS ({_CORPUS_BOTH})
SELECT corpus_version, clause_id, scheme, 2::INTEGER AS ingest_seq, text || ' (revised)' AS payload FROM c""")
def r5(t):
    """Indexing both versions twice, the second time with a revised payload,
    leaves one point per (version, clause), with the later payload."""
    c = RT.point_ids(corpus(t, (ACTIVE, OLD)).select("corpus_version", "clause_id", "scheme", F.col("text").alias("payload")), _NS)
    first = c.withColumn("ingest_seq", F.lit(1))
    once = RT.vector_upsert(first.limit(0), first)
    second = c.withColumn("payload", F.concat("payload", F.lit(" (revised)"))).withColumn("ingest_seq", F.lit(2))
    return RT.vector_upsert(once, second).select("corpus_version", "clause_id", "scheme", "ingest_seq", "payload")


@register("R5_stored_upsert")
def r5_stored(t):
    """R5 into a stored point table: both versions, then both again with a revised payload."""
    c = RT.point_ids(corpus(t, (ACTIVE, OLD)).select("corpus_version", "clause_id", "scheme", F.col("text").alias("payload")), _NS)
    table = KeyedTable(t.spark, fresh_scratch(t.spark, "points"), "point_id", "ingest_seq")
    table.upsert(c.withColumn("ingest_seq", F.lit(1)))
    table.upsert(c.withColumn("payload", F.concat("payload", F.lit(" (revised)"))).withColumn("ingest_seq", F.lit(2)))
    return table.read().select("corpus_version", "clause_id", "scheme", "ingest_seq", "payload")


ORACLES["R5_stored_upsert"] = ORACLES["R5_vector_index_upsert"]


@register("R6_retrieval_fallback", "WITH " + _index_sql(_CORPUS_ACTIVE) + _retrieve_sql(_Q_ALL) + """,
first AS (SELECT min(label) AS label FROM embeddings),
it AS (SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings JOIN first USING (label)),
vq AS (SELECT CAST(b.item_id AS VARCHAR) || ':*' AS query_id, CAST(e.embedding AS DOUBLE[]) AS v
       FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id JOIN first USING (label)),
vs AS (SELECT vq.query_id, it.item_id, list_dot_product(vq.v, it.v)
         / (sqrt(list_dot_product(vq.v, vq.v)) * sqrt(list_dot_product(it.v, it.v))) AS score FROM vq, it),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, item_id) AS rank FROM vs WHERE score >= 0.35)
SELECT query_id, rank, item_id AS clause_id, round_even(score, 4) AS score, false AS retrieval_failed, 'vector' AS backend
FROM vr WHERE rank <= 3
UNION ALL
SELECT query_id, rank, clause_id, score, retrieval_failed, 'tfidf' AS backend FROM res
WHERE query_id NOT IN (SELECT query_id FROM vr)""")
def r6(t):
    """The vector index holds the items of one label.  Benchmark queries whose own
    vector has that label are answered by it; all others fall back to TF-IDF."""
    q = bench_queries(t, per_scheme=False).withColumn("corpus_version", F.lit(ACTIVE))
    tf = RT.retrieve(q, _parts(t)).select("query_id", "rank", F.col("clause_id"), "score", "retrieval_failed")
    e = t.embeddings
    first = e.agg(F.min("label").alias("label"))                       # one row
    items = e.join(F.broadcast(first), "label").select(F.col("vec_id").alias("clause_id"), "label", "embedding")
    vectors = e.select(F.col("vec_id").alias("item_id"), "label", "embedding")
    vec = RT.vector_topk(q.select("query_id", "item_id").join(vectors, "item_id", "left"), items, key="clause_id")
    out = RT.with_fallback(vec, tf)
    return rounded(out.select("query_id", "rank", "clause_id", "score", "retrieval_failed", "backend"))


@register("F7_render_query", cte("v_applications") + """
SELECT application_id, 'loan amount ' || coalesce(CAST(amt_credit AS VARCHAR), 'None') || ' annual income '
  || coalesce(CAST(amt_income_total AS VARCHAR), 'None') || ' annuity ' || coalesce(CAST(amt_annuity AS VARCHAR), 'None')
  || ' employment days ' || coalesce(CAST(days_employed AS VARCHAR), 'None') || ' region rating '
  || coalesce(CAST(region_rating_client AS VARCHAR), 'None') AS query
FROM v_applications""")
def f7(t):
    a = t.view("v_applications")
    return a.select("application_id", RT.render_query(F.col("amt_credit"), F.col("amt_income_total"),
                                                      F.col("amt_annuity"), F.col("days_employed"),
                                                      F.col("region_rating_client")).alias("query"))
