"""More queries: reads of records and projections, work queues, caches and codecs. Registered with those of ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.functions import text as X
from stratalens.model import as_of
from stratalens.operators import adaptive, filters, fusion, governance, graph, history, jobs, metrics, projections, tags, vectors
from stratalens.queries import EDGES, FAM, FEED, HIST, LINKS, MEM, REC, VEC, VISIBLE, _pin, _pin_sql, _view, query
from stratalens.sources import store
from stratalens.sources import tables as T

_SPACES = "WITH st AS (SELECT 'N' || n_nationkey AS space_id, n_name AS space_key, 1 + n_regionkey AS valid_from, CASE WHEN n_nationkey % 4 = 0 THEN 3 + n_regionkey END AS valid_to, CASE WHEN n_nationkey % 6 = 5 THEN 'retired' ELSE 'active' END AS lifecycle FROM nation)"


def _space_states(spark, sf_dir) -> DataFrame:
    n = F.col("n_nationkey")
    return T.table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), n).alias("space_id"), F.col("n_name").alias("space_key"), (1 + F.col("n_regionkey")).cast("long").alias("valid_from"), F.when(n % 4 == 0, 3 + F.col("n_regionkey")).cast("long").alias("valid_to"), F.when(n % 6 == 5, "retired").otherwise("active").alias("lifecycle"))


@query(_SPACES + " SELECT space_id, space_key, lifecycle FROM st WHERE valid_from <= 4 AND (valid_to IS NULL OR 4 < valid_to)")
def space_list(spark, sf_dir):
    return as_of(_space_states(spark, sf_dir), 4).select("space_id", "space_key", "lifecycle")


@query(HIST + ", st AS (SELECT 'S' || (memory_id % 3) AS space_id, valid_to, CASE WHEN memory_id % 3 = 2 THEN 'retired' ELSE 'active' END AS lifecycle FROM hist) SELECT s AS space_id, EXISTS (SELECT 1 FROM st WHERE space_id = s AND valid_to IS NULL AND lifecycle = 'active') AS found FROM (VALUES ('S0'), ('S2'), ('S7')) AS v(s)")
def exists_active(spark, sf_dir):
    m = F.col("memory_id") % 3
    states = T.turn_history(spark, sf_dir).select(F.concat(F.lit("S"), m).alias("space_id"), "valid_to", F.when(m == 2, "retired").otherwise("active").alias("lifecycle"))
    return spark.createDataFrame([(s, history.exists_active(states, [s])) for s in ("S0", "S2", "S7")], "space_id string, found boolean")


@query("SELECT DISTINCT sha256(text) AS blob, text AS content FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en')")
def blob_put(spark, sf_dir):
    """Sources stored beside those of the English documents: only what isn't there, each once."""
    docs = T.table(spark, sf_dir, "documents")
    none = spark.createDataFrame([], "blob string, content string")
    return store.put_blobs(store.put_blobs(none, docs.where("lang = 'en'")), docs)


@query("SELECT DISTINCT sha256(text) AS blob FROM documents WHERE doc_id % 7 = 0 EXCEPT SELECT sha256(text) FROM documents WHERE doc_id % 7 <> 0")
def blob_corrupt(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents").withColumn("blob", F.sha2("text", 256))
    bad = docs.groupBy("blob").agg(F.every(F.col("doc_id") % 7 == 0).alias("bad"), F.first("text").alias("text"))
    return store.corrupt_blobs(bad.select("blob", F.when(F.col("bad"), F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("content")))


@query(REC + f" SELECT space_id, memory_id, row_number() OVER (ORDER BY memory_id, space_id) - 1 AS rank FROM (SELECT * FROM rec WHERE space_id IN ('en', 'fr') AND NOT retired AND NOT purged AND {VISIBLE.format(g=_pin_sql(8))} AND source = 'src2' ORDER BY space_id, memory_id, revision_id LIMIT 25)")
def exact_channel(spark, sf_dir):
    """The exact channel by itself: the first records in scan order, ranked by memory."""
    from stratalens.plans.engine import exact_channel as channel
    from stratalens.plans.query import Query

    found = channel(T.serving_records(spark, sf_dir), Query(spaces=("en", "fr"), tags=("src2",), max_results=25), _pin(spark, sf_dir, 8))
    return found.select("space_id", "memory_id", F.col("rank").cast("long"))


@query(VEC + " SELECT memory_id FROM vec WHERE space_id = 'L2' AND segment = 1")
def vector_filter(spark, sf_dir):
    return vectors.selected(T.vectors(spark, sf_dir), space_id="L2", segment=1, memory_id=None).select("memory_id")


# --- projections ---------------------------------------------------------------------------------


def _marked(spark, sf_dir) -> DataFrame:
    """Parts as documents with an entity, a state that addresses the reader, and a relation between them."""
    from stratalens.operators import markup

    ref = F.regexp_replace("p_type", r"\s", "-")
    text = F.concat(F.lit("# "), "p_name", F.lit('\n\n<Entity id="e" ref="type:'), ref, F.lit('">'), "p_type", F.lit('</Entity>\n<State id="s" kind="status">'), F.when(F.col("p_size") % 3 == 0, "as you know: ").otherwise(""), F.lit("size "), F.col("p_size").cast("string"), F.lit('</State>\n<Relation id="r" from="#e" to="#s" kind="supports" />\n'))
    return markup.compile_documents(T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("memory_id"), text.alias("text")))


@query("SELECT p_partkey AS memory_id, 'r' AS node_id, 'e' AS from_id, 's' AS to_id, 'supports' AS kind FROM part")
def projection_relations(spark, sf_dir):
    return projections.relations(_marked(spark, sf_dir), "memory_id")


@query("SELECT p_partkey AS memory_id, 's' AS node_id, 'you' AS words FROM part WHERE p_size % 3 = 0")
def reference_lint(spark, sf_dir):
    return projections.lint(_marked(spark, sf_dir), "memory_id").withColumn("words", F.array_join("words", ","))


_BODY = "'# ' || p_name || chr(10) || p_type || chr(10) || CASE WHEN p_size % 3 = 0 THEN 'as you know: ' ELSE '' END || 'size ' || p_size"


@query(f"SELECT p_partkey AS memory_id, sha256({_BODY}) AS context FROM part")
def context_embedding_text(spark, sf_dir):
    return _marked(spark, sf_dir).select("memory_id", F.sha2(projections.context_text(), 256).alias("context"))


def _parts_sql(domain: str, *parts: str) -> str:
    return f"sha256('{domain}|' || " + " || ".join(f"strlen({p}) || ':' || {p}" for p in parts) + ")"


_KEY = _parts_sql("projection-input-v1", "'ContextEmbedding'", "'1'", "'sig'", "text")


@query(f"SELECT doc_id, {_KEY} AS input_hash, {_parts_sql('embedding-v1', _KEY, chr(39) + 'local' + chr(39), chr(39) + 'hash' + chr(39), chr(39) + 'document' + chr(39), chr(39) + '64' + chr(39), chr(39) + 'True' + chr(39), chr(39) + '1' + chr(39))} AS cache_key FROM documents")
def embedding_keys(spark, sf_dir):
    """The hash of a projection's input, and the key of its embedding."""
    key = projections.input_hash("ContextEmbedding", 1, "sig", F.col("text"))
    return T.table(spark, sf_dir, "documents").select("doc_id", key.alias("input_hash"), projections.embedding_key(key, "local", "hash", "document", 64, True, 1).alias("cache_key"))


@query(r"SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('<!-- a' || chr(10) || 'b -->' || html || chr(13) || chr(10) || '  ' || chr(10) || chr(10) || chr(10), '<!--.*?-->', '', 'gs'), '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '\n+$', '')) AS plain FROM pages WHERE NOT starts_with(html, chr(10))")
def canonical_text(spark, sf_dir):
    """Comments, white space at line ends and repeated empty lines gone."""
    whole = F.concat(F.lit("<!-- a\nb -->"), "html", F.lit("\r\n  \n\n\n"))
    return T.table(spark, sf_dir, "pages").where(~F.col("html").startswith("\n")).select("page_id", F.sha2(X.canonical_text(whole), 256).alias("plain"))


@query("SELECT DISTINCT 'type:' || regexp_replace(p_type, '\\s', '-', 'g') AS entity_ref FROM part WHERE p_type = (SELECT min(p_type) FROM part) AND p_size % 5 IN (0, 2)")
def entity_discovery(spark, sf_dir):
    """Entities seen under a surface, in allowed spaces only."""
    part = T.table(spark, sf_dir, "part")
    seen = part.select(F.concat(F.lit("S"), F.col("p_size") % 5).alias("space_id"), F.col("p_type").alias("surface"), F.concat(F.lit("type:"), F.regexp_replace("p_type", r"\s", "-")).alias("entity_ref"))
    return governance.discover_entities(seen, part.agg(F.min("p_type")).first()[0], ["S0", "S2"])


# --- evidence and propagation --------------------------------------------------------------------


@query("SELECT p_partkey, (p_size % 3) + 0.5 * (p_size % 2 + p_partkey % 4) + 0.25 * (p_partkey % 5 + p_size % 7 + p_partkey % 2) AS strength FROM part")
def evidence_strength(spark, sf_dir):
    k, z = F.col("p_partkey"), F.col("p_size")
    counts = {"exact": z % 3, "lexical": z % 2, "semantic": k % 4, "tags": k % 5, "relations": z % 7, "history": k % 2}
    rows = T.table(spark, sf_dir, "part").select("p_partkey", *(c.alias(f"n_{n}") for n, c in counts.items()))
    return rows.select("p_partkey", fusion.evidence_strength().cast("double").alias("strength"))


@query("SELECT p_partkey, array_to_string(string_split(p_name, ' ')[1:3], ',') AS words, array_to_string(string_split(p_type, ' ')[1:greatest(3 - len(string_split(p_name, ' ')), 0)], ',') AS kinds FROM part")
def evidence_trim(spark, sf_dir):
    """Three items across two lists."""
    rows = T.table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("words"), F.split("p_type", " ").alias("kinds"))
    kept = fusion.trim_evidence(rows, ["words", "kinds"], 3)
    return kept.select("p_partkey", F.array_join("words", ",").alias("words"), F.array_join("kinds", ",").alias("kinds"))


@query(
    EDGES
    + """, h0 AS (SELECT * FROM (VALUES ('red', 1.0), ('economy', 0.55)) AS v(tag, score)), h1 AS (SELECT dst AS tag, max(score * signal * 0.5) AS score FROM h0 JOIN both_ways ON src = tag WHERE score * signal * 0.5 > 1e-6 GROUP BY dst),
act AS (SELECT tag, max(score) AS s FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1) GROUP BY tag)
SELECT space_id, memory_id, tag, round(s * r, 6) AS score FROM (SELECT t.space_id, t.memory_id, t.tag, s, CASE provenance WHEN 'explicit' THEN 0.95 ELSE 0.55 END AS r FROM tagged t JOIN act USING (tag) WHERE space_id IN ('S0', 'S1') ORDER BY r DESC, space_id, memory_id, tag_id LIMIT 96)"""
)
def propagation_readout(spark, sf_dir):
    """Memories of the tags that activation has reached in one hop."""
    active = graph.activation(tags.both_ways(_view(spark, sf_dir)), {"red": 1.0, "economy": 0.55}, 1)
    return graph.propagation_readout(T.tag_memberships(spark, sf_dir), active, ["S0", "S1"], 96).withColumn("score", F.round("score", 6))


@query("WITH r AS (SELECT c_custkey AS m, c_custkey * 7 % 2000 AS t FROM customer) SELECT m AS source, m AS target, 'supports' AS kind FROM r UNION ALL SELECT m, t, 'references' FROM r WHERE t IN (SELECT m FROM r)")
def relation_links(spark, sf_dir):
    from stratalens.queries import _referring

    return graph.relation_links(_referring(spark, sf_dir))


@query(LINKS + ", s AS (SELECT 'O' || o_orderkey AS target FROM orders WHERE o_orderpriority = '2-HIGH'), new AS (SELECT DISTINCT l.target FROM s JOIN links l ON l.source = s.target) SELECT target, 0 AS hops FROM s UNION ALL SELECT * FROM (SELECT target, 1 FROM new ORDER BY target LIMIT 20)")
def relation_expansion_bounded(spark, sf_dir):
    """One hop, with a bound on what is added."""
    starts = T.table(spark, sf_dir, "orders").where("o_orderpriority = '2-HIGH'").select(F.concat(F.lit("O"), "o_orderkey").alias("target"))
    return graph.expand_relations(T.place_links(spark, sf_dir), starts, 1, 20).select("target", "hops")


@query(MEM + " SELECT DISTINCT tag FROM tagged WHERE tag IN ('red', 'economy', 'blue')")
def tag_dictionary_lookup(spark, sf_dir):
    return tags.dictionary(T.tag_memberships(spark, sf_dir)).where(F.col("tag").isin("red", "economy", "blue")).select("tag")


# --- feedback ------------------------------------------------------------------------------------


@query(FAM + " SELECT space_id, memory_id, positive_count, negative_count, CAST(positive_weight AS DOUBLE) AS positive_weight, last_success FROM fam")
def familiarity_merged(spark, sf_dir):
    """The state of a prefix and that of the rest, as one."""
    rows = T.feedback(spark, sf_dir)
    early = F.col("event_id") % 10 < 7
    return adaptive.merge_states(adaptive.familiarity(rows.where(early)), adaptive.familiarity(rows.where(~early)))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark, sf_dir):
    from stratalens.streaming.feedback import windowed_counts as counts

    return counts(T.table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


# --- work ----------------------------------------------------------------------------------------

_JOBS = "WITH j AS (SELECT o_orderkey AS job, 'S' || (o_custkey % 3) AS space_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'running' ELSE 'succeeded' END AS state, CASE WHEN o_custkey % 4 = 0 THEN o_custkey END AS not_before FROM orders)"


def _jobs(spark, sf_dir) -> DataFrame:
    c = F.col("o_custkey")
    state = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "running").otherwise("succeeded")
    return T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), F.concat(F.lit("S"), c % 3).alias("space_id"), state.alias("state"), F.when(c % 4 == 0, c).alias("not_before"))


@query(_JOBS + ", t AS (SELECT job FROM j WHERE state = 'queued' AND coalesce(not_before, 0) <= 50 AND space_id <> 'S1' ORDER BY coalesce(not_before, 0), job LIMIT 40) SELECT job, CASE WHEN t.job IS NOT NULL THEN 'running' ELSE state END AS state, CASE WHEN t.job IS NOT NULL THEN 'w1' END AS worker FROM j LEFT JOIN t USING (job)")
def job_claim(spark, sf_dir):
    """The next jobs of a queue given to a worker, none of a space whose policy forbids it."""
    denied = spark.createDataFrame([("S1",)], "space_id string")
    return jobs.claimed(_jobs(spark, sf_dir), "w1", 50, 40, denied).select("job", "state", "worker")


@query(_JOBS + " SELECT job, CASE state WHEN 'running' THEN 'queued' ELSE state END AS state FROM j")
def job_reopen(spark, sf_dir):
    return jobs.reopened(_jobs(spark, sf_dir)).select("job", "state")


@query("SELECT p_partkey AS memory_id, CASE WHEN p_size % 3 = 0 OR p_partkey % 10 = 0 THEN 'superseded' ELSE 'succeeded' END AS state FROM part")
def job_superseded(spark, sf_dir):
    """Results whose input is no longer the head's."""
    part = T.table(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("memory_id"), F.sha2("p_name", 256).alias("input_hash"), F.lit("succeeded").alias("state"))
    heads = part.where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("memory_id"), F.when(F.col("p_size") % 3 == 0, "other").otherwise(F.sha2("p_name", 256)).alias("input_hash"))
    return jobs.superseded(rows, heads).select("memory_id", "state")


@query("SELECT doc_id, sha256(text) AS input_hash, CASE WHEN sha256(text) IN (SELECT sha256(text) FROM documents WHERE source = 'src1') THEN 'kept' END AS payload FROM documents")
def embedding_reuse(spark, sf_dir):
    """What is computed for an input already isn't computed again."""
    docs = T.table(spark, sf_dir, "documents").withColumn("input_hash", F.sha2("text", 256))
    have = docs.where("source = 'src1'").select("input_hash", F.lit("kept").alias("payload"))
    return jobs.reusable(docs.select("doc_id", "input_hash"), have)


@query("SELECT p_partkey AS memory_id, array_to_string(list_sort(list_distinct(CASE WHEN p_size % 2 = 0 THEN [p_brand, 'found', p_type] ELSE [p_brand] END)), ',') AS tags FROM part")
def enrichment_publish(spark, sf_dir):
    """Tags found in the background reach the records whose head is still the one they were found for."""
    part = T.table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "memory_id").withColumn("input_hash", F.sha2("p_name", 256))
    results = part.select("memory_id", "input_hash", F.array(F.lit("found"), "p_type").alias("tags"))
    heads = part.select("memory_id", F.when(F.col("p_size") % 2 == 0, F.col("input_hash")).otherwise("moved on").alias("input_hash"))
    out = jobs.published(results, heads, part.select("memory_id", F.array("p_brand").alias("tags")))
    return out.select("memory_id", F.array_join(F.array_sort("tags"), ",").alias("tags"))


@query("SELECT s_suppkey AS manifest, 'h' || (s_suppkey % 3) AS holder, CASE WHEN s_suppkey % 3 = 1 THEN 100 + 60 ELSE 50 + s_suppkey * 7 % 200 END AS expires_at FROM supplier WHERE 50 + s_suppkey * 7 % 200 > 100 AND s_suppkey % 3 <> 2 UNION ALL SELECT 999999, 'h9', 130")
def manifest_leases(spark, sf_dir):
    """Leases after one holder has renewed, one has let go and one has come; those that had run out are gone."""
    k = F.col("s_suppkey")
    leases = T.table(spark, sf_dir, "supplier").select(k.alias("manifest"), F.concat(F.lit("h"), k % 3).alias("holder"), (50 + k * 7 % 200).alias("expires_at"))
    return jobs.acquire(jobs.release(jobs.renew(leases, "h1", 100, 60), "h2"), 999_999, "h9", 100, 30)


@query("WITH c AS (SELECT event_id AS key, epoch_us(ts) AS used_at, event_id % 100 AS expires_at FROM events) SELECT key FROM c WHERE expires_at > 40 ORDER BY used_at DESC, key LIMIT 256")
def ttl_cache(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("used_at"), (F.col("event_id") % 100).alias("expires_at"))
    return jobs.cached(e, 40, 256).select("key")


@query("SELECT doc_id AS memory_id FROM documents WHERE lang = 'fr'")
def package_duplicates(spark, sf_dir):
    """Identifiers that a package has twice."""
    r = T.serving_records(spark, sf_dir)
    return governance.duplicate_ids(r.unionByName(r.where("space_id = 'fr'")))


@query(REC + " SELECT space_id, memory_id, revision_id, sha256(text) AS content, retired FROM rec WHERE space_id IN ('de', 'fr')")
def package_roundtrip(spark, sf_dir):
    """The records of two spaces, written as a package and read again."""
    from stratalens.sources import package

    path = store.working_path(spark, "package")
    package.write_package(T.serving_records(spark, sf_dir), path, ["de", "fr"])
    return package.read_package(spark, path).select("space_id", "memory_id", "revision_id", F.sha2("text", 256).alias("content"), "retired")


@query("""SELECT p_partkey AS memory_id, '<MemoryRef ref="' || CASE WHEN p_size % 4 = 0 THEN 'x' || (p_partkey + 1) ELSE 'n' || (p_partkey + 1) END || '" /> `<MemoryRef ref="x1" />`' AS text, CASE WHEN p_size % 4 = 0 THEN 'x' || (p_partkey + 1) ELSE '' END AS unknown FROM part""")
def reference_rewrite(spark, sf_dir):
    """References of documents under new ids, in parsed elements alone; those without one are told."""
    from stratalens.operators import markup

    k = F.col("p_partkey")
    docs = T.table(spark, sf_dir, "part").select(k.alias("memory_id"), F.concat(F.lit('<MemoryRef ref="'), F.when(F.col("p_size") % 4 == 0, "x").otherwise("o"), (k + 1).cast("string"), F.lit('" /> `<MemoryRef ref="x1" />`')).alias("text"))
    ids = spark.range(0, 10).limit(0).selectExpr("'' AS old", "'' AS new").unionByName(T.table(spark, sf_dir, "part").select(F.concat(F.lit("o"), (k + 1).cast("string")).alias("old"), F.concat(F.lit("n"), (k + 1).cast("string")).alias("new")))
    return markup.rewrite_all(docs, ids, "memory_id").withColumn("unknown", F.array_join("unknown", ","))


@query(HIST + """, st AS (SELECT memory_id, 'S' || (memory_id % 3) AS space_id, 'k' || memory_id AS document_key, revision_id, 'active' AS lifecycle, valid_from, valid_to FROM hist), head AS (SELECT * FROM st WHERE valid_to IS NULL)
SELECT memory_id, space_id, lifecycle, revision_id, valid_from, CASE WHEN valid_to IS NULL AND memory_id IN (1, 2, 3) THEN 90 ELSE valid_to END AS valid_to FROM st
UNION ALL SELECT memory_id, 'S9', lifecycle, revision_id, 90, NULL FROM head WHERE memory_id = 1
UNION ALL SELECT memory_id, space_id, 'retired', revision_id, 90, NULL FROM head WHERE memory_id = 2
UNION ALL SELECT memory_id, space_id, lifecycle, 'merged', 90, NULL FROM head WHERE memory_id = 3""")
def history_changes(spark, sf_dir):
    """A move, a retirement and a merge of two revisions, in one generation."""
    h = T.turn_history(spark, sf_dir)
    states = h.select("memory_id", F.concat(F.lit("S"), F.col("memory_id") % 3).alias("space_id"), F.concat(F.lit("k"), "memory_id").alias("document_key"), "revision_id", F.lit("active").alias("lifecycle"), F.col("valid_from").cast("long").alias("valid_from"), F.col("valid_to").cast("long").alias("valid_to"))
    own = [r.revision_id for r in h.where("memory_id = 3").orderBy(F.desc("turn")).limit(2).collect()]
    changed = history.apply_batch(states, [("move", 1, "S9"), ("retire", 2)], 90)
    if len(own) == 2:
        none = spark.createDataFrame([], "revision_id string, parent_id string")
        changed, _ = history.merge(changed, none, h, 3, own, "merged", 90)
    return changed.select("memory_id", "space_id", "lifecycle", "revision_id", "valid_from", "valid_to")


@query("SELECT 'many' AS name, TRUE AS due UNION ALL SELECT 'few', FALSE UNION ALL SELECT 'dead', TRUE")
def segment_compaction(spark, sf_dir):
    """Whether segments are to be compacted: too many of them, or too many dead rows."""
    rows = T.table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 12).alias("segment"))
    few, n = rows.where("segment < 3"), rows.count()
    return spark.createDataFrame([("many", vectors.needs_compaction(rows, 0)), ("few", vectors.needs_compaction(few, 0)), ("dead", vectors.needs_compaction(few, n))], "name string, due boolean")


# --- codecs and gates ----------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS back, 4 + 52 AS size FROM documents")
def id_codec(spark, sf_dir):
    """Identifiers in base 32, and back."""
    rows = T.table(spark, sf_dir, "documents").select("doc_id", X.identifier("rev_", F.sha2("text", 256)).alias("id"))
    return rows.select("doc_id", F.substring(X.from_base32(F.substring("id", 5, 100)), 1, 64).alias("back"), F.length("id").alias("size"))


@query("SELECT c_custkey, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(c_name, ''), lambda c: ord(c)::BIGINT)), lambda h, c: ((xor(h, c)::HUGEINT * 16777619) % 4294967296)::BIGINT) AS hash FROM customer")
def fnv1a_hash(spark, sf_dir):
    return T.table(spark, sf_dir, "customer").select("c_custkey", X.fnv1a32(F.col("c_name")).alias("hash"))


@query("WITH b AS (SELECT quality, avg(n_chars) AS m FROM documents JOIN labels USING (doc_id) GROUP BY quality), z AS (SELECT m AS m0 FROM b WHERE quality = 0) SELECT quality, CASE WHEN m < m0 THEN 'ndcg gain,ndcg loss' ELSE '' END || CASE WHEN m > 2 * m0 THEN 'p95' ELSE '' END AS failed FROM b, z")
def acceptance_gate(spark, sf_dir):
    """Which tests each candidate fails against the baseline."""
    rows = T.table(spark, sf_dir, "documents").join(T.table(spark, sf_dir, "labels"), "doc_id").groupBy("quality").agg(F.avg("n_chars").alias("m")).collect()  # a row for each grade
    of = {r.quality: {"recall": 0.5, "ndcg": r.m, "p95": r.m} for r in rows}
    return spark.createDataFrame([(q, ",".join(metrics.accept(of[0], c))) for q, c in of.items()], "quality int, failed string")


@query(REC + f" SELECT memory_id FROM rec WHERE space_id IN ('de', 'es') AND NOT retired AND NOT purged AND {VISIBLE.format(g=_pin_sql(10))} AND size_tag = 'size-2'")
def semantic_match(spark, sf_dir):
    rows = T.serving_records(spark, sf_dir).withColumn("score", F.when(F.col("memory_id") % 3 >= 0, 0.5))
    return rows.where(filters.semantic_match(["de", "es"], _pin(spark, sf_dir, 10), tags=["size-2"])).select("memory_id")
