"""The library's queries over the driver's tables, each with DuckDB SQL that must agree where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.functions import scores as S
from stratalens.functions import text as X
from stratalens.functions.temporal import partial_date, temporal_key
from stratalens.model import as_of, overlaps
from stratalens.operators import filters, fusion, graph, history, lexical, tags, vectors
from stratalens.operators.ranking import ranked, ranked_whole, top_per_group
from stratalens.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


#: Serving records in SQL.
REC = """WITH rec AS (
  SELECT d.lang AS space_id, d.doc_id AS memory_id, sha256(d.text) AS revision_id, d.text, d.source, 'source:' || d.source AS entity,
         'size-' || (d.n_chars % 7) AS size_tag, coalesce(l.toxic, 0) = 1 AS retired, d.doc_id % 97 = 0 AS purged, d.doc_id + 1 AS generation,
         CASE WHEN d.doc_id % 13 = 0 THEN d.doc_id + 500 END AS valid_until
  FROM documents d LEFT JOIN labels l USING (doc_id)
)"""
VISIBLE = "generation <= {g} AND (valid_until IS NULL OR {g} < valid_until)"


def _pin_sql(tenths: int) -> str:
    return f"(SELECT (max(doc_id) + 1) * {tenths} // 10 FROM documents)"


def _pin(spark, sf_dir, tenths: int) -> int:
    """A generation to read at: so many tenths of the newest one."""
    return (T.table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0] + 1) * tenths // 10


HIST = """WITH hist AS (
  SELECT conv_id AS memory_id, turn, role, text, turn + 1 AS valid_from, lead(turn + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS valid_to, conv_id || ':' || turn AS revision_id
  FROM conversations
)"""
MEM = """WITH mem AS (
  SELECT DISTINCT 'S' || (p_size % 5) AS space_id, p_partkey AS memory_id, w AS tag, 'explicit' AS provenance FROM part, unnest(string_split(p_name, ' ')) AS u(w)
  UNION SELECT 'S' || (p_size % 5), p_partkey, lower(p_type), 'generated' FROM part
  UNION SELECT 'S' || (p_size % 5), p_partkey, lower(p_brand), 'generated' FROM part
), tagged AS (SELECT *, sha256('tag-v1|' || format('{:016X}', strlen(tag)) || tag) AS tag_id FROM mem)"""
EDGES = (
    MEM
    + """, pairs AS (
  SELECT a.space_id, a.tag AS l, b.tag AS r, a.tag_id AS lid, b.tag_id AS rid, a.provenance
  FROM tagged a JOIN tagged b ON a.space_id = b.space_id AND a.memory_id = b.memory_id AND a.provenance = b.provenance AND a.tag_id < b.tag_id
), edges AS (
  SELECT space_id, l AS "left", r AS "right", lid, rid, count(*) FILTER (WHERE provenance = 'explicit') AS explicit, count(*) FILTER (WHERE provenance = 'generated') AS generated
  FROM pairs GROUP BY ALL
), comp AS (
  SELECT "left", "right", lid, rid, sum(explicit) AS explicit, sum(generated) AS generated, sum(explicit) + 0.5 * sum(generated) AS weight
  FROM edges WHERE space_id IN ('S0', 'S1', 'S2') GROUP BY ALL
), both_ways AS (
  SELECT "left" AS src, "right" AS dst, weight / (1 + weight) AS signal FROM comp UNION ALL SELECT "right", "left", weight / (1 + weight) FROM comp
)"""
)
SCOPE = ["S0", "S1", "S2"]
VEC = """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), vec AS (
  SELECT 'L' || label AS space_id, vec_id AS memory_id, vec_id % 3 AS segment, embedding FROM embeddings
), sc AS (
  SELECT space_id, memory_id, segment, list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[]))) AS score FROM vec, q
)"""
FEED = """WITH fb AS (
  SELECT event_id, 'S' || (user_id % 4) AS space_id, user_id AS memory_id, epoch_us(ts) AS micros, 'k' || json_extract_string(props, '$.k') AS tag,
         CASE event_type WHEN 'purchase' THEN 'used' WHEN 'click' THEN 'correct_for_query' WHEN 'signup' THEN 'sufficient' WHEN 'error' THEN 'rejected' END AS outcome,
         CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 1.0 WHEN 'signup' THEN 0.5 WHEN 'error' THEN -1.0 END AS w
  FROM events WHERE event_type <> 'view'
)"""
LINKS = """WITH links AS (
  SELECT 'C' || c_custkey AS source, 'N' || c_nationkey AS target, 'located-in' AS kind FROM customer
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'part-of' FROM nation
  UNION ALL SELECT 'O' || o_orderkey, 'C' || o_custkey, 'references' FROM orders
)"""
_CASE = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in T.table(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding]


# --- filters and reads ---------------------------------------------------------------------------


@query(REC + " SELECT space_id, memory_id, generation FROM rec WHERE space_id IN ('en', 'de')")
def scope_filter(spark, sf_dir):
    return T.serving_records(spark, sf_dir).where(filters.in_scope(["en", "de"])).select("space_id", "memory_id", "generation")


@query(REC + f" SELECT space_id, memory_id, revision_id FROM rec WHERE space_id IN ('en', 'fr') AND NOT retired AND NOT purged AND {VISIBLE.format(g=_pin_sql(7))} AND entity = 'source:src1'")
def exact_match_all_entities(spark, sf_dir):
    return T.serving_records(spark, sf_dir).where(filters.exact_match(["en", "fr"], _pin(spark, sf_dir, 7), entities=["source:src1"])).select("space_id", "memory_id", "revision_id")


@query(REC + f" SELECT memory_id FROM rec WHERE space_id = 'en' AND NOT retired AND NOT purged AND {VISIBLE.format(g=_pin_sql(9))} AND source = 'src2' AND size_tag = 'size-3'")
def exact_match_all_tags(spark, sf_dir):
    return T.serving_records(spark, sf_dir).where(filters.exact_match(["en"], _pin(spark, sf_dir, 9), tags=["src2", "size-3"])).select("memory_id")


@query(REC + f" SELECT space_id, count(*) AS n, max(generation) AS newest FROM rec WHERE {VISIBLE.format(g=_pin_sql(6))} GROUP BY space_id")
def visible_at_generation(spark, sf_dir):
    from stratalens.model import visible_at

    return T.serving_records(spark, sf_dir).where(visible_at(F.col("generation"), F.col("valid_until"), _pin(spark, sf_dir, 6))).groupBy("space_id").agg(F.count(F.lit(1)).alias("n"), F.max("generation").alias("newest"))


@query(REC + " SELECT space_id, count(*) FILTER (WHERE NOT retired AND NOT purged) AS active, count(*) FILTER (WHERE retired) AS retired FROM rec GROUP BY space_id")
def lifecycle_active(spark, sf_dir):
    return T.serving_records(spark, sf_dir).groupBy("space_id").agg(F.count_if(~F.col("retired") & ~F.col("purged")).alias("active"), F.count_if("retired").alias("retired"))


@query(REC + f" SELECT memory_id, revision_id FROM rec WHERE space_id IN ('en', 'de', 'fr', 'es') AND NOT retired AND NOT purged AND {VISIBLE.format(g=_pin_sql(5))} AND memory_id IN (3, 5, 8, 13, 21, 34)")
def memory_reference_any(spark, sf_dir):
    refs = [(i, None) for i in (3, 5, 8, 13, 21, 34)]
    return T.serving_records(spark, sf_dir).where(filters.exact_match(["en", "de", "fr", "es"], _pin(spark, sf_dir, 5), refs)).select("memory_id", "revision_id")


@query(REC + " SELECT memory_id FROM rec WHERE memory_id = 3 AND memory_id = 5")
def all_memories_quirk(spark, sf_dir):
    """Two different required memories leave nothing."""
    return T.serving_records(spark, sf_dir).where(filters.all_memories([3, 5])).select("memory_id")


@query(REC + f" SELECT memory_id FROM rec WHERE space_id IN ('en', 'de') AND NOT retired AND (contains({_CASE}, 'licensed under') OR contains({_CASE}, 'die in '))")
def ascii_contains_any(spark, sf_dir):
    return T.serving_records(spark, sf_dir).where(filters.lexical_match(["en", "de"], ["Licensed UNDER", "DIE in "])).select("memory_id")


@query(REC + f" SELECT memory_id, generation FROM rec WHERE space_id IN ('en', 'es') AND NOT purged AND generation <= {_pin_sql(8)} AND contains({_CASE}, 'the ')")
def history_match(spark, sf_dir):
    return T.serving_records(spark, sf_dir).where(filters.history_match(["en", "es"], _pin(spark, sf_dir, 8), ["THE "])).select("memory_id", "generation")


@query(HIST + " SELECT memory_id, revision_id, role FROM hist WHERE valid_from <= 3 AND (valid_to IS NULL OR 3 < valid_to)")
def as_of_state(spark, sf_dir):
    return as_of(T.turn_history(spark, sf_dir), 3).select("memory_id", "revision_id", "role")


@query(HIST + " SELECT memory_id, max(valid_from) AS generation, arg_max(revision_id, valid_from) AS revision_id FROM hist WHERE valid_from <= 2 GROUP BY memory_id")
def logical_ref_latest(spark, sf_dir):
    return history.resolve_logical(T.turn_history(spark, sf_dir), 2)


@query(HIST + " SELECT memory_id, role, sha256(text) AS blob FROM hist WHERE revision_id IN ('1:0', '2:1', '3:1')")
def revision_ref(spark, sf_dir):
    return T.turn_history(spark, sf_dir).where(F.col("revision_id").isin("1:0", "2:1", "3:1")).select("memory_id", "role", F.sha2("text", 256).alias("blob"))


@query(HIST + " SELECT memory_id, revision_id, valid_from FROM hist WHERE valid_from <= 4 ORDER BY valid_from DESC, memory_id, revision_id LIMIT 25")
def history_all_revisions(spark, sf_dir):
    return history.listing(T.turn_history(spark, sf_dir), 4, 25).select("memory_id", "revision_id", "valid_from")


@query(HIST + ", bent AS (SELECT *, CASE WHEN memory_id % 5 = 0 THEN valid_to + 1 ELSE valid_to END AS e FROM hist) SELECT DISTINCT a.memory_id, a.revision_id FROM bent a JOIN bent b ON a.memory_id = b.memory_id AND b.valid_from < a.valid_from AND (b.e IS NULL OR b.e > a.valid_from)")
def interval_overlap_check(spark, sf_dir):
    bent = T.turn_history(spark, sf_dir).withColumn("valid_to", F.when(F.col("memory_id") % 5 == 0, F.col("valid_to") + 1).otherwise(F.col("valid_to")))
    return overlaps(bent, ["memory_id"]).select("memory_id", "revision_id")


@query(HIST + " SELECT memory_id, count(*) AS open FROM (SELECT memory_id, CASE WHEN memory_id % 7 = 0 THEN NULL ELSE valid_to END AS e FROM hist) WHERE e IS NULL GROUP BY memory_id HAVING count(*) <> 1")
def current_unique_check(spark, sf_dir):
    bent = T.turn_history(spark, sf_dir).withColumn("valid_to", F.when(F.col("memory_id") % 7 == 0, None).otherwise(F.col("valid_to")))
    return bent.where("valid_to is null").groupBy("memory_id").agg(F.count(F.lit(1)).alias("open")).where("open <> 1")


@query(
    HIST
    + """, st AS (SELECT memory_id, 'S' || (memory_id % 3) AS space_id, valid_from, valid_to, revision_id FROM hist), ch AS (SELECT DISTINCT memory_id FROM st WHERE memory_id % 4 = 0)
SELECT st.memory_id, space_id, revision_id, valid_from, CASE WHEN ch.memory_id IS NOT NULL AND valid_to IS NULL THEN 50 ELSE valid_to END AS valid_to FROM st LEFT JOIN ch USING (memory_id)
UNION ALL SELECT memory_id, 'S9', revision_id, 50, NULL FROM st JOIN ch USING (memory_id) WHERE valid_to IS NULL"""
)
def interval_versioning(spark, sf_dir):
    states = T.turn_history(spark, sf_dir).select("memory_id", F.concat(F.lit("S"), F.col("memory_id") % 3).alias("space_id"), "valid_from", "valid_to", "revision_id")
    moves = states.where("memory_id % 4 = 0").select("memory_id", F.lit("S9").alias("space_id")).distinct()
    return history.change(states, moves, 50, ["memory_id"], ["space_id"]).select("memory_id", "space_id", "revision_id", "valid_from", "valid_to")


@query("SELECT sha256(text) AS blob, count(*) AS uses, min(doc_id) AS first_user FROM documents GROUP BY 1")
def blob_dedup(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents")
    return docs.groupBy(F.sha2("text", 256).alias("blob")).agg(F.count(F.lit(1)).alias("uses"), F.min("doc_id").alias("first_user"))


@query(f"SELECT DISTINCT sha256(text) AS blob FROM documents WHERE doc_id + 1 <= {_pin_sql(3)}")
def distinct_blobs_at_generation(spark, sf_dir):
    return T.serving_records(spark, sf_dir).where(F.col("generation") <= _pin(spark, sf_dir, 3)).select(F.col("revision_id").alias("blob")).distinct()


# --- text and hashes -----------------------------------------------------------------------------


@query("SELECT c_custkey, lower(trim(regexp_replace('  ' || c_name || chr(9) || ' ÉTÉ  ' || c_mktsegment || ' ', '\\s+', ' ', 'g'))) AS tag FROM customer")
def normalize_tag(spark, sf_dir):
    raw = F.concat(F.lit("  "), "c_name", F.lit("\t ÉTÉ  "), "c_mktsegment", F.lit(" "))
    return T.table(spark, sf_dir, "customer").select("c_custkey", X.normalize_tag(raw).alias("tag"))


@query("SELECT doc_id, sha256(array_to_string(list_filter(string_split('# ' || source || chr(10) || text || chr(10) || '  ###', chr(10)), lambda x: NOT regexp_matches(trim(x), '^#{1,6}( |$)')), chr(10))) AS kept FROM documents")
def heading_strip(spark, sf_dir):
    whole = F.concat(F.lit("# "), "source", F.lit("\n"), "text", F.lit("\n  ###"))
    return T.table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.without_headings(whole), 256).alias("kept"))


@query("SELECT page_id, sha256(CASE WHEN regexp_matches(html, '[<>]') THEN array_to_string(list_filter(string_split(html, chr(10)), lambda x: NOT regexp_matches(x, '[<>]')), chr(10)) ELSE html END) AS kept FROM pages")
def rerank_text_sanitize(spark, sf_dir):
    return T.table(spark, sf_dir, "pages").select("page_id", F.sha2(X.without_marked_lines(F.col("html")), 256).alias("kept"))


_TOK = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: len(x) > 0 AND strlen(x) < 40)"


@query(f"SELECT doc_id, len({_TOK}) AS tokens, len(list_distinct({_TOK})) AS terms FROM documents")
def tokenize_counts(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", F.size(X.tokens(F.col("text"))).cast("long").alias("tokens"), F.size(F.array_distinct(X.tokens(F.col("text")))).cast("long").alias("terms"))


@query("""SELECT p_partkey, '# ' || p_name || chr(10) || chr(10) || '<Tag value="' || replace(replace(p_brand || ' & "' || p_type || '"', '&', '&amp;'), '"', '&quot;') || '" />' || chr(10) || chr(10) || 'size ' || p_size || chr(10) AS document FROM part""")
def serialize_document(spark, sf_dir):
    tag = F.concat("p_brand", F.lit(' & "'), "p_type", F.lit('"'))
    return T.table(spark, sf_dir, "part").select("p_partkey", X.serialize_document(F.col("p_name"), F.array(tag), F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("document"))


@query("SELECT conv_id, turn, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS collapsed FROM conversations")
def whitespace_collapse(spark, sf_dir):
    return T.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(X.collapse_space(F.col("text")), 256).alias("collapsed"))


@query("SELECT doc_id, sha256('state-v1|' || strlen(lang) || ':' || lang || strlen(text) || ':' || text) AS fingerprint FROM documents")
def semantic_fingerprint(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", X.fingerprint("state-v1", F.col("lang"), F.col("text")).alias("fingerprint"))


@query(MEM + " SELECT DISTINCT tag, tag_id FROM tagged")
def tag_id_hash(spark, sf_dir):
    return tags.dictionary(T.tag_memberships(spark, sf_dir))


@query("SELECT item_id, 'item:' || strlen(text) || ':' || substr(sha256(text), 1, 16) AS shown FROM benchmark")
def redacted_diagnostic(spark, sf_dir):
    return T.table(spark, sf_dir, "benchmark").select("item_id", X.redacted("item", F.col("text")).alias("shown"))


@query("SELECT page_id, sha256(array_to_string(list_filter([url, '', html], lambda x: x <> ''), chr(10))) AS view FROM pages")
def rerank_view(spark, sf_dir):
    return T.table(spark, sf_dir, "pages").select("page_id", F.sha2(X.joined_view(F.col("url"), F.lit(""), F.col("html")), 256).alias("view"))


_D = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '2023-02-30' END"


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN year(o_orderdate) END AS y, CASE WHEN o_orderkey % 4 IN (1, 2) THEN month(o_orderdate) WHEN o_orderkey % 4 = 0 THEN 1 END AS m, CASE o_orderkey % 4 WHEN 2 THEN day(o_orderdate) WHEN 3 THEN NULL ELSE 1 END AS d FROM orders")
def partial_dates(spark, sf_dir):
    orders = T.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.date_format("o_orderdate", "yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM")).when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("2023-02-30")
    rows = orders.select("o_orderkey", partial_date(raw).alias("p"))
    key = F.when(F.col("p").isNotNull(), temporal_key(F.col("p")))
    return rows.select("o_orderkey", key["year"].cast("long").alias("y"), key["month"].cast("long").alias("m"), key["day"].cast("long").alias("d"))


# --- lexical -------------------------------------------------------------------------------------


@query(f"WITH t AS (SELECT doc_id, unnest({_TOK}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS occurrences FROM t GROUP BY term")
def term_df(spark, sf_dir):
    return lexical.term_counts(T.serving_records(spark, sf_dir))


_TERMS = ["the", "licensed", "und"]
BM25 = (
    REC
    + f""", tok AS (SELECT space_id, memory_id, text, retired, purged, generation, valid_until, {_TOK} AS words FROM rec),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(words)) AS mean FROM tok),
q AS (SELECT unnest(['the', 'licensed', 'und']) AS term),
tf AS (SELECT tok.space_id, tok.memory_id, len(words)::DOUBLE AS length, term, len(list_filter(words, lambda w: w = term))::DOUBLE AS tf FROM tok, q),
df AS (SELECT term, count(*) FILTER (WHERE tf > 0)::DOUBLE AS df FROM tf GROUP BY term),
bm AS (SELECT space_id, memory_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM tf JOIN df USING (term), st WHERE tf > 0 GROUP BY space_id, memory_id)"""
)


_indexes: dict[tuple[str, str], str] = {}


def _index(spark, sf_dir) -> lexical.LexicalIndex:
    """The full-text index of the documents, written by the first query that asks for it."""
    from stratalens.sources.store import working_path

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        path = working_path(spark, "lexical-index")
        lexical.write_index(T.serving_records(spark, sf_dir), path)
        _indexes[key] = path
    return lexical.open_index(spark, _indexes[key])


@query(BM25 + " SELECT space_id, memory_id, round(score, 6) AS score FROM bm WHERE space_id IN ('en', 'de') ORDER BY bm.score DESC, memory_id LIMIT 40")
def bm25_topk(spark, sf_dir):
    return lexical.bm25_top_k(_index(spark, sf_dir), "The licensed und", ["en", "de"], 40).withColumn("score", F.round("score", 6))


@query(BM25 + " SELECT space_id, memory_id, round(score, 6) AS score FROM bm WHERE space_id IN ('en', 'de') ORDER BY bm.score DESC, memory_id LIMIT 40")
def bm25_scan(spark, sf_dir):
    """The same without an index."""
    return lexical.bm25_top_k(T.serving_records(spark, sf_dir), "The licensed und", ["en", "de"], 40).withColumn("score", F.round("score", 6))


@query("SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest(" + _TOK + ") AS term FROM documents WHERE lang IN ('en', 'fr')) GROUP BY term")
def index_update(spark, sf_dir):
    """An index whose French space has been replaced, with the rest as it was."""
    from stratalens.sources.store import working_path

    records, path = T.serving_records(spark, sf_dir).where("space_id IN ('en', 'fr')"), working_path(spark, "lexical-update")
    lexical.write_index(records.withColumn("text", F.when(F.col("space_id") == "fr", F.lit("stale words")).otherwise(F.col("text"))), path)
    lexical.update_index(records.where("space_id = 'fr'"), path)
    index = lexical.open_index(spark, path)
    rows = index.postings.join(index.current().select("space_id", "segment"), ["space_id", "segment"])
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


@query(
    BM25.replace("['the', 'licensed', 'und']", "['licensed', 'under', 'the', 'und']")
    + """, top AS (SELECT *, row_number() OVER (ORDER BY score DESC, memory_id, space_id) - 1 AS evidence_rank FROM (SELECT * FROM bm WHERE space_id IN ('en', 'de') ORDER BY score DESC, memory_id, space_id LIMIT 60)),
kept AS (SELECT top.*, row_number() OVER (ORDER BY evidence_rank) - 1 AS rank FROM top JOIN tok USING (space_id, memory_id) WHERE NOT retired AND (contains(lower(text), 'licensed under') OR contains(lower(text), 'the und')))
SELECT memory_id, evidence_rank, rank FROM kept WHERE rank < 10"""
)
def lexical_channel(spark, sf_dir):
    """The words are searched one by one, but only texts with a cue as it stands stay."""
    found = lexical.lexical_channel(T.serving_records(spark, sf_dir), ["licensed under", "the und"], ["en", "de"], 60, 10, _index(spark, sf_dir))
    return found.select("memory_id", F.col("evidence_rank").cast("long"), F.col("rank").cast("long"))


# --- vectors -------------------------------------------------------------------------------------


@query(VEC + " SELECT space_id, memory_id, round(score, 6) AS score FROM sc ORDER BY sc.score DESC, memory_id LIMIT 20")
def cosine_topk(spark, sf_dir):
    return vectors.top_k(T.vectors(spark, sf_dir), first_vector(spark, sf_dir), 20).withColumn("score", F.round("score", 6))


@query(VEC + " SELECT space_id, memory_id, row_number() OVER w - 1 AS rank FROM sc WINDOW w AS (PARTITION BY space_id ORDER BY score DESC, memory_id) QUALIFY row_number() OVER w <= 3")
def cosine_per_space_topk(spark, sf_dir):
    return vectors.top_k_per_space(T.vectors(spark, sf_dir), first_vector(spark, sf_dir), 3).select("space_id", "memory_id", F.col("rank").cast("long"))


@query("SELECT 'L' || label AS space_id, vec_id // 3 AS unit, max(vec_id % 3) AS segment, arg_max(vec_id, vec_id % 3) AS vec_id FROM embeddings GROUP BY 1, 2")
def segment_newest_wins(spark, sf_dir):
    rows = T.table(spark, sf_dir, "embeddings").select(F.concat(F.lit("L"), "label").alias("space_id"), F.floor(F.col("vec_id") / 3).alias("unit"), (F.col("vec_id") % 3).alias("segment"), "vec_id")
    return vectors.newest_segments(rows, ["space_id", "unit"])


@query(VEC + " SELECT space_id, memory_id FROM vec WHERE memory_id % 17 <> 0")
def tombstone_antijoin(spark, sf_dir):
    v = T.vectors(spark, sf_dir)
    return vectors.without_tombstones(v, v.where("memory_id % 17 = 0"), ["space_id", "memory_id"]).select("space_id", "memory_id")


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def l2_norm(spark, sf_dir):
    return T.table(spark, sf_dir, "embeddings").select("vec_id", F.round(S.norm(F.col("embedding")), 6).alias("norm"))


@query(VEC + ", live AS (SELECT * FROM sc WHERE memory_id % 17 <> 0 AND memory_id % 5 <> 0 AND memory_id % 2 = 0 AND isfinite(score) AND space_id IN ('L0', 'L1', 'L2') ORDER BY score DESC, space_id, memory_id LIMIT 64) SELECT space_id, memory_id, row_number() OVER (ORDER BY score DESC, memory_id, space_id) - 1 AS rank FROM live ORDER BY score DESC, memory_id, space_id LIMIT 10")
def semantic_channel(spark, sf_dir):
    """The best current vectors of the scope that have the tag: others, however near, take no place among them."""
    v = T.vectors(spark, sf_dir)
    gone, no = F.col("memory_id") % 5 == 0, F.lit(False)
    records = v.select("space_id", "memory_id", F.lit("r").alias("revision_id"), F.array().cast("array<string>").alias("entity_refs"), F.array(F.when(F.col("memory_id") % 2 == 0, "even").otherwise("odd")).alias("tags"), F.lit(True).alias("current"), gone.alias("retired"), no.alias("purged"), F.lit(1).alias("generation"), F.lit(None).cast("long").alias("valid_until"))
    found = vectors.semantic_channel(v, records, first_vector(spark, sf_dir), filters.semantic_scope(["L0", "L1", "L2"], 1, tags=["even"]), 64, 10, v.where("memory_id % 17 = 0"))
    return found.select("space_id", "memory_id", F.col("rank").cast("long"))


def _basis_sql(many: int) -> str:
    """The span of the first vectors by Gram-Schmidt, step by step, and what it leaves of the query."""
    less = lambda a, b, e: f"list_transform(list_zip({a}, {e}), lambda p: p[1] - {b} * p[2])"
    parts = ["r0 AS (SELECT embedding::DOUBLE[] AS r FROM embeddings WHERE vec_id = 0)"]
    for k in range(1, many + 1):
        parts.append(f"u{k}_0 AS (SELECT embedding::DOUBLE[] AS u FROM embeddings WHERE vec_id = {k})")
        for j in range(1, k):
            parts.append(f"u{k}_{j} AS (SELECT {less('u', 'd', 'e')} AS u FROM (SELECT u, e, list_dot_product(u, e) AS d FROM u{k}_{j - 1}, e{j}))")
        parts.append(f"e{k} AS (SELECT list_transform(u, lambda x: x / n) AS e FROM (SELECT u, sqrt(list_dot_product(u, u)) AS n FROM u{k}_{k - 1}))")
        parts.append(f"r{k} AS (SELECT {less('r', 'd', 'e')} AS r FROM (SELECT r, e, list_dot_product(r, e) AS d FROM r{k - 1}, e{k}))")
    return ", ".join(parts)


@query(
    VEC
    + ", "
    + _basis_sql(8)
    + """, res AS (SELECT space_id, memory_id, list_dot_product(embedding::DOUBLE[], r) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(r, r))) AS score, 1 - list_dot_product(r, r) / list_dot_product(q::DOUBLE[], q::DOUBLE[]) AS e FROM vec, r8, q)
SELECT space_id, memory_id, round(score, 6) AS score, 8 AS rank_of_basis, round(e, 6) AS explained FROM res ORDER BY res.score DESC, memory_id LIMIT 10"""
)
def tag_basis_residual(spark, sf_dir):
    """The query vector's part outside the span of eight tag vectors, and the vectors nearest to it."""
    v = T.vectors(spark, sf_dir)
    some = [r.vector for r in v.where("memory_id between 1 and 8").orderBy("memory_id").collect()]
    b = vectors.tag_basis(first_vector(spark, sf_dir), some)
    return vectors.top_k(v, b.residual.tolist(), 10).withColumn("score", F.round("score", 6)).withColumns({"rank_of_basis": F.lit(b.rank), "explained": F.lit(round(b.explained, 6))})


# --- tags and graph ------------------------------------------------------------------------------


@query(MEM + " SELECT DISTINCT tag, tag_id FROM tagged")
def tag_dictionary(spark, sf_dir):
    return tags.dictionary(T.tag_memberships(spark, sf_dir))


@query(MEM + " SELECT space_id, tag, count(DISTINCT memory_id) AS memories, count(DISTINCT memory_id) FILTER (WHERE provenance = 'explicit') AS explicit FROM tagged GROUP BY 1, 2")
def tag_membership_count(spark, sf_dir):
    return tags.membership_counts(T.tag_memberships(spark, sf_dir))


@query(EDGES + ' SELECT space_id, "left", "right", explicit, generated, CAST(explicit + 0.5 * generated AS DOUBLE) AS weight FROM edges')
def tag_cooccurrence(spark, sf_dir):
    return tags.cooccurrence(T.tag_memberships(spark, sf_dir)).drop("left_id", "right_id")


@query(EDGES + ' SELECT "left", "right", CAST(explicit AS BIGINT) AS explicit, CAST(generated AS BIGINT) AS generated, CAST(weight AS DOUBLE) AS weight FROM comp')
def composite_edges(spark, sf_dir):
    return _view(spark, sf_dir).select("left", "right", "explicit", "generated", "weight")


@query(EDGES + ' SELECT "left", "right", round(weight / (1 + weight), 6) AS signal FROM comp')
def edge_signal(spark, sf_dir):
    return _view(spark, sf_dir).select("left", "right", F.round("signal", 6).alias("signal"))


def _view(spark, sf_dir) -> DataFrame:
    return tags.composite(tags.cooccurrence(T.tag_memberships(spark, sf_dir)), SCOPE)


@query(MEM + " SELECT space_id, memory_id, tag, provenance, CASE provenance WHEN 'explicit' THEN 0.95::DOUBLE ELSE 0.55::DOUBLE END AS score FROM tagged WHERE tag IN ('red', 'economy') AND space_id IN ('S0', 'S1') ORDER BY score DESC, space_id, memory_id, tag_id LIMIT 48")
def tag_readout(spark, sf_dir):
    return tags.readout(T.tag_memberships(spark, sf_dir), ["red", "economy"], ["S0", "S1"], 48).drop("tag_id")


@query(EDGES + ', e AS (SELECT "left" AS tag, weight FROM comp UNION ALL SELECT "right", weight FROM comp) SELECT tag, count(*) AS degree, round(avg(weight), 6) AS mean_weight FROM e GROUP BY tag')
def degree_mean_weight(spark, sf_dir):
    return tags.degrees(_view(spark, sf_dir)).withColumn("mean_weight", F.round("mean_weight", 6))


@query(EDGES + ', e AS (SELECT least("left", "right") AS "left", greatest("left", "right") AS "right", explicit, generated FROM edges) SELECT "left", "right", CAST(max(explicit) AS DOUBLE) AS static_weight, CAST(max(generated) AS DOUBLE) AS adaptive_weight FROM e GROUP BY 1, 2')
def graph_merge(spark, sf_dir):
    e = tags.cooccurrence(T.tag_memberships(spark, sf_dir)).select("left", "right", F.col("explicit").cast("double").alias("static_weight"), F.col("generated").cast("double").alias("adaptive_weight"))
    return tags.merge_edges(e)


_HOPS = """, h0 AS (SELECT * FROM (VALUES ('red', 1.0), ('economy', 0.55)) AS v(tag, score)),
h1 AS (SELECT dst AS tag, max(score * signal * 0.5) AS score FROM h0 JOIN both_ways ON src = tag WHERE score * signal * 0.5 > 1e-6 GROUP BY dst)"""


@query(EDGES + _HOPS + " SELECT tag, round(max(score), 6) AS score FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1) GROUP BY tag")
def activation_1hop(spark, sf_dir):
    return graph.activation(tags.both_ways(_view(spark, sf_dir)), {"red": 1.0, "economy": 0.55}, 1).select("tag", F.round("score", 6).alias("score"))


@query(EDGES + _HOPS + """, h2 AS (SELECT dst AS tag, max(score * signal * 0.5) AS score FROM h1 JOIN both_ways ON src = tag WHERE score * signal * 0.5 > 1e-6 GROUP BY dst),
h3 AS (SELECT dst AS tag, max(score * signal * 0.5) AS score FROM h2 JOIN both_ways ON src = tag WHERE score * signal * 0.5 > 1e-6 GROUP BY dst)
SELECT tag, round(max(score), 6) AS score FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) GROUP BY tag""")
def activation_hops(spark, sf_dir):
    return graph.activation(tags.both_ways(_view(spark, sf_dir)), {"red": 1.0, "economy": 0.55}, 3).select("tag", F.round("score", 6).alias("score"))


@query()
def activation_bounded(spark, sf_dir):
    """Activation in visiting order with the balanced profile's budgets."""
    found = graph.bounded_activation(tags.both_ways(_view(spark, sf_dir)), [("economy", 0.55), ("red", 1.0)], 96, 1024, 3)
    return found.withColumn("score", F.round("score", 6))


def _diffusion_sql(rounds: int) -> str:
    parts = [", deals AS (SELECT src, sum(signal) AS dealt FROM both_ways GROUP BY src), part_of AS (SELECT src, dst, signal / dealt AS part FROM both_ways JOIN deals USING (src))", "d0 AS (SELECT * FROM (VALUES ('red', 0.5), ('economy', 0.5)) AS v(tag, score))"]
    for n in range(1, rounds + 1):
        parts.append(f"d{n} AS (SELECT tag, sum(score) AS score FROM (SELECT tag, 0.35 * score AS score FROM d0 UNION ALL SELECT dst, 0.65 * score * part FROM d{n - 1} JOIN part_of ON src = tag) GROUP BY tag)")
    return ", ".join(parts) + f" SELECT tag, round(score, 6) AS score FROM d{rounds} WHERE score > 0"


@query(EDGES + _diffusion_sql(8))
def diffusion_8_iter(spark, sf_dir):
    return graph.diffusion(tags.both_ways(_view(spark, sf_dir)), {"red": 1.0, "economy": 1.0}).withColumn("score", F.round("score", 6))


@query(LINKS + " SELECT DISTINCT l.target, 1 AS hops FROM links l WHERE source IN ('C1', 'C2', 'O7') UNION SELECT * FROM (VALUES ('C1', 0), ('C2', 0), ('O7', 0)) AS v(target, hops)")
def relation_1hop(spark, sf_dir):
    starts = spark.createDataFrame([("C1",), ("C2",), ("O7",)], "target string")
    return graph.expand_relations(T.place_links(spark, sf_dir), starts, 1).select("target", "hops")


@query(LINKS + ", s AS (SELECT 'O' || o_orderkey AS target FROM orders WHERE o_orderpriority = '1-URGENT'), a AS (SELECT target, 0 AS hops FROM s UNION ALL SELECT l.target, 1 FROM s JOIN links l ON l.source = s.target UNION ALL SELECT m.target, 2 FROM s JOIN links l ON l.source = s.target JOIN links m ON m.source = l.target) SELECT target, min(hops) AS hops FROM a GROUP BY target")
def relation_2hop(spark, sf_dir):
    starts = T.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("O"), "o_orderkey").alias("target"))
    return graph.expand_relations(T.place_links(spark, sf_dir), starts, 2).select("target", "hops")


@query(HIST + ", p AS (SELECT revision_id, lag(revision_id) OVER (PARTITION BY memory_id ORDER BY turn) AS parent_id, memory_id, turn FROM hist), tip AS (SELECT memory_id, max(turn) AS top FROM hist WHERE memory_id = 5 GROUP BY 1) SELECT hist.revision_id, top - turn AS depth FROM hist JOIN tip USING (memory_id) WHERE turn < top")
def revision_ancestors(spark, sf_dir):
    from pyspark.sql import Window

    h = T.turn_history(spark, sf_dir)
    parents = h.where("memory_id = 5").select("revision_id", F.lag("revision_id").over(Window.partitionBy("memory_id").orderBy("turn")).alias("parent_id")).where("parent_id is not null")
    tip = h.where("memory_id = 5").agg(F.max_by("revision_id", "turn")).first()[0]
    return graph.ancestors(parents, tip or "-").select("revision_id", F.col("depth").cast("long"))


# --- fusion, consolidation, assessment -----------------------------------------------------------

POOL = """WITH c1 AS (SELECT 'en' AS space_id, doc_id AS memory_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 40),
c2 AS (SELECT lang AS space_id, doc_id AS memory_id, row_number() OVER (ORDER BY sha256(text), doc_id) - 1 AS rank FROM documents WHERE n_chars > 3000 ORDER BY sha256(text), doc_id LIMIT 60),
pool AS (SELECT 'a' AS channel, * FROM c1 UNION ALL SELECT 'b', * FROM c2),
rrf AS (SELECT space_id, memory_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, count(*) AS channels FROM pool GROUP BY 1, 2)"""


def _pool(spark, sf_dir) -> DataFrame:
    """Two short ranked lists over documents: the longest English ones, and long ones by hash."""
    docs = T.table(spark, sf_dir, "documents").select(F.col("lang").alias("space_id"), F.col("doc_id").alias("memory_id"), F.sha2("text", 256).alias("revision_id"), "n_chars")
    one = [F.desc("n_chars"), F.col("memory_id")]
    two = [F.col("revision_id"), F.col("memory_id")]
    a = ranked(docs.where("space_id = 'en'").orderBy(*one).limit(40), one)
    b = ranked(docs.where("n_chars > 3000").orderBy(*two).limit(60), two)
    return fusion.pool_rows("a", a, n_exact=F.lit(1)).unionByName(fusion.pool_rows("b", b, n_semantic=F.lit(1), resolutions=F.array(F.lit("document"))))


@query(POOL + " SELECT space_id, memory_id, round(rrf, 6) AS rrf FROM rrf")
def rrf_two_channels(spark, sf_dir):
    return fusion.fuse(_pool(spark, sf_dir)).select("space_id", "memory_id", F.round("rrf", 6).alias("rrf"))


@query(POOL + " SELECT memory_id, round(rrf, 6) AS rrf FROM rrf WHERE space_id IN ('de', 'en') ORDER BY rrf.rrf DESC, memory_id LIMIT 15")
def rrf_scoped_limit(spark, sf_dir):
    return fusion.fuse(_pool(spark, sf_dir), ["de", "en"], 15).select("memory_id", F.round("rrf", 6).alias("rrf"))


@query(POOL + " SELECT memory_id, channels AS families, round(least(channels / 3.0, 1.0), 6) AS confidence, round(1.0 / (1 + channels), 6) AS effort, round(rrf / (1 + rrf), 6) AS relevance FROM rrf")
def evidence_families(spark, sf_dir):
    shown = fusion.presented(fusion.fuse(_pool(spark, sf_dir)))
    return shown.select("memory_id", F.col("families").cast("long"), *(F.round(c, 6).alias(c) for c in ("confidence", "effort", "relevance")))


@query("SELECT p_partkey, round(least(greatest(0.07 * least(ln(1 + p_size) / ln(5), 1) + 0.03 * least(p_retailprice / 1500, 1) + 0.02 * (p_partkey % 10) / 10, 0), 0.12), 6) AS bonus FROM part")
def support_bonus(spark, sf_dir):
    bonus = S.support_bonus(F.col("p_size"), F.col("p_retailprice") / 1500, (F.col("p_partkey") % 10) / 10)
    return T.table(spark, sf_dir, "part").select("p_partkey", F.round(bonus, 6).alias("bonus"))


@query("SELECT p_partkey, round(least(0.03 * (p_partkey % 4) / 3.0 + 0.03 / (1 + p_size % 5) + CASE WHEN p_size % 2 = 0 THEN 0.02 ELSE 0 END, 0.08), 6) AS bonus FROM part")
def structure_bonus(spark, sf_dir):
    bonus = S.structure_bonus((F.col("p_partkey") % 4) / 3.0, F.col("p_size") % 5, F.col("p_size") % 2 == 0)
    return T.table(spark, sf_dir, "part").select("p_partkey", F.round(bonus, 6).alias("bonus"))


@query("SELECT c_custkey, round(least(0.025 * count(o_orderkey), 0.05), 6) AS bonus FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def relation_bonus(spark, sf_dir):
    n = T.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return T.table(spark, sf_dir, "customer").join(n, "c_custkey", "left").select("c_custkey", F.round(S.relation_bonus(F.coalesce("n", F.lit(0))), 6).alias("bonus"))


@query("SELECT p_partkey, round(least(p_size / 4.0 + p_partkey % 100 / 256.0 + p_size / 1024.0 + p_partkey % 7 / 64.0 + p_partkey % 2 / 2.0, 1.0), 6) AS effort FROM part")
def effort_from_cost(spark, sf_dir):
    k = F.col("p_partkey")
    return T.table(spark, sf_dir, "part").select("p_partkey", F.round(S.effort_from_cost(F.col("p_size"), k % 100, F.col("p_size"), k % 7, k % 2), 6).alias("effort"))


CONS = """WITH cand AS (SELECT o_custkey AS memory_id, o_totalprice / 1000000 AS score, CASE o_orderstatus WHEN 'F' THEN 'exact' WHEN 'O' THEN 'lexical' ELSE 'tags' END AS kind, o_orderkey FROM orders),
o AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY score DESC, kind DESC) AS rn, row_number() OVER (PARTITION BY memory_id, kind ORDER BY score DESC) AS first_of_kind FROM cand),
g AS (SELECT memory_id, max(score) AS best, coalesce(sum(score) FILTER (WHERE rn > 1 AND first_of_kind = 1), 0) AS support, count(DISTINCT kind) AS families FROM o GROUP BY memory_id),
res AS (SELECT memory_id, families, best + 0.5 * (1 - exp(-support)) AS score FROM g)"""


def _consolidated(spark, sf_dir, limit: int) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "exact").when(F.col("o_orderstatus") == "O", "lexical").otherwise("tags")
    rows = T.table(spark, sf_dir, "orders").select(F.lit("S").alias("space_id"), F.col("o_custkey").alias("memory_id"), F.lit("r").alias("revision_id"), (F.col("o_totalprice") / 1000000).alias("score"), F.array(kind).alias("kinds"))
    return fusion.consolidate(rows, limit)


@query(CONS + " SELECT memory_id, families, round(score, 6) AS score, round(score / (1 + score), 6) AS relevance FROM res ORDER BY res.score / (1 + res.score) DESC, memory_id LIMIT 50")
def consolidate(spark, sf_dir):
    return _consolidated(spark, sf_dir, 50).select("memory_id", F.col("families").cast("long"), F.round("score", 6).alias("score"), F.round("relevance", 6).alias("relevance"))


@query(CONS + ", top AS (SELECT * FROM res ORDER BY score / (1 + score) DESC, memory_id LIMIT 50) SELECT count(*) AS result_count, round(max(score / (1 + score)), 6) AS top_relevance, round(avg(least(families / 3.0, 1.0)), 6) AS mean_confidence, 0.5::DOUBLE AS mean_accessibility, round(avg(1.0 / (1 + families)), 6) AS mean_effort, round(avg(families / 7.0), 6) AS channel_coverage FROM top")
def assessment(spark, sf_dir):
    a = fusion.assess(_consolidated(spark, sf_dir, 50))
    return a.select("result_count", *(F.round(c, 6).alias(c) for c in a.columns[1:]))


def _engine(spark, sf_dir, **more):
    """A store over documents, and a scoped text query on it."""
    from stratalens.plans.engine import Store, run
    from stratalens.plans.query import Query, Snapshot

    newest = 10**9
    store = Store(T.serving_records(spark, sf_dir), Snapshot(newest, newest), index=_index(spark, sf_dir))
    return run(store, Query(spaces=("en", "de"), text=("licensed under",), max_results=10, **more))


@query(
    BM25.replace("['the', 'licensed', 'und']", "['licensed', 'under']")
    + """, top AS (SELECT *, row_number() OVER (ORDER BY score DESC, memory_id, space_id) - 1 AS evidence_rank FROM (SELECT * FROM bm WHERE space_id IN ('en', 'de') ORDER BY score DESC, memory_id, space_id LIMIT 64)),
kept AS (SELECT top.space_id, top.memory_id, row_number() OVER (ORDER BY evidence_rank) - 1 AS rank FROM top JOIN tok USING (space_id, memory_id) WHERE NOT retired AND contains(lower(text), 'licensed under') QUALIFY row_number() OVER (ORDER BY evidence_rank) <= 10)
SELECT space_id, memory_id, round((1.0 / (60 + rank)) / (1 + 1.0 / (60 + rank)), 6) AS relevance, round(1 / 3.0, 6) AS confidence, 0.5::DOUBLE AS effort FROM kept"""
)
def engine_query(spark, sf_dir):
    """A scoped text query from plan to results."""
    return _engine(spark, sf_dir).results.select("space_id", "memory_id", *(F.round(c, 6).alias(c) for c in ("relevance", "confidence", "effort")))


@query()
def fused_end_to_end(spark, sf_dir):
    """Text, vectors, tags, propagation and relations of parts, fused, with the thorough profile."""
    from stratalens.plans.engine import Store, run
    from stratalens.plans.query import Query, Snapshot

    members = T.tag_memberships(spark, sf_dir)
    part = T.table(spark, sf_dir, "part")
    records = part.select(
        F.concat(F.lit("S"), F.col("p_size") % 5).alias("space_id"), F.col("p_partkey").alias("memory_id"), F.sha2(F.concat_ws("|", "p_partkey", "p_name"), 256).alias("revision_id"),
        F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"), F.array(F.concat(F.lit("brand:"), "p_brand")).alias("entity_refs"), F.split("p_name", " ").alias("tags"), F.array().cast("array<string>").alias("node_ids"),
        F.array(F.concat(F.lit("memory-ref:"), F.col("p_partkey") + 1)).alias("relations"), F.lit(True).alias("current"), F.lit(False).alias("retired"), F.lit(False).alias("purged"), F.lit(1).cast("long").alias("generation"), F.lit(None).cast("long").alias("valid_until"),
    )
    vec = T.table(spark, sf_dir, "embeddings").join(records.select("memory_id", "space_id"), F.col("vec_id") == F.col("memory_id")).select("space_id", "memory_id", F.lit(0).alias("segment"), F.col("embedding").alias("vector"))
    store = Store(records, Snapshot(1, 1), vec, None, members, tags.cooccurrence(members), graph.relation_links(records))
    q = Query(spaces=tuple(SCOPE), text=("red widget",), cue_tags=("Red",), preferred=("semantic", "associative"), quality="thorough", query_vector=tuple(first_vector(spark, sf_dir)))
    shown = run(store, q).results
    return shown.select("space_id", "memory_id", "channels", "families", F.round("relevance", 6).alias("relevance"))


# --- reranking and feedback ----------------------------------------------------------------------

RES = """WITH res AS (SELECT 'S' || (p_size % 5) AS space_id, p_partkey AS memory_id, p_brand AS revision_id, p_name || CASE WHEN p_size % 3 = 0 THEN chr(10) || '<b>' ELSE '' END AS text, (p_partkey % 50) / 50.0::DOUBLE AS relevance FROM part),
sent AS (SELECT space_id || ':' || memory_id || ':' || revision_id AS handle, * FROM res ORDER BY relevance DESC, handle LIMIT 32)"""


def _results(spark, sf_dir) -> DataFrame:
    text = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, "\n<b>").otherwise(""))
    return T.table(spark, sf_dir, "part").select(F.concat(F.lit("S"), F.col("p_size") % 5).alias("space_id"), F.col("p_partkey").alias("memory_id"), F.col("p_brand").alias("revision_id"), text.alias("text"), ((F.col("p_partkey") % 50) / 50.0).alias("relevance"))


@query(RES + " SELECT handle, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '[<>]')), chr(10)) AS text, round(relevance, 6) AS relevance FROM sent")
def rerank_batch(spark, sf_dir):
    from stratalens.operators import rerank

    return rerank.batch(_results(spark, sf_dir), "balanced").withColumn("relevance", F.round("relevance", 6))


@query(RES + ", sc AS (SELECT handle, ('0x' || substr(sha256(handle), 1, 6))::BIGINT / 16777215.0::DOUBLE AS s FROM sent), a AS (SELECT res.*, s FROM res LEFT JOIN sc ON handle = space_id || ':' || memory_id || ':' || revision_id) SELECT memory_id, round(s, 6) AS rerank_score FROM a")
def rerank_apply(spark, sf_dir):
    from stratalens.operators import rerank

    r = _results(spark, sf_dir)
    return rerank.apply(r, rerank.hash_scores(rerank.batch(r, "balanced"))).select("memory_id", F.round("rerank_score", 6).alias("rerank_score"))


FAM = FEED + ", fam AS (SELECT space_id, memory_id, count(*) FILTER (WHERE w > 0) AS positive_count, count(*) FILTER (WHERE w < 0) AS negative_count, sum(greatest(w, 0)) AS positive_weight, max(micros) FILTER (WHERE w > 0) AS last_success FROM fb GROUP BY 1, 2)"


@query(FAM + " SELECT space_id, memory_id, positive_count, negative_count, CAST(positive_weight AS DOUBLE) AS positive_weight, last_success FROM fam")
def familiarity_reduce(spark, sf_dir):
    from stratalens.operators import adaptive

    return adaptive.familiarity(T.feedback(spark, sf_dir))


@query(FEED + " SELECT space_id, memory_id, tag, count(*) FILTER (WHERE w > 0) AS positive_count, count(*) FILTER (WHERE w < 0) AS negative_count, round(sum(w) / sum(abs(w)), 6) AS score FROM fb GROUP BY 1, 2, 3")
def tag_affinity_reduce(spark, sf_dir):
    from stratalens.operators import adaptive

    return adaptive.affinity(T.feedback(spark, sf_dir)).select("space_id", "memory_id", "tag", "positive_count", "negative_count", F.round("score", 6).alias("score"))


NOW = 1_710_000_000


@query(FAM + f" SELECT space_id, memory_id, round(CASE WHEN last_success IS NULL THEN 0 ELSE (1 - exp(-positive_weight / 4.0)) * exp(-greatest({NOW} - last_success // 1000000, 0) / 2592000.0) END, 6) AS accessibility FROM fam")
def accessibility_at(spark, sf_dir):
    from stratalens.operators import adaptive

    f = adaptive.familiarity(T.feedback(spark, sf_dir))
    return f.select("space_id", "memory_id", F.round(S.accessibility(F.col("positive_weight"), F.floor(F.col("last_success") / 1_000_000), NOW), 6).alias("accessibility"))


@query(
    FAM
    + f""", acc AS (SELECT space_id, memory_id, (1 - exp(-positive_weight / 4.0)) * exp(-greatest({NOW} - last_success // 1000000, 0) / 2592000.0) AS a FROM fam WHERE space_id IN ('S0', 'S1')),
aff AS (SELECT space_id, memory_id, avg((s + 1) / 2) AS m FROM (SELECT space_id, memory_id, tag, sum(w) / sum(abs(w)) AS s FROM fb WHERE tag IN ('k1', 'k2') GROUP BY 1, 2, 3) GROUP BY 1, 2),
pr AS (SELECT space_id, memory_id, 0.1 * least(greatest(0.75 * coalesce(a, 0) + 0.25 * coalesce(m, 0), 0), 1) AS prior FROM acc LEFT JOIN aff USING (space_id, memory_id))
SELECT memory_id, memory_id % 3 AS relevance, round(prior, 6) AS prior, row_number() OVER (ORDER BY memory_id % 3 DESC, prior DESC, memory_id) AS place FROM pr"""
)
def adaptive_tiebreak(spark, sf_dir):
    from stratalens.operators import adaptive

    fb = T.feedback(spark, sf_dir)
    prior = adaptive.priors(adaptive.familiarity(fb), adaptive.affinity(fb), ["S0", "S1"], ["k1", "k2"], NOW)
    rows = prior.select("space_id", "memory_id", F.lit("r").alias("revision_id"), (F.col("memory_id") % 3).alias("relevance"))
    placed = ranked_whole(adaptive.tie_break(rows, prior), [F.desc("relevance"), F.desc("prior"), F.col("memory_id")], "place")
    return placed.select("memory_id", "relevance", F.round("prior", 6).alias("prior"), (F.col("place") + 1).cast("long").alias("place"))


@query(FEED + " SELECT event_id, outcome FROM fb WHERE event_id % 3 = 0 AND event_id % 2 <> 0")
def feedback_dedup(spark, sf_dir):
    """A batch with repeats against a log that has its even events."""
    from stratalens.operators import adaptive

    fb = T.feedback(spark, sf_dir)
    batch = fb.where("event_id % 3 = 0")
    return adaptive.new_events(fb.where("event_id % 2 = 0"), batch.unionByName(batch)).select("event_id", "outcome")


@query(FEED + " SELECT event_id, 2 AS contents FROM fb WHERE event_id % 10 = 0")
def idempotency_conflicts(spark, sf_dir):
    from stratalens.operators import adaptive

    fb = T.feedback(spark, sf_dir)
    again = fb.where("event_id % 5 = 0").withColumn("tag", F.when(F.col("event_id") % 10 == 0, "other").otherwise(F.col("tag")))
    return adaptive.conflicts(fb, again)


@query(FAM + " SELECT space_id, memory_id, positive_count, negative_count, CAST(positive_weight AS DOUBLE) AS positive_weight, last_success FROM fam")
def feedback_stream(spark, sf_dir):
    """The same state from a stream that runs until it has read all there is."""
    from stratalens.sources.store import working_path
    from stratalens.streaming.feedback import run_available

    events = T.table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events*").parquet(sf_dir) if _one_file(spark, sf_dir) else spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet")
    return run_available(stream, working_path(spark, "familiarity"))


def _one_file(spark, sf_dir) -> bool:
    """Whether the events are a file, not a folder: streams read folders."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile()


# --- governance ----------------------------------------------------------------------------------


@query("SELECT d.doc_id + 0 AS memory_id, row_number() OVER (ORDER BY d.doc_id) + 4999 AS new_id FROM documents d WHERE lang = 'es'")
def import_mapping(spark, sf_dir):
    from stratalens.operators import governance

    return governance.mapping(T.serving_records(spark, sf_dir).where("space_id = 'es'"), 5000)


_REFS = "WITH r AS (SELECT c_custkey AS memory_id, c_custkey * 7 % 2000 AS target FROM customer)"


def _referring(spark, sf_dir) -> DataFrame:
    return T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("memory_id"), F.lit("A").alias("space_id"), F.array(F.concat(F.lit("memory-ref:"), (F.col("c_custkey") * 7 % 2000).cast("string")), F.lit("supports")).alias("relations"))


@query(_REFS + ", ids AS (SELECT memory_id, row_number() OVER (ORDER BY memory_id) + 9999 AS new_id FROM r) SELECT i.new_id AS memory_id, 'NEW' AS space_id, 'memory-ref:' || coalesce(t.new_id, r.target) || ',supports' AS relations FROM r JOIN ids i ON i.memory_id = r.memory_id LEFT JOIN ids t ON t.memory_id = r.target")
def import_remap(spark, sf_dir):
    from stratalens.operators import governance

    rows = _referring(spark, sf_dir)
    return governance.import_records(rows, governance.mapping(rows, 10_000), "NEW").withColumn("relations", F.array_join("relations", ","))


@query(_REFS + " SELECT r.memory_id, r.target FROM r WHERE r.target NOT IN (SELECT memory_id FROM r)")
def unresolved_refs(spark, sf_dir):
    from stratalens.operators import governance

    rows = _referring(spark, sf_dir)
    return governance.unresolved_references(rows, rows)


@query(REC + " SELECT memory_id, revision_id FROM rec WHERE NOT (source = 'src3')")
def purge_rewrite(spark, sf_dir):
    from stratalens.operators import governance

    r = T.serving_records(spark, sf_dir)
    return governance.purge(r, r.where(F.array_contains("tags", "src3"))).select("memory_id", "revision_id")


@query(FEED + " SELECT space_id, count(*) AS n FROM fb WHERE NOT (space_id = 'S2' AND memory_id = 6) GROUP BY space_id")
def reset_space(spark, sf_dir):
    from stratalens.operators import adaptive

    return adaptive.reset(T.feedback(spark, sf_dir), "S2", 6).groupBy("space_id").agg(F.count(F.lit(1)).alias("n"))


@query("WITH s AS (SELECT n_regionkey, CASE WHEN n_nationkey = 3 THEN 0 WHEN n_nationkey % 5 = 1 THEN 1 ELSE 2 END AS o FROM nation) SELECT n_regionkey, ['deny', 'local-only', 'external-allowed'][min(o) + 1] AS policy FROM s GROUP BY n_regionkey")
def most_restrictive_policy(spark, sf_dir):
    from stratalens.operators import governance

    policy = F.when(F.col("n_nationkey") == 3, "deny").when(F.col("n_nationkey") % 5 == 1, "local-only").otherwise("external-allowed")
    return governance.most_restrictive(T.table(spark, sf_dir, "nation").withColumn("policy", policy), ["n_regionkey"])


@query("""WITH c AS (SELECT 'name' || (c_custkey % 40) AS surface, 'person:' || (c_custkey % 80) AS e, CASE WHEN c_custkey % 40 < 10 THEN 1 ELSE 2 END AS trust FROM customer UNION SELECT 'name' || (s_suppkey % 50), 'person:' || s_suppkey, CASE WHEN s_suppkey % 50 BETWEEN 5 AND 12 THEN 0 ELSE 2 END FROM supplier),
b AS (SELECT surface, min(trust) AS t FROM c GROUP BY surface), g AS (SELECT surface, t, count(DISTINCT e) AS n, string_agg(DISTINCT e, ',' ORDER BY e) AS entities FROM c JOIN b USING (surface) WHERE trust = t GROUP BY 1, 2)
SELECT surface, ['conversation', 'directory', 'observation'][t + 1] AS source, entities, CASE WHEN n = 1 AND t < 2 THEN 'resolved' ELSE 'ambiguous' END AS status FROM g""")
def identity_precedence(spark, sf_dir):
    from stratalens.operators import identity

    c, s = F.col("c_custkey"), F.col("s_suppkey")
    a = T.table(spark, sf_dir, "customer").select(F.concat(F.lit("name"), c % 40).alias("surface"), F.concat(F.lit("person:"), c % 80).alias("entity_ref"), F.when(c % 40 < 10, "directory").otherwise("observation").alias("source"))
    b = T.table(spark, sf_dir, "supplier").select(F.concat(F.lit("name"), s % 50).alias("surface"), F.concat(F.lit("person:"), s).alias("entity_ref"), F.when((s % 50).between(5, 12), "conversation").otherwise("observation").alias("source"))
    return identity.resolve(a.unionByName(b)).withColumn("entities", F.array_join("entities", ","))


@query("WITH own AS (SELECT p_partkey AS memory_id, unnest(string_split(p_name, ' ')) AS e FROM part WHERE p_size % 5 < 3), req AS (SELECT item_id AS request, ['red', 'steel', 'zzz'][item_id % 3 + 1] AS e FROM benchmark), h AS (SELECT request, count(DISTINCT memory_id) AS n FROM req JOIN own USING (e) GROUP BY 1) SELECT request, coalesce(n, 0) AS memories, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'existing' ELSE 'ambiguous' END AS status FROM req LEFT JOIN h USING (request)")
def owner_discovery(spark, sf_dir):
    from stratalens.operators import identity

    records = T.table(spark, sf_dir, "part").select(F.concat(F.lit("S"), F.col("p_size") % 5).alias("space_id"), F.col("p_partkey").alias("memory_id"), F.split("p_name", " ").alias("entity_refs"))
    wanted = T.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request"), F.array(F.element_at(F.array(F.lit("red"), F.lit("steel"), F.lit("zzz")), (F.col("item_id") % 3 + 1).cast("int"))).alias("entities"))
    return identity.discover_owner(records, SCOPE, wanted)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 900 NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 11 <> 0)")
def integrity_dangling(spark, sf_dir):
    from stratalens.operators import integrity

    lines = T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 900).alias("ref"))
    return integrity.dangling(lines, "ref", T.table(spark, sf_dir, "part").where("p_partkey % 11 <> 0"), "p_partkey").select("l_orderkey", "l_linenumber")


@query(
    """WITH r AS (SELECT conv_id, turn, conv_id || ':' || turn AS revision FROM conversations), top AS (SELECT conv_id, max(turn) AS top, count(*) AS n FROM r GROUP BY 1)
SELECT 'HEAD_MISSING' AS code, CAST(conv_id AS VARCHAR) AS subject FROM r WHERE turn % 4 = 3
UNION SELECT 'FOREIGN_KEY', revision FROM r WHERE turn % 4 = 3
UNION SELECT 'STATE_OVERLAP', CAST(conv_id AS VARCHAR) FROM top WHERE conv_id % 10 = 1 AND n > 1
UNION SELECT 'SOURCE_BLOB_MISSING', revision FROM r WHERE turn % 4 <> 3 AND conv_id % 20 = 2
UNION SELECT 'REVISION_PARENT_MISSING', revision FROM r WHERE turn > 0 AND (turn - 1) % 4 = 3
UNION SELECT 'REVISION_PARENT_MISSING', conv_id || ':0' FROM top WHERE conv_id % 30 = 4 AND top % 4 = 3
UNION SELECT 'REVISION_CYCLE', revision FROM r WHERE conv_id % 30 = 4"""
)
def integrity_codes(spark, sf_dir):
    """Every test at once, on a history with faults: missing revisions and blobs, overlaps, rings of parents."""
    from stratalens.operators import integrity

    h = T.turn_history(spark, sf_dir)
    spaces = spark.createDataFrame([("A", 1)], "space_id string, created long")
    states = spark.createDataFrame([("A", "a", "active", 1, None)], "space_id string, space_key string, lifecycle string, valid_from long, valid_to long")
    memories = h.groupBy("memory_id").agg(F.min("valid_from").alias("created"))
    bent = h.withColumn("valid_to", F.when(F.col("memory_id") % 10 == 1, F.col("valid_to") + 1).otherwise(F.col("valid_to")))
    own = bent.select("memory_id", F.lit("A").alias("space_id"), F.lit(None).cast("string").alias("document_key"), "revision_id", F.lit("active").alias("lifecycle"), "valid_from", "valid_to")
    revisions = h.where("turn % 4 <> 3").select("revision_id", "memory_id", F.col("revision_id").alias("blob"), F.col("valid_from").alias("generation"))
    one = lambda m, t: F.concat_ws(":", m, t)
    chain = h.where("turn > 0").select("revision_id", one(F.col("memory_id"), F.col("turn") - 1).alias("parent_id"))
    ring = h.where("memory_id % 30 = 4").groupBy("memory_id").agg(F.max("turn").alias("top")).select(one(F.col("memory_id"), F.lit(0)).alias("revision_id"), one(F.col("memory_id"), F.col("top")).alias("parent_id"))
    parents = chain.unionByName(ring)
    blobs = revisions.where("memory_id % 20 <> 2").select("blob")
    return integrity.check(spaces, states, memories, own, revisions, parents, blobs, 10**6)


@query("SELECT DISTINCT sha256(text) AS blob FROM documents WHERE lang <> 'es' EXCEPT SELECT sha256(text) FROM documents WHERE source <> 'src1'")
def gc_unreferenced(spark, sf_dir):
    from stratalens.operators import governance

    docs = T.table(spark, sf_dir, "documents").withColumn("blob", F.sha2("text", 256))
    return governance.unreferenced(docs.where("lang <> 'es'").select("blob").distinct(), docs.where("source <> 'src1'"))


# --- documents, builds, metrics ------------------------------------------------------------------


def _documents(spark, sf_dir, version: int) -> DataFrame:
    """Parts as marked-up documents, in two versions."""
    size = F.col("p_size") + (F.lit(version) if version else F.lit(0)) * (F.col("p_partkey") % 2).cast("int")
    text = F.concat(F.lit("# "), "p_name", F.lit('\n\n<Tag value="'), "p_brand", F.lit('" />\n<Entity id="e" ref="type:'), F.regexp_replace("p_type", r"\s", "-"), F.lit('">'), "p_type", F.lit('</Entity>\n<State id="s" kind="status" validFrom="2024">size '), size.cast("string"), F.lit("</State>\n"))
    if version:
        text = F.when(F.col("p_partkey") % 3 == 0, F.concat(text, F.lit('<Tag value="extra" />\n'))).otherwise(text)
    return T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("memory_id"), text.alias("text"))


def _diffed(spark, sf_dir) -> DataFrame:
    from stratalens.operators import diff, markup

    old, new = (markup.compile_documents(_documents(spark, sf_dir, v)).select("memory_id", "ir") for v in (0, 1))
    return diff.semantic_diff(old, new, "memory_id")


_DIFF = "WITH d AS (SELECT p_partkey AS memory_id, 's' AS node_id, 'VisibleText' AS category FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT p_partkey, NULL, c FROM part, unnest(['SemanticNodeLifecycle', 'ExplicitTag']) AS u(c) WHERE p_partkey % 3 = 0)"


@query(_DIFF + " SELECT * FROM d")
def semantic_diff_categories(spark, sf_dir):
    return _diffed(spark, sf_dir)


@query()
def invalidation_closure(spark, sf_dir):
    from stratalens.operators import diff

    return diff.rebuilds(_diffed(spark, sf_dir), "memory_id")


def _closure_sql() -> str:
    """The dependency table as rows, and its closure as a recursive query."""
    from stratalens.operators.diff import DEPENDS, ROOTS

    roots = ", ".join(f"('{c}', '{p}')" for c, own in ROOTS.items() for p in own)
    needs = ", ".join(f"('{p}', '{n}')" for p, own in DEPENDS.items() for n in own)
    return _DIFF.replace("WITH d", "WITH RECURSIVE d", 1) + f", roots AS (SELECT * FROM (VALUES {roots}) AS v(category, projection)), needs AS (SELECT * FROM (VALUES {needs}) AS v(projection, need)), up AS (SELECT category, projection FROM roots UNION SELECT up.category, needs.projection FROM up JOIN needs ON needs.need = up.projection) SELECT DISTINCT memory_id, projection FROM d JOIN up USING (category) UNION SELECT DISTINCT memory_id, 'Ir' FROM d"


ORACLE_SQL["invalidation_closure"] = _closure_sql()


@query("SELECT p_partkey AS memory_id, array_to_string([p_brand], ',') AS tags, 'type:' || regexp_replace(p_type, '\\s', '-', 'g') AS entities, '# ' || p_name || chr(10) || chr(10) || '' AS ignored, sha256('# ' || p_name || chr(10) || p_type || chr(10) || 'size ' || p_size) AS lexical FROM part".replace(", '# ' || p_name || chr(10) || chr(10) || '' AS ignored", ""))
def projection_serving(spark, sf_dir):
    from stratalens.operators import markup, projections

    rows = projections.serving(markup.compile_documents(_documents(spark, sf_dir, 0)))
    return rows.select("memory_id", F.array_join("tags", ",").alias("tags"), F.array_join("entity_refs", ",").alias("entities"), F.sha2("text", 256).alias("lexical"))


@query("SELECT p_partkey AS memory_id, unnest(['Tag', 'Entity', 'State']) AS kind, unnest([NULL, 'e', 's']) AS node_id FROM part")
def projection_structure(spark, sf_dir):
    from stratalens.operators import markup, projections

    return projections.structure(markup.compile_documents(_documents(spark, sf_dir, 0)), "memory_id").select("memory_id", "kind", "node_id")


@query("SELECT p_partkey AS memory_id, 's' AS node_id, '2024' AS valid_from FROM part")
def projection_temporal(spark, sf_dir):
    from stratalens.operators import markup, projections

    return projections.temporal(markup.compile_documents(_documents(spark, sf_dir, 0)), "memory_id").select("memory_id", "node_id", "valid_from")


@query("SELECT p_partkey AS memory_id, p_brand AS value, lower(p_brand) AS tag FROM part")
def projection_tags(spark, sf_dir):
    from stratalens.operators import markup, projections

    return projections.explicit_tags(markup.compile_documents(_documents(spark, sf_dir, 0)), "memory_id").select("memory_id", "value", "tag")


@query("SELECT p_partkey AS memory_id, 'type:' || regexp_replace(p_type, '\\s', '-', 'g') AS entity_ref, p_type AS surface FROM part")
def projection_entities(spark, sf_dir):
    from stratalens.operators import markup, projections

    return projections.entities(markup.compile_documents(_documents(spark, sf_dir, 0)), "memory_id").select("memory_id", "entity_ref", "surface")


@query("SELECT page_id, true AS refused FROM pages")
def untrusted_markup(spark, sf_dir):
    """Raw web pages aren't of the profile: all are refused."""
    from stratalens.operators import markup

    pages = T.table(spark, sf_dir, "pages")
    return markup.compile_documents(pages, "html").select("page_id", F.col("ir.error").isNotNull().alias("refused"))


@query("WITH c AS (SELECT p_partkey AS memory_id, unnest([p_brand, upper(p_brand) || ' ', p_type, ' ', p_name]) AS v, unnest([0.5, 0.9, 1.5, 0.7, 0.25]) AS score, unnest([0, 1, 2, 3, 4]) AS pos FROM part), n AS (SELECT memory_id, lower(trim(v)) AS tag, score, pos FROM c WHERE trim(v) <> '' AND score <= 1) SELECT memory_id, tag, CAST(arg_min(score, pos) AS DOUBLE) AS score FROM n GROUP BY 1, 2")
def generated_tags(spark, sf_dir):
    values = F.array(*(F.struct(v.alias("value"), F.lit(s).alias("score"), F.lit(i).alias("position")) for i, (v, s) in enumerate([(F.col("p_brand"), 0.5), (F.concat(F.upper("p_brand"), F.lit(" ")), 0.9), (F.col("p_type"), 1.5), (F.lit(" "), 0.7), (F.col("p_name"), 0.25)])))
    rows = T.table(spark, sf_dir, "part").select(F.lit("A").alias("space_id"), F.col("p_partkey").alias("memory_id"), F.explode(values).alias("c")).select("space_id", "memory_id", "c.*")
    return tags.generated_tags(rows).select("memory_id", "tag", "score")


@query("SELECT least(5000, min(generation) - 1) AS covered FROM (SELECT o_orderkey + 1 AS generation FROM orders WHERE o_orderstatus = 'P')")
def capability_coverage(spark, sf_dir):
    from stratalens.operators import jobs

    pending = T.table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("generation"), (F.col("o_orderstatus") == "P").cast("int").alias("pending"))
    return spark.createDataFrame([(jobs.coverage(pending, 5000),)], "covered long")


@query("SELECT o_orderkey AS job, CASE WHEN o_orderstatus = 'F' THEN o_custkey % 5 + 1 ELSE o_custkey % 5 END AS attempts, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_custkey % 5 + 1 < 5 THEN 'queued' ELSE 'failed' END ELSE 'succeeded' END AS state, CASE WHEN o_orderstatus = 'F' AND o_custkey % 5 + 1 < 5 THEN 1000 + [1, 5, 30, 120, 600][o_custkey % 5 + 1] END AS not_before FROM orders")
def job_retries(spark, sf_dir):
    from stratalens.operators import jobs

    rows = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), (F.col("o_custkey") % 5).alias("attempts"), F.when(F.col("o_orderstatus") == "F", "running").otherwise("succeeded").alias("state"), F.lit(None).cast("long").alias("not_before"))
    return jobs.after_failure(rows, F.lit(1000).cast("long"))


@query("WITH r AS (SELECT p_partkey AS k, CASE WHEN p_size < 25 THEN 50 ELSE 500 END AS e FROM part), f AS (SELECT user_id AS k, count(*) AS times FROM events GROUP BY 1) SELECT f.k AS result_id, CASE WHEN r.k IS NULL THEN 'unknown' WHEN e <= 100 THEN 'expired' WHEN times > 1 THEN 'duplicate' ELSE 'ok' END AS refused, times FROM f LEFT JOIN r USING (k)")
def receipts_resolve(spark, sf_dir):
    from stratalens.operators import jobs

    r = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("result_id"), F.lit("A").alias("space_id"), F.col("p_partkey").alias("memory_id"), F.lit("r").alias("revision_id"), F.when(F.col("p_size") < 25, 50).otherwise(500).alias("expires_at"))
    f = T.table(spark, sf_dir, "events").select(F.col("user_id").alias("result_id"), F.lit("used").alias("outcome"))
    return jobs.resolve_receipts(r, f, 100).groupBy("result_id").agg(F.coalesce(F.min("refused"), F.lit("ok")).alias("refused"), F.count(F.lit(1)).alias("times"))


@query("SELECT sha256(text) AS artifact FROM documents WHERE doc_id <= 600 EXCEPT SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0 AND doc_id % 4 <> 0")
def garbage_collection(spark, sf_dir):
    from stratalens.operators import jobs

    docs = T.table(spark, sf_dir, "documents").withColumn("artifact", F.sha2("text", 256))
    made = docs.groupBy("artifact").agg(F.min("doc_id").alias("created_at"))
    roots = docs.where("doc_id % 3 = 0").select("artifact", F.when(F.col("doc_id") % 4 == 0, 5).alias("expires_at"))
    return jobs.garbage(made, roots, 700, 100).select("artifact")


METRIC = """WITH grades AS (SELECT o_custkey % 50 AS query_id, o_orderkey AS doc, 1 + o_orderkey % 3 AS grade FROM orders WHERE o_orderkey % 7 = 0),
listed AS (SELECT o_custkey % 50 AS query_id, o_orderkey AS doc, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank FROM orders),
h AS (SELECT query_id, count(*) AS hits, min(rank) AS first, sum((2 ** grade - 1) / log2(rank + 2)) AS dcg FROM listed JOIN grades USING (query_id, doc) WHERE rank < 10 GROUP BY 1),
i AS (SELECT query_id, count(*) AS n, sum(CASE WHEN r < 10 THEN (2 ** grade - 1) / log2(r + 2) ELSE 0 END) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc) - 1 AS r FROM grades) GROUP BY 1)"""


@query(METRIC + " SELECT query_id, round(coalesce(hits / n, 0), 6) AS recall, round(coalesce(1.0 / (first + 1), 0), 6) AS mrr, round(coalesce(dcg / ideal, 0), 6) AS ndcg FROM i LEFT JOIN h USING (query_id)")
def recall_mrr_ndcg(spark, sf_dir):
    from stratalens.operators import metrics

    orders = T.table(spark, sf_dir, "orders").withColumn("query_id", F.col("o_custkey") % 50).withColumnRenamed("o_orderkey", "doc")
    grades = orders.where("doc % 7 = 0").select("query_id", "doc", (1 + F.col("doc") % 3).alias("grade"))
    listed = top_per_group(orders, ["query_id"], [F.desc("o_totalprice"), F.col("doc")], 10).select("query_id", "doc", "rank")
    m = metrics.retrieval_metrics(listed, grades)
    return m.select("query_id", *(F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")))


@query("SELECT event_type, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.5) AS p50 FROM events GROUP BY event_type")
def nearest_rank_percentile(spark, sf_dir):
    from stratalens.operators import metrics

    return T.table(spark, sf_dir, "events").groupBy("event_type").agg(metrics.nearest_rank("value", 0.95).alias("p95"), metrics.nearest_rank("value", 0.5).alias("p50"))


@query("WITH b AS (SELECT quality, avg(n_chars) AS m FROM documents JOIN labels USING (doc_id) GROUP BY quality) SELECT quality, round(m / (SELECT m FROM b WHERE quality = 0) - 1, 6) AS delta, m >= (SELECT m FROM b WHERE quality = 0) AS accepted FROM b")
def quality_delta_gate(spark, sf_dir):
    means = T.table(spark, sf_dir, "documents").join(T.table(spark, sf_dir, "labels"), "doc_id").groupBy("quality").agg(F.avg("n_chars").alias("m"))
    base = means.where("quality = 0").first()
    return means.select("quality", F.round(F.col("m") / (base.m if base else None) - 1, 6).alias("delta"), (F.col("m") >= F.lit(base.m if base else None)).alias("accepted"))
