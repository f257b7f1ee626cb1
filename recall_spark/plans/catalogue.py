"""The engine's queries by name, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recall_spark.functions import embed
from recall_spark.functions import sentiment as S
from recall_spark.functions import text as X
from recall_spark.functions import vector as V
from recall_spark.operators import commands, context, crossindex, dynamics, filters, ingest, learning, lifecycle, observe, scoring, spatial, spread
from recall_spark.sources import views
from recall_spark.sources.views import AS_OF, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return add


def at() -> object:
    return views.as_of()


def r6(c) -> object:
    return F.round(c, 6)


# DuckDB's side of the views.
_H = "((conv_id * 5 + turn * 3) % 200)::INT"
NODES = f"""nodes AS (SELECT 'conv-' || conv_id AS index_id, conv_id || ':' || turn AS neuron_id, text AS content,
  0.1::DOUBLE + 0.9::DOUBLE * ((conv_id * 7 + turn * 13) % 100) / 100::DOUBLE AS energy, 0.1::DOUBLE AS base_energy, (turn % 4)::INT AS depth,
  TIMESTAMP '{AS_OF}' - to_hours(2 * {_H} + 1) AS created_at, TIMESTAMP '{AS_OF}' - to_hours({_H}) AS last_fired_at,
  1 + (conv_id + turn) % 25 AS access_count, conv_id::VARCHAR AS thread_id, role FROM conversations)"""
DOCS = f"""docs AS (SELECT lang AS index_id, doc_id::VARCHAR AS neuron_id, text AS content,
  0.1::DOUBLE + 0.9::DOUBLE * ((doc_id * 7) % 100) / 100::DOUBLE AS energy, (doc_id % 4)::INT AS depth,
  TIMESTAMP '{AS_OF}' - to_hours((doc_id % 200)::INT) AS last_fired_at, 1 + doc_id % 25 AS access_count, source, embedding
  FROM documents LEFT JOIN embeddings ON doc_id = vec_id)"""
EDGES = f"""edges AS (SELECT 'all' AS index_id, doc_id || ':' || (doc_id + k) AS synapse_id, doc_id::VARCHAR AS from_id, (doc_id + k)::VARCHAR AS to_id,
  0.1::DOUBLE + 0.9::DOUBLE * ((doc_id * 3 + k * 11) % 50) / 50::DOUBLE AS weight, 1 + (doc_id + k) % 9 AS co_fire_count,
  TIMESTAMP '{AS_OF}' - to_hours(((doc_id + k) % 50)::INT) AS last_co_fire, TIMESTAMP '{AS_OF}' - to_hours((50 + (doc_id * k) % 1000)::INT) AS created_at
  FROM documents, (SELECT unnest([1, 7, 31])::BIGINT AS k))"""
ADJ = f"{EDGES}, adj AS (SELECT index_id, from_id AS a, to_id AS b, weight, created_at, synapse_id FROM edges UNION ALL SELECT index_id, to_id, from_id, weight, created_at, synapse_id FROM edges)"
FIRES = "fires AS (SELECT 'all' AS index_id, user_id::VARCHAR AS neuron_id, ts, event_id AS seq FROM events)"
ACTIVITY = "activity AS (SELECT user_id::VARCHAR AS index_id, ts FROM events)"
_TOKENS = r"list_filter(string_split(trim(lower(regexp_replace({0}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))), ' '), lambda x: strlen(x) >= 2)"
_DYN = f"(0.5 + 0.5 * energy) * (0.8 + 0.2 / (1.0 + ((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_fired_at)) / 3.6e9) / 24.0)) * (1.0 + 0.1 * log10(access_count + 1.0)) * (1.0 / (1.0 + 0.2 * depth))"


def lexical_sql(query: str, content: str = "content", tk: str = "tk") -> str:
    """The lexical score of a literal query in DuckDB."""
    words = X.query_tokens(query)
    hit = lambda w: f"list_filter({tk}, lambda c: c = '{w}' OR (strlen(c) > 3 AND strlen('{w}') > 3 AND encode(c)[1:3] = encode('{w}')[1:3]))[1]"
    matched = " + ".join(f"(CASE WHEN {hit(w)} IS NOT NULL THEN 1 ELSE 0 END)" for w in words)
    partial = " + ".join(f"(CASE WHEN {hit(w)} <> '{w}' THEN 1 ELSE 0 END)" for w in words)
    base = f"((CASE WHEN contains(lower({content}), '{query.lower()}') THEN 10.0::DOUBLE ELSE 0.0 END) + 0.3::DOUBLE * ({partial}) + ({matched})::DOUBLE / {len(words)} * 5.0)"
    if len(query.encode()) > 20:
        return base
    most = f"greatest({len(query.encode())}, strlen(t))::DOUBLE"
    fuzzy = f"coalesce(list_sum(list_transform({tk}[1:8], lambda t: CASE WHEN 1.0 - levenshtein('{query.lower()}', t) / {most} > 0.7 THEN (1.0 - levenshtein('{query.lower()}', t) / {most}) * 2.0 ELSE 0.0::DOUBLE END)), 0)"
    return f"({base} + CASE WHEN {base} < 8.0 THEN {fuzzy} ELSE 0 END)"


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return views.conversation_nodes(spark, sf)


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return views.document_nodes(spark, sf)


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return views.document_edges(spark, sf)


# -- Filters and commands.
_FILTERS = {
    "find_energy_gt": ({"energy": {"$gt": 0.7}}, "energy > 0.7"),
    "find_range": ({"energy": {"$gte": 0.3, "$lt": 0.6}, "depth": {"$lte": 2}}, "energy >= 0.3 AND energy < 0.6 AND depth <= 2"),
    "find_eq": ({"depth": 1, "accessCount": {"$eq": 3}}, "depth = 1 AND access_count = 3"),
    "find_and_or_not": ({"$or": [{"depth": 0}, {"$and": [{"energy": {"$gt": 0.5}}, {"$not": {"role": "user"}}]}]}, "depth = 0 OR (energy > 0.5 AND role <> 'user')"),
    "find_in_nin": ({"depth": {"$in": [0, 3]}, "role": {"$nin": ["system", "tool"]}}, "depth IN (0, 3) AND role NOT IN ('system', 'tool')"),
    "find_regex": ({"content": {"$regex": "(?:^|\\s)[Tt]he\\s"}}, "regexp_matches(content, '(?:^|\\s)[Tt]he\\s')"),
    "find_contains": ({"content": {"$contains": "TION"}}, "contains(lower(content), 'tion')"),
    "find_exists": ({"role": {"$exists": True}, "missing": {"$exists": False}}, "role IS NOT NULL"),
    "find_metadata_eq": ({"role": "assistant", "thread_id": "7"}, "role = 'assistant' AND thread_id = '7'"),
    "find_ne_missing": ({"missing": {"$ne": "x"}, "$not": {"missing": {"$gt": 1}}, "role": {"$ne": "user"}}, "role <> 'user'"),
    "find_created": ({"createdAt": {"$gt": "2024-01-25 00:00:00"}}, "created_at > TIMESTAMP '2024-01-25 00:00:00'"),
    "find_unknown_operators": ({"energy": {"$near": 1}, "content": {"$regex": "("}}, "false"),
    "find_all": ({}, "true"),
}


def _register_filters() -> None:
    for name, (spec, where) in _FILTERS.items():

        def run(spark: SparkSession, sf: str, spec: dict = spec) -> DataFrame:
            return nodes(spark, sf).where(filters.compile_filter(spec)).select("index_id", "neuron_id", "energy", "depth")

        query(f"WITH {NODES} SELECT index_id, neuron_id, energy, depth FROM nodes WHERE {where}", name)(run)


_register_filters()


@query(f'WITH {NODES} SELECT neuron_id AS "_id", energy, access_count AS "accessCount" FROM nodes WHERE depth >= 1 ORDER BY access_count DESC, energy, neuron_id LIMIT 25 OFFSET 10')
def find_project_sort_skip_limit(spark, sf):
    return commands.find(nodes(spark, sf), {"depth": {"$gte": 1}}, [("accessCount", -1), ("energy", 1)], 10, 25, {"_id": 1, "energy": 1, "accessCount": 1})


@query(f'WITH {NODES} SELECT neuron_id AS "_id", content, energy, depth, access_count AS "accessCount", created_at AS "createdAt", last_fired_at AS "lastFiredAt" FROM nodes WHERE role = \'assistant\' ORDER BY energy DESC, neuron_id LIMIT 1')
def find_one(spark, sf):
    return commands.find(nodes(spark, sf), {"role": "assistant"}, limit=1, fields={"position": 0, "tags": 0, "metadata": 0})


@query(f"WITH {NODES} SELECT neuron_id AS \"_id\", role FROM nodes ORDER BY role DESC, energy DESC, neuron_id LIMIT 30")
def find_sort_metadata(spark, sf):
    found = commands.find(nodes(spark, sf), sort=[("role", -1), ("energy", -1)], limit=30, fields={"_id": 1, "metadata": 1})
    return found.select("_id", F.col("metadata")["role"].alias("role"))


@query(f"WITH {NODES} SELECT count(*)::BIGINT AS count FROM nodes WHERE energy > 0.4 AND role = 'user'")
def count_filtered(spark, sf):
    return commands.count(nodes(spark, sf), {"energy": {"$gt": 0.4}, "role": "user"})


@query(f'WITH {EDGES} SELECT synapse_id AS "_id", from_id AS "fromId", to_id AS "toId", weight, co_fire_count AS "coFireCount", last_co_fire AS "lastCoFire", created_at AS "createdAt" FROM edges WHERE weight > 0.8')
def find_synapses(spark, sf):
    return commands.find_synapses(edges(spark, sf), {"weight": {"$gt": 0.8}})


@query(f"WITH {NODES} SELECT role AS \"_id\", count(*)::BIGINT AS n, round(avg(energy), 6) AS mean FROM nodes WHERE depth < 3 GROUP BY role")
def aggregate_pipeline(spark, sf):
    own = nodes(spark, sf).withColumn("one", F.lit(1)).withColumn("metadata", F.map_concat("metadata", F.create_map(F.lit("one"), F.lit("1"))))
    out = commands.aggregate(own, [{"$match": {"depth": {"$lt": 3}}}, {"$group": {"_id": "$role", "n": {"$sum": 1}, "mean": {"$avg": "$energy"}}}])
    return out.select("_id", F.col("n").cast("long").alias("n"), r6("mean").alias("mean"))


@query(f"WITH {NODES} SELECT neuron_id, content, energy FROM nodes WHERE neuron_id = '3:0'")
def read_point(spark, sf):
    return nodes(spark, sf).where(F.col("neuron_id") == "3:0").select("neuron_id", "content", "energy")


@query(f"WITH {NODES} SELECT neuron_id, energy FROM nodes ORDER BY energy DESC, neuron_id LIMIT 100")
def recall_top_energy(spark, sf):
    return nodes(spark, sf).orderBy(F.desc("energy"), "neuron_id").limit(100).select("neuron_id", "energy")


@query(f"WITH {NODES} SELECT neuron_id, energy FROM nodes WHERE depth = 2 ORDER BY energy DESC, neuron_id LIMIT 50 OFFSET 5")
def recall_depth_filter(spark, sf):
    return commands.page(nodes(spark, sf).where(F.col("depth") == 2).orderBy(F.desc("energy"), "neuron_id"), 5, 50).select("neuron_id", "energy")


@query(f"WITH {EDGES} SELECT (weight > 0.05) AS alive, (weight > 0 AND weight <= 0.05) AS weak, count(*)::BIGINT AS n FROM (SELECT weight - 0.3 AS weight FROM edges) GROUP BY 1, 2")
def liveness(spark, sf):
    return edges(spark, sf).withColumn("weight", F.col("weight") - 0.3).groupBy(filters.edge_alive().alias("alive"), filters.edge_weak().alias("weak")).agg(F.count(F.lit(1)).alias("n"))


# -- Statistics.
@query(f"WITH {NODES} SELECT index_id, count(*)::BIGINT AS neuron_count, round(avg(energy), 6) AS avg_energy, 0::BIGINT AS synapse_count, 0.0::DOUBLE AS avg_weight FROM nodes GROUP BY index_id")
def index_stats(spark, sf):
    out = observe.index_stats(nodes(spark, sf), edges(spark, sf))
    return out.withColumns({"avg_energy": r6("avg_energy"), "avg_weight": r6("avg_weight")})


@query(f"WITH {NODES} SELECT index_id, depth, count(*)::BIGINT AS neurons FROM nodes GROUP BY index_id, depth")
def depth_histogram(spark, sf):
    return observe.depth_histogram(nodes(spark, sf))


@query(f"WITH {EDGES} SELECT index_id, row_number() OVER (PARTITION BY index_id ORDER BY weight, synapse_id)::INT AS rank, round(weight, 6) AS weight FROM edges")
def weight_list(spark, sf):
    return observe.weights(edges(spark, sf)).withColumn("weight", r6("weight"))


@query(f"WITH {NODES} SELECT index_id, count(*)::BIGINT AS neuron_count, round(sum(energy), 6) AS total_energy, 3::INT AS dim, max(last_fired_at) AS modified_at, 0::BIGINT AS synapse_count FROM nodes GROUP BY index_id")
def snapshot(spark, sf):
    return observe.snapshot(nodes(spark, sf), edges(spark, sf)).withColumn("total_energy", r6("total_energy"))


@query(f"WITH {FIRES} SELECT index_id, count(*)::BIGINT AS total_activations, max(ts) AS last_activity FROM fires GROUP BY index_id")
def activation_counters(spark, sf):
    return observe.activation_counters(views.fires(spark, sf))


@query(f"WITH {NODES} SELECT index_id, neuron_id AS id, content, energy, depth FROM nodes")
def graph_nodes(spark, sf):
    return observe.graph_nodes(nodes(spark, sf)).drop("position")


@query(f"WITH {EDGES} SELECT index_id, from_id AS source, to_id AS target, weight FROM edges")
def graph_edges(spark, sf):
    return observe.graph_edges(edges(spark, sf))


@query(
    f"""WITH {NODES}, {EDGES}, ev AS (
  SELECT last_fired_at AS t, 'neuron' AS type, 'FIRED' AS action, CASE WHEN strlen(content) <= 50 THEN content ELSE substring(content, 1, 50) || '...' END AS details, neuron_id AS key FROM nodes
  UNION ALL SELECT created_at, 'neuron', 'CREATED', CASE WHEN strlen(content) <= 50 THEN content ELSE substring(content, 1, 50) || '...' END, neuron_id FROM nodes
  UNION ALL SELECT last_co_fire, 'synapse', 'STRENGTHENED (' || printf('%.2f', weight) || ')', 'co-fired ' || co_fire_count || ' times', synapse_id FROM edges
  UNION ALL SELECT created_at, 'synapse', 'FORMED', 'weight: ' || printf('%.2f', weight), synapse_id FROM edges)
SELECT strftime(t, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, type, action, details, key FROM ev
WHERE epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(t) BETWEEN 0 AND 299999999 ORDER BY timestamp DESC, type, action, key LIMIT 100"""
)
def activity_feed(spark, sf):
    return observe.activity_feed(nodes(spark, sf), edges(spark, sf), at()).drop("index_id")


@query(
    f"""WITH {NODES}, {EDGES}, d AS (SELECT 'all' AS index_id, doc_id::VARCHAR AS neuron_id, text AS content FROM documents)
SELECT (SELECT count(*) FROM d)::BIGINT AS neurons_checked, (SELECT count(*) FROM edges)::BIGINT AS synapses_checked,
 (SELECT count(*) FROM edges WHERE from_id NOT IN (SELECT neuron_id FROM d) OR to_id NOT IN (SELECT neuron_id FROM d))::BIGINT AS dangling_synapses,
 (SELECT count(*) - count(DISTINCT content) FROM d)::BIGINT AS repeated_contents, 0::BIGINT AS bad_energy, 0::BIGINT AS bad_weight"""
)
def integrity_report(spark, sf):
    return observe.integrity(docs(spark, sf).withColumn("index_id", F.lit("all")), edges(spark, sf))


# -- Text and vectors.
@query(f"SELECT doc_id, len({_TOKENS.format('text')})::INT AS n_tokens FROM documents")
def tokenize_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(X.tokens(F.col("text"))).alias("n_tokens"))


@query(
    """SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
 substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1)::INT % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS content_hash
 FROM (SELECT doc_id, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(text)) AS h FROM documents)"""
)
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT doc_id, (strlen(text) <= 65536 AND trim(text) <> '') AS valid FROM documents")
def validate_content(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.valid_content(F.col("text")).alias("valid"))


@query("SELECT lang AS index_id, CASE WHEN count(*) FILTER (source = 'src0') = 0 THEN min(doc_id) END AS first_id, (count(*) - CASE WHEN count(*) FILTER (source = 'src0') = 0 THEN 1 ELSE 0 END)::BIGINT AS fires FROM documents GROUP BY lang, text")
def dedupe_first_and_fire_count(spark, sf):
    """All documents written to a store that holds those of one source: what is new, and what fires."""
    rows = table(spark, sf, "documents").selectExpr("lang as index_id", "doc_id as seq", "text as content", "source")
    stored = rows.where("source = 'src0'").select("index_id", X.content_hash(F.col("content")).alias("content_hash"))
    new, again = ingest.deduplicated(rows, stored)
    both = new.select("index_id", "content_hash", "seq").join(again, ["index_id", "content_hash"], "full")
    return both.select("index_id", F.col("seq").alias("first_id"), F.coalesce("fires", F.lit(0).cast("long")).alias("fires"))


_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<head\b[^>]*>.*?</head\s*>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[/!?a-zA-Z][^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT page_id, {_CLEAN.format('html')} AS cleaned FROM pages")
def clean_pages(spark, sf):
    """Without entities, whose unescaping SQL has no function for: they stay on both sides."""
    hidden = F.replace(F.col("html"), F.lit("&"), F.lit("\x01"))
    shown = F.replace(X.clean(F.replace(hidden, F.lit("\x01"), F.lit("␛"))), F.lit("␛"), F.lit("&"))
    return table(spark, sf, "pages").select("page_id", shown.alias("cleaned"))


@query(
    r"""SELECT doc_id, regexp_replace(text || '\x{2603}', '[\x{2600}-\x{26FF}\x{2702}-\x{27B0}\x{FE00}-\x{FE1F}\x{E000}-\x{F8FF}]', '', 'g') = text AS kept FROM documents""".replace("'\\x{2603}'", "chr(9731)")
)
def keep_printable(spark, sf):
    return table(spark, sf, "documents").select("doc_id", (X.keep_printable(F.concat("text", F.lit("☃"))) == F.col("text")).alias("kept"))


@query("SELECT DISTINCT a.r_name AS a, b.n_name AS b, levenshtein(lower(a.r_name), lower(b.n_name))::INT AS distance FROM region a, nation b WHERE a.r_regionkey = b.n_regionkey")
def levenshtein_ascii(spark, sf):
    a, b = table(spark, sf, "region"), table(spark, sf, "nation")
    return a.join(b, a.r_regionkey == b.n_regionkey).select(F.col("r_name").alias("a"), F.col("n_name").alias("b"), X.edit_distance(F.col("r_name"), F.col("n_name")).alias("distance")).distinct()


_QV = [round(((i * 37) % 17 - 8) / 10, 1) for i in range(64)]


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_QV}::DOUBLE[]), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20")
def cosine_topk(spark, sf):
    scored = table(spark, sf, "embeddings").select("vec_id", r6(V.cosine_to(F.col("embedding"), _QV)).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(20)


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 5) AS norm, 1.0::DOUBLE AS unit FROM embeddings")
def normalize_norms(spark, sf):
    v = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", F.round(V.norm(v), 5).alias("norm"), F.round(V.norm(V.normalised(F.transform(v, lambda x: x * 3.0))), 5).alias("unit"))


@query("SELECT label, i::INT AS i, round(avg(x), 5) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY label, i")
def centroid_by_label(spark, sf):
    flat = table(spark, sf, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    return flat.groupBy("label", "i").agg(F.round(F.avg("x"), 5).alias("x"))


# -- Ranked search.
def _ranked(found: DataFrame, k: int) -> DataFrame:
    return found.select("index_id", "neuron_id", r6("score").alias("score")).orderBy(F.desc("score"), "index_id", "neuron_id").limit(k)


def _search_sql(q: str, k: int, view: str = NODES, src: str = "nodes", factor: str = "1", where: str = "true") -> str:
    return f"""WITH {view}, t AS (SELECT *, {_TOKENS.format('content')} AS tk FROM {src} WHERE {where}), s AS (SELECT *, {lexical_sql(q)} AS lex FROM t)
SELECT index_id, neuron_id, round(lex * {_DYN} * {factor}, 6) AS score FROM s WHERE lex > 0 AND {factor} > 0 ORDER BY score DESC, index_id, neuron_id LIMIT {k}"""


@query(_search_sql("the nteres on that word", 50))
def lexical_search(spark, sf):
    return _ranked(scoring.scored(nodes(spark, sf), "the nteres on that word", at()), 50)


@query(_search_sql("anering", 50, DOCS, "docs", where="index_id = 'en'"))
def fuzzy_search(spark, sf):
    return _ranked(scoring.scored(docs(spark, sf).where("index_id = 'en'"), "anering", at()), 50)


_META = "(1.0 + 0.3 * ((CASE WHEN role = 'user' THEN 1 ELSE 0 END) + (CASE WHEN thread_id = '5' THEN 1 ELSE 0 END)))"


@query(_search_sql("the nteres on that word", 50, factor=_META))
def search_metadata_soft(spark, sf):
    return _ranked(scoring.scored(nodes(spark, sf), "the nteres on that word", at(), metadata={"role": "user", "thread_id": "5"}), 50)


@query(_search_sql("the nteres on that word", 50, factor="(CASE WHEN role = 'user' THEN 1.3 ELSE 0 END)"))
def search_metadata_strict(spark, sf):
    return _ranked(scoring.scored(nodes(spark, sf), "the nteres on that word", at(), metadata={"role": "user"}, strict=True), 50)


_HYBRID = f"""WITH {DOCS}, t AS (SELECT *, {_TOKENS.format('content')} AS tk FROM docs), l AS (SELECT *, {lexical_sql('the nteres on that word')} AS lex FROM t),
 s AS (SELECT *, CASE WHEN embedding IS NULL THEN lex ELSE 0.6 * greatest(0, list_cosine_similarity(embedding::DOUBLE[], {_QV}::DOUBLE[])) + 0.4 * tanh(lex / 10.0) END AS base FROM l)
 SELECT index_id, neuron_id, round(base * {_DYN}, 6) AS score FROM s WHERE base > 0"""


@query(f"{_HYBRID} ORDER BY score DESC, index_id, neuron_id LIMIT 50")
def hybrid_search(spark, sf):
    return _ranked(scoring.scored(docs(spark, sf), "the nteres on that word", at(), query_vector=_QV), 50)


_KEY = "CASE WHEN strlen({0}) > 3 THEN hex(encode({0})[1:3]) ELSE '=' || {0} END"


@query(
    f"""WITH {DOCS}, t AS (SELECT *, {_TOKENS.format('content')} AS tk FROM docs), q AS (SELECT item_id, text AS query, {_TOKENS.format('text')} AS qk FROM benchmark),
 c AS (SELECT neuron_id, unnest(tk) AS w, generate_subscripts(tk, 1) AS pos FROM t), k AS (SELECT neuron_id, {_KEY.format('w')} AS key, arg_min(w, pos) AS first FROM c GROUP BY 1, 2),
 a AS (SELECT item_id, w, {_KEY.format('w')} AS key, count(*) AS n FROM (SELECT item_id, unnest(qk) AS w FROM q) GROUP BY 1, 2, 3),
 m AS (SELECT item_id, neuron_id, sum(n)::DOUBLE AS matched, sum(CASE WHEN first <> w THEN n ELSE 0 END)::DOUBLE AS partial FROM a JOIN k USING (key) GROUP BY 1, 2),
 s AS (SELECT q.item_id, t.*, query, (CASE WHEN contains(lower(content), lower(query)) THEN 10.0::DOUBLE ELSE 0 END) + 0.3::DOUBLE * coalesce(partial, 0) + coalesce(matched, 0) / len(qk)::DOUBLE * 5.0::DOUBLE AS lex
  FROM q JOIN t ON len(qk) > 0 LEFT JOIN m ON m.item_id = q.item_id AND m.neuron_id = t.neuron_id),
 z AS (SELECT *, (lex + CASE WHEN strlen(query) <= 20 AND lex < 8.0 THEN coalesce(list_sum(list_transform(tk[1:8], lambda t: CASE WHEN 1.0 - levenshtein(lower(query), t) / greatest(strlen(query), strlen(t))::DOUBLE > 0.7 THEN (1.0 - levenshtein(lower(query), t) / greatest(strlen(query), strlen(t))::DOUBLE) * 2.0 ELSE 0.0::DOUBLE END)), 0) ELSE 0 END) * ({_DYN}) AS score FROM s)
 SELECT item_id AS query_id, rank::INT AS rank, index_id, neuron_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, neuron_id) AS rank FROM z WHERE score > 0) WHERE rank <= 10"""
)
def batch_search(spark, sf):
    """Every benchmark item, whole, against every index: the ten best nodes of each."""
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(None).cast("string").alias("index_id"), F.col("text").alias("query"))
    return scoring.batch(docs(spark, sf), asked, at(), 10).withColumn("score", r6("score"))


def _mood(c: str) -> str:
    return f"CASE WHEN {c} >= 0.6 THEN 'happiness' WHEN {c} >= 0.2 THEN 'surprise' WHEN {c} <= -0.6 THEN (CASE WHEN neu <= 0 OR neg / neu > 1.5 THEN 'anger' WHEN neu > neg THEN 'fear' ELSE 'disgust' END) WHEN {c} <= -0.2 THEN 'sadness' ELSE 'neutral' END"


_MOODS = f"m AS (SELECT event_id, {_mood('c')} AS label FROM (SELECT event_id, (event_id % 201 - 100) / 100.0::DOUBLE AS c, (event_id % 7) / 7.0::DOUBLE AS neg, (event_id % 5) / 5.0::DOUBLE AS neu FROM events))"


def _moods(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id", "(event_id % 201 - 100) / 100D as c", "(event_id % 7) / 7D as neg", "(event_id % 5) / 5D as neu")
    return e.select("event_id", S.label(F.col("c"), F.col("neg"), F.col("neu")).alias("label"))


@query(f"WITH {_MOODS} SELECT event_id, label FROM m")
def sentiment_label_ladder(spark, sf):
    return _moods(spark, sf)


@query(f"WITH {_MOODS} SELECT event_id, (CASE WHEN label = 'neutral' THEN 1.0 WHEN label = 'happiness' THEN 1.2 WHEN label IN ('sadness', 'fear', 'anger', 'disgust') THEN 0.8 ELSE 1.0 END)::DOUBLE AS boost FROM m")
def sentiment_boost(spark, sf):
    return _moods(spark, sf).select("event_id", S.boost(F.lit("happiness"), F.col("label")).alias("boost"))


# -- Graph.
def _seeds(spark, sf):
    return table(spark, sf, "documents").where("doc_id % 50 = 0").selectExpr("'all' as index_id", "cast(doc_id as string) as neuron_id", "1D + doc_id % 7 as score")


_HOP = """p{n} AS (SELECT f.index_id, a.b, f.score * a.weight * {factor} AS score, f.rank, a.created_at, a.synapse_id FROM f{m} f JOIN adj a ON a.a = f.neuron_id AND a.index_id = f.index_id
  WHERE f.score * a.weight * {factor} > 0.1 AND a.b NOT IN (SELECT neuron_id FROM r{m}) AND a.b IN (SELECT doc_id::VARCHAR FROM documents)),
 w{n} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY rank, created_at, synapse_id) AS n FROM p{n}) WHERE n = 1),
 f{n} AS (SELECT index_id, b AS neuron_id, score, row_number() OVER (ORDER BY rank, created_at, synapse_id) AS rank FROM w{n}),
 r{n} AS (SELECT * FROM r{m} UNION ALL SELECT index_id, neuron_id, score, {n} AS hop FROM f{n})"""


def _spread_sql(depth: int) -> str:
    hops = ", ".join(_HOP.format(n=d + 1, m=d, factor=f"(1.0::DOUBLE / {d + 2})") for d in range(depth))
    seeds = "f0 AS (SELECT 'all' AS index_id, doc_id::VARCHAR AS neuron_id, 1.0::DOUBLE + doc_id % 7 AS score, row_number() OVER (ORDER BY 1.0::DOUBLE + doc_id % 7 DESC, doc_id::VARCHAR) AS rank FROM documents WHERE doc_id % 50 = 0), r0 AS (SELECT index_id, neuron_id, score, 0 AS hop FROM f0)"
    return f"WITH {ADJ}, {seeds}, {hops} SELECT neuron_id, round(score, 6) AS score, hop FROM r{depth}"


def _spread(depth: int) -> None:
    def run(spark, sf):
        ids = docs(spark, sf).select(F.lit("all").alias("index_id"), "neuron_id")
        return spread.spread(_seeds(spark, sf), edges(spark, sf), ids, depth).select("neuron_id", r6("score").alias("score"), "hop")

    query(_spread_sql(depth), f"spread_depth{depth}")(run)


for _depth in (1, 2, 3):
    _spread(_depth)


@query(f"WITH {ADJ} SELECT index_id, a AS neuron_id, b AS neighbour_id, weight FROM adj WHERE weight >= 0.6")
def neighbours_min_weight(spark, sf):
    return spread.neighbours(edges(spark, sf), 0.6)


@query(f"WITH {ADJ} SELECT index_id, a AS neuron_id, count(*)::BIGINT AS degree FROM adj GROUP BY index_id, a")
def degree(spark, sf):
    return spread.degrees(edges(spark, sf))


@query(f"WITH {EDGES}, p AS (SELECT 'all' AS index_id, doc_id::VARCHAR AS a, (doc_id - 7)::VARCHAR AS b FROM documents) SELECT p.index_id, a, b, coalesce(max(weight), 0.0) AS weight FROM p LEFT JOIN edges e ON (from_id = a AND to_id = b) OR (from_id = b AND to_id = a) GROUP BY p.index_id, a, b")
def edge_weight_lookup(spark, sf):
    pairs = table(spark, sf, "documents").selectExpr("'all' as index_id", "cast(doc_id as string) as a", "cast(doc_id - 7 as string) as b")
    return spread.edge_weight(edges(spark, sf), pairs)


@query(
    f"""WITH {NODES}, t AS (SELECT *, {_TOKENS.format('content')} AS tk FROM nodes), s AS (SELECT *, {lexical_sql('the that word with')} AS lex FROM t),
 seeds AS (SELECT index_id, neuron_id, lex * {_DYN} AS score FROM s WHERE lex > 0),
 e AS (SELECT a.index_id, a.neuron_id AS x, b.neuron_id AS y FROM (SELECT index_id, neuron_id, split_part(neuron_id, ':', 2)::INT AS n FROM nodes) a JOIN (SELECT index_id, neuron_id, split_part(neuron_id, ':', 2)::INT AS n FROM nodes) b ON a.index_id = b.index_id AND b.n = a.n + 1),
 adj AS (SELECT index_id, x AS a, y AS b, x || '>' || y AS id FROM e UNION ALL SELECT index_id, y, x, x || '>' || y FROM e),
 rk AS (SELECT *, row_number() OVER (PARTITION BY index_id ORDER BY score DESC, neuron_id) AS rank FROM seeds),
 hop AS (SELECT r.index_id, b AS neuron_id, r.score * 0.5::DOUBLE * (1.0::DOUBLE / 2) AS score, row_number() OVER (PARTITION BY r.index_id, b ORDER BY r.rank, id) AS n FROM rk r JOIN adj ON adj.index_id = r.index_id AND adj.a = r.neuron_id WHERE r.score * 0.5::DOUBLE * (1.0::DOUBLE / 2) > 0.1 AND (r.index_id, b) NOT IN (SELECT (index_id, neuron_id) FROM seeds))
 SELECT index_id, neuron_id, round(score, 6) AS score FROM (SELECT index_id, neuron_id, score FROM seeds UNION ALL SELECT index_id, neuron_id, score FROM hop WHERE n = 1)"""
)
def search_with_spread(spark, sf):
    own = nodes(spark, sf)
    turn = F.split("neuron_id", ":")[1].cast("int")
    here = own.select("index_id", F.col("neuron_id").alias("from_id"), turn.alias("n"))
    nxt = own.select("index_id", F.col("neuron_id").alias("to_id"), (turn - 1).alias("n"))
    links = here.join(nxt, ["index_id", "n"]).select("index_id", F.concat_ws(">", "from_id", "to_id").alias("synapse_id"), "from_id", "to_id", F.lit(0.5).alias("weight"), at().alias("created_at"))
    seeds = scoring.scored(own, "the that word with", at()).select("index_id", "neuron_id", "score")
    return spread.spread(seeds, links, own, 1).select("index_id", "neuron_id", r6("score").alias("score"))


# -- Learning.
def _pairs_sql(seconds: int) -> str:
    return f"""{FIRES}, met AS (SELECT DISTINCT x.index_id, x.neuron_id AS a, y.neuron_id AS b, x.ts, x.seq FROM fires x JOIN fires y ON x.neuron_id <> y.neuron_id
  AND y.ts BETWEEN x.ts - INTERVAL {seconds} SECOND AND x.ts AND (y.ts < x.ts OR y.seq < x.seq)),
 pairs AS (SELECT index_id, least(a, b) AS from_id, greatest(a, b) AS to_id, count(*)::BIGINT AS co_fire_count, max(ts) AS last_co_fire, min(ts) AS created_at FROM met GROUP BY 1, 2, 3)"""


@query(f"WITH {_pairs_sql(5)} SELECT * FROM pairs")
def coactivation_pairs(spark, sf):
    return learning.pair_counts(views.fires(spark, sf))


@query(f"WITH {_pairs_sql(60)} SELECT from_id || ':' || to_id AS synapse_id, round(1.0 - 0.8::DOUBLE * pow(0.9::DOUBLE, co_fire_count - 1), 6) AS weight, co_fire_count FROM pairs")
def learned_weights(spark, sf):
    return learning.learn(views.fires(spark, sf), 60.0).select("synapse_id", r6("weight").alias("weight"), "co_fire_count")


@query(f"WITH {FIRES} SELECT neuron_id, seq, lag(ts) OVER (PARTITION BY neuron_id ORDER BY ts, seq) AS previous_ts FROM fires")
def last_fire_before(spark, sf):
    return learning.last_fire_before(views.fires(spark, sf)).select("neuron_id", "seq", "previous_ts")


# -- Dynamics.
@query(f"WITH {NODES}, ev AS (SELECT 'conv-' || (event_id % 40) AS index_id, (event_id % 40) || ':' || (user_id % 4) AS neuron_id, ts FROM events), c AS (SELECT index_id, neuron_id, count(*) AS n, max(ts) AS t FROM ev GROUP BY 1, 2) SELECT neuron_id, round(CASE WHEN n > 0 THEN least(1.0, energy + 0.3 * n) ELSE energy END, 6) AS energy, (access_count + coalesce(n, 0))::BIGINT AS access_count, coalesce(t, last_fired_at) AS last_fired_at FROM nodes LEFT JOIN c USING (index_id, neuron_id)")
def apply_fires(spark, sf):
    ev = table(spark, sf, "events").selectExpr("concat('conv-', event_id % 40) as index_id", "concat(event_id % 40, ':', user_id % 4) as neuron_id", "ts")
    return dynamics.apply_fires(nodes(spark, sf), ev).select("neuron_id", r6("energy").alias("energy"), "access_count", "last_fired_at")


@query(f"WITH {NODES} SELECT neuron_id, round(greatest(0.1, energy - 0.1 * (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_fired_at)) / 1e6 / 3600.0), 6) AS energy FROM nodes")
def node_decay(spark, sf):
    return dynamics.decay_nodes(nodes(spark, sf), at()).select("neuron_id", r6("energy").alias("energy"))


@query(f"WITH {EDGES} SELECT synapse_id, round(greatest(0.0, weight - 0.01 * (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_co_fire)) / 1e6 / 3600.0), 6) AS weight FROM edges")
def edge_decay_tick(spark, sf):
    return dynamics.decay_edges(edges(spark, sf), at()).select("synapse_id", r6("weight").alias("weight"))


@query(f"WITH {EDGES} SELECT synapse_id, round(greatest(0.0, weight - 0.01 * 60 * (co_fire_count * 10) * (co_fire_count * 10 + 1) / 7200.0), 6) AS weight FROM edges")
def edge_decay_closed(spark, sf):
    return edges(spark, sf).select("synapse_id", r6(dynamics.decayed_weight(F.col("weight"), F.col("co_fire_count") * 10, 60.0)).alias("weight"))


@query(f"WITH {EDGES} SELECT synapse_id FROM edges WHERE weight - 0.3::DOUBLE > 0.05")
def prune_edges(spark, sf):
    return dynamics.prune_edges(edges(spark, sf).withColumn("weight", F.col("weight") - 0.3)).select("synapse_id")


@query(f"WITH {EDGES}, d AS (SELECT doc_id::VARCHAR AS id FROM documents WHERE doc_id % 100 >= 30) SELECT synapse_id FROM edges WHERE weight > 0.05 AND from_id IN (SELECT id FROM d) AND to_id IN (SELECT id FROM d)")
def prune_nodes_cascade(spark, sf):
    own = table(spark, sf, "documents").selectExpr("'all' as index_id", "cast(doc_id as string) as neuron_id", "if(doc_id % 100 < 30, 0.005D, 0.5D) as energy")
    return dynamics.prune(own, edges(spark, sf))[1].select("synapse_id")


@query(f"WITH {NODES} SELECT neuron_id, (depth + (CASE WHEN access_count >= 10 AND TIMESTAMP '{AS_OF}' - created_at >= INTERVAL 30 MINUTE AND energy < 0.5 THEN 1 ELSE 0 END))::INT AS depth FROM nodes")
def consolidate(spark, sf):
    return dynamics.consolidate(nodes(spark, sf), at()).select("neuron_id", "depth")


@query(f"WITH {EDGES}, n AS (SELECT 'all' AS index_id, count(*) AS n FROM documents), e AS (SELECT index_id, count(*) AS e FROM edges GROUP BY 1), d AS (SELECT index_id, 2.0::DOUBLE * e / n AS deg FROM n JOIN e USING (index_id)) SELECT index_id, round(deg, 6) AS avg_degree, round((CASE WHEN deg < 3 THEN least(0.3, 0.1 * 1.1) WHEN deg > 20 THEN greatest(0.05, 0.1 * 0.9) ELSE 0.1 END)::DOUBLE, 6) AS learning_rate, round((CASE WHEN deg < 3 THEN greatest(0.1, 0.3 * 0.9) WHEN deg > 20 THEN least(0.5, 0.3 * 1.1) ELSE 0.3 END)::DOUBLE, 6) AS min_weight FROM d")
def self_tune(spark, sf):
    own = table(spark, sf, "documents").selectExpr("'all' as index_id", "cast(doc_id as string) as neuron_id")
    out = dynamics.self_tune(own, edges(spark, sf))
    return out.select("index_id", *[r6(c).alias(c) for c in ("avg_degree", "learning_rate", "min_weight")])


@query("SELECT lang AS index_id, greatest(3, least(1000, ceil(count(*) / 100.0)::INT))::INT AS dim FROM documents GROUP BY lang")
def dimension_growth(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("lang").alias("index_id")).agg(spatial.dimension(F.count(F.lit(1))).alias("dim"))


@query(f"WITH {ADJ}, p AS (SELECT doc_id::VARCHAR AS b, (doc_id % 11) / 11.0::DOUBLE AS x, (doc_id % 13) / 13.0::DOUBLE AS y FROM documents) SELECT a AS neuron_id, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM adj JOIN p USING (b) WHERE weight > 0.3 GROUP BY a")
def neighbour_centroid(spark, sf):
    own = table(spark, sf, "documents").selectExpr("'all' as index_id", "cast(doc_id as string) as neuron_id", "array(doc_id % 11 / 11D, doc_id % 13 / 13D) as position")
    return spatial.neighbour_centroids(own, edges(spark, sf)).select("neuron_id", r6(F.col("centroid")[0]).alias("cx"), r6(F.col("centroid")[1]).alias("cy"))


@query(f"WITH {EDGES} SELECT synapse_id, round(least(1.0, weight + 0.2), 6) AS stronger, round(greatest(0.0, weight - 0.5), 6) AS weaker FROM edges")
def edge_strengthen_weaken(spark, sf):
    w = F.col("weight")
    return edges(spark, sf).select("synapse_id", r6(dynamics.strengthen(w, 0.2)).alias("stronger"), r6(dynamics.weaken(w, 0.5)).alias("weaker"))


@query(f"WITH {NODES} SELECT neuron_id, round(least(1.0, energy + 0.25), 6) AS boosted, round(least(1.0, energy + 0.6), 6) AS fired_twice FROM nodes")
def reactivate(spark, sf):
    e = F.col("energy")
    return nodes(spark, sf).select("neuron_id", r6(dynamics.reactivate(e, 0.25)).alias("boosted"), r6(dynamics.fire(e, 2)).alias("fired_twice"))


@query(f"WITH {NODES} SELECT neuron_id, CASE WHEN role = 'user' THEN 'set' ELSE content END AS content, round(CASE WHEN role = 'user' THEN greatest(0.0, least(1.0, energy - 0.4)) ELSE energy END, 6) AS energy, CASE WHEN role = 'user' THEN role || ',new' ELSE role END AS tags, CASE WHEN role = 'user' THEN 't1' ELSE thread_id END AS thread_id, role FROM nodes")
def update_operators(spark, sf):
    spec = {"$set": {"content": "set", "metadata": {"thread_id": "t1"}}, "$inc": {"energy": -0.4}, "$push": {"tags": "new"}}
    out = dynamics.update(nodes(spark, sf), filters.compile_filter({"role": "user"}), spec)
    return out.select("neuron_id", "content", r6("energy").alias("energy"), F.array_join("tags", ",").alias("tags"), F.col("metadata")["thread_id"].alias("thread_id"), F.col("metadata")["role"].alias("role"))


@query(f"WITH {EDGES} SELECT synapse_id FROM edges WHERE from_id::BIGINT % 10 <> 3 AND to_id::BIGINT % 10 <> 3")
def delete_cascade(spark, sf):
    own = docs(spark, sf).select(F.lit("all").alias("index_id"), "neuron_id")
    ends = edges(spark, sf).select(F.explode(F.array("from_id", "to_id")).alias("neuron_id")).distinct()
    gone = ends.where(F.col("neuron_id").cast("long") % 10 == 3).withColumn("index_id", F.lit("all"))
    return dynamics.delete_nodes(own, edges(spark, sf), gone)[1].select("synapse_id")


@query(f"WITH {EDGES} SELECT synapse_id FROM edges WHERE weight - 0.5::DOUBLE < 0.01 AND TIMESTAMP '2024-03-03 00:00:00' - last_co_fire > INTERVAL 30 DAY")
def archivable_edges(spark, sf):
    late = F.lit("2024-03-03 00:00:00").cast("timestamp_ntz")
    return edges(spark, sf).withColumn("weight", F.col("weight") - 0.5).where(filters.archivable(late)).select("synapse_id")


@query("WITH old AS (SELECT n_nationkey::VARCHAR AS uuid, n_name AS name FROM nation), new AS (SELECT r_regionkey::VARCHAR AS uuid, r_name AS name FROM region UNION ALL SELECT 'x' || r_regionkey, r_name FROM region) SELECT coalesce(o.uuid, n.uuid) AS uuid, coalesce(n.name, o.name) AS name FROM old o FULL JOIN new n ON o.uuid = n.uuid")
def registry_upsert(spark, sf):
    from recall_spark.sources.registry import Registry

    times = ["timestamp_ntz'2024-01-01' as created_at", "timestamp_ntz'2024-01-02' as updated_at"]
    old = table(spark, sf, "nation").selectExpr("cast(n_nationkey as string) as uuid", "map('name', n_name) as metadata", *times)
    region = table(spark, sf, "region")
    new = region.selectExpr("cast(r_regionkey as string) as uuid", "map('name', r_name) as metadata", *times).unionByName(region.selectExpr("concat('x', r_regionkey) as uuid", "map('name', r_name) as metadata", *times))
    return Registry(old).upserted(new).entries.select("uuid", F.col("metadata")["name"].alias("name"))


# -- Lifecycle.
_LAST = f"{ACTIVITY}, last AS (SELECT index_id, max(ts) AS last_activity, count(*)::BIGINT AS invoke_count, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(ts))) / 1e6 AS el FROM activity GROUP BY 1), st AS (SELECT *, CASE WHEN el > 1800 THEN 'dormant' WHEN el > 300 THEN 'sleeping' WHEN el > 30 THEN 'idle' ELSE 'active' END AS state FROM last)"
_NOW = "2024-01-31 00:00:00"


def _now():
    return F.lit(_NOW).cast("timestamp_ntz")


@query(f"WITH {_LAST} SELECT index_id, last_activity, invoke_count, state FROM st")
def lifecycle_state(spark, sf):
    return lifecycle.states(views.activity(spark, sf), _now())


@query(f"WITH {_LAST} SELECT count(*)::BIGINT AS total, " + ", ".join(f"count(*) FILTER (state = '{s}')::BIGINT AS {s}" for s in lifecycle.STATES) + " FROM st")
def state_distribution(spark, sf):
    return lifecycle.distribution(lifecycle.states(views.activity(spark, sf), _now()))


@query(f"WITH {ACTIVITY}, a AS (SELECT index_id, ts, epoch_us(ts) // 1000000 AS e FROM activity) SELECT index_id, ts, count(*) OVER w::BIGINT AS recent_ops, count(*) OVER w < 3 AS sparse FROM a WINDOW w AS (PARTITION BY index_id ORDER BY e RANGE BETWEEN 30 PRECEDING AND CURRENT ROW)".replace("count(*) OVER w::BIGINT", "(count(*) OVER w)::BIGINT"))
def sparseness_30s(spark, sf):
    return lifecycle.sparseness(views.activity(spark, sf))


@query(f"WITH {ACTIVITY}, g AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY index_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY index_id ORDER BY ts) > INTERVAL 5 MINUTE THEN 1 ELSE 0 END AS new FROM activity), n AS (SELECT *, sum(new) OVER (PARTITION BY index_id ORDER BY ts)::BIGINT AS session FROM g) SELECT index_id, session, min(ts) AS started, max(ts) AS ended, count(*)::BIGINT AS ops FROM n GROUP BY 1, 2")
def sessions_5m(spark, sf):
    return lifecycle.sessions(views.activity(spark, sf))


@query(f"WITH {_LAST} SELECT index_id, last_activity AS last_op, invoke_count AS ops_processed FROM st WHERE el > 1800")
def idle_eviction(spark, sf):
    return lifecycle.evicted(views.activity(spark, sf), _now())


@query(f"WITH {_LAST} SELECT count(*) FILTER (el <= 1800)::BIGINT AS active_workers, count(*)::BIGINT AS total_created, count(*) FILTER (el > 1800)::BIGINT AS total_evicted, sum(invoke_count)::BIGINT AS total_ops FROM st")
def pool_stats(spark, sf):
    return lifecycle.pool_stats(views.activity(spark, sf), _now())


@query(
    """WITH RECURSIVE w AS (SELECT user_id AS client, min(ts) AS began FROM events GROUP BY 1
  UNION ALL SELECT w.client, min(e.ts) FROM w JOIN events e ON e.user_id = w.client AND e.ts >= w.began + INTERVAL 6 HOUR GROUP BY w.client),
 n AS (SELECT user_id AS client, event_id AS request_id, ts, (SELECT max(began) FROM w WHERE w.client = e.user_id AND began <= e.ts) AS began FROM events e),
 r AS (SELECT *, row_number() OVER (PARTITION BY client, began ORDER BY ts, request_id) AS n FROM n) SELECT client, request_id, n FROM r WHERE n > 1"""
)
def rate_limit_fixed_window(spark, sf):
    """One request a client in six hours, from the first after the last window ran out."""
    asked = table(spark, sf, "events").selectExpr("user_id as client", "event_id as request_id", "ts")
    return lifecycle.rate_limited(asked, 1, 6 * 3600).select("client", "request_id", "n")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_rollup(spark, sf):
    return table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT user_id, max_by(event_id, event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY user_id")
def coalesced_writes(spark, sf):
    from recall_spark.streaming.stateful import coalesced

    return coalesced(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id")


# -- Context and many indexes.
_RANKED = f"{NODES}, rk AS (SELECT *, row_number() OVER (PARTITION BY index_id ORDER BY energy DESC, neuron_id) AS rank, (strlen(content) // 4)::BIGINT AS tokens FROM nodes), us AS (SELECT *, sum(tokens) OVER (PARTITION BY index_id ORDER BY rank)::BIGINT AS used FROM rk)"


def _by_energy(spark, sf):
    by = Window.partitionBy("index_id").orderBy(F.desc("energy"), "neuron_id")
    return nodes(spark, sf).withColumn("rank", F.row_number().over(by))


@query(f"WITH {_RANKED} SELECT index_id, string_agg(content || CASE WHEN depth > 0 THEN ' [depth:' || depth || ']' ELSE '' END, chr(10) || '---' || chr(10) ORDER BY rank) AS context, count(*)::BIGINT AS neurons_used, max(used) AS estimated_tokens FROM us WHERE used <= 500 GROUP BY index_id")
def context_budget(spark, sf):
    return context.assembled(_by_energy(spark, sf), 500, ["index_id"])


_EACH = f"""{NODES}, t AS (SELECT *, {_TOKENS.format('content')} AS tk FROM nodes), s AS (SELECT *, {lexical_sql('the that word with')} AS lex FROM t), z AS (SELECT *, round(lex * {_DYN}, 6) AS score FROM s WHERE lex > 0),
 k AS (SELECT *, row_number() OVER (PARTITION BY index_id ORDER BY score DESC, neuron_id)::INT AS rank FROM z)"""


@query(f"WITH {_EACH} SELECT index_id, neuron_id, energy * access_count AS merit FROM k WHERE rank <= 3 ORDER BY merit DESC, index_id, neuron_id LIMIT 15")
def global_search(spark, sf):
    return crossindex.search_all(nodes(spark, sf), "the that word with", at(), 3).select("index_id", "neuron_id", (F.col("energy") * F.col("access_count")).alias("merit"))


@query(f"WITH {_EACH} SELECT index_id, neuron_id, rank FROM k WHERE rank <= 2 AND index_id IN ('conv-1', 'conv-3', 'conv-9999')")
def multi_search(spark, sf):
    return crossindex.search_many(nodes(spark, sf), ["conv-1", "conv-3", "conv-9999"], "the that word with", at(), 2).select("index_id", "neuron_id", "rank")


_USERS = "nn AS (SELECT (doc_id % 97)::VARCHAR AS index_id, count(*)::BIGINT AS neuron_count FROM documents GROUP BY 1)"


def _user_nodes(spark, sf):
    return table(spark, sf, "documents").selectExpr("cast(doc_id % 97 as string) as index_id", "cast(doc_id as string) as neuron_id")


@query(f"WITH {ACTIVITY}, {_USERS}, o AS (SELECT index_id, max(ts) AS last_op, count(*)::BIGINT AS ops_processed FROM activity GROUP BY 1) SELECT index_id, last_op, ops_processed, neuron_count FROM o JOIN nn USING (index_id) WHERE neuron_count >= 5 ORDER BY last_op DESC, index_id LIMIT 20")
def recent_indexes(spark, sf):
    return crossindex.recent(_user_nodes(spark, sf), edges(spark, sf), views.activity(spark, sf), 20, 5).select("index_id", "last_op", "ops_processed", "neuron_count")


@query(f"WITH {ACTIVITY}, {_USERS}, reg AS (SELECT n_nationkey::VARCHAR AS index_id, n_name AS name FROM nation), o AS (SELECT index_id, max(ts) AS last_op, count(*)::BIGINT AS ops FROM activity GROUP BY 1) SELECT index_id, name, o.last_op IS NOT NULL AS active, coalesce(neuron_count, 0)::BIGINT AS neuron_count FROM reg LEFT JOIN o USING (index_id) LEFT JOIN nn USING (index_id)")
def list_indexes(spark, sf):
    reg = table(spark, sf, "nation").selectExpr("cast(n_nationkey as string) as uuid", "map('name', n_name) as metadata", "timestamp_ntz'2024-01-01' as created_at", "timestamp_ntz'2024-01-01' as updated_at")
    out = crossindex.catalog(_user_nodes(spark, sf), edges(spark, sf), views.activity(spark, sf), reg)
    return out.select("index_id", F.col("metadata")["name"].alias("name"), "active", "neuron_count")


@query("WITH a AS (SELECT item_id, lower(w) AS w, n1 FROM (SELECT item_id, unnest(string_split_regex(trim(text), '\\s+')) AS w, len(string_split_regex(trim(text), '\\s+')) AS n1 FROM benchmark)), b AS (SELECT conv_id || ':' || turn AS nid, ws, len(ws) AS n2 FROM (SELECT *, list_filter(string_split_regex(lower(trim(text)), '\\s+'), lambda x: x <> '') AS ws FROM conversations)), bb AS (SELECT DISTINCT nid, n2, unnest(ws) AS w FROM b), s AS (SELECT item_id, nid, count(*)::DOUBLE / greatest(any_value(n1), any_value(n2)) AS sc FROM a JOIN bb USING (w) WHERE a.w <> '' GROUP BY 1, 2) SELECT item_id, round(max(sc), 6) AS overlap FROM s GROUP BY 1")
def nearest_by_words(spark, sf):
    new = table(spark, sf, "benchmark").selectExpr("'all' as index_id", "cast(item_id as string) as content_hash", "text as content")
    found = ingest.nearest_by_words(new, nodes(spark, sf).withColumn("index_id", F.lit("all")))
    return found.select(F.col("content_hash").cast("long").alias("item_id"), r6("overlap").alias("overlap"))


# -- Without SQL: rows only.
@query()
def sentence_chunks(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(X.chunks(F.col("text"), 40)).alias("chunk", "text"))


@query()
def spatial_reorg_step(spark, sf):
    own = table(spark, sf, "documents").selectExpr("'all' as index_id", "cast(doc_id as string) as neuron_id").withColumn("position", spatial.random_position(F.col("neuron_id"), 3))
    moved = spatial.reorganise(own, edges(spark, sf))
    return moved.select("neuron_id", *[r6(F.col("position")[i]).alias(f"p{i}") for i in range(3)])


@query()
def hashing_embedding(spark, sf):
    v = embed.HashingEmbedder(16).column(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.round(V.norm(v), 5).alias("norm"))


@query()
def sentiment_scores(spark, sf):
    return S.analysed(table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("content"))).drop("content")


@query()
def ingest_documents(spark, sf):
    from recall_spark import schema

    rows = table(spark, sf, "documents").selectExpr("lang as index_id", "doc_id as seq", "text as content")
    done = ingest.write(spark.createDataFrame([], schema.NEURONS_DDL), rows, at())
    return done.neurons.select("index_id", "neuron_id", "energy", "access_count", "sentiment_label", F.size("position").alias("dim"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid ranked search over documents, spread by one hop within each language."""
    own = docs(spark, sf_dir)
    seeds = scoring.top(scoring.scored(own, "the nteres on that word", at(), query_vector=_QV), 20).select("index_id", "neuron_id", "score")
    links = edges(spark, sf_dir).drop("index_id").join(own.select("index_id", F.col("neuron_id").alias("from_id")), "from_id")
    reached = spread.spread(seeds, links, own, 1)
    return reached.join(own.select("index_id", "neuron_id", "content"), ["index_id", "neuron_id"]).select("index_id", "neuron_id", "score", "hop", F.substring("content", 1, 80).alias("content"))
