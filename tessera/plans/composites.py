"""Queries: composite stages, runs and their control, connectors, publishing, and what models are called through."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import rules as RU
from ..operators import answers as A
from ..operators import graph as G
from ..operators import ingestion as I
from ..providers import Prompts, RateLimiter, TtlCache, complete, retry, structured
from ..registry import query
from ..sources import connectors as N
from ..sources.shared import shared_dir
from ..streaming import queues as K
from .stages import Runner, Stage, closure, construction

c = F.col
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def _fresh(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}/{uuid.uuid4().hex}"


def _values(rows: list[tuple], names: str) -> str:
    """A VALUES list of small results that are known beforehand."""
    cell = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") v({names})"


@query("P03_compress_stage", "videos", sql=r"""
WITH u AS (SELECT video_id, length(transcript) AS n, array_to_string(list_filter(list_transform(regexp_split_to_array(transcript, '\n\s*\n|\n'), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text FROM videos WHERE transcript IS NOT NULL AND trim(transcript) <> ''),
a AS (SELECT video_id, n, regexp_replace(regexp_replace(regexp_replace(text, '\s+([''’])\s*([A-Za-z0-9_])', '\1\2', 'g'), '([A-Za-z0-9_])\s*-\s+([A-Za-z0-9_])', '\1-\2', 'g'), '([A-Za-z0-9_])\s*_\s*([A-Za-z0-9_])', '\1_\2', 'g') AS t FROM u),
b AS (SELECT video_id, n, trim(regexp_replace(CASE WHEN 2 * len(list_filter(string_split(t, chr(10)), lambda x: length(trim(x)) <= 1)) > len(string_split(t, chr(10))) THEN replace(t, chr(10), '') ELSE t END, '\s+', ' ', 'g')) AS t FROM a)
SELECT video_id, sha256(t) AS h, round(length(t) / n, 6) AS ratio FROM b WHERE t <> ''""")
def _(v):
    return I.compressed(v).select("video_id", F.sha2("compressed_text", 256).alias("h"), F.round("ratio", 6).alias("ratio"))


@query("P05_enrich_stage", "chunks", sql="""
SELECT chunk_id, CASE WHEN chunk_id % 10 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN chunk_id % 10 = 0 THEN 0 ELSE 1 END AS entities, CASE WHEN chunk_id % 10 = 0 THEN 0.0 ELSE round((0.4 + 0.4 * redundancy_score) / 0.8, 6) END AS score,
  CASE WHEN chunk_id % 10 = 0 THEN 'low' WHEN (0.4 + 0.4 * redundancy_score) / 0.8 >= 0.8 THEN 'high' WHEN (0.4 + 0.4 * redundancy_score) / 0.8 >= 0.5 THEN 'medium' ELSE 'low' END AS level,
  sha256(CASE WHEN chunk_id % 10 = 0 THEN text ELSE concat_ws(chr(10), 'about ' || video_id, 'Entities: ' || channel_id, 'Concepts: ' || video_id, nullif(text, '')) END) AS h FROM chunks""")
def _(k):
    entity = lambda name, kind, r: F.struct(name.alias("name"), F.lit(kind).alias("type"), F.lit(r).alias("relevance"))
    answer = F.to_json(F.struct(F.concat(F.lit("about "), "video_id").alias("summary"), F.array(entity(F.concat(F.lit(" "), "channel_id"), "person", 1.5), entity(F.lit(" "), "event", 0.5)).alias("entities"), F.array(F.struct(c("video_id").alias("name"), c("redundancy_score").alias("confidence"))).alias("concepts")))
    out = I.enriched(k, F.when(c("chunk_id") % 10 == 0, "no json").otherwise(answer))
    return out.select("chunk_id", "status", F.size("entities").alias("entities"), F.round("quality.score", 6).alias("score"), "quality.level", F.sha2("embedding_text", 256).alias("h"))


def _steps(rows) -> list[Stage]:
    keep = lambda n: lambda spark, df: df.where(c("r_regionkey") < n)
    return [Stage("one", keep(4)), Stage("two", keep(3), needs=("one",)), Stage("three", keep(2), needs=("two",)), Stage("other", keep(1))]


@query("P16_controlled_run", "region", sql=_values([(1, "one", "completed", None), (1, "two", "completed", None), (1, "three", "cancelled", None), (2, "one", "reused", 2), (2, "two", "reused", 2), (2, "three", "completed", 2)], "run, stage, status, left_rows"))
def _(r):
    """A run that is cancelled after its second stage, and taken up again: what was done is not done again."""
    spark, folder = r.sparkSession, _fresh(r.sparkSession, "runs")
    steps = closure(_steps(r), ["three"])
    first = Runner(spark, folder, listeners=(lambda e: first.cancel() if (e["stage"], e["status"]) == ("two", "completed") else None,))
    first.run(steps, r)
    first.resume()
    second = Runner(spark, folder)
    left = second.run(steps, r).count()
    rows = [(1, x["stage"], x["status"], None) for x in first.log] + [(2, x["stage"], x["status"], left) for x in second.log]
    return spark.createDataFrame(rows, "run int, stage string, status string, left_rows int")


@query("R14_progress_events", "region", sql=_values([(i, s, t, d, 3) for i, (s, t, d) in enumerate([("one", "running", 0), ("one", "completed", 1), ("two", "running", 1), ("two", "completed", 2), ("three", "running", 2), ("three", "completed", 3)])], "i, stage, status, done, total"))
def _(r):
    """What a subscriber of a run is told; one that fails is told nothing more."""
    told: list[dict] = []
    runner = Runner(r.sparkSession, _fresh(r.sparkSession, "runs"), listeners=(told.append, lambda e: 1 / 0))
    runner.run(closure(_steps(r), ["three"]), r)
    assert len(runner.listeners) == 1
    return r.sparkSession.createDataFrame([(i, e["stage"], e["status"], e["done"], e["total"]) for i, e in enumerate(told)], "i int, stage string, status string, done int, total int")


@query("P15_dependency_closure", "region", sql=_values([(0, "one"), (1, "two"), (2, "other")], "i, stage"))
def _(r):
    return r.sparkSession.createDataFrame(list(enumerate(s.name for s in closure(_steps(r), ["other", "two"]))), "i int, stage string")


@query("K21_published", "events", sql="SELECT event_id AS id, event_id % 11 <> 0 AS confirmed, CASE WHEN event_id % 11 = 0 THEN 3 WHEN event_id % 7 = 0 THEN 2 ELSE 1 END AS tries FROM events")
def _(e):
    # a broker that confirms some messages the second time, and some never
    send = lambda bodies, t: [int(b) % 11 != 0 and (int(b) % 7 != 0 or t > 1) for b in bodies]
    return K.published(e.select(c("event_id").alias("id"), c("event_id").cast("string").alias("value")), send)


@query("R05_retry_schedule", "events", sql="SELECT event_type AS queue, event_id AS id, event_id % 5 + 1 AS attempt, epoch_us(ts) + 1000000 * CASE event_id % 5 WHEN 0 THEN 5 WHEN 1 THEN 30 ELSE 120 END AS due FROM events")
def _(e):
    failed = e.select(c("event_type").alias("queue"), c("event_id").alias("id"), (c("event_id") % 5).alias("attempt"), c("ts").cast("timestamp").alias("ts"))
    return K.retry_schedule(failed).withColumn("due", F.unix_micros("due"))


@query("R10_reconnect_waits", "region", sql=_values([(i, w) for i, w in enumerate([1.0, 2.0, 4.0, 8.0, 16.0, 30.0, 30.0])], "attempt, seconds"))
def _(r):
    waits: list[float] = []

    @retry(8, first_wait=1.0, most=30.0, errors=(ConnectionError,), sleep=waits.append)
    def connect():
        raise ConnectionError

    try:
        connect()
    except ConnectionError:
        pass
    return r.sparkSession.createDataFrame(list(enumerate(waits)), "attempt int, seconds double")


@query("G09_split_oversized", "nation", sql="SELECT 'n' || n_nationkey AS entity_id, min('n' || n_nationkey) OVER (PARTITION BY n_regionkey) || '-p' AS community FROM nation")
def _(n):
    """One community of all nations, split into regions: only nations of one region are linked."""
    side = lambda x: n.select(F.concat(F.lit("n"), "n_nationkey").alias(x), c("n_regionkey").alias("r"))
    graph = side("a").join(side("b"), "r").where("a < b").select("a", "b", F.lit(1.0).alias("weight"))
    return G.split_oversized(graph, side("entity_id").select("entity_id", F.lit("world").alias("community")), 10)


@query("G20_closed_gate", "relation_rows", "mentions", "entities", sql="SELECT subject_id, object_id, predicate, 'extracted' AS kind FROM relations")
def _(r, m, e):
    """Where enough pairs are linked already, the chain adds nothing to what was extracted."""
    return construction(r, m, e, gate=0.0).select("subject_id", "object_id", "predicate", "kind")


@query("V14_graph_query", "entities", "relations", "mentions", "documents", sql=f"""
WITH s AS (SELECT entity_id FROM entities WHERE regexp_matches(name, '(?i)ring|license') OR regexp_matches(description, '(?i)ring|license') ORDER BY trust_score DESC NULLS LAST, centrality_score DESC, confidence DESC, entity_id LIMIT 5),
e AS (SELECT subject_id AS a, object_id AS b, confidence FROM relations UNION ALL SELECT object_id, subject_id, confidence FROM relations), n AS (SELECT b AS entity_id FROM e WHERE a IN (SELECT entity_id FROM s) AND b NOT IN (SELECT entity_id FROM s) GROUP BY b ORDER BY round(sum(confidence), 9) DESC, b LIMIT 5),
w AS (SELECT * FROM s UNION ALL SELECT * FROM n), k AS (SELECT chunk_id FROM mentions WHERE entity_id IN (SELECT entity_id FROM w) GROUP BY chunk_id ORDER BY count(DISTINCT entity_id) DESC, chunk_id LIMIT 10),
t AS (SELECT doc_id, {_WORDS} AS w FROM documents), l AS (SELECT doc_id, len(w) AS n FROM t), a AS (SELECT count(*) AS n, avg(n) AS m FROM l), x AS (SELECT doc_id, unnest(w) AS term FROM t), tf AS (SELECT doc_id, term, count(*) AS tf FROM x WHERE term IN ('ring', 'license') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
b AS (SELECT doc_id, round(sum(ln(1 + (a.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l.n / a.m))), 9) AS score FROM tf JOIN df USING (term) JOIN l USING (doc_id), a GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10),
g AS (SELECT 'seed' AS kind, entity_id AS id FROM s UNION ALL SELECT 'related', entity_id FROM n UNION ALL SELECT 'chunk', chunk_id FROM k)
SELECT 'local' AS mode, * FROM g UNION ALL SELECT 'hybrid', * FROM g UNION ALL SELECT 'hybrid', 'text', CAST(doc_id AS VARCHAR) FROM b""")
def _(e, r, m, d):
    ask = lambda mode: A.graph_query(e, r, m, "ring|license", mode, d).withColumn("mode", F.lit(mode))
    return ask("local").unionByName(ask("hybrid"))


def _objects(r, folder: str):
    """One object for each region; their number is that of the regions."""
    for row in r.select("r_regionkey", "r_name").collect():
        N.put_object(r.sparkSession, f"{folder}/{row.r_regionkey}.txt", row.r_name.encode())
    return F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("int").alias("r_regionkey")


@query("S15_object_download", "region", sql="SELECT CAST(r_regionkey AS INTEGER) AS r_regionkey, r_name AS content FROM region")
def _(r):
    folder = _fresh(r.sparkSession, "objects")
    key = _objects(r, folder)
    return N.read_objects(r.sparkSession, folder).select(key, F.decode("content", "UTF-8").alias("content"))


@query("S16_object_store", "region", sql="SELECT CAST(r_regionkey AS INTEGER) AS r_regionkey, CASE r_regionkey WHEN 1 THEN 3 ELSE length(r_name) END AS length FROM region WHERE r_regionkey <> 2")
def _(r):
    folder = _fresh(r.sparkSession, "objects")
    key = _objects(r, folder)
    N.put_object(r.sparkSession, f"{folder}/1.txt", b"new")
    N.delete_object(r.sparkSession, f"{folder}/2.txt")
    return N.read_objects(r.sparkSession, folder).select(key, "length")


@query("S17_message_source", "events", sql="SELECT CAST(event_id AS VARCHAR) AS id, event_type FROM events")
def _(e):
    from .streams import _run

    spark, folder = e.sparkSession, _fresh(e.sparkSession, "messages")
    e.select(F.to_json(F.struct(c("event_id").cast("string").alias("id"), c("event_type").alias("type"))).alias("value")).write.text(folder)
    out = _run(K.decode(N.message_stream(spark, folder)).select("envelope.id", c("envelope.type").alias("event_type")), "source")
    return spark.read.parquet(f"{out}/out")


@query("S20_generated_messages", "region", sql="SELECT CAST(i AS VARCHAR) AS id, 'profile.task' AS type, 1700000000000000 + 40000 * i AS at FROM range(1000) t(i)")
def _(r):
    made = K.decode(N.generated_batch(r.sparkSession, 1000, 25, 1_700_000_000))
    return made.select("envelope.id", "envelope.type", F.unix_micros("ts").alias("at"))


_ONTOLOGY = '{"canonical": ["uses", "part_of"], "predicate_map": {"utilises": "uses", "in": "part_of"}, "symmetric": ["near"], "constraints": {"uses": [["PERSON", "TECHNOLOGY"]]}}'


@query("S21_ontology_file", "region", sql=_values([("map", "utilises", "uses"), ("map", "in", "part_of"), ("canonical", "uses", None), ("canonical", "part_of", None), ("constraint", "uses", "PERSON TECHNOLOGY")], "kind, predicate, value"))
def _(r):
    spark, path = r.sparkSession, f"{_fresh(r.sparkSession, 'ontology')}/ontology.json"
    N.put_object(spark, path, _ONTOLOGY.encode())
    t = N.ontology_tables(spark, N.load_ontology(bytes(N.read_objects(spark, path).first().content).decode()))
    row = lambda df, kind, value: df.select(F.lit(kind).alias("kind"), "predicate", value.alias("value"))
    return row(t["predicate_map"], "map", c("canonical")).unionByName(row(t["canonical"], "canonical", F.lit(None).cast("string"))).unionByName(row(t["constraints"], "constraint", F.concat_ws(" ", "subject_type", "object_type")))


@query("K30_clustered", "lineitem", sql="SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey BETWEEN 100 AND 400")
def _(li):
    kept = N.clustered(li.select("l_orderkey", "l_linenumber", "l_partkey"), _fresh(li.sparkSession, "clustered"), ["l_orderkey", "l_linenumber"])
    return kept.where(c("l_orderkey").between(100, 400))


@query("E01_model_call", "nation", sql="SELECT n_nationkey, reverse(n_name) AS answer FROM nation")
def _(n):
    return complete(n.select("n_nationkey", "n_name"), c("n_name"), lambda prompts: [p[::-1] for p in prompts]).select("n_nationkey", "answer")


@query("E02_structured_call", "nation", sql="SELECT n_nationkey, CASE WHEN length(n_name) % 2 = 0 THEN length(n_name) END AS letters FROM nation")
def _(n):
    model = lambda prompts: [f'{{"letters": {len(p)}}}' if len(p) % 2 == 0 else "no answer" for p in prompts]
    return structured(n.select("n_nationkey", "n_name"), c("n_name"), "letters int", model).select("n_nationkey", "parsed.letters")


@query("E05_limited_calls", "nation", sql="SELECT n_nationkey, lower(n_name) AS answer FROM nation")
def _(n):
    return complete(n.select("n_nationkey", "n_name"), c("n_name"), lambda prompts: [p.lower() for p in prompts], threads=8, a_minute=60_000).select("n_nationkey", "answer")


@query("E06_retried_calls", "nation", sql="SELECT n_nationkey, n_name || ' 2' AS answer FROM nation")
def _(n):
    """A model whose first answer to each prompt is an error."""
    seen: dict[str, int] = {}

    def model(prompts):
        seen[prompts[0]] = seen.get(prompts[0], 0) + 1
        if seen[prompts[0]] == 1:
            raise ConnectionError
        return [f"{p} {seen[p]}" for p in prompts]

    return complete(n.select("n_nationkey", "n_name"), c("n_name"), model).select("n_nationkey", "answer")


@query("E07_limiter_waits", "region", sql=_values([(0, 0.0), (1, 0.0), (2, 60.0), (3, 0.0), (4, 60.0), (5, 0.0)], "call, waited"))
def _(r):
    now = [0.0]
    limiter = RateLimiter(100, 60, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    return r.sparkSession.createDataFrame([(i, limiter.acquire(40)) for i in range(6)], "call int, waited double")


@query("E08_custom_rule", "customer", sql="""
SELECT c_custkey, 'solvent' AS rule FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'own nation' FROM customer WHERE c_nationkey = c_custkey % 25""")
def _(u):
    return RU.violations(u, {"solvent": c("c_acctbal") >= 0, "own nation": c("c_nationkey") != c("c_custkey") % 25}).select("c_custkey", "rule")


@query("E09_prompts", "region", sql=_values([("now", "List AFRICA in short."), ("before", "List AFRICA.")], "version, prompt"))
def _(r):
    p = Prompts()
    p.register("list", "List {name}.")
    p.register("list", "List {name} in short.")
    return r.sparkSession.createDataFrame([("now", p.render("list", name="AFRICA")), ("before", p.render("list", version=1, name="AFRICA"))], "version string, prompt string")


@query("E10_memoised", "region", sql=_values([(0, "a", 0, 1), (1, "b", 0, 2), (2, "a", 1, 2), (3, "c", 1, 3), (4, "b", 1, 4), (5, "b", 2, 4)], "i, key, hits, misses"))
def _(r):
    cache, rows = TtlCache(2), []
    for i, k in enumerate("abacbb"):
        cache.get(k, lambda k=k: k)
        rows.append((i, k, cache.hits, cache.misses))
    return r.sparkSession.createDataFrame(rows, "i int, key string, hits int, misses int")


@query("E12_splitter_function", "documents", sql=r"""
WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n FROM documents), p AS (SELECT doc_id, n, unnest(range(greatest(0, ceil((n - 500) / 450))::BIGINT + 1)) AS piece FROM w WHERE n > 0)
SELECT doc_id, piece, least(500, n - 450 * piece) AS tokens FROM p""")
def _(d):
    from ..operators.chunking import register_splitters

    register_splitters(d.sparkSession)
    return d.sparkSession.sql("SELECT doc_id, p.piece, p.tokens FROM {d}, LATERAL token_pieces(text, 500, 50) p", d=d)
