"""Queries that fill a store from the test tables, change it by its own methods and read it; with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.derived import Derived
from cairn.operators.keyword_index import KeywordIndex
from cairn.operators.store import Store
from cairn.operators.vector_index import VectorIndex
from cairn.plans import recall as R
from cairn.plans.engine import Engine
from cairn.plans.queries import AS_OF, BM25, EMBEDDED, KNN, SESSIONS, passages_of, query, session_events, table
from cairn.sources import files
from cairn.sources.shared import fresh_folder
from cairn.streaming import capture as H

_START = 1_704_067_200  # 2024-01-01


def _store(spark: SparkSession) -> Store:
    return Store(spark, fresh_folder(spark, "store"), AS_OF)


def _at(hours: str):
    return F.timestamp_seconds(F.lit(_START) + F.col(hours) * 3600)


def _with_memories(spark, d) -> Store:
    """documents as memories, one an hour; toxic ones are disputed and every third English one is archived by forgetting."""
    store = _store(spark)
    docs = table(spark, d, "documents")
    store.append("memories", docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), F.col("source").alias("author"), F.col("lang").alias("room"), F.when(F.col("doc_id") % 2 == 0, "team").otherwise("personal").alias("scope"), F.lit("active").alias("state"), F.lit(0.8).alias("confidence"), _at("doc_id").alias("created_at"), F.lit(True).alias("in_index")))
    toxic = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("id")).distinct()
    store.update("memories", toxic, state=F.lit("disputed"))
    store.update("memories", docs.filter("lang = 'en' AND doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("id")), state=F.lit("archived"), in_index=F.lit(False))
    return store


_MEMORIES = """m AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, text, lang, CASE WHEN lang = 'en' AND doc_id % 3 = 0 THEN 'archived' WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'disputed' ELSE 'active' END AS state FROM documents)"""


@query(f"WITH {_MEMORIES} SELECT id, text AS content, state FROM m WHERE lang = 'fr' AND state = 'active' ORDER BY doc_id DESC LIMIT 20")
def store_list(spark, d) -> DataFrame:
    return _with_memories(spark, d).memories(room="fr", state="active", limit=20).select("id", "content", "state")


@query(
    f"""WITH {_MEMORIES} SELECT CAST(count_if(state = 'active') AS BIGINT) AS active, CAST(count_if(state = 'archived') AS BIGINT) AS archived, CAST(count_if(state = 'disputed') AS BIGINT) AS disputed, CAST(count_if(state <> 'archived') AS BIGINT) AS indexed,
    (SELECT CAST(count_if(toxic = 0) AS BIGINT) FROM labels) AS pending_conflicts, CAST(0 AS BIGINT) AS superseded, count(*) AS total FROM m"""
)
def store_stats(spark, d) -> DataFrame:
    store = _with_memories(spark, d)
    _add_conflicts(store, spark, d)
    return store.stats()


def _add_conflicts(store: Store, spark, d) -> None:
    """Every labelled document is a pending conflict; those of toxic ones are resolved."""
    labels = table(spark, d, "labels")
    store.upsert("conflicts", labels.select(F.format_string("x%d", "doc_id").alias("id"), F.array(F.col("doc_id").cast("string")).alias("existing_memory_ids"), F.lit("pending").alias("state"), _at("doc_id").alias("created_at")))
    done = labels.filter("toxic = 1").select(F.format_string("x%d", "doc_id").alias("id"))
    resolution = F.struct(F.lit("keep_both").alias("action"), F.lit(None).cast("string").alias("context"), F.lit(None).cast("string").alias("merged_content"))
    store.update("conflicts", done, state=F.lit("resolved"), resolution=resolution, resolved_by=F.lit("me"), resolved_at=F.lit(AS_OF).cast("timestamp"))


@query("SELECT 'x' || doc_id AS id, CAST(doc_id AS VARCHAR) AS about, CASE WHEN toxic = 1 THEN 'resolved' ELSE 'pending' END AS state, CASE WHEN toxic = 1 THEN 'keep_both' END AS action, CASE WHEN toxic = 1 THEN 'me' END AS resolved_by FROM labels")
def store_conflicts(spark, d) -> DataFrame:
    store = _store(spark)
    _add_conflicts(store, spark, d)
    open_ = store.conflicts("pending").unionByName(store.conflicts("resolved"))
    return open_.select("id", F.col("existing_memory_ids")[0].alias("about"), "state", F.col("resolution.action").alias("action"), "resolved_by")


@query("SELECT DISTINCT n_nationkey || '-' || n_regionkey AS id, CAST(n_regionkey AS VARCHAR) AS target_id FROM nation WHERE n_nationkey IN (1, 2, 3) OR n_regionkey IN (1, 2, 3)")
def store_edges(spark, d) -> DataFrame:
    store = _store(spark)
    ends = [F.col(c).cast("string") for c in ("n_nationkey", "n_regionkey")]
    store.append("edges", table(spark, d, "nation").select(F.concat_ws("-", *ends).alias("id"), ends[0].alias("source_id"), ends[1].alias("target_id"), F.lit("references").alias("edge_type")))
    return store.edges_for(spark.createDataFrame([("1",), ("2",), ("3",)], "id string")).select("id", "target_id")


@query("SELECT event_id, CAST(floor(value * 100) AS BIGINT) AS priority FROM events WHERE event_id % 5 <> 0 ORDER BY priority DESC, event_id LIMIT 25")
def store_queue(spark, d) -> DataFrame:
    store = _store(spark)
    events = table(spark, d, "events")
    store.enqueue_all(events.select(F.lit("memory").alias("target_type"), F.col("event_id").cast("string").alias("target_id"), F.col("props").alias("content"), F.floor(F.col("value") * 100).cast("bigint").alias("priority"), F.col("event_id").alias("place")))
    store.mark_done(store.table("embed_queue").filter("cast(target_id AS bigint) % 5 = 0").select("id"))
    return store.pending(25).select(F.col("target_id").cast("bigint").alias("event_id"), "priority")


@query("SELECT CAST(user_id AS VARCHAR) AS memory_id, CAST(event_id AS VARCHAR) AS id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) AS n FROM events) WHERE n <= 10")
def store_timeline(spark, d) -> DataFrame:
    store = _store(spark)
    events = table(spark, d, "events")
    store.append("timeline", events.select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("memory_id"), "event_type", F.col("ts").cast("timestamp").alias("created_at")))
    return store.timeline_for(events.select(F.col("user_id").cast("string").alias("id")).distinct()).select("memory_id", "id")


@query(
    """WITH c AS (SELECT doc_id, printf('c%06d', doc_id) AS id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 1 ELSE 0 END AS hits FROM documents WHERE NOT coalesce(doc_id % 8 = 0 OR doc_id % 20 = 5, false))
    SELECT id, CAST(hits AS BIGINT) AS hits, CAST(least((SELECT count(*) FROM c), 300) AS BIGINT) AS entries FROM c ORDER BY doc_id DESC LIMIT 300"""
)
def store_cache(spark, d) -> DataFrame:
    """Every document is an answer; hits are counted, expired ones purged, those of a changed memory dropped, and the newest 300 kept."""
    store = _store(spark)
    docs = table(spark, d, "documents")
    key = F.format_string("c%06d", "doc_id")
    store.upsert("cache", docs.select(key.alias("id"), F.col("source").alias("query"), F.col("text").alias("answer"), F.array(F.concat(F.lit("m"), F.col("doc_id") % 20)).alias("source_ids"), _at("doc_id").alias("created_at"), F.when(F.col("doc_id") % 8 == 0, F.lit("2025-12-31").cast("timestamp")).alias("expires_at"), F.lit(0).alias("hits")))
    store.cache_touch(table(spark, d, "labels").filter("quality = 1").select(key.alias("id")).distinct())
    store.cache_purge(AS_OF)
    store.cache_invalidate("m5")
    store.cache_evict(300)
    return store.table("cache").select("id", "hits", F.lit(store.cache_count()).cast("bigint").alias("entries"))


@query(f"WITH {_MEMORIES} SELECT id, text AS content, lang AS room, state, strftime(TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS created FROM m WHERE doc_id % 2 = 0")
def store_export(spark, d) -> DataFrame:
    """The team's memories through JSON lines and back."""
    folder = fresh_folder(spark, "export")
    files.export_memories(_with_memories(spark, d).table("memories"), folder, scope="team")
    return files.read_memories(spark, folder).select("id", "content", "room", "state", F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("created"))


@query("SELECT CAST(vec_id AS VARCHAR) AS id, unnest(range(1, len(embedding) + 1)) AS place, round(CAST(unnest(embedding) AS DOUBLE), 6) AS x FROM embeddings")
def vector_file(spark, d) -> DataFrame:
    """All vectors through packed files and back."""
    folder = fresh_folder(spark, "vectors")
    files.write_vectors(table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding"), folder, 64)
    rows = files.read_vectors(spark, folder).select("id", F.posexplode("embedding").alias("place", "x"))
    return rows.select("id", (F.col("place") + 1).cast("bigint").alias("place"), F.round(F.col("x").cast("double"), 6).alias("x"))


@query(f"WITH {EMBEDDED} SELECT CAST(doc_id AS VARCHAR) AS id, array_to_string(list_transform(v, lambda x: CASE WHEN x > 0 THEN '+' WHEN x < 0 THEN '-' ELSE '0' END), '') AS signs, round(CAST(list_max(list_transform(v, lambda x: abs(x))) AS DOUBLE), 4) AS largest, 'done' AS status, 'second' AS worker FROM e JOIN documents USING (doc_id)")
def reindex(spark, d) -> DataFrame:
    """Every document is a queued memory, longer ones first; one worker dies with a lease, another embeds all, those in the end."""
    engine = Engine(spark, fresh_folder(spark, "reindex"), as_of=AS_OF)
    store = engine.store
    docs = table(spark, d, "documents")
    store.append("memories", docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), F.lit("active").alias("state"), F.lit(False).alias("in_index")))
    store.enqueue_all(docs.select(F.lit("memory").alias("target_type"), F.col("doc_id").cast("string").alias("target_id"), F.col("text").alias("content"), F.col("n_chars").alias("priority"), F.col("doc_id").alias("place")))
    store.claim("first", 100, AS_OF, seconds=600)
    while engine.drain("second", None, AS_OF):
        pass
    while engine.drain("second", None, "2026-01-01 00:10:00"):
        pass
    signs = F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "+").when(x < 0, "-").otherwise("0")), "")
    queue = store.table("embed_queue").select(F.col("target_id").alias("id"), "status", "worker")
    return store.index().select("id", signs.alias("signs"), F.round(F.array_max(F.transform("embedding", F.abs)).cast("double"), 4).alias("largest")).join(queue, "id")


@query(f"WITH {BM25} SELECT query_id, id, round(score, 6) AS score, rank FROM fts")
def fts_kept_index(spark, d) -> DataFrame:
    """Keyword search over an index that was kept in step with a store: texts that were wrong at first, texts that came later, texts that were deleted, and a merge between."""
    store = _store(spark)
    index = KeywordIndex(spark, fresh_folder(spark, "keywords"))
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))
    early = F.col("id").cast("bigint") % 3 == 0
    store.upsert("memories", docs.filter(early).withColumn("content", F.concat(F.lit("draft "), F.reverse("content"))))
    store.upsert("memories", docs.select(F.concat(F.lit("old"), "id").alias("id"), "content").filter("length(id) < 5"))
    index.sync(store)
    store.upsert("memories", docs)
    store.delete("memories", lambda m: m.filter("id like 'old%'"))
    index.sync(store)
    index.merge()
    return index.search(passages_of(spark, d), 20).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(KNN)
def knn_kept_index(spark, d) -> DataFrame:
    """Neighbours from an index that was built of two thirds of the vectors, then got the rest, wrong ones and deletions, as a store had them."""
    store = _store(spark)
    index = VectorIndex(spark, fresh_folder(spark, "neighbours"))
    e = table(spark, d, "embeddings").select(F.format_string("%012d", "vec_id").alias("id"), "embedding", F.lit(True).alias("in_index"))
    third = F.col("id").cast("bigint") % 3 == 0
    store.upsert("memories", e.filter(~third).unionByName(e.filter(third).withColumns({"id": F.concat(F.lit("old"), "id"), "embedding": F.reverse("embedding")})))
    index.sync(store, member="in_index")
    store.upsert("memories", e.filter(third))
    store.update("memories", store.table("memories").filter("id like 'old%'").select("id"), in_index=F.lit(False))
    index.sync(store, member="in_index")
    asked = e.filter("cast(id AS bigint) % 20 = 0").select(F.col("id").cast("bigint").alias("query_id"), "embedding")
    return index.search(asked, 5, digits=6).select("query_id", F.col("id").cast("bigint").alias("id"), "sim", "rank")


@query(
    """WITH a AS (SELECT user_id, count(*) AS n, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks, max(event_id) AS last FROM events GROUP BY user_id)
    SELECT CAST(user_id AS VARCHAR) AS id, n AS hits, CASE WHEN clicks > 0 THEN 'second' ELSE 'first' END AS query, CAST(last AS VARCHAR) AS answer FROM a"""
)
def store_writers(spark, d) -> DataFrame:
    """Two stores of one folder: the second writes over what the first has written since it was opened, both count hits, and one compacts between."""
    first = _store(spark)
    second = Store(spark, first.path, AS_OF)
    events = table(spark, d, "events").select(F.col("user_id").cast("string").alias("id"), "event_type", "event_id")
    each = events.groupBy("id").agg(F.max("event_id").cast("string").alias("answer"))
    first.upsert("cache", each.select("id", F.lit("first").alias("query"), F.lit(0).alias("hits")))
    first.upsert("cache", each.select("id", "answer", F.lit("first").alias("query"), F.lit(0).alias("hits")))
    clicks = F.col("event_type") == "click"
    second.upsert("cache", events.filter(clicks).select("id").distinct().join(each, "id").select("id", "answer", F.lit("second").alias("query"), F.lit(0).alias("hits")))
    first.cache_touch(events.filter(~clicks))
    first.compact("cache")
    second.cache_touch(events.filter(clicks))
    return first.table("cache").select("id", "hits", "query", "answer")


@query(
    f"""WITH l AS (SELECT DISTINCT doc_id, doc_id % 4 AS a FROM labels) SELECT 'x' || l.doc_id AS id,
    CASE a WHEN 2 THEN CAST(l.doc_id AS VARCHAR) WHEN 3 THEN substr(sha256('merge' || chr(1) || 'merged ' || l.doc_id || chr(1) || '{AS_OF}'), 1, 26) ELSE 'n' || l.doc_id END AS stands,
    CASE WHEN a IN (0, 3) THEN 'superseded' ELSE 'active' END AS old_state, CASE a WHEN 2 THEN text WHEN 3 THEN 'merged ' || l.doc_id ELSE 'new ' || l.doc_id END AS content,
    CASE a WHEN 1 THEN 'complements' WHEN 2 THEN NULL ELSE 'supersedes' END AS edge_type, CAST(CASE a WHEN 0 THEN 2 ELSE 1 END AS BIGINT) AS events, 'resolved' AS state FROM l JOIN documents d ON l.doc_id = d.doc_id"""
)
def resolve_actions(spark, d) -> DataFrame:
    """A conflict with each labelled document, resolved by one of the four actions; what stands, what became of the document, the edge and the events."""
    engine = Engine(spark, fresh_folder(spark, "resolve"), as_of=AS_OF)
    store = engine.store
    docs, ids = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id").distinct()
    text = F.col("doc_id").cast("string")
    store.append("memories", docs.select(text.alias("id"), F.col("text").alias("content"), F.lit("active").alias("state"), F.lit(True).alias("in_index")))
    fields = store.table("conflicts").schema["new_memory"].dataType
    given = {"id": F.concat(F.lit("n"), text), "content": F.concat(F.lit("new "), text), "state": F.lit("active")}
    memory = F.struct(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
    store.upsert("conflicts", ids.join(docs.select("doc_id"), "doc_id").select(F.concat(F.lit("x"), text).alias("id"), memory.alias("new_memory"), F.array(text).alias("existing_memory_ids"), F.lit("pending").alias("state")))
    action = F.get(F.array(*map(F.lit, ("replace", "keep_both", "discard_new", "merge"))), (F.col("doc_id") % 4).cast("int"))
    changes = engine.resolve_many(ids.select(F.concat(F.lit("x"), text).alias("conflict_id"), action.alias("action"), F.concat(F.lit("merged "), text).alias("merged")))
    stands = changes.filter("kind = 'stands'").select(F.col("conflict_id").alias("id"), F.col("id").alias("stands"))
    memories, edges = store.table("memories").select("id", "content", "state"), store.table("edges").select(F.col("source_id").alias("stands"), "edge_type")
    named = lambda df, **new: df.select(*(F.col(c).alias(n) for c, n in new.items()))
    old = named(memories, id="old", state="old_state")
    per = changes.filter("kind = 'event'").join(named(store.table("timeline"), memory_id="id", event_type="what").distinct(), ["id", "what"]).groupBy(F.col("conflict_id").alias("id")).agg(F.count("*").alias("events"))
    out = stands.withColumn("old", F.substring("id", 2, 40)).join(old, "old").join(named(memories, id="stands", content="content"), "stands").join(edges, "stands", "left").join(per, "id")
    return out.join(store.conflicts("resolved").select("id", "state"), "id").select("id", "stands", "old_state", "content", "edge_type", "events", "state")


@query(
    """WITH v AS (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY doc_id), e AS (SELECT d.doc_id, coalesce(t, 0) AS t, CASE WHEN coalesce(q, 0) = 1 THEN 1 + CAST(d.doc_id % 2 = 0 AS INTEGER) ELSE 0 END AS n FROM documents d LEFT JOIN v ON d.doc_id = v.doc_id)
    SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN t = 1 THEN 'archived' ELSE 'active' END AS state, t = 0 AS in_index, n AS endorsed, round(CASE WHEN n > 0 THEN (n + 1) / (n + 2.0) ELSE 0.8 END, 6) AS confidence FROM e"""
)
def endorse_and_forget(spark, d) -> DataFrame:
    """Documents of good quality are endorsed by one or two authors, toxic ones forgotten, in a store."""
    engine = Engine(spark, fresh_folder(spark, "endorse"), as_of=AS_OF)
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    text, none = F.col("doc_id").cast("string").alias("id"), F.array().cast("array<string>")
    engine.store.append("memories", docs.select(text, F.col("text").alias("content"), F.lit("active").alias("state"), F.lit(True).alias("in_index"), F.lit(0.8).alias("confidence"), none.alias("endorsed_by"), none.alias("disputed_by")))
    good = labels.filter("quality = 1").select("doc_id").distinct()
    engine.endorse_many(good.select(text, F.lit("ana").alias("author")).unionByName(good.filter("doc_id % 2 = 0").select(text, F.lit("bo").alias("author"))))
    engine.endorse_many(good.select(text, F.lit("ana").alias("author")))  # a second time changes nothing
    engine.forget_many(labels.filter("toxic = 1").select(text))
    return engine.store.table("memories").select("id", "state", "in_index", F.size("endorsed_by").alias("endorsed"), F.round("confidence", 6).alias("confidence"))


@query(SESSIONS)
def session_stream(spark, d) -> DataFrame:
    """Sessions of a stream of event files that is stopped and goes on with files that repeat some events."""
    store, folder = _store(spark), fresh_folder(spark, "events")
    events = session_events(spark, d)
    late = F.col("session_id").cast("bigint") % 3 == 0
    for part, rows in enumerate((events.filter(~late), events.filter(late | (F.col("session_id").cast("bigint") % 3 == 1)))):
        rows.write.mode("append").json(f"{folder}/in/{part}")
        H.capture(store, H.source(spark, f"{folder}/in/*"), f"{folder}/check", delay="3650 days").awaitTermination()
    return store.table("sessions").select("id", "ide", "room", F.unix_timestamp("started_at").alias("started"), F.unix_timestamp("ended_at").alias("ended"))


@query()
def recall_indexed(spark, d) -> DataFrame:
    """``recall_static`` by kept indexes of what has been derived of the texts; whole memories are made of what is found."""
    rows = files.document_rows(spark, d)
    derived = Derived(spark, fresh_folder(spark, "derived"))
    derived.fill(rows)
    searched = files.as_searched(rows, derived=derived)
    words, vectors = KeywordIndex(spark, fresh_folder(spark, "keywords")), VectorIndex(spark, fresh_folder(spark, "neighbours"))
    words.upsert(searched)
    vectors.upsert(searched)
    return R.recall(passages_of(spark, d), None, AS_OF, full=lambda ids: files.as_memories(rows.join(ids, "id"), derived=derived), indexes=(words, vectors))
