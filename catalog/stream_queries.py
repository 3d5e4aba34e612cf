"""Streams run over the given tables until nothing is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import decision, haversine, norm, partial, query, r4, ratio, score, sql_exact, sql_r4, token_set
from catalog.views import stream_view
from catalog.workflow_queries import IMAGE_NOTES, PATCHED_IMAGES, PATCHED_STORES, STORE_NOTES
from placewise.streaming import feeds
from placewise.tables import fresh_path


@query(
    "st1_s10_store_updates",
    "SELECT CASE WHEN id % 4 = 0 THEN 'STORE_ADDED' ELSE 'STORE_UPDATED' END AS action, id AS store_id, name, lat, lng FROM stores WHERE state = 'active'", "stores",
)
def _(d):
    changes = stream_view(d.spark, d.folder, "stores", "part").withColumn("created", F.col("id") % 4 == 0)
    return feeds.append_once(feeds.store_updates(changes), fresh_path(d.spark))


@query(
    "st2_running_ratings",
    f"SELECT l_partkey AS store_id, {sql_r4('avg(CAST(l_quantity AS INTEGER) % 5 + 1)')} AS rating_avg, CAST(count(*) AS INTEGER) AS rating_count FROM lineitem GROUP BY l_partkey",
)
def _(d):
    lines = feeds.read_changes(d.spark, d.folder, d.lineitem.schema, "lineitem.parquet")
    reviews = lines.select(F.col("l_partkey").alias("store_id"), (F.col("l_quantity").cast("int") % 5 + 1).alias("rating"))
    ratings = feeds.update_once(feeds.running_ratings(reviews), fresh_path(d.spark), ["store_id"])
    return ratings.select("store_id", r4("rating_avg").alias("rating_avg"), "rating_count")


@query(
    "st3_latest_searches",
    "SELECT user_id, id, keyword FROM (SELECT *, row_number() OVER (PARTITION BY user_id, lower(keyword) ORDER BY created_at DESC, id DESC) AS n FROM search_history) x WHERE n = 1", "search_history",
)
def _(d):
    history = stream_view(d.spark, d.folder, "search_history", "events")
    keyed = feeds.latest_searches(history).withColumn("word", F.lower("keyword"))
    return feeds.update_once(keyed, fresh_path(d.spark), ["user_id", "word"]).select("user_id", "id", "keyword")


@query(
    "st4_duplicate_alerts",
    f"""SELECT candidate_id, store_id, {sql_exact('m', 2)} AS distance_m, {sql_exact(score('p', 't', 'l'), 4)} AS score, {decision(score('p', 't', 'l'))} AS decision FROM (
 SELECT -1 - a.id AS candidate_id, b.id AS store_id, {haversine('a.lng', 'a.lat', 'b.lng', 'b.lat')} AS m, {partial('a.n', 'b.n')} AS p, {token_set('a.n', 'b.n')} AS t, {ratio('a.n', 'b.n')} AS l
 FROM named a JOIN named b ON abs(a.lat - b.lat) < 0.001 AND abs(a.lng - b.lng) < 0.001) x WHERE m <= 15 AND {score('p', 't', 'l')} >= CAST(0.7 AS DOUBLE)""",
    "stores", {"named": f"SELECT id, lng, lat, {norm('name')} AS n FROM stores"},
)
def _(d):
    arriving = stream_view(d.spark, d.folder, "stores", "part").select((-1 - F.col("id")).alias("candidate_id"), "name", "lng", "lat")
    return feeds.append_once(feeds.duplicate_alerts(arriving, d.stores), fresh_path(d.spark))


def _merged_state(d):
    """The approvals arrive in eight files, one a batch, in no order of time; the log is compacted once."""
    arriving, log, compact = (fresh_path(d.spark) for _ in range(3))
    d.approvals.repartition(8, "id").write.parquet(arriving)
    stream = feeds.read_changes(d.spark, arriving, d.approvals.schema, files_per_trigger=1)
    feeds.run_once(feeds.log_approvals(stream, log), f"{fresh_path(d.spark)}/progress")
    feeds.compact_log(d.spark, log, compact)
    return feeds.merged_state(d.stores, d.images, compact)


@query("st5_apply_approvals", PATCHED_STORES, "stores approvals", STORE_NOTES)
def _(d):
    return _merged_state(d)[0].select("id", "name", "phone", "email", "address", "lat", "lng", "state")


@query("st5_approved_images", PATCHED_IMAGES, "images approvals", IMAGE_NOTES)
def _(d):
    return _merged_state(d)[1].select("id", "store_id", "state")
