"""Queries over the relational tables and events: inventories, ordered groups, diffs, graphs, the event log, findings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexispark import store
from lexispark.operators import relational as rel
from lexispark.plans.registry import query, table
from lexispark.streaming import eventlog as log


@query("SELECT source, lang, count(*) AS n, count(DISTINCT text) AS n_texts, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY source, lang")
def inventory_source_lang(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text").alias("n_texts"), F.sum("n_chars").alias("n_chars"))


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS n_customers, count(DISTINCT o_orderpriority) AS n_priorities FROM orders GROUP BY o_orderstatus")
def count_distinct(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("n_customers"), F.count_distinct("o_orderpriority").alias("n_priorities"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (n_chars > 2000) AS n_long, count(*) FILTER (contains(text, 'token')) AS n_marked FROM documents GROUP BY lang")
def conditional_counts(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") > 2000).alias("n_long"), F.count_if(F.col("text").contains("token")).alias("n_marked"))


@query("SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 12")
def topn_groups(spark, sf):
    return rel.top_groups(table(spark, sf, "part"), "p_type", 12)


@query("SELECT r_name, array_to_string(list_sort(list(DISTINCT n_name)), '; ') AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def names_concat(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return rel.joined_names(n.join(r, n["n_regionkey"] == r["r_regionkey"]), "r_name", "n_name")


@query("SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (value > 0) AS n_valued FROM events GROUP BY user_id")
def min_max_span(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(F.col("value") > 0).alias("n_valued"))


@query("""
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'O') AS n_open, count(*) FILTER (o_orderstatus <> 'O' AND o_totalprice > 200000) AS n_large,
  count(*) FILTER (o_orderstatus <> 'O' AND NOT o_totalprice > 200000) AS n_other, count(*) AS total FROM orders GROUP BY o_orderpriority""")
def status_pivot(spark, sf):
    kind = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_totalprice") > 200000, "large").otherwise("other")
    rows = table(spark, sf, "orders").select("o_orderpriority", kind.alias("kind"))
    return rows.groupBy("o_orderpriority").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("open", "large", "other")], F.count(F.lit(1)).alias("total"))


@query("""
SELECT l_returnflag, round_even(100.0 * count(*) FILTER (l_linestatus = 'F') / count(*), 2) AS pct_done, round_even(sum(l_quantity) / 443, 0)::BIGINT AS pages
FROM lineitem GROUP BY l_returnflag""")
def ratio_share(spark, sf):
    done = F.count_if(F.col("l_linestatus") == "F") * F.lit(100.0) / F.count(F.lit(1))
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.bround(done, 2).alias("pct_done"), F.bround(F.sum("l_quantity") / 443, 0).cast("bigint").alias("pages"))


@query("""
SELECT lang, quality, count(*) AS n, sum(toxic)::BIGINT AS n_toxic, round(avg(n_chars), 6) AS mean_chars FROM documents JOIN labels USING (doc_id) GROUP BY lang, quality""")
def quality_by_lang(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return rows.groupBy("lang", "quality").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("n_toxic"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


_RANK = "CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 1 ELSE 0 END"


@query(f"""
WITH r AS (SELECT *, {_RANK} AS rank, row_number() OVER (PARTITION BY o_custkey ORDER BY {_RANK} DESC, o_orderkey) AS rn FROM orders)
SELECT o_custkey, rank::INTEGER AS rank, o_orderkey, o_orderstatus FROM r WHERE rn = 1""")
def best_record_per_key(spark, sf):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 2).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(0)
    return rel.best_record(table(spark, sf, "orders"), "o_custkey", rank, "o_orderkey", ["o_orderkey", "o_orderstatus"])


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT user_id, event_type, event_id, ts, value FROM r WHERE rn = 1""")
def latest_version(spark, sf):
    return rel.latest(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["ts", "event_id", "value"])


@query(r"""
WITH w AS (SELECT conv_id, turn, string_split_regex(lower(text), '[^\p{L}]+') AS ws FROM conversations),
e AS (SELECT conv_id, turn, i, ws[i] AS term FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM w))
SELECT term, min(conv_id) AS conv_id, min_by(turn, conv_id * 1000000000 + turn * 1000000 + i) AS turn, (min_by(i, conv_id * 1000000000 + turn * 1000000 + i) - 1)::INTEGER AS position
FROM e WHERE length(term) >= 5 GROUP BY term""")
def first_use_term(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode_outer(F.split(F.lower("text"), r"[^\p{L}]+")).alias("position", "term"))
    first = rows.where(F.length("term") >= 5).groupBy("term").agg(F.min(F.struct("conv_id", "turn", "position")).alias("f"))
    return first.select("term", "f.conv_id", "f.turn", "f.position")


@query("""
SELECT conv_id, turn, role, lag(role) OVER w AS before, lead(role) OVER w AS after, lag(length(text)) OVER w AS chars_before FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def neighbour_context(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"), F.lag(F.length("text").cast("bigint")).over(w).alias("chars_before"))


@query("""
WITH v AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events)
SELECT user_id, count(*) AS n_versions, count(*) FILTER (was IS NOT NULL AND was <> event_type) AS n_changed FROM v GROUP BY user_id""")
def versions_changed(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf, "events").select("user_id", "event_type", F.lag("event_type").over(w).alias("was"))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_versions"), F.count_if(F.col("was") != F.col("event_type")).alias("n_changed"))


@query("""
WITH k AS (SELECT user_id, max_by(event_type, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS last_kind FROM events WHERE event_type IN ('purchase', 'error', 'signup') GROUP BY user_id)
SELECT user_id, last_kind FROM k WHERE last_kind = 'purchase'""")
def standing_state(spark, sf):
    rows = table(spark, sf, "events").where(F.col("event_type").isin("purchase", "error", "signup"))
    return rel.latest(rows, ["user_id"], ["ts", "event_id"], ["event_type"]).select("user_id", F.col("event_type").alias("last_kind")).where("last_kind = 'purchase'")


@query("""
WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 7 <> 0),
b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 11 <> 0)
SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN a.s IS NULL THEN 'added' WHEN b.s IS NULL THEN 'removed' WHEN a.s <> b.s THEN 'changed' ELSE 'same' END AS status
FROM a FULL JOIN b ON a.k = b.k""")
def diff_added_removed_changed(spark, sf):
    old, new = _snapshots(table(spark, sf, "orders"))
    return rel.snapshot_diff(old, new, "o_orderkey", "s")


def _snapshots(orders):
    """Two states of the orders' signatures, derived from the table."""
    new = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderpriority")).otherwise(F.col("o_orderstatus"))
    return (
        orders.where("o_orderkey % 7 <> 0").select("o_orderkey", F.col("o_orderstatus").alias("s")),
        orders.where("o_orderkey % 11 <> 0").select("o_orderkey", new.alias("s")),
    )


@query("""
WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 7 <> 0),
b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 11 <> 0)
SELECT s, count(*) AS n FROM b GROUP BY s""")
def merged_index(spark, sf):
    old, new = _snapshots(table(spark, sf, "orders"))
    diff = rel.snapshot_diff(old, new, "o_orderkey", "s")
    fresh = new.join(diff.where("status IN ('added', 'changed')").select("o_orderkey"), "o_orderkey", "left_semi")
    return rel.merge_index(old, fresh, diff, "o_orderkey").groupBy("s").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH j AS (SELECT d.doc_id AS a, l.doc_id AS b FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id)
SELECT count(*) FILTER (b IS NULL) AS left_only, count(*) FILTER (a IS NULL) AS right_only, count(*) FILTER (b IS NULL) = 0 AND count(*) FILTER (a IS NULL) = 0 AS aligned FROM j""")
def alignment_check(spark, sf):
    return rel.alignment(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_manifest(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("""
WITH p AS (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem), s AS (SELECT l_orderkey, count(*) - 1 AS others FROM p GROUP BY l_orderkey)
SELECT l_partkey, sum(others)::BIGINT AS n_synonyms FROM p JOIN s USING (l_orderkey) GROUP BY l_partkey""")
def synonym_self_join(spark, sf):
    return rel.synonyms(table(spark, sf, "lineitem"), "l_partkey", "l_orderkey")


@query("""
SELECT DISTINCT s_nationkey, p_brand FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE p_size <= 5""")
def one_hop_relation(spark, sf):
    li, s, p = table(spark, sf, "lineitem"), table(spark, sf, "supplier"), table(spark, sf, "part")
    small = p.where("p_size <= 5").select("p_partkey", "p_brand")
    return li.join(small, li["l_partkey"] == small["p_partkey"]).join(s, li["l_suppkey"] == s["s_suppkey"]).select("s_nationkey", "p_brand").distinct()


_EDGES = "SELECT DISTINCT l_suppkey AS src, 1 + (l_partkey % (SELECT count(*) FROM supplier)) AS dst FROM lineitem"


@query(f"""
WITH RECURSIVE e AS ({_EDGES}), r(node, hops) AS (SELECT 1::BIGINT, 0 UNION SELECT dst, hops + 1 FROM r JOIN e ON src = node WHERE hops < 4)
SELECT node, min(hops)::INTEGER AS hops FROM r GROUP BY node""")
def reachability(spark, sf):
    n = table(spark, sf, "supplier").agg(F.count(F.lit(1)).alias("n"))
    li = table(spark, sf, "lineitem")
    edges = li.join(F.broadcast(n)).select(F.col("l_suppkey").alias("src"), (1 + F.col("l_partkey") % F.col("n")).alias("dst")).distinct()  # one row
    return rel.reachable(edges, spark.range(1, 2).select(F.col("id").alias("node")), 4)


@query(f"""
WITH RECURSIVE e AS ({_EDGES}), r(node, hops) USING KEY (node) AS (SELECT 1::BIGINT, 0 UNION SELECT DISTINCT dst, r.hops + 1 FROM r JOIN e ON src = r.node WHERE dst NOT IN (SELECT node FROM recurring.r))
SELECT node, hops::INTEGER AS hops FROM r""")
def reachability_all(spark, sf):
    """All rows as edges, and as many hops as there are."""
    n = table(spark, sf, "supplier").agg(F.count(F.lit(1)).alias("n"))
    li = table(spark, sf, "lineitem")
    edges = li.join(F.broadcast(n)).select(F.col("l_suppkey").alias("src"), (1 + F.col("l_partkey") % F.col("n")).alias("dst")).distinct()  # one row
    return rel.reachable(edges, spark.range(1, 2).select(F.col("id").alias("node")))


@query("""
WITH RECURSIVE n AS (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
c(user_id, event_id, depth) AS (SELECT user_id, event_id, 1 FROM n WHERE rn = 1 UNION ALL SELECT c.user_id, n2.event_id, depth + 1 FROM c JOIN n n1 ON n1.event_id = c.event_id JOIN n n2 ON n2.event_id = n1.nxt WHERE depth < 30)
SELECT user_id, max(depth)::INTEGER AS depth, max_by(event_id, depth) AS last_event FROM c GROUP BY user_id""")
def chain_walk_depth(spark, sf):
    """A chain in order is its own row numbers: the walk is a window, not a recursion."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf, "events").select("user_id", "event_id", F.row_number().over(w).alias("depth")).where("depth <= 30")
    return rows.groupBy("user_id").agg(F.max("depth").alias("depth"), F.max_by("event_id", "depth").alias("last_event"))


@query("""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s FROM events),
p AS (SELECT a.event_id AS left_id, b.event_id AS right_id, abs(a.s - b.s) AS distance FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND abs(a.s - b.s) <= 3600)
SELECT left_id, min_by(right_id, distance * 1000000000 + right_id) AS right_id, min(distance) AS distance, count(*) AS n_near FROM p GROUP BY left_id""")
def band_join_nearest(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    return rel.nearest_within(e, e, "user_id", "s", 3600, "event_id")


_TITLE = r"trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"""
WITH p AS (SELECT p_partkey, string_split({_TITLE}, ' ') AS ws FROM part), w AS (SELECT DISTINCT p_partkey, unnest(ws) AS w FROM p),
h AS (SELECT w, min(p_partkey) AS first_key, count(*) AS n FROM w GROUP BY w)
SELECT w AS word, first_key, n FROM h WHERE n > 1""")
def title_word_holders(spark, sf):
    title = F.trim(F.regexp_replace(F.regexp_replace(F.lower("p_name"), "[^a-z0-9 ]+", " "), r"\s+", " "))
    words = table(spark, sf, "part").select("p_partkey", F.explode_outer(F.split(title, " ")).alias("word")).distinct()
    return words.groupBy("word").agg(F.min("p_partkey").alias("first_key"), F.count(F.lit(1)).alias("n")).where("n > 1")


@query("""
SELECT item_id, count(*) AS n_docs, min(doc_id) AS first_doc FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id""")
def contains_theta_join(spark, sf):
    """Containment of whole items, long ones by a key of whole words."""
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("item"))
    hits = rel.containing(items, table(spark, sf, "documents"))
    return hits.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


_OWN = "left(sha256(concat_ws('|', event_id::VARCHAR, user_id::VARCHAR, event_type, {})), 16)"


_WHAT = "concat_ws('|', strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), json_object('event_id', event_id, 'event_type', event_type, 'props', {}, 'user_id', user_id)::VARCHAR)"


@query(f"""
WITH RECURSIVE o AS (SELECT *, {_WHAT.format('props')} AS what, {_WHAT.format("CASE WHEN event_id % 997 = 0 THEN props || ' ' ELSE props END")} AS now, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
c(user_id, n, prev, hash, now) AS (
  SELECT user_id, n, repeat('0', 16), left(sha256(repeat('0', 16) || '|' || what), 16), now FROM o WHERE n = 1
  UNION ALL SELECT o.user_id, o.n, c.hash, left(sha256(c.hash || '|' || o.what), 16), o.now FROM c JOIN o ON o.user_id = c.user_id AND o.n = c.n + 1)
SELECT user_id, count(*) AS n_events, count(*) FILTER (left(sha256(prev || '|' || now), 16) <> hash) AS n_bad_hash, 0::BIGINT AS n_bad_link FROM c GROUP BY user_id""")
def event_chain_verify(spark, sf):
    """Chains of all users, some payloads of which were changed after the chain was made."""
    what = log.body(F.col("ts"), "event_id", "user_id", "event_type", "props")
    rows = log.chained(table(spark, sf, "events"), "user_id", ["ts", "event_id"], what)
    edited = rows.withColumn("props", F.when(F.col("event_id") % 997 == 0, F.concat("props", F.lit(" "))).otherwise(F.col("props")))
    return log.verify(edited, "user_id", ["ts", "event_id"], what)


#: Event types of the test table as presses of a card.
_PRESS = {"purchase": "approve", "signup": "edit", "error": "withdraw", "click": "directive"}


def _press(col):
    return F.create_map(*[F.lit(x) for kv in _PRESS.items() for x in kv])[col]


_FOLD = """
WITH k AS (SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || lpad(event_id::VARCHAR, 15, '0') AS moment,
  CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'signup' THEN 'submitted' WHEN 'error' THEN 'yours' END AS sets, event_type = 'click' AS directive FROM events),
s AS (SELECT user_id, max(moment) FILTER (sets IS NOT NULL) AS decided_at, max_by(sets, moment) FILTER (sets IS NOT NULL) AS decided, max(moment) FILTER (directive) AS directed, count(*) AS n_events FROM k GROUP BY user_id)
SELECT user_id, CASE WHEN directed IS NOT NULL AND (decided_at IS NULL OR directed > decided_at) AND coalesce(decided, 'yours') <> 'approved' THEN 'submitted' ELSE coalesce(decided, 'yours') END AS status, n_events
FROM s"""


@query(_FOLD)
def event_fold_state(spark, sf):
    return log.fold(table(spark, sf, "events"), "user_id", F.struct("ts", "event_id"), _press(F.col("event_type")))


@query(_FOLD)
def stream_event_fold(spark, sf):
    return log.fold_stream(spark, f"{sf}/events.parquet", "user_id", lambda d: F.struct(d["ts"], d["event_id"]), lambda d: _press(d["event_type"]))


@query("""
WITH r AS (SELECT user_id::VARCHAR AS card, event_type = 'purchase' AS approves, ts, date_trunc('milliseconds', ts) AS ms FROM events WHERE event_type IN ('purchase', 'error')),
n AS (SELECT *, lead(ms) OVER w AS next, lag(approves) OVER w AS after_approval, lag(ms) OVER w AS before FROM r WINDOW w AS (PARTITION BY card ORDER BY ts, approves DESC)),
e AS (SELECT max(ts) AS latest FROM events)
SELECT card, 'approving' AS status, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS at FROM n WHERE approves UNION ALL
SELECT card, 'taken back', strftime(ts, '%Y-%m-%d %H:%M:%S.%g') FROM n WHERE NOT approves AND after_approval AND ms < before + INTERVAL 86400 SECOND UNION ALL
SELECT card, 'approved', strftime(ms + INTERVAL 86400 SECOND, '%Y-%m-%d %H:%M:%S.%g') FROM n, e WHERE approves AND coalesce(next >= ms + INTERVAL 86400 SECOND, ms + INTERVAL 86400 SECOND < latest)""")
def stream_approvals(spark, sf):
    """Approvals that wait a day, in a stream over all events: state and a timer for each card."""
    from lexispark.streaming import timers

    path = f"{sf}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    kind = F.when(F.col("event_type") == "purchase", "approve").when(F.col("event_type") == "error", "withdraw").otherwise("note")
    rows = timers.settled_table(stream.select(F.col("user_id").alias("card"), kind.alias("kind"), "ts"), 86_400, store.folder(spark))
    return rows.select("card", "status", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSS").alias("at"))


@query(f"""
WITH h AS (SELECT *, {_OWN.format('props')} AS hash FROM events),
r AS (SELECT *, CASE WHEN event_type = 'error' THEN lag(hash) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS retracts FROM h)
SELECT user_id, count(*) AS n_standing, round(sum(value), 6) AS value FROM r WHERE retracts IS NULL AND hash NOT IN (SELECT retracts FROM r WHERE retracts IS NOT NULL) GROUP BY user_id""")
def retract_anti_join(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    own = log.entry_hash(F.col("event_id"), F.col("user_id"), F.col("event_type"), F.col("props"))
    rows = table(spark, sf, "events").withColumn("hash", own)
    rows = rows.withColumn("retracts", F.when(F.col("event_type") == "error", F.lag("hash").over(w)))
    return log.retract(rows).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_standing"), F.round(F.sum("value"), 6).alias("value"))


@query(r"""
SELECT user_id, count(*) AS n, max((json_extract_string(props, '$.k'))::BIGINT) AS most_k FROM events GROUP BY user_id""")
def json_field_by_key(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.get_json_object("props", "$.k").cast("bigint")).alias("most_k"))
