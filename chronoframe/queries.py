"""The registered queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoframe.functions.interval import CLOSED, duration, fork_node, granule, joined_payload, root_power
from chronoframe.operators import aggregate, antijoin, join, partition
from chronoframe.plans.width import relation_stats
from chronoframe.sources.views import events_iv, lineitem_iv, orders_iv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
GRANULES = 60
LOW, HIGH = 500, 900

VIEWS = """
R AS (SELECT ts, ts + 1 + id % 7 AS te, k, id, data FROM (SELECT CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) + 1 AS BIGINT) AS ts, o_custkey AS k, o_orderkey AS id, o_orderpriority AS data FROM orders)),
S AS (SELECT ts, ts + 1 + CAST(floor(q) AS BIGINT) % 5 AS te, k, id, data FROM (SELECT CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) + 1 AS BIGINT) AS ts, l_quantity AS q, l_suppkey AS k, l_orderkey AS id, l_returnflag AS data FROM lineitem)),
E AS (SELECT * FROM (SELECT event_id AS id, user_id AS k, epoch_us(ts) AS ts, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS te, event_type AS data FROM events) WHERE te > ts)
"""


def _sweep(table: str, keys: str = "") -> str:
    """Common table expressions that end in `steps`: end points with the number of live rows after each."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    by = f"{keys}, p" if keys else "p"
    return f"""pts AS (SELECT {k}ts AS p, 1 AS d FROM {table} UNION ALL SELECT {k}te, -1 FROM {table}),
sums AS (SELECT {k}p, sum(d) AS d FROM pts GROUP BY {by}),
steps AS (SELECT {k}p AS ts, lead(p) OVER ({part}ORDER BY p) AS te, CAST(sum(d) OVER ({part}ORDER BY p) AS BIGINT) AS n FROM sums)"""


def query(name: str, sql: str | None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


PER_ORDER = f"""WITH {VIEWS} SELECT r.id AS id, count(*) AS pairs, min(greatest(r.ts, s.ts)) AS first_ts, CAST(sum(least(r.te, s.te) - greatest(r.ts, s.ts)) AS BIGINT) AS shared
FROM R r JOIN S s ON r.ts < s.te AND r.te > s.ts GROUP BY r.id"""


def _per_order(spark: SparkSession, sf: str, joined: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """What each order shares with line items.  Rows of one interval share the same, so the distinct intervals of both sides meet, and orders look theirs up."""
    r, s = orders_iv(spark, sf), lineitem_iv(spark, sf)
    pairs = joined(join.by_interval(r), join.by_interval(s))
    shared = F.sum((F.col("te") - F.col("ts")) * F.col("s_rows"))
    found = pairs.groupBy("r_ts", "r_te").agg(F.sum("s_rows").alias("pairs"), F.min("ts").alias("first_ts"), shared.alias("shared"))
    # an order has one row, but the operators take any number of rows with one id
    at = r.join(found, (F.col("ts") == F.col("r_ts")) & (F.col("te") == F.col("r_te")))
    return at.groupBy("id").agg(F.sum("pairs").alias("pairs"), F.min("first_ts").alias("first_ts"), F.sum("shared").alias("shared"))


@query("overlap_join_bucketed", f"WITH {VIEWS} SELECT r.id AS r_id, s.id AS s_id, greatest(r.ts, s.ts) AS ts, least(r.te, s.te) AS te FROM R r JOIN S s ON r.ts < s.te AND r.te > s.ts")
def overlap_join_bucketed(spark, sf):
    r, s = (x.select("ts", "te", "id") for x in (orders_iv(spark, sf), lineitem_iv(spark, sf)))  # lists keep all columns that they are given
    return join.overlap_join(r, s, crowded=True).select("r_id", "s_id", "ts", "te")


@query("overlap_join_theta", PER_ORDER)
def overlap_join_theta(spark, sf):
    return _per_order(spark, sf, join.theta_overlap_join)


@query("overlap_join_oip", PER_ORDER)
def overlap_join_oip(spark, sf):
    return _per_order(spark, sf, lambda r, s: join.granule_join(r, s, 400))


@query("overlap_join_levels", PER_ORDER)
def overlap_join_levels(spark, sf):
    return _per_order(spark, sf, lambda r, s: join.overlap_join(r, s, width=1, levels=True))


@query("overlap_join_closed", PER_ORDER.replace("r.ts < s.te AND r.te > s.ts", "r.ts <= s.te AND r.te >= s.ts"))
def overlap_join_closed(spark, sf):
    return _per_order(spark, sf, lambda r, s: join.overlap_join(r, s, CLOSED))


KEYED = f"WITH {VIEWS} SELECT r.k AS k, r.id AS r_id, s.id AS s_id, greatest(r.ts, s.ts) AS ts, least(r.te, s.te) AS te FROM R r JOIN S s ON r.k = s.k AND r.ts < s.te AND r.te > s.ts"


@query("overlap_join_keyed", KEYED)
def overlap_join_keyed(spark, sf):
    return join.keyed_overlap_join(orders_iv(spark, sf), lineitem_iv(spark, sf), ["k"]).select(F.col("r_k").alias("k"), "r_id", "s_id", "ts", "te")


@query("overlap_join_keyed_closed", KEYED.replace("r.ts < s.te AND r.te > s.ts", "r.ts <= s.te AND r.te >= s.ts"))
def overlap_join_keyed_closed(spark, sf):
    return join.keyed_overlap_join(orders_iv(spark, sf), lineitem_iv(spark, sf), ["k"], CLOSED).select(F.col("r_k").alias("k"), "r_id", "s_id", "ts", "te")


@query("interval_equality_join", f"WITH {VIEWS} SELECT r.id AS r_id, s.id AS s_id, r.ts AS ts, r.te AS te FROM R r JOIN S s ON r.ts = s.ts AND r.te = s.te")
def interval_equality_join(spark, sf):
    r, s = (x.select("ts", "te", "id") for x in (orders_iv(spark, sf), lineitem_iv(spark, sf)))
    return join.interval_equality_join(r, s).select("r_id", "s_id", "ts", "te")


@query("range_select", f"WITH {VIEWS} SELECT ts, te, k, id FROM S WHERE ts < {HIGH} AND te > {LOW}")
def range_select(spark, sf):
    return join.range_select(lineitem_iv(spark, sf), LOW, HIGH).select("ts", "te", "k", "id")


@query("range_select_closed", f"WITH {VIEWS} SELECT ts, te, k, id FROM S WHERE ts <= {HIGH} AND te >= {LOW}")
def range_select_closed(spark, sf):
    return join.range_select(lineitem_iv(spark, sf), LOW, HIGH, CLOSED).select("ts", "te", "k", "id")


@query("antijoin_pieces", f"""WITH {VIEWS}, {_sweep("R")},
gap AS (SELECT ts, coalesce(te, 4611686018427387904) AS te FROM steps WHERE n = 0 UNION ALL SELECT -4611686018427387904, min(ts) FROM R)
SELECT greatest(s.ts, g.ts) AS ts, least(s.te, g.te) AS te, s.id AS id, s.k AS k FROM S s JOIN gap g ON s.ts < g.te AND s.te > g.ts""")
def antijoin_pieces(spark, sf):
    return antijoin.temporal_anti_join(lineitem_iv(spark, sf), orders_iv(spark, sf)).select("ts", "te", "id", "k")


ANTI_KEYED = f"""WITH {VIEWS}, {{sweep}},
gap AS (SELECT {{k}}, ts, coalesce(te, 4611686018427387904) AS te FROM steps WHERE n = 0 UNION ALL SELECT {{k}}, -4611686018427387904, min(ts) FROM {{s}} GROUP BY {{k}})
SELECT greatest(r.ts, g.ts) AS ts, least(r.te, g.te) AS te, r.id AS id, r.{{k}} AS {{k}} FROM {{r}} r JOIN gap g ON r.{{k}} = g.{{k}} AND r.ts < g.te AND r.te > g.ts
UNION ALL SELECT ts, te, id, {{k}} FROM {{r}} r WHERE NOT EXISTS (SELECT 1 FROM {{s}} s WHERE s.{{k}} = r.{{k}})"""


@query("antijoin_keyed", ANTI_KEYED.format(sweep=_sweep("S", "k"), k="k", r="R", s="S"))
def antijoin_keyed(spark, sf):
    return antijoin.temporal_anti_join(orders_iv(spark, sf), lineitem_iv(spark, sf), ["k"]).select("ts", "te", "id", "k")


CLOSED_VIEWS = VIEWS + """, R1 AS (SELECT ts, te + 1 AS te, k, id, data FROM R), S1 AS (SELECT ts, te + 1 AS te, k, id, data FROM S), E1 AS (SELECT ts, te + 1 AS te, k, id, data FROM E)"""


@query("antijoin_keyed_closed", f"SELECT ts, te - 1 AS te, id, k FROM ({ANTI_KEYED.format(sweep=_sweep('S1', 'k'), k='k', r='R1', s='S1').replace(VIEWS, CLOSED_VIEWS)})")
def antijoin_keyed_closed(spark, sf):
    return antijoin.temporal_anti_join(orders_iv(spark, sf), lineitem_iv(spark, sf), ["k"], CLOSED).select("ts", "te", "id", "k")


@query("temporal_difference", ANTI_KEYED.format(sweep=_sweep("R", "data"), k="data", r="E2", s="R").replace("E AS (", "E2 AS (SELECT ts, te, id, CASE data WHEN 'A' THEN '1-URGENT' WHEN 'N' THEN '2-HIGH' ELSE data END AS data FROM S),\nE AS (", 1))
def temporal_difference(spark, sf):
    renamed = F.when(F.col("data") == "A", "1-URGENT").when(F.col("data") == "N", "2-HIGH").otherwise(F.col("data"))
    return antijoin.temporal_difference(lineitem_iv(spark, sf).withColumn("data", renamed), orders_iv(spark, sf)).select("ts", "te", "id", "data")


@query("temporal_intersection", f"WITH {VIEWS} SELECT greatest(a.ts, b.ts) AS ts, least(a.te, b.te) AS te, a.data AS data, count(*) AS n FROM R a JOIN R b ON a.data = b.data AND a.ts < b.te AND a.te > b.ts GROUP BY 1, 2, 3")
def temporal_intersection(spark, sf):
    r = orders_iv(spark, sf)
    return antijoin.intersection_counts(r, r)


@query("temporal_intersection_closed", f"WITH {VIEWS} SELECT greatest(a.ts, b.ts) AS ts, least(a.te, b.te) AS te, a.data AS data, count(*) AS n FROM R a JOIN R b ON a.data = b.data AND a.ts <= b.te AND a.te >= b.ts GROUP BY 1, 2, 3")
def temporal_intersection_closed(spark, sf):
    r = orders_iv(spark, sf)
    return antijoin.intersection_counts(r, r, bounds=CLOSED)


@query("temporal_agg_segments_closed", f"WITH {CLOSED_VIEWS}, {_sweep('S1')} SELECT ts, te - 1 AS te, n FROM steps WHERE n > 0 AND te IS NOT NULL")
def temporal_agg_segments_closed(spark, sf):
    return aggregate.segments(lineitem_iv(spark, sf), bounds=CLOSED)


@query("temporal_agg_segments", f"WITH {VIEWS}, {_sweep('S')} SELECT ts, te, n FROM steps WHERE n > 0 AND te IS NOT NULL")
def temporal_agg_segments(spark, sf):
    return aggregate.segments(lineitem_iv(spark, sf))


@query("temporal_agg_segments_keyed", f"WITH {VIEWS}, {_sweep('E', 'data')} SELECT data, ts, te, n FROM steps WHERE n > 0 AND te IS NOT NULL")
def temporal_agg_segments_keyed(spark, sf):
    return aggregate.segments(events_iv(spark, sf), ["data"])


@query("temporal_agg_payload", f"""WITH {VIEWS}, {_sweep("R")} SELECT s.ts AS ts, s.te AS te, count(*) AS n, min(r.id) AS least_id, max(r.id) AS most_id, string_agg(CAST(r.id AS VARCHAR), '+' ORDER BY r.id) AS payload
FROM steps s JOIN R r ON r.ts < s.te AND r.te > s.ts WHERE s.n > 0 AND s.te IS NOT NULL GROUP BY 1, 2""")
def temporal_agg_payload(spark, sf):
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("r_id")), lambda x: x.cast("string")), "+")
    return aggregate.segment_aggregate(orders_iv(spark, sf), {"n": F.count("*"), "least_id": F.min("r_id"), "most_id": F.max("r_id"), "payload": ids})


@query("normalize_keyed", f"""WITH {VIEWS}, RR AS (SELECT *, row_number() OVER () AS rid FROM R), pts AS (SELECT DISTINCT k, p FROM (SELECT k, ts AS p FROM R UNION ALL SELECT k, te FROM R))
SELECT r.k AS k, r.id AS id, p AS ts, coalesce(lead(p) OVER (PARTITION BY rid ORDER BY p), r.te) AS te FROM RR r JOIN pts ON pts.k = r.k AND r.ts <= p AND p < r.te""")
def normalize_keyed(spark, sf):
    return aggregate.normalize(orders_iv(spark, sf), ["k"]).select("k", "id", "ts", "te")


@query("normalize_keyed_closed", f"""WITH {CLOSED_VIEWS}, RR AS (SELECT *, row_number() OVER () AS rid FROM R1), pts AS (SELECT DISTINCT k, p FROM (SELECT k, ts AS p FROM R1 UNION ALL SELECT k, te FROM R1))
SELECT r.k AS k, r.id AS id, p AS ts, coalesce(lead(p) OVER (PARTITION BY rid ORDER BY p), r.te) - 1 AS te FROM RR r JOIN pts ON pts.k = r.k AND r.ts <= p AND p < r.te""")
def normalize_keyed_closed(spark, sf):
    return aggregate.normalize(orders_iv(spark, sf), ["k"], CLOSED).select("k", "id", "ts", "te")


@query("dip_num_partitions", f"WITH {VIEWS}, {_sweep('S')} SELECT max(n) AS partitions FROM steps")
def dip_num_partitions(spark, sf):
    return aggregate.max_depth(lineitem_iv(spark, sf))


@query("dip_overlap_violations", f"WITH {VIEWS}, {_sweep('S')} SELECT CAST(0 AS BIGINT) AS violations, count(*) AS n, (SELECT max(n) FROM steps) AS parts FROM S")
def dip_overlap_violations(spark, sf):
    parts = partition.disjoint_partitions(lineitem_iv(spark, sf))
    return partition.overlap_violations(parts, F.count("*").alias("n"), F.count_distinct("part").alias("parts"))


@query("dip_islands", f"""WITH {VIEWS}, {_sweep("E")}, edge AS (SELECT ts, n, lag(n, 1, 0) OVER (ORDER BY ts) AS b FROM steps),
ends AS (SELECT ts, lead(ts) OVER (ORDER BY ts) AS te, n FROM edge WHERE n = 0 OR b = 0) SELECT ts, te FROM ends WHERE n > 0""")
def dip_islands(spark, sf):
    return partition.islands(events_iv(spark, sf))


CELL_SQL = f"""WITH {VIEWS}, w AS (SELECT min(ts) AS o, (max(te) - min(ts) + 1 + {GRANULES - 1}) // {GRANULES} AS d FROM S)
SELECT (ts - o) // d AS i, (te - o) // d AS j, count(*) AS n FROM S, w GROUP BY 1, 2"""


@query("oip_cells", CELL_SQL)
def oip_cells(spark, sf):
    return partition.granule_cells(lineitem_iv(spark, sf), GRANULES)


@query("oip_num_partitions", f"SELECT count(*) AS cells FROM ({CELL_SQL})")
def oip_num_partitions(spark, sf):
    return partition.granule_cells(lineitem_iv(spark, sf), GRANULES).agg(F.count("*").alias("cells"))


@query("scalar_functions", f"WITH {VIEWS} SELECT id, k, ts, te - ts AS duration, (ts - 10) // 7 AS granule, 'null+' || data AS payload FROM R WHERE ts >= 10 UNION ALL SELECT id, k, ts, te - ts, -((16 - ts) // 7), 'null+' || data FROM R WHERE ts < 10")
def scalar_functions(spark, sf):
    return orders_iv(spark, sf).select("id", "k", "ts", duration(F.col("ts"), F.col("te")).alias("duration"), granule(F.col("ts"), 10, 7).alias("granule"), joined_payload(F.lit(None).cast("string"), F.col("data")).alias("payload"))


@query("fork_node", f"WITH {VIEWS} SELECT id, ts, te, (te >> l) << l AS node, CAST(1 AS BIGINT) << (length(bin(te)) - 1) AS root FROM (SELECT *, CAST(length(bin(xor(ts - 1, te))) - 1 AS BIGINT) AS l FROM R)")
def fork_node_query(spark, sf):
    return orders_iv(spark, sf).select("id", "ts", "te", fork_node(F.col("ts"), F.col("te")).alias("node"), root_power(F.col("te")).alias("root"))


@query("relation_stats", f"WITH {VIEWS} SELECT count(*) AS n, max(te - ts + 1) AS longest, min(ts) AS us, max(te) AS ue FROM S")
def relation_stats_query(spark, sf):
    return relation_stats(lineitem_iv(spark, sf))


@query("sort_start_end", f"WITH {VIEWS} SELECT k, id, ts, te, row_number() OVER (PARTITION BY k ORDER BY ts, te DESC, id) AS place FROM R")
def sort_start_end(spark, sf):
    return orders_iv(spark, sf).select("k", "id", "ts", "te", F.row_number().over(Window.partitionBy("k").orderBy("ts", F.desc("te"), "id")).cast("bigint").alias("place"))


@query("match_counters", f"""WITH {VIEWS}, w AS (SELECT 8 AS d), c AS (SELECT count(*) AS n FROM (SELECT ts // 8 AS a, (te - 1) // 8 AS b FROM R) r JOIN (SELECT ts // 8 AS a, (te - 1) // 8 AS b FROM S) s ON r.a <= s.b AND r.b >= s.a),
m AS (SELECT count(*) AS n FROM R r JOIN S s ON r.ts < s.te AND r.te > s.ts) SELECT m.n AS matches, c.n - m.n AS false_hits FROM m, c""")
def match_counters(spark, sf):
    """Pairs whose granules meet against pairs that overlap, for granules of 8 days; both sides are added up by interval first."""
    r = orders_iv(spark, sf).groupBy("ts", "te").agg(F.count("*").alias("c"))
    s = lineitem_iv(spark, sf).groupBy("ts", "te").agg(F.count("*").alias("c"))
    coarse = lambda x: x.select((granule(F.col("ts"), 0, 8) * 8).alias("ts"), (granule(F.col("te") - 1, 0, 8) * 8 + 8).alias("te"), "c")
    count = lambda pairs: pairs.agg(F.sum(F.col("r_c") * F.col("s_c")).alias("n"))
    matches, candidates = count(join.overlap_join(r, s, width=8)), count(join.overlap_join(coarse(r), coarse(s), width=8))
    return matches.select(F.col("n").alias("matches")).crossJoin(candidates).select("matches", (F.col("n") - F.col("matches")).alias("false_hits"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_join_keyed(spark, sf_dir)
