"""Registered queries over the driver's tables, each with its SQL oracle where SQL can express it.

Inputs are projections of the tables into program relations, written once in SQL that both engines read. They take whole
tables, and ids grow with them; where ids are taken modulo a number (blocks of a function, threads, kinds), that shapes a
relation and drops no row. A condition stands only where it is what a relation says (used blocks, marked nodes, frees).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.operators import assumptions, clients, constraints as cons, graphs, pointsto, slices
from quarry.plans import fixpoint
from quarry.plans.tables import oracle, project, settle
from quarry.sources import logs
from quarry.streaming import traces

FLAGSHIP = "points_to"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, **relations: str):
    """Register a function of a reader of projections; ``sql`` over the named relations is its oracle."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda rel: project(spark, sf_dir, rel))
        if sql:
            ORACLES[f.__name__] = oracle(sql, **relations)
        return f

    return put


# Program relations.
COUNTS = "SELECT CAST(l_suppkey AS INT) AS bb, CAST(l_quantity AS BIGINT) AS cnt FROM {lineitem}"
CALLS_SEEN = "SELECT CAST(o_custkey AS INT) AS call, CAST(l_suppkey AS INT) AS fn FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey"
PTS_SEEN = "SELECT CAST(l_partkey AS INT) AS val, CAST(CASE WHEN l_suppkey % 97 = 0 AND l_linenumber = 1 THEN 2 WHEN l_suppkey % 31 = 0 THEN -1 WHEN l_suppkey % 29 = 0 THEN 0 ELSE l_suppkey + 3 END AS INT) AS obj FROM {lineitem}"
ALIAS_SEEN = "SELECT CAST(l_partkey AS INT) AS load, CAST(CASE WHEN l_suppkey % 53 = 0 AND l_linenumber = 1 THEN 2 WHEN l_suppkey % 19 = 0 THEN 0 ELSE l_suppkey + 3 END AS INT) AS store FROM {lineitem}"
ORDER_SITES = "SELECT l_orderkey, l_linenumber, CAST(l_suppkey AS INT) AS cs FROM {lineitem}"
EDGES = "SELECT DISTINCT CAST(l_orderkey AS INT) AS src, CAST(FLOOR((l_orderkey + l_linenumber) / 3) AS INT) AS dest FROM {lineitem}"
SPARSE = "SELECT DISTINCT CAST(s_suppkey AS INT) AS src, CAST(s_suppkey * 2 + 5 AS INT) AS dest FROM {supplier} UNION SELECT DISTINCT CAST(c_custkey AS INT), CAST(FLOOR(c_custkey * 2 / 3) AS INT) FROM {customer}"
DAG = f"SELECT src, dest FROM ({SPARSE}) d WHERE src < dest"
CONS = "SELECT DISTINCT CAST((l_orderkey * 7 + l_linenumber) % 4 AS INT) AS ctype, CAST(CASE WHEN l_partkey % 50 = 0 THEN l_suppkey * 8 + 4 ELSE l_orderkey * 8 + l_partkey % 8 + 4 END AS INT) AS src, CAST(l_orderkey * 8 + (l_suppkey + l_linenumber) % 8 + 4 AS INT) AS dest, 0 AS rep, 0 AS offs FROM {lineitem}"
LAYERED = "SELECT DISTINCT CAST(CASE WHEN l_linenumber = 1 THEN 3 WHEN l_linenumber = 2 THEN 1 WHEN l_linenumber = 3 THEN 2 ELSE 0 END AS INT) AS ctype, CAST(l_orderkey * 16 + 4 + CASE WHEN l_linenumber = 1 THEN l_partkey % 3 * 3 ELSE l_partkey % 10 END AS INT) AS src, CAST(l_orderkey * 16 + 4 + (l_suppkey + l_linenumber) % 10 AS INT) AS dest, 0 AS rep, CAST(CASE WHEN l_linenumber >= 6 THEN l_suppkey % 3 ELSE 0 END AS INT) AS offs FROM {lineitem}"
ALLOCS = "SELECT DISTINCT CAST(l_orderkey * 16 + 4 + l_partkey % 3 * 3 AS INT) AS obj, CAST(l_partkey % 3 AS INT) AS max_offs FROM {lineitem}"
FACTS = "SELECT DISTINCT CAST(l_orderkey AS INT) AS node, CAST(l_partkey + 4 AS INT) AS obj FROM {lineitem}"
VALUES = "SELECT CAST(o_orderkey AS INT) AS id, CAST(o_custkey AS INT) AS value_key FROM {orders}"
INSTS = "SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS inst, CAST(l_suppkey AS INT) AS fn, CAST(l_suppkey * 20 + l_partkey % 20 AS INT) AS bb, CASE (l_partkey + l_linenumber) % 11 WHEN 0 THEN 'ret' WHEN 1 THEN 'alloca' WHEN 2 THEN 'load' WHEN 3 THEN 'store' WHEN 4 THEN 'gep' WHEN 5 THEN 'bitcast' WHEN 6 THEN 'phi' WHEN 7 THEN 'select' WHEN 8 THEN 'inttoptr' WHEN 9 THEN 'extract' ELSE 'insert' END AS op, CAST(l_orderkey + 10 AS INT) AS dst, CAST(l_partkey + 10 AS INT) AS a, CAST(CASE WHEN l_partkey % 5 = 0 THEN -1 ELSE l_suppkey + 10 END AS INT) AS b, CAST(l_partkey % 4 AS INT) AS k, (l_quantity < 40) AS is_ptr, CASE WHEN l_quantity < 40 THEN 'ptr' WHEN l_orderkey % 3 = 0 THEN 'int' WHEN l_orderkey % 3 = 1 THEN 'float' ELSE 'struct' END AS value_type, CASE l_suppkey % 3 WHEN 0 THEN 'ptr' WHEN 1 THEN 'int' ELSE 'struct' END AS pointee FROM {lineitem}"
SITES = "SELECT DISTINCT CAST(l_partkey AS INT) AS cs, CAST(FLOOR(l_partkey / 10) AS INT) AS fn, CAST(FLOOR((l_partkey * 3 + 7) / 20) AS INT) AS callee FROM {lineitem}"
EVENTS = "SELECT CAST(user_id % 8 AS BIGINT) AS thread, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'store' WHEN event_id % 17 = 1 THEN 'free' ELSE 'load' END AS kind, CAST(event_id % 501 AS BIGINT) AS id, CAST(user_id * 4 AS BIGINT) AS addr, CAST(event_id % 6 + 1 AS BIGINT) AS size FROM {events}"
VISITS = "SELECT CAST(user_id % 8 AS BIGINT) AS thread, event_id AS seq, 'visit' AS kind, CAST(user_id % 200 AS BIGINT) AS id, CAST(0 AS BIGINT) AS addr, CAST(0 AS BIGINT) AS size FROM {events}"
ALLOC_EVENTS = "SELECT CAST(0 AS BIGINT) AS thread, event_id AS seq, CASE WHEN event_id % 5 = 0 THEN 'free' ELSE 'malloc' END AS kind, event_id AS id, CAST(user_id * 1024 AS BIGINT) AS addr, CAST(event_id % 900 + 1 AS BIGINT) AS size FROM {events} WHERE event_id % 2 = 0"
ACCESSES = "SELECT CAST(event_id % 701 AS BIGINT) AS id, CAST(user_id * 1024 + event_id % 1024 AS BIGINT) AS addr, event_id AS seq FROM {events} WHERE event_id % 2 = 1"
STACK_EVENTS = "SELECT CAST(user_id AS BIGINT) AS thread, event_id AS seq, CASE WHEN event_id % 7 < 4 THEN 'call' WHEN event_id % 7 = 6 AND event_id % 11 = 0 THEN 'longjmp' WHEN event_id % 29 = 5 THEN 'setjmp' ELSE 'ret' END AS kind, CAST(event_id % 5 AS BIGINT) AS id, CAST(0 AS BIGINT) AS addr, CAST(0 AS BIGINT) AS size FROM {events}"
STACK_LINES = "SELECT l_orderkey, array_join(transform(array_sort(collect_list(struct(l_linenumber, l_suppkey))), x -> CAST(x.l_suppkey AS STRING)), ' ') AS value FROM {lineitem} GROUP BY l_orderkey"
#: In SQL of the oracle, the same stacks: of orders without a repeated supplier (or supplier 0), with 0 before.
STACKS_SQL = "SELECT DISTINCT '0 ' || string_agg(CAST(l_suppkey AS VARCHAR), ' ' ORDER BY l_linenumber, l_suppkey) AS stack FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) = count(*) AND min(l_suppkey) > 0"
CLOSURE_SQL = "tc(src, dest) AS (SELECT src, dest FROM edges UNION SELECT tc.src, e.dest FROM tc JOIN edges e ON e.src = tc.dest)"


def lines_of(pairs: DataFrame, key: str, item: str) -> DataFrame:
    return logs.write_pairs(pairs, key, item)


# Sources and sinks.
@query("SELECT CAST(l_suppkey AS INT) AS bb, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS cnt FROM lineitem GROUP BY 1")
def edge_profile(rel):
    return logs.read_counts(rel(COUNTS).select(F.concat_ws(" ", "bb", "cnt").alias("value")))


@query("SELECT DISTINCT call, fn FROM seen", seen=CALLS_SEEN)
def indirect_target_log(rel):
    return logs.read_pairs(lines_of(rel(CALLS_SEEN), "call", "fn"), "call", "fn")


@query("SELECT DISTINCT val, obj FROM seen WHERE obj NOT IN (0, -1) AND val NOT IN (SELECT val FROM seen WHERE obj = 2)", seen=PTS_SEEN)
def points_to_log(rel):
    return logs.read_points_to(lines_of(rel(PTS_SEEN), "val", "obj"))


@query("SELECT DISTINCT load, CASE WHEN store = 2 THEN -1 ELSE store END AS store FROM seen WHERE store <> 0", seen=ALIAS_SEEN)
def alias_log(rel):
    return logs.read_aliases(lines_of(rel(ALIAS_SEEN), "load", "store"))


def _stacks(rel):
    return logs.read_stacks(rel(STACK_LINES), strict=False)


@query(STACKS_SQL)
def call_stacks(rel):
    return logs.merge_stacks(_stacks(rel)).select(logs.joined("stack").alias("stack"))


@query(f"SELECT CAST(id AS INT) AS id, count(*) AS n_stacks FROM (SELECT unnest(string_split(stack, ' ')) AS id FROM ({STACKS_SQL}) s) u GROUP BY 1")
def stack_index(rel):
    return logs.stack_index(_stacks(rel))


@query("SELECT CAST(call AS VARCHAR) || ': ' || string_agg(CAST(fn AS VARCHAR), ' ' ORDER BY fn) AS value FROM (SELECT DISTINCT call, fn FROM (SELECT call, fn FROM a UNION ALL SELECT val, obj FROM b) u) d GROUP BY call", a=CALLS_SEEN, b=PTS_SEEN)
def merged_logs(rel):
    return logs.merge_pairs(lines_of(rel(CALLS_SEEN), "call", "fn"), lines_of(rel(PTS_SEEN), "val", "obj"))


@query(f"SELECT stack FROM ({STACKS_SQL}) s UNION SELECT '0 ' || CAST(l_suppkey AS VARCHAR) FROM lineitem")
def merged_call_stacks(rel):
    short = rel(ORDER_SITES).select(F.array(F.lit(0), "cs").alias("stack"))
    return logs.merge_stacks(_stacks(rel), short).select(logs.joined("stack").alias("stack"))


@query("SELECT CAST(src AS VARCHAR) || ' -> { ' || string_agg(CAST(dest AS VARCHAR), ' ' ORDER BY dest) || ' };' AS value FROM edges GROUP BY src", edges=EDGES)
def dot_export(rel):
    return logs.dot_lines(rel(EDGES))


@query("SELECT src AS fcn_num, dest AS inst_num FROM edges", edges=EDGES)
def slice_seed_log(rel):
    return logs.read_seeds(logs.write_seeds(rel(EDGES).select(F.col("src").alias("fcn_num"), F.col("dest").alias("inst_num"))))


@query(f"SELECT DISTINCT CAST(unnest(string_split(stack, ' ')) AS INT) AS id, stack FROM ({STACKS_SQL}) s")
def stacks_by_id(rel):
    return logs.stacks_by_id(_stacks(rel)).select("id", logs.joined("stack").alias("stack"))


@query(f"SELECT stack FROM ({STACKS_SQL}) s INTERSECT SELECT '0 ' || CAST(l_suppkey AS VARCHAR) FROM lineitem")
def stacks_equal_to_prefix(rel):
    asked = rel(ORDER_SITES).select(F.array(F.lit(0), "cs").alias("stack"))
    return logs.equal_to_prefix(_stacks(rel), asked).select(logs.joined("stack").alias("stack"))


NUMBERED = "SELECT DISTINCT CAST(dense_rank() OVER (ORDER BY fn) - 1 AS INT) AS fcn_num, CAST(dense_rank() OVER (PARTITION BY fn ORDER BY inst) - 1 AS INT) AS inst_num, inst FROM i"


@query(f"SELECT n.fcn_num, n.inst_num, n.inst FROM ({NUMBERED}) n JOIN (SELECT DISTINCT s_nationkey AS f, s_suppkey % 50 AS k FROM supplier) s ON s.f = n.fcn_num AND s.k = n.inst_num", i=INSTS)
def seed_instructions(rel):
    lines = logs.write_seeds(rel("SELECT DISTINCT s_nationkey AS fcn_num, s_suppkey % 50 AS inst_num FROM {supplier}"))
    return logs.seed_instructions(logs.read_seeds(lines), rel(INSTS))


@query("SELECT CAST(call AS VARCHAR) || ': ' || string_agg(CAST(fn AS VARCHAR), ' ' ORDER BY fn) AS value FROM (SELECT call, fn FROM a UNION SELECT load, store FROM b) d GROUP BY call", a=CALLS_SEEN, b=ALIAS_SEEN)
def merged_into_log(rel):
    run = rel(ALIAS_SEEN).select(F.col("load").alias("call"), F.col("store").alias("fn"))
    return logs.merge_into(lines_of(rel(CALLS_SEEN), "call", "fn"), run, "call", "fn")


@query("SELECT t.n, string_agg(COALESCE(p_name, CAST(t.id AS VARCHAR)), ' ' ORDER BY t.at) AS value FROM (SELECT o_orderkey AS n, 0 AS at, o_custkey AS id FROM orders UNION ALL SELECT o_orderkey, 1, o_orderkey % 4001 FROM orders) t LEFT JOIN part ON p_partkey = t.id AND p_partkey % 3 <> 0 GROUP BY t.n")
def trace_names(rel):
    listing = rel("SELECT CAST(p_partkey + 10 AS BIGINT) AS n, CONCAT(' ', CAST(p_partkey AS STRING), ': ', p_name) AS value FROM {part} WHERE p_partkey % 3 <> 0 UNION ALL SELECT 5, 'OUTPUT:' UNION ALL SELECT 2, '7: not yet'")
    return logs.substitute_ids(rel("SELECT o_orderkey AS n, CONCAT_WS(' ', o_custkey, o_orderkey % 4001) AS value FROM {orders}"), logs.read_id_map(listing))


# Constraint generation.
@query(
    """SELECT DISTINCT CAST(ctype AS INT) AS ctype, CAST(src AS INT) AS src, CAST(dest AS INT) AS dest, CAST(offs AS INT) AS offs FROM (
    SELECT 0 AS ctype, a AS src, fn + 5000 AS dest, 0 AS offs FROM i WHERE op = 'ret' AND is_ptr
    UNION ALL SELECT 3, inst + 9000000, dst, 0 FROM i WHERE op = 'alloca'
    UNION ALL SELECT 1, a, dst, 0 FROM i WHERE op = 'load' AND value_type = 'ptr'
    UNION ALL SELECT 1, dst, 1, 0 FROM i WHERE op = 'load' AND value_type = 'int' AND pointee = 'ptr'
    UNION ALL SELECT 2, a, b, 0 FROM i WHERE op = 'store' AND value_type = 'ptr'
    UNION ALL SELECT 2, 1, b, 0 FROM i WHERE op = 'store' AND value_type = 'int' AND pointee <> 'int'
    UNION ALL SELECT 0, a, dst, k FROM i WHERE op = 'gep'
    UNION ALL SELECT 0, a, dst, 0 FROM i WHERE op IN ('bitcast', 'phi', 'select') AND is_ptr
    UNION ALL SELECT 0, b, dst, 0 FROM i WHERE op IN ('phi', 'select') AND is_ptr
    UNION ALL SELECT 0, a + 1, dst, 0 FROM i WHERE op = 'phi' AND is_ptr AND k >= 2 UNION ALL SELECT 0, a + 2, dst, 0 FROM i WHERE op = 'phi' AND is_ptr AND k = 3
    UNION ALL SELECT 0, CASE WHEN b = -1 THEN 1 ELSE b END, dst, 0 FROM i WHERE op = 'inttoptr'
    UNION ALL SELECT 0, 3, CASE WHEN value_type = 'ptr' THEN dst ELSE 1 END, 0 FROM i WHERE op = 'extract' AND value_type IN ('ptr', 'int')
    UNION ALL SELECT 0, CASE WHEN value_type = 'ptr' THEN a ELSE 1 END, 3, 0 FROM i WHERE op = 'insert' AND value_type IN ('ptr', 'int')) u""",
    i=INSTS,
)
def instruction_constraints(rel):
    more = F.when(F.col("k") == 3, F.array(F.col("a") + 1, F.col("a") + 2)).when(F.col("k") == 2, F.array(F.col("a") + 1))
    return cons.from_instructions(rel(INSTS).withColumn("more", more), 5000, 9_000_000)


@query("SELECT DISTINCT c.ctype, c.src + f AS src, c.dest + f AS dest, c.offs FROM c CROSS JOIN generate_series(0, 3) AS g(f) WHERE f <= CASE WHEN c.ctype = 3 THEN 0 ELSE c.src % 4 END", c="SELECT CAST(ctype AS INT) AS ctype, CAST(src AS INT) AS src, CAST(dest AS INT) AS dest, CAST(offs AS INT) AS offs FROM (" + CONS + ") x")
def typed_constraints(rel):
    c = rel(CONS).withColumn("type", F.concat(F.lit("t"), (F.col("src") % 4).cast("string")))
    fields = rel("SELECT 't0' AS type, 1 AS n_fields UNION ALL SELECT 't1', 2 UNION ALL SELECT 't2', 3 UNION ALL SELECT 't3', 4")
    return cons.typed(c.select("ctype", "src", "dest", "offs", "type"), fields).distinct()


USED = "SELECT DISTINCT CAST(l_suppkey * 5 + l_linenumber % 3 AS INT) AS bb FROM {lineitem} UNION SELECT 1"


@query("WITH RECURSIVE r(node) AS (SELECT bb FROM used WHERE bb < 25 UNION SELECT e.dest FROM r JOIN edges e ON e.src = r.node JOIN used u ON u.bb = e.dest) SELECT node, 'used' AS kind FROM r UNION SELECT e.dest, 'boundary' FROM r JOIN edges e ON e.src = r.node WHERE e.dest NOT IN (SELECT bb FROM used)", edges=SPARSE, used=USED)
def reachable_blocks(rel):
    seen, edge = cons.used_reachable(rel(f"SELECT bb AS node FROM ({USED}) u WHERE bb < 25"), settle(rel(SPARSE)), settle(rel(USED)))
    return seen.withColumn("kind", F.lit("used")).union(edge.withColumn("kind", F.lit("boundary")))


@query(
    """SELECT DISTINCT CAST(0 AS INT) AS ctype, CAST(src AS INT) AS src, CAST(dest AS INT) AS dest, CAST(0 AS INT) AS offs FROM (
    SELECT l_orderkey % 50 * 10 + 1009 AS src, l_orderkey % 3000 + 5000 AS dest FROM lineitem WHERE l_orderkey % 100 < 90
    UNION ALL SELECT l_partkey, CASE WHEN pos < l_orderkey % 100 % 4 THEN l_orderkey % 50 * 10 + 1000 + pos WHEN l_orderkey % 2 = 0 THEN l_orderkey % 50 * 10 + 1008 END
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS pos FROM lineitem) q WHERE l_orderkey % 100 < 90) u WHERE dest IS NOT NULL"""
)
def call_constraints(rel):
    calls = rel("SELECT CAST(l_orderkey AS INT) AS call_id, CAST(l_orderkey % 100 AS INT) AS fn, transform(array_sort(collect_list(struct(l_linenumber, CAST(l_partkey AS INT) AS p))), x -> x.p) AS args, CAST(l_orderkey % 3000 + 5000 AS INT) AS ret FROM {lineitem} GROUP BY l_orderkey")
    functions = rel("SELECT DISTINCT CAST(l_orderkey % 100 AS INT) AS fn FROM {lineitem} WHERE l_orderkey % 100 < 90")
    functions = functions.selectExpr("fn", "slice(transform(sequence(0, 3), i -> CAST(fn % 50 * 10 + 1000 + i AS INT)), 1, fn % 4) AS params", "fn % 50 * 10 + 1009 AS ret_node", "CASE WHEN fn % 2 = 0 THEN fn % 50 * 10 + 1008 ELSE -1 END AS vararg")
    return cons.direct_calls(calls, functions)


CALL_SITES = "SELECT CAST(o_orderkey AS INT) AS call_id, CAST(o_custkey AS INT) AS callee, CAST(CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 40 ELSE -1 END AS INT) AS direct_fn FROM {orders}"
SITE_TARGETS = "SELECT DISTINCT CAST(l_orderkey AS INT) AS call_id, CAST(l_suppkey % 40 AS INT) AS fn FROM {lineitem}"


@query("SELECT DISTINCT s.call_id, CASE WHEN direct_fn >= 0 THEN direct_fn ELSE COALESCE(t.fn, -1) END AS fn, CASE WHEN direct_fn >= 0 THEN 'direct' WHEN t.fn IS NOT NULL THEN 'profiled' ELSE 'deferred' END AS how FROM s LEFT JOIN t ON t.call_id = s.call_id", s=CALL_SITES, t=SITE_TARGETS)
def resolved_calls(rel):
    return cons.resolve_calls(rel(CALL_SITES), rel(SITE_TARGETS))


LIB_CALLS = "SELECT CAST(p_partkey AS INT) AS call_id, CASE p_partkey % 14 WHEN 0 THEN 'malloc' WHEN 1 THEN 'strchr' WHEN 2 THEN 'llvm.memcpy.p0' WHEN 3 THEN 'strtol' WHEN 4 THEN 'nobody_knows' WHEN 5 THEN 'atoi' WHEN 6 THEN 'llvm.memset.p0' WHEN 7 THEN 'freopen' WHEN 8 THEN 'pthread_create' WHEN 9 THEN 'gettext' WHEN 10 THEN 'localtime' WHEN 11 THEN 'fclose' WHEN 12 THEN 'opendir' ELSE 'realloc' END AS name, CAST(p_size + 10 AS INT) AS a0, CAST(p_partkey % 77 + 10 AS INT) AS a1, CAST(p_partkey % 55 + 10 AS INT) AS a2, CAST(p_partkey % 33 + 10 AS INT) AS a3, CAST(CASE WHEN p_partkey % 4 = 0 THEN -1 ELSE p_partkey % 66 + 100 END AS INT) AS ret, CAST(p_size % 4 AS INT) AS n_fields FROM {part}"
THREAD_PARAMS = "SELECT CAST(s_suppkey + 10 AS INT) AS callee, CAST(s_suppkey * 3 + 700 AS INT) AS param FROM {supplier} WHERE s_suppkey % 2 = 0"


@query(
    """SELECT DISTINCT CAST(ctype AS INT) AS ctype, CAST(src AS INT) AS src, CAST(dest AS INT) AS dest, CAST(offs AS INT) AS offs FROM (
    SELECT 3 AS ctype, call_id + 100000000 AS src, ret AS dest, 0 AS offs FROM c WHERE name IN ('malloc', 'opendir') AND ret >= 0
    UNION ALL SELECT 0, CASE WHEN name = 'freopen' THEN a2 ELSE a0 END, ret, 0 FROM c WHERE name IN ('strchr', 'freopen', 'realloc', 'gettext') AND ret >= 0
    UNION ALL SELECT 0, CASE WHEN name = 'gettext' THEN 50006 ELSE 50003 END, ret, 0 FROM c WHERE name IN ('gettext', 'localtime') AND ret >= 0
    UNION ALL SELECT 1, a1, call_id * 24 + 200000000, 0 FROM c WHERE name = 'llvm.memcpy.p0' AND n_fields = 0 UNION ALL SELECT 2, call_id * 24 + 200000000, a0, 0 FROM c WHERE name = 'llvm.memcpy.p0' AND n_fields = 0
    UNION ALL SELECT 0, a1, call_id * 24 + 200000001 + 3 * i, i FROM m UNION ALL SELECT 1, call_id * 24 + 200000001 + 3 * i, call_id * 24 + 200000000 + 3 * i, 0 FROM m
    UNION ALL SELECT 0, a0, call_id * 24 + 200000002 + 3 * i, i FROM m UNION ALL SELECT 2, call_id * 24 + 200000000 + 3 * i, call_id * 24 + 200000002 + 3 * i, 0 FROM m
    UNION ALL SELECT 2, a0, a1, 0 FROM c WHERE name = 'strtol'
    UNION ALL SELECT 0, a3, t.param, 0 FROM c JOIN t ON t.callee = a2 WHERE name = 'pthread_create'
    UNION ALL SELECT 1, ret, 2, 0 FROM c WHERE name = 'nobody_knows' AND ret >= 0
    UNION ALL SELECT 1, unnest([a0, a1, a2, a3]), 2, 0 FROM c WHERE name = 'nobody_knows') u""",
    c=LIB_CALLS, t=THREAD_PARAMS, m="SELECT call_id, a0, a1, unnest(range(n_fields)) AS i FROM (" + LIB_CALLS + ") x WHERE name = 'llvm.memcpy.p0' AND n_fields > 0",
)
def external_constraints(rel):
    calls = rel(LIB_CALLS).select("call_id", "name", F.array("a0", "a1", "a2", "a3").alias("args"), "ret", "n_fields")
    return cons.external_calls(calls, cons.find_models(calls), 50_000, 100_000_000, 200_000_000, rel(THREAD_PARAMS))


CONTEXTS = "SELECT DISTINCT CAST(n_nationkey AS INT) AS ctx, CAST(n_regionkey AS INT) AS fn FROM {nation}"
FN_ROWS = "SELECT ctype, src, dest, offs, CAST(src % 5 AS INT) AS fn FROM (" + CONS + ") c"


@query("SELECT DISTINCT ctype, CAST(CASE WHEN src < 60 THEN src ELSE src + (ctx + 1) * 1000 END AS INT) AS src, CAST(CASE WHEN dest < 60 THEN dest ELSE dest + (ctx + 1) * 1000 END AS INT) AS dest, offs FROM x JOIN r ON r.fn = x.fn", x=CONTEXTS, r=FN_ROWS)
def context_clones(rel):
    return cons.clone_contexts(rel(FN_ROWS), rel(CONTEXTS), 60, 1000)


@query("SELECT CASE WHEN ctype = 0 AND offs <> 0 THEN 'gep' WHEN ctype = 0 THEN 'copy' WHEN ctype = 1 THEN 'load' WHEN ctype = 2 THEN 'store' ELSE 'address' END AS kind, count(*) AS n FROM c GROUP BY 1", c=LAYERED)
def constraint_census(rel):
    return cons.census(rel(LAYERED))


GLOBALS = "SELECT CAST(c_custkey AS INT) AS g FROM {customer}"
INITS = "SELECT CAST(o_custkey AS INT) AS g, CAST(o_orderkey AS INT) AS value FROM {orders}"


@query("SELECT 3 AS ctype, g + 100000 AS src, g AS dest, 0 AS offs FROM g UNION SELECT 2, i.value, i.g, 0 FROM i JOIN g ON g.g = i.g UNION SELECT 3, 2, 2, 0 UNION SELECT 2, 2, 2, 0", g=GLOBALS, i=INITS)
def global_constraints(rel):
    return cons.global_rows(rel(GLOBALS), rel(INITS), 100_000)


@query("SELECT p_name AS const, CAST(CASE WHEN p_size % 5 = 0 THEN 0 WHEN p_size % 5 = 1 THEN 1 ELSE 99999 + dense_rank() OVER (PARTITION BY p_size % 5 > 1 ORDER BY p_name) END AS INT) AS node FROM (SELECT DISTINCT p_name || CAST(p_size AS VARCHAR) AS p_name, p_size FROM part) d")
def constant_ids(rel):
    return cons.constant_nodes(rel("SELECT CONCAT(p_name, CAST(p_size AS STRING)) AS const, CASE WHEN p_size % 5 = 0 THEN 'null' WHEN p_size % 5 = 1 THEN 'int' ELSE 'expr' END AS kind FROM {part}"))


# The solver.
def _points_sql(gep: bool = False) -> str:
    more = "UNION SELECT 'P', x.dest, p.b + x.offs FROM recurring.f p JOIN cons x ON p.k = 'P' AND x.ctype = 0 AND x.offs > 0 AND x.src = p.a JOIN allocs o ON o.obj = p.b AND o.max_offs >= x.offs WHERE p.b >= 2" if gep else ""
    return f"""WITH RECURSIVE f(k, a, b) USING KEY (k, a, b) AS (
    SELECT 'P', dest, src FROM cons WHERE ctype = 3 UNION SELECT 'C', src, dest FROM cons WHERE ctype = 0 AND offs = 0 AND src <> dest
    UNION SELECT * FROM (
      SELECT 'P' AS k, c.b AS a, p.b AS b FROM recurring.f c JOIN recurring.f p ON c.k = 'C' AND p.k = 'P' AND p.a = c.a
      UNION SELECT 'C', p.b, x.dest FROM recurring.f p JOIN cons x ON p.k = 'P' AND x.ctype = 1 AND x.src = p.a WHERE p.b <> x.dest AND p.b >= 2
      UNION SELECT 'C', x.src, p.b FROM recurring.f p JOIN cons x ON p.k = 'P' AND x.ctype = 2 AND x.dest = p.a WHERE p.b <> x.src AND p.b >= 2 AND x.src >= 2
      {more}) n ANTI JOIN recurring.f z ON z.k = n.k AND z.a = n.a AND z.b = n.b)"""


@query(_points_sql() + " SELECT a AS node, b AS obj FROM f WHERE k = 'P'", cons=CONS)
def points_to(rel):
    return pointsto.solve(rel(CONS))[0]


@query(_points_sql() + " SELECT a AS node, b AS obj FROM f WHERE k = 'P'", cons=CONS)
def points_to_collapsing(rel):
    return pointsto.solve(rel(CONS), collapse_every=3)[0]


@query(_points_sql(True) + " SELECT a AS node, b AS obj FROM f WHERE k = 'P'", cons=LAYERED, allocs=ALLOCS)
def points_to_fields(rel):
    return pointsto.solve(rel(LAYERED), settle(rel(ALLOCS)))[0]


@query(_points_sql() + " SELECT (SELECT count(*) FROM (SELECT a FROM f UNION SELECT b FROM f WHERE k = 'C') n) AS nodes, count(*) FILTER (k = 'P') AS facts, count(DISTINCT a) FILTER (k = 'P') AS non_empty, count(*) FILTER (k = 'C') AS edges FROM f", cons=CONS)
def points_to_counts(rel):
    facts, copies = pointsto.solve(rel(CONS))
    return pointsto.result_counts(facts, copies)


FN_OBJECTS = "SELECT CAST(n_nationkey * 8 + 4 AS INT) AS obj, CAST(n_nationkey * 8 + 5 AS INT) AS p0, CAST(n_nationkey * 8 + 6 AS INT) AS p1, CAST(n_nationkey * 8 + 7 AS INT) AS ret_node FROM {nation}"
INDIRECT = "SELECT DISTINCT CAST(s_suppkey * 8 + 4 AS INT) AS callee, CAST(s_suppkey * 8 + 5 AS INT) AS a0, CAST(s_suppkey * 16 + 6 AS INT) AS a1, CAST(s_suppkey * 24 + 7 AS INT) AS ret FROM {supplier}"


@query(
    _points_sql().replace("n ANTI JOIN", "UNION SELECT 'C', u.s, u.d FROM (SELECT i.a0 AS s, o.p0 AS d, i.callee, o.obj FROM ind i CROSS JOIN fo o UNION SELECT i.a1, o.p1, i.callee, o.obj FROM ind i CROSS JOIN fo o UNION SELECT o.ret_node, i.ret, i.callee, o.obj FROM ind i CROSS JOIN fo o) u JOIN recurring.f p ON p.k = 'P' AND p.a = u.callee AND p.b = u.obj WHERE u.s <> u.d) n ANTI JOIN", 1).replace("\n      ) UNION SELECT 'C', u.s", "\n      UNION SELECT 'C', u.s")
    + " SELECT a AS node, b AS obj FROM f WHERE k = 'P'",
    cons=CONS, ind=INDIRECT, fo=FN_OBJECTS,
)
def points_to_indirect(rel):
    indirect = settle(rel(INDIRECT).select("callee", F.array("a0", "a1").alias("args"), "ret"))
    functions = settle(rel(FN_OBJECTS).select("obj", F.array("p0", "p1").alias("params"), "ret_node"))
    return pointsto.solve(rel(CONS), indirect=indirect, functions=functions)[0]


@query("SELECT DISTINCT value_key, obj FROM v JOIN f ON f.node = v.id", v=VALUES, f=FACTS)
def value_points_to(rel):
    return pointsto.of_values(rel(VALUES), rel(FACTS))


@query("SELECT CAST(least(n, 10) AS BIGINT) AS size, count(*) AS n FROM (SELECT node, count(*) AS n FROM f GROUP BY node) s GROUP BY 1", f=FACTS)
def set_size_histogram(rel):
    return pointsto.size_histogram(rel(FACTS), "node").select(F.col("size").cast("long"), "n")


@query("SELECT CAST(count(*) AS BIGINT) AS tracked, CAST(sum(n) AS BIGINT) AS total, max(n) AS largest, count(*) FILTER (n = (SELECT max(c) FROM (SELECT count(*) AS c FROM f GROUP BY node) y)) AS n_largest FROM (SELECT node, count(*) AS n FROM f GROUP BY node) s", f=FACTS)
def set_size_summary(rel):
    return pointsto.size_summary(rel(FACTS), "node")


# Graphs.
@query(f"WITH RECURSIVE {CLOSURE_SQL} SELECT DISTINCT src, dest FROM tc", edges=EDGES)
def transitive_closure(rel):
    return fixpoint.closure(settle(rel(EDGES)))


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dest")).distinct()


@query(f"WITH RECURSIVE {CLOSURE_SQL}, nodes AS (SELECT src AS node FROM edges UNION SELECT dest FROM edges) SELECT n.node, COALESCE(least(n.node, min(a.dest)), n.node) AS rep FROM nodes n LEFT JOIN tc a ON a.src = n.node AND EXISTS (SELECT 1 FROM tc b WHERE b.src = a.dest AND b.dest = n.node) GROUP BY n.node", edges=SPARSE)
def strong_components(rel):
    edges = settle(rel(SPARSE))
    return fixpoint.strong_components(_nodes(edges), edges)


@query("WITH RECURSIVE lv(node, level) AS (SELECT node, 0 FROM (SELECT src AS node FROM edges UNION SELECT dest FROM edges) n WHERE node NOT IN (SELECT dest FROM edges) UNION SELECT e.dest, lv.level + 1 FROM lv JOIN edges e ON e.src = lv.node) SELECT node, CAST(max(level) AS INT) AS level FROM lv GROUP BY node", edges=DAG)
def topological_levels(rel):
    edges = settle(rel(DAG))
    return fixpoint.levels(_nodes(edges), edges)


LEVELS_SQL = "WITH RECURSIVE s(node) AS (SELECT CAST({start} AS INT) UNION SELECT e.{b} FROM s JOIN edges e ON e.{a} = s.node), lv(node, level) AS (SELECT CAST({start} AS INT), 0 UNION SELECT e.{b}, lv.level + 1 FROM lv JOIN edges e ON e.{a} = lv.node) SELECT node, CAST(max(level) AS INT) AS level FROM lv GROUP BY node"


@query(LEVELS_SQL.format(start=1, a="src", b="dest"), edges=DAG)
def levels_from_node(rel):
    return fixpoint.levels_from(rel("SELECT 1 AS node"), settle(rel(DAG)))


@query(LEVELS_SQL.format(start=25, a="dest", b="src"), edges=DAG)
def levels_back_from_node(rel):
    return fixpoint.levels_from(rel("SELECT 25 AS node"), settle(rel(DAG)), back=True)


@query("SELECT DISTINCT caller AS src, fn AS dest FROM c JOIN t ON t.call_id = c.call_id", c="SELECT CAST(o_orderkey AS INT) AS call_id, CAST(o_custkey % 40 AS INT) AS caller FROM {orders}", t=SITE_TARGETS)
def call_graph(rel):
    return graphs.call_edges(rel("SELECT CAST(o_orderkey AS INT) AS call_id, CAST(o_custkey % 40 AS INT) AS caller FROM {orders}"), rel(SITE_TARGETS))


@query("SELECT DISTINCT a.cs AS src, b.cs AS dest FROM s a JOIN s b ON b.fn = a.callee", s=SITES)
def call_site_graph(rel):
    return graphs.call_site_edges(rel(SITES))


@query("SELECT DISTINCT a.cs AS src, b.cs AS dest FROM s a JOIN s b ON b.fn = a.callee UNION SELECT -1, cs FROM s WHERE fn = 3", s=SITES)
def call_site_graph_from_main(rel):
    sites = settle(rel(SITES))
    return graphs.with_virtual_main(graphs.call_site_edges(sites), sites, 3, -1)


SMALL = "SELECT DISTINCT CAST(n_nationkey % 13 AS INT) AS src, CAST((n_nationkey * 5 + n_regionkey) % 13 AS INT) AS dest FROM {nation}"


@query("WITH RECURSIVE p(path, last) AS (SELECT [0], 0 UNION ALL SELECT list_append(path, e.dest), e.dest FROM p JOIN edges e ON e.src = p.last WHERE NOT list_contains(path, e.dest)) SELECT array_to_string(path, ' ') AS path FROM p", edges=SMALL)
def acyclic_paths(rel):
    return fixpoint.acyclic_paths(0, settle(rel(SMALL)), 20).select(logs.joined("path").alias("path"))


CD_SITES = "SELECT CAST(c_custkey AS INT) AS cs, CAST(c_custkey AS INT) AS callee, CAST(CASE WHEN c_nationkey = 0 THEN c_custkey % 50 ELSE -1 END AS INT) AS direct_fn FROM {customer}"
CD_PROFILED = "SELECT DISTINCT CAST(o_custkey AS INT) AS cs, CAST(o_orderkey % 50 AS INT) AS fn FROM {orders} WHERE o_custkey % 4 = 1"
CD_OBJECTS = "SELECT CAST(p_partkey + 4 AS INT) AS obj, CAST(p_partkey % 50 AS INT) AS fn FROM {part}"
CD_USED = "SELECT DISTINCT CAST(s_suppkey % 50 AS INT) AS fn FROM {supplier} WHERE s_suppkey % 50 < 35"


@query("SELECT cs, direct_fn AS fn FROM s WHERE direct_fn >= 0 UNION SELECT s.cs, p.fn FROM s JOIN p ON p.cs = s.cs WHERE direct_fn < 0 UNION SELECT s.cs, o.fn FROM s JOIN f ON f.node = s.callee JOIN o ON o.obj = f.obj JOIN u ON u.fn = o.fn WHERE direct_fn < 0 AND s.cs NOT IN (SELECT cs FROM p)", s=CD_SITES, p=CD_PROFILED, f=FACTS, o=CD_OBJECTS, u=CD_USED)
def call_destinations(rel):
    return graphs.call_destinations(rel(CD_SITES), rel(CD_PROFILED), rel(FACTS), rel(CD_OBJECTS), rel(CD_USED))


@query("SELECT fn, count(*) FILTER (op = 'ret') AS n_returns, count(DISTINCT bb) AS n_blocks FROM i GROUP BY fn", i=INSTS)
def function_returns(rel):
    return rel(INSTS).groupBy("fn").agg(F.count_if(F.col("op") == "ret").alias("n_returns"), F.countDistinct("bb").alias("n_blocks"))


@query("SELECT callee AS fn, count(DISTINCT cs) AS n_callers FROM s GROUP BY callee", s=SITES)
def function_callers(rel):
    return rel(SITES).groupBy(F.col("callee").alias("fn")).agg(F.countDistinct("cs").alias("n_callers"))


DOM = "SELECT DISTINCT CAST(l_partkey % 40 AS INT) AS src, CAST(l_partkey % 40 + 1 + l_suppkey * 7 % (3 + l_partkey % 40 % 3) AS INT) AS dest FROM {lineitem}"


@query("WITH RECURSIVE seen(node) AS (SELECT CAST(0 AS INT) UNION SELECT e.dest FROM seen s JOIN edges e ON e.src = s.node), av(d, n) AS (SELECT node, CAST(0 AS INT) FROM seen WHERE node <> 0 UNION SELECT a.d, e.dest FROM av a JOIN edges e ON e.src = a.n WHERE e.dest <> a.d), dom AS (SELECT a.node AS d, b.node AS n FROM seen a JOIN seen b ON a.node <> b.node ANTI JOIN av ON av.d = a.node AND av.n = b.node), depth AS (SELECT n AS d, count(*) AS c FROM dom GROUP BY n) SELECT n AS node, arg_max(dom.d, COALESCE(c, 0)) AS idom FROM dom LEFT JOIN depth ON depth.d = dom.d GROUP BY n", edges=DOM)
def immediate_dominators(rel):
    return fixpoint.dominators(0, settle(rel(DOM)))


@query("SELECT DISTINCT CASE WHEN src % 10 = 1 THEN src + 1 ELSE src END AS src, CASE WHEN dest % 10 = 1 THEN dest + 1 ELSE dest END AS dest FROM (SELECT src, dest FROM edges UNION SELECT a.src, a.dest FROM a) u WHERE src <> dest AND src % 10 <> 7 AND dest % 10 <> 7", edges=EDGES, a=SPARSE)
def edited_graph(rel):
    edges, added = rel(EDGES), rel(SPARSE)
    loops = edges.union(added).where("src = dest").distinct()
    nodes = settle(_nodes(edges.union(added)))
    return graphs.edit(edges, added, loops, nodes.where("node % 10 = 7"), nodes.where("node % 10 = 1").select("node", (F.col("node") + 1).alias("rep")))


MARKED = "SELECT DISTINCT CAST(s_suppkey * 3 AS INT) AS node FROM {supplier} WHERE s_suppkey % 9 = 0"


@query("SELECT src, dest FROM edges WHERE src NOT IN (SELECT node FROM m) AND dest NOT IN (SELECT node FROM m)", edges=SPARSE, m=MARKED)
def graph_without_marked(rel):
    return graphs.without_marked(rel(SPARSE), rel(MARKED))


@query("WITH RECURSIVE r(node) AS (SELECT node FROM m WHERE node IN (SELECT src FROM edges UNION SELECT dest FROM edges) UNION SELECT e.src FROM r JOIN edges e ON e.dest = r.node) SELECT node FROM r", edges=SPARSE, m=MARKED)
def needed_nodes(rel):
    edges = settle(rel(SPARSE))
    return graphs.needed_nodes(_nodes(edges), edges, rel(MARKED))


@query(f"WITH RECURSIVE {CLOSURE_SQL}, nodes AS (SELECT src AS node FROM all_edges UNION SELECT dest FROM all_edges) SELECT n.node, COALESCE(least(n.node, min(a.dest)), n.node) AS rep FROM nodes n LEFT JOIN tc a ON a.src = n.node AND EXISTS (SELECT 1 FROM tc b WHERE b.src = a.dest AND b.dest = n.node) GROUP BY n.node", all_edges=SPARSE, m=MARKED, edges="SELECT src, dest FROM all_edges WHERE src NOT IN (SELECT node FROM m) AND dest NOT IN (SELECT node FROM m)")
def merged_unmarked_components(rel):
    edges = settle(rel(SPARSE))
    return graphs.merge_unmarked_components(_nodes(edges), edges, settle(rel(MARKED)))


@query()
def folded_predecessors(rel):
    edges = settle(rel(SPARSE))
    return graphs.fold_single(_nodes(edges).select("node", F.col("node").alias("rep")), edges, settle(rel(MARKED)))


@query()
def folded_successors(rel):
    edges = settle(rel(SPARSE))
    return graphs.fold_single(_nodes(edges).select("node", F.col("node").alias("rep")), edges, settle(rel(MARKED)), into="dest")


@query("WITH RECURSIVE r(node) AS (SELECT src FROM edges WHERE dest = 5 UNION SELECT e.src FROM r JOIN edges e ON e.dest = r.node WHERE r.node NOT IN (SELECT node FROM m)) SELECT node FROM r", edges=SPARSE, m=MARKED)
def predecessor_instructions(rel):
    return graphs.predecessors(rel("SELECT 5 AS node"), settle(rel(SPARSE)), settle(rel(MARKED)))


CALLEES = "SELECT CAST(o_orderkey AS INT) AS call_id, CASE o_orderkey % 5 WHEN 0 THEN 'asm' WHEN 1 THEN 'intrinsic' WHEN 2 THEN 'bitcast' ELSE 'plain' END AS kind, CAST(o_custkey AS INT) AS callee, CAST(o_custkey % 7 AS INT) AS operand FROM {orders}"


@query("SELECT call_id, CASE WHEN kind = 'bitcast' THEN operand ELSE callee END AS callee FROM c WHERE kind IN ('bitcast', 'plain')", c=CALLEES)
def valid_call_sites(rel):
    return graphs.valid_calls(rel(CALLEES))


@query()
def value_numbering(rel):
    rows = settle(rel(CONS))
    copies = rows.where("ctype = 0").select("src", "dest")
    fresh = rows.where("ctype <> 0").select(F.col("dest").alias("node")).union(rows.where("ctype = 3").select("src")).distinct()
    return graphs.value_numbers(_nodes(rows), copies, fresh)


@query(_points_sql() + " SELECT a AS node, b AS obj FROM f WHERE k = 'P'", cons=CONS)
def reduced_points_to(rel):
    rows, reps = graphs.reduce_constraints(rel(CONS))
    return pointsto.solve(rows, reps=reps)[0]


@query()
def reduced_constraints(rel):
    return graphs.reduce_constraints(rel(CONS))[0]


# Clients.
ASKED = "SELECT DISTINCT CAST(o_custkey AS INT) AS p, CAST(o_orderkey AS INT) AS q FROM {orders}"
INT_POINTERS = "SELECT DISTINCT CAST(c_custkey AS INT) AS node FROM {customer} WHERE c_nationkey = 3"
MAY_SQL = "SELECT DISTINCT a.p, a.q FROM asked a JOIN f x ON x.node = a.p JOIN f y ON y.node = a.q AND y.obj = x.obj WHERE a.p NOT IN (SELECT node FROM ints) AND a.q NOT IN (SELECT node FROM ints)"


@query(f"SELECT a.p, a.q, CASE WHEN m.p IS NULL THEN 'no' ELSE 'may' END AS answer FROM asked a LEFT JOIN ({MAY_SQL}) m ON m.p = a.p AND m.q = a.q", asked=ASKED, f=FACTS, ints=INT_POINTERS)
def alias_answers(rel):
    return clients.alias_answers(rel(ASKED), rel(FACTS), rel(INT_POINTERS))


@query(f"SELECT a.p, a.q, CASE WHEN a.p % 2 = 0 AND m.p IS NULL THEN 'no' ELSE 'may' END AS answer FROM asked a LEFT JOIN ({MAY_SQL}) m ON m.p = a.p AND m.q = a.q", asked=ASKED, f=FACTS, ints=INT_POINTERS)
def alias_facade(rel):
    precise = clients.alias_answers(rel(ASKED), rel(FACTS), rel(INT_POINTERS)).withColumn("answer", F.when(F.col("p") % 2 == 0, F.col("answer")))
    return clients.first_answer(precise, rel(ASKED).select("p", "q", F.lit(None).cast("string").alias("answer")))


@query("SELECT DISTINCT a.node AS p, b.node AS q FROM f a JOIN f b ON a.obj = b.obj AND a.node < b.node", f=FACTS)
def may_alias_pairs(rel):
    return clients.may_alias_pairs(rel(FACTS))


@query("SELECT checked, may, checked - may AS no FROM (SELECT CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS checked FROM n) c, (SELECT count(*) AS may FROM (SELECT DISTINCT a.node, b.node FROM f a JOIN f b ON a.obj = b.obj AND a.node < b.node) x(p, q)) m", n="SELECT CAST(o_orderkey AS INT) AS node FROM {orders}", f=FACTS)
def alias_census(rel):
    return clients.alias_census(settle(rel("SELECT CAST(o_orderkey AS INT) AS node FROM {orders}")), rel(FACTS))


LOADS = "SELECT inst, bb, a AS ptr FROM (" + INSTS + ") i WHERE op = 'load'"
STORES = "SELECT inst, bb, dst AS ptr FROM (" + INSTS + ") i WHERE op = 'store'"


@query("SELECT checked, may, checked - may AS no FROM (SELECT (SELECT count(*) FROM l) * (SELECT count(*) FROM s) AS checked) c, (SELECT CAST(COALESCE(sum(nl * ns), 0) AS BIGINT) AS may FROM (SELECT DISTINCT x.node AS lp, y.node AS sp FROM f x JOIN f y ON x.obj = y.obj) pq JOIN (SELECT ptr, count(*) AS nl FROM l GROUP BY ptr) a ON a.ptr = lp JOIN (SELECT ptr, count(*) AS ns FROM s GROUP BY ptr) b ON b.ptr = sp) m", l=LOADS, s=STORES, f=FACTS)
def load_store_census(rel):
    return clients.load_store_census(rel(LOADS), rel(STORES), rel(FACTS))


STATIC = "SELECT DISTINCT CAST(l_partkey AS INT) AS load, CAST(CASE WHEN l_linenumber = 5 THEN l_suppkey + 4 ELSE l_suppkey + 3 END AS INT) AS store FROM {lineitem}"
SEEN_CLEAN = "SELECT DISTINCT load, CASE WHEN store = 2 THEN -1 ELSE store END AS store FROM (" + ALIAS_SEEN + ") s WHERE store <> 0"
ASKED_LS = "SELECT DISTINCT CAST(l_partkey AS INT) AS load, CAST(l_linenumber * 5 + 3 AS INT) AS store FROM {lineitem}"


@query("SELECT a.load, a.store, CASE WHEN o.lo IS NULL THEN false WHEN o.lo = -1 THEN EXISTS (SELECT 1 FROM st WHERE st.load = a.load AND st.store = a.store) ELSE EXISTS (SELECT 1 FROM seen s WHERE s.load = a.load AND s.store = a.store) END AS answer FROM asked a LEFT JOIN (SELECT load, min(store) AS lo FROM seen GROUP BY load) o ON o.load = a.load", asked=ASKED_LS, seen=SEEN_CLEAN, st=STATIC)
def dynamic_alias(rel):
    return clients.dynamic_alias(rel(ASKED_LS), rel(SEEN_CLEAN), rel(STATIC))


USED_LOADS = "SELECT DISTINCT CAST(p_partkey AS INT) AS load FROM {part} WHERE p_size < 40"
USED_STORES = "SELECT DISTINCT CAST(s_suppkey AS INT) AS store FROM {supplier}"


@query("SELECT count(DISTINCT load) FILTER (load NOT IN (SELECT load FROM bad)) AS good_loads, count(DISTINCT store) FILTER (store NOT IN (SELECT store FROM bad)) AS good_stores, (SELECT count(*) FROM bad) AS bad_pairs FROM real", seen=SEEN_CLEAN, st=STATIC, ul=USED_LOADS, us=USED_STORES, real="SELECT load, store FROM seen WHERE store <> -1 AND load IN (SELECT load FROM ul) AND store IN (SELECT store FROM us)", bad="SELECT load, store FROM real ANTI JOIN st USING (load, store)")
def soundness(rel):
    return clients.soundness(rel(SEEN_CLEAN), rel(STATIC), rel(USED_LOADS), rel(USED_STORES))


@query(f"SELECT DISTINCT stack FROM (SELECT '0 ' || string_agg(CAST(l_suppkey AS VARCHAR), ' ' ORDER BY l_linenumber, l_suppkey) AS stack FROM lineitem WHERE l_linenumber <= 2 GROUP BY l_orderkey) q WHERE EXISTS (SELECT 1 FROM ({STACKS_SQL}) s WHERE s.stack = q.stack OR starts_with(s.stack, q.stack || ' '))")
def valid_prefixes(rel):
    asked = logs.read_stacks(rel(STACK_LINES.replace("FROM {lineitem}", "FROM {lineitem} WHERE l_linenumber <= 2")), strict=False)
    plain = asked.union(logs.read_stacks(rel(STACK_LINES.replace("FROM {lineitem}", "FROM {lineitem} WHERE l_linenumber <= 2")).limit(0)))
    return plain.distinct().join(logs.prefixes(_stacks(rel)), "stack", "left_semi").select(logs.joined("stack").alias("stack"))


@query(f"SELECT stack FROM ({STACKS_SQL}) s WHERE list_contains(string_split(stack, ' '), '7')")
def stacks_with_site(rel):
    return _stacks(rel).distinct().where(F.array_contains("stack", 7)).select(logs.joined("stack").alias("stack"))


@query("SELECT DISTINCT b.fn, b.bb FROM i b JOIN (SELECT bb, sum(cnt) AS cnt FROM c GROUP BY bb) u ON u.bb = b.bb WHERE u.cnt >= 1", i=INSTS, c=COUNTS)
def used_blocks(rel):
    blocks = rel(INSTS).select("fn", "bb").distinct()
    counts = rel(COUNTS).groupBy("bb").agg(F.sum("cnt").alias("cnt"))
    return blocks.join(clients.used_blocks(blocks.select("bb").distinct(), counts), "bb").select("fn", "bb")


FNS = "SELECT CAST(s_suppkey AS INT) AS fn, (s_suppkey = 1) AS is_main, (s_nationkey = 4) AS is_declaration FROM {supplier}"
ENTRIES = "SELECT CAST(s_suppkey AS INT) AS fn, CAST(s_suppkey % 37 AS INT) AS bb FROM {supplier}"
SOME_COUNTS = "SELECT CAST(l_suppkey % 37 AS INT) AS bb, CAST(sum(CASE WHEN l_suppkey % 37 % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS cnt FROM {lineitem} GROUP BY 1"


@query("SELECT fn FROM f WHERE is_main OR is_declaration OR fn IN (SELECT e.fn FROM e JOIN c ON c.bb = e.bb WHERE cnt >= 1)", f=FNS, e=ENTRIES, c=SOME_COUNTS)
def used_functions(rel):
    return clients.used_functions(rel(FNS), rel(ENTRIES), rel(SOME_COUNTS))


@query(f"SELECT (SELECT count(DISTINCT bb) FROM c WHERE cnt >= 1) AS used_blocks, (SELECT count(*) FROM (SELECT DISTINCT call, fn FROM t) d) AS targets, (SELECT count(*) FROM ({STACKS_SQL}) s) AS stacks", c=COUNTS, t=CALLS_SEEN)
def invariant_counts(rel):
    return clients.invariants(rel(COUNTS), rel(CALLS_SEEN), _stacks(rel))


@query("SELECT p, q, CASE WHEN EXISTS (SELECT 1 FROM f x JOIN f y ON x.obj = y.obj WHERE x.node = p AND y.node = q) THEN 'may' ELSE 'no' END AS answer FROM (SELECT arg_min(dst, inst) AS p, arg_max(dst, inst) AS q FROM (SELECT dst, inst FROM i WHERE fn = 7 AND is_ptr ORDER BY inst LIMIT 2) t) z", i=INSTS, f=FACTS)
def two_pointer_smoke(rel):
    return clients.smoke(rel(INSTS), rel(FACTS), 7)


# Contexts and slices.
PRED_EDGES = "SELECT DISTINCT CAST(l_suppkey * 20 + l_partkey % 20 AS INT) AS src, CAST(l_suppkey * 20 + l_orderkey % 20 AS INT) AS dest FROM {lineitem}"
CALLER_BB = "SELECT DISTINCT CAST(l_suppkey * 20 + l_partkey % 20 AS INT) AS bb, CAST(FLOOR(l_suppkey / 2) * 20 + 3 AS INT) AS caller_bb FROM {lineitem}"


@query(
    f"""WITH RECURSIVE {CLOSURE_SQL}, up(bb, high) AS (SELECT bb, caller_bb FROM c WHERE bb <> caller_bb UNION SELECT up.bb, c.caller_bb FROM up JOIN c ON c.bb = up.high AND c.bb <> c.caller_bb),
    n AS (SELECT src AS bb, CAST(floor(src / 20) AS INT) AS fn FROM edges UNION SELECT dest, CAST(floor(dest / 20) AS INT) FROM edges),
    l AS (SELECT dest AS bb, src AS pred FROM tc UNION SELECT bb, bb FROM n UNION SELECT a.bb, b.bb FROM n a JOIN n b ON b.fn = a.fn WHERE a.fn % 17 = 0)
    SELECT bb, pred FROM l UNION SELECT up.bb, l.pred FROM up JOIN l ON l.bb = up.high""",
    edges=PRED_EDGES, c=CALLER_BB,
)
def predecessor_blocks(rel):
    edges = settle(rel(PRED_EDGES))
    blocks = _nodes(edges).select(F.col("node").alias("bb"), F.floor(F.col("node") / 20).cast("int").alias("fn"))
    recursive = blocks.where("fn % 17 = 0").select("fn").distinct()
    local = settle(slices.local_predecessors(blocks, edges, recursive, blocks.limit(0).select("bb", F.col("bb").alias("pred"))))
    return slices.all_predecessors(local, settle(rel(CALLER_BB).where("bb <> caller_bb")))


@query("SELECT DISTINCT stack || ' ' || CAST(cs AS VARCHAR) AS stack, v AS value FROM (SELECT CAST(cs AS VARCHAR) AS stack, cs AS top, callee AS fn FROM s) a JOIN (SELECT cs, fn, callee FROM s) b ON b.fn = a.fn AND b.cs <> a.top JOIN (SELECT fn, cs * 2 AS v FROM s) r ON r.fn = b.callee", s=SITES)
def pushed_contexts(rel):
    sites = settle(rel(SITES))
    stacks = sites.select(F.array("cs").alias("stack"), F.col("callee").alias("fn"))
    out = slices.push(stacks, sites, sites.select("fn", (F.col("cs") * 2).alias("value")))
    return out.select(logs.joined("stack").alias("stack"), "value")


@query("SELECT DISTINCT CAST(a.cs AS VARCHAR) AS stack, c.cs FROM s a JOIN (SELECT cs, cs % 200 AS rep FROM s) t ON t.cs = (a.cs * 3 + 1) % 1000 JOIN (SELECT cs, cs % 200 AS rep FROM s) c ON c.rep = t.rep", s=SITES)
def popped_contexts(rel):
    sites = settle(rel(SITES))
    stacks = sites.select(F.array("cs", (F.col("cs") * 3 + 1) % 1000).alias("stack"), "fn")
    return slices.pop(stacks, sites.select("cs", (F.col("cs") % 200).alias("rep")), sites.select("fn", "cs")).select(logs.joined("stack").alias("stack"), "cs")


@query("SELECT DISTINCT i.inst, p.path AS stack FROM i JOIN (SELECT array_to_string(path, ' ') AS path, last FROM p) p ON p.last = i.fn", i=INSTS, p="SELECT [0] AS path, 0 AS last UNION ALL SELECT [0, e.dest], e.dest FROM (" + SMALL + ") e WHERE e.src = 0 AND e.dest <> 0")
def instruction_contexts(rel):
    one = settle(rel(SMALL))
    paths = one.where("src = 0 and dest <> 0").select(F.array(F.lit(0), "dest").alias("path"), F.col("dest").alias("fn")).union(one.limit(1).select(F.array(F.lit(0)).alias("path"), F.lit(0).alias("fn")))
    return slices.contexts_of(rel(INSTS).select("inst", "fn"), paths).select("inst", logs.joined("stack").alias("stack"))


@query(f"SELECT stack, CAST(row_number() OVER (ORDER BY list_transform(string_split(stack, ' '), lambda x: CAST(x AS INT))) AS INT) AS stack_id FROM ({STACKS_SQL}) s")
def interned_stacks(rel):
    return slices.intern(_stacks(rel)).select(logs.joined("stack").alias("stack"), "stack_id")


DEPS = "SELECT DISTINCT CAST(l_orderkey * 8 + l_linenumber AS INT) AS inst, CAST(CASE WHEN l_linenumber = 1 THEN FLOOR(l_orderkey / 2) * 8 + 1 + l_partkey % 7 ELSE l_orderkey * 8 + 1 + l_partkey % (l_linenumber - 1) END AS INT) AS src FROM {lineitem}"
SLICE_SEEDS = "SELECT CAST(n_nationkey AS BIGINT) AS slice_id, CAST((1490 - n_nationkey * 47) * 8 + 1 + n_nationkey % 7 AS INT) AS inst FROM {nation}"
SLICE_SQL = "WITH RECURSIVE r(slice_id, inst) AS (SELECT slice_id, inst FROM seeds UNION SELECT r.slice_id, d.src FROM r JOIN deps d ON d.inst = r.inst)"
SLICE_INSTS = "SELECT CAST(inst AS INT) AS inst, min(fn) AS fn, min(bb) AS bb, min(op) AS op FROM (" + INSTS + ") i GROUP BY 1"
BB_COUNTS = "SELECT CAST(user_id AS INT) AS bb, count(*) AS cnt FROM {events} GROUP BY 1"


def _slices(rel):
    return settle(slices.slices(rel(SLICE_SEEDS), settle(rel(DEPS))), "slices")


@query(SLICE_SQL + " SELECT slice_id, inst FROM r", seeds=SLICE_SEEDS, deps=DEPS)
def backward_slices(rel):
    return _slices(rel)


@query(SLICE_SQL + " SELECT slice_id, string_agg(CAST(inst AS VARCHAR), ' ' ORDER BY inst) AS insts FROM r GROUP BY slice_id", seeds=SLICE_SEEDS, deps=DEPS)
def slice_log(rel):
    back = logs.read_pairs(logs.write_pairs(_slices(rel), "slice_id", "inst"), "slice_id", "inst")
    return back.groupBy(F.col("slice_id").cast("long").alias("slice_id")).agg(logs.joined(F.array_sort(F.collect_list("inst"))).alias("insts"))


@query(SLICE_SQL + ", m AS (SELECT slice_id, i.bb, i.op, COALESCE(c.cnt, 0) AS c FROM r JOIN i ON i.inst = r.inst LEFT JOIN c ON c.bb = i.bb) SELECT b.slice_id, CAST(b.x + COALESCE(h.y, 0) AS BIGINT) AS cost FROM (SELECT slice_id, sum(2 * c) AS x FROM (SELECT DISTINCT slice_id, bb, c FROM m) d GROUP BY slice_id) b LEFT JOIN (SELECT slice_id, sum(c) AS y FROM m WHERE op IN ('load', 'store', 'select', 'call') GROUP BY slice_id) h ON h.slice_id = b.slice_id", seeds=SLICE_SEEDS, deps=DEPS, i=SLICE_INSTS, c=BB_COUNTS)
def slice_costs(rel):
    return slices.slice_cost(_slices(rel), settle(rel(SLICE_INSTS)), rel(BB_COUNTS))


@query(SLICE_SQL + " SELECT slice_id, i.fn, i.bb, string_agg(CAST(r.inst AS VARCHAR), ' ' ORDER BY r.inst) AS insts FROM r JOIN i ON i.inst = r.inst GROUP BY slice_id, i.fn, i.bb", seeds=SLICE_SEEDS, deps=DEPS, i=SLICE_INSTS)
def slice_report(rel):
    return slices.slice_report(_slices(rel), rel(SLICE_INSTS))


@query("SELECT fn, count(*) AS total, count(u.bb) AS used FROM i LEFT JOIN (SELECT DISTINCT bb FROM c) u ON u.bb = i.bb GROUP BY fn", i=INSTS, c=BB_COUNTS)
def instruction_census(rel):
    return slices.instruction_census(rel(INSTS), rel(BB_COUNTS))


DEP_INSTS = "SELECT CAST(inst AS INT) AS inst, op, a, b, k AS c FROM (" + INSTS + ") i"
NO_EDGES = "SELECT CAST(0 AS INT) AS inst, CAST(0 AS INT) AS src FROM {region} WHERE r_regionkey < 0"
CONTROL = "SELECT CAST(inst AS INT) AS inst, CAST(bb AS INT) AS src FROM (" + INSTS + ") i"


@query("SELECT DISTINCT inst, src, kind FROM (SELECT inst, a AS src, 'operand' AS kind FROM i WHERE op IN ('ret', 'gep', 'extract', 'load', 'bitcast') UNION ALL SELECT inst, a, 'operand' FROM i WHERE op IN ('store', 'insert', 'phi') UNION ALL SELECT inst, b, 'operand' FROM i WHERE op IN ('store', 'insert', 'phi') UNION ALL SELECT inst, b, 'operand' FROM i WHERE op = 'select' UNION ALL SELECT inst, c, 'operand' FROM i WHERE op = 'select' UNION ALL SELECT inst, src, 'memory' FROM ls UNION ALL SELECT inst, src, 'control' FROM ctl) u WHERE src >= 0", i=DEP_INSTS, ls=DEPS, ctl=CONTROL)
def dependence_edges(rel):
    none = rel(NO_EDGES)
    return slices.dependence(rel(DEP_INSTS), rel(CONTROL), rel(DEPS), none, none)


PREDS = "SELECT DISTINCT bb, CAST(bb - 1 AS INT) AS pred FROM (" + INSTS + ") i UNION SELECT DISTINCT bb, bb FROM (" + INSTS + ") j"


@query("SELECT DISTINCT l.inst, s.inst AS src FROM l JOIN f x ON x.node = l.ptr JOIN p ON p.bb = l.bb JOIN s ON s.bb = p.pred JOIN f y ON y.node = s.ptr AND y.obj = x.obj", l=LOADS, s=STORES, f=FACTS, p=PREDS)
def load_store_dependences(rel):
    return slices.load_store_edges(rel(LOADS), rel(STORES), rel(FACTS), rel(PREDS))


@query("SELECT fn, arg_min(inst, md5('7 ' || fn || ' ' || inst)) AS inst FROM i GROUP BY fn ORDER BY md5('8 ' || fn) LIMIT 10", i=INSTS)
def picked_seeds(rel):
    return slices.pick_seeds(rel(INSTS), 10, 7)


@query("SELECT DISTINCT fn, inst FROM i WHERE fn = 3", i=INSTS)
def seeds_of_main(rel):
    return slices.seeds_of_function(rel(INSTS), 3)


@query("SELECT checked, may, checked - may AS no FROM (SELECT (SELECT count(*) FROM (SELECT DISTINCT load FROM a) x) * (SELECT count(*) FROM (SELECT DISTINCT store FROM a) y) AS checked) c, (SELECT count(*) AS may FROM (SELECT DISTINCT s.load, s.store FROM s JOIN (SELECT DISTINCT load FROM a) x ON x.load = s.load JOIN (SELECT DISTINCT store FROM a) y ON y.store = s.store) z) m", a=ASKED_LS, s=SEEN_CLEAN)
def dynamic_load_store_census(rel):
    return clients.dynamic_census(rel(ASKED_LS), rel(SEEN_CLEAN))


# Assumptions.
SETS = "SELECT DISTINCT CAST(o_custkey AS INT) AS ptr, CAST(o_orderkey % 4 AS INT) AS obj FROM {orders}"
DEFS = "SELECT CAST(c_custkey AS INT) AS ptr, CAST(c_custkey % 300 AS INT) AS site FROM {customer}"
ALLOC_SITES = "SELECT CAST(n_nationkey % 6 AS INT) AS obj, CAST(n_nationkey + 400 AS INT) AS site FROM {nation}"
FREE_SITES = "SELECT CAST(n_nationkey % 9 AS INT) AS obj, CAST(n_nationkey * 2 AS INT) AS site FROM {nation}"
CHECKS_SQL = "SELECT 'set' AS kind, d.site FROM d WHERE d.ptr IN (SELECT ptr FROM t) UNION SELECT 'alloc', site FROM a WHERE obj IN (SELECT obj FROM t) UNION SELECT 'free', site FROM fr WHERE obj IN (SELECT obj FROM t)"


@query("SELECT ptr, min(ptr) OVER (PARTITION BY k) AS set_id, n FROM (SELECT ptr, string_agg(CAST(obj AS VARCHAR), ' ' ORDER BY obj) AS k, count(*) AS n FROM t GROUP BY ptr) s", t=SETS)
def interned_target_sets(rel):
    return assumptions.target_sets(rel(SETS))


@query(CHECKS_SQL, t=SETS, d=DEFS, a=ALLOC_SITES, fr=FREE_SITES)
def assumption_checks(rel):
    return assumptions.checks(rel(SETS), rel(DEFS), rel(ALLOC_SITES), rel(FREE_SITES))


@query(f"SELECT kind, CAST(sum(COALESCE(cnt, 0)) AS BIGINT) AS cost FROM ({CHECKS_SQL}) k LEFT JOIN c ON c.bb = k.site GROUP BY kind", t=SETS, d=DEFS, a=ALLOC_SITES, fr=FREE_SITES, c=BB_COUNTS)
def assumption_cost(rel):
    return assumptions.check_cost(assumptions.checks(rel(SETS), rel(DEFS), rel(ALLOC_SITES), rel(FREE_SITES)), rel(BB_COUNTS))


@query("SELECT ptr FROM (SELECT o_custkey AS ptr, sum(o_totalprice) AS saving, count(*) * 1000.0 AS cost FROM orders GROUP BY 1) s WHERE saving > 150 * cost")
def worthwhile_assumptions(rel):
    each = rel("SELECT o_custkey AS ptr, sum(o_totalprice) AS saving, count(*) * 1000.0 AS cost FROM {orders} GROUP BY 1")
    return assumptions.worth_it(each.select("ptr", "saving"), each.select("ptr", "cost"), 150)


@query("WITH RECURSIVE r(node) AS (SELECT node FROM boundary UNION SELECT node FROM boundary) SELECT DISTINCT 'visit' AS kind, node AS site FROM r", boundary=MARKED)
def dead_code_traps(rel):
    return assumptions.dead_code(rel(MARKED)).distinct()


@query("SELECT DISTINCT f.obj, i.inst AS site FROM i JOIN f ON f.node = i.a WHERE i.op = 'ret'", i=INSTS, f=FACTS)
def free_locations(rel):
    return assumptions.freed_objects(rel(INSTS).where("op = 'ret'").select(F.col("inst").alias("site"), F.col("a").alias("ptr")), rel(FACTS))


@query("WITH RECURSIVE r(node) AS (SELECT src FROM edges WHERE src % 50 = 3 UNION SELECT dest FROM edges WHERE src % 50 = 3 UNION SELECT e.src FROM r JOIN edges e ON e.dest = r.node) SELECT node FROM r", edges=SPARSE)
def invalid_stack_sites(rel):
    edges = settle(rel(SPARSE))
    return assumptions.invalid_stack_closure(edges.where("src % 50 = 3").select(F.array("src", "dest").alias("stack")), edges)


@query("SELECT dest AS last, count(*) AS n FROM edges GROUP BY dest", edges=SPARSE)
def invalid_stacks_by_last(rel):
    return assumptions.stacks_by_last(rel(SPARSE).select(F.array("src", "dest").alias("stack")))


@query("SELECT DISTINCT CAST(a.src AS VARCHAR) || ' ' || CAST(a.dest AS VARCHAR) AS stack FROM edges a JOIN s b ON b.src = a.src AND b.dest = a.dest", edges=EDGES, s="SELECT src, dest FROM (" + EDGES + ") e WHERE (src + dest) % 5 = 0")
def stack_violations(rel):
    edges = rel(EDGES).select(F.array("src", "dest").alias("stack"), "src", "dest")
    return assumptions.violations(edges.select("stack"), edges.where("(src + dest) % 5 = 0").select("stack")).select(logs.joined("stack").alias("stack"))


# Event traces.
@query("SELECT CAST(user_id % 200 AS INT) AS bb, count(*) AS cnt FROM events GROUP BY 1")
def visit_counts(rel):
    return traces.visit_counts(rel(VISITS))


@query("SELECT DISTINCT e.id AS call, f.fn FROM e JOIN (SELECT CAST(s_suppkey % 50 * 4 AS BIGINT) AS addr, CAST(s_suppkey AS INT) AS fn FROM supplier) f ON f.addr = e.addr", e=EVENTS)
def indirect_targets(rel):
    return traces.indirect_targets(rel(EVENTS).withColumn("kind", F.lit("icall")), rel("SELECT CAST(s_suppkey % 50 * 4 AS BIGINT) AS addr, CAST(s_suppkey AS INT) AS fn FROM {supplier}"))


@query("SELECT DISTINCT load, store FROM (SELECT kind, id AS load, CAST(COALESCE(last_value(CASE WHEN kind = 'store' THEN id WHEN kind = 'free' THEN -1 END IGNORE NULLS) OVER (PARTITION BY byte ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS BIGINT) AS store FROM (SELECT seq, kind, id, unnest(generate_series(addr, addr + CASE WHEN kind = 'load' THEN 1 ELSE size END - 1)) AS byte FROM e) b) w WHERE kind = 'load'", e=EVENTS)
def last_writers(rel):
    return traces.last_writers(rel(EVENTS))


RANGES_SQL = "SELECT kind, id AS obj, addr AS start, addr + size AS stop, seq AS born, COALESCE(lead(seq) OVER (PARTITION BY addr ORDER BY seq), 4611686018427387904) AS died FROM e"


@query(f"SELECT DISTINCT a.id, COALESCE(r.obj, 2) AS obj FROM a LEFT JOIN (SELECT * FROM ({RANGES_SQL}) x WHERE kind <> 'free') r ON a.addr >= r.start AND a.addr < r.stop AND a.seq >= r.born AND a.seq < r.died", e=ALLOC_EVENTS, a=ACCESSES)
def accessed_objects(rel):
    return traces.objects_of(rel(ACCESSES), traces.live_ranges(rel(ALLOC_EVENTS)))


@query(f"SELECT obj, start, stop, born, died FROM ({RANGES_SQL}) x WHERE kind <> 'free'", e=ALLOC_EVENTS)
def live_ranges(rel):
    return traces.live_ranges(rel(ALLOC_EVENTS))


CUT_RANGES = "SELECT CAST(p_partkey * 100 AS BIGINT) AS obj, CAST(p_partkey * 1000 AS BIGINT) AS start, CAST(p_partkey * 1000 + p_size AS BIGINT) AS stop FROM {part}"
CUTS = "SELECT DISTINCT CAST(l_partkey * 100 AS BIGINT) AS obj, CAST(l_quantity AS BIGINT) AS offs FROM {lineitem}"


@query("WITH RECURSIVE c AS (SELECT r.obj, k.offs FROM k JOIN r ON r.obj = k.obj WHERE k.offs > 0 AND r.start + k.offs < r.stop UNION SELECT obj, 0 FROM r) SELECT CAST(c.obj + row_number() OVER w - 1 AS BIGINT) AS obj, r.start + c.offs AS start, COALESCE(r.start + lead(c.offs) OVER w, r.stop) AS stop FROM c JOIN r ON r.obj = c.obj WINDOW w AS (PARTITION BY c.obj ORDER BY c.offs)", r=CUT_RANGES, k=CUTS)
def split_ranges(rel):
    return traces.split_ranges(rel(CUT_RANGES), rel(CUTS))


FRAMES = "SELECT CAST(user_id AS BIGINT) AS thread, event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'call' WHEN 1 THEN 'alloca' ELSE 'ret' END AS kind, event_id AS id, CAST(event_id * 16 AS BIGINT) AS addr, CAST(event_id % 16 + 1 AS BIGINT) AS size FROM {events}"


@query("SELECT a.id AS obj, a.addr AS start, a.addr + a.size AS stop, a.seq AS born, min(r.seq) AS died FROM (SELECT * FROM d WHERE kind = 'alloca') a LEFT JOIN (SELECT thread, seq, depth + 1 AS depth FROM d WHERE kind = 'ret') r ON r.thread = a.thread AND r.depth = a.depth AND r.seq > a.seq GROUP BY 1, 2, 3, 4", e=FRAMES, d="SELECT *, sum(CASE kind WHEN 'call' THEN 1 WHEN 'ret' THEN -1 ELSE 0 END) OVER (PARTITION BY thread ORDER BY seq) AS depth FROM e")
def frame_ranges(rel):
    return traces.frame_ranges(rel(FRAMES))


@query()
def recorded_stacks(rel):
    return traces.recorded_stacks(rel(STACK_EVENTS)).select(logs.joined("stack").alias("stack"))


@query()
def stack_checks(rel):
    stacks = settle(traces.recorded_stacks(rel(STACK_EVENTS)))
    invalid = stacks.where("size(stack) = 2 and stack[0] = 1").select("stack")
    return traces.stack_checks(stacks, invalid).select(logs.joined("stack").alias("stack"))


@query(f"SELECT DISTINCT a.id AS ptr, a.addr FROM a JOIN (SELECT * FROM ({RANGES_SQL}) x WHERE kind <> 'free') r ON a.addr >= r.start AND a.addr < r.stop AND a.seq >= r.born AND a.seq < r.died WHERE a.addr <> 0 AND NOT (a.id % 4 = r.obj % 4 AND a.id % 5 <> 0)", e=ALLOC_EVENTS, a=ACCESSES)
def set_violations(rel):
    live = settle(traces.live_ranges(rel(ALLOC_EVENTS)))
    asked = rel(ACCESSES).select(F.col("id").alias("ptr"), "addr", "seq")
    allowed = asked.select("ptr").distinct().where("ptr % 5 <> 0").select("ptr", (F.col("ptr") % 4).alias("set_id"))
    members = live.select((F.col("obj") % 4).alias("set_id"), "obj").distinct()
    return assumptions.set_violations(asked, live, allowed, members)
