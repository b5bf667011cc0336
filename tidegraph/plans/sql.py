"""Common table expressions for DuckDB: the static graph, the operation log and its fold."""

NODES = """nodes AS (SELECT 'region:' || r_regionkey AS node_id FROM region UNION ALL SELECT 'nation:' || n_nationkey FROM nation
UNION ALL SELECT 'customer:' || c_custkey FROM customer UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier
UNION ALL SELECT 'part:' || p_partkey FROM part UNION ALL SELECT 'order:' || o_orderkey FROM orders)"""
EDGES = """edges AS (SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'in_region' AS label FROM nation
UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'in_nation' FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'in_nation' FROM supplier
UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'placed_by' FROM orders
UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 'contains' FROM lineitem
UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'supplied_by' FROM lineitem)"""
GRAPH = f"{NODES}, {EDGES}"
_PROPS = (
    ("region", "region", "r_regionkey", (), ("r_name",)),
    ("nation", "nation", "n_nationkey", (), ("n_name",)),
    ("customer", "customer", "c_custkey", ("c_acctbal",), ("c_name", "c_mktsegment")),
    ("supplier", "supplier", "s_suppkey", ("s_acctbal",), ("s_name",)),
    ("part", "part", "p_partkey", ("p_size", "p_retailprice"), ("p_name", "p_brand", "p_type")),
    ("orders", "order", "o_orderkey", ("o_totalprice",), ("o_orderstatus", "o_orderpriority")),
)
_ROWS = [
    f"SELECT '{prefix}:' || {key} AS node_id, '{c}' AS key, {f'CAST({c} AS DOUBLE)' if c in numbers else 'NULL'} AS num, {c if c in texts else 'NULL'} AS str FROM {table}"
    for table, prefix, key, numbers, texts in _PROPS
    for c in (*numbers, *texts)
]
GRAPH_PROPS = f"{GRAPH}, node_props AS ({' UNION ALL '.join(_ROWS)})"

_BASE = """e AS (SELECT event_id, user_id, event_type AS kind, value, json_extract_string(props, '$.k') AS k FROM events),
{p}b AS (SELECT * FROM (SELECT md5(CAST(event_id AS VARCHAR)) AS sha, 'w' || (user_id % 8) AS writer, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS lamport,
  kind, 'user:' || user_id AS usr, 'item:' || k || '.' || (user_id // 10) AS item, value, event_id % 3 = 0 AS third FROM e) WHERE {cond})"""
_LOG = """{p}node_add AS (SELECT sha, writer, lamport, 0 AS op_index, CASE WHEN kind = 'signup' THEN usr ELSE item END AS node FROM {p}b WHERE kind IN ('view', 'click', 'signup')),
{p}edge_add AS (SELECT sha, writer, lamport, 0 AS op_index, usr AS src, item AS dst, 'bought' AS label FROM {p}b WHERE kind = 'purchase'),
{p}node_rem AS (SELECT sha, writer, lamport, 0 AS op_index, item AS node FROM {p}b WHERE kind = 'error'),
{p}edge_rem AS (SELECT sha, writer, lamport, 1 AS op_index, usr AS src, item AS dst FROM {p}b WHERE kind = 'error' AND third),
{p}node_set AS (SELECT sha, writer, lamport, 1 AS op_index, usr AS node, 'score' AS key, value FROM {p}b WHERE kind = 'signup'
  UNION ALL SELECT sha, writer, lamport, 1, item, 'seen', value FROM {p}b WHERE kind = 'view'),
{p}edge_set AS (SELECT sha, writer, lamport, 1 AS op_index, usr AS src, item AS dst, 'bought' AS label, 'amount' AS key, value FROM {p}b WHERE kind = 'purchase')"""
_STATE = """{p}node_tomb AS (SELECT DISTINCT a.writer AS dw, a.lamport AS dc FROM {p}node_rem r JOIN {p}node_add a USING (node) WHERE a.lamport < r.lamport),
{p}edge_tomb AS (SELECT DISTINCT a.writer AS dw, a.lamport AS dc FROM {p}edge_rem r JOIN {p}edge_add a USING (src, dst) WHERE a.lamport < r.lamport),
{p}live_dots AS (SELECT node, writer, lamport FROM {p}node_add WHERE (writer, lamport) NOT IN (SELECT (dw, dc) FROM {p}node_tomb)),
{p}live_nodes AS (SELECT DISTINCT node FROM {p}live_dots),
{p}live_edges AS (SELECT DISTINCT src, dst, label FROM {p}edge_add WHERE (writer, lamport) NOT IN (SELECT (dw, dc) FROM {p}edge_tomb)
  AND src IN (SELECT node FROM {p}live_nodes) AND dst IN (SELECT node FROM {p}live_nodes)),
{p}births AS (SELECT src, dst, label, max({{'lamport': lamport, 'writer': writer, 'sha': sha, 'op_index': op_index}}) AS birth FROM {p}edge_add GROUP BY src, dst, label),
{p}node_win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node, key ORDER BY lamport DESC, writer DESC, sha DESC, op_index DESC) AS n FROM {p}node_set) WHERE n = 1),
{p}edge_win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, label, key ORDER BY lamport DESC, writer DESC, sha DESC, op_index DESC) AS n FROM {p}edge_set) WHERE n = 1),
{p}live_node_props AS (SELECT node, key, value FROM {p}node_win WHERE node IN (SELECT node FROM {p}live_nodes)),
{p}live_edge_props AS (SELECT w.src, w.dst, w.label, w.key, w.value FROM {p}edge_win w JOIN {p}live_edges USING (src, dst, label) JOIN {p}births USING (src, dst, label)
  WHERE (w.lamport, w.writer, w.sha, w.op_index) >= (birth.lamport, birth.writer, birth.sha, birth.op_index))"""


def state_at(condition: str, prefix: str = "") -> str:
    """The log's fold over the patches that meet a condition, its tables' names under a prefix.

    Removals observe the additions of the whole log; of those only the chosen patches' dots can be in the state.
    """
    base = _BASE.format(p=prefix, cond=condition)
    if prefix and prefix != "a_":
        base = base.partition("),\n")[2]  # e is there already
    return f"{base}, {_LOG.format(p=prefix)}, {_STATE.format(p=prefix)}"


LOG = f"{_BASE.format(p='', cond='true')}, {_LOG.format(p='')}"
STATE = state_at("true")
