"""Domain frames over the test tables, as common table expressions that both engines read."""

#: Today, for all queries.
NOW = "TIMESTAMP '1998-08-02 00:00:00'"

NOTICES = """notices AS (
  SELECT o.o_orderkey AS notice_id, CASE o.o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'unknown' END AS status,
         CAST(o.o_orderdate AS TIMESTAMP) AS closing_ts, o.o_totalprice AS value, o.o_orderpriority AS category, o.o_custkey AS buyer_id,
         c.c_mktsegment AS buyer_type, r.r_name AS region
  FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey)"""

INTERACTIONS = """events_raw AS (
  SELECT l.l_suppkey AS firm_id, l.l_orderkey AS ocid, l.l_linenumber AS pos, CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END AS won, l.l_extendedprice AS amount,
         CAST(o.o_orderdate AS DATE) AS day, o.o_custkey AS buyer_id, p.p_type AS category, p.p_name AS title
  FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {part} p ON l.l_partkey = p.p_partkey),
interactions AS (
  SELECT firm_id, ocid, max(won) AS won, max(day) AS day, max(buyer_id) AS buyer_id, <<min_by(amount, struct(pos, amount))||arg_min(amount, (pos, amount))>> AS amount,
         <<min_by(category, struct(pos, amount))||arg_min(category, (pos, amount))>> AS category, <<min_by(title, struct(pos, amount))||arg_min(title, (pos, amount))>> AS title
  FROM events_raw GROUP BY firm_id, ocid)"""
