"""DuckDB SQL of the panels, shared by the oracles."""

#: q: valid quotes; k: last quote of a day and leg; p: the day grid with last known values and basis.
LINEITEM = """
q0 AS (SELECT CASE l_returnflag WHEN 'A' THEN 'a' WHEN 'R' THEN 'b' WHEN 'N' THEN 'c' END AS leg, epoch_us(l_shipdate) // 1000000 AS s,
        l_extendedprice / l_quantity / 1500 * (1 - l_discount) AS bid, l_extendedprice / l_quantity / 1500 * (1 + l_tax) AS ask, lineitem.* FROM lineitem),
q AS (SELECT *, (bid + ask) / 2 AS mid FROM q0 WHERE bid > 0 AND ask > 0 AND bid < ask),
k AS (SELECT leg, s // 86400 * 86400 AS s, bid, ask, mid FROM q
      QUALIFY row_number() OVER (PARTITION BY leg, s // 86400 ORDER BY s DESC, l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC,
              l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_linestatus DESC) = 1),
g AS (SELECT unnest(generate_series((SELECT min(s) FROM k), (SELECT max(s) FROM k), 86400)) AS s),
j AS (SELECT g.s, a.mid AS am, a.bid AS ab, a.ask AS aa, b.mid AS bm, b.bid AS bb, b.ask AS ba, c.mid AS cm, c.bid AS cb, c.ask AS ca
      FROM g LEFT JOIN k a ON a.s = g.s AND a.leg = 'a' LEFT JOIN k b ON b.s = g.s AND b.leg = 'b' LEFT JOIN k c ON c.s = g.s AND c.leg = 'c'),
f AS (SELECT s, last_value(am IGNORE NULLS) OVER w AS a_mid, last_value(ab IGNORE NULLS) OVER w AS a_bid, last_value(aa IGNORE NULLS) OVER w AS a_ask,
        last_value(bm IGNORE NULLS) OVER w AS b_mid, last_value(bb IGNORE NULLS) OVER w AS b_bid, last_value(ba IGNORE NULLS) OVER w AS b_ask,
        last_value(cm IGNORE NULLS) OVER w AS c_mid, last_value(cb IGNORE NULLS) OVER w AS c_bid, last_value(ca IGNORE NULLS) OVER w AS c_ask,
        am IS NOT NULL AS a_fresh, bm IS NOT NULL AS b_fresh, cm IS NOT NULL AS c_fresh
      FROM j WINDOW w AS (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
p AS (SELECT *, a_mid * b_mid AS synthetic, c_mid - a_mid * b_mid AS basis FROM f WHERE a_mid IS NOT NULL AND b_mid IS NOT NULL AND c_mid IS NOT NULL)
"""


def events(step: int) -> str:
    """e: ticks of the legs; k, g, p as above, of mids only."""
    return f"""
e AS (SELECT CASE event_type WHEN 'click' THEN 'a' WHEN 'view' THEN 'b' WHEN 'purchase' THEN 'c' END AS leg, epoch_us(ts) // 1000000 AS s, value AS mid, ts, event_id
      FROM events WHERE event_type IN ('click', 'view', 'purchase')),
k AS (SELECT leg, s // {step} * {step} AS s, mid FROM e QUALIFY row_number() OVER (PARTITION BY leg, s // {step} ORDER BY s DESC, ts DESC, event_id DESC) = 1),
g AS (SELECT unnest(generate_series((SELECT min(s) FROM k), (SELECT max(s) FROM k), {step})) AS s),
j AS (SELECT g.s, a.mid AS am, b.mid AS bm, c.mid AS cm
      FROM g LEFT JOIN k a ON a.s = g.s AND a.leg = 'a' LEFT JOIN k b ON b.s = g.s AND b.leg = 'b' LEFT JOIN k c ON c.s = g.s AND c.leg = 'c'),
f AS (SELECT s, last_value(am IGNORE NULLS) OVER w AS a_mid, last_value(bm IGNORE NULLS) OVER w AS b_mid, last_value(cm IGNORE NULLS) OVER w AS c_mid,
        am IS NOT NULL AS a_fresh, bm IS NOT NULL AS b_fresh, cm IS NOT NULL AS c_fresh
      FROM j WINDOW w AS (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
p AS (SELECT *, a_mid * b_mid AS synthetic, c_mid - a_mid * b_mid AS basis FROM f WHERE a_mid IS NOT NULL AND b_mid IS NOT NULL AND c_mid IS NOT NULL)
"""


EVENTS = events(600)
