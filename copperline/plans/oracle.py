"""DuckDB SQL of the registered queries, over the same projection of the star schema."""

from __future__ import annotations

from copperline.functions import exprs
from copperline.plans.projection import ACTIVE_PINS, PREFIXES

_PREFIX = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PREFIXES.items()) + " ELSE 'J' END"
_PASSIVE = ", ".join(f"'{k}'" for k in list(PREFIXES)[:4])


def matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern}', 'i')"


GROUND = matches("net", exprs.GROUND_PATTERN)
POWER = matches("net", exprs.POWER_PATTERN)
STOP = f"({GROUND} OR {POWER})"
DNS = "regexp_matches(coalesce(mpn, '') || ' ' || coalesce(description, '') || ' ', '" + exprs.dns_pattern() + "', 'i')"
PASSIVE = matches("refdes", exprs.PASSIVE_PATTERN)

#: comp (refdes, mpn, description, value, comp_ord, dns) and pins (refdes, pin, net, comp_ord).
BASE = f"""
part0 AS (
  SELECT *, {_PREFIX} || p_partkey AS refdes FROM part),
comp0 AS (
  SELECT refdes, CASE WHEN p_size % 10 <> 0 THEN p_brand || '-' || p_size END AS mpn,
         p_name || CASE WHEN p_partkey % 17 = 0 THEN ' DNP' ELSE '' END AS description,
         CAST(p_size AS VARCHAR) AS value, CAST(p_partkey AS BIGINT) AS comp_ord
  FROM part0),
comp AS (SELECT *, {DNS} AS dns FROM comp0),
ranked AS (
  SELECT l_partkey, l_orderkey,
         row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_suppkey) AS low,
         row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey) AS high
  FROM lineitem),
pin0 AS (
  SELECT refdes, CASE WHEN p_type IN ({_PASSIVE}) THEN '1' ELSE CAST(low AS VARCHAR) END AS pin, l_orderkey, p_partkey
  FROM ranked JOIN part0 ON l_partkey = p_partkey
  WHERE CASE WHEN p_type IN ({_PASSIVE}) THEN low = 1 ELSE low <= {ACTIVE_PINS} END
  UNION ALL
  SELECT refdes, '2', l_orderkey, p_partkey FROM ranked JOIN part0 ON l_partkey = p_partkey WHERE p_type IN ({_PASSIVE}) AND high = 1),
pins AS (
  SELECT refdes, pin, CAST(p_partkey AS BIGINT) AS comp_ord,
         CASE WHEN l_orderkey % 97 = 0 THEN 'GND' WHEN l_orderkey % 89 = 0 THEN '+3V3' ELSE 'N' || l_orderkey END AS net
  FROM pin0),
nets AS (SELECT DISTINCT net FROM pins)"""


def grouped(where: str, dns: str = "NOT dns") -> str:
    """Rows of ``group_by_mpn`` over the components that fit."""
    return f"""
WITH {BASE},
g AS (SELECT *, coalesce(mpn, 'refdes:' || refdes) AS k FROM comp WHERE {dns} AND ({where}))
SELECT mpn, arg_min(description, comp_ord) AS description, arg_min(value, comp_ord) AS value, dns,
       string_agg(refdes, ',' ORDER BY regexp_extract(refdes, '^[A-Z]+'), CAST(regexp_extract(refdes, '[0-9]+$') AS BIGINT)) AS refdes,
       count(*) AS n
FROM g GROUP BY k, mpn, dns"""


def traversal(starts: str, skip: str = "false") -> str:
    """CTEs up to ``shown`` (root, refdes, pin, net) and ``vis`` (root, net, expanded); skip names parts that are left out."""
    return f"""
WITH RECURSIVE {BASE},
ok AS (SELECT refdes, mpn, description, value, comp_ord FROM comp WHERE NOT dns AND NOT ({skip})),
pp AS (SELECT refdes, pin, net FROM pins JOIN ok USING (refdes) WHERE {PASSIVE}),
edge AS (SELECT DISTINCT a.net AS s, b.net AS d FROM pp a JOIN pp b USING (refdes) WHERE a.net <> b.net),
starts AS ({starts}),
r AS (
  SELECT root, root AS net FROM starts
  UNION
  SELECT r.root, e.d FROM r JOIN edge e ON r.net = e.s WHERE r.net = r.root OR NOT {STOP.replace('(net', '(r.net')}),
vis AS (SELECT root, net, net = root OR NOT {STOP} AS expanded FROM r),
near AS (SELECT DISTINCT v.root, p.refdes, p.pin, p.net FROM vis v JOIN pins p USING (net) JOIN ok USING (refdes) WHERE v.expanded),
shown AS (
  SELECT root, refdes, pin, net FROM near
  UNION
  SELECT n.root, pp.refdes, pp.pin, pp.net FROM (SELECT DISTINCT root, refdes FROM near) n JOIN pp USING (refdes))"""


CIRCUIT = """,
conn0 AS (SELECT root, refdes, net, string_agg(pin, ',' ORDER BY pin) AS pins, min(pin) AS p0 FROM shown GROUP BY root, refdes, net),
conn AS (
  SELECT c.root, c.refdes, mpn, description, value, comp_ord,
         string_agg(net, '|' ORDER BY net) AS sig,
         string_agg(pins || ':' || net, '|' ORDER BY p0) AS way,
         string_agg('{"pins":["' || replace(pins, ',', '","') || '"],"net":"' || net || '"}', ',' ORDER BY net) AS wiring
  FROM conn0 c JOIN comp USING (refdes) GROUP BY ALL),
keyed AS (
  SELECT *, coalesce('mpn:' || mpn, 'desc:' || description) AS k,
         regexp_extract(refdes, '^[A-Z]+') AS letters, CAST(regexp_extract(refdes, '[0-9]+$') AS BIGINT) AS digits
  FROM conn)"""

NATURAL = "letters, digits"
