"""Registered queries of the netlist engine and their DuckDB SQL.

All run over the projection of the supplied tables; each returns flat rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copperline.functions import exprs
from copperline.operators import components as parts
from copperline.operators import compare, geometry, grouping, matching, xnet
from copperline.operators.pairing import paired
from copperline.plans import fleet, oracle, projection
from copperline.plans.netlist import Netlist
from copperline.sources import cadence

#: Patterns of the registered searches; the same in Java and RE2.
NET_SEARCH = "^N1[0-9]*7$"
SIGN_SEARCH = "^[*+][0-9]+V3$|^GN[C-E]$|\\++N|N99$"
REFDES_SEARCH = "^(u|fb)[0-9]*5"
MPN_SEARCH = "brand#1[0-9]?-[1-4]"
DESCRIPTION_SEARCH = "[a-e].*dnp"
SKIP = ["C", "FB"]


def _flat(groups: DataFrame) -> DataFrame:
    return groups.select("mpn", "description", "value", F.coalesce("dns", F.lit(False)).alias("dns"), F.array_join("refdes", ",").alias("refdes"), F.col("count").alias("n"))


def _starts(net) -> DataFrame:
    """Every net that is not on ground."""
    return net.nets.where(~exprs.is_ground(F.col("net"))).select("design_id", F.col("net").alias("root"))


START_SQL = f"SELECT net AS root FROM nets WHERE NOT {oracle.GROUND}"


def _circuit(spark: SparkSession, sf_dir: str, skip: list[str] = ()):
    net = projection.settled(spark, sf_dir)
    seen = xnet.reach(net, _starts(net), skip)
    return net, seen, xnet.circuit_pins(net, seen, skip)


def _every_circuit(spark: SparkSession, sf_dir: str):
    net = projection.settled(spark, sf_dir)
    seen = xnet.closure_visits(xnet.closures(net))
    return net, seen, xnet.circuit_pins(net, seen)


def list_components_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(parts.list_components(projection.netlist(spark, sf_dir), "R"))


def list_components_with_dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(parts.list_components(projection.netlist(spark, sf_dir), "r", include_dns=True))


def list_nets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.list_nets(projection.netlist(spark, sf_dir)).select("net")


def search_nets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.search_nets(projection.netlist(spark, sf_dir), parts.checked_pattern(spark, NET_SEARCH)).select("net")


def search_nets_by_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern whose quantifier and anchors are escaped, within a class, and in the middle."""
    return parts.search_nets(projection.netlist(spark, sf_dir), parts.checked_pattern(spark, SIGN_SEARCH)).select("net")


def search_components_by_refdes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(parts.search_by_refdes(projection.netlist(spark, sf_dir), parts.checked_pattern(spark, REFDES_SEARCH)))


def search_components_by_mpn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(parts.search_by_mpn(projection.netlist(spark, sf_dir), parts.checked_pattern(spark, MPN_SEARCH)))


def search_components_by_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(parts.search_by_description(projection.netlist(spark, sf_dir), parts.checked_pattern(spark, DESCRIPTION_SEARCH), include_dns=True))


def query_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts.component_details(projection.netlist(spark, sf_dir))
    pins = F.array_join(F.transform("pins", lambda p: F.concat(p["pin"], F.lit("="), p["net"])), ",")
    return rows.select("refdes", "mpn", "description", "value", F.coalesce("dns", F.lit(False)).alias("dns"), F.element_at("notes", 1).alias("note"), pins.alias("pins"))


def available_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.available_prefixes(projection.netlist(spark, sf_dir)).select("prefix")


def net_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = F.col("net")
    return parts.list_nets(projection.netlist(spark, sf_dir)).select("net", exprs.is_ground(net).alias("is_ground"), exprs.is_power(net).alias("is_power"), exprs.is_stop(net).alias("is_stop"))


def dns_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    comps = projection.netlist(spark, sf_dir).components
    return comps.select("refdes", exprs.is_dns(F.col("mpn"), F.col("description"), F.col("comment")).alias("dns"))


def passive_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    refdes = F.col("refdes")
    return projection.netlist(spark, sf_dir).components.select("refdes", exprs.is_passive(refdes).alias("passive"), exprs.is_refdes(refdes).alias("valid"), exprs.refdes_prefix(refdes).alias("prefix"))


def net_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts.described_net_pins(projection.netlist(spark, sf_dir))
    return rows.groupBy("net").agg(F.count("*").alias("n_pins"), F.count_distinct("refdes").alias("n_parts"), F.sum(F.col("dns").cast("long")).alias("n_dns_pins"))


def circuit_pin_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins of each part by net, connections in the order of their first pin."""
    rows = parts.described_net_pins(projection.netlist(spark, sf_dir))
    made = grouping.circuit_components(rows, ["design_id"])
    return made.select("refdes", F.size("connections").cast("long").alias("n_nets"), F.array_join(F.transform("connections", lambda c: F.concat(F.array_join(c["pins"], ","), F.lit(":"), c["net"])), "|").alias("wiring"))


def whole_fans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections of each part when all of its lines are pins: the pins on each net in natural order, and the parts that the net meets."""
    pins = projection.every_pin(spark, sf_dir)
    met = pins.select("net", "refdes").distinct().groupBy("net").agg(F.count("*").alias("n_parts"))
    held = pins.groupBy("refdes", "net").agg(F.array_join(exprs.naturally_sorted(F.collect_set("pin")), ",").alias("pins"))
    return held.join(met, "net").select("refdes", "net", "pins", "n_parts")


def xnet_from_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _circuit(spark, sf_dir)[2].select("root", "refdes", "pin", "net")


def xnet_visited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _circuit(spark, sf_dir)[1].select("root", "net", "expanded")


def xnet_from_pin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extended nets of every component pin that is not on ground; each distinct net is traced once."""
    net = projection.settled(spark, sf_dir)
    asked = net.component_pins.where(~exprs.is_ground(F.col("net"))).select("design_id", F.col("refdes").alias("start_refdes"), F.col("pin").alias("start_pin"), F.col("net").alias("root"))
    seen = xnet.reach(net, asked.select("design_id", "root"))
    shown = xnet.circuit_pins(net, seen).select("design_id", "root", F.col("refdes").alias("part"), "pin", "net")
    return paired(asked, shown, ["design_id", "root"], xnet.cut).select("start_refdes", "start_pin", "root", "part", "pin", "net")


def xnet_power_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A start on a power net is expanded, though such nets end a traversal otherwise."""
    net = projection.settled(spark, sf_dir)
    seen = xnet.reach(net, xnet.starts_of(spark, [(projection.DESIGN, "+3V3")]))
    return xnet.circuit_pins(net, seen).select("root", "refdes", "pin", "net")


def xnet_skip_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _circuit(spark, sf_dir, SKIP)[2].select("root", "refdes", "pin", "net")


def xnet_skipped_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    net, seen, _ = _circuit(spark, sf_dir, SKIP)
    return xnet.skipped_counts(net, seen, SKIP).select("root", "skip_type", "n")


def xnet_all_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xnet.closures(projection.settled(spark, sf_dir)).select("net", "label")


def xnet_group_by_mpn(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, pins = _circuit(spark, sf_dir)
    rows = grouping.aggregate_circuits(grouping.circuit_components(pins, ["design_id", "root"]), ["design_id", "root"])
    return rows.select("root", "mpn", "description", "value", "total_count", F.size("orientations").cast("long").alias("n_orientations"), F.col("net_signature").alias("nets"))


def xnet_orientations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every extended net's groups, an orientation a row, numbered in order."""
    _, _, pins = _every_circuit(spark, sf_dir)
    rows = grouping.aggregate_circuits(grouping.circuit_components(pins, ["design_id", "root"]), ["design_id", "root"])
    way = F.array_join(F.transform("o.connections", lambda c: F.concat(F.array_join(c["pins"], ","), F.lit(":"), c["net"])), "|")
    each = rows.select("root", "mpn", "description", F.posexplode("orientations").alias("place", "o"))
    return each.select("root", "mpn", F.col("place").cast("long").alias("place"), F.col("o.count").alias("n"), F.array_join("o.refdes", ",").alias("refdes"), way.alias("wiring"))


def xnet_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of each answer: components, distinct configurations, visited nets."""
    _, seen, pins = _circuit(spark, sf_dir)
    groups = grouping.aggregate_circuits(grouping.circuit_components(pins, ["design_id", "root"]), ["design_id", "root"])
    # A component is in one group, so the groups' counts add up to the components.
    totals = groups.groupBy("design_id", "root").agg(F.count("*").alias("unique_configurations"), F.sum("total_count").alias("total_components"))
    visited = seen.groupBy("design_id", "root").agg(F.count("*").alias("n_visited"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return visited.join(totals, ["design_id", "root"], "left").select("root", zero("total_components"), zero("unique_configurations"), "n_visited")


def circuit_hash_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, pins = _every_circuit(spark, sf_dir)
    return grouping.circuit_hash(grouping.circuit_components(pins, ["design_id", "root"]), ["design_id", "root"]).select("root", "circuit_hash")


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet per supplier, a wire or point per line of its orders, laid out by keys."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber").distinct()
    x = (F.col("l_orderkey") % 300) * 1000
    y = (F.col("l_partkey") % 200) * 1000
    far = F.when(F.col("l_linenumber") % 2 == 0, x + 4000).otherwise(x)
    up = F.when(F.col("l_linenumber") % 3 == 0, y + 15000).otherwise(y)
    points = F.array(F.struct(x.alias("x"), y.alias("y")), F.struct(far.alias("x"), up.alias("y")))
    name = F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber")
    return line.select(F.col("l_suppkey").cast("string").alias("sheet"), name.alias("idx"), points.alias("points"))


def spatial_connect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of devices that touch, on every sheet."""
    edges = geometry.touching(_boxes(spark, sf_dir), ["sheet"])
    return edges.select("sheet", "a", "b")


def spatial_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The connected group of every device of every sheet."""
    groups = geometry.connected_groups(_boxes(spark, sf_dir).withColumn("label", F.lit(None).cast("string")), ["sheet"], xnet.cut)
    return groups.select("sheet", "idx", F.col("group").alias("first_of_group"))


def cadence_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projection written as text exports, one design per brand, and parsed and joined again."""
    net = cadence.netlist_of_lines(projection.cadence_lines(spark, sf_dir))
    pins = net.component_pins.select("design_id", "refdes", "pin", "pin_name", "net")
    return net.components.select("design_id", "refdes", "mpn", "description", "value").join(pins, ["design_id", "refdes"], "left")


def broken(net: Netlist) -> Netlist:
    """The netlist with a flaw of each kind that ``problems`` finds, put in by what the rows say."""
    comps = net.components.withColumn("refdes", F.when(F.col("description").endswith(" DNP"), None).otherwise(F.col("refdes")))
    pins = net.component_pins.withColumn("pin", F.when(F.col("net") == "GND", None).otherwise(F.col("pin")))
    net_pins = net.net_pins.withColumn("net", F.when(F.col("pin") == "8", None).otherwise(F.col("net")))
    nets = net.nets.where("net <> '+3V3'")
    return Netlist(
        comps.union(comps.where("mpn IS NULL")),
        pins.union(pins.where("net = '+3V3'")),
        net_pins,
        nets.union(nets.where("net = 'GND'")).union(nets.where("net = 'GND'").withColumn("net", F.lit(None).cast("string"))),
    )


def netlist_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What breaks the tables' contract in a projection with flaws of every kind; the projection itself has none."""
    net = projection.settled(spark, sf_dir)
    return broken(net).problems().unionByName(net.problems())


def revised(net: Netlist) -> Netlist:
    """A later state of the netlist: parts and nets that went, came and changed, by what the rows say."""
    comps, pins, net_pins = net.components, net.component_pins, net.net_pins
    comps = comps.where(~F.col("description").endswith(" DNP")).withColumn("value", F.when(F.col("mpn").isNull(), F.concat("value", F.lit("k"))).otherwise(F.col("value")))
    spare = comps.where(F.startswith("refdes", F.lit("L")) & (F.col("value") == "7")).withColumn("refdes", F.concat(F.lit("X"), "refdes"))
    pins = pins.withColumn("net", F.when((F.col("net") == "+3V3") & (F.col("pin") == "2"), "GND").otherwise(F.col("net")))
    more = net_pins.where("net = '+3V3' AND pin = '1'")
    nets = net.nets.where("net <> '+3V3'").withColumn("net_ord", F.lit(0))
    return Netlist(comps.unionByName(spare), pins, net_pins.unionByName(more), nets)


def compare_netlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between the projection and a later state of it."""
    net = projection.settled(spark, sf_dir)
    return compare.differences(net, revised(net)).select("of_table", "part_or_net", "name", "change")


def greedy_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's parts as designs and its orders as data sets, matched one to one by score."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pairs = line.groupBy("l_suppkey", "l_partkey", "l_orderkey").agg(F.max(F.col("l_quantity").cast("long")).alias("score"))
    rows = pairs.select(F.col("l_suppkey").cast("string").alias("root"), F.col("l_partkey").cast("string").alias("design"), F.col("l_orderkey").cast("string").alias("data_set"), "score")
    return matching.greedy(rows, ["root"]).select("root", "design", "data_set", "score")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extended net of every net, rolled up by part number."""
    return xnet_group_by_mpn(spark, sf_dir).orderBy(F.desc("total_count"), "root")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        list_components_r, list_components_with_dns, list_nets, search_nets, search_components_by_refdes, search_components_by_mpn,
        search_components_by_description, query_component, available_prefixes, net_classification, dns_flags, passive_flags, net_degree,
        circuit_pin_groups, xnet_from_net, xnet_visited, xnet_from_pin, xnet_power_start, xnet_skip_types, xnet_skipped_counts,
        xnet_all_components, xnet_group_by_mpn, xnet_orientations, xnet_envelope, circuit_hash_all, spatial_connect,
        whole_fans, greedy_assignment, cadence_round_trip, netlist_problems, compare_netlists, search_nets_by_signs, spatial_groups,
    )
    return {f.__name__: f for f in every} | fleet.queries()


def _skip_sql(column: str = "refdes") -> str:
    return " OR ".join(f"starts_with({column}, '{k}')" for k in SKIP)


def oracle_sql() -> dict[str, str]:
    base = f"WITH {oracle.BASE}"
    walk = oracle.traversal(START_SQL)
    skip_walk = oracle.traversal(START_SQL, _skip_sql())
    pin_starts = f"SELECT DISTINCT net AS root FROM pins WHERE NOT {oracle.GROUND}"
    everything = oracle.traversal(f"SELECT net AS root FROM nets WHERE NOT {oracle.STOP}")
    # Every extended net once: the start that is its least net.
    least = everything + f""",
label AS (SELECT root AS net, min(net) FILTER (NOT {oracle.STOP}) AS label FROM vis GROUP BY root)"""
    roots = least.replace("label AS (", "label0 AS (") + """,
own AS (SELECT net AS root FROM label0 WHERE net = label),
shown1 AS (SELECT shown.* FROM shown JOIN own USING (root))"""
    every_circuit = roots + oracle.CIRCUIT.replace("FROM shown GROUP", "FROM shown1 GROUP")
    wiring = oracle.CIRCUIT
    sql = {
        "list_components_r": oracle.grouped("starts_with(upper(refdes), 'R')"),
        "list_components_with_dns": oracle.grouped("starts_with(upper(refdes), 'R')", "true"),
        "list_nets": f"{base} SELECT net FROM nets",
        "search_nets": f"{base} SELECT net FROM nets WHERE regexp_matches(net, '{NET_SEARCH}')",
        "search_nets_by_signs": f"{base} SELECT net FROM nets WHERE regexp_matches(net, '{SIGN_SEARCH}')",
        "search_components_by_refdes": oracle.grouped(f"regexp_matches(refdes, '{REFDES_SEARCH}', 'i')"),
        "search_components_by_mpn": oracle.grouped(f"mpn IS NOT NULL AND regexp_matches(mpn, '{MPN_SEARCH}', 'i')"),
        "search_components_by_description": oracle.grouped(f"regexp_matches(description, '{DESCRIPTION_SEARCH}', 'i')", "true"),
        "query_component": f"""{base},
p AS (SELECT refdes, string_agg(pin || '=' || net, ',' ORDER BY CAST(pin AS INT)) AS pins FROM pins GROUP BY refdes)
SELECT refdes, mpn, description, value, dns, CASE WHEN mpn IS NULL THEN '{exprs.MPN_MISSING_NOTE}' END AS note, coalesce(pins, '') AS pins
FROM comp LEFT JOIN p USING (refdes)""",
        "available_prefixes": f"{base} SELECT DISTINCT regexp_extract(refdes, '^[A-Z]+') AS prefix FROM comp",
        "net_classification": f"{base} SELECT net, {oracle.GROUND} AS is_ground, {oracle.POWER} AS is_power, {oracle.STOP} AS is_stop FROM nets",
        "dns_flags": f"{base} SELECT refdes, dns FROM comp",
        "passive_flags": f"{base} SELECT refdes, {oracle.PASSIVE} AS passive, {oracle.matches('refdes', exprs.REFDES_PATTERN)} AS valid, regexp_extract(refdes, '^[A-Z]+') AS prefix FROM comp",
        "net_degree": f"{base} SELECT net, count(*) AS n_pins, count(DISTINCT refdes) AS n_parts, CAST(sum(CAST(dns AS BIGINT)) AS BIGINT) AS n_dns_pins FROM pins JOIN comp USING (refdes) GROUP BY net",
        "circuit_pin_groups": f"""{base},
c AS (SELECT refdes, net, string_agg(pin, ',' ORDER BY pin) AS p, min(pin) AS p0 FROM pins GROUP BY refdes, net)
SELECT refdes, count(*) AS n_nets, string_agg(p || ':' || net, '|' ORDER BY p0) AS wiring FROM c GROUP BY refdes""",
        "whole_fans": f"""{base},
e AS (
  SELECT refdes, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_suppkey) AS pin,
         CASE WHEN l_orderkey % 97 = 0 THEN 'GND' WHEN l_orderkey % 89 = 0 THEN '+3V3' ELSE 'N' || l_orderkey END AS net
  FROM lineitem JOIN part0 ON l_partkey = p_partkey)
SELECT refdes, net, string_agg(CAST(pin AS VARCHAR), ',' ORDER BY pin) AS pins, any_value(n_parts) AS n_parts
FROM e JOIN (SELECT net, count(DISTINCT refdes) AS n_parts FROM e GROUP BY net) USING (net) GROUP BY refdes, net""",
        "xnet_from_net": f"{walk} SELECT root, refdes, pin, net FROM shown",
        "xnet_visited": f"{walk} SELECT root, net, expanded FROM vis",
        "xnet_from_pin": oracle.traversal(pin_starts) + f"""
SELECT a.refdes AS start_refdes, a.pin AS start_pin, s.root, s.refdes AS part, s.pin, s.net FROM shown s
JOIN (SELECT refdes, pin, net FROM pins WHERE NOT {oracle.GROUND}) a ON a.net = s.root""",
        "xnet_power_start": oracle.traversal("SELECT '+3V3' AS root") + " SELECT root, refdes, pin, net FROM shown",
        "xnet_skip_types": f"{skip_walk} SELECT root, refdes, pin, net FROM shown",
        "xnet_skipped_counts": f"""{skip_walk},
sk AS (SELECT DISTINCT v.root, c.refdes, CASE {" ".join(f"WHEN starts_with(c.refdes, '{k}') THEN '{k}'" for k in SKIP)} END AS skip_type
       FROM vis v JOIN pins p USING (net) JOIN comp c ON c.refdes = p.refdes WHERE v.expanded AND NOT c.dns)
SELECT root, skip_type, count(*) AS n FROM sk WHERE skip_type IS NOT NULL GROUP BY root, skip_type""",
        "xnet_all_components": f"{least} SELECT net, label FROM label",
        "xnet_group_by_mpn": f"""{walk}{wiring}
SELECT root, mpn, arg_min(description, ({oracle.NATURAL})) AS description, arg_min(value, ({oracle.NATURAL})) AS value,
       count(*) AS total_count, count(DISTINCT way) AS n_orientations, sig AS nets
FROM keyed GROUP BY root, k, mpn, sig""",
        "xnet_orientations": f"""{every_circuit},
w AS (SELECT root, k, mpn, sig, way, count(*) AS n, min(row(letters, digits)) AS first,
             string_agg(refdes, ',' ORDER BY {oracle.NATURAL}) AS refdes FROM keyed GROUP BY ALL)
SELECT root, mpn, row_number() OVER (PARTITION BY root, k, sig ORDER BY n DESC, first) - 1 AS place, n, refdes, way AS wiring FROM w""",
        "xnet_envelope": f"""{walk}{wiring},
t AS (SELECT root, count(*) AS total_components, count(DISTINCT (k, sig)) AS unique_configurations FROM keyed GROUP BY root)
SELECT v.root, coalesce(any_value(total_components), 0) AS total_components, coalesce(any_value(unique_configurations), 0) AS unique_configurations, count(*) AS n_visited
FROM vis v LEFT JOIN t USING (root) GROUP BY v.root""",
        "circuit_hash_all": f"""{every_circuit}
SELECT root, substr(sha256('[' || string_agg('{{"refdes":"' || refdes || '","mpn":' || coalesce('"' || mpn || '"', 'null') || ',"connections":[' || wiring || ']}}', ',' ORDER BY {oracle.NATURAL}) || ']'), 1, 16) AS circuit_hash
FROM keyed GROUP BY root""",
        "cadence_round_trip": f"""{base}
SELECT p_brand AS design_id, c.refdes, coalesce(mpn, p_type) AS mpn, p_name AS description,
       CASE WHEN pin IS NOT NULL THEN lower(p_type) END AS value, pin, CASE WHEN pin = '1' THEN 'FIRST' END AS pin_name, net
FROM part0 c JOIN comp0 USING (refdes) LEFT JOIN pins ON pins.refdes = c.refdes""",
        "netlist_problems": f"""{base},
c0 AS (SELECT CASE WHEN description NOT LIKE '% DNP' THEN refdes END AS refdes, mpn FROM comp),
c AS (SELECT refdes FROM c0 UNION ALL SELECT refdes FROM c0 WHERE mpn IS NULL),
p0 AS (SELECT refdes, CASE WHEN net <> 'GND' THEN pin END AS pin, net FROM pins),
p AS (SELECT refdes, pin FROM p0 UNION ALL SELECT refdes, pin FROM p0 WHERE net = '+3V3'),
np AS (SELECT CASE WHEN pin <> '8' THEN net END AS net, refdes, pin FROM pins),
n AS (SELECT net FROM nets WHERE net <> '+3V3' UNION ALL SELECT net FROM nets WHERE net = 'GND' UNION ALL SELECT NULL FROM nets WHERE net = 'GND')
SELECT 'components' AS of_table, 'star' AS design_id, '' AS name, 'key is missing' AS problem FROM c WHERE refdes IS NULL
UNION ALL SELECT 'components', 'star', refdes, 'key is repeated' FROM c WHERE refdes IS NOT NULL GROUP BY refdes HAVING count(*) > 1
UNION ALL SELECT 'component_pins', 'star', refdes, 'key is missing' FROM p WHERE pin IS NULL
UNION ALL SELECT 'component_pins', 'star', refdes || '.' || pin, 'key is repeated' FROM p WHERE pin IS NOT NULL GROUP BY refdes, pin HAVING count(*) > 1
UNION ALL SELECT 'net_pins', 'star', refdes || '.' || pin, 'key is missing' FROM np WHERE net IS NULL
UNION ALL SELECT DISTINCT 'net_pins', 'star', net, 'no such net' FROM np WHERE net IS NOT NULL AND net NOT IN (SELECT net FROM n WHERE net IS NOT NULL)
UNION ALL SELECT 'nets', 'star', '', 'key is missing' FROM n WHERE net IS NULL
UNION ALL SELECT 'nets', 'star', net, 'key is repeated' FROM n WHERE net IS NOT NULL GROUP BY net HAVING count(*) > 1""",
        "compare_netlists": f"""{base},
c AS (SELECT refdes, description LIKE '% DNP' AS gone, mpn IS NULL AS bare, value FROM comp)
SELECT 'components' AS of_table, refdes AS part_or_net, refdes AS name, CASE WHEN gone THEN 'lost' ELSE 'changed' END AS change FROM c WHERE gone OR bare
UNION ALL SELECT 'components', 'X' || refdes, 'X' || refdes, 'added' FROM c WHERE NOT gone AND NOT bare AND starts_with(refdes, 'L') AND value = '7'
UNION ALL SELECT 'component_pins', refdes, refdes || '.2', 'changed' FROM pins WHERE net = '+3V3' AND pin = '2'
UNION ALL SELECT 'net_pins', net, net || '.' || refdes || '.1#2', 'added' FROM pins WHERE net = '+3V3' AND pin = '1'
UNION ALL SELECT DISTINCT 'nets', net, net, 'lost' FROM pins WHERE net = '+3V3'""",
        "spatial_connect": """
WITH b AS (
  SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS sheet, l_orderkey || '-' || l_partkey || '-' || l_linenumber AS idx,
         (l_orderkey % 300) * 1000 AS x1, (l_partkey % 200) * 1000 AS y1,
         (l_orderkey % 300) * 1000 + CASE WHEN l_linenumber % 2 = 0 THEN 4000 ELSE 0 END AS x2,
         (l_partkey % 200) * 1000 + CASE WHEN l_linenumber % 3 = 0 THEN 15000 ELSE 0 END AS y2
  FROM lineitem)
SELECT DISTINCT a.sheet, a.idx AS a, c.idx AS b FROM b a JOIN b c ON a.sheet = c.sheet AND a.idx < c.idx
WHERE (a.x1 BETWEEN c.x1 AND c.x2 AND a.y1 BETWEEN c.y1 AND c.y2) OR (a.x2 BETWEEN c.x1 AND c.x2 AND a.y2 BETWEEN c.y1 AND c.y2)
   OR (c.x1 BETWEEN a.x1 AND a.x2 AND c.y1 BETWEEN a.y1 AND a.y2) OR (c.x2 BETWEEN a.x1 AND a.x2 AND c.y2 BETWEEN a.y1 AND a.y2)""",
    }
    sql["spatial_groups"] = sql["spatial_connect"].replace("WITH b AS", "WITH RECURSIVE b AS").replace("FROM lineitem)\nSELECT DISTINCT", "FROM lineitem),\ne0 AS (SELECT DISTINCT") + """),
e AS (SELECT sheet, a, b FROM e0 UNION SELECT sheet, b, a FROM e0),
r AS (SELECT DISTINCT sheet, idx, idx AS other FROM b UNION SELECT r.sheet, r.idx, e.b FROM r JOIN e ON e.sheet = r.sheet AND e.a = r.other)
SELECT sheet, idx, min(other) AS first_of_group FROM r GROUP BY sheet, idx"""
    sql["greedy_assignment"] = """
WITH RECURSIVE c AS (
  SELECT l_suppkey AS root, CAST(l_partkey AS VARCHAR) AS design, CAST(l_orderkey AS VARCHAR) AS data_set, max(CAST(l_quantity AS BIGINT)) AS score
  FROM lineitem GROUP BY l_suppkey, l_partkey, l_orderkey),
o AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY score DESC, design, data_set) AS n FROM c),
g AS (
  SELECT root, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS designs, CAST([] AS VARCHAR[]) AS sets, false AS taken FROM (SELECT DISTINCT root FROM c)
  UNION ALL
  SELECT root, n, CASE WHEN f THEN list_append(designs, design) ELSE designs END, CASE WHEN f THEN list_append(sets, data_set) ELSE sets END, f
  FROM (SELECT o.root, o.n, g.designs, g.sets, o.design, o.data_set, NOT list_contains(g.designs, o.design) AND NOT list_contains(g.sets, o.data_set) AS f
        FROM g JOIN o ON o.root = g.root AND o.n = g.n + 1))
SELECT CAST(o.root AS VARCHAR) AS root, design, data_set, score FROM o JOIN g USING (root, n) WHERE taken"""
    return sql | fleet.oracle_sql()
