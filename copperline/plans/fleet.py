"""Registered queries over files made of the projection (sheets, listings) and over answers, with their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copperline import api
from copperline.functions import exprs
from copperline.operators import components as parts
from copperline.operators import answers, xnet
from copperline.operators.ordering import numbered
from copperline.plans import drawn, oracle, projection
from copperline.sources import altium, cadence, designs, listing


def altium_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projection drawn as sheets, read again: components in the order of sheets and records."""
    rows = altium.design_components(drawn.altium_records(spark, sf_dir))
    return rows.select("design_id", "refdes", "mpn", "mpn_present", "description", "comment", "value", "comp_ord")


def altium_component_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins of the drawn parts with the nets that wires, labels and ports give them; hidden pins are none."""
    return altium.netlist_of_records(drawn.altium_records(spark, sf_dir)).normalised().component_pins.select("design_id", "refdes", "pin", "pin_name", "net")


def altium_net_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins of the drawn nets, across the sheets of a design; pins that end nowhere are on none."""
    return altium.netlist_of_records(drawn.altium_records(spark, sf_dir)).net_pins.select("design_id", "net", "refdes", "pin")


def altium_xnets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extended nets of the drawn designs."""
    return xnet.closures(altium.netlist_of_records(drawn.altium_records(spark, sf_dir)).normalised()).select("design_id", "net", "label")


def altium_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the drawn sheets by kind: how many, how many are roots, their depth and how many are valid."""
    rows = xnet.cut(drawn.altium_records(spark, sf_dir))
    names = F.create_map(*[F.lit(x) for kind in altium.RECORD_NAMES.items() for x in kind])
    valid = F.lit(False)
    for kind in ("1", "2", "17", "25", "27", "34", "41"):
        valid = valid | altium.valid_records(rows, kind)
    deep = altium.flattened(altium.record_view(rows)).withColumns({"name": names[F.col("kind")], "valid": valid.cast("long")})
    return deep.groupBy("design_id", "sheet", "name").agg(F.count("*").alias("n"), F.sum(F.col("is_root").cast("long")).alias("n_roots"), F.max(F.size("path")).cast("long").alias("depth"), F.sum("valid").alias("n_valid"))


def flawed(rows: DataFrame) -> DataFrame:
    """Records with a flaw of each kind that ``record_faults`` finds, put in by what they say."""
    kind, props = F.col("kind"), F.col("props")
    without = lambda name: F.map_filter("props", lambda k, v: k != name)
    text = props["Text"]
    made = F.when((kind == altium.DESIGNATOR) & text.startswith("J"), without("Text")).when((kind == altium.DESIGNATOR) & text.startswith("U"), F.map_concat("props", F.create_map(F.lit("Name"), F.lit("Comment"))))
    made = made.when((kind == altium.PARAMETER) & (props["Name"] == "Kind"), without("Name")).when((kind == altium.NET_LABEL) & (text == "+3V3"), without("Text")).when(kind == altium.POWER_PORT, without("Text"))
    return rows.withColumn("props", made.otherwise(props))


def altium_record_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What breaks the rules of their types in records with flaws of every kind; the drawn records themselves have none."""
    rows = drawn.altium_records(spark, sf_dir)
    names = F.create_map(*[F.lit(x) for kind in altium.RECORD_NAMES.items() for x in kind])
    found = altium.record_faults(rows.unionByName(flawed(rows)))
    return found.groupBy("design_id", "sheet", names[F.col("kind")].alias("name"), "fault").agg(F.count("*").alias("n"))


def altium_parts_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the drawn sheets, found by a field's value, with the record that designates them."""
    rows = xnet.cut(drawn.altium_records(spark, sf_dir))
    named = altium.designators(rows).withColumnRenamed("owner", "idx")
    found = altium.find_records(altium.record_view(rows, "parts-list"), "CurrentPartId", "1")
    return found.join(named, ["design_id", "sheet", "idx"]).select("design_id", "sheet", "refdes", F.col("props")["ComponentDescription"].alias("description"))


def altium_varied_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the varied sheets: fields in either case, numbers and comments from every place, parts on two sheets, bytes that are no UTF-8."""
    rows = altium.design_components(altium.records(drawn.varied_sheets(spark, sf_dir)))
    return rows.select("design_id", "refdes", "mpn", "description", "comment", "value")


def altium_varied_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins of the varied parts with nets that their least pins name; of a part on two sheets those of the first."""
    return altium.netlist(drawn.varied_sheets(spark, sf_dir)).normalised().component_pins.select("design_id", "refdes", "pin", "net")


def altium_varied_nets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nets of the varied sheets with their place in the collated order of a design's names, and their pins."""
    net = altium.netlist(drawn.varied_sheets(spark, sf_dir))
    names = parts.list_nets(net).withColumn("collated", exprs.collated(F.col("net")))
    placed = numbered(names, ["design_id"], ["collated", "net"], "place", xnet.cut)
    n = net.net_pins.groupBy("design_id", "net").agg(F.count("*").alias("n_pins"))
    return placed.join(n, ["design_id", "net"]).select("design_id", "net", "place", "n_pins")


def altium_owner_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How deep the records of the varied parts' chains lie, by sheet."""
    deep = altium.flattened(xnet.cut(altium.records(drawn.varied_sheets(spark, sf_dir)))).where(F.col("kind").between("44", "48"))
    return deep.groupBy("design_id", "sheet", "kind", F.size("path").alias("depth")).agg(F.count("*").alias("n"))


def design_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projection as text exports in files, read through the indexed source: nets of all designs, and of one that is asked for.

    Files name pins with the number 1 twice; a net lists such a pin twice and a part has it once.
    """
    lines = projection.cadence_lines(spark, sf_dir)
    at, twice = F.col("at") * 2, F.startswith("line", F.lit("NODE_NAME")) & F.endswith("line", F.lit(" 1"))
    lines = lines.withColumn("at", F.explode(F.when(twice, F.array(at, at + 1)).otherwise(F.array(at))))
    index = designs.index(drawn.exported(lines), f"{xnet.shared_root(spark)}/index-{uuid.uuid4().hex}")
    least = spark.read.parquet(f"{sf_dir}/part.parquet").agg(F.min("p_brand")).first()[0]
    read = designs.export_lines(spark, index)

    def told(asked: str, rows: DataFrame) -> DataFrame:
        net = cadence.netlist_of_lines(rows)
        listed = net.net_pins.groupBy("design_id", "net").agg(F.count("*").alias("n_listed"))
        held = net.component_pins.groupBy("design_id", "net").agg(F.count("*").alias("n_pins"))
        return listed.join(held, ["design_id", "net"]).select(F.lit(asked).alias("asked"), "design_id", "net", "n_listed", "n_pins")

    return told("all", read).unionByName(told("one", read.where(F.col("design_id") == least)))


def discover_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Designs of a listed fleet, each data set given to one."""
    return listing.cadence_designs(drawn.cadence_tree(spark, sf_dir))


def walk_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fleet as files of the shared folder, walked by tasks and discovered; paths from the fleet's root on."""
    root = drawn.planted(spark, drawn.cadence_tree(spark, sf_dir))
    found = listing.cadence_designs(listing.listing(spark, root))
    own = lambda c: F.regexp_extract(c, r"/tree-[0-9a-f]{32}(/.*)$", 1)
    return found.select("name", "format", *[own(c).alias(c) for c in ("path", "pstxnet", "pstxprt", "pstchip")], "error")


def best_data_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best data set of each design of the fleet on its own."""
    files = drawn.cadence_tree(spark, sf_dir)
    return listing.best_dat_set(files, files.where(F.col("ext").isin(listing.CADENCE_EXTENSIONS))).select("path", "dat_dir")


def discover_altium(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects of a listed fleet with their sheets."""
    files, texts = drawn.altium_tree(spark, sf_dir)

    def read(paths: DataFrame, size: int | None = None) -> DataFrame:
        wanted = texts.join(paths.select("path").distinct(), "path", "left_semi")
        return wanted.withColumn("content", F.substring("content", 1, size)) if size else wanted

    return listing.altium_designs(files, read).withColumn("sheets", F.array_join("sheets", ","))


def _first_part(spark: SparkSession, sf_dir: str) -> str:
    """The U part with the least key whose pin 1 is not on ground."""
    net = projection.netlist(spark, sf_dir)
    asked = net.component_pins.where((F.col("pin") == "1") & ~exprs.is_ground(F.col("net")) & F.col("refdes").startswith("U")).join(net.components, ["design_id", "refdes"])
    return asked.orderBy("comp_ord").first().refdes


def lookup_pin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A component and its first pin, found whatever their case and blanks."""
    net, refdes = projection.netlist(spark, sf_dir), _first_part(spark, sf_dir)
    found = parts.find_component(net, f" {refdes.lower()} ").select("design_id", "refdes", "mpn", "description")
    return found.join(parts.find_pin(net, refdes.lower(), " 1 ").select("refdes", "pin", "net"), "refdes").select("refdes", "mpn", "description", "pin", "net")


def _said(spark: SparkSession, answer: dict) -> DataFrame:
    """An answer's envelope as a row."""
    groups, visited = answer["components_by_mpn"], answer["visited_nets"]
    row = (answer["starting_point"], answer["total_components"], answer["unique_configurations"], answer["circuit_hash"], len(visited), sum(g["total_count"] for g in groups), ",".join(sorted(visited)))
    return spark.createDataFrame([row], "starting_point string, total_components long, unique_configurations long, circuit_hash string, n_visited long, n_grouped long, visited string")


def answer_by_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer for the extended net of +3V3."""
    return _said(spark, api.query_xnet_by_net_name(spark, projection.settled(spark, sf_dir), "+3V3"))


def answer_by_pin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer for the extended net of pin 1 of the first U part, asked for in lower case."""
    return _said(spark, api.query_xnet_by_pin_name(spark, projection.settled(spark, sf_dir), f"{_first_part(spark, sf_dir).lower()}.1"))


def answer_every_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers for all nets off ground, asked at once: totals, groups in their order, and visited nets."""
    net = projection.settled(spark, sf_dir)
    rows = answers.circuits(net, net.nets.where(~exprs.is_ground(F.col("net"))).select("design_id", F.col("net").alias("root")))
    said = lambda *names: F.concat_ws("/", *[F.get_json_object("body", f"$.{n}") for n in names])
    what = F.when(F.col("kind") == "totals", said("total_components", "unique_configurations", "circuit_hash")).when(F.col("kind") == "group", said("total_count", "mpn", "description", "value"))
    what = what.otherwise(F.get_json_object(F.concat(F.lit('{"net":'), "body", F.lit("}")), "$.net"))
    return rows.select("root", "kind", F.when(F.col("kind") != "visited", F.col("place")).alias("place"), what.alias("what"))


def answer_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer for a component, a pin a row."""
    answer = api.query_component(spark, projection.netlist(spark, sf_dir), _first_part(spark, sf_dir).lower())
    rows = [(answer["refdes"], answer["mpn"], answer.get("description"), answer.get("value"), bool(answer.get("dns")), pin, net) for pin, net in answer["pins"].items()]
    return spark.createDataFrame(rows, "refdes string, mpn string, description string, value string, dns boolean, pin string, net string")


#: Designs that ``answer_designs`` lists, the same in Java and RE2.
DESIGN_SEARCH = "^n|[05]$"


def answer_designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer that lists the designs of the walked fleet by a pattern, in its order, with errors in band."""
    root = drawn.planted(spark, drawn.cadence_tree(spark, sf_dir)).removeprefix("file://")
    found = api.list_designs(spark, root, DESIGN_SEARCH)
    rows = [(place, d["name"], d["path"].removeprefix(root), d.get("error")) for place, d in enumerate(found)]
    return spark.createDataFrame(rows, "place long, name string, path string, error string")


def answer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What answers say when nothing fits: whether they are errors, their error or note, and how many results they hold."""
    net, part = projection.settled(spark, sf_dir), _first_part(spark, sf_dir)
    asked = {
        "prefix": api.list_components(spark, net, " zz "),
        "no type": api.list_components(spark, net, "  "),
        "nets": api.search_nets(spark, "^none$", net),
        "pattern": api.search_nets(spark, "a(", net),
        "refdes": api.search_components_by_refdes(spark, "^none$", net),
        "mpn": api.search_components_by_mpn(spark, "^none$", net),
        "description": api.search_components_by_description(spark, "^none$", net),
        "part": api.query_component(spark, net, "none"),
        "ground": api.query_xnet_by_net_name(spark, net, "GND"),
        "net": api.query_xnet_by_net_name(spark, net, "none"),
        "pin name": api.query_xnet_by_pin_name(spark, net, "none"),
        "pin of none": api.query_xnet_by_pin_name(spark, net, "none.1"),
        "pin": api.query_xnet_by_pin_name(spark, net, f"{part}.none"),
    }
    said = lambda a: a["error"] if api.is_error(a) else a["notes"][0]
    rows = [(ask, api.is_error(a), said(a), sum(map(len, a.get("results", {}).values()))) for ask, a in asked.items()]
    return spark.createDataFrame(rows, "asked string, is_error boolean, said string, n_results long")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        altium_components, altium_component_pins, altium_net_pins, altium_xnets, altium_records, altium_record_faults, altium_parts_list,
        altium_varied_components, altium_varied_pins, altium_varied_nets, altium_owner_chains, design_source,
        discover_cadence, walk_cadence, best_data_sets, discover_altium, lookup_pin, answer_by_net, answer_by_pin, answer_every_net, answer_component,
        answer_designs, answer_edges,
    )
    return {f.__name__: f for f in every}


#: Suppliers' folders, as ``drawn.cadence_tree`` lays them out.
FLEET = """
WITH s AS (
  SELECT '/fleet/n' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS home, 'n' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS nation,
         lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS key, s_acctbal AS bal FROM supplier),
t AS (SELECT *, home || '/s' || key || '/' || CASE WHEN bal >= 0 AND bal <= 3999.99 THEN 'BOARD' || key ELSE 'out' END AS dat_dir FROM s),
sets AS (SELECT * FROM t WHERE bal <= 8000),
own AS (SELECT home || '/s' || key || '/board' || key || '.DSN' AS path, 'board' || key AS name, CASE WHEN bal <= 8000 THEN dat_dir END AS dat_dir FROM t WHERE bal >= 0)"""


#: Pins of the varied sheets, as ``drawn.varied_part`` joins them.
VARIED = """
WITH v AS (
  SELECT p_brand AS design_id, letter || p_partkey AS refdes, pin, name || p_partkey || least AS net
  FROM part, (VALUES ('R', '10', 'NetR', '_9'), ('R', '9', 'NetR', '_9'), ('U', '1', 'NetR', '_9'), ('U', 'B2', 'NetU', '_A10'), ('U', 'A10', 'NetU', '_A10'), ('U', '77', NULL, NULL)) p(letter, pin, name, least))"""


def _drawn_sql() -> dict[str, str]:
    base = f"""
WITH {oracle.BASE},
k AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS sheet_ord FROM (SELECT DISTINCT p_type FROM part)),
dp AS (SELECT p_brand AS design_id, p_brand || '/' || p_type || '.SchDoc' AS sheet, sheet_ord, p_type, c.refdes, mpn, value, comp_ord, p_name AS description
       FROM part0 JOIN comp c USING (refdes) JOIN k USING (p_type)),
dn AS (SELECT design_id, sheet, pins.refdes, pin,
              CASE WHEN starts_with(pins.refdes, 'J') THEN 'Net' || pins.refdes || '_' || pin WHEN NOT starts_with(pins.refdes, 'FB') THEN net END AS net
       FROM pins JOIN dp USING (refdes))"""
    return {
        "altium_components": f"""{base}
SELECT design_id, refdes, mpn, mpn IS NOT NULL AS mpn_present, description, p_type AS comment, value,
       row_number() OVER (PARTITION BY design_id ORDER BY sheet_ord, comp_ord) - 1 AS comp_ord FROM dp""",
        "altium_component_pins": f"{base} SELECT design_id, refdes, pin, 'IO' || pin AS pin_name, coalesce(net, 'NC') AS net FROM dn",
        "altium_net_pins": f"{base} SELECT design_id, net, refdes, pin FROM dn WHERE net IS NOT NULL",
        "altium_xnets": base.replace("WITH", "WITH RECURSIVE", 1) + f""",
an AS (SELECT DISTINCT design_id, net FROM dn WHERE net IS NOT NULL AND NOT {oracle.STOP}),
ap AS (SELECT DISTINCT design_id, refdes, net FROM dn JOIN an USING (design_id, net) WHERE {oracle.PASSIVE}),
ae AS (SELECT DISTINCT a.design_id, a.net AS s, b.net AS d FROM ap a JOIN ap b USING (design_id, refdes)),
ar AS (SELECT design_id, net, net AS other FROM an UNION SELECT ar.design_id, ar.net, ae.d FROM ar JOIN ae ON ae.design_id = ar.design_id AND ae.s = ar.other)
SELECT design_id, net, min(other) AS label FROM ar GROUP BY design_id, net""",
        "altium_records": f"""{base},
rec AS (
  SELECT design_id, sheet, unnest(['Component', 'Designator', 'Parameter', 'Parameter', 'Parameter', CASE WHEN mpn IS NOT NULL THEN 'Parameter' END, CASE WHEN starts_with(refdes, 'U') THEN 'Pin' END]) AS name FROM dp
  UNION ALL
  SELECT design_id, sheet, unnest(['Pin', CASE WHEN starts_with(refdes, 'J') OR net = 'GND' THEN 'Wire' END,
                                   CASE WHEN net IS NOT NULL AND NOT starts_with(refdes, 'J') THEN CASE WHEN net = 'GND' THEN 'Power Port' ELSE 'Net Label' END END]) FROM dn)
SELECT design_id, sheet, name, count(*) AS n, CASE WHEN name IN ('Pin', 'Designator', 'Parameter') THEN 0 ELSE count(*) END AS n_roots,
       CASE WHEN name IN ('Pin', 'Designator', 'Parameter') THEN 2 ELSE 1 END AS depth, count(*) AS n_valid
FROM rec WHERE name IS NOT NULL GROUP BY design_id, sheet, name""",
        "altium_record_faults": f"""{base},
f AS (
  SELECT design_id, sheet, 'Parameter' AS name, 'Name is missing' AS fault FROM dp
  UNION ALL SELECT design_id, sheet, 'Designator', CASE WHEN starts_with(refdes, 'J') THEN 'Text is missing' ELSE 'Name is not Designator' END FROM dp WHERE starts_with(refdes, 'J') OR starts_with(refdes, 'U')
  UNION ALL SELECT design_id, sheet, CASE WHEN net = 'GND' THEN 'Power Port' ELSE 'Net Label' END, 'Text is missing' FROM dn WHERE net IN ('GND', '+3V3'))
SELECT design_id, sheet, name, fault, count(*) AS n FROM f GROUP BY ALL""",
        "altium_varied_components": """
SELECT p_brand AS design_id, 'U' || p_partkey AS refdes, CASE p_partkey % 3 WHEN 0 THEN p_brand || '-' || p_size WHEN 1 THEN 'PN' || p_size ELSE 'MP' || p_size END AS mpn,
       p_name || CASE WHEN p_partkey % 7 = 0 THEN chr(65533) ELSE '' END AS description,
       CASE WHEN p_size % 4 IN (1, 3) THEN p_type END AS comment, CAST(p_size AS VARCHAR) AS value FROM part
UNION ALL SELECT p_brand, 'R' || p_partkey, NULL, NULL, NULL, NULL FROM part""",
        "altium_varied_pins": f"{VARIED} SELECT design_id, refdes, pin, coalesce(net, 'NC') AS net FROM v",
        "altium_varied_nets": f"""{VARIED}
SELECT design_id, net, row_number() OVER (PARTITION BY design_id ORDER BY replace(net, '_', ' ')) - 1 AS place, count(*) AS n_pins
FROM v WHERE net IS NOT NULL GROUP BY design_id, net""",
        "altium_owner_chains": f"""
SELECT p_brand AS design_id, p_brand || '/' || (p_partkey // {drawn.SHEET_KEYS}) || '.SchDoc' AS sheet, CAST(kind AS VARCHAR) AS kind, CAST(kind - 42 AS INT) AS depth, count(*) AS n
FROM part, range(44, 49) k(kind) WHERE p_partkey % 11 = 0 GROUP BY ALL""",
        "design_source": f"""
WITH {oracle.BASE},
n AS (SELECT p_brand AS design_id, net, count(*) + count(*) FILTER (pin = '1') AS n_listed, count(*) AS n_pins FROM pins JOIN part0 USING (refdes) GROUP BY ALL)
SELECT 'all' AS asked, * FROM n UNION ALL SELECT 'one', * FROM n WHERE design_id = (SELECT min(p_brand) FROM part)""",
        "altium_parts_list": f"{base} SELECT design_id, sheet, refdes, description FROM dp",
    }


def _answers_sql() -> dict[str, str]:
    first = f"first AS (SELECT arg_min(refdes, comp_ord) AS refdes, arg_min(net, comp_ord) AS net FROM pins WHERE pin = '1' AND starts_with(refdes, 'U') AND NOT {oracle.GROUND})"
    part = """'{"refdes":"' || refdes || '","mpn":' || coalesce('"' || mpn || '"', 'null') || ',"connections":[' || wiring || ']}'"""

    def said(start: str) -> str:
        return f"""{oracle.CIRCUIT},
h AS (SELECT root, substr(sha256('[' || string_agg({part}, ',' ORDER BY {oracle.NATURAL}) || ']'), 1, 16) AS circuit_hash,
      count(*) AS total_components, count(DISTINCT (k, sig)) AS unique_configurations FROM keyed GROUP BY root)
SELECT {start} AS starting_point, total_components, unique_configurations, circuit_hash, (SELECT count(*) FROM vis) AS n_visited, total_components AS n_grouped,
       (SELECT string_agg(net, ',' ORDER BY net) FROM vis) AS visited FROM h"""

    by_pin = oracle.traversal("SELECT net AS root FROM first").replace("starts AS (", f"{first},\nstarts AS (", 1)
    return {
        "lookup_pin": f"WITH {oracle.BASE}, {first} SELECT f.refdes, mpn, description, '1' AS pin, f.net FROM first f JOIN comp USING (refdes)",
        "answer_component": f"WITH {oracle.BASE}, {first.replace(" AS (", " AS MATERIALIZED (", 1)} SELECT refdes, mpn, description, value, dns, pin, p.net FROM comp JOIN (SELECT refdes FROM first) USING (refdes) JOIN pins p USING (refdes)",
        "answer_edges": f"""WITH {oracle.BASE}, {first.replace(" AS (", " AS MATERIALIZED (", 1)},
known AS (SELECT string_agg(prefix, ', ' ORDER BY prefix) AS prefixes FROM (SELECT DISTINCT regexp_extract(refdes, '^[A-Z]+') AS prefix FROM comp)),
held AS (SELECT f.refdes, string_agg(pin, ', ' ORDER BY CAST(pin AS INT)) AS numbers FROM first f JOIN pins p USING (refdes) GROUP BY f.refdes)
SELECT 'prefix' AS asked, true AS is_error, 'No components with prefix ''ZZ'' found in design ''design''. Available prefixes: [' || prefixes || ']' AS said, CAST(0 AS BIGINT) AS n_results FROM known
UNION ALL SELECT 'pin', true, 'Pin ''' || refdes || '.none'' not found. Component ' || refdes || ' has pins: [' || numbers || ']', 0 FROM held
UNION ALL SELECT * FROM (VALUES
  ('no type', true, 'Missing required parameter: type', 0),
  ('nets', false, 'No nets matched pattern ''^none$''', 0),
  ('pattern', true, 'Invalid regex pattern ''a(''', 0),
  ('refdes', false, 'No components matched refdes pattern ''^none$''', 0),
  ('mpn', false, '{api.BROADER.format("^none$").replace("'", "''")}', 0),
  ('description', false, '{api.BROADER.format("^none$").replace("'", "''")}', 0),
  ('part', true, 'Component ''none'' not found in design ''design''. Use list_components() or search_components_by_refdes() to find available components.', 0),
  ('ground', true, 'GND is a ground net and cannot be queried.', 0),
  ('net', true, 'Net ''none'' not found in design ''design''. Use search_nets() to find available nets.', 0),
  ('pin name', true, 'Invalid pin name ''none''. Expected ''REFDES.PIN''.', 0),
  ('pin of none', true, 'Component ''none'' not found in design ''design''. Use list_components() or search_components_by_refdes() to find available components.', 0))""",
        "answer_every_net": oracle.traversal(f"SELECT net AS root FROM nets WHERE NOT {oracle.GROUND}") + f"""{oracle.CIRCUIT},
h AS (SELECT root, substr(sha256('[' || string_agg({part}, ',' ORDER BY {oracle.NATURAL}) || ']'), 1, 16) AS circuit_hash,
      count(*) AS total_components, count(DISTINCT (k, sig)) AS unique_configurations FROM keyed GROUP BY root),
g AS (SELECT root, k, sig, mpn, arg_min(description, ({oracle.NATURAL})) AS description, arg_min(value, ({oracle.NATURAL})) AS value, count(*) AS n, min(row(letters, digits)) AS first
      FROM keyed GROUP BY root, k, mpn, sig)
SELECT root, 'totals' AS kind, 0 AS place, coalesce(total_components, 0) || '/' || coalesce(unique_configurations, 0) || '/' || coalesce(circuit_hash, '{"0" * 16}') AS what
FROM (SELECT DISTINCT root FROM vis) LEFT JOIN h USING (root)
UNION ALL SELECT root, 'group', row_number() OVER (PARTITION BY root ORDER BY n DESC, first, sig) - 1, concat_ws('/', n, mpn, description, value) FROM g
UNION ALL SELECT root, 'visited', NULL, net FROM vis""",
        "answer_by_net": oracle.traversal("SELECT '+3V3' AS root") + said("'+3V3'"),
        "answer_by_pin": by_pin + said("(SELECT refdes || '.1' FROM first)"),
    }


def oracle_sql() -> dict[str, str]:
    sql = _drawn_sql() | _answers_sql() | {
        "discover_cadence": f"""{FLEET},
top AS (SELECT home || '/' || nation || '.cpm' AS path, nation AS name, min(CASE WHEN bal < 0 THEN dat_dir END) AS dat_dir FROM t GROUP BY home, nation),
d AS (SELECT *, 'cadence-cis' AS format FROM own UNION ALL SELECT *, 'cadence-hdl' FROM top)
SELECT name, format, path, dat_dir || '/pstxnet.dat' AS pstxnet, dat_dir || '/PSTXPRT.DAT' AS pstxprt, dat_dir || '/pstchip.dat' AS pstchip,
       CASE WHEN dat_dir IS NULL THEN '{listing.NOT_EXPORTED}' END AS error FROM d""",
        "best_data_sets": f"""{FLEET}
SELECT path, dat_dir FROM own WHERE dat_dir IS NOT NULL
UNION ALL SELECT home || '/' || nation || '.cpm', min(dat_dir) FROM sets GROUP BY home, nation""",
        "discover_altium": """
WITH s AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS key, s_acctbal AS bal FROM supplier),
p AS (SELECT 'p' || key AS name, '/pcb/s' || key AS dir, key, bal FROM s)
SELECT name, 'altium' AS format, dir || '/' || name || '.PrjPcb' AS path,
       CASE WHEN bal < 0 THEN '' WHEN bal < 4000 OR bal >= 8000 THEN dir || '/sub/top.SchDoc' ELSE '/pcb/s' || key || '/sub/top.SchDoc,/pcb/shared/b' || key || '.SchDoc' END AS sheets,
       CASE WHEN bal < 0 THEN 'No schematic documents found for project ''' || name || '''.' END AS error FROM p""",
    }
    listed = f"SELECT row_number() OVER (ORDER BY name, path) - 1 AS place, name, path, error FROM ({sql['discover_cadence']}) WHERE regexp_matches(name, '{DESIGN_SEARCH}')"
    return sql | {"walk_cadence": sql["discover_cadence"], "answer_designs": listed}
