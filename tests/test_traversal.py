"""Extended nets, grouping and hashes on literal netlists."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from copperline import api
from copperline.operators import components as parts
from copperline.operators import grouping, matching, xnet
from copperline.plans.netlist import from_rows


def design(spark, components, nets=None):
    content = {"components": {r: {"pins": p} if "pins" not in p else p for r, p in components.items()}}
    return from_rows(spark, {"d": content | ({"nets": nets} if nets else {})})


def shown(spark, net, start, **options):
    seen = xnet.reach(net, xnet.starts_of(spark, [("d", start)]), **options)
    pins = {(r.refdes, r.pin, r.net) for r in xnet.circuit_pins(net, seen, **options).collect()}
    return pins, {r.net for r in seen.collect()}


#: A ladder of passives with a branch through a connector, a tap on a rail and a part on one net twice.
LADDER = {
    "L7": {"1": "IN_F", "2": "MID_F"},
    "FB2": {"1": "MID_F", "2": "OUT_F"},
    "C31": {"1": "MID_F", "2": "AGND"},
    "C32": {"1": "AGND", "2": "FAR"},
    "R90": {"1": "OUT_F", "2": "VCC_1V8", "3": "SENSE"},
    "R91": {"1": "VCC_1V8", "2": "FAR"},
    "J4": {"1": "SENSE", "2": "FAR"},
    "R92": {"1": "LOOP", "2": "LOOP"},
}
CASES = [
    (LADDER, "IN_F", {"L7", "FB2", "C31", "R90", "J4"}, {"IN_F", "MID_F", "OUT_F", "AGND", "VCC_1V8", "SENSE"}),
    (LADDER, "VCC_1V8", {"L7", "FB2", "C31", "C32", "R90", "R91", "J4"}, {"VCC_1V8", "OUT_F", "SENSE", "MID_F", "IN_F", "AGND", "FAR"}),
    (LADDER, "FAR", {"C32", "R91", "J4"}, {"FAR", "AGND", "VCC_1V8"}),
    (LADDER, "LOOP", {"R92"}, {"LOOP"}),
    (LADDER, "ELSEWHERE", set(), set()),
]


@pytest.mark.parametrize(("components", "start", "refs", "visited"), CASES)
def test_reach(spark, components, start, refs, visited):
    pins, nets = shown(spark, design(spark, components), start)
    assert {p[0] for p in pins} == refs
    assert nets == visited


def test_actives_show_only_the_pins_on_the_net(spark):
    bridge = {"Q3": {"G": "DRIVE", "D": "COIL", "S": "AGND"}, "FB2": {"A": "COIL", "B": "SUPPLY"}, "J8": {"7": "SUPPLY", "8": "DRIVE", "9": "COIL"}}
    pins, nets = shown(spark, design(spark, bridge), "COIL")
    assert pins == {("Q3", "D", "COIL"), ("J8", "9", "COIL"), ("FB2", "A", "COIL"), ("FB2", "B", "SUPPLY"), ("J8", "7", "SUPPLY")}
    assert nets == {"COIL", "SUPPLY"}


def test_skipping_and_do_not_stuff(spark):
    net = design(spark, {"C1": {"1": "N", "2": "A"}, "C2": {"1": "N", "2": "B"}, "R1": {"1": "N", "2": "C"}, "C3": {"mpn": "X DNP", "pins": {"1": "N", "2": "D"}}})
    pins, nets = shown(spark, net, "N", skip_types=["c"])
    assert {p[0] for p in pins} == {"R1"} and nets == {"N", "C"}
    seen = xnet.reach(net, xnet.starts_of(spark, [("d", "N")]), ["c"])
    assert [(r.skip_type, r.n) for r in xnet.skipped_counts(net, seen, ["c"]).collect()] == [("C", 2)]
    assert {p[0] for p in shown(spark, net, "N", include_dns=True)[0]} == {"C1", "C2", "C3", "R1"}


def test_unknown_refdes_on_a_net_is_shown_without_properties(spark):
    net = design(spark, {"R1": {"1": "A", "2": "B"}}, {"A": {"R1": ["1"], "@X.Y": ["7"]}, "B": {"R1": ["2"]}})
    pins, _ = shown(spark, net, "A")
    assert ("@X.Y", "7", "A") in pins


def model(components, start, stop):
    """Queue-free model of a traversal: expand the start and every other net that is no stop net."""
    on = {}
    for r, pins in components.items():
        for p, n in pins.items():
            on.setdefault(n, []).append((r, p))
    done, todo, visited, out = set(), [start], {start}, set()
    while todo:
        n = todo.pop()
        if n in done:
            continue
        done.add(n)
        for r, p in on.get(n, ()):
            out.add((r, p, n))
            if r[0] in "RCL":
                for q, m in components[r].items():
                    out.add((r, q, m))
                    visited.add(m)
                    if not stop(m):
                        todo.append(m)
    return out, visited


def test_frontier_and_labels_agree_with_a_model(spark):
    rng = random.Random(5)
    nets = ["GND", "+3V3", *[f"N{k}" for k in range(14)]]
    components = {f"{rng.choice('RCLUJ')}{k}": {str(p): rng.choice(nets) for p in range(1, rng.randint(2, 5))} for k in range(22)}
    net = design(spark, components)
    names = sorted({n for p in components.values() for n in p.values()})
    seen = xnet.reach(net, xnet.starts_of(spark, [("d", n) for n in names]))
    pins = {}
    for r in xnet.circuit_pins(net, seen).collect():
        pins.setdefault(r.root, set()).add((r.refdes, r.pin, r.net))
    visited = {}
    for r in seen.collect():
        visited.setdefault(r.root, set()).add(r.net)
    stop = lambda n: n in ("GND", "+3V3")
    for n in names:
        assert (pins[n], visited[n]) == model(components, n, stop)
    label = {r.net: r.label for r in xnet.closures(net).collect()}
    for n in names:
        if not stop(n):
            assert label[n] == min(m for m in visited[n] if not stop(m))


def test_grouping_by_part_number(spark):
    net = design(spark, {"R2": {"mpn": "A", "pins": {}, "value": " "}, "R10": {"mpn": " A ", "pins": {}, "value": "5"}, "R1": {"mpn": None, "pins": {}}, "R3": {"mpn": " ", "pins": {}}, "R4": {"mpn": "A", "comment": "DNP", "pins": {}}})
    answer = api.list_components(spark, net, "r")
    assert [(g["mpn"], g["refdes"], g["count"]) for g in answer["components"]] == [(None, "R1", 1), (None, "R3", 1), ("A", ["R2", "R10"], 2)]
    assert answer["components"][2]["value"] == "5" and "notes" in answer["components"][0]
    assert len(api.list_components(spark, net, "R", include_dns=True)["components"]) == 4


def test_orientations(spark):
    net = design(spark, {"R1": {"mpn": "X", "pins": {"1": "A", "2": "B"}}, "R2": {"mpn": "X", "pins": {"1": "B", "2": "A"}}, "R3": {"mpn": "X", "pins": {"1": "B", "2": "A"}}, "U1": {"pins": {"1": "A"}}})
    answer = api.query_xnet_by_net_name(spark, net, "A")
    group = answer["components_by_mpn"][0]
    assert group["total_count"] == 3 and [(o["count"], o["refdes"]) for o in group["orientations"]] == [(2, ["R2", "R3"]), (1, "R1")]
    assert answer["components_by_mpn"][1] == {"mpn": None, "total_count": 1, "notes": [api.exprs.MPN_MISSING_NOTE], "refdes": "U1", "connections": [{"net": "A", "pins": "1"}]}
    assert answer["total_components"] == 4 and answer["unique_configurations"] == 2 and set(answer["visited_nets"]) == {"A", "B"}


def test_hash_is_of_compact_json_in_natural_order(spark):
    net = design(spark, {"R10": {"mpn": None, "pins": {"1": "A", "2": "B"}}, "R2": {"mpn": "X", "pins": {"2": "A", "1": "+5V"}}, "U1": {"pins": {"10": "A", "9": "A"}}})
    text = '[{"refdes":"R2","mpn":"X","connections":[{"pins":["1"],"net":"+5V"},{"pins":["2"],"net":"A"}]},{"refdes":"R10","mpn":null,"connections":[{"pins":["1"],"net":"A"},{"pins":["2"],"net":"B"}]},{"refdes":"U1","connections":[{"pins":["9","10"],"net":"A"}]}]'
    assert api.query_xnet_by_net_name(spark, net, "A")["circuit_hash"] == hashlib.sha256(text.encode()).hexdigest()[:16]
    assert api.query_xnet_by_net_name(spark, net, "B")["circuit_hash"] == hashlib.sha256(text.encode()).hexdigest()[:16]


def test_empty_circuit(spark):
    net = design(spark, {"R1": {"mpn": "DNP", "pins": {"1": "A"}}})
    answer = api.query_xnet_by_net_name(spark, net, "A")
    assert answer == {"starting_point": "A", "total_components": 0, "unique_configurations": 0, "components_by_mpn": [], "visited_nets": ["A"], "circuit_hash": "0" * 16}


def test_greedy_matches_the_sequential_rule(spark):
    rng = random.Random(2)
    rows = [("x", f"d{a}", f"s{b}", rng.randint(0, 4)) for a in range(12) for b in range(9) if rng.random() < 0.5]
    taken_d, taken_s, expected = set(), set(), set()
    for _, d, s, score in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if d not in taken_d and s not in taken_s:
            taken_d.add(d)
            taken_s.add(s)
            expected.add((d, s, score))
    got = matching.greedy(spark.createDataFrame(rows, "g string, design string, data_set string, score int"), ["g"])
    assert {(r.design, r.data_set, r.score) for r in got.collect()} == expected


def test_find_and_describe(spark):
    net = design(spark, {"U1": {"mpn": " M ", "comment": " c ", "pins": {"A1": "N1", "10": ("CLK", "N2"), "2": ""}}}).normalised()
    assert api.query_component(spark, net, " u1 ") == {"refdes": "U1", "mpn": "M", "pins": {"2": "NC", "10": {"name": "CLK", "net": "N2"}, "A1": "N1"}, "comment": " c "}
    assert parts.find_pin(net, "u1", "a1").first().net == "N1"
    assert api.query_component(spark, net, "U9")["error"].startswith("Component 'U9' not found in design 'design'.")


def test_pin_questions(spark):
    net = design(spark, {"U1": {"pins": {"1": "", "2": "GND", "3": "S", "10": "T"}}, "R1": {"pins": {"1": "S", "2": "GND"}}}).normalised()
    ask = lambda p: api.query_xnet_by_pin_name(spark, net, p)
    assert ask("U1")["error"] == "Invalid pin name 'U1'. Expected 'REFDES.PIN'."
    assert ask("u1.9")["error"] == "Pin 'u1.9' not found. Component U1 has pins: [1, 2, 3, 10]"
    assert ask("U1.2")["error"] == "Pin U1.2 is connected to GND (ground) and cannot be queried."
    assert ask("u1.1") == {"starting_point": "U1.1", "net": "NC", "total_components": 0, "unique_configurations": 0, "components_by_mpn": [], "visited_nets": ["NC"], "circuit_hash": "nc-U1.1"}
    assert ask("X.1")["error"].startswith("Component 'X' not found")
    answer = ask(" u1 . 3 ")
    assert answer["starting_point"] == "U1.3" and answer["total_components"] == 2
    assert api.query_xnet_by_net_name(spark, net, "GND")["error"] == "GND is a ground net and cannot be queried."
    assert "not found in design" in api.query_xnet_by_net_name(spark, net, "gnd")["error"]


def test_searches_and_their_notes(spark):
    net = design(spark, {"U1": {"mpn": "STM32", "pins": {"1": "SDA"}}, "u2": {"pins": {"1": "scl"}}})
    assert api.search_nets(spark, "^S", net) == {"results": {"design": ["SDA"]}}
    assert api.search_nets(spark, "zz", net) == {"results": {"design": []}, "notes": ["No nets matched pattern 'zz'"]}
    assert api.search_nets(spark, "(", net) == {"error": "Invalid regex pattern '('"}
    assert api.search_nets(spark, "(?i)s", net) == {"error": "Invalid regex pattern '(?i)s'"}
    assert [g["refdes"] for g in api.search_components_by_refdes(spark, "U", net)["results"]["design"]] == ["u2", "U1"]
    assert api.search_components_by_mpn(spark, "stm", net)["results"]["design"][0]["mpn"] == "STM32"
    assert "Try a broader pattern" in api.search_components_by_mpn(spark, "nrf", net)["notes"][0]
    assert api.search_components_by_description(spark, "x", net)["notes"] == [api.NO_DESCRIPTION]
    assert api.list_components(spark, net, " ") == {"error": "Missing required parameter: type"}
    assert api.list_components(spark, net, "q")["error"] == "No components with prefix 'Q' found in design 'design'. Available prefixes: [U]"
    assert api.list_nets(spark, net) == {"nets": ["scl", "SDA"]}


def test_export_is_not_run():
    assert api.is_error(api.export_cadence_netlist("/x.dsn")) and "only available on Windows" in api.export_cadence_netlist("/x.dsn")["error"]
    assert api.bash_path("C:\\a\\b") == "/c/a/b"


def test_installed_versions(tmp_path):
    for v in ("17.2", "16.6", "9.0"):
        for f in ("tools/bin/pstswp.exe", "tools/capture/allegro.cfg"):
            p = tmp_path / f"SPB_{v}" / f
            p.parent.mkdir(parents=True, exist_ok=True)
            p.touch()
    (tmp_path / "SPB_18.0").mkdir()
    assert [x["version"] for x in api.detect_cadence_versions(str(tmp_path))] == ["17.2", "16.6", "9.0"]
    assert api.latest_cadence(str(tmp_path / "none")) is None


def test_written_tables_read_back(spark, tmp_path):
    net = design(spark, {"R1": {"pins": {"1": "A", "2": "B"}}})
    net.write(f"file://{tmp_path}/n")
    again = type(net).read(spark, f"file://{tmp_path}/n").design("d")
    assert again.component_pins.count() == 2 and again.nets.where(F.col("net") == "A").count() == 1


def test_circuit_grouping_orders_by_first_pin(spark):
    pins = spark.createDataFrame([("d", "U1", p, n) for p, n in (("10", "A"), ("2", "B"), ("9", "A"))], "design_id string, refdes string, pin string, net string")
    rows = pins.selectExpr("*", "string(null) mpn", "false mpn_present", "string(null) description", "string(null) comment", "string(null) value", "boolean(null) dns")
    got = grouping.circuit_components(rows, ["design_id"]).first().connections
    assert [(c.net, c.pins) for c in got] == [("B", ["2"]), ("A", ["9", "10"])]
