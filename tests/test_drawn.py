"""Sheets are drawn a part at a time."""

import tracemalloc

from copperline.plans import drawn
from copperline.sources import writer
from copperline.sources.ole import CompoundFile

DATA = "/root/testdata/sf0.001"


def test_a_sheet_asks_for_its_parts_as_it_draws_them():
    asked = []

    def parts():
        for k in range(50):
            asked.append(k)
            yield {"refdes": f"U{k}", "mpn": None, "name": "n", "size": "3", "pins": [{"pin": "2", "net": "GND"}, {"pin": "1", "net": "N1"}]}

    rows = drawn.drawn_records("LARGE", parts())
    first = next(rows)
    assert asked == [0] and first["RECORD"] == "1"
    every = [first, *rows]
    owners = {r["OwnerIndex"] for r in every if "OwnerIndex" in r}
    assert owners == {str(k) for k, r in enumerate(every) if r["RECORD"] == "1"}
    assert writer.sheet(iter(every)) == writer.sheet(every)


def test_a_large_sheet_takes_little_more_than_twice_its_file():
    rows = [{"RECORD": "41", "OwnerIndex": "0", "Text": f"{k:09d}" * 6} for k in range(80_000)]
    tracemalloc.start()
    made = writer.sheet(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(made) > 5 << 20 and peak < 2.6 * len(made)  # with sectors that were copied: over 3.5 times
    assert b"".join(CompoundFile(made).pieces("FileHeader")).rstrip(b"\0") == writer.stream([{"HEADER": "Protel for Windows"}, *rows]).rstrip(b"\0")


def test_sheets_are_read_where_they_are_drawn(spark):
    rows = drawn.altium_records(spark, DATA)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "binary" not in plan and "content" not in plan
    part = spark.read.parquet(f"{DATA}/part.parquet")
    got = rows.where("kind = '1'").groupBy("design_id", "sheet").count().collect()
    assert {(r.design_id, r.sheet, r["count"]) for r in got} == {(r.p_brand, f"{r.p_brand}/{r.p_type}.SchDoc", r["count"]) for r in part.groupBy("p_brand", "p_type").count().collect()}
    said = rows.where("kind = '34'").selectExpr("sheet", "idx", "cast(regexp_extract(props['Text'], '[0-9]+$', 0) as long) AS key").orderBy("sheet", "idx").collect()
    together = [(a.key, b.key) for a, b in zip(said, said[1:], strict=False) if a.sheet == b.sheet]
    assert together and all(a < b for a, b in together)
