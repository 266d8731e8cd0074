"""Rules, costing, inventory, profiles, schema checks, mapping, files and merging."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerprep import fixed_values as fv
from ledgerprep.functions.numbers import as_timestamp, exact_sum, number_text, parse_number, whole_months, with_dates
from ledgerprep.operators import (
    costing, entity, industrial, inventory, mapping, merge, ordered, profile, quarantine, readiness, schema,
)
from ledgerprep.plans.cleanse import Options
from ledgerprep.plans.premigration import merge_duplicates, readiness_table, run_premigration, write_package
from ledgerprep.sources import sinks
from ledgerprep.sources.csv import detect_dialect, read_table, rejected_records
from ledgerprep.sources.sinks import MANIFEST, read_package


def rows(df, key="row_id"):
    return [r.asDict() for r in df.orderBy(key).collect()]


def test_material_rules(table):
    df = table({
        "MATERIAL": ["M1", "M2", "M3", "M4", "M5"], "MAT_TYPE": ["ROH", "FERT", "HALB", "ZXYZ", "roh"],
        "BASE_UOM": ["PC", "KG", "XXX", "PC", "PC"], "PRICE_CTRL": ["S", "V", "X", "S", " s "],
        "PRICE": ["120.50", "0.0", "15", "invalid", "2e7"], "NET_WEIGHT": ["1.5", "-0.5", "10", "", "1"],
        "UNIT_OF_WEIGHT": ["KG", "G", "", "", None],
    })
    found = industrial.apply_rules(df, fv.MATERIAL_MASTER, findings=True)
    got = rows(found)
    assert [r["IND_VALID"] for r in got] == [True, False, False, False, True]
    assert got[1]["IND_ERROR"] == "ERROR: Peso neto negativo: -0.5 | WARN: Precio del material es 0.0 (Posible falta de valoración)"
    assert got[2]["IND_ERROR"].split(" | ") == [
        "ERROR: Peso neto indicado pero falta unidad de peso (UNIT_OF_WEIGHT)",
        "ERROR: Control de precio 'X' incorrecto (Debe ser S o V)",
        "WARN: Unidad de medida base 'XXX' no estándar en SAP",
    ]
    assert "Precio estándar de ROH inusualmente alto: 20000000.0" in got[4]["IND_ERROR"]
    assert "Unidad de peso 'NAN' no estándar" in got[4]["IND_ERROR"]
    total = industrial.rule_summary(found, fv.MATERIAL_MASTER).first()
    assert (total["industrial_errors"], total["rows_in_error"]) == (4, 3)


def test_bom_rules(table):
    n = 51
    df = table({
        "MATERIAL_PARENT": ["P001"] * n + ["P002", " P001 "], "COMPONENT": [f"C{i}" for i in range(n + 2)],
        "QUANTITY": ["2.0"] * n + ["0.0", "9999"], "UOM": ["PC"] * (n + 2),
    })
    found = industrial.apply_rules(df, fv.BILL_OF_MATERIALS, findings=True)
    got = rows(found)
    assert got[0]["IND_ERROR"] == "WARN: BOM Compleja: El material padre 'P001' tiene 51 componentes."
    assert got[n]["IND_ERROR"] == "ERROR: Cantidad de componente menor o igual a cero: 0.0"
    assert "extremadamente alta: 9999.0" in got[n + 1]["IND_ERROR"] and "BOM Compleja" in got[n + 1]["IND_ERROR"]
    assert industrial.rule_summary(found, fv.BILL_OF_MATERIALS).first()["complex_boms"] == n + 1


def test_routing_and_cost_center_rules(table):
    df = table({
        "WORK_CENTER": ["WC01", "", "WC02", None], "SETUP_TIME": ["10", "5", "0", "-1"],
        "MACHINE_TIME": ["20", "0", "x", "10"], "LABOR_TIME": ["5", "0", "5", "-5"],
    })
    found = industrial.apply_rules(df, fv.ROUTING, findings=True)
    got = [r["IND_ERROR"] for r in rows(found)]
    assert got[0] == "" and "WORK_CENTER" in got[1] and "WARN: Ambos tiempos" in got[1]
    assert "SETUP_TIME crítico" in got[2] and "máquina no es un valor" in got[2]
    assert "preparación negativo: -1.0" in got[3] and "mano de obra negativo" in got[3] and "WORK_CENTER" not in got[3]
    assert industrial.rule_summary(found, fv.ROUTING).first()["zero_setup_routes"] == 1
    df = table({
        "VALID_FROM": ["20260101", "2026.01.01", "x"], "VALID_TO": ["31.12.9999"] * 3,
        "PERSON_IN_CHARGE": ["Ann", "", "-"], "FUNCTIONAL_AREA": ["A", "A", ""], "HIERARCHY_GROUP": ["H", "H", " "],
    })
    got = rows(industrial.apply_rules(df, fv.COST_CENTER))
    assert [r["IND_VALID"] for r in got] == [True, False, False]
    assert "inicio '2026.01.01'" in got[1]["IND_ERROR"] and got[2]["IND_ERROR"].count("ERROR:") == 3


def test_standard_cost(table):
    bom = table({"MATERIAL_PARENT": ["M001", "M001", "M001", None], "COMPONENT": ["C001", "C002", "C9", "C001"], "QUANTITY": ["2.0", "1,5", "1", "7"]})
    routing = table({"MATERIAL": ["M001"], "SETUP_TIME": ["0.1"], "MACHINE_TIME": ["0.2"], "LABOR_TIME": ["0.3"]})
    master = table({"MATERIAL": ["C001", "C002", "M001", None], "PRICE": ["10.0", "20.0", "55.0", "3"]})
    got = {r["MATERIAL"]: r for r in costing.classify_deviation(costing.standard_cost(master, bom, routing, 10.0)).collect()}
    m = got["M001"]
    assert (m["COST_BOM"], m["COST_LOADED"], m["DEV_STATUS"], m["DEV_DIRECTION"]) == (50.0, 55.0, "OK", "undervalued")
    assert m["COST_ROUTING"] == pytest.approx(6.0) and m["DEVIATION_PCT"] == pytest.approx(1.7857, abs=1e-4)
    assert got["C001"]["DEVIATION_PCT"] == 100.0 and got[None]["COST_LOADED"] == 3.0 and len(got) == 4
    missing = costing.unpriced_summary(bom, master).first()
    assert (missing["unpriced_components"], missing["sample"]) == (1, "C9")
    only = costing.standard_cost(master, None, bom).first()
    assert only["COST_BOM"] == 0.0


def test_duplicate_master_rows_fan_out(table):
    bom = table({"MATERIAL_PARENT": ["A"], "COMPONENT": ["C"], "QUANTITY": ["2"]})
    master = table({"MATERIAL": ["C", "C", "A", "A"], "PRICE": ["1", "10", "5", "6"]})
    got = costing.standard_cost(master, bom).where("MATERIAL = 'A'").collect()
    assert sorted(r["COST_LOADED"] for r in got) == [5.0, 6.0] and {r["COST_BOM"] for r in got} == {22.0}


def test_margin_impact(spark):
    cost = spark.createDataFrame(
        [("M1", 56.0, 55.0, 1.0, 1.78), ("M2", 56.0, 62.0, 6.0, 10.71), ("M3", 56.0, 56.0, 0.0, 0.0)],
        "MATERIAL string, COST_TOTAL_CALC double, COST_LOADED double, DEVIATION_ABS double, DEVIATION_PCT double",
    )
    got = costing.costing_kpis(costing.classify_deviation(cost)).first()
    assert (got["total_overvaluation"], got["total_undervaluation"], got["pct_with_deviation"]) == (6.0, 1.0, 66.67)
    assert (got["cost_deviations_ok"], got["cost_deviations_warning"], got["cost_deviations_error"]) == (2, 1, 0)


def test_inventory(table):
    df = table({
        "MATERIAL": ["M1", "M2", "M3", "M4"], "UNRESTRICTED_STOCK": ["100.5", "-5.0", "50", "x"],
        "BLOCKED_STOCK": ["0", "0", "-2,5", "10"], "QUALITY_STOCK": ["0"] * 4, "BASE_UOM": ["g", "TON", "PC", "KG"],
        "STANDARD_PRICE": ["100", "100", "100", "0"], "MOVING_AVG_PRICE": ["100", "85", "70", "1"],
        "LAST_MOVEMENT_DATE": ["30.01.2020", "20231215", "junk", "2021-12-31"], "TOTAL_VALUE": ["800", "150", "50", None],
    })
    assert [r["MATERIAL"] for r in rows(inventory.negative_stock(df))] == ["M2", "M3"]
    old = rows(inventory.obsolete_stock(df, "2024-02-29", 24))
    assert [(r["MATERIAL"], r["MONTHS_INACTIVE"]) for r in old] == [("M1", 49), ("M4", 26)]
    flagged = rows(inventory.price_discrepancies(df))
    assert [(r["MATERIAL"], r["PRICE_DISC_STATUS"]) for r in flagged] == [("M2", "WARNING"), ("M3", "ERROR")]
    enriched = inventory.enrich(df, "row_id")
    got = rows(enriched)
    assert [r["ABC_CLASS"] for r in got] == ["A", "B", "C", "C"]
    assert [(r["STOCK_STANDARDIZED"], r["STOCK_UNIT_STANDARDIZED"]) for r in got] == [
        (0.1005, "KG"), (-5000.0, "KG"), (50.0, "PC"), (None, "KG"),
    ]
    kpis = inventory.health_kpis(enriched, "2024-02-29").first()
    assert tuple(kpis) == (2, 2, 2, 1, 1, 2, 2)
    classes = {r["ABC_CLASS"]: r for r in inventory.abc_summary(enriched).collect()}
    assert (classes["A"]["count"], classes["A"]["pct_items"], classes["A"]["pct_value"]) == (1, 25.0, 80.0)


@pytest.mark.parametrize(
    "values, want",
    [(["900", "50", "50"], "ABC"), (["0", "0"], "CC"), (["x", None], "CC"), (["10", "10", "10", "10", "10"], "AAAAC"), (["100"], "A")],
)
def test_abc_edges(table, values, want):
    df = table({"TOTAL_VALUE": values})
    assert "".join(r["ABC_CLASS"] for r in rows(inventory.classify_abc(df, "row_id"))) == want


def test_running_sum_over_slices_equals_one_window(spark):
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("g"), (F.hash("id") % 5).cast("long").alias("v"))
    order = [F.desc("v"), F.asc("id")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    placed = ordered.place(df, order, ["g"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert placed.select(ordered.SLICE).distinct().count() > 1
    got = {r["id"]: r["t"] for r in ordered.running_sum(placed, F.col("v"), order, "t", ["g"]).collect()}
    total, want = {}, {}
    for r in sorted(df.collect(), key=lambda r: (r["g"], -r["v"], r["id"])):
        total[r["g"]] = total.get(r["g"], 0) + r["v"]
        want[r["id"]] = total[r["g"]]
    assert got == want


def test_numbers_and_dates(table):
    cases = {
        "1.5": (1.5, "1.5"), "-2,5": (-2.5, "-2.5"), "1 000,5": (1000.5, "1000.5"), "1.234,56": (None, None), "1.0d": (None, None),
        "1_000": (1000.0, "1000.0"), "nan": (None, None), "-inf": (float("-inf"), "-inf"), ".5": (0.5, "0.5"), "": (None, None),
        "12345678.25": (12345678.25, "12345678.25"), "1e16": (1e16, "1e+16"), "1e-5": (1e-5, "1e-05"), "0.0005": (0.0005, "0.0005"), "\t7\n": (7.0, "7.0"),
    }
    df = table({"V": list(cases)}).withColumn("n", parse_number(F.col("V"))).withColumn("t", F.expr(number_text("n")))
    assert {r["V"]: (r["n"], r["t"]) for r in df.collect()} == cases
    dates = {
        "2024-1-5": "2024-01-05", "2024-01-05T10:11:12": "2024-01-05", "1.2.2024": "2024-02-01", "20240131": "2024-01-31",
        "31/12/2024": "2024-12-31", "12/31/2024": "2024-12-31", "05/06/2024": "2024-06-05", "05-06-2024": "2024-05-06", "junk": None,
        "20249999": None, "5 Jan 2024": "2024-01-05", " 2024/02/03 ": "2024-02-03", "30.02.2024": None, "2024-01-05 10:11": "2024-01-05",
    }
    df = with_dates(table({"V": list(dates)}), {"d": F.col("V")})
    assert {r["V"]: r["d"] and r["d"].strftime("%Y-%m-%d") for r in df.collect()} == dates
    pairs = [("2023-01-30", "2023-02-28", 1), ("2023-02-28", "2023-03-27", 0), ("2022-03-15", "2024-03-15", 24), ("2024-01-31", "2024-02-28", 0)]
    for day, until, months in pairs:
        one = table({"D": [day]}).select(whole_months(as_timestamp(day), as_timestamp(until)).alias("m"))
        assert one.first()["m"] == months


def test_cost_is_equal_however_rows_are_split(spark):
    master = spark.range(40).selectExpr("concat('M', id) AS MATERIAL", "string(round(rand(3) * 90, 2)) AS PRICE")
    rows = spark.range(4000).selectExpr(
        "concat('M', id % 3) AS MATERIAL_PARENT", "concat('M', id % 39) AS COMPONENT", "string(rand(5) * pow(10, id % 7)) AS QUANTITY"
    ).collect()
    times = spark.range(4000).selectExpr(
        "concat('M', id % 3) AS MATERIAL", "string(rand(7)) AS SETUP_TIME", "string(rand(8) * 1e6) AS MACHINE_TIME", "'0.1' AS LABOR_TIME"
    ).collect()
    prices = master.collect()
    seen = set()
    for parts in (1, 2, 3, 7, 16):
        split = [spark.createDataFrame(sorted(r, key=lambda x: hash((parts, x)))).repartition(parts) for r in (prices, rows, times)]
        cost = costing.standard_cost(*split)
        impact = costing.margin_impact(cost).first()
        seen.add((tuple(sorted(map(tuple, cost.collect()))), tuple(impact)))
    assert len(seen) == 1


def test_sums_beyond_decimals(spark):
    def total(*values):
        return spark.createDataFrame([(v,) for v in values], "v double").agg(exact_sum(F.col("v"))).first()[0]

    assert total(0.1, 0.2, None) == 0.3
    assert total() is None and total(None) is None
    assert total(1e30, 1.5) == 1e30 and total(1e30) == 1e30
    assert total(float("inf"), 1.0) == float("inf")


@pytest.mark.parametrize("collide", [False, True])
def test_copies_of_rows(spark, monkeypatch, collide):
    if collide:
        monkeypatch.setattr(profile, "_fingerprint", lambda df: [F.lit(7).cast("long"), F.lit(7).cast("long")])
    rows = [(None, "a", 0.0), ("a", None, 0.0), (None, "a", -0.0), ("a", None, float("nan")), ("a", None, float("nan")), ("", "a", 0.0), (None, None, None)]
    df = spark.createDataFrame(rows * 3, "`_1` string, `x.y` string, `_word` double").repartition(5)
    assert tuple(profile.duplicate_rows(df).first()) == (21, 21 - 5)
    assert tuple(profile.duplicate_rows(df.distinct()).first()) == (5, 0)
    assert tuple(profile.duplicate_rows(df.limit(0)).first()) == (0, 0)


def test_unique_rows_stay_where_they_are(spark):
    df = spark.range(20_000).selectExpr("id", "repeat(string(id), 50) AS long_text")
    both = df.unionByName(df.where("id < 10"))
    assert tuple(profile.duplicate_rows(both).first()) == (20_010, 10)
    assert 20 <= profile._suspects(both).count() < 40


def test_profile(table):
    df = table({
        "A": ["1", "2", "1", None], "B": ["Texto", "Otro", "Texto", "Más"], "C": ["", "2026-06-02", "", "2026-06-03"],
        "D": ["01", "2", "01", "3"], "E": ["1.5", "2", "1.5", "nan"], "F": [" "] * 4, "G": ["20240101", "2024-01-02", "20240101", "1.2.2024"],
    }, row_id=False)
    whole, columns = profile.table_profile(df)
    assert tuple(whole.first()) == (4, 1, 7)
    got = {r["column"]: (r["null_count"], r["null_percentage"], r["inferred_type"]) for r in columns.collect()}
    assert got == {
        "A": (1, 25.0, "integer"), "B": (0, 0.0, "text"), "C": (2, 50.0, "datetime"), "D": (0, 0.0, "numeric_str (leads 0)"),
        "E": (1, 25.0, "decimal"), "F": (4, 100.0, "empty"), "G": (0, 0.0, "datetime"),
    }


def test_types_of_odd_cells(table):
    cells = {"integer": ["+5", "-7", "12"], "decimal": ["1", "2.5"], "text": ["20240131", "1-2"]}
    odd = [
        ("5\x7f", "text"), ("\x005", "text"), (" 5 ", "integer"), ("1_000", "integer"), ("1.0", "integer"), ("12.50", "decimal"),
        ("007", "numeric_str (leads 0)"), ("20240131", "integer"), ("2024-01-31", "datetime"),
        ("/5", "text"), ("1e3", "integer"), ("--5", "text"), ("+", "text"), ("31.01.2024", "datetime"), ("12345678", "integer"),
    ]
    df = table({f"c{i}": [text, text] for i, (text, _) in enumerate(odd)}, row_id=False)
    got = {r["column"]: r["inferred_type"] for r in profile.type_profile(df).collect()}
    assert [(text, got[f"c{i}"]) for i, (text, _) in enumerate(odd)] == odd
    for kind, texts in cells.items():
        assert profile.type_profile(table({"c": texts}, row_id=False)).first()["inferred_type"] == kind
    mixed = table({"c": ["20240131", "2024-01-31", "\t20240131"]}, row_id=False)
    assert profile.type_profile(mixed).first()["inferred_type"] == "datetime"


def test_schema(table):
    rules = schema.read_schema(json.dumps({"columns": {
        "ID": {"required": True, "nullable": False, "type": "int"}, "NAME": {"required": True, "nullable": False, "type": "str"},
        "GONE": {"required": True}, "RATE": {"type": "float"},
    }}))
    good = table({"ID": ["1", "2.0"], "NAME": ["a", "b"], "GONE": ["x", "y"], "RATE": ["1.5", None]})
    assert schema.schema_violations(good, rules, "row_id").count() == 0
    bad = table({"ID": ["1", "x", "y"] + ["1"] * 12, "NAME": ["a", "  ", None] + ["nan"] * 12, "RATE": ["1", "1,5", "z"] + ["2"] * 12})
    got = {(r["check"], r["column"]): r for r in schema.schema_violations(bad, rules, "row_id").collect()}
    assert set(got) == {("missing_column", "GONE"), ("not_null", "NAME"), ("type_int", "ID"), ("type_float", "RATE")}
    assert got["not_null", "NAME"]["violations"] == 14 and got["not_null", "NAME"]["rows"] == list(range(2, 12))
    assert (got["type_int", "ID"]["rows"], got["type_int", "ID"]["value"]) == ([2], "x")


def test_mapping(table):
    df = table({"NAME": ["a", None, ""], "X": ["-", "y", None], "Z": ["1"] * 3})
    out = mapping.map_columns(df, {"NAME": "CUSTOMER", "X": "VAT", "NO": "NONE"}, ["CUSTOMER", "VAT", "CUR"], {"VAT": "?", "CUR": "EUR"}, carry=["row_id"])
    assert [tuple(r.values()) for r in rows(out)] == [(0, "a", "?", "EUR"), (1, "-", "y", "EUR"), (2, "", "?", "EUR")]
    assert "Z" in mapping.map_columns(df, {"NAME": "CUSTOMER"}, keep_unmapped=True).columns
    staged = mapping.staging_projection(table({"QUANTITY": [" 2 ", None], "COMPONENT": ["c", "d"]}), fv.BILL_OF_MATERIALS)
    assert [tuple(r) for r in staged.collect()] == [("", "c", "2", ""), ("", "d", "", "")]


def test_dialects_and_reading(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("ID;NOMBRE;VALOR\n1;España;100\n2;Colón €;N/A\n".encode("cp1252"))
    (tmp_path / "b.csv").write_bytes("﻿ID,NOMBRE\n3,\"Muñoz, S.A.\"\n".encode())
    (tmp_path / "c.csv").write_bytes(("ID;NOMBRE;VALOR\n4;" + "ñ" * 6000 + ";1\n").encode())
    got = {r["ID"]: r for r in read_table(spark, str(tmp_path)).collect()}
    assert got["1"]["NOMBRE"] == "España" and got["2"]["NOMBRE"] == "Colón €" and got["2"]["VALOR"] is None
    assert got["3"]["NOMBRE"] == "Muñoz, S.A." and got["3"]["VALOR"] is None and got["4"]["NOMBRE"] == "ñ" * 6000
    assert detect_dialect(b"a|b|c;d\n").separator == "|" and detect_dialect(b"plain\n").separator == ","


def test_files_without_silent_loss(spark, tmp_path):
    wide = ";".join(f"A_COLUMN_NAME_OF_MORE_THAN_FORTY_LETTERS_IN_ALL_{i}" for i in range(250))
    texts = {
        "late.csv": ("ID;NAME\n" + "1;plain\n" * 3000 + "2;MUÑOZ\n").encode("cp1252"),
        "lines.csv": 'ID;NAME;V\n1;"two\nlines";5\n2;"a ""q""; b";6\n3;short\n'.encode(),
        "wide.csv": f"{wide}\n{wide}\n".encode(), "surplus.csv": b'ID;NAME\n1;a;b\n2;c\n3;"x;y";"z\nw"\n4;"p;q"\n',
        "header.csv": b'ID,"NA\nME"\n1,2\n', "empty.csv": b"",
    }
    for name, content in texts.items():
        (tmp_path / name).write_bytes(content)
    at = lambda name: str(tmp_path / name)
    assert [r["NAME"] for r in read_table(spark, at("late.csv")).where("ID = 2").collect()] == ["MUÑOZ"]
    assert [tuple(r) for r in read_table(spark, at("lines.csv")).orderBy("ID").collect()] == [
        ("1", "two\nlines", "5"), ("2", 'a "q"; b', "6"), ("3", "short", None)
    ]
    assert list(read_table(spark, at("wide.csv")).first()) == wide.split(";")
    with pytest.raises(Exception, match="more fields than the header"):
        read_table(spark, at("surplus.csv")).select("ID").collect()
    assert read_table(spark, at("surplus.csv"), surplus="skip").count() == 2
    assert {r["record"] for r in rejected_records(spark, at("surplus.csv")).collect()} == {"1;a;b", '3;"x;y";"z\nw"'}
    assert read_table(spark, [at("header.csv"), at("empty.csv")]).columns == ["ID", "NA\nME"]


def test_dates_of_any_length(spark):
    texts = {
        "2024-01-05T10:11:12.5": "2024-01-05 10:11:12", "2024-01-05T10:11:12Z": "2024-01-05 10:11:12",
        "2024-01-05 00:00:00.000": "2024-01-05 00:00:00", "2024-01-05T10:11+02:00": "2024-01-05 10:11:00",
        "5 January 2024": "2024-01-05 00:00:00", "Jan 5, 2024": "2024-01-05 00:00:00", "5-feb-2023": "2023-02-05 00:00:00",
        "December 31st, 2023": "2023-12-31 00:00:00", "1/2/24": "2024-01-02 00:00:00", "13/2/24": "2024-02-13 00:00:00",
        "5 Janvier 2024": None, "2024-13-05T10:11:12Z": None, "x" * 5000: None, "31 June 2024": None,
    }
    df = with_dates(spark.createDataFrame([(t,) for t in texts], "t string"), {"d": F.col("t")})
    assert {r["t"]: r["d"] for r in df.select("t", F.date_format("d", "yyyy-MM-dd HH:mm:ss").alias("d")).collect()} == texts


def test_amounts_that_are_no_exact_numbers(spark):
    df = spark.createDataFrame([(1, "1e25"), (2, "inf"), (3, "5"), (4, None), (5, "1e40"), (6, "x")], "id long, TOTAL_VALUE string")
    assert {r["id"]: r["ABC_CLASS"] for r in inventory.classify_abc(df, "id").collect()} == {1: "A", 2: "C", 3: "C", 4: "C", 5: "C", 6: "C"}
    assert sorted(r["id"] for r in inventory.unreadable_amounts(df).collect()) == [2, 5, 6]


def members_of(spark, *groups):
    """Members table from (group, row, type) triples, ranked in the given order."""
    data = [(g, r, t, 100.0, "", (0 if t == "primary" else 1, 0, 0, 0, r)) for g, r, t in groups]
    return spark.createDataFrame(
        data, "group_id long, row_id long, match_type string, score double, value string, "
        "rank_key struct<section:int,via:long,kind:int,anchor:long,row:long>",
    )


def test_merge_policies(spark, table):
    df = table({
        "NAME": ["Empresa A", "Empresa A", "Empresa B", "Empresa B", "Solo"], "PHONE": ["-", "600", None, "nan", "700"],
        "IBAN": ["bad", "good", "x", "", "z"], "IBAN_ERROR": ["wrong", "", "e", "f", ""], "STREET": ["", "CALLE SOL", "a", "b", "c"],
        "STREET_TIPO_VIA": ["", "CALLE", "", "", ""], "STREET_NOMBRE_VIA": ["", "SOL", "a", "b", "c"], "STREET_NUMERO": ["", "S/N", "", "", ""],
        "STREET_PISO": [""] * 5,
    }).withColumn("IBAN_VALID", F.col("row_id").isin(1, 4))
    members = members_of(spark, (0, 0, "primary"), (0, 1, "tax_id"), (2, 2, "primary"), (2, 3, "tax_id"))
    merged = rows(merge.apply_policies(df, members, "row_id"))
    assert [r["row_id"] for r in merged] == [0, 2, 4] and merge.merged_away(members).first()[0] == 2
    first = merged[0]
    assert (first["PHONE"], first["IBAN"], first["IBAN_VALID"], first["IBAN_ERROR"]) == ("600", "good", True, "")
    assert (first["STREET"], first["STREET_TIPO_VIA"], first["STREET_NOMBRE_VIA"]) == ("CALLE SOL", "CALLE", "SOL")
    assert (merged[1]["PHONE"], merged[1]["IBAN"], merged[1]["IBAN_VALID"]) == (None, "x", False)
    for policy, kept in (("keep_primary", [0, 2, 4]), ("keep_first", [0, 2, 4]), ("keep_last", [1, 3, 4]), ("no_merge", [0, 1, 2, 3, 4])):
        assert [r["row_id"] for r in rows(merge.apply_policies(df, members, "row_id", policy))] == kept
    table_of = spark.createDataFrame([(0, "keep_last")], "group_id long, policy string")
    assert [r["row_id"] for r in rows(merge.apply_policies(df, members, "row_id", "merge", table_of))] == [1, 2, 4]


def test_plain_reasons_and_impact(spark, table):
    df = table({"M": ["Longitud incorrecta: 3", "Dígito de control incorrecto", "Código postal fuera del rango", "algo", ""]})
    got = [r["p"][:9] for r in rows(df.withColumn("p", quarantine.plain_reason(F.col("M"))))]
    assert got == ["El número", "La letra ", "El código", "algo", ""]
    names = ["tax_id_fixes", "postal_code_fixes", "iban_fixes", "province_fixes", "bic_fixes", "address_fixes", "phone_fixes", "duplicates_merged", "iban_errors", "processed_rows", "valid_rows"]
    kpis = spark.createDataFrame([(1, 2, 1, 1, 1, 1, 1, 1, 2, 4, 3), (0,) * 9 + (4, 3)], ", ".join(f"{n} long" for n in names))
    assert {tuple(r) for r in readiness.impact(kpis).collect()} == {(1.3, 300, 75.0), (0.1, 0, 75.0)}


def test_premigration_package(spark, table, tmp_path):
    types = {"PARTNER_ID": "text", "NAME": "text", "TAX_ID": "tax_id"}
    df = table({
        "ID": ["1", "2", "3", "4"], "NOMBRE": ["Aceros Sur S.A.", "aceros sur", "Otra", "Mala"],
        "CIF": ["12345678Z", "12345678Z", "11111111H", "bad"],
    })
    options = Options(types, mapping={"ID": "PARTNER_ID", "NOMBRE": "NAME", "CIF": "TAX_ID"}, template=fv.BUSINESS_PARTNER, row_id="row_id", dedup_column="NAME")
    master = table({"MATERIAL": ["A"], "PRICE": ["5"]})
    stock = table({"MATERIAL": ["A", "B"], "UNRESTRICTED_STOCK": ["-1", "2"], "TOTAL_VALUE": ["1", "2"]})
    result = run_premigration(df, options, master=master, stock=stock)
    assert merge_duplicates(result).count() == 2
    score = readiness_table(result, merged=True).first()
    assert (score["total_records"], score["rejected_records"], score["duplicate_groups"], score["records_affected"]) == (3, 1, 1, 2)
    assert score["critical_issues"] == 2 and score["readiness_score"] == pytest.approx(77.8)
    folder = str(tmp_path / "package")
    write_package(result, folder, merged=True)
    assert read_table(spark, f"{folder}/clean").count() == 2
    assert read_table(spark, f"{folder}/rejected").first()["MOTIVO_RECHAZO"].startswith("Longitud incorrecta")
    assert read_table(spark, f"{folder}/staging").columns == list(fv.TEMPLATES[fv.BUSINESS_PARTNER])
    assert spark.read.parquet(f"{folder}/audit").where("step = 'quarantine'").first()["row_count"] == 1
    assert spark.read.json(f"{folder}/duplicates").count() == 2 and read_table(spark, f"{folder}/inventory").count() == 2
    tables = read_package(spark, folder)
    assert set(tables) == {"clean", "rejected", "audit", "readiness", "staging", "duplicates", "inventory", "costing"}
    assert tables["clean"].count() == 2 and tables["staging"].count() == 2
    with pytest.raises(FileExistsError):
        write_package(result, folder, merged=True)
    next(Path(f"{folder}/clean").glob("part-*")).write_text("cut off")
    with pytest.raises(OSError, match="clean"):
        read_package(spark, folder)


def test_package_of_an_ended_run_is_not_read(spark, table, tmp_path, monkeypatch):
    df = table({"PARTNER_ID": ["1", "2"], "NAME": ["Aceros", "Otra"], "TAX_ID": ["12345678Z", "bad"]})
    options = Options({"PARTNER_ID": "text", "NAME": "text", "TAX_ID": "tax_id"}, template=fv.BUSINESS_PARTNER, row_id="row_id")
    result, folder = run_premigration(df, options), str(tmp_path / "package")
    write_package(result, folder)
    counted = json.loads((tmp_path / "package" / MANIFEST).read_text())["tables"]
    assert {n: t["rows"] for n, t in counted.items()} == {"clean": 1, "rejected": 1, "audit": result.audit.count(), "readiness": 1, "staging": 1}

    def ended(*_):
        raise RuntimeError("ended")

    monkeypatch.setattr(sinks, "write_audit", ended)
    with pytest.raises(RuntimeError):
        write_package(result, folder, mode="overwrite")
    with pytest.raises(FileNotFoundError, match="no finished package"):
        read_package(spark, folder)


def test_empty_quarantine_keeps_its_header(spark, table, tmp_path):
    from ledgerprep.sources.sinks import write_quarantine

    write_quarantine(table({"NAME": ["a"], "TAX_ID": ["b"]}).where("false"), str(tmp_path / "r"))
    back = read_table(spark, str(tmp_path / "r"))
    assert back.columns == ["row_id", "NAME", "TAX_ID"] and back.count() == 0


def test_hot_key_and_name(spark):
    """A third of the rows share one key and a third one name: results stay whole."""
    df = spark.range(3000).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("UNO "), F.col("id"))).when(F.col("id") % 3 == 1, F.lit("ACEROS HOT")).otherwise(
            F.concat(F.lit("Z"), F.sha1(F.col("id").cast("string")))
        ).alias("N"),
        F.when(F.col("id") % 3 == 0, F.lit("A1234567")).alias("T"),
    )
    members = entity.find_duplicates(df, "row_id", "N", tax_id="T")
    sizes = {r["group_id"]: r["count"] for r in members.groupBy("group_id").count().collect()}
    assert sizes == {0: 1000, 1: 1000}


def test_side_tables_of_a_package_are_computed_once(spark, table, tmp_path):
    seen = {name: spark.sparkContext.accumulator(0) for name in ("bom", "stock")}

    def counted(name):
        def add(x):
            seen[name].add(1)
            return x

        return F.udf(add, "string").asNondeterministic()

    master = table({"MATERIAL": ["A", "B"], "PRICE": ["10", "3"]}, row_id=False)
    bom = table({"MATERIAL_PARENT": ["A", "A"], "COMPONENT": ["B", "C"], "QUANTITY": ["2", "1"]}, row_id=False)
    stock = table({"MATERIAL": ["A", "B", "C"], "TOTAL_VALUE": ["100", "20", "3"]})
    bom = bom.withColumn("QUANTITY", counted("bom")("QUANTITY"))
    stock = stock.withColumn("TOTAL_VALUE", counted("stock")("TOTAL_VALUE"))
    result = run_premigration(table({"N": ["a", "b"]}), Options({"N": "text"}, row_id="row_id"), master, bom, None, stock, "row_id")
    write_package(result, str(tmp_path / "package"))
    assert {name: n.value for name, n in seen.items()} == {"bom": 2, "stock": 3}
    tables = read_package(spark, str(tmp_path / "package"))
    assert {r["MATERIAL"]: float(r["COST_BOM"]) for r in tables["costing"].collect()} == {"A": 6.0, "B": 0.0}
    assert {r["MATERIAL"]: r["ABC_CLASS"] for r in tables["inventory"].collect()} == {"A": "A", "B": "C", "C": "C"}
