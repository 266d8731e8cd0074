"""Cleaning rules and the cleaning run, with the literal cases they must satisfy."""

from pyspark.sql import functions as F

from ledgerprep import fixed_values as fv
from ledgerprep.functions.identifiers import bic_error
from ledgerprep.functions.text import alphanumeric_code
from ledgerprep.operators.cleansing import RULES, Rule
from ledgerprep.plans.cleanse import ROW_ID, Options, dry_run, run_cleansing
from ledgerprep.streaming.stateless import start_cleansing


def clean(table, semantic, values):
    rows = run_cleansing(table({"C": values}), Options({"C": semantic}, row_id="row_id"))
    both = rows.marked.orderBy(ROW_ID).collect()
    return [r.asDict() for r in both]


def test_text(table):
    got = clean(table, "text", ["  hello   world  ", "N/A", "null", None, "a b\x1cc"])
    assert [r["C"] for r in got] == ["HELLO WORLD", "-", "-", "-", "A B C"]
    got = clean(table, "something else", [" valid  text ", "NaN"])
    assert [r["C"] for r in got] == ["valid text", "-"]


def test_tax_id(table):
    cases = [
        ("12345678Z", "12345678Z", ""), (" 12345678-z ", "12345678Z", ""),
        ("X1234567L", "X1234567L", ""), ("b-64.613.201", "B64613201", ""),
        ("12345678A", "12345678A", "Dígito de control incorrecto. Esperado 'Z', recibido 'A'"),
        ("B64613202", "B64613202", "Dígito de control de CIF debe ser el número '1'"),
        ("P64613201", "P64613201", "Dígito de control de CIF debe ser la letra 'A'"),
        ("C64613209", "C64613209", "Dígito de control de CIF incorrecto. Esperado '1' o 'A'"),
        ("C6461320A", "C6461320A", ""),
        ("123", "123", "Longitud incorrecta: 3 caracteres (deben ser 9)"),
        ("1234A678Z", "1234A678Z", "NIF con caracteres no numéricos en la parte central"),
        ("X12A4567L", "X12A4567L", "NIE con caracteres no numéricos en la parte central"),
        ("B12A45678", "B12A45678", "CIF con caracteres no numéricos en la parte central"),
        ("I12345678", "I12345678", "Tipo de Tax ID no identificado o prefijo 'I' inválido"),
        (None, "-", "Valor vacío o no válido"), ("-", "-", "Valor vacío o no válido"),
    ]
    got = clean(table, "tax_id", [value for value, _, _ in cases])
    for r, (_, cleaned, error) in zip(got, cases):
        assert (r["C"], r["C_ERROR"], r["C_VALID"]) == (cleaned, error, error == "")


def iban_is_valid(code):
    digits = "".join(str(int(ch, 36)) for ch in code[4:] + code[:4])
    return int(digits) % 97 == 1


def test_iban(table):
    values = [
        "ES91 2100 0418 4502 0005 1332", "ES92 2100 0418 4502 0005 1332", "ES91", "GB82WEST12345698765432",
        "MT84MALT011000012345MTLCAST001S", "1291210004184502", "ES00_IBAN_INVALIDO_8888", "",
    ]
    got = clean(table, "iban", values)
    assert [r["C_VALID"] for r in got] == [True, False, False, True, True, False, False, False]
    assert got[0]["C"] == "ES9121000418450200051332"
    assert got[1]["C_ERROR"].startswith("Algoritmo de control (Módulo 97)")
    assert got[2]["C_ERROR"] == "Longitud incorrecta: 4 caracteres (debe estar entre 15 y 34)"
    assert got[5]["C_ERROR"] == "El IBAN debe comenzar con un código de país de 2 letras"
    assert got[6]["C_ERROR"] == "Longitud incorrecta para país ES: 20 (deberían ser 24)"
    many = [f"XK{i % 97:02d}{i * 7919:014d}AZ{i}" for i in range(300)]
    for r in clean(table, "iban", many):
        assert r["C_VALID"] == iban_is_valid(r["C"])


def test_phone_postal_bic(table):
    got = clean(table, "phone", ["662384698", "93-123 45 67", "0033123456789", "+33 1", "-", None, "123"])
    assert [r["C"] for r in got] == ["+34662384698", "+34931234567", "+33123456789", "+331", "-", "-", "+34123"]
    got = clean(table, "postal_code", ["08770", "8770", "99999", "08A70", "123", None])
    assert [(r["C"], r["C_VALID"]) for r in got] == [
        ("08770", True), ("08770", True), ("99999", False), ("00870", False), ("123", False), ("-", False),
    ]
    assert got[2]["C_ERROR"] == "Código postal fuera del rango de España (01000 - 52999)"
    got = clean(table, "bic", ["DEUTDEDB", "deut-dedb axx", "DEUTD", "12UTDEDB"])
    assert [r["C_VALID"] for r in got] == [True, True, False, False]
    code = alphanumeric_code(F.col("V"))
    rows = table({"V": ["DEUTDEDB"] * 2, "K": ["DE", "es91"]}).orderBy("row_id")
    errors = [r[0] for r in rows.select(bic_error(code, F.col("K"))).collect()]
    assert errors[0] == "" and "Discrepancia" in errors[1]


def test_address(table):
    cases = [
        ("C/ Gran Vía 45, 3º B", ("CALLE", "GRAN VÍA", "45", "3º B")),
        ("Av. Diagonal, 640, 4-A", ("AVENIDA", "DIAGONAL", "640", "4-A")),
        ("Plaza Mayor S/N", ("PLAZA", "MAYOR", "S/N", "")),
        ("Carretera de Barcelona 12 Bis", ("CARRETERA", "DE BARCELONA", "12 BIS", "")),
        ("Carrer Balmes 99, 1-1", ("CALLE", "BALMES", "99", "1-1")),
        ("Pº de Gracia 5 2A", ("PASEO", "DE GRACIA", "5", "2A")),
        ("Joan Sala", ("", "JOAN SALA", "S/N", "")), ("-", ("", "", "", "")), (None, ("", "", "", "")),
        ("Calle Sol, bajo", ("CALLE", "SOL, BAJO", "S/N", "")),
        ("A45 Ronda 7", ("", "A45 RONDA", "7", "")),
    ]
    got = clean(table, "address", [value for value, _ in cases])
    for r, (_, parts) in zip(got, cases):
        assert tuple(r[f"C{s}"] for s in ("_TIPO_VIA", "_NOMBRE_VIA", "_NUMERO", "_PISO")) == parts


def test_cross_checks(table):
    df = table({
        "CODIGO_POSTAL": ["8770", "28080"], "PROVINCIA": ["MADRID", "MADRID"],
        "IBAN": ["ES9121000418450200051332"] * 2, "BIC": ["DEUTDEDB", "DEUTESDB"],
    })
    types = {"CODIGO_POSTAL": "postal_code", "PROVINCIA": "province", "IBAN": "iban", "BIC": "bic"}
    result = run_cleansing(df, Options(types, row_id="row_id"))
    a, b = result.accepted.orderBy(ROW_ID).collect()
    assert (a["CODIGO_POSTAL"], a["PROVINCIA"], b["PROVINCIA"]) == ("08770", "BARCELONA", "MADRID")
    assert a["BIC_ERROR"] == "Discrepancia de país: BIC 'DE' vs IBAN 'ES'"
    assert (a["BIC_VALID"], b["BIC_VALID"]) == (False, True)
    kpis = result.kpis.first()
    assert (kpis["provinces_repaired"], kpis["bank_discrepancies"], kpis["bic_errors"]) == (1, 1, 0)
    assert kpis["postal_code_fixes"] == 1


BP = {
    "PARTNER_ID": "text", "NAME": "text", "TAX_ID": "tax_id", "POSTAL_CODE": "postal_code",
    "PROVINCE": "province", "COUNTRY": "text", "STREET": "address",
}


def test_template_limits_and_required_fields(table):
    df = table({
        "PARTNER_ID": ["BP001", "BP002"], "NAME": ["A" * 90, "Empresa"], "TAX_ID": ["12345678Z", "-"],
        "POSTAL_CODE": ["08770", ""], "PROVINCE": ["BARCELONA"] * 2, "COUNTRY": ["ES"] * 2,
        "STREET": ["Calle Industria 10"] * 2,
    })
    result = run_cleansing(df, Options(BP, row_id="row_id"))
    (ok,) = result.accepted.collect()
    assert ok["NAME"] == "A" * 80 and not ok["NAME_SAP_VALID"]
    assert ok["NAME_SAP_ERROR"] == "Valor truncado de 90 a 80 caracteres"
    (bad,) = result.rejected.collect()
    assert not bad["TAX_ID_SAP_VALID"] and "obligatorio" in bad["POSTAL_CODE_SAP_ERROR"]
    assert bad["CAMPO_AFECTADO"] == "TAX_ID"
    assert bad["MOTIVO_RECHAZO"] == "Campo obligatorio en SAP vacío"


def test_quarantine_and_dry_run(table):
    df = table({"NAME": ["A", "B", "C", "D"], "TAX_ID": ["12345678Z", "INVALID_NIF", "11111111H", "11111111H"]})
    options = Options({"NAME": "text", "TAX_ID": "tax_id", "GONE": "text"}, row_id="row_id")
    result = run_cleansing(df, options)
    kpis = result.kpis.first()
    assert (kpis["processed_rows"], kpis["valid_rows"], kpis["rejected_rows"]) == (4, 3, 1)
    assert kpis["rejection_rate"] == 25.0 and kpis["text"] == 4
    (bad,) = result.rejected.collect()
    assert bad["TAX_ID"] == "INVALIDNIF" and bad["SUGERENCIA"] == "Revisar el formato del TAX_ID."
    steps = {(r["level"], r["step"]): r["row_count"] for r in result.audit.collect()}
    assert steps[("WARNING", "quarantine")] == 1 and ("WARNING", "cleanse") in steps
    lines = dry_run(df, options, rows=3).orderBy("Fila").collect()
    assert [r["Estado"] for r in lines] == ["Válido", "Rechazado (TAX_ID)", "Válido"]
    assert lines[1]["TAX_ID (Origen)"] == "INVALID_NIF" and lines[1]["TAX_ID (Limpio)"] == "INVALIDNIF"


def test_empty_and_null_tables(table):
    options = Options({"NAME": "text", "TAX_ID": "tax_id"}, row_id="row_id")
    nothing = run_cleansing(table({"NAME": ["x"], "TAX_ID": ["y"]}).where("false"), options)
    assert nothing.accepted.count() == 0
    assert nothing.kpis.first()["rejection_rate"] == 0.0
    nulls = run_cleansing(table({"NAME": [None, None], "TAX_ID": [None, None]}), options)
    assert (nulls.accepted.count(), nulls.rejected.count()) == (0, 2)


def test_numbers_as_input(spark):
    df = spark.createDataFrame([(0, 12345.0, 8001), (1, 99.99, 28080)], "row_id long, NAME double, POSTAL_CODE int")
    rows = run_cleansing(df, Options({"NAME": "text", "POSTAL_CODE": "postal_code"}, row_id="row_id"))
    assert [(r["NAME"], r["POSTAL_CODE"]) for r in rows.accepted.orderBy(ROW_ID).collect()] == [
        ("12345.0", "08001"), ("99.99", "28080"),
    ]


def test_rule_without_result_is_a_fault(table):
    """A rule that gives null keeps the raw cell, marks it wrong and rejects a strict type."""
    sound = RULES["tax_id"]
    broken = Rule(lambda c: F.when(c != "87654321X", sound.tidy(c)), reason=sound.reason)
    df = table({"NAME": ["Empresa A", "Empresa B"], "TAX_ID": ["12345678Z", "87654321X"]})
    result = run_cleansing(
        df, Options({"NAME": "text", "TAX_ID": "tax_id"}, row_id="row_id", rules={"tax_id": broken})
    )
    assert (result.accepted.count(), result.rejected.count()) == (1, 1)
    (fault,) = result.faults.collect()
    assert (fault["column"], fault["row_id"], fault["value"], fault["strict"]) == ("TAX_ID", 1, "87654321X", True)
    (bad,) = result.rejected.collect()
    assert bad["TAX_ID"] == "87654321X" and bad["MOTIVO_RECHAZO"].startswith("Error inesperado")


def test_stateless_steps_run_on_a_stream(spark, table, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    table({"NAME": [" a ", "b"], "TAX_ID": ["12345678Z", "bad"]}).write.parquet(source)
    stream = spark.readStream.schema("row_id long, NAME string, TAX_ID string").parquet(source)
    options = Options({"NAME": "text", "TAX_ID": "tax_id"}, row_id="row_id")
    query = start_cleansing(stream, options, sink, str(tmp_path / "state"))
    query.awaitTermination(60)
    got = {r["NAME"]: r["_REJECTED"] for r in spark.read.parquet(sink).collect()}
    assert got == {"A": "false", "B": "true"}


def test_province_list():
    assert len(fv.PROVINCES) == 52 and fv.PROVINCES[27] == "MADRID" and fv.PROVINCES[7] == "BARCELONA"


def test_rows_of_one_task_are_dealt_before_they_are_judged(spark, table):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = table({"C": [str(i) for i in range(200)]}).coalesce(1)
        marked = run_cleansing(rows, Options({"C": "text"}, row_id="row_id")).marked
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(marked.inputFiles()) > 1
    assert sorted(r[0] for r in marked.select("C").collect()) == sorted(map(str, range(200)))
