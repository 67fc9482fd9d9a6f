import math

import pytest

from kelvara.functions import units as U
from kelvara.operators import records
from kelvara.session import cut_lineage

NAMES = [("conductivity", "Теплопроводность; λ", "Вт/(м·К)"), ("thickness", "Толщина; δ; Толщина слоя", "мм"), ("temperature", "Температура; tн", "°C")]
SCHEMA = "table_id bigint, title string, headers array<string>, rows array<array<string>>, raw_text string, extra string"


def load(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    names = spark.createDataFrame(NAMES, "quantity string, names string, common_unit string")
    loaded = cut_lineage(records.load_tables(df, names))
    return loaded, records.table_values(loaded)


@pytest.mark.parametrize(
    "cell, want",
    [
        ("12,5", ("value", 12.5, 12.5, None)), ("10 041", ("value", 10041.0, 10041.0, None)), ("1.234,5", ("value", 1234.5, 1234.5, None)), ("−3 °F", ("value", -3.0, -3.0, "°F")), ("2,57·10^1", ("value", 25.7, 25.7, None)),
        ("1,72E+01 мм", ("value", 17.2, 17.2, "мм")), ("1 – 2", ("value", 1.0, 2.0, None)), ("1...2 m", ("value", 1.0, 2.0, "m")), ("2 ± 0,5", ("value", 1.5, 2.5, None)), ("≥ 3", ("value", 3.0, None, None)),
        ("не более 3 мм", ("value", None, 3.0, "мм")), ("", ("missing",)), (" — ", ("missing",)), ("н/д", ("missing",)), ("#Н/Д", ("bad",)), ("да", ("bad",)), ("8,8,93", ("bad",)), ("--5", ("bad",)), ("32.,9", ("bad",)), ("371О kgf/cm²", ("bad",)), ("27,О3", ("bad",)), (None, ("missing",)),
    ],
)
def test_values(cell, want):
    got = U.read_value(cell)
    assert got[0] == want[0]
    if len(want) > 1:
        assert got[3] == want[3]
        for a, b in zip(got[1:3], want[1:3]):
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b))


def test_alias_dictionary(spark):
    seen = [
        ("thickness", "mm"), ("thickness", "ММ."), ("thickness", "см"), ("conductivity", "мВт/(м*К)"), ("conductivity", "милливаттах на метр-кельвин"), ("conductivity", "W/(m K)"), ("temperature", "град. F"), ("thickness", "попугаев"),
        ("thickness", None), ("thickness", ""), ("thickness", "x" * 500),
    ]
    got = {(r.quantity, r.spelling): r.unit for r in U.alias_dictionary(spark, spark.createDataFrame(seen, "quantity string, spelling string")).collect()}
    assert got == {
        ("thickness", "mm"): "mm", ("thickness", "ММ."): "mm", ("thickness", "см"): "cm", ("conductivity", "мВт/(м*К)"): "mW/(m·K)", ("conductivity", "милливаттах на метр-кельвин"): "mW/(m·K)", ("conductivity", "W/(m K)"): "W/(m·K)",
        ("temperature", "град. F"): "°F",
    }


def test_common_units_are_the_tables_first():
    assert {q: U.common_unit(q) for q in ("thickness", "temperature", "heat_flow")} == {"thickness": "mm", "temperature": "°C", "heat_flow": "W"}
    assert math.isclose((32 + U.units()["temperature", "°F"][1]) * U.units()["temperature", "°F"][0], 0, abs_tol=1e-9)


def test_faults_and_reasons(spark):
    raw = 'Имя;Толщина, мм\n"a ""q""";5\n"b" c;5\n"d;5\ne\nf;5;6\ng;да\nh;-5\ni;\nПримечание: нет'
    loaded, values = load(spark, [(1, None, ["Имя", "Толщина, мм"], None, raw, "x"), (2, None, None, None, None, None)])
    got = {(r.row_no, r.reason) for r in records.faulty_records(loaded, values).collect()}
    assert got == {(1, "quoting"), (2, "quoting"), (3, "column_count"), (4, "column_count"), (5, "value"), (6, "value")}
    cells = {(r.row_no, r.header): r.cell for r in records.sound_cells(loaded, values).collect()}
    assert cells == {(0, "Имя"): 'a "q"', (0, "Толщина, мм"): "5", (7, "Имя"): "i", (7, "Толщина, мм"): ""}


def test_delimiters_and_rows_without_raw_text(spark):
    rows = [
        (1, None, None, None, "| Имя | δ |\n|---|---|\n| a | 5 |\n| b | 5 | 6 |", None), (2, None, None, None, "Имя\tδ\na \"b\t5", None), (3, None, None, None, "Имя  δ\na b    5\nc", None),
        (4, None, ["Имя", "δ"], [["a", '"1', '5"'], ["b", "2"]], None, None), (5, None, ["Имя", "δ"], [["a", "1"], ["b"]], None, None), (6, None, [], [], None, None), (7, None, ["δ"], None, "", None),
    ]
    loaded, values = load(spark, rows)
    got = {(r.table_id, r.row_no, r.reason) for r in records.faulty_records(loaded, values).collect()}
    assert got == {(1, 1, "column_count"), (3, 1, "column_count"), (5, 1, "column_count")}
    lo = {(r.table_id, r.row_no): r.lo for r in values.where("state = 'value'").collect()}
    assert lo[(4, 0)] == 1.5 and lo[(4, 1)] == 2.0 and lo[(2, 0)] == 5.0


def test_units_by_nearest_statement(spark):
    rows = [
        (1, "Таблица 1 (λ, мВт/(м·К))", ["λ", "Толщина, см"], [["40", "1"], ["0,04 Вт/(м·К)", "5 мм"]], None, None),
        (2, None, ["δ", "tн"], None, "δ;tн\n1;300\nПримечание. Значения столбца «tн» даны в К.", None), (3, None, ["Температура, K"], [["-5"], ["273,15"]], None, None), (3, None, ["Температура, K"], [["-5"], ["273,15"]], None, None),
    ]
    _, values = load(spark, rows)
    got = {(r.table_id, r.row_no, r.col_no): (r.state, r.unit, None if r.lo is None else round(r.lo, 4)) for r in values.collect()}
    assert got[(1, 0, 0)] == ("value", "mW/(m·K)", 0.04) and got[(1, 1, 0)] == ("value", "W/(m·K)", 0.04)
    assert got[(1, 0, 1)] == ("value", "cm", 10.0) and got[(1, 1, 1)] == ("value", "mm", 5.0)
    assert got[(2, 0, 0)] == ("value", "mm", 1.0) and got[(2, 0, 1)] == ("value", "K", 26.85)
    assert got[(3, 0, 0)][0] == "bad" and got[(3, 1, 0)] == ("value", "K", 0.0)


def test_materials(spark):
    rows = [
        (1, "Плита", 40.0, "cat_05", None), (2, "Плита, λ в Вт/(м·К)", 0.04, "cat_05", None), (3, "Плита", 0.04, None, "плотность по паспорту, кг/м³"), (4, "Плита", 40.0, "cat_01 ([мВт/(м·К)])", None),
        (5, "Плита", None, "cat_05", None), (6, "Плита", 1.0, "нет", "Lambda in kcal/(m·h·°C)"),
        (7, "Плита", 40.0, None, "Теплопроводность в мВт/м·К"),
    ]
    m = spark.createDataFrame(rows, "material_id bigint, name string, lambda_value double, source string, remark string")
    s = spark.createDataFrame([("cat_05", "All lambda values are in mW/(m·K)."), ("cat_01", None)], "source string, about string")
    got = {r.material_id: (r.unit, r.is_common, round(r.lambda_common, 4)) for r in records.material_values(m, s).collect()}
    assert got == {1: ("mW/(m·K)", False, 0.04), 2: ("W/(m·K)", True, 0.04), 3: ("W/(m·K)", True, 0.04), 4: ("mW/(m·K)", False, 0.04), 6: ("kcal/(m·h·°C)", False, 1.163), 7: ("mW/(m·K)", False, 0.04)}


def test_empty_tables(spark):
    loaded, values = load(spark, [])
    assert records.faulty_records(loaded, values).count() == 0 and values.count() == 0


def test_open_quotes_swallow_no_neighbours(spark):
    lines = ['a;"1', 'b;2', '"c";3', 'd;4', '"e;5', 'f"g";6', '"h;7";8', 'i;9', '"j', 'k;10']
    want = {0: "quoting", 4: "quoting", 5: "quoting", 8: "quoting"}
    loaded, values = load(spark, [(1, None, None, None, "\n".join(["Имя;Толщина", *lines]), None), (2, None, None, None, "Имя;Толщина\nx;1\ny;\"2", None), (3, None, None, None, "Имя;Толщина\n" + "\n".join(f'x;"{i}' for i in range(50)), None)])
    got = {(r.table_id, r.row_no): r.reason for r in records.faulty_records(loaded, values).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == 1} == want
    assert {k: v for k, v in got.items() if k[0] == 2} == {(2, 1): "quoting"}
    assert sum(k[0] == 3 and v == "quoting" for k, v in got.items()) == 50
    cells = {(r.table_id, r.row_no): r.cell for r in records.sound_cells(loaded, values).where("header_no = 0").collect()}
    assert cells == {(1, 1): "b", (1, 2): "c", (1, 3): "d", (1, 6): "h;7", (1, 7): "i", (1, 9): "k", (2, 0): "x"}


def test_very_long_lines(spark):
    long = "x" * 3_000_000
    loaded, values = load(spark, [(1, None, None, None, f'Имя;Толщина\n{long};5\n"{long};6', None)])
    assert [(r.row_no, r.reason) for r in records.faulty_records(loaded, values).collect()] == [(1, "quoting")]
    assert [r.lo for r in values.collect()] == [5.0]


def test_long_statements_keep_their_unit(spark):
    words = "выраженные по результатам испытаний в сухом состоянии"
    rows = [(1, f"Толщина, см, а также {words}, t в К, q в Вт, ρ в г/см³, с в Дж/(кг·К), L в м³/с", ["δ"], [["5"]], None, None), (2, None, ["δ, дм"], [["5"]], None, None), (3, None, ["λ, килокалория на метр и час и градус"], [["5"]], None, None)]
    _, values = load(spark, rows)
    got = {r.table_id: (r.unit, r.lo) for r in values.collect()}
    assert got[1] == ("cm", 50.0) and got[2] == ("dm", 500.0)
    assert U.longest_spelling() > max(len(s) for r in U._table() for s in r[4].split(";"))
