import pytest

from factweave.functions.quantity import read_quantity
from factweave.functions.units import CONVERSION, UNIT_ALIASES, resolve_unit
from factweave.operators.units import combine, recorded_in_other_unit, to_common_units


@pytest.mark.parametrize(
    "text, number, symbol, power",
    [
        ("23 ℃下为4.20 g/cm3", 4.2, "g/cm3", 0),
        ("0.1 MPa下为366.8 开", 366.8, "K", 0),
        ("23 ℃下为2889 10^3 kPa", 2889.0, "kPa", 3),
        ("１４,8３７　ｋg⼒/cｍ2（23　℃）", 14837.0, "kgf/cm2", 0),
        ("约3. 081 W/(m·K)", 3.081, "W/(m·K)", 0),
        ("0.1 МРа下为391.5 ℉", 391.5, "℉", 0),
        ("5.9 千 kPa", 5.9, "kPa", 3),
        ("519.5到539.2 kelvin", 529.35, "K", 0),
        ("0.6602W/mK", 0.6602, "W/(m·K)", 0),
        ("77.3 lb/cu ft", 77.3, "lb/ft3", 0),
        ("4.153×10^2", 415.3, None, 0),
        ("73（23 ℃）", 73.0, None, 0),
    ],
)
def test_read_quantity(text, number, symbol, power):
    found = read_quantity(text)
    assert found.number == pytest.approx(number) and (found.symbol, found.power) == (symbol, power)


def test_no_quantity():
    assert all(read_quantity(t) is None for t in (None, "", "无味", "A-12", "B3 号柜"))


def test_every_alias_resolves_to_its_unit():
    assert set(UNIT_ALIASES) == set(CONVERSION)
    for symbol, forms in UNIT_ALIASES.items():
        assert all(resolve_unit(f)[0] == symbol for f in (symbol, *forms)), symbol
    assert resolve_unit("10^3 ppm") == ("ppm", 3) and resolve_unit("×10³ kg/m³") == ("kg/m3", 3) and resolve_unit("foo") is None


def test_operator(spark):
    reference = spark.createDataFrame([("MPa", "", "pressure", "MPa"), ("psi", "", "pressure", "MPa"), ("℃", "", "temperature", "℃"), ("K", "", "temperature", "℃"), ("%", "", "fraction", "%")], "unit_symbol string, unit_name string, dimension string, common_unit string")
    rows = [
        (1, "1000 psi", "1000", "MPa"),
        (2, "300", "300", "K"),
        (3, "300", "300", None),
        (4, None, "20", "℃"),
        (5, "无味", None, "psi"),
        (6, None, None, None),
        (7, "5 %", None, ""),
        (1, "1000 psi", "1000", "MPa"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "row_id bigint, `尾实体/取值文本` string, `数值` string, `单位` string, number string")
    out = {r.row_id: r for r in to_common_units(df, reference).collect()}
    assert sorted(out) == [1, 2, 4, 7]
    assert out[1].common_value == pytest.approx(6.894757, rel=1e-6) and out[2].common_value == pytest.approx(26.85)
    assert out[4].unit_from == "field" and out[1].unit_from == "text"
    found = recorded_in_other_unit(df, reference)
    assert sorted(map(tuple, found.collect())) == [(1, "psi"), (2, "K")]
    assert recorded_in_other_unit(df.limit(0), reference).count() == 0


@pytest.mark.parametrize(
    ("text", "number", "symbol", "power"),
    [
        ("在25℃下测得 1.2 g/cm3", 1.2, "g/cm3", 0),
        ("3小时20分", 3 + 20 / 60, "h", 0),
        ("1 h 30 min", 1.5, "h", 0),
        ("2 min 30 s", 2.5, "min", 0),
        ("1,5 MPa", 1.5, "MPa", 0),
        ("1,500 MPa", 1500, "MPa", 0),
        ("0,577 MPa", 0.577, "MPa", 0),
        ("1 000 MPa", 1000, "MPa", 0),
        ("10-20 MPa", 15, "MPa", 0),
        ("10–20 MPa", 15, "MPa", 0),
        ("-29.66 ℃", -29.66, "℃", 0),
        ("500 mPa", 500, "MPa", -9),
        ("3 MN/m", 3, "mN/m", 9),
        ("0.577 10^3 mPa·s（23 ℃）", 0.577, "mPa·s", 3),
    ],
)
def test_styles_of_numbers_and_conditions(text, number, symbol, power):
    found = read_quantity(text)
    assert found.number == pytest.approx(number) and (found.symbol, found.power) == (symbol, power)


def test_the_property_name_resolves_what_is_ambiguous():
    assert combine("500 mPa", None, None, "拉伸强度")[5] == 0 and combine("500 mPa", None, None, None)[5] == -9
    assert combine("3 MN/m", None, None, "表面张力")[5] == 0
    assert combine("测于 25 ℃，1.2 g/cm3", None, None, "密度")[4] == "g/cm3" and combine("25 ℃，1.2 g/cm3", None, None, "熔点")[4] == "℃"
    found = read_quantity("10-20 MPa")
    assert (found.lower, found.upper) == (10, 20)


def test_a_unit_without_a_factor_is_reported(spark):
    reference = spark.createDataFrame([("MPa", "x", "pressure", "MPa"), ("kPa", "x", "pressure", "MPa")], "unit_symbol string, unit_name string, dimension string, common_unit string")
    df = spark.createDataFrame([(1, "5 kPa", None, None)], "row_id bigint, `尾实体/取值文本` string, `数值` string, `单位` string")
    assert to_common_units(df, reference).first().common_value == pytest.approx(0.005)
