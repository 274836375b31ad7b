"""The vectorised splitter against single cases, a brute-force version and random text."""

import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from factweave.operators.multivalue import divided_names, flattened, positions_of, split_batch, split_values

NAMES = ["光泽、色度", "耐酸性/耐碱性", "熔点", "Cp", "D50"]
CUT = divided_names(NAMES)


def values(text):
    parents, found = flattened(split_batch(pa.array([text]), CUT, frozenset(NAMES)))
    return found.to_pylist()


def test_lists():
    assert values("熔点; 软化点；密度|外观") == ["熔点", "软化点", "密度", "外观"]
    assert values('["熔点", "a,b"]') == ["熔点", "a,b"]
    assert values("①水②丙酮") == ["水", "丙酮"]
    assert values("1)水 2)丙酮 10)醇") == ["水", "丙酮", "醇"]
    assert values("水\\n丙酮\n醇\t酯") == ["水", "丙酮", "醇", "酯"]
    assert values('"灰白;带斑点"; 「a|b」') == ["灰白;带斑点", "a|b"]
    assert values("；；水;;丙酮；​") == ["水", "丙酮"]
    assert values("2.1 g/cm3; 2.2 g/cm3") == ["2.1 g/cm3", "2.2 g/cm3"]
    assert values("D50/外观") == ["D50", "外观"]


def test_closed_lists_apostrophes_and_comma_lists():
    assert values("熔点；D50；Cp。") == ["熔点", "D50", "Cp"]
    assert values("1.2 g/cm3；1.3 g/cm3。") == ["1.2 g/cm3", "1.3 g/cm3"]
    assert values("it's a; b's c") == ["it's a", "b's c"] and values("'a;b'; c") == ["a;b", "c"]
    assert values("3,5,7") == ["3", "5", "7"] and values("10,20,30 MPa") == ["10", "20", "30 MPa"]
    assert values("1,234,567") == ["1,234,567"] and values("2,4,6-三澜基酯") == ["2,4,6-三澜基酯"] and values("3,5") == ["3,5"]
    assert values("水\r\n丙酮\r醇") == ["水", "丙酮", "醇"]
    assert values("遇强碱变色；见图。") == ["遇强碱变色；见图。"]


def test_one_value():
    for text in ("光泽、色度", "光泽、色渡", "耐酸性/耐碱性", "熔点 / degC", "熔点, ℃", "比热容/J/(g·K)", "1,860.0", "3,5-二岚基环酮型", "N,N-双沐基胺类", "浸泡后变化很小，无起泡。", "2.1 g/cm3", "N/A", "10~20", "1:2", "水;"):
        assert len(values(text)) == 1, text


def test_names_inside_lists():
    assert values("气味,光泽、色度") == ["气味", "光泽、色度"]
    assert values("气味/耐酸性/耐碱性") == ["气味", "耐酸性/耐碱性"]
    assert values("熔点,Cp") == ["熔点", "Cp"] and values("光泽、色度 / Cp") == ["光泽、色度", "Cp"] and values("黏度, cP") == ["黏度, cP"]


def test_nulls_empty_long():
    parents, found = flattened(split_batch(pa.array([None, "", "a;b", None, "；", "x" * 300_000 + ";y"]), CUT))
    assert parents.tolist() == [2, 2, 5, 5]
    assert positions_of(parents).tolist() == [1, 2, 1, 2]
    assert found.to_pylist()[:2] == ["a", "b"] and len(found.to_pylist()[2]) == 300_000
    assert split_batch(pa.array([], pa.string()), CUT).to_pylist() == [] and split_batch(pa.array([None, "a;b"]), CUT).to_pylist() == [[], ["a", "b"]]


def brute(text):
    """Split at semicolons and bars outside straight double quotes, one character at a time."""
    if text.count('"') % 2:
        quoted = False
        parts = [""]
        for ch in text:
            parts[-1] += ch
            if ch in ";|":
                parts[-1] = parts[-1][:-1]
                parts.append("")
    else:
        quoted, parts = False, [""]
        for ch in text:
            if ch == '"':
                quoted = not quoted
            elif ch in ";|" and not quoted:
                parts.append("")
            else:
                parts[-1] += ch
    return [p.strip() for p in parts if p.strip()]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='ab水;|" ', max_size=12), min_size=1, max_size=8))
def test_against_brute_force(texts):
    parents, found = flattened(split_batch(pa.array(texts), []))
    expected = [(i, v) for i, t in enumerate(texts) for v in brute(t)]
    assert list(zip(parents.tolist(), found.to_pylist(), strict=True)) == expected


def test_operator(spark):
    rows = [(1, "熔点;密度", None), (1, "熔点;密度", ""), (2, None, "水、丙酮"), (3, "熔点", "N/A")]
    df = spark.createDataFrame([(*r, "clash", 9) for r in rows], "row_id bigint, predicate_raw string, `尾实体/取值文本` string, value string, pos int")
    out = sorted(map(tuple, split_values(df, NAMES).collect()))
    assert out == sorted([(1, "predicate_raw", 1, "熔点"), (1, "predicate_raw", 2, "密度")] * 2 + [(2, "尾实体/取值文本", 1, "水"), (2, "尾实体/取值文本", 2, "丙酮")])
    assert split_values(df.limit(0), NAMES).count() == 0
    assert split_values(df, NAMES, keep_single=True).where("row_id = 3").count() == 2


def test_the_filter_knows_all_that_folds_to_a_separator():
    from factweave.operators import multivalue as M

    passes = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), M.candidate()))
    assert all(passes.search(f"甲{c}乙") for c in "\u2215\u2044\uff64\u037e;|、,/①") and not passes.search("甲乙")
    assert not re.search(M.CANDIDATE, "甲\uff64乙")
