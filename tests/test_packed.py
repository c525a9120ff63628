import random

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from textilla.operators.packed import CODES, LABELS, explode_packed, split_packed

CASES = [
    ('"Materiales ""blandos"" y superficies" | "MarLit"', ['Materiales "blandos" y superficies', "MarLit"]),
    ("[MarLit++EcoMer++EcoMer]", ["MarLit", "EcoMer", "EcoMer"]),
    ('  "HisPat" ++ ', ["HisPat"]),
    (None, []),
    ("", []),
    ("   ", []),
    ("'Socie_'\n'MarLit'", ["Socie_", "MarLit"]),
    ('A, "Derecho; normas y tribunales"++SalPob', ["A", "Derecho; normas y tribunales", "SalPob"]),
    ('"unclosed; x', ['"unclosed', "x"]),
    ("O'Brien; 'x;y'", ["O'Brien", "x;y"]),
    ("(a;b)", ["a", "b"]),
    (';;"" ; a', ["a"]),
    ("ñandú; «é»", ["ñandú", "«é»"]),
]


@pytest.mark.parametrize("text,values", CASES)
def test_cases(text, values):
    assert split_packed(pa.array([text], pa.string())).to_pylist() == [values]
    # the same among neighbours
    assert split_packed(pa.array(["x;'y", text, None, '"z"'], pa.string())).to_pylist() == [["x", "'y"], values, [], ["z"]]


def test_codes():
    got = split_packed(pa.array(["450603, 2701.03", "330301 / 330505", "450305 - 450303", '9,,"9",,9', "1 2\t3\n4"]), CODES)
    assert got.to_pylist() == [["450603", "2701.03"], ["330301", "330505"], ["450305", "450303"], ["9", "9", "9"], ["1", "2", "3", "4"]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="abñ ;,\"'+[", min_size=1, max_size=8).map(str.strip).filter(bool), max_size=5), max_size=6))
def test_round_trip(rows):
    quoted = [";".join('"' + v.replace('"', '""') + '"' for v in r) for r in rows]
    want = [[w for v in r if (w := v.strip(" "))] for r in rows]
    assert split_packed(pa.array(quoted, pa.string())).to_pylist() == want


def test_brute_force_codes():
    rng = random.Random(1)
    rows = [rng.choice([",", ";", " ", " | ", "\n", "+"]).join(str(rng.randrange(1000, 999999)) for _ in range(rng.randrange(0, 6))) for _ in range(500)]
    import re

    assert split_packed(pa.array(rows), CODES).to_pylist() == [re.findall(r"\d+", r) for r in rows]


def test_table(spark):
    df = spark.createDataFrame([("r1", "a;b;a", 1, "x"), ("r1", "c", 2, "y"), (None, "d", 3, "z"), ("r2", None, 4, "w"), ("r3", "q" * 200_000 + ";z", 5, "v")], "key string, field string, pos int, val string")
    got = explode_packed(df, "key", "field")
    rows = [(r["key"], r["pos"], r["val"][:3]) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted([("r1", 1, "a"), ("r1", 2, "b"), ("r1", 3, "a"), ("r1", 1, "c"), (None, 1, "d"), ("r3", 1, "qqq"), ("r3", 2, "z")], key=repr)
    assert explode_packed(df.limit(0), "key", "field", LABELS).count() == 0
    assert got.filter(F.length("val") == 200_000).count() == 1
