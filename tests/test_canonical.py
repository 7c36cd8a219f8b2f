"""Canonical JSON against what JSON.stringify prints for the same documents."""

import pytest
from pyspark.sql import functions as F

from veilframe.functions.canonical import canonical_json_exact, number_text

# Numbers and what JavaScript prints for them.
NUMBERS = {
    "1e21": "1e+21", "-0.0": "0", "-0": "0", "1.0": "1", "1E2": "100", "0.1": "0.1", "1e-6": "0.000001", "1e-7": "1e-7", "123e-9": "1.23e-7", "12345678901234567890": "12345678901234567000",
    "9007199254740993": "9007199254740992", "999999999999999999999": "1e+21", "123456789012345680000": "123456789012345680000", "5e-324": "5e-324", "1.7976931348623157e308": "1.7976931348623157e+308",
    "1e400": "null", "-12.50": "-12.5", "100": "100", "0.000001234": "0.000001234", "-1e-7": "-1e-7",
}


@pytest.mark.parametrize("text", NUMBERS)
def test_numbers(text):
    assert number_text(float(text)) == NUMBERS[text]


def test_documents(spark):
    cases = {
        '{"b":1,"a":[1.50,{"z":null,"y":true}]}': '{"a":[1.5,{"y":true,"z":null}],"b":1}',
        '{"�":1,"\U0001f600":2,"z":3}': '{"z":3,"\U0001f600":2,"�":1}',
        '{"a":1,"a":2}': '{"a":2}', '{"10":1,"9":2,"":3}': '{"":3,"10":1,"9":2}', '"\\ud800\\u0041\\n/\\u0001"': '"\\ud800A\\n/\\u0001"',
        " [ ] ": "[]", "{}": "{}", "1e21": "1e+21", "nope": None, '{"a":NaN}': None, "": None, "[" * 5000 + "]" * 5000: None,
        '{"limit":5,"entity":"cards"}': '{"entity":"cards","limit":5}',
    }
    rows = [(k, d) for k, d in enumerate([*cases, None])]
    got = {r.k: r.c for r in spark.createDataFrame(rows, "k int, d string").select("k", canonical_json_exact(F.col("d")).alias("c")).collect()}
    assert [got[k] for k in range(len(rows))] == [*cases.values(), None]
