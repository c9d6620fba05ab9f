"""Numbers in tool calls: integers by value, one canonical form, what no double can hold."""

import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat

TOOLS = {"t": {"n": ("integer", True), "x": ("number", False), "s": ("string", False), "a": ("array", False)}}


def checked(spark, cases):
    rows = [(i, 1, "assistant", json.dumps({"content": "", "tool_calls": [{"id": "a", "name": "t", "arguments": text}]})) for i, text in enumerate(cases)]
    got = chat.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), TOOLS).filter("kind = 'call'").orderBy("conv_id").collect()
    return [(r.status, list(r.errors), r.line) for r in got]


@pytest.mark.parametrize("value", ["1", "1.0", "1e0", "10E-1", "0.1e1", "1.000", "100e-2"])
def test_equal_numbers_have_one_form(spark, value):
    (status, errors, line), = checked(spark, [f'{{"n": {value}, "a": [{value}, "{value}"]}}'])
    assert not errors and line == f'{{"arguments":{{"a":[1,"{value}"],"n":1}},"id":"a","name":"t","role":"assistant","type":"call"}}'
    assert status == "no result"


def test_large_small_and_refused_numbers(spark):
    cases = {
        '{"n":99999999999999999999}': ([], '{"n":99999999999999999999}'), '{"n":-0}': ([], '{"n":0}'), '{"n":1e2}': ([], '{"n":100}'), '{"n":12345678901234567890123456789012345678901234567890}': ([], '{"n":12345678901234567890123456789012345678901234567890}'),
        '{"n":1,"x":1.5E-7}': ([], '{"n":1,"x":0.00000015}'), '{"n":1.5}': (["n is not integer"], '{"n":1.5}'), '{"n":"1"}': (["n is not integer"], '{"n":"1"}'), '{"n":1,"s":2}': (["s is not string"], '{"n":1,"s":2}'),
        '{"n":1E400}': (["number out of range"], '{"malformed":"{\\"n\\":1E400}"}'), '{"n":1,"x":-1e99999999999}': (["number out of range"], None), '{"n":01}': (["malformed arguments"], None), '{"n":1,"s":"a \\"1.0\\" \\\\"}': ([], '{"n":1,"s":"a \\"1.0\\" \\\\"}'),
        '{"n": 5 , "s" : "x:1.0,2.0"}': ([], '{"n":5,"s":"x:1.0,2.0"}'),
    }
    for (text, (errors, line)), got in zip(cases.items(), checked(spark, list(cases)), strict=True):
        assert got[1] == errors, (text, got)
        assert line is None or got[2].startswith(f'{{"arguments":{line},'), (text, got)


def test_canonical_numbers_by_value(spark):
    made = random.Random(6)
    texts = []
    for _ in range(800):
        t = ("-" if made.random() < 0.3 else "") + str(made.choice([0, made.randint(1, 9), made.randint(10, 10**12)]))
        t += "." + "".join(made.choices("0012345", k=made.randint(1, 9))) if made.random() < 0.6 else ""
        t += made.choice("eE") + made.choice(["", "+", "-"]) + str(made.randint(0, 30)) if made.random() < 0.5 else ""
        texts.append(t)
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.canonical_number(F.col("t")).alias("c")).collect()
    for r in got:
        assert Decimal(r.c) == Decimal(r.t) and "e" not in r.c.lower() and not (("." in r.c) and r.c.endswith("0")) and r.c != "-0", r
    same = {}
    for r in got:
        assert same.setdefault(Decimal(r.t), r.c) == r.c
