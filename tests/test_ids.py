import re

import pytest
from pyspark.sql import functions as F

from doclake.functions import ids

HEX = "354a4f41-bf47-b173-8e4d-e4c8110d25a8"


@pytest.mark.parametrize(
    ("text", "want"),
    [(HEX, HEX), (HEX.upper(), HEX), (HEX.replace("-", ""), HEX), (f" \t{HEX.upper()}\u00a0\u3000\n", HEX), ("-3-54A4F41BF47B1738E4DE4C8110D25A8-", HEX), ("dxAbC ", "dxAbC"), ("a-B", "a-B"), ("g" * 32, "g" * 32), ("", None), (" \u2003", None), (None, None)],
)
def test_canonical_id(spark, text, want):
    assert spark.createDataFrame([(text,)], "c string").select(ids.canonical_id(F.col("c"))).first()[0] == want


def test_blanks_are_one_set(spark):
    every = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(every)], "i int, c string")
    gone = {every[r.i] for r in df.where(ids.strip(F.col("c")) == "").collect()}
    pattern = re.compile("^" + re.sub(r"\\x\{([0-9A-F]{4})\}", r"\\u\1", ids.BLANK).replace(r"\s", r" \t\n\x0b\f\r") + "$")
    assert gone == {c for c in every if pattern.match(c)}
