import pytest
from pyspark.sql import functions as F

from bomspark.functions.licenses import valid_expression, valid_spdx

CASES = {
    "MIT": True, "mit": True, "GPL-2.0+": True, "CC-BY-SA-4.0": True, "LicenseRef-own": True, "DocumentRef-a:LicenseRef-b": True, "MIT OR (Apache-2.0 AND (BSD-3-Clause OR ISC))": True, "GPL-2.0-only WITH Classpath-exception-2.0": True, "(MIT)AND(ISC)": True,
    "": False, " ": False, "Unknown": False, "MIT OR": False, "MIT ISC": False, "(MIT": False, "MIT)": False, "()": False, "MIT WITH ISC": False, "Classpath-exception-2.0": False, "MIT or ISC": False, "NOASSERTION": False, "(MIT OR ISC) WITH LLVM-exception": False,
}


@pytest.fixture(scope="module")
def verdicts(spark):
    rows = spark.createDataFrame([(k,) for k in CASES], "x string")
    return {r.x: r.ok for r in rows.select("x", valid_expression(F.col("x")).alias("ok")).collect()}


@pytest.mark.parametrize("text", CASES)
def test_expression(verdicts, text):
    assert verdicts[text] is CASES[text]


def test_every_licence_counts(spark):
    rows = spark.createDataFrame([([],), (["MIT"],), (["MIT", "x"],), (["own"],)], "l array<string>")
    assert [r[0] for r in rows.select(valid_spdx(F.col("l"))).collect()] == [False, True, False, False]
    assert [r[0] for r in rows.select(valid_spdx(F.col("l"), ("own", "x"))).collect()] == [False, False, False, True]
