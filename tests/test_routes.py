"""Ways over many packages: no bound but that of the languages."""

from folioflow.operators import language


def test_long_chain(spark):
    rows = [(k, f"l{chr(97 + k)}", f"l{chr(98 + k)}", "1") for k in range(14)] + [(14, "lo", "la", "1"), (15, "lc", None, "1")]
    packages = spark.createDataFrame(rows, "nth long, from_code string, to_code string, version string")
    found = language.routes(packages, "la", "lo").orderBy("hop").collect()
    assert [(r["hop"], r["from_code"], r["to_code"]) for r in found] == [(k + 1, a, b) for k, a, b, _ in rows[:14]]
    assert language.routes(packages, "la", "zz").count() == 0  # a ring without the target ends
