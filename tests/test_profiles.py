"""Profile codes: the aliases applied one after another, in a plan that does not double with each."""

from pyspark.sql import functions as F

from foliotab.functions import fixed_values as V
from foliotab.operators import routing


def test_profile_codes_equal_the_chain_of_aliases(spark):
    names = [*V.PROFILE_ALIASES, *(p[0] for p in V.PROFILES), "unknown", "MATEO ", "\tCustom\n", " Internal-General"]

    def want(raw):
        key = (raw or "").strip().lower()
        for alias, target in V.PROFILE_ALIASES.items():
            key = target if key == alias else key
        return key if key in {p[0] for p in V.PROFILES} else routing.DEFAULT_PROFILE

    rows = [(x,) for x in [*names, None]]
    df = spark.createDataFrame(rows, "raw string").select("raw", routing.profile_code("raw").alias("code"))
    assert {(r.raw, r.code) for r in df.collect()} == {(x, want(x)) for x, in rows}
    plan = spark.range(1).select(routing.profile_code(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("trim(") <= 2
