"""How the fingerprints move the texts."""

from rinse.llm.merkle import edited_fingerprints


def test_texts_go_through_one_shuffle(spark):
    docs = spark.createDataFrame([(at, f"text {at}. " * at) for at in range(60)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = edited_fingerprints(docs)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    reused = [line for line in plan.splitlines() if "ReusedExchange" in line and "text" in line]
    assert len(reused) == 1
