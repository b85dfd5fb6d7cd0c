"""The material view shuffles its records by id once."""

from lodestitch.operators import reports


def test_what_is_joined_by_id_is_joined_first(spark):
    records = spark.createDataFrame([(1, "o", "c", "t", "T", "k")], "id long, source_org string, local_code string, raw_text string, norm_text string, category string")
    links = spark.createDataFrame([("E", 1, 0.5, "EXACT")], "entity_id string, record_id long, match_score double, relationship string")
    entities = spark.createDataFrame([("E", "d", "k", 1)], "entity_id string, description string, category string, member_count long")
    review = spark.createDataFrame([(1, "BLOCKED", 0.5)], "record_id long, status string, score double")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        view = reports.material_view(records, links, entities, review)
        plan = view._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(id") == 3
        assert view.columns[:2] == ["id", "entity_id"]
        assert [(r.id, r.entity_id, r.review_status, r.entity_description) for r in view.collect()] == [(1, "E", "BLOCKED", "d")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
