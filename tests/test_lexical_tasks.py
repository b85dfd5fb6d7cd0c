"""The index of a corpus is counted in tasks of bounded size."""

from lodestitch.operators import lexical as L


def test_postings_are_counted_where_their_record_is(spark, monkeypatch):
    """Of 40 classes of two tokens, ten tokens to a task, no row of (record, term) is shuffled."""
    seen, kept = [], L.stored
    monkeypatch.setattr(L, "stored", lambda df: (seen.append(df), kept(df))[1])
    monkeypatch.setattr(L, "TASK_TOKENS", 10, raising=False)
    rows = [(i, "a", [f"t{i}", "x", "x"]) for i in range(40)]
    index = L.build_index(spark.createDataFrame(rows, "id long, category string, tokens array<string>"), None, 3)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in seen if "tf" in df.columns]
    assert plans and not [line for plan in plans for line in plan.split("\n") if "Exchange" in line and "term" in line]
    assert index.postings.count() == 80 and index.levels.where("key = 'a\\0x'").count() == 1
