"""What a search sends to all tasks does not grow with the lists."""

from pyspark.sql import functions as F

from lodestitch.operators import lexical


def test_blocks_are_never_sent(spark, monkeypatch):
    words = F.array(F.lit("ALL"), F.concat(F.lit("W"), (F.col("id") % 5).cast("string")), F.concat(F.lit("X"), F.col("id").cast("string")))
    corpus = spark.range(400).select("id", F.lit(None).cast("string").alias("category"), words.alias("tokens"))
    asked = corpus.where("id < 3")
    monkeypatch.setattr(lexical, "BLOCK_RECORDS", 2)
    sent, made = [], lexical._sums

    def watched(plan, index):
        sums = made(plan, index)
        text = sums._jdf.queryExecution().executedPlan().toString()
        sent.append((lexical.opened_blocks(plan).count(), plan.where("not closed").count(), text))
        return sums

    monkeypatch.setattr(lexical, "_sums", watched)
    rows = lambda: sorted((r.query_id, r.cand_id, round(r.lexical, 9)) for r in lexical.bm25_top_k(asked, corpus, 5).collect())
    by_level = rows()
    monkeypatch.setattr(lexical, "MOST_LEVELS", 0)
    assert rows() == by_level and len(by_level) == 15
    (blocks, levels, text), (_, _, shuffled) = sent
    # Blocks come from a generator, and nothing that is sent is made by one.
    assert blocks > levels and "Generate" not in text and "BroadcastExchange" in text
    assert "Generate" in shuffled and "SortMergeJoin" in shuffled and "BroadcastExchange" not in shuffled
