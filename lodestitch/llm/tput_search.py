"""Ranked lexical search by TPUT (three-phase uniform threshold) over term-partitioned postings.

The postings of a term are its list: a row per document that holds it, with the points that the
document gets for the term. Lists are stored term by term, most points first, cut into ranges of about
equal size, so that a long list is many files and a filter on points skips whole row groups.

1. The ``k`` heads of every list are fetched, and their documents scored. A query's k-th best score is its first threshold.
2. A part of the threshold (``SHARED``) is divided evenly over the query's lists: every list is fetched down to this uniform share. With
   the forty lists of a long query the share alone would open nearly all lists to the end, so another part
   (``DEFERRED``) is spent on deferring lists whose heads fit into it, the lowest, which are the longest, first. A
   document that is fetched from no list stays below the threshold. Sums of what is fetched, with what
   the rest of the lists could add, are upper bounds; documents below the threshold are dropped.
3. The documents that are left are looked up for their exact scores, first the k best so far, which
   raise the threshold once more, then those that still reach it; the k best are ranked.

Scores are 64-bit integers, so bounds are exact, and documents of equal score all come through to the
last ranking, however many they are. Long lists of frequent words have few points, so the share
keeps them closed for most queries; a query of frequent words alone reads its lists whole.

Terms are read in Arrow batches: a word is a slice of the batch's own bytes, looked up exactly
among the words that are asked for. Up to ``most_terms`` distinct words (counted first) go along to the tasks; if there are
more, all words of the corpus are listed and joined with those asked for. Document counts, lengths and
frequencies are taken over all documents either way.

Defined results. A null or empty text has no terms, neither as a document nor as an item, and an item without
terms has no rows. Every row is a document and every row of the items a query of its own: repeated rows are ranked
beside each other, equal scores by ascending id, a null id last. Only A-Z are lower-cased. Empty tables give empty
results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestitch.llm._hashing import LOWER, portions, text_bytes, word_spans
from lodestitch.plans.materialize import stored

#: What separates terms: ASCII bytes other than 0-9, A-Z and a-z.
GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Distinct words asked for that go along to the tasks (some tens of MB at most).
MOST_TERMS = 200_000
#: Rows of a small side (numbers only) that are sent to all executors; a larger one is shuffled.
MOST_SENT = 500_000
#: Percent of the first threshold that the uniform share, and the deferred lists, are paid from; less than 100 together.
SHARED, DEFERRED = 10, 50
#: Postings of a range of the stored lists.
RANGE_ROWS = 2_000_000


def terms_of(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """(first row, row of each term, the terms in lower case), a portion of the rows at a time; in order."""
    data, offsets = text_bytes(column)
    for a, b in portions(offsets):
        part, at = LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        starts, ends = word_spans(part, at, GAP[part])
        kept = np.ascontiguousarray(part[~GAP[part]])
        bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(kept)])
        yield a, np.searchsorted(at, starts, side="right") - 1, words


def term_counts(texts: DataFrame, words: list[bytes] | None) -> DataFrame:
    """id, n, words (array<binary>, or of places in ``words``), tf: a row per text, with its distinct words and their counts.

    ``texts``: id, text. Only the words listed are counted one by one, if there is a list; n counts all terms.
    """
    listed = None if words is None else pa.array(words, pa.large_binary())
    kind = "binary" if listed is None else "int"

    def count(row: np.ndarray, found: pa.Array, rows: int) -> tuple[pa.Array, pa.Array]:
        if listed is None:
            coded = found.dictionary_encode()
            code, names = np.asarray(coded.indices).astype(np.int64), coded.dictionary.cast(pa.binary())
        else:
            place = pc.index_in(found, value_set=listed)
            known = np.asarray(pc.is_valid(place))
            row, code, names = row[known], np.asarray(pc.drop_null(place)).astype(np.int64), None
        width = max(1, len(listed) if listed is not None else len(names))
        key, tf = np.unique(row * width + code, return_counts=True)
        bounds = pa.array(np.searchsorted(key, np.arange(rows + 1) * width).astype(np.int32))
        codes = pa.array((key % width).astype(np.int32))
        return pa.ListArray.from_arrays(bounds, codes if names is None else names.take(codes)), pa.ListArray.from_arrays(bounds, pa.array(tf.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for first, row, found in terms_of(batch.column("text")):
                at = first
                rows = int(row[-1]) + 1 if len(row) else 0
                n = np.bincount(row, minlength=rows)
                lists = count(row, found, rows)
                ids = batch.column("id").slice(at, rows)
                yield pa.record_batch([ids, pa.array(n.astype(np.int64)), *lists], ["id", "n", "words", "tf"])

    return texts.mapInArrow(run, f"id long, n long, words array<{kind}>, tf array<int>").where("n > 0")


def _points(n_docs: int, n_terms: int) -> Column:
    """Points of a document of length n for a term of weight w that it holds tf times; all in 64-bit integers."""
    return F.expr(f"w * ((1000000000L * tf) div (1000L * tf + 8 * (10 + (90L * n * {n_docs}L) div {n_terms}L)))")


def _best(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k first rows of each query; Spark cuts every partition to k rows a query before it shuffles."""
    place = F.row_number().over(Window.partitionBy("q").orderBy(*order))
    return df.withColumn("rank", place).where(F.col("rank") <= k)


def _threshold(sums: DataFrame, k: int, into: str) -> DataFrame:
    """q, into: the k-th largest lower bound; queries with fewer documents are missing."""
    return _best(sums, k, F.desc("low")).where(F.col("rank") == k).select("q", F.col("low").alias(into))


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    *,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text_col: str = "text",
    most_terms: int = MOST_TERMS,
) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0."""
    side = lambda df, name: df.select(F.col(name).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # Stored, so that the number of a row stays the same.
    queries = stored(term_counts(side(items, item_id), None).withColumn("q", F.monotonically_increasing_id()))
    asked = queries.select("q", F.explode("words").alias("word"))
    vocabulary = stored(asked.groupBy("word").agg(F.count("*").alias("queries")))
    wanted = vocabulary.agg(F.count("*").alias("words"), F.coalesce(F.sum("queries"), F.lit(0)).alias("pairs")).first()
    few = wanted["words"] <= most_terms
    sent = lambda df, rows: F.broadcast(df) if rows <= MOST_SENT else df
    words = [bytes(r["word"]) for r in vocabulary.select("word").orderBy("word").collect()] if few else None
    forward = stored(term_counts(side(docs, doc_id), words).withColumn("doc", F.monotonically_increasing_id()))

    sizes = forward.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("rows")).first()
    n_docs, n_terms = sizes["docs"], max(1, sizes["terms"])
    entry = F.explode(F.arrays_zip("words", "tf")).alias("e")
    spread = forward.select("doc", "n", entry).select("doc", "n", F.col("e.words").alias("word"), F.col("e.tf").cast("long").alias("tf"))
    if few:
        named = _places(forward, words)
        asked = asked.join(named, "word").drop("word")
        term = F.col("word").alias("term")
    else:
        # A number per word keeps the lists narrow.
        named = stored(vocabulary.select("word", F.monotonically_increasing_id().alias("term")))
        asked, spread = asked.join(named, "word").drop("word"), spread.join(named, "word").drop("word")
        term = F.col("term")
    spread = spread.select("doc", "n", term, "tf")
    df = spread.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    weights = stored(df.select("term", weight.alias("w")))
    listed = spread.join(sent(weights, wanted["words"]), "term").select("term", "doc", _points(n_docs, n_terms).alias("points")).where("points > 0")
    ranges = max(1, sizes["rows"] // RANGE_ROWS)
    lists = stored(listed.repartitionByRange(ranges, "term", F.desc("points"), "doc").sortWithinPartitions("term", F.desc("points")))

    def scored(pairs: DataFrame, most: int) -> DataFrame:
        """q, doc, doc_id, score of pairs (q, doc), from the documents' own rows."""
        texts = forward.withColumnRenamed("id", "doc_id").join(sent(pairs, most), "doc").select("q", "doc", "doc_id", "n", entry)
        texts = texts.select("q", "doc", "doc_id", "n", F.col("e.words").alias("word"), F.col("e.tf").cast("long").alias("tf"))
        texts = texts.withColumnRenamed("word", "term") if few else texts.join(named, "word").drop("word")
        exact = texts.join(sent(asked, wanted["pairs"]), ["q", "term"]).join(sent(weights, wanted["words"]), "term")
        return exact.groupBy("q", "doc", "doc_id").agg(F.sum(_points(n_docs, n_terms)).alias("score"))

    # 1: heads.
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("points"), "doc"))
    heads = stored(lists.withColumn("place", place).where(F.col("place") <= k).drop("place"))
    first = stored(heads.join(asked, "term").select("q", "doc").distinct())
    thresholds = _threshold(scored(first, wanted["pairs"] * k).withColumnRenamed("score", "low"), k, "first")

    # 2: a uniform share, and lists that wait.
    tops = asked.join(heads.groupBy("term").agg(F.max("points").alias("top")), "term").join(thresholds, "q", "left")
    per_query, lowest = Window.partitionBy("q"), Window.partitionBy("q").orderBy("top", "term")
    tops = tops.withColumn("share", F.greatest(F.lit(1).cast("long"), F.expr(f"coalesce({SHARED} * first, 0) div 100") / F.count("*").over(per_query)).cast("long"))
    tops = tops.withColumn("spent", F.sum(F.greatest(F.col("top") - F.col("share") + 1, F.lit(0))).over(lowest))
    waits = (F.col("top") < F.col("share")) | F.coalesce(F.col("spent") <= F.expr(f"{DEFERRED} * first div 100"), F.lit(False))
    rest = F.when(F.col("waits"), F.col("top")).otherwise(F.col("share") - 1)
    bounds = stored(tops.withColumn("waits", waits).select("q", "term", "first", "share", "waits", rest.alias("rest")))
    # No query asks for less than the least share, so row groups below it aren't read.
    least = bounds.where("not waits").agg(F.min("share")).first()[0]
    opened = sent(bounds.where("not waits").select("q", "term", "share", "rest"), wanted["pairs"])
    fetched = lists.where(F.col("points") >= F.lit(least or 0)).join(opened, "term").where("points >= share")
    sums = stored(fetched.groupBy("q", "doc").agg(F.sum("points").alias("low"), F.sum("rest").alias("seen")))
    room = bounds.groupBy("q").agg(F.sum("rest").alias("all_rest"), F.max("first").alias("first")).join(_threshold(sums, k, "second"), "q", "left")
    reach = F.col("low") + F.col("all_rest") - F.col("seen")
    left = sums.join(sent(room, wanted["pairs"]), "q").withColumn("reach", reach).where("reach >= coalesce(greatest(first, second), 0)")
    left = stored(left.select("q", "doc", "low", "reach"))

    # 3: exact scores.
    ahead = _best(left, k, F.desc("low"), F.col("doc")).select("q", "doc")
    third = _threshold(scored(stored(ahead), wanted["pairs"] * k).withColumnRenamed("score", "low"), k, "third")
    last = stored(left.join(sent(third, wanted["pairs"]), "q", "left").where("reach >= coalesce(third, 0)").select("q", "doc"))
    best = _best(scored(last, last.count()).where("score > 0"), k, F.desc("score"), F.asc_nulls_last("doc_id"), F.col("doc"))
    return best.join(queries.select("q", F.col("id").alias("item_id")), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _places(df: DataFrame, words: list[bytes]) -> DataFrame:
    """word, term: the place of each word in a list of bounded length."""
    return df.sparkSession.createDataFrame([(bytearray(w), i) for i, w in enumerate(words)], "word binary, term int")
