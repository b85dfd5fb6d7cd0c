"""BM25 top-k with upper bounds, over postings in blocks of like weight.

The list of a term holds a weight per record. Lists are cut into levels of weight, and long levels into
blocks by a hash of the record, so that a block is a key of its own, a term of every record is many keys,
and the greatest weight of each level is known without reading it. A search

1. adds up the heads of the query's lists and scores the records that lead: k records reach the k-th best of these scores;
2. spends a part of that score (``SPENT``) on the lists from the cheapest up: a list whose greatest weight fits into what is left of it is closed,
   the next one is opened down to what is then left, the rest, the rare terms, are opened whole. A record that is found
   in no opened part stays below the k-th best, so it is never paired with the query;
3. drops what can't reach the k-th best with all that its closed lists could add, twice: the leaders' whole scores raise it once more;
4. scores what remains from the records' own rows.

Records of equal tokens are one class, for which all this is done once; the same goes for queries. So copies, however many, cost nothing more
than their place in the result, and a term that all records hold costs a query one row for each of its levels, not one for each record. Weights
may be negative (most terms of a tiny category can be in most of its records); bounds take account of that.
Scores equal after ``TIES`` are ties, and bounds leave that much room, so results are those of scoring every pair.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestitch.functions import rules as R
from lodestitch.plans.materialize import shuffle_partitions, stored

#: Raw scores are compared in steps of 1 / TIES.
TIES = 1e6
#: What a bound may be short of: two roundings, and what the order of additions changes.
ROOM = 4 / TIES
#: The part of the score to beat that is spent on closing lists, and how many times k records are scored for that score.
SPENT, AHEAD = 0.3, 2
#: Queries whose bounds (three numbers each) are sent to all executors.
MOST_SENT = 200_000
#: Postings of a file of the index, and what one task adds up of a search of many queries.
FILE_ROWS, TASK_HITS = 500_000, 2_000_000
#: Open levels of all queries together that are sent to the postings.
MOST_LEVELS = 1 << 17
#: Tokens that one task counts into postings.
TASK_TOKENS = 1_000_000
#: Queries from which on a search counts as one of many.
MANY = 1000
#: Levels of weight of a list, and the records of a list from which on its levels are cut into blocks.
LEVELS, BLOCK_RECORDS = 16, 1024


def partition_key(category: Column) -> Column:
    """The category that a record is searched in; those without one are together."""
    return F.coalesce(category, F.lit(R.UNKNOWN))


def tagged(records: DataFrame) -> DataFrame:
    """part, id, tokens, bag: ``bag`` names what tokens there are and how often. Stored, so that texts are tokenized once."""
    tokens = F.coalesce("tokens", F.array().cast("array<string>"))
    bag = F.sha2(F.array_join(F.sort_array(tokens), "\0"), 256)
    return stored(records.select(partition_key(F.col("category")).alias("part"), "id", tokens.alias("tokens"), bag.alias("bag")))


def classes(records: DataFrame) -> DataFrame:
    """part, bag, id, n, tokens: one row for all records (``tagged``) of equal tokens, with the smallest id and their number."""
    return records.groupBy("part", "bag").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.any_value("tokens").alias("tokens"))


def postings(of_classes: DataFrame) -> DataFrame:
    """part, id, n, term, tf, length: one row per class and distinct term."""
    # An inner explode would make the optimizer test the size of the tokens in a filter below.
    terms = of_classes.select("part", "id", "n", F.size("tokens").alias("length"), F.explode_outer("tokens").alias("term")).where("term is not null")
    return terms.groupBy("part", "id", "n", "length", "term").agg(F.count("*").alias("tf"))


def category_sizes(records: DataFrame, posting: DataFrame) -> DataFrame:
    """part, n_docs, average_length: a row per category, over all records."""
    count = records.groupBy("part").agg(F.count("*").alias("n_docs"))
    tokens = posting.groupBy("part").agg(F.sum(F.col("n") * F.col("tf")).alias("tokens"))
    return count.join(F.broadcast(tokens), "part").select("part", "n_docs", (F.col("tokens") / F.col("n_docs")).alias("average_length"))


def inverse_frequencies(sizes: DataFrame, posting: DataFrame) -> DataFrame:
    """part, term, rows, idf, average_length; a negative idf becomes a quarter of the mean idf of its category.

    ``rows``: the length of the term's list, a row per class. ``sizes``: as of ``category_sizes``.
    """
    terms = posting.groupBy("part", "term").agg(F.sum("n").alias("df"), F.count("*").alias("rows")).join(F.broadcast(sizes), "part")
    terms = terms.withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    means = terms.groupBy("part").agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, F.lit(R.BM25_EPSILON) * F.col("mean")).otherwise(F.col("raw"))
    return terms.join(F.broadcast(means), "part").select("part", "term", "rows", idf.alias("idf"), "average_length")


def joined_key(*parts: Column) -> Column:
    """One string for several parts without NUL, so that a stored table can be bucketed by it and joined on nothing else."""
    return F.concat_ws("\0", *[p.cast("string") for p in parts])


@dataclass(frozen=True)
class LexicalIndex:
    """What a search reads: five tables, each with its category ``part`` and the key that it is joined on.

    A list is a category and a term, a block a list and a number, a class a category and the smallest id of its records; the
    ids in postings, heads and forward are those of classes. Heads and members go ``depth`` deep, and no search goes deeper.
    """

    #: part, key (block), id, w
    postings: DataFrame
    #: part, key (list), level, cuts, most, least, n: the blocks of a level are numbered level * 2**32 + 0 .. cuts - 1
    levels: DataFrame
    #: part, key (list), id, w, place
    heads: DataFrame
    #: part, key (class), id, n (records), weights: array<struct<term, w>>
    forward: DataFrame
    #: part, key (class), id, place: the records of a class of smallest id
    members: DataFrame
    depth: int


def heads_of(weighted: DataFrame, depth: int) -> DataFrame:
    """The ``depth`` records of greatest weight of every list (part, key); Spark cuts each partition before it shuffles."""
    place = F.row_number().over(Window.partitionBy("part", "key").orderBy(F.desc("w"), "id"))
    return weighted.select("part", "key", "id", "w", place.alias("place")).where(F.col("place") <= depth)


def _kept(index: LexicalIndex) -> LexicalIndex:
    """The index for one search: tables that it reads more than once are stored."""
    return replace(index, levels=stored(index.levels), forward=stored(index.forward))


def build_index(corpus: DataFrame, terms: DataFrame | None = None, depth: int = R.CANDIDATES) -> LexicalIndex:
    """The index of ``corpus`` (id, category, tokens); with ``terms`` (part, term) only of these, weighed by the whole corpus."""
    return _indexed(tagged(corpus), terms, depth)


def _indexed(records: DataFrame, terms: DataFrame | None, depth: int) -> LexicalIndex:
    # Dealt by record, what a record holds is counted where it is, in tasks of about TASK_TOKENS tokens, and no posting is shuffled for it.
    tokens = records.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    tasks = max(records.sparkSession.sparkContext.defaultParallelism, tokens // TASK_TOKENS)
    posting = stored(postings(classes(records).repartition(tasks, "part", "id")))
    idf = inverse_frequencies(stored(category_sizes(records, posting)), posting)
    if terms is not None:
        idf = idf.join(terms, ["part", "term"], "left_semi")
    # Stored, it is known to be small where it is, and postings are not shuffled for it.
    idf = stored(idf)
    norm = R.BM25_K1 * (1 - R.BM25_B + R.BM25_B * F.col("length") / F.col("average_length"))
    share = F.col("tf") / (F.col("tf") + norm)
    cuts = F.greatest(F.lit(1).cast("long"), F.expr(f"rows div {BLOCK_RECORDS}"))
    level = F.floor(share * LEVELS).cast("long")
    number = level * (1 << 32) + F.pmod(F.xxhash64("id"), cuts)
    of_list = joined_key(F.col("part"), F.col("term"))
    weight = F.col("idf") * F.col("tf") * (R.BM25_K1 + 1) / (F.col("tf") + norm)
    weighted = posting.join(idf, ["part", "term"]).select("part", "term", of_list.alias("key"), number.alias("number"), "id", "n", weight.alias("w"), cuts.alias("cuts"))
    # What a record holds is in one file, so that its sums are made where it is read, and no task reads more than a file or two.
    files = max(posting.sparkSession.sparkContext.defaultParallelism, posting.count() // FILE_ROWS)
    weighted = stored(weighted.repartition(files, "part", "id"))
    by_level = weighted.groupBy("part", "key", F.shiftright("number", 32).cast("int").alias("level"))
    levels = by_level.agg(F.max("cuts").alias("cuts"), F.max("w").alias("most"), F.min("w").alias("least"), F.count("*").alias("n"))
    inside = Window.partitionBy("part", "bag").orderBy("id")
    first = records.select("part", "bag", "id", F.row_number().over(inside).alias("place")).where(F.col("place") <= depth)
    members = first.withColumn("key", joined_key(F.col("part"), F.first("id").over(inside))).select("part", "key", "id", "place")
    forward = weighted.groupBy("part", "id", "n").agg(F.collect_list(F.struct("term", "w")).alias("weights"))
    return LexicalIndex(
        weighted.select("part", joined_key(F.col("key"), F.col("number")).alias("key"), "id", "w"),
        levels,
        heads_of(weighted, depth),
        forward.select("part", joined_key(F.col("part"), F.col("id")).alias("key"), "id", "n", "weights"),
        members,
        depth,
    )


def asked_terms(queries: DataFrame) -> DataFrame:
    """query_id, part, term, key (list), qtf of ``tagged`` queries, a query for all of equal tokens."""
    found = postings(classes(queries))
    return found.select(F.col("id").alias("query_id"), "part", "term", joined_key(F.col("part"), F.col("term")).alias("key"), F.col("tf").alias("qtf"))


def class_of(records: DataFrame) -> DataFrame:
    """part, id, class: the smallest id of the ``tagged`` records with equal tokens."""
    rows = records.select("part", "bag", "id")
    return rows.join(rows.groupBy("part", "bag").agg(F.min("id").alias("class")), ["part", "bag"]).select("part", "id", "class")


def _best(sums: DataFrame, k: int) -> DataFrame:
    """The k rows of greatest sum of each query, and their place."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s")))
    return sums.withColumn("place", place).where(F.col("place") <= k)


def _kth(sums: DataFrame, k: int, into: str) -> DataFrame:
    """query_id, into: the k-th largest sum; queries with fewer are missing."""
    return _best(sums, k).where(F.col("place") == k).select("query_id", F.col("s").alias(into))


def _reached(pairs: DataFrame, asked: DataFrame, index: LexicalIndex, k: int, into: str) -> DataFrame:
    """query_id, into: a score that k records reach, from the whole scores of given pairs."""
    scores = _best(exact_scores(pairs, asked, index).select("query_id", "n", F.col("raw").alias("s")), k)
    records = F.sum("n").over(Window.partitionBy("query_id").orderBy("place"))
    return scores.withColumn("records", records).where(F.col("records") >= k).groupBy("query_id").agg(F.max("s").alias(into))


def planned(asked: DataFrame, index: LexicalIndex, k: int) -> DataFrame:
    """Every level of the lists of each query: query_id, part, key, qtf, level, cuts, n (records), ``kth``, a score that k records reach, ``closed``,
    and ``rest``, the most that the closed levels of the list add. Levels that add nothing are left out.

    Closing a level costs the query the most that it adds beyond the level below; levels that save
    most records for their cost are closed first, the lower ones of a list never after the higher.
    """
    found = asked.select("query_id", "part", "key", "qtf").join(index.heads.where(F.col("place") <= k).select("key", "id", "w"), "key")
    sums = found.groupBy("query_id", "part", "id").agg(F.sum(F.col("qtf") * F.col("w")).alias("s"))
    reached = _reached(stored(_best(sums, AHEAD * k)), asked, index, k, "kth")
    levels = index.levels.select("key", "level", "cuts", "most", "n").where("most > 0")
    rows = asked.select("query_id", "part", "key", "qtf").join(levels, "key").withColumn("most", F.col("qtf") * F.col("most"))
    of_list = Window.partitionBy("query_id", "key").orderBy("most", "level")
    cost = F.greatest(F.col("most") - F.coalesce(F.lag("most").over(of_list), F.lit(0.0)), F.lit(0.0))
    rows = rows.withColumn("cost", cost).withColumn("worth", F.min(F.col("n") / (F.col("cost") + 1e-12)).over(of_list))
    spent = F.sum("cost").over(Window.partitionBy("query_id").orderBy(F.desc("worth"), "key", "most", "level"))
    rows = rows.withColumn("spent", spent).join(reached, "query_id", "left")
    closed = F.coalesce(F.col("spent") <= SPENT * F.col("kth") - ROOM, F.lit(False))
    rest = F.coalesce(F.max(F.when(F.col("closed"), F.col("most"))).over(Window.partitionBy("query_id", "key")), F.lit(0.0))
    return rows.withColumn("closed", closed).select("query_id", "part", "key", "qtf", "level", "cuts", "n", "kth", "closed", rest.alias("rest"))


def opened_blocks(plan: DataFrame) -> DataFrame:
    """query_id, part, key (block), qtf, rest: the blocks of the levels that are not closed."""
    nth = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("nth")
    blocks = plan.where("not closed").select("query_id", "part", "key", "qtf", "rest", "level", nth)
    return blocks.withColumn("key", joined_key(F.col("key"), F.col("level").cast("long") * (1 << 32) + F.col("nth"))).drop("level", "nth")


def level_key(key: Column) -> Column:
    """The list and level of a block, from its key."""
    number = F.substring_index(key, "\0", -1)
    of_list = F.substring(key, F.lit(1), F.length(key) - F.length(number) - 1)
    return joined_key(of_list, F.shiftright(number.cast("long"), 32))


def _sums(plan: DataFrame, index: LexicalIndex) -> DataFrame:
    """query_id, part, id, s, seen: the sums over open blocks, and what the closed levels of these lists can add.

    Few open levels (counted first) are sent to the postings as levels: their blocks grow with the corpus and look small before they are listed, so
    these are never sent, and meet the postings by block. Where queries and what they open are many, both sides are dealt to tasks of
    about ``TASK_HITS`` sums, stored postings too unless levels are sent.
    """
    open_levels = plan.where("not closed")
    row = open_levels.agg(F.count_distinct("query_id").alias("queries"), F.coalesce(F.sum("n"), F.lit(0)).alias("hits"), F.count("*").alias("levels")).first()
    tasks = row["hits"] // TASK_HITS
    postings = index.postings.select("key", "id", "w")
    wide = row["queries"] > MANY and tasks > 0
    if wide:
        tasks = max(tasks, shuffle_partitions(plan.sparkSession))
    if row["levels"] <= MOST_LEVELS:
        opened = open_levels.select("query_id", "part", joined_key(F.col("key"), F.col("level")).alias("key"), "qtf", "rest")
        opened, postings = F.broadcast(opened), postings.withColumn("key", level_key(F.col("key")))
    else:
        opened = opened_blocks(plan)
        if wide:
            opened, postings = opened.repartition(tasks, "key"), postings.repartition(tasks, "key")
        opened = opened.hint("merge")
    hits = postings.join(opened, "key").select("query_id", "part", "id", (F.col("qtf") * F.col("w")).alias("s"), "rest")
    if wide:
        # Entries of one record are of different lists and so in different tasks: adding them up before they meet would only cost memory.
        hits = hits.repartition(tasks, "query_id", "part", "id")
    return hits.groupBy("query_id", "part", "id").agg(F.sum("s").alias("s"), F.sum("rest").alias("seen"))


def _least_sums(asked: DataFrame, index: LexicalIndex) -> DataFrame:
    """query_id, below: the least that all lists of the query together add to any record, 0 or negative."""
    least = index.levels.where("least < 0").groupBy("key").agg(F.min("least").alias("least"))
    return asked.join(least, "key").groupBy("query_id").agg(F.sum(F.col("qtf") * F.col("least")).alias("below"))


def candidates(asked: DataFrame, index: LexicalIndex, k: int) -> DataFrame:
    """query_id, part, id: the records that can still be among the k best of a query."""
    # A row per query is sent along where queries are few (counted), so that the many rows of pairs stay where they are.
    few = asked.select("query_id").distinct().count() <= MOST_SENT
    sent = lambda df: F.broadcast(df) if few else df
    plan = stored(planned(asked, index, k))
    sums = stored(_sums(plan, index))
    by_list = plan.groupBy("query_id", "key").agg(F.max("rest").alias("rest"), F.max("kth").alias("kth"))
    room = by_list.groupBy("query_id").agg(F.sum("rest").alias("all_rest"), F.max("kth").alias("kth"))
    room = room.join(_kth(sums, k, "second"), "query_id", "left").join(_least_sums(asked, index), "query_id", "left")
    reach = (F.col("s") + F.col("all_rest") - F.col("seen") + ROOM).alias("reach")
    least = F.greatest("kth", F.col("second") + F.coalesce("below", F.lit(0.0))).alias("least")
    left = sums.join(sent(room), "query_id").select("query_id", "part", "id", "s", reach, least)
    left = stored(left.where("least is null or reach >= least"))
    third = _reached(_best(left, k), asked, index, k, "third")
    return left.join(sent(third), "query_id", "left").where("third is null or reach >= third").select("query_id", "part", "id")


def exact_scores(pairs: DataFrame, asked: DataFrame, index: LexicalIndex) -> DataFrame:
    """query_id, cand_id, n, raw: the whole score of given pairs of classes (query_id, part, id), where it is above 0."""
    wanted = pairs.select("query_id", joined_key(F.col("part"), F.col("id")).alias("key"))
    terms = wanted.join(index.forward.select("key", "id", "n", "weights"), "key")
    terms = terms.select("query_id", "id", "n", F.explode("weights").alias("e")).select("query_id", "id", "n", "e.term", "e.w")
    scored = terms.join(asked.select("query_id", "term", "qtf"), ["query_id", "term"])
    return scored.groupBy("query_id", F.col("id").alias("cand_id"), "n").agg(F.sum(F.col("qtf") * F.col("w")).alias("raw")).where("raw > 0")


def best_classes(asked: DataFrame, index: LexicalIndex, k: int) -> DataFrame:
    """query_id, cand_id, raw, rank: the k best classes of each class of queries."""
    return _ranked(exact_scores(candidates(asked, index, k), asked, index), k)


def search_index(queries: DataFrame, index: LexicalIndex, k: int = R.CANDIDATES) -> DataFrame:
    """query_id, cand_id, raw, rank: the k best of each query in its category, equal scores by id.

    The k best records are among the first k of the k best classes: classes of equal score go by their smallest id.
    """
    if k > index.depth:
        raise ValueError(f"the index goes {index.depth} deep")
    return _searched(tagged(queries), None, index, k)


def _searched(queries: DataFrame, asked: DataFrame | None, index: LexicalIndex, k: int) -> DataFrame:
    asked = stored(asked_terms(queries)) if asked is None else asked
    owners = class_of(queries).select("part", F.col("id").alias("of"), F.col("class").alias("query_id"))
    part = asked.select("query_id", "part").distinct()
    top = best_classes(asked, index, k).drop("rank", "n").join(part, "query_id").withColumn("key", joined_key(F.col("part"), F.col("cand_id")))
    members = index.members.where(F.col("place") <= k).select("key", "id")
    records = top.join(members, "key").select("query_id", "part", F.col("id").alias("cand_id"), "raw")
    best = _ranked(records, k)
    return best.join(owners, ["query_id", "part"]).select(F.col("of").alias("query_id"), "cand_id", "raw", "rank")


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.floor(F.col("raw") * TIES + 0.5)), "cand_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def shares(top: DataFrame) -> DataFrame:
    """query_id, cand_id, lexical: scores as a share of the query's best."""
    peak = F.max("raw").over(Window.partitionBy("query_id"))
    return top.select("query_id", "cand_id", (F.col("raw") / peak).alias("lexical"))


def bm25_top_k(queries: DataFrame, corpus: DataFrame, k: int = R.CANDIDATES) -> DataFrame:
    """query_id, cand_id, lexical: the k best, as a share of the query's best score; an index of the asked terms is made for it."""
    records = tagged(corpus)
    wanted = records if queries is corpus else tagged(queries)
    asked = stored(asked_terms(wanted))
    return shares(_searched(wanted, asked, _kept(_indexed(records, asked.select("part", "term").distinct(), k)), k))


def pair_lexical(pairs: DataFrame, corpus: DataFrame) -> DataFrame:
    """a, b, lexical: the score of ``b`` for the query ``a`` as a share of a's best in its category.

    Only a's best is searched for; the pairs are scored by themselves.
    """
    records = tagged(corpus)
    queries = records.join(pairs.select(F.col("a").alias("id")).distinct(), "id", "left_semi")
    asked = stored(asked_terms(queries))
    index = _kept(_indexed(records, asked.select("part", "term").distinct(), 1))
    best = best_classes(asked, index, 1).select("query_id", F.col("raw").alias("peak"))
    a = class_of(queries).select("part", F.col("id").alias("a"), F.col("class").alias("query_id"))
    b = class_of(records).select("part", F.col("id").alias("b"), F.col("class").alias("id"))
    wanted = stored(pairs.select("a", "b").distinct().join(a, "a").join(b, ["part", "b"]))
    scores = exact_scores(wanted.select("query_id", "part", "id").distinct(), asked, index).join(best, "query_id")
    share = scores.select("query_id", F.col("cand_id").alias("id"), (F.col("raw") / F.col("peak")).alias("lexical"))
    known = wanted.join(share, ["query_id", "id"]).select("a", "b", "lexical")
    return pairs.select("a", "b").join(known, ["a", "b"], "left").fillna(0.0, ["lexical"])


def every_score(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, cand_id, raw: scores above 0 of all pairs with a common term, the plain way; what searches are held against."""
    records = tagged(corpus).withColumn("n", F.lit(1))
    posting = postings(records)
    norm = R.BM25_K1 * (1 - R.BM25_B + R.BM25_B * F.col("length") / F.col("average_length"))
    weight = F.col("idf") * F.col("tf") * (R.BM25_K1 + 1) / (F.col("tf") + norm)
    idf = inverse_frequencies(category_sizes(records, posting), posting)
    weighted = posting.join(idf, ["part", "term"]).select("part", "term", F.col("id").alias("cand_id"), weight.alias("w"))
    asked = postings(tagged(queries).withColumn("n", F.lit(1))).select(F.col("id").alias("query_id"), "part", "term", "tf")
    found = asked.join(weighted, ["part", "term"]).groupBy("query_id", "cand_id")
    return found.agg(F.sum(F.col("tf") * F.col("w")).alias("raw")).where("raw > 0")
