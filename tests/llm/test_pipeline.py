"""The corpus pipeline against a brute-force version of its five stages."""

import hashlib
import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_dedup import brute_components, brute_lines
from test_native_operators import brute_counts

from lodestitch.llm.byte_bpe import read_ranks

ITEM = "the question asks which river crosses seven old stone bridges before it meets the cold northern sea"


def documents():
    rng = random.Random(11)
    v = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te", "vo") for b in ("ban", "cor", "dal", "fen", "gim", "hos", "jet")]
    common = " ".join(rng.choice(v) for _ in range(12))
    rows = []
    for i in range(90):
        lines = [" ".join(rng.choice(v) for _ in range(rng.randint(3, 30))) for _ in range(rng.randint(1, 5))]
        k = i % 9
        if k == 1:
            lines.insert(0, common)
        elif k == 2 and rows:
            lines = rows[rng.randrange(len(rows))][1].split("\n")  # a copy
        elif k == 3 and rows:
            words = rows[rng.randrange(len(rows))][1].replace("\n", " ").split()
            words[rng.randrange(len(words))] = "changed"
            lines = [" ".join(words)]
        elif k == 4:
            lines = ["spam spam ham " * 20]
        elif k == 5:
            lines.append(f"{' '.join(rng.choice(v) for _ in range(6))}. {ITEM} {rng.choice(v)}")
        rows.append((i, "\n".join(lines), rng.choice(["en", None]), "src", 0))
    rows[7] = (7, None, "en", "src", None)
    rows[8] = (8, "", "en", None, 0)
    return rows


def brute(rows):
    """doc_id -> text of what is left before the last stage."""
    kept = [(i, t) for i, t, *_ in rows if (c := brute_counts(t))[0] >= 20 and 100 * c[4] <= 30 * c[0]]
    kept = [(i, t) for i, t, gone in brute_lines(kept) if not (gone and not t.strip(" "))]
    first = {i for i, _, c in brute_components(kept, 80, 5) if i == c}
    return {i: t for i, t in kept if i in first and ITEM not in t}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(documents(), schema).write.parquet(f"{base}/documents.parquet")
    labels = [(i, int(i % 9 != 4), 0) for i in range(0, 90, 3)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def test_run_equals_brute_force(spark, tables):
    expected = brute(documents())
    assert 20 < len(expected) < 80
    codec = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={}
    )
    digests = {}
    for i, t in expected.items():
        ids = np.array(codec.encode_ordinary(t), "<u4")
        digests[i] = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in corpus_pipeline.run(spark, tables).collect()} == digests


def test_stages_keep_the_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), tables).count() == 0


def test_stages_take_nulls_repeats_and_clashing_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    wide = ["uid", "n_lines", "removed_lines", "labelled_id", "row", "rest", "stratum", "kept", "g", "n", "v", "carry_0", "a.b"]
    nobody = docs.limit(9).withColumn("doc_id", F.lit(None).cast("long"))
    own = nobody.limit(2).withColumn("text", F.lit(" ".join(f"own{i}" for i in range(25))))
    odd = docs.unionByName(docs.limit(20)).unionByName(nobody).unionByName(own)
    odd = odd.select("*", *[F.lit(i).alias(c) for i, c in enumerate(wide)], F.concat("doc_id", F.lit("x")).alias("mark"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, tables)
        rows = out.collect()
        assert out.columns == odd.columns and out.dtypes == odd.dtypes and rows, name
        assert all([r[c] for c in wide] == list(range(len(wide))) for r in rows), name
        assert all(r["mark"] == (None if r["doc_id"] is None else f"{r['doc_id']}x") for r in rows), name
        assert any(r["doc_id"] is None for r in rows), name


def test_a_copy_with_short_and_blank_lines_leaves_nothing(spark, tables):
    long = "the quiet harbour kept its old lamps burning through the winter night"
    text = f"A Title\n\n{long}\n \t\nPart two\n\n{long} again and again"
    rows = [(1, text), (2, text), (3, f"Its own title\n{long}"), (4, "\n\n"), (5, None), (6, f"\n\n{long}\n\r\n")]
    docs = spark.createDataFrame([(i, t, "en", "src", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, tables).collect()}
    assert left == {1: text, 3: "Its own title", 4: "\n\n", 5: None}
