"""The pipeline on the smallest tables: each stage against what it must do with its own input."""

import hashlib
import re

import numpy as np
import public_tokenizers as vocab
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from kerbline.llm.vocab import byte_ranks

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage, on documents with repeated rows, nulls and empty texts."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select(corpus_pipeline.COLUMNS)
    blank = docs.limit(2).select(F.lit(None).cast("bigint").alias("doc_id"), *(F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns[1:]))
    docs = docs.union(docs.orderBy("doc_id").limit(4)).union(blank).union(docs.limit(1).withColumn("text", F.lit("")).withColumn("doc_id", F.lit(10**9).cast("bigint")))
    out, root = {}, tmp_path_factory.mktemp("stages")
    docs.write.parquet(f"{root}/input")
    docs = spark.read.parquet(f"{root}/input")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs.withColumn("score", F.lit("x")).withColumn("kept", F.lit(1)), DIR).write.parquet(f"{root}/{name}")
        result = spark.read.parquet(f"{root}/{name}")
        out[name] = docs.collect(), result.collect(), result.columns
        docs = result
    return out


def test_order_and_columns(stages):
    assert list(stages) == ["toxicity", "language_id", "near_duplicates", "decontamination", "byte_bpe"]
    assert all(columns == corpus_pipeline.COLUMNS for name, (_, _, columns) in stages.items() if name != "byte_bpe")


def test_filters_only_take_rows_away(stages):
    for name in ("toxicity", "language_id", "near_duplicates", "decontamination"):
        before, after, _ = stages[name]
        left = [tuple(r) for r in before]
        for row in after:
            left.remove(tuple(row))
        assert len(after) > 0.5 * len(before)


def test_toxicity_keeps_blank_and_clean_rows(stages, spark):
    before, after, _ = stages["toxicity"]
    clean = {r["doc_id"] for r in spark.read.parquet(f"{DIR}/labels.parquet").where("toxic = 0").collect()}
    kept = {r["doc_id"] for r in after}
    assert sum(r["text"] is None for r in after) == 2
    assert len(clean & kept) >= 0.97 * len(clean & {r["doc_id"] for r in before})


def test_language_rejects_texts_without_letters(stages):
    _, after, _ = stages["language_id"]
    assert all(r["text"] and any(map(str.isalpha, r["text"])) for r in after)


def test_near_duplicates_against_all_pairs(stages):
    before, after, _ = stages["near_duplicates"]

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())

    sets = {}
    for r in before:
        sets.setdefault(r["doc_id"], set()).update(shingles(r["text"]))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    assert sorted(r["doc_id"] for r in after) == sorted(d for d in ids if find(d) == d)


def test_decontamination_takes_verbatim_items(stages, spark):
    before, after, _ = stages["decontamination"]
    plain = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    items = [plain(r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    holds = {r["doc_id"] for r in before if any(i and i in plain(r["text"]) for i in items)}
    assert not holds & {r["doc_id"] for r in after}


def test_round_trip(stages):
    before, after, columns = stages["byte_bpe"]
    assert columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    library = tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=byte_ranks(vocab.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r["doc_id"]: r for r in after}
    assert len(got) == len(before)
    for r in before:
        ids = library.encode_ordinary(r["text"] or "")
        assert got[r["doc_id"]]["ids"] == ids and got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_run(spark):
    out = corpus_pipeline.run(spark, DIR)
    assert out.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < out.count() < 200
