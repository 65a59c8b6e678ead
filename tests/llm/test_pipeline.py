"""The pipeline's stages on a small corpus, each against what it should keep, and the registered queries."""

import random
import re
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from cytotide.llm import simhash
from cytotide.llm.queries import queries
from tests_llm_helpers import brute_classes_of

WORDS = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A documents and a benchmark table with copies, leaks, junk and empty texts."""
    rnd = random.Random(1)
    say = lambda n: " ".join(rnd.choice(WORDS) + str(rnd.randrange(40)) for _ in range(n))
    items = [say(30) for _ in range(3)]
    texts = [say(rnd.randint(20, 90)) for _ in range(80)]
    texts += [texts[0]] * 3 + [texts[1] + " end"] + [say(30) + " " + items[0] + " " + say(20), items[1]]
    texts += [None, "", "12 %% 34"]
    rows = [(i, t, "en" if i % 5 else "fr", f"src{i % 3}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), dict(enumerate(texts))


def test_stages_in_order(spark, folder):
    at, texts = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, at).cache()
        kept[name] = docs.collect()
        if name != "shards":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {name: Counter(r.doc_id for r in rows) for name, rows in kept.items()}
    told = [i for i, t in texts.items() if t and any(c.isalpha() for c in t)]
    assert sorted(ids["language"]) == told
    assert ids["near_duplicates"] == Counter(brute_classes_of({i: texts[i] for i in told}))
    leaks = {84, 85}
    assert set(ids["leaks"]) == set(ids["near_duplicates"]) - leaks
    assert set(ids["mix"]) <= set(ids["leaks"]) and max(ids["mix"].values()) <= 3
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    assert abs(words(kept["mix"]) - words(kept["leaks"])) <= 4
    assert Counter((r.doc_id, r.text) for r in kept["shards"]) == Counter((r.doc_id, r.text) for r in kept["mix"])
    for s in {r.shard for r in kept["shards"]}:
        slots = sorted(r.slot for r in kept["shards"] if r.shard == s)
        assert slots == list(range(len(slots)))
    ran = corpus_pipeline.run(spark, at).collect()
    assert Counter((r.doc_id, r.text, r.shard) for r in ran) == Counter((r.doc_id, r.text, r.shard) for r in kept["shards"])


def test_pipeline_of_an_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder[0]}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(queries()) == set(names) and simhash.SHINGLE == 3 and simhash.DISTANCE == 2
