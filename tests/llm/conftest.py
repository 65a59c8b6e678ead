import pytest

from cytotide.llm.common import ready

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module", autouse=True)
def session_is_ready(spark):
    """The operators' session state, and settings that suit a few rows: no compiled code, few partitions."""
    ready(spark)
    small = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN",
             "spark.sql.shuffle.partitions": "3"}
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text[, lang, source]) as a documents table; ``extra`` adds columns whose names clash with ours."""
    def make(rows, extra=False):
        full = [(i, t, *(r[0] if r else ("en", "a")), None if t is None else len(t)) for i, t, *r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        if extra:
            from pyspark.sql import functions as F
            names = ["TEXT", "Doc_ID", "size", "shard", "fp", "key", "root", "hash", "range", "list", "text"]
            df = df.select("*", *[F.lit(f"x{i}").alias(n) for i, n in enumerate(names)])
        return df
    return make
