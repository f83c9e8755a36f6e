import random

import pytest

SOURCES = ["b", "a", None, "ä"]
CLASHES = ["row_key", "chunk", "key", "size", "fp", "shard", "id", "group", "piece", "text_sha256", "range"]


@pytest.fixture(scope="session")
def hostile(spark, tmp_path_factory):
    """Documents with null, empty, very long and repeated texts, null and repeated ids, repeated
    rows, null columns, and extra columns named like the operators' own; stored as a table."""
    rnd = random.Random(4)
    words = ["the", "Cat", "sat,", "ÉTÉ", "mat", "häuser", "x1", "dog s", "foo's", "<|endoftext|>", "日本", "it's"]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60))) for _ in range(25)]
    texts = [None, "", " ", "\t\n", "!!!", "12 34", "a", "x" * 300, "ab " * 30_000, "\x1c\x1d"]
    texts += [rnd.choice(base) for _ in range(60)]
    texts += [rnd.choice(base).replace(" ", "\n", 1) for _ in range(20)]
    texts += [rnd.choice(base) + " " + rnd.choice(base) for _ in range(40)]
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    ids[3] = ids[4] = ids[30] = None
    ids[50] = ids[51]
    rows = [(i, t, rnd.choice(["en", "de", None]), rnd.choice(SOURCES)) for i, t in zip(ids, texts)]
    rows += rows[40:44]
    return _table(spark, rows, str(tmp_path_factory.mktemp("docs") / "documents.parquet"))


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return _table(spark, [], str(tmp_path_factory.mktemp("none") / "documents.parquet"))


def _table(spark, rows, path):
    extra = ", ".join(f"`{c}` string" for c in CLASHES)
    rows = [(*r, *["x"] * len(CLASHES)) for r in rows]
    df = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {extra}")
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def keyed(hostile):
    """The rows as the operators number them: row_key -> (doc_id, text, lang, source)."""
    from pyspark.sql import functions as F
    rows = hostile.select(F.monotonically_increasing_id().alias("k"), "doc_id", "text", "lang", "source").collect()
    return {r["k"]: (r["doc_id"], r["text"], r["lang"], r["source"]) for r in rows}
