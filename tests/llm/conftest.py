import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that operators use for their own columns.
CLASHING = ["size", "target", "taken", "score", "secrets", "hits", "item_ids", "n_words", "node", "label", "text_", "host", "anomaly", "lang_pred", "source_size", "copies", "class", "u", "rank", "bin", "_rest"]


@pytest.fixture(scope="session", autouse=True)
def folder(spark, tmp_path_factory):
    """The shared folder of the session; one of our own only where the session names none."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def documents(spark):
    """Make a documents table of (doc_id, text[, lang, source]) rows."""

    def make(rows, extra=()):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        schema = T.StructType([*DOC.fields, *(T.StructField(n, T.StringType()) for n in extra)])
        return spark.createDataFrame([(*r, *("x" for _ in extra)) for r in full], schema)

    return make


@pytest.fixture(scope="session")
def prose():
    """Distinct pseudo-random prose of n words; the same seed gives the same words."""
    import random

    def make(seed, n, vocabulary=5000):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(2 + w % 3)) for w in (rng.randrange(vocabulary) for _ in range(n)))

    return make
