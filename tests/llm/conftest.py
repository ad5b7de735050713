import pytest
from llm_texts import messy_texts

MESSY = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int, row string, component_id string, shard string, text_hash string, key string, a string"


@pytest.fixture(scope="session")
def messy(spark):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 7 else None, None, "k", 1, "r", "c", "s", "h", "y", "z") for i, t in enumerate(messy_texts())]
    rows += [rows[0], rows[0], (None, "one two three four five six", None, None, None, "k", 1, "r", "c", "s", "h", "y", "z")]
    return spark.createDataFrame(rows, MESSY).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)
