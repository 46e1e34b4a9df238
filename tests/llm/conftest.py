import pytest
from pyspark.sql import types as T

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
MIT = "Released under the MIT license."

# doc_id, text, lang, source, n_chars, and columns named like things the operators use inside.
ROWS = [
    (5, None, "en", "a", 0),
    (6, "", "en", "a", 0),
    (7, " \t\n ", "en", None, 3),
    (8, LONG, "en", "a", len(LONG)),
    (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 1),
    (2, "The quick  brown fox jumps over the lazy dog again and again", "en", "b", 1),
    (3, "the Quick brown\nfox jumps over the lazy dog again and again", "en", "b", 1),
    (4, "The quick brown fox jumps over the lazy dog again and again", "de", "a", 1),
    (9, "start " + PASSAGE + " end", "en", "c", 1),
    (10, "other " + PASSAGE + " " + PASSAGE + " words", "en", None, 1),
    (None, PASSAGE, "en", "c", 1),
    (11, MIT + " é ñ ß, write to jane.doe@example.org or +1 (377) 555-0271", None, "b", 1),
    (11, MIT + " é ñ ß, write to jane.doe@example.org or +1 (377) 555-0271", None, "b", 1),
    (12, "Of Of Of Of", "en", "b", 1),
    (13, "one", "en", "d", 1),
    (14, "one", "en", "d", 1),
    (15, "zero\x00byte and \U0001f600 wide", "en", "d", 1),
] + [(100 + i, f"filler text number {i} with some more words {i * 7} to fill a line", "en", f"s{i % 3}", 1) for i in range(40)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("key", "row", "code", "size", "bin", "score", "_doc", "digest", "component_id", "doc", "kept")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def wide_docs(docs):
    """The same rows with clashing extra columns, null and not."""
    return docs.selectExpr("*", *[f"if(doc_id % 2 = 0, null, {i}) as `{c}`" for i, c in enumerate(CLASHES)])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], T._parse_datatype_string(SCHEMA))
