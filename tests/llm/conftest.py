"""Tables with every odd case: nulls, empty and long texts, ties, repeated rows, clashing names."""

import pytest

ODD_TEXTS = [
    None, "", " \n\t ", "!!! ... ---", "word", "one two three", "ÄÖÜ straße Σίσυφος İstanbul",
    "same text here", "same text here", "x" * 50_000, "long words and more words " * 4_000,
    "\x00\x1f control lines\x85end", "😀 emoji 中文 текст", "<|endoftext|> <|startoftext|>a",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, **extra):
        rows = [(k, text, None if k % 5 == 0 else "en", None if k % 3 == 0 else "s",
                 None if text is None else len(text)) for k, text in enumerate(texts)]
        frame = spark.createDataFrame(rows, SCHEMA)
        for name, value in extra.items():
            frame = frame.selectExpr("*", f"{value} AS `{name}`")
        return frame
    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """The odd texts, one row twice, a row of nulls, and columns named like results."""
    clash = dict.fromkeys(
        ("n_tokens", "_id", "_text", "ids", "spans", "size", "shard", "slot", "n_words", "items",
         "node", "root", "score", "kept", "n_links", "component_id"), "'mine'")
    docs = make_docs(ODD_TEXTS, **clash)
    nulls = docs.limit(1).selectExpr(*(
        f"cast(NULL AS {kind}) AS `{name}`" for name, kind in docs.dtypes))
    return docs.union(docs.where("doc_id = 5")).union(nulls)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
