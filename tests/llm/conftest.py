import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named as the operators' own."""
    long = " ".join(f"word{i % 977} other{i % 31}" for i in range(30_000))
    same = "the same line of words that stands here and there again and again without any end at all today\nand a second line that is also the same"
    rows = [
        (1, same, "en", "a", 1), (2, same, None, None, None), (2, same, None, None, None), (3, None, "en", "b", 0), (4, "", "", "", 0), (5, long, "de", "a", 5), (6, long + " more", "de", "b", 5),
        (None, same, "fr", "a", 2), (None, None, None, None, None), (7, "  \t\n ", "en", "c", 3), (8, "One", "en", "é", 3), (9, "One two", "en", "😀", 3), (10, "x" * 200_000, "en", "a", 3), (-5, same + " tail", "en", "a", 1),
        (11, "a<|im_start|>b <|endoftext|> c", "en", "z", 0), (12, "éàü 漢字 😀   x y\r\n\r\nz  w", "fr", "z", 0),
    ]
    clash = ", ".join(f"'{c}' as {c}" for c in ("size", "taken", "score", "n_words", "fp", "component_id", "n_links", "host", "kept_text", "n_bytes", "row", "id", "batch", "rules"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *clash.split(", "))


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
