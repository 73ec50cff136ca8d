import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def edge_texts() -> dict:
    """Texts at the edges: null, empty, blank, one very long, copies, control bytes, many scripts."""
    long = " ".join(f"word{k % 997} tail{k % 13}," for k in range(15_000))
    return {
        1: None,
        2: "",
        3: " \t\n ",
        4: long,
        5: "same line of text that is shared\nother",
        6: "same line of text that is shared\nmore",
        7: "  SAME line of text that is SHARED \x0b\nSame line of text that is shared\n",
        8: "same line of text that is shared\nother",
        9: "Zu wenig Ä Öl 漢字 \U0001f600 é İ Σ </s> [INST] \\ \\\\",
        10: "a b c d e f g a b c d e f g",
        11: "\n\n\n",
        12: "x" * 5000,
    }


@pytest.fixture(scope="session")
def edges(spark):
    rows = [(d, t, "en", "s", len(t or "")) for d, t in edge_texts().items()]
    return spark.createDataFrame([*rows, rows[9]], DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")
