import pytest

TEXTS = [
    "The quick brown fox jumps over the lazy dog near the river bank",
    "The quick brown fox jumps over the lazy dog near the river bank",
    "the Quick brown  fox jumps over the lazy dog near the river bank",
    "",
    None,
    "   \n\t ",
    "word",
    "line one here\nline two here\nline one here\n\n#$% symbols & more <tags>",
    "a@b.co and 10.0.0.1 or +1 (212) 555-0199, card 4111 1111 1111 1111 end",
    "x" * 5000,
    "ab " * 3000,
    "é ü ñ 日本語 😀 text with\u00a0odd\u2003spaces\r\nand\x0bmore",
]


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls in any column, empty and long texts, copies, a repeated row, a repeated id, and columns whose names clash."""
    rows = [(i, t, None if i == 2 else "en", None if i % 4 == 3 else f"src{i % 4}", None if i == 1 else len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [rows[0], (6, "another text of id six", "de", "src1", 22), (None, "a text without an id", "fr", "src2", 20)]
    odd = "score double, predicted int, row string, spans string, base string, copies long, hash long, size long, taken long, th long, n_email string, host string"
    return spark.createDataFrame([(*r, 0.5, 1, "r", "s", "b", 3, 4, 5, 6, 7, "e", "h") for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {odd}")


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.limit(0)
