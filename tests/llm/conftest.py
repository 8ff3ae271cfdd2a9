import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, component_id string, digest string, score string, ranges string, p string, n_tokens string, keep_id string, n_removed string, at string"


@pytest.fixture
def docs(spark):
    """Nulls, an empty and a long text, ties, a repeated row, a shared passage, and columns with clashing names."""
    passage = " ".join(f"p{i}" for i in range(60))
    texts = {1: "Alpha beta gamma delta.", 2: "alpha beta gamma delta.", 3: None, 4: "", 5: f"before {passage} after", 6: f"{passage} only here", 7: "x " * 40, 8: " ".join(f"w{i}" for i in range(9000)), 9: "Größe — naïve <|endoftext|> 日本", 10: "ab"}
    rows = [(i, t, "en", "s", len(t or ""), "a", "b", "c", "d", "e", "f", "g", "h", "i", "j") for i, t in texts.items()]
    rows += [rows[0], (None, "no id", *[None] * 13)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)
