import datetime

import pytest

LONG = " ".join(f"wörd{i % 977} tail{i % 31}" for i in range(30_000))
TEXTS = [
    None, "", " ", "\n\n", "one", "one two\nthree  four\t five\r\nsix ", "  lead", "trail \n", "über naïve 'tis can't",
    "nbsp here", "em space run", "<|endoftext|> as text", "a|b | c", "tab\tend\n\n\nmore", "日本語 text 12345",
    LONG, "one", "one",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns with clashing names."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "src1") for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "one", None, None), (None, None, "de", "src2")]
    names = ["text_sha256", "kept", "maybe", "tokens", "budget", "score", "ids", "n", "_row", "fingerprint", "component_id"]
    day = datetime.date(2020, 1, 1)
    wide = [(*r, *[7] * (len(names) - 1), day) for r in rows]
    schema = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"`{n}` int" for n in names[:-1])
    return spark.createDataFrame(wide, schema + f", `{names[-1]}` date")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
