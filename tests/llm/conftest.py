from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, n long, value string, `Start` long"
ODD = "Zahl ein Wort zwei drei vier fünf sechs sieben acht neun zehn elf zwölf"


def frame(spark, texts, langs=None):
    """Documents with extra columns whose names clash with inner ones."""
    rows = [(i, t, (langs or {}).get(i), f"s{(i or 0) % 2}" if (i or 0) % 5 else None, None if t is None else len(t), 7, 8, "x", 9) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank and very long texts, copies, a repeated row, a null id."""
    long = " ".join(f"w{k % 977}x{k % 31}" for k in range(40_000))
    texts = [
        (1, None), (2, ""), (3, " \t\n"), (4, "Eins"), (5, ODD), (6, ODD.upper().replace("Ü", "ü").replace("Ö", "ö")), (7, ODD + " dreizehn"), (8, long), (9, long + " end"),
        (5, ODD), (None, ODD), (10, "a" * 50_000), (11, "1 " * 2_000), (12, "x@" * 5_000 + "y.z"), (13, "..,, !! 12 34"), (14, "日本語 текст İstanbul <|endoftext|> é"),
    ]
    return frame(spark, texts)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])
