from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, t string, k1 long, k2 long, rid long, score double, text_ string, spans_ string, copies int, `key` string, h long, word string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, ties, a very long text, and clashing extra columns."""
    prose = "the quick brown fox jumps over the lazy dog near the river bank while seven small birds sing loudly in an old oak tree " * 4
    rows = [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \n\t ", None, None),
        (4, prose, "en", "a"),
        (4, prose, "en", "a"),
        (5, prose, "en", "b"),
        (6, prose.replace("river", "lake", 1), "en", None),
        (None, prose + "extra", "en", "b"),
        (8, "word", "en", "b"),
        (9, "x" * 100_000, "en", "b"),
        (10, "mail me at jo.doe@mail.example.org or +49 (30) 1234-5678, card 4111 1111 1111 1111, host 10.0.0.1", "en", "a"),
        (11, " ".join(f"w{k % 977}" for k in range(60_000)), "en", "b"),
        (12, "日本語 ▁ text\r\nwith  double  spaces", "xx", "a"),
    ]
    extra = (7, "r", "t", 1, 2, 3, 0.5, "t_", "s_", 1, "k", 9, "w")
    return spark.createDataFrame([(*r, len(r[1] or ""), *extra) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 1, 0), (9, 0, 1), (11, 0, 0), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
