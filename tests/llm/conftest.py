import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Some hard documents: null, empty, blank, long, equal, near-equal, repeated; columns of clashing names; a null id."""
    base = [f"w{i * 7919 % 97}" for i in range(120)]
    text = " ".join(base)
    rows = [
        (1, text, "en", "b", 1),
        (2, text, "en", "b", 2),
        (3, " ".join([*base[:60], "changed", *base[61:]]), "en", "a", 3),
        (4, None, None, None, None),
        (5, "", "fr", "a", 5),
        (6, " \t\n ", "fr", "\U0001f600", 6),
        (7, "short text", "fr", "a", 7),
        (8, "é" * 30 + " " + text[:200] + "\nUnder the MIT License\nLicensed under the Apache License, Version 2.0.\n" + text[:200], "en", "c", 8),
        (9, "a b " * 40000, "en", "a", 9),
        (10, " ".join(f"u{i}" for i in range(40)) + " " + " ".join(base[20:50]), "de", "b", 10),
        (10, " ".join(f"u{i}" for i in range(40)) + " " + " ".join(base[20:50]), "de", "b", 10),
        (11, "Same line here.\nSame line here.\n<b>#$%</b> & more | words to make it ten in all", "en", "c", 11),
        (None, text, "en", "a", 12),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long").repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
