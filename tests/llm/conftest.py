import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, copy string, row string, tokens string, kept string, part string"


def passage(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words)).capitalize() + "."


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank, tiny and very long texts, equal texts, repeated rows, and clashing column names."""
    shared = passage(99, 60)
    texts = [
        (1, None), (2, ""), (3, " \n\t "), (4, "Hi"), (5, passage(5, 80)), (5, passage(5, 80)), (6, passage(5, 80)), (7, passage(7, 40) + " " + shared + " " + passage(8, 40)),
        (8, passage(9, 30) + "\n" + shared), (9, "the " * 30000), (10, passage(10, 20000)), (None, passage(11, 60)), (12, "Ünïcödé 😀 <|endoftext|> \u0001 x'll"),
        (13, "A. B. C. A. B. C."), (14, None), (None, None),
    ]
    rows = [(i, t, None if k % 5 == 4 else "en" if k % 2 else "de", None if k % 4 == 3 else f"src{k % 3}", None if t is None else len(t), *"abcde") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
