import pytest

from tests.conftest import DATA  # noqa: F401

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x % len(WORDS)] + str(x // 65536 % 50))
    return " ".join(out)


def some_documents() -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows, near copies, shared passages."""
    long = prose(1, 9000)
    near = prose(2, 120)
    passage = prose(3, 60)
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, long, "b"), (5, long, "b"), (6, near, "a"), (7, near + " more", None), (8, near.replace("alpha", "omega"), "c"), (9, "one two", "c"), (10, "One TWO", "c")]
    rows += [(11, "x " * 300, "d"), (12, "日本語 テキスト é ü 😀 ▁ <s> [INST]\n" * 9, "d"), (13, passage + "\n" + prose(4, 40), "d"), (14, prose(5, 40) + "\n" + passage, "e")]
    rows += [(20 + i, prose(20 + i, 30 + i), "src" + str(i % 3)) for i in range(20)]
    return rows + [rows[5], rows[13]]


@pytest.fixture(scope="session")
def documents(spark):
    """With extra columns whose names operators use inside."""
    rows = [(i, t, "en", s, len(t or ""), 1, 2, "x", 3) for i, t, s in some_documents()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id int, n int, hash string, size int").repartition(3)
