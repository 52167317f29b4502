"""Documents with every odd case: nulls in any column, empty and long texts, ties, repeats, clashing column names."""

import random

SCHEMA = "doc_id long, text string, source string, n_words long, _t string, _row string, size long, path string, key string, row_no long, lang string"
WORDS = "the of stone river light and house to green wind over small bird song".split()


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) * (r.random() < 0.5) for _ in range(n))


def texts() -> list[tuple[int | None, str | None, str | None]]:
    long = prose(6000, 1)
    base = prose(120, 2)
    near = base.replace(base.split()[60], "changed", 1)
    return [
        (1, None, "a"), (2, "", "a"), (3, " \t\n ", "b"), (4, "one", None), (5, "one", None), (5, "one", None), (6, long, "a"), (7, long, "b"),
        (8, base, "b"), (9, near, "c"), (10, base, "c"), (None, base, "a"), (None, None, None), (11, 'say token = "abcdef0123456789abcd" now', "a"),
        (12, "É日本 🎉 x y", "c"), (13, "Released under the MIT License.\nReleased under the MIT License.", "c"), (14, base.upper(), "a"),
    ]


def docs(spark):
    return spark.createDataFrame([(i, t, s, 7, "x", "y", 3, "p", "k", 1, "en") for i, t, s in texts()], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def listed(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
