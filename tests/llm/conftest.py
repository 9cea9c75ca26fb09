import random

import pytest

#: Columns beside those that operators read, with names that operators use themselves.
WORKING = "_first _size _key _part _rank_in _toxicity _kept _copies _copy _tie _target _n size key part target copies id u v m".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, length long, rank int, fp long, " + ", ".join(f"`{c}` int" for c in WORKING)


def made(spark, rows):
    """Documents (doc_id, text, source) with clashing columns beside."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 0.5, 3, 1, 9, *range(len(WORKING))) for i, t, s in rows], SCHEMA)


def odd_rows(seed=0, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(50)] + ["Élan", "ñandú", "Straße", "don't", "x.", "漢字"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 120))), f"s{i % 4}" if i % 9 else None) for i in range(n)]
    rows += [(n, None, "s0"), (n + 1, "", "s1"), (n + 2, " \t\n", None), (None, "no id at all", "s2"), (3, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2]), (n + 3, " ".join(["long"] * 30_000), "s3"), (n + 4, rows[5][1], "s1"), (n + 5, rows[5][1], "s1")]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return made(spark, odd_rows()).cache()


@pytest.fixture(scope="session")
def none(spark):
    return made(spark, [])
