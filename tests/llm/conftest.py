import random

import pytest

#: Names that the operators use inside; as extra columns they must not matter.
CLASH = "tag recipe shard slot cid digest score kept chunk __p __r __u __h __b __i __d __digest __words __tf rate copies tokens posterior piece key pii spans first component".split()
SCHEMA = "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in CLASH)


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def texts(seed=3):
    """(doc_id, text): copies, near copies, shared passages, nulls, empties, a very long text, repeated rows."""
    rng = random.Random(seed)
    out, n = [], 0

    def add(text, times=1):
        nonlocal n
        for _ in range(times):
            out.append((n, text))
            n += 1

    passage = " ".join(words(rng, 60))
    for _ in range(25):
        add(" ".join(words(rng, rng.randrange(5, 200))))
    base = words(rng, 150)
    for _ in range(12):
        near = list(base)
        for _ in range(rng.randrange(6)):
            near[rng.randrange(150)] = f"x{rng.randrange(99)}"
        add(" ".join(near))
    for _ in range(15):
        add(" ".join(words(rng, 40)) + "  " + passage + "\n" + " ".join(words(rng, rng.randrange(60))))
    add("Same Text here", 7), add("same text HERE"), add("", 2), add(None, 2), add(" \t\n"), add("one"), add("one two"), add("é ü 漢字   x y")
    add(" ".join(words(rng, 30_000, 5_000)))
    out += [out[0], out[0], (None, "Same Text here"), (None, None), (None, passage), (None, "only here " + " ".join(words(rng, 30)))]
    return out


@pytest.fixture(scope="session")
def rows():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", *["x"] * len(CLASH)) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
