"""Small tables for the operators: odd rows, clashing names, nothing at all."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

DOC_SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "size long, fp long, row string, digest long, nth int, blocks string, component_id long"
)
SYLLABLES = "tha ner ion est ver und que cion ado lich".split()


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


def rows():
    """Nulls, empty and blank texts, copies, near copies, repeated rows, one very long text."""
    rng = random.Random(7)
    base = [words(rng, 120) for _ in range(6)]
    texts = {
        1: base[0],
        2: base[0],
        3: base[1],
        4: base[1].replace("tha", "Tha", 1) + " end",
        5: None,
        6: "",
        7: " \n\t ",
        8: "one",
        9: "two words",
        10: "ÄÖ ß é " + base[2],
        11: base[2] + "\n" + base[2],
        12: words(rng, 30_000),
        13: "12 34 -- !!",
        14: base[3] + "\x1c x",
        15: base[4],
        16: "a a a a a a a a a a a a " * 30,
    }
    out = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None) for i, t in texts.items()]
    out += [out[2], out[2], (None, base[5], None, None), (None, None, "de", "s1")]
    return out


@pytest.fixture(scope="session")
def odd_rows():
    return rows()


@pytest.fixture(scope="session")
def odd_docs(spark):
    extra = ("x", 1, "r", 2, 3, "b", 4)
    data = [
        (i, t, lang, source, len(t or ""), 9, extra[1], extra[2], extra[3], extra[4], extra[5], extra[6])
        for i, t, lang, source in rows()
    ]
    return spark.createDataFrame(data, DOC_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

