from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Also columns whose names the operators use inside.
CLASHING = DOCS + ", th long, b string, marks string, k_id long, component_id long, start long"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices("abcdeéß", k=rng.randint(1, 7))) + rng.choice(["", "", ",", "."]) for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """Exact and near copies, a shared passage, periodic, empty and null texts, a very long one."""
    rng = random.Random(5)
    passage = words(rng, 90)
    base = words(rng, 200)
    texts = [" ".join(base)] * 6
    for i in range(8):
        near = base[:]
        near[20 * i] = "changed"
        texts.append(" ".join(near))
    for i in range(8):
        own = words(rng, 60 + 10 * i)
        texts.append(" ".join(own[:30]) + "\n" + " ".join(passage[i:]) + "\t" + " ".join(own[30:]))
    texts += [" ".join(words(rng, n)) for n in (1, 2, 3, 49, 50, 51, 120, 3000)]
    texts += ["x " * 400, "x " * 130 + "y", "ab" * 700, None, "", "  \n ", "12 34 !?", "a", "Ünïcödé " * 60, "ends <|endoftext|> and goes on", "two  spaces\n\nand lines"]
    return [(i * 3, t, "en", "s", len(t) if t else 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2, 3, 4) for r in rows], CLASHING).repartition(3)


@pytest.fixture(scope="session")
def pairs(rows):
    return [(r[0], r[1]) for r in rows]


@pytest.fixture
def scratch(spark):
    from matchloom.llm.common import Scratch

    return Scratch(spark, "test")


def got(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, str(r)))
