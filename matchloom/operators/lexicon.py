"""Learns what words of Indic scripts mean from linked records.

Names of linked records align word by word if they have equally many; address
components align with every component of the entity that has as many words, and
a component of a single word with whole components.  Alignments become rows,
and counts, shares and the choice are ordinary aggregates over them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.text import fold

_INDIC = re.compile(f"[{fixed.INDIC}]")
ALIGNED = "view string, word string, target string, n long, seen long"
_ALIGNED = pa.schema([("view", pa.string()), ("word", pa.string()), ("target", pa.string()), ("n", pa.int64()), ("seen", pa.int64())])


#: Marks hold no digits, which folding may change.
_DIGITS = str.maketrans("0123456789", "bdfghjkmnp")


class _Marks:
    """Stands in for the lexicon and gives each Indic word a mark that survives folding."""

    def __init__(self):
        self.words: dict[str, str] = {}

    def get(self, word: str) -> str:
        mark = f"qx{len(self.words):06d}xq".translate(_DIGITS)
        self.words[mark] = word
        return mark


def aligned(own: str, other: str) -> Iterator[tuple[str, str]]:
    """(Indic word, English word) at equal places of two texts with equally many words."""
    marks = _Marks()
    left, right = fold(own, marks).split(), fold(other).split()
    if len(left) == len(right):
        yield from ((marks.words[a], b) for a, b in zip(left, right) if a in marks.words and not b.isdigit())


def align_component(component: str, others: list[str]) -> tuple[set[str], set[tuple[str, str]]]:
    """The component's Indic words, and its distinct (word, target) pairs."""
    marks = _Marks()
    words = fold(component, marks).split()
    if len(words) == 1 and words[0] in marks.words:
        pairs = {(marks.words[words[0]], fold(o)) for o in others}
    else:
        pairs = {pair for o in others for pair in aligned(component, o)}
    return set(marks.words.values()), pairs


def alignments(pairs: DataFrame) -> DataFrame:
    """Rows of ``name1, addr1`` (entity) and ``name2, addr2`` (pool) to counted alignments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n1, a1, n2, a2 in zip(*(batch.column(c).to_pylist() for c in ("name1", "addr1", "name2", "addr2"))):
                if n2 and _INDIC.search(n2):
                    out += [("name", w, t, 1, 0) for w, t in aligned(n2, n1 or "")]
                if a2 and _INDIC.search(a2):
                    others = [c for c in (a1 or "").split(",") if c.strip()]
                    for component in a2.split(","):
                        if _INDIC.search(component):
                            words, found = align_component(component, others)
                            out += [("addr", w, None, 0, 1) for w in words]
                            out += [("addr", w, t, 1, 0) for w, t in found]
            columns = zip(*out) if out else [[] for _ in _ALIGNED]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _ALIGNED)], schema=_ALIGNED)

    return pairs.select("name1", "addr1", "name2", "addr2").mapInArrow(run, ALIGNED)


def choose(counted: DataFrame, least: int = 3, purity: float = 0.6, together: float = 0.8) -> DataFrame:
    """``word, english``: the commonest target, if common and sure enough; names win over addresses."""
    sums = counted.groupBy("view", "word", "target").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))
    own = Window.partitionBy("view", "word")
    whole = F.when(F.col("view") == "name", F.sum("n").over(own)).otherwise(F.sum("seen").over(own))
    by = own.orderBy(F.col("target").isNull(), F.desc("n"), "target")
    top = sums.withColumns({"whole": whole, "place": F.row_number().over(by)}).where("place = 1 and target is not null")
    share = F.when(F.col("view") == "name", purity).otherwise(together)
    good = top.where((F.col("n") >= least) & (F.col("n") / F.col("whole") >= share))
    return good.groupBy("word").agg(F.max_by("target", "view").alias("english"))


def linked_texts(links: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """Raw texts of linked records whose pool side has Indic text; fails on a link to a record that isn't there."""
    left = s1.select(F.col("entity_id").alias("s1_id"), F.col("business_name").alias("name1"), F.col("business_address").alias("addr1"), F.lit(1).alias("k_s"))
    right = pool.select(F.col("entity_id").alias("pool_id"), F.col("business_name").alias("name2"), F.col("business_address").alias("addr2"), F.lit(1).alias("k_p"))
    joined = links.join(left, "s1_id", "left").join(right, "pool_id", "left")
    missing = F.raise_error(F.concat(F.lit("no record for link "), F.col("s1_id"), F.lit(" "), F.col("pool_id")))
    joined = joined.withColumn("k_s", F.when(F.col("k_s").isNull() | F.col("k_p").isNull(), missing.cast("int")).otherwise(1))
    return joined.where(F.col("k_s") == 1).where(F.col("name2").rlike(f"[{fixed.INDIC}]") | F.col("addr2").rlike(f"[{fixed.INDIC}]")).select("name1", "addr1", "name2", "addr2")


def learn(pairs: DataFrame, **rules) -> dict[str, str]:
    """The lexicon as a dictionary: words seen at least three times, a few thousand at most."""
    return {r["word"]: r["english"] for r in choose(alignments(pairs), **rules).collect()}
