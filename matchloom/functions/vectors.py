"""Dense vectors in arrays, and n-gram weights in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product, added up in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: (x.cast("double") / norm).cast("float"))).otherwise(F.transform(v, lambda x: x.cast("float")))


def half_precision(v: Column) -> Column:
    """Each number at eleven significant bits, as half-precision floats keep them."""

    def rounded(x):
        x = x.cast("double")
        scale = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14)) - 10)
        return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x / scale) * scale).cast("float")

    return F.transform(v, rounded)


def blend(cos_name: Column, cos_addr: Column, both: Column, weight: float) -> Column:
    """Name and address together where both sides have an address, else the name alone."""
    return F.when(both, weight * cos_name + (1 - weight) * cos_addr).otherwise(cos_name)


def char_ngrams(text: Column, low: int = 2, high: int = 4) -> Column:
    """Grams of each word between one space at either end; a word shorter than a gram gives itself once."""

    def windows(padded: Column, n: Column, size: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: padded.substr(i.cast("int"), F.lit(size)))

    def of_word(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        n = F.length(padded)
        parts = []
        for size in range(low, high + 1):
            every = windows(padded, n, size)
            # The size that the padded word reaches gives the word itself, and longer sizes nothing more.
            parts.append(F.when(n >= size, every).otherwise(F.array().cast("array<string>")))
        return F.flatten(F.array(*parts))

    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return F.flatten(F.transform(words, of_word))


def term_frequencies(texts: DataFrame, id_col: str, text_col: str, buckets: int | None = None) -> DataFrame:
    """``id, gram, tf``; with ``buckets`` the gram is a bucket number."""
    gram = F.explode(char_ngrams(F.col(text_col)))
    grams = texts.select(F.col(id_col).alias("id"), gram.alias("gram"))
    if buckets:
        grams = grams.withColumn("gram", F.pmod(F.xxhash64("gram"), F.lit(buckets)))
    return grams.groupBy("id", "gram").agg(F.count("*").alias("tf"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("gram").agg(F.count("*").alias("df"))


def tfidf(tf: DataFrame, df: DataFrame, n: int) -> DataFrame:
    """``id, gram, w``: sublinear frequency times smooth inverse document frequency, at length 1 per id."""
    idf = F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0
    raw = tf.join(df, "gram").select("id", "gram", ((1.0 + F.log("tf")) * idf).alias("raw"))
    norms = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norms, "id").select("id", "gram", (F.col("raw") / F.col("norm")).alias("w"))
