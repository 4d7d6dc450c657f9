"""Small tables and brute-force helpers of the training-data tests."""

import hashlib
import re

from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


def make(spark, rows, **extra):
    """documents from (doc_id, text[, lang[, source]]) rows; ``extra`` adds constant columns."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1]) if r[1] is not None else None)
            for r in rows]
    df = spark.createDataFrame(full, DOCS)
    from pyspark.sql import functions as F
    for k, v in extra.items():
        df = df.withColumn(k, F.lit(v))
    return df


def sentence(seed, n):
    """n words that depend on the seed only."""
    out, h = [], seed
    for i in range(n):
        h = int(hashlib.md5(f"{seed}-{i}".encode()).hexdigest(), 16)
        out.append("".join("abcdefghiklmnoprstu"[h >> 4 * k & 15] for k in range(3 + h % 5)))
    return " ".join(out)


#: Texts that every operator must take: null, empty, blank, one word, repeats, controls, other scripts, very long.
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "Word"), (5, "a b a b a b a b a b a b a b a b a b a b a b a b"),
        (6, "x" * 100_000), (7, sentence(7, 20_000)), (8, "naïve Ünïcode — «текст» 漢字 \x00   end."), (9, "# $ & | < >"),
        (10, sentence(10, 60)), (10, sentence(10, 60)), (11, sentence(10, 60)), (None, sentence(12, 40)), (None, None)]


def read_texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def ascii_lower(s):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), s or "")
