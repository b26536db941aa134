"""Tables with everything a table may hold: nulls, empty and long texts, repeats, clashing columns."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("fp", T.StringType()), T.StructField("component_id", T.LongType()), T.StructField("count", T.LongType()),
    T.StructField("quality_score", T.StringType()), T.StructField("cut", T.StringType()), T.StructField("toxicity", T.StringType()),
])

TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "One word? Two words! Three, four five six seven."), (5, "one word? two words! three, four five six seven."),
    (5, "one word? two words! three, four five six seven."), (6, "x" * 50_000), (7, "ab " * 30_000), (8, "Été ça 漢字 \U0001F600 <|endoftext|> é"),
    (9, "\0\x01 a b  c"), (10, "MIT License. Licensed under the Apache License, Version 2.0"), (None, "no id here"), (11, "GNU General Public License v3, cc by cc by-sa 4.0"),
    (12, "licence " * 3_000 + "mit license " * 2_000),
]


def documents(spark, texts=TEXTS):
    rows = [(i, t, 0.5, "fp", 99, 7, "good", "cut", "no") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int, y int, place string")
