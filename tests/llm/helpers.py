"""Small tables with the hard cases: nulls, empty and long texts, ties, repeats, clashing columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, **more):
    """rows: (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    for name, value in more.items():
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit(value))
    return df


def clashing(df):
    """The same rows with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ["size", "key", "one", "label", "score", "shard", "mix", "copies", "target", "node", "ids", "media", "report", "part", "hilbert", "predicted", "n"]
    return df.withColumns({c: F.lit("x") for c in names})
