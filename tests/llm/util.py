"""Small document tables with the awkward cases."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

LONG = " ".join(f"word{i % 997} tail{i % 31}" for i in range(9000))


def doc_rows():
    plain = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potions near an old stone bridge"
    return [
        (1, plain, "en", "a", 1),
        (2, plain, "en", "b", 1),
        (3, None, "en", "a", None),
        (4, "", None, None, 0),
        (5, " \n\t ", "en", "a", 3),
        (6, LONG, "en", "a", 1),
        (7, plain + " and leave", "en", None, 1),
        (8, "Ünïcode ÉÉ straße 東京 \x85 naïve é \U0001f600", "de", "b", 1),
        (9, "two words", "fr", "b", 1),
        (10, LONG, "en", "a", 1),
        (None, "a row without an identifier", None, "c", None),
        (1, plain, "en", "a", 1),
    ]


def docs(spark, rows=None):
    return spark.createDataFrame(doc_rows() if rows is None else rows, SCHEMA)


def saved(spark, tmp_path, rows=None, **tables):
    """A data folder with a documents table, and others given as (rows, schema)."""
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    for name, (own, schema) in tables.items():
        spark.createDataFrame(own, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def clashing(df):
    """The same table with further columns named like results and internals."""
    from pyspark.sql import functions as F

    names = ["id", "t", "size", "shard", "slot", "score", "kept", "spans", "items", "n", "key", "label", "rep", "component_id", "taken", "target", "n_words", "predicted", "law", "run", "__h", "__d", "__g", "__k0", "__rid", "a.b", "tick`ed", "c0", "rid", "tie", "g"]
    odd = F.struct(F.lit(1).alias("two words"), F.array(F.struct(F.lit("x").alias("a.b`c"))).alias("1st"))
    return df.withColumns({n: F.lit("clash") for n in names} | {"odd ones": odd, "map": F.create_map(F.lit("k"), F.lit(2)), "when": F.lit("2024-01-02 03:04:05").cast("timestamp")})
