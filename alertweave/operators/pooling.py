"""Text vectors from windows: the mean over a text's windows, of unit length, each distinct
text pooled once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let


def pooled(df: DataFrame, id_col: str, text_col: str, encode: Callable[[Column], Column], size: int = 512) -> DataFrame:
    """The identifier and the vector of each row's text. Windows are of ``size`` words that
    follow one another over the whole text; ``encode`` takes a window's words and gives its
    vector, an array of doubles of one length. Texts are collapsed before any window is
    encoded, by a partial aggregate and one exchange; windows are rows, so a long text is no
    long expression; vectors are joined back by the text's hash. A null text is an empty one,
    of one window without words; a vector of length 0 stays as it is."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = df.select(F.col(id_col), F.sha2(text, 256).alias("__key"))
    each = df.select(text.alias("__text")).distinct()
    parts = F.regexp_extract_all("__text", F.lit(rf"(?:\S++\s*+){{1,{size}}}"), F.lit(0))
    each = each.select(F.sha2("__text", 256).alias("__key"), F.explode(F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("")))).alias("__part"))
    words = F.filter(F.split("__part", r"\s+"), lambda w: w != "")
    # a window's words are taken once, however often ``encode`` names them; an inner explode
    # would compute the vector again to see that it isn't empty
    each = each.select("__key", F.posexplode_outer(let(words, encode)).alias("__dim", "__x")).filter("__dim is not null")
    means = each.groupBy("__key", "__dim").agg(F.avg("__x").alias("__x"))
    found = means.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("__dim", "__x"))).alias("__v"), F.sqrt(F.sum(F.col("__x") * F.col("__x"))).alias("__length"))
    unit = F.transform("__v", lambda v: F.when(F.col("__length") > 0, v["__x"] / F.col("__length")).otherwise(0.0))
    return own.join(found.select("__key", unit.alias("vector")), "__key").select(id_col, "vector")
