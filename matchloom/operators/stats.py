"""Statistics of a collection of names: how often a whole name and how rarely a token occurs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import STOPWORDS
from ..functions.text import tokens


def telling(key: Column, min_len: int = 2, stopwords: list[str] = STOPWORDS) -> Column:
    """Tokens of at least min_len letters that aren't stopwords, repeats kept."""
    return F.filter(tokens(key), lambda t: (F.length(t) >= min_len) & ~t.isin(stopwords))


def name_freq(df: DataFrame, key: str = "name_key") -> DataFrame:
    """(name, freq): rows per upper-cased key; null keys aren't counted."""
    return df.where(F.col(key).isNotNull()).groupBy(F.upper(key).alias("name")).agg(F.count(F.lit(1)).alias("freq"))


def token_df(df: DataFrame, key: str = "name_key", min_len: int = 2, stopwords: list[str] = STOPWORDS) -> DataFrame:
    """(token, df): records that hold a token; a token counts once in a record, so no distinct is shuffled."""
    each = F.explode(F.array_distinct(telling(F.upper(key), min_len, stopwords)))
    return df.select(each.alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def token_idf(df: DataFrame, key: str = "name_key", min_len: int = 2, stopwords: list[str] = STOPWORDS) -> DataFrame:
    """(token, df, idf): idf = ln(N / df), N all records, those without a name included."""
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    return token_df(df, key, min_len, stopwords).join(F.broadcast(n)).select("token", "df", F.log(F.col("__n") / F.col("df")).alias("idf"))  # one row is broadcast
