"""Bags of words: vocabulary, counts and tf-idf as long tables of (key, term, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.base import Estimator, Model
from tessera.plans.storage import stored

#: Vocabularies of so many terms at most are broadcast.
BROADCAST_TERMS = 1_000_000


def tokens(text: Column, lowercase: bool = True) -> Column:
    """Words of at least two letters, digits or underscores."""
    split = F.split(F.lower(text) if lowercase else text, r"[^\p{L}\p{N}_]+")
    return F.filter(split, lambda t: F.length(t) >= 2)


class CountVectorizer(Estimator):
    """Counts of each document's terms. Terms need min_df documents and at most the share max_df of them.

    With max_features only the most frequent terms stay (ties by name). The vocabulary stays a DataFrame, so its size
    is not bounded; its columns are term and df. Texts are dealt by key once, before they are cut into terms, so that what
    is counted and scaled by key is not dealt again.
    """

    def __init__(self, key: str, text: str, min_df: int = 1, max_df: float = 1.0, max_features: int | None = None, binary: bool = False):
        self.key, self.text, self.min_df, self.max_df, self.max_features, self.binary = key, text, min_df, max_df, max_features, binary

    def counts(self, df: DataFrame) -> DataFrame:
        """key, term and n, dealt by key."""
        terms = df.select(self.key, self.text).repartition(self.key).select(self.key, F.explode(tokens(F.col(self.text))).alias("term"))
        n = F.lit(1) if self.binary else F.count("*")
        return terms.groupBy(self.key, "term").agg(n.cast("long").alias("n"))

    def frequencies(self, df: DataFrame) -> DataFrame:
        """term and df. A row whose key is its own is a whole document, so its terms are told apart where it stands."""
        repeated = stored(df.groupBy(F.col(self.key).alias("__k")).count().where("count > 1").select("__k"))
        own, terms = df, []
        if not repeated.isEmpty():
            same = F.col(self.key).eqNullSafe(F.col("__k"))
            own, terms = df.join(repeated, same, "left_anti"), [self.counts(df.join(repeated, same, "left_semi")).select("term")]
        found = own.select(F.explode(F.array_distinct(tokens(F.col(self.text)))).alias("term"))
        return reduce(DataFrame.unionAll, terms, found).groupBy("term").agg(F.count("*").alias("df"))

    def fit(self, df: DataFrame) -> CountVectorizerModel:
        rows = df.count()
        if self.max_features is None:
            vocabulary = self.frequencies(df)
        else:
            vocabulary = self.counts(df).groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("total"))
        vocabulary = vocabulary.where((F.col("df") >= self.min_df) & (F.col("df") <= self.max_df * rows))
        if self.max_features is not None:
            vocabulary = vocabulary.orderBy(F.desc("total"), "term").limit(self.max_features)
        return CountVectorizerModel(self, stored(vocabulary.select("term", "df")), rows)


class CountVectorizerModel(Model):
    def __init__(self, settings: CountVectorizer, vocabulary: DataFrame, rows: int):
        self.settings, self.vocabulary, self.rows = settings, vocabulary, rows

    def known(self, counts: DataFrame) -> DataFrame:
        """The counts of terms of the vocabulary, with df; a vocabulary that was counted to be small is broadcast."""
        few = self.vocabulary.count() <= BROADCAST_TERMS
        return counts.join(F.broadcast(self.vocabulary) if few else self.vocabulary, "term")

    def transform(self, df: DataFrame) -> DataFrame:
        return self.known(self.settings.counts(df)).select(self.settings.key, "term", "n")


class TfidfVectorizer(Estimator):
    """Term counts times ln((1 + rows) / (1 + df)) + 1 (smooth) or ln(rows / df) + 1, rows scaled to norm l1, l2 or None."""

    def __init__(self, key: str, text: str, norm: str | None = "l2", smooth_idf: bool = True, sublinear_tf: bool = False, **counting):
        self.counter = CountVectorizer(key, text, **counting)
        self.norm, self.smooth_idf, self.sublinear_tf = norm, smooth_idf, sublinear_tf

    def fit(self, df: DataFrame) -> Model:
        return _Tfidf(self, self.counter.fit(df))


class _Tfidf(Model):
    def __init__(self, settings: TfidfVectorizer, counts: CountVectorizerModel):
        self.settings, self.counts = settings, counts

    def transform(self, df: DataFrame) -> DataFrame:
        s, n, key = self.settings, F.lit(float(self.counts.rows)), self.counts.settings.key
        idf = F.ln((n + 1) / (F.col("df") + 1)) if s.smooth_idf else F.ln(n / F.col("df"))
        tf = F.ln("n") + 1 if s.sublinear_tf else F.col("n")
        rows = self.counts.known(self.counts.settings.counts(df)).select(key, "term", (tf * (idf + 1)).alias("weight"))
        if s.norm is None:
            return rows
        own = W.partitionBy(key)
        size = F.sqrt(F.sum(F.col("weight") ** 2).over(own)) if s.norm == "l2" else F.sum(F.abs("weight")).over(own)
        return rows.withColumn("size", size).where(F.col(key).isNotNull()).select(key, "term", (F.col("weight") / F.col("size")).alias("weight"))
