"""Full-text and geographic search over node properties."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, of any script, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def search_all(df: DataFrame, text: str, query: str) -> DataFrame:
    """Rows whose text has every token of the query; none for a query without tokens."""
    wanted = F.array_distinct(tokens(F.lit(query)))
    return df.where((F.size(wanted) > 0) & (F.size(F.array_intersect(tokens(F.col(text)), wanted)) == F.size(wanted)))


def _postings(df: DataFrame, *keep: Column) -> DataFrame:
    """The columns `keep`, len, term, tf: a row for each row of df and distinct token in `_t`.

    The tokens of a row are sorted and its runs of equal ones measured, so a
    row's work grows with n log n of its tokens, not with their square.
    """
    sorted_ = df.select(*keep, F.sort_array("_t").alias("_s")).withColumn("len", F.size("_s").cast("long"))
    starts = F.when(F.col("len") > 0, F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: (i == 0) | (F.get("_s", i) != F.get("_s", i - 1))))
    runs = sorted_.withColumn("_b", starts)
    names = [c for c in runs.columns if c not in ("_s", "_b")]
    run = F.transform("_b", lambda at, k: F.struct(F.get("_s", at).alias("term"), (F.coalesce(F.get("_b", k + 1), F.col("len").cast("int")) - at).cast("long").alias("tf")))
    return runs.select(*names, F.inline(run))


def term_counts(df: DataFrame, text: str) -> DataFrame:
    """term, docs, occurrences."""
    counted = _postings(df.select(tokens(F.col(text)).alias("_t"))).select("term", F.col("tf").alias("n"))
    return counted.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").cast("long").alias("occurrences"))


def search_ranked(df: DataFrame, key: str, text: str, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score: BM25 of rows with any token of the query; a token asked twice counts twice. Ties are for the caller to order by key.

    Occurrences are counted in place, per row, so only rows with a hit move.
    """
    wanted = [r for r in query_terms(df.sparkSession, query)]
    read = df.select(key, tokens(F.col(text)).alias("_t"))

    def hits_of(term: str) -> Column:
        return F.size(F.filter("_t", lambda x: x == term)).cast("double")

    hits = {term: hits_of(term) for term in dict.fromkeys(wanted)}
    names = {term: f"_tf{i}" for i, term in enumerate(hits)}
    counted = read.select(key, F.size("_t").cast("double").alias("_len"), *[hits[t].alias(names[t]) for t in hits])
    stats = counted.agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"), *[F.sum((F.col(c) > 0).cast("int")).alias(f"_df{c}") for c in names.values()])
    score = F.lit(0.0)
    for term in wanted:
        tf, df_ = F.col(names[term]), F.col(f"_df{names[term]}")
        idf = F.log(1 + (F.col("_n") - df_ + 0.5) / (df_ + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_len") / F.col("_avg")))
    some = F.lit(False)
    for c in names.values():
        some = some | (F.col(c) > 0)
    return counted.where(some).crossJoin(F.broadcast(stats)).select(key, score.alias("score"))


class TextIndex:
    """Postings (bucket, term, key, tf, len) and one row of statistics, kept as Parquet.

    Postings are partitioned by a hash of the term and sorted by it, so a query
    opens the buckets of its own terms alone, however long it is after the index
    was written; postings of one term are spread over several files by key.
    """

    def __init__(self, postings: DataFrame, stats: DataFrame, buckets: int):
        self.postings, self.stats, self.buckets = postings, stats, buckets

    @classmethod
    def write(cls, df: DataFrame, key: str, text: str, path: str, buckets: int = 64, spread: int = 8) -> TextIndex:
        """Index the rows of df; a null text has no token but counts as a row, as in `search_ranked`."""
        read = df.select(F.col(key).alias("key"), tokens(F.col(text)).alias("_t"))
        postings = _postings(read, F.col("key")).withColumn("bucket", _bucket(F.col("term"), buckets))
        postings.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(spread))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
        written = df.sparkSession.read.schema(postings.schema).parquet(f"{path}/postings")  # the texts are cut once
        stats = df.agg(F.count(F.lit(1)).alias("n")).crossJoin(written.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("_all")))
        stats.select("n", (F.col("_all") / F.nullif(F.col("n"), F.lit(0))).alias("mean"), F.lit(buckets).alias("buckets")).write.parquet(f"{path}/stats")
        return cls.open(df.sparkSession, path)

    @classmethod
    def open(cls, spark, path: str) -> TextIndex:
        stats = spark.read.parquet(f"{path}/stats")
        return cls(spark.read.parquet(f"{path}/postings"), stats.select("n", "mean"), stats.first()["buckets"])

    def hits(self, terms: list[str]) -> DataFrame:
        """Postings of the terms."""
        spark = self.postings.sparkSession
        wanted = spark.range(1).select(F.explode(F.array_distinct(F.transform(F.array(*[F.lit(t) for t in terms]), lambda t: _bucket(t, self.buckets))))).collect() if terms else []
        return self.postings.where(F.col("bucket").isin([r[0] for r in wanted]) & F.col("term").isin(terms))

    def ranked(self, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """key, score: BM25 of rows with any token of the query, as `search_ranked` gives it."""
        terms = query_terms(self.postings.sparkSession, query)
        hits = self.hits(list(dict.fromkeys(terms)))
        times = F.lit(0)
        for term in dict.fromkeys(terms):
            times = F.when(F.col("term") == term, F.lit(terms.count(term))).otherwise(times)
        rare = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row for each term of the query
        tf, rest = F.col("tf"), k1 * (1 - b + b * F.col("len") / F.col("mean"))
        one = times * F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * tf * (k1 + 1) / (tf + rest)
        return hits.join(F.broadcast(rare), "term").crossJoin(F.broadcast(self.stats)).groupBy("key").agg(F.sum(one).alias("score"))

    def having_all(self, query: str) -> DataFrame:
        """key of rows with every token of the query; none for a query without tokens."""
        terms = list(dict.fromkeys(query_terms(self.postings.sparkSession, query)))
        return self.hits(terms).groupBy("key").agg(F.count_distinct("term").alias("_n")).where(F.col("_n") == len(terms)).select("key")


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.hash(term), F.lit(buckets))


def query_terms(spark, query: str) -> list[str]:
    """Tokens of a query, cut by the same rule as the texts."""
    return spark.range(1).select(tokens(F.lit(query)).alias("t")).first()["t"]


def _valid(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km; null for coordinates out of range."""
    cols = [c if isinstance(c, Column) else F.lit(float(c)) for c in (lat1, lon1, lat2, lon2)]
    a1, o1, a2, o2 = (F.radians(c) for c in cols)
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return F.when(_valid(cols[0], cols[1]) & _valid(cols[2], cols[3]), 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h))))


def within_radius(df: DataFrame, lat: str, lon: str, at: tuple[float, float], km: float) -> DataFrame:
    """Rows within km of a place; a band of latitudes comes first, which reaches the scan."""
    reach = math.degrees(km / EARTH_KM) + 1e-9
    band = F.col(lat).between(at[0] - reach, at[0] + reach)
    return df.where(band & (haversine_km(F.col(lat), F.col(lon), *at) <= km))


def within_box(df: DataFrame, lat: str, lon: str, low: tuple[float, float], high: tuple[float, float]) -> DataFrame:
    """Rows in a box; one whose west lies east of its east crosses the antimeridian."""
    x = F.col(lon)
    wide = x.between(low[1], high[1]) if low[1] <= high[1] else (x >= low[1]) | (x <= high[1])
    return df.where(_valid(F.col(lat), x) & F.col(lat).between(low[0], high[0]) & wide)


def nearest(df: DataFrame, key: str, lat: str, lon: str, at: tuple[float, float], k: int) -> DataFrame:
    """key, km of the k nearest rows, ties by key."""
    out = df.select(key, haversine_km(F.col(lat), F.col(lon), *at).alias("km")).where("km is not null")
    return out.orderBy("km", key).limit(k)
