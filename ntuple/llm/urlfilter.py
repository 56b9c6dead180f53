"""URL filter: rules by host suffix and path prefix, else a logistic regression on n-grams.

Native.  The model is fitted by Spark's own logistic regression on hashed character n-grams of
host and path.  Its training table is a small labelled list of URLs, a parameter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lengths of the n-grams of a host and of a path, and the number of hashed features.
HOST_GRAMS = (3, 4, 5)
PATH_GRAMS = (3, 4)
FEATURES = 1 << 16

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A small labelled table: URLs to block, and ordinary ones.
BLOCK_URLS = """
https://casino-bonus.example.com/play/12
http://www.best-casino.example.net/en/3
https://m.casino-royal.example.org/slots
http://online-casino.example.com/win/77.html
https://win-big.example.net/jackpot
http://lotto-win.example.org/en/41?ref=x
https://poker-win.example.com/table/9
http://free-spins.example.net/en/5
https://free-slots.example.org/de/88
http://free-money.example.com/now
https://www.bets-online.example.net/en/19
http://sport-bets.example.com/fr/7
https://live-bets.example.org/odds/3
http://cheap-meds.example.com/buy/4
https://www.cheap-drugs.example.net/en/2
http://pills-online.example.org/order
https://m.diet-pills.example.com/en/61
http://buy-pills.example.net/fr/33
https://cheap-viagra.example.org/en/8
http://cheap-watches.example.com/replica/5
https://spam-links.example.net/en/17
http://link-farm.example.com/en/1
https://www.spam-blog.example.org/de/4
http://seo-spam.example.net/es/9
https://content-farm.example.com/en/72
http://ads-server.example.org/banner/3
https://track-ads.example.net/click?id=9
http://ad-tracker.example.com/pixel/2
https://ads-network.example.org/en/6
http://click-track.example.net/en/31
https://m.popup-ads.example.com/x/1
http://adult-chat.example.org/en/5
https://xxx-video.example.net/en/14
http://www.adult-video.example.com/fr/2
https://adult-cams.example.org/es/61
http://x-adult.example.net/en/90
https://hot-dates.example.com/adult/4
http://payday-loan.example.net/cash/8
https://quick-loans.example.org/en/25
http://free-gift.example.com/claim/6
https://m.free-bet.example.net/en/44
http://blog.bets.example.org/de/12.html
https://m.cheap-loans.example.com/fr/9#top
http://blog.casino.example.net/en/70?page=2
""".split()
ALLOW_URLS = """
https://www.theriver.example.com/en/12
http://blog.mountains.example.net/fr/3
https://thinking.example.org/de/71.html
http://m.kitchen.example.com/recipes/4
https://weather.example.net/en/55?page=2
http://www.library.example.org/books/9
https://history.example.com/en/401/
http://tion.example.net/en/8#top
https://blog.thread.example.org/es/77
http://ther.example.com/de/5?utm_source=feed
https://museum.example.net/fr/61
http://www.thonder.example.com/en/33.html
https://gardens.example.org/plants/17
http://m.thatch.example.net/en/250
https://research.example.com/papers/81
http://blog.station.example.org/en/19
https://therein.example.net/es/64?page=2&ref=x
http://www.thistle.example.com/en/707
https://news.example.org/world/52
http://science.example.net/en/3/
https://blog.thing.example.com/fr/118#top
http://ththan.example.org/en/92
https://m.ththor.example.net/de/14
http://www.theron.example.com/en/640
https://schools.example.org/en/31
http://university.example.net/courses/7
https://music.example.com/albums/25
http://blog.tions.example.org/en/48.html
https://thesis.example.net/en/202
http://painting.example.com/gallery/6
https://www.thonth.example.org/en/356
http://maps.example.net/cities/90
https://travel.example.com/guide/15
http://m.theater.example.org/en/87
https://tionble.example.net/fr/41?utm_source=feed
http://code.example.com/docs/3.html
https://health.example.org/en/68
http://www.sports.example.net/results/12
https://thened.example.com/en/509/
http://cooking.example.org/de/27
""".split()


@dataclass(frozen=True)
class Rule:
    """``host`` with ``path``, for instance ``net`` and ``/``, for that host and its subdomains."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters lower-cased) and path; both empty without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as ``(length, name, verdict)``; null without one.

    Rules are a short list, so each is a comparison of its own; of rules of equal length the one
    whose name comes last wins.
    """
    fits = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(len(r.name)).alias("length"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict")),
        )
        for r in rules
    ]
    none = F.lit(None).cast("struct<length:int,name:string,verdict:string>")
    return F.array_max(F.array(none, none, *fits))


def grams(text: Column, lengths: tuple[int, ...], tag: str) -> Column:
    """Tagged n-grams of a text between ``^`` and ``$``."""
    whole = F.concat(F.lit("^"), text, F.lit("$"))
    lists = [
        F.when(
            F.length(whole) >= n,
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(whole) - (n - 1), F.lit(1))),
                lambda i, n=n: F.concat(F.lit(tag), F.substr(whole, i, F.lit(n))),
            ),
        ).otherwise(F.array().cast("array<string>"))
        for n in lengths
    ]
    return F.concat(*lists)


def features(df: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """Add ``_features``: which hashed n-grams occur."""
    listed = df.withColumn("_grams", F.concat(grams(F.col(host), HOST_GRAMS, "h:"), grams(F.col(path), PATH_GRAMS, "p:")))
    hashing = HashingTF(binary=True, numFeatures=FEATURES, inputCol="_grams", outputCol="_features")
    return hashing.transform(listed).drop("_grams")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """``url``, ``label`` (1: block): the built-in table."""
    urls = F.array(*[F.struct(F.lit(u).alias("url"), F.lit(y).alias("label")) for us, y in ((BLOCK_URLS, 1.0), (ALLOW_URLS, 0.0)) for u in us])
    return spark.range(1, numPartitions=1).select(F.explode(urls).alias("x")).select("x.url", "x.label")


def fit(labelled: DataFrame, reg: float = 0.005) -> LogisticRegressionModel:
    """Fit the regression on ``url``, ``label``; rows without either are left out."""
    host, path = parts(F.col("url"))
    rows = labelled.dropna(subset=["url", "label"]).select(host.alias("host"), path.alias("path"), F.col("label").cast("double").alias("label"))
    # A small table: one partition makes the sums of the optimiser repeat exactly.
    model = LogisticRegression(featuresCol="_features", maxIter=100, regParam=reg, standardization=False)
    return model.fit(features(rows).coalesce(1))


def judge(
    pages: DataFrame, rules: list[Rule], model: LogisticRegressionModel, *, url: str = "url", keep: list[str] = ("page_id",)
) -> DataFrame:
    """``keep``, ``host``, ``path``, ``rule``, ``score`` (probability of block) and ``verdict``.

    A null URL, or one without ``://``, has an empty host and path, fits no rule, and gets what the
    model says of nothing.  Rows that repeat give rows that repeat; no rows give no rows; other
    columns are not read.
    """
    host, path = parts(F.col(url))
    rows = pages.select(*keep, host.alias("host"), path.alias("path"))
    scored = model.transform(features(rows))
    fit_rule = rule_of(F.col("host"), F.col("path"), rules)
    score = vector_to_array("probability")[1]
    return scored.withColumns({"_rule": fit_rule, "score": score}).select(
        *keep, "host", "path",
        F.col("_rule.name").alias("rule"),
        "score",
        F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"),
    )
