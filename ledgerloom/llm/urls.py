"""URL filter: allow and block rules first, else a logistic regression on hashed character n-grams.

Everything runs as DataFrame expressions and Spark's own learner in the JVM. The model learns from
a small labelled table (a few dozen URLs, given as a DataFrame), so training is bounded; scoring is
one pass over the ``url`` column without a shuffle.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is
judged by the model. An empty n-gram list gets the model's intercept. URLs of any length are read
whole, in time proportional to their length. Repeated rows get the same verdict. Other columns of the
input are not read, so their names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import lower_az

#: (verdict, host and path): the longest rule that fits a URL decides
RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)

#: The labelled table: 1 is to be blocked, 0 is to be allowed.
_BLOCKED = """
http://casino-bonus777.example/win/free-spins
http://best-casino.example/slots/jackpot?ref=9
https://poker-online.example/bonus/deposit
http://free-slots.example/casino/play-now
https://cheap-pills.example/buy/viagra
http://pharmacy-discount.example/pills/order-now
https://meds-online.example/cialis/cheap
http://xxx-videos.example/porn/watch
https://adult-cams.example/sex/live
http://hot-girls.example/xxx/free
https://free-movies-torrent.example/download/full-hd
http://warez-crack.example/keygen/download
http://torrent-mirror.example/magnet/2931
https://ads.clicktrack.example/banner/click?id=1
http://tracker.adserver.example/pixel.gif
http://popups.adnetwork.example/redirect?to=x
https://secure-login-verify.example/account/update-password
http://bank-verify.example/login/confirm-account
http://get-rich-fast.example/earn-money/now
https://crypto-double.example/earn/bitcoin-free
http://cheap-replica-watches.example/buy/rolex
http://loans-fast.example/payday/apply-now
http://seo-backlinks.example/buy-links/cheap
http://coupon-spam.example/discount/buy-now
http://spam-network.example/link-farm
http://link-farm.example/spam/12
https://bets-online.example/free-bets/today
http://sports-bets.example/odds/77
https://ads-server.example/track/8
http://track-visits.example/ads/31
https://adult-dating.example/en/901
http://pills-store.example/en/55
http://casino-games.example/de/10
https://www.win-casino.example/en/7781.html
http://blog.casino-bonus.example/fr/40/
http://m.slots-casino.example/es/312?page=2&ref=x
https://www.cheap-meds.example/en/66021
http://blog.buy-pills.example/de/9#top
https://m.cheap-viagra.example/fr/1209.html
http://free-spins.example/en/88
https://www.free-poker.example/es/12003/
http://blog.live-bets.example/en/451?utm_source=feed
https://m.web-track.example/en/7
http://www.ads-click.example/de/5102.html
https://click-ads.example/fr/64
http://www.adult-video.example/en/3390
https://blog.xxx-adult.example/es/18/
http://m.porn-x.example/en/720.html
http://www.spam-links.example/en/5
https://spam-mail.example/de/2281#top
http://blog.content-farm.example/en/39100
https://m.click-farm.example/fr/6/
""".split()
_ALLOWED = """
https://docs.library.example/en/guide/install.html
https://docs.library.example/en/reference/index.html
https://blog.science.example/2021/05/why-stars-shine
https://blog.garden.example/2019/11/growing-tomatoes
https://www.university.example/departments/history/
https://www.university.example/research/papers/412
https://news.city.example/articles/2020/council-meeting
https://news.world.example/article/18823.html
https://en.encyclopedia.example/wiki/Photosynthesis
https://fr.encyclopedia.example/wiki/Paris
https://de.encyclopedia.example/wiki/Berlin
https://forum.makers.example/thread/3312?page=2
https://m.magazine.example/en/4412
https://m.magazine.example/fr/871/
http://journal.example/en/issue/12.html
http://journal.example/de/ausgabe/7.html
http://www.museum.example/es/coleccion/55
https://recipes.kitchen.example/bread/sourdough
https://www.government.example/en/services/passport
https://weather.example/forecast/north
http://blog.travel.example/es/304?utm_source=feed
http://books.example/fr/1204#top
https://code.project.example/repo/readme
https://maths.school.example/lessons/fractions.html
http://m.harbour.example/en/102
https://www.northern.example/en/3381.html
http://blog.thimble.example/de/640/
https://shorten.example/fr/55021
https://www.otherland.example/es/77?page=2&ref=x
http://m.anthem.example/en/90134
https://blog.station.example/en/4/
http://weathered.example/de/81
https://nether.example/en/2044#top
http://www.thirteenth.example/fr/9
https://m.thorough.example/es/310.html
http://blog.breathing.example/en/78231
https://mention.example/en/16?utm_source=feed
http://www.therapy.example/en/5150/
https://tribune.example/de/1207
http://thousand.example/en/66.html
https://www.stable.example/fr/3020
http://m.theory.example/de/29
https://gathering.example/es/41
http://blog.northwest.example/fr/880?page=2
""".split()

N_FEATURES = 1 << 12
GRAMS = (3, 4)
BLOCK_AT = 0.5


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled URL table (url, label)."""
    marked = [
        spark.range(1).select(F.explode(F.array(*map(F.lit, urls))).alias("url"), F.lit(label).alias("label"))
        for urls, label in ((_BLOCKED, 1.0), (_ALLOWED, 0.0))
    ]
    return marked[0].unionAll(marked[1])


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return lower_az(_split_url(url)[0])


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return _split_url(url)[1]


def _split_url(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    return F.regexp_extract(rest, "^[^/?#]*", 0), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls where none does.

    The rules are a hand-kept list and become one conditional expression, longest first.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: len(r[1])):
        rule_host, slash, rule_path = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        name = F.when(fits, text).otherwise(name)
        verdict = F.when(fits, decision).otherwise(verdict)
    return name, verdict


def grams(host: Column, path: Column, sizes: Sequence[int] = GRAMS) -> Column:
    """Character n-grams of host and path, each marked by its part and with the part's ends shown;
    all digits count as one."""
    parts = []
    for mark, part in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(F.lit("^"), path, F.lit("$")))):
        chars = F.split(F.translate(lower_az(part), "123456789", "000000000"), "")
        for n in sizes:
            parts.append(_grams_of(chars, n, mark))
    return F.concat(*parts)


def _grams_of(chars: Column, n: int, mark: str) -> Column:
    """``chars`` goes through a lambda variable, so that it is made once and not for every n-gram."""

    def cut(chars: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(chars)), lambda i: i <= F.size(chars) - n + 1)
        return F.transform(starts, lambda i: F.concat(F.lit(mark), F.array_join(F.slice(chars, i, n), "")))

    return F.transform(F.array(chars), cut)[0]


def fit(labelled: DataFrame) -> PipelineModel:
    """Logistic regression on hashed n-grams, from a small labelled table (url, label)."""
    hashing = HashingTF(numFeatures=N_FEATURES, inputCol="_grams", outputCol="_features")
    rows = labelled.filter("label is not null").select(
        F.col("label").cast("double").alias("label"), grams(host_of(F.col("url")), path_of(F.col("url"))).alias("_grams")
    )
    learner = LogisticRegression(
        featuresCol="_features", labelCol="label", regParam=0.01, maxIter=60, standardization=False,
        rawPredictionCol="_raw", probabilityCol="_probability", predictionCol="_prediction",
    )
    model = learner.fit(hashing.transform(rows).coalesce(1))
    return PipelineModel([hashing, model])


def judge(
    pages: DataFrame, model: PipelineModel, rules: Sequence[tuple[str, str]] = RULES, block_at: float = BLOCK_AT
) -> DataFrame:
    """page_id, host, path, rule, score (the model's chance that the URL is bad) and verdict of every row."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    scored = model.transform(parts.withColumn("_grams", grams(F.col("host"), F.col("path"))))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    score = F.element_at(vector_to_array("_probability"), 2)
    return scored.select(
        "page_id", "host", "path", rule.alias("rule"), score.alias("score"),
        F.coalesce(verdict, F.when(score >= block_at, "block").otherwise("allow")).alias("verdict"),
    )
