"""URL filters: host and path rules, and a logistic regression for the URLs that no rule fits.

The model's features are hashed character n-grams of host and path; it is trained by gradient descent with
momentum from ``LABELLED`` and ``PATHS``, a small table of words that stand for URLs, as host labels or in paths
(bounded: its rows are written below). Features, training and scoring are DataFrame expressions alone; only the
trained weights, ``DIM`` doubles, come to the driver, to be a literal in the scoring expression.

Edge cases: a null url or one without ``://`` has an empty host and path, fits no rule and is judged by
the model (no features: the intercept alone, which allows); repeated rows give repeated results; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opweave.session import table

#: (host, path, verdict)
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
DIM, GRAMS, ROUNDS, RATE, MOMENTUM, DECAY = 4096, (3, 4, 5), 60, 1.0, 0.9, 0.0003
#: The labelled table: host labels, 1 for those to block; each is met in every frame of FRAMES, whose paths say nothing.
LABELLED = {
    1: "spam-farm cheap-pills casino-win free-bets adult-x ads-track online-casino best-pills bet-bonus sports-bets xxx-adult adult-cams click-ads ad-tracker link-farm spam-mail win-prize free-money cheap-meds slots-win poker-bonus hot-dates payday-loans lucky-jackpot track-clicks popup-ads seo-spam pills-shop viagra-store bets-live",
    0: "library weather school history museum garden kitchen science theatre forest railway harbour teacher mountain news recipes painting music travel health city-council open-data the-other north-line winter-sport book-club river-side farmers-market tracks-and-fields adults-learning thinking nation herald thesis intern theory reader station another there stable portable notable motion action option section relation mention attention edition the-times mother brother leather gather together ring thing string spring evening morning hand land island sand band urban human woman german area idea sea tea year near hearing healing shore rest north thread threshold honest tent event one phone bone onion thorn born the-rent parent current other-side sheet with-you what-now where-to shelter lyric early daily family tides titles still outer county council town-hall public-library art-gallery film-club music-school home-garden bike-repair road-atlas fire-service post-office new-town old-bridge sea-view hill-farm cook-book tea-house wood-work land-trust night-sky blue-heron school-board",
}
FRAMES = ("{}.example.com/en/12", "www.{}.example.net/de/7", "{}.example.org/fr/345.html", "blog.{}.example.com/es/9/", "m.{}.example.com/de/31")


#: Parts of paths, likewise; each is met in every frame of PATH_FRAMES, whose hosts say nothing.
PATHS = {
    1: "casino-bonus free-spins buy-pills cheap-viagra win-prize adult-pics xxx-videos click-here/ads ads/redirect track/click payday-loan hot-dates lucky-slots bets-online spam-offer free-money popup-ads seo-links",
    0: "articles/history news/today opening-hours about-us contact recipes/bread music/lessons science/notes en/guide de/start fr/accueil es/inicio blog/spring-walk docs/install products/chairs weather/week library/catalogue museum/tickets school/term-dates forum/help events/concert garden/roses sport/results travel/trains health/sleep books/review",
}
PATH_FRAMES = ("www.example.com/{}/7", "news.example.org/{}.html", "shop.example.net/{}")


def _parts(df: DataFrame) -> DataFrame:
    at = F.expr("instr(url, '://')")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    df = df.withColumn("rest", F.coalesce(rest, F.lit("")))
    host = F.regexp_extract("rest", r"\A([^/?#]*)", 1)
    path = F.regexp_extract("rest", r"\A[^/?#]*([^?#]*)", 1)
    return df.select("*", F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), path.alias("path")).drop("rest")


def _grams(text: Column, mark: str) -> Column:
    """Hashed n-grams of one part, with its ends marked; empty for an empty part."""
    none = F.array().cast("array<int>")

    def of(chars: Column, k: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(chars) - (k - 1))
        # a function of one argument: a second one would be given the index
        every = F.transform(starts, lambda i: F.pmod(F.hash(F.lit(mark), F.array_join(F.slice(chars, i, k), "")), F.lit(DIM)))
        return F.when(F.size(chars) >= k, every).otherwise(none)

    # the characters are a lambda's variable, so that they are made once for a text and not for each n-gram
    split = F.array(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""))
    grams = F.get(F.transform(split, lambda chars: F.concat(*[of(chars, k) for k in GRAMS])), F.lit(0))
    return F.when(F.length(text) > 0, grams).otherwise(none)


def features(host: str = "host", path: str = "path") -> Column:
    return F.array_distinct(F.concat(_grams(F.col(host), "h"), _grams(F.col(path), "p")))


def train(spark: SparkSession) -> tuple[list[float], float]:
    """Weights by feature, and the intercept: full-batch gradient descent inside one SQL expression."""
    found = [(f.format(w), y) for words, frames in ((LABELLED, FRAMES), (PATHS, PATH_FRAMES)) for y, ws in words.items() for w in ws.split() for f in frames]
    values = ", ".join(f"('http://{u}', {y}D)" for u, y in found)
    urls = spark.sql(f"select y, url from values {values} as t(url, y)")
    rows = _parts(urls).select("y", features().alias("fs"), F.row_number().over(_by()).alias("r"))
    kept = rows.select("r", "y", F.explode("fs").alias("f"))
    at = kept.groupBy("f").agg(F.sort_array(F.collect_list(F.col("r") - 1)).alias("ix"))
    inverse = at.agg(F.sort_array(F.collect_list(F.struct("f", "ix"))).alias("inv"))
    lists = rows.agg(F.sort_array(F.collect_list(F.struct("r", "y", "fs"))).alias("rows"))
    n, state = len(found), "struct<now: array<double>, was: array<double>>"
    fit = f"""
      aggregate(sequence(1, {ROUNDS}), cast(struct(array_repeat(0D, {DIM + 1}), array_repeat(0D, {DIM + 1})) as {state}), (s, _) ->
        aggregate(array(zip_with(s.now, s.was, (a, b) -> a + {MOMENTUM}D * (a - b))), s, (s1, w) ->
          aggregate(array(transform(rows, r -> 1D / (1D + exp(-aggregate(r.fs, w[{DIM}], (a, f) -> a + w[f]))) - r.y)), s1, (s2, err) ->
            cast(struct(
              concat(transform(dense, (ix, f) -> w[f] - {RATE}D * (aggregate(ix, 0D, (a, i) -> a + err[i]) / {n} + {DECAY}D * w[f])),
                     array(w[{DIM}] - {RATE}D * aggregate(err, 0D, (a, e) -> a + e) / {n})),
              s2.now) as {state}))), s -> s.now)"""
    dense = f"transform(sequence(0, {DIM - 1}), f -> coalesce(m[f], cast(array() as array<int>)))"
    one = lists.join(inverse.select(F.map_from_entries("inv").alias("m")))  # one row with one row
    w = one.select("rows", F.expr(dense).alias("dense")).select(F.expr(fit).alias("w")).first()["w"]
    return list(w[:DIM]), w[DIM]


def _by():
    from pyspark.sql import Window

    return Window.orderBy("y", "url")  # over the labelled table only


def matched_rule() -> Column:
    """The longest rule that fits host and path, else null."""
    ranked = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p) for h, p, _ in ranked]
    return reduce(lambda out, x: out.when(x[0], F.lit(x[1][0] + x[1][1])), zip(fits, ranked), F.when(F.lit(False), F.lit("")))


def judge(pages: DataFrame, model: tuple[list[float], float] | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): score is the model's probability to block."""
    weights, bias = model or train(pages.sparkSession)
    df = _parts(pages.select("page_id", "url")).withColumn("rule", matched_rule())
    sum_ = F.aggregate(features(), F.lit(bias), lambda a, f: a + F.get(F.lit(weights), f))
    df = df.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-sum_)))
    verdict = {h + p: v for h, p, v in RULES}
    by_rule = reduce(lambda out, x: out.when(F.col("rule") == x[0], x[1]), verdict.items(), F.when(F.lit(False), ""))
    return df.select("page_id", "host", "path", "rule", F.coalesce(by_rule, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def op10(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))


QUERIES = {"op10_url_filters": op10}
