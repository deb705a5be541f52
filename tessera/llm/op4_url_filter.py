"""URL filters: host and path rules, and for all other urls a logistic regression. DataFrame operations only.

Features are the distinct character n-grams (NGRAMS) of `host path`, with a mark at both ends, hashed to BUCKETS
buckets. The weights are trained on the driver by gradient descent from a small labelled URL table; they become
one literal array, so a url is judged inside its row, without a shuffle or a join.

Defined cases: null urls and urls without `://` have empty host and path; no rule fits them (an empty host is no
subdomain) and the regression judges the empty features. Repeated rows give repeated rows. Very long urls are
read whole. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import computed

#: Fixed values: (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
NGRAMS, BUCKETS = (3, 4), 1024
ROUNDS, RATE, PENALTY = 300, 0.5, 1e-3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The labelled URL table: host and path, label 1 for block.
LABELLED = (
    *((u, 0) for u in (
        "docs.library.org /guide/intro.html", "www.university.edu /research/papers/12", "wiki.city.org /history/of/the/town", "news.daily.org /2023/science/article",
        "blog.garden.net /posts/soil-and-seeds", "museum.art.org /collection/451", "www.school.edu /courses/biology/", "archive.books.org /texts/novel/chapter-1",
        "journal.medicine.org /issue/4/abstract", "open.maps.org /data/rivers", "code.project.org /manual/install", "forum.cooking.net /t/bread-recipe/88",
        "www.weather.gov /forecast/north", "data.census.gov /tables/2020", "radio.public.org /shows/morning", "www.theatre.org /season/plays",
        "learn.music.net /lessons/piano", "www.parliament.gov /debates/archive", "static.encyclopedia.org /de/artikel/1204", "m.history.org /en/12213",
        "blog.travel.org /fr/voyage/3301", "www.science.net /en/news/8813.html", "reading.club.org /es/libros/77", "www.birds.org /species/robin/",
    )),
    *((u, 1) for u in (
        "casino-bonus.win /play/now", "free-pills.shop /buy/cheap/viagra", "xxx-videos.cam /watch/hot", "track.adserver.biz /click?id",
        "win-prize.click /claim/free-gift", "hot-singles.date /join/tonight", "cheap-loans.biz /apply/fast-cash", "slots.jackpot.bet /spin/bonus",
        "download-crack.top /keygen/full-version", "ads.popunder.biz /banner/ad.js", "replica-watches.shop /sale/luxury", "bet-poker.win /casino/deposit",
        "porn-tube.xxx /free/sex", "spam-seo.top /links/buy-backlinks", "phish-login.click /account/verify/password", "crypto-double.win /invest/now",
        "miracle-diet.shop /lose/weight/pills", "adult-chat.cam /live/girls", "click-bait.top /you-wont-believe", "fake-news.click /shock/scandal",
        "torrent-free.top /movie/crack/download", "gamble.slots.bet /free-spins", "ad.tracker.biz /pixel/track", "essay-mill.shop /buy/essay/cheap",
    )),
)


def parts(url: str = "url") -> tuple[Column, Column]:
    """host (A-Z lowered) and path."""
    u = F.coalesce(F.col(url), F.lit(""))
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(u, shape, 1), UPPER, LOWER), F.regexp_extract(u, shape, 2)


def buckets_of(host: str, path: str) -> list[int]:
    """Buckets of the n-grams, as grams() computes them."""
    s = f"^{host} {path}$"
    gs = {s[i : i + n] for n in NGRAMS for i in range(len(s) - n + 1)}
    return sorted(int(hashlib.md5(g.encode()).hexdigest()[:4], 16) % BUCKETS for g in gs)


@cache
def train(labelled: tuple[tuple[str, int], ...] = LABELLED) -> tuple[float, ...]:
    """Weights of the buckets and, last, the bias. Batch gradient descent on the log loss with an L2 penalty; features are scaled by 1 / sqrt(n-grams)."""
    rows = []
    for u, y in labelled:
        bs = buckets_of(*u.split(" ", 1))
        rows.append((bs, 1 / math.sqrt(max(1, len(bs))), y))
    w, bias = [0.0] * BUCKETS, 0.0
    for _ in range(ROUNDS if rows else 0):
        grad, slope = [PENALTY * x for x in w], 0.0
        for bs, scale, y in rows:
            z = bias + scale * sum(w[b] for b in bs)
            d = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y) / len(rows)
            slope += d
            for b in bs:
                grad[b] += d * scale
        w = [x - RATE * len(NGRAMS) * g for x, g in zip(w, grad, strict=True)]
        bias -= RATE * slope
    return tuple(round(x, 6) for x in (*w, bias))


def score(s: Column, weights: Sequence[float]) -> Column:
    """Log odds of block for `^host path$`, rounded to 6 digits."""

    def of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - (n - 1), F.lit(1))), lambda i: F.substring(s, i, F.lit(n)))

    grams = F.array_distinct(F.concat(*map(of, NGRAMS)))  # the shortest text, `^ $`, is one n-gram of three
    table = F.array(*[F.lit(float(x)) for x in weights[:-1]])
    total = F.aggregate(grams, F.lit(0.0), lambda a, g: a + F.element_at(table, (F.conv(F.substring(F.md5(g), 1, 4), 16, 10).cast("int") % BUCKETS) + 1))
    return F.round(weights[-1] + total / F.sqrt(F.greatest(F.size(grams), F.lit(1))), 6)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (host and path joined) and its verdict, null where none fits. Rules are few: one CASE."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labelled: tuple[tuple[str, int], ...] = LABELLED) -> DataFrame:
    """page_id, host, path, rule, verdict, log_odds of every row of pages (log_odds: null where a rule decides)."""
    host, path = parts()
    rows = computed(pages.select("page_id", "url"), host=host, path=path, text=F.concat(F.lit("^"), host, F.lit(" "), path, F.lit("$")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": verdict})
    rows = rows.withColumn("log_odds", F.when(F.col("said").isNull(), score(F.col("text"), train(labelled))))
    own = F.when(F.col("log_odds") > 0, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("said", own).alias("verdict"), "log_odds")


def sql() -> str:
    rules = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    grams = " || ".join(f"list_transform(range(1, length(s) - {n - 2}), lambda i: substr(s, i, {n}))" for n in NGRAMS)
    w = train()
    return rf"""
WITH u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', ['h', 'p']) AS m FROM pages),
p AS (SELECT page_id, translate(m.h, '{UPPER}', '{LOWER}') AS host, m.p AS path FROM u),
r AS (SELECT *, CASE {" ".join(f"WHEN {fits(h, q)} THEN '{h}{q}'" for h, q, _ in rules)} END AS rule,
  CASE {" ".join(f"WHEN {fits(h, q)} THEN '{v}'" for h, q, v in rules)} END AS said, '^' || host || ' ' || path || '$' AS s FROM p),
g AS (SELECT *, list_distinct({grams}) AS gs FROM r),
o AS (SELECT *, CASE WHEN said IS NULL THEN round({w[-1]} + list_sum(list_transform(gs, lambda x: ({list(w[:-1])})[('0x' || substr(md5(x), 1, 4))::int % {BUCKETS} + 1])) / sqrt(greatest(length(gs), 1)), 6) END AS log_odds FROM g)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN log_odds > 0 THEN 'block' ELSE 'allow' END) AS verdict, log_odds FROM o
"""
