"""URL filter by rules, and by the ratio of two character language models where no rule fits.

Rules allow or block a host with all its subdomains, below a path; the longest that fits wins.
The URLs that rules allow and those that they block train two variable-order Markov models of
characters (contexts of up to ``ORDER`` characters, blended by Witten-Bell escapes: a context
gives the next shorter one as much weight as it has distinct followers; Begleiter et al., "On
Prediction Using Variable Order Markov Models", 2004). A URL without a rule is allowed if the mean
per character of

    ln p(character | context, allowed URLs) - ln p(character | context, blocked URLs)

reaches a threshold. That is calibrated on the labelled URLs of fold 0 (by a hash of the URL)
with models of the others: the middle of where balanced accuracy is greatest. The models that judge
are of all labelled URLs.

Models see a URL without its scheme, A-Z lower-cased. A URL that occurs often counts once, so
copies have no weight.

At scale: everything is DataFrame functions. The characters of distinct URLs are counted before
their shuffle; the tables of contexts are joined level by level and never sent to the driver or
to all tasks, since they grow with the corpus. A URL's characters meet their log ratios by a join
that adaptive execution can split, as the other side is aggregated with a shuffle of its own. The
driver gets the counts of at most 2 * (2 * ``MOST_BIN`` + 1) bins. Ratios are summed as integers
(units of 2**-20), so that results do not depend on the order of rows.

Defined results: a null URL, or one without ``://``, has empty host and path and no rule. A URL without
a character has score 0. With one class of labelled URLs, or none, all scores are 0 and the
threshold is 0, and URLs without a rule are allowed. Scores equal to the threshold allow. Repeated
rows and ids are judged one by one. Columns that the result adds get names the table does not have.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.merge import own_shuffle
from ..scratch import discarding_stages, staged
from .batches import hidden, text_column

#: Longest context.
ORDER = 5
#: Stands before the first character.
START = "\x01"
UNITS = 1 << 20
#: Thresholds are multiples of 1 / BINS; scores beyond MOST_BIN of them say no more than that.
BINS = 256
MOST_BIN = 8192
#: Rules become one expression; a longer list is refused.
MOST_RULES = 1000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null if nothing does."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """(name, allow) of the longest rule that fits, the first of equally long ones; null if none."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} are supported")
    found = F.lit(None).cast("struct<name:string,allow:boolean>")
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):  # the longest is tried first
        found = F.when(rule.fits(host, path), F.struct(F.lit(rule.name).alias("name"), F.lit(rule.allow).alias("allow"))).otherwise(found)
    return found


def modelled(url: Column) -> Column:
    """The characters that models see."""
    return F.translate(F.coalesce(after_scheme(url), url, F.lit("")), UPPER, LOWER)


def grams_of(text: Column) -> Column:
    """For every character of ``text`` the ``ORDER`` characters before it and itself."""
    padded = F.concat(F.lit(START * ORDER), text)
    # one character is consumed at a time, the window is looked ahead at
    return F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{ORDER + 1}}}))."), F.lit(1))


#: Counts of a gram: in allowed and blocked URLs, and in those outside the calibration fold.
COUNTS = ("allowed", "blocked", "allowed_fit", "blocked_fit")


def gram_counts(urls: DataFrame) -> DataFrame:
    """(gram, counts) of every gram of any URL. ``urls``: text, allow (null: unlabelled), fold."""
    fit = F.col("fold") != 0
    each = urls.select(F.explode(grams_of(F.col("text"))).alias("gram"), "allow", "fold")
    kinds = {"allowed": F.col("allow"), "blocked": ~F.col("allow"), "allowed_fit": F.col("allow") & fit, "blocked_fit": ~F.col("allow") & fit}
    return each.groupBy("gram").agg(*[F.count_if(kinds[n]).alias(n) for n in COUNTS])


def probabilities(grams: DataFrame) -> DataFrame:
    """(gram, p_<count> for every count): the blended probability of each gram's last character.

    Level by level from no context to the longest: counts of the grams' ends, totals and distinct
    followers of their contexts, and the next shorter end's probability.
    """
    before = None
    for k in range(ORDER + 1):
        level = grams.groupBy(F.right("gram", F.lit(k + 1)).alias("end")).agg(*[F.sum(n).alias(n) for n in COUNTS])
        context = Window.partitionBy(F.left("end", F.lit(k)))  # as many rows as characters follow
        totals = [F.sum(n).over(context).alias(f"n_{n}") for n in COUNTS]
        followers = [F.count_if(F.col(n) > 0).over(context).alias(f"f_{n}") for n in COUNTS]
        level = level.select("*", *totals, *followers, F.count(F.lit(1)).over(context).alias("characters"))
        if before is None:
            shorter = {n: 1.0 / (F.col("characters") + 1) for n in COUNTS}
        else:
            level = level.join(before, F.right("end", F.lit(k)) == F.col("shorter"))
            shorter = {n: F.col(f"p_{n}") for n in COUNTS}
        blended = {
            n: F.when(F.col(f"n_{n}") == 0, shorter[n]).otherwise(
                (F.col(n) + F.col(f"f_{n}") * shorter[n]) / (F.col(f"n_{n}") + F.col(f"f_{n}"))
            )
            for n in COUNTS
        }
        before = level.select(F.col("end").alias("shorter"), *[blended[n].alias(f"p_{n}") for n in COUNTS])
    return before.withColumnRenamed("shorter", "gram")


def log_ratios(grams: DataFrame) -> DataFrame:
    """(gram, ratio, ratio_fit): log ratios in units, with all labelled URLs and without fold 0."""

    def units(allowed: str, blocked: str) -> Column:
        return F.floor((F.log(allowed) - F.log(blocked)) * F.lit(float(UNITS)) + 0.5).cast("bigint")

    return probabilities(grams).select(
        "gram", units("p_allowed", "p_blocked").alias("ratio"), units("p_allowed_fit", "p_blocked_fit").alias("ratio_fit")
    )


def _bin(total: Column, n: Column) -> Column:
    """The mean ratio of ``n`` characters as a number of bins."""
    found = F.floor(total / (n * F.lit(float(UNITS // BINS)))).cast("int")
    return F.greatest(F.least(found, F.lit(MOST_BIN)), F.lit(-MOST_BIN))


def scores(urls: DataFrame) -> DataFrame:
    """(id, bin, bin_fit, n) of every URL that needs a score: unlabelled ones and those of fold 0."""
    grams = staged(gram_counts(urls), "grams")
    wanted = urls.filter(F.col("allow").isNull() | (F.col("fold") == 0))
    each = wanted.select("id", F.explode(grams_of(F.col("text"))).alias("gram"))
    both = [F.count_if(F.col(n) > 0) > 0 for n in COUNTS]
    known = grams.agg(both[0] & both[1], both[2] & both[3]).first()
    met = each.join(own_shuffle(log_ratios(grams)), "gram")
    summed = met.groupBy("id").agg(F.sum("ratio").alias("total"), F.sum("ratio_fit").alias("total_fit"), F.count(F.lit(1)).alias("n"))
    return summed.select(
        "id",
        (_bin(F.col("total"), F.col("n")) if known[0] else F.lit(0)).alias("bin"),
        (_bin(F.col("total_fit"), F.col("n")) if known[1] else F.lit(0)).alias("bin_fit"),
        "n",
    )


def calibrate(bins: list[tuple[int, bool, int]]) -> float:
    """The threshold, in bins: the middle of those of greatest balanced accuracy.

    ``bins``: (bin, allowed, URLs) of the labelled URLs held out. 0 unless both classes occur.
    """
    good = sum(n for _, allow, n in bins if allow)
    bad = sum(n for _, allow, n in bins if not allow)
    if not good or not bad:
        return 0.0
    edges = sorted({b for b, _, _ in bins})

    def right(edge: int) -> int:
        kept = sum(n for b, allow, n in bins if allow and b >= edge)
        dropped = sum(n for b, allow, n in bins if not allow and b < edge)
        return kept * bad + dropped * good

    worth = {edge: right(edge) for edge in edges}
    best = [edge for edge in edges if worth[edge] == max(worth.values())]
    # any threshold above the bin before the first best one does as well
    lower = max((e for e in edges if e < best[0]), default=best[0] - 1)
    return (lower + 1 + best[-1]) / 2


def judge(pages: DataFrame, rules: Sequence[Rule], *, url_col: str = "url") -> tuple[DataFrame, dict[str, str]]:
    """``pages`` with a verdict on every row, and the names its new columns got: host, path, rule
    (null if none fits), verdict (allow or block), score (mean log ratio per character, in steps of
    1 / ``BINS``; null where a rule decides) and threshold."""
    spark = pages.sparkSession
    wanted = ("host", "path", "rule", "verdict", "score", "threshold")
    names = dict(zip(wanted, hidden(pages, *wanted), strict=True))
    [text, found] = hidden(pages, "modelled", "found")
    url = text_column(pages, url_col)
    split = pages.withColumns({names["host"]: host_of(url), names["path"]: path_of(url), text: modelled(url)})
    split = split.withColumn(found, longest_rule(rules, F.col(names["host"]), F.col(names["path"])))
    with discarding_stages(spark):
        distinct = split.groupBy(F.col(text).alias("text"), F.col(f"{found}.allow").alias("allow")).agg(F.lit(1).alias("one"))
        fold = (F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 4), 16, 10).cast("int") % 5).alias("fold")
        urls = staged(distinct.select(F.monotonically_increasing_id().alias("id"), "text", "allow", fold), "urls")
        scored = staged(scores(urls), "scored")
        held = scored.join(urls.filter("allow is not null").select("id", "allow"), "id")
        threshold = calibrate([tuple(r) for r in held.groupBy("bin_fit", "allow").count().collect()])
        judged = urls.filter("allow is null").join(scored, "id").select(F.col("text").alias("judged"), F.col("bin"))
        judged = staged(judged, "judged", keep=True)
    met = split.join(judged, (F.col(text) == F.col("judged")) & F.col(found).isNull(), "left")
    value = F.when(F.col(found).isNull(), F.coalesce("bin", F.lit(0)))
    allow = F.coalesce(F.col(f"{found}.allow"), value >= F.lit(threshold), F.lit(True))
    shown = met.withColumns(
        {
            names["rule"]: F.col(f"{found}.name"),
            names["verdict"]: F.when(allow, F.lit("allow")).otherwise(F.lit("block")),
            names["score"]: value / F.lit(float(BINS)),
            names["threshold"]: F.lit(threshold / BINS),
        }
    )
    return shown.select(*[F.col(f"`{c}`") for c in pages.columns], *names.values()), names
