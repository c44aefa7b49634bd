"""Text of list rows, and the ranked filter over them.

The filter matches a pattern as a subsequence, whatever the case, as one fold over a text's
characters. For each pattern character it takes the best of its occurrences before the next one
begins; an occurrence is worth 10 at the start, 20 after a separator, 20 where case rises, and, directly
after the last match, 5 and twice what such matches got so far. The first match costs 5 for each character before
it, 15 at most, and each character that isn't matched costs 1. Better scores come first, ties in list order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..tables import settle

# Weights of the filter and the characters that separate words.
FIRST, SEPARATED, CAMEL, ADJACENT, LEADING, LEADING_MOST = 10, 20, 20, 5, -5, -15
SEPARATORS = ("/", "-", "_", " ", ".", "\\")


def title(name: Column, version: Column) -> Column:
    return F.concat(name, F.lit(" "), F.when(fn.text(version) == "", "(no version)").otherwise(version))


def description(purl: Column, licenses: Column, dependencies: Column) -> Column:
    """The package type if there is a purl, else the first licence and the number of dependencies."""
    parts = F.concat_ws(" | ", F.concat(F.lit("License: "), F.get(licenses, F.lit(0))), F.when(dependencies > 0, F.concat(F.lit("Deps: "), dependencies.cast("string"))))
    return F.when(F.coalesce(purl, F.lit("")).startswith("pkg:"), F.concat(F.lit("Type: "), F.substring_index(F.substring(purl, 5, 1 << 30), "/", 1))).otherwise(parts)


def filter_value(name: Column, purl: Column, licenses: Column) -> Column:
    return F.concat_ws(" ", name, fn.text(purl), F.array_join(licenses, " "))


def subsequence_score(text: Column, pattern: str) -> Column:
    """The score of ``pattern`` in ``text``, null where it is no subsequence."""
    if not pattern:
        return F.lit(0)
    letters = [c.lower() for c in pattern]
    wanted = F.array(*map(F.lit, letters))
    integer = lambda v: F.lit(v).cast("int")
    # p: pattern place, best and at: the best occurrence so far, last: place of the last match, run: adjacency bonus
    begin = F.struct(integer(0).alias("p"), integer(-1).alias("best"), integer(-1).alias("at"), integer(-1).alias("last"), integer(0).alias("run"), integer(0).alias("score"))

    def let(value: Column, then: Callable[[Column], Column]) -> Column:  # makes a value once, however often it is used
        return F.get(F.transform(F.array(value), then), F.lit(0))

    def marks(chars: Column) -> Column:
        """j, low, next and worth (without bonus) of the places at which the fold can change its state."""

        def made(lows: Column) -> Column:
            def mark(c: Column, j: Column) -> Column:
                before = F.get(chars, j - 1)
                rises = (before != F.upper(before)) & (c != F.lower(c))
                worth = F.when(j == 0, FIRST).when(rises, CAMEL).otherwise(0) + F.when((j > 0) & before.isin(*SEPARATORS), SEPARATED).otherwise(0)
                return F.struct(j.alias("j"), F.get(lows, j).alias("low"), F.get(lows, j + 1).alias("next"), F.when(F.get(lows, j).isin(*letters), worth).alias("worth"))

            return F.filter(F.transform(chars, mark), lambda m: m["low"].isin(*letters) | m["next"].isNull() | m["next"].isin(*letters))

        return let(F.transform(chars, F.lower), made)

    def step(s: Column, m: Column) -> Column:
        j = m["j"]

        def judged(x: Column) -> Column:
            return let(F.struct(x["bonus"].alias("bonus"), (m["worth"] + x["bonus"]).alias("worth")), moved)

        def moved(x: Column) -> Column:
            better = x["worth"] > s["best"]
            return let(F.struct(F.when(better, x["worth"]).otherwise(s["best"]).alias("best"), F.when(better, j).otherwise(s["at"]).alias("at"), (s["run"] + x["bonus"]).alias("run")), closed)

        def closed(x: Column) -> Column:
            due = (x["at"] >= 0) & (m["next"].isNull() | F.coalesce(m["next"] == F.get(wanted, s["p"] + 1), F.lit(False)))
            lead = F.when(s["last"] < 0, F.greatest(x["at"] * LEADING, F.lit(LEADING_MOST))).otherwise(0)
            done = {"p": s["p"] + 1, "best": F.lit(-1), "at": F.lit(-1), "last": x["at"], "run": x["run"], "score": s["score"] + x["best"] + lead}
            open_ = {"p": s["p"], "best": x["best"], "at": x["at"], "last": s["last"], "run": x["run"], "score": s["score"]}
            state = lambda fields: F.struct(*[v.cast("int").alias(k) for k, v in fields.items()])
            return F.when(due, state(done)).otherwise(state(open_))

        hit = (s["p"] < len(pattern)) & (m["low"] == F.get(wanted, s["p"]))
        bonus = F.when((s["last"] >= 0) & (s["last"] == j - 1), s["run"] * 2 + ADJACENT).otherwise(0)
        missed = F.struct(s["best"].alias("best"), s["at"].alias("at"), s["run"].alias("run"))
        return F.when(F.coalesce(hit, F.lit(False)), let(F.struct(bonus.alias("bonus")), judged)).otherwise(closed(missed))

    # the text's characters and their places are made once a row, not once a step
    length = F.length(text)
    score = let(F.aggregate(let(F.split(text, ""), marks), begin, step), lambda end: F.when(end["p"] == len(pattern), end["score"]))
    return F.when(length > 0, score - (length - len(pattern)))


def may_match(text: Column, pattern: str) -> Column:
    """A cheap test that every matching text passes."""
    if not pattern or not pattern.isascii():  # other letters' case can hang on their neighbours
        return F.lit(True)
    first, *rest = [rf"\x{{{ord(c.lower()):x}}}" for c in pattern]
    return F.lower(text).rlike(first + "".join(f"[^{c}]*{c}" for c in rest))


def ranked(comps: DataFrame, pattern: str) -> DataFrame:
    """ordinal, score of the rows that match, best first. The filter looks at name, purl and licences."""
    text = filter_value(F.col("name"), F.col("purl"), F.col("licenses"))
    scored = comps.where(may_match(text, pattern)).select("ordinal", subsequence_score(text, pattern).alias("score"))
    # kept: a filter on the score and the sort's sample would make it again
    return settle(scored, "scores").where("score IS NOT NULL").orderBy(F.desc("score"), "ordinal")
