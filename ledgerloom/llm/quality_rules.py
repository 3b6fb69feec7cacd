"""Quality rules of documents and of their hosts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import let, stored, without, words_of

#: Characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "soft_failed", "host_failure", "host_rejected", "kept")


def repeated_words(words: Column) -> Column:
    """Words inside windows of three words that stand twice or more in the same text.

    Windows are hashed from word hashes. Where all are distinct the count is 0; else they are sorted by hash
    with their place, equal neighbours mark repeated places, and a place adds the words up to the next marked
    place, three at most, so overlapping windows count a word once."""

    def hashed(h: Column) -> Column:
        pairs = F.zip_with(h, F.slice(h, 2, 1 << 30), lambda a, b: F.xxhash64(a, b))
        return F.slice(F.zip_with(pairs, F.slice(h, 3, 1 << 30), lambda a, b: F.xxhash64(a, b)), 1, F.greatest(F.size(h) - 2, F.lit(0)))

    def marked(s: Column) -> Column:
        later = F.slice(F.zip_with(s, F.slice(s, 2, 1 << 30), lambda a, b: a["h"] == b["h"]), 1, F.size(s) - 1)
        return let(later, lambda t: F.zip_with(F.concat(t, F.array(F.lit(False))), F.concat(F.array(F.lit(False)), t), lambda a, b: a | b))

    def places(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        repeated = let(ordered, lambda s: F.filter(F.zip_with(s["i"], marked(s), lambda i, r: F.when(r, i)), lambda i: i.isNotNull()))
        return F.sort_array(repeated)

    def covered(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, 2, 1 << 30), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    counted = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(places(h), covered))
    return let(let(F.transform(words, lambda w: F.xxhash64(w)), hashed), counted)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus the counts of the base rules and ``base_failed``."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = (
        without(docs, *ADDED, "words__", "lines__")
        .withColumns({"words__": words_of(whole), "lines__": lines})
        .withColumns(
            {
                "n_words": F.size("words__").cast("long"),
                "word_chars": F.length(F.array_join("words__", "")).cast("long"),
                "n_symbols": F.regexp_count(whole, F.lit(SYMBOLS)).cast("long"),
                "n_dup_lines": (F.size("lines__") - F.size(F.array_distinct("lines__"))).cast("long"),
                "n_repeat_words": repeated_words(F.col("words__")),
            }
        )
        .drop("words__", "lines__")
    )
    return counted.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def host_verdicts(measured: DataFrame, host: Column, reject_rate: float = 0.5) -> DataFrame:
    """One row per host: its rule failures, its failure rate shrunk towards the corpus, and its verdict.

    The prior is a beta distribution fitted by moments to the hosts' own rates: mean m over all documents, and
    strength from the spread of the rates that sampling alone does not explain. A host of few documents lies
    near m; a large host speaks for itself. A host is rejected when its shrunk rate is above ``reject_rate``."""
    hosts = measured.groupBy(host.alias("host__")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("base_failed") | F.col("soft_failed")).cast("long")).alias("failures"))
    rate = F.col("failures") / F.col("n")
    sums = hosts.agg(
        F.sum("failures").alias("x"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("n") * rate * rate).alias("nr2"), F.sum(F.col("n") * F.col("n")).alias("n2"),
    )
    mean = F.col("x") / F.col("n")
    spread = mean * (1 - mean)
    # moments of a weighted one-way layout: between-host sum of squares less what binomial noise gives
    between = F.greatest(F.lit(0.0), (F.col("nr2") - F.col("n") * mean * mean - (F.col("k") - 1) * spread) / F.greatest(F.lit(1e-9), F.col("n") - F.col("n2") / F.col("n") - (F.col("k") - 1)))
    strength = F.least(F.lit(1e6), F.greatest(F.lit(1.0), spread / F.greatest(between, F.lit(1e-9)) - 1))
    prior = sums.select(mean.alias("m__"), strength.alias("s__"))
    shrunk = (F.col("failures") + F.col("m__") * F.col("s__")) / (F.col("n") + F.col("s__"))
    # the prior is one row; hosts meet it without a key
    return hosts.join(prior).select("host__", F.round(shrunk, 9).alias("host_failure"), (F.round(shrunk, 9) > reject_rate).alias("host_rejected"))


def quality_rules(docs: DataFrame, host: str = "source", text: str = "text", reject_rate: float = 0.5, keep_text: bool = True) -> DataFrame:
    """``docs``, with or without its text, plus the measures, the host's shrunk failure rate and the verdict ``kept``.

    A document fails softly with more than one symbol in ten words, or with more than three tenths of its
    lines repeated. A kept document passes base and soft rules and comes from a host that is not rejected. Hosts are
    counted before they are shuffled, so one host with a third of all rows is one row per task; verdicts are
    one row per host and come back by a join that Spark may split or broadcast by their measured size. The
    measures are written once to the shared folder, as hosts and documents both need them.

    Null texts have no words and fail; null hosts form one host; repeated rows each count; input columns named
    like the results are replaced; an empty table gives an empty result."""
    symbols = 10 * F.col("n_symbols") > F.col("n_words")
    lines = 10 * F.col("n_dup_lines") > 3 * F.size(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n"))
    measured = measures(docs, text).withColumn("soft_failed", symbols | lines)
    measured = stored(measured if keep_text else measured.drop(text), "measured")
    verdicts = host_verdicts(measured, F.col(host))
    joined = measured.join(verdicts, F.col(host).eqNullSafe(F.col("host__")), "left").drop("host__")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("soft_failed") & ~F.coalesce(F.col("host_rejected"), F.lit(False)))
