"""Rules on documents, judged by host as well.

A document fails if it has too few words or repeats itself too much. Failures are summed by host, each host's rate is
shrunk towards the rate of all documents with an empirical beta prior, and the host's verdict is joined back to its documents.
The prior's weight comes from the beta-binomial moments: hosts weigh by their documents, and the scatter that documents drawn
at one common rate would show by themselves is taken off first. Only what hosts differ by beyond that makes the prior weak. So a
table of tiny hosts, whose rates say little, leaves all of them near the common rate, and a host of three documents is not
condemned by two; where hosts of many documents do differ, one of a million is judged by its own rate.

Everything is a column expression: one scan, no shuffle for the documents' figures, one aggregation of counts by host.
Windows of 8 words are compared as 64-bit hashes within one text. Hosts are one row each and join as Spark sees fit.

Results: null or empty text has no words and fails; a null host is a host of its own; a null doc_id is kept as it is;
repeated rows are rows like others; very long texts are rows like others, a text at a time; an empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dishlens.sources.sinks import materialize

WHITE = " \t\n\x0b\x0c\r"
WINDOW, MIN_WORDS, MAX_REPEATED_PERCENT = 8, 20, 30
#: A host whose shrunk rate of failures is above this loses all of its documents.
MAX_HOST_RATE = 0.5
#: Bounds on the prior's weight, counted in documents, for hosts that differ wholly or not at all.
PRIOR_WEIGHT = (1.0, 1_000_000.0)


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def window_hashes(hashes: str) -> Column:
    """A hash of every 8 neighbours, from a column with the words' hashes."""
    n = F.size(hashes) - WINDOW + 1
    every = F.transform(F.col(hashes), lambda _, i: F.when(i < n, F.xxhash64(F.slice(F.col(hashes), i + 1, WINDOW))))
    return F.slice(every, 1, F.greatest(n, F.lit(0)))


def repeated_positions(pairs: str) -> Column:
    """Where the windows begin that occur twice or more, ascending, from a column with their sorted hashes and positions."""
    beside = lambda p, j: F.coalesce(F.get(F.col(pairs), j)["h"] == p["h"], F.lit(False))
    found = F.filter(F.col(pairs), lambda p, j: beside(p, j - 1) | beside(p, j + 1))
    return F.sort_array(F.transform(found, lambda p: p["i"]))


def covered_words(positions: str) -> Column:
    """Words in windows that begin at the positions of a column, each once."""
    steps = F.transform(F.col(positions), lambda p, j: F.least(F.coalesce(F.get(F.col(positions), j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)


def document_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host, the figures of each document and whether it fails by itself; no shuffle.

    Arrays that an expression looks into at every step are columns of a projection before, so that they are made once.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), body.alias("body"), words(body).alias("words"))
    lines = F.filter(F.split("body", "\n", -1), lambda line: F.length(F.btrim(line, F.lit(WHITE))) > 0)
    base = base.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda total, w: total + F.length(w)).alias("word_chars"),
        (F.length("body") - F.length(F.regexp_replace("body", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    base = base.withColumn("hashes", window_hashes("hashes"))
    some = F.size(F.array_distinct("hashes")) < F.size("hashes")
    base = base.withColumn("pairs", F.when(some, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    base = base.withColumn("positions", repeated_positions("pairs"))
    base = base.select(
        "doc_id",
        "host",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("positions").isNotNull(), covered_words("positions")).otherwise(0).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return base.withColumn("base_failed", failed)


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Parameters of the beta distribution that hosts' rates are drawn from, by the moments of the beta-binomial.

    With p the rate of all N documents and k hosts, the sum over hosts of n (rate - p)^2 is expected to be
    p (1 - p) (k - 1 + rho (N - sum(n^2) / N - k + 1)); the prior's weight is 1 / rho - 1.
    """
    total = hosts.agg(F.sum("failed"), F.sum("n"), F.count(F.lit(1)), F.sum(F.col("n").cast("double") * F.col("n"))).first()
    low, high = PRIOR_WEIGHT
    if not total[1]:
        return low, low
    failed, n, k, squares = total
    p = failed / n
    scatter = hosts.agg(F.sum(F.col("n") * F.pow(F.col("failed") / F.col("n") - p, 2))).first()[0]
    free = n - squares / n - (k - 1)
    # hosts of a document each say nothing of what hosts differ by
    rho = round((scatter / (p * (1 - p)) - (k - 1)) / free, 9) if 0 < p < 1 and free > 0 else 0.0
    weight = min(max(1 / rho - 1, low), high) if rho > 0 else high
    return round(p * weight, 6), round((1 - p) * weight, 6)


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row for each document: its figures, base_failed, its host's shrunk rate, and kept."""
    rules = materialize(document_rules(docs, doc_id, text, host), "rules")
    hosts = rules.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    a, b = beta_prior(hosts)
    verdicts = hosts.select(F.col("host").alias("judged"), F.round((F.col("failed") + a) / (F.col("n") + a + b), 6).alias("host_rate"))
    return (
        rules.join(verdicts, F.col("host").eqNullSafe(F.col("judged")), "left")
        .withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_host_rate))
        .drop("host", "judged")
    )
