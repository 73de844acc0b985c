"""Quality rules with risk-controlled thresholds; only DataFrame functions.

A rule rejects a document whose statistic reaches a cutoff. Its cutoffs are a fixed list, from lenient to strict, so that each
rejects what those before it reject. Labelled documents that pass the base rules are dealt to two halves by a hash of
the id. Per stratum (language) and rule:

* On the *holdout* half the null hypothesis "this cutoff rejects a share of ``risk`` / number of rules or more of the good documents" is
  tested exactly: with k of n good documents rejected its p-value is P(Binomial(n, share) <= k). Cutoffs are tested in
  their order up to the first that is not significant, which needs no correction within a rule; the level is
  ``confidence_gap`` divided by the number of (stratum, rule) sequences (Bonferroni). So with probability
  1 - ``confidence_gap`` no certified cutoff anywhere falsely rejects more than its share, and a stratum's rules
  together reject at most ``risk`` of its good documents.
* On the *other* half the gain of each cutoff, bad documents rejected less ``price`` times the good ones, chooses among the
  certified; without a positive gain the rule is off.

Defined cases: a null text is empty; a null language is the stratum ``und``; labels with a null id or quality, or without a document,
are left out; a document is good where all its labels say so; rows that share an id are trials of their own; a
stratum without certified cutoffs keeps what passes the base rules; an empty table gives an empty result.
"""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ringfence.session import cut, join_small

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Per rule: numerator, denominator and the cutoffs per 1000, lenient first. ``short_words`` rejects at and below its cutoffs.
SHARES = (900, 800, 700, 600, 500, 450, 400, 350, 300, 250, 200, 150, 120, 100, 80, 60, 50, 40, 30, 20)
RULES = {
    "symbols": ("n_symbols", "word_chars", SHARES + (15, 10, 5)),
    "dup_lines": ("n_dup_lines", "n_lines", SHARES),
    "repeats": ("n_repeat_words", "n_words", SHARES),
    "long_words": ("word_chars", "n_words", tuple(range(20_000, 5_900, -500))),
    "short_words": ("word_chars", "n_words", tuple(range(1_000, 5_100, 250))),
}
FALLING = {"short_words"}


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words that lie in windows of three which occur twice or more.

    Windows are ordered by a hash, so that equal ones are neighbours; neighbours of one hash are compared word by word.
    """
    word = lambda at, k: F.element_at(words, at + k)
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.struct(
        F.xxhash64(word(i, 0), word(i, 1), word(i, 2)).alias("h"), i.alias("at")))

    def places(ordered):
        def equal(x, y):
            same = x["h"] == y["h"]
            for k in range(3):
                same = same & (word(x["at"], k) == word(y["at"], k))
            return F.coalesce(same, F.lit(False))

        found = F.filter(ordered, lambda x, i: equal(x, F.get(ordered, i - 1)) | equal(x, F.get(ordered, i + 1)))
        return F.sort_array(F.transform(found, lambda x: x["at"]))

    # a window covers three words, less those that the next one covers too
    cover = lambda at: F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    return F.when(F.size(words) < 3, 0).otherwise(let(F.sort_array(windows), lambda ordered: let(places(ordered), cover)))


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words and base_failed of every row."""
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    counted = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("stratum"),
        let(words, lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("again"))).alias("_words"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("once"))).alias("_lines"))
    rows = counted.select(
        "doc_id", "stratum", F.col("_words.n").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.col("_lines.n") - F.col("_lines.once")).cast("long").alias("n_dup_lines"), F.col("_lines.n").cast("long").alias("n_lines"),
        F.col("_words.again").cast("long").alias("n_repeat_words"))
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def first_reached() -> Column:
    """Per rule the place of the first cutoff that the row reaches (their number, if none): array of (rule, level, cutoffs)."""

    def level(name: str, up: str, down: str, cutoffs) -> Column:
        value, per = 1000 * F.col(up), F.col(down)
        every = F.array(*[F.lit(c).cast("long") for c in cutoffs])
        hit = F.filter(every, lambda c: value <= c * per if name in FALLING else value >= c * per)
        n = F.when(per > 0, F.size(hit)).otherwise(0)
        return F.struct(F.lit(name).alias("rule"), (F.lit(len(cutoffs)) - n).alias("level"), F.lit(len(cutoffs)).alias("cutoffs"))

    return F.array(*[level(name, *rule) for name, rule in RULES.items()])


def log_gamma(x: Column) -> Column:
    """Stirling's series, ten places further up."""
    z = x + 10
    series = (z - 0.5) * F.ln(z) - z + 0.5 * log(2 * pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    for i in range(10):
        series = series - F.ln(x + i)
    return series


def binomial_tail(n: Column, k: Column, share: float) -> Column:
    """P(Binomial(n, share) <= k) where k lies below the mean, else 1.

    The terms fall from k down; those more than ten deviations away add less than the precision.
    """
    n, k = n.cast("double"), k.cast("double")
    top = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * log(share) + (n - k) * log(1 - share)
    terms = F.least(k, F.ceil(10 * F.sqrt(n * share)) + 50).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("all"))

    def step(acc, j):
        term = acc["term"] * (k - j + 1) / (n - k + j) * ((1 - share) / share)
        return F.struct(term.alias("term"), (acc["all"] + term).alias("all"))

    sums = F.when(terms > 0, F.aggregate(F.sequence(F.lit(1), terms), start, step)["all"]).otherwise(1.0)
    return F.when(k < n * share, F.least(F.lit(1.0), F.exp(top) * sums)).otherwise(1.0)


def fit_cutoffs(statistics: DataFrame, labels: DataFrame, risk: float = 0.05, confidence_gap: float = 0.05, price: int = 5) -> DataFrame:
    """(stratum, rule, level, cutoff, trials, rejected, p_value) of the rules that are on.

    ``labels`` has doc_id and quality; ``statistics`` is :func:`text_statistics` of the documents.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_id")).agg((F.min("quality") > 0).alias("good"))
    half = F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 1) < "8"
    rated = statistics.filter("not base_failed").join(known, F.col("doc_id") == F.col("_id")).withColumn("held", half)
    rated = rated.select("stratum", "good", "held", F.explode(first_reached()).alias("r")).select("stratum", "good", "held", "r.*")
    good, held = F.col("good"), F.col("held")
    per = rated.groupBy("stratum", "rule", "cutoffs", "level").agg(
        F.count_if(good & held).alias("k"), F.count_if(good & ~held).alias("lost"), F.count_if(~good & ~held).alias("won"))
    per = cut(per, "rule-counts")
    key = ["stratum", "rule"]
    sums = {c: F.sum(c).alias(c) for c in ("k", "lost", "won")}
    tests = per.groupBy(*key, "cutoffs").agg(F.sum("k").alias("trials")).filter("trials > 0")
    sequences = W.partitionBy()
    tests = tests.withColumn("_alpha", confidence_gap / F.count(F.lit(1)).over(sequences)).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("cutoffs") - 1)))
    upto = per.filter("level < cutoffs").withColumn("at", F.explode(F.sequence(F.col("level"), F.col("cutoffs") - 1))).groupBy(*key, "at").agg(*sums.values())
    tests = tests.join(upto, [*key, "at"], "left").fillna(0, list(sums))
    tests = tests.withColumn("p_value", binomial_tail(F.col("trials"), F.col("k"), risk / len(RULES)))
    earlier = W.partitionBy(*key).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    tests = tests.withColumn("_certified", F.min(F.col("p_value") <= F.col("_alpha")).over(earlier)).withColumn("_gain", F.col("won") - price * F.col("lost"))
    best = tests.filter("_certified and _gain > 0").groupBy(*key).agg(F.max_by(F.struct("at", "trials", "k", "p_value"), F.struct("_gain", -F.col("at"))).alias("b"))
    lists = F.create_map(*[x for name, (_, _, cutoffs) in RULES.items() for x in (F.lit(name), F.array(*[F.lit(c) for c in cutoffs]))])
    return best.select(*key, F.col("b.at").alias("level"), F.get(lists[F.col("rule")], F.col("b.at")).alias("cutoff"), F.col("b.trials").alias("trials"),
                       F.col("b.k").alias("rejected"), F.col("b.p_value").alias("p_value"))


def apply_cutoffs(statistics: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``statistics`` with ``failed``, the rules that a row fails in its stratum, and ``kept``."""
    chosen = cutoffs.groupBy(F.col("stratum").alias("_stratum")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "level"))).alias("_cut"))
    both = join_small(statistics, cut(chosen, "cutoffs"), F.col("stratum") == F.col("_stratum"), "left")
    failed = F.filter(first_reached(), lambda r: F.coalesce(r["level"] <= F.col("_cut")[r["rule"]], F.lit(False)))
    return both.withColumn("failed", F.transform(failed, lambda r: r["rule"])).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop("_stratum", "_cut")


def quality_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The statistics and the verdict of every document; options as for :func:`fit_cutoffs`."""
    statistics = cut(text_statistics(docs), "rule-statistics")
    return apply_cutoffs(statistics, fit_cutoffs(statistics, labels, **options))
