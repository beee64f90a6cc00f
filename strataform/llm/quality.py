"""Learned decision lists over text statistics (operator 2)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.llm.common import stored

_SPACE = r"\t\n\u000B\u000C\r "  # inside a SQL string, also as a regular expression's class
_SYMBOLS = "#*$%&|<>"
WINDOW = 5


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``stats`` (replaced if there): a struct of whole numbers about each whole text.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols`` (of ``#*$%&|<>``),
    ``n_dup_lines`` (lines with a word that equal an earlier line), ``n_repeat_words`` (words in
    windows of five that the text holds twice or more, the first included), and for the rules
    ``n_chars``, ``n_lines``, ``n_upper``, ``n_digits``, ``n_punct``, ``n_distinct`` (words).

    All is computed inside one row; nothing is exploded or shuffled. Windows are hashed first, and
    compared as text only where two hashes agree. A null text has no words and zeros.
    """
    raw = f"coalesce(cast(`{text}` AS STRING), '')"
    windows = f"transform(sequence(1, size(w) - {WINDOW - 1}), i -> xxhash64(slice(w, i, {WINDOW})))"
    exact = _let(
        f"array_sort(transform(sequence(1, size(w) - {WINDOW - 1}), "
        f"i -> struct(concat_ws(' ', slice(w, i, {WINDOW})) AS g, i AS p)))", "s",
        "aggregate(array_sort(transform(filter(transform(s, (x, n) -> struct(x.p AS p, "
        "(n > 0 AND get(s, n - 1).g = x.g) OR (n + 1 < size(s) AND get(s, n + 1).g = x.g) AS twice)), "
        "x -> x.twice), x -> x.p)), struct(0L AS n, -1000 AS last), "
        f"(a, p) -> struct(a.n + least({WINDOW}, p - a.last) AS n, p AS last), a -> a.n)")
    repeated = _let(windows, "h", f"CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE {exact} END")
    lines = f"filter(split(t, '\\n', -1), l -> l rlike '[^{_SPACE}]')"
    fields = ", ".join((
        "cast(size(w) AS BIGINT) AS n_words",
        "cast(length(bare) AS BIGINT) AS word_chars",
        f"cast(length(bare) - length(translate(bare, '{_SYMBOLS}', '')) AS BIGINT) AS n_symbols",
        f"cast({_let(lines, 'k', 'size(k) - size(array_distinct(k))')} AS BIGINT) AS n_dup_lines",
        f"CASE WHEN size(w) <= {WINDOW} THEN 0L ELSE {repeated} END AS n_repeat_words",
        "cast(length(t) AS BIGINT) AS n_chars",
        "cast(length(t) - length(replace(t, '\\n', '')) + 1 AS BIGINT) AS n_lines",
        "cast(length(bare) - length(translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS BIGINT) AS n_upper",
        "cast(length(bare) - length(translate(bare, '0123456789', '')) AS BIGINT) AS n_digits",
        "cast(length(bare) - length(translate(bare, '.,;:!?\"()-', '')) AS BIGINT) AS n_punct",
        "cast(size(array_distinct(w)) AS BIGINT) AS n_distinct",
    ))
    words = f"filter(split(t, '[{_SPACE}]+', -1), x -> x <> '')"
    body = _let(f"translate(t, '{_SPACE}', '')", "bare", f"struct({fields})")
    return df.withColumn("stats", F.expr(_let(raw, "t", _let(words, "w", body))))


#: What the rules may ask about: shares and lengths, from the statistics alone.
FEATURES = {
    "words": "stats.n_words",
    "mean_word": "stats.word_chars / stats.n_words",
    "symbols_per_word": "stats.n_symbols / stats.n_words",
    "dup_lines_per_line": "stats.n_dup_lines / stats.n_lines",
    "repeat_share": "stats.n_repeat_words / stats.n_words",
    "words_per_line": "stats.n_words / stats.n_lines",
    "upper_share": "stats.n_upper / stats.word_chars",
    "digit_share": "stats.n_digits / stats.word_chars",
    "punct_per_word": "stats.n_punct / stats.n_words",
    "distinct_share": "stats.n_distinct / stats.n_words",
}


def features(df: DataFrame) -> DataFrame:
    """``df`` with one double column ``f_<name>`` per feature; 0 where a text has no words."""
    return df.withColumns({f"f_{n}": F.coalesce(F.expr(f"try_divide({e.split(' / ')[0]}, {e.split(' / ')[1]})")
                           if " / " in e else F.expr(e).cast("double"), F.lit(0.0)) for n, e in FEATURES.items()})


@dataclass(frozen=True)
class Condition:
    """``feature > threshold`` or, if not ``above``, ``feature <= threshold``."""

    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(f"f_{self.feature}")
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class Rule:
    """Rejects what meets all conditions."""

    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " AND ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.6g}" for c in self.conditions)


def _counts(rows: DataFrame, grid: dict[str, list[float]]) -> dict[str, list[tuple[int, int]]]:
    """Per feature and step of its grid: (bad, good) rows with a value up to that threshold and above the last."""
    got = rows.select("bad", F.posexplode("steps").alias("feature", "step")).groupBy("feature", "step").agg(
        F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")).collect()
    names = list(grid)
    out = {n: [(0, 0)] * (len(edges) + 1) for n, edges in grid.items()}
    for r in got:
        out[names[r["feature"]]][r["step"]] = (r["bad"], r["good"])
    return out


def _gain(bad: int, good: int, bad_before: int, good_before: int) -> float:
    """Bad rows kept, times what is learnt about each (in bits)."""
    from math import log2

    if bad == 0:
        return 0.0
    return bad * (log2(bad / (bad + good)) - log2(bad_before / (bad_before + good_before)))


def learn_decision_list(
    labelled: DataFrame, most_rules: int = 6, most_conditions: int = 3, steps: int = 48, least_rows: int = 5,
    precision: float = 0.98,
) -> list[Rule]:
    """An ordered list of rules that reject, by sequential covering over ``labelled(bad 0/1, f_*)``.

    Two thirds of the rows grow, one third prunes (by a hash of the features). A rule grows by the
    condition of greatest gain until it holds no good row; conditions are then dropped from its end
    while that does not lower its precision on the pruning rows. It is accepted if at least
    ``least_rows`` bad rows meet it and the precision on all remaining rows reaches ``precision``;
    the rows it covers are then set aside. Learning stops at the first rule that fails.

    Thresholds are ``steps`` quantiles of the bad rows and of all rows. Each condition costs one
    aggregate over the labelled statistics, which returns (features x steps) counts: the driver
    sees counts only, and all labelled rows are used. No rows, or one class only, give no rules.
    """
    rows = stored(labelled.select(
        F.col("bad").cast("long").alias("bad"), *[f"f_{n}" for n in FEATURES],
        (F.pmod(F.xxhash64(*[f"f_{n}" for n in FEATURES]), F.lit(3)) == 0).alias("prune"),
    ), "marked")
    shares = F.array(*[F.lit((n + 0.5) / steps) for n in range(steps)])
    quantiles = rows.agg(
        F.count("*").alias("n"), F.sum("bad").alias("bad"),
        *[F.percentile_approx(f"f_{n}", shares, F.lit(1000)).alias(f"all_{n}") for n in FEATURES],
        *[F.percentile_approx(F.when(F.col("bad") == 1, F.col(f"f_{n}")), shares, F.lit(1000)).alias(f"bad_{n}")
          for n in FEATURES],
    ).first()
    if not quantiles["bad"] or quantiles["bad"] == quantiles["n"]:
        return []
    grid = {n: sorted({*quantiles[f"all_{n}"], *(quantiles[f"bad_{n}"] or [])}) for n in FEATURES}
    def step(name: str) -> Column:  # the number of thresholds below the value
        return F.size(F.filter(F.array(*[F.lit(float(t)) for t in grid[name]]), lambda t: t < F.col(f"f_{name}")))

    rows = stored(rows.withColumn("steps", F.array(*map(step, grid))), "stepped")

    def total(df: DataFrame, conditions: tuple[Condition, ...]) -> list[tuple[int, int]]:
        """(bad, good) that meet the first k conditions, for every k from 1."""
        met, asked = F.lit(True), []
        for c in conditions:
            met = met & c.column()
            asked += [F.sum(F.when(met, F.col("bad")).otherwise(0)), F.sum(F.when(met, 1 - F.col("bad")).otherwise(0))]
        got = [x or 0 for x in df.agg(*asked).first()]
        return list(zip(got[::2], got[1::2]))

    found: list[Rule] = []
    left = rows
    for _ in range(most_rules):
        grow, conditions = left.where("NOT prune"), ()
        bad = good = None
        while len(conditions) < most_conditions:
            counts, best = _counts(grow, grid), (0.0, None, 0, 0)
            if bad is None:
                bad, good = map(sum, zip(*next(iter(counts.values()))))
            if not bad or not good:
                break
            for name, cells in counts.items():
                low_bad = low_good = 0
                for threshold, (b, g) in zip(grid[name], cells):
                    low_bad, low_good = low_bad + b, low_good + g
                    for above, kept_bad, kept_good in ((False, low_bad, low_good), (True, bad - low_bad, good - low_good)):
                        gain = _gain(kept_bad, kept_good, bad, good)
                        if gain > best[0] + 1e-9:
                            best = (gain, Condition(name, above, float(threshold)), kept_bad, kept_good)
            if best[1] is None:
                break
            conditions, bad, good = (*conditions, best[1]), best[2], best[3]
            grow = grow.where(best[1].column())
        if not conditions:
            break
        pruned = total(left.where("prune"), conditions)
        worth = [(b - g) / (b + g) if b + g else -1.0 for b, g in pruned]
        keep = max(range(len(worth)), key=lambda k: (worth[k], -k)) + 1
        rule = Rule(conditions[:keep])
        everything = total(left, rule.conditions)[-1]
        if everything[0] < least_rows or everything[0] < precision * sum(everything):
            rule = Rule(conditions)  # the whole rule may still be precise enough
            everything = total(left, rule.conditions)[-1]
        if everything[0] < least_rows or everything[0] < precision * sum(everything):
            break
        found.append(rule)
        left = left.where(~rule.column())
    return found


def decision(rules: list[Rule]) -> Column:
    """The number of the first rule that rejects (from 1), or null: one ordered conditional expression."""
    out = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.column(), F.lit(number)).otherwise(out)
    return out


def fit_quality(statistics: DataFrame, labels: DataFrame, key: str = "doc_id") -> list[Rule]:
    """Rules from ``statistics(key, stats)`` of all rows and ``labels(doc_id, quality)``; 0 is bad.

    Rows that fail the base check teach nothing. Null labels are left out; a key labelled twice
    counts as bad if one label is.
    """
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_of")).agg(
        (1 - F.min("quality")).alias("bad"))
    marked = statistics.select(key, "stats").join(marks, F.col(key) == F.col("_of")).where(~base_failed())
    return learn_decision_list(features(marked))


def base_failed() -> Column:
    """Under ten words, or over a fifth of the words in repeated windows."""
    return (F.col("stats.n_words") < 10) | (100 * F.col("stats.n_repeat_words") > 20 * F.col("stats.n_words"))


def judge_quality(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``df(stats, ..)`` with ``base_failed``, ``rule`` (number of the rejecting rule, or null) and ``kept``.

    Columns of ``df`` named like these results, or like features (``f_*``), are replaced.
    """
    own = [f"f_{n}" for n in FEATURES]
    df = df.drop("base_failed", "rule", "kept", *own)
    judged = features(df).withColumn("base_failed", base_failed()).withColumn("rule", decision(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).drop(*own)
