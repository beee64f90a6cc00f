"""Toxicity by class-conditional Kneser-Ney models over letters (operator 4).

Each class has an interpolated Kneser-Ney model of order 5 over the letters of its words. A word
weighs as much as the number of different words it follows in that class, so copies of a text add
nothing. Only the highest order has counts by class; what it leaves over goes to one distribution
that both classes share (continuation counts of shorter letter strings). Where two models share
all that is below, the ratio of their probabilities needs the highest order alone:

* a string that neither class has often enough: log of the ratio of the left-over shares;
* else the log ratio of the two interpolated probabilities, for which the shared part is needed.

So what tasks need is a table of the strings that speak for a class, and one of contexts.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.llm.common import held, lean, stored

ORDER = 5
BEGIN, END = "\x02", "\x03"
DISCOUNT = 3.0  # a string must follow more than so many different words to speak for a class
SHARED_DISCOUNT = 0.75
PASSAGE = 3  # words in a passage
EDGES = ".,;:!?\"'()[]{}<>*_~|&%$#@+=-/\\`^"


def folds(key: str) -> F.Column:
    """CRC-32 of the key's text, modulo 3; 1 is held out."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3


def _core(piece: str) -> str:
    return piece.strip(EDGES)


def _words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def labelled(df: DataFrame, labels: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """``fold, toxic, text`` of labelled rows outside the held-out fold; about ``most`` rows at most.

    Beyond ``most`` labelled keys, those of least hash are taken. The labels' side is bounded by
    ``most`` and broadcast, so texts are not shuffled. A key labelled twice is toxic if one label is.
    """
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_of")).agg(
        F.max("toxic").cast("int").alias("toxic"))
    marks = stored(marks.withColumn("fold", folds("_of")).where("fold <> 1"), "marks")
    total = marks.count()
    if total > most:
        share = int(most / total * 1_000_000)
        marks = marks.where(F.pmod(F.xxhash64("_of"), F.lit(1_000_000)) < share)
    return df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text")).join(
        F.broadcast(marks), F.col("_key") == F.col("_of")).select("fold", "toxic", "text")


def _followed(batches, most: int = 250_000):
    """``word, before, toxic``: the words of the texts and a hash of the word before each, with few repeats."""
    import xxhash

    digest = xxhash.xxh64_intdigest

    def batch_of(seen):
        word, before, toxic = zip(*seen) if seen else ((), (), ())
        return pa.record_batch({
            "word": pa.array(word, pa.string()), "before": pa.array(before, pa.int64()),
            "toxic": pa.array(toxic, pa.int32())})

    held("words", dict)  # lets go of what other steps kept in this worker
    for batch in lean(batches):
        seen = set()
        cores: dict[str, tuple[str, int]] = {}
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text")):
            before = 0
            for piece in _words(text.as_py()):
                core = cores.get(piece)
                if core is None:
                    word = _core(piece)
                    core = cores[piece] = (word, digest(word) - (1 << 63))
                if core[0]:
                    seen.add((core[0], before, toxic))
                    before = core[1]
            if len(seen) >= most or len(cores) >= most:
                yield batch_of(seen)
                seen.clear()
                cores.clear()
        yield batch_of(seen)


@dataclass(frozen=True)
class Model:
    """Log ratios toxic to ordinary by letter string (of ORDER letters) and by context (one less)."""

    grams: object  # sorted hashes
    gram_ratios: object
    contexts: object
    context_ratios: object

    def ratios(self, words: list[str]):
        """The log ratio of each word, summed over its letters and its end."""
        import numpy as np

        if not words:
            return np.empty(0)
        padded = [BEGIN * (ORDER - 1) + w + END for w in words]
        letters = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.fromiter(map(len, padded), np.int64, len(padded))
        ends = np.cumsum(sizes)
        at = np.arange(len(letters))
        keep = (at - np.repeat(ends - sizes, sizes)) >= ORDER - 1  # the last letter of a string
        last = at[keep]
        context = _hashed([letters[last - n] for n in range(ORDER - 1, 0, -1)])
        gram = _hashed_on(context, letters[last])
        known, ratio = _found(self.grams, self.gram_ratios, gram)
        other, left = _found(self.contexts, self.context_ratios, context)
        value = np.where(known, ratio, np.where(other, left, 0.0))
        sums = np.concatenate([[0.0], np.cumsum(value)])
        marks = np.cumsum(sizes - (ORDER - 1))
        return sums[marks] - sums[marks - (sizes - (ORDER - 1))]


def _hashed_on(h, letter):
    import numpy as np

    h = (h ^ letter.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _hashed(columns):
    import numpy as np

    h = np.full(len(columns[0]), 1469598103934665603, np.uint64)
    for c in columns:
        h = _hashed_on(h, c)
    return h


def _found(keys, values, wanted):
    import numpy as np

    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, values[at]


def _counted(train: DataFrame) -> DataFrame:
    """``gram, t, o``: letter strings of ORDER letters, with their counts by class."""
    words = train.mapInArrow(lambda batches: _followed(batches), "word string, before long, toxic int").distinct().groupBy("word").agg(
        F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("o"))
    padded = F.concat(F.lit(BEGIN * (ORDER - 1)), "word", F.lit(END))
    return words.select("t", "o", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("word") + 1), lambda n: F.substring(padded, n, F.lit(ORDER)))).alias("gram"),
    ).groupBy("gram").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def _shared(grams: DataFrame) -> DataFrame:
    """``tail, p``: the shared Kneser-Ney probability of a string's last letter after the letters before it,
    for all tails (strings without their first letter), from continuation counts."""
    levels, level = [], grams.select(F.substring("gram", 2, ORDER).alias("tail")).groupBy("tail").agg(
        F.count("*").alias("n"))
    for size in range(ORDER - 1, 0, -1):
        levels.append(level)
        if size > 1:  # how many different letters stand before the shorter string
            level = level.select(F.substring("tail", 2, ORDER).alias("tail")).groupBy("tail").agg(F.count("*").alias("n"))
    total = levels[-1].agg(F.sum("n")).first()[0] or 1  # over single letters
    below = levels[-1].select("tail", (F.col("n") / total).alias("p"))
    for level in reversed(levels[:-1]):
        size = F.length("tail")
        level = level.withColumn("context", F.expr("substring(tail, 1, length(tail) - 1)"))
        totals = level.groupBy("context").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
        lower = below.select(F.col("tail").alias("short"), F.col("p").alias("p_short"))
        below = (
            level.join(totals, "context").withColumn("short", F.substring("tail", F.lit(2), size))
            .join(lower, "short").select("tail", (
                (F.greatest(F.col("n") - SHARED_DISCOUNT, F.lit(0.0)) + SHARED_DISCOUNT * F.col("kinds") * F.col("p_short"))
                / F.col("all")).alias("p"))
        )
    return below


def fit_model(train: DataFrame) -> Model:
    """The two classes' models from ``train(toxic, text)``; what speaks for no class is not kept.

    Counting, sharing and joining are Spark jobs; the driver gets the strings that more than
    DISCOUNT different words precede in a class, a number that the bounded sample bounds.
    """
    import numpy as np

    grams = stored(_counted(train), "letter-strings").withColumn(
        "context", F.substring("gram", 1, ORDER - 1)).withColumn("tail", F.substring("gram", 2, ORDER))
    contexts = stored(grams.groupBy("context").agg(*[
        agg for c in "to" for agg in (
            F.sum(c).alias(f"{c}_all"), F.sum(F.least(F.col(c).cast("double"), F.lit(DISCOUNT))).alias(f"{c}_left"))
    ]).select("context", *[
        x for c in "to" for x in (
            F.col(f"{c}_all"), F.when(F.col(f"{c}_all") > 0, F.col(f"{c}_left") / F.col(f"{c}_all")).otherwise(1.0)
            .alias(f"{c}_share"))
    ]).where("t_share < 1 OR o_share < 1"), "contexts")
    speaking = grams.where((F.col("t") > DISCOUNT) | (F.col("o") > DISCOUNT))
    shared = _shared(grams)

    def part(c: str):
        own = F.when(F.col(f"{c}_all") > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"{c}_all")).otherwise(0.0)
        return own + F.col(f"{c}_share") * F.col("p")

    ratios = speaking.join(shared, "tail").join(contexts, "context").select(
        "gram", F.log(part("t") / part("o")).alias("ratio"))
    found = ratios.toArrow()
    left = contexts.select("context", F.log(F.col("t_share") / F.col("o_share")).alias("ratio")).toArrow()

    def table(strings, values, size):
        strings = strings.to_pylist()
        letters = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, size)
        keys = _hashed([letters[:, n] for n in range(size)]) if len(letters) else np.empty(0, np.uint64)
        order = np.argsort(keys)
        return keys[order], np.asarray(values, np.float32)[order]

    return Model(
        *table(found.column("gram"), found.column("ratio"), ORDER),
        *table(left.column("context"), left.column("ratio"), ORDER - 1))


class _Ratios(dict):
    def __init__(self, model: Model, most: int = 300_000):
        super().__init__()
        self.model, self.most = model, most

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self]
        if len(self) + len(new) > self.most:
            self.clear()
            new = list(pieces)
        self.update(zip(new, self.model.ratios([_core(p) for p in new]).tolist()))


def _measured(texts, ratios: _Ratios, most_letters: int = 2_000_000):
    """Per text: the greatest length-normalised log ratio of a passage, and that of the whole text.

    Texts are split and looked up some at a time, by their letters, to bound memory.
    """
    import numpy as np

    best, whole = np.zeros(len(texts)), np.zeros(len(texts))

    def settle(held):
        ratios.learn({w for _, words in held for w in words})
        for n, words in held:
            sums = np.concatenate([[0.0], np.cumsum(np.fromiter(map(ratios.__getitem__, words), float, len(words)))])
            span = min(PASSAGE, len(words))
            best[n] = (sums[span:] - sums[:-span]).max() / PASSAGE
            whole[n] = sums[-1] / len(words)

    held, letters = [], 0
    for n, text in enumerate(texts):
        words = _words(text.as_py())
        if words:
            held.append((n, words))
            letters += sum(map(len, words))
        if letters >= most_letters:
            settle(held)
            held, letters = [], 0
    settle(held)
    return best, whole


def measure(df: DataFrame, text: str, model) -> DataFrame:
    """``df`` with ``passage`` and ``whole``; ``model``: a broadcast Model. Texts without words have 0 and 0."""
    number = uuid.uuid4().hex
    kinds = [(f.name, f.dataType.simpleString()) for f in df.schema if f.name not in ("passage", "whole")]
    names = [n for n, _ in kinds]

    def run(batches):
        ratios = _kept_ratios(number, model)
        for batch in lean(batches):
            best, whole = _measured(batch.column(text), ratios)
            yield pa.record_batch(
                [*[batch.column(n) for n in names], pa.array(best), pa.array(whole)], names=[*names, "passage", "whole"])

    schema = ", ".join(f"`{n}` {k}" for n, k in kinds) + ", passage double, whole double"
    return df.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema)


def _kept_ratios(number: str, model) -> _Ratios:
    """The worker's cache for a model."""
    return held(("ratios", number), lambda: _Ratios(model.value))


@dataclass(frozen=True)
class Calibration:
    """Logistic curve over the two measures."""

    bias: float
    passage: float
    whole: float

    def column(self):
        z = self.bias + self.passage * F.col("passage") + self.whole * F.col("whole")
        return 1 / (1 + F.exp(-z))


def calibrate(measured: DataFrame, ridge: float = 1e-3) -> Calibration:
    """Ridge-penalised logistic regression on ``measured(passage, whole, toxic)``, by Newton's steps.

    Each step is one aggregate of fixed size over all calibration rows. One class only, or no rows:
    a constant curve at that class's share.
    """
    import numpy as np

    rows = stored(measured.select("passage", "whole", F.col("toxic").cast("double").alias("y")), "calibration")
    x = [F.lit(1.0), F.col("passage"), F.col("whole")]
    n, positive = rows.agg(F.count("*"), F.sum("y")).first()
    if not n or positive in (0, n):
        return Calibration(math.log((0.5 + (positive or 0)) / (0.5 + n - (positive or 0))), 0.0, 0.0)
    beta = np.zeros(3)
    for _ in range(25):
        z = sum((float(b) * c for b, c in zip(beta, x)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        got = rows.agg(
            *[F.sum((F.col("y") - p) * c) for c in x],
            *[F.sum(p * (1 - p) * x[a] * x[b]) for a in range(3) for b in range(a, 3)]).first()
        slope, curve, at = np.array(got[:3]), np.zeros((3, 3)), 3
        for a in range(3):
            for b in range(a, 3):
                curve[a, b] = curve[b, a] = got[at]
                at += 1
        penalty = ridge * n * np.diag([1e-6, 1e-2, 1e-2])
        step = np.linalg.solve(curve + penalty + 1e-9 * np.eye(3), slope - penalty @ beta)
        step *= min(1.0, 8.0 / max(1e-12, np.abs(step).max()))
        beta = beta + step
        if np.abs(step).max() < 1e-4:
            break
    return Calibration(*map(float, beta))


def score_toxicity(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most_labelled: int = 200_000,
    threshold: float = 0.7,
) -> DataFrame:
    """``df`` with ``score`` (0 to 1) and ``predicted`` (1 if ``score >= threshold``).

    ``labels(doc_id, toxic)``. Keys whose CRC-32 is 1 modulo 3 teach nothing; of the others, those
    of remainder 0 fit the letter models and those of remainder 2 the curve, ``most_labelled`` rows
    in all at most (a documented bound of the sample; scoring covers every row and whole texts).

    Null and empty texts have no evidence and the curve's value at 0. Without labels of both classes
    the score is constant. Columns named ``passage``, ``whole``, ``score`` or ``predicted`` are replaced.
    """
    spark = df.sparkSession
    df = df.drop("score", "predicted")
    taught = labelled(df, labels, key, text, most_labelled)
    model = spark.sparkContext.broadcast(fit_model(taught.where("fold = 0").select("toxic", "text")))
    curve = calibrate(measure(taught.where("fold = 2").select("toxic", "text"), "text", model))
    scored = measure(df, text, model).withColumn("score", curve.column())
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop("passage", "whole")
