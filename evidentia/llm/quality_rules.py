"""Quality rules: thresholds per language and source from mergeable quantile sketches, then joined filtering."""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evidentia.llm.common import map_arrow, small_enough, stored

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Bins of a sketch grow by this factor, so a quantile is right within 2 %.
GROWTH = 1.02
#: Ratios that the sketches hold: name, numerator, denominator, and the least count that a rule on it may reject.
RATIOS = (("symbols", "n_symbols", "word_chars", 5), ("dup_lines", "n_dup_lines", "n_words", 2), ("repeats", "n_repeat_words", "n_words", 12), ("word_length", "word_chars", "n_words", 0))
#: The bin of ratios of 0, which most texts of most groups have.
ZERO = -100_000
#: A group's limits: name, ratio, quantile of the group, and the factor on it.  max_ limits are upper, min_ lower ones.
#: Quantiles lie below the tail that is judged, so some junk in a group does not lift its limit.
LIMITS = (("max_symbols", "symbols", 0.75, 4.0), ("max_dup_lines", "dup_lines", 0.75, 16.0), ("max_repeats", "repeats", 0.75, 8.0), ("max_word_length", "word_length", 0.9, 1.3), ("min_word_length", "word_length", 0.1, 1 / 1.3))
#: A group's mean ratio counts as if so many texts of the whole table were in the group.
SHRINK = 100
#: Up to so many groups, thresholds are broadcast (about 100 bytes each).
BROADCAST_GROUPS = 100_000


def _measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: splits at the ASCII white space of the contract alone
    n = len(words)
    lengths = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats = 0
    if n > 3:
        grams = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(grams)) < len(grams):
            seen, again = set(), set()
            for g in grams:
                (again if g in seen else seen).add(g)
            end = 0
            for i, g in enumerate(grams):
                if g in again:
                    repeats += i + 3 - max(i, end)
                    end = i + 3
    return n, lengths, symbols, len(lines) - len(set(lines)), repeats, len(lines)


def measure(documents: DataFrame) -> DataFrame:
    """The base counts of each whole text, beside doc_id, lang and source.  A null text has no words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(map(_measure, batch.column("text").to_pylist()))
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(6)]
        keys = [batch.column(c) for c in ("doc_id", "lang", "source")]
        return pa.RecordBatch.from_arrays([*keys, *columns], ["doc_id", "lang", "source", *COUNTS, "n_lines"])

    kept = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")))
    return map_arrow(kept, run, "doc_id bigint, lang string, source string, " + ", ".join(f"{c} bigint" for c in (*COUNTS, "n_lines")))


def _ratio(top: str, bottom: str) -> Column:
    """Of a text without words 0."""
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, ratio, bin, n: a log-binned quantile sketch per group, zeros apart.  Adding up n merges two sketches."""
    place = lambda x: F.when(x > 0, F.ceil(F.log(x) / math.log(GROWTH)).cast("int")).otherwise(ZERO)
    bins = F.array(*(F.struct(F.lit(name).alias("ratio"), place(_ratio(a, b)).alias("bin")) for name, a, b, _ in RATIOS))
    return measured.select("lang", "source", F.explode(bins).alias("x")).groupBy("lang", "source", "x.ratio", "x.bin").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame, limits: tuple = LIMITS) -> DataFrame:
    """lang, source and each limit, from the sketches alone.  A sketch has some hundred bins, whatever its group's size.

    The limit on a count is a factor on the group's quantile or on its mean ratio, whichever is more: where most texts
    have none, the quantile is 0, and what the group's texts have on average takes its place.  A small group's mean
    leans on that of the whole table.  Limits on word length are factors on quantiles.
    """
    group = W.partitionBy("lang", "source", "ratio")
    value = F.when(F.col("bin") == ZERO, F.lit(0.0)).otherwise(F.pow(F.lit(GROWTH), F.col("bin")))
    sketch = sketch.withColumn("value", value)
    table = sketch.groupBy("ratio").agg((F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("table_mean"))
    ranked = sketch.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("of", F.sum("n").over(group)).withColumn("total", F.sum(F.col("n") * F.col("value")).over(group))
    ranked = ranked.join(F.broadcast(table), "ratio").withColumn("mean", (F.col("total") + SHRINK * F.col("table_mean")) / (F.col("of") + SHRINK))  # a row a ratio

    def limit(ratio: str, quantile: float) -> Column:
        edge = F.min(F.when((F.col("ratio") == ratio) & (F.col("upto") >= F.col("of") * quantile), F.col("value")))
        return edge if ratio == "word_length" else F.greatest(edge, F.max(F.when(F.col("ratio") == ratio, F.col("mean"))))

    return ranked.groupBy("lang", "source").agg(*((limit(ratio, quantile) * factor).alias(name) for name, ratio, quantile, factor in limits))


def quality_rules(documents: DataFrame, limits: tuple = LIMITS, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Base counts, base_failed and kept for each document, and the limits of its language and source.

    Null languages and sources form groups of their own; repeated rows count and stay; an empty table gives none.
    A text with fewer than ``min_words`` words, or mostly repeated three-word windows, fails whatever its group is.
    All other verdicts come from the group's sketches: no limit on a ratio is fixed.  A count below its least evidence
    (RATIOS), zero above all, never rejects a text, however short it is beside the others of its group.
    """
    measured = stored(measure(documents), "quality")
    names = [name for name, *_ in limits]
    found = stored(thresholds(sketches(measured), limits).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *names), "limits")
    if small_enough(found, BROADCAST_GROUPS):
        found = F.broadcast(found)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    ratio = {name: (_ratio(a, b), F.col(a) < least) for name, a, b, least in RATIOS}
    passes = reduce(lambda x, y: x & y, (ratio[r][1] | (ratio[r][0] <= F.col(name) if name.startswith("max_") else ratio[r][0] >= F.col(name)) for name, r, _, _ in limits))
    joined = measured.join(found, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    return joined.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & F.coalesce(passes, F.lit(True))).alias("kept"), *names)
