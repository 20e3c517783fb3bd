"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

One scan measures every text. Each measure's values are counted in the buckets of a quantile sketch
(2^BITS per octave, so a quantile is off by at most 1/128 of its value): a sketch is a set of (bucket, n)
rows, merging is adding, and language and corpus sketches are merged from the (language, source) ones.
Fixed cutoffs are replaced by fences: the median plus or minus ``reach`` times the distance from the
median to a quartile, as the sketches of the document's own language and source tell them. The quartiles
of a group of n documents weigh n^2 against prior^2 for those of its language, which weigh against those
of the corpus alike, so small groups lean on larger ones without a size at which the judge changes.
No constant of the measure's own scale takes part: where a group has no spread at all, the fence is what
the sketch can tell apart (a bucket). Since rates of short documents are coarse, a document is outside
only if it is more than ``spare`` symbols, lines, words or characters beyond what its size allows at the
fence. The fences are joined back to the documents.

Results for odd input: null, empty and blank texts have no words and fail the base rules; null
languages and sources are groups of their own; repeated rows are judged each by itself; an empty
table gives an empty result; the tables' other columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigweave.llm.shared import stash
from sigweave.llm.text import NOT_SPACE, grams, slices

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines", "n_stutter")
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_LEADS = (np.arange(256) & 0xC0) != 0x80
_UPPER = (np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A)

MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Sketched measure: (scale, count, size, reach, spare, is a high value bad, is a low value bad); its value is scale * count div size.
FENCES = {
    "word_length": (100, "word_chars", "n_words", 12, 50, True, True),
    "symbol_rate": (1000, "n_symbols", "n_words", 12, 1, True, False),
    "upper_rate": (1000, "n_upper", "word_chars", 12, 10, True, False),
    "dup_line_rate": (1000, "n_dup_lines", "n_lines", 12, 3, True, False),
    "stutter_rate": (1000, "n_stutter", "n_words", 12, 3, True, False),
}
#: The quartiles: up to a quarter of a group may be bad without moving its fence.
INNER, OUTER = 0.25, 0.75
#: A group of so many documents weighs as much as the next larger group.
PRIOR = 10
#: A sketch has 2^BITS buckets an octave.
BITS = 7


def _measure(batches):
    for batch in batches:
        out: list[list[np.ndarray]] = [[] for _ in MEASURES]
        for part in slices(batch.column(batch.schema.get_field_index("text"))):
            w = part.words(NOT_SPACE)
            sums = lambda flags, p=part: np.diff(np.concatenate(([0], np.cumsum(flags)))[p.offsets])
            inside = NOT_SPACE[part.data]
            word = w.hashes(lower=False)
            five = grams(word, WINDOW)
            again = np.zeros(len(word), np.int64)
            again[1:] = word[1:] == word[:-1]
            again[w.at[:-1][w.counts > 0]] = 0
            stutter = np.diff(np.concatenate(([0], np.cumsum(again)))[w.at])
            dup, repeat, lines = np.zeros(part.n, np.int64), np.zeros(part.n, np.int64), np.zeros(part.n, np.int64)
            for i in range(part.n):
                own = five[w.at[i] : max(w.at[i], w.at[i + 1] - WINDOW + 1)]
                ordered = np.sort(own)
                twice = ordered[1:][ordered[1:] == ordered[:-1]]
                if len(twice):
                    marks = np.zeros(w.counts[i], bool)
                    hit = np.flatnonzero(np.isin(own, twice))
                    for k in range(WINDOW):
                        marks[hit + k] = True
                    repeat[i] = marks.sum()
                full = [x for x in part.bytes_of(i).split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
                lines[i] = len(full)
                dup[i] = len(full) - len(set(full))
            for k, x in enumerate((w.counts, sums(inside & _LEADS[part.data]), sums(_SYMBOL[part.data]), dup, repeat, sums(_UPPER[part.data]), lines, stutter)):
                out[k].append(x)
        arrays = [pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()) for x in out]
        kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
        yield pa.RecordBatch.from_arrays(kept + arrays, names=[n for n in batch.schema.names if n != "text"] + list(MEASURES))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text), lang, source, and the measures, in one scan and without a shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    schema = "doc_id long, text_key long, lang string, source string, " + ", ".join(f"{m} long" for m in MEASURES)
    return rows.mapInArrow(_measure, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def bucket(value: str, bits: int = BITS) -> Column:
    """The sketch bucket of a non-negative whole number: itself in the first octaves (under 256 with 128 buckets), then 2^bits buckets an octave."""
    n, octave = 1 << bits, f"(length(bin({value})) - {bits + 1})"
    return F.expr(f"CASE WHEN {value} < {2 * n} THEN {value} ELSE {n} * {octave} + ({value} div shiftleft(1L, {octave})) END")


def bucket_value(at: str, bits: int = BITS) -> Column:
    """The smallest number of a bucket."""
    n = 1 << bits
    return F.expr(f"CASE WHEN {at} < {2 * n} THEN {at} ELSE ({n} + {at} % {n}) * shiftleft(1L, cast({at} div {n} - 1 as int)) END")


def sketch(rows: DataFrame, keys: list[str], values: dict[str, str], bits: int = BITS) -> DataFrame:
    """Mergeable sketches: (keys, measure, bucket, n)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.expr(x).alias("value")) for m, x in values.items()]))
    return rows.select(*keys, pairs.alias("p")).select(*keys, "p.measure", bucket("p.value", bits).alias("bucket")).groupBy(*keys, "measure", "bucket").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], at: dict[str, Column]) -> DataFrame:
    """(keys, measure, rows, one column for each quantile): the smallest bucket that reaches the share of rows."""
    group = [*keys, "measure"]
    running = Window.partitionBy(*group).orderBy("bucket")
    both = sketches.withColumn("run", F.sum("n").over(running)).withColumn("rows", F.sum("n").over(Window.partitionBy(*group)))
    return both.groupBy(*group).agg(F.max("rows").alias("rows"), *[F.min(F.when(F.col("run") >= F.col("rows") * share, F.col("bucket"))).alias(name) for name, share in at.items()])


def blended(measured: DataFrame, prior: float) -> DataFrame:
    """(lang, source, measure, mid, mid_end, low, high_end): median and quartiles of a language and source, weighed against those of its language and of the corpus.

    A bucket stands for the numbers from its smallest up to the next bucket's: distances are taken between the outer ends."""
    values = {m: f"{scale} * {count} div {size}" for m, (scale, count, size, *_) in FENCES.items()}
    own = stash(sketch(measured.where(~base_failed() & (F.col("n_lines") > 0) & (F.col("word_chars") > 0)), ["lang", "source"], values), "sketches")
    shares = {"q_mid": F.lit(0.5), "q_low": F.lit(INNER), "q_high": F.lit(OUTER)}
    levels = [quantiles(own, ["lang", "source"], shares), quantiles(merge(own, ["lang"]), ["lang"], shares), quantiles(merge(own, []), [], shares)]
    ends = {"mid": bucket_value("q_mid"), "mid_end": bucket_value("(q_mid + 1)") - 1, "low": bucket_value("q_low"), "high_end": bucket_value("(q_high + 1)") - 1}
    cells = own.select("lang", "source", "measure").distinct()
    for k, (keys, level) in enumerate(zip((["lang", "source"], ["lang"], []), levels, strict=True)):
        named = level.select(*[F.col(c).alias(f"{c}_{k}") for c in [*keys, "measure"]], (F.col("rows").cast("double") * F.col("rows").cast("double")).alias(f"weight_{k}"), *[x.cast("double").alias(f"{c}_{k}") for c, x in ends.items()])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_{k}")) for c in [*keys, "measure"]])
        cells = cells.join(named, same, "left")
    other = F.lit(float(prior) ** 2)
    lean = lambda k, c, on: (F.col(f"weight_{k}") * F.col(f"{c}_{k}") + other * on) / (F.col(f"weight_{k}") + other)
    return cells.select("lang", "source", "measure", *[lean(0, c, lean(1, c, F.col(f"{c}_2"))).alias(c) for c in ends])


def _setting(i: int) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for m, f in FENCES.items() for x in (m, f[i])]), F.col("measure"))


def fences(measured: DataFrame, prior: float = PRIOR) -> DataFrame:
    """For each language and source, the low and high fence of every measure."""
    cells = blended(measured, prior)
    least = F.col("mid") / (1 << BITS) + 1
    high = F.col("mid") + F.greatest(_setting(3) * (F.col("high_end") - F.col("mid")), least)
    low = F.col("mid") - F.greatest(_setting(3) * (F.col("mid_end") - F.col("low")), least)
    limits = cells.select("lang", "source", "measure", F.when(_setting(6), low).alias("low"), F.when(_setting(5), high).alias("high"))
    return limits.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}") for m in FENCES for side in ("low", "high")])


def judge(docs: DataFrame, prior: float = PRIOR) -> DataFrame:
    """The measures of every document row with base_failed, kept, and failed (the measures outside their fences)."""
    measured = stash(measure(docs), "measures")
    limits = fences(measured, prior).withColumnsRenamed({"lang": "limit_lang", "source": "limit_source"})
    same = F.col("lang").eqNullSafe(F.col("limit_lang")) & F.col("source").eqNullSafe(F.col("limit_source"))
    both = measured.join(limits, same, "left").withColumn("base_failed", base_failed())
    outside = []
    for m, (scale, count, size, _, spare, *_) in FENCES.items():
        here = F.expr(f"CASE WHEN n_words > 0 AND n_lines > 0 AND word_chars > 0 THEN {scale} * {count} END")
        outside.append(F.when((here - scale * spare > F.col(f"{m}_high") * F.col(size)) | (here + scale * spare < F.col(f"{m}_low") * F.col(size)), F.lit(m)))
    both = both.withColumn("failed", F.array_compact(F.array(*outside)))
    return both.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).select("doc_id", "text_key", "lang", "source", *MEASURES, "base_failed", "kept", "failed")
