"""Quality rules with thresholds that come from the data: for each language and source, mergeable quantile sketches
(Spark's Greenwald-Khanna summaries) of every ratio give fences, and a join filters each document by its group's.

A ratio's fence lies FENCE spreads beyond what is usual in its group, and nothing in it is a fixed cutoff:

* Ratios that are 0 in ordinary text (symbols, repeated lines, repeated words) spread from their median to the quantile LEVEL,
  which leaves an eighth of a group to be junk before the fence moves; the mean length of words spreads between quartiles.
* To a spread belongs what a single event makes of the group's typical text: one symbol in as many words as its median text
  has, one line in as many lines, four words said twice; for the mean length, its error in that many words. So where
  nobody uses symbols the fence is tight for long texts and wide for short ones, and where many do it is theirs.

A group's quantiles are shrunk towards its language's, by n / (n + SHRINK) of its n documents, and these towards those of
all documents: the less a group has to say, the more it takes from the others, by one rule at every size. Sketches are
built from documents that pass the fixed base rules.

Edge cases: null text counts as empty and fails the base rules; null language or source is a group of its own;
repeated rows are judged each, and count each; a value equal to its fence passes; an empty table gives an empty result; a
text of any length is read whole; further columns are dropped, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .words import SPACE, all_grams, words

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Documents whose weight the larger group's quartiles have in a smaller one's.
SHRINK = 100.0
FENCE = 6.0
ACCURACY = 2000
LEVEL = 0.875
#: Each ratio with the quantiles between which it spreads.
RATIOS = {"symbol_ratio": (0.5, LEVEL), "dup_line_ratio": (0.5, LEVEL), "repeat_ratio": (0.5, LEVEL), "mean_word": (0.25, 0.75)}
#: Words that are repeated where four of them are said twice.
SAID_TWICE = 8
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long"


def _lines(raw: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier one, and all lines with a word. bytes.split() knows the same white space as WORD."""
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    return len(lines) - len(set(lines)), len(lines)


def measures(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep, and the counts of _BASE for every whole text."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", " + _BASE
    names = [*keep, *(x.split()[0] for x in _BASE.split(", "))]

    def count(batch: pa.RecordBatch) -> list[np.ndarray]:
        w = words(batch.column(text_col))
        n = np.diff(w.first)
        total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[w.offsets])
        chars = total(~SPACE[w.buf] & ((w.buf & 0xC0) != 0x80))
        symbols = total(_SYMBOLS[w.buf])
        raw = w.buf.tobytes()
        dup, lines = np.array([_lines(raw[a:b]) for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True)], np.int64).T
        three, at = all_grams(w, 3)
        repeat = np.zeros(len(n), np.int64)
        for i in np.flatnonzero(n > 3):
            g = three[at[i] : at[i + 1]]
            order = np.argsort(g, kind="stable")
            same = g[order][1:] == g[order][:-1]
            if same.any():
                twice = np.zeros(len(g), bool)
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
                hit = np.zeros(n[i], bool)
                for j in range(3):
                    hit[j : j + len(g)] |= twice
                repeat[i] = hit.sum()
        return [n, chars, symbols, dup, lines, repeat]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, text_col):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(np.asarray(x, np.int64)) for x in count(batch))], names)

    return common.pick(docs, *dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)


def with_ratios(counted: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return counted.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
            "symbol_ratio": F.col("n_symbols") / n,
            "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "repeat_ratio": F.col("n_repeat_words") / n,
            "mean_word": F.col("word_chars") / n,
        }
    )


def event_of(ratio: str, n_words: Column, n_lines: Column) -> Column:
    """What one event makes of a ratio in a text of so many words and lines."""
    words, lines = (F.greatest(x, F.lit(1)).cast("double") for x in (n_words, n_lines))
    return {"symbol_ratio": 1 / words, "dup_line_ratio": 1 / lines, "repeat_ratio": SAID_TWICE / words, "mean_word": 1 / F.sqrt(words)}[ratio]


def thresholds(rated: DataFrame) -> DataFrame:
    """lang, source and the fences. A task sends a sketch for each group, never the group's rows."""
    median = {c: F.percentile_approx(c, 0.5, ACCURACY) for c in ("n_words", "n_lines")}

    def sketched(*by: str) -> DataFrame:
        quantiles = [F.percentile_approx(c, list(levels), ACCURACY).alias(c) for c, levels in RATIOS.items()]
        g = rated.filter("not base_failed").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *quantiles, *(m.alias(c) for c, m in median.items()))
        own = (F.concat(F.col(c), F.array(event_of(c, F.col("n_words"), F.col("n_lines")))).alias(c) for c in RATIOS)
        return g.select(*by, "n", *own)  # of each ratio both quantiles and the event

    def shrunk(own: Column, up: Column) -> Column:
        return F.zip_with(own, up, lambda x, y: (F.col("n") * x + SHRINK * y) / (F.col("n") + SHRINK))

    whole = sketched().first()
    langs = sketched("lang").select(F.col("lang").alias("of"), *(shrunk(F.col(c), F.array(*map(F.lit, whole[c] or (0.0, 0.0, 1.0)))).alias(f"up_{c}") for c in RATIOS))
    groups = sketched("lang", "source")
    groups = groups.join(langs, groups["lang"].eqNullSafe(langs["of"])).select("lang", "source", *(shrunk(F.col(c), F.col(f"up_{c}")).alias(c) for c in RATIOS))
    beyond = {c: FENCE * (F.col(c)[1] - F.col(c)[0] + F.col(c)[2]) for c in RATIOS}
    return groups.select("lang", "source", *((F.col(c)[1] + beyond[c]).alias(f"max_{c}") for c in RATIOS), (F.col("mean_word")[0] - beyond["mean_word"]).alias("min_mean_word"))


def verdicts(rated: DataFrame, fences: DataFrame) -> DataFrame:
    """rated with `kept`: joined with the fences of its group, which exist for every document that passes the base rules."""
    f = fences.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), F.struct(*[c for c in fences.columns if c not in ("lang", "source")]).alias("at"))
    out = rated.join(f, rated["lang"].eqNullSafe(f["of_lang"]) & rated["source"].eqNullSafe(f["of_source"]), "left")
    sound = F.col("mean_word") >= F.col("at.min_mean_word")
    for c in RATIOS:
        sound = sound & (F.col(c) <= F.col(f"at.max_{c}"))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(sound, F.lit(True))).drop("of_lang", "of_source", "at")


def judge(docs: DataFrame) -> DataFrame:
    """Texts are read once: their counts go to a table in the shared folder, from which sketches and verdicts are made."""
    rated = with_ratios(common.materialize(measures(docs, ["doc_id", "lang", "source"])))
    return verdicts(rated, common.materialize(thresholds(rated)))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
