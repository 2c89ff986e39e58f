"""Language identification by fusing evidence in the manner of Bayes.

For each text: log likelihoods of its byte trigrams under a model of each language (damped, because neighbouring
trigrams aren't independent), the likelihood of the markup language that it declares, and a prior of its host. The priors
come from the whole input by grouped aggregation of soft counts: a host's counts are smoothed towards its domain's, these
towards its address suffix's, these towards all texts', each as a Dirichlet prior of strength STRENGTH; country suffixes
add counts for their languages. A text's own count is taken out of its host's before it is judged.

The trigram models are trained here on a bounded sample of labelled documents, TRAIN_TEXTS for each label, those of the
least hash of their doc_id. Every label is learnt; a model takes a quarter of a MB.

Rejected (kept = false): texts without a letter or any byte above ASCII, those whose best language has a posterior under
MIN_POSTERIOR, and those that don't fit their best language: whose mean log likelihood for each trigram is more than
MOST_MISFIT standard errors under what the language's own texts have (each trigram judged by the others of the sample),
and worse than all but OWN_MISFITS of these texts; their language is `und`. Texts that fit no language don't count for their hosts.

Edge cases: null text counts as empty and is rejected; null or unknown declared languages say nothing; a null address has
an empty host of its own; without any labelled document every text is `und`; repeated rows are judged each, and each
counts; an empty table gives an empty result; texts are read whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .html_text import extract
from .words import utf8

TRAIN_TEXTS = 1500
STRENGTH, SUFFIX_COUNT = 5.0, 20.0
MIN_POSTERIOR = 0.5
#: A text counts as this many independent trigrams at most.
MOST_TRIGRAMS = 60.0
#: Standard errors by which a text may be less likely than its language's own, and the least spread of a trigram's log likelihood.
MOST_MISFIT, LEAST_SPREAD = 5.0, 1.0
OWN_MISFITS = 0.001
#: Trigrams times languages that are looked up at once.
_BLOCK = 4 << 20
#: How often a declared language is the true one.
DECLARED_RIGHT = 0.9
_BITS = 16
#: Languages of country suffixes.
COUNTRY = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja"}

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[x for x in range(128) if not chr(x).isalpha()]] = 32
_LETTER = _FOLD != 32


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all byte trigrams with a letter in them, text by text, and where each text's begin. A text is read as if
    it had a space on either side; what isn't a letter reads as a space."""
    buf, at = utf8(column)
    n = len(buf) + 2 * (len(at) - 1)
    every = np.full(n, 32, np.uint32)
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    every[np.arange(len(buf)) + 2 * of + 1] = _FOLD[buf]
    begin = at + 2 * np.arange(len(at))
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    code = every[:-2] << np.uint32(16) | every[1:-1] << np.uint32(8) | every[2:]
    good = every[1:-1] != 32
    # a trigram across two texts has a space in its middle, and so has none
    place = np.flatnonzero(good)
    code = (code[place] * np.uint32(2654435769)) >> np.uint32(32 - _BITS)
    return code.astype(np.int64), np.searchsorted(place, begin)


@dataclass
class Model:
    """languages, the log probability of each trigram code in each of them (codes x languages), the mean and spread of
    these in each language's own texts, and the least fit that isn't rejected."""

    languages: list[str]
    table: np.ndarray
    usual: np.ndarray
    spread: np.ndarray
    least: np.ndarray | float = -MOST_MISFIT

    def evidence(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of trigrams of each text; its log likelihoods, damped (texts x languages; the best is 0); by how many
        standard errors it is likelier than each language's own texts."""
        code, begin = trigrams(column)
        n = np.diff(begin)
        total = np.zeros((len(n), len(self.languages)))
        if not self.languages:
            return n, total, total
        of, block = np.repeat(np.arange(len(n)), n), max(1, _BLOCK // len(self.languages))
        for a in range(0, len(code), block):
            some = of[a : a + block]
            first = np.flatnonzero(np.diff(some, prepend=-1))
            total[some[first]] += np.add.reduceat(self.table[code[a : a + block]], first, axis=0)
        fit = (total / np.maximum(n, 1)[:, None] - self.usual) / self.spread * np.sqrt(n / (1 + n / MOST_TRIGRAMS))[:, None]
        total /= (1 + n / MOST_TRIGRAMS)[:, None]
        return n, total - total.max(axis=1, keepdims=True), fit


def train(docs: DataFrame) -> Model:
    """docs: doc_id, text, lang. Labels are primary language subtags, in lower case."""
    label = F.lower(F.regexp_extract(docs["lang"], "^[A-Za-z]{2,3}", 0))
    known = docs.select("doc_id", "text", label.alias("label")).filter("label <> ''")
    names = sorted(r.label for r in known.select("label").distinct().collect())
    place = {name: i for i, name in enumerate(names)}
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = known.select("label", "doc_id").distinct().withColumn("r", F.row_number().over(order)).filter(F.col("r") <= TRAIN_TEXTS).drop("r")
    sample = known.join(F.broadcast(ids), ["label", "doc_id"], "left_semi")  # at most TRAIN_TEXTS ids of each label

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "text"):
            code, begin = trigrams(batch.column("text"))
            text = np.repeat(np.array([place[x] for x in batch.column("label").to_pylist()], np.int64), np.diff(begin))
            at, n = np.unique(text << _BITS | code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.astype(np.int64))], ["at", "n"])

    found = sample.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most the table's size
    at, n = found.column("at").to_numpy(), found.column("n").to_numpy()
    counts = np.full((len(names), 1 << _BITS), 0.1, np.float32)
    counts.reshape(-1)[at] += n
    total = counts.sum(axis=1, keepdims=True, dtype=np.float64)
    # how likely each trigram of the sample is by the others
    of, times = at >> _BITS, n.astype(float)
    value = np.log((times - 0.9) / np.maximum(total[of, 0] - 1, 1.0))
    size = np.maximum(np.bincount(of, times, len(names)), 1)
    usual = np.bincount(of, times * value, len(names)) / size
    spread = np.sqrt(np.maximum(np.bincount(of, times * value**2, len(names)) / size - usual**2, LEAST_SPREAD**2))
    np.log(counts, out=counts)
    counts -= np.log(total).astype(np.float32)
    model = Model(names, np.ascontiguousarray(counts.T), usual, spread)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "text"):
            fit = model.evidence(batch.column("text"))[2]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([fit[i, place[x]] for i, x in enumerate(batch.column("label").to_pylist())], pa.float64())], ["label", "fit"])

    lowest = dict(sample.mapInArrow(own, "label string, fit double").groupBy("label").agg(F.percentile_approx("fit", OWN_MISFITS, 10000)).collect())
    model.least = np.array([min(-MOST_MISFIT, lowest.get(name) or 0.0) for name in names])
    return model


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f names it, and whatever the optimizer puts together."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _normal(scores: Column) -> Column:
    """exp of an array of log scores, so that they sum up to 1."""
    parts = _with(scores, lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s))))
    return _with(parts, lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda t, y: t + y)))


def identify(records: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """records: keep, text, html (true where text is a page), declared, host. Returns keep, language, posterior, declared,
    host, kept. Texts are read once; their evidence goes to a table in the shared folder."""
    names = model.languages
    if not names:
        return records.select(*keep, F.lit("und").alias("language"), F.lit(0.0).alias("posterior"), "declared", "host", F.lit(False).alias("kept"))
    clean = records.select(
        *keep,
        "text",
        "html",
        F.lower(F.regexp_extract(F.coalesce("declared", F.lit("")), "^[A-Za-z]{2,3}", 0)).alias("declared"),
        F.lower(F.coalesce("host", F.lit(""))).alias("host"),
    )
    kinds = {f.name: f.dataType.simpleString() for f in clean.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keep, "declared", "host"]) + ", trigrams long, e array<double>, fits array<boolean>"

    place = {name: i for i, name in enumerate(names)}
    wrong = float(np.log(max((1 - DECLARED_RIGHT) / max(1, len(names) - 1), 1e-6)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "text"):
            text = batch.column("text")
            if any(html := batch.column("html").to_pylist()):
                text = pa.array([extract(x) if h else x for x, h in zip(text.to_pylist(), html, strict=True)], pa.large_string())
            n, e, fit = model.evidence(text)
            for i, name in enumerate(batch.column("declared").to_pylist()):
                if name in place:
                    e[i] += wrong
                    e[i, place[name]] += np.log(DECLARED_RIGHT) - wrong
            first = np.arange(len(n) + 1, dtype=np.int32) * len(names)
            lists = [pa.ListArray.from_arrays(first, pa.array(x.ravel())) for x in (e, fit >= model.least)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*keep, "declared", "host"]), pa.array(n), *lists], [*keep, "declared", "host", "trigrams", "e", "fits"])

    seen = common.materialize(clean.mapInArrow(read, schema))
    rows = seen.withColumn("own", F.when((F.col("trigrams") > 0) & F.array_contains("fits", True), 1.0).otherwise(0.0))
    rows = rows.withColumn("p", F.transform(_normal(F.col("e")), lambda x: x * F.col("own")))
    # a host's counts without the text's own, smoothed towards its domain
    prior = F.zip_with("c", "p", lambda c, p: F.greatest(c - p, F.lit(0.0)))
    total = F.greatest(F.col("n") - F.col("own"), F.lit(0.0)) + STRENGTH
    prior = F.zip_with(prior, "up", lambda c, u: F.log((c + STRENGTH * u) / total))
    judged = rows.join(common.materialize(host_priors(rows, names)), "host", "left")
    judged = judged.select(*keep, "declared", "host", "trigrams", "fits", _normal(F.zip_with("e", prior, lambda x, y: x + y)).alias("q"))
    best = _with(F.col("q"), lambda q: F.struct(F.array_max(q).alias("p"), (F.array_position(q, F.array_max(q)).cast("int") - 1).alias("at")))
    judged = judged.withColumn("best", best)
    sound = (F.col("trigrams") > 0) & (F.col("best.p") >= MIN_POSTERIOR) & F.get("fits", F.col("best.at"))
    return judged.select(
        *keep,
        F.when(sound, F.get(F.array(*map(F.lit, names)), F.col("best.at"))).otherwise("und").alias("language"),
        F.when(F.col("trigrams") > 0, F.col("best.p")).otherwise(F.lit(0.0)).alias("posterior"),
        F.nullif("declared", F.lit("")).alias("declared"),
        "host",
        sound.alias("kept"),
    )


def host_priors(rows: DataFrame, names: list[str]) -> DataFrame:
    """host, its texts n and soft counts c, and up: the smoothed prior of its domain (arrays by language). Three
    aggregations, each of the one before; the rows themselves are added up on the map side."""
    k = range(len(names))
    sums = lambda of, *by: of.groupBy(*by).agg(F.sum("n").alias("n"), *(F.sum(F.col("c")[i]).alias(f"c{i}") for i in k)).select(*by, "n", F.array(*(f"c{i}" for i in k)).alias("c"))
    hosts = sums(rows.select("host", F.col("own").alias("n"), F.col("p").alias("c")), "host").withColumn("suffix", F.element_at(F.split("host", r"\."), -1))
    hosts = common.materialize(hosts.withColumn("domain", F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0)))
    domains = sums(hosts, "domain", "suffix")
    suffixes = common.materialize(sums(domains, "suffix"))
    whole = sums(suffixes).first()
    n, c = whole["n"] or 0.0, [x or 0.0 for x in whole["c"]]
    top = F.array(*(F.lit((x + 1.0) / (n + len(names))) for x in c))
    country = F.array(*(F.when(F.col("suffix").isin([s for s, lang in COUNTRY.items() if lang == name]), SUFFIX_COUNT).otherwise(0.0) for name in names))
    extra = F.aggregate(country, F.lit(0.0), lambda t, x: t + x)
    smooth = lambda counts, up, size: F.zip_with(counts, up, lambda c, u: (c + STRENGTH * u) / (size + STRENGTH)).alias("up")
    suffixes = suffixes.select("suffix", smooth(F.zip_with("c", country, lambda x, y: x + y), top, F.col("n") + extra))
    domains = domains.join(suffixes, "suffix", "left").select("domain", smooth(F.col("c"), F.col("up"), F.col("n")))
    return hosts.join(domains, "domain", "left").select("host", "n", "c", "up")


def of_documents(docs: DataFrame) -> DataFrame:
    """A document declares its lang, and its source stands for the host."""
    return docs.select("doc_id", "text", F.lit(False).alias("html"), F.col("lang").alias("declared"), F.col("source").alias("host"))


def of_pages(pages: DataFrame) -> DataFrame:
    """A page declares the lang of its html element."""
    return pages.select(
        "page_id",
        F.col("html").alias("text"),
        F.lit(True).alias("html"),
        F.regexp_extract("html", r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?([a-z-]+)""", 1).alias("declared"),
        F.regexp_extract("url", r"(?s)^.*?://(?:[^/?#@]*@)?([^/?#:]*)", 1).alias("host"),
    )


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents (doc_id; page_id null) and all pages (page_id; doc_id null), the tables with texts of unknown language."""
    docs = common.table(spark, sf_dir, "documents")
    both = of_documents(docs).unionByName(of_pages(common.table(spark, sf_dir, "pages")), allowMissingColumns=True)
    return identify(both, train(docs), ["doc_id", "page_id"])
