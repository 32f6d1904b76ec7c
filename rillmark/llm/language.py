"""Language of web pages by Bayesian evidence fusion.

Three kinds of evidence are added as log probabilities: the text under a character n-gram model
learned from labelled documents; the language that the markup declares; and a prior of the
address, the host's smoothed towards its domain's, that towards its suffix's, that towards all
pages'.  How far declarations can be trusted, and all priors, come from grouped counts over all
pages under the text evidence alone, weighted by its posterior; a page's own weight is taken out
of every count before the page is judged, so no page votes for itself, and the suffix enters once,
through the prior.

The text model learns from about ``TRAIN_DOCS`` whole documents of each language (those whose hash
falls in that share); the languages are all that any document is labelled with.

Defined cases: a null or empty page, or one without letters, has no text evidence; a null or odd
url has the empty host; an undeclared or unknown language is evidence of its own kind; without any
labelled document there is no language and ``lang`` is null; repeated rows are judged each; an
empty table gives no rows; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.llm import storage

TRAIN_DOCS = 800
BUCKETS, NGRAMS = 1 << 15, (1, 2, 3)
#: Evidence of n-grams overlaps; a text counts as so many independent words at most.
TEXT_POWER, WORDS_MOST = 1.0, 30
STRENGTH = 5.0
WORDS_KEPT = 200_000

#: Elements whose content is not the page's text.
_SILENT = ("script", "style", "nav")
_TAG = re.compile(r"(?s)<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9]*)[^<>]*>|<[^<>]*>")
_DECLARED = re.compile(r"""(?i)<html\b[^>]*?\b(?:xml:)?lang\s*=\s*["']?([A-Za-z]{2,3})|<meta\b[^>]*content-language[^>]*content\s*=\s*["']?([A-Za-z]{2,3})""")
_WORD = re.compile(r"[^\W\d_]+")


def page_text(page: str | None) -> str:
    """The text outside tags, comments and silent elements, in one pass; an element left open is read."""
    page = page or ""
    out, at, silent = [], 0, ""
    ends: dict[str, int] = {}
    for m in _TAG.finditer(page):
        name = (m[2] or "").lower()
        if silent:
            if not (name == silent and m[1]):
                continue
            silent = ""
        else:
            out.append(page[at : m.start()])
            if name in _SILENT and not m[1]:
                if name not in ends:
                    ends[name] = max((x.start() for x in re.finditer(rf"(?i)</{name}[^<>]*>", page)), default=-1)
                if ends[name] >= m.end():  # an element that no tag closes is not silent
                    silent = name
        at = m.end()
    out.append(page[at:])
    return entities.unescape(" ".join(out))


def declared(page: str | None) -> str:
    m = _DECLARED.search(page or "")
    return (m[1] or m[2]).lower() if m else ""


def grams(word: str) -> list[int]:
    own = f"_{word}_"
    return [zlib.crc32(own[i : i + n].encode("utf-8", "replace")) % BUCKETS for n in NGRAMS for i in range(len(own) - n + 1)]


class TextModel:
    """Mean log probability of a word's n-grams in each language."""

    def __init__(self, langs: list[str], logs: np.ndarray):
        self.langs, self.logs = langs, logs

    def of(self, text: str, known: dict) -> np.ndarray:
        """Log likelihoods of a text, up to a constant, as if its words were few and independent."""
        total, n = np.zeros(len(self.langs)), 0
        for word in _WORD.findall(text.lower()):
            own = known.get(word)
            if own is None:
                own = self.logs[:, grams(word)].mean(axis=1)
                if len(word) <= 64:
                    if len(known) > WORDS_KEPT:
                        known.clear()
                    known[word] = own
            total += own
            n += 1
        if n and len(total):
            total = (total - total.max()) * TEXT_POWER * min(1.0, WORDS_MOST / n)
        return total


def fit(docs: DataFrame, sample: int = TRAIN_DOCS, seed: int = 5) -> TextModel:
    """Learn from about ``sample`` whole documents of each language; only counts reach the driver."""
    storage.small_batches(docs.sparkSession)
    known = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    langs = sorted(sizes)
    if not langs:
        return TextModel([], np.zeros((0, BUCKETS)))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample / sizes[k]))])
    drawn = F.shiftrightunsigned(F.xxhash64("text", F.lit(seed)), 11) / F.lit(float(1 << 53)) < share[F.col("lang")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for word, times in Counter(_WORD.findall((text or "").lower())).items():
                    np.add.at(own, grams(word), times)
        for lang, own in counts.items():
            held = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(held), pa.string()), pa.array(held.astype("i4")), pa.array(own[held])], ["lang", "bucket", "n"])

    # at most BUCKETS rows a language
    table = known.where(drawn).select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((len(langs), BUCKETS), 0.5)
    at = {k: i for i, k in enumerate(langs)}
    rows = np.array([at[k] for k in table.column("lang").to_pylist()], int)
    counts[rows, table.column("bucket").to_numpy()] += table.column("n").to_numpy()
    return TextModel(langs, np.log(counts / counts.sum(axis=1, keepdims=True)))


def _host(url) -> tuple:
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    domain, suffix = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.regexp_extract(host, r"\.([^.]+)$", 1)
    return host, F.when(domain != "", domain).otherwise(F.concat(F.lit("."), suffix)), suffix  # a domain has one suffix


def evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, host, domain, suffix, declared and the text's log likelihoods, for every page."""
    storage.small_batches(pages.sparkSession)
    schema = "page_id long, host string, domain string, suffix string, declared string, likelihood array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            raw = batch.column(4).to_pylist()
            logs = [model.of(page_text(x), known).tolist() for x in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([declared(x) for x in raw], pa.string()), pa.array(logs, pa.list_(pa.float64()))], [x.split()[0] for x in schema.split(", ")])

    host, domain, suffix = _host(F.col("url").cast("string"))
    narrow = pages.select(F.col("page_id").cast("long"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix"), F.col("html").cast("string").alias("html"))
    return narrow.mapInArrow(run, schema)


def _soft(logs):
    """Probabilities from log values."""
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def _sums(n: int) -> Column:
    """The summed probability of each language."""
    return F.array(*[F.sum(F.col("p")[i]) for i in range(n)])


def _less(counts: Column, own: Column) -> Column:
    """Counts without the page's own weight."""
    return F.zip_with(counts, own, lambda c, p: F.greatest(c - p, F.lit(0.0)))


def _smoothed(counts: Column, parent: Column) -> Column:
    """(counts + strength x parent) / (their sum + strength)."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, parent, lambda c, q: (c + F.lit(STRENGTH) * q) / (total + F.lit(STRENGTH)))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, probability, declared, suffix, host, text_lang, posterior for every page."""
    model = fit(docs)
    n = len(model.langs)
    seen = storage.staged(evidence(pages, model), "evidence")
    if not n:
        none = F.lit(None).cast("string")
        return seen.select("page_id", none.alias("lang"), F.lit(None).cast("double").alias("probability"), "declared", "suffix", "host", none.alias("text_lang"), F.array().cast("array<double>").alias("posterior"))
    seen = storage.staged(seen.withColumn("p", _soft(F.col("likelihood"))), "posteriors")
    total = seen.agg(F.count("*"), *[F.sum(F.col("p")[i]).alias(f"p{i}") for i in range(n)]).first()
    pages_, total = total[0], [x or 0.0 for x in total[1:]]
    everywhere = F.array(*[F.lit(float(x)) for x in total])
    # keys are the address itself, so their tables follow the pages
    hosts = seen.groupBy("suffix", "domain", "host").agg(_sums(n).alias("by_host"), F.count("*").alias("pages"))
    hosts = storage.staged(hosts.withColumn("p", F.col("by_host")), "hosts")
    domains = storage.staged(hosts.groupBy("suffix", "domain").agg(_sums(n).alias("by_domain"), F.sum("pages").alias("pages")).withColumn("p", F.col("by_domain")), "domains")
    suffixes = storage.staged(domains.groupBy("suffix").agg(_sums(n).alias("by_suffix"), F.sum("pages").alias("pages")), "suffixes")
    marked = storage.staged(seen.groupBy("declared").agg(_sums(n).alias("by_declared"), F.count("*").alias("pages")), "declared")
    joined = seen
    for table, key, value in ((hosts, "host", "by_host"), (domains, "domain", "by_domain"), (suffixes, "suffix", "by_suffix"), (marked, "declared", "by_declared")):
        joined = storage.joined(joined, table.select(key, value, "pages"), key, "pages", pages_)
    own = F.col("p")
    flat = F.array(*[F.lit(1.0 / n)] * n)
    prior = _smoothed(_less(everywhere, own), flat)
    for level in ("by_suffix", "by_domain", "by_host"):
        prior = _smoothed(_less(F.col(level), own), prior)
    joined = joined.withColumn("prior", prior).withColumn("marks", _less(F.col("by_declared"), own)).withColumn("others", _less(everywhere, own))
    trust = [F.log((F.col("marks")[i] + 0.1) / (F.col("others")[i] + 1.0)) for i in range(n)]  # log P(declared | language)
    logs = F.array(*[F.col("likelihood")[i] + trust[i] + F.log(F.col("prior")[i]) for i in range(n)])
    names = F.array(*[F.lit(x) for x in model.langs])
    best = lambda values: F.get(names, (F.array_position(values, F.array_max(values)) - 1).cast("int"))
    out = joined.withColumn("posterior", _soft(logs))
    return out.select("page_id", best(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("probability"), "declared", "suffix", "host", best(F.col("p")).alias("text_lang"), "posterior")
