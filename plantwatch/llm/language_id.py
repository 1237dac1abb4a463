"""Operator 8: language identification by Bayesian evidence fusion.

The posterior of a language for a page multiplies four pieces of evidence:

* the likelihood of its visible text under a character n-gram model per language, tempered
  so that a long text counts as ``EVIDENCE`` n-grams at most;
* the declared markup language, by how often pages of each language declare it;
* the address suffix, by how often pages of each language have it;
* the prior of its host, smoothed towards that of its domain, which is smoothed towards
  that of all pages. A page's own text is left out of its host's and domain's counts.

The counts come from grouped aggregates over all pages, with the text's first guess as the
language; they combine before the shuffle, so a host with a third of all pages is no hot group.
Counts of host, domain and suffix are put together per host and written, and evidence rows
(numbers, no texts) are joined to them once.

The n-gram model is fitted on at most ``MODEL_ROWS`` labelled documents, those with the smallest
hash per language; counts and scores cover every page.

Defined results: a page without text is judged by the rest of its evidence; an address that is
null or has no host belongs to the host ''; repeated rows are judged each; null ids stay null; an
empty table gives no rows; without labelled documents every language is null.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plantwatch.llm.arrow import BoundedCache, map_arrow, texts
from plantwatch.session import materialise

MODEL_ROWS = 2_000
BUCKETS = 1 << 15
EVIDENCE = 40.0
HOST_STRENGTH = 5.0
SIGNAL_STRENGTH = 2.0

OPENER = re.compile(r"<(script|style)\b|<!--", re.I)
CLOSERS = {"script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I), "": re.compile("-->")}
TAG = re.compile(r"<[^>]*>")
ENTITY = re.compile(r"&(?:#\d+|#x[0-9a-f]+|\w+);", re.I)
NOT_LETTERS = re.compile(r"[\W\d_]+")


def without_hidden(html: str) -> str:
    """A page without scripts, styles and comments, in one pass: a kind whose end is missing once is not looked for again."""
    out, kept, at, open_ended = [], 0, 0, set()
    while (found := OPENER.search(html, at)) is not None:
        kind = (found.group(1) or "").lower()
        end = None if kind in open_ended else CLOSERS[kind].search(html, found.end())
        if end is None:
            open_ended.add(kind)
            if len(open_ended) == len(CLOSERS):
                break
            at = found.start() + 1
        else:
            out.append(html[kept:found.start()])
            kept = at = end.end()
    out.append(html[kept:])
    return " ".join(out)


def visible(html: str) -> str:
    """Text of a page without markup, scripts, styles and comments."""
    shown = without_hidden(html)
    # Behind the last bracket no tag can end.
    last = shown.rfind(">") + 1
    return ENTITY.sub(" ", TAG.sub(" ", shown[:last]) + shown[last:])


def grams(word: str) -> list[int]:
    """Buckets of the 1- to 3-grams of a word."""
    marked = f"<{word}>"
    return [zlib.crc32(marked[i:i + n].encode("utf-8", "surrogatepass"), n) % BUCKETS
            for n in (1, 2, 3) for i in range(len(marked) - n + 1)]


def word_counts(text: str) -> Counter:
    return Counter(w for w in NOT_LETTERS.split(text.lower()) if w)


@dataclass
class Model:
    """Log-probability of each n-gram bucket in each language."""
    languages: list[str]
    table: np.ndarray


def fit(rows: list[tuple[str, str]], smoothing: float = 0.5) -> Model:
    languages = sorted({lang for _, lang in rows})
    counts = np.full((BUCKETS, len(languages)), smoothing)
    for text, lang in rows:
        k = languages.index(lang)
        for word, n in word_counts(text).items():
            np.add.at(counts[:, k], grams(word), n)
    return Model(languages, np.log(counts / counts.sum(axis=0)))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          most_rows: int = MODEL_ROWS) -> Model:
    """Fit on a bounded sample: the same number of documents of each language, smallest hashes first."""
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    languages = sorted(r[0] for r in labelled.select(lang_col).distinct().limit(most_rows).collect())
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)))
    each, rows = max(1, most_rows // len(languages)), []
    ids = labelled.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.md5(F.col(id_col).cast("string")).alias("_order"))
    for lang in languages:
        rows += [(r["_id"], lang) for r in ids.filter(F.col("_lang") == lang).orderBy("_order", "_id").limit(each).collect()]
    pick = docs.sparkSession.createDataFrame(rows, ids.select("_id", "_lang").schema)
    chosen = (labelled.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
              .join(F.broadcast(pick), ["_id", "_lang"]).groupBy("_id", "_lang").agg(F.min("_text").alias("_text")).collect())
    return fit(sorted((r["_text"], r["_lang"]) for r in chosen))


def text_scorer(model: Model, cached_words: int = 300_000):
    """Tempered log-likelihood of a text per language; None for a text without letters."""
    known = BoundedCache(cached_words)

    def score(text: str) -> np.ndarray | None:
        total, n = np.zeros(len(model.languages)), 0
        known.room()
        for word, times in word_counts(text).items():
            got = known.get(word)
            if got is None:
                ids = grams(word)
                got = known.keep(word, (model.table[ids].sum(axis=0), len(ids)))
            total += times * got[0]
            n += times * got[1]
        return total * (min(EVIDENCE, n) / n) if n else None

    return score


def host_of(url: Column) -> Column:
    text = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return text


def evidence(pages: DataFrame, model: Model, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """id, host, declared (null unless it is one of the languages), scores per language, first guess (-1: none)."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    declared = F.lower(F.regexp_extract(F.coalesce(html_col, F.lit("")), r"(?i)<html\b[^<>]*?\slang\s*=\s*[\"']?([A-Za-z]+)", 1))
    source = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("_host"),
                          F.when(declared.isin(model.languages), declared).alias("_declared"), F.col(html_col).alias("_html"))

    def run(batches):
        score = text_scorer(shared.value)
        none = [0.0] * len(shared.value.languages)
        for b in batches:
            found = [score(visible(t)) for i in range(0, b.num_rows, 256) for t in texts(b.column("_html").slice(i, 256))]
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), b.column("_host"), b.column("_declared"),
                 pa.array([none if x is None else x.tolist() for x in found], pa.list_(pa.float64())),
                 pa.array([-1 if x is None else int(x.argmax()) for x in found], pa.int32())],
                names=["_id", "_host", "_declared", "_scores", "_guess"])

    kind = source.schema["_id"].dataType.simpleString()
    return map_arrow(source, run, f"_id {kind}, _host string, _declared string, _scores array<double>, _guess int")


def identify(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, host, text_lang (first guess), declared, lang and confidence (its posterior)."""
    langs = model.languages
    if not langs:
        return pages.select(id_col, host_of(F.col(url_col)).alias("host"), *[F.lit(None).cast("string").alias(c) for c in
                            ("text_lang", "declared", "lang")], F.lit(None).cast("double").alias("confidence"))
    size = len(langs)
    seen = materialise(evidence(pages, model, id_col, url_col, html_col), "evidence")
    suffix = F.element_at(F.split("_host", r"\."), -1)
    domain = F.concat_ws(".", F.slice(F.split("_host", r"\."), F.greatest(F.size(F.split("_host", r"\.")) - 1, F.lit(1)), 2))
    each = [F.count_if(F.col("_guess") == k).alias(f"_n{k}") for k in range(size)]
    again = [F.sum(f"_n{k}").alias(f"_n{k}") for k in range(size)]
    packed = F.array(*[F.col(f"_n{k}") for k in range(size)])
    hosts = materialise(seen.groupBy("_host").agg(*each).withColumns({"_domain": domain, "_suffix": suffix}), "hosts")
    domains = hosts.groupBy("_domain").agg(*again).select("_domain", packed.alias("_of_domain"))
    suffixes = hosts.groupBy("_suffix").agg(*again).select("_suffix", packed.alias("_of_suffix"))
    totals = hosts.agg(*again).first()
    everything = np.array([totals[f"_n{k}"] or 0 for k in range(size)], float)
    by_declared = {(r["_declared"], k): r[f"_n{k}"] for r in seen.groupBy("_declared").agg(*each).collect() for k in range(size)}
    table = materialise(hosts.select("_host", "_domain", "_suffix", packed.alias("_of_host"))
                        .join(domains, "_domain").join(suffixes, "_suffix").drop("_domain", "_suffix"), "host_counts")
    overall = (everything + 1) / (everything.sum() + size)
    rows = seen.join(table, "_host")

    def posterior(k: int) -> Column:
        own, any_own = (F.col("_guess") == k).cast("double"), (F.col("_guess") >= 0).cast("double")

        def smoothed(counts: str, to: Column) -> Column:
            total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
            return (F.element_at(counts, k + 1) - own + to * HOST_STRENGTH) / (total - any_own + HOST_STRENGTH)

        prior = smoothed("_of_host", smoothed("_of_domain", F.lit(float(overall[k]))))
        suffix_all = F.aggregate("_of_suffix", F.lit(0.0), lambda a, x: a + x)
        share = (suffix_all - any_own + 1) / (float(everything.sum()) + 1)
        from_suffix = (F.element_at("_of_suffix", k + 1) - own + share * SIGNAL_STRENGTH) / (float(everything[k]) - own + SIGNAL_STRENGTH)
        says = F.lit(0.0)
        for d in langs:
            chance = (by_declared.get((d, k), 0) + SIGNAL_STRENGTH / size) / (everything[k] + SIGNAL_STRENGTH)
            says = F.when(F.col("_declared") == d, F.lit(math.log(chance))).otherwise(says)
        return F.element_at("_scores", k + 1) + says + F.log(prior) + F.log(from_suffix)

    logs = rows.withColumn("_logs", F.array(*[posterior(k) for k in range(size)])).withColumn("_top", F.array_max("_logs"))
    names = F.array(*[F.lit(x) for x in langs])
    best = F.array_position("_logs", F.col("_top")).cast("int")
    total = F.aggregate(F.transform("_logs", lambda x: F.exp(x - F.col("_top"))), F.lit(0.0), lambda a, x: a + x)
    return logs.select(F.col("_id").alias(id_col), F.col("_host").alias("host"),
                       F.when(F.col("_guess") >= 0, F.element_at(names, F.greatest(F.col("_guess"), F.lit(0)) + 1)).alias("text_lang"),
                       F.col("_declared").alias("declared"), F.element_at(names, best).alias("lang"), (1 / total).alias("confidence"))
