"""Operator 2: language of web pages by Bayesian evidence fusion.

Independent pieces of evidence are multiplied for every language:

text      likelihood of the visible text under character-trigram models
markup    the language the page declares (``<html lang=...>``)
suffix    the country suffix of its address
host      a prior for its host, smoothed hierarchically: host towards
          registered domain towards suffix towards all pages

The priors come from grouped aggregations over all pages: each page counts for
the language that text, markup and suffix give it, a level's share is
``(count + weight * parent share) / (total + weight)``, and a page's own count
is left out of its own prior.

Bound of the fit, a parameter: ``per_language`` texts of each language (least
hashes of their ids), read whole.  Priors, scoring and counts use every page
and whole texts.

Defined results: a null or empty page, and one without known trigrams, has no
text evidence; an address without a host has the prior of all pages; a declared
language that is not modelled, and a suffix that stands for none, are no
evidence; ties go to the language that sorts first; with no labelled text the
language is null; pages that repeat are each answered and counted, documents
that repeat an id are told apart by language and text; no pages give an empty
table; other columns are not used, whatever their names.
"""

import html as entities
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlake.llm.scratch import written
from pairlake.llm.text import arrow_column, pick, pieces

#: Country suffixes and the language that prevails there.
SUFFIX_LANGUAGE = {
    "at": "de", "au": "en", "br": "pt", "cl": "es", "cn": "zh", "co": "es", "cz": "cs", "de": "de", "es": "es",
    "fr": "fr", "gr": "el", "hu": "hu", "ie": "en", "it": "it", "jp": "ja", "kr": "ko", "mx": "es", "nl": "nl",
    "nz": "en", "pl": "pl", "pt": "pt", "ro": "ro", "ru": "ru", "se": "sv", "tr": "tr", "ua": "uk", "uk": "en",
    "us": "en"}
DECLARED_RIGHT = 0.9  # share of pages whose declared language is theirs
SUFFIX_RIGHT = 0.7  # share of pages under a country suffix in its language
TEXT_TRIGRAMS = 50  # the text's trigrams weigh like at most so many independent ones
SMOOTHING = 8.0  # pages that a parent's share weighs
_WORD = re.compile(r"[^\W\d_]+")
_RAW = re.compile(r"<(script|style)\b", re.I)


def visible_text(page: str) -> str:
    """The text outside tags, comments, scripts and styles; an unclosed one
    reaches to the end."""
    out, at = [], 0
    while (begin := page.find("<", at)) >= 0:
        out.append(page[at:begin])
        raw = _RAW.match(page, begin)
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = end + 3 if end >= 0 else len(page)
        elif raw:
            closing = re.compile(f"</{raw[1]}[^>]*>", re.I).search(page, raw.end())
            at = closing.end() if closing else len(page)
        else:
            end = page.find(">", begin + 1)
            at = end + 1 if end >= 0 else len(page)
    return entities.unescape(" ".join([*out, page[at:]]))


def trigrams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i:i + 3] for i in range(len(padded) - 2)]


def _count_trigrams(batches):
    for batch in batches:
        counts: Counter = Counter()
        at = 0
        for piece in pieces(batch.column(1)):
            for lang, text in zip(batch.column(0).slice(at, len(piece)).to_pylist(), piece.to_pylist(), strict=True):
                for word, n in Counter(_WORD.findall((text or "").lower())).items():
                    for gram in trigrams(word):
                        counts[lang, gram] += n
            at += len(piece)
        rows = [(lang, gram, n) for (lang, gram), n in counts.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["lang", "gram", "n"])


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        per_language: int = 1000) -> tuple[list[str], dict[str, tuple[float, ...]]]:
    """(languages, trigram -> log likelihood per language).

    A document is known by its id, language and text together, so ids that
    repeat keep their texts apart; rows alike in all three are one.  The
    ``per_language`` documents of least hash are read whole, all their trigrams
    count."""
    known = pick(docs, id=doc_id, text=text, lang=lang).select(
        "id", F.lower("lang").alias("lang"), "text", F.xxhash64("text").alias("mark")).filter(
        "id is not null and lang is not null")
    draw = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "mark")
    chosen = known.select("id", "lang", "mark").distinct().withColumn("r", F.row_number().over(draw)).filter(
        F.col("r") <= per_language).drop("r")
    sample = known.join(F.broadcast(chosen), ["id", "lang", "mark"]).groupBy("id", "lang", "mark").agg(
        F.first("text").alias("text"))
    rows = (sample.select("lang", "text").mapInArrow(_count_trigrams, "lang string, gram string, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n"))).collect()
    languages = sorted({r["lang"] for r in rows})
    table: dict[str, dict[str, int]] = {}
    for r in rows:
        table.setdefault(r["gram"], {})[r["lang"]] = r["n"]
    total = {k: sum(v.get(k, 0) for v in table.values()) for k in languages}
    return languages, {g: tuple(math.log((n.get(k, 0) + 0.5) / (total[k] + 0.5 * len(table))) for k in languages)
                       for g, n in sorted(table.items())}


class TextLikelihood:
    """``likelihood(page)`` -> log likelihood per language, or None."""

    def __init__(self, languages: list[str], model: dict[str, tuple[float, ...]]):
        self._n, self._model, self._words = len(languages), model, {}

    def _word(self, word: str) -> tuple[int, list[float]]:
        known = [self._model[g] for g in trigrams(word) if g in self._model]
        return len(known), [sum(x) for x in zip(*known, strict=True)] or [0.0] * self._n

    def __call__(self, page: str | None) -> list[float] | None:
        if len(self._words) > 200_000:
            self._words.clear()
        seen, out = 0, [0.0] * self._n
        for word, times in Counter(_WORD.findall(visible_text(page or "").lower())).items():
            found = self._words.get(word)
            if found is None:
                found = self._words[word] = self._word(word)
            seen += found[0] * times
            for i, x in enumerate(found[1]):
                out[i] += x * times
        # neighbouring trigrams depend on each other: long texts do not weigh without bound
        return [x * min(1.0, TEXT_TRIGRAMS / seen) for x in out] if seen else None


def _evidence(language: Column, languages: list[str], right: float) -> Column:
    """Log likelihood per language of a clue that names one of them."""
    wrong = (1 - right) / max(1, len(languages) - 1)
    return F.when(language.isin(languages), F.array(*[
        F.when(language == k, F.lit(math.log(right))).otherwise(F.lit(math.log(wrong or 1.0))) for k in languages
    ])).otherwise(F.array(*[F.lit(0.0)] * len(languages)))


def _add(*logs: Column) -> Column:
    total = logs[0]
    for x in logs[1:]:
        total = F.zip_with(total, x, lambda a, b: a + b)
    return total


def _least_best(logs: Column) -> Column:
    """Number of the first greatest entry."""
    return (F.array_position(logs, F.array_max(logs)) - 1).cast("int")


def identify(pages: DataFrame, docs: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
             smoothing: float = SMOOTHING, **fitting) -> DataFrame:
    """(page_id, ``lang``, ``confidence``: its posterior, ``text_lang``,
    ``declared``, ``host``, ``suffix``)."""
    languages, model = fit(docs, **fitting)
    pages = pick(pages, **{page_id: page_id, "url": url, "html": html})
    url, html = "url", "html"
    if not languages:
        return pages.select(page_id, F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"),
                            *[F.lit(None).cast("string").alias(c) for c in ("text_lang", "declared", "host", "suffix")])
    n = len(languages)
    names = F.array(*map(F.lit, languages))

    def kernel():
        likelihood = TextLikelihood(languages, model)
        return lambda texts: pa.array([likelihood(t) for t in texts.to_pylist()], type=pa.list_(pa.float64()))

    host = F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    # whole tags first, so that a page of many unclosed tags is still read once
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<html\b[^>]*+"), F.lit(0))
    langs = F.transform(tags, lambda t: F.regexp_extract(t, r"(?i)\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    declared = F.lower(F.get(F.filter(langs, lambda k: k != ""), 0))
    facts = written(pages.select(
        F.col(page_id).alias("_id"), host.alias("host"), declared.alias("declared"),
        arrow_column(kernel, "array<double>")(F.col(html)).alias("text")), "pages")
    suffix = F.substring_index("host", ".", -1)
    of_suffix = F.create_map(*[F.lit(x) for pair in SUFFIX_LANGUAGE.items() for x in pair])
    nothing = F.array(*[F.lit(0.0)] * n)
    facts = (facts.withColumns({"suffix": suffix, "domain": F.substring_index("host", ".", -2)})
             .withColumn("own", _add(F.coalesce("text", nothing), _evidence(F.col("declared"), languages, DECLARED_RIGHT),
                                     _evidence(of_suffix[F.col("suffix")], languages, SUFFIX_RIGHT)))
             .withColumn("vote", _least_best(F.col("own"))))

    def counted(*keys):
        return [F.sum((F.col("vote") == i).cast("long")).alias(f"{keys[-1]}{i}") for i in range(n)]

    # counts per host, summed up for the levels above it
    hosts = facts.filter("host is not null").groupBy("host", "domain", "suffix").agg(*counted("h"))
    domains = hosts.groupBy("domain", "suffix").agg(*[F.sum(f"h{i}").alias(f"d{i}") for i in range(n)])
    suffixes = domains.groupBy("suffix").agg(*[F.sum(f"d{i}").alias(f"s{i}") for i in range(n)])
    levels = hosts.join(domains.drop("suffix"), "domain").join(suffixes, "suffix").drop("domain", "suffix")
    everything = facts.agg(*counted("a")).first()
    whole = [everything[i] or 0 for i in range(n)]

    def share(level: str, parent: list[Column]) -> list[Column]:
        """Without the page's own vote."""
        rest = [F.coalesce(F.col(f"{level}{i}") - (F.col("vote") == i).cast("long"), F.lit(0)) for i in range(n)]
        total = sum(rest[1:], rest[0])
        return [(r + smoothing * p) / (total + smoothing) for r, p in zip(rest, parent, strict=True)]

    rows = facts.join(levels, "host", "left")
    top = [(F.lit(whole[i]) - (F.col("vote") == i).cast("long") + 1) / F.lit(float(sum(whole) - 1 + n)) for i in range(n)]
    prior = share("h", share("d", share("s", top)))
    fused = (rows.withColumn("prior", F.array(*[F.ln(p) for p in prior]))
             .withColumn("all", _add(F.col("own"), F.col("prior")))
             .withColumn("best", _least_best(F.col("all"))))
    spread = F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("all")))
    return fused.select(F.col("_id").alias(page_id), names[F.col("best")].alias("lang"), (1 / spread).alias("confidence"),
                        F.when(F.col("text").isNotNull(), names[_least_best(F.col("text"))]).alias("text_lang"),
                        "declared", "host", "suffix")
