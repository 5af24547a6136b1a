"""Language ID (op 2): the fused posterior against a plain computation."""

import math
import random
from collections import Counter

import pytest

from pairlake.llm import langid

WORDS = {"de": "der die und nicht einen werden schon", "en": "the and with that from they this",
         "fr": "les des une dans pour avec que"}


def corpus(n=60):
    draw = random.Random(2)
    return [(i, " ".join(draw.choice(WORDS[k].split()) for _ in range(30)), k)
            for i, k in enumerate(draw.choice(list(WORDS)) for _ in range(n))] + [(900, None, "de"), (901, "x", None)]


def pages():
    draw = random.Random(3)
    hosts = ["a.shop.de", "b.shop.de", "news.fr", "x.example.com", "hot.example.com", "hot.example.com", "hot.example.com"]
    out = []
    for i in range(80):
        k = draw.choice(list(WORDS))
        body = " ".join(draw.choice(WORDS[k].split()) for _ in range(draw.choice([0, 1, 12])))
        declared = draw.choice([k, k, "en", "xx", None])
        tag = f'<html lang="{declared}">' if declared else "<html>"
        out.append((i, f"https://{draw.choice(hosts)}/p?{i}", f"{tag}<script>the and the</script><p>{body}&amp;</p>"))
    return out + [(100, None, None), (101, "", ""), (102, "no address", "<p>und die</p>"), (103, "http://news.fr", "<!-- die"),
                  (100, None, None), out[3]]


def plain(rows, languages, model, smoothing=langid.SMOOTHING):
    import re

    def parts(url, html):
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
        host = m[1].lower() if m else None
        m = re.search(r"<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", html or "", re.I)
        return host, m[1].lower() if m else None

    def clue(language, right):
        wrong = (1 - right) / (len(languages) - 1)
        return [math.log(right if k == language else wrong) if language in languages else 0.0 for k in languages]
    likelihood = langid.TextLikelihood(languages, model)
    facts = []
    for i, url, html in rows:
        host, declared = parts(url, html)
        text = likelihood(html)
        suffix = host.rsplit(".", 1)[-1] if host else None
        own = [sum(x) for x in zip(text or [0.0] * len(languages), clue(declared, langid.DECLARED_RIGHT),
                                   clue(langid.SUFFIX_LANGUAGE.get(suffix), langid.SUFFIX_RIGHT), strict=True)]
        facts.append((i, host, host and ".".join(host.split(".")[-2:]), suffix, own, own.index(max(own))))
    counts = Counter()
    for _, host, domain, suffix, _, vote in facts:
        counts.update([("all", vote), *([("h", host, vote), ("d", domain, vote), ("s", suffix, vote)] if host else [])])
    out = []
    for i, host, domain, suffix, own, vote in facts:
        share = [(counts["all", k] - (k == vote) + 1) / (len(facts) - 1 + len(languages)) for k in range(len(languages))]
        for level in (("s", suffix), ("d", domain), ("h", host)):
            n = [counts[*level, k] - (k == vote) if host else 0 for k in range(len(languages))]
            share = [(c + smoothing * p) / (sum(n) + smoothing) for c, p in zip(n, share, strict=True)]
        logs = [o + math.log(p) for o, p in zip(own, share, strict=True)]
        best = logs.index(max(logs))
        out.append((i, languages[best], 1 / sum(math.exp(x - max(logs)) for x in logs)))
    return sorted(out)


def test_fused_posterior(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    rows = pages()
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    languages, model = langid.fit(docs)
    assert languages == ["de", "en", "fr"]
    got = sorted((r["page_id"], r["lang"], r["confidence"]) for r in langid.identify(df, docs).collect())
    want = plain(rows, languages, model)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-9)


def test_language_is_found_behind_long_attributes(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    rows = [*pages(), (104, "http://news.fr", f'<html class="{"no-js " * 400}" data-x="{"y" * 50_000}" lang="DE-at"><p>'),
            (105, "http://news.fr", '<HTML a="1"> <html b lang = fr>'), (106, "http://news.fr", "<html lang><p lang=de>"),
            (107, "http://news.fr", "<html " * 2_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = langid.identify(df, docs).collect()
    assert {r["page_id"]: r["declared"] for r in got if r["page_id"] > 103} == {104: "de", 105: "fr", 106: None, 107: None}
    languages, model = langid.fit(docs)
    want = plain(rows, languages, model)
    assert sorted((r["page_id"], r["lang"]) for r in got) == [w[:2] for w in want]


def test_fit_counts_each_row_once_for_its_own_language(spark):
    rows = [(1, "und Und die", "de"), (1, "und the", "EN"), (1, "und the", "en"), (2, "and", "en"), (2, "and", "en"), (3, None, "de"),
            (None, "xx", "de"), (4, "zz", None), (5, "a1b2 ç", "fr")]
    languages, model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = {}
    for lang, words in (("de", ["und", "und", "die"]), ("en", ["und", "the", "and"]), ("fr", ["a", "b", "ç"])):
        for w in words:
            for i in range(len(w)):
                counts.setdefault((" " + w + " ")[i:i + 3], Counter())[lang] += 1
    total = {k: sum(c[k] for c in counts.values()) for k in ("de", "en", "fr")}
    assert languages == ["de", "en", "fr"] and model.keys() == counts.keys()
    for gram, c in counts.items():
        assert model[gram] == pytest.approx([math.log((c[k] + 0.5) / (total[k] + 0.5 * len(counts))) for k in languages])
    assert langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=0)[0] == []


def test_text_decides_where_there_is_enough(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    body = {k: f"<html lang=en><body>{' '.join([WORDS[k]] * 5)}" for k in WORDS}
    df = spark.createDataFrame([(k, "http://h.com/", b) for k, b in body.items()], "page_id string, url string, html string")
    assert all(r["page_id"] == r["lang"] == r["text_lang"] for r in langid.identify(df, docs).collect())


def test_empty_tables(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    df = spark.createDataFrame([(1, "http://a.de", "x")], "page_id long, url string, html string")
    assert langid.identify(df.limit(0), docs).collect() == []
    assert [r["lang"] for r in langid.identify(df, docs.limit(0)).collect()] == [None]


def test_visible_text():
    assert langid.visible_text("a<script>b<c</SCRIPT >d<!-- e --><style x>f</style>g<p q='1'>h&lt;i").split() == [
        "a", "d", "g", "h<i"]
    assert langid.visible_text("a<script>b").split() == ["a"] and langid.visible_text("a<!-- b").split() == ["a"]
