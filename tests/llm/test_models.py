import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumspark.llm import language, lm_score, quality, queries

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    rows = queries.op6_compression_quality(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(rows) == docs.count() and rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.5)).all()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows.itertuples())
    m = labels.merge(rows, on="doc_id")
    m = m[m.held_out]
    assert (m.predicted == m.quality).mean() > 0.95
    # labels of held-out rows change nothing
    turned = spark.read.parquet(f"{SF}/labels.parquet").withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.scores(docs, quality.train(docs, turned)).toPandas()
    assert again.sort_values("doc_id").score.tolist() == rows.sort_values("doc_id").score.tolist()


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (7, 0, 1), (9, 1, 0), (None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.scores(odd_docs.withColumn("score", F.lit("x")), quality.train(odd_docs, labels)).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    none = quality.train(no_docs, labels.limit(0))
    assert {r.score for r in quality.scores(odd_docs, none).collect()} == {0.5}
    assert quality.scores(no_docs, none).count() == 0


def brute_quality(docs, labels):
    """The same scores in plain Python: rows by their hash, trained dictionaries, frame sizes, regression by gradient."""
    import struct

    import xxhash
    import zstandard

    def hashed(b):
        h = xxhash.xxh64_intdigest(b, seed=42)
        return h - 2**64 if h >= 2**63 else h

    texts, out = dict(docs), {}
    learn = {i: q for i, q in labels if q in (0, 1) and zlib.crc32(str(i).encode()) % 3 != 1}
    order = sorted(learn, key=lambda i: (hashed(struct.pack("<q", i)), i))
    picked = {q: [texts[i].encode()[: quality.MOST_BYTES] for i in order if learn[i] == q and texts.get(i)] for q in (0, 1)}
    sizes, plain = [], len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(b""))
    for q, n in ((1, quality.GOOD_ROWS), (0, quality.BAD_ROWS)):
        picked[q] = picked[q][: n + quality.FIT_ROWS]
        n = min(n, max(1, len(picked[q]) // 2))
        samples = [t[k : k + 1024] for t in picked[q][:n] for k in range(0, len(t), 1024)]
        try:
            words = zstandard.train_dictionary(quality.DICTIONARY_BYTES, samples)
        except zstandard.ZstdError:
            words = zstandard.ZstdCompressionDict(b"".join(picked[q][:n])[-quality.DICTIONARY_BYTES :])
        sizes.append(zstandard.ZstdCompressor(level=3, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False))
        picked[q] = picked[q][n : n + quality.FIT_ROWS] or picked[q]

    def features(b):
        parts = [b[k : k + quality.PIECE] for k in range(0, len(b), quality.PIECE)]
        good, bad = (sum(len(c.compress(x)) - plain for x in parts) for c in sizes)
        return [len(b) / (len(b) + quality.HALF), 10 * (bad - good) / (len(b) + quality.HALF)]

    x = np.array([features(b.decode("utf-8", "ignore").encode()) for q in (1, 0) for b in picked[q]])
    y = np.array([q for q in (1, 0) for _ in picked[q]])
    share = sum(learn.values()) / len(learn)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    w, offset = np.zeros(2), math.log(share / (1 - share))
    for _ in range(200_000):
        step = x.T @ (weight * (y - 1 / (1 + np.exp(-(offset + x @ w))))) - 1e-3 * w
        w += step * 0.02
        if np.abs(step).max() < 1e-9:
            break
    for i, t in docs:
        out[i] = 1 / (1 + math.exp(-max(-30, min(30, offset + float(np.dot(features((t or "").encode()), w))))))
    return out


def test_quality_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    want, got = brute_quality(docs, labels), queries.op6_compression_quality(spark, sf).collect()
    assert len(got) == len(want) and all(r.score == pytest.approx(want[r.doc_id], abs=1e-4) for r in got)


def test_quality_of_little_text_is_that_of_the_labels(spark):
    rows = [(i, "all good words stand here in a row " * 5 if i % 4 else "B@D!! W0RD$$ ### " * 9) for i in range(200)] + [(1000, ""), (1001, None), (1002, "x" * 70_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(bool(i % 4))) for i in range(200)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.scores(docs, model).collect()}
    share = 1 / (1 + math.exp(-model.prior))
    assert got[1000] == got[1001] == pytest.approx(share) and 0.6 < share < 0.9 and got[1] > 0.9 and got[4] < 0.1


def test_language_of_documents_and_pages(spark):
    rows = queries.op2_language_id(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().merge(rows, on="doc_id")
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas().merge(rows, on="page_id")
    assert len(docs) + len(pages) == len(rows) and (docs.lang == docs.language).mean() > 0.99 and docs.kept.mean() > 0.99
    assert (pages.html.str.extract('<html lang="(..)"')[0] == pages.language).mean() > 0.99


def test_language_fuses_its_evidence(spark):
    train = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([("the house and the garden are here", "en"), ("das haus und der garten sind hier", "de")] * 4)], "doc_id long, text string, lang string")
    model = language.train(train)
    rows = [
        (1, "the garden", None, "a.example.org"), (2, "der garten und das haus", None, "b.example.org"), (3, "", "de", None), (4, None, None, "x.firma.de"), (5, None, None, None), (6, "123 456", None, "b.example.org"),
        *[(10 + i, "das haus und der garten sind hier", None, "hot.example.net") for i in range(50)], (7, "gar", None, "hot.example.net"), (8, "the the", "de", None),
    ]
    df = spark.createDataFrame(rows, "id long, text string, m string, h string").withColumn("language", F.lit(0)).withColumn("prior", F.lit(1))
    got = {r.id: r for r in language.identify(df, model, "text", F.col("m"), F.col("h")).collect()}
    assert len(got) == len(rows) and got[1].prior == 1
    assert (got[1].language, got[2].language, got[3].language, got[4].language) == ("en", "de", "de", "de")
    assert got[3].language_kept and got[4].language_kept and not got[5].language_kept and not got[6].language_kept
    assert got[7].language == "de" and all(0 < r.posterior <= 1 for r in got.values())
    assert got[3].posterior > got[5].posterior


def test_host_priors_are_smoothed_as_written(spark):
    model = language.Model(["a", "b"], np.log(np.full((2, language.BUCKETS), 1 / language.BUCKETS)))
    rows = spark.createDataFrame([(i, "x", f"h{i % 2}.d.net") for i in range(6)], "id long, text string, h string")
    got = language.identify(rows, model, "text", None, F.col("h")).collect()
    assert {round(r.posterior, 6) for r in got} == {0.5} and {r.language for r in got} == {"a"}  # even evidence: ties go to the first


def brute_languages(rows, model):
    """The fusion in plain Python. rows: text, markup, host; returns language, posterior and kept of each."""
    langs, n = model.languages, len(model.languages)

    def triples(text):
        b = b" " + b" ".join((text or "").encode().lower().split()) + b" "
        return [((x * 0x9E3B + y * 0x85EB + z * 0xC2B3) * 0x27D4EB2F) % 2**32 >> 16 for x, y, z in zip(b, b[1:], b[2:], strict=False)]

    def chances(logs):
        e = [math.exp(x - max(logs)) for x in logs]
        return [x / sum(e) for x in e]

    said, own, hosts, domains, whole = [], [], {}, {}, [0.0] * n
    domain = lambda h: ".".join(h.split(".")[-2:]) if h and "." in h else None
    for text, _, host in rows:
        t = triples(text)
        letters = any(c.isalpha() for c in text or "")
        logs = [sum(row[x] for x in t) for row in model.table] + [max(1, len(t)) * language.NO_TRIPLE]
        logs = [x * language.MOST_TRIPLES / (language.MOST_TRIPLES + max(1, len(t))) for x in logs]
        said.append(logs if letters else [0.0] * (n + 1))
        own.append(chances(logs)[:n] if letters else [0.0] * n)
        for sums, key in ((hosts, host), (domains, domain(host))):
            if key:
                sums[key] = [x + y for x, y in zip(sums.get(key, [0.0] * n), own[-1], strict=True)]
        whole = [x + y for x, y in zip(whole, own[-1], strict=True)]
    out = []

    def smooth(sums, mine, parent):
        rest = [max(0.0, x - y) for x, y in zip(sums, mine, strict=True)]
        size = sum(x - y for x, y in zip(sums, mine, strict=True))
        return [(x + language.SMOOTHING * p) / (size + language.SMOOTHING) for x, p in zip(rest, parent, strict=True)]

    for (text, markup, host), logs, mine in zip(rows, said, own, strict=True):
        prior = [max(0.0, x - y) + 1 for x, y in zip(whole, mine, strict=True)]
        prior = [x / sum(prior) for x in prior]
        if domain(host):
            prior = smooth(domains[domain(host)], mine, prior)
        if host:
            prior = smooth(hosts[host], mine, prior)
        fused = [math.log(p * (1 - language.NO_LANGUAGE)) + x for p, x in zip(prior, logs, strict=False)] + [math.log(language.NO_LANGUAGE) + logs[n]]
        country = language.SUFFIX_LANGUAGE.get(host.split(".")[-1]) if domain(host) else None
        known = 0
        for value, trust in ((markup, language.MARKUP_TRUST), (country, language.SUFFIX_TRUST)):
            if value in langs:
                known += 1
                fused = [x + (math.log(trust) if k == value else math.log((1 - trust) / (n - 1))) for x, k in zip(fused, langs, strict=False)] + [fused[n] - math.log(n)]
        c = chances(fused)
        best = max(c[:n])
        p = best / sum(c[:n])
        evidence = any(x.isalpha() for x in text or "") or known
        out.append((langs[c.index(best)], p, bool(evidence and p >= 0.5 and c[n] < 0.5)))
    return out


def same_languages(got, want):
    assert len(got) == len(want)
    for (lang, p, kept), (lang2, p2, kept2) in zip(got, want, strict=True):
        assert p == pytest.approx(p2, abs=1e-6) and (lang == lang2 or p < 0.5 + 1e-6) and (kept == kept2 or abs(p - 0.5) < 1e-6), (lang, p, kept, lang2, p2, kept2)


def test_language_query_equals_brute_force(spark, sf):
    docs, pages = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "pages"))
    html = F.col("html")
    pages = [tuple(r) for r in pages.select("page_id", language.visible_text(html), language.declared_language(html), language.host_of(F.col("url"))).collect()]
    rows = [(f"d{r.doc_id}", r.text, None, r.source) for r in docs.collect()] + [(f"p{r[0]}", *r[1:]) for r in pages]
    want = brute_languages([r[1:] for r in rows], language.train(docs))
    got = {f"d{r.doc_id}" if r.doc_id is not None else f"p{r.page_id}": (r.language, r.posterior, r.kept) for r in queries.op2_language_id(spark, sf).collect()}
    same_languages([got[r[0]] for r in rows], want)


def test_language_of_odd_rows_equals_brute_force(spark, odd_docs):
    train = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.train(train)
    hosts = ["a.firma.de", "b.firma.de", "x", None, "a.firma.de", "shop.example.fr", "", "x.co.uk", "a.firma.de", "b.firma.de", "solo.es", "x"]
    marks = [None, "de", "en", "xx", None, "fr", "es", None, None, "de", None, ""]
    rows = [(i, r.text, m, h) for i, (r, m, h) in enumerate(zip(odd_docs.collect(), marks, hosts, strict=True))]
    df = spark.createDataFrame(rows, "__prior int, __h string, own string, domain_sums string").withColumn("best", F.lit(1))
    got = {r["__prior"]: (r.language, r.posterior, r.language_kept) for r in language.identify(df, model, "__h", F.col("own"), F.col("domain_sums")).collect()}
    same_languages([got[r[0]] for r in rows], brute_languages([(t, m, h or None) for _, t, m, h in rows], model))


def test_a_rows_own_text_counts_once(spark):
    train = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([("the house and the garden are here", "en"), ("das haus und der garten sind hier", "de")] * 4)], "doc_id long, text string, lang string")
    rows = spark.createDataFrame([(1, "gar", "lone.example.org"), (2, "gar", None)], "id long, text string, h string")
    got = {r.id: r.posterior for r in language.identify(rows, language.train(train), "text", None, F.col("h")).collect()}
    assert got[1] == pytest.approx(got[2], abs=1e-9)


def test_unlearned_languages_and_random_letters_are_refused(spark):
    import random

    r = random.Random(4)
    train = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(train)
    noise = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)) for _ in range(30)] + ["Это совсем другой язык, которого здесь никто не учил " * 4] * 5
    rows = spark.createDataFrame(list(enumerate(noise)), "id long, text string")
    assert not any(x.language_kept for x in language.identify(rows, model).collect())
    own = language.identify(train, model, "text", None, F.col("source"))
    assert own.where("language_kept and language = lang").count() >= 0.99 * train.count()


def test_seventy_languages_are_all_learned(spark):
    import random

    r = random.Random(5)
    words = {f"l{k:02d}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for k in range(70)}
    rows = [(i, " ".join(r.choices(w, k=40)), k) for i, (k, w) in enumerate([(k, w) for k, w in words.items() for _ in range(3)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df, rows=2)
    assert model.languages == sorted(words)
    assert language.identify(df, model).where("language <> lang").count() == 0


def test_long_texts_are_summed_in_parts(spark, monkeypatch):
    """Texts longer than one part give what they give whole, and are learned from in part."""
    texts = ["the house and the garden " * 3000, "das haus und der garten " * 50_000, "x" * 300, "", None]
    df = spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = language.train(df)
    whole = {r.doc_id: r.likelihood for r in language.text_likelihoods(df, model).collect()}
    monkeypatch.setattr(language, "AT_ONCE", 100)
    from vellumspark.llm.language import _sums, _text_bytes

    x = [_text_bytes(t) for t in texts]
    parts = [sum(_sums(model.table, [b[at : at + 102]])[0] for at in range(0, max(1, len(b) - 2), 100)) for b in x]
    assert np.allclose(np.array(parts), _sums(model.table, x))
    cut = {r.doc_id: r.likelihood for r in language.text_likelihoods(df, model).collect()}
    assert all(np.allclose(whole[i], cut[i]) for i in whole) and len(whole) == 5


def test_language_of_nothing(spark, no_docs, odd_docs):
    model = language.train(no_docs)
    assert model.languages == ["und"]
    rows = language.identify(odd_docs, model, "text", None, F.col("source")).collect()
    assert len(rows) == 12 and {r.language for r in rows} == {"und"}
    assert language.identify(no_docs, language.train(odd_docs), "text", None, F.col("source")).count() == 0


def test_lm_tells_quality(spark):
    rows = queries.op10_lm_score(spark, SF).toPandas()
    m = spark.read.parquet(f"{SF}/labels.parquet").toPandas().merge(rows, on="doc_id")
    rank = m.score.rank()
    good = m.quality == 1
    n = good.sum()
    assert (rank[good].sum() - n * (n + 1) / 2) / (n * (~good).sum()) > 0.75


def test_lm_of_odd_rows(spark, odd_docs, no_docs):
    targets = spark.createDataFrame([(1,), (1,), (None,), (99,)], "doc_id long")
    rows = lm_score.cross_entropy_difference(odd_docs.withColumn("score", F.lit("x")), targets).collect()
    assert len(rows) == 12
    for r in rows:
        assert math.isfinite(r.score) and (r.n_tokens > 0 or r.score == 0)
    assert lm_score.cross_entropy_difference(odd_docs, targets.limit(0)).count() == 12
    assert lm_score.cross_entropy_difference(no_docs, targets).count() == 0


def exact_losses(docs, target):
    """The same models from counts of real words and pairs."""
    uni, bi, total, texts = ([Counter(), Counter()] for _ in range(4))

    def grams(words):
        return list(zip([None, *words], words, strict=False))

    def count(m, words, sign):
        for h, w in grams(words):
            uni[m][w] += sign
            bi[m][h, w] += sign
        total[m][0] += sign * len(words)
        texts[m][0] += sign * bool(words)

    docs = [(d, (t or "").lower().split()) for d, t in docs]
    for d, words in docs:
        for m in range(1 + (d in target)):
            count(m, words, 1)
    size, out = len(uni[0]), []
    scale = [total[1][0] / total[0][0] if total[1][0] else 1.0, 1.0]
    for d, words in docs:
        loss = []
        for m in (0, 1):
            mine = m <= (d in target)
            if mine:
                count(m, words, -1)
            n = 0.0
            for h, w in grams(words):
                k = scale[m]
                u = (k * uni[m][w] + lm_score.UNIFORM) / (k * total[m][0] + lm_score.UNIFORM * size)
                n -= math.log((k * bi[m][h, w] + lm_score.BACKOFF * u) / (k * (texts[m][0] if h is None else uni[m][h]) + lm_score.BACKOFF))
            loss.append(n / max(1, len(words)))
            if mine:
                count(m, words, 1)
        out.append((str(d), len(words), round(loss[1], 8), round(loss[0], 8)))
    return sorted(out)


def as_exact(rows):
    assert all(r.score == pytest.approx(r.background_loss - r.target_loss) for r in rows)
    return sorted((str(r.doc_id), r.n_tokens, round(r.target_loss, 8), round(r.background_loss, 8)) for r in rows)


def near(got, want):
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2:] for x in got], [x[2:] for x in want], atol=3e-8)


def test_registered_lm_scores_count_every_word_and_pair(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    target = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("quality = 1").collect()}
    near(as_exact(queries.op10_lm_score(spark, "/root/testdata/sf0.001").collect()), exact_losses(docs, target))


def test_exact_lm_of_many_blocks_and_odd_rows(spark, odd_docs, no_docs):
    targets = spark.createDataFrame([(1,), (1,), (None,), (99,)], "doc_id long")
    want = exact_losses([(r.doc_id, r.text) for r in odd_docs.collect()], {1})
    for rows in (odd_docs.coalesce(1), odd_docs.repartition(5)):
        near(as_exact(lm_score.cross_entropy_difference(rows.withColumn("score", F.lit("x")), targets).collect()), want)
    none = lm_score.cross_entropy_difference(odd_docs, targets.limit(0)).collect()
    near(as_exact(none), exact_losses([(r.doc_id, r.text) for r in odd_docs.collect()], set()))
    assert lm_score.cross_entropy_difference(no_docs, targets).count() == 0


def test_lm_frees_the_first_shuffle_before_the_second(spark, monkeypatch):
    """Of the two shuffles, each about as large as the input, only one lies on the disks at a time."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {int(m[1]) for m in re.finditer(r"shuffle_(\d+)_\d+_\d+\.data", manager.getAllFiles().mkString(" "))}

    docs = spark.createDataFrame([(i, f"some words and word{i} here {i % 7}") for i in range(400)], "doc_id long, text string").repartition(4, "doc_id")
    found, inner, write = [], lm_score._totals, lm_score.stored

    def totals(*args):
        before = shuffles()
        out = inner(*args)
        found.append(shuffles() - before)
        return out

    def stored(df, name):
        if name == "lm-scores":
            time.sleep(1)
            found.append(found[0] & shuffles())
        return write(df, name)

    monkeypatch.setattr(lm_score, "_totals", totals)
    monkeypatch.setattr(lm_score, "stored", stored)
    assert lm_score.cross_entropy_difference(docs, docs.select("doc_id").limit(9)).count() == 400
    assert found[0] and not found[1]


def test_kept_texts_pass_one_worker(spark, sf):
    """Where the text is kept, one step scores and fuses; the sums get no column of the rows but the host."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = language.identify(docs, language.train(docs), "text", None, F.col("source"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    apart = language.identify(docs, language.train(docs), "text", None, F.col("source"), keep=["doc_id"])
    near = {r.doc_id: r.posterior for r in apart.collect()}
    assert all(abs(near[r.doc_id] - r.posterior) < 1e-9 for r in found.collect())
