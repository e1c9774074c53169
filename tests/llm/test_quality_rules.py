"""Base measures against Python, the binomial test against scipy-free sums."""

import math
import random
import re
from collections import Counter

import pytest

from ratecraft.llm import quality_rules as qr


def measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = Counter(zip(w, w[1:], w[2:], strict=False))
    repeat = set()
    for i, t in enumerate(zip(w, w[1:], w[2:], strict=False)):
        if runs[t] > 1:
            repeat.update((i, i + 1, i + 2))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(repeat))


def texts():
    rng = random.Random(4)
    out = [None, "", " \n\t ", "a", "a b", "a b c", "a b c a b c", "x " * 400, "é# ñ|\n" * 30, "\x0b\x0c a\r\nb"]
    for n in (5, 40, 60, 200, 900):
        for vocabulary in (2, 8, 3000):
            out.append("".join(f"{'wörd' if rng.random() < .1 else 'w'}{rng.randrange(vocabulary)}"
                               + rng.choice("  \n\t") for _ in range(n)))
    return out


def test_measures_match_python(docs):
    rows = [(i, t) for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in qr.measured(docs(rows)).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(t), t


@pytest.mark.parametrize("k,n,rate", [(0, 1, .01), (0, 100, .002), (3, 5000, .002), (40, 25000, .002),
                                      (3000, 1000000, .004), (5, 10, .9)])
def test_binomial_tail_is_exact(spark, k, n, rate):
    got = spark.range(1).selectExpr(qr.binomial_tail(f"{k}L", f"{n}L", rate) + " p").first().p
    want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1)
                        + j * math.log(rate) + (n - j) * math.log1p(-rate)) for j in range(k + 1))
    assert got == pytest.approx(want, rel=1e-6)


def _labelled(spark, docs, n):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, good + (" ## $$ || %%" if i % 5 == 0 else "")) for i in range(n)]
    labels = spark.createDataFrame([(i, 0 if i % 5 == 0 else 1) for i in range(n)] + [(None, 1), (n + 9, 1), (3, None)],
                                   "doc_id long, quality int")
    return docs(rows + [(None, None), (n + 1, "")]), labels


def test_cutoffs_reject_bad_documents_and_spare_good_ones(spark, docs, monkeypatch):
    d, labels = _labelled(spark, docs, 400)
    monkeypatch.setattr(qr, "RISK", 0.2)
    rows = qr.measured(d).withColumn("stratum", qr._stratum())
    cuts = qr.cutoffs(rows, labels, risk=0.5)
    assert cuts.first().cut_symbols == qr.RULES["symbols"][3][0]
    kept = {r.doc_id: r.kept for r in qr.verdicts(rows, cuts).collect()}
    assert all(kept[i] == (i % 5 != 0) for i in range(400))
    assert kept[None] is False and kept[401] is False


def test_few_labels_certify_nothing(spark, docs):
    d, labels = _labelled(spark, docs, 30)
    report = {r.doc_id: r for r in qr.quality_rules(d, labels).collect()}
    assert len(report) == 32 and all(report[i].kept for i in range(30))
    kept = qr.keep_good(d, labels)
    assert kept.columns == d.columns and kept.count() == 30
    assert qr.keep_good(d.where("doc_id < 0"), labels).count() == 0
    assert qr.quality_rules(d, labels.where("doc_id < 0")).count() == 32


def test_path_is_nested_and_ends_at_the_first_failure(spark, docs):
    for r, (_, _, high, grid) in qr.RULES.items():
        steps = qr.path(r)
        assert sorted(steps, reverse=high > 0) == steps and set(steps) == set(grid)
    # Good documents in four languages; a third of the German ones have symbols.
    rows, labels = [], []
    for k, (lang, n) in enumerate([("en", 900), ("de", 900), ("fr", 450), ("es", 300)]):
        for i in range(n):
            junk = i % 10 == 0
            mild = lang == "de" and i % 3 == 1
            text = " ".join(f"word{j}" for j in range(60)) + (" ####" * 30 if junk else " ####" if mild else "")
            rows.append((k * 1000 + i, text, lang))
            labels.append((k * 1000 + i, int(not junk)))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    measured = qr.measured(d).withColumn("stratum", qr._stratum())
    tests = {(r.stratum, r.step): r for r in qr.tests(measured, labels).collect()}
    assert all(abs(t.most_p - 0.05 / 4) < 1e-12 for t in tests.values())
    assert {s: tests[s, 0].missing for s in ("=en", "=de", "=fr", "=es")} == {"=en": 0, "=de": 0, "=fr": 32, "=es": 167}
    cuts = {r.stratum: r for r in qr.cutoffs(measured, labels).collect()}
    assert set(cuts) == {"=en", "=de"}
    # 4 symbols in some 354 letters: 0.0113; German steps stop before 0.01, English ones go on to words over 6 letters.
    assert (cuts["=de"].cut_symbols, cuts["=en"].cut_symbols) == (0.02, 0.002)
    kept = {r.doc_id: r.kept for r in qr.quality_rules(d, labels).collect()}
    for k, lang in enumerate(["en", "de", "fr", "es"]):
        for i in range(900 if k < 2 else 450 if k == 2 else 300):
            assert kept[k * 1000 + i] == (lang in ("fr", "es") or i % 10 != 0)


def test_junk_is_rejected_with_the_defaults(spark):
    """The labelled junk of the three languages with enough labels, none of the good documents beyond the risk."""
    sf = "/root/testdata/sf0.1"
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = qr.quality_rules(d, labels).join(d.select("doc_id", "lang"), "doc_id").join(labels, "doc_id").where("not base_failed")
    got = got.selectExpr("lang", "quality", "int(kept) AS kept").groupBy("lang", "quality").agg({"quality": "count", "kept": "sum"})
    n = {(r.lang, r.quality): (r["count(quality)"], r["sum(kept)"]) for r in got.collect()}
    for lang in ("en", "fr", "de"):
        assert n[lang, 0][0] > 20 and n[lang, 0][1] == 0
        assert n[lang, 1][0] - n[lang, 1][1] <= qr.RISK * n[lang, 1][0]
    assert n["es", 0][1] == n["es", 0][0]  # 307 good labels; 437 are needed
