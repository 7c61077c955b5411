"""The two trained operators, number by number, against plain readings of their definitions."""

import math
import random

import pytest

pytest.importorskip("public_tokenizers")

import numpy as np  # noqa: E402
from test_text_operators import DOCS, written  # noqa: E402
from vicinity.llm import language, quality  # noqa: E402


def sites_by_hand(rows, base):
    """site_docs, host_prior and site_prior of each (host, path), from the evidence of all rows."""
    good = {}
    for host, path, e in rows:
        good.setdefault((host, path), []).append(1 / (1 + math.exp(-(e + base))))
    hosts = {}
    for (host, _), values in good.items():
        hosts.setdefault(host, []).extend(values)
    everything = [v for values in good.values() for v in values]
    overall = sum(everything) / len(everything)

    def strength(groups):
        """groups: (number of documents, mean, prior)."""
        docs = sum(n for n, _, _ in groups)
        unit = sum(n * p * (1 - p) for n, _, p in groups)
        if len(groups) < 2 or not unit:
            return quality.MOST_STRENGTH
        within = unit / docs
        off = sum(n * (m - p) ** 2 for n, m, p in groups)
        between = (off - (len(groups) - 1) * within) / (docs - sum(n * n for n, _, _ in groups) / docs + 1e-9)
        return min(max(within / between - 1, quality.LEAST_STRENGTH), quality.MOST_STRENGTH) if between > 0 else quality.MOST_STRENGTH

    k = strength([(len(v), sum(v) / len(v), overall) for v in hosts.values()])
    host_prior = {h: (sum(v) + k * overall) / (len(v) + k) for h, v in hosts.items()}
    k = strength([(len(v), sum(v) / len(v), host_prior[h]) for (h, _), v in good.items()])
    return {(h, p): (len(v), host_prior[h], (sum(v) + k * host_prior[h]) / (len(v) + k)) for (h, p), v in good.items()}


def test_quality_by_hand(spark):
    r = random.Random(11)
    rows = [(i, written(r, r.random() < (0.1, 0.3, 0.6)[i % 3]), r.choice(["en", "de", None]), f"host{i % 3}" if i % 17 else None, 1, "", "")
            for i in range(400)] + [(1000, None, "en", "rare", 1, "", ""), (3, "again.", "en", "host0", 1, "", "")]
    known = {i: int(" | " not in rows[i][1] and "!!" not in rows[i][1] and "Buy" not in rows[i][1]) if r.random() > 0.1 else r.randint(0, 1) for i in range(0, 400, 2)}
    whole = spark.createDataFrame(rows, DOCS).repartition(3)
    labels = spark.createDataFrame([(i, y, 0) for i, y in known.items()] + [(None, 1, 0), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(whole, labels).collect()

    train = sorted((float(known[i]), quality.features(t or "")) for i, t, *_ in rows if i in known)
    model = quality.Classifier(np.array([x for _, x in train]), np.array([y for y, _ in train]))
    evidence = {(i, t): float(model.evidence(np.array([quality.features(t or "")]))[0]) for i, t, *_ in rows}
    sites = sites_by_hand([(h, p, evidence[i, t]) for i, t, p, h, *_ in rows], model.prior)
    assert len(got) == len(rows)
    for x in got:
        docs, host, site = sites[x["source"], x["lang"]]
        e = evidence[x["doc_id"], x["text"]]
        posterior = 1 / (1 + math.exp(-(e + math.log(site / (1 - site)))))
        assert x["site_docs"] == docs
        assert [x["evidence"], x["host_prior"], x["site_prior"], x["posterior"]] == pytest.approx([e, host, site, posterior], rel=1e-9)
        assert x["keep"] == (posterior >= quality.KEEP_FROM)


def language_by_hand(rows, weights_from):
    """Prediction and score of each text: every bit's log ratios from mean shares, then the nearest codeword."""
    shares, names = {}, sorted({lang for _, lang in weights_from})
    for name in names:
        total = {}
        texts = [language.grams(t).tolist() for t, lang in weights_from if lang == name]
        for found in texts:
            for g in found:
                total[g] = total.get(g, 0.0) + 1 / len(found)
        scale = 1e6 / sum(total.values())
        all_slots = 1e6 + 0.1 * language.SLOTS
        shares[name] = lambda g, total=total, scale=scale, all_slots=all_slots: (total.get(g, 0.0) * scale + 0.1) / all_slots
    code = language.codewords(len(names))

    def margins(text):
        found, out = language.grams(text).tolist(), []
        for bit in range(code.shape[1]):
            ones = [shares[n] for n, c in zip(names, code[:, bit]) if c > 0]
            zeros = [shares[n] for n, c in zip(names, code[:, bit]) if c < 0]
            total = sum(math.log((sum(s(g) for s in ones) / len(ones)) / (sum(s(g) for s in zeros) / len(zeros))) for g in found)
            out.append(total / math.sqrt(len(found)))
        return out

    right = [0] * code.shape[1]
    for text, lang in weights_from:
        for bit, m in enumerate(margins(text)):
            right[bit] += (m > 0) - (m < 0) == code[names.index(lang)][bit]
    weights = [max(n / len(weights_from) - 0.5, 0.01) * 2 for n in right]
    out = []
    for text in rows:
        m = margins(text)
        loss = [sum(w * math.log1p(math.exp(-c * x)) for w, c, x in zip(weights, word, m)) / sum(weights) for word in code]
        best = min(range(len(names)), key=lambda i: loss[i])
        odds = sum(math.exp(-(v - loss[best]) * code.shape[1]) for v in loss)
        close = sorted(loss)[1] - loss[best] < language.AMBIGUOUS
        out.append((names[best], 1 / odds, close))
    return out


def test_language_by_hand(spark):
    """Languages that share words, so that margins, weights and near codewords matter."""
    r = random.Random(12)
    words = {"aa": ["kala", "mila", "soto"], "bb": ["kala", "brzn", "vlck"], "cc": ["soto", "eaux", "vlck"], "dd": ["mila", "eaux", "nuri"]}
    table = []
    for i in range(160):
        lang = r.choice(list(words))
        table.append((i, " ".join(r.choice(words[lang]) for _ in range(r.randint(1, 5))), lang, "s", 1, "", ""))
    got = {x["doc_id"]: x for x in language.identify(spark.createDataFrame(table, DOCS).repartition(3)).collect()}
    train = [(t, lang) for i, t, lang, *_ in table if not got[i]["held_out"]]
    want = language_by_hand([t for _, t, *_ in table], train)
    assert {w[0] for w in want} == set(words) and any(w[2] for w in want)
    for (i, *_), (lang, score, close) in zip(table, want):
        assert got[i]["lang_pred"] == lang and got[i]["ambiguous"] == close
        assert got[i]["score"] == pytest.approx(score, rel=1e-3)
