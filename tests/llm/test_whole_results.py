"""Whole results of the fitted operators and of the pipeline against plain versions."""

import math
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from quotary.llm import packing, quality_classifier, quality_rules, secret_scan

FUNCTION_WORDS = set("the of and to in is that der die und das ist nicht den le la les et des de en que el los un du y a".split())


def votes(text):
    """The eight rules' votes: 0 good, 1 bad, 2 none."""
    text = text or ""
    n, chars, symbols, dup_lines, repeated = brute.rule_statistics(text)
    words = brute.SPACE_WORDS.findall(text)
    joined = "".join(words)
    lines = [x for x in text.split("\n") if brute.SPACE_WORDS.search(x)]
    if not n:
        return (1,) * 8

    def low(value, good, bad):
        return 1 if value >= bad else 0 if value <= good else 2

    upper, letters, bangs = (len(regex.findall(p, joined)) for p in (r"\p{Lu}", r"\p{L}", "!"))
    mean, function = chars / n, sum(w.lower() in FUNCTION_WORDS for w in words) / n
    return (1 if n < 50 else 0 if n >= 80 else 2, low(symbols / max(chars, 1), 0.01, 0.05), low(dup_lines / max(len(lines), 1), 0.1, 0.4),
            low(repeated / n, 0.2, 0.5), low(upper / max(letters, 1), 0.15, 0.4), low(bangs / n, 0.05, 0.3),
            1 if mean < 2 or mean > 15 else 0 if 3 <= mean <= 10 else 2, 1 if function < 0.02 else 0 if function > 0.08 else 2)


def plain_quality(texts, rounds=10):
    """{doc_id: (posterior, kept)}: expectation-maximisation with one row per document."""
    cast = {d: votes(t) for d, t in texts.items()}
    good = {d: 0.2 if 1 in v else 0.95 for d, v in cast.items()}
    for _ in range(rounds):
        weight = [sum(good.values()), sum(1 - g for g in good.values())]
        prior = (weight[0] + 1) / (sum(weight) + 2)
        chance = [[[1.0] * 3 for _ in range(8)] for _ in (0, 1)]
        for d, v in cast.items():
            for rule, vote in enumerate(v):
                chance[0][rule][vote] += good[d]
                chance[1][rule][vote] += 1 - good[d]
        chance = [[[x / (weight[c] + 3) for x in row] for row in chance[c]] for c in (0, 1)]
        for d, v in cast.items():
            odds = math.log(prior / (1 - prior)) + sum(math.log(chance[0][r][x] / chance[1][r][x]) for r, x in enumerate(v))
            good[d] = 1 / (1 + math.exp(-odds))
    out = {}
    for d, t in texts.items():
        n, _, _, _, repeated = brute.rule_statistics(t)
        out[d] = good[d], not (n < 50 or 100 * repeated > 50 * n) and good[d] >= 0.5
    return out


def test_quality_rules_whole(corpus, texts):
    want = plain_quality(texts)
    rows = {r.doc_id: r for r in quality_rules.score_documents(corpus).collect()}
    assert np.allclose([rows[d].quality for d in texts], [want[d][0] for d in texts], atol=1e-9)
    assert {d: r.kept for d, r in rows.items()} == {d: k for d, (_, k) in want.items()}
    assert {True, False} == {k for _, k in want.values()}


_OWNED = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


def plain_secrets(rows, owners=3, repositories=20):
    """rows: (doc_id, text, source), ids unique -> {doc_id: (spans, n_live, n_examples)}; and the live spans' places."""
    found = {}
    for d, text, _ in rows:
        text = text or ""
        spans = []
        for s in brute.secrets(text)[4]:
            kind, a, b = s.split(":")
            a, b = int(a), int(b)
            spans.append((kind, a, b, brute._ASSIGN.fullmatch(text[a:b])[2] if kind == "assign" else text[a:b]))
        for m in _OWNED.finditer(text):
            n = Counter(m[0])
            hard = -sum(k / len(m[0]) * math.log2(k / len(m[0])) for k in n.values()) >= 3
            mixed = any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])
            if hard and mixed and not any(a < m.end() and m.start() < b for _, a, b, _ in spans if _ is not None):
                spans.append(("owned", *m.span(), m[0]))
        found[d] = spans
    who, where = defaultdict(set), defaultdict(set)
    for d, _, source in rows:
        for *_, value in found[d]:
            who[value].add(source)
            where[value].add(d)
    live = {v for v in who if len(who[v]) < owners and len(where[v]) < repositories}
    rank = ("assign", "access", "hex", "owned").index
    out = {}
    for d, spans in found.items():
        kept = sorted((s for s in spans if s[0] != "owned" or s[3] in live), key=lambda s: (s[1], rank(s[0])))
        out[d] = ",".join("%s:%d:%d" % s[:3] for s in kept), sum(s[3] in live for s in spans), sum(s[3] not in live for s in spans)
    return out


def _with_keys(texts):
    """The fixture's texts with keys of all kinds of ownership put in."""
    rng = np.random.default_rng(9)
    letters = np.array(list("ABCDEFGHabcdefgh0123456789+/"))
    keys = ["".join(rng.choice(letters, 24)) for _ in range(12)] + ["A" * 30 + "1", "0123456789" * 3, "AKIA" + "Q" * 20, "abcdef0123456789" * 2]
    rows = []
    for i, (d, t) in enumerate(texts.items()):
        own = [keys[k] for k in range(len(keys)) if (k < 4 and i % 9 == k) or (4 <= k < 8 and i % (k * 7) == 1) or (k >= 8 and i % 5 == k % 5)]
        rows.append((d, t if t is None or i % 3 else f"{t}\n" + " ".join(f"é {k} token = {k}" if len(k) % 2 else k for k in own), f"s{i % 5}" if i % 11 else None))
    return rows


def test_secret_scan_whole(spark, texts):
    rows = _with_keys(texts)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    got = {r.doc_id: (r.spans, r.n_live, r.n_examples) for r in secret_scan.scan_secrets(docs).collect()}
    assert got == plain_secrets(rows)
    assert any("owned" in s for s, *_ in got.values()) and any(n for *_, n in got.values())


def plain_features(text):
    raw = (text or "").encode()
    words = [w.encode() for w in brute.SPACE_WORDS.findall(text or "")]
    n, home = len(words), sum(map(len, words))
    count = lambda chars: sum(raw.count(bytes([c])) for c in chars)
    share = lambda part, whole, weight, floor=0.01: math.log(part / (whole + weight) + floor)
    capitals, small = count(range(65, 91)), count(range(97, 123))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [math.log((home + 60) / (n + 10)), share(capitals, capitals + small, 20), share(count(b"#*$%&<>^~"), n, 10), share(count(b"!"), n, 10),
            share(count(b"0123456789"), home, 50), share(count(b".,;:?"), n, 10), share(count(b"|"), n, 10),
            share(sum(a == b for a, b in zip(words, words[1:])), n, 30), share(len(lines) - len(set(lines)), len(lines), 5, 0.2)]


def test_quality_classifier_whole(spark, corpus, texts):
    rng = np.random.default_rng(4)
    x = {d: np.array(plain_features(t)) for d, t in texts.items()}
    labels = [(d, int(v[0] + rng.normal() * 0.3 > 1.6)) for d, v in x.items() if d % 4]
    train = [(x[d], y) for d, y in labels if zlib.crc32(str(d).encode()) % 4 != 2]
    own = [np.array([v for v, y in train if y == c]) for c in (0, 1)]
    assert min(map(len, own)) > 5
    cov = [np.cov(v.T, bias=True) for v in own]
    pooled = sum(len(v) * c for v, c in zip(own, cov)) / len(train)
    density = []
    for v, c in zip(own, cov):
        s = 0.9 * c + 0.1 * pooled
        s = 0.95 * s + 0.05 * np.diag(np.diag(s)) + 1e-6 * np.eye(9)
        inverse, det = np.linalg.inv(s), np.linalg.slogdet(s)[1]
        density.append({d: math.log(len(v) / len(train)) - det / 2 - (z - v.mean(axis=0)) @ inverse @ (z - v.mean(axis=0)) / 2 for d, z in x.items()})
    want = {d: 1 / (1 + math.exp(min(max(density[0][d] - density[1][d], -700), 700))) for d in x}
    got = {r.doc_id: r for r in quality_classifier.score_quality(corpus, spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()}
    assert np.allclose([got[d].score for d in x], list(want.values()), atol=1e-6)
    assert all(r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())


@pytest.fixture(scope="module")
def tables(spark, texts, tmp_path_factory):
    """Documents of which some pass each stage and some do not, and a benchmark, as files."""
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = _with_keys(texts)
    base = next(t for _, t, _ in rows if t and 100 < len(t.split()) < 200)
    rows += [(20000 + i, base.replace(" ", f" w{i} ", 1) + f" tail{i}" * (i % 2), "s0") for i in range(6)]
    long = next(t for _, t, _ in reversed(rows) if t and 90 < len(t.split()) < 250 and t != base)
    items = [(1, " ".join(brute.MARK_WORDS.findall(brute.lower(long))[20:45])), (2, "no such words"), (None, None)]
    spark.createDataFrame([(d, t, "x", s, len(t or "")) for d, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(
        4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_pipeline_whole(spark, tables):
    from tokenizers import Tokenizer

    import corpus_pipeline

    folder, rows, items = tables
    texts, source = {d: t for d, t, _ in rows}, {d: s for d, _, s in rows}
    counts = [len(texts)]

    def left(keep):
        counts.append(sum(map(bool, keep.values())))
        return {d: t for d, t in texts.items() if keep[d]}

    texts = left({d: k for d, (_, k) in plain_quality(texts).items()})
    texts = left({d: r[2] for d, r in brute.near_duplicates(list(texts.items()), 5, 80).items()})
    texts = left({d: not r[4] for d, r in brute.decontamination(texts.items(), items).items()})
    assert all(a > b for a, b in zip(counts, counts[1:])) and counts[-1] > 5
    for d, (spans, *_) in plain_secrets([(d, t, source[d]) for d, t in texts.items()]).items():
        at, out = 0, ""
        for kind, a, b in (s.split(":") for s in spans.split(",") if s):
            if int(a) >= at:
                out += texts[d][at:int(a)] + "[SECRET]"
            at = max(at, int(b))
        texts[d] = out + texts[d][at:]
    assert any("[SECRET]" in t for t in texts.values())
    tokenizer, want = Tokenizer.from_file(packing.tokenizer_file()), {}
    for d, t in texts.items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        for k, i in enumerate(range(0, len(ids), 4096)):
            want[d, k] = i, len(ids[i:i + 4096]), zlib.crc32(np.array(ids[i:i + 4096], "<u4").tobytes())
    got = corpus_pipeline.run(spark, folder).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)


def test_pipeline_of_no_documents(spark, tables, tmp_path):
    import corpus_pipeline

    folder = tables[0]
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    spark.read.parquet(f"{folder}/documents.parquet").withColumn("text", F.lit(None).cast("string")).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0  # texts without words are below the least length
