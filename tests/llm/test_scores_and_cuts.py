"""Toxicity, fill-in-the-middle and the filter audit against plain versions, and on odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from quotary.llm import fill_in_middle, filter_audit, toxicity

LINES = re.compile(r"[^\n]*\n|[^\n]+")


def cut(doc_id, text, seed=7, percent=100, spm_percent=50):
    """(n, form, prefix_chars, middle_chars, output) of one document."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i:i + 8], 16) for i in range(0, 32, 8)]
    text = text or ""
    u = LINES.findall(text)
    i, j = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(u), "plain", None, None, text
    p, m, s = "".join(u[:i]), "".join(u[i:j]), "".join(u[j:])
    if h[3] % 100 < spm_percent:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_unit_ends_in_words_of_eight_bytes():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab\né日𝄞 ") for _ in range(rng.randint(0, 60))) for _ in range(2000)] + ["", "\n", "\n" * 9, "x" * 8, "é" * 4]
    want = [LINES.findall(t) for t in texts]
    found = fill_in_middle.units([t.encode() for t in texts])
    assert found.counts.tolist() == [len(w) for w in want]
    k = np.array([rng.randint(0, len(w)) for w in want])
    ends = found.ends(k)
    assert ends.tolist() == [len("".join(w[:n]).encode()) for w, n in zip(want, k)]
    assert found.code_points(ends).tolist() == [len("".join(w[:n])) for w, n in zip(want, k)]
    nothing = fill_in_middle.units([b"", b""])
    assert nothing.counts.tolist() == [0, 0] and nothing.ends(np.array([0, 0])).tolist() == [0, 0]


@pytest.mark.parametrize(("percent", "spm"), [(100, 50), (60, 20)])
def test_fill_in_middle(spark, corpus, texts, percent, spm):
    made = fill_in_middle.fill_in_middle(corpus, percent=percent, spm_percent=spm).withColumn("back", fill_in_middle.restored())
    rows = {r.doc_id: r for r in made.collect()}
    assert set(rows) == set(texts)
    for doc_id, text in texts.items():
        r = rows[doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == cut(doc_id, text, percent=percent, spm_percent=spm)
        assert r.back == (text or "")
    assert {r.form for r in rows.values()} == {"psm", "spm", "plain"}


def test_fill_in_middle_of_odd_texts(spark):
    texts = ["a <P> b\nc", "<M>", "x<\nP>\ny<S", "\n", "\n\n", None, "", "long " * 400000 + "\nend", "\r\n", "日\n<", "S>\n<P"]
    rows = [(i, t) for i, t in enumerate(texts * 6)] + [(None, "a\nb\nc"), (None, "a\nb\nc"), (1, "x\ny")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("output", F.lit(1)).withColumn("form", F.lit("psm"))
    got = fill_in_middle.fill_in_middle(docs).withColumn("back", fill_in_middle.restored()).collect()
    want = Counter((d, *cut(d, t), t or "") for d, t in rows)
    assert Counter(tuple(r) for r in got) == want
    assert fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0


def failures(rows):
    """rows: (doc_id, text, part) -> the set of failed filters of each."""
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = []
    for d, t, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append({f for f, bad in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                                                  bool(re.search(r"[#$%&*|]", t)), d is not None and least[t] < d), strict=True) if bad})
    return out


def audited(rows, labels):
    """Each order applied to the documents one filter after the other."""
    failed, want, total = failures(rows), {}, defaultdict(int)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    for part in {p or "" for _, _, p in rows}:
        own = [(d, f) for (d, _, p), f in zip(rows, failed, strict=True) if (p or "") == part]
        for order in permutations("ABCDE"):
            left, gone = own, []
            for step, f in enumerate(order, 1):
                out, left = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                total[part, f] += len(out)
                want[part, "".join(order), step] = (len(left), len(out), sum(f in x[1] for x in gone), sum(x[1] == {f} for x in own),
                                                    sum(x[0] in good for x in out), sum(x[0] in toxic for x in out))
                gone = gone + out
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in want.items()}


def test_filter_audit(spark, corpus, texts):
    rows = [(r.doc_id, r.text, "ab"[r.doc_id % 2] if r.doc_id % 5 else None) for r in corpus.collect()]
    rng = random.Random(3)
    rows += [(d, t, rng.choice("abc")) for d, t, _ in rows[:20]] + [(None, "", "a"), (None, "", "a"), (None, rows[0][1], None), (None, None, "d"),
                                                                     (10 ** 6, "Shout " * 200 + "#", "c"), (10 ** 6, "Shout " * 200 + "#", "c")]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d, *_ in rows] + [(None, 1, 1), (10 ** 7, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({c: F.lit("x") for c in ("part", "mask", "n", "print", "good")})
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("text", F.lit(0))
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
           for r in filter_audit.audit(docs.repartition(5), marks).collect()}
    assert got == audited(rows, labels)
    assert len({v[-1] for v in got.values()}) > 8
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    no_labels = filter_audit.audit(docs, marks.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.sum("removed")).collect()[0]
    assert no_labels[:2] == (0, 0) and no_labels[2] > 0


def test_least_squares_are_shapley_values():
    rng = random.Random(2)
    for _ in range(20):
        v = np.array([0] + [rng.randint(0, 1000) for _ in range(31)])
        want = []
        for i in range(5):
            total = Fraction(0)
            for s in range(32):
                if not s >> i & 1:
                    size = bin(s).count("1")
                    total += Fraction(math.factorial(size) * math.factorial(4 - size), math.factorial(5)) * int(v[s | 1 << i] - v[s])
            want.append(total)
        assert filter_audit.shapley(v) == want


def _vectors(rng, n, width=9):
    out = []
    for _ in range(n):
        w = np.zeros(width)
        w[0] = rng.uniform(0.5, 3)
        for p in rng.choice(np.arange(1, width), int(rng.integers(0, 4)), replace=False):
            w[p] = rng.integers(1, 4)
        w /= np.linalg.norm(w)
        out.append(w)
    return out


@pytest.mark.parametrize("block", [1, 4, 64])
def test_block_max_search_is_exact(block):
    """Also with many ties and fewer entries than neighbours."""
    rng = np.random.default_rng(block)
    for n, k in ((3, 5), (60, 7), (300, 16)):
        dense = _vectors(rng, n)
        dense += dense[: n // 3]
        sparse = [(np.flatnonzero(w), w[np.flatnonzero(w)]) for w in dense]
        labels = rng.integers(0, 2, len(dense))
        index = toxicity.Index.build(sparse, labels, np.arange(len(dense)), 9, block)
        assert index.n.sum() == len(dense) and index.toxic.sum() == labels.sum()
        entries = np.zeros((index.n.size, 9))
        for e in range(index.n.size):
            place, w = index.vector(e)
            entries[e, place] = w
        for q in [*_vectors(rng, 40), *dense[:20]]:
            cosines = np.round(entries @ q, 9)
            top = np.lexsort((np.arange(cosines.size), -cosines))[:k]
            got, near = index.nearest(np.flatnonzero(q), q[np.flatnonzero(q)], k)
            assert np.allclose(near, cosines[top], atol=2e-9) and np.allclose(cosines[got], cosines[top], atol=2e-9)


def words_and_beginnings(text):
    out = Counter()
    for w in brute.MARK_WORDS.findall(brute.lower(text)):
        out[w, "word"] += 1
        for n in (3, 4, 5, 6):
            if len(w) > n:
                out[w[:n], "beginning"] += 1
    return out


def plain_scores(train, texts, k=16, most=512):
    """train: (doc_id, text, label). TF-IDF vectors, cosines with all of them, votes, leave-one-out line: no index."""
    counts = [(words_and_beginnings(t), y) for _, t, y in train]
    n = Counter(y for _, y in counts)
    seen = {y: Counter(w for c, own in counts if own == y for w in c) for y in (0, 1)}
    whole = n[0] + n[1]

    def ratio(a, b):
        pairs = ((a, (a + b) * n[1] / whole), (b, (a + b) * n[0] / whole), (n[1] - a, (whole - a - b) * n[1] / whole), (n[0] - b, (whole - a - b) * n[0] / whole))
        return 2 * sum(x * math.log(x / e) for x, e in pairs if x > 0)

    chosen = [w for w, a in seen[1].items() if a >= 3 and a * n[0] > seen[0][w] * n[1] and ratio(a, seen[0][w]) >= 20]
    assert 3 < len(chosen) <= most
    idf = {w: 1 + math.log((1 + whole) / (1 + seen[1][w] + seen[0][w])) for w in chosen}

    def vector(c):
        v = {w: math.sqrt(c[w]) * idf[w] for w in chosen if c[w]}
        n_words = sum(x for (_, kind), x in c.items() if kind == "word")
        v[""] = math.sqrt(n_words)
        size = math.sqrt(sum(x * x for x in v.values()))
        return tuple(sorted(((repr(w), round(x / size, 12)) for w, x in v.items()))) if n_words else None

    entries = defaultdict(list)
    for c, y in counts:
        if vector(c) is not None:
            entries[vector(c)].append(y)

    def voted(v, skip=None):
        own = []
        for e, ys in entries.items():
            ys = list(ys)
            if skip is not None and e == v:
                ys.remove(skip)
            if ys:
                other = dict(e)
                own.append((round(sum(x * other.get(w, 0) for w, x in v), 9), sum(ys) / len(ys)))
        own.sort(key=lambda x: -x[0])
        assert len(own) <= k or own[k - 1][0] > own[k][0] or skip is not None  # a tie at the last place would be the index's choice
        w = [1 / (0.01 + max(1 - c, 0)) for c, _ in own[:k]]
        return sum(x * s for x, (_, s) in zip(w, own)) / sum(w)

    votes = [(voted(e, y), y, ys.count(y)) for e, ys in entries.items() for y in set(ys)]
    line = toxicity.calibrated(np.array([v for v, _, _ in votes]), np.array([y * m for _, y, m in votes]), np.array([(1 - y) * m for _, y, m in votes]))
    out = []
    for t in texts:
        v = vector(words_and_beginnings(t))
        p = n[1] / whole
        if v is not None:
            raw = min(max(voted(v), 1e-3), 1 - 1e-3)
            p = 1 / (1 + math.exp(-(line[0] * math.log(raw / (1 - raw)) + line[1])))
        out.append(p)
    return out


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


@pytest.fixture(scope="module")
def insults():
    rng = random.Random(8)
    calm = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 9))) for _ in range(120)]
    out = []
    for i in range(260):
        w = [rng.choice(calm) for _ in range(rng.randint(5, 90))]
        bad = i % 4 == 0
        for _ in range(rng.randint(1, 6) if bad else rng.random() < 0.05):
            w.insert(rng.randrange(len(w)), rng.choice(["Vile", "gräss" + rng.choice(calm), "brute!"]))
        out.append((i, " ".join(w), int(bad)))
    return out


def test_toxicity_scores(spark, insults):
    texts = {i: t for i, t, _ in insults} | {1000: None, 1001: "", 1002: "vile " * 50000, 1003: "!?"}
    docs = spark.createDataFrame([*texts.items(), (None, "vile brute"), (None, "vile brute")], "doc_id bigint, text string").withColumns(
        {c: F.lit("x") for c in ("label", "toxic", "score", "vote", "place", "held_out")}).repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in insults] + [(None, 1), (5, None), (4, 0)], "doc_id bigint, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    want = plain_scores([x for x in insults if not held_out(x[0])], [*texts.values(), "vile brute", "vile brute"])
    scores = {r.doc_id: r.score for r in got if r.doc_id is not None}
    assert np.allclose([scores[i] for i in texts], want[:-2], atol=1e-6)
    assert np.allclose([r.score for r in got if r.doc_id is None], want[-2:], atol=1e-6)
    assert all(r.held_out == held_out(r.doc_id) and r.predicted == (r.score >= 0.7) for r in got)
    truth = {i: y for i, _, y in insults}
    assert np.mean([scores[i] >= 0.7 for i in truth if held_out(i) and truth[i]]) > 0.8
    assert np.mean([scores[i] >= 0.7 for i in truth if held_out(i) and not truth[i]]) < 0.1
    assert all(len(r.neighbours) == len(r.cosines) == 3 for r in got if r.doc_id in truth)


def test_toxicity_learns_nothing_from_held_out_labels(spark, insults):
    docs = spark.createDataFrame([x[:2] for x in insults], "doc_id bigint, text string")
    scores = []
    for turn in (0, 1):
        labels = spark.createDataFrame([(i, y ^ turn if held_out(i) else y) for i, _, y in insults], "doc_id bigint, toxic int")
        scores.append({r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).collect()})
    assert scores[0] == scores[1]


def test_toxicity_without_labels_of_both_classes(spark, insults):
    docs = spark.createDataFrame([x[:2] for x in insults[:20]], "doc_id bigint, text string")
    for given, share in (([], 0.5), ([(i, 1) for i, *_ in insults[:20]], 1.0), ([(i, 0) for i, *_ in insults[:20]], 0.0)):
        labels = spark.createDataFrame(given, "doc_id bigint, toxic int")
        assert {r.score for r in toxicity.score_toxicity(docs, labels).collect()} == {share}
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_toxicity_on_a_bounded_sample(spark, insults):
    docs = spark.createDataFrame([x[:2] for x in insults], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in insults], "doc_id bigint, toxic int")
    sample = toxicity._sample(docs, labels, F.lit(False), 80, "toxic", "doc_id", "text")
    assert 50 < sample.count() < 110
    assert toxicity.score_toxicity(docs, labels, examples=80).count() == len(insults)


def test_toxicity_of_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic = np.array([r.toxic for r in rows])
    score = np.array([r.score for r in rows])
    assert np.mean((score >= 0.7)[toxic == 1]) > 0.9 and np.mean((score >= 0.7)[toxic == 0]) < 0.005
    assert abs(score.mean() - toxic.mean()) < 0.01  # calibrated in the large


@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_filter_audit"])
def test_same_as_sql(spark, name):
    import duckdb

    from quotary.llm import queries

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    cursor = con.execute(queries.ORACLE[name])
    columns = [d[0] for d in cursor.description]
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == sorted(columns)
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(cursor.fetchall())
