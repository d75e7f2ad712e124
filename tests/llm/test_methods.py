"""What the methods decide beyond their contracts, against brute force: templates, the classifier's fit, notices."""

import collections
import random
import re
import time

import numpy as np
import regex
from corpora import in_fold_one, prose, write
from test_operators import multiset, words

from tessera.llm import op05_url_templates as op5
from tessera.llm import op07_nbsvm_quality as op7
from tessera.llm import op10_license_notices as op10

# ---- Templates


def judged(pages):
    """(page_id, verdict, purity) of pages whose trees stay below the wildcard of rare segments."""
    rows = []
    for page, url in pages:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        host, path = m[1].lower(), m[2]
        fit = max((r for r in op5.RULES if (host == r[1].split("/")[0] or host.endswith("." + r[1].split("/")[0])) and path.startswith("/" + r[1].split("/", 1)[1])), key=lambda r: len(r[1]), default=None)
        shape = tuple("*" if re.match(op5._VARIABLE, x.lower()) else x for x in path[1:].split("/", 3))
        rows.append((page, host, shape, fit and fit[0]))
    label = lambda v: {"block": 1, "allow": 0}.get(v)
    name = {}
    for depth in range(4):
        groups = collections.defaultdict(lambda: collections.defaultdict(list))
        for _, host, shape, v in rows:
            if len(shape) > depth:
                groups[host, name.get((host, shape), ())][shape[depth]].append(label(v))
        renamed = {}
        for (host, above), children in groups.items():
            assert len(children) <= op5.MANY
            known = {seg: [x for x in v if x is not None] for seg, v in children.items()}
            total, blocks = sum(map(len, known.values())), sum(map(sum, known.values()))
            for seg, v in known.items():
                n, others = len(v), total - len(v)
                if seg == "*" or not n or not others:
                    renamed[host, above, seg] = seg
                    continue
                p = blocks / total
                spread = (p * (1 - p) * (1 / n + 1 / others)) ** 0.5
                renamed[host, above, seg] = seg if abs(sum(v) / n - (blocks - sum(v)) / others) > op5.Z * spread else "+"
        for _, host, shape, _ in rows:
            above = name.get((host, shape), ())
            if len(shape) > depth and len(above) == depth:
                name[host, shape] = (*above, renamed[host, above, shape[depth]])
    out = []
    for page, host, shape, v in rows:
        labels = host.split(".")
        above = op5.PRIOR_BLOCKS / op5.PRIOR_LABELS
        for k in range(min(len(labels), op5.LEVELS) + 1):
            domain = ".".join(labels[len(labels) - k :])
            some = [label(r[3]) for r in rows if r[2] == shape and (not k or r[1] == domain or r[1].endswith("." + domain)) and r[3]]
            above = (sum(some) + op5.PRIOR_LABELS * above) / (len(some) + op5.PRIOR_LABELS)
        own = [label(r[3]) for r in rows if r[1] == host and name[r[1], r[2]] == name[host, shape] and r[3]]
        purity = (sum(own) + op5.PRIOR_LABELS * above) / (len(own) + op5.PRIOR_LABELS)
        out.append((page, v or ("block" if purity >= op5.REJECT else "allow"), round(purity, 9)))
    return out


def test_templates_decide_pages_that_no_rule_fits(spark):
    rng = random.Random(9)
    pages = []
    for k in range(400):
        host = rng.choice(["a.", "b.", "www.c."]) + rng.choice(["example.com", "example.net", "example.org", "other.org"])
        pages.append((k, f"http://{host}/{rng.choice(['de', 'en', 'fr', 'es'])}/{rng.choice(['news/', 'x/y/', ''])}{rng.randrange(9000)}{rng.choice(['.html', '', '?q=1'])}"))
    got = op5.judge(op5.Scratch(spark), spark.createDataFrame(pages, "page_id long, url string")).collect()
    want = judged(pages)
    assert multiset((r["page_id"], r["verdict"], round(r["purity"], 9)) for r in got) == multiset(want)
    free = collections.Counter(r["verdict"] for r in got if r["rule"] is None)
    assert free["block"] > 10 and free["allow"] > 10


def test_very_long_and_deep_urls(spark):
    pages = [(1, "http://x.org/" + "a" * 100_000), (2, "http://x.org/" + "a/" * 5000), (3, "http://" + "h." * 3000 + "net/de"), (None, None)]
    got = {r["page_id"]: r for r in op5.judge(op5.Scratch(spark), spark.createDataFrame(pages, "page_id long, url string")).collect()}
    assert got[1]["template"] == "/*" and got[3]["verdict"] == "block" and got[None]["verdict"] == "allow" and len(got) == 4


# ---- Classifier


def test_dual_coordinate_descent_reaches_the_least_loss():
    rng = np.random.default_rng(4)
    rows = [np.sort(rng.choice(12, 4, replace=False)) for _ in range(40)]
    values = [rng.normal(size=4) for _ in rows]
    y, cost = np.where(rng.random(40) < 0.5, 1.0, -1.0), rng.uniform(0.5, 2, 40)
    x = np.zeros((40, 13))
    for k, (r, v) in enumerate(zip(rows, values, strict=True)):
        x[k, r], x[k, 12] = v, 1
    loss = lambda w: w @ w / 2 + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    w = op7.dual_coordinate_descent(rows, values, y, cost, 2000, 12)
    alpha, gram = np.zeros(40), (y[:, None] * x) @ (y[:, None] * x).T
    for _ in range(60_000):  # projected gradient on the whole dual
        alpha = np.clip(alpha - (gram @ alpha - 1) / np.linalg.norm(gram, 2), 0, cost)
    best = loss((alpha * y) @ x)
    assert loss(w) <= best * 1.01 + 1e-6


def plain_features(text):
    """The indicators by their meaning: words, pairs of words, runs of one to three shapes."""
    w = re.findall(r"[^ \t\n\x0b\x0c\r]+", text)
    kind = lambda c: 1 if ord(c) >= 128 or c in "abcdefghijklmnopqrstuvwxyz" else next((b for s, b in (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 4), (".,;:", 8), ("|", 16), ("#$%&*@^~<>", 32), ("!?", 64)) if c in s), 128)
    shape = [frozenset(map(kind, x)) for x in w]
    one = [(s, k > 0 and w[k] == w[k - 1]) for k, s in enumerate(shape)]
    return {("w", x) for x in w} | {("ww", *p) for p in zip(w, w[1:], strict=False)} | {("s", *one[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)}


def test_features_are_the_ngrams():
    texts = ["a b a b", "Hello, World!! 12", "", "é é é x|y ##", "one two two three"]
    buckets, counts = op7.features(texts)
    assert counts.tolist() == [len(plain_features(t)) for t in texts]
    parts = np.split(buckets, np.cumsum(counts)[:-1])
    alone = [op7.features([t])[0] for t in texts]
    assert all((p == a).all() for p, a in zip(parts, alone, strict=True))
    a, b = (set(op7.features([t])[0].tolist()) for t in ("a b c", "b c a"))
    assert len(a & b) == len(plain_features("a b c") & plain_features("b c a"))


def corpus_of_two(rng, n):
    return [(k, prose(rng, rng.randrange(20, 60)) if k % 3 else " | ".join(w + "###" for w in prose(rng, rng.randrange(20, 60)).split())) for k in range(n)]


def test_repeated_labelled_documents_and_bytes_change_nothing(spark, tmp_path):
    rows = corpus_of_two(random.Random(2), 150)
    labels = [(k, int(k % 3 != 0), 0) for k in range(0, 150, 2)]
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    one = {r["doc_id"]: r["score"] for r in op7.query(spark, write(tmp_path / "a", rows, labels=labels)).collect()}
    two = op7.query(spark, write(tmp_path / "b", rows + rows[:40] * 3, labels=labels + labels)).collect()
    assert len(two) == 270 and all(abs(r["score"] - one[r["doc_id"]]) < 1e-9 for r in two)
    docs, known = (spark.read.parquet(str(tmp_path / "a" / f"{x}.parquet")) for x in ("documents", "labels"))
    few = op7.train(docs, known, most_bytes=4000)
    assert np.isfinite(few.margins(*op7.features([rows[1][1]]))).all()


def test_fit_by_rows_equals_the_query(spark, tmp_path):
    """The model from plain rows, and its scores one text at a time."""
    rows = corpus_of_two(random.Random(6), 120) + [(None, "alpha"), (900, None)]
    labels = [(k, int(k % 3 != 0), 0) for k in range(0, 120, 2)]
    got = {r["doc_id"]: r["score"] for r in op7.query(spark, write(tmp_path, rows, labels=labels)).collect()}
    known = {k: y for k, y, _ in labels if not in_fold_one(k)}
    seen = sorted((op7.features([t])[0].astype(np.uint32).tobytes(), known[d]) for d, t in rows if d in known)
    model = op7.fit([np.frombuffer(b, np.uint32).astype(np.int64) for b, _ in seen], np.array([y for _, y in seen]))
    assert all(abs(got[d] - float(model.scores(*op7.features([t or ""]))[0])) < 1e-6 for d, t in rows)


def test_keep_good_leaves_rows_as_they_are(spark, tmp_path):
    rows = corpus_of_two(random.Random(2), 90) + [(1, "alpha1 beta2 gamma3 alpha4 beta5")] * 2 + [(None, prose(random.Random(1), 30)), (901, None)]
    folder = write(tmp_path, rows, labels=[(k, int(k % 3 != 0), 0) for k in range(0, 90, 2)])
    docs = spark.read.parquet(folder + "/documents.parquet")
    kept = op7.keep_good(spark, docs, folder)
    assert kept.schema == docs.schema
    scores = {r["doc_id"]: r["score"] for r in op7.query(spark, folder).collect()}
    want = [(d, t) for d, t in rows if d == 1 or scores[d] >= 0.5]
    got = [(r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect()]
    assert multiset(x for x in got if x[0] != 1) == multiset(x for x in want if x[0] != 1) and 40 < len(got) < 90
    none = write(tmp_path / "none" if (tmp_path / "none").mkdir() is None else tmp_path)
    assert op7.keep_good(spark, spark.read.parquet(none + "/documents.parquet"), none).count() == 0


# ---- Notices


def test_notices_equal_a_search_of_the_whole_text():
    """Labels, spans and errors of one planted notice a text, against the library's search without seeds."""
    rng = random.Random(3)
    for text, label in op10.NOTICES:
        notice = op10.Notice(text, label)
        for _ in range(8):
            t = list(text)
            for _ in range(rng.randrange(0, notice.errors + 1)):
                k = rng.randrange(len(t))
                t[k : k + 1] = rng.choice([["q"], [t[k], "z"]])
            whole = f"{prose(rng, 6)} {''.join(t)} {prose(rng, 6)}"
            n, places, spans = op10.scan_text(whole, [], [notice])
            flat = " " + " ".join(words(whole)) + " "
            m = regex.search(r"(?b)(?:%s){e<=%d}" % (regex.escape(text, literal_spaces=True), notice.errors), flat)
            assert n == len(words(whole)) and len(spans) == bool(m)
            if m:
                assert (spans[0]["label"], spans[0]["errors"]) == (label, sum(m.fuzzy_counts))
                assert spans[0]["first"] == 6 and spans[0]["score"] == 1 - sum(m.fuzzy_counts) / len(text)


def test_places_take_time_in_proportion():
    own = [(b" cc by ", "cc-by")]
    times = []
    for n in (20_000, 200_000):
        start = time.time()
        count, places, _ = op10.scan_text("cc by " * n, own, [op10.Notice(*x) for x in op10.NOTICES])
        times.append(time.time() - start)
        assert count == 2 * n and [p["word"] for p in places[:3]] == [0, 2, 4] and len(places) == n
    assert times[1] < 40 * times[0] + 1
