"""Operators against brute force on small tables, and what they do with odd rows."""

import hashlib
import math
import os
import re
import subprocess
import sys
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import ann, decontaminate, gru, html, induced, kernel, language_model, minhash, packing, quality, substrings, toxicity, warc

RNG = np.random.default_rng(0)
WORDS = ["".join(RNG.choice(list("abcdefgh"), 4)) for _ in range(300)]
LONG = " ".join(RNG.choice(WORDS, 30_000))


def prose(n: int) -> str:
    return " ".join(RNG.choice(WORDS, n)) + "."


SHARED = prose(40)
COPY = prose(120)
ROWS = [
    *[(i, prose(int(RNG.integers(3, 200)))) for i in range(40)],
    *[(100 + i, COPY) for i in range(5)],
    (110, COPY.replace(WORDS[0], "zzzz") + " tail"),
    *[(120 + i, prose(20) + " " + SHARED + " " + prose(20)) for i in range(4)],
    (130, None), (131, ""), (132, " \t\n"), (133, "one two"), (134, "one two"), (135, LONG), (136, LONG[:50]), (137, "ünï " * 40),
    (None, COPY), (0, "a repeated id with another text"), (101, COPY),
]
WS = re.compile("[\x20\x09-\x0d]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return [w for w in WS.split(low(t)) if w]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"key": F.lit("k"), "label": F.lit(7), "n": F.lit(None).cast("int")}).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(40)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def same_rows(df, n=len(ROWS)):
    rows = df.collect()
    assert len(rows) == n
    return rows


def test_induced_sort_with_disk_and_recursion():
    for n in (1, 2, 17, 400):
        for letters in (1, 2, 5):
            t = RNG.integers(0, letters, n).astype(np.uint8)
            want = sorted(range(n), key=lambda i: t[i:].tobytes(), reverse=True)
            for memory in (64, 1 << 20):
                got = list(induced.sort(t, memory))
                assert np.concatenate([w for w, _ in got]).tolist() == want
                shared = np.concatenate([c for _, c in got])
                for k in range(1, n):
                    a, b = t[want[k - 1] :], t[want[k] :]
                    m = min(len(a), len(b))
                    differ = np.flatnonzero(a[:m] != b[:m])
                    assert shared[k] == min(255, differ[0] if len(differ) else m)


def test_long_words_that_sums_cannot_tell_apart():
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    for x in (kernel.hashes, lambda d, s, e: kernel.span(d, kernel.rolling(d), s, e)):
        found = x(np.frombuffer(f"{word} {other} {word}".encode(), np.uint8), np.array([0, 4097, 8194]), np.array([4096, 8193, 12290]))
        assert found[0] == found[2] != found[1]


def test_hot_minimizers_change_no_result(docs, monkeypatch):
    want = sorted(map(tuple, substrings.remove_repeats(docs).collect()), key=repr)
    monkeypatch.setattr(substrings, "HOT", 2)
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 20_000)
    assert sorted(map(tuple, substrings.remove_repeats(docs).collect()), key=repr) == want


def test_repeats_equal_brute_force(docs):
    first = {}
    for i, t in ROWS:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - 49):
                w = b[p : p + 50]
                first[w] = min(first.get(w, i), i)
    want = []
    for i, t in ROWS:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49) if i is not None else ():
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    got = same_rows(substrings.remove_repeats(docs))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    left = substrings.without_repeats(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} >= {0, 1, 2, 130, 131, 133}


def test_near_duplicates_equal_brute_force(docs):
    sets = []
    for _, t in ROWS:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = {i: i for i, _ in ROWS}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(ROWS)):
        for b in range(a):
            if None not in (ROWS[a][0], ROWS[b][0]) and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(ROWS[a][0]), root(ROWS[b][0])))
                parent[y] = x
    want = sorted(((i, len(s), None if i is None else root(i), i is not None and root(i) == i) for (i, _), s in zip(ROWS, sets)), key=repr)
    got = same_rows(minhash.near_duplicates(docs))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr) == want


def test_pipeline_drops_near_copies_of_similarity_four_fifths(spark):
    import corpus_pipeline

    base = [f"w{i}" for i in range(104)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-20])), (3, " ".join(base[:-21]))]  # 100 shingles, 80 and 79 of them
    short = [(10 + 2 * j + k, " ".join(f"s{j}x{i}" for i in range(9 - k))) for j in range(40) for k in (0, 1)]  # 5 and 4
    docs = spark.createDataFrame(rows[:2] + short, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()}
    assert got == {1, *range(10, 90, 2)}
    docs = spark.createDataFrame([rows[0], rows[2]], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()} == {1, 3}
    docs = spark.createDataFrame(rows[:2], "doc_id long, text string")
    assert {r.doc_id for r in minhash.near_duplicates(docs).where("kept").collect()} == {1, 2}


def test_leaks_equal_brute_force(spark, docs):
    rows = [(1, SHARED), (2, "never " * 8 + "seen anywhere at all."), (3, None), (4, ""), (5, prose(3)), (None, COPY), (6, SHARED)]
    bench = spark.createDataFrame(rows, "item_id long, text string").withColumn("key", F.lit(1))
    for most in (1 << 20, 300):
        got = {r.doc_id: (r.contaminated, r.item_ids, r.n_items) for r in same_rows(decontaminate.find(docs, bench, most))}
        assert [got[120 + i] for i in range(4)] == [(True, [1, 6], 2)] * 4
        assert got[100][0] and got[100][1] == []
        assert {i for i, x in got.items() if x[0]} <= {100, 101, 102, 103, 104, 110, 120, 121, 122, 123, None}
    assert decontaminate.clean(docs, bench).columns == docs.columns
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} & {120, 121, 100} == set()


def test_language_model(docs):
    rows = same_rows(language_model.score(docs))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter()
    for i, t in ROWS:
        if i is not None and not held(i):
            count.update([*words(t), None])
    n, v = sum(count.values()), len(count)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, t in ROWS:
        w = [*words(t), None]
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)
        assert any(r.n_tokens == len(w) and r.n_known == sum(count[x] > 0 for x in w) and r.train_tokens == n and r.held_out == held(i) and abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0 for r in by[i])


def test_language_model_learns_from_all_training_documents(spark):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    rows = [(i, " ".join(RNG.choice(WORDS, 12))) for i in range(3_500)]
    table = lambda x: spark.createDataFrame(x, "doc_id long, text string").repartition(4)
    # the documents that a sample of 2,000 by a hash of the id leaves out, with their words backwards: same counts
    share = 1.05 * 2_000 / sum(not held(i) for i, _ in rows)
    out = {r.doc_id for r in table(rows).where(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 30)) >= int(share * (1 << 30))).collect()}
    turned = [(i, " ".join(reversed(t.split())) if i in out and not held(i) else t) for i, t in rows]
    a, b = ({r.doc_id: r for r in language_model.score(table(x)).collect()} for x in (rows, turned))
    tested = [i for i, _ in rows if held(i)]
    assert all(abs(a[i].base_score - b[i].base_score) < 1e-9 for i in tested)
    assert max(abs(a[i].score - b[i].score) for i in tested) > 1e-3
    # every word and end of all training documents is learned from once
    training = table([x for x in rows if not held(x[0])])
    n = training.count()
    seen = language_model.Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), 13 * n, 0)
    learned = language_model.fit(training, seen, n)[1]
    assert len(learned) == language_model.ROUNDS and sum(learned) == 13 * n


def direct(p, texts, of):
    """Log-likelihoods word by word, from the definition."""
    size, n = p["word"].shape[2], p["state"].shape[0]
    out = []
    for lo, hi in zip(of[:-1], of[1:]):
        h, total, before = np.zeros(n), 0.0, 0
        for w in texts[lo:hi]:
            x, own = p["gates"][before] + p["bias"], h @ p["state"]
            z, r = (1 / (1 + np.exp(-(x[k * n : (k + 1) * n] + own[k * n : (k + 1) * n]))) for k in (0, 1))
            h = (1 - z) * np.tanh(x[2 * n :] + r * own[2 * n :]) + z * h
            c = w // size
            a, b = h @ p["class"] + p["class_bias"], h @ p["word"][c] + p["word_bias"][c]
            total += a[c] - np.log(np.exp(a).sum()) + b[w % size] - np.log(np.exp(b).sum())
            before = w
        out.append(total)
    return np.array(out)


def test_gradients_and_carried_state():
    p = {k: v.astype(np.float64) for k, v in gru.start(RNG.random(24) * 10, 6, hidden=5).items()}
    before, target, mask, h = RNG.integers(0, 24, (4, 3)), RNG.integers(0, 24, (4, 3)), np.ones((4, 3), bool), RNG.standard_normal((3, 5))
    mask[2:, 1] = False
    _, g, _ = gru.gradient(p, before, target, mask, h)
    for k in p:
        at = tuple(int(RNG.integers(0, s)) for s in p[k].shape)
        p[k][at] += 1e-5
        up = gru.gradient(p, before, target, mask, h)[0]
        p[k][at] -= 2e-5
        down = gru.gradient(p, before, target, mask, h)[0]
        p[k][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-6
    # the state is 0 again where a text begins
    begins = np.zeros((4, 3), bool)
    begins[2, 0] = begins[0, 1] = True
    _, g, _ = gru.gradient(p, before, target, mask, h, begins)
    for k in p:
        at = tuple(int(RNG.integers(0, s)) for s in p[k].shape)
        p[k][at] += 1e-5
        up = gru.gradient(p, before, target, mask, h, begins)[0]
        p[k][at] -= 2e-5
        down = gru.gradient(p, before, target, mask, h, begins)[0]
        p[k][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-6
    texts = RNG.integers(0, 24, 300)
    of = np.array([0, 100, 100, 130, 300])
    assert np.allclose(gru.score(p, texts, of, 0, lanes=2), direct(p, texts, of))
    assert np.allclose(gru.score(p, texts, of, 0, window=7), gru.score(p, texts, of, 0, window=500))
    # a distribution: the chances of all words at a place sum to one
    state = RNG.standard_normal((24, 5))[:1].repeat(24, axis=0)
    assert abs(np.exp(gru._likelihood(p, state, np.arange(24))).sum() - 1) < 1e-6


def test_network_where_logits_are_high_and_lanes_end():
    rng = np.random.default_rng(6)
    p = {k: v.astype(np.float64) for k, v in gru.start(rng.random(24) * 10, 6, hidden=5).items()}
    texts, of = rng.integers(0, 24, 300), np.array([0, 100, 100, 130, 300])
    for far in (1, 300):
        far = {k: v * (far if "bias" not in k and k in ("class", "word") else 1) for k, v in p.items()}
        assert np.allclose(gru.score(far, texts, of, 0, lanes=3, window=7), direct(far, texts, of))
        found = gru.score({k: v.astype(np.float32) for k, v in far.items()}, texts, of, 0)
        assert np.allclose(found, direct(far, texts, of), rtol=1e-3)
    # the loss of windows in turn is that of the texts, whether exponentials are safe or not
    for far in (p, {k: v * 300 if k == "word" else v for k, v in p.items()}):
        assert gru._safe(far, np.ones((1, 5))) == (far is p)
        loom, h, loss = gru.Loom(texts, of, 3), np.zeros((3, 5)), 0.0
        for at in range(0, loom.steps, 7):
            place, begins, _ = loom.window(at, min(7, loom.steps - at))
            real = place >= 0
            mean, _, h = gru.gradient(far, np.where(begins, 0, texts[place - 1]), texts[place], real, h[: place.shape[1]], begins)
            loss += mean * real.sum()
        assert np.isclose(-loss, direct(far, texts, of).sum())
    # every word is in one window of its own text
    words, of = np.arange(70), np.array([0, 10, 10, 11, 40, 65, 70])
    loom, met = gru.Loom(words, of, 2), []
    for at in range(0, loom.steps, 4):
        place, begins, text = loom.window(at, min(4, loom.steps - at))
        real = place >= 0
        assert (begins[real] == np.isin(place[real], of[:-1])).all() and (text[real] == np.searchsorted(of, place[real], "right") - 1).all()
        met += place[real].tolist()
    assert sorted(met) == words.tolist()


#: CPU time of a word in training and in scoring, as multiples of that of the matrix products and exponentials it needs.
COSTS = """
import time
import numpy as np
from corpusmill.llm import gru

rng = np.random.default_rng(5)
p = gru.start(1e6 / (1 + np.arange(2048.0)), 64)
of = np.concatenate([[0], np.cumsum(rng.integers(1, 400, 700))])
words = np.minimum(rng.zipf(1.3, of[-1]) - 1, 2047).astype("<u2")
h, states = (rng.standard_normal((n, 16)).astype(np.float32) for n in (256, 2048))
w, u = np.ones((16, 96), np.float32), np.ones((16, 48), np.float32)

def products(back):
    for _ in range(160):
        h @ u
    for _ in range(20):
        x = states @ w
        np.exp(x, out=x)
        if back:
            states.T @ x
            x @ w.T

def cost(work, *given):
    t = time.process_time()
    work(*given)
    return time.process_time() - t

train, score = [], []
for _ in range(7):
    train.append(cost(gru.train, p, words, of, 0) / cost(products, True))
    score.append(cost(gru.score, p, words, of, 0) / cost(products, False))
print(*(sorted(k)[3] / of[-1] * 20 * 2048 for k in (train, score)))
"""


def test_network_costs_little_more_than_its_products():
    root = str(Path(gru.__file__).parents[2])
    threads = {"OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1"}
    train, score = map(float, subprocess.run([sys.executable, "-c", COSTS], cwd=root, env=os.environ | threads, capture_output=True, text=True, check=True, timeout=300).stdout.split())
    # 9.4 and 10.0 with the highest logit of every row looked for, and lanes read one by one
    assert score < 6 and train + score < 14, (train, score)


def test_toxicity_is_exact_and_learns(spark):
    bad = ["vileword", "nastyterm", "grimslur"]
    rows, y = [], []
    for i in range(600):
        w = list(RNG.choice(WORDS, 40))
        if i % 5 == 0:
            for k in range(3):
                w[int(RNG.integers(40))] = bad[(i + k) % 3] + "s" * (i % 2)
        rows.append((i, " ".join(w)))
        y.append((i, 1, int(i % 5 == 0)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(y, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(df, lab).collect()}
    assert all(r.predicted == int(i % 5 == 0) for i, r in got.items() if r.held_out)
    model = toxicity.fit(df, lab)
    index = model.index
    # cosines of whole vectors, from the definition, against the blocks' search
    learned = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    dense = np.zeros((len(learned), len(index.highest)))
    for k, (_, t) in enumerate(learned):
        at, w = model.vectors.of(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0]
        dense[k, at] = w
    ids = np.array([i for i, _ in learned])
    for k in range(0, len(learned), 17):
        at = np.flatnonzero(dense[k])
        cosine = np.round(dense @ dense[k], 12)
        assert index.nearest((at, dense[k, at]))[0].tolist() == ids[np.lexsort((ids, -cosine))[: toxicity.K]].tolist()
    for _ in range(20):
        c = np.append(0, np.sort(RNG.choice(np.arange(1, len(index.highest)), min(3, len(index.highest) - 1), replace=False)))
        w = RNG.random(len(c))
        w /= np.sqrt((w * w).sum())
        _, everything = index._scores(c, w, np.ones(index.blocks, bool))
        order = np.lexsort((index.ids, -everything))[: toxicity.K]
        assert index.nearest((c, w))[0].tolist() == index.ids[order].tolist()


def test_neighbours_equal_brute_force(spark):
    x = RNG.standard_normal((400, 16))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000, None, 1), (1020, [0.0] * 16, 1), (1040, [float("nan")] * 16, 1), (1060, [1.0, None] * 8, 1), (1080, [1.0] * 3, 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = defaultdict(list)
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
        assert abs(r.score - float(x[r.query_id] @ x[r.vec_id])) < 1e-9
    assert set(got) == set(range(0, 400, 20))
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(found) & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.9 * 20 * len(got)
    assert ann.search(df.limit(0)).count() == 0


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    from corpusmill.llm import tokens

    whole = Tokenizer.from_file(tokens.default_path())
    pieces = packing.pack(docs).collect()
    by, seats = defaultdict(list), defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
        seats[p.sequence_id].append((p.offset, p.length))
    for s in seats.values():
        s.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and s[0][0] == 0 and sum(n for _, n in s) <= 4096
    for i, t in ROWS:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert any(p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in by[i])
    assert sum(p.length for p in pieces) == sum(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ROWS)
    # little padding: at most one sequence in fifty more than the ids need, and a few for what rounding leaves
    total = sum(p.length for p in pieces)
    assert len(seats) <= -(-total // 4096) * 1.02 + 2
    plan = packing.plan({5: 40, 7: 33, 12: 9, 16: 2}, 16)
    assert sum(n * p for p, n in plan)[[5, 7, 12, 16]].tolist() == [40, 33, 9, 2]


def test_quality_prefers_what_is_like_the_good(spark):
    good, junk = ["and of the it so be on at".split(), "### $$$ %%% &&& *** !!!".split()]
    rows = [(i, " ".join(RNG.choice(good if i % 4 else junk, 60))) for i in range(400)]
    df = spark.createDataFrame([*rows, (None, "and of"), (900, None)], "doc_id long, text string").withColumn("key", F.lit(0))
    lab = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality.weigh(df, lab).collect()}
    assert all(kept[i] == (i % 4 > 0) for i in range(400))
    assert quality.keep_good(df, lab).columns == df.columns
    values = spark.createDataFrame([(float(v),) for v in (5, 1, 1, 3, -2)], "v double")
    assert [quality.kth_largest(values, "v", k) for k in (1, 2, 3, 4, 5)] == [5, 3, 1, 1, -2]


PAGE = """<html><head><title>t</title><script>var a = "<p>no</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="content"><h1>A title &amp; more</h1><p>The first paragraph of the article  has
words enough &eacute; to surge.</p><p>The second paragraph is as long as the first one, surely.</p></div>
<div class="comments"><p>Nice article, I read it twice and then again.</p></div><footer>All rights reserved by somebody.</footer></body></html>"""


def test_html(spark):
    want = "A title & more\nThe first paragraph of the article has words enough é to surge.\nThe second paragraph is as long as the first one, surely."
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>"), (None, "u", PAGE), (1, "u", PAGE)]
    got = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in got] == [want, "", "", "", want, want]
    assert [r.n_chars for r in got] == [len(r.text) for r in got]


def test_warc(spark):
    rows = [(i, f"u{i}", "same" if i % 3 == 0 else f"page {i}") for i in range(30)] + [(30, None, None), (31, "u", "")]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, h in rows:
        assert got[i].payload_digest == warc.digest((h or "").encode()) and got[i].payload_bytes == len(h or "")
        first = 0 if h == "same" else 30 if i == 31 else None
        assert (got[i].record_type, got[i].refers_to) == (("revisit", first) if first is not None and first != i else ("response", None))


def test_warc_salvage():
    made = [warc.member(warc.record("response", i, "u", b"payload %d" % i, warc.digest(b"payload %d" % i))) for i in range(6)]
    broken = bytearray(b"".join(made))
    at = len(made[0]) + len(made[1])
    broken[at + 30 : at + 60] = b"\0" * 30
    found = list(warc.salvage(bytes(broken)))
    assert [x[3][0]["x-page-id"] for x in found if x[0] == "record"] == ["0", "1", "3", "4", "5"]
    assert [(a, b) for what, a, b, _ in found if what == "gap"] == [(at, at + len(made[2]))]


def test_warc_salvage_within_a_member():
    parts = [warc.record("response", i, "u", b"payload %d " % i * 40, warc.digest(b"payload %d " % i * 40)) for i in range(3)]
    broken = bytearray(parts[1])
    broken[-20] ^= 1
    # a sound member of three records, the second of which is damaged
    data = warc.member(parts[0] + bytes(broken) + parts[2])
    found = list(warc.salvage(data))
    assert [x[3][0]["x-page-id"] for x in found if x[0] == "record"] == ["0", "2"] and [x[:3] for x in found if x[0] == "gap"] == [("gap", 0, len(data))]
    # a member whose stream breaks: what came before is kept, the next member is read
    noise = [warc.record("response", i, "u", RNG.bytes(6000).hex().encode(), "x") for i in range(3)]
    data = bytearray(warc.member(b"".join(noise)))
    cut = len(data)
    data[cut * 2 // 3 :] = RNG.bytes(cut - cut * 2 // 3)
    data += warc.member(noise[0])
    found = list(warc.salvage(bytes(data)))
    assert [x[3][0]["x-page-id"] for x in found if x[0] == "record"] in (["0", "0"], ["0", "1", "0"])
    assert sum(b - a for what, a, b, _ in found if what == "gap") == cut
    # a third of a large file is damage: marks are looked for once
    began = time.monotonic()
    list(warc.salvage(b"\x1f\x8b\x08" * 20_000 + b"".join(parts)))
    assert time.monotonic() - began < 20


def test_warc_odd_rows(spark):
    long = "x" * 3_000_000
    rows = [(1, "u", "a", 7), (1, "u", "a", 7), (2, None, "a", None), (None, "u", "a", 7), (3, "u", long, 7), (4, "u", long, 7), (5, "u", None, 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest int")
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(df).collect()), key=repr)
    assert got == sorted([(1, "response", None, 1), (1, "response", None, 1), (2, "revisit", 1, 1), (None, "revisit", 1, 1), (3, "response", None, 3_000_000), (4, "revisit", 3, 3_000_000), (5, "response", None, 0)], key=repr)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_html_by_structure(spark):
    page = "<html><body><nav><a href=x>Home</a></nav>{}<footer>All rights reserved by somebody else.</footer></body></html>"
    body = '<div class="{}"><p>This is a paragraph long enough to surge.</p><p><a href="x">A paragraph that is a link</a></p><p>A last paragraph that is as long.</p></div>'
    whole = "This is a paragraph long enough to surge.\nA paragraph that is a link\nA last paragraph that is as long."
    for name, want in (("long-form", whole), ("popular-science", whole), ("legal-news", whole), ("comment-list", ""), ("siteFooter", ""), ("post__comments--main", "")):
        assert html.extract(page.format(body.format(name))) == want
    assert html.extract("<p>Short one.</p>") == "Short one."
    assert html.extract("<article><p>a <b title='x > y'>b</b> c</p></article>") == "a b c"
    began = time.monotonic()
    for bad in ("<a '", "<a <a ", "<a '><b>", "<a '>' ", "<script '", "<!--", "<p>x</b>"):
        html.extract(bad * 20_000)
    assert time.monotonic() - began < 30
    rows = [(i, "u", page.format(body.format("x")), 5) for i in (1, 1, 2)] + [(3, None, "<p>" + "long text " * 200_000, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html.extract_pages(df).collect()
    assert [r.text for r in got[:3]] == [whole] * 3 and got[3].n_chars == 10 * 200_000 - 1
    assert html.extract_pages(df.limit(0)).count() == 0


def bm25(items, passage):
    """Scores of a passage by definition: the BM25 sum over its distinct words, as a share of the item's own."""
    split = lambda t: re.findall("[a-z0-9]+", low(t))
    own = {i: Counter(split(t)) for i, t in items}
    mean = sum(sum(c.values()) for c in own.values()) / len(own)
    df = Counter(w for c in own.values() for w in c)
    out = {}
    for i, c in own.items():
        n = sum(c.values())
        part = {w: math.log1p((len(own) - df[w] + 0.5) / (df[w] + 0.5)) * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * n / mean)) for w, k in c.items()}
        out[i] = sum(part[w] for w in part.keys() & set(split(passage))) / sum(part.values())
    return out


def test_block_maxima_lose_no_item():
    items = [(i, " ".join(RNG.choice(WORDS[:60], int(RNG.integers(5, 15))))) for i in range(60)]
    index = decontaminate.Index([i for i, _ in items], [t for _, t in items])
    for _ in range(40):
        some = items[int(RNG.integers(60))][1].split()
        passage = " ".join([*RNG.choice(WORDS[:60], 3), *some[: int(RNG.integers(3, len(some) + 1))]][: index.run])
        h, of = decontaminate.words(np.frombuffer(passage.encode(), np.uint8), np.array([0, len(passage)]))
        place, term = index.known(h)
        first, blocks = index.candidates(np.zeros(len(place), np.int64), term, np.array([False]))
        got = {index.ids[k]: s for k, s in index.above(np.unique(term), blocks)}
        want = {i: s for i, s in bm25(items, passage).items() if s >= decontaminate.THRESHOLD}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_leaks_in_scripts_without_spaces(spark):
    item = "臺灣最高的山是哪一座山？玉山是臺灣最高的山，海拔三千九百五十二公尺。"
    assert decontaminate.parts(item) == ("臺灣最高的山是哪一座山？", "玉山是臺灣最高的山，海拔三千九百五十二公尺。")
    bench = spark.createDataFrame([(1, item), (2, "Which is the highest of all mountains? It is the one that no other one exceeds in height.")], "item_id long, text string")
    rows = [(1, "昨天我在圖書館看書，其中一頁寫著「" + item + "」然後我就回家了。"), (2, "昨天我在圖書館看書，其中一頁寫著玉山很高。"), (3, "Before:Which is the highest of all mountains? It is the one that no other one exceeds in height—after.")]
    got = {r.doc_id: r.item_ids for r in decontaminate.find(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {1: [1], 2: [], 3: [2]}


def test_codes_choose_the_neighbours():
    x = RNG.standard_normal((3000, 32))
    turn, centre = ann.rotation(32), np.zeros(32)
    bits, scalars = ann.encode(x, centre, turn)
    ids, asked = np.arange(3000), np.arange(0, 3000, 60)
    best = {int(q): set(np.argsort(-np.where(ids == q, -np.inf, x @ x[q]))[:20].tolist()) for q in asked}

    def recall(b):
        bar = np.array([np.sort(x @ x[q])[-41] for q in asked])
        found = defaultdict(set)
        for q, v, s in zip(*ann.nearest(ids, x, b, scalars, asked, x[asked], bar, centre, turn, 20)):
            found[int(q)].add(int(v))
            assert abs(s - float(x[q] @ x[v])) < 1e-9
        return sum(len(found[q] & best[q]) for q in best) / (20 * len(best))

    assert recall(bits) > 0.97
    # bits of other rows choose other rows
    assert recall(np.roll(bits, 1, axis=0)) < 0.7


def test_neighbours_with_repeated_ids_and_ties(spark):
    rows = [(i, [1.0, float(i % 3)]) for i in range(60)] + [(20, [0.5, 0.0]), (21, [9.0, 9.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("query_id = 40").orderBy("rank").collect()
    q = [1.0, 1.0]
    best = {}
    for i, v in rows:
        if i != 40:
            best[i] = max(best.get(i, -9e9), sum(a * b for a, b in zip(q, v)))
    assert [(r.vec_id, r.score) for r in got] == sorted(best.items(), key=lambda x: (-x[1], x[0]))[:20]


def test_quality_equals_brute_force(spark):
    rows = [(i, " ".join(RNG.choice(["aa", "bb", "cc", "7", "##"], 30))) for i in range(60)] + [(None, "aa bb"), (None, "aa bb"), (None, "## 7 ##"), (7, "anew")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 2), 0) for i in range(40)], "doc_id long, quality int, toxic int")

    def units(t):
        u = re.findall(r"[a-zA-Z]+|[0-9]+|[^a-zA-Z0-9\s]+", t or "")
        return [*u, *["again" if a == b else (a, b) for a, b in zip(u, u[1:])]]

    raw, good = Counter(x for _, t in rows for x in units(t)), Counter(x for i, t in rows if i is not None and i < 40 and i % 2 for x in units(t))
    n, m, size = sum(raw.values()), sum(good.values()), quality.BUCKETS
    q = lambda x: (raw[x] + 0.5) / (n + 0.5 * size)
    want = sorted(round(sum(math.log((good[x] + 0.5 * size * q(x)) / (m + 0.5 * size) / q(x)) for x in units(t)), 6) for _, t in rows)
    got = quality.weigh(df, lab).collect()
    # no two units of so few share a bucket
    assert sorted(round(r.log_weight, 6) for r in got) == want
    assert len({r.perturbed - r.log_weight for r in got if r.doc_id is None}) == 2
    assert sum(r.kept for r in got) >= 1


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "near duplicates", "suffix-array dedup", "benchmark decontamination", "packing"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, h long"
    rows = [(i, t, "en", None, None if t is None else len(t), None, 1) for i, t in ROWS]
    for table, data, kind in (("labels", [(i, int(i % 3 > 0), 0) for i in range(40)], "doc_id long, quality int, toxic int"), ("benchmark", [(1, SHARED), (None, None)], "item_id long, text string")):
        spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/{table}.parquet")
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name == "packing":
                assert out.count() >= docs.count()
            else:
                assert out.schema.names == docs.schema.names and out.count() <= docs.count()


def test_empty_tables(spark, labels):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([], "item_id long, text string")
    for f in (lambda: quality.weigh(none, labels), lambda: decontaminate.find(none, bench), lambda: language_model.score(none), lambda: minhash.near_duplicates(none), lambda: substrings.remove_repeats(none), lambda: toxicity.score(none, labels), lambda: packing.pack(none)):
        assert f().count() == 0


def test_odd_rows(docs, labels):
    same_rows(quality.weigh(docs, labels))
    for r in same_rows(toxicity.score(docs, labels)):
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    same_rows(toxicity.score(docs, labels.limit(0)))


def test_kernel_spans():
    a = np.frombuffer(b"xx hello yy hello", np.uint8)
    h = kernel.span(a, kernel.rolling(a), np.array([3, 12, 2]), np.array([8, 17, 7]))
    assert h[0] == h[1] != h[2]


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["op5_minhash", "op7_warc", "op8_induced"])
def test_queries_equal_sql(spark, name):
    import duckdb

    from corpusmill.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr) == sorted(result.fetchall(), key=repr)
