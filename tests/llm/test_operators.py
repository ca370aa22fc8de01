"""Each operator against its brute-force version, on texts that are null, empty, long, repeated or cut in odd places."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conformix.llm import ann, html, jaccard, katz, langid, mixing, neardup, packing, quality, suffix
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double"


def make_docs(seed=5, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgéü") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(90))
    docs = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        if i % 5 == 0:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        if i % 7 == 0 and docs:
            base = docs[rng.randrange(len(docs))][1] or "x"
            words = base.split()
            if words and i % 2:
                words[rng.randrange(len(words))] = "changed"
        docs.append((i, " ".join(words)))
    docs += [(n, None), (n + 1, ""), (n + 2, " \t\n "), (n + 3, "one"), (n + 4, "One TWO"), (n + 5, "one two"), (n + 6, "z" * 3000), (n + 7, "ab " * 900)]
    return docs


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else "de", None if i % 11 == 0 else f"s{i % 3}", None if t is None else len(t), 7, 0.5) for i, t in make_docs()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    return dict(make_docs())


@pytest.mark.parametrize("length,gram,group", [(60, 16, 30000), (60, 16, 3)])
def test_suffix_dedup(docs, texts, length, gram, group):
    out = suffix.dedup(docs, length=length, gram=gram, group=group, keep=["doc_id"]).collect()
    want = brute.dedup_rows(list(texts.items()), length)
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == sorted(want)
    assert sum(r["n_removed"] for r in out) > 0


def test_suffix_dedup_counts_repeated_rows(spark):
    t = "".join(random.Random(1).choice("abcdef ") for _ in range(200))
    df = spark.createDataFrame([(1, t), (1, t), (2, t[:50])], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in suffix.dedup(df, length=60, gram=16).collect()) == [(1, 200), (1, 200), (2, 0)]


@pytest.mark.parametrize("width,percent", [(3, 90), (2, 60)])
def test_jaccard_join(docs, texts, width, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs, width, percent, block=4).collect()}
    assert got == brute.jaccard_rows(texts, width, percent)


def test_first_grams_lose_no_pair():
    rng = np.random.default_rng(0)
    for percent in (80, 90):
        first = lambda x: np.sort(jaccard.mix(x))[: jaccard.first_grams(len(x), percent)]
        for n in [1, 2, 3, 5, 9, 10, 20, 50, 300]:
            for _ in range(20):
                a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
                drop = rng.integers(0, n * (100 - percent) // 100 + 1)
                b = np.unique(np.concatenate((a[drop:], rng.integers(0, 1 << 63, rng.integers(0, drop + 1), dtype=np.uint64))))
                over = len(np.intersect1d(a, b))
                if 100 * over >= percent * (len(a) + len(b) - over):
                    assert np.intersect1d(first(a), first(b)).size


def test_katz(docs, texts):
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    train = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)
    out = katz.score(docs, katz.fit(train), keep=["doc_id"]).collect()
    want, p, uni = brute.katz_rows(texts, held)
    assert {r["doc_id"]: (r["n_tokens"], r["n_known"]) for r in out} == {i: w[:2] for i, w in want.items()}
    for r in out:
        assert r["base_score"] == pytest.approx(want[r["doc_id"]][2]) and r["score"] == pytest.approx(want[r["doc_id"]][3])
    for h in list(uni)[:5]:
        assert sum(p(w, h) for w in uni) + p("never seen", h) == pytest.approx(1)


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    out = packing.pack(docs, size=64, nearly=2, merge_bins=20).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == texts.keys()
    for i, t in texts.items():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        rows = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["start"] for r in rows] == list(range(0, len(ids), 64)) and sum(r["length"] for r in rows) == len(ids)
        for r in rows:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r["length"] for r in out)
    assert len(bins) <= 1.1 * -(-total // 64) + 1


def test_word_cache_equals_tokenizer():
    from tokenizers import Tokenizer

    tok, fast = Tokenizer.from_file(packing.tokenizer_path()), packing.WordTokens(packing.tokenizer_path(), limit=20)
    for t in ["Don't stop, it's 3.14 o'clock!", "ÉCOLE straße naïve_x y2k", "a\tb\nc  d", "<|endoftext|> x", "日本語 é İ ﬁ", "x'S 'LL''ve", "", "a" * 300, " ".join(f"w{i}" for i in range(60))]:
        assert fast.encode(t) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_mixing(docs, texts):
    out = mixing.mix(docs).collect()
    size = {i: len(brute.lower_words(t)) for i, t in texts.items()}
    assert {r["doc_id"]: r["size"] for r in out} == size
    taken, goal, largest = Counter(), {}, defaultdict(int)
    for r in out:
        taken[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
    assert sum(goal.values()) == pytest.approx(sum(size.values()))
    assert all(abs(taken[s] - goal[s]) <= largest[s] for s in goal)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=str)


def test_targets_stop_at_the_cap():
    t = mixing.targets([("a", 10), ("b", 100), (None, 100)])
    assert t["a"] == 30 and t["b"] == pytest.approx(180 * 2 / 3) and t[None] == pytest.approx(60)


def vectors(seed=2, n=150, dim=8):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x[20:40] = x[0] + 0.02 * rng.standard_normal((20, dim))
    x[40:50] = x[1]
    x[50] = 2 * x[2]
    rows = [(i, [float(v) for v in x[i]], i % 2 if i > 60 else 0) for i in range(n)]
    return x, rows + [(n, None, 0), (n + 1, [0.0] * dim, 0), (n + 2, [float("nan")] + [1.0] * (dim - 1), 0), (n + 3, [None] + [1.0] * (dim - 1), 0), (n + 4, rows[0][1], None)]


def test_near_duplicate_vectors(spark):
    x, rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = [(i, j) for i in range(len(x)) for j in range(i) if rows[i][2] == rows[j][2] and u[i] @ u[j] >= 0.98]
    comp = brute.brute_components([r[0] for r in rows], links)
    n = Counter(k for p in links for k in p)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, k=4, block=8).collect()}
    assert got == {i: (n[i], comp[i], comp[i] == i) for i in comp}


def test_nearest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
    monkeypatch.setattr(ann, "BASE_BLOCK", 40)
    x, rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    good = list(range(len(x))) + [rows[-1][0]]
    full = {i: np.array(rows[i][1]) for i in good}
    got = defaultdict(list)
    for r in ann.search(df.where("vec_id % 20 = 0"), df, k=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got.keys() == {i for i in good if i % 20 == 0}
    for q, found in got.items():
        want = sorted(((-float((full[q] * full[i]).sum()), i) for i in good if i != q))[:5]
        assert [i for i, _ in found] == [i for _, i in want] and [s for _, s in found] == pytest.approx([-s for s, _ in want])


def test_language_id(spark):
    rng = random.Random(4)
    words = {"en": ["the", "and", "thing", "with", "that"], "fr": ["être", "les", "une", "dans", "mentre"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(3, 30))), lang) for i, lang in enumerate(["en", "fr"] * 60)]
    rows += [(900, None, "en"), (901, "", None), (902, "12 34 !", "fr"), (903, "The " * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(9.0))
    model = langid.fit(df.where("doc_id % 4 <> 2"))
    got = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:120] if i % 4 == 2)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[903]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.identify(df, langid.fit(df.limit(0))).collect()} == {"und"}


def test_quality(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["calm", "plain", "text", "words"]) for _ in range(30)) if i % 3 else "BUY!! NOW!! " * rng.randint(3, 9), 5) for i in range(160)] + [(200, None, None), (201, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(120)] + [(5, None), (999, 1)], "doc_id long, quality int")
    out = quality.score(df, quality.fit(df, labels), keep=["doc_id"]).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    held = [r for r in out if 120 <= r["doc_id"] < 160]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held]) > 0.9


def test_factorisation_machine_identity():
    rng = np.random.default_rng(1)
    x, w, v = rng.standard_normal((3, 6)), rng.standard_normal(6), rng.standard_normal((6, 2))
    m = quality.FactorisationMachine(np.zeros(6), np.ones(6), 0.5, w, v)
    pairs = [sum((v[i] @ v[j]) * r[i] * r[j] for i in range(6) for j in range(i)) for r in x]
    assert m.margin(x) == pytest.approx(0.5 + x @ w + pairs)


PAGE = '<html><head><title>x</title><script>var a="<p>no</p>";</script></head><body><nav><a href="/">menu</a></nav><div class="wrap7"><div class="ad">buy</div><article class="post{n}"><h1>Title &amp; more</h1><p>First <b>para\n graph<p>second &lt;tag&gt; {n}<div class="comments"><p>reader</p></div></article></div><footer>foot</footer></body></html>'


def test_html(spark):
    rows = [(i, f"https://h{i % 2}.example.org/{i}", PAGE.replace("{n}", str(i))) for i in range(6)] + [(6, None, None), (7, "no url", ""), (8, "https://h0.example.org/x", "<p>only a < b</p"), (9, "https://h0.example.org/y", "plain text")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract(df).collect()}
    for i in range(6):
        want = f"Title & more\nFirst para graph\nsecond <tag> {i}"
        assert got[i] == (want, len(want))
    assert got[6] == ("", 0) and got[7] == ("", 0) and got[8] == ("only a < b", 10) and got[9] == ("plain text", 10)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    vecs = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert suffix.dedup(none).count() == 0
    assert jaccard.join(none).count() == 0
    assert katz.score(none, katz.fit(none)).count() == 0
    assert packing.pack(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert neardup.near_duplicates(vecs).count() == 0
    assert ann.search(vecs, vecs).count() == 0
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
