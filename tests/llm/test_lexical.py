"""Ranked search against a plain scorer."""

import math
import re
from collections import Counter

import pytest

from conformix.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = [
    (1, "Alpha beta, GAMMA-beta."), (2, "alphabet beta"), (3, "beta beta beta beta"), (4, None), (5, ""), (6, "..., \n"), (7, "äpfel Äpfel alpha"), (8, "alpha\x00beta\x7fgamma"),
    (9, "alpha beta gamma"), (10, "gamma beta alpha"), (10, "gamma beta alpha"), (None, "gamma beta alpha"), (11, "x " * 50_000 + "alpha"), (12, "中文 alpha"), (13, "beta alpha beta"), (14, "alpha_beta"), (15, "naïve beta9 9beta 9"),
] + [(100 + i, f"filler {i} alpha") for i in range(30)]
ITEMS = [(1, "alpha beta"), (2, "beta beta Beta"), (3, "nothing here matches zzz"), (4, None), (5, ""), (6, "Äpfel 中文"), (7, "gamma"), (7, "gamma"), (8, "one"), (8, "alpha"), (None, "9 9beta"), (9, "filler 7")]


def terms(text):
    return [] if text is None else TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def brute(docs, items, k):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    texts = {}
    for i, t in sorted(set((i, t) for i, t in items if t is not None), key=repr):
        texts.setdefault(i, []).extend(terms(t))
    out = []
    for i, ts in texts.items():
        scored = []
        for doc, c, n in held:
            m = 100 - 75 + 75 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                scored.append((-s, doc is None, doc))
        out += [(i, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def frames(spark, docs=DOCS, items=ITEMS):
    return (
        spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, item_id string").repartition(4),
        spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int"),
    )


@pytest.mark.parametrize("most,size,docs_at_once", [(4096, 1 << 20, 256), (3, 1 << 20, 2), (4096, 20, 7)])
def test_equals_brute_force(spark, monkeypatch, most, size, docs_at_once):
    monkeypatch.setattr(lexical, "ITEMS", most)
    monkeypatch.setattr(lexical, "ITEM_BYTES", size)
    monkeypatch.setattr(lexical, "DOCS", docs_at_once)
    got = lexical.search(*frames(spark), k=4)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(DOCS, ITEMS, 4)


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(*frames(spark, items=[(3, "zzz")])).count() == 0


def test_guards_share_and_bound():
    items = lexical.Items.of([(1, b"a b ab")])
    n, which, tf = lexical.count_terms(items.automaton(), b"A a,b abab ab")
    assert n == 5 and dict(zip([items.terms[i] for i in which], tf.tolist())) == {b"a": 2, b"b": 1, b"ab": 1}
