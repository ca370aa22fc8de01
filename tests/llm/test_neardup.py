"""Near-duplicate vectors where the tables miss links: the closing rounds, the audit and the exact product."""

from collections import Counter

import numpy as np
import pytest

from conformix.llm import neardup
from tests.llm import brute


def rows_and_links(x, labels):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argwhere(np.triu(u @ u.T >= 0.98, 1))
    return u, [(int(i), int(j)) for i, j in near if labels[i] == labels[j]]


def cone(seed=3, n=700, dim=24):
    """Vectors around one direction, which share most sign codes, with planted close pairs."""
    rng = np.random.default_rng(seed)
    x = 4.5 * np.ones(dim) + 1.4 * rng.standard_normal((n, dim))
    x[1::10] = x[0::10] + 0.25 * rng.standard_normal((len(x[1::10]), dim))
    return x


def run(spark, x, labels, **kw):
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], labels[i]) for i in range(len(x))], "vec_id long, embedding array<double>, label int")
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup.near_duplicates(df, **kw).collect()}


@pytest.mark.parametrize("audit", [0.0, 1.0])
def test_links_the_lists_missed_are_found(spark, monkeypatch, audit):
    x, labels = cone(), [0] * 700
    _, links = rows_and_links(x, labels)
    assert len(links) >= 60
    tables = neardup._tables
    monkeypatch.setattr(neardup, "_tables", lambda *a: tables(*a).limit(0))
    monkeypatch.setattr(neardup, "TABLE_ROUNDS", 2 if audit else 1, raising=False)
    monkeypatch.setattr(neardup, "_audit", lambda *a: audit)
    got = run(spark, x, labels, block=64)
    comp, n = brute.brute_components(range(700), links), Counter(k for p in links for k in p)
    if audit:  # tables alone: most links; those found are counted and joined
        assert sum(got[a][1] == got[b][1] for a, b in links) >= 0.9 * len(links)
    else:  # an audit that never passes ends in the exact product
        assert got == {i: (n[i], comp[i]) for i in range(700)}


def test_every_pair_of_a_crowded_code_is_compared(spark):
    x, labels = cone(), [0] * 700
    u, links = rows_and_links(x, labels)
    rows = [(i, 0, 24, bytearray(u[i].tobytes()), i) for i in range(700)]
    state = spark.createDataFrame(rows, "id long, grp long, dim int, x binary, comp long").repartition(3)
    codes = [(r["t"], r["id"], r["code"]) for r in neardup._coded(state, 2, *neardup._shape(700, 0.05)).select("t", "id", "code").collect()]
    of = {(t, i): c for t, i, c in codes}
    same = [(a, b) for a, b in links if any(of[t, a] == of[t, b] for t in {t for t, *_ in codes})]
    assert max(Counter((t, c) for t, _, c in codes).values()) > neardup.WINDOW_ROWS
    got = brute.brute_components(range(700), [(r["a"], r["b"]) for r in neardup._across(state, 700, 2, 0.98, 64).collect()])
    assert got == brute.brute_components(range(700), same)


def test_audit_counts_vectors_not_links(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((120, 24))
    x[:100] = x[0] + 0.01 * rng.standard_normal((100, 24))
    x[110:] = x[100:110]
    u, _ = rows_and_links(x, [0] * 120)
    lost = [(i, 0, 24, bytearray(u[i].tobytes()), 0 if i < 100 else i) for i in range(120)]
    state = spark.createDataFrame(lost, "id long, grp long, dim int, x binary, comp long")
    assert neardup._audit(state, 0.98, 200) == pytest.approx(100 / 120)


def test_audit_goes_on_until_it_has_seen_links(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 24))
    x[899] = x[898]
    u, links = rows_and_links(x, [0] * 900)
    assert links == [(898, 899)]
    state = spark.createDataFrame([(i, 0, 24, bytearray(u[i].tobytes()), i) for i in range(900)], "id long, grp long, dim int, x binary, comp long")
    assert neardup._audit(state, 0.98, 10) == 0


def test_repeated_ids_keep_label_and_vector_of_one_row(spark):
    x, y = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, "a", x), (1, "b", y), (2, "a", y), (3, "b", y), (4, "a", x)]
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()}
    assert out == {1: (1, 1), 4: (1, 1), 2: (0, 2), 3: (0, 3)}


def test_refinement_finds_what_the_first_lists_miss(spark):
    """One large cluster, many pairs and noise: after the rounds of refinement alone the links give a recall of 0.9 or more."""
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(32)
    near = lambda c: c + 0.02 * np.linalg.norm(c) / np.sqrt(32) * rng.standard_normal(32)
    vectors = [near(centre) for _ in range(400)]
    for _ in range(200):
        c = rng.standard_normal(32)
        vectors += [near(c), near(c), near(c)]
    vectors += list(rng.standard_normal((300, 32)))
    x = np.array(vectors)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= 0.98
    np.fill_diagonal(link, False)
    from tests.llm import brute

    comp = brute.brute_components(list(range(len(x))), list(zip(*map(list, np.nonzero(link)))))
    df = spark.createDataFrame([(i, "l", v.tolist()) for i, v in enumerate(x)], "vec_id long, label string, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
    assert got == {i: (int(link[i].sum()), int(comp[i])) for i in range(len(x))}
    units = neardup.materialise(spark.createDataFrame([(i, 1, 32, bytearray(v.tobytes()), 1) for i, v in enumerate(u)], "id long, grp long, dim int, x binary, copies long"), "units")
    lists = neardup.descend(units, len(x), 0.98)
    found = {(r["a"], r["b"]) for r in lists.where("s >= 0.98").collect()}
    of = brute.brute_components(list(range(len(x))), list(found))
    i, j = np.nonzero(link)
    assert np.mean([of[a] == of[b] for a, b in zip(i.tolist(), j.tolist())]) >= 0.9
