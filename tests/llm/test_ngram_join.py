import re

import numpy as np
import pytest

from curvelark.llm import ngram_join as J
from tests.llm.util import docs_frame, words_text

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(FOLD))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    ids = list(sets)
    near = {i: {j for j in ids if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])} for i in ids}
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(sets[i]), min(seen), len(near[i]))
    return out


def found(spark, rows, n, percent):
    got = J.jaccard_components(docs_frame(spark, rows, extra=True), n, percent).collect()
    return {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_against_all_pairs(spark, n, percent):
    rng = np.random.default_rng(n)
    rows, base = [], [words_text(rng, 120) for _ in range(6)]
    for i in range(240):
        w = base[i % 6].split(" ")
        for _ in range(int(rng.integers(0, 6))):
            w[int(rng.integers(0, len(w)))] = f"x{rng.integers(0, 40)}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "One two"), (2004, "one  TWO"), (2005, "one"), (2006, "É two three"), (2007, "é two three"), (2008, rows[0][1].upper()), (2009, words_text(rng, 30_000)), (2010, "w" * 3_000_000)]
    assert found(spark, rows, n, percent) == brute(rows, n, percent)


@pytest.mark.parametrize("giant", [16, 2])
def test_blocks_of_large_clusters(spark, monkeypatch, giant):
    monkeypatch.setattr(J, "BLOCK", 16)
    monkeypatch.setattr(J, "GIANT", giant)
    rng = np.random.default_rng(9)
    base = words_text(rng, 200).split(" ")
    rows = []
    for i in range(150):
        w = list(base[: 200 - int(rng.integers(0, 25))])
        for _ in range(int(rng.integers(0, 7))):
            w[int(rng.integers(0, len(w)))] = f"x{rng.integers(0, 1000)}"
        rows.append((i, " ".join(w)))
    assert found(spark, rows, 3, 90) == brute(rows, 3, 90)


def test_repeated_null_and_no_rows(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, None)]
    got = sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in J.jaccard_components(docs_frame(spark, rows), 3, 90).collect())
    assert got[:3] == [(False, 3, 2, 3, 2), (False, 5, 2, 3, 2), (False, 5, 2, 3, 2)]
    assert [(g[1], g[3], g[4]) for g in got[3:]] == [(None, None, 0)] * 2
    assert J.jaccard_components(docs_frame(spark, []), 3, 90).count() == 0


def test_texts_under_one_id(spark):
    rng = np.random.default_rng(8)
    one, two = words_text(rng, 60), words_text(rng, 60)
    near = lambda t, k: " ".join(t.split(" ")[:-1] + [f"end{k}"])
    rows = [(1, one), (1, two), (3, near(two, 1)), (0, near(one, 1)), (1, two), (7, near(two, 1)), (9, words_text(rng, 50))]
    got = sorted((r.doc_id, r.component_id, r.n_links, r.component is None) for r in J.jaccard_components(docs_frame(spark, rows), 3, 90).collect())
    assert got == sorted((i, c, n, False) for i, c, n in [(1, 0, 1), (1, 1, 3), (3, 1, 3), (0, 0, 1), (1, 1, 3), (7, 1, 3), (9, 9, 0)])


def test_blocks_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_BYTES", 4000)
    rng = np.random.default_rng(10)
    base, rows = words_text(rng, 150).split(" "), []
    for i in range(60):
        w = list(base)
        for _ in range(int(rng.integers(0, 5))):
            w[int(rng.integers(0, len(w)))] = f"x{rng.integers(0, 1000)}"
        rows.append((i, " ".join(w)))
    assert found(spark, rows, 3, 90) == brute(rows, 3, 90)


def test_join_block_derives_what_counting_gives():
    rng = np.random.default_rng(2)
    base = rng.choice(5000, 300, replace=False)
    sets = [np.unique(np.concatenate((rng.choice(base, 290, replace=False), rng.integers(5000, 9000, int(rng.integers(0, 25)))))).astype(np.uint64) for _ in range(60)]
    got = {(x, int(y)) if x < y else (int(y), x) for x, near in J.join_block(sets, 90, np.full(60, 2)) for y in near}
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 90 * len(np.union1d(sets[a], sets[b]))}
    assert got == want and want
    side = np.arange(60) % 2
    cross = {(x, int(y)) if x < y else (int(y), x) for x, near in J.join_block(sets, 90, side) for y in near}
    assert cross == {(a, b) for a, b in want if side[a] != side[b]}
