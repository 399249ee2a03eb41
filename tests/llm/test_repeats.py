"""Substring dedup against brute force, through tasks and through windows, and the cases that tables may hold."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from curvelark.llm import repeats
from tests.llm.util import docs_frame, words_text


def brute(texts, words):
    """(n_words, kept text, number of maximal repeats) of each text."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + words]) for w in split for i in range(len(w) - words + 1))
    out = []
    for w in split:
        hit = [i for i in range(len(w) - words + 1) if seen[tuple(w[i : i + words])] > 1]
        gone = {p for i in hit for p in range(i, i + words)}
        out.append((len(w), " ".join(t for p, t in enumerate(w) if p not in gone), sum(i - 1 not in hit for i in hit)))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(12)
    passage, line, long = words_text(rng, 60).split(), words_text(rng, 12), words_text(rng, 3000)
    rows = [(i, words_text(rng, int(rng.integers(1, 120)))) for i in range(40)]
    for i in range(40, 140):  # a passage, or a part of it, amid other words
        a, b = sorted(rng.integers(0, 61, 2))
        rows.append((i, "\t".join([words_text(rng, int(rng.integers(0, 30))), " ".join(passage[a:b]), words_text(rng, int(rng.integers(0, 30)))])))
    rows += [(i, f"{words_text(rng, 20)}\n{line}\n{words_text(rng, 25)}") for i in range(200, 240)]  # too short a line to go
    rows += [(300, "a " * 34), (301, "b " * 35), (302, "c " * 36), (303, "d " * 300), (304, " ".join("xyz"[j % 3] for j in range(90)))]
    rows += [(400 + i, long) for i in range(5)] + [(410, long.upper()), (411, long[:9000] + " end"), (412, long[3000:]), (413, "short copy"), (414, "short copy")]
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "é " * 40 + "  x"), (None, words_text(rng, 50)), (None, long), (7, rows[8][1] + " z"), (8, rows[8][1])]
    return rows + [(600, "word" + "x" * 5000 + " " + words_text(rng, 40)), (601, "word" + "x" * 5000 + " " + words_text(rng, 40))]


@pytest.mark.parametrize("hot_rows", [4096, 3])
def test_against_brute_force(spark, rows, hot_rows):
    got = repeats.remove_repeats(docs_frame(spark, rows, extra=True), ["doc_id", "text"], 35, hot_rows).collect()
    want = sorted(((-1 if i is None else i), t or "", *x) for (i, t), x in zip(rows, brute([t for _, t in rows], 35), strict=True))
    assert sorted(((-1 if r.doc_id is None else r.doc_id), r.text or "", r.n_words, r.kept_text, len(r.repeats)) for r in got) == want
    assert all(r.n_removed == r.n_words - len(r.kept_text.split(" ")) or r.kept_text == "" and r.n_removed == r.n_words or " " in (r.text or "") for r in got)


@pytest.mark.parametrize("words", [3, 8, 11])
def test_other_lengths(spark, words):
    rng = np.random.default_rng(words)
    rows = [(i, " ".join(rng.choice(list("abcd"), int(rng.integers(0, 30))))) for i in range(60)]
    got = {r.doc_id: (r.n_words, r.kept_text, len(r.repeats)) for r in repeats.remove_repeats(docs_frame(spark, rows), ["doc_id"], words, 5).collect()}
    assert got == dict(zip([i for i, _ in rows], brute([t for _, t in rows], words), strict=True))


def test_empty_table(spark):
    assert repeats.remove_repeats(docs_frame(spark, []), ["doc_id"]).count() == 0


def test_pieces_and_segments(monkeypatch):
    """Hashes and anchors do not depend on where long texts are cut."""
    rng = np.random.default_rng(5)
    texts = [words_text(rng, 700).encode(), b"", b"q" * 900 + b" " + words_text(rng, 90).encode(), b"w" * 1500, words_text(rng, 40).encode()]
    whole = repeats.Seeds(texts, 35)
    hashes, bounds = repeats.word_hashes(texts)
    assert list(np.diff(bounds)) == [len(t.split()) for t in texts]
    monkeypatch.setattr(repeats, "_PIECE", 256)
    monkeypatch.setattr(repeats, "_LONG", 100)
    cut, _ = repeats.word_hashes(texts)
    long = [len(w) > 100 for t in texts for w in t.split()]
    assert (cut == hashes).tolist() == [not x for x in long]  # these are hashed another way
    monkeypatch.undo()
    monkeypatch.setattr(repeats, "_SEGMENT", 64)
    parts = repeats.Seeds(texts, 35)
    assert (parts.reach == whole.reach).all() and parts.count.sum() == whole.count.sum()
    assert set(zip(parts.doc.tolist(), parts.place.tolist(), parts.name.tolist(), strict=True)) == set(zip(whole.doc.tolist(), whole.place.tolist(), whole.name.tolist(), strict=True))


def test_query_has_digests_of_what_is_kept(spark, sf):
    got = {r.doc_id: r for r in repeats.op12_seed_extend_dedup(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    for d, (n, kept, runs) in zip(docs, brute([d.text for d in docs], 35), strict=True):
        r = got[d.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256, r.n_repeats) == (n, n - len(kept.split()), hashlib.sha256(kept.encode()).hexdigest(), runs)
