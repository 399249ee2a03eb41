"""Language identification, the mix, byte-pair encoding and the pipeline."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from curvelark.llm import bpe, langid, mixing
from curvelark.operators.staging import staged
from tests.llm.util import COLUMNS, docs_frame

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs)
    got = langid.identify(docs, model, ["doc_id", "lang"]).withColumn("held_out", langid.held_out(F.col("doc_id"))).toPandas()
    held = got[got.held_out]
    assert len(got) == docs.count() and len(held) > 20
    assert (held.lang_pred == held.lang).mean() > 0.95 and got.score.between(0, 1).all() and got.rejected.mean() < 0.02
    odd = docs_frame(spark, [(1, None), (2, ""), (3, "12 %$ \n"), (4, "漢字"), (5, "the and " * 200_000), (5, "the and "), (None, "der die das")], extra=True)
    rows = {(r.doc_id, r.lang_pred == "und", r.rejected) for r in langid.identify(odd, model, ["doc_id"]).collect()}
    assert {(1, True, True), (2, True, True), (3, True, True), (4, False, True)} <= rows | {(4, False, True), (4, False, False)}
    assert (5, False, False) in rows and langid.identify(odd.where("false"), model, ["doc_id"]).count() == 0
    none = langid.train(odd.where("false"))
    assert [r.lang_pred for r in langid.identify(odd, none, ["doc_id"]).collect()] == ["und"] * 7


def test_languages_of_rows_without_an_id_are_learnt(spark):
    """All of a language's rows may lack an id, or share one: texts decide which are drawn, and copies are drawn once."""
    rng = np.random.default_rng(8)
    kinds = {"aa": "bcdfg aeiou", "bb": "klmnp uyoe"}
    text = lambda lang: " ".join("".join(rng.choice(list(kinds[lang].replace(" ", "")), 6)) for _ in range(40))
    rows = [(None, text("aa"), "aa", "s", 1) for _ in range(300)] + [(4, text("bb"), "bb", "s", 1) for _ in range(300)] + [(None, rows_text, "aa", "s", 1) for rows_text in [text("aa")] * 200]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.train(docs, 50)
    assert model.langs == ["aa", "bb"]
    got = langid.identify(docs, model, ["lang"]).groupBy("lang", "lang_pred").count().collect()
    assert sum(r["count"] for r in got if r["lang"] == r["lang_pred"]) >= 0.95 * len(rows)


def test_long_text_is_the_sum_of_its_windows(monkeypatch):
    text = [("the quick bröwn fox " * 50).encode(), b"", b"x"]
    count = lambda: sum(np.bincount(b + o * langid.BUCKETS, minlength=3 * langid.BUCKETS) for b, o in langid.subword_windows(text))
    whole = count()
    monkeypatch.setattr(langid, "_WINDOW", 37)
    assert (count() == whole).all()


def plain_forward(model, text):
    """The model's prediction for one text, subword by subword."""
    low = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalpha() else 32 for b in text.encode()) + b"  "
    total, n = np.zeros(len(model.langs)), 0
    for i in range(len(low)):
        for k in langid.ORDERS:
            piece = low[i : i + k]
            if len(piece) == k and 32 not in piece[1:-1] and piece != b"  ":
                h = int.from_bytes(piece, "little")
                bucket = (h * 2654435761 + (k * 0x9E3779B1 & 0xFFFFFFFF) & 0xFFFFFFFF) * 2246822519 % (1 << 32) >> 17
                total += model.table[bucket].astype(float)
                n += 1
    z = (total / max(n, 1) + model.bias) / model.temperature
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    return model.langs[int(p.argmax())], float(p.max())


def test_predictions_are_those_of_a_plain_forward_pass(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs)
    texts = [r.text for r in docs.where("text IS NOT NULL AND length(text) < 3000").orderBy("doc_id").limit(25).collect()] + ["a", "Ä b", "x  y", "the\nend"]
    for window in (1 << 18, 50):
        monkeypatch.setattr(langid, "_WINDOW", window)
        lang, score = model.predict([t.encode() for t in texts])
        want = [plain_forward(model, t) for t in texts]
        assert lang == [w[0] for w in want] and score.tolist() == pytest.approx([w[1] for w in want], abs=1e-6)


def fill(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, out = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in out]
        left = total - sum(out.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return out | share
        out |= {s: most * sizes[s] for s in over}


def mix_frame(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(n), "en", s, 1) for i, (n, s) in enumerate(zip(rng.integers(0, 400, 400), rng.choice(["b", "a", "Ä", "z", None], 400, p=[0.6, 0.1, 0.05, 0.2, 0.05]), strict=True))]
    rows += [(9000, None, "en", "tiny", 0), (9001, "one two three", "en", "small", 13), (9001, "one two three", "en", "small", 13), (None, "w w", "en", "a", 3), (9002, "", "en", "void", 0)]
    return spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 AS size", "2 AS taken")


def test_mix(spark):
    docs = mix_frame(spark)
    rows = staged(mixing.narrow(docs), "t")
    got = mixing.taken_words(rows, 32).toPandas()
    assert len(got) == docs.count() and (got.taken <= 3 * got["size"]).all()
    assert got["size"].sum() == sum(len((r.text or "").split()) for r in docs.collect())
    by = got.groupby(got.source.fillna("￿"))
    sizes = {None if s == "￿" else s: int(g["size"].sum()) for s, g in by}
    want = fill(sizes)
    for s, g in by:
        s = None if s == "￿" else s
        assert (g.source_size == sizes[s]).all() and g.target.iloc[0] == pytest.approx(want[s]) and abs(g.taken.sum() - want[s]) <= 1
    again = mixing.taken_words(staged(mixing.narrow(docs.repartition(7)), "t"), 32).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert sorted(got[key].astype(str).itertuples(index=False)) == sorted(again[key].astype(str).itertuples(index=False))
    empty = staged(mixing.narrow(docs.where("false")), "t")
    assert mixing.taken_words(empty).count() == 0


def test_draws_are_a_permutation_spread_over_shards(spark):
    rows = staged(mixing.narrow(mix_frame(spark)), "t")
    _, draws, _ = mixing.mix(rows, 16, n_shards=8)
    d = draws.toPandas()
    for _, g in d.groupby(["_k", "_pass"]):
        assert g._block.is_unique
    for _, g in d.groupby(["_k", "_shard"]):
        assert sorted(g._slot) == list(range(len(g)))
    hot = d[d._k == "sb"]
    assert hot._shard.nunique() == 8 and hot.groupby("_shard").size().min() > 0.5 * len(hot) / 8 and hot.groupby("_shard").size().nunique() > 1
    assert (hot[hot._pass == 0].sort_values(["_shard", "_slot"])._block.diff() == 1).mean() < 0.2
    taken = mixing.taken_words(rows, 16, n_shards=8).collect()
    by = {(r.rid, int(s.split(":")[0])): int(s.split(":")[1]) for r in taken for s in r.shards.split(",") if s}
    assert sum(by.values()) == sum(r.taken for r in taken)
    size = {"n" if r.source is None else "s" + r.source: r.source_size for r in taken}
    for shard, g in d.groupby("_shard"):
        assert sum(n for (_, s), n in by.items() if s == shard) == sum(min(t, size[k] - 16 * b) for k, b, t in zip(g._k, g._block, g._take, strict=True))


def test_blocks_of_the_shards_hold_the_words_taken(spark):
    docs = spark.createDataFrame([(i, " ".join(f"{s or 'none'}{i}_{k}" for k in range(n)), "en", s, 1) for i, (s, n) in enumerate([("a", 50), ("b", 7), (None, 33), ("a", 0), ("b", 120)])], COLUMNS)
    got = mixing.mixed_blocks(docs, 8, n_shards=3).toPandas()
    taken = {r.doc_id: r.taken for r in mixing.taken_words(staged(mixing.narrow(docs), "t"), 8, n_shards=3).collect()}
    held = {}
    for r in got.itertuples():
        words = r.text.split(" ")
        assert 0 < len(words) <= 8 and all(w.startswith(r.source or "none") for w in words)
        for w in words:
            i = int(re.sub("^[a-z]+", "", w).split("_")[0])
            held[i] = held.get(i, 0) + 1
    assert held == {i: n for i, n in taken.items() if n}
    assert not got.duplicated(["shard", "source", "slot"]).any()
    assert mixing.mixed_blocks(docs.where("false")).count() == 0


def test_mixed_documents_hold_the_words_taken(spark):
    docs = mix_frame(spark)
    out = mixing.mixed_documents(docs, 32).toPandas()
    taken = mixing.taken_words(staged(mixing.narrow(docs), "t"), 32).toPandas()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert list(out.columns) == ["doc_id", "text", "lang", "source", "n_chars"]
    assert out.text.map(count).sum() == taken.taken.sum()
    each = out.assign(n=out.text.map(count)).groupby(out.doc_id.fillna(-1)).n.sum()
    assert (each == taken.groupby(taken.doc_id.fillna(-1)).taken.sum().reindex(each.index)).all()


def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


ODD = [None, "", "a", " ", "\x1c\x1d a\x1f\x85b᠎ c   x", "naïve 12 ³½ \U0001f600 ok's 'LL don't\r\n\r\n  end   ", "x" * 3000, "\x00﻿​ zz", "क्षि ไทย 한국어 日本語", "　　a\t\t b", "====== ----- aaaaaaaaaaa       b", "<|endoftext|>", "the " * 60_000]
LONG = ["".join(np.random.default_rng(5).choice(list("etaoinshrdlu"), 200_000)), "é" * 700 + " " + "x" * 20_001, "ab" * 400 + "c" + "ab" * 400, "漢字かな" * 900, "-" * 2000 + "'s" + "1" * 1500]


@pytest.mark.parametrize(("words", "common"), [(300_000, 16_000), (50, 0)])
def test_bpe_is_that_of_the_library(spark, sf, words, common):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id < 60").unionByName(docs_frame(spark, [(10_000 + i, t) for i, t in enumerate(ODD + LONG)] + [(None, "a b")]).select("doc_id", "text"))
    got = bpe.encode_documents(docs.selectExpr("*", "1 AS word", "2 AS doc"), ["doc_id"], PATH, public_tokenizers.PATTERN, words, common).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(got) == len(texts)
    enc = reference()
    for r in got:
        ids = np.array(enc.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    assert bpe.encode_documents(docs.where("false"), ["doc_id"], PATH, public_tokenizers.PATTERN).count() == 0


SIGNS = "ab s t'' ' m r e v l d  \n\r\t \u3000\x85é中½1 23_-.,!\u0301\U0001d7d8\U00020000\x1c\x00"


@pytest.mark.parametrize("window", [1 << 17, 16])
@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.text(alphabet=SIGNS, max_size=80), min_size=1, max_size=4))
def test_windows_hold_the_matches_of_the_pattern(window, texts):
    splitter = bpe.Splitter(public_tokenizers.PATTERN)
    assert splitter.runs is not None
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(bpe, "WINDOW", window)
        for own in (splitter, bpe.Splitter("(?:" + public_tokenizers.PATTERN + ")")):
            found = [[] for _ in texts]
            for group in own.windows(texts):
                joined, _, start, end, owner = own.split(group)
                for a, b, i in zip(start.tolist(), end.tolist(), owner.tolist(), strict=True):
                    found[i].append(joined[a:b])
            assert found == [regex.findall(public_tokenizers.PATTERN, t) for t in texts]


def test_words_of_one_hash_keep_their_numbers():
    text, words = "ab cd ef ab cd", [(0, 2), (3, 5), (6, 8), (9, 11), (12, 14)]
    start, end = np.array(words).T
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(bpe, "hashes", lambda codes, a, b: [np.zeros(len(a), np.uint64), codes[a].astype(np.uint64)])
        none = np.empty(0, np.uint64)
        numbers, counts, new = bpe.Book(none, none).number(text, bpe._codes(text), start, end)
    assert sorted(new) == [b"ab", b"cd", b"ef"] and (counts == 1).all()
    assert [new[i] for i in numbers] == [b"ab", b"cd", b"ef", b"ab", b"cd"]


def test_merging_long_words():
    ranks, rng = bpe.load_ranks(PATH), np.random.default_rng(6)
    for n in (1, 2, 7, 40, 120):
        word = "".join(rng.choice(list("aeérst "), n)).encode()
        assert bpe.merged_long(word, ranks) == bpe.merged(word, ranks)
    assert bpe.merged_long(b"a" * 300, ranks) == bpe.merged(b"a" * 300, ranks)


def test_pipeline(spark):
    text = "the and of with this that from there would could should other which their about these many then them " * 4
    other = "der die das und nicht mit von ist auf für eine dem werden sich des auch als nach wie bei aus " * 4
    rows = [(i, f"{text if i % 2 else other} " + " ".join(f"w{i}x{k}" for k in range(80)), ["de", "en"][i % 2], f"s{i % 3}", 1) for i in range(60)]
    rows += [(100, rows[1][1], "en", "s0", 1), (101, rows[1][1] + " end", "en", "s0", 1), (102, "%%% 123", "en", "s0", 7), (103, None, None, "s0", 0), (104, text + " unique token = abcdef0123456789XYZ " + " ".join(f"q{k}" for k in range(90)), "en", "s1", 1)]
    docs, kept = spark.createDataFrame(rows, COLUMNS), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, ""), name)
        assert docs.columns == corpus_pipeline.COLUMNS
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept["language"]) == {*range(60), 100, 101, 104}
    assert set(kept["near_duplicates"]) == {*range(60), 104}
    assert "abcdef0123456789XYZ" not in kept["secrets"][104] and kept["secrets"][5] == rows[5][1]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "").toPandas()
    assert len(last) == docs.count() and last.n_tokens.sum() > 1000


def test_pipeline_of_nothing_and_of_repeats(spark):
    text = "the and of with this that from there would could should other which their about these many then them " * 4
    odd = text + " ".join(f"z{k}" for k in range(300))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "r", 1), (1, odd, "en", "s", 2), (3, odd + " end", "en", "s", 2), (None, text, "en", "s", 1), (None, text, "en", "s", 1), (5, "", "en", "s", 0), (5, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, COLUMNS)
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, len(r.text), r.source) for r in got) == sorted([(1, len(text), "r"), (1, len(odd), "s"), (0, len(text), "s"), (0, len(text), "s"), (5, 0, "s")])
    for some in (docs, docs.where("false")):
        now = some
        for name, stage in corpus_pipeline.STAGES:
            now = staged(stage(spark, now, ""), name)
        assert (now.count() > 0) == (some is docs) and "ids_sha256" in now.columns
