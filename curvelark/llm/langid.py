"""Language identification: averaged hashed subword embeddings, a linear softmax, and calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import release_memory, small_batches

#: Rows that the model is fitted to, at most, for each language.
FIT_ROWS = 700
#: Buckets of the hashed subwords, and the length of an embedding.
BUCKETS, DIM = 1 << 15, 16
#: Lengths of the subwords in bytes; a word's ends count as a byte.
ORDERS = (2, 3, 4)
#: Share of right calibration predictions that the rejection threshold lets pass, and the threshold's ceiling.
KEEP, CEILING = 0.999, 0.4
#: Share of a label that is spread over all languages in training, so that certainty stays finite.
SMOOTHING = 0.02
UNDETERMINED = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[b for b in range(128) if not chr(b).isalpha()]] = 32
_ASCII_LETTERS = np.zeros(256, bool)
_ASCII_LETTERS[[*range(65, 91), *range(97, 123)]] = True
_WINDOW = 1 << 18


def subword_windows(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all subwords of all texts, in bounded windows: (bucket, text number) of those within one word.

    Bytes are lower-cased and what is no letter below 128 becomes a space; a subword holds a space at its ends only, and
    bytes of one text only: of the two spaces between texts none begins a subword.
    """
    raw = np.frombuffer(b"  ".join(texts) + b"    ", np.uint8)
    ends = np.cumsum([len(t) + 2 for t in texts])
    for at in range(0, len(raw) - 4, _WINDOW):
        x = _LOWER[raw[at : at + _WINDOW + 3]].astype(np.uint32)
        n = min(_WINDOW, len(x) - 3)
        space = x == 32
        owner = None
        h = x[:n].copy()
        ok = np.ones(n, bool)
        between = ends[np.searchsorted(ends, at + 1) : np.searchsorted(ends, at + n, "right")] - 1 - at
        ok[between] = False
        for k in range(2, max(ORDERS) + 1):
            h |= x[k - 1 : k - 1 + n] << np.uint32(8 * (k - 1))
            if k > 2:
                ok &= ~space[k - 2 : k - 2 + n]
            keep = ok if k > 2 else ok & ~(space[:n] & space[1 : n + 1])
            if k in ORDERS:
                if owner is None:
                    owner = np.searchsorted(ends, np.arange(at, at + n), side="right")
                bucket = ((h * np.uint32(2654435761) + np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(2246822519)) >> np.uint32(32 - 15)
                keep = keep & (owner < len(texts))
                yield bucket[keep], owner[keep]


def has_letter(text: bytes) -> bool:
    """Whether there is any Unicode letter."""
    if _ASCII_LETTERS[np.frombuffer(text, np.uint8)].any():
        return True
    return any(c.isalpha() for c in text.decode())


@dataclass
class LanguageModel:
    """``table`` holds, for each bucket, the product of its embedding with the softmax weights, so that a text's logits are a mean of rows."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
        """Language and calibrated probability of each text; ``und`` and 0 where it is null or has no letter."""
        at = [i for i, t in enumerate(texts) if t and self.langs and has_letter(t)]
        lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if at:
            total, count = np.zeros((len(at), len(self.langs))), np.zeros(len(at))
            for bucket, owner in subword_windows([texts[i] for i in at]):
                if len(owner):
                    starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                    total[owner[starts]] += np.add.reduceat(self.table[bucket], starts, axis=0, dtype=np.float64)
                    count[owner[starts]] += np.diff(np.append(starts, len(owner)))
            p = _softmax((total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature)
            best = p.argmax(axis=1)
            for row, i in enumerate(at):
                lang[i], score[i] = self.langs[best[row]], p[row, best[row]]
        return lang, score


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(examples: list[tuple[np.ndarray, np.ndarray, str]], epochs: int = 8, rate: float = 1.0, short: int = 60, seed: int = 3) -> LanguageModel:
    """From (buckets, counts, language): stochastic gradient descent, one text a step, in turn whole and as few drawn subwords, so that short texts are learnt too.

    A fifth of the examples is kept for calibration: the temperature with the least loss, and the
    threshold below which few of its right predictions lie.
    """
    langs = sorted({e[2] for e in examples})
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(examples))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    embed = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    weight, bias = np.zeros((DIM, len(langs))), np.zeros(len(langs))
    at = {x: i for i, x in enumerate(langs)}

    def part(buckets: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        drawn = buckets[rng.choice(len(buckets), n, p=counts / counts.sum())]
        return drawn, np.ones(n)

    steps = max(1, epochs * len(used))
    for step in range(steps if len(langs) > 1 else 0):
        if step % max(1, len(used)) == 0:
            used = rng.permutation(used)
        buckets, counts, lang = examples[used[step % len(used)]]
        if not len(buckets):
            continue
        if step % 2:
            buckets, counts = part(buckets, counts, short)
        share = (counts / counts.sum())[:, None]
        mean = (embed[buckets] * share).sum(axis=0)
        p = _softmax((mean @ weight + bias)[None])[0]
        p -= SMOOTHING / len(langs)
        p[at[lang]] -= 1 - SMOOTHING
        lr = rate * (1 - step / steps)
        back = weight @ p
        weight -= lr * np.outer(mean, p)
        bias -= 0.1 * lr * p
        np.subtract.at(embed, buckets, lr * 20 * share * back)
    model = LanguageModel(langs, (embed @ weight).astype(np.float32), bias, 1.0, 0.0)
    z, y = [], []
    for i in held:
        buckets, counts, lang = examples[i]
        for b, c in ((buckets, counts), part(buckets, counts, short) if len(buckets) else (buckets, counts)):
            if len(b):
                z.append((model.table[b] * (c / c.sum())[:, None]).sum(axis=0) + bias)
                y.append(at[lang])
    if z and len(langs) > 1:
        z, y = np.array(z), np.array(y)
        loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.5, 10, 31), key=loss))
        p = _softmax(z / model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == y]
        model.threshold = float(min(CEILING, np.quantile(right, 1 - KEEP))) if len(right) else 0.0
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, fit_rows: int = FIT_ROWS) -> LanguageModel:
    """Fit to documents with a language and text, held-out ones aside: about ``fit_rows`` of each language, chosen by a hash of id and text, and twice as many in all at most.

    Executors reduce the chosen texts to counts of buckets; only those reach the driver. Without any such row there
    is no language, and every text is undetermined.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text", F.pmod(F.xxhash64(F.lit(9), "doc_id", "text"), F.lit(1 << 40)).alias("_h"))
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    limit = F.element_at(F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(int(min(1.0, fit_rows / r["count"]) * (1 << 40))))]), F.col("lang"))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ns = [], []
            for t in b["text"].cast(pa.binary()).to_pylist():
                n = np.zeros(BUCKETS, np.int64)
                for bucket, _ in subword_windows([t]):
                    n += np.bincount(bucket, minlength=BUCKETS)
                found = np.flatnonzero(n)
                ids.append(found.astype(np.uint16).tobytes())
                ns.append(n[found].astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([b["lang"], b["_h"], pa.array(ids, pa.binary()), pa.array(ns, pa.binary())], ["lang", "h", "ids", "ns"])

    # by hash again: of rows that repeat an id and a text one stays, and no number of rows comes to more than the bound
    chosen = rows.where(F.col("_h") < limit).dropDuplicates(["lang", "_h"])
    sample = chosen.mapInArrow(reduce, "lang string, h long, ids binary, ns binary").orderBy("h", "lang").limit(2 * fit_rows * len(counts)).collect()
    sample.sort(key=lambda r: (r["h"], r["lang"], bytes(r["ids"])))
    sample = list({(r["lang"], bytes(r["ids"]), bytes(r["ns"])): r for r in sample}.values())  # copies would flatter the calibration
    model = fit([(np.frombuffer(r["ids"], np.uint16), np.frombuffer(r["ns"], np.uint32), r["lang"]) for r in sample])
    del sample
    release_memory()
    return model


def identify(docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred, score and rejected (undetermined, or less certain than the calibrated threshold).

    Every row has a result, which depends on its text alone; texts are whole, empty and very long ones too. Repeated rows and null ids are rows like others, columns of other names
    are ignored, an empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS rows of a float for each language
    given = docs.select(*keep, F.col("text").alias("_text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = shared.value.predict(b["_text"].cast(pa.binary()).to_pylist())
            rejected = [x == UNDETERMINED or s < shared.value.threshold for x, s in zip(lang, score, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*keep, "lang_pred", "score", "rejected"])
        release_memory()

    schema = ", ".join(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in keep)
    return given.mapInArrow(predict, f"{schema}, lang_pred string, score double, rejected boolean")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs), ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
