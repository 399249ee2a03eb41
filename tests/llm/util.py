import numpy as np

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, rows, extra=False):
    """(doc_id, text) as documents; with ``extra``, columns whose names clash with those that operators use inside."""
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    df = spark.createDataFrame(full, COLUMNS)
    if extra:
        for c in ("n", "doc", "token", "size", "shard", "component_id", "_k", "rid", "print", "key", "slice", "ids", "word", "spans", "score", "lang_pred", "_text", "law", "_range"):
            df = df.selectExpr("*", f"'x' AS `{c}`")
    return df


def words_text(rng: np.random.Generator, n: int, letters: str = "abcdefghij") -> str:
    return " ".join("".join(rng.choice(list(letters), 6)) for _ in range(n))
