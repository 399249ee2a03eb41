"""Scalar functions on names, digests and descriptors."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that mark a version of a title.
VERSION_WORDS = "album live remaster remastered version mix remix take edit recording instrumental karaoke demo mono stereo lp".split()
_ANY = "|".join(VERSION_WORDS)
# What is taken from a title, in turn: brackets that hold a version word; all from the first such word on; a trailing copy number.
TITLE_CUTS = [rf"[(\[][^)\]]*\b({_ANY})\b[^)\]]*[)\]]", rf"\b({_ANY})\b[^\n]*$", r"[_-]\s*(take\s*)?[0-9]+$"]
_PYTHON_CUTS = [re.compile(p.replace("[0-9]", r"\d"), re.IGNORECASE) for p in TITLE_CUTS]  # digits of every script


def title_of(name: str) -> str:
    """The key under which versions of one title meet: see :func:`canonical_title`."""
    file = re.split(r"[/\\]", name)[-1]
    stem = file.rpartition(".")[0] if "." in file.strip(".") else file
    text = unicodedata.normalize("NFKD", stem).casefold()
    for cut in _PYTHON_CUTS:
        text = cut.sub(" ", text)
    return re.sub("[^a-z0-9]", "", text) or f"untitled-{file.casefold()}"


@F.pandas_udf(T.StringType())
def _titles(names: pd.Series) -> pd.Series:
    return names.map(title_of, na_action="ignore")


def canonical_title(name: Column) -> Column:
    """Title key of a file name, exact for all of Unicode (its decomposition has no SQL form). A title that is nothing but a version word becomes ``untitled-<name>``."""
    return _titles(name)


def ascii_title(name: Column) -> Column:
    """The same for ASCII names, in SQL alone."""
    file = F.regexp_extract(name, r"([^/\\]*)$", 1)
    text = F.lower(F.regexp_replace(file, r"(?<=.)\.[^.]*$", ""))
    for cut in TITLE_CUTS:
        text = F.regexp_replace(text, cut, " ")
    key = F.regexp_replace(text, "[^a-z0-9]", "")
    return F.when(key == "", F.concat(F.lit("untitled-"), F.lower(file))).otherwise(key)


def combined_digest(values: Column) -> Column:
    """SHA-256 of an ordered list of strings, a line each."""
    return F.sha2(F.array_join(F.transform(values, lambda v: F.concat(v, F.lit("\n"))), ""), 256)


def group_id(paths: Column) -> Column:
    """Name of a group from its members' paths, in whatever order."""
    return F.concat(F.lit("grp_"), F.left(F.sha2(F.array_join(F.array_sort(paths), "\n"), 256), F.lit(16)))


def prediction_key(name: Column) -> Column:
    """Column name for a method: lower case, words joined by ``_``, no brackets."""
    return F.translate(F.lower(name), "- ()", "__")


def point_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two points given as arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


# Descriptors by group, in the order in which they are computed.
FEATURE_GROUPS = {
    "scale": "duration_beats onset_count onset_density".split(),
    "pitch": "pitch_mean pitch_std pitch_range pitch_q10 pitch_q90".split(),
    "interval_contour": (
        "interval_abs_mean interval_abs_std interval_abs_max step_fraction leap_fraction repeat_fraction ascending_fraction descending_fraction direction_change "
        "contour_slope pitch_autocorrelation interval_entropy interval_unison_fraction interval_step_fraction interval_third_fourth_fraction "
        "interval_fifth_seventh_fraction interval_octave_fraction interval_large_fraction"
    ).split(),
    "dynamics": "velocity_mean velocity_std velocity_range velocity_change_abs_mean velocity_change_std pitch_velocity_correlation".split(),
    "rhythm": "ioi_mean ioi_std ioi_cv ioi_q25 ioi_q75 offbeat_fraction rhythm_regularity ioi_entropy".split(),
    "tonality": ["pitch_class_entropy", "pitch_class_peak", "pitch_class_top3", *(f"pc_{i}" for i in range(12))],
}
FEATURES = [name for names in FEATURE_GROUPS.values() for name in names]


def feature_group(name: str) -> str | None:
    return next((g for g, names in FEATURE_GROUPS.items() if name in names), None)


# Characters that LaTeX gives a meaning, and what prints them.
LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}"}


def latex_escape(text: str) -> str:
    return "".join(LATEX.get(c, c) for c in text)


def latex_number(value: float, digits: int = 2) -> str:
    return f"{value:.{digits}f}"


def latex_macros(values: dict[str, object]) -> str:
    """A file of macros, one for each value."""
    return "".join(f"\\newcommand{{\\{name}}}{{{latex_number(v) if isinstance(v, float) else latex_escape(str(v))}}}\n" for name, v in values.items())


def latex_conflicts(rows: list[dict], top: int = 8) -> str:
    """Table lines of the genre pairs with the most conflicts: count, pair, versions and the first title, 55 characters of it."""
    best = sorted(rows, key=lambda r: (-r["group_count"], r["genres"]))[:top]
    return "".join(f"{latex_escape(r['genres'])} & {r['group_count']} & {r['versions']} & {latex_escape((r['title'] or '')[:55])} \\\\\n" for r in best)
