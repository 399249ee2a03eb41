"""Duplicate groups over several identifiers, conflicts between classes, and the audit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import group_id
from .graph import connected_components
from .staging import staged

IDENTIFIERS = ("canonical_title", "sha256", "melody_fingerprint")


def duplicate_labels(files: DataFrame, identifiers: tuple[str, ...] = IDENTIFIERS) -> DataFrame:
    """``files`` (path, genre, identifiers) with ``label``, the smallest path that is reached by equal identifiers.

    Every file points at the first file with its identifier: a star for each value, one equi-join an identifier, no join on
    alternatives. Null and empty identifiers link nothing. ``files`` is written first, so identifiers are derived once, not for each star and join.
    """
    files = staged(files, "identified")
    edges = None
    for c in identifiers:
        known = files.where(F.col(c).isNotNull() & (F.col(c) != "")).select("path", c)
        first = known.groupBy(c).agg(F.min("path").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
        star = known.join(first, c).where(F.col("path") != F.col("_first")).select(F.col("path").alias("a"), F.col("_first").alias("b"))
        edges = star if edges is None else edges.unionByName(star)
    labels = connected_components(edges).withColumnRenamed("node", "path")
    return files.join(labels, "path", "left").withColumn("label", F.coalesce("component", "path")).drop("component")


def duplicate_groups(labelled: DataFrame) -> DataFrame:
    """A row for each group: group (named after all its paths), label, genres, cross_genre, versions, titles, files.

    The name is by definition a digest of all paths in order, so one task sees a group's paths, once.
    """
    return (
        labelled.groupBy("label")
        .agg(F.array_sort(F.collect_set("genre")).alias("genres"), F.count("*").alias("versions"), F.array_sort(F.collect_set("canonical_title")).alias("titles"), F.array_sort(F.collect_list("path")).alias("files"))
        .withColumns({"group": group_id(F.col("files")), "cross_genre": (F.size("genres") > 1).cast("int")})
    )


def identifier_audit(files: DataFrame, identifiers: tuple[str, ...] = IDENTIFIERS) -> DataFrame:
    """(identifier, duplicate_sets): how many values of each identifier several files share."""
    out = None
    for c in identifiers:
        sets = files.where(F.col(c).isNotNull() & (F.col(c) != "")).groupBy(c).count().where("count > 1").agg(F.count("*").alias("duplicate_sets")).select(F.lit(c).alias("identifier"), "duplicate_sets")
        out = sets if out is None else out.unionByName(sets)
    return out


def conflict_summary(groups: DataFrame) -> DataFrame:
    """Of the groups that span classes: by the classes, how many groups and versions, and title and file of the group that comes first by name."""
    return (
        groups.where("cross_genre = 1")
        .withColumn("genres", F.array_join("genres", "/"))
        .groupBy("genres")
        .agg(F.count("*").alias("group_count"), F.sum("versions").alias("versions"), F.min_by(F.get("titles", F.lit(0)), "group").alias("title"), F.min_by(F.get("files", F.lit(0)), "group").alias("file"))
    )


def candidates(labelled: DataFrame) -> DataFrame:
    """Files of groups within one class; a group that spans classes goes as a whole."""
    groups = labelled.groupBy("label").agg(F.count_distinct("genre").alias("_g")).where("_g = 1").select("label")
    return labelled.join(groups, "label", "left_semi")


def balanced_sample(labelled: DataFrame, per_genre: int, seed: int, usable: str = "true") -> DataFrame:
    """One usable version of each of the first groups of each class, as many of each class.

    The order of groups and, apart from it, of versions is that of a hash with the seed: it depends on nothing else. A class with fewer
    groups than the quota lowers the quota of all. Raises when a class has none.
    """
    key = lambda *c: F.md5(F.concat_ws("|", F.lit(str(seed)), *c))
    version = W.partitionBy("genre", "label").orderBy(key(F.lit("version"), F.col("path")), "path")
    firsts = candidates(labelled).where(usable).withColumn("_v", F.row_number().over(version)).where("_v = 1").drop("_v")
    order = W.partitionBy("genre").orderBy(key(F.lit("group"), F.col("genre"), F.col("label")), "label")
    picked = firsts.withColumn("position", F.row_number().over(order)).where(F.col("position") <= per_genre)
    quota = picked.groupBy("genre").agg(F.max("position").alias("n")).agg(F.min("n").alias("_quota"))  # one row
    return picked.join(F.broadcast(quota), F.col("position") <= F.col("_quota")).drop("_quota")


def sample_by_rounds(labelled: DataFrame, per_genre: int, seed: int, parse: Callable[[DataFrame], DataFrame], max_rounds: int = 200) -> tuple[DataFrame, int]:
    """The balanced sample where only reading a file tells whether it is usable: (the sample of :func:`balanced_sample`, how many files were read).

    ``parse`` gets files (path, genre, label and all other columns of ``labelled``) and gives the paths of those that can be read. In each round just
    the next version of those of each class's
    first ``per_genre`` groups that have none yet is read; a version that fails gives way to the group's next one, and a group without another to the
    group that follows in the class. So hardly more files are read than
    are sampled, and none twice. Each round is written, so a lost executor costs no file that was read before. Raises if ``max_rounds`` (versions
    tried one after another) don't suffice.
    """
    key = lambda *c: F.md5(F.concat_ws("|", F.lit(str(seed)), *c))
    group = ["genre", "label"]
    files = staged(candidates(labelled), "sample-files")
    place = W.partitionBy("genre").orderBy(key(F.lit("group"), F.col("genre"), F.col("label")), "label")
    version = W.partitionBy(*group).orderBy(key(F.lit("version"), F.col("path")), "path")
    ordered = staged(files.select(*group, "path", F.row_number().over(version).alias("version")), "sample-versions")
    # a row for each group: its next version, and the path once one was read
    state = staged(ordered.groupBy(*group).agg(F.max("version").alias("last")).withColumns({"version": F.lit(1), "path": F.lit(None).cast("string")}), "sample-groups")
    read = 0
    for _ in range(max_rounds):
        leading = state.where("path IS NOT NULL OR version <= last").withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= per_genre)
        due = staged(leading.where("path IS NULL").select(*group, "version").join(ordered, [*group, "version"]), "sample-due")
        n = due.count()
        if not n:
            break
        read += n
        good = parse(files.join(due.select("path"), "path", "left_semi")).select("path").distinct().withColumn("_good", F.lit(True))
        tried = due.select(*group, F.col("path").alias("_tried")).join(good, F.col("_tried") == F.col("path"), "left").select(*group, "_tried", "_good")
        after = state.join(tried, group, "left")
        failed = F.col("_tried").isNotNull() & F.col("_good").isNull()
        state = staged(after.select(*group, "last", (F.col("version") + failed.cast("int")).alias("version"), F.coalesce("path", F.when(F.col("_good"), F.col("_tried"))).alias("path")), "sample-groups")
    else:
        raise RuntimeError(f"some groups have no readable version after {max_rounds} rounds")
    picked = state.where("path IS NOT NULL").withColumn("position", F.row_number().over(place)).where(F.col("position") <= per_genre)
    quota = picked.groupBy("genre").agg(F.max("position").alias("n")).agg(F.min("n").alias("_quota"))  # one row
    chosen = picked.join(F.broadcast(quota), F.col("position") <= F.col("_quota")).select("path", "position")
    return files.join(chosen, "path"), read


def checked_sample(sample: DataFrame) -> DataFrame:
    """The sample, stored, after making sure that there is one and that no group repeats."""
    stored = staged(sample, "sample")
    n, groups = stored.agg(F.count("*"), F.count_distinct("label")).first()
    if n == 0:
        raise ValueError("no usable groups in some class")
    if n != groups:
        raise ValueError("a group was sampled twice")
    return stored


def data_audit(labelled: DataFrame, per_genre: int, seed: int, usable: str = "true") -> DataFrame:
    """By class, and in total: files, groups that span classes, groups within the class, usable ones (the quota at most), and selected ones."""
    spans = labelled.groupBy("label").agg((F.count_distinct("genre") > 1).cast("int").alias("_x"))
    rows = labelled.join(spans, "label")
    groups = lambda where: F.count_distinct(F.when(where, F.col("label")))
    across, within = F.col("_x") == 1, F.col("_x") == 0
    counted = [F.count("*").alias("raw"), groups(across).alias("cross_genre_groups"), groups(within).alias("candidate_groups")]
    own = rows.groupBy("genre").agg(*counted, groups(within & F.expr(usable)).alias("_usable"))
    own = own.withColumn("usable_groups", F.least("_usable", F.lit(per_genre))).drop("_usable")
    chosen = balanced_sample(labelled, per_genre, seed, usable).groupBy("genre").agg(F.count("*").alias("selected"))
    by_genre = own.join(chosen, "genre", "left").withColumn("selected", F.coalesce("selected", F.lit(0)))
    all_ = rows.agg(F.lit("TOTAL").alias("genre"), *counted)
    summed = by_genre.agg(F.lit("TOTAL").alias("genre"), F.sum("usable_groups").alias("usable_groups"), F.sum("selected").alias("selected"))
    return by_genre.unionByName(all_.join(summed, "genre"))
