"""Data-quality audit: manifests, counts against expectation, exact and near duplicates, review tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustmill.functions.storage import saved
from trustmill.operators.hamming import block_links, block_pairs, close_pairs, in_blocks
from trustmill.operators.prefix import numbered


def first_label(columns: list[str], otherwise: str = "unlabelled") -> Column:
    """Name of the first one-hot column that is 1."""
    return reduce(lambda acc, c: F.when(F.col(c) == 1, c).otherwise(acc), reversed(columns), F.lit(otherwise))


def label_problems(labels: DataFrame, files: DataFrame, columns: list[str], key: str = "path") -> DataFrame:
    """(key, problem): rows without exactly one label, listed files that are missing, files that are not listed."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in columns])
    bad = labels.where(total != 1).select(key, F.lit("label count is not one").alias("problem"))
    missing = labels.join(files, key, "left_anti").select(key, F.lit("listed but missing").alias("problem"))
    extra = files.join(labels, key, "left_anti").select(key, F.lit("present but unlisted").alias("problem"))
    return bad.unionByName(missing).unionByName(extra)


def listed_files(labels: DataFrame, files: DataFrame, columns: list[str], key: str = "path", folder: str = "", ending: str = "") -> DataFrame:
    """(key, label, path): listed files that are present, by the label that is 1, with the path folder + key + ending."""
    path = F.concat(F.lit(folder), F.col(key).cast("string"), F.lit(ending))
    return labels.join(files.select(key).distinct(), key, "left_semi").select(key, first_label(columns).alias("label"), path.alias("path"))


def file_selection(names: DataFrame, found: DataFrame, copied: DataFrame, key: str, size: str, left_out: Column) -> DataFrame:
    """(key, state) for a filtered copy: of the listed names, 'missing' where there is no file, 'there' where a copy of
    the same size exists, else 'copy'; 'left out' for files under the condition left_out that no row names. Copying
    itself is up to the caller."""
    own = found.select(key, F.col(size).alias("_size"))
    state = F.when(F.col("_size").isNull(), "missing").when(F.col("_size") == F.col("_copy"), "there").otherwise("copy")
    rows = names.select(key).join(own, key, "left").join(copied.select(key, F.col(size).alias("_copy")), key, "left").select(key, state.alias("state"))
    return rows.unionByName(found.where(left_out).join(names, key, "left_anti").select(key, F.lit("left out").alias("state")))


def exact_duplicates(manifest: DataFrame, digest: str = "sha256", dataset: str = "dataset", label: str = "label", path: str = "path") -> DataFrame:
    """(digest, dataset, path, count, scope, labels), one row per file whose digest two files or more hold.

    Only sets of labels are gathered, never the files of a digest, however many copies it has.
    """
    classes = manifest.groupBy(digest).agg(F.count("*").alias("count"), F.min(dataset).alias("_lo"), F.max(dataset).alias("_hi"), F.array_sort(F.collect_set(label)).alias("_labels"))
    scope = F.when(F.col("_lo") == F.col("_hi"), F.concat(F.lit("within_"), F.col("_lo"))).otherwise("cross_dataset")
    # saved, so that the join can split a digest that very many files hold
    classes = saved(classes.where("count >= 2").select(digest, "count", scope.alias("scope"), F.array_join("_labels", ";").alias("labels")))
    return manifest.select(digest, dataset, path).join(classes, digest)


def duplicate_report(duplicates: DataFrame, digest: str = "sha256", dataset: str = "dataset", path: str = "path") -> DataFrame:
    """(digest, count, scope, labels, paths): exact_duplicates with the files of a digest in one row, by (dataset, path),
    as a report to be read lists them. For groups whose size is known to be small."""
    files = F.array_sort(F.collect_list(F.struct(F.col(dataset).alias("d"), F.col(path).alias("p"))))
    rows = duplicates.groupBy(digest, "count", "scope", "labels").agg(files.alias("_files"))
    return rows.select(digest, "count", "scope", "labels", F.array_join(F.transform("_files", lambda f: f["p"].cast("string")), ";").alias("paths"))


def halves(hex64: Column) -> tuple[Column, Column]:
    """A 64-bit hash in hex as two unsigned longs of 32 bits; Spark has no unsigned 64-bit type."""
    return F.conv(F.substring(hex64, 1, 8), 16, 10).cast("long"), F.conv(F.substring(hex64, 9, 8), 16, 10).cast("long")


def _classes(items: DataFrame, key: str, hi: str, lo: str) -> DataFrame:
    known = items.where(F.col(hi).isNotNull() & F.col(lo).isNotNull())
    return saved(known.groupBy(F.col(hi).alias("h"), F.col(lo).alias("l")).agg(F.min(key).alias("k")).select(F.struct("h", "l").alias("v"), "h", "l", "k"))


def near_classes(items: DataFrame, key: str, hi: str, lo: str, max_distance: int) -> tuple[DataFrame, DataFrame]:
    """(classes (v, k), links (va, vb, distance)): the distinct 64-bit hashes v, each with its smallest key k, and all
    pairs va < vb of them at max_distance bits or fewer. Membership is equality of hashes; copies are never paired.
    Items without a hash are in no class."""
    distinct = _classes(items, key, hi, lo)
    return distinct.select("v", "k"), close_pairs(distinct.select("v", "h", "l"), max_distance)


def near_links(items: DataFrame, key: str, hi: str, lo: str, max_distance: int) -> DataFrame:
    """(a, b): edges whose components are those of near_pairs, in a number that grows with items and not with pairs of
    copies: every copy to the smallest key of its hash, and one edge per pair of near hashes; of hashes that are compared
    block by block, no more edges of each two blocks than join the same hashes."""
    distinct = _classes(items, key, hi, lo)
    classes, n = distinct.select("v", "k"), distinct.count()
    copies = items.select(F.col(key).alias("b"), F.struct(F.col(hi).alias("h"), F.col(lo).alias("l")).alias("v")).join(classes, "v").where("b <> k").select(F.col("k").alias("a"), "b")
    if in_blocks(max_distance, n):
        return saved(copies.union(block_links(distinct.select(F.col("k").alias("v"), "h", "l"), max_distance, n)))
    links = close_pairs(distinct.select("v", "h", "l"), max_distance)
    side = lambda x: classes.select(F.col("v").alias(f"v{x}"), F.col("k").alias(x))
    return copies.union(links.join(side("a"), "va").join(side("b"), "vb").select("a", "b"))


def near_pairs(items: DataFrame, key: str, hi: str, lo: str, max_distance: int, digest: str | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """(key_a, key_b, distance, c_a and c_b for each carried column c), key_a < key_b: all pairs of items at max_distance
    bits or fewer, copies included. With digest, pairs whose digests are equal are left out: exact copies have a list of
    their own (exact_duplicates).

    Items that are compared block by block take their columns along; otherwise near_classes is expanded.
    """
    extra = {f"_{i}": F.col(c) for i, c in enumerate(carried)} | ({"s": F.col(digest)} if digest else {})
    own = items.where(F.col(hi).isNotNull() & F.col(lo).isNotNull())
    own = saved(own.select(F.col(key).alias("k"), F.col(hi).alias("h"), F.col(lo).alias("l"), *[c.alias(name) for name, c in extra.items()]))
    n = own.count()
    if in_blocks(max_distance, n):
        pairs = block_pairs(own, max_distance, n)
    else:
        classes, links = near_classes(own, "k", "h", "l", max_distance)
        links = links.union(classes.select("v", "v", F.lit(0)))
        side = lambda x: own.select(F.struct("h", "l").alias(f"v{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("k", *extra)])
        pairs = links.join(side("a"), "va").join(side("b"), "vb").where((F.col("va") != F.col("vb")) | (F.col("k_a") < F.col("k_b")))
    pairs = pairs.where((F.col("distance") > 0) | (F.col("k_a") != F.col("k_b")))
    if digest:
        pairs = pairs.where(F.coalesce(F.col("s_a") != F.col("s_b"), F.lit(True)))
    turned = F.coalesce(F.col("k_a") > F.col("k_b"), F.lit(False))
    ends = [F.when(turned, F.col(f"_{i}_{y}")).otherwise(F.col(f"_{i}_{x}")).alias(f"{c}_{x}") for x, y in ("ab", "ba") for i, c in enumerate(carried)]
    return pairs.select(F.least("k_a", "k_b").alias(f"{key}_a"), F.greatest("k_a", "k_b").alias(f"{key}_b"), F.col("distance").cast("int").alias("distance"), *ends)


def with_reviewed(pairs: DataFrame, reviews: DataFrame, a: str, b: str) -> DataFrame:
    """pairs plus already_reviewed; a review counts in either order of its pair."""
    known = reviews.select(F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b")).distinct().withColumn("_hit", F.lit(True))
    out = pairs.join(known, (F.least(a, b) == F.col("_a")) & (F.greatest(a, b) == F.col("_b")), "left")
    return out.withColumn("already_reviewed", F.coalesce("_hit", F.lit(False))).drop("_a", "_b", "_hit")


def pair_scope(a: Column, b: Column) -> Column:
    return F.when(a == b, F.concat_ws("-", a, b)).otherwise("cross")


def distance_sweep(pairs: DataFrame, max_distance: int, scopes: list[str]) -> DataFrame:
    """(distance, pairs, one column per scope with its pairs, different_label, not_reviewed, pairs_up_to) for every distance
    from 0, zeros included; pairs_up_to counts those of smaller distances too, so its last value is the total.

    pairs has distance, scope, same_label and already_reviewed.
    """
    counts = pairs.groupBy("distance").agg(
        F.count("*").alias("pairs"), *[F.count_if(F.col("scope") == s).alias(s) for s in scopes],
        F.count_if(~F.col("same_label")).alias("different_label"), F.count_if(~F.col("already_reviewed")).alias("not_reviewed"),
    )
    axis = pairs.sparkSession.range(max_distance + 1).select(F.col("id").cast("int").alias("distance"))
    out = axis.join(counts, "distance", "left").na.fill(0)
    return out.withColumn("pairs_up_to", F.sum("pairs").over(Window.orderBy("distance")))  # a row for each distance


def review_sheet(pairs: DataFrame, order: list[str], per_sheet: int = 6) -> DataFrame:
    """pairs numbered by pair_id in order, with a sheet number and an empty decision."""
    out = numbered(pairs, order, "pair_id")
    return out.select("pair_id", *pairs.columns, F.floor((F.col("pair_id") - 1) / per_sheet).alias("sheet"), F.lit("").alias("decision"))


def to_review(pairs: DataFrame, distances: list[int]) -> DataFrame:
    """Pairs of the named distances, or across datasets, that nobody has reviewed."""
    return pairs.where((F.col("distance").isin(distances) | (F.col("scope") == "cross")) & ~F.col("already_reviewed"))


def checked_decisions(reviews: DataFrame, allowed: list[str], column: str = "decision") -> tuple[DataFrame, DataFrame]:
    """(reviews with trimmed lower-case decisions, counts of empty and invalid ones)."""
    clean = reviews.withColumn(column, F.lower(F.trim(F.coalesce(column, F.lit("")))))
    state = clean.agg(F.count_if(F.col(column) == "").alias("empty"), F.count_if((F.col(column) != "") & ~F.col(column).isin(allowed)).alias("invalid"))
    return clean, state


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def count_check(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, found, expected, state): OK, or CHECK where counts differ. expected has key and expected."""
    counts = found.groupBy(key).agg(F.count("*").alias("found"))
    out = expected.join(counts, key, "left").withColumn("found", F.coalesce("found", F.lit(0).cast("long")))
    return out.select(key, "found", "expected", F.when(F.col("found") == F.col("expected"), "OK").otherwise("CHECK").alias("state"))


def value_shares(df: DataFrame, key: str, classes: list | None = None) -> DataFrame:
    """(key, n, share); with classes, exactly these, zeros included."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    if classes is not None:
        axis = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, classes))).alias(key))
        counts = axis.join(counts, key, "left").na.fill(0, ["n"])
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.crossJoin(F.broadcast(total)).select(key, "n", (F.col("n") / F.nullif("_t", F.lit(0))).alias("share"))  # one row


def modal_value(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """The most frequent value of each group; of equals the smallest."""
    counts = df.groupBy(*by, column).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col(column).alias("v"))).alias("_b")
    return counts.groupBy(*by).agg(best).select(*by, F.col("_b.v").alias(column), (-F.col("_b.m")).alias("n"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): N / (classes * n)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_t"), F.count("*").alias("_c"))
    return counts.crossJoin(F.broadcast(total)).select(label, "n", (F.col("_t") / (F.col("_c") * F.col("n"))).alias("weight"))


def positive_weight(df: DataFrame, flag: str, cap: float = 5.0) -> DataFrame:
    pos, neg = F.count_if(F.col(flag) == 1), F.count_if(F.col(flag) == 0)
    return df.agg(pos.alias("positives"), neg.alias("negatives"), F.least(F.lit(cap), neg / F.nullif(pos, F.lit(0))).alias("weight"))
