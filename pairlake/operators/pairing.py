"""Pairing images with features, attaching labels and captions, and auditing
the pairing (J1-J5, J7, J9, A5, A6, A8, A12, U1-U4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlake.functions.paths import extract_id, norm_path, top_dir
from pairlake.operators.index import global_index


def _fail_when(cond: Column, message: Column) -> Column:
    return F.when(cond, F.raise_error(message))


def latest_wins(df: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    """Deduplicate a key -> value list the way ``dict(list)`` does: the entry
    with the highest position wins.  Partial aggregation keeps one candidate
    per key per task, so a repeated key does not pile up in one task."""
    return df.groupBy(key).agg(F.max_by(F.col(value), F.col(pos)).alias(value))


def attach_class_labels(files: DataFrame, manifest: DataFrame, path: str = "path",
                        fname: str = "fname", label: str = "label",
                        on_missing: str = "null") -> DataFrame:
    """Left join of files to a deduplicated class manifest on the
    slash-normalised relative path.  ``on_missing='error'`` raises for a file
    without a label (the training contract); ``'null'`` keeps it unlabelled
    (the preparation contract)."""
    m = manifest.select(F.col(fname).alias("_key"), F.col(label).alias(label))
    out = (files.withColumn("_key", norm_path(path))
           .join(m, "_key", "left"))
    if on_missing == "error":
        out = out.withColumn(label, F.coalesce(F.col(label).cast("long"), _fail_when(
            F.col(label).isNull(), F.concat(F.lit("no class label for "), F.col(path))).cast("long")))
    elif on_missing != "null":
        raise ValueError("on_missing must be 'null' or 'error'")
    return out.drop("_key")


def attach_captions(features: DataFrame, captions: DataFrame, path: str = "path",
                    cid: str = "id", caption: str = "caption", strict: bool = True) -> DataFrame:
    """Every feature file gets the caption whose id equals its F4 id.  A
    missing caption is an error naming id and file; unused captions are
    ignored (see ``unused_captions``)."""
    c = captions.select(F.col(cid).alias("_cid"), F.col(caption).alias(caption))
    out = features.withColumn("_cid", extract_id(path)).join(c, "_cid", "left")
    if strict:
        msg = F.concat(F.lit("no caption has id "), F.col("_cid"), F.lit(" (file "),
                       F.col(path), F.lit(")"))
        out = out.withColumn(caption, F.coalesce(F.col(caption), _fail_when(F.col(caption).isNull(), msg)))
    return out.withColumnRenamed("_cid", "id")


def unused_captions(features: DataFrame, captions: DataFrame, path: str = "path", cid: str = "id") -> DataFrame:
    return captions.join(features.select(extract_id(path).alias(cid)), cid, "left_anti")


def dataset_size(images: DataFrame, features: DataFrame) -> DataFrame:
    """Both row counts in one job and their parity."""
    both = (images.select(F.lit(1).alias("_i"), F.lit(0).alias("_f"))
            .unionByName(features.select(F.lit(0).alias("_i"), F.lit(1).alias("_f"))))
    return both.agg(F.sum("_i").cast("long").alias("n_images"),
                    F.sum("_f").cast("long").alias("n_features")).withColumn(
        "equal", F.col("n_images") == F.col("n_features"))


def pair_by_position(images: DataFrame, features: DataFrame, path: str = "path",
                     check: bool = True) -> DataFrame:
    """The i-th image in path order is paired with the i-th feature file.
    Unequal counts are an error (checked before any index is built)."""
    if check:
        sizes = dataset_size(images, features).first()
        if not sizes["equal"]:
            raise ValueError(f"image/feature count mismatch: {sizes['n_images']} vs {sizes['n_features']}")
    a = global_index(images.select(F.col(path).alias("image_path")), "image_path", "pos")
    b = global_index(features.select(F.col(path).alias("feature_path")), "feature_path", "pos")
    return a.join(b, "pos")


def pair_by_id(images: DataFrame, features: DataFrame, path: str = "path") -> DataFrame:
    """Full outer join on the F4 id with a status column
    (matched / image_only / feature_only)."""
    a = images.select(extract_id(path).alias("id"), F.col(path).alias("image_path"))
    b = features.select(extract_id(path).alias("id"), F.col(path).alias("feature_path"))
    j = a.join(b, "id", "full_outer")
    status = (F.when(F.col("image_path").isNotNull() & F.col("feature_path").isNotNull(), "matched")
              .when(F.col("image_path").isNotNull(), "image_only").otherwise("feature_only"))
    return j.withColumn("status", status)


def repeated_ids(images: DataFrame, features: DataFrame, path: str = "path") -> DataFrame:
    """Ids that several files of a side share: J4 pairs each of one side with
    each of the other, so check these before pairing by id."""
    sides = (images.select(extract_id(path).alias("id"), F.lit(1).alias("i"), F.lit(0).alias("f"))
             .unionAll(features.select(extract_id(path).alias("id"), F.lit(0).alias("i"), F.lit(1).alias("f"))))
    return (sides.groupBy("id").agg(F.sum("i").alias("n_images"), F.sum("f").alias("n_features"))
            .filter("n_images > 1 or n_features > 1"))


def pairing_audit(images: DataFrame, features: DataFrame, path: str = "path") -> DataFrame:
    """Images whose positional partner differs from their id partner -- the
    rows a positional pairing would silently mislabel.  Counts may differ
    (no count check); positions beyond the shorter side have no partner."""
    pos = pair_by_position(images, features, path, check=False).select(
        "image_path", F.col("feature_path").alias("positional_partner"))
    ids = pair_by_id(images, features, path).filter(F.col("image_path").isNotNull()).select(
        "image_path", F.col("feature_path").alias("id_partner"))
    j = ids.join(pos, "image_path", "left")
    return j.filter(~F.col("positional_partner").eqNullSafe(F.col("id_partner")))


def infer_labels_from_dirs(files: DataFrame, path: str = "path", label: str = "label") -> DataFrame:
    """A5: class = index of the file's top-level folder in the sorted list of
    distinct top-level folders ('' for root files); NULL labels when there is
    only one distinct folder.  The distinct folders are indexed with W1, so
    even a very large folder list is never sorted in one task."""
    f = files.withColumn("_top", top_dir(path))
    dirs = f.select("_top").distinct()
    indexed = global_index(dirs, "_top", "_cls")
    n_dirs = indexed.agg(F.count(F.lit(1))).first()[0]
    if n_dirs <= 1:
        return f.drop("_top").withColumn(label, F.lit(None).cast("long"))
    return f.join(indexed, "_top", "left").drop("_top").withColumnRenamed("_cls", label)


def label_coverage(df: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """A6 / K2 flag: per class counts plus whether every row is labelled
    (``all([])`` is True for an empty table)."""
    flag = df.agg(F.coalesce(F.bool_and(F.col(label).isNotNull()), F.lit(True)).alias("all_labelled"))
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts, flag


def output_key_audit(df: DataFrame, out_name: str = "out_name", path: str = "path") -> DataFrame:
    """Output names produced by more than one input (a later write would
    silently replace the earlier one)."""
    return (df.groupBy(out_name)
            .agg(F.count(F.lit(1)).alias("n"), F.min(path).alias("first_path"), F.max(path).alias("last_path"))
            .filter(F.col("n") > 1))


def missing_samples(plan: DataFrame, existing: DataFrame, idx: str = "sample_index") -> DataFrame:
    """Planned indices with no existing sample (resume only the gaps)."""
    return plan.join(existing.select(idx), idx, "left_anti")


def sample_completion(existing: DataFrame, n: int, idx: str = "sample_index") -> DataFrame:
    """J7 count rule as one row: how many samples exist and whether sampling
    may be skipped (the reference skips everything once count >= n, even
    when some indices are missing -- ``missing_samples`` lists those)."""
    return existing.agg(F.count(F.col(idx)).alias("n_existing")).withColumn(
        "is_complete", F.col("n_existing") >= F.lit(n))


def null_condition(df: DataFrame, flag, column: str, null_value) -> DataFrame:
    """Replace ``column`` by a constant where ``flag`` holds (dropped class
    label -> the null class id; dropped caption -> the null embedding)."""
    fc = F.col(flag) if isinstance(flag, str) else flag
    nv = null_value if isinstance(null_value, Column) else F.lit(null_value)
    return df.withColumn(column, F.when(fc, nv).otherwise(F.col(column)))
