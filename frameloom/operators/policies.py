"""Which classes a source's labels can be trusted for: five modes, each from images to (image, policy, ids).

A policy is a key and a sorted list of class ids; images are many and policies few, so images carry the key only and the list is
joined where it is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashes import policy_digest
from .dedup import small

_NONE = "array<int>"


def trusted_list(images: DataFrame, trust: DataFrame) -> DataFrame:
    """images (image, source), trust (source, ids): the source's own list; a source without one trusts nothing."""
    return images.join(small(trust), "source", "left").select("image", F.col("source").alias("policy"), F.array_sort(F.coalesce("ids", F.array().cast(_NONE))).alias("ids"))


def with_ledger(base: DataFrame, ledger: DataFrame) -> DataFrame:
    """Policies of base widened by an image's verified classes; ledger: image, class_id. The key changes only where the set grows."""
    verified = ledger.groupBy("image").agg(F.collect_set(F.col("class_id").cast("int")).alias("verified"))
    both = base.join(verified, "image", "left")
    wide = F.array_sort(F.array_union("ids", F.coalesce("verified", F.array().cast(_NONE))))
    grown = F.size(wide) > F.size("ids")
    return both.select("image", F.when(grown, F.concat_ws("+", "policy", policy_digest(wide))).otherwise(F.col("policy")).alias("policy"), F.when(grown, wide).otherwise(F.col("ids")).alias("ids"))


def per_slug(images: DataFrame, slugs: DataFrame, trust: DataFrame) -> DataFrame:
    """images (image, source); slugs (image, slug), one slug each; trust (slug, ids). See slug_problems for what must not be."""
    return images.join(slugs, "image").join(small(trust), "slug").select("image", F.concat_ws("/", "source", "slug").alias("policy"), F.array_sort("ids").alias("ids"))


def slugs_of_files(files: DataFrame, names: DataFrame) -> DataFrame:
    """files (source, filename) with slug: the file's name without its source's prefix, looked up in names (name, slug); null where it is not there."""
    prefix = F.concat("source", F.lit("_"))
    bare = F.when(F.startswith("filename", prefix), F.substr("filename", F.length(prefix) + 1)).otherwise(F.col("filename"))
    return files.withColumn("name", bare).join(names.select("name", "slug"), "name", "left").drop("name")


def slug_problems(images: DataFrame, slugs: DataFrame, trust: DataFrame) -> DataFrame:
    """(image, problem): absent, ambiguous or untrusted slug."""
    n = slugs.groupBy("image").agg(F.countDistinct("slug").alias("n"), F.min("slug").alias("slug"))
    known = images.join(n, "image", "left").join(small(trust.select("slug", F.lit(True).alias("known"))), "slug", "left")
    problem = F.when(F.col("n").isNull(), "absent").when(F.col("n") > 1, "ambiguous").when(F.col("known").isNull(), "untrusted")
    return known.select("image", problem.alias("problem")).filter("problem is not null")


def verified_absence(images: DataFrame, n_classes: int) -> DataFrame:
    """Negatives: every class is known not to be there, so every id is trusted."""
    return images.select("image", F.col("source").alias("policy"), F.sequence(F.lit(0), F.lit(n_classes - 1)).alias("ids"))


def per_session(images: DataFrame, sessions: DataFrame, trust_column: str = "ids") -> DataFrame:
    """Own captures: the longest session id that, with an underscore, begins the image's name.

    Names are cut at each underscore and the pieces are equi-joined with session ids, so the prefix match needs no
    comparison of all pairs.
    """
    parts = F.split("image", "_")
    heads = images.select("image", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "_"))).alias("session"))
    met = heads.filter(F.length("session") < F.length("image")).join(sessions.select("session", trust_column), "session")
    best = met.groupBy("image").agg(F.max(F.struct(F.length("session").alias("n"), "session", F.col(trust_column).alias("ids"))).alias("b"))
    return best.select("image", F.col("b.session").alias("policy"), F.array_sort("b.ids").alias("ids"))


def policy_table(resolved: DataFrame) -> DataFrame:
    """(policy, ids, images): the dictionary of policies in use."""
    return resolved.groupBy("policy").agg(F.min("ids").alias("ids"), F.count("*").alias("images"))


def unused(policies: DataFrame, resolved: DataFrame) -> DataFrame:
    return policies.join(resolved.select("policy").distinct(), "policy", "left_anti")


def trusted_pairs(resolved: DataFrame) -> DataFrame:
    """(image, class_id), a row for each class that an image's policy trusts."""
    return resolved.select("image", F.explode("ids").alias("class_id"))


def completeness_stats(resolved: DataFrame) -> DataFrame:
    """Per trusted class: images whose policy trusts it."""
    return trusted_pairs(resolved).groupBy("class_id").agg(F.count("*").alias("images"))


def provenance_branches(ledger: DataFrame, provenance: DataFrame) -> DataFrame:
    """Ledger entries (image, source) with branch: ok, skipped (the merge dropped the image) or mismatch (another source; callers treat it as an error)."""
    both = ledger.join(provenance.select("image", F.col("source").alias("known")), "image", "left")
    branch = F.when(F.col("known").isNull(), "skipped").when(F.col("known") != F.col("source"), "mismatch").otherwise("ok")
    return both.withColumn("branch", branch).drop("known")


def latest_per_key(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row of each key: a later session's value replaces an earlier one's."""
    nth = F.row_number().over(W.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order]))
    return rows.withColumn("_n", nth).filter("_n = 1").drop("_n")
