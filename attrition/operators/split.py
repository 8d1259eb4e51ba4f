"""Reproducible split, sample and folds (§2.5).

All three hash the customer id with a seed (``md5(seed || ':' || id)``), so
the same rows are chosen in Spark and in DuckDB, independent of partitioning
and of executor loss (no ``rand``, no input order). A row without an id reads
as one with an empty id: such rows go to one side and one fold together.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _id(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("string"), F.lit(""))


def hash_hex(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), _id(id_col)))


def cut_hex(p: float) -> str:
    """8-hex-digit cut point: the first 8 digits of the hash fall below it
    with probability ``p``."""
    return format(min(int(p * 2 ** 32), 2 ** 32 - 1), "08x")


def split_train_test(df: DataFrame, id_col: str, p: float = 0.8, seed: int = 123,
                     stratify: str | None = None, out: str = "is_train") -> DataFrame:
    """``df`` + boolean ``out``.

    Plain: hash prefix below the cut (about ``p`` of rows, no shuffle).
    Stratified: within each class of ``stratify``, the first ⌈p·n_class⌉ rows
    in hash order (nulls are a class). Rows are counted per (class, first four
    hash digits); only the keys of the one bucket that holds a class's cut are
    ranked, and the rows get a predicate against the cut table (one row a class).
    """
    h = F.substring(hash_hex(id_col, seed), 1, 8)
    if stratify is None:
        return df.withColumn(out, h < F.lit(cut_hex(p)))
    key = F.concat(hash_hex(id_col, seed), _id(id_col))  # unique per row that has an id
    proj = df.select(F.col(stratify).alias("_cls"), key.alias("_h"), F.substring(key, 1, 4).alias("_b"))
    counts = proj.groupBy("_cls", "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_cls")  # ≤ 65,536 buckets a class
    found = counts.withColumn("_to", F.sum("_n").over(w.orderBy("_b"))) \
        .withColumn("_want", F.ceil(F.sum("_n").over(w) * F.lit(float(p)))) \
        .where("_to >= _want and _to - _n < _want") \
        .select(F.col("_cls").alias("_c"), F.col("_b").alias("_bb"), (F.col("_want") - F.col("_to") + F.col("_n")).alias("_nth"))
    inside = proj.join(found, F.col("_cls").eqNullSafe(F.col("_c")) & (F.col("_b") == F.col("_bb")))
    cuts = inside.withColumn("_r", F.row_number().over(w.orderBy("_h"))).where("_r = _nth") \
        .select("_cls", F.col("_h").alias("_cut"))
    j = df.join(cuts, F.col(stratify).eqNullSafe(F.col("_cls")), "left")
    return j.withColumn(out, F.coalesce(key <= F.col("_cut"), F.lit(False))).drop("_cls", "_cut")


def anti_split(df: DataFrame, train: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``df`` whose id is not in ``train`` (left anti join on the id; null is an id of its own)."""
    known = train.select(F.col(id_col).alias("_known")).distinct()
    return df.join(known, F.col(id_col).eqNullSafe(F.col("_known")), "left_anti")


def sample_n(df: DataFrame, id_col: str, n: int, seed: int = 2026, drop: str | None = None) -> DataFrame:
    """``min(n, rows)`` rows without replacement, chosen by seeded id hash;
    columns matching the regex ``drop`` (case-insensitive) are removed.
    Distributed top-n: each task keeps its n smallest hashes."""
    out = df.orderBy(hash_hex(id_col, seed), F.col(id_col)).limit(n)
    if drop:
        rx = re.compile(drop, re.IGNORECASE)
        out = out.drop(*[c for c in df.columns if rx.search(c)])
    return out


def kfold_assign(df: DataFrame, id_col: str, k: int = 10, seed: int = 7, out: str = "fold") -> DataFrame:
    """``df`` + ``out`` in 0..k-1 from the seeded id hash."""
    v = F.conv(F.substring(hash_hex(id_col, seed), 1, 8), 16, 10).cast("long")
    return df.withColumn(out, (v % k).cast("int"))
