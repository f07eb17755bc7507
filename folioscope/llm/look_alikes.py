"""Visually identical text with different characters: classes of texts that read the same.

Look-alikes are mapped first (``functions/readingform.py``), accents staying as they are stored. The
mapped texts are grouped under the accent-sensitive Unicode collation in SQL, which decides what is
one class; every class gets a deterministic canonical member, and that is joined back.

A collation key is as long as its text, so not all texts are compared: those without a partner are
left out by an accent-blind skeleton, which all texts of a class share, kept as a hash.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.readingform import SEEN_FORMATS, UNSEEN, for_collation, unfolded
from folioscope.llm.shared import having, is_small, written

#: Members of one text that meet those of another in one task of the pairing; more are cut into blocks of this size.
BLOCK = 1024

#: A text's identity in 128 bits, and the same of the canonical text of its class.
TEXT, CLASS = ["text_a", "text_b"], ["class_a", "class_b"]

_CODE = lambda c: f"\\x{{{c:x}}}"
_VISIBLE = rf"[^\p{{Z}}\p{{Cc}}\p{{Cf}}\s{''.join(_CODE(c) for c in sorted(UNSEEN))}]|[{''.join(_CODE(c) for c in sorted(SEEN_FORMATS))}]"


def has_visible(column: str) -> Column:
    """Whether a text has anything but spaces, controls and signs that cannot be seen; false for null."""
    return F.coalesce(F.regexp_like(F.col(column), F.lit(_VISIBLE)), F.lit(False))


def mapped(text: str) -> str:
    """The text with look-alikes mapped, such that the collation tells apart what reads differently."""
    return for_collation(unfolded(text))


def skeleton(text: str) -> str:
    """The mapped text without accents: texts of one class have one skeleton."""
    m = mapped(text)
    return m if m.isascii() else "".join(c for c in unicodedata.normalize("NFD", m) if not unicodedata.combining(c))


def keyed_texts(df: DataFrame, key: str, text: str, field_name: str) -> DataFrame:
    """``field_name, key, text_a, text_b, skeleton`` for each row of ``df`` whose text has a visible character: identities only, no texts."""

    @F.pandas_udf("string")
    def blind(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(skeleton)

    rows = df.select(F.lit(field_name).alias("field_name"), F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return rows.where(has_visible("text")).select("field_name", "key", *_identity("text"), F.xxhash64(blind("text")).alias("skeleton"))


def _identity(column: str) -> list:
    return [F.xxhash64(F.lit(seed), column).alias(name) for seed, name in enumerate(TEXT)]


def classes(texts: DataFrame, sources: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """``field_name, text_a, text_b, canonical, class_a, class_b`` of every text that another one may read like, as a written table.

    ``texts`` is a written table of ``keyed_texts``, ``sources`` the tables it was made from, as (table, text column, field name).
    Skeletons that different texts have are found by sums over hashes, combined in each task; only texts with such a
    skeleton are read again, each once. The canonical member of a class is the least of its texts by code point.
    """
    spark = texts.sparkSession
    differ = texts.groupBy("field_name", "skeleton").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in TEXT for f in (F.min, F.max)])
    shared = written(differ.where("min_text_a <> max_text_a OR min_text_b <> max_text_b").select("field_name", "skeleton"), "shared-skeletons")
    chosen = written(having(texts, shared, ["field_name", "skeleton"]).select("field_name", *TEXT).distinct(), "texts-to-compare")

    @F.pandas_udf("string")
    def form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(mapped, na_action="ignore")

    found = None
    for df, text, field_name in sources:
        rows = df.select(F.lit(field_name).alias("field_name"), F.col(text).alias("text")).where("text IS NOT NULL")
        rows = having(rows.select("*", *_identity("text")), chosen, ["field_name", *TEXT])
        found = rows if found is None else found.unionByName(rows)
    once = found.groupBy("field_name", *TEXT).agg(F.first("text").alias("text"))
    compared = written(once.withColumn("form", form("text")), "compared-texts")
    classed = spark.sql(
        """
        WITH class AS (
          SELECT field_name, form COLLATE UNICODE AS read_as, min(text) AS canonical
          FROM {compared} GROUP BY field_name, form COLLATE UNICODE
        )
        SELECT t.field_name, t.text_a, t.text_b, c.canonical
        FROM {compared} t JOIN class c ON t.field_name = c.field_name AND t.form COLLATE UNICODE = c.read_as
        """,
        compared=compared,
    )
    return written(classed.select("*", *[c.alias(name) for c, name in zip(_identity("canonical"), CLASS)]), "text-classes")


def _with_classes(texts: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``texts`` with the class of their text; a text that was not compared is a class by itself."""
    known = found.select("field_name", *TEXT, *CLASS)
    joined = texts.join(F.broadcast(known) if is_small(known) else known, ["field_name", *TEXT], "left")
    return joined.select("field_name", "key", *TEXT, *[F.coalesce(c, t).alias(c) for c, t in zip(CLASS, TEXT)])


def members(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``field_name, key, text_a, text_b, class_a, class_b, links``: every key once for each of its texts, with its class.

    ``links`` is how many members of the class have another text; 0 for most. A class of any size is counted in each task first.
    """
    rows = _with_classes(texts, found).distinct()
    sizes = rows.groupBy("field_name", *CLASS, *TEXT).agg(F.count("*").alias("own"))
    whole = sizes.groupBy("field_name", *CLASS).agg(F.sum("own").alias("all"), F.count("*").alias("texts"))
    mixed = written(sizes.join(whole.where("texts > 1"), ["field_name", *CLASS]).select("field_name", *TEXT, (F.col("all") - F.col("own")).alias("links")), "class-links")
    joined = rows.join(F.broadcast(mixed) if is_small(mixed) else mixed, ["field_name", *TEXT], "left")
    return joined.withColumn("links", F.coalesce("links", F.lit(0)))


def canonical_texts(df: DataFrame, key: str, text: str, field_name: str, found: DataFrame) -> DataFrame:
    """``field_name, key, canonical``: every text of ``df`` with a visible character as the canonical member of its class, once for a key and class.

    A text that no other reads like is a class by itself, and its own canonical member.
    """
    rows = df.select(F.lit(field_name).alias("field_name"), F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")
    other = found.where(F.col("text_a") != F.col("class_a")).select("field_name", *TEXT, "canonical")
    joined = rows.select("*", *_identity("text")).join(F.broadcast(other) if is_small(other) else other, ["field_name", *TEXT], "left")
    named = joined.select("field_name", "key", F.coalesce("canonical", "text").alias("canonical"))
    return named.where(has_visible("canonical")).dropDuplicates(["field_name", "key", "canonical"])


def same_reading_pairs(texts: DataFrame, found: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """``field_name, key_a, key_b``: two different keys whose texts read the same but are not identical, ``key_a`` the smaller.

    Each pair comes out once however often its rows are repeated; null keys make none. Of a class, pairs of
    different texts are formed first, then the keys of one text meet those of the other, so copies of one text
    make no work. Where a text has more than ``block`` keys they are cut into blocks, and each block meets the other
    text's blocks in groups of their own: no task holds a whole large class, and no pair is left out.
    """
    rows = _with_classes(texts.where("key IS NOT NULL"), found).join(_mixed(found), ["field_name", *CLASS], "left_semi").distinct()
    rows = written(rows, "keys-of-mixed-classes")
    sizes = rows.groupBy("field_name", *CLASS, *TEXT).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sizes = written(sizes, "texts-of-mixed-classes")
    side = lambda n: sizes.select("field_name", *CLASS, F.struct(*TEXT).alias(f"t{n}"), F.col("blocks").alias(f"blocks{n}"))
    both = side(1).join(side(2), ["field_name", *CLASS]).where("t1 < t2").select("field_name", "t1", "t2", "blocks1", "blocks2")
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.col(f"blocks{n}") - 1)).alias(f"b{n}")
    met = both.select("*", blocks(1)).select("*", blocks(2))
    keyed = lambda n: rows.select("field_name", F.struct(*TEXT).alias(f"t{n}"), F.col("key").alias(f"key{n}"))
    own = lambda n: F.pmod(F.xxhash64(f"key{n}"), F.col(f"blocks{n}").cast("long")).cast("int").alias(f"b{n}")
    placed = lambda n: keyed(n).join(sizes.select("field_name", F.struct(*TEXT).alias(f"t{n}"), F.col("blocks").alias(f"blocks{n}")), ["field_name", f"t{n}"]).select("field_name", f"t{n}", own(n), f"key{n}")
    pairs = met.join(placed(1), ["field_name", "t1", "b1"]).join(placed(2), ["field_name", "t2", "b2"]).where("key1 <> key2")
    return pairs.select("field_name", F.least("key1", "key2").alias("key_a"), F.greatest("key1", "key2").alias("key_b")).distinct()


def _mixed(found: DataFrame) -> DataFrame:
    """Classes in which texts differ."""
    return found.groupBy("field_name", *CLASS).agg(F.count("*").alias("texts")).where("texts > 1").select("field_name", *CLASS)
