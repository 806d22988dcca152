"""Corrections and matches by likeness. Every comparison happens within an equality of some key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwright.functions.text import clean_all, first_group, similarity, spaces
from plotwright.storage import settle

# Fixed value: the street of an address, up to its comma.
STREET_GROUP = r"(^[A-Z ]+[A-Z0-9 ]+| [A-Z0-9-]+[A-ZA-Z0-9 ]+|^[0-9]{1,2}[A-Z ]+),"


def spaced_siblings(df: DataFrame, block: str, column: str, key: str) -> DataFrame:
    """(key, donor key, old, new): rows whose text equals that of a row of the same block but for digits and lost blanks.

    An edit distance of 0 is equality, so the compared form is a join key. Of several donors the one
    with most blanks is taken, of those the one of least key.
    """
    form = clean_all(F.col(column), "[0-9 ]+")
    bare = F.trim(F.regexp_replace(column, "[0-9]+", ""))
    side = df.where(F.col(column).isNotNull() & F.col(block).isNotNull()).select(F.col(block).alias("block"), form.alias("form"), F.col(key).alias("key"), F.col(column).alias("text"), bare.alias("bare"), spaces(F.col(column)).alias("sp"))
    # One donor for each text is enough: copies of a text collapse before the join.
    donors = side.groupBy("block", "form", "text", "bare", "sp").agg(F.min("key").alias("donor"))
    other = donors.select("block", "form", F.col("donor").alias("d_key"), F.col("text").alias("d_text"), F.col("bare").alias("d_bare"), F.col("sp").alias("d_sp"))
    distance = F.levenshtein("bare", "d_bare")
    fits = (F.col("sp") < F.col("d_sp")) & (distance > 0) & (distance / F.greatest(F.length("text"), F.length("d_text")) < 0.5)
    best = donors.join(other, ["block", "form"]).where(fits).groupBy("block", "text").agg(F.min(F.struct((-F.col("d_sp")).alias("sp"), "d_key", "d_text")).alias("m"))
    return side.join(best, ["block", "text"]).select(F.col("key").alias(key), F.col("m.d_key").alias("donor_key"), F.col("text").alias("old_text"), F.col("m.d_text").alias("new_text"))


def correct_spacing(df: DataFrame, block: str = "parcel_id", column: str = "property_address", key: str = "unique_id") -> DataFrame:
    found = spaced_siblings(df, block, column, key).select(F.col(key).alias("f_key"), F.col("new_text"))
    return df.join(found, F.col(key) == F.col("f_key"), "left").withColumn(column, F.coalesce("new_text", column)).select(*df.columns)


# The patterns of the repairs below, and the street that one of them is for.
LETTER_PAIR, INITIAL, STATE, REPAIRED_STREET = r"(\d+ [ABC])(\w) ", r"(\d+ [BC])([BC]\w+)", r",\s*TN\s*\z", "FALL CREEK DR"


def split_letters(address: Column) -> Column:
    """1808 AB STREET becomes 1808 A B STREET."""
    return F.regexp_replace(address, LETTER_PAIR, "$1 $2 ")


def split_initials(address: Column) -> Column:
    return F.regexp_replace(address, INITIAL, "$1 $2")


def without_state(address: Column) -> Column:
    return F.regexp_replace(address, STATE, "")


def street_from_owner(property_address: Column, owner_address: Column, street: str = REPAIRED_STREET) -> Column:
    """The repair of one street: the owner's address, without its state, where there is one."""
    return F.when(property_address.contains(street) & owner_address.isNotNull(), without_state(owner_address)).otherwise(property_address)


def reconcile(df: DataFrame, a: str = "property_address", b: str = "owner_address") -> DataFrame:
    """Of two addresses whose streets differ in blanks only, the one with the longer street replaces the other; both read the old values."""
    ga, gb = (F.trim(first_group(F.col(c), STREET_GROUP)) for c in (a, b))
    distance = F.levenshtein(ga, gb)
    alike = (F.length(ga) != F.length(gb)) & (distance / F.greatest(F.length(ga), F.length(gb)) < 0.5) & (distance > 0) & (clean_all(ga, " +") == clean_all(gb, " +"))
    return df.withColumns({a: F.when(alike & (F.length(ga) < F.length(gb)), F.col(b)).otherwise(F.col(a)), b: F.when(alike & (F.length(ga) > F.length(gb)), F.col(a)).otherwise(F.col(b))})


def grams(text: Column, n: int) -> Column:
    """The different substrings of ``n`` letters."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def match(asked: DataFrame, known: DataFrame, threshold: float = 0.8, text: str = "address", street: str = "street_name", suffix: str = "street_suffix", key: str = "address_id", longest: int = 6) -> DataFrame:
    """The best match of each ``asked`` text: ``known`` columns and confidence.

    A known street qualifies if all words of the asked street occur in it. Different street texts are compared
    once, however many rows share them. A known street must hold all pieces of up to ``longest`` letters of the
    asked words; the asked street meets those that hold its rarest piece (none, if a piece is unknown) and whose
    length allows the ``threshold``. Ties go to the least key.
    """
    part = F.trim(F.regexp_replace(F.split_part(text, F.lit(","), F.lit(1)), r"[0-9.]+", ""))
    words = F.filter(F.split(F.lower("a_part"), r"\s+"), lambda w: w != "")
    texts = asked.select(F.col(text).alias("asked"), part.alias("a_part")).where("a_part <> ''").distinct()
    piece = lambda w: F.when(F.length(w) < longest, F.array(w)).otherwise(grams(w, longest))
    parts = settle(texts.select("a_part").distinct().withColumn("a_words", words))
    name = F.trim(F.regexp_replace(F.concat_ws(" ", F.col(street), F.nullif(F.col(suffix), F.lit(""))), "[0-9]+", ""))
    rows = known.select(name.alias("k_name"), F.lower(F.col(street)).alias("k_low"), F.struct(*known.columns).alias("row"))
    names = settle(rows.where("k_low is not null").groupBy("k_name", "k_low").agg(F.min_by("row", F.col(f"row.{key}")).alias("row")))
    held = names.select("k_name", "k_low", "row", F.explode(F.array_distinct(F.flatten(F.array(*[grams(F.col("k_low"), n) for n in range(1, longest + 1)])))).alias("gram"))
    wanted = parts.select("a_part", F.explode(F.array_distinct(F.flatten(F.transform("a_words", piece)))).alias("gram"))
    frequent = held.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = wanted.join(frequent, "gram", "left").groupBy("a_part").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"), F.min(F.coalesce("n", F.lit(0))).alias("n")).where("n > 0").drop("n")
    a_size, k_size = F.length("a_part"), F.length("k_name")
    fits = (F.least(a_size, k_size) >= threshold * F.greatest(a_size, k_size) - 1e-9) & F.forall("a_words", lambda w: F.contains(F.col("k_low"), w))
    pairs = rarest.join(parts, "a_part").join(held, "gram").where(fits)
    scored = pairs.withColumn("confidence", similarity(F.lower("a_part"), F.lower("k_name"))).where(F.col("confidence") >= threshold)
    best = scored.groupBy("a_part").agg(F.min_by(F.struct("confidence", "row"), F.struct(-F.col("confidence"), F.col(f"row.{key}"))).alias("m"))
    return texts.join(best, "a_part").select(F.col("asked").alias(text), *[F.col(f"m.row.{c}").alias(f"matched_{c}") for c in known.columns], F.col("m.confidence").alias("confidence"))
