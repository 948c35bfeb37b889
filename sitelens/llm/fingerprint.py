"""Threshold-scaled document sketches, in DataFrame functions only.

A text's words (runs of characters other than blank, tab, LF, VT, FF, CR) give
overlapping shingles of ``SHINGLE`` words; a text of fewer words is one shingle,
an empty text none.  Every shingle is hashed to 64 bits and *every* hash below a
fixed fraction ``1/SCALE`` of the range is kept.  So

* the sketch of a union of texts is the union of the sketches (``merge``),
* the share of one sketch found in another estimates containment, without bias
  from very different lengths, because both keep the same part of the hash range.

Where no hash falls below the threshold, the smallest one is kept, so a short
text still has a fingerprint.

Defined cases: null text is empty; the empty text's fingerprint is the empty
string; two empty sketches are alike (1.0), an empty and a nonempty one are not
(0.0); equal texts have equal fingerprints; repeated shingles count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
SCALE = 4
#: Signed 64-bit hashes below this are the lowest 1/SCALE of the range.
THRESHOLD = -(1 << 63) + (1 << 64) // SCALE

SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def shingle_hashes(word_hashes: Column, shingle: int = SHINGLE) -> Column:
    """One hash for every run of ``shingle`` words, given the words' own hashes."""
    count = F.size(word_hashes)
    last = F.greatest(count - shingle, F.lit(0))
    return F.when(
        count > 0,
        F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(word_hashes, i + j) for j in range(shingle)])),
    ).otherwise(F.array().cast("array<bigint>"))


def keep_low(hashes: Column, threshold: int = THRESHOLD) -> Column:
    low = F.filter(hashes, lambda h: h < F.lit(threshold))
    return F.array_sort(
        F.array_distinct(F.when((F.size(low) == 0) & (F.size(hashes) > 0), F.array(F.array_min(hashes))).otherwise(low))
    )


def with_sketch(df: DataFrame, text: str, out: str, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """Add the sketch of column ``text`` as ``out``; each step its own projection,
    so the words are split and the shingles hashed once."""
    a, b = f"__{out}_words", f"__{out}_hashes"
    return (
        df.withColumn(a, F.transform(words(F.coalesce(F.col(text), F.lit(""))), lambda w: F.xxhash64(w)))
        .withColumn(b, shingle_hashes(F.col(a), shingle))
        .drop(a)
        .withColumn(out, keep_low(F.col(b), threshold))
        .drop(b)
    )


def merge(a: Column, b: Column) -> Column:
    """The sketch of both texts together."""
    return F.array_sort(F.array_union(a, b))


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double")


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a``'s shingles that occur in ``b``."""
    return F.when(F.size(a) == 0, (F.size(b) == 0).cast("double")).otherwise(_shared(a, b) / F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """Containment of the smaller sketch in the larger: 0 to 1, symmetric."""
    small = F.least(F.size(a), F.size(b))
    return F.when(small == 0, (F.size(a) == F.size(b)).cast("double")).otherwise(_shared(a, b) / small)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(a) + F.size(b) - _shared(a, b)
    return F.when(both == 0, F.lit(1.0)).otherwise(_shared(a, b) / both)


def text_form(sketch: Column) -> Column:
    """A sketch as a string: its hashes in hexadecimal, ascending."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), ",")
