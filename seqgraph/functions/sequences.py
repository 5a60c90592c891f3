"""Column functions on sequences and oriented vertices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The IUPAC complement; U pairs with A, S, W and N with themselves.
BASES = "ACGTUMKRYVBHDSWNacgtumkryvbhdswn"
PAIRED = "TGCAAKMYRBVDHSWNtgcaakmyrbvdhswn"

#: Bias of diagonal numbers in a packed vertex-diagonal key.
DIAGONAL_BIAS = 0x40000000


def _(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reverse_complement(seq: Column | str) -> Column:
    """Case is kept; characters without a complement stay."""
    return F.reverse(F.translate(_(seq), BASES, PAIRED))


def vertex(segment: Column | str, orientation: Column | str) -> Column:
    """Segment number and strand (0 forward, 1 reverse) to an oriented vertex."""
    return F.shiftleft(_(segment).cast("long"), 1).bitwiseOR(_(orientation).cast("long"))


def segment_of(v: Column | str) -> Column:
    return F.shiftright(_(v), 1)


def strand_of(v: Column | str) -> Column:
    return _(v).bitwiseAND(1).cast("int")


def complement(v: Column | str) -> Column:
    """The same segment on the other strand."""
    return _(v).bitwiseXOR(1)


def beyond(length: Column | str, over: Column | str) -> Column:
    """What of a segment lies behind an overlap: an arc's length on that side."""
    return F.greatest(_(length) - _(over), F.lit(0))


def pack_diagonal(v: Column | str, d: Column | str) -> Column:
    """Vertex and diagonal to one key that sorts like the pair."""
    return F.shiftleft(_(v).cast("long"), 32) + _(d).cast("long") + F.lit(DIAGONAL_BIAS)


def diagonal_of(key: Column | str) -> Column:
    return (_(key).bitwiseAND(0xFFFFFFFF) - F.lit(DIAGONAL_BIAS)).cast("int")


def common_extension(a: Column | str, b: Column | str) -> Column:
    """How many characters two strings share from their beginnings; null if either is null."""
    a, b = _(a), _(b)
    apart = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), False).cast("int")
    return F.when(apart > 0, apart - 1).when(apart == 0, F.least(F.length(a), F.length(b)))


def overlap(text: Column | str) -> Column:
    """Struct ov, ow of an overlap field.

    A star, a bare number, other text or null: 0, 0. ":N" has ov null. "N:M" and "N:" (ow 0). A CIGAR: M, D and
    N count for ov, M, I and S for ow.
    """
    t = F.coalesce(_(text), F.lit("*"))
    number = lambda pattern: F.regexp_extract(t, pattern, 1).try_cast("int")

    def consumed(kinds: str) -> Column:
        found = F.regexp_extract_all(t, F.lit(rf"(\d+)[{kinds}]"), F.lit(1))
        return F.aggregate(found, F.lit(0), lambda acc, x: acc + F.coalesce(x.try_cast("int"), F.lit(0)))

    cigar = t.rlike(r"^(\d+[MIDNSHP=X])+$")
    ov = F.when(t.rlike(r"^:\d+$"), F.lit(None).cast("int")).when(t.rlike(r"^\d+:\d*$"), number(r"^(\d+):")).when(cigar, consumed("MDN")).otherwise(0)
    ow = F.when(t.rlike(r"^:\d+$"), number(r"^:(\d+)$")).when(t.rlike(r"^\d+:\d+$"), number(r":(\d+)$")).when(cigar, consumed("MIS")).otherwise(0)
    return F.struct(ov.alias("ov"), ow.alias("ow"))


#: A well-formed tag.
TAG = r"^[A-Za-z][A-Za-z0-9]:([AZ]:.*|i:[-+]?\d+|f:[-+]?[0-9.]+([eE][-+]?\d+)?|B:[cCsSiIf](,[-+0-9.eE]+)*)$"


def tags(fields: Column) -> Column:
    """Array of XX:T:value to a map from tag to struct type, value; malformed ones and unknown B kinds go."""
    good = F.filter(fields, lambda x: x.rlike(TAG))
    entry = F.transform(good, lambda x: F.struct(F.substr(x, F.lit(1), F.lit(2)), F.struct(F.substr(x, F.lit(4), F.lit(1)).alias("type"), F.substr(x, F.lit(6)).alias("value"))))
    # Of a tag that comes twice the first counts. Fields are bound in an array of one, so that they are parsed once.
    first = lambda own: F.filter(own, lambda e, i: F.array_position(F.transform(own, lambda o: o["col1"]), e["col1"]) == i + 1)
    return F.map_from_entries(F.get(F.transform(F.array(entry), first), F.lit(0)))


def tags_text(tag_map: Column | str) -> Column:
    """The tags as tab-separated text, by name."""
    entries = F.array_sort(F.map_entries(_(tag_map)))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["key"], e["value"]["type"], e["value"]["value"])), "\t")


def with_tag(tag_map: Column | str, name: str, kind: str, value: Column) -> Column:
    """The tags with one set."""
    own = F.map_filter(_(tag_map), lambda k, v: k != name)
    return F.map_concat(own, F.create_map(F.lit(name), F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"))))


def without_tag(tag_map: Column | str, name: str) -> Column:
    return F.map_filter(_(tag_map), lambda k, v: k != name)


def tag_int(tag_map: Column | str, name: str) -> Column:
    """An integer tag's value, else null."""
    found = F.try_element_at(_(tag_map), F.lit(name))
    return F.when(found["type"] == "i", found["value"].try_cast("int"))


def field_int(fields: Column, name: str) -> Column:
    """tag_int of tags(fields), without the map."""
    own = F.get(F.filter(fields, lambda x: x.startswith(f"{name}:") & x.rlike(TAG)), F.lit(0))
    return F.when(F.substr(own, F.lit(4), F.lit(1)) == "i", F.substr(own, F.lit(6)).try_cast("int"))


def tag_string(tag_map: Column | str, name: str) -> Column:
    found = F.try_element_at(_(tag_map), F.lit(name))
    return F.when(found["type"] == "Z", found["value"])
