"""Column functions on sequences: alphabet checks, choice of encoding, packing, case runs and small predicates.

These suit queries over many short sequences; files of long ones are packed by ``packing``. Letters become digits of base 4, 8 or 16 with ``translate``; ``conv`` turns 16 digits at a time into hexadecimal
ones and ``unhex`` into bytes. Everything is a built-in expression. Line feeds and blanks are not part of a
sequence. Null sequences are empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import codes

CHUNK = 16


def text(sequence: Column) -> Column:
    return F.coalesce(sequence, F.lit(""))


def clean(sequence: Column) -> Column:
    """The sequence as the packers see it."""
    return F.translate(text(sequence), "\n ", "")


def upper(sequence: Column) -> Column:
    """A-Z for a-z only: the full upper case of some letters is two valid codes."""
    return F.translate(sequence, codes.LOWER, codes.UPPER)


def bad_symbol(sequence: Column) -> Column:
    """The first symbol outside the alphabet, else null."""
    found = F.regexp_extract(F.translate(text(sequence), "\n", ""), f"([^{codes.VALID}])", 1)
    return F.nullif(found, F.lit(""))


def encoding(sequence: Column, strict: bool = True) -> Column:
    """2b for plain capitals, 3b with lower case, 4b with degenerate codes or gaps.

    Sequences with symbols outside the alphabet raise an error, or are null if not strict.
    """
    s = F.translate(text(sequence), "\n", "")
    degenerate = codes.DEGENERATE + codes.DEGENERATE.lower() + "-"
    found = F.when(s.rlike(f"[{degenerate}]"), "4b").when(s.rlike("[a-z]"), "3b").otherwise("2b")
    message = F.concat(F.lit("Unsupported symbol (amino acids?): "), bad_symbol(sequence))
    return F.when(bad_symbol(sequence).isNull(), found).otherwise(F.raise_error(message).cast("string") if strict else F.lit(None))


def checked(s: Column, allowed: str) -> Column:
    """The text, or an error if it holds another symbol."""
    message = F.concat(F.lit("Cannot encode symbol: "), F.regexp_extract(s, f"([^{allowed}])", 1))
    return F.when(s.rlike(f"[^{allowed}]"), F.raise_error(message).cast("string")).otherwise(s)


def converted(digits: Column, source: int, target: int, chunk: int, width: int) -> Column:
    """Digits of one base as those of another, ``chunk`` digits at a time as ``width`` digits; filled up with zeros."""
    filled = F.concat(digits, F.repeat(F.lit("0"), F.pmod(-F.length(digits), F.lit(chunk))))
    parts = F.regexp_extract_all(filled, F.lit(f"(.{{{chunk}}})"), F.lit(1))
    return F.array_join(F.transform(parts, lambda c: F.lpad(F.conv(c, source, target), width, "0")), "")


def n_bases(sequence: Column) -> Column:
    return F.length(clean(sequence)).cast("long")


def pack_2b(sequence: Column) -> Column:
    """Four bases a byte, the first in the highest bits."""
    s = checked(clean(sequence), codes.TWO_BIT_SYMBOLS)
    digits = F.translate(s, codes.TWO_BIT_SYMBOLS, codes.TWO_BIT_DIGITS)
    return F.unhex(F.substring(converted(digits, 4, 16, CHUNK, 8), 1, 2 * F.ceil(F.length(s) / 4).cast("int")))


def pack_3b(sequence: Column) -> Column:
    """Three bits a base, the highest set for lower case; zeros fill the last byte."""
    s = checked(clean(sequence), codes.THREE_BIT_SYMBOLS)
    digits = F.translate(s, codes.THREE_BIT_SYMBOLS, codes.THREE_BIT_DIGITS)
    return F.unhex(F.substring(converted(digits, 8, 16, CHUNK, 12), 1, 2 * F.ceil(3 * F.length(s) / 8).cast("int")))


def pack_4b(sequence: Column) -> Column:
    """Two bases a byte, the first in the high half; case is lost."""
    s = checked(upper(clean(sequence)), codes.FOUR_BIT_SYMBOLS)
    return F.unhex(F.concat(F.translate(s, codes.FOUR_BIT_SYMBOLS, codes.FOUR_BIT_DIGITS), F.when(F.length(s) % 2 == 1, "0").otherwise("")))


def as_rna(s: Column, nuc: Column) -> Column:
    """T and t as U and u where the type is RNA (or R)."""
    return F.when(nuc.startswith("R"), F.translate(s, "Tt", "Uu")).otherwise(s)


def unpack_2b(payload: Column, n: Column, nuc: Column) -> Column:
    digits = converted(F.hex(payload), 16, 4, 8, 16)
    return as_rna(F.translate(F.substring(digits, F.lit(1), n.cast("int")), "0123", codes.TWO_BIT_INVERSE), nuc)


def unpack_3b(payload: Column, n: Column, nuc: Column) -> Column:
    digits = converted(F.hex(payload), 16, 8, 12, 16)
    return as_rna(F.translate(F.substring(digits, F.lit(1), n.cast("int")), "01234567", codes.THREE_BIT_INVERSE), nuc)


def unpack_4b(payload: Column, n: Column, nuc: Column) -> Column:
    return as_rna(F.translate(F.substring(F.hex(payload), F.lit(1), n.cast("int")), "0123456789ABCDEF", codes.FOUR_BIT_INVERSE), nuc)


def pack(sequence: Column, enc: Column) -> Column:
    return F.when(enc == "2b", pack_2b(sequence)).when(enc == "3b", pack_3b(sequence)).otherwise(pack_4b(sequence))


def unpack(payload: Column, n: Column, enc: Column, nuc: Column, runs: Column) -> Column:
    """The sequence of a payload of n bases; runs of lower case count for 4b only."""
    return F.when(enc == "2b", unpack_2b(payload, n, nuc)).when(enc == "3b", unpack_3b(payload, n, nuc)).otherwise(with_case(unpack_4b(payload, n, nuc), runs))


def packed_size(n: Column, enc: Column) -> Column:
    """Bytes of a payload of n bases."""
    return F.ceil(n * F.when(enc == "2b", 2).when(enc == "3b", 3).otherwise(4) / 8).cast("long")


RUN = "struct<start:int,len:int>"
#: Runs are summed up in slices, as appending to one long array would copy it each time.
SLICE = 512


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where lambdas refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def case_runs(sequence: Column) -> Column:
    """Maximal runs of lower-case letters as (start, len), from 0."""
    empty = F.array().cast(f"array<{RUN}>")

    def in_slice(pairs: Column) -> Column:
        """Runs from the slice's begin, and its length."""
        zero = F.struct(F.lit(0).alias("at"), empty.alias("runs"))

        def step(state: Column, x: Column) -> Column:
            start = state["at"] + x["gap"]
            run = F.struct(start.alias("start"), x["low"].alias("len"))
            return F.struct((start + x["low"]).alias("at"), F.concat(state["runs"], F.array(run)).alias("runs"))

        return F.aggregate(pairs, zero, step)

    def summed(slices: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("offsets"))
        offsets = F.aggregate(slices, zero, lambda state, x: F.struct((state["at"] + x["at"]).alias("at"), F.concat(state["offsets"], F.array(state["at"])).alias("offsets")), lambda state: state["offsets"])
        moved = F.zip_with(slices, offsets, lambda x, o: F.transform(x["runs"], lambda r: F.struct((r["start"] + o).alias("start"), r["len"].alias("len"))))
        return F.flatten(moved)

    def sliced(pairs: Column) -> Column:
        begins = F.sequence(F.lit(1), F.greatest(F.size(pairs), F.lit(1)), F.lit(SLICE))
        return let(F.transform(begins, lambda k: in_slice(F.slice(pairs, k, F.lit(SLICE)))), summed)

    def measured(s: Column) -> Column:
        gap, low = (F.transform(F.regexp_extract_all(s, F.lit("([^a-z]*)([a-z]+)"), F.lit(k)), F.length) for k in (1, 2))
        return let(F.arrays_zip(gap.alias("gap"), low.alias("low")), sliced)

    return let(clean(sequence), measured)


def with_case(sequence: Column, runs: Column) -> Column:
    """Lower-cases each run; ends are cut at the length, and runs may overlap or be null.

    Each run is cut out of the sequence by its place; for millions of bases with very many runs use ``with_case_arrow``.
    """
    lower = lambda x: F.translate(x, codes.UPPER, codes.LOWER)

    def joined(s: Column, runs: Column) -> Column:
        before = F.transform(runs, lambda r, i: F.coalesce(F.get(runs, i - 1)["start"] + F.get(runs, i - 1)["len"], F.lit(0)))

        def disjoint(before: Column) -> Column:
            parts = F.zip_with(runs, before, lambda r, b: F.concat(F.substring(s, b + 1, r["start"] - b), lower(F.substring(s, r["start"] + 1, r["len"]))))
            last = F.element_at(runs, -1)
            whole = F.concat(F.array_join(parts, ""), F.substring(s, last["start"] + last["len"] + 1, F.length(s)))
            ordered = F.forall(F.zip_with(runs, before, lambda r, b: r["start"] >= b), lambda x: x)
            one = lambda now, r: F.concat(F.substring(now, F.lit(1), r["start"]), lower(F.substring(now, r["start"] + 1, r["len"])), F.substring(now, r["start"] + r["len"] + 1, F.length(s)))
            return F.when(F.size(runs) == 0, s).when(ordered, whole).otherwise(F.aggregate(runs, s, one))

        return let(before, disjoint)

    runs = F.coalesce(runs, F.array().cast(f"array<{RUN}>"))
    return let(text(sequence), lambda s: let(runs, lambda r: joined(s, r)))


def with_case_arrow(sequence: Column, runs: Column) -> Column:
    """The same in time that grows with the sequence's length only: an Arrow function on bytes."""

    @F.pandas_udf("string")
    def mask(sequences: pd.Series, masks: pd.Series) -> pd.Series:
        out = []
        for s, found in zip(sequences, masks):
            data = np.frombuffer((s or "").encode("ascii"), np.uint8).copy()
            for r in found if found is not None else ():
                part = data[r["start"] : r["start"] + r["len"]]
                part[(part >= 65) & (part <= 90)] += 32
            out.append(data.tobytes().decode())
        return pd.Series(out, dtype=object)

    return mask(sequence, runs)


def type_tag(sequence: Column, nuc: Column) -> Column:
    """R if the given type says so or the sequence holds U, else D."""
    return F.when(F.coalesce(upper(nuc).startswith("R"), F.lit(False)) | F.contains(text(sequence), F.lit("U")), "R").otherwise("D")


def nucleotide(sequence: Column, hint: Column | None = None) -> Column:
    """RNA or DNA: a valid hint, else whether U or u occurs."""
    own = F.when(text(sequence).rlike("[uU]"), "RNA").otherwise("DNA")
    return own if hint is None else F.when(upper(hint).isin("DNA", "RNA"), upper(hint)).otherwise(own)


def mixes_t_and_u(sequence: Column) -> Column:
    s = upper(text(sequence))
    return F.contains(s, F.lit("T")) & F.contains(s, F.lit("U"))


def shortened(description: Column, most: int = 200) -> Column:
    return F.when(F.length(description) > most, F.concat(F.left(description, F.lit(most)), F.lit("…"))).otherwise(description)


def count_symbol(sequence: Column, symbol: str) -> Column:
    s = text(sequence)
    return (F.length(s) - F.length(F.translate(s, symbol, ""))).cast("int")


def bases_per_byte(bases: Column, size: Column) -> Column:
    """Rounded half to even at two places; an error for size 0."""
    return F.when(size == 0, F.raise_error(F.lit("No bytes to divide by")).cast("double")).otherwise(F.bround(bases / size, 2))


def bar_label(size: Column, ratio: Column) -> Column:
    return F.concat(F.format_number(size, 0), F.lit(" B<br>NCF: "), F.format_string("%.2f", ratio))
