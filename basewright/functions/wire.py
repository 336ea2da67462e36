"""Column functions that build records of the container and of the legacy bit stream."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import bases, codes


MARKERS = (("DNA", codes.LEGACY_DNA), ("RNA", codes.LEGACY_RNA), ("NEXT", codes.LEGACY_END))


def le32_hex(n: Column) -> Column:
    h = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)])


def le32(n: Column) -> Column:
    """Four bytes, the lowest first."""
    return F.unhex(le32_hex(n))


def block(kind: Column | int, length: Column, payload: Column) -> Column:
    head = F.lit(f"{kind:02X}") if isinstance(kind, int) else F.lpad(F.hex(kind.cast("long")), 2, "0")
    return F.concat(F.unhex(head), le32(length), payload)


def runs_bytes(runs: Column) -> Column:
    return F.unhex(F.array_join(F.transform(runs, lambda r: F.concat(le32_hex(r["start"]), le32_hex(r["len"]))), ""))


def record_body(description: Column, sequence: Column, nuc: Column, legacy: bool = False) -> Column:
    """The blocks of one record, without their checksum."""
    return bases.let(F.struct(sequence.alias("s"), bases.encoding(sequence).alias("enc")), lambda x: _body(description, x["s"], nuc, x["enc"], legacy))


def _body(description: Column, sequence: Column, nuc: Column, enc: Column, legacy: bool) -> Column:
    described = F.encode(F.coalesce(description, F.lit("")), "UTF-8")
    kind = F.when(enc == "2b", codes.BLOCK_TWO_BIT).when(enc == "3b", codes.BLOCK_THREE_BIT).otherwise(codes.BLOCK_FOUR_BIT)
    lower = (enc == "4b") & bases.clean(sequence).rlike("[a-z]")
    masked = F.when(lower, bases.let(bases.case_runs(sequence), lambda runs: block(codes.BLOCK_RUNS, 8 * F.size(runs), runs_bytes(runs)))).otherwise(F.unhex(F.lit("")))
    parts = [
        block(codes.BLOCK_DESCRIPTION, F.octet_length(described), described),
        block(codes.BLOCK_TYPE, F.lit(1), F.encode(bases.type_tag(sequence, nuc), "UTF-8")),
        block(kind, bases.n_bases(sequence), bases.pack(sequence, enc)),
        masked,
    ]
    if legacy:
        old = F.unhex(padded(legacy_record(description, sequence)))
        parts.append(block(codes.BLOCK_LEGACY, F.octet_length(old), old))
    return F.concat(*parts)


def with_checksum(body: Column) -> Column:
    return bases.let(body, lambda b: F.concat(b, le32(F.crc32(b))))


def header(count: Column) -> Column:
    return F.concat(F.lit(codes.MAGIC), F.unhex(F.lit(f"{codes.VERSION:02X}000000")), le32(count))


def record_size(description: Column, n: Column, enc: Column, runs: Column) -> Column:
    """Bytes of a record: three heads, type and checksum are 20."""
    masked = F.when((enc == "4b") & (runs > 0), 5 + 8 * runs).otherwise(0)
    return (20 + F.octet_length(F.coalesce(description, F.lit(""))) + bases.packed_size(n, enc) + masked).cast("long")


def padded(digits: Column) -> Column:
    return F.concat(digits, F.when(F.length(digits) % 2 == 1, "0").otherwise(""))


def digit_pattern(bits: str, shift: int) -> str:
    """A pattern of hexadecimal digits that hold these bits from the given bit of the first digit on."""
    framed = "." * shift + bits + "." * (-(shift + len(bits)) % 4)

    def one(want: str) -> str:
        fits = [f"{d:X}" for d in range(16) if all(w in (".", b) for w, b in zip(want, f"{d:04b}"))]
        return fits[0] if len(fits) == 1 else f"[{''.join(fits)}]"

    return "".join(one(framed[k : k + 4]) for k in range(0, len(framed), 4))


def first_bit(digits: Column, bits: str) -> Column:
    """The first bit from which digits hold the given bits, at any of the four alignments; -1 if there is none.

    One pattern takes all alignments, the smaller first, so the leftmost digit where it fits is the first place; no bits are spelled out.
    """
    forms = [digit_pattern(bits, s) for s in range(4)]

    def placed(x: Column) -> Column:
        there = F.substring(x["digits"], x["at"], F.lit(len(bits) // 4 + 1))
        shift = reduce(lambda rest, s: F.when(there.rlike(f"^{forms[s]}"), s).otherwise(rest), (2, 1, 0), F.lit(3))
        return F.when(x["at"] == 0, -1).otherwise(4 * (x["at"] - 1) + shift)

    return bases.let(F.struct(digits.alias("digits"), F.regexp_instr(digits, F.lit("|".join(forms))).alias("at")), placed)


def digits_from(digits: Column, bit: Column) -> Column:
    """Whole digits of what begins at a bit."""

    def moved(d: Column, shift: int) -> Column:
        of = "".join(f"{v >> (4 - shift) & 15:X}" for v in range(256))  # the digit in each two that follow each other
        twos = F.regexp_extract_all(d, F.lit("(?=(..))"), F.lit(1))
        return F.array_join(F.transform(twos, lambda t: F.substring(F.lit(of), F.conv(t, 16, 10).cast("int") + 1, F.lit(1))), "")

    shift = F.pmod(bit, F.lit(4))
    rest = F.substring(digits, F.floor(bit / 4).cast("int") + 1, F.length(digits))
    return bases.let(F.struct(rest.alias("d"), shift.alias("shift")), lambda x: F.when(x["shift"] == 0, x["d"]).when(x["shift"] == 1, moved(x["d"], 1)).when(x["shift"] == 2, moved(x["d"], 2)).otherwise(moved(x["d"], 3)))


def legacy_digits(sequence: Column) -> Column:
    """Hexadecimal digits of a sequence in the legacy code, in which a blank is a symbol and a gap is none."""
    s = bases.checked(bases.upper(F.translate(bases.text(sequence), "\n", "")), codes.LEGACY_SYMBOLS)
    return F.translate(s, codes.LEGACY_SYMBOLS, codes.LEGACY_DIGITS)


def marker_cores() -> list[str]:
    """Whole digits inside any marker three times in a row, at any of the four bit alignments: no hit is without one of them."""
    found = []
    for marker in (codes.LEGACY_DNA, codes.LEGACY_RNA, codes.LEGACY_END):
        for shift in range(4):
            bits = (f"{int(marker, 16):012b}" * 3)[-shift % 4 :]
            found.append("".join(f"{int(bits[k : k + 4], 2):X}" for k in range(0, len(bits) - 3, 4)))
    return found


def marker_hits(digits: Column) -> Column:
    """For code digits that hold a marker three times in a row: its name and bit offset, DNA before RNA before NEXT, else null."""
    suspect = reduce(or_, [F.contains(digits, F.lit(core)) for core in marker_cores()])
    none = F.lit(None).cast("struct<marker:string,bit:int>")

    def search(d: Column) -> Column:
        places = F.struct(*[first_bit(d, f"{int(marker, 16):012b}" * 3).alias(name) for name, marker in MARKERS])
        found = lambda x: reduce(lambda rest, name: F.when(x[name] >= 0, F.struct(F.lit(name).alias("marker"), x[name].alias("bit"))).otherwise(rest), [n for n, _ in reversed(MARKERS)], none)
        return bases.let(places, found)

    return F.when(suspect, bases.let(digits, search))


def legacy_record(description: Column, sequence: Column, any_bit: bool = True) -> Column:
    """A legacy record as hexadecimal digits.

    any_bit: for readers that may search markers at any bit; an error if the code holds one three times in a row. Else for
    readers that go by digits from the type marker to the next end marker, as ours do; an error if the code holds an end marker.
    """
    kind = F.when(bases.upper(bases.text(sequence)).contains("U"), codes.LEGACY_RNA).otherwise(codes.LEGACY_DNA)
    guard = (lambda digits: bases.let(marker_hits(digits), lambda hit: _guarded(digits, hit))) if any_bit else _readable
    code = bases.let(legacy_digits(sequence), guard)
    return F.concat(F.hex(F.encode(F.coalesce(description, F.lit("")), "UTF-8")), kind, code, F.lit(codes.LEGACY_END))


def _guarded(digits: Column, hit: Column) -> Column:
    message = F.format_string("Code holds marker %s three times at bit %d (base %d)", hit["marker"], hit["bit"], F.floor(hit["bit"] / 4))
    return F.when(hit.isNotNull(), F.raise_error(message).cast("string")).otherwise(digits)


def _readable(digits: Column) -> Column:
    """The code, or an error if a reader that goes by digits would end it early."""
    at = F.instr(digits, codes.LEGACY_END)
    return F.when(at > 0, F.raise_error(F.format_string("Code holds an end marker at base %d", at - 1)).cast("string")).otherwise(digits)


def legacy_decoded(digits: Column) -> Column:
    """One legacy record by a search at any bit offset, as struct(description, sequence, nuc); an error without markers.

    Descriptions are read one letter per byte. The first DNA marker anywhere goes before any RNA marker.
    """
    dna, rna, end = (f"{int(m, 16):012b}" for _, m in MARKERS)
    fail = lambda why: F.raise_error(F.lit(why)).cast("struct<description:string,sequence:string,nuc:string>")
    half = lambda n: F.floor(n / 4).cast("int")

    def described(d: Column, at: Column) -> Column:
        """Whole bytes before the marker, then the number in the bits that are left."""
        whole = 2 * F.floor(at / 8).cast("int")
        left = F.pmod(at, F.lit(8))
        last = F.conv(F.substring(d, whole + 1, F.lit(2)), 16, 10).cast("int")
        last = F.floor(last / F.pow(F.lit(2), 8 - left)).cast("int")
        return F.decode(F.unhex(F.concat(F.substring(d, F.lit(1), whole), F.when(left == 0, "").otherwise(F.lpad(F.hex(last), 2, "0")))), "ISO-8859-1")

    def split(x: Column) -> Column:
        is_dna = x["dna"] >= 0
        at = F.when(is_dna, x["dna"]).otherwise(first_bit(x["digits"], rna))
        return bases.let(F.struct(x["digits"].alias("digits"), is_dna.alias("is_dna"), at.alias("at")), rest)

    def rest(x: Column) -> Column:
        after = F.when(x["at"] >= 0, digits_from(x["digits"], x["at"] + 12))
        return bases.let(F.struct(x.alias("x"), after.alias("rest")), lambda y: bases.let(F.struct(y["x"].alias("x"), y["rest"].alias("rest"), first_bit(y["rest"], end).alias("stop")), read))

    def read(y: Column) -> Column:
        x, stop = y["x"], y["stop"]
        sequence = F.translate(F.substring(y["rest"], F.lit(1), half(stop)), "0123456789ABCDEF", codes.LEGACY_INVERSE)
        sequence = F.when(x["is_dna"], sequence).otherwise(F.translate(sequence, "T", "U"))
        found = F.struct(described(x["digits"], x["at"]).alias("description"), sequence.alias("sequence"), F.when(x["is_dna"], "DNA").otherwise("RNA").alias("nuc"))
        return F.when(x["at"] < 0, fail("No type marker found")).when(stop < 0, fail("No end marker found")).when(F.pmod(stop, F.lit(4)) != 0, fail("Code is not whole")).otherwise(found)

    return bases.let(digits, lambda d: bases.let(F.struct(d.alias("digits"), first_bit(d, dna).alias("dna")), split))
