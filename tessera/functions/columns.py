"""Column functions on names, bytes, colours, times and notes; all built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = 0xFFFFFFFF
NANOS = 1_000_000_000

# Extensions with their format, and the one-byte type hints of metadata blocks.
EXTENSIONS = {
    "mix": "mix", "big": "big", "meg": "meg", "pgm": "meg", "pak": "pak", "idx": "bag-idx", "bag": "bag-idx", "iso": "iso", "shp": "shp", "pal": "pal", "aud": "aud", "lut": "lut", "dip": "dip",
    "tmp": "tmp", "vqa": "vqa", "vqp": "vqp", "wsa": "wsa", "fnt": "fnt", "eng": "eng", "ger": "eng", "fre": "eng", "ini": "ini", "cps": "cps", "csf": "csf", "voc": "voc",
    "w3d": "w3d", "vxl": "vxl", "hva": "hva", "icn": "icn", "bin": "bin", "mpr": "mpr", "str": "str", "wnd": "wnd", "dds": "dds", "tga": "tga", "apt": "apt", "mid": "mid", "xmi": "xmi", "adl": "adl",
    "avi": "avi", "gif": "gif", "png": "png", "wav": "wav", "yaml": "miniyaml", "yml": "miniyaml",
}


def ascii_upper(c: Column) -> Column:
    return F.translate(c, LOWER, UPPER)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def u_le(c: Column, offset: Column | int, size: int) -> Column:
    """Unsigned little-endian number of `size` bytes at a byte offset of a binary column; null where the bytes aren't all there."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    part = F.substring(c, at + 1, F.lit(size))
    return F.when(F.octet_length(part) == size, F.conv(F.hex(F.reverse(part)), 16, 10).cast("long"))


def u_be(c: Column, offset: Column | int, size: int) -> Column:
    at = F.lit(offset) if isinstance(offset, int) else offset
    part = F.substring(c, at + 1, F.lit(size))
    return F.when(F.octet_length(part) == size, F.conv(F.hex(part), 16, 10).cast("long"))


def name_hash(name: Column) -> Column:
    """32-bit id of a file name: over its upper-case bytes in little-endian words of four, padded with zeros, the sum is rotated
    left by one bit and the word added. An empty name has 0."""
    data = F.encode(ascii_upper(name), "UTF-8")
    words = F.ceil(F.octet_length(data) / 4).cast("int")

    def word(k: Column) -> Column:
        part = F.substring(data, k * 4 + 1, F.lit(4))
        return F.conv(F.hex(F.reverse(F.rpad(part, 4, F.unhex(F.lit("00"))))), 16, 10).cast("long")

    def add(total: Column, k: Column) -> Column:
        return (F.shiftleft(total, 1).bitwiseOR(F.shiftrightunsigned(total, 31)).bitwiseAND(WORD) + word(k)).bitwiseAND(WORD)

    return F.when(words > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(words - 1, F.lit(0))), F.lit(0).cast("long"), add)).when(name.isNotNull(), F.lit(0).cast("long"))


def extension(path: Column) -> Column:
    """What follows the last dot, in lower case; all of a path without one."""
    return F.lower(F.regexp_extract(path, r"([^.]*)$", 1))


def format_of_extension(path: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in EXTENSIONS.values()]), (F.array_position(F.array(*[F.lit(k) for k in EXTENSIONS]), extension(path)) - 1).cast("int"))


def six_to_eight_plain(v: Column) -> Column:
    """Palette files: the low six bits, shifted; 63 gives 252."""
    return F.shiftleft(v.bitwiseAND(63), 2)


def six_to_eight_full(v: Column) -> Column:
    """Screens and video: 63 gives 255."""
    return F.shiftleft(v.bitwiseAND(63), 2).bitwiseOR(F.shiftright(v.bitwiseAND(63), 4))


def eight_to_six(v: Column) -> Column:
    return F.shiftright(v, 2)


def whole_div(a: Column, b: Column) -> Column:
    """Whole quotient of numbers that aren't negative."""
    return ((a - a % b) / b).cast("long")


def duration_ns(count: Column, rate: Column) -> Column:
    """Whole nanoseconds of `count` units at `rate` a second; null at rate 0."""
    per = F.when(rate != 0, rate.cast("long"))
    n = count.cast("long")
    return whole_div(n - n % per, per) * NANOS + whole_div((n % per) * NANOS, per)


def frame_index(raw: Column) -> tuple[Column, Column]:
    """Flags (top four bits) and offset (the others) of a packed frame index."""
    return F.shiftrightunsigned(raw, 28), raw.bitwiseAND(268435455)


def note_of_frequency(hz: Column) -> Column:
    """The nearest MIDI note; null outside 0 to 127."""
    n = F.round(69 + 12 * F.log2(hz / 440.0)).cast("int")
    return F.when((hz > 0) & n.between(0, 127), n)


def frequency_of_note(note: Column) -> Column:
    return 440.0 * F.pow(F.lit(2.0), (note - 69) / 12.0)


def velocity_of_energy(total: Column, count: Column) -> Column:
    """MIDI velocity of the sum of a note's frame levels: 64 without frames, 1 without level, else by the logarithm of their mean."""
    level = total / count
    scaled = F.least(F.greatest(1 + F.log10(level), F.lit(0.0)), F.lit(1.0))
    return F.when(count == 0, 64).when(total <= 0, 1).otherwise(F.least(F.greatest(F.round(scaled * 126 + 1), F.lit(1.0)), F.lit(127.0)).cast("int"))


def pcm8_to_16(v: Column) -> Column:
    return (v - 128) * 256


def without_version(name: Column) -> Column:
    """ISO names lose ;1 and then one last dot."""
    return F.regexp_replace(F.regexp_replace(name, ";[^;]*$", ""), r"\.$", "")


def until_hash(line: Column) -> Column:
    """The line before its first # that no backslash precedes, with the escaped ones as plain #."""
    return F.replace(F.regexp_replace(line, r"(?<!\\)#.*$", ""), F.lit("\\#"), F.lit("#"))


def needs_quotes(v: Column) -> Column:
    """If a text must stand in quotes in YAML."""
    special = F.lower(v).isin("true", "false", "yes", "no", "on", "off", "null", "~", "y", "n")
    number = v.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")
    first = v.rlike(r"^[\s\-?:,\[\]{}#&*!|>'\"%@`]")
    inner = v.rlike(r": |:$| #|\s$|[\n\r\t\"\\]")
    return (v == "") | special | number | first | inner


def map_rectangle(text: Column) -> Column:
    """x, y, width, height of 'x,y,w,h'; null unless there are four whole numbers."""
    parts = F.split(text, ",")
    n = [F.trim(F.get(parts, i)).try_cast("long") for i in range(4)]
    made = F.struct(*[x.alias(k) for x, k in zip(n, ("x", "y", "width", "height"), strict=True)])
    ok = F.size(parts) == 4
    for x in n:
        ok = ok & x.between(0, WORD)
    return F.when(ok, made)


# Kinds of entries by the number that stands for them; any other number is a bin.
HINTS = ("bin", "shp", "pal", "aud", "vqa", "wsa", "tmp", "fnt", "ini", "mix")


def extension_of_hint(hint: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in HINTS]), hint.cast("int")), F.lit(HINTS[0]))


def hint_of_extension(extension: Column) -> Column:
    """0 for an extension that has no number."""
    place = F.array_position(F.array(*[F.lit(x) for x in HINTS]), extension) - 1
    return F.greatest(F.coalesce(place, F.lit(0)), F.lit(0)).cast("int")


def display_name(format: Column) -> Column:
    """A format's name as it is shown: with hyphens, and some in full."""
    # Formats that are shown by another name.
    shown = {"bin": "bin-td", "str": "sage-str"}
    other = F.create_map(*[F.lit(x) for pair in shown.items() for x in pair])
    return F.coalesce(other[format], F.replace(format, F.lit("_"), F.lit("-")))
