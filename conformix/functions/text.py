"""Text, number and hash columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How length and angle units are written, by canonical unit.
UNIT_WORDS = {
    "mm": "mm 毫米 公釐 millimeter millimeters millimetre millimetres",
    "cm": "cm 公分 centimeter centimeters centimetre centimetres",
    "m": "m 公尺 米 meter meters metre metres",
    "ft": "ft foot feet 呎 英尺",
    "in": "in inch inches 吋 英吋",
    "deg": "° 度 deg degree degrees",
}
_WORDS = sorted((w for ws in UNIT_WORDS.values() for w in ws.split()), key=len, reverse=True)
_NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
QUANTITY = rf"(?i)(?<![\d.])(?<!\d,)({_NUMBER})\s*({'|'.join(_WORDS)})(?![A-Za-z0-9²³/^·×])"
HEADING = r"^\s*(#{1,6}\s+.+|\d+(\.\d+)*[\s、.．)]\s*\S.*|第[一二三四五六七八九十百零〇\d]+[章節條款].*|[A-Z]\.\d+(\.\d+)*\s+\S.*)$"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
_PUNCTUATION = r"[\s,.;:、，。；：()\"'「」『』《》\-_/]+"


def nfkc(c: Column) -> Column:
    """Full-width ASCII and the wide blank become narrow; other compatibility forms stay as they are."""
    return F.translate(c, _WIDE, _NARROW)


def strip(c: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize(c: Column) -> Column:
    return F.regexp_replace(F.lower(nfkc(c)), r"(?U)\s+", "")


def norm_text(c: Column) -> Column:
    return F.regexp_replace(F.lower(nfkc(c)), "(?U)" + _PUNCTUATION, "")


def numbers_in(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(nfkc(c), F.lit(f"({_NUMBER})"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))


def canonical_unit(word: Column) -> Column:
    table = F.create_map(*[F.lit(x) for unit, ws in UNIT_WORDS.items() for w in ws.split() for x in (w, unit)])
    return F.try_element_at(table, F.lower(word))


def quantities_in(c: Column, with_text: bool = False) -> Column:
    """array<struct<value, unit>>, and text as written if asked for: numbers written with a unit; "in" before a word is no inch."""
    text = F.regexp_replace(nfkc(c), r"(?i)(\d\s*)(in|inch|inches|吋|英吋)(?=\s+[A-Za-z])", "$1#")
    values, units = (F.regexp_extract_all(text, F.lit(QUANTITY), F.lit(g)) for g in (1, 2))
    if with_text:
        whole = F.regexp_extract_all(text, F.lit(QUANTITY), F.lit(0))
        parts = F.arrays_zip(values.alias("v"), units.alias("u"), whole.alias("t"))
        return F.transform(parts, lambda x: F.struct(F.replace(x["v"], F.lit(","), F.lit("")).cast("double").alias("value"), canonical_unit(x["u"]).alias("unit"), x["t"].alias("text")))
    return F.zip_with(values, units, lambda v, u: F.struct(F.replace(v, F.lit(","), F.lit("")).cast("double").alias("value"), canonical_unit(u).alias("unit")))


def suggest_values(c: Column) -> Column:
    """array<struct<value, unit>>: numbers with units; if there are none, all numbers without one."""
    found, bare = quantities_in(c), F.transform(numbers_in(c), lambda n: F.struct(n.alias("value"), F.lit(None).cast("string").alias("unit")))
    return F.when(F.size(found) > 0, found).otherwise(bare)


def is_heading(line: Column) -> Column:
    s = F.trim(line)
    return (F.length(s) > 0) & (F.length(s) <= 80) & s.rlike(HEADING)


def evidence_id(doc_hash: Column, page: Column, line: Column, text: Column) -> Column:
    key = F.concat_ws("|", doc_hash, F.coalesce(page.cast("string"), F.lit("-")), line.cast("string"), F.sha2(text, 256))
    return F.concat(F.lit("EV-"), F.upper(F.substring(F.sha2(key, 256), 1, 12)))


def contains_quote(text: Column, quote: Column) -> Column:
    """The normalised quote occurs in the normalised text, never beginning or ending inside a larger number."""
    n, q = normalize(text), normalize(quote)
    safe = F.regexp_replace(q, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    before = F.when(q.rlike(r"^\d"), F.lit(r"(?<!\d)(?<!\d[.,])")).otherwise("")
    after = F.when(q.rlike(r"\d$"), F.lit(r"(?!\d)(?![.,]\d)")).otherwise("")
    return (F.length(q) > 0) & F.contains(n, q) & F.regexp_like(n, F.concat(before, safe, after))


def fixed(v: Column, digits: int | Column) -> Column:
    """`digits` decimals of the double's exact binary value, ties to even, as C and Python write them; a Column of 0 to 9 if rows differ.

    The JVM's own formats round the shortest decimal text of a double, so that 2.385 (a little less in binary) ends in 9. Here the part
    behind the point is split into two halves whose products with the power of ten are exact, and the half-way test is made on those.
    """
    own = isinstance(digits, Column)
    ten = F.element_at(F.array(*[F.lit(10**i) for i in range(10)]), digits.cast("int") + 1) if own else F.lit(10**digits)
    some = digits > 0 if own else F.lit(digits > 0)

    def text(x: Column) -> Column:
        y = F.abs(x)
        whole = F.floor(y)
        part = y - whole
        c = part * 134217729.0
        high = c - (c - part)
        p, q = high * ten.cast("double"), (part - high) * ten.cast("double")
        n = F.floor(p + q)
        over = ((p - n) - 0.5) + q
        odd = F.when(some, n).otherwise(whole) % 2 == 1
        n = n + F.when((over > 0) | ((over == 0) & odd), 1).otherwise(0)
        up = lambda m: (whole + F.when(~some, m).when(m == ten, 1).otherwise(0)).cast("string")
        tail = lambda m: F.when(some, F.concat(F.lit("."), F.lpad((m % ten).cast("string"), digits.cast("int") if own else digits, "0"))).otherwise("")
        return F.concat(F.when(x < 0, "-").otherwise(""), F.get(F.transform(F.array(n), lambda m: F.concat(up(m), tail(m))), F.lit(0)))

    # doubles beyond this have nothing behind the point
    far = F.format_string("%.0f", v) if own else F.format_string(f"%.{digits}f", v)
    return F.when(F.abs(v) < 1e16, F.get(F.transform(F.array(v), text), F.lit(0))).otherwise(far)


def fmt(v: Column) -> Column:
    """At most two decimals, no trailing zeros."""
    text = F.regexp_replace(fixed(v, 2), r"\.?0+$", "")
    return F.when(v.isNull(), "—").when(F.abs(v - F.rint(v)) < 0.005, F.rint(v).cast("bigint").cast("string")).otherwise(text)


def safe_cell(c: Column) -> Column:
    return F.when(c.rlike("^[=+\\-@\\t\\r\\n]"), F.concat(F.lit("'"), c)).otherwise(c)
