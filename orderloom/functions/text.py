"""Text canonicalisation as native Column functions (ids T1-T14).

Everything runs in the JVM but full normalisation of the few rows that need it. The
table of accents is generated from ``unicodedata`` once per process.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Administrative prefixes, without accents.
ADMIN_PREFIXES = (
    "thanh pho", "thu do", "tp", "t p", "tinh", "quan", "q", "huyen", "thi xa", "tx", "phuong", "p", "xa", "thi tran", "tt", "thon", "ap",
)
# Forms of address before a name, particles after it, and words that are no name.
HONORIFICS = ("anh", "chị", "chi", "cô", "co", "chú", "chu", "bạn", "ban", "bé", "be", "b", "c", "a")
PARTICLES = ("nhé", "nha", "nhe", "nhỉ", "nhi", "ạ", "à", "nhờ", "vậy", "thôi", "được", "ok", "oke", "ha", "hả", "rồi", "xong")
NOT_NAMES = (
    "nhé", "nha", "nhe", "nhỉ", "nhi", "ạ", "à", "ư", "ừ", "ha", "hả", "nhờ", "nho", "vậy", "vay", "thôi", "thoi",
    "được", "duoc", "ok", "oke", "okay", "rồi", "roi", "xong",
)
# Administrative types and their short forms, dotted and bare; the first that fits counts.
SHORT_FORMS = (
    ("Thành Phố ", "tp. ", "tp "), ("Thành phố ", "tp. ", "tp "), ("Thủ Đô ", "", ""), ("Thủ đô ", "", ""), ("Thị trấn ", "tt. ", "tt "), ("Thị xã ", "tx. ", "tx "),
    ("Phường ", "p. ", "p "), ("Huyện ", "h. ", "h "), ("Quận ", "q. ", "q "), ("Tỉnh ", "tỉnh ", ""), ("Xã ", "x.", "x "),
)


#: Blocks whose letters no compatibility normalisation changes; other characters need a look. ASCII falls at the first range, most accented letters at the next two.
_SETTLED = r"[\x{80}-\x{10FFFF}&&[^\u1EA0-\u1EFF]&&[^\u00C0-\u0131]&&[^\u0134-\u013E\u0141-\u0148\u014A-\u017E\u0180-\u01C3\u01CD-\u01F0\u01F4-\u024F\u0400-\u0481\u048A-\u052F\u1E00-\u1E99]]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def begins(*starts: str) -> str:
    """Look-ahead at the first signs of a pattern that ignores case: any of ``starts``, each a class
    or two of them parted by a blank. What a letter can stand for is listed, as a class that ignores
    case maps each sign of the text several times."""
    others = {"s": "\u017F", "k": "\u212A", "i": "\u0130\u0131"}

    def signs(letters: str) -> str:
        return "".join(dict.fromkeys(x for c in letters for x in (c, c.upper(), *others.get(c, ""))))

    return f"(?=(?-i:{'|'.join(''.join(f'[{signs(x)}]' for x in start.split(' ')) for start in starts)}))"


def needs_exact(c: Column) -> Column:
    """Rows with a character outside the settled blocks, which normalisation may change."""
    return F.coalesce(c.rlike(_SETTLED), F.lit(False))


def _full_nfkc(s: pa.Array) -> pa.Array:
    if s.null_count == len(s):  # most batches
        return s
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in s.to_pylist()], s.type)


def nfkc(c: Column) -> Column:
    """Full NFKC, with composition and expansion; null stays null. Only rows that
    ``needs_exact`` marks, which are rare, carry their text to Python, in Arrow batches."""
    needs = needs_exact(c)
    return F.coalesce(F.arrow_udf(_full_nfkc, "string")(F.when(needs, c)), c)


@cache
def _accent_table() -> tuple[str, str]:
    source, target = [], []
    for code in range(0x80, 0x10000):
        ch = chr(code)
        if 0xD800 <= code < 0xE000:
            continue
        bare = "".join(x for x in unicodedata.normalize("NFD", ch) if unicodedata.category(x) != "Mn")
        if len(bare) == 1 and bare != ch:
            source.append(ch)
            target.append(bare)
    return "".join([*source, "đ", "Đ"]), "".join([*target, "d", "D"])


def collapse_ws(c: Column) -> Column:
    """Runs of white space become one space, ends trimmed; null stays null."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def compact_text(c: Column) -> Column:
    """Compatibility characters, white space collapsed and trimmed; null becomes empty."""
    return collapse_ws(nfkc(F.coalesce(c, F.lit(""))))


def strip_accents(c: Column) -> Column:
    """Marks removed, đ to d; null becomes empty. Composed and decomposed text agree;
    Hangul syllables, which hold no marks, stay whole."""
    c = F.coalesce(c, F.lit(""))
    bare = F.regexp_replace(F.translate(c, *_accent_table()), r"\p{Mn}+", "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), bare).otherwise(c)


def _key(low: Column, remove_admin_prefix: bool) -> Column:
    key = F.trim(F.regexp_replace(low, r"(?U)\W+", " "))
    if not remove_admin_prefix:
        return key
    # the prefixes of two words by a pattern; those of one word, like empty words, by the words
    pairs = "|".join(p for p in ADMIN_PREFIXES if " " in p)
    words = F.split(F.regexp_replace(key, rf"(?U)\b(?:{pairs})\b", " "), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*ADMIN_PREFIXES, "")), " ")


def normalize_key(c: Column, remove_admin_prefix: bool = True) -> Column:
    """Accentless lower-case key without administrative prefixes (anywhere in it)."""
    return _key(F.lower(strip_accents(c)), remove_admin_prefix)


def normalize_text_key(c: Column, remove_admin_prefix: bool = True) -> Column:
    """T4: as normalize_key with accents kept; accented prefixes therefore remain."""
    return _key(F.lower(nfkc(F.coalesce(c, F.lit("")))), remove_admin_prefix)


def score_text(c: Column) -> Column:
    """T5: the scorer's form; null becomes empty."""
    return F.lower(compact_text(c.cast("string")))


def eval_text(c: Column) -> Column:
    """Trimmed lower case; null stays null."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def export_text(c: Column) -> Column:
    """The scorer's form without compatibility mapping."""
    return collapse_ws(F.lower(F.coalesce(c.cast("string"), F.lit(""))))


def place_name(c: Column) -> Column:
    """Accentless lower-case place name, white space collapsed."""
    return F.lower(F.regexp_replace(strip_accents(F.trim(c)), r"(?U)\s+", " "))


def ward_code(name: Column, code: Column) -> Column:
    """The official code, else W_ and an upper-case slug (đ has no base letter here and becomes _)."""
    kept_d = F.translate(F.upper(name), "Đ", "\u0001")
    slug = F.regexp_replace(F.regexp_replace(strip_accents(kept_d), "[^A-Z0-9]", "_"), "_+", "_")
    return F.coalesce(F.nullif(code, F.lit("")), F.concat(F.lit("W_"), F.trim(slug, F.lit("_"))))


def strip_honorific(c: Column) -> Column:
    """One leading form of address removed; empty becomes null."""
    return F.nullif(F.regexp_replace(collapse_ws(c), rf"(?iU)^(?:{'|'.join(HONORIFICS)})\s+", ""), F.lit(""))


def recipient_name(c: Column) -> Column:
    """Name without form of address and trailing particle; null if no name is left."""
    bare = F.regexp_replace(F.trim(c), rf"(?iU)^(?:{'|'.join(HONORIFICS)})\s+", "")
    bare = F.regexp_replace(F.trim(bare), rf"(?iU)\s+(?:{'|'.join(PARTICLES)})$", "")
    return F.when(~F.lower(bare).isin(*NOT_NAMES) & (F.length(bare) >= 2), bare)


def abbreviate_admin(c: Column, dotted: Column) -> Column:
    """The administrative type at the start in its short form; null and empty give null."""
    long = F.regexp_extract(c, f"^(?:{'|'.join(x for x, _, _ in SHORT_FORMS)})", 0)
    tables = (F.create_map(*[F.lit(x) for form in SHORT_FORMS for x in (form[0], form[k])]) for k in (1, 2))
    short = F.when(dotted, F.try_element_at(next(tables), long)).otherwise(F.try_element_at(next(tables), long))
    return F.nullif(F.concat(F.coalesce(short, F.lit("")), F.substring(c, F.length(long) + 1, F.length(c))), F.lit(""))


def _swap(c: Column, pairs: tuple[tuple[str, str], ...], otherwise: Column) -> Column:
    out = otherwise
    for long, short in reversed(pairs):
        out = F.when(c.startswith(long), F.concat(F.lit(short), F.substring(c, len(long) + 1, 1 << 20))).otherwise(out)
    return out


def short_province(c: Column, idx: Column) -> Column:
    """HN / HCM on every third index, else the type shortened or dropped."""
    plain = _swap(c, (("Thành phố ", "TP. "), ("Thành Phố ", "TP. "), ("Tỉnh ", ""), ("Thủ Đô ", "")), c)
    third = F.pmod(idx, F.lit(3)) == 0
    return F.when(third & F.lower(c).contains("hà nội"), F.lit("HN")).when(third & F.lower(c).contains("hồ chí minh"), F.lit("HCM")).otherwise(plain)


def short_district(c: Column, idx: Column) -> Column:
    short = _swap(c, (("Quận ", "q. "), ("Huyện ", "h. "), ("Thành phố ", "tp. ")), c)
    return F.when(F.pmod(idx, F.lit(2)) == 0, short).otherwise(c)


def short_ward(c: Column, idx: Column) -> Column:
    short = _swap(c, (("Phường ", "p. "), ("Xã ", "x. "), ("Thị trấn ", "tt. ")), c)
    return F.when(F.pmod(idx, F.lit(2)) == 0, short).otherwise(c)
