"""Rule extraction of name, address parts and note (ids X1-X11), native Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderloom.functions.text import begins, let

# The extraction patterns.
NAME = r"\b(anh|chị|chi|cô|co|chú|chu|bạn|ban|b|c)\s+([A-ZÀ-Ỵ][\wÀ-ỹ]+)"
NUMBER = r"[0-9]+[a-zA-Z]?(?:/[0-9]+[a-zA-Z]?)?"
HOUSE = rf"\b(?:sn|số nhà|so nha|số|so)\s*({NUMBER})\b"
LEADING_HOUSE = rf"\b({NUMBER})\s+(?=(?:ngách|ngach|ngõ|ngo|hẻm|hem|kiệt|kiet|đường|duong|phố|pho)\b)"
WARD = (
    r"\b(p\.?\s*\d+|p\.\s*[^,.;\n]+|p\s+[^,.;\n]+|phường\s+[^,.;\n]+|phuong\s+[^,.;\n]+|x\.\s*[^,.;\n]+|x\s+[^,.;\n]+|xã\s+[^,.;\n]+|"
    r"xa\s+[^,.;\n]+|tt\.\s*[^,.;\n]+|thị trấn\s+[^,.;\n]+|thi tran\s+[^,.;\n]+)"
)
DISTRICT = (
    r"\b(q\.?\s*\d+|q\.\s*[^,.;\n]+|q\s+[^,.;\n]+|quận\s+[^,.;\n]+|quan\s+[^,.;\n]+|h\.\s*[^,.;\n]+|h\s+[^,.;\n]+|huyện\s+[^,.;\n]+|"
    r"huyen\s+[^,.;\n]+|tx\.\s*[^,.;\n]+|thị xã\s+[^,.;\n]+|thi xa\s+[^,.;\n]+)"
)
STREET = r"\b((?:ngách|ngach|ngõ|ngo|hẻm|hem|kiệt|kiet)\s+[^,.;]+?\s+)?((?:đường|duong|phố|pho)\s+[^,.;\n]+)"
LABELLED_NOTE = r"\b(?:note|ghi chú|ghi chu)\s*[:：]?\s*([^.;\n]+(?:[.;]\s*[^.;\n]+)?)"
SIMPLE_NOTE = (
    r"\b(gọi trước[^.;\n]*|goi truoc[^.;\n]*|giao giờ[^.;\n]*|giao gio[^.;\n]*|ship sau[^.;\n]*|thu cod[^.;\n]*|cod\s*\d+[kK]?|"
    r"để hàng[^.;\n]*|de hang[^.;\n]*|chuyển khoản rồi|chuyen khoan roi)"
)
HA_NOI = r"\b(hn|hà nội|ha noi)\b"
HO_CHI_MINH = r"\b(hcm|tphcm|tp\.?\s*hcm|sài gòn|sai gon|hồ chí minh|ho chi minh)\b"
PROVINCE = r"\b(?:tỉnh|tinh|thành phố|thanh pho|tp\.?)\s+([^,.;\n]+)"
NOTE_LABEL = r"\b(?:note|ghi chú|ghi chu)\s*:"
ORDER_WORDS = r"\b(giao|ship|địa chỉ|dia chi|đc|dc|sđt|sdt|phone|tel|chốt|chot|đơn|don|cod)\b"
WARD_TYPE = r"^(phường|phuong|thị trấn|thi tran|p\.?|x\.?|xã|xa|tt\.?)\s*"
DISTRICT_TYPE = r"^(quận|quan|huyện|huyen|thị xã|thi xa|q\.?|h\.?|tx\.?)\s*"


#: The letters and signs that a match of each pattern can begin with: a look at one sign spares most places the whole pattern.
LEADS = {
    NAME: "abc", HOUSE: "s", LEADING_HOUSE: "0-9", WARD: "ptx", DISTRICT: "qht", STREET: "nhkđdp", LABELLED_NOTE: "ng", SIMPLE_NOTE: "gstcđd",
    PROVINCE: "t", HA_NOI: "h", HO_CHI_MINH: "hts", ORDER_WORDS: "gsđdptc",
}


def led(pattern: str) -> str:
    return begins(LEADS[pattern]) + pattern


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without a match; no pattern's group can match nothing."""
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), f"(?iU){led(pattern)}", group), F.lit(""))


def _ends(c: Column) -> Column:
    return F.trim(c, F.lit(" ,;."))


def extract_name(c: Column) -> Column:
    """Form of address and the word after it."""
    return F.regexp_replace(_first(c, NAME, 0), r"(?U)^(\S+)\s+", "$1 ")


def extract_province(c: Column) -> Column:
    """The two large cities by alias, else the phrase after a province word, cut at a note."""
    low = F.lower(F.coalesce(c, F.lit("")))
    named = F.regexp_replace(_first(c, PROVINCE), f"(?isU){NOTE_LABEL}.*", "")
    return F.when(low.rlike(f"(?U){led(HA_NOI)}"), F.lit("Hà Nội")).when(low.rlike(f"(?U){led(HO_CHI_MINH)}"), F.lit("Hồ Chí Minh")).otherwise(_ends(named))


def extract_district(c: Column, strict_compat: bool = False) -> Column:
    """District with its canonical type. ``h`` without a dot is a Huyện; with
    strict_compat it is labelled Thị xã."""

    def typed(raw: Column) -> Column:
        low = F.lower(raw)
        rural = low.startswith("h.") | low.startswith("huyện") | low.startswith("huyen")
        rural = rural if strict_compat else rural | low.rlike(r"(?U)^h\s")
        kind = F.when(low.startswith("q"), F.lit("Quận ")).when(rural, F.lit("Huyện ")).otherwise(F.lit("Thị xã "))
        return F.concat(kind, F.trim(F.regexp_replace(raw, f"(?iU){DISTRICT_TYPE}", "")))

    return let(F.trim(_first(c, DISTRICT)), typed)


def extract_ward(c: Column) -> Column:
    """Ward with its canonical type. As in the patterns' own order, the type of a
    written-out ``Xã`` is cut after its first letter (``Xã ã Vĩnh Thái``)."""

    def typed(raw: Column) -> Column:
        low = F.lower(raw)
        rural = low.startswith("x.") | low.startswith("x ") | low.startswith("xã") | low.startswith("xa")
        kind = F.when(low.startswith("p"), F.lit("Phường ")).when(rural, F.lit("Xã ")).otherwise(F.lit("Thị trấn "))
        return F.concat(kind, F.trim(F.regexp_replace(raw, f"(?iU){WARD_TYPE}", "")))

    return let(F.trim(_first(c, WARD)), typed)


def extract_street(c: Column) -> Column:
    """Optional alley part, then the street."""

    def parts(whole: Column) -> Column:  # the match alone, a short text, is parted once more
        return F.nullif(F.trim(F.concat_ws(" ", *[F.trim(_first(whole, STREET, k)) for k in (1, 2)])), F.lit(""))

    return let(_first(c, STREET, 0), parts)


def extract_house_number(c: Column) -> Column:
    """A labelled number, else one that stands before an alley or street word."""
    return F.coalesce(_first(c, HOUSE), _first(c, LEADING_HOUSE))


def extract_note(c: Column) -> Column:
    """The labelled note, else all simple notes, each spelling-insensitively once."""
    labelled = _ends(_first(c, LABELLED_NOTE))
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"(?iU){led(SIMPLE_NOTE)}"), F.lit(1)), _ends)
    once = F.aggregate(
        found, F.array().cast("array<string>"),
        lambda acc, n: F.when(F.exists(acc, lambda have: F.lower(have) == F.lower(n)), acc).otherwise(F.concat(acc, F.array(n))),
    )
    return F.coalesce(labelled, F.when(F.size(once) > 0, F.array_join(once, ", ")))


def address_parts(c: Column) -> dict[str, Column]:
    """The five address parts that the rules find."""
    return {
        "province": extract_province(c), "district_hint": extract_district(c), "ward": extract_ward(c), "street": extract_street(c), "house_number": extract_house_number(c),
    }


def address_hints(c: Column) -> Column:
    """The five address parts that the rules find, as a struct."""
    return F.struct(*[part.alias(x) for x, part in address_parts(c).items()])


def rule_hints(c: Column) -> Column:
    """Name and address hints as one struct."""
    return F.struct(extract_name(c).alias("name"), address_hints(c).alias("address"))


def is_likely_order(text: Column, phone: Column, addr: Column | dict[str, Column]) -> Column:
    """A phone, an address hint or an order word; such rows are parsed, others stay empty."""
    hints = addr["province"].isNotNull() | addr["ward"].isNotNull() | addr["street"].isNotNull()
    return phone.isNotNull() | hints | F.coalesce(text, F.lit("")).rlike(f"(?iU){led(ORDER_WORDS)}")


def address_signals(addr: Column) -> Column:
    """How many of province, ward, street and house number are known."""
    return sum((F.coalesce(addr[f], F.lit("")) != "").cast("int") for f in ("province", "ward", "street", "house_number"))


def can_skip_model(phone: Column, name: Column, note: Column, addr: Column, fast_mode: bool) -> Column:
    """X11: fast mode, and rules alone found phone, name, note and two address parts."""
    known = phone.isNotNull() & name.isNotNull() & note.isNotNull() & (address_signals(addr) >= 2)
    return known & F.lit(fast_mode)
