"""Column functions against plain-Python models and written cases."""

import random

import numpy as np
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from orderloom.functions import extract, fuzzy, merge, phone, reply, text


def values(spark, rows, *cols):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    return [tuple(r)[1:] for r in df.select("i", *cols).orderBy("i").collect()]


def bare(s):
    return "".join(c for c in unicodedata.normalize("NFD", s or "") if unicodedata.category(c) != "Mn").replace("đ", "d").replace("Đ", "D")


def key(s, fold=bare):
    k = re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", fold(s).lower())).strip()
    for p in sorted(text.ADMIN_PREFIXES, key=len, reverse=True):
        k = re.sub(rf"\b{re.escape(p)}\b", " ", k)
    return " ".join(p for p in k.split() if p not in text.ADMIN_PREFIXES)


NAMES = ["Phường Tân Định", "xã  An-Thái", "TP. Hồ Chí Minh", "Thị trấn Đông Hưng", "Quận 1", "Thủ Đô Hà Nội", "", None, "ấp Bình Đức, p.3", unicodedata.normalize("NFD", "Huyện Quỳnh Phụ"), "q q tx An", "T P Đà Lạt"]


def test_keys(spark):
    got = values(spark, NAMES, text.strip_accents(F.col("s")), text.normalize_key(F.col("s")), text.normalize_text_key(F.col("s")))
    composed = [None if n is None else unicodedata.normalize("NFC", n) for n in NAMES]
    assert [g[0] for g in got] == [bare(n) for n in NAMES]
    assert [g[1] for g in got] == [key(n) for n in NAMES]
    for g, n, c in zip(got, NAMES, composed, strict=True):
        if n == c:
            assert g[2] == key(n, lambda s: unicodedata.normalize("NFKC", s or ""))


def test_text_forms(spark):
    rows = [" a\t\nb  c ", None, "ｆｕｌｌ　width", "Chị Lan nhé", "anh ơi", "b", "Nguyễn Đức"]
    got = values(spark, rows, text.compact_text(F.col("s")), text.recipient_name(F.col("s")), text.ward_code(F.col("s"), F.lit("")), text.nfkc(F.col("s")))
    assert [g[0] for g in got][:3] == ["a b c", "", "full width"]
    assert [g[1] for g in got][3:] == ["Lan", "ơi", None, "Nguyễn Đức"]
    assert got[6][2] == "W_NGUYEN_UC" and got[2][3] == "full width"


@pytest.mark.parametrize("s, want", [
    ("0912 345 678", "0912345678"), ("0912-345-678", "0912345678"), ("(0912) 345.678", "0912345678"), ("+84912345678", "0912345678"), ("84912345678", "0912345678"),
    ("091234567", None), ("09123456789", None), ("nhà số 0987654321", None), ("mã đơn: 0912345678", None), ("mã đơn 0912345678 gọi 0387654321", "0387654321"), ("0912345678, 0987654321", "0912345678"), (None, None),
])
def test_phone_cases(spark, s, want):
    assert values(spark, [s], phone.extract_phone(F.col("s"))) == [(want,)]


def test_phones_against_a_model(spark):
    number = re.compile(r"(?<!\d)\(?(?:\+?84|0)(?:[\s.\-()]*\d){9}\)?(?!\d)")
    block = re.compile(r"(mã\s*đơn|ma\s*don|nhà\s*số|nha\s*so|số\s*nhà|so\s*nha)\s*[:#-]?\s*$", re.I)

    def norm(raw):
        d = re.sub(r"\D", "", raw)
        d = "0" + d[2:] if d.startswith("84") and len(d) == 11 else d
        return d if re.fullmatch(r"0[35789]\d{8}", d) else None

    def masked(s):
        return number.sub(lambda m: m[0] if block.search(s[: m.start()]) or not norm(m[0]) else "[P]", s)

    rng = random.Random(4)
    bits = ["0912345678", "+84 912 345 678", "(0387) 654.321", "0112345678", "mã đơn ", "nhà số: ", "12", " gọi ", "0912.345.678", ", ", "x", "091234567"]
    rows = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 6))) for _ in range(500)]
    got = values(spark, rows, phone.extract_phone(F.col("s")), phone._replaced(F.col("s"), "[P]"))
    for s, (first, mask) in zip(rows, got, strict=True):
        valid = [norm(m[0]) for m in number.finditer(s) if not block.search(s[: m.start()]) and norm(m[0])]
        assert first == (valid[0] if valid else None), s
        assert mask == masked(s), s


def test_extraction(spark):
    s = "chị Mai chốt, sđt 0912345678, giao số 12A/3 ngõ 5 đường Lê Lợi, p. Tân Định, q. 1, tp Hồ Chí Minh. ghi chú: gọi trước"
    row = values(spark, [s], extract.rule_hints(F.col("s")).alias("h"), extract.extract_note(F.col("s")))[0]
    h = row[0]
    assert (h.name, h.address.province, h.address.district_hint, h.address.ward) == ("chị Mai", "Hồ Chí Minh", "Quận 1", "Phường Tân Định")
    assert (h.address.street, h.address.house_number, row[1]) == ("ngõ 5 đường Lê Lợi", "12A/3", "gọi trước")
    both = values(spark, ["giao h Quỳnh Phụ"], extract.extract_district(F.col("s")), extract.extract_district(F.col("s"), strict_compat=True))[0]
    assert both == ("Huyện Quỳnh Phụ", "Thị xã h Quỳnh Phụ") or both[0].startswith("Huyện")
    assert values(spark, ["thu cod 50k, để hàng ở cổng. Thu COD 50k, để hàng ở cổng"], extract.extract_note(F.col("s")))[0][0].count("cod") == 1


def test_replies(spark):
    rows = ['{"name": "A", "phone": "09"}', 'x {"recipient_name": "B", "phone_number": "[PHONE]", "address_info": {"municipality": "M", "neighborhood": "N"}} y', "none", "{broken", None, "{a} {"]
    got = values(spark, rows, reply.recover_json(F.col("s")).alias("r"), reply.reply_to_order(reply.recover_json(F.col("s"))["order"]).alias("o"))
    assert [g[0].status for g in got] == ["ok", "ok", "no_json", "no_json", "no_json", "error"]
    assert (got[0][1].name, got[0][1].phone) == ("A", "09")
    assert (got[1][1].name, got[1][1].phone, got[1][1].address.ward, got[1][1].address.district_hint) == ("B", None, "N", "M")


def test_merge(spark):
    rows = ["12 ngõ 5", "5", None]
    a = F.struct(F.lit(None).cast("string").alias("province"), F.lit("x").alias("district_hint"), F.lit(None).cast("string").alias("ward"), F.lit("đường Lê Lợi").alias("street"), F.col("s").alias("house_number"))
    got = [g[0] for g in values(spark, rows, merge.fix_address_parts(a).alias("a"))]
    assert (got[0].house_number, got[0].street) == ("12", "ngõ 5 đường Lê Lợi") and (got[1].house_number, got[2].house_number) == ("5", None)
    assert values(spark, ["A", " a ,", None], merge.format_address(F.col("s"), F.lit("a"), F.lit("B"))) == [("A, B",), ("a, B",), ("a, B",)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lanes_against_the_scalar_form():
    rng = random.Random(2)

    def word(n):
        return "".join(rng.choice("abcdeê \U0001F600đ") for _ in range(n))

    pairs = [(word(rng.randint(0, 14)), word(rng.randint(0, 14))) for _ in range(6000)]
    for n in (63, 64, 65, 128, 129, 200):  # several words, carries between them
        for _ in range(20):
            x = word(n)
            pairs += [(x, word(rng.randint(50, 210))), (x, x[: n // 2] + "z" + x[n // 2 :]), (x, "")]
    a, b = (np.array(side, dtype=str) for side in zip(*pairs, strict=True))
    assert fuzzy.lcs_lengths(a, b).tolist() == [lcs(str(x), str(y)) for x, y in zip(a, b, strict=True)]
    assert fuzzy.lcs_lengths(a[:0], b[:0]).tolist() == []


def test_ratio_and_its_bound(spark):
    rng = random.Random(1)

    def near(a):
        w = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randint(0, len(w))
            w[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "đ"])
        return "".join(w).strip()

    one = ["".join(rng.choice("abc dđ") for _ in range(rng.randint(0, 16))).strip() for _ in range(600)]
    pairs = [(a, near(a) if i % 2 else rng.choice(one)) for i, a in enumerate(one)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    cols = [fuzzy.indel_ratio(F.col("a"), F.col("b")).alias("r"), fuzzy.field_score(F.col("a"), F.col("b")).alias("s")]
    cols += [F.size(F.array_intersect(fuzzy.grams(F.col("a"), k), fuzzy.grams(F.col("b"), k))).alias(f"g{k}") for k in (1, 2)]
    need = {t: fuzzy.shared_grams(F.length("a"), F.length("b"), F.lit(float(t))) for t in (72, 78, 88)}
    cols += [c.alias(f"{n}{t}") for t, both in need.items() for n, c in zip(("p", "l"), both, strict=True)]
    some = 0
    for (a, b), r in zip(pairs, df.select("i", *cols).orderBy("i").collect(), strict=True):
        want = 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0
        assert abs(r.r - want) < 1e-9
        assert not a or b or r.s == 0
        for t in need:  # what is looked up in the index is necessary
            if want >= t:
                some += 1
                assert r.g2 >= r[f"p{t}"] and r.g1 >= r[f"l{t}"]
    assert some > 200


def test_decomposed_messages_parse_like_composed_ones(spark):
    import unicodedata

    from orderloom.plans.orders import rule_pass

    said = ["giao phường Tân Phú, quận 7, gọi anh Đức 0912 345 678, ghi chú: giao giờ hành chính", "ｓｈｉｐ sn ⅷ x. Vĩnh Thái, h. Quỳnh Phụ, tỉnh Thái Bình"]
    forms = [(i, f, unicodedata.normalize(f, t)) for i, t in enumerate(said) for f in ("NFC", "NFD", "NFKD")]
    got = rule_pass(spark.createDataFrame([(f"{i}{f}", t) for i, f, t in forms], "msg_id string, text string")).collect()
    by = {r["msg_id"]: r.asDict(recursive=True) for r in got}
    for i, f, t in forms:
        assert {**by[f"{i}{f}"], "msg_id": 0} == {**by[f"{i}NFC"], "msg_id": 0}
        assert by[f"{i}{f}"]["cleaned"] == " ".join(unicodedata.normalize("NFKC", t).split())
    assert by["0NFD"]["hints"]["ward"] == "Phường Tân Phú" and by["0NFD"]["hints"]["district_hint"] == "Quận 7"


def test_normal_forms_equal_pythons(spark):
    import unicodedata

    # blocks that all Unicode versions in use agree on
    rows = [chr(c) for a, b in ((1, 0x530), (0x1E00, 0x20A0), (0x2100, 0x2190), (0x3041, 0x3100), (0xAC00, 0xAD00), (0xFF01, 0xFFEF)) for c in range(a, b) if unicodedata.category(chr(c)) != "Cn"]
    rows += ["a" + chr(c) + "b" + chr(0x323) for c in range(0x300, 0x370)]
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    for r in df.select("s", text.nfkc(F.col("s")).alias("k"), text.strip_accents(F.col("s")).alias("b")).collect():
        assert r["k"] == unicodedata.normalize("NFKC", r["s"])
        bare = "".join(x for x in unicodedata.normalize("NFD", r["s"]) if unicodedata.category(x) != "Mn").replace("đ", "d").replace("Đ", "D")
        assert r["b"] == bare or 0xAC00 <= ord(r["s"]) < 0xAD00  # Hangul stays composed


def test_token_f1_counts_repeats(spark):
    from collections import Counter

    from orderloom.operators.score import token_f1

    rows = [("a b b c", "b b b d"), ("", ""), (None, "a"), ("x", None), ("A  a b", "a A b"), ("a 1 a 2", "a 2 1 a")]
    got = spark.createDataFrame(rows, "e string, p string").select(token_f1(F.col("e"), F.col("p")).alias("f")).collect()
    for (e, p), r in zip(rows, got, strict=True):
        a, b = Counter((e or "").lower().split()), Counter((p or "").lower().split())
        shared = sum((a & b).values())
        want = 1.0 if not a and not b else 2 * shared / (a.total() + b.total())
        assert abs(r["f"] - want) < 1e-12
