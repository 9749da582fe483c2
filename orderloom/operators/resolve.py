"""Address resolution: a blocked, ranked fuzzy join (ids N1, N6-N14).

No step pairs all addresses with all records. Addresses are reduced to their distinct
spellings, spellings and records to their distinct keys per level; keys meet in an index
of the pairs of signs that they must share to be as like as asked, are scored once, and
joined back by equality. Records are the administrative table: its keys number a few ten
thousand however many addresses there are, so its side of a join is broadcast behind a
check of its row count.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.fuzzy import combined_score, field_score, grams, indel_ratio, shared_grams, token_sorted
from orderloom.functions.text import normalize_key, normalize_text_key
from orderloom.sources.staging import staged

# The two cities whose names can stand alone, by key.
CITY_KEYS = ("ha noi", "ho chi minh")
LIMITS = {"province": 78.0, "district": 72.0, "ward": 72.0}
BROADCAST_ROWS = 200_000
#: Spellings with up to five candidates each, up to which they are broadcast.
BROADCAST_SPELLINGS = 20_000
#: Key triples of a task at most, and at least where there are fewer tasks than cores: a triple is few bytes, but meets some hundred records.
TRIPLES_PER_TASK, LEAST_TRIPLES = 1_000, 50
TRIPLE = [f"q{t}_{x}" for x in LIMITS for t in ("", "t")]


def _hinted(df: DataFrame, rows: int) -> DataFrame:
    return df.hint("broadcast" if rows <= BROADCAST_ROWS else "merge")


def flatten_wards(wards: DataFrame) -> DataFrame:
    """N1 on ward rows (province_code, province_name, pos, ward_code, ward_name, merged_from):
    one ``new`` record a ward and one ``old`` record a predecessor, with keys and ``ord``.

    ``ord`` breaks ties: it orders by province, place in the province and place among
    the predecessors (4,095 at most), without bringing the records together.
    """
    codes = sorted(r["province_code"] for r in wards.select("province_code").filter("province_code is not null").distinct().collect())  # tens of provinces
    p_no = F.array_position(F.array(*[F.lit(c) for c in codes]).cast("array<string>"), F.col("province_code"))
    base = wards.withColumnRenamed("merged_from", "olds")
    base = base.withColumn("base", F.shiftleft(F.coalesce(p_no, F.lit(0)).cast("long"), 44) + F.shiftleft(F.col("pos").cast("long"), 12))
    new = base.select(
        "province_code", "province_name", "ward_code", "ward_name", F.lit("new").alias("source"), F.col("base").alias("ord"),
        *[F.lit(None).cast("string").alias(c) for c in ("old_province_name", "old_district_name", "old_ward_name")],
        F.col("province_name").alias("p"), F.lit("").alias("d"), F.col("ward_name").alias("w"),
    )
    old = base.select("*", F.posexplode("olds").alias("opos", "o")).select(
        "province_code", "province_name", "ward_code", "ward_name", F.lit("old").alias("source"), (F.col("base") + F.col("opos") + 1).alias("ord"),
        "o.old_province_name", "o.old_district_name", "o.old_ward_name",
        F.coalesce(F.nullif("o.old_province_name", F.lit("")), "province_name").alias("p"), F.coalesce("o.old_district_name", F.lit("")).alias("d"),
        F.coalesce(F.nullif("o.old_ward_name", F.lit("")), "ward_name", F.lit("")).alias("w"),
    )
    keys = {}
    for level, c in (("province", "p"), ("district", "d"), ("ward", "w")):
        keys[f"{level}_key"], keys[f"{level}_text_key"] = normalize_key(F.col(c)), normalize_text_key(F.col(c))
    return new.unionByName(old).withColumns(keys).drop("p", "d", "w")


def flatten_admin(admin: DataFrame) -> DataFrame:
    """N1 on the nested administrative table."""
    wards = admin.select("province_code", "province_name", F.posexplode("wards").alias("pos", "w"))
    return flatten_wards(wards.select("province_code", "province_name", "pos", "w.ward_code", "w.ward_name", "w.merged_from"))


def unique_municipalities(records: DataFrame) -> DataFrame:
    """(key, province_name) of names that one old province alone has, one of the two
    cities. District and ward names are told apart; the district wins."""
    city = F.col("province_key").isin(*CITY_KEYS)
    parts = []
    for level, rank in (("district", 0), ("ward", 1)):
        named = records.filter(F.col(f"{level}_key") != "").groupBy(F.col(f"{level}_key").alias("key")).agg(
            F.count_distinct("province_key").alias("n"), F.min_by("province_name", F.when(city, F.col("ord"))).alias("province_name"),
            F.max(city).alias("city"), F.min("ord").alias("ord"),
        )
        parts.append(named.filter("n = 1 and city").select("key", "province_name", "ord", F.lit(rank).alias("level")))
    both = parts[0].unionByName(parts[1])
    return both.groupBy("key").agg(F.min_by("province_name", "level").alias("province_name"), F.min_by("ord", "level").alias("ord"))


def _tokens(keys: DataFrame, side: str, plain: bool) -> DataFrame:
    """(level, key, side, n, kind, gram): the pairs of signs (kind 2) and letters (kind 1) of each key."""
    form = F.col("key") if plain else token_sorted(F.col("key"))
    formed = keys.select("level", "key", form.alias("form"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), grams(F.col("form"), k).alias("grams")) for k in (2, 1)])
    each = formed.select("level", "key", F.length("form").alias("n"), F.explode(kinds).alias("g")).select("level", "key", "n", "g.kind", F.explode("g.grams").alias("gram"))
    return each.withColumn("side", F.lit(side))


def key_pairs(queries: DataFrame, keys: DataFrame, least: dict[str, float], plain: bool = False) -> DataFrame:
    """(level, q, r, score) of distinct non-blank query keys (level, q) and record keys (level, r)
    whose field score, or ``plain`` ratio, is ``least`` of the level or more.

    An index with prefix filter: a score bounds from below how many pairs of signs two keys
    share (of short keys: how many letters), so of each key's n pairs, rarest first, only n less
    that bound and one more need be looked up. The field score reaches 72 and more
    by the sorted words alone, so those are what is indexed.
    """
    q = queries.filter("q <> ''").distinct().withColumnRenamed("q", "key")
    r = keys.filter("r <> ''").distinct().withColumnRenamed("r", "key")
    tokens = staged(_tokens(q, "q", plain).unionByName(_tokens(r, "r", plain)), "key-grams")
    often = tokens.groupBy("level", "kind", "gram").agg(F.count(F.lit(1)).alias("often"))
    ranked = tokens.join(often.hint("merge"), ["level", "kind", "gram"])
    ranked = ranked.withColumn("k", F.row_number().over(Window.partitionBy("level", "side", "key", "kind").orderBy("often", "gram")))  # a key's own grams
    ranked = staged(ranked.select("level", "side", "key", "n", "kind", "gram", "k"), "key-index")
    a, b = (ranked.filter(F.col("side") == x).select("level", "kind", "gram", F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("k").alias(f"k{x}")) for x in ("q", "r"))
    need = F.coalesce(*[F.when(F.col("level") == level, F.lit(float(x))) for level, x in least.items()])
    pairs, letters = shared_grams(F.col("nq"), F.col("nr"), need)
    by_pairs = (F.col("kind") == 2) & (pairs >= 1) & (F.col("kq") <= F.col("nq") - pairs) & (F.col("kr") <= F.col("nr") - pairs)
    by_letters = (F.col("kind") == 1) & (pairs < 1) & (F.col("kq") <= F.col("nq") - letters + 1) & (F.col("kr") <= F.col("nr") - letters + 1)
    met = a.join(b.hint("merge"), ["level", "kind", "gram"]).filter((letters <= F.least("nq", "nr")) & (by_pairs | by_letters))
    near = met.select("level", "q", "r").distinct()
    score = indel_ratio(F.col("q"), F.col("r")) if plain else field_score(F.col("q"), F.col("r"))
    return near.withColumn("score", score).filter(F.col("score") >= need)


def infer_province(df: DataFrame, col: str, unique: DataFrame, out: str = "inferred", min_score: float = 88.0) -> DataFrame:
    """Adds ``out``: the city that a municipality names, by equal key, else by the best
    plain ratio of ``min_score`` or more (the first record on ties)."""
    keyed = df.withColumn("__k", normalize_key(F.col(col)))
    keys = keyed.filter(F.coalesce(F.col(col), F.lit("")) != "").select(F.lit("any").alias("level"), F.col("__k").alias("q")).distinct()
    pairs = key_pairs(keys, unique.select(F.lit("any").alias("level"), F.col("key").alias("r")), {"any": min_score}, plain=True)
    best = pairs.join(_hinted(unique.withColumnRenamed("key", "r"), unique.count()), "r").groupBy("q").agg(
        F.max_by("province_name", F.struct((F.col("q") == F.col("r")).alias("e"), "score", -F.col("ord"))).alias(out)
    )
    return keyed.join(best.withColumnRenamed("q", "__q").hint("merge"), F.col("__k") == F.col("__q"), "left").drop("__k", "__q")


def query_keys(addresses: DataFrame) -> DataFrame:
    """Adds the six keys of an address (province, district_hint, ward)."""
    keys = {}
    for level, c in (("province", "province"), ("district", "district_hint"), ("ward", "ward")):
        keys[f"q_{level}"], keys[f"qt_{level}"] = normalize_key(F.col(c)), normalize_text_key(F.col(c))
    return addresses.withColumns(keys)


def candidates(queries: DataFrame, records: DataFrame) -> DataFrame:
    """For each distinct key triple the records that pass all limits, scored.

    A blank query key passes every record at 100; a blank record district is
    exempt from the limit and scores 0. A ward key left blank by prefix removal meets
    the records of its province; without one, those of its district and those without a
    district, of all provinces; a triple that is blank throughout meets every record. Such
    keys are few words (administrative types), whatever the number of addresses.
    """
    q = staged(queries.select(*TRIPLE).distinct(), "triples")
    n, asking = records.count(), q.count()
    asked, known = (
        functools.reduce(DataFrame.unionByName, [df.select(F.lit(x).alias("level"), F.col(f"{head}{x}{tail}").alias(name)) for x in LIMITS])
        for df, head, tail, name in ((q, "q_", "", "q"), (records, "", "_key", "r"))
    )
    # pairs grow with the queries: written, so that they are counted and not scored again
    found = staged(key_pairs(asked, known, LIMITS), "pairs")
    rows = {r["level"]: r["n"] for r in found.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}  # three levels
    pairs = {x: _hinted(found.filter(F.col("level") == x).select(F.col("q").alias(f"q_{x}"), F.col("r").alias(f"{x}_key"), F.col("score").alias(f"{x}_score")), rows.get(x, 0)) for x in LIMITS}
    rec = _hinted(records, n)
    tasks = max(-(-asking // TRIPLES_PER_TASK), min(q.sparkSession.sparkContext.defaultParallelism, asking // LEAST_TRIPLES))
    q = q.repartition(tasks, *TRIPLE) if tasks > 1 else q  # a scan's splits go by bytes
    named = q.filter("q_ward <> ''").join(pairs["ward"], "q_ward").join(rec, "ward_key")
    blank = q.filter("q_ward = ''").withColumn("ward_score", F.lit(100.0))
    by_province = blank.filter("q_province <> ''").join(pairs["province"].drop("province_score"), "q_province").join(rec, "province_key")
    hit = named.unionByName(by_province)
    anywhere = blank.filter("q_province = ''")
    if not anywhere.isEmpty():
        by_district = anywhere.filter("q_district <> ''").join(pairs["district"].drop("district_score"), "q_district").join(rec, "district_key")
        codes = [r["province_key"] for r in records.select("province_key").distinct().collect()]  # tens of provinces
        every = anywhere.withColumn("province_key", F.explode(F.array(*[F.lit(c) for c in codes])))
        free = every.filter("q_district = ''").join(rec, "province_key").unionByName(
            every.filter("q_district <> ''").join(_hinted(records.filter("district_key = ''"), n), "province_key"))
        hit = hit.unionByName(by_district).unionByName(free)
    hit = hit.join(pairs["province"], ["q_province", "province_key"], "left")
    hit = hit.filter("q_province = '' or province_score is not null")
    hit = hit.join(pairs["district"], ["q_district", "district_key"], "left")
    hit = hit.filter("q_district = '' or district_key = '' or district_score is not null")
    d = F.when(F.col("q_district") == "", 100.0).otherwise(F.coalesce("district_score", F.lit(0.0)))
    p = F.when(F.col("q_province") == "", 100.0).otherwise(F.col("province_score"))
    hit = hit.withColumn("score", F.round(combined_score(p, d, F.col("ward_score"), F.col("q_province") != "", F.col("q_district") != ""), 2))
    return tie_signals(hit.drop("province_score", "district_score", "ward_score"))


def tie_signals(df: DataFrame) -> DataFrame:
    """Accent-aware weighted score and number of equal accent-aware keys, on survivors only."""
    tie = {x: field_score(F.col(f"qt_{x}"), F.col(f"{x}_text_key")) for x in LIMITS}
    exact = {x: (F.col(f"qt_{x}") == F.col(f"{x}_text_key")).cast("int") for x in LIMITS}
    return df.withColumns({f"__{x}": c for x, c in tie.items()}).withColumns({
        "tie_score": combined_score(F.col("__province"), F.col("__district"), F.col("__ward"), F.col("qt_province") != "", F.col("qt_district") != ""),
        "exact_matches": exact["province"] + F.when(F.col("qt_district") != "", exact["district"]).otherwise(0) + exact["ward"],
    }).drop(*[f"__{x}" for x in LIMITS])


def rank_candidates(df: DataFrame) -> DataFrame:
    """Adds ``rank`` within each key triple."""
    order = [F.desc("score"), F.desc("exact_matches"), F.desc("tie_score"), F.col("old_district_name").isNull(), F.col("source") != "new", F.asc("ord")]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*TRIPLE).orderBy(*order)))


def first_candidates(queries: DataFrame, records: DataFrame, k: int = 5) -> DataFrame:
    """The candidates of rank 1 to ``k`` of each distinct key triple, ranked as ``rank_candidates`` ranks all.

    Records of equal keys are a class: they score alike and only ``ord`` parts them. So triples
    meet the first record of each class, and only the first ``k`` records of the first ``k`` classes
    can have one of the ranks. A triple's work grows with the distinct names, not with the records.
    """
    alike = [f"{x}{tail}" for x in LIMITS for tail in ("_key", "_text_key")] + ["source", "__whole"]
    ordered = Window.partitionBy(*alike).orderBy("ord")
    firsts = records.withColumn("__whole", F.col("old_district_name").isNull()).withColumn("__place", F.row_number().over(ordered)).filter(F.col("__place") <= k)
    firsts = staged(firsts.withColumn("__head", F.min("ord").over(Window.partitionBy(*alike))), "record-classes").drop("__whole")  # at most k rows a class
    heads = firsts.filter("__place = 1").drop("__place", "__head")
    signals = ["score", "tie_score", "exact_matches"]
    best = rank_candidates(candidates(queries, heads)).filter(F.col("rank") <= k).select(*TRIPLE, *signals, F.col("ord").alias("__head"))
    best = staged(best, "best-classes")
    every = best.join(_hinted(firsts.drop("__place"), firsts.count()), "__head").drop("__head")
    return rank_candidates(every).filter(F.col("rank") <= k)


def top_candidates(df: DataFrame, k: int = 5) -> DataFrame:
    """The first k candidates of each triple as an array in rank order."""
    one = F.struct(
        "rank", "province_name", "ward_name", "province_code", "ward_code", "score",
        F.when(F.col("source") == "new", "new_address").otherwise("old_address_mapping").alias("matched_by"),
        "old_province_name", "old_district_name", "old_ward_name",
    )
    return df.filter(F.col("rank") <= k).groupBy(*TRIPLE).agg(F.array_sort(F.collect_list(one)).alias("candidates"))  # at most k each


def is_ambiguous(cands: Column) -> Column:
    """One of ranks 2-5 within 0.01 of the best names another place."""
    best = cands[0]
    return F.exists(
        F.slice(cands, 2, 4),
        lambda c: (c["score"] >= best["score"] - 0.01) & ~(c["province_name"].eqNullSafe(best["province_name"]) & c["ward_name"].eqNullSafe(best["ward_name"])),
    )


def verdict(df: DataFrame, threshold: float = 84.0) -> DataFrame:
    """Adds ``resolved`` (struct) from ``candidates``: place, trust and warnings."""
    c = F.col("candidates")
    ward = F.coalesce(F.col("ward"), F.lit("")) != ""
    found = ward & c.isNotNull()
    best, vague = F.get(c, F.lit(0)), F.coalesce(is_ambiguous(c), F.lit(False))
    low = best["score"] < threshold
    warnings = F.array_compact(F.array(
        F.when(~ward, F.lit("missing_ward")), F.when(ward & c.isNull(), F.lit("admin_normalization_not_found")),
        F.when(found & low, F.lit("low_admin_match_confidence")), F.when(found & vague, F.lit("ambiguous_admin_match")),
        F.when(found & (F.coalesce(F.col("house_number"), F.lit("")) == ""), F.lit("missing_house_number")),
        F.when(ward & (F.col("q_ward") == ""), F.lit("blank_ward_key")),
    ))
    return df.withColumn("resolved", F.struct(
        F.when(found, best["province_name"]).otherwise(F.col("province")).alias("province"),
        F.when(found, best["ward_name"]).otherwise(F.col("ward")).alias("ward"), "street", "house_number",
        F.coalesce(found & ~low & ~vague, F.lit(False)).alias("is_normalized"),
        F.when(found, F.round(best["score"] / 100, 4)).otherwise(0.0).alias("confidence"),
        F.when(found, best["matched_by"]).alias("matched_by"),
        F.when(found, c).otherwise(F.array().cast(dict(df.dtypes)["candidates"])).alias("candidates"), warnings.alias("warnings"),
    ))


def resolve_spellings(spellings: DataFrame, records: DataFrame) -> DataFrame:
    """(province, district_hint, ward, q_ward, candidates) of distinct spellings."""
    keyed = staged(query_keys(spellings), "spellings")
    top = top_candidates(first_candidates(keyed.filter(F.coalesce("ward", F.lit("")) != ""), records))
    return keyed.join(top.hint("merge"), TRIPLE, "left").select(*SPELLING, "q_ward", "candidates")


SPELLING = ["province", "district_hint", "ward"]


def joined_spellings(addresses: DataFrame, resolved: DataFrame, threshold: float) -> DataFrame:
    """Addresses with ``resolved`` from what their spellings have."""
    n = resolved.count()
    other = resolved.withColumnsRenamed({c: f"__{c}" for c in SPELLING})
    other = other.hint("broadcast" if n <= BROADCAST_SPELLINGS else "merge")  # up to five candidates a row
    same = functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in SPELLING])
    return verdict(addresses.join(other, same, "left"), threshold).drop(*[f"__{c}" for c in SPELLING], "q_ward", "candidates")


def resolve_records(addresses: DataFrame, records: DataFrame, threshold: float = 84.0) -> DataFrame:
    """N14 on flattened records: each address with ``resolved``. Keys are made and
    scored once for each distinct spelling of province, district and ward."""
    spellings = addresses.select(*SPELLING).distinct()
    return joined_spellings(addresses, staged(resolve_spellings(spellings, records), "resolved-spellings"), threshold)


def normalize_addresses(addresses: DataFrame, admin: DataFrame, threshold: float = 84.0) -> DataFrame:
    """Addresses against the nested administrative table."""
    return resolve_records(addresses, staged(flatten_admin(admin), "records"), threshold)
