"""Which address records denote the same location, although they are written differently.

An address is split into its words and its house numbers. The distinct wordings of all addresses and of the gazetteer become
weighted character n-grams (inverse document frequency over all of them) in inverted indexes, which are probed only with the
prefix of a wording's rarest n-grams; cosine similarity verifies the candidates. A wording is first led to the town of the
gazetteer it names, so that writings in two scripts meet; wordings that no single town explains are compared with one another
through an index of their own, whose keys hold the house numbers as well. Addresses match if their towns are the same, or
their wordings near enough, and their house numbers are compatible: all three equal. Wordings repeat a lot, so each is looked
up once, and no two addresses are compared that differ in their numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plotwise.operators.pairs import pairs_by_key
from plotwise.session import broadcast_if_small, materialize

_ASCII = "".join(map(chr, range(0x21, 0x7F)))
_WIDE = "".join(chr(ord(c) + 0xFEE0) for c in _ASCII)
# Dashes, and old or variant forms of characters with the form in general use.
_DASHES = "‐‑‒–—―−－ｰ─━"
_OLD = "澤﨑嵜嶋嶌關螢櫻濱峽曾溪瀧龍邊邉廣國學櫪萬鹽齋齊眞惠寶藏縣區號條會灣驛假槇壺榮穗瀨靜實晴與淺邨燈灯"
_NEW = "沢崎崎島島関蛍桜浜峡曽渓滝竜辺辺広国学枥万塩斎斉真恵宝蔵県区号条会湾駅仮槙壷栄穂瀬静実晴与浅村灯灯"
_NUM = "[0-9〇一二三四五六七八九十百]+"
_TRIPLE = rf"({_NUM})\s*(?:丁目|[\s-]*(?:chome|cho-me)|-|の|ノ)[\s-]*({_NUM})\s*(?:番地の|番地|番|-|の|ノ)[\s-]*({_NUM})"
_POSTAL = r"(?:〒\s*|\A\s*|[\s,])([0-9]{3}-?[0-9]{4})(?=[^0-9-]|\z)|〒\s*([0-9]{3}-?[0-9]{4})"

#: Cosine from which a wording names a town beyond doubt, that it must reach on its words alone, and where the postal code agrees.
SURE, BY_WORDS, BY_POSTAL = 0.9, 0.55, 0.03
#: Cosine of two wordings outside the gazetteer that name the same place.
BY_ADDRESS = 0.6
#: A wording is clear if no other town comes so near to its best one; a bare town name without a postal code never is.
MARGIN = 0.02
#: Every n-gram counts as if it were in one wording of so many more, so that a slip's unheard-of n-grams don't outweigh the rest.
SMOOTHING = 500
#: The prefix is taken until the rest of the vector is this part of the cosine looked for; up to 1 none is missed.
PREFIX_SURE, PREFIX_REST = 0.9, 0.85
#: Wordings that a task compares with the gazetteer.
TASK_WORDINGS = 400
#: What an agreeing postal code counts against cosine when towns compete.
POSTAL_BONUS = 0.35


def folded(address: Column) -> Column:
    """The address without character width, case, dash and character variants."""
    plain = F.lower(F.translate(F.translate(address, _WIDE + "　", _ASCII + " "), _DASHES + _OLD, "-" * len(_DASHES) + _NEW))
    plain = F.regexp_replace(plain, r"(?<=[0-9])ー(?=[0-9])", "-")
    return F.regexp_replace(plain, r"(?<=[^ -~])[がケガ](?=[丘原崎沢谷台関峰])", "ヶ")


def _number(c: Column) -> Column:
    """A number in digits or in Japanese numerals."""
    s = F.translate(c, "〇一二三四五六七八九", "0123456789")
    digits = lambda p: F.regexp_extract(s, p, 1)
    hundreds = F.when(s.contains("百"), F.when(digits("^([0-9]*)百") == "", 1).otherwise(digits("^([0-9]*)百").try_cast("bigint"))).otherwise(0)
    tens = F.when(s.contains("十"), F.when(digits("([0-9]*)十") == "", 1).otherwise(digits("([0-9]*)十").try_cast("bigint"))).otherwise(0)
    ones = F.coalesce(digits("([0-9]*)$").try_cast("bigint"), F.lit(0))
    return F.when(s.rlike("^[0-9]+$"), s.try_cast("bigint")).otherwise(hundreds * 100 + tens * 10 + ones)


def _words(text: Column) -> Column:
    """The place words in one writing: Latin words apart, in order of the alphabet; Japanese without spaces and markers."""
    latin = F.regexp_replace(text, r"-(?:shi|ku|cho|machi|mura|son|gun|ken|fu|to|do)\b|\b(?:city|town|ward|village|prefecture|pref|japan)\b\.?", " ")
    latin = F.array_join(F.array_sort(F.filter(F.split(latin, r"[^a-z]+"), lambda w: w != "")), " ")
    japanese = F.regexp_replace(F.regexp_replace(text, r"大字|字(?=.)|[\s,、・-]", ""), r"(.)\1", "$1")
    return F.when(text.rlike("[a-z]{3}"), latin).otherwise(japanese)


def parsed(df: DataFrame, key: str, address: str) -> DataFrame:
    """(rid, words, postal, n1, n2, n3) of each address that has three house numbers; repeated rows once."""
    text = F.col("text")
    rows = df.select(F.col(key).alias("rid"), folded(F.col(address)).alias("text")).where("rid is not null and text is not null").distinct()
    rows = rows.withColumn("postal", F.regexp_replace(F.concat(F.regexp_extract(text, _POSTAL, 1), F.regexp_extract(text, _POSTAL, 2)), "-", ""))
    rows = rows.withColumn("text", F.regexp_replace(text, _POSTAL, " "))
    rows = rows.withColumns({f"n{k}": _number(F.regexp_extract(text, _TRIPLE, k)) for k in (1, 2, 3)}).where(text.rlike(_TRIPLE))
    latin = text.rlike("[a-z]{3}")
    # What follows the numbers of a Japanese address is a building.
    words = _words(F.when(latin, F.regexp_replace(text, _TRIPLE, " ")).otherwise(F.regexp_extract(text, rf"\A(.*?)(?:{_TRIPLE})", 1)))
    return rows.select("rid", words.alias("words"), "postal", "n1", "n2", "n3")


def gazetteer(towns: DataFrame) -> DataFrame:
    """(town, words, postal): each town in the writings an address may use, with and without the prefecture.

    town_ref: postal_code, prefecture, city, town and their Latin forms. Folded as addresses are.
    """
    f = lambda c: folded(F.coalesce(F.col(c), F.lit("")))
    ja, la = [f("prefecture"), f("city"), f("town")], [f("prefecture_latin"), f("city_latin"), f("town_latin")]
    forms = [_words(F.concat(*ja[k:])) for k in range(2)] + [_words(F.concat_ws(" ", *la[k:])) for k in range(2)]
    town = F.concat_ws("|", f("prefecture"), f("city"), f("town"))
    rows = towns.select(town.alias("town"), F.explode(F.array(*forms)).alias("words"), F.regexp_replace(F.coalesce("postal_code", F.lit("")), "-", "").alias("postal"))
    return rows.where("words <> ''").distinct()


def grams(words: Column) -> Column:
    """The distinct n-grams of the words: one and two characters of Japanese, three of each Latin word with its borders."""

    def cut(text: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))

    latin = F.flatten(F.transform(F.split(words, " "), lambda w: cut(F.concat(F.lit("^"), w, F.lit("$")), 3)))
    return F.array_distinct(F.when(words.rlike("^[a-z ]+$"), latin).otherwise(F.concat(cut(words, 1), cut(words, 2))))


def _vectors(rows: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """(key, v): unit vectors, an array of (g, w, rest), the rarest n-gram first: its place in that order, its weight, and the
    length of the vector from it on. Linear in the length of a wording, and long ones are sorted by spilling, not in memory."""
    long = rows.select(key, F.explode(grams(F.col("words"))).alias("gram")).join(weights, "gram")
    long = long.withColumn("from", F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key).orderBy(F.desc("g"))))
    v = long.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("g", "w", "from"))).alias("v"), F.sqrt(F.max("from")).alias("norm"))
    return v.select(key, F.transform("v", lambda x: F.struct(x["g"].alias("g"), (x["w"] / F.col("norm")).alias("w"), (F.sqrt(x["from"]) / F.col("norm")).alias("rest"))).alias("v"))


def _as_map(v: Column) -> Column:
    return F.map_from_entries(F.transform(v, lambda e: F.struct(e["g"], e["w"])))


def _dot(v: Column, m: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, e: s + e["w"] * F.coalesce(F.try_element_at(m, e["g"]), F.lit(0.0)))


def gram_weights(texts: DataFrame) -> DataFrame:
    """(gram, w, g) of distinct wordings (words): the inverse document frequency, and the place in the order of rarity."""
    df = materialize(texts.select(F.explode(F.concat(F.array(F.lit("")), grams(F.col("words")))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df")))
    count = float(df.where("gram = ''").agg(F.coalesce(F.max("df"), F.lit(1))).first()[0])
    # Rare n-grams first; equal ones by a hash.
    g = F.shiftleft("df", 40) + F.pmod(F.xxhash64("gram"), F.lit(1 << 40))
    return broadcast_if_small(materialize(df.where("gram <> ''").select("gram", F.log(1 + count / (F.col("df") + count / SMOOTHING)).alias("w"), g.alias("g"))), 80)


def _candidates(mine: DataFrame, lists: DataFrame, least: float, part: float) -> DataFrame:
    """(x, y): every pair whose cosine can reach `least`.

    Whoever reaches it shares an n-gram of the prefix, since the rest of the vector is shorter. The prefix is taken until the
    rest is `part` of it: its n-grams are still among the rarer ones, and what candidates share in them, with the lengths of
    both rests, rules nearly all out before any vector is compared. All probes of a wording are in one task, so what it shares
    with a candidate adds up without a shuffle.
    """
    parts = max(int(mine.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-mine.count() // TASK_WORDINGS))
    mine = mine.repartition(parts, "x")
    short = least * part
    # Length of the vector after the prefix: that of the first n-gram left out.
    rest = F.coalesce(F.array_max(F.transform(F.filter("v", lambda e: e["rest"] < short), lambda e: e["rest"])), F.lit(0.0))
    probes = mine.select("x", rest.alias("left"), F.explode(F.filter("v", lambda e: e["rest"] >= short)).alias("e")).select("x", "left", "e.g", "e.w")
    met = probes.join(lists, "g").select("x", "left", "w", F.inline("ys")).groupBy("x", "y").agg(F.sum(F.col("w") * F.col("hub_w")).alias("part"), F.max("left").alias("left"), F.min("after").alias("after"))
    return met.where(F.col("part") + F.col("left") * F.col("after") >= least - 1e-9).select("x", "y")


def resolve(wordings: DataFrame, towns: DataFrame, weights: DataFrame, hub: DataFrame, by_words: float = BY_WORDS, by_postal: float = BY_POSTAL, bonus: float = POSTAL_BONUS) -> DataFrame:
    """(words, postal, town, cosine): the town of each distinct wording; near ties between towns and too low cosines leave no row.

    hub is gazetteer(towns) with a number y. Wordings that come nearer to one town than SURE are decided by that, whatever their
    postal code; for the others the search goes on down to by_words, and towns of the postal code are candidates as well.
    """
    asked = materialize(wordings.select("words", "postal").distinct())
    seen = materialize(asked.select("words").distinct().withColumn("x", F.monotonically_increasing_id()))
    of_hub = materialize(_vectors(hub, weights, "y").join(hub.select("y", "town", "postal"), "y"))
    after = lambda e: F.sqrt(F.greatest(F.lit(0.0), e["rest"] * e["rest"] - e["w"] * e["w"]))
    posted = of_hub.select("y", F.explode("v").alias("e")).select("y", "e.g", F.col("e.w").alias("hub_w"), after(F.col("e")).alias("after"))
    lists = posted.groupBy("g").agg(F.collect_list(F.struct("y", "hub_w", "after")).alias("ys"))
    lists = broadcast_if_small(materialize(lists), F.lit(32) + 24 * F.size("ys"))
    maps = broadcast_if_small(materialize(of_hub.select("y", "town", F.col("postal").alias("code"), _as_map(F.col("v")).alias("m"))), F.lit(100) + 24 * F.size("m"))
    mine = _vectors(seen, weights, "x").join(seen, "x")
    mine = materialize(mine)
    cosine = _dot(F.col("v"), F.col("m"))

    near = _candidates(mine, lists, SURE, PREFIX_SURE).join(maps, "y").join(mine.select("x", "v"), "x").select("x", "town", cosine.alias("cosine")).where(F.col("cosine") >= SURE)
    by_town = near.groupBy("x", "town").agg(F.max("cosine").alias("cosine")).groupBy("x").agg(F.max_by("town", "cosine").alias("town"), F.sort_array(F.collect_list("cosine"), asc=False).alias("cs"))
    # Whatever comes within MARGIN of these has been found as well.
    sure = by_town.where((F.col("cs")[0] >= SURE + MARGIN) & (F.coalesce(F.get("cs", F.lit(1)), F.lit(0.0)) <= F.col("cs")[0] - MARGIN))
    sure = materialize(sure.select("x", "town", F.col("cs")[0].alias("cosine")).join(seen, "x"))
    first = asked.join(sure, "words").select("words", "postal", "town", "cosine")

    hard = materialize(mine.join(sure.select("x"), "x", "left_anti"))
    near = materialize(_candidates(hard, lists, by_words, PREFIX_REST).join(maps, "y").join(hard.select("x", "v"), "x").select("x", "town", "code", cosine.alias("cosine")).where(F.col("cosine") >= by_words))
    pairs = materialize(asked.join(hard.select("x", "v", "words"), "words").withColumn("z", F.monotonically_increasing_id()))
    coded = (F.col("postal") == F.col("code")) & (F.col("postal") != "")
    by_grams = pairs.select("z", "x", "postal").join(near, "x").select("z", "town", "cosine", coded.alias("coded"))
    by_code = pairs.where("postal <> ''").join(maps, F.col("postal") == F.col("code")).select("z", "town", cosine.alias("cosine"), F.lit(True).alias("coded"))
    scored = by_grams.unionByName(by_code.where(F.col("cosine") >= by_postal))
    score = F.round(F.max(F.col("cosine") + F.when(F.col("coded"), bonus).otherwise(0.0)), 9)
    best = scored.groupBy("z", "town").agg(score.alias("score"), F.max("cosine").alias("cosine"))
    top = best.groupBy("z").agg(F.max(F.struct("score", "town", "cosine")).alias("top"), F.sort_array(F.collect_list("score"), asc=False).alias("ss"))
    clear = top.where(F.coalesce(F.get("ss", F.lit(1)), F.lit(0.0)) <= F.col("top.score") - MARGIN)
    return first.unionByName(clear.join(pairs, "z").select("words", "postal", "top.town", "top.cosine"))


def _alike(nodes: DataFrame, weights: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: nodes (x, words, n1, n2, n3) of equal numbers whose wordings reach the cosine `least`.

    The inverted index holds an n-gram of the prefix together with the numbers; a key of any number of nodes is split.
    """
    v = materialize(_vectors(nodes, weights, "x"))
    posted = v.select("x", F.explode(F.filter("v", lambda e: e["rest"] >= least - 1e-9)).alias("e")).select("x", "e.g").join(nodes.select("x", "n1", "n2", "n3"), "x")
    pairs = pairs_by_key(materialize(posted), ["n1", "n2", "n3", "g"], "x").distinct()
    right = v.select(F.col("x").alias("b"), _as_map(F.col("v")).alias("m"))
    return pairs.join(v.select(F.col("x").alias("a"), "v"), "a").join(right, "b").where(_dot(F.col("v"), F.col("m")) >= least).select("a", "b")


NUMBERS = ["n1", "n2", "n3"]


def located(df: DataFrame, towns: DataFrame, key: str = "id", address: str = "address") -> tuple[DataFrame, DataFrame]:
    """(rid, place, n1, n2, n3) of every address with three numbers, and (a, b), a < b, the places that are the same under two names.

    place is the town, or for a wording that no single town explains "?" and its words, whatever its postal code. Two such
    wordings with equal numbers are the same place if their cosine reaches BY_ADDRESS: a and b are (place, n1, n2, n3).
    """
    rows = materialize(parsed(df, key, address).where("words <> ''"))
    hub = materialize(gazetteer(towns).withColumn("y", F.monotonically_increasing_id()))
    texts = rows.select("words").unionByName(hub.select("words")).distinct()
    weights = gram_weights(texts)
    places = resolve(rows, towns, weights, hub)
    place = F.coalesce(F.col("town"), F.concat(F.lit("?"), "words"))
    rows = materialize(rows.join(places, ["words", "postal"], "left").select("rid", place.alias("place"), *NUMBERS).distinct())
    unknown = rows.where(F.startswith("place", F.lit("?"))).select("place", *NUMBERS).distinct()
    unknown = materialize(unknown.withColumn("words", F.expr("substr(place, 2)")).withColumn("x", F.monotonically_increasing_id()))
    at = lambda c: unknown.select(F.col("x").alias(c), F.struct("place", *NUMBERS).alias(f"{c}_place"))
    same = _alike(unknown, weights, BY_ADDRESS).join(at("a"), "a").join(at("b"), "b")
    return rows, materialize(same.select(F.least("a_place", "b_place").alias("a"), F.greatest("a_place", "b_place").alias("b")))


def _across(rows: DataFrame, same: DataFrame) -> DataFrame:
    """(rid of a, rid of b) for places that are the same under two names, each member of one with each of the other."""
    at = F.struct("place", *NUMBERS)
    left = rows.select(at.alias("a"), F.col("rid").alias("ra"))
    right = rows.select(at.alias("b"), F.col("rid").alias("rb"))
    return same.join(left, "a").join(right, "b").select("ra", "rb")


def same_place(df: DataFrame, towns: DataFrame, key: str = "id", address: str = "address") -> DataFrame:
    """(id_a, id_b): two different keys whose addresses name the same town and the same three numbers, the smaller key first.

    Null keys and addresses, and addresses without three numbers, take no part; repeated rows count once.
    """
    rows, same = located(df, towns, key, address)
    inside = pairs_by_key(rows, ["place", *NUMBERS], "rid").select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))
    across = _across(rows, same).where("ra <> rb").select(F.least("ra", "rb").alias("id_a"), F.greatest("ra", "rb").alias("id_b"))
    return inside.unionByName(across).distinct()


def places(df: DataFrame, towns: DataFrame, key: str = "id", address: str = "address") -> DataFrame:
    """(id, place, n1, n2, n3, members, links): each key's place as its class id, how many keys the place has, and with how many
    others the key is at the same place. It grows with the rows, not with the pairs; a key whose rows name several places has a row for each."""
    rows, same = located(df, towns, key, address)
    at = F.struct("place", *NUMBERS)
    sizes = materialize(rows.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("members")))
    other = same.select(F.col("a").alias("at"), F.col("b").alias("o")).unionByName(same.select(F.col("b").alias("at"), F.col("a").alias("o")))
    more = other.join(sizes.select(F.col("at").alias("o"), "members"), "o").groupBy("at").agg(F.sum("members").alias("more"))
    known = sizes.join(more, "at", "left")
    met = rows.withColumn("at", at).join(known, "at")
    return met.select(F.col("rid").alias("id"), "place", *NUMBERS, "members", (F.col("members") - 1 + F.coalesce("more", F.lit(0))).alias("links"))
