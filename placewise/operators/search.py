"""Filters, search, facets, map display."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewise.functions.address import parse_address_facet
from placewise.functions.contact import is_phone_or_address
from placewise.functions.geo import haversine_km
from placewise.operators.nearest import cell_columns, nearest_cells, unit_sphere
from placewise.operators.substring import contains_join
from placewise.tables import materialize

# --- Fixed values -------------------------------------------------------------------------------------------
FILLER_PHRASES = ["gần đây", "gan day", "ở đâu"]
CATEGORY_SYNONYMS = {
    "Ẩm thực": ["quán ăn", "tiệm ăn", "nhà hàng", "cơm", "phở", "bún", "hủ tiếu", "đồ ăn", "ẩm thực", "ăn uống", "lẩu", "nướng", "quán nhậu"],
    "Đồ uống": ["cafe", "cà phê", "quán nước", "trà sữa", "đồ uống", "giải khát", "sinh tố", "tiệm nước", "bar", "pub"],
    "Xe Cộ & Phương Tiện": ["xăng", "đổ xăng", "cây xăng", "trạm xăng", "sửa xe", "rửa xe", "xe máy", "ô tô", "phụ tùng", "gara"],
    "Lưu Trú": ["khách sạn", "nhà nghỉ", "hotel", "motel", "homestay", "resort", "nghỉ ngơi", "chú trọ", "chỗ ngủ"],
    "Y Tế & Sức Khỏe": ["bệnh viện", "nha khoa", "phòng khám", "nhà thuốc", "tiệm thuốc", "y tế", "trạm y tế", "cấp cứu"],
    "Siêu Thị & Tạp Hóa": ["siêu thị", "tạp hóa", "tiện lợi", "minimart", "cửa hàng", "bách hóa", "vinmart", "coop"],
    "Làm Đẹp & Spa": ["spa", "thẩm mỹ", "hớt tóc", "cắt tóc", "nail", "salon", "massage", "gội đầu"],
    "Giáo Dục": ["trường", "đại học", "cao đẳng", "trung học", "tiểu học", "mầm non", "trung tâm", "ngoại ngữ", "giáo dục"],
    "Tôn Giáo": ["chùa", "nhà thờ", "đền", "miếu", "thánh thất", "tôn giáo"],
    "Công Nghệ & Điện Máy": ["điện máy", "điện thoại", "máy tính", "laptop", "phụ kiện", "công nghệ", "sửa điện thoại"],
    "Hành Chính & Công Cộng": ["ủy ban", "công an", "trụ sở", "bưu điện", "nhà nước", "phường", "quận"],
    "Tài Chính & Doanh Nghiệp": ["ngân hàng", "atm", "tín dụng", "cầm đồ", "tài chính", "bank"],
}
MAP_LEVELS = {
    1: ["y tế", "giáo dục", "vận tải", "ẩm thực", "nhà hàng", "quán"],
    2: ["siêu thị", "hành chính", "tài chính", "đồ uống", "lưu trú", "cafe"],
    3: ["mua sắm", "công nghệ", "xe cộ", "giải trí"],
}
TOP_PRIORITY = 99999999
SUGGESTIONS = 10
PAGE_SIZE = 10
# ------------------------------------------------------------------------------------------------------------
VIETNAMESE = "vi"  # collation of values shown in lists
_SEARCH_ROUNDS = 5  # cells of 1 / 8 ** 5 of the sphere's box, about 400 m


def order_by(df: DataFrame, key: str, desc: bool = False, tie: str = "id") -> DataFrame:
    """Total order by a column; the id decides ties."""
    return df.orderBy(F.col(key).desc() if desc else F.col(key).asc(), F.col(tie))


def visible_stores(stores: DataFrame, is_staff: bool) -> DataFrame:
    """Staff see every store, others the active ones; best rated first."""
    shown = stores if is_staff else stores.where(F.col("state") == "active")
    return order_by(shown, "rating_avg", desc=True)


def in_bbox(df: DataFrame, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Rows whose point lies in (min lng, min lat, max lng, max lat)."""
    return df.where(F.col("lng").between(bbox[0], bbox[2]) & F.col("lat").between(bbox[1], bbox[3]))


def filter_by(df: DataFrame, **equals) -> DataFrame:
    """Exact filters; a None value is no filter."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), [kv for kv in equals.items() if kv[1] is not None], df)


def search(df: DataFrame, terms: str, fields: list[str]) -> DataFrame:
    """Rows where every blank-separated term is a case-insensitive substring of at least one field."""
    for term in terms.split():
        hits = [F.coalesce(F.contains(F.lower(f), F.lit(term.lower())), F.lit(False)) for f in fields]
        df = df.where(reduce(lambda a, b: a | b, hits))
    return df


def order_page(
    df: DataFrame, key: str, allowed: list[str], page: int = 1, size: int = PAGE_SIZE, desc: bool = False, after: tuple | None = None,
) -> DataFrame:
    """One page of a whitelisted order; rows with a null key stand first, or last if ``desc``.

    ``after`` is (key, id) of the last row seen, its key may be null; a task then keeps one page, however deep it is. ``page`` counts from the start and keeps all
    rows up to the page. Both give the same pages.
    """
    if key not in allowed:
        raise ValueError(f"cannot order by {key}")
    if after is None:
        return order_by(df, key, desc).offset((page - 1) * size).limit(size)
    value, last = after
    tied = F.col(key).eqNullSafe(F.lit(value)) & (F.col("id") > F.lit(last))
    if value is None:
        beyond = F.lit(False) if desc else F.col(key).isNotNull()
    else:
        beyond = F.col(key).isNull() | (F.col(key) < F.lit(value)) if desc else F.col(key) > F.lit(value)
    return order_by(df.where(beyond | tied), key, desc).limit(size)


def search_word(keyword: Column) -> Column:
    """Lower-cased keyword without the first occurrence of each filler phrase."""
    word = F.lower(keyword)
    for phrase in FILLER_PHRASES:
        word = F.regexp_replace(word, f"(?s)^(.*?){phrase}(.*)$", "$1$2")
    return F.trim(word)


def implied_categories(word: Column) -> Column:
    """Lower-cased category names whose synonyms occur in the word."""
    found = [
        F.when(reduce(lambda a, b: a | b, [F.contains(word, F.lit(s)) for s in synonyms]), F.lit(name.lower()))
        for name, synonyms in CATEGORY_SYNONYMS.items()
    ]
    return F.filter(F.array(*found), lambda c: c.isNotNull())


def _matches(word: Column, text: Column, category: Column) -> Column:
    """Does the word occur in the text, imply the category, or is it empty?"""
    implied = F.coalesce(F.array_contains(implied_categories(word), category), F.lit(False))
    return (word == "") | F.coalesce(F.contains(text, word), F.lit(False)) | implied


def _word_hits(words: DataFrame, texts: DataFrame) -> DataFrame:
    """Every pair of a non-empty word and a matching row of ``texts``, once; to be aggregated or limited, not written."""
    direct = contains_join(words, texts, "word", "_text")
    implied = words.select("word", F.explode(implied_categories(F.col("word"))).alias("_category"))
    others = implied.join(texts, "_category").where(~F.coalesce(F.contains("_text", "word"), F.lit(False)))
    return direct.unionByName(others)


def smart_search(stores: DataFrame, queries: DataFrame, k: int = SUGGESTIONS) -> DataFrame:
    """First ``k`` stores per query (query_id, keyword, lng, lat): nearest first, or by id without a location.

    ``stores`` needs id, name, address, category_name, lng, lat. Equal words and equal (word, location) pairs are answered once.

    Pairs of words and stores are never written. With a location, they are only counted by word and cell (about 400 m); the counts name the few cells that can hold
    a search's ``k`` nearest stores, and only the stores of those cells are fetched and matched again. Without a location, every task
    keeps the first ``k`` ids of a word before the shuffle. The empty word takes its counts from the stores alone.
    """
    asked = queries.where(F.trim("keyword") != "").withColumn("word", search_word(F.col("keyword")))
    placeless = asked.where("lng is null or lat is null").select("query_id", "word")
    placed = asked.where("lng is not null and lat is not null").select("query_id", "word", "lng", "lat")
    axes, low, span = ["x", "y", "z"], -1.0, 2.0
    cells = [f"_c{i}" for i in range(len(axes))]
    texts = stores.select(
        "id", F.lower("category_name").alias("_category"),
        F.concat_ws("\x01", F.lower("name"), F.lower("address"), F.lower("category_name")).alias("_text"),
        F.col("lng").alias("s_lng"), F.col("lat").alias("s_lat"),
    )

    first_words = placeless.select("word").distinct()
    # The empty word matches everything; its lookup side is a single row.
    empty = F.broadcast(first_words.where("word = ''").limit(1))
    hits = _word_hits(first_words, texts.select("id", "_category", "_text")).select("word", "id")
    hits = hits.unionByName(texts.select("id", F.lit("").alias("word")).join(empty, "word").select("word", "id"))
    first = hits.withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy("id"))).where(F.col("rank") <= k)
    unplaced = placeless.join(first, "word").select("query_id", F.col("id").alias("store_id"), F.lit(None).cast("double").alias("km"), "rank")

    spots = materialize(placed.groupBy("word", "lng", "lat").agg(F.min("query_id").alias("spot")))
    near_words = spots.select("word").distinct()
    located = texts.where("s_lng is not null and s_lat is not null").withColumns(unit_sphere(F.col("s_lng"), F.col("s_lat")))
    located = materialize(located.withColumns(cell_columns(axes, low, span, _SEARCH_ROUNDS)).drop(*axes))
    counted = _word_hits(near_words, located.drop("id", "s_lng", "s_lat")).groupBy("word", *cells).agg(F.count("*").alias("_n"))
    everywhere = located.groupBy(*cells).agg(F.count("*").alias("_n")).withColumn("word", F.lit(""))
    everywhere = everywhere.join(F.broadcast(near_words.where("word = ''").limit(1)), "word")
    chosen = materialize(nearest_cells(
        spots.withColumns(unit_sphere(F.col("lng"), F.col("lat"))), counted.unionByName(everywhere),
        "spot", axes, low, span, k, key=["word"], rounds=_SEARCH_ROUNDS,
    ))
    found = chosen.select("word", *cells).distinct().join(located, cells)
    found = found.where(_matches(F.col("word"), F.col("_text"), F.col("_category"))).drop("_text", "_category")
    # Of the stores on one point only the k first can be among the k nearest.
    found = found.withColumn(
        "_same", F.row_number().over(Window.partitionBy("word", *cells, "s_lng", "s_lat").orderBy("id"))
    ).where(F.col("_same") <= k).drop("_same")
    ranked = chosen.join(found, ["word", *cells]).drop("word").join(spots, "spot")
    ranked = ranked.withColumn("km", haversine_km(F.col("lng"), F.col("lat"), F.col("s_lng"), F.col("s_lat")))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("spot").orderBy("km", "id"))).where(F.col("rank") <= k)
    answers = placed.join(ranked.select("word", "lng", "lat", F.col("id").alias("store_id"), "km", "rank"), ["word", "lng", "lat"])
    return unplaced.unionByName(answers.select("query_id", "store_id", "km", "rank"))


def address_facets(stores: DataFrame, district: str | None = None, ward: str | None = None) -> DataFrame:
    """(facet, value, position): districts of all stores, wards under the district, streets under the ward.

    Within a facet values stand in Vietnamese alphabetical order (d before đ, o before ô before ơ, tones after letters); ``position`` counts them from 1. Only the
    distinct values of a facet are ranked.
    """
    parsed = parse_address_facet(stores.select("address"), "address", "a")
    in_district = F.lit(True) if not district else F.col("a.district") == district
    in_ward = in_district if not ward else in_district & (F.col("a.ward") == ward)
    facets = F.array(
        F.struct(F.lit("district").alias("facet"), F.col("a.district").alias("value")),
        F.struct(F.lit("ward").alias("facet"), F.when(in_district, F.col("a.ward")).alias("value")),
        F.struct(F.lit("street").alias("facet"), F.when(in_ward, F.col("a.street_name")).alias("value")),
    )
    values = parsed.select(F.inline(facets)).where("value is not null and value <> ''").distinct()
    alphabet = Window.partitionBy("facet").orderBy(F.collate("value", VIETNAMESE), "value")
    return values.withColumn("position", F.row_number().over(alphabet)).orderBy("facet", "position")


def favorite_flag(stores: DataFrame, favorites: DataFrame, user_id: int) -> DataFrame:
    """Add ``is_favorite``: has the user marked the store?"""
    mine = favorites.where(F.col("user_id") == user_id).select(F.col("store_id").alias("id"), F.lit(True).alias("_mine")).distinct()
    return stores.join(mine, "id", "left").withColumn("is_favorite", F.coalesce("_mine", F.lit(False))).drop("_mine")


def display_filter(
    stores: DataFrame, favorites: DataFrame, user_id: int | None = None, district: str | None = None,
    ward: str | None = None, street: str | None = None, categories: list[int] = (), favorites_only: bool = False,
) -> DataFrame:
    """Stores shown under an address selection, a category set and the favourites switch.

    Switch alone: favourites. Switch and categories: both must hold. Neither: everything.
    """
    shown = parse_address_facet(stores, "address", "_a")
    if district:
        shown = shown.where(F.col("_a.district") == district)
    if ward:
        shown = shown.where(F.col("_a.ward") == ward)
    if street:
        named = F.col("_a.street_name") == street
        shown = shown.where(named | F.contains(F.lower("_a.street"), F.lit(street.lower())))
    shown = shown.drop("_a")
    if categories:
        shown = shown.where(F.col("category_id").isin(list(categories)))
    if favorites_only:
        mine = favorites.where(F.col("user_id") == F.lit(user_id)).select(F.col("store_id").alias("id"))
        shown = shown.join(mine, "id", "left_semi")
    return shown


def public_images(images: DataFrame) -> DataFrame:
    """(store_id, position, id, image, describe) of every public image; positions count from 0 by image id."""
    public = images.where(F.col("state") == "public").select("store_id", "id", "image", "describe")
    order = Window.partitionBy("store_id").orderBy("id", "image")
    return public.select("store_id", (F.row_number().over(order) - 1).alias("position"), "id", "image", "describe")


def with_public_images(stores: DataFrame, images: DataFrame) -> DataFrame:
    """One row per store, its public images nested as an array ordered by image id; for stores with very many images use ``public_images``."""
    public = images.where(F.col("state") == "public")
    nested = public.groupBy(F.col("store_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("id").alias("id"), "image", "describe"))).alias("images")
    )
    empty = F.array().cast("array<struct<id:bigint,image:string,describe:string>>")
    return stores.join(nested, "id", "left").withColumn("images", F.coalesce("images", empty))


def pending(approvals: DataFrame) -> DataFrame:
    """Approval queue: pending entries, newest first."""
    return order_by(approvals.where(F.col("status") == "pending"), "date_up", desc=True)


def for_user(df: DataFrame, users: DataFrame, newest: str) -> DataFrame:
    """Rows of active users only, per user by ``newest`` descending."""
    active = users.where("is_active").select(F.col("id").alias("user_id"))
    return df.join(active, "user_id", "left_semi").orderBy("user_id", F.col(newest).desc(), F.col("id").desc())


def name_suggestions(other: Column, raw_texts: Column, phones: Column, addresses: Column) -> Column:
    """Distinct non-empty texts that are no known or apparent phone or address."""
    texts = F.array_distinct(F.filter(F.concat(other, raw_texts), lambda t: t.isNotNull() & (t != "")))
    known = F.coalesce(F.concat(phones, addresses), F.array().cast("array<string>"))
    return F.filter(texts, lambda t: ~F.array_contains(known, t) & ~is_phone_or_address(t))


def prefill(existing: Column, *proposals: Column) -> Column:
    """Keep a non-blank form value, else the first non-empty proposal, else the old value."""
    kept = F.when(F.trim(existing) != "", existing)
    return F.coalesce(kept, *[F.nullif(p, F.lit("")) for p in proposals], existing)


def category_representatives(stores: DataFrame) -> DataFrame:
    """One store per category: greatest ``id * 17 % 13``, the earliest (smallest ``seq``) on ties."""
    best = F.max_by("id", F.struct((F.col("id") * 17) % 13, -F.col("seq")))
    return stores.groupBy("category_id").agg(best.alias("store_id"))


def map_tiers(
    stores: DataFrame, zoom: float, selected: list[int] = (), hovered: list[int] = (), route_points: list[tuple[float, float]] = (), filtered: bool = False,
) -> DataFrame:
    """Visible stores at a zoom with their level and drawing priority.

    ``stores`` needs id, seq, category_id, category_name, rating_avg, rating_count, and lng, lat where route points are given. A selected or
    hovered store and one on a route point are always shown, with the top priority; with an active filter nothing is hidden.
    """
    low = F.lower(F.coalesce("category_name", F.lit("")))
    level = F.lit(4)
    for number, words in sorted(MAP_LEVELS.items(), reverse=True):
        level = F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]), number).otherwise(level)
    chosen = category_representatives(stores).select("category_id", F.col("store_id").alias("_chosen"))
    tiered = stores.join(chosen, "category_id", "left").withColumns({
        "level": level,
        "high_quality": (F.coalesce("rating_avg", F.lit(0.0)) >= 3.5) & (F.coalesce("rating_count", F.lit(0)) >= 1),
        "representative": F.col("id") == F.col("_chosen"),
    }).drop("_chosen")
    prominent = F.col("high_quality") | F.col("representative")
    base = F.when(prominent, F.lit(100)).otherwise(F.lit(50)) - F.col("level") * 10
    focus = [F.col("id").isin([*selected, *hovered])] if selected or hovered else []
    focus += [(F.col("lng") == lng) & (F.col("lat") == lat) for lng, lat in route_points]
    in_focus = reduce(lambda a, b: a | b, focus, F.lit(False))
    tiered = tiered.withColumn("priority", F.when(in_focus, F.lit(TOP_PRIORITY)).otherwise(base.cast("long") * 100000 + F.col("id")))
    if filtered:
        return tiered
    shown = F.col("level") <= (1 if zoom < 12 else 3 if zoom < 14 else 4)
    if zoom < 13:
        shown = shown & prominent
    return tiered.where(shown | in_focus)
