"""Approvals, image attachment, cascading deletes, integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions.columns import sealed

PATCHED_FIELDS = ["name", "address", "describe", "phone", "email", "open_time", "close_time"]


def decide_approvals(approvals: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply decisions (approval_id, decision, approver_id): (updated approvals, refused decisions).

    Only pending entries can be decided, by the first decision on them; approving needs a readable note.
    """
    first = decisions.groupBy("approval_id").agg(F.min("decision_id").alias("_first"))
    target = approvals.select(F.col("id").alias("approval_id"), F.col("status").alias("_status"), "note")
    target = first.join(target, "approval_id", "left")
    checked = decisions.join(target, "approval_id")
    readable = F.json_array_length("note").isNotNull() | F.json_object_keys("note").isNotNull()
    reason = (
        F.when(F.col("_status").isNull(), "unknown approval")
        .when((F.col("_status") != "pending") | (F.col("decision_id") > F.col("_first")), "already decided")
        .when((F.col("decision") == "approved") & ~readable, "unreadable note")
    )
    checked = checked.withColumn("reason", reason)
    applied = checked.where("reason is null").select(F.col("approval_id").alias("id"), "decision", "approver_id")
    updated = approvals.join(applied, "id", "left").withColumn("status", F.coalesce("decision", "status")).drop("decision")
    return updated, checked.where("reason is not null").select("decision_id", "approval_id", "decision", "reason")


def note_changes(approvals: DataFrame, when: str = "date_up") -> DataFrame:
    """What approved notes change, reduced to the newest value: (store_id, image_id, field, value, lat, lng, at, approval_id).

    One row per store and field: a patched field or ``category``, ``point`` (numeric latitude and longitude of one note) and ``activated`` (CREATE_NEW); and one per
    image that a note without CREATE_NEW names, ``published`` or ``deleted``. ``when`` is the time that decides which value is newest, the approval id breaks
    ties. Changes of several batches may be put together in any order and reduced again by ``newest_changes``.
    """
    parsed = approvals.where((F.col("status") == "approved") & F.json_object_keys("note").isNotNull())
    parsed = parsed.withColumn("_f", sealed(F.from_json("note", "map<string,string>")))

    def number(name: str) -> Column:
        return F.col("_f")[name].try_cast("double")

    def change(field: Column | str, value: Column | None = None, image: Column | None = None, point: bool = False) -> Column:
        return F.struct(
            (F.lit(None).cast("bigint") if image is None else image).alias("image_id"), (F.lit(field) if isinstance(field, str) else field).alias("field"),
            (F.lit(None).cast("string") if value is None else value).alias("value"),
            *[(number(n) if point else F.lit(None).cast("double")).alias(c) for c, n in (("lat", "latitude"), ("lng", "longitude"))],
        )

    none = F.array().cast("array<struct<image_id:bigint,field:string,value:string,lat:double,lng:double>>")
    creates = F.coalesce(F.col("_f")["action"] == "CREATE_NEW", F.lit(False))
    named = F.filter(F.map_entries("_f"), lambda e: e["key"].isin([*PATCHED_FIELDS, "category"]))
    changes = [
        F.transform(named, lambda e: change(e["key"], e["value"])),
        F.when(number("latitude").isNotNull() & number("longitude").isNotNull(), F.array(change("point", point=True))),
        F.when(creates, F.array(change("activated"))),
    ]

    def named_images(name: str, field: str) -> Column:
        ids = F.filter(F.from_json(F.col("_f")[name], "array<bigint>"), lambda i: i.isNotNull())
        return F.when(~creates, F.transform(ids, lambda i: change(field, image=i)))

    changes += [named_images("new_images", "published"), named_images("deleted_images", "deleted")]
    every = F.flatten(F.array(*[F.coalesce(c, none) for c in changes]))
    rows = parsed.select("store_id", F.col(when).alias("at"), F.col("id").alias("approval_id"), F.inline(every))
    rows = rows.withColumn("store_id", F.when(F.col("image_id").isNull(), F.col("store_id")))
    return newest_changes(rows)


def newest_changes(changes: DataFrame) -> DataFrame:
    """The newest change per store, image and field, with a partial step before the shuffle."""
    newest = F.max_by(F.struct("value", "lat", "lng", "at", "approval_id"), F.struct("at", "approval_id"))
    return changes.groupBy("store_id", "image_id", "field").agg(newest.alias("_c")).select("store_id", "image_id", "field", "_c.*")


def merge_store_changes(stores: DataFrame, changes: DataFrame) -> DataFrame:
    """Stores after changes: the newest note that names a field sets it, null included; a readable category id and a whole position are applied."""
    fields = [*PATCHED_FIELDS, "category", "point", "activated"]
    order = F.struct("at", "approval_id")
    values = F.struct("value", "lat", "lng")
    newest = [F.max_by(values, F.when(F.col("field") == f, order)).alias(f"_p_{f}") for f in fields]
    patches = changes.where("image_id is null and store_id is not null").groupBy(F.col("store_id").alias("_store")).agg(*newest)
    merged = stores.join(patches, stores["id"] == patches["_store"], "left")
    patch = {f: F.when(F.col(f"_p_{f}").isNotNull(), F.col(f"_p_{f}.value")).otherwise(F.col(f)) for f in PATCHED_FIELDS if f in stores.columns}
    patch |= {n: F.coalesce(F.col(f"_p_point.{n}"), F.col(n)) for n in ("lat", "lng")}
    activated = F.col("_p_activated").isNotNull()
    patch["state"] = F.when(activated, "active").otherwise(F.col("state"))
    if "is_active" in stores.columns:
        patch["is_active"] = activated | F.col("is_active")
    if "category_id" in stores.columns:
        patch["category_id"] = F.coalesce(F.col("_p_category.value").try_cast("bigint"), F.col("category_id"))
    return merged.select(*[patch.get(c, F.col(c)).alias(c) for c in stores.columns])


def merge_image_changes(images: DataFrame, changes: DataFrame) -> DataFrame:
    """Images after changes: deleted ones are gone, published ones and all of an activated store are public."""
    of_images = changes.where("image_id is not null").select(F.col("image_id").alias("id"), "field").distinct()
    deleted = of_images.where("field = 'deleted'").select("id")
    published = of_images.where("field = 'published'").select("id", F.lit(True).alias("_published"))
    created = changes.where("field = 'activated'").select("store_id", F.lit(True).alias("_created")).distinct()
    kept = images.join(deleted, "id", "left_anti").join(published, "id", "left").join(created, "store_id", "left")
    public = F.coalesce("_created", "_published", F.lit(False))
    state = F.when(public, "public").otherwise(F.col("state"))
    return kept.select(*[(state if c == "state" else F.col(c)).alias(c) for c in images.columns])


def patch_stores(stores: DataFrame, approvals: DataFrame, when: str = "date_up") -> DataFrame:
    """Stores after all approved notes.

    The latest note that names a field sets it, null included. A position needs numeric latitude and longitude in the same note.
    CREATE_NEW activates the store. A category id in a note is applied.
    """
    return merge_store_changes(stores, note_changes(approvals, when))


def patch_images(images: DataFrame, approvals: DataFrame) -> DataFrame:
    """Images after all approved notes: CREATE_NEW publishes every image of its store, other notes publish
    ``new_images`` and delete ``deleted_images``."""
    return merge_image_changes(images, note_changes(approvals))


def apply_approvals(stores: DataFrame, images: DataFrame, approvals: DataFrame) -> tuple[DataFrame, DataFrame]:
    return patch_stores(stores, approvals), patch_images(images, approvals)


def attach_images(images: DataFrame, requests: DataFrame) -> DataFrame:
    """Attach images to stores: requests (request_id, store_id, image_ids 'a, b', describe, state); entries
    that are no digits are ignored; the latest request wins for an image."""
    ids = F.filter(F.transform(F.split("image_ids", ","), lambda x: F.trim(x)), lambda x: x.rlike("^[0-9]+$"))
    rows = requests.select("request_id", "store_id", "describe", "state", F.explode(ids).alias("_id")).withColumn(
        "id", F.expr("try_cast(_id as bigint)")
    )
    latest = rows.groupBy("id").agg(
        F.max_by(F.struct("store_id", "describe", "state"), "request_id").alias("_r")
    )
    joined = images.join(latest, "id", "left")
    new = {c: F.when(F.col("_r").isNotNull(), F.col(f"_r.{c}")).otherwise(F.col(c)) for c in ("store_id", "describe", "state")}
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in images.columns])


def delete_stores(tables: dict[str, DataFrame], store_ids: DataFrame) -> dict[str, DataFrame]:
    """Delete stores (``id``) and everything that hangs on them: keys ``stores`` and tables with ``store_id``."""
    gone = store_ids.select("id").distinct()
    by_store = gone.select(F.col("id").alias("store_id"))
    return {
        name: df.join(gone, "id", "left_anti") if name == "stores" else df.join(by_store, "store_id", "left_anti")
        for name, df in tables.items()
    }


def delete_categories(stores: DataFrame, category_ids: DataFrame) -> DataFrame:
    """Ids of the stores that go with their category, for ``delete_stores``."""
    return stores.join(category_ids.select(F.col("id").alias("category_id")).distinct(), "category_id", "left_semi").select("id")


def forget_users(df: DataFrame, user_ids: DataFrame, columns: list[str]) -> DataFrame:
    """References to deleted users become null."""
    gone = user_ids.select("id").distinct()
    for column in columns:
        marked = gone.select(F.col("id").alias(column), F.lit(True).alias("_gone"))
        order = df.columns
        df = df.join(marked, column, "left").withColumn(column, F.when(F.col("_gone").isNull(), F.col(column)))
        df = df.select(*order)
    return df


def _split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.where("reason is null").drop("reason"), checked.where("reason is not null")


def check_reviews(reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with reason): ratings are 1 to 5."""
    bad = F.col("rating").isNull() | ~F.col("rating").between(1, 5)
    return _split(reviews.withColumn("reason", F.when(bad, "rating must be 1 to 5")))


def check_unique(df: DataFrame, keys: list[str], order: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """(first row per key, later ones with reason). A row with a null in its key equals no other one and is valid.

    The first is found by an aggregate and looked up by key, so a frequent key is no long sorted group.
    """
    first = df.groupBy(*keys).agg(F.min(order).alias("_first"))
    checked = df.join(first, keys, "left").withColumn("reason", F.when(F.col(order) > F.col("_first"), reason)).drop("_first")
    return _split(checked)


def check_favorites(favorites: DataFrame) -> tuple[DataFrame, DataFrame]:
    return check_unique(favorites, ["user_id", "store_id"], "id", "already a favourite")


def check_categories(categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    return check_unique(categories, ["slug"], "id", "slug is taken")
