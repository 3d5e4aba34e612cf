"""Knowledge graph of stores as node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions.address import parse_address_kg, parse_address_nine_districts
from placewise.functions.formats import store_code
from placewise.functions.text import make_id

NODE_TYPES = [
    "Store", "Brand", "Category", "Address", "Street", "Ward", "District", "City", "Location", "Phone", "Service",
]


def _node_id(kind: str, label: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), make_id(label))


def build_kg(stores: DataFrame, variant: str = "ward") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the stores (id, name, category_name, address, phone, lat, lng, describe).

    ``ward`` links Address to Street and Ward, Ward to District; services come from an optional ``services``
    array. ``district`` has no wards, splits ``describe`` into services and pads store codes to 3 digits.
    A node id written by several stores keeps the label of the largest store id, as does an edge.
    """
    wards = variant == "ward"
    c = F.col
    parse = parse_address_kg if wards else parse_address_nine_districts
    parsed = parse(stores, "address", "_a")
    phone = F.nullif(F.coalesce(c("phone"), F.lit("")), F.lit("")) if wards else F.nullif(F.trim("phone"), F.lit(""))
    if wards:
        services = c("services") if "services" in stores.columns else F.array().cast("array<string>")
        located = c("lat").isNotNull() & c("lng").isNotNull()
    else:
        parts = F.transform(F.split(F.coalesce("describe", F.lit("")), ","), lambda s: F.trim(s))
        services = F.filter(parts, lambda s: s != "")
        located = F.lit(True)
    lat, lng = (F.coalesce(c(n), F.lit(0.0)).cast("string") for n in ("lat", "lng"))
    labels = parsed.select(
        c("id").alias("seq"),
        F.struct(F.concat(F.lit("Store:"), store_code(c("id"), 0 if wards else 3)).alias("node"), store_code(c("id"), 0 if wards else 3).alias("label")).alias("Store"),
        *[
            F.when(F.coalesce(label, F.lit("")) != "", F.struct(_node_id(kind, label).alias("node"), label.alias("label"))).alias(kind)
            for kind, label in {
                "Brand": c("name"), "Category": c("category_name"), "Address": c("address"), "Phone": phone,
                "Street": c("_a.street"), "District": c("_a.district"), "City": c("_a.city"),
                **({"Ward": c("_a.ward")} if wards else {}),
            }.items()
        ],
        F.when(located, F.struct(F.concat(F.lit("Location:"), lat, F.lit("_"), lng).alias("node"), F.concat(lat, F.lit(", "), lng).alias("label"))).alias("Location"),
        F.transform(services, lambda s: F.struct(_node_id("Service", s).alias("node"), s.alias("label"))).alias("Service"),
    )
    single = [k for k in NODE_TYPES if k in labels.columns and k != "Service"]

    def node(kind: str, value: Column) -> Column:
        return F.struct(value["node"].alias("node_id"), value["label"].alias("label"), F.lit(kind).alias("node_type"))

    all_nodes = F.concat(
        F.array(*[F.when(c(k).isNotNull(), node(k, c(k))) for k in single]),
        F.transform("Service", lambda s: node("Service", s)),
    )
    nodes = labels.select("seq", F.explode(F.filter(all_nodes, lambda x: x.isNotNull())).alias("n")).select("seq", "n.*")
    nodes = nodes.groupBy("node_id").agg(F.max_by(F.struct("label", "node_type"), "seq").alias("n")).select(
        "node_id", "n.label", F.concat("n.node_type", F.lit(": "), "n.label").alias("title"), "n.node_type"
    )

    def edge(src: str, dst: str, relation: str, unless: str | None = None) -> Column:
        there = c(src).isNotNull() & c(dst).isNotNull()
        if unless:
            there = there & c(unless).isNull()
        return F.when(there, F.struct(c(f"{src}.node").alias("src"), c(f"{dst}.node").alias("dst"), F.lit(relation).alias("relation")))

    rules = [
        edge("Store", "Brand", "HAS_BRAND"), edge("Store", "Category", "BELONGS_TO"), edge("Store", "Address", "LOCATED_AT"),
        edge("Store", "Phone", "HAS_PHONE"), edge("Store", "Location", "HAS_GEO"), edge("Address", "Street", "ON_STREET"),
        edge("District", "City", "IN_CITY"), edge("Address", "City", "IN_CITY", unless="District"),
    ]
    if wards:
        rules = rules[:-1] + [
            edge("Address", "Ward", "IN_WARD"), edge("Street", "Ward", "IN_WARD"), edge("Ward", "District", "IN_DISTRICT"),
            edge("Address", "District", "IN_DISTRICT", unless="Ward"),
        ]
    else:
        rules.append(edge("Address", "District", "IN_DISTRICT"))
    provides = F.transform(
        "Service", lambda s: F.struct(c("Store.node").alias("src"), s["node"].alias("dst"), F.lit("PROVIDES").alias("relation"))
    )
    all_edges = F.filter(F.concat(F.array(*rules), provides), lambda x: x.isNotNull())
    edges = labels.select("seq", F.explode(all_edges).alias("e")).select("seq", "e.*")
    edges = edges.groupBy("src", "dst").agg(F.max_by("relation", "seq").alias("relation"))
    return nodes, edges


def _kind(node: str) -> Column:
    return F.substring_index(node, ":", 1)


def filter_kg(
    nodes: DataFrame, edges: DataFrame, district: str = "", ward: str = "", street: str = "", types: list[str] | None = None
) -> DataFrame:
    """Nodes that stay visible under a selection.

    A node has the district, ward and street of its neighbours, directly or through an Address, then by
    street -> ward -> district. Several candidates: the greatest label. Attributes are aggregated per
    Address first, so a node with many neighbours never meets their neighbours one by one.
    """
    wanted = nodes.where(F.col("node_type").isin(types or NODE_TYPES))
    if not (district or ward or street):
        return wanted
    places = nodes.where(F.col("node_type").isin("District", "Ward", "Street")).select("node_id", "label")
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

    def maps(frm: str, to: str) -> DataFrame:
        pairs = edges.where((_kind("src") == frm) & (_kind("dst") == to))
        named = pairs.join(places.select(F.col("node_id").alias("src"), F.col("label").alias("_from")), "src").join(
            places.select(F.col("node_id").alias("dst"), F.col("label").alias("_to")), "dst"
        )
        return named.groupBy("_from").agg(F.max("_to").alias("_to"))

    street_ward, ward_district = maps("Street", "Ward"), maps("Ward", "District")

    def attributes(pairs: DataFrame) -> DataFrame:
        """Greatest label per neighbour type."""
        named = pairs.join(places.select(F.col("node_id").alias("dst"), "label"), "dst")
        return named.groupBy("src").agg(*[
            F.max(F.when(_kind("dst") == k, F.col("label"))).alias(k.lower()) for k in ("District", "Ward", "Street")
        ])

    direct = attributes(both.where(_kind("dst").isin("District", "Ward", "Street")))
    by_address = direct.where(_kind("src") == "Address").withColumnRenamed("src", "dst")
    through = both.where(_kind("dst") == "Address").join(by_address, "dst").drop("dst")
    found = direct.unionByName(through).groupBy(F.col("src").alias("node_id")).agg(
        *[F.max(k).alias(k) for k in ("district", "ward", "street")]
    )
    df = wanted.join(found, "node_id", "left")
    kind = F.col("node_type")
    own = {k: F.when(kind == k.capitalize(), F.col("label")).otherwise(F.col(k)) for k in ("district", "ward", "street")}
    df = df.withColumns(own)
    df = df.join(street_ward.select(F.col("_from").alias("street"), F.col("_to").alias("_ward_of")), "street", "left")
    # Ward and street nodes take these maps only; other nodes use them as a fallback.
    df = df.withColumn("ward", F.when(kind == "Street", F.col("_ward_of")).otherwise(F.coalesce("ward", "_ward_of")))
    df = df.join(ward_district.select(F.col("_from").alias("ward"), F.col("_to").alias("_district_of")), "ward", "left")
    df = df.withColumn(
        "district", F.when(kind.isin("Street", "Ward"), F.col("_district_of")).otherwise(F.coalesce("district", "_district_of"))
    )
    match = F.lit(True)
    if district:
        unknown_ok = (kind == "Street") & F.col("ward").isNull()
        match = match & (F.coalesce(F.col("district") == district, F.lit(False)) | unknown_ok)
    elif ward or street:
        match = match & (kind != "District")
    if ward:
        match = match & ((kind == "District") | F.coalesce(F.col("ward") == ward, F.lit(False)))
    if street:
        match = match & (kind.isin("District", "Ward") | F.coalesce(F.col("street") == street, F.lit(False)))
    return df.where(match).select("node_id", "label", "title", "node_type")
