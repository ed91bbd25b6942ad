"""Inclusion, taxonomy, salience, importance and terrain classes of tagged elements, as column expressions.

The taxonomy is one ordered CASE; each rule is a condition and the two parts of its category.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.geo import c
from ..functions.text import blank_to_null, empty_to_null, klass, resolve_name, subclass

# Fixed values of the tag vocabulary.
DROPPED_AMENITY = ("parking", "parking_space", "parking_entrance", "bench", "bicycle_parking", "waste_basket", "post_box", "drinking_water", "recycling", "toilets", "vending_machine", "bicycle_repair_station", "fountain", "clock", "hunting_stand")
DROPPED_NATURAL = ("tree", "tree_row", "scrub", "wood", "stone", "shrub", "grassland")
FOOD_AMENITY = ("restaurant", "cafe", "bar", "pub", "fast_food", "biergarten", "food_court", "ice_cream")
CIVIC_AMENITY = ("school", "library", "post_office", "townhall", "community_centre", "college", "university", "kindergarten", "police", "fire_station", "courthouse", "dentist", "clinic", "pharmacy", "hospital", "doctors", "veterinary", "social_facility")
LEISURE = ("marina", "fitness_centre", "sports_centre", "swimming_pool", "playground", "pitch", "slipway", "track", "dog_park", "garden", "golf_course", "stadium", "ice_rink")
LEISURE_AMENITY = ("theatre", "cinema", "arts_centre", "events_venue", "nightclub", "boat_rental", "spa", "makerspace", "studio", "coworking_space")
SHOP_AMENITY = ("bank", "fuel", "marketplace", "car_wash", "car_rental")
LODGING_TOURISM = ("hotel", "hostel", "guest_house", "motel", "chalet", "apartment")
LANDMARK_TOURISM = ("artwork", "viewpoint", "attraction", "museum", "gallery", "monument")
WORSHIP_BUILDING = ("church", "cathedral", "chapel", "mosque", "synagogue", "temple")
RESIDENTIAL_BUILDING = ("house", "apartments", "houseboat", "floating_home", "detached", "semidetached_house", "residential", "terrace", "bungalow", "static_caravan")
INSTITUTION_BUILDING = ("school", "hospital", "civic", "fire_station")
MAN_MADE_LANDMARK = ("pier", "tower", "lighthouse", "water_tower", "bridge", "obelisk", "windmill", "communications_tower")
CIVIC_OFFICE = ("government", "educational_institution", "research", "research_institute", "diplomatic")
CORE_CIVIC = ("school", "college", "university", "library", "hospital", "post_office", "townhall", "police", "fire_station", "courthouse", "station", "community_centre", "civic", "kindergarten")
BUDGETED_LANDMARK = ("artwork", "viewpoint", "memorial", "monument", "tower", "lighthouse", "water_tower", "bridge", "obelisk", "windmill", "communications_tower")
CORE_LEISURE = ("marina", "stadium", "sports_centre", "golf_course")
WORSHIP = ("place_of_worship", "church", "cathedral", "chapel", "mosque", "synagogue", "temple")
CAMPUS_HALLS = ("university_building", "college_building")
MOTORWAY, RAIL, WATERWAY = ("motorway", "motorway_link", "trunk"), ("rail", "light_rail"), ("river", "canal")
ANCHOR_PLACES, TITLE_PLACES = ("neighbourhood", "quarter"), ("neighbourhood", "quarter", "suburb")

Tag = Callable[[str], Column]


def tags_of(column: str = "tags") -> Tag:
    return lambda key: F.col(column)[key]


def name_from(tag: Tag) -> Column:
    return resolve_name(tag("name"), tag("short_name"), tag("brand"), tag("operator"))


def category_of(tag: Tag, named: Column) -> Column:
    """`class.subclass`, or null for what is no feature."""
    of = lambda key, values: tag(key).isin(*values)
    as_ = lambda name, value: F.concat(F.lit(f"{name}."), value)
    station = (tag("railway") == "station") | (tag("public_transport") == "station")
    rules: list[tuple[Column, Column]] = [
        (of("tourism", LANDMARK_TOURISM), as_("landmark", tag("tourism"))),
        (tag("amenity") == "place_of_worship", F.lit("landmark.place_of_worship")),
        (tag("historic").isNotNull(), as_("landmark", tag("historic"))),
        (of("building", WORSHIP_BUILDING), as_("landmark", tag("building"))),
        (of("man_made", MAN_MADE_LANDMARK), as_("landmark", tag("man_made"))),
        (of("amenity", CIVIC_AMENITY), as_("civic", tag("amenity"))),
        (tag("healthcare").isNotNull(), as_("civic", tag("healthcare"))),
        (of("office", CIVIC_OFFICE), as_("civic", tag("office"))),
        (station & named, F.lit("civic.station")),
        (of("amenity", FOOD_AMENITY), as_("food", tag("amenity"))),
        (of("amenity", LEISURE_AMENITY), as_("leisure", tag("amenity"))),
        (of("amenity", SHOP_AMENITY), as_("shop", tag("amenity"))),
        (tag("shop") == "deli", F.lit("food.deli")),
        (tag("shop").isNotNull(), as_("shop", tag("shop"))),
        (tag("craft").isNotNull(), as_("shop", tag("craft"))),
        (of("leisure", LEISURE), as_("leisure", tag("leisure"))),
        (tag("amenity") == "student_accommodation", F.lit("lodging.student_accommodation")),
        (of("tourism", LODGING_TOURISM), as_("lodging", tag("tourism"))),
        (named & of("building", INSTITUTION_BUILDING), as_("civic", tag("building"))),
        (named & (tag("building") == "stadium"), F.lit("leisure.stadium")),
        (named & (tag("building") == "train_station"), F.lit("civic.station")),
        (named & of("building", ("university", "college")), F.concat(F.lit("civic."), tag("building"), F.lit("_building"))),
        (named & (tag("building") == "dormitory"), F.lit("lodging.student_accommodation")),
        (named & of("building", RESIDENTIAL_BUILDING), as_("residential", tag("building"))),
    ]
    dropped = of("amenity", DROPPED_AMENITY) | of("natural", DROPPED_NATURAL)
    out = F.when(F.coalesce(dropped, F.lit(False)), F.lit(None).cast("string"))
    for condition, value in rules:
        out = out.when(F.coalesce(condition, F.lit(False)), value)
    return out


def salience_of(category) -> Column:
    """core, budgeted or clustered."""
    k, sub = klass(category), subclass(category)
    core = ((k == "landmark") & ~sub.isin(*BUDGETED_LANDMARK)) | ((k == "civic") & sub.isin(*CORE_CIVIC)) | ((k == "leisure") & sub.isin(*CORE_LEISURE)) | ((k == "lodging") & (sub == "student_accommodation"))
    return F.when(empty_to_null(category).isNull(), "budgeted").when(core, "core").when(k == "residential", "clustered").otherwise("budgeted")


def is_worship(category) -> Column:
    return F.coalesce((klass(category) == "landmark") & subclass(category).isin(*WORSHIP), F.lit(False))


def is_campus_hall(category) -> Column:
    return F.coalesce((klass(category) == "civic") & subclass(category).isin(*CAMPUS_HALLS), F.lit(False))


def importance_of(category, named: Column, chain: Column) -> Column:
    """0 to 100: a base by class and salience, more with a name or as a landmark, less for a chain."""
    k, sub, budgeted = klass(category), subclass(category), salience_of(category) == "budgeted"
    base = (
        F.when((k == "landmark") & budgeted, 45)
        .when((k == "civic") & budgeted, F.when(sub.isin(*CIVIC_OFFICE), 45).otherwise(55))
        .when(k.isin("landmark", "civic"), 80)
        .when(k.isin("food", "shop", "leisure", "lodging"), 55)
        .otherwise(30)
    )
    score = base + F.when(named, 10).otherwise(0) + F.when(k == "landmark", 5).otherwise(0) - F.when(chain, 15).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")


def tier_of(score) -> Column:
    s = c(score)
    return F.when(s >= 75, "landmark").when(s >= 50, "destination").when(s >= 25, "minor").otherwise("structure")


def area_bonus(square_metres) -> Column:
    """0 up to 200 m², then a log ramp to 9."""
    a = c(square_metres)
    return F.when(a <= 200.0, 0).otherwise(F.least(F.lit(9), F.rint(5 * F.log10(a / 200.0)).cast("int"))).cast("int")


def barrier_of(tag: Tag) -> tuple[Column, Column]:
    """Label and class of a barrier way; both null for others."""
    kind = F.when(tag("highway").isin(*MOTORWAY), "motorway").when(tag("railway").isin(*RAIL), "rail").when(tag("waterway").isin(*WATERWAY), "water")
    label = F.coalesce(blank_to_null(tag("name")), blank_to_null(tag("ref")))
    return F.when(kind.isNotNull(), label), F.when(label.isNotNull(), kind)


def area_of(tag: Tag) -> Column:
    """water or park for a named area; null for others."""
    park = (tag("leisure") == "park") | tag("landuse").isin("recreation_ground", "cemetery") | (tag("amenity") == "grave_yard") | tag("natural").isin("beach", "wetland")  # a null test does not spoil a true one
    return F.when(blank_to_null(tag("name")).isNull(), F.lit(None).cast("string")).when(tag("natural").isin("water", "bay"), "water").when(park, "park")


def settled(rows, value: Column, name: str):
    """rows with a column that is computed once: the optimizer does not copy it into every expression that reads it."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def classified(rows, tag: Tag):
    """rows with name, category, importance, tier and salience; what is no feature goes."""
    chain = tag("brand").isNotNull() | tag("brand:wikidata").isNotNull()
    out = settled(rows, name_from(tag), "name")
    out = settled(out, category_of(tag, F.col("name").isNotNull()), "category").where("category is not null")
    out = settled(out, importance_of("category", F.col("name").isNotNull(), chain), "importance")
    return out.withColumn("tier", tier_of("importance")).withColumn("salience", salience_of("category"))
