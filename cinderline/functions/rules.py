"""Fixed values of the domain: severities, precedences, labels, patterns. Results depend on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How severe a status is; 0 for all others.
STATUS_SEVERITY = {"closure": 100, "full": 90, "stage_2": 80, "stage_1": 70, "year_round": 60, "advisory": 50, "partial": 40, "none": 10, "unknown": 0}
#: Statuses of an emergency order, which set a year-round baseline aside.
ACTIVE_ORDERS = ("stage_1", "stage_2", "full", "closure")
#: Which kind of source is believed first; 0 for all others.
SOURCE_PRECEDENCE = {
    "arcgis_feature_layer": 100, "fs_fire_info_page": 90, "fs_fire_page": 88, "fs_alert_detail": 85, "fs_alerts_page": 80, "fs_release_page": 70,
    "nps_fire_page": 88, "nps_alerts_api": 84, "nps_conditions_page": 82, "partner_page": 60, "state_feature_layer": 40, "inciweb_feed": 10, "nifc_feature_layer": 10,
}
#: The first of these that occurs is a group's policy.
POLICY_PRECEDENCE = ("prohibited", "stoves_only", "developed_sites_only", "fire_pan_required", "propane_allowed", "allowed", "unknown")
#: How a policy change is graded.
POLICY_SEVERITY = {"allowed": 0, "fire_pan_required": 1, "developed_sites_only": 2, "stoves_only": 3, "prohibited": 4}
#: Abbreviations in names of places.
NAME_TOKENS = {
    "mt": "mount", "mtn": "mountain", "nf": "national forest", "natl": "national", "cg": "campground", "campgrounds": "campground", "th": "trailhead", "trailheads": "trailhead",
    "trl": "trail", "trails": "trail", "lk": "lake", "lakes": "lake", "rvr": "river", "rivers": "river", "waterfalls": "waterfall", "wildernesses": "wilderness",
}
#: Words of a name that its slug leaves out.
SLUG_STOPS = r"\b(national forest|forest|wilderness|campground|trailhead)\b"
#: Fixed values of map projection and distances.
EARTH_RADIUS_METERS, METERS_PER_MILE, ACRE_SQUARE_METERS, LEAST_RADIUS_METERS = 6_378_137.0, 1609.344, 4046.86, 500.0
FEET_PER_METER = 3.280839895
NEAR_MILES, REGIONAL_MILES, REGIONAL_ACRES = 10, 30, 100
#: Order of durations in lists of rules; 9 for all others.
DURATION_RANK = {"temporary": 0, "incident": 1, "seasonal": 2, "permanent": 3}

#: Statuses that a map shows for the whole unit, reviews that publish, and which source a unit's link comes from (the least; 9 for all others).
MAP_STATUSES, PUBLISHED_REVIEWS = ("closure", "full", "stage_1", "stage_2", "year_round"), ("accepted", "auto_accepted")
LINK_RANK = {"fs_fire_info_page": 0, "fs_fire_page": 1, "fs_alerts_page": 2, "fs_release_page": 3, "nps_fire_page": 0, "nps_alerts_api": 1, "nps_conditions_page": 2}
#: States by unit and, for other units, by market; "other" for all else.
STATE_NAMES = {"or": "Oregon", "wa": "Washington", "ca": "California", "other": "Other"}
STATE_BY_MARKET = {"oregon": "or", "washington": "wa", "northern_california": "ca", "extended_tahoe": "ca"}
STATE_BY_UNIT = {
    "colville": "wa", "deschutes": "or", "fremont-winema": "or", "gifford-pinchot": "wa", "malheur": "or", "mt-baker-snoqualmie": "wa", "mt-hood": "or", "ochoco-crooked-river": "or",
    "okanogan-wenatchee": "wa", "olympic": "wa", "rogue-river-siskiyou": "or", "siuslaw": "or", "umatilla": "or", "umpqua": "or", "wallowa-whitman": "or", "willamette": "or",
    "north-cascades": "wa", "mount-rainier": "wa", "olympic-national-park": "wa", "crater-lake": "or", "klamath": "ca", "six-rivers": "ca", "shasta-trinity": "ca", "mendocino": "ca",
    "modoc": "ca", "lassen": "ca", "lassen-volcanic": "ca", "plumas": "ca", "tahoe": "ca", "eldorado": "ca", "lake-tahoe-basin": "ca",
}


def lookup(key: Column, table: dict, default) -> Column:
    """The table's value for a key, default for none."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))
