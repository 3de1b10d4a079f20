"""Map tags of the collectible place categories."""

# Category -> (tag, value pattern); a pattern with ``=`` semantics is anchored.
CATEGORY_TAGS = {
    "school": [
        ("amenity", "^school$"),
        ("construction:amenity", "^school$"),
        ("planned:amenity", "^school$"),
        ("proposed:amenity", "^school$"),
    ],
    "kindergarten": [
        ("amenity", "^kindergarten$"),
        ("construction:amenity", "^kindergarten$"),
        ("planned:amenity", "^kindergarten$"),
        ("proposed:amenity", "^kindergarten$"),
    ],
    "shop": [("shop", "supermarket|convenience")],
    "parking": [("amenity", "^parking$")],
    "park_forest": [("leisure", "^park$"), ("natural", "^wood$"), ("landuse", "^forest$")],
    "medical": [("amenity", "clinic|hospital|doctors|pharmacy")],
    "university": [("amenity", "university|college")],
    "dentist": [("amenity", "^dentist$")],
    "sport": [("leisure", "fitness_centre|sports_centre|swimming_pool")],
    "food": [("amenity", "cafe|restaurant|fast_food")],
    "mall": [("shop", "mall|department_store")],
    "cinema": [("amenity", "^cinema$")],
    "bank": [("amenity", "^bank$")],
    "post": [("amenity", "^post_office$")],
}

# Tag keys of objects that do not operate yet.
BUILDING_KEYS = ("construction", "planned", "proposed")
COLLECT_RADIUS_M = 2000
SCHEMA_VERSION = 2
