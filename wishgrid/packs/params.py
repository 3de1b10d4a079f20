"""Fixed values of the search link: parameter names, path segments, id audit modes."""

# Link host and path.
LINK_HOST = "www.pik.ru"
LINK_BASE = "https://www.pik.ru/search"

# Room classes -> path segment and id; finish ids -> path segment.
ROOM_SEGMENTS = {"studio": "studio", "one": "one-room", "two": "two-room", "three_plus": "three-room"}
ROOM_IDS = {"studio": "-1", "one": "1", "two": "2", "three_plus": "3"}
FINISH_SEGMENTS = {0: "bez-otdelki", 1: "finish", 2: "predchistovaya-otdelka"}

# Path segment -> (parameter, value).
PATH_PARAMS = {
    "studio": ("rooms", "-1"),
    "one-room": ("rooms", "1"),
    "two-room": ("rooms", "2"),
    "three-room": ("rooms", "3"),
    "finish": ("hasFinish", "1"),
    "bez-otdelki": ("hasFinish", "0"),
    "predchistovaya-otdelka": ("hasFinish", "2"),
    "ready": ("ready", "1"),
}

# Query parameters taken over unchanged, and the renamed one.
PASSED_PARAMS = (
    "rooms blocks metroStations districtLocations districtCounties hasFinish ready status "
    "priceFrom priceTo areaFrom areaTo areaKitchenFrom areaKitchenTo floorFrom floorTo "
    "notFirstFloor lastFloor notLastFloor timeOnFoot timeOnTransport settlementYearFrom "
    "settlementYearTo settlementMonthFrom settlementMonthTo currentBenefit optionGroups options "
    "requiredTags sortBy orderBy"
).split()
RENAMED_PARAMS = {"type": "types"}

# Parameters a result count does not reflect.
UNVERIFIED_LOCATION = ("metroStations", "districtLocations", "districtCounties")
UNVERIFIED_DATES = (
    "settlementYearFrom",
    "settlementYearTo",
    "settlementMonthFrom",
    "settlementMonthTo",
)
VERIFIABLE_FINISH = (1, 2, 3)

# Metro ids that are not to be trusted.
REMOVED_METRO_IDS = (
    "c1d2e3f4-a5b6-7c8d-9e0f-1a2b3c4d5e6f",
    "a1b2c3d4-e5f6-7a8b-9c0d-1e2f3a4b5c6d",
    "b1c2d3e4-f5a6-7b8c-9d0e-1f2a3b4c5d6e",
    "guid-varshavskaya",
    "guid-sokol",
)
SUSPICIOUS_METRO_IDS = (
    "23bd023f-e8b3-469b-98f2-d9633e6fa16b",
    "23bd023f-e8b3-469b-98f2-d9633e6fa16c",
)
DISTRUSTED_METRO_IDS = REMOVED_METRO_IDS + SUSPICIOUS_METRO_IDS

FLATS_PER_PAGE = 20
