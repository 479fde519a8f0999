"""Fixed vocabularies and thresholds. Order matters wherever a list is scanned."""

from __future__ import annotations

# Spelling variants of cities, in scanning order.
CITY_VARIANTS = [
    ("casa", "casablanca"), ("casa blanca", "casablanca"), ("dar el beida", "casablanca"), ("dar el bayda", "casablanca"),
    ("rabat-sale", "rabat"), ("rabat salé", "rabat"), ("rbat", "rabat"), ("marrakesh", "marrakech"), ("marrakech menara", "marrakech"),
    ("tanger", "tangier"), ("tangiers", "tangier"), ("fez", "fes"), ("fès", "fes"), ("agadir-ida", "agadir"), ("agadir ida ou tanane", "agadir"),
    ("meknes", "meknes"), ("meknès", "meknes"), ("oujda-angad", "oujda"), ("tetouan", "tetouan"), ("tétouan", "tetouan"),
    ("mohammedia", "mohammedia"), ("mohammédia", "mohammedia"), ("kenitra", "kenitra"), ("kénitra", "kenitra"), ("el jadida", "el jadida"),
    ("jadida", "el jadida"), ("safi", "safi"), ("beni mellal", "beni mellal"), ("béni mellal", "beni mellal"), ("khouribga", "khouribga"), ("nador", "nador"),
]

# Variants of property types, in scanning order.
TYPE_VARIANTS = [
    ("appartement", "apartment"), ("appart", "apartment"), ("app", "apartment"), ("flat", "apartment"), ("studio", "studio"), ("duplex", "duplex"),
    ("triplex", "triplex"), ("penthouse", "penthouse"), ("loft", "loft"), ("maison", "house"), ("villa", "villa"), ("riad", "riad"),
    ("townhouse", "townhouse"), ("cottage", "house"), ("pavillon", "house"), ("bureau", "office"), ("local commercial", "commercial"),
    ("commerce", "commercial"), ("boutique", "shop"), ("magasin", "shop"), ("entrepôt", "warehouse"), ("depot", "warehouse"), ("usine", "industrial"),
    ("terrain", "land"), ("terrain agricole", "agricultural_land"), ("terrain constructible", "buildable_land"), ("parcelle", "land"),
]

# Words that tell of a feature in a description.
FEATURE_WORDS = {
    "parking": ["parking", "garage", "place de parking"],
    "pool": ["piscine", "pool", "swimming pool"],
    "garden": ["jardin", "garden", "espace vert"],
    "elevator": ["ascenseur", "elevator", "lift"],
    "air_conditioning": ["climatisation", "clim", "air conditioning", "ac"],
    "heating": ["chauffage", "heating", "radiateur"],
    "furnished": ["meublé", "furnished", "équipé"],
    "balcony": ["balcon", "balcony", "terrasse"],
    "terrace": ["terrasse", "terrace", "roof top"],
    "sea_view": ["vue mer", "sea view", "vue océan"],
    "mountain_view": ["vue montagne", "mountain view"],
    "new_construction": ["neuf", "new", "nouvelle construction"],
    "renovated": ["rénové", "renovated", "refait à neuf"],
    "security": ["sécurité", "security", "gardien", "surveillance"],
    "internet": ["internet", "wifi", "fibre"],
}

# Yes and no, conditions, floors.
TRUE_WORDS = ["oui", "yes", "true", "1", "disponible", "inclus", "avec"]
FALSE_WORDS = ["non", "no", "false", "0", "sans", "aucun"]
CONDITION_WORDS = [
    ("excellent", ["excellent", "très bon", "parfait", "impeccable"]),
    ("good", ["bon", "good", "correct", "satisfaisant"]),
    ("average", ["moyen", "acceptable", "passable"]),
    ("poor", ["mauvais", "poor", "à rénover", "dégradé"]),
    ("new", ["neuf", "new", "nouvelle construction"]),
    ("renovated", ["rénové", "refait", "renovated"]),
]
FLOOR_WORDS = [("ground_floor", ["rdc", "ground", "rez"]), ("basement", ["sous-sol", "basement", "cave"]), ("top_floor", ["dernier", "top", "penthouse"])]

# Words counted in titles and descriptions.
TITLE_WORDS = ["luxury", "modern", "new", "renovated", "spacious", "bright"]
POSITIVE_WORDS = ["excellent", "perfect", "beautiful", "amazing", "stunning"]
NEGATIVE_WORDS = ["needs", "repair", "old", "small", "dark"]
AMENITY_WORDS = ["parking", "garage", "garden", "terrace", "balcony", "pool", "elevator", "air conditioning", "heating", "furnished"]

# Per city: price range, price per m2 range, price per m2 levels, centre, airport.
CITIES = {
    "casablanca": ((200_000, 50_000_000), (8_000, 80_000), (15_000, 30_000, 50_000), (33.5731, -7.5898), (33.3676, -7.5897)),
    "rabat": ((150_000, 30_000_000), (6_000, 60_000), (12_000, 25_000, 40_000), (34.0209, -6.8416), (34.0515, -6.7515)),
    "marrakech": ((300_000, 80_000_000), (10_000, 100_000), (20_000, 40_000, 70_000), (31.6295, -7.9811), (31.6069, -8.0363)),
    "tangier": ((150_000, 25_000_000), (5_000, 50_000), (10_000, 20_000, 35_000), (35.7595, -5.8340), (35.7269, -5.9169)),
    "fes": ((100_000, 15_000_000), (4_000, 40_000), (8_000, 15_000, 25_000), (34.0331, -5.0003), (33.9273, -4.9676)),
    "agadir": ((200_000, 35_000_000), (7_000, 70_000), (15_000, 30_000, 50_000), (30.4278, -9.5981), (30.3814, -9.5463)),
}
DEFAULT_CITY = "casablanca"
#: The enrichment tables place one centre elsewhere.
ENRICHMENT_CENTRES = {c: v[3] for c, v in CITIES.items()} | {"fes": (34.0181, -5.0078)}
KNOWN_CITIES = ["casablanca", "rabat", "marrakech", "tangier", "fes", "agadir", "meknes", "oujda", "kenitra", "tetouan", "safi", "mohammedia", "el jadida", "beni mellal", "khouribga", "nador"]
KNOWN_TYPES = ["apartment", "house", "villa", "studio", "duplex", "triplex", "penthouse", "loft", "riad", "office", "commercial", "land"]

# Currencies and valid ranges.
RATES = {"USD": 10.0, "EUR": 11.0, "GBP": 12.5, "DH": 1.0, "MAD": 1.0, "DHS": 1.0}
PRICE_RANGE, PPM2_RANGE = (50_000, 100_000_000), (1_000, 200_000)
LAT_RANGE, LON_RANGE = (21.0, 36.0), (-17.5, -1.0)
SURFACE_RANGE, ROOMS_RANGE = (15, 2000), (1, 15)

# Encodings.
ORDINAL = {
    "condition": ["poor", "average", "good", "excellent", "new"],
    "price_category": ["budget", "mid_range", "premium", "luxury"],
    "price_per_m2_category": ["below_market", "market_rate", "above_market", "premium_market"],
    "floor_level": ["basement", "ground_floor", "floor_1", "floor_2", "floor_3", "floor_4", "floor_5", "floor_6+", "top_floor"],
}
DEFAULT_ENCODINGS = {
    "neighborhood": "frequency", "address": "label", "city": "onehot", "property_type": "onehot", "source_platform": "onehot",
    "condition": "ordinal", "price_category": "ordinal", "price_per_m2_category": "ordinal",
    "parking": "boolean", "elevator": "boolean", "pool": "boolean", "garden": "boolean", "furnished": "boolean",
}
BOOLEAN_TRUE = ["true", "1", "yes", "y", "oui"]
LUXURY_WEIGHTS = {"pool": 3.0, "garden": 2.0, "elevator": 1.5, "parking": 1.0, "air_conditioning": 1.0, "furnished": 0.5}
AMENITIES = ["parking", "elevator", "pool", "garden", "furnished", "air_conditioning", "heating", "balcony", "terrace"]

# Quality checks.
FIELD_GROUPS = {
    "critical": (0.95, ["price_mad", "surface_m2", "city", "property_type"]),
    "important": (0.80, ["rooms", "neighborhood", "latitude", "longitude"]),
    "optional": (0.50, ["bathrooms", "floor", "parking", "elevator", "description"]),
}
EXPECTED_TYPES = {
    "price_mad": "double", "surface_m2": "double", "rooms": "bigint", "bathrooms": "double", "latitude": "double",
    "longitude": "double", "city": "string", "property_type": "string", "neighborhood": "string",
}
CHECK_WEIGHTS = {"completeness": 0.3, "validity": 0.25, "consistency": 0.20, "accuracy": 0.15, "uniqueness": 0.05, "integrity": 0.05}

# Points of interest and city facts.
POI_CATEGORIES = {
    "schools": ["school", "university", "kindergarten"],
    "hospitals": ["hospital", "clinic", "doctors"],
    "restaurants": ["restaurant", "cafe", "fast_food"],
    "shops": ["shop", "mall", "supermarket"],
    "parks": ["park", "garden", "playground"],
}
CENSUS = [("casablanca", 3359818, 9030, 0.12, 0.87), ("rabat", 1777186, 4950, 0.10, 0.91), ("marrakech", 928850, 4365, 0.08, 0.68)]
INFRASTRUCTURE = {"road_quality_index": 7.2, "water_access": True, "electricity_reliability": 0.95, "internet_coverage": 0.78}
ROOM_WORDS = [
    ("bedroom", ["bedroom", "chambre", "bed"]), ("kitchen", ["kitchen", "cuisine"]), ("bathroom", ["bathroom", "salle_bain", "bath"]),
    ("living_room", ["living", "salon", "sitting"]), ("exterior", ["exterior", "facade", "outside"]),
]
EXTERIOR_WORDS = ["exterior", "facade", "outside", "building", "front"]
INTERIOR_WORDS = ["interior", "inside", "room", "kitchen", "bathroom"]
