"""Fixed values of the domain: rates, bounds, word lists and title patterns.

These values decide results, so they are stated as plain text.
"""

# --- fixed values: currency rates to MAD -----------------------------------
LAPTOP_RATES = {
    "MAD": 1.0, "": 1.0, "EUR": 11.0, "€": 11.0, "USD": 10.0, "$": 10.0, "GBP": 13.0, "£": 13.0,
}
ACCESSORY_RATES = {"MAD": 1.0, "DH": 1.0, "USD": 10.0, "EUR": 11.0, "GBP": 13.0}
ACCESSORY_VIEW_RATES = {"MAD": 1.0, "USD": 10.0, "EUR": 11.0, "GBP": 13.0}

# --- fixed values: price bounds in MAD -------------------------------------
LOAD_BOUNDS = (1500.0, 150000.0)
PRODUCT_BOUNDS = {"laptop": (500.0, 150000.0), "accessory": (10.0, 20000.0)}
OTHER_PRODUCT_BOUNDS = (1.0, 1000000.0)
ACCESSORY_BOUNDS = {"souris": (10.0, 10000.0), "stand": (10.0, 5000.0), "usb": (5.0, 3000.0)}
ACCESSORY_VIEW_BOUNDS = {"souris": (20.0, 8000.0), "stand": (10.0, 5000.0), "usb": (5.0, 3000.0)}
OTHER_ACCESSORY_BOUNDS = (1.0, 100000.0)

# accessory price range: category -> (below is "bas", below is "moyen")
ACCESSORY_RANGE_CUTS = {"souris": (100.0, 500.0), "stand": (100.0, 400.0)}
OTHER_ACCESSORY_RANGE_CUTS = (50.0, 200.0)

# --- fixed values: price levels --------------------------------------------
PRICE_LEVELS = [
    (3000.0, "entrée_de_gamme"),
    (7000.0, "milieu_de_gamme_bas"),
    (12000.0, "milieu_de_gamme"),
    (22000.0, "haut_de_gamme"),
]
TOP_PRICE_LEVEL = "premium"
PRICE_LEVEL_ORDER = [name for _, name in PRICE_LEVELS] + [TOP_PRICE_LEVEL]
BASKET_PRICE_LEVELS = [(3000.0, "entree"), (7000.0, "milieu_bas"), (12000.0, "milieu"), (22000.0, "haut")]
BASKET_TOP_PRICE_LEVEL = "premium"

# price-band segments: (from, below, name)
PRICE_BANDS = [
    (0.0, 3000.0, "Entrée de gamme"),
    (3000.0, 6000.0, "Milieu de gamme bas"),
    (6000.0, 12000.0, "Milieu de gamme"),
    (12000.0, 25000.0, "Haut de gamme"),
    (25000.0, 999999.0, "Premium"),
]
SEGMENT_NAMES = [name for _, _, name in PRICE_BANDS]
BAND_EPS = 0.1003
BAND_MIN_SAMPLES = 3

# anomaly chart bands: (label, from, below)
ANOMALY_BANDS = [
    ("< 3k", 0.0, 3000.0), ("3–6k", 3000.0, 6000.0), ("6–12k", 6000.0, 12000.0),
    ("12–25k", 12000.0, 25000.0), ("25–50k", 25000.0, 50000.0), ("> 50k", 50000.0, float("inf")),
]

# --- fixed values: laptop words --------------------------------------------
LAPTOP_WORDS = ["laptop", "ordinateur", "notebook", "pc portable", "computer", "macbook"]
GAMING_WORDS = [
    "gaming", "gamer", "game", "rog", "predator", "nitro", "legion", "omen", "victus", "tuf", "g15", "g14",
    "g16", "rtx", "gtx", "geforce", "strix", "raider", "helios", "katana", "sword", "stealth", "blade",
]
ACCESSORY_GAMING_WORDS = ["gaming", "gamer", "rog", "predator"]

# --- fixed values: brand patterns, first match wins ------------------------
BRAND_PATTERNS = [
    ("Apple", r"\bapple\b|\bmacbook\b|\bmac\s*book\b"),
    ("HP", r"\bhp\b|\belitebook\b|\bprobook\b|\bomen\b|\bvictus\b|\benvy\b|\bpavill?on\b|\bspectre\b"),
    ("Dell", r"\bdell\b|\blatitude\b|\bvostro\b|\bxps\b|\binspiro[n]?\b|\bg\d+\b"),
    ("Lenovo", r"\blenovo\b|\bthinkpad\b|\bideapad\b|\blegion\b|\byoga\b|\bslim\s*\d+\b"),
    ("Asus", r"\basus\b|\brog\b|\bvivobook\b|\bzenbook\b|\bexpertbook\b|\btuf\b|\bproart\b"),
    ("Acer", r"\bacer\b|\baspire\b|\bswift\b|\bpredator\b|\bnitro\b|\bextensa\b|\bconceptd\b"),
    ("MSI", r"\bmsi\b|\bmodern\b|\bcreator\b|\bstealth\b|\braider\b|\bprestige\b"),
    ("Samsung", r"\bsamsung\b|\bgalaxy\s*book\b"),
    ("Toshiba", r"\btoshiba\b|\bdynabook\b"),
    ("Huawei", r"\bhuawei\b|\bmatebook\b"),
    ("Microsoft", r"\bmicrosoft\b|\bsurface\b"),
    ("Xiaomi", r"\bxiaomi\b|\bmi\s+notebook\b|\bredmibook\b|\bmi\s+laptop\b"),
    ("Gpd", r"\bgpd\b"),
    ("LG", r"\blg\b|\bgram\b"),
    ("Razer", r"\brazer\b|\bblade\b"),
    ("Teclast", r"\bteclast\b"),
    ("Chuwi", r"\bchuwi\b"),
    ("Jumper", r"\bjumper\b"),
    ("Jumia", r"\bjumia\b"),
]
OTHER_BRAND = "Autre"

# --- fixed values: valid sizes in Go ---------------------------------------
RAM_SIZES = [2, 4, 6, 8, 10, 12, 16, 18, 24, 32, 48, 64, 128]
STORAGE_SIZES = [16, 32, 64, 128, 256, 480, 500, 512, 1000, 2000, 4000]

# --- fixed values: processor score rules, first match wins -----------------
CPU_SCORES = [
    (10, r"\bcore\s*ultra\s*9\b|\bultra\s*9\b"),
    (8, r"\bcore\s*ultra\s*7\b|\bultra\s*7\b"),
    (6, r"\bcore\s*ultra\s*5\b|\bultra\s*5\b"),
    (9, r"\bi9\b|core\s*i9"),
    (7, r"\bi7\b|core\s*i7"),
    (5, r"\bi5\b|core\s*i5"),
    (3, r"\bi3\b|core\s*i3"),
    (9, r"ryzen\s*(?:ai\s*)?9"),
    (7, r"ryzen\s*(?:ai\s*)?7"),
    (5, r"ryzen\s*(?:ai\s*)?5"),
    (3, r"ryzen\s*3"),
    (10, r"\bm[34]\s*(?:pro|max|ultra)\b"),
    (9, r"\bm[12]\s*(?:pro|max|ultra)\b"),
    (8, r"\bm[34]\b"),
    (7, r"\bm[12]\b"),
    (8, r"\bsnapdragon\s*x\s*(?:elite|plus)\b"),
    (5, r"\bsnapdragon\b"),
    (1, r"\bceleron\b|\bpentium\b|\batom\b|\bn\d{4}\b"),
]

# --- fixed values: processor generation patterns, in order -----------------
# each with plain texts one of which every match contains
CPU_GENERATIONS = [
    (r"(\d+)[eèéúþ]+me?\s*g[eé]n", ["gen", "gén"]),
    (r"(\d+)th\s*gen", ["th"]),
    (r"(\d+)e\s*gen", ["gen"]),
    (r"generation\s*(\d+)", ["generation"]),
    (r"gen\s*(\d+)", ["gen"]),
    (r"-(\d+)(?:th|[eè]me)", ["-"]),
    (r"i[357]-(\d{2})\d{2,}", ["i3-", "i5-", "i7-"]),
]
GENERATION_RANGE = (4, 14)

# --- fixed values: yes/no title patterns -----------------------------------
GPU_PATTERN = (
    r"\brtx\b|\bgtx\b|\bradeon\s*rx\b|\brx\s*\d+\b|\bgeforce\b|\bnvidia\b|\bamd\s*gpu\b|\bquadro\b|\barc\s*a\d+\b"
)
TOUCH_PATTERN = r"\btactile\b|\btouch\b|\btouchscreen\b|\b2-in-1\b|\b2in1\b"
REFURBISHED_PATTERN = (
    r"\brecondition\b|\brefurb\b|\brenew\b|\bremis\s*[àa]\s*neuf\b|\bgrade\s*[abc]\b|\bgrade[abc]\b|\bused\b|\boccasion\b"
)

# --- fixed values: storage kinds, first match wins -------------------------
STORAGE_KINDS = [
    ("NVMe SSD", r"\bnvme\b|\bm\.2\b"),
    ("SSD", r"\bssd\b"),
    ("eMMC", r"\bemmc\b|\bflash\b"),
    ("HDD", r"\bhdd\b|\bdisque\s*dur\b|\bhard\s*disk\b"),
]
UNKNOWN = "Inconnu"

# ram level: (up to, name)
RAM_LEVELS = [(4, "Basique (≤4GB)"), (8, "Standard (8GB)"), (16, "Performant (16GB)")]
TOP_RAM_LEVEL = "Haute perf (≥32GB)"

# --- fixed values: listing relevance rules ---------------------------------
# family -> (words one of which must occur, words none of which may occur, lowest price)
LISTING_RULES = {
    "laptop": (
        ["laptop", "notebook", "pc portable", "ordinateur portable", "ordinateur", "macbook", "ultrabook",
         "chromebook", "desktop", "pc bureau", "all in one", "mini pc", "gaming laptop", "gamer", "rog", "omen",
         "legion", "victus", "thinkpad", "ideapad", "vivobook", "zenbook", "pavilion", "inspiron", "latitude",
         "xps", "aspire", "swift", "elitebook", "probook"],
        ["sac", "bag", "backpack", "cartable", "sacoche", "toploader", "sticker", "stickers", "autocollant",
         "autocollants", "skin", "decal", "souris", "mouse", "clavier", "keyboard", "chargeur", "charger",
         "battery", "batterie", "Hyper Station", "écran", "ecran", "screen", "monitor", "housse", "coque",
         "cover", "case", "support", "stand", "holder", "dock", "hub", "cable", "câble", "adaptateur",
         "adapter", "speaker", "haut parleur", "haut-parleur", "enceinte", "casque", "écouteur", "lampe",
         "lamp", "light", "disque dur", "hard drive", "hdd", "ssd externe", "tablette", "smartphone", "tv",
         "projecteur", "webcam", "Manette", "USB", "usb", "xbox", "playstation", "Msi", "PC Steam",
         "Lenovo Legion", "Legion", "Asus ROG", "ROG", "HP Omen", "Omen", "Acer Predator", "Predator",
         "notebook"],
        1200.0,
    ),
    "mouse": (
        ["souris", "mouse"],
        ["tapis", "mouse pad", "mousepad", "sticker", "autocollant", "capteur", "switch", "bouton", "pièce",
         "cable", "câble", "hub"],
        30.0,
    ),
    "bag": (
        ["sac", "sacoche", "housse", "bag", "backpack", "pochette"],
        ["tapis", "sticker", "autocollant", "cable", "câble", "hub", "souris", "clavier", "chargeur", "ecran",
         "batterie", "antivol", "support", "stand", "film", "protection clavier"],
        40.0,
    ),
    "stand": (
        ["support", "stand", "rehausseur", "refroidisseur", "cooler", "tablette", "porte", "base"],
        ["sac", "sacoche", "housse", "pochette", "backpack", "sticker", "autocollant", "cable", "câble",
         "batterie", "clavier", "souris", "ecran", "antivol", "film"],
        30.0,
    ),
    "usb": (
        ["usb", "cle", "clé", "flash", "drive", "pendrive", "gb", "go", "to", "tb"],
        ["cable", "câble", "chargeur", "hub", "adaptateur", "adapter", "micro sd", "carte memoire", "ventilo",
         "lampe", "souris", "clavier", "convertisseur", "wifi", "bluetooth"],
        20.0,
    ),
    "cooling": (
        ["refroidisseur", "cooling", "cooler", "ventilateur", "ventilo", "fan", "pad", "base", "support ventilé",
         "radiateur", "vaccum", "turbine", "rgb", "led", "airflow"],
        ["interne", "pâte thermique", "thermal paste", "cpu cooler", "watercooling kit", "boitier pc", "case fan",
         "support bois", "support aluminium seul", "pliable sans ventilateur", "bureau", "table", "coque",
         "housse"],
        20.0,
    ),
}

# category written by each crawler family
LISTING_CATEGORIES = {
    "mouse": "mouse", "bag": "sac_laptop", "stand": "laptop_stand", "usb": "usb_flash_drive", "cooling": "cooling_pad",
}

# --- fixed values: shops ----------------------------------------------------
SHOP_HOSTS = {
    "Jumia": "https://www.jumia.ma", "Amazon": "https://www.amazon.fr", "AliExpress": "https://fr.aliexpress.com",
}

# --- fixed values: search terms by shop and seed ---------------------------
# Only short lists are kept here; longer ones come from a (shop, seed, term)
# table given by the user, see sources.search_terms.
SEARCH_TERMS = {
    ("Jumia", "sac_laptop"): [
        "sac pc", "sac ordinateur", "sacoche ordinateur", "sacoche pc", "housse pc", "housse ordinateur",
        "laptop bag", "laptop backpack", "sac à dos pc", "sac à dos ordinateur", "sac laptop", "pochette pc",
        "sacoche hp", "sac à dos lenovo", "housse macbook",
    ],
    ("AliExpress", "laptop"): [
        "pc portable", "macbook pro m3", "macbook pro m3 pro", "macbook pro m3 max", "macbook pro 16 m3",
        "lenovo thinkpad laptop", "laptop lenovo", "dell laptop", "asus rog gaming laptop", "asus zenbook laptop",
        "asus zenbook pro 14", "msi stealth 16", "microsoft surface laptop", "laptop intel core i5",
        "laptop intel core i7", "laptop intel core i9", "laptop intel core ultra 5", "laptop intel core ultra 7",
        "laptop intel core ultra 9", "laptop rtx 3036", "workstation laptop", "video editing laptop",
        "graphic design laptop", "coding laptop", "school laptop",
    ],
    ("Jumia", "souris"): [
        "souris pc", "souris ordinateur", "souris sans fil", "souris filaire", "souris usb", "souris bluetooth",
        "souris gamer", "souris gaming", "gaming mouse", "rgb mouse", "mouse gamer rgb", "hp mouse", "dell mouse",
        "razer mouse", "trust mouse", "havit mouse", "asus mouse", "lenovo mouse", "souris hp", "souris dell",
        "souris asus", "souris lenovo", "silent mouse", "ergonomic mouse", "vertical mouse", "portable mouse",
        "souris silencieuse", "souris ergonomique", "souris verticale", "souris portable",
    ],
}
