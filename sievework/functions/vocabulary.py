"""Default word lists of the classifiers. All classifiers take others."""

# Suffixes that count as images; strict scans leave out the last.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tif", ".tiff", ".mpo")

# Dataset folders and what they are called.
DATASETS = {"banana": "Banana", "cotton": "Cotton", "mango": "Mango", "rice": "Rice", "plantdoc": "PlantDoc", "plantvillage": "PlantVillage"}
# The datasets whose folders hold several crops.
MULTI_CROP = ("plantdoc", "plantvillage")

# Words in a label and the crop they mean.
CROP_ALIASES = {
    "tomato": "tomato", "potato": "potato", "apple": "apple", "pepper": "pepper", "bell pepper": "bell_pepper", "bell_pepper": "bell_pepper", "corn": "maize", "maize": "maize",
    "grape": "grape", "peach": "peach", "cherry": "cherry", "strawberry": "strawberry", "raspberry": "raspberry", "blueberry": "blueberry", "soybean": "soybean",
    "soyabean": "soybean", "squash": "squash", "banana": "banana", "cotton": "cotton", "mango": "mango", "rice": "rice",
}

# Canonical label and the words that mean it; the first match in this order wins.
DISEASE_WORDS = {
    "early_blight": ["early blight"], "late_blight": ["late blight"], "bacterial_spot": ["bacterial spot"], "bacterial_blight": ["bacterial blight"],
    "bacterial_leaf_blight": ["bacterial leaf blight"], "brown_spot": ["brown spot"], "leaf_blast": ["leaf blast"], "leaf_scald": ["leaf scald"],
    "sheath_blight": ["sheath blight"], "anthracnose": ["anthracnose"], "powdery_mildew": ["powdery mildew"], "sooty_mould": ["sooty mould", "sooty mold"],
    "bacterial_canker": ["bacterial canker"], "curl_virus": ["curl virus", "yellow leaf curl virus", "leaf yellow virus"], "mosaic_virus": ["mosaic virus"],
    "septoria_leaf_spot": ["septoria leaf spot"], "target_spot": ["target spot"], "leaf_mold": ["leaf mold", "mold leaf"],
    "spider_mites": ["spider mites", "two spotted spider mite"], "fusarium_wilt": ["fusarium wilt", "fussarium wilt"], "sigatoka": ["sigatoka"], "cordana": ["cordana"],
    "pestalotiopsis": ["pestalotiopsis"], "die_back": ["die back"], "gall_midge": ["gall midge"], "cutting_weevil": ["cutting weevil"], "apple_scab": ["apple scab"],
    "rust": ["apple rust", "corn rust"], "leaf_spot": ["leaf spot"], "black_rot": ["black rot"], "gray_leaf_spot": ["gray leaf spot"], "leaf_blight": ["leaf blight"],
}

# Whole labels that are decided before the words.
WHOLE_LABELS = {
    "apple scab leaf": "apple_scab", "apple rust leaf": "rust", "bell pepper leaf spot": "leaf_spot", "grape leaf black rot": "black_rot",
    "corn gray leaf spot": "gray_leaf_spot", "corn leaf blight": "leaf_blight", "corn rust leaf": "rust", "tomato leaf yellow virus": "curl_virus",
}
