"""Vocabularies and default weights; fixed values that results depend on."""

BASE_CATEGORIES = ("character", "copyright", "artist", "species", "meta", "general")
CATEGORY_WEIGHTS = {"character": 6.0, "copyright": 3.0, "artist": 2.0, "species": 2.5, "general": 3.0, "meta": 0.5}
MERGE_PRIORITY = {"character": 6, "species": 5, "copyright": 4, "artist": 3, "meta": 2, "general": 1}
EXTENDED_WEIGHTS = {
    "00_Subject_Count": 2.0, "01_Body_Physique": 4.0, "02_Body_Hair": 3.5, "03_Body_Face": 3.0, "04_Body_Genitalia": 1.5,
    "05_Attire_Main": 2.5, "06_Attire_Inner": 2.0, "07_Attire_Legwear": 2.0, "08_Attire_Acc": 2.0, "09_Action": 1.0, "10_Pose": 1.0,
    "11_Expression": 1.5, "12_Sexual_Act": 1.0, "13_Object": 1.5, "14_Setting": 0.8, "15_Framing": 0.5, "16_Focus": 0.5,
    "17_Style_Art": 0.8, "18_Style_Tech": 0.5, "19_Meta_Attributes": 0.3, "20_Meta_Text": 0.3, "21_Status": 1.5,
}
EXTENDED_META = ("19_Meta_Attributes", "20_Meta_Text")
RATINGS = ("rating:general", "rating:sensitive", "rating:questionable", "rating:explicit")
RATING_CODES = {"g": "rating:general", "s": "rating:sensitive", "q": "rating:questionable", "e": "rating:explicit"}
RATING_THRESHOLDS = (0.5, 0.6, 0.7, 0.8)
MIN_CONFIDENCE = 0.4
PAIR_MULTIPLIER = 1.5
AUTOCOMPLETE_ORDER = ("character", "copyright", "artist", "species", "general", "meta")
SUGGESTION_BOUNDS = (0.012, 0.04)
VISUAL_GUARD, BLOB_GUARD = 0.02, 0.0025
VIDEO_EXTENSIONS = ("mp4", "webm")
