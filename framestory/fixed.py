"""Vocabularies, thresholds and lookup tables.

These are plain facts the results depend on; changing one changes results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Class vocabularies -------------------------------------------------------
PERSON_CLASSES = ["person", "man", "woman", "child", "baby", "crowd"]
VEHICLE_CLASSES = ["car", "truck", "bus", "motorcycle", "bicycle", "scooter", "van"]
TRANSIENT_OBJECT_CLASSES = [
    "bottle", "wine_glass", "cup", "fork", "knife", "spoon", "bowl", "banana", "apple", "sandwich",
    "orange", "book", "cell_phone", "laptop", "mouse", "remote", "keyboard", "backpack", "handbag",
    "suitcase", "umbrella", "scissors", "vase", "clock"]
PHONE_CLASSES = ["phone", "smartphone", "mobile_phone", "cell_phone", "iphone"]
LAPTOP_CLASSES = ["laptop", "notebook_computer", "notebook"]
DRINK_CLASSES = ["bottle", "water_bottle", "cup", "mug", "coffee_mug", "tea_cup", "wine_glass", "glass", "can"]
BOOK_CLASSES = ["book", "notebook", "document", "magazine"]
SCREEN_CLASSES = ["tv", "television", "monitor", "screen", "projector"]
POCKET_CLASSES = ["wallet", "phone", "smartphone", "mobile_phone", "remote_control", "remote", "pen", "pencil",
                  "keys", "key", "glasses"]
PICK_UP_CLASSES = ["bottle", "cup", "mug", "coffee_mug", "book", "remote_control", "remote", "phone", "smartphone",
                   "wallet", "glasses", "backpack", "handbag", "briefcase", "laptop", "box", "package"]
BACKGROUND_CLASSES = ["chair", "office_chair", "sofa", "couch", "bed", "desk", "table", "dining_table", "shelf",
                      "bookshelf", "cabinet", "wardrobe", "bench", "curtain", "window", "door", "wall", "floor",
                      "ceiling", "air_conditioner", "ceiling_fan", "carpet", "rug"]
BAG_CLASSES = ["backpack", "handbag", "suitcase", "bag", "luggage", "briefcase", "duffel_bag", "tote_bag"]
CARRY_CLASSES = ["backpack", "handbag", "suitcase", "bag", "briefcase", "bottle", "box", "package", "laptop", "book"]
SEAT_CLASSES = ["chair", "office_chair", "couch", "bench", "sofa", "stool", "ottoman"]
BICYCLE_CLASSES = ["bicycle", "bike", "cycle", "motorbike", "motorcycle", "scooter"]
SANITY_BICYCLE_CLASSES = ["bicycle", "bike", "motorcycle"]
HALLUCINATED_CLASSES = ["sports_ball", "teddy_bear", "frisbee", "kite", "baseball_bat", "baseball_glove",
                        "skateboard", "surfboard", "tennis_racket", "snowboard", "skis", "bow_tie", "vase"]

# Speed, area and camera-motion thresholds ----------------------------------
STATIONARY_MAX, SLOW_MAX, WALKING_MAX = 0.01, 0.05, 0.15
AREA_CHANGE = 0.05
CAMERA_MIN_TRACKS, CAMERA_COHERENCE = 3, 0.85
COMPASS = ["E", "NE", "N", "NW", "W", "SW", "S", "SE"]

# Event rules: name, event type, classes, speeds, stationary, approach, recede,
# minimum ms, minimum frames, new, ended, minimum motion confidence, prior.
RULES = [
    ("rule_person_standing", "person_standing", PERSON_CLASSES, None, True, False, False, 0.0, 2, False, False, 0.3, 0.80),
    ("rule_person_walking", "person_walking", PERSON_CLASSES, ["slow", "walking"], None, False, False, 0.0, 2, False, False, 0.3, 0.78),
    ("rule_person_running", "person_running", PERSON_CLASSES, ["fast"], None, False, False, 0.0, 2, False, False, 0.3, 0.88),
    ("rule_person_loitering", "person_loitering", PERSON_CLASSES, None, True, False, False, 5000.0, 0, False, False, 0.3, 0.85),
    ("rule_person_entered", "person_entered_scene", PERSON_CLASSES, None, None, False, False, 0.0, 1, True, False, 0.0, 0.82),
    ("rule_person_left", "person_left_scene", PERSON_CLASSES, None, None, False, False, 0.0, 1, False, True, 0.0, 0.80),
    ("rule_vehicle_approaching", "vehicle_approaching", VEHICLE_CLASSES, None, None, True, False, 0.0, 2, False, False, 0.3, 0.83),
    ("rule_vehicle_receding", "vehicle_receding", VEHICLE_CLASSES, None, None, False, True, 0.0, 2, False, False, 0.3, 0.80),
    ("rule_vehicle_stationary", "vehicle_stationary", VEHICLE_CLASSES, None, True, False, False, 0.0, 2, False, False, 0.3, 0.78),
    ("rule_object_appeared", "object_appeared", TRANSIENT_OBJECT_CLASSES, None, None, False, False, 0.0, 3, True, False, 0.0, 0.68),
    ("rule_object_disappeared", "object_disappeared", TRANSIENT_OBJECT_CLASSES, None, None, False, False, 0.0, 3, False, True, 0.0, 0.65),
]
DEFAULT_RULE_PRIOR = 0.75

# Story roles, terminal types and impossible successions ---------------------
ENTRY_TYPES = ["person_entered_scene", "object_appeared"]
EXIT_TYPES = ["person_left_scene", "object_disappeared"]
ACTION_TYPES = ["person_walking", "person_running", "person_standing", "person_loitering", "vehicle_approaching",
                "vehicle_receding", "vehicle_stationary", "cycling", "running", "walking_upstairs",
                "walking_downstairs"]
COMPAT_VALIDATOR_ACTIONS = ACTION_TYPES[:7]
INVALID_SUCCESSIONS = [
    ("person_left_scene", "person_walking"), ("person_left_scene", "person_running"),
    ("person_left_scene", "person_standing"), ("person_left_scene", "person_loitering"),
    ("object_disappeared", "object_appeared")]
COMPLETENESS_SCORE = {"complete": 1.0, "partial": 0.6, "entry_only": 0.4, "exit_only": 0.4, "minimal": 0.2}

# Rarity priors ---------------------------------------------------------------
RARITY = {
    "person_running": 0.90, "person_loitering": 0.80, "vehicle_approaching": 0.75, "person_entered_scene": 0.62,
    "person_left_scene": 0.62, "person_walking": 0.50, "vehicle_receding": 0.50, "object_appeared": 0.40,
    "object_disappeared": 0.40, "vehicle_stationary": 0.38, "person_standing": 0.30, "scene_activity": 0.25}
DEFAULT_RARITY = 0.50

# Fusion weights: detection, motion, rule, track stability, scene reliability
FUSION_WEIGHTS = {
    "default": (0.30, 0.25, 0.20, 0.15, 0.10),
    "frozen_v1": (0.25, 0.20, 0.25, 0.20, 0.10),
}

# Per-class detection thresholds ----------------------------------------------
CLASS_CONFIDENCE = {
    "person": 0.25, "man": 0.25, "woman": 0.25, "child": 0.22, "bicycle": 0.35, "car": 0.35, "motorcycle": 0.35,
    "laptop": 0.30, "cell phone": 0.25, "phone": 0.25, "bottle": 0.25, "cup": 0.25, "book": 0.25, "backpack": 0.25,
    "handbag": 0.25, "chair": 0.30}
CLASS_CONFIDENCE_DEFAULT = 0.35

# Display categories ------------------------------------------------------------
CATEGORY_MEMBERS = {
    "people": ["person", "man", "woman", "child", "baby", "crowd", "human hand", "face"],
    "furniture": ["chair", "office chair", "sofa", "couch", "bed", "desk", "table", "dining table", "coffee table",
                  "shelf", "bookshelf", "cabinet", "wardrobe", "bench", "stool", "ottoman", "whiteboard"],
    "home": ["curtain", "window blind", "carpet", "rug", "pillow", "cushion", "lamp", "floor lamp", "desk lamp",
             "ceiling light", "light switch", "fan", "ceiling fan", "air conditioner", "clock", "vase", "plant",
             "potted plant", "mirror", "door", "window", "trash can", "toy", "teddy bear"],
    "electronics": ["laptop", "notebook computer", "desktop computer", "monitor", "screen", "television", "tv",
                    "tablet", "ipad", "phone", "smartphone", "mobile phone", "keyboard", "mouse", "remote control",
                    "speaker", "headphones", "earphones", "camera", "webcam", "charger", "projector",
                    "smart watch", "calculator"],
    "drinkware": ["bottle", "water bottle", "glass", "wine glass", "cup", "mug", "coffee mug", "tea cup"],
    "kitchen": ["plate", "bowl", "fork", "knife", "spoon", "kettle", "coffee maker", "microwave"],
    "documents": ["book", "notebook", "folder", "document", "paper"],
    "stationery": ["pen", "pencil", "marker"],
    "bag": ["backpack", "handbag", "purse", "wallet", "suitcase", "briefcase", "shopping bag", "umbrella"],
    "clothing": ["glasses", "sunglasses", "hat", "jacket", "watch"],
    "vehicle": ["car", "truck", "bus", "motorcycle", "bicycle", "scooter"],
    "animal": ["dog", "cat", "bird"],
    "security": ["safe", "vault", "safe box", "security camera", "cctv camera", "padlock", "keycard"],
    "safety": ["fire extinguisher"],
}
# Category of a detector's class number, taken before the names above.
CLASS_ID_CATEGORY = {
    "people": [0],
    "vehicle": [1, 2, 3, 5, 7],
    "outdoor": [9, 10, 11],
    "furniture": [13, 56, 57, 59, 60],
    "animal": [14, 15, 16],
    "bag": [24, 25, 26, 28],
    "clothing": [27],
    "sport": [32, 38],
    "drinkware": [39, 40, 41, 45],
    "utensil": [42, 43, 44],
    "food": [46, 47, 48, 53, 55],
    "home": [58, 74, 75, 76, 77, 78, 79],
    "electronics": [62, 63, 64, 65, 66, 67],
    "documents": [73],
}
# Tried in this order when the class is in no list above.
CATEGORY_KEYWORDS = [
    ("people", ["person", "man", "woman", "child", "human"]),
    ("furniture", ["chair", "desk", "table", "bed", "sofa", "shelf"]),
    ("electronics", ["phone", "laptop", "computer", "screen", "tv", "camera"]),
    ("vehicle", ["car", "truck", "bus", "bike", "vehicle"]),
    ("drinkware", ["bottle", "glass", "cup", "mug", "drink"]),
    ("documents", ["book", "pen", "paper", "document", "folder"]),
    ("bag", ["bag", "backpack", "wallet", "purse"]),
]
CATEGORY_ORDER = {"people": 0, "electronics": 1, "bag": 2, "drinkware": 3, "documents": 4, "clothing": 5}

# Timeline categories -----------------------------------------------------------
TIMELINE_ACTIVITY = [
    "person_entered_scene", "person_left_scene", "person_walking", "person_running", "person_standing",
    "person_sitting", "person_standing_up", "person_loitering", "person_reaching_up", "walking", "running",
    "loitering", "entering_scene", "cycling", "walking_upstairs", "walking_downstairs"]
TIMELINE_LIGHTING = ["light_turned_on", "light_turned_off"]
TIMELINE_INTERACTION = ["person_using_phone", "person_using_laptop", "person_drinking", "person_reading",
                        "person_watching_screen", "person_pocketed_object", "person_at_desk", "person_near_screen"]
ANOMALY_WORDS = ["theft", "stolen", "pocketed", "picked_up", "unattended", "disappeared", "package_left", "tampering"]
STATE_MACHINE_TYPES = ["person_entered_scene", "person_left_scene", "person_walking", "person_standing",
                       "person_sitting", "person_standing_up", "person_running", "person_loitering"]
NARRATIVE_LABELS = ["cycling", "running", "walking_upstairs", "walking_downstairs", "loitering", "walking"]

# Upload rules ---------------------------------------------------------------------
VIDEO_EXTENSIONS = [".mp4", ".avi", ".mov", ".mkv", ".webm"]
VIDEO_CODECS = ["h264", "h265", "hevc", "vp8", "vp9", "av1", "mpeg4", "mpeg2video", "mjpeg", "wmv3", "wmv2"]
MAX_FILE_BYTES = 50 * 1024 ** 3
# name, from seconds, to seconds, estimated processing seconds
DURATION_BANDS = [("Quick Test", 0.0, 120.0, 8.0), ("Short Clip", 120.0, 600.0, 20.0), ("Standard", 600.0, 3600.0, 90.0),
                  ("Long Recording", 3600.0, 21600.0, 600.0), ("Extended Recording", 21600.0, 86400.0, 3600.0),
                  ("Custom", 86400.0, float("inf"), None)]


def one_of(col: Column, values: list[str]) -> Column:
    return col.isin(*values)


def lookup(col: Column, table: dict, default) -> Column:
    """Small literal lookup kept inside codegen."""
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, col), F.lit(default))


def rules_table(spark: SparkSession) -> DataFrame:
    schema = ("rule_name string, event_type string, class_names array<string>, speed_classes array<string>, "
              "require_stationary boolean, require_approach boolean, require_recede boolean, min_length_ms double, "
              "min_frames long, require_new boolean, require_ended boolean, min_motion_confidence double, "
              "rule_confidence double")
    return spark.createDataFrame(RULES, schema)

# Activities, sampling and poses --------------------------------------------------
ACTIVITY_TAILS = {
    "cycling": " is cycling across the scene", "running": " is running", "walking_upstairs": " is walking up stairs",
    "walking_downstairs": " is walking down stairs", "loitering": " is loitering (stationary for >12s)", "walking": " is walking"}
# Name, warm-up frames, largest skip, smoothing, protection threshold and window.
SWEEP_VARIANTS = [
    ("baseline", 25, 10, 0.25, 0.08, 15),
    ("conservative", 10, 8, 0.30, 0.05, 25),
    ("aggressive", 5, 15, 0.20, 0.12, 10),
]
# Minimum supporting frames per state and the event each state maps to.
POSE_MINIMUM = {"CRAWLING": 3, "CROUCHING": 3, "RUNNING": 3, "FALLEN": 2, "SITTING": 8, "WALKING": 2, "STANDING": 1}
POSE_EVENT = {"CRAWLING": "person_crawling", "CROUCHING": "person_crouching_sustained", "FALLEN": "person_falling_likely",
              "RUNNING": "person_running", "SITTING": "person_loitering"}
