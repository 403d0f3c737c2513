"""Fixed values of the detection domain. Results depend on them; they are data, not code."""

from __future__ import annotations

CLASS_NAMES = ["face", "person", "vehicle", "text_or_logo", "crane", "container", "scaffolding", "material_stack"]
CLASS_IDS = {name: i for i, name in enumerate(CLASS_NAMES)}

# fixed values: least confidence, least area in pixels
MIN_CONFIDENCE = {"face": 0.15, "person": 0.20, "vehicle": 0.36, "text_or_logo": 0.25, "crane": 0.35, "container": 0.35, "scaffolding": 0.30, "material_stack": 0.225}
DEFAULT_MIN_CONFIDENCE = 0.20
MIN_AREA = {"face": 100.0, "text_or_logo": 100.0}
DEFAULT_MIN_AREA = 400.0
MAX_ASPECT_RATIO = 6.0
DEGENERATE_ASPECT = 999.0

# fixed values: class numbers of the common-objects detector
COCO_CLASSES = {0: "person", 1: "vehicle", 2: "vehicle", 7: "vehicle"}
COCO_CLASSES_MODULE = {0: "person", 2: "vehicle", 3: "vehicle", 5: "vehicle", 7: "vehicle"}
SCORER_VEHICLES = (2, 3, 5, 7)

# fixed values: phrases of the grounded detector by class, in the order that breaks ties of equal length
PHRASES: list[tuple[str, str]] = [
    ("human head", "face"), ("person's head", "face"), ("worker head", "face"), ("head", "face"),
    ("excavator", "vehicle"), ("bicycle", "vehicle"), ("truck", "vehicle"), ("car", "vehicle"),
    ("information board", "text_or_logo"), ("license plate", "text_or_logo"), ("number plate", "text_or_logo"),
    ("company name", "text_or_logo"), ("warning sign", "text_or_logo"), ("safety sign", "text_or_logo"),
    ("brand name", "text_or_logo"), ("nameplate", "text_or_logo"), ("banner", "text_or_logo"), ("sticker", "text_or_logo"),
    ("poster", "text_or_logo"), ("label", "text_or_logo"), ("sign", "text_or_logo"), ("logo", "text_or_logo"), ("text", "text_or_logo"),
    ("shipping container", "container"), ("container", "container"), ("portable office container", "container"),
    ("large portable office container", "container"), ("large storage container", "container"),
    ("construction site container", "container"), ("portable cabin", "container"), ("storage container", "container"),
    ("tower crane", "crane"), ("crane", "crane"), ("scaffolding", "scaffolding"), ("scaffold", "scaffolding"),
    ("building materials", "material_stack"), ("material stack", "material_stack"), ("stacked wood planks", "material_stack"),
    ("stacked lumber", "material_stack"), ("pile of wooden boards", "material_stack"), ("stacked iron pipes", "material_stack"),
    ("stacked metal tubes", "material_stack"), ("pile of bricks", "material_stack"), ("pallet of concrete blocks", "material_stack"),
    ("stacked building materials on pallets", "material_stack"),
    ("van", "vehicle"), ("concrete mixer", "vehicle"), ("concrete mixer truck", "vehicle"), ("dump truck", "vehicle"),
    ("forklift", "vehicle"), ("delivery truck", "vehicle"), ("flatbed truck", "vehicle"),
    ("company logo", "text_or_logo"), ("construction company sign", "text_or_logo"), ("company logo on vehicle", "text_or_logo"),
    ("company logo on container", "text_or_logo"), ("text on fence", "text_or_logo"), ("text on banner", "text_or_logo"),
    ("pile of wood", "material_stack"), ("stacked pipes", "material_stack"), ("stacked bricks", "material_stack"),
    ("pile of construction materials", "material_stack"), ("pallets with materials", "material_stack"), ("stacked wood", "material_stack"),
    ("wooden boards", "material_stack"), ("iron pipes", "material_stack"), ("metal tubes", "material_stack"), ("concrete blocks", "material_stack"),
]

# fixed values: the older phrase table, matched in this order in either direction
MODULE_PHRASES: list[tuple[str, str]] = [
    ("human face", "face"), ("head with helmet", "face"), ("face with safety helmet", "face"), ("person", "person"), ("worker", "person"),
    ("construction worker", "person"), ("pedestrian", "person"), ("vehicle", "vehicle"), ("car", "vehicle"), ("truck", "vehicle"),
    ("excavator", "vehicle"), ("forklift", "vehicle"), ("concrete mixer", "vehicle"), ("text", "text_or_logo"), ("sign", "text_or_logo"),
    ("logo", "text_or_logo"), ("license plate", "text_or_logo"), ("crane", "crane"), ("tower crane", "crane"),
    ("shipping container", "container"), ("site container", "container"), ("scaffolding", "scaffolding"), ("scaffold", "scaffolding"),
    ("material stack", "material_stack"), ("building materials", "material_stack"),
]
MODULE_PHRASE_DEFAULT = "person"

# fixed values: what a text or logo holds, by phrase
CONTENT_TYPES: list[tuple[str, str]] = [
    ("license plate", "license_plate"), ("number plate", "license_plate"), ("plate", "license_plate"),
    ("safety sign", "safety_sign"), ("warning sign", "safety_sign"), ("warning", "safety_sign"),
    ("logo", "company_name"), ("company", "company_name"), ("company name", "company_name"), ("brand", "company_name"),
    ("brand name", "company_name"), ("nameplate", "company_name"),
    ("sign", "other"), ("banner", "other"), ("label", "other"), ("sticker", "other"), ("text", "other"), ("information board", "other"), ("poster", "other"),
]
LOGO_PHRASES = ["logo", "company", "company name", "brand", "brand name", "banner", "nameplate"]

# fixed values: open-vocabulary names, first group that matches
OPEN_VOCABULARY: list[tuple[str, list[str]]] = [
    ("text_or_logo", ["sign", "logo", "text", "license", "banner", "brand", "sticker", "board", "warning", "number plate", "company"]),
    ("crane", ["crane"]),
    ("scaffolding", ["scaffold"]),
    ("container", ["container"]),
    ("material_stack", ["material", "pile", "stacked", "concrete", "pallet"]),
]

ALLOWED_CONTAINMENT = [("person", "face"), ("person", "text_or_logo"), ("vehicle", "text_or_logo")]
DEFAULT_EXCLUSION = {"setup_1": (0.25, 0.0, 0.0), "setup_2": (0.25, 0.0, 0.0)}  # top, right, bottom
EXCLUSION_CLASSES = ["face", "text_or_logo"]

PRIVACY_WEIGHTS = {"face": 0.40, "person": 0.30, "vehicle": 0.10, "text_or_logo": 0.10}
PRIVACY_TARGET = 0.80
RECALL_FLOORS = {"face": 0.50, "person": 0.70}

# fixed values: least brightness, greatest brightness, contrast, sharpness, edge density
QUALITY_PROFILES = {"strict": (50.0, 230.0, 25.0, 200.0, 0.02), "lenient": (30.0, 250.0, 15.0, 50.0, 0.01), "config": (30.0, 250.0, 25.0, 50.0, 0.02)}
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "bmp", "tiff", "tif"]
ANNOTATED_EXTENSIONS = ["jpg", "jpeg", "png", "bmp"]

# fixed values: detector confidences, prompt groups with box and text thresholds
DETECTOR_CONFIDENCE = {"coco": 0.25, "face": 0.10, "open_vocabulary": 0.15, "ppe": 0.10, "rescue": 0.05, "module_coco": 0.35}
PROMPT_THRESHOLDS = {"vehicle": (0.25, 0.20), "text": (0.25, 0.20), "construction": (0.25, 0.20), "head": (0.40, 0.35)}

#: Zero-shot tasks: labels in the order that breaks ties, and the least score. Fixed values.
ZERO_SHOT_TASKS = {
    "helmet": (["yes", "no"], 0.21), "vest": (["yes", "no"], 0.20),
    "posture": (["standing", "walking", "crouching", "sitting", "climbing", "carrying", "operating"], 0.20),
    "face_rescue": (["face_visible", "no_face"], 0.20), "plate_rescue": (["plate", "no_plate"], 0.22),
    "vehicle_type": (["car", "truck", "excavator", "bicycle"], 0.22), "ownership": (["construction", "public", "delivery"], 0.22),
    "content_type": (["company_name", "license_plate", "safety_sign"], 0.22), "visibility": (["clear", "partial", "occluded"], 0.20),
    "verify": (["positive", "negative"], 0.20),
}
#: A "yes" needs more than this. Fixed values.
YES_ABOVE = {"helmet": 0.22, "vest": 0.21}
VERIFIED_CLASSES = {"vehicle": 10.0, "material_stack": 10.0, "text_or_logo": 5.0, "container": 10.0}  # crop padding
