"""The word lists behind text evidence, stated as they are used."""

STOP_TOKENS = [
    "a", "an", "and", "are", "as", "be", "by", "defect", "defective", "good", "in", "is", "it", "normal", "of", "on",
    "only", "or", "the", "there", "to", "with",
]

WEAK_TOKENS = [
    "body", "color", "component", "core", "inner", "insulation", "layer", "material", "object", "outer", "part",
    "ring", "surface",
]

SPELLING = {
    "colour": "color",
    "coloured": "color",
    "colours": "color",
    "fibre": "fiber",
    "fibres": "fiber",
    "remov": "remove",
}

# Visual failure modes and the words that express them.
ATTRIBUTES = {
    "shape_deformation": [
        "bend", "bent", "buckl", "collapsed", "collaps", "concave", "dent", "deform", "deformation", "deformity",
        "distort", "distortion", "flat", "flatten", "geometry", "contour", "outline", "misalign", "misshapen",
        "shape", "symmet", "symmetry", "symmetric", "symmetrical", "asymmet", "asymmetry", "asymmetric",
        "asymmetrical", "warp",
    ],
    "material_split": [
        "break", "broken", "crack", "fissure", "fracture", "jagged", "rupture", "separation", "split", "tear",
    ],
    "material_cut_or_exposure": ["cut", "expos", "expose", "exposure", "reveal", "remove", "scrape", "slice", "slit"],
    "surface_abrasion": ["abrasion", "line", "linear", "matte", "scratch", "scuff", "thin"],
    "hole_or_puncture": [
        "circular", "dot", "gap", "hole", "indent", "penetration", "poke", "puncture", "round", "void",
    ],
    "absence_or_missing": [
        "absence", "absent", "blank", "empty", "gap", "gone", "hollow", "lack", "miss", "missing", "sparse", "void",
    ],
    "color_or_marking": [
        "blemish", "chipped", "code", "discolor", "faded", "font", "identifier", "imprint", "ink", "print", "stain",
        "text",
    ],
    "exposed_material_contrast": ["contrast", "highlight", "inner", "light", "lighter", "reveal"],
    "fiber_or_thread": ["fabric", "fiber", "fuzzy", "string", "thread", "weav", "weave", "woven"],
    "foreign_metal": ["contamination", "foreign", "hard", "metal", "metallic", "rigid", "shiny"],
    "color_layout_mismatch": ["coding", "incorrect", "mapping", "mismatch", "position", "swap", "wrong"],
}

SURFACE_TERMS = [
    "cut", "edge", "irregular", "layer", "lighter", "natural", "scrape", "seam", "separ", "separation", "shallow",
    "shell", "surface", "texture",
]

DECISIVE_TERMS = [
    "absence", "absent", "broken", "contamination", "crack", "deep", "foreign", "fracture", "hole", "ink", "metal",
    "missing", "print", "puncture", "rupture", "split", "structural", "tear", "void",
]

NEGATIONS = ["no", "not", "without", "absent", "absence", "neither", "nor"]
RESETS = ["and", "but", "however", "although", "though", "except"]
BENIGN_HOLE_WORDS = ["board", "hole", "holes", "insert", "inserted", "seat", "seated", "solder", "soldered"]
EXTRA_ANOMALY_WORDS = ["abnormal", "anomaly", "damage", "damaged", "defect", "defective"]

NORMAL_PHRASES = [
    r"\bnormal\b",
    r"\bno\s+(?:logical\s+)?defects?\b",
    r"\bno\s+(?:visible\s+)?defects?\b",
    r"\bno\s+defects?\s+detected\b",
    r"\bno\s+(?:visible\s+)?anomal(?:y|ies)\b",
    r"\bwithout\s+(?:any\s+)?(?:visible\s+)?(?:defects?|anomal(?:y|ies))\b",
    r"\bmatches?\s+(?:the\s+)?normal\s+standard\b",
    r"\bmatching\s+(?:the\s+)?normal\b",
    r"\bnormal\s+standard\b",
    r"\bglobal\s+status\s*:\s*normal\b",
]

LOCATION_PATTERNS = {
    "left": r"\bleft\b",
    "right": r"\bright\b",
    "top": r"\btop\b|\bupper\b",
    "bottom": r"\bbottom\b|\blower\b",
    "center": r"\bcenter\b|\bcentre\b|\bcentral\b|\bmiddle\b",
    "slightly": r"\bslight(?:ly)?\b|\boff center\b|\boff-center\b",
    "corner": r"\bcorner\b",
}

GROUNDING_MARKERS = [
    "defect classification",
    "defect description",
    "defect analysis",
    "type of the defect",
    "appearance of the defect",
    "effect does the defect",
    "how does the defect affect",
]
