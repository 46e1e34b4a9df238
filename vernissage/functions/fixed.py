"""Vocabularies, patterns and constants that results depend on."""

# Class index -> medium, in label order.
MEDIA = (
    "acrylic",
    "ink",
    "oil on canvas",
    "oil on panel",
    "oil on wood",
    "print",
    "tempera",
    "watercolor",
)
N_CLASSES = len(MEDIA)

# Group 1 is the medium the caption names.
CAPTION_PATTERN = r"(?iU)A\s+([a-zA-Z ]+?)\s+artwork titled"

# "<width> x <height>" anywhere in the dimension text.
DIMENSION_PATTERN = r"(?U)(\d+(?:\.\d+)?)\s*[x×]\s*(\d+(?:\.\d+)?)"

# Text that counts as a number; anything else coerces to null.
NUMBER_PATTERN = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"

# Terms looked up as plain substrings of the joined text fields.
KEYWORDS = (
    "oil", "acrylic", "tempera", "watercolor", "gouache", "pencil", "graphite",
    "pen", "ink", "chalk", "wash", "charcoal", "etching", "woodcut", "lithograph",
    "engraving", "brushstroke", "painted", "layered", "impasto", "etched", "plate",
    "engraved", "printed", "transparent", "paper", "gold ground", "gilded",
    "egg tempera", "calligraphic",
)

TEXT_FIELDS = ("t", "txt", "tag", "note", "inscription", "creditline", "assistivetext")
RARE_FIELDS = (
    "volume", "eff", "subclassification", "watermarks", "markings",
    "portfolio", "series", "note", "tag", "txt",
)
CATEGORY_FIELDS = (
    "classification", "visualbrowserclassification", "departmentabbr",
    "viewtype", "element", "dimensiontype",
)
CLASSIFICATIONS = ("Painting", "Drawing", "Print", "Photograph")
MISSING_CATEGORY = "MISSING"
MISSING_NUMBER = -9999.0

# Half-open year ranges [low, high).
ERAS = (
    ("is_pre_1500", None, 1500),
    ("is_1500_1700", 1500, 1700),
    ("is_1700_1850", 1700, 1850),
    ("is_1850_1940", 1850, 1940),
    ("is_post_1940", 1940, None),
)
ACRYLIC_FROM = 1940

# Output flag -> text searched in the lower-cased dimension field.
DIMENSION_TERMS = (
    ("has_frame", "framed"),
    ("has_sheet", "sheet"),
    ("has_image_dim", "image:"),
    ("has_plate_dim", "plate:"),
    ("has_mount", "mount"),
)
TINY_AREA_CM2 = 100
HUGE_AREA_CM2 = 10000

TOP_CATEGORY_TOKENS = 30
TOKEN_NAME_LENGTH = 30

# Columns that never reach a model.
NOT_FEATURES = (
    "y", "_concat_text", "cap", "cap_med", "dim", "provenancetext", "inscription",
    "markings", "creditline", "acc_id", "id", "Unnamed: 0", "t", "txt", "tag", "note",
    "assistivetext", "wikidataid", "customprinturl", "label", "uuid", "iiifurl",
    "iiifthumburl", "dt", "ts", "loc", "parentid", "isvirtual",
    "lastdetectedmodification", "created", "modified", "depictstmsobjectid",
    "sequence", "maxpixels", "attributioninverted", "subclassification",
    "portfolio", "series", "volume", "watermarks", "dimension", "tp", "ord", "eff",
    "img", "attribution", "cat", "y0", "y1", "acc", "wd_materials",
)

# Material category -> label fragments that set it.
MATERIAL_FRAGMENTS = {
    "oil": ("oil paint", "linseed oil"),
    "oil_canvas": ("oil on canvas",),
    "oil_panel": ("oil on panel",),
    "oil_wood": ("oil on wood",),
    "canvas_support": ("canvas", "transferred to canvas", "transferred on canvas"),
    "panel_support": ("panel",),
    "wood_support": ("wood", "poplar", "oak", "walnut"),
    "metal_support": ("copper",),
    "watercolor": (
        "watercolor paint", "watercolour", "gouache paint", "gouache", "watercolor",
    ),
    "ink_mat": (
        "ink", "india ink", "chinese ink", "black ink", "iron gall ink", "pen", "quill",
    ),
    "print_mat": (
        "etching", "engraving", "lithography", "woodcut", "aquatint", "drypoint",
        "intaglio", "mezzotint", "screenprint", "linocut", "lithograph",
    ),
    "tempera_mat": ("tempera", "egg tempera", "distemper"),
    "acrylic_mat": ("acrylic paint", "acrylic"),
    "paper_support": ("paper", "wove paper", "laid paper", "vellum", "parchment"),
    "graphite": ("graphite", "pencil"),
    "chalk": ("chalk", "black chalk", "red chalk"),
    "charcoal": ("charcoal",),
    "gold": ("gold leaf", "gold"),
}
# Categories published as wd_* columns, in output order.
MATERIAL_FLAGS = (
    "oil", "canvas_support", "panel_support", "wood_support", "watercolor",
    "acrylic_mat", "tempera_mat", "print_mat", "ink_mat", "paper_support",
    "graphite", "chalk", "gold", "charcoal",
)

# Gray = (299 r + 587 g + 114 b) / 1000; kept in thousandths so sums stay whole.
GRAY_WEIGHTS = (299, 587, 114)
IMAGE_SIDE = 64
GRAY_PERCENTILES = (10, 25, 50, 75, 90)
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)

NGRAM_SIZES = (3, 4, 5)
MAX_NGRAMS = 3000
# Characters that separate words (Unicode white space).
WORD_GAP = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)

N_FOLDS = 5
BLEND_SEEDS = (42, 7, 123)
WIDE_BLEND_SEEDS = (42, 7, 123, 13, 99)
OVERRIDE_CONFIDENCE = 0.85
REFIT_FACTOR = 1.05
LOOKUP_BATCH = 80

# Meta-model inputs besides the base probabilities and the caption flags.
META_FEATURES = (
    "y0_f", "has_frame", "has_sheet", "has_inscription", "dim_area", "century",
    "anachronism_acrylic",
)

# Field text a CSV scan takes as null.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
