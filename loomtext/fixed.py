"""They have to equal the ones the results are compared with."""

# fixed values: characters rewritten before speech, applied in this order
SPEECH_CHARACTERS = [
    ("\u201c", '"'),  # left double quotation mark
    ("\u201d", '"'),  # right double quotation mark
    ("\u2018", "'"),  # left single quotation mark
    ("\u2019", "'"),  # right single quotation mark
    ("\u2026", "..."),  # ellipsis
    ("%", "-percent"),
    ("\u2014", ";"),  # em dash
    ("\u2013", "-"),  # en dash
    ("\u00a0", " "),  # no-break space
    ("\u00ad", ""),  # soft hyphen
    ("\u200b", ""),  # zero-width space
    ("\u200c", ""),  # zero-width non-joiner
    ("\u200d", ""),  # zero-width joiner
    ("\u2032", " feet"),  # prime
    ("\u2033", " inches"),  # double prime
    ("\u2192", " to "),  # rightwards arrow
    ("|", ","),
]

# fixed values: spoken forms of acronyms, applied in this order
ACRONYMS = [
    ("exp", "E-X-P"),
    ("mps", "M-P-S"),
    ("hps", "H-P-S"),
    ("mp/s", "M-P-S"),
    ("hp/s", "H-P-S"),
]

# fixed values: title characters, applied in this order
TITLE_CHARACTERS = [
    ("\u00a0", " "),
    ("´", "'"),
    ("ä", "ae"),
    ("á", "aa"),
    (" \u0301", "'"),
    ("ā", "aa"),
    ("é", "e"),
    ("ö", "oo"),
    ("ū", "uu"),
    ('"', "'"),
    ("…", "..."),
    ("—", "-"),
    ("–", "-"),
    ("’", "'"),
    ("‘", "'"),
    ("`", "'"),
    ("“", "'"),
    ("”", "'"),
    ("\t", " "),
    ("~", "-"),
    (":", ""),
    ("û", "uu"),
    ("ú", "uu"),
    ("ü", "uu"),
    ("ô", "oo"),
    ("ó", "oo"),
    ("ò", "oo"),
    ("ñ", "nn"),
    ("í", "ii"),
    ("ì", "ii"),
    ("î", "ii"),
    ("ç", "c"),
    ("ß", "ss"),
    ("ð", "th"),
    ("æ", "ae"),
    ("œ", "oe"),
]

# fixed values: site suffixes of a page title and the characters a file name may not hold
TITLE_SITE_SUFFIX = "Royal Road"
UNSAFE_FILE_CHARACTERS = r'[\\/:*?"<>|]'

# fixed values: source names by host substring
SOURCE_HOSTS = [("royalroad.com", "royalroad"), ("scribblehub.com", "scribblehub")]

# fixed values: limits
CHUNK_CHARS_LARGE = 750
CHUNK_CHARS_SMALL = 250
BATCH_SIZE = 5
MIN_CHUNK_SECONDS = 15.0
SECONDS_PER_CHAR = 0.3
MIN_WORK_SECONDS = 60.0
CODEC_FRAMES_PER_SECOND = 12
MAX_ATTEMPTS = 10
MISSING_INDEX = 999999
KEEP_LOG_LINES = 500
KEEP_EVENTS = 1000
KEEP_JOBS = 20
LOG_LOOKBACK = 30
DEFAULT_VOICE = "onyx"
STATUSES = ["pending", "processing", "done", "failed"]

# fixed values: job labels
JOB_LABELS = {
    "full_pipeline": "Full Pipeline",
    "scrape_all": "Scrape All",
    "scrape_series": "Scrape",
    "generate_series": "Generate",
    "regenerate_chapter": "Regenerate",
    "rescrape_chapter": "Rescrape",
}
SCRAPE_JOBS = ["scrape_all", "scrape_series", "rescrape_chapter"]

# fixed values: log line shapes
LOG_SERIES = r"^\[(\d+)/(\d+)\](?U:\s)+(Scraping|Generating)(?U:\s)+(.+)$"
LOG_QUEUE = r"^\[queue\](?U:\s)*(.*)$"
LOG_STEP = r"^(Merged!|Saved!|Converted to MP3!)$"
LOG_WARN = r"(?i)^(Chunk too long|Warning:)"
LOG_ERROR = (
    r"(?i)^(Error on|Error merging|Error converting|Error applying|Error adjusting|Timed out|"
    r"Skipping chapter|Problem text:|An unexpected error|Traceback|NetworkError)"
)
LOG_ERROR_ANYWHERE = r"(?i)TTS produced garbled audio|share unreachable|No such file or directory|disk I/O error"

# fixed values: Windows codes of a lost network share
NETWORK_CODES = [53, 64, 67, 1231]

# Which page elements are spoken by another voice, by kind. Elements are named by tag or by a chain of tags
# from the outside in, with words of their style; texts by a pattern, of which the first group that is there is spoken.
VOICE_RULES = {
    "table": {"tags": ("table tbody",), "form": "lines", "breaks": " "},
    "center": {"tags": ("p",), "style": "text-align: center", "form": "lines"},
    "bold": {"tags": ("strong", "b"), "form": "flat"},
    "italic": {"tags": ("em",), "form": "flat"},
    "blockquote": {"tags": ("blockquote",), "form": "flat"},
    "bracket": {"pattern": r"\A\[([^\[\]]*)\]\n?\Z"},
    "angle": {"pattern": r"<<([^<>]+)>>|<([^<>]+)>"},
}
SYSTEM_SPEAKER, STRESSED_SPEAKER, STRESSED_TAGS = "system", "fable", ("em", "i")

# Elements that become plain text before that: tags, words of their style, the text in their place or None
# for their own
PLAIN_EDITS = ((("em", "span"), "font-weight: 400", None), (("hr",), None, "\n\n"))
