"""Values that decide results and therefore have to be exactly these.

FIXED VALUES: word lists, patterns, token formats, thresholds and default
records. Nothing in this file is logic. Patterns use Java syntax because Spark
evaluates them on the JVM.
"""

# --- white space ----------------------------------------------------------
# The code points the text rules treat as white space: tab..CR, FS..US, space,
# NEL, NBSP and the Unicode space separators.
WS_CLASS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{WS_CLASS}]"
NOT_WS = f"[^{WS_CLASS}]"
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- words and sentences --------------------------------------------------
WORD_CHAR = r"[a-z0-9_\p{L}\p{N}]"
# A run of ASCII letters, digits, ' and - (lower case) with a word boundary at
# both ends; the boundaries are spelled out because JVM versions differ on \b.
WORD = (
    rf"(?:[a-z0-9](?<!{WORD_CHAR}.)|['-](?<={WORD_CHAR}.))[a-z0-9'-]*"
    rf"(?:(?<=[a-z0-9])(?!{WORD_CHAR})|(?<=['-])(?={WORD_CHAR}))"
)

# Abbreviations after which the chunker does not end a sentence.
CHUNK_ABBREVIATIONS = [
    "et", "al", "e.g", "i.e", "fig", "vol", "dr", "mr", "ms",
    "prof", "vs", "ca", "approx", "dept", "univ", "ed", "eds",
    "pp", "p", "ref", "refs", "chap", "sec",
]

# Abbreviations whose dots do not end a sentence in the metrics splitter.
METRIC_ABBREVIATIONS = [
    "Dr.", "dr.", "Mr.", "mr.", "Mrs.", "mrs.", "Ms.", "ms.",
    "Prof.", "prof.", "Col.", "col.", "Gen.", "gen.", "Vs.", "vs.",
    "e.g.", "E.g.", "i.e.", "I.e.", "a.m.", "p.m.", "A.M.", "P.M.",
]
# Where texts are split: after the end of a sentence, at blank lines, after a clause.
# Visible ASCII is ruled out first, by one range, and then what precedes; most places need not be asked for more.
SENTENCE_GAP = rf"(?![!-~])(?<=[.!?]){WS}+"
PARAGRAPH_GAP = rf"\n{WS}*\n"
CLAUSE_GAP = rf"(?![!-~])(?<=[,;:—]){WS}+"
# A code fence around a whole answer, reasoning inside one, and the headings of a summary.
FENCE = r"(?s)\A```(?:[a-zA-Z0-9-]*\n)?(.*?)```\z"
THINK = r"(?is)<think>.*?</think>"
SUMMARY_THESIS, SUMMARY_METHODOLOGY, SUMMARY_GLOSSARY = "(?iu)THESIS:", "(?iu)METHODOLOGY:", "(?iu)GLOSSARY:"
METRIC_DOT_MASK = "\u200b"

# --- uniformity score -----------------------------------------------------
BUZZWORDS = [
    "moreover", "furthermore", "tapestry", "testament", "delve",
    "pivotal", "demystify", "underscores", "beacon",
]
BUZZWORD_STRIP = ",.?!"

# --- citations, applied in this order -------------------------------------
_AUTHOR = (
    r"(?:[A-Z\u00C0-\u017E][A-Za-z\u00C0-\u017E\-']*"
    r"(?:\s+(?:&|and)\s+[A-Za-z\u00C0-\u017E\-']+)?"
    r"(?:\s+et\s+al\.?)?)"
    r"[,\s]+(?:19|20)\d{2}[a-z]?"
)
CITATION_PATTERNS = [
    rf"(?U)\({_AUTHOR}\)",
    rf"(?U)\[{_AUTHOR}\]",
    r"(?U)\[\s*\d+(?:(?:\s*[-\u2013\u2014]\s*\d+)|(?:\s*,\s*\d+)+)?\s*\]",
    r"(?![\x00-\x7f])[\u00B9\u00B2\u00B3\u2074-\u2079\u2070]+",
    r"(?i)\[(?:i{1,3}v?|vi{0,3}|ix|x|[a-e])\]",
]
CITATION_TOKEN = "__CITATION_{}__"

# --- mathematics, block patterns before inline patterns -------------------
MATH_BLOCK_PATTERNS = [
    r"(?s)\$\$(?!\$)(.+?)\$\$",
    r"(?s)\\begin\{(equation\*?|align\*?|gather\*?|multline\*?|eqnarray\*?)\}(.+?)\\end\{\1\}",
    r"(?s)\\\[(.+?)\\\]",
]
MATH_INLINE_PATTERNS = [
    r"(?s)\\\((.+?)\\\)",
    r"(?<!\$)\$(?!\$)([^$\n]{1,500})(?<!\$)\$(?!\$)",
]
# What every match of these patterns begins with, in their order.
MATH_BLOCK_SIGNS, MATH_INLINE_SIGNS = ["$$", "\\begin{", "\\["], ["\\(", "$"]
MATH_BLOCK_TOKEN = "__MATH_BLOCK_{}__"
MATH_INLINE_TOKEN = "__MATH_INLINE_{}__"

CITATION_TOKEN_PATTERN = r"__CITATION_\d+__"
MATH_TOKEN_PATTERN = r"__MATH_(?:BLOCK|INLINE)_\d+__"
RESIDUAL_PATTERN = r"__CITATION_[0-9]+__|__MATH_BLOCK_[0-9]+__"
PLACEHOLDER_PATTERN = r"__[A-Z0-9_]+__"

# --- chunk budgets --------------------------------------------------------
TARGET_WORDS, MAX_WORDS = 250, 400          # used by the document jobs
LIBRARY_TARGET_WORDS, LIBRARY_MAX_WORDS = 500, 600
SHIFT_BACK_CHARS = 150

# --- intake limits --------------------------------------------------------
MAX_TEXT_CHARS = 60_000
WARN_TEXT_CHARS = 50_000
MAX_FILE_BYTES = 10 * 1024 * 1024
FILE_SUFFIX, FILE_MAGIC = ".pdf", "%PDF"
MAX_NAME_CHARS, MAX_STEM_CHARS = 60, 80
DEFAULT_NAME = "pasted_text"
CONTEXT_CHARS = 12_000
SNIPPET_CHARS = 80

# --- candidate loop -------------------------------------------------------
MAX_ITERATIONS = 3
EXIT_SCORE = 15.0
DEGRADATION_TOLERANCE = 5.0
STALL_THRESHOLD = 2.0
FAILED_SCORE = 100.0

# --- layout ---------------------------------------------------------------
COORD_MIN, COORD_MAX = -9999.0, 99999.0
PAGE_WIDTH, PAGE_HEIGHT = 595.0, 842.0
BOLD_FLAG, ITALIC_FLAG = 16, 2
HEADING_MAX_CHARS = 100
REDACT_MARGIN = 0.5
BODY_FONT_SIZE = 10.0
LINE_SPACING = 1.2
CHAR_WIDTH_RATIO = 0.38
OVERFLOW_TOLERANCE = 0.15
MIN_FONT_SIZE = 7.0
FIT_STEPS = 10

# --- providers, in failover order, and their default budgets --------------
FAILOVER_SEQUENCE = ["openrouter", "google", "google", "groq", "deepseek"]
DEFAULT_QUOTAS = [
    # provider, daily_limit, used_today, rpm_limit
    ("openrouter", 1_000_000, 0, 20),
    ("google", 1_000_000, 0, 15),
    ("groq", 14_400, 0, 30),
    ("deepseek", 500_000, 0, 60),
]
THROTTLED_STATUSES = [429, 503]

# --- run status -----------------------------------------------------------
RUN_STATUSES = ["running", "completed", "failed"]
RUN_LABELS = {"completed": "Completed", "running": "Processing", "failed": "Failed"}
PROGRESS_NODES = [
    # node, progress state that makes it the active one
    ("ingest", "parsing"),
    ("analysis", "analyzing"),
    ("rewriting", "rewriting"),
    ("reconstruct", "reconstruction"),
    ("assembly", "assembly"),
    ("export", "completed"),
]

# --- structured summaries -------------------------------------------------
SUMMARY_TERMS = 10
SUMMARY_MIN_WORDS, SUMMARY_MAX_WORDS = 150, 250
BULLET_CHARS = "-*•1234567890."

# --- glyph widths (thousandths of the font size), public Adobe AFM core fonts,
# grouped by width; characters outside the groups take DEFAULT_GLYPH_WIDTH.
HELVETICA_WIDTHS = {
    191: "'", 222: "ijl", 260: "|",
    278: " !,./:;I[\\]ftÌÍÎÏìíîï", 333: "()-`r", 334: "{}", 355: '"', 389: "*",
    469: "^", 500: "Jckszvxyçýÿ",
    556: "#$0123456789?L_abdeghnopquàáâãäåèéêëðñòóôõöùúûüþ",
    584: "+<=>~×÷", 611: "FTZßø", 667: "&ABEKPSVXYÀÁÂÃÄÅÈÉÊËÝÞ",
    722: "CDHNRUwÇÐÑÙÚÛÜ", 778: "GOQÒÓÔÕÖØ", 833: "Mm", 889: "%æ",
    944: "W", 1000: "Æ", 1015: "@",
}
HELVETICA_BOLD_WIDTHS = {
    238: "'", 278: " ,./I\\ijlÌÍÎÏìíîï", 280: "|",
    333: "!()-:;[]`ft", 389: "*r{}", 474: '"', 500: "z",
    556: "#$0123456789J_aceksvxyàáâãäåçèéêëýÿ",
    584: "+<=>^~×÷", 611: "?FLTZbdghnopqußðñòóôõöøùúûüþ",
    667: "EPSVXYÈÉÊËÝÞ", 722: "&ABCDHKNRUÀÁÂÃÄÅÇÐÑÙÚÛÜ",
    778: "GOQwÒÓÔÕÖØ", 833: "M", 889: "%mæ", 944: "W", 975: "@", 1000: "Æ",
}
DEFAULT_GLYPH_WIDTH = 556
HELVETICA_SPACE = 278  # the same in both weights
