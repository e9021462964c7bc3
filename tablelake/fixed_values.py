"""They must stay exactly as they are for results to match."""

# ---- typed exports -------------------------------------------------------
# Source type name -> Spark SQL type.
SOURCE_TYPES = {
    "Text": "string",
    "Memo/Hyperlink": "string",
    "GUID": "string",
    "Replication ID": "string",
    "Boolean": "boolean",
    "Byte": "smallint",
    "Integer": "int",
    "Long Integer": "int",
    "Single": "float",
    "Double": "double",
    "Float": "double",
    "Currency": "decimal(19,4)",
    "Numeric": "double",
    "Decimal": "double",
    "DateTime": "timestamp_ntz",
    "DateTime (Short)": "timestamp_ntz",
    "OLE": "binary",
    "Binary": "binary",
}
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
CATALOG_KINDS = ("tables", "valuesets", "sectiontable", "filenames", "vartable", "newvariables")
EXCLUDED_PREFIXES = ("DRV", "DFR")
MIN_CATALOG_YEAR, MAX_CATALOG_YEAR = 2000, 2100

# ---- SQL surface ---------------------------------------------------------
MAX_ROWS = 500
REFUSED = "Error: Only SELECT or WITH (CTE) statements are allowed."
SQL_ERROR = "SQL Error: {problem}"
NO_ROWS = "Query executed successfully, but returned no rows."
TRUNCATED = ("\n\n[Truncated: only the first {cap} rows are shown. "
             "Refine the query with LIMIT, filters, or aggregation.]")
NO_VALUE_SET = ("No value set found for column {var!r} in table {table!r} (year {year}). "
                "The column may be continuous or the name may differ.")
VALUE_SET_HEAD = "Value set for {table}.{var} (year {year}):"
VALUE_SET_LINE = "  %s — %s"

# ---- report tables -------------------------------------------------------
MISSING_MARKERS = ("†", "‡", "#", "—", "–", "-", "---", "(†)", "(‡)", "!")
NOTE_PREFIX = r"^\s*(NOTE|SOURCE|†|‡|#|—|\*|\d+\s)"
HEADER_SCAN_ROWS = 12
PLACEHOLDER_COLUMN = r"^col_\d+$"
SURVEY_PATTERNS = {
    "IPEDS": r"IPEDS|Integrated Postsecondary",
    "NPSAS": r"NPSAS|National Postsecondary Student Aid",
    "HSLS": r"HSLS",
    "BPS": r"BPS:",
    "B&B": r"B&B",
    "CPS": r"Current Population Survey",
    "Census": r"Census Bureau",
    "Projections": r"Projections of Education",
    "NSOPF": r"NSOPF|National Study of Postsecondary Faculty",
    "SASS": r"Schools and Staffing Survey|SASS",
    "OpenDoors": r"Open Doors|Institute of International Education",
    "NSF": r"National Science Foundation",
    "SED": r"Survey of Earned Doctorates",
    "NSDUH": r"National Survey on Drug Use and Health",
    "PulseSurvey": r"Household Pulse Survey",
    "MLA": r"Modern Language Association",
    "FSA": r"Office of Federal Student Aid",
}
TARGET_SURVEY = "IPEDS"
YEAR_PATTERN = r"\b((?:19|20)\d{2})(?:\s*-\s*(?:\d{2}|\d{4}))?\b"
YEAR_MIN, YEAR_MAX = 2004, 2023
MIN_ROW_YEAR_LABELS = 3
LINK_PATH_PREFIX = "programs/digest/"
TABLE_LINK = r"/?d(\d{2})/tables/dt\d{2}_([\d.]+?)\.asp"

# ---- questions -----------------------------------------------------------
TOLERANCE = 0.01
RANK_MARGIN = 0.02
QUOTAS = {"lookup": 400, "rank": 100}
PER_TABLE_CAP = 5
CANDIDATES_PER_TABLE = 10
MIN_RANK_OPTIONS, MAX_RANK_OPTIONS = 3, 5
QUALIFIER_THRESHOLD = 0.7
PARAPHRASE_ATTEMPTS = 2
TOTAL_LABEL = r"^\s*(total|all\b|subtotal|united states|u\.?s\.?\b|50 states|national\b)"
YEAR_LABEL = r"^\s*(?:19|20)\d{2}(?:\s*-\s*(?:\d{2}|\d{4}))?\s*$"
STOPWORDS = (
    "and", "the", "for", "with", "from", "that", "this", "was", "were", "are",
    "of", "in", "by", "to", "or", "a", "an", "as", "at", "on", "its",
)
NUMBER_TOKEN = r"-?\d[\d,]*(?:\.\d+)?"
ID_PREFIX = "digest_"
QUESTION_LEAD = "In NCES data on "
RANK_QUESTION_TYPE = "rank (multiple choice, ask which option is highest)"
SLUG_LENGTH = 24
PHRASED_BY_TEMPLATE, PHRASED_BY_FUNCTION = "template", "llm"
