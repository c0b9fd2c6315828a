"""Fixed values that results depend on: word lists, patterns and constants, stated as they are.

Patterns are written for Java's regular expressions; (?i) and (?m) stand in front where case or
line ends matter.
"""

# Retrieval.
TOP_K_DENSE = 20
TOP_K_SPARSE = 20
TOP_K_QA = 5
TOP_K_FINAL = 5
MIN_RAW_IN_FINAL = 3
QA_RELEVANCE_FLOOR = 0.35
NEGATIVE_GATE = 0.3
DENSE_WEIGHT, SPARSE_WEIGHT = 0.6, 0.4
HYBRID_WEIGHT, RERANK_WEIGHT = 0.35, 0.65
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
SOURCE_BOOST = {
    "general_overview": {"website": 0.08, "pdf": -0.03},
    "topic_specific": {"website": 0.0, "pdf": 0.04},
    "project_initiative": {"website": 0.04, "pdf": 0.04},
    "publication_finding": {"website": -0.04, "pdf": 0.10},
    "synthesis": {"website": 0.04, "pdf": 0.04},
    "no_evidence": {"website": 0.0, "pdf": 0.0},
}
DEFAULT_INTENT = "topic_specific"
ONE_QA_INTENTS = ["publication_finding", "topic_specific"]

# Filters.
USELESS = [
    r"(?i)^(table of contents|acknowledgments?|references?|bibliography|copyright)",
    r"(?i)^\s*page\s+\d+\s*$",
    r"(?i)^(list of figures|list of tables|appendix\s+[a-z])",
]
REFUSAL = [
    r"(?i)could not find clearly supported",
    r"(?i)no relevant \w+ work found",
    r"(?i)not enough evidence to answer",
    r"(?i)current corpus (does not|doesn.t) contain",
    r"(?i)no clearly supported \w+",
    r"(?i)i was unable to find",
    r"(?i)there is no( specific| direct| clear)? (evidence|information|documentation)",
]

# Document types.
SCHOLARLY = [
    r"\babstract\b", r"\bintroduction\b", r"\breferences\b", r"\bmethods?\b", r"\bresults?\b", r"\bdiscussion\b", r"\bconclusion\b",
    r"\bdoi:\s*10\.", r"\barxiv:", r"\bjournal of\b", r"\bproceedings of\b",
]
INSTITUTE = [
    r"\bannual report\b", r"\bimpact report\b", r"\bour mission\b", r"\bour team\b", r"\bwho we are\b", r"\bstrategic plan\b",
    r"\bdonor\b", r"\bboard of directors\b",
]
REPORT_WORDS = ["report", "brief", "summary", "executive", "white paper", "policy", "recommendations", "assessment", "feasibility"]

# Chunk sizes.
MAX_CHUNK_CHARS, MAX_SENTENCES, OVERLAP_SENTENCES = 700, 5, 2
AGENT_CHUNK_CHARS = 800
STOP_WORDS = "the a an and or for of in on at to from with by is are was were be been being as it this that these those".split()

# Chunk types by keyword, first match first.
WEB_BIOGRAPHY = ["biography", "bio:", "area of expertise", "degrees", "ph.d"]
WEB_PUBLICATION = ["publication", "journal", "book chapter", "refereed"]
WEB_PROJECT = ["project", "initiative", "program", "funded by"]
WEB_EVENT = ["event", "forum", "workshop", "lecture"]

# Lines of the first pages of papers that say nothing.
PREAMBLE_SKIP = [
    r"(?i)^(Authors?|Citation|Received|Revised|Accepted|Published):?\s*$",
    r"(?i)^Copyright:?\s",
    r"(?i)^Licensee\s+MDPI",
    r"(?i)^Academic\s+Editor",
    r"(?i)^\*\s*Correspondence",
    r"(?i)^https?://",
    r"(?i)^open access article",
    r"(?i)^This article is an? open access",
]
HEADINGS = [
    "table of contents", "about", "executive summary", "introduction", "background", "methodology", "methods", "results", "discussion",
    "conclusion", "conclusions", "recommendations", "acknowledgments", "acknowledgements", "appendix", "references", "bibliography",
    "glossary", "thank you", "who we are", "meet our team", "mission", "core", "partnerships highlights", "new initiatives",
    "publications", "research highlight", "upcoming research releases", "students", "recognitions", "events", "summary",
]
TABLE_LABEL = r"(?i)^\s*Table\s+(\d+)\.\s*(.*?)$"
FIGURE_LABEL = r"(?i)^\s*(?:Figure|Fig\.?)\s+(\d+)\.\s*(.*?)$"
NUMBERED_HEADING = r"^(\d+(?:\.\d+)*)\.?\s+([A-Z][A-Za-z,\s:&/'–\-]{3,80})$"
# Where a bibliography begins: a number alone before a line that starts with an author, or both on one line.
ENTRY_NUMBER, ENTRY_AUTHOR, ENTRY_LINE = r"^\s*(\d+)\.\s*$", r"^\s*[A-Z][a-z]+,\s+[A-Z]", r"^\d+\.\s+[A-Z][a-z]+,\s+[A-Z]"
REFERENCE_SIGNALS = r"(?im)\[CrossRef\]|\[PubMed\]|doi\.org|Available\s+online:?\s+http|ISBN\s+\d|Accessed\s+on\s+\d|^\s*\d+\.\s*$"
SCRAPE_NOISE = ["honeypot link", "Current Students", "Parents & Families", "Faculty & Staff", "Alumni", "Skip to Main Content"]
NOISE_TAGS = ["nav", "header", "footer", "aside", "script", "style", "noscript", "form"]
# Elements that are no content: tags, roles, and parts of attributes in any case; for sections and for the text of a page.
NOISE_ROLES = ["navigation"]
SECTION_NOISE = {"aria-label": ["cookie"], "class": ["cookie", "banner", "newsletter"], "id": ["cookie"]}
TEXT_NOISE = {"aria-label": ["cookie"], "class": ["cookie"], "id": ["cookie"]}
# Where the content of a page stands, first found first.
SECTION_CONTAINERS = ["main", "article", "body"]
TEXT_CONTAINERS = ["main", "[role=main]", "article", "#content", "#main", ".main-content", "body"]

# Blocks, by characters: the least of a preamble or page, and of a block under a marker.
LEAST_PREAMBLE, LEAST_BLOCK, LEAST_CONDENSED = 31, 15, 30
MIN_CHUNK_CHARS, HARD_MIN_CHARS = 120, 200

# Headings of reports.
INSTITUTE_HEADING = r"(?im)^\s*(?:\d+(?:\.\d+)*\s+.{3,80}|(?:[A-Z][A-Za-z0-9 ,&'-]{2,60})\s*$|(?:Our Mission|Our Team|Who We Are|Programs|Partners|Contact|Financials|Overview)\b)\s*$"
INSTITUTE_OPENING = r"(?i)^(our mission|programs|contact|overview)\b"
PERSON_LINE = r"^[A-Z][a-zA-ZáéíóúñÁÉÍÓÚÑ.\-' ]+(?:\([^)]+\))?$"

# Sections of papers, in order; they begin at the start of a line.
SCHOLAR_SECTIONS = [
    (r"(?im)^\s*abstract\s*$", "Abstract"),
    (r"(?im)^\s*1\.?\s*introduction\s*$", "Introduction"),
    (r"(?im)^\s*(?:2\.?\s*)?methods?\b", "Methods"),
    (r"(?im)^\s*(?:3\.?\s*)?results?\b", "Results"),
    (r"(?im)^\s*(?:4\.?\s*)?discussion\b", "Discussion"),
    (r"(?im)^\s*conclusion[s]?\b", "Conclusion"),
    (r"(?im)^\s*references?\b", "References"),
    (r"(?im)^\s*acknowledgements?\b", "Acknowledgements"),
]

# Lines of tables and lists, and what is no heading.
TABLE_LINE = r"(?m)^\s*\|.*\|"
LIST_LINE = r"(?m)^\s*[-•*]\s"
YEAR = r"^(19|20)\d{2}$"
AFFILIATION = r"^(Department|School|University|Institute|Faculty)"
CAPTION = r"^(table|figure|fig\.)"
MONTH_AND_YEAR = r"^(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)\w*\s+\d{4}$"

# Entries of a bibliography, and paths that tell papers from reports.
REFERENCE_LINK = r"\[CrossRef\]|\[PubMed\]|doi\.org"
NUMBERED_REFERENCE = r"(?m)^\s*\d+\.\s+[A-Z][a-z]+,"
JOURNAL_REFERENCE = r"\b[A-Z][a-z]+\.\s+\d{4},\s+\d+"
PAPER_PATH, REPORT_PATH = "scholar|paper|arxiv", "report|institute|annual"

# Sessions.
SESSION_TURNS, SUMMARY_TURNS, ENTITY_TURNS = 10, 3, 3
SESSION_TTL_S, MAX_SESSIONS = 3600, 200
STRATEGIES = ["FULL", "REUSE", "MERGE"]
