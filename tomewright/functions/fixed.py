"""Lists, tables and patterns that results depend on, stated as they must be."""

import re

# --- fixed values: file kinds ---
AUDIO_EXTS = (".m4b", ".m4a", ".mp3", ".flac", ".ogg", ".opus", ".wma", ".aac")
EBOOK_EXTS = (".epub", ".mobi", ".azw", ".azw3", ".pdf")
EXTRA_EXTS = (".jpg", ".jpeg", ".png", ".nfo", ".cue", ".opf", ".txt")
SIDECAR_EXTS = (
    ".jpg", ".jpeg", ".png", ".webp", ".gif", ".nfo", ".txt", ".opf", ".json", ".cue", ".pdf", ".m3u", ".m3u8", ".sfv",
    ".md5", ".log", ".url",
)
FORMAT_RANK = {
    ".m4b": 0, ".m4a": 1, ".flac": 2, ".opus": 3, ".ogg": 4, ".mp3": 5, ".aac": 6, ".wma": 7,
    ".epub": 0, ".azw3": 1, ".azw": 2, ".mobi": 3, ".pdf": 4,
}

# --- fixed values: words ---
JUNK_WORDS = (
    "audiobooks", "audiobook", "ebooks", "ebook", "books", "book", "unsorted", "new", "folder", "downloads",
    "download", "fiction", "nonfiction", "series", "misc", "temp", "incoming", "media", "source", "dest", "output",
    "complete", "collection", "library", "torrents", "import", "todo", "stuff", "unknown", "various", "author",
    "authors", "tmp", "metadata", "cache", "watch", "untitled",
)
SMALL_WORDS = ("a", "an", "the", "and", "or", "of", "in", "on", "at", "to", "for", "by")
NAME_SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "phd", "md")
NUMBER_WORDS = {
    "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8",
    "nine": "9", "ten": "10", "i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7",
    "viii": "8", "ix": "9", "first": "1", "second": "2", "third": "3",
}
JUNK_AUTHORS = (
    "unknown", "unknown author", "calibre", "n a", "none", "author", "admin", "administrator", "user",
    "various artists", "audiobook", "audiobooks",
)
JUNK_TITLES = ("unknown", "untitled", "title", "new document", "document", "book", "audiobook")
NOT_AUTHORS = (
    "me", "you", "us", "him", "her", "them", "it", "night", "day", "starlight", "moonlight", "candlelight",
    "design", "default",
)
DUPLICATE_REASONS = {
    "Identical files": 0, "Same ASIN": 1, "Same ISBN": 2, "Same title and author": 3,
    "Same title, other subtitle": 4, "Similar title": 5, "Same author and length": 6,
}
AUTHOR_CONFIDENCE = {"high": 0, "medium": 1, "low": 2, "glued": 3}
DONE_STATUSES = ("copied", "moved", "skipped")
SOURCE_BASE = {
    "opf": 72, "metadata.json": 66, "tags": 62, "folders": 56, "filename": 38, "AI": 60, "you": 100, "online": 70,
}

# --- fixed values: patterns ---
SERIES_WORDS = (
    r"\b(series|saga|trilogy|chronicles?|cycle|quartet|quintet|sequence|collection|omnibus|archives?|files|"
    r"universe|adventures|mysteries|tales|legends)\b"
)
SERIES_TAIL = r"\s*(series|saga|trilogy|cycle|sequence)$"
AUTHOR_TAIL = (
    r"\s+(?:collection|anthology|omnibus|complete works|selected works|collected works|bibliography|best of|"
    r"works of|works|audiobooks|ebooks|books|library)\s*$"
)
JUNK_TOKEN = (
    r"(?:mp3|m4b|m4a|aac|flac|ogg|opus|wma|vbr|cbr|abr|mono|stereo|lame|multi|full|audio\s*book|audiobooks?|"
    r"unabridged|abridged|unabr|unb|retail|hq|ipod|itunes|\d{2,3}\s*k(?:bps|b/s|bit)?|\d{2,3}kbps|"
    r"\d{2}(?:\.\d)?\s*khz|\d+(?:\.\d+)?\s*(?:mb|gb|mib|gib))"
)
JUNK_UNIT = r"(?:[\(\[\{]\s*" + JUNK_TOKEN + r"(?:[\s,]+" + JUNK_TOKEN + r")*\s*[\)\]\}]|" + JUNK_TOKEN + r")"
BODY_AND_JUNK = r"^(?P<body>.*?\S.*?)(?:[\s._\-]+" + JUNK_UNIT + r"\s*){0,8}$"
AUDIOBOOK_HEAD = r"^\s*(?:full\s+)?audio\s*book[\s_\-:]+"
RELEASE_TAG = (
    r"^\s*[\[\{](?:(?i:[\w-]+\.(?:to|com|org|net|me|cc|io|info|ws|se|nz|li|is))|[A-Z]{2,5}|TGx|"
    r"(?i:audiobookbay|rarbg|yts))[\]\}]\s*[-_.]?\s*"
)
CONTENT_PAREN = (
    r"\d\s*[-–]\s*\d|\b(?:vol(?:ume)?s?|books?|parts?|set|omnibus|collection|trilogy|complete)\b"
)
NOISE_PAREN = (
    r"\s*[\(\[](?:un)?abridged[\)\]]|\s*[\(\[](?:audio ?book|mp3|m4b|m4a|aac|flac|ogg|\d{2,3}\s*kbps|retail|epub|"
    r"kindle|e-?book|hq|complete|full|(?:19|20)\d{2})[\)\]]"
)
NARRATOR_PAREN = r"\s*[\(\[][^\)\]]*?(?:read|narrated|performed|told)\s+by\s+([^\)\]]+)[\)\]]"
TITLE_JUNK_BRACKETS = (
    r"[\(\[][^\)\]]*(?:unabridged|abridged|audiobook|retail|mp3|m4b|kbps|epub|mobi|pdf|dramati[sz]ed|narrated|"
    r"read by)[^\)\]]*[\)\]]"
)
TITLE_JUNK_WORDS = r"\b(unabridged|abridged|audiobook|a novel|the novel|retail)\b"
GLUE = r"\s+and\s+|\s*&\s*|\s*;\s*|\s+with\s+"
DISC_WORD = r"(?:disc|disk|cd|part|pt|side|tape)"
ROMAN = r"(?=[IVXLC])M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})"
ISBN = r"(?<![0-9X])(97[89][- ]?(?:[0-9][- ]?){9}[0-9]|[0-9]{9}[0-9Xx])(?![0-9X])"
INTRO = (
    r"(?s)(?:presents?|this is|welcome to)?\s*([A-Z][^.,]{2,80}?),?\s+(?:written\s+)?by\s+([A-Z][\w.' -]{2,50}?)[,.]?\s+"
    r"(?:read|narrated|performed)\s+by\s+([A-Z][\w.' -]{2,50}?)[.,]"
)
PLACEHOLDER_TITLE = r"(?i)^(untitled|unknown.*|track \d+|chapter \d+|\d{1,3})$"
#: Fields of a book that enrichment only fills where they are empty.
FILL_FIELDS = ("narrator", "year", "publisher", "description", "genres", "asin", "isbn", "language")
EDITABLE = (
    "author", "series", "series_index", "title", "narrator", "year", "publisher", "description", "genres",
    "language", "asin", "isbn",
)
KNOWN_NARRATORS = (
    "scott brick", "ray porter", "luke daniels", "steven pacey", "tim gerard reynolds", "r.c. bray", "rc bray",
    "r c bray", "nick podehl", "simon vance", "michael kramer", "kate reading", "january lavoy", "rebecca soler",
    "kirby heyborne", "rob inglis", "toby longworth", "joe morton", "bahni turpin", "robin miles", "dion graham",
    "jim dale", "frank muller", "george guidall", "davina porter", "grover gardner", "jefferson mays",
    "edoardo ballerini", "julia whelan", "will patton", "dick hill", "michael page", "stefan rudnicki",
    "jayne entwistle", "cassandra campbell", "jennifer ikeda", "tavia gilbert", "mary robinette kowal", "jeff hays",
    "andrea parsneau", "emily woo zeller", "travis baldree", "kevin r. free", "adjoa andoh", "roy dotrice",
)
GENERIC_TITLES = (
    "match game", "the game", "game on", "end game", "final game", "the end", "the beginning", "new beginnings",
    "fresh start", "home", "coming home", "going home", "home again", "the choice", "choices", "decisions",
    "the list", "the plan", "the promise", "the secret", "forever", "always", "never", "maybe", "lost", "found",
    "broken", "fallen", "risen", "dark", "light", "shadow", "shadows", "fire", "ice", "storm", "rain", "book one",
    "book two", "book 1", "book 2", "part one", "part two", "part 1", "part 2", "chapter one", "chapter 1",
    "untitled", "the gift", "the return", "the hunt", "the escape",
)

# --- fixed values: patterns of names ---
ANY_ID = r"\s*\(\d+\)\s*$"
CATALOG_ID = r"\s*\(\d{3,}\)\s*$"
BETWEEN_AUTHORS = r"\s*(?:[;/&]|\band\b|\bwith\b)\s*"
NUMBERED_FOLDER = r"^(?P<word>book|vol(?:ume)?|part|#)?\s*(?P<n>\d{1,3}(?:\.\d)?)\s*[-. ]\s*(?P<title>.+)$"
FOLDER_BY = r"^(?P<what>.+?)\s+by\s+(?P<who>[A-Z][\w.'\- ]+)$"
FILE_ENDING = r"\.(?:doc|docx|txt|rtf|lit|htm|html|epub|mobi|azw3?|pdf)$"
BRACKETS = r"\s*[\(\[][^\)\]]*[\)\]]"
BRACKETS_AT_END = r"(?:\s*[\(\[][^\)\]]*[\)\]])+\s*$"
#: Rewrites of a name before it is read: (pattern, replacement, flags).
NAME_RULES = (
    (r"\.(m4b|m4a|mp3|flac|ogg|opus|wma|aac|epub|mobi|azw3?|pdf)$", "", re.I),
    (r"[\[\(](?:unabridged|abridged|audiobook|\d{4}|mp3|64k|128k)[\]\)]", "", re.I),
    (r"^\s*(?:19|20)\d{2}\s*[-._]\s*", "", 0),
)
#: Rewrites of a title or series in order; {author} and {series} stand for those values.
TEXT_RULES = (
    (NOISE_PAREN, "", re.I),
    (r"\s*[\(\[]\s*\d{1,3}\s*of\s*\d{1,3}\s*[\)\]]", "", 0),
    (r"\s*\bB0[0-9A-Z]{8}\b", "", re.I),
    (r"\s*[\(\[]\s*\d+\s*(?:mp3s?|files|tracks|discs?|parts?|cds?|books?)\b[^\)\]]*[\)\]]", "", re.I),
    (r"[\s\-_.,]*\b(?:unb|unabr|unabridged|abridged)\b[\s\-_.,]*", " ", re.I),
    (r"\s+\d{10}(?:\d{3})?\s*$", "", 0),
    (r"^[A-Z]{1,4}\s?\d{1,3}\s+(?=[A-Za-z])", "", 0),
    (r"^{author}\s*[-:]\s*", "", re.I),
    (r"^(?:collection|novel|audiobook)\s*[-:]\s*", "", re.I),
    (r"[\s:,\-]*\bA Novel\s*$", "", re.I),
    (r"(\w)_ (?=\w)", r"\1: ", 0),
    (r"(\w)- (?=[A-Za-z])", r"\1: ", 0),
    (r"\s+by\s+{author}\s*$", "", re.I),
    (r"\s*[\(\[]\s*{series}(?:\s*(?:,|#|book)?\s*\d+)?\s*[\)\]]", "", re.I),
)
#: A series' name at the end of a title: its own, and any with a number.
SERIES_ECHO = (
    (r"\s*[:\-,(]\s*(?:the\s+)?{series}[^,:()]*?(?:,?\s*(?:book|bk|vol(?:ume)?|#)\s*\d+)?\s*\)?\s*$", "", re.I),
    (r"\s*[:\-]\s*[^:]*?\b(?:book|bk|vol(?:ume)?)\s*\d+\s*$", "", re.I),
)
VOLUME_RANGE = (
    r"[\(\[]\s*(?:books?|vols?\.?|volumes?)?\s*(\d{1,3}\s*[-–]\s*\d{1,3})\s*[\)\]]|"
    r"\b(?:books?|vols?\.?|volumes?)\s+(\d{1,3}\s*[-–]\s*\d{1,3})\b"
)
TITLE_BY = r"^(?P<title>.+?)\s+by\s+(?P<author>[A-Za-z][\w.'\- ]+)$"
BRACKETED_SERIES = r"^[\[\(](?P<series>[^\]\)]+?)\s+(?P<series_index>\d{1,3}(?:\.\d+)?)[\]\)]\s*[-:]?\s*(?P<title>.+)$"
AUTHOR_SERIES_TITLE = (
    r"^(?P<author>[A-Z][\w.']+ [A-Z][\w.']+)\s+(?:Trilogy|Series|Saga)\s+(?P<series>.+?)\s*[-\s]+"
    r"(?P<series_index>\d{1,2})[-\s]*(?P<title>[A-Za-z].+)$"
)
PERSON_DASH_TITLE = r"^(?P<author>[^-\d]+?)\s*-\s*(?P<title>[^-]*\S\s+\S[^-]*)$"
SERIES_NUMBER = r"^(?P<series>[A-Za-z][^-]*?)\s+(?P<series_index>\d{1,3}(?:\.\d+)?)$"
SERIES_AT_END = r"^(?P<series>.+?)(?:\s+series)?,?\s*(?:book|bk|vol(?:ume)?|#)\s*(?P<series_index>\d{1,3})\s*$"
SERIES_BEFORE_TITLE = (
    (
        r"^(?P<series>.+?)\s*(?:,|-)?\s*(?:book|bk|vol(?:ume)?|#)\s*(?P<series_index>\d+(?:\.\d+)?)\s*[-:]\s*"
        r"(?P<title>.+)$",
        re.I,
    ),
    (r"^(?P<series>.+?)\s+(?P<series_index>\d{1,2}(?:\.\d+)?)\s*[-:]\s*(?P<title>.+)$", 0),
)
INDEX_TITLE = r"^(?P<series_index>\d{1,2}(?:\.\d)?)\s*[-. ]\s*(?P<title>.+)$"

# --- fixed values: patterns of numbered parts ---
_COUNT = r"(?:\s*(?:of|/)\s*\d{1,3})?"
DISC = rf"{DISC_WORD}[\s._\-]*(?P<n>\d{{1,3}}|{ROMAN}){_COUNT}"
DISC_FOLDER = (
    r"(\d{1,3})|[A-Z]{1,2}(\d{1,3})|[\(\[]?\s*(\d{1,3})\s*of\s*\d{1,3}\s*[\)\]]?|"
    rf"(?:\d{{1,3}}[\s._\-)]+)?{DISC_WORD}[\s._\-]*(\d{{1,3}}|{ROMAN}){_COUNT}(?:\s*[-:_.]\s*.+)?"
)
ENCODED = r"\d\s*(?:k|kbps|mb|gb|khz)\b|\b(?:mp3|m4b|aac|vbr|cbr)\b"
#: Words that count a book's parts in file names.
UNITS = frozenset("disc disk cd part pt side tape chapter chap ch track trk episode ep".split())
#: Of these, those that count parts even behind a word for volumes.
PARTS = frozenset("disc cd part track chapter".split())
#: Words behind which a number is a volume's, and those behind which a last number is a chapter's.
VOLUME_WORDS = frozenset("book bk vol volume no number season series".split())
CHAPTER_WORDS = frozenset("chapter chap ch track trk part pt disc disk cd episode ep".split())
#: Words that, with a number or alone, are no title.
BARE_CHAPTERS = frozenset("chapter ch track part".split())
#: Containers that hold a whole book.
WHOLE_BOOKS = (".m4b", ".m4a")

#: The entities that plain pages use, in the order in which they are resolved: the ampersand's last, so that none is resolved twice.
PLAIN_ENTITIES = {"&middot;": "·", "&copy;": "©", "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
