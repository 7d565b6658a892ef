"""Fixed values that results depend on, each stated once: patterns, thresholds, caps and labels."""

# Noise: rules of separators, lines under so many characters, page stamps alone or with "page n of m".
SEPARATORS = r"[\s\-_=|.]+"
LEAST_CHARS = 4
STAMP = r"[-–—\s]*\(?\s*\d{1,4}\s*\)?[-–—\s]*"
PAGE_STAMP = r"page\s+\d{1,4}(?:\s+of\s+\d{1,4})?"
BARE_STAMP = r"[-–—\s]*\d{1,4}[-–—\s]*"

# Characters that a normalised line does not have, beside the category C.
INVISIBLE = ((0xAD, 0xAD), (0x200B, 0x200F), (0xFEFF, 0xFEFF), (0xFFF0, 0xFFFD))

# Numbers, what is left of one without white space and commas, and what does not count within them.
NUMBER = r"\b\d{1,3}(?:[,.]?\d{3})*(?:\.\d+)?\b|\b\d+ \d{3}(?:\.\d+)?\b"
PLAIN_NUMBER = r"\d+(\.\d+)?"
DIGIT_GAP = r"(?<=\d)\s+(?=\d)"
THOUSANDS = r"(?<=\d),(?=\d{3})"
YEAR = r"(?:19|20)\d{2}"

# Wrapped lines: ends that close a line, and the least characters of a line that goes on.
LINE_END = "[.!?;:]$"
WRAPPED_CHARS = 15

# Matching: same at once, related, same with equal numbers; the wrap gate; the prefix gate; what numbers add or take.
EXACT, RELATED, NUMBERS_EQUAL = 0.94, 0.55, 0.80
OVERLAP, LENGTH_RATIO, LEAST_WORDS, PREFIX_CHARS = 0.85, 0.55, 4, 40
SENTENCE_END = ".!?"
BONUS, PENALTY = 0.04, 0.06
CANDIDATES = 40

# Pages: how far one may move, the least similarity of a match, the anchor's lines, their characters and all of them, a word's letters.
WINDOW, LEAST = 8, 0.30
ANCHOR_LINES, ANCHOR_LEAST, ANCHOR_CHARS = 3, 8, 120
WORD = "[a-z]{4,}"

# Snapshots: dots per inch, the grid of lines, the margin of a box.
DPI, GRID, MARGIN = 130, 5, 2

# Highlighting: characters of a needle, of a head, of a whole line; a wrapped line's overlap and lengths; words, shared, length.
NEEDLE, HEAD, WHOLE = 40, 6, 12
WRAP_OVERLAP, WRAP_FROM, WRAP_TO = 0.85, 0.55, 0.75
MARK_WORDS, MARK_SHARED, MARK_LENGTH = 4, 0.80, 0.30

# Keys of comments; caps of the API document: lines of a status, numbers, issues of a pair of pages.
COMMENT_KEY = r"(?i)^(changed|page|overall):[0-9a-z_\-]*$"
API_LINES, API_NUMBERS, API_ISSUES = 100, 50, 25
