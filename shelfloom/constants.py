"""Names, limits, patterns and labels that results must agree on."""

# Row status values and limits of the compliance check.
SUCCESS = "Success"
FAILED = "Failed"
NON_COMPLIANT = "Failed compliance checks"
FAILED_TEXT = "Failed. Check the 'Full API Response' column for details."
TITLE_MAX_LENGTH = 150
DESCRIPTION_MAX_LENGTH = 5000
MAX_TRIES = 3
BATCH_ROWS = 30

# Separator of key and value lists in replies.
LIST_SEPARATOR = "|"

# Letters and digits that make up a word of a title.
WORD_PATTERN = "([A-Za-zÀ-ÖØ-öø-ÿ0-9]+)"
PLAIN_WORD_PATTERN = r"(\w+)"

# White space that trimming removes: ASCII, no-break and other Unicode spaces, byte order mark.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# One reply line: "id: text", or an id alone.
LINE_ID_AND_TEXT = r"(?s)^([^:]+): (.*)\z"
LINE_ID_ONLY = r"(?s)^([^:]+)\z"

# Reply blocks, one per item.
TITLE_BLOCK = r"(?is)id:[^\n]+.*?generated title:[^\n]+"
DESCRIPTION_BLOCK = r"(?is)id:[^\n]+.*?score:[^\n]+"
BLOCK_ID = r"(?i)id:\s*([^\n]+)"
BLOCK_TITLE = r"(?i)generated title:\s*([^\n]+)"
BLOCK_DESCRIPTION = r"(?is)generated description:\s*(.*?)(?:\n\s*score:|\z)"

# One item per reply, labels possibly in bold or italics.
MARKDOWN_TITLE = r"(?is)generated title\s*:\s*(?:\*\*|\*)*\s*([^\n]+)"
MARKDOWN_DESCRIPTION = (
    r"(?is)generated description\s*:\s*(?:\*\*|\*)*\s*(.*?)(?:\n\s*(?:\*\*|\*)*\s*score:|\z)"
)
TITLE_LABEL = "generated title:"
DESCRIPTION_LABEL = "generated description:"

# First labelled line of a batch reply.
BATCH_LABEL = r"(?i)generated (?:title|description|highlights):\s*([^\n]*)"

# Keys of the two structured replies, in order.
TITLE_REPLY_KEYS = (
    "product attribute keys in original title:",
    "product category:",
    "product attribute keys:",
    "product attribute values:",
    "replaced keys:",
    "generated title:",
)
DESCRIPTION_REPLY_KEYS = ("description:", "score:", "reasoning:")

# Attribute keys whose values may bring new words into a title.
FEATURE_KEYS = ("Image Features", "Website Features")

# Column roles guessed from names (ignore case, first match wins).
ROLE_PATTERNS = {
    "id": "(id|sku)",
    "title": "(title|name)",
    "description": "(desc|text|summary)",
    "url": "(url|link|page)",
    "image_url": "(img|image|photo|pic)",
}

# Marker of generated text in a merchant feed.
AI_MARKER = "trained_algorithmic_media"

# Text that stands for a missing reply in the attribute job, and the id prefix in its requests.
NO_ANSWER = "N/A"
ID_PREFIX = "Id: "

# Reasons for which a reply stream counts as blocked, and the thresholds sent with a request.
BLOCKED_REASONS = ("SAFETY", "BLOCKLIST")
SAFETY_CATEGORIES = (
    "HARM_CATEGORY_DANGEROUS_CONTENT",
    "HARM_CATEGORY_HARASSMENT",
    "HARM_CATEGORY_HATE_SPEECH",
    "HARM_CATEGORY_SEXUALLY_EXPLICIT",
)
SAFETY_THRESHOLD = "BLOCK_ONLY_HIGH"

# Markup patterns of the line-based page reader. The brackets are character classes, so a removal
# runs to the end of its line.
PAGE_HEAD = r"(?s)<head.*</head>"
PAGE_REMOVED = (
    r"<script[^</script].*",
    r"<svg[^</svg].*",
    r"<path[^</path].*",
    r"<iframe[^</iframe].*",
    r"<a [^</a].*",
)
PAGE_SPAN = r"<span[^</span](.*)"
PAGE_PARAGRAPH = r"<p[^</p](.*)"
PAGE_TEXT = r"(?s)>(.*)<"
SCRIPT_OR_STYLE = r"(?is)<(script|style)\b.*?</\1\s*>"
