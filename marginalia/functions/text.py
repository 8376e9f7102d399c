"""Text functions as column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, patterns and terms that decide results.
CACHE_STOP = (
    "a", "an", "the", "of", "for", "to", "in", "on", "at", "by", "and", "or", "is", "are", "was", "were", "be", "do", "does", "did", "what", "whats",
    "how", "who", "whom", "when", "where", "which", "why", "many", "much", "with", "from", "about", "into", "that", "this", "these", "those", "it",
    "its", "as", "if", "than", "then", "so", "not", "no", "yes", "can", "could", "should", "would", "will", "just", "please", "me", "my", "our",
    "your", "their", "there", "any", "all", "per", "vs", "versus",
)
CITE_STOP = (
    "the", "and", "for", "that", "with", "this", "from", "are", "was", "were", "they", "their", "have", "has", "you", "your", "not", "but", "any",
    "all", "can", "may", "must", "will", "each", "per", "who", "what", "when", "which", "into", "also", "than", "then", "them", "its", "does",
)
PROHIBITION = r"\b(prohibited|may not|must not|not permitted|forbidden|banned|no one may|not allowed|never)\b"
OBLIGATION = r"\b(must|required|shall|mandatory|is expected to|needs?)\b"
PERMISSION = r"\b(may|permitted|allowed|can|eligible|entitled)\b"
GLOSSARY = (
    "perry the platypus", "agent p", "o.w.c.a.", "norm", "vanessa", "gimmelshtump", "tri-state area", "chief token officer", "ceo", "cfo",
    "foosball leaderboard", "inator review board", "minion union", "platypus", "foosball", "self-destruct button", "blimp", "tokens",
)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def stem(word: Column) -> Column:
    """Drops a final s of words over three letters, but not of a double s."""
    return F.when((F.length(word) > 3) & word.endswith("s") & ~word.endswith("ss"), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def tokens(text: Column) -> Column:
    """Stemmed lower-case words."""
    return F.transform(words(text), stem)


def estimate_tokens(text: Column) -> Column:
    """Words and single other signs; at least 1 for a non-empty text, 0 for an empty one."""
    n = F.size(F.regexp_extract_all(text, F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0)))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(n, F.lit(1)))


def sentences(text: Column) -> Column:
    """Pieces between white space that follows . ! ? and precedes a capital, a digit, a quote or a bracket."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z0-9\"'(])"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def version_key(version: Column) -> Column:
    """The leading number of each dotted part, -1 where there is none; arrays compare part by part."""
    return F.transform(F.split(version, r"\."), lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"^\d+", 0), F.lit("")).try_cast("int"), F.lit(-1)))


def normalize_version(version: Column) -> Column:
    v = F.regexp_replace(F.lower(F.trim(version)), "^v+", "")
    return F.when((v == "") | v.contains("."), v).otherwise(F.concat(v, F.lit(".0")))


def named_versions(question: Column) -> Column:
    """Versions that a question names, in order of first mention."""
    pattern = F.lit(r"(?i)\b(?:v(?:ersion)?\s*\.?\s*)(\d+(?:\.\d+)?)\b|\b(\d+\.\d+)\b")
    a, b = (F.regexp_extract_all(question, pattern, F.lit(i)) for i in (1, 2))
    named = F.zip_with(a, b, lambda x, y: normalize_version(F.when(x != "", x).otherwise(y)))
    return F.array_distinct(named)


def mentioned_versions(question: Column, available: Column) -> Column:
    """Available versions that a question names, in order of first mention."""
    return F.filter(named_versions(question), lambda v: F.array_contains(available, v))


def _month(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(name)).cast("int")


def _date(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", year, F.lpad(F.nullif(month, F.lit(0)).cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    return F.when(month > 0, F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd"))


def mentioned_date(question: Column, today: Column) -> Column:
    """The day a question asks about: an ISO day, "June 1, 2024", "1 June 2024", "June 2024" or "last June"; null if none or invalid."""
    part = lambda p, i: F.regexp_extract(question, p, i)
    iso = r"\b(20\d\d-\d\d-\d\d)\b"
    md = r"\b([A-Za-z]+)\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(20\d\d)\b"
    dm = r"\b(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]+)\s+(20\d\d)\b"
    my = r"\b([A-Za-z]+)\s+(20\d\d)\b"
    last = r"(?i)\blast\s+([A-Za-z]+)\b"
    month = _month(part(last, 1))
    year = F.when(F.month(today) > month, F.year(today)).otherwise(F.year(today) - 1)
    return F.when(part(iso, 1) != "", F.date_format(F.try_to_date(part(iso, 1), "yyyy-MM-dd"), "yyyy-MM-dd")).otherwise(
        F.coalesce(
            _date(part(md, 3), _month(part(md, 1)), part(md, 2)),
            _date(part(dm, 3), _month(part(dm, 2)), part(dm, 1)),
            _date(part(my, 2), _month(part(my, 1)), F.lit("1")),
            F.when(month > 0, _date(year.cast("string"), month, F.lit("1"))),
        )
    )


def date_number(day: Column, default: int | None = None) -> Column:
    """yyyymmdd as an integer; the default where there is no valid day."""
    d = F.try_to_date(day, "yyyy-MM-dd")
    return F.coalesce(F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d), F.lit(default).cast("int"))


def clause_type(text: Column) -> Column:
    return F.when(text.rlike("(?i)" + PROHIBITION), "prohibition").when(text.rlike("(?i)" + OBLIGATION), "obligation").when(text.rlike("(?i)" + PERMISSION), "permission").otherwise("informational")


def entities(text: Column) -> Column:
    """Glossary terms that the text contains, then names that end in -inator."""
    low = F.lower(text)
    terms = F.filter(F.array(*map(F.lit, GLOSSARY)), lambda g: F.contains(low, g))
    return F.array_distinct(F.concat(terms, F.transform(F.regexp_extract_all(text, F.lit(r"\b([A-Z][\w-]*-inator)\b"), F.lit(1)), F.lower)))


def content_tokens(question: Column) -> Column:
    """Sorted tokens that two questions must share to be the same: dates, versions, and words that aren't stop words."""
    low = F.lower(question)
    dates = F.regexp_extract_all(low, F.lit(r"\b20\d\d-\d\d-\d\d\b"), F.lit(0))
    versions = F.transform(F.regexp_extract_all(low, F.lit(r"\bv(?:ersion)?\s*\.?\s*(\d+(?:\.\d+)?)\b"), F.lit(1)), lambda v: F.concat(F.lit("v"), v))
    plain = F.array_except(F.regexp_extract_all(low, F.lit(r"[a-z0-9]+(?:\.[0-9]+)?"), F.lit(0)), F.array(*map(F.lit, CACHE_STOP)))
    return F.sort_array(F.array_union(F.array_union(dates, versions), plain))


def content_words(text: Column) -> Column:
    """Sorted distinct words that can support a citation: with a digit, or over two letters and no stop word."""
    return F.sort_array(F.array_distinct(F.filter(words(text), lambda w: w.rlike("[0-9]") | ((F.length(w) > 2) & ~F.array_contains(F.array(*map(F.lit, CITE_STOP)), w)))))


def slug(name: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-")), F.lit("")), F.lit("x"))


# Fixed value: emphasis marks, which hug what they emphasise and stand outside words.
EMPHASIS = r"(?U)(?<!\w)[*_](\S(?:.*?\S)?)[*_](?!\w)"


def markdown_lines(text: Column) -> Column:
    """Lines without heading marks and emphasis; rules are left out, table rows stay."""
    def clean(line: Column) -> Column:
        line = F.regexp_replace(F.regexp_replace(line, r"\s+$", ""), r"^#{1,6}\s+", "")
        plain = F.regexp_replace(F.regexp_replace(line, r"\*\*(.+?)\*\*", "$1"), EMPHASIS, "$1")
        return F.when(F.ltrim(line).startswith("|"), line).otherwise(plain)

    return F.filter(F.transform(F.split(text, "\n"), clean), lambda x: ~F.trim(x).isin("---", "***"))


SUBSECTION = r"^\s*(\d+(?:\.\d+)+)\.?\s+(\S.*)$"
SECTION = r"^\s*(\d+)\.\s+(\S.*)$"


def heading_level(line: Column) -> Column:
    """1 for "3. Title", 2 for "3.1 Title" and so on; null for other lines. Numbered sentences are no headings."""
    rest = F.trim(F.regexp_extract(line, SECTION, 2))
    title = F.substring_index(rest, ". ", 1)
    good = (title != "") & ~title.rlike(r"[.!?]$") & (F.size(F.split(F.trim(title), r"\s+")) <= 12)
    dots = F.length(F.regexp_replace(F.regexp_extract(line, SUBSECTION, 1), r"[^.]", ""))
    return F.when(line.rlike(SUBSECTION), dots + 1).when(line.rlike(SECTION) & good, F.lit(1))


def redact(text: Column, classification: Column, phrase: str) -> Column:
    """Top-secret texts (and those without a classification) go; elsewhere the access phrase goes where it stands as a word."""
    return F.when(F.coalesce(classification, F.lit("top-secret")) == "top-secret", "[redacted: top-secret]").otherwise(F.regexp_replace(text, rf"\b{phrase}\b", "[access-phrase]"))
