"""String functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once; a Column used within a lambda is computed for each element."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def similarity(a: Column | str, b: Column | str, both_empty: float = 0.0) -> Column:
    """1 - Levenshtein distance / longer length; 0 if one side is empty, ``both_empty`` if both are."""
    a, b = _col(a), _col(b)
    score = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    empty = (F.length(a) == 0) | (F.length(b) == 0)
    return F.when((F.length(a) == 0) & (F.length(b) == 0), F.lit(both_empty)).when(empty, F.lit(0.0)).otherwise(score)


def chars(c: Column | str) -> Column:
    """Distinct characters."""
    return F.array_distinct(F.filter(F.split(_col(c), ""), lambda x: x != ""))


def char_overlap(a: Column | str, b: Column | str) -> Column:
    """Shared distinct characters over the longer length; 0 if one side is empty."""
    a, b = _col(a), _col(b)
    shared = F.size(F.array_intersect(chars(a), chars(b))) / F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(shared)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 on an empty union."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def tokens(c: Column | str) -> Column:
    """Lower-cased words; whatever is neither a word character nor a blank parts words."""
    return F.filter(F.split(F.regexp_replace(F.lower(_col(c)), r"[^\w\s]", " "), r"\s+"), lambda x: x != "")


def index_text(c: Column | str) -> Column:
    """Lower case, only ``[a-z0-9 _-.]``, blanks collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_col(c)), r"[^a-z0-9\s_\-.]", " "), r"\s+", " "))


def index_tokens(c: Column | str) -> Column:
    return F.filter(F.split(index_text(c), r"[\s_\-.]+"), lambda x: x != "")


def ngrams(c: Column | str, n: int) -> Column:
    """Character n-grams of the blank-free index text; a shorter text is its own only gram."""
    flat = F.regexp_replace(index_text(c), r"\s+", "")
    many = lambda f: F.transform(F.sequence(F.lit(1), F.length(f) - n + 1), lambda i: F.substring(f, i, F.lit(n)))
    return let(flat, lambda f: F.when(F.length(f) < n, F.array(f)).otherwise(many(f)))


def query_terms(c: Column | str) -> Column:
    """Words of more than two characters, lower-cased, without non-word characters."""
    return F.transform(F.filter(F.split(_col(c), r"\s+"), lambda t: F.length(t) > 2), lambda t: F.regexp_replace(F.lower(t), r"[^\w]", ""))


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def stem_of_file(path: Column | str) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def extension(path: Column | str) -> Column:
    """Lower-cased extension without the dot, empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1))


def dirname(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"^(.*)/[^/]*$", 1)


def canonical_path(path: Column | str) -> Column:
    return F.lower(F.translate(_col(path), "\\", "/"))


def same_tail(a: Column | str, b: Column | str) -> Column:
    """Whether the shorter path is the tail of the longer one, by segments."""
    one, two = F.split(canonical_path(a), "/"), F.split(canonical_path(b), "/")
    n = F.least(F.size(one), F.size(two))
    tail = lambda parts: F.slice(parts, F.size(parts) - n + 1, n)
    return tail(one) == tail(two)


def pascal_case(c: Column | str) -> Column:
    """snake_case and kebab-case to PascalCase."""
    parts = F.filter(F.split(_col(c), "[_-]"), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 2**30))), "")


def strip_file_prefix(c: Column | str) -> Column:
    """``path::Name`` to ``Name``, and ``path::Class::member`` to ``Class::member``."""
    c = _col(c)
    return F.when(c.contains("::"), F.substring(c, F.length(F.substring_index(c, "::", 1)) + 3, F.length(c))).otherwise(c)


def strip_citations(c: Column | str) -> Column:
    """Without ``[cite_n]`` marks; blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(_col(c), r"\[cite_\d+\]", ""), r"\s+", " "))


def shorten(c: Column | str, limit: int) -> Column:
    """At most ``limit`` characters, an ellipsis for the rest."""
    c = _col(c)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def line_of_offset(text: Column | str, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    return F.size(F.split(F.substring(_col(text), F.lit(1), offset), "\n"))


def mermaid_label(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(c), '"', "'"), r"[\[\]{}()<>|]", " ")


# Secret patterns that are redacted.
SECRET_PATTERNS = (
    r"""['"]\s*(?:api[_-]?key|apikey|key|secret|token|password|pwd|pass)\s*['"]\s*:\s*['"][^'"]{8,}['"]""",
    r"(?:^|\s)((?:sk|pk|ak)_[a-z0-9]{20,})",
    r"(?:^|\s)([a-f0-9]{32,})",
    r"eyJ[a-z0-9_-]+\.[a-z0-9_-]+\.[a-z0-9_-]+",
    r"AKIA[0-9A-Z]{16}",
    r"ghp_[a-z0-9]{36}",
    r"github_pat_\w{82}",
    r"AIza[-\da-z_]{35}",
    r"-----BEGIN.*PRIVATE KEY-----[\s\S]*?-----END.*PRIVATE KEY-----",
)


def redact(c: Column | str) -> Column:
    """Secrets replaced by a mark."""
    c = _col(c)
    for pattern in SECRET_PATTERNS:
        c = F.regexp_replace(c, "(?i)" + pattern, "[REDACTED_SECRET]")
    return c


# Identifier families of a question.
IDENTIFIER_PATTERNS = {
    "pascal": r"\b[A-Z][a-z]+[A-Z]\w*\b",
    "snake": r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b",
    "kebab": r"\b[a-z][a-z0-9]*(?:-[a-z0-9]+)+\b",
    "quoted": r'"([^"]+)"',
}


def identifiers(c: Column | str, family: str) -> Column:
    pattern = IDENTIFIER_PATTERNS[family]
    return F.regexp_extract_all(_col(c), F.lit(pattern), 1 if family == "quoted" else 0)


# Technical terms of a prompt.
TERM_PATTERNS = (r"\b[A-Z][a-zA-Z0-9]*\b", r"\b[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*\b")
QUOTED_TERM = r"""(?:"[^"]+"|'[^']+'|`[^`]+`)"""


def technical_terms(c: Column | str) -> Column:
    """Distinct Pascal-case, then camel-case, then quoted terms, each in order."""
    c = _col(c)
    plain = [F.regexp_extract_all(c, F.lit(p), 0) for p in TERM_PATTERNS]
    quoted = F.transform(F.regexp_extract_all(c, F.lit(QUOTED_TERM), 0), lambda q: F.regexp_replace(q, "[\"`']", ""))
    return F.array_distinct(F.concat(*plain, quoted))
