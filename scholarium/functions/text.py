"""Column expressions for identifiers, names, titles, dates and report text. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The record identifier prefix, the DOI prefix, the target categories and the suffix spellings.
IDENTIFIER_PREFIX = "oai:arXiv.org:"
DOI_PREFIX = "10.48550/arXiv."
TARGET_CATEGORIES = ["cs.AI", "cs.LG", "cs.GT", "cs.MA", "cs.LO", "cs.CY", "cs.CR", "cs.SE", "cs.NE"]
JUNIOR_SPELLINGS = ["JR", "JR.", "JUNIOR"]
SENIOR_SPELLINGS = ["SR", "SR.", "SENIOR"]
ROMAN_SUFFIXES = ["I", "II", "III", "IV", "V"]

# Default stop list of the keyword operators: English function words. Callers may pass their own.
STOP_WORDS = (
    "a about above after again against all also am an and any are as at be because been before being below "
    "between both but by can could did do does doing down during each either else ever few for from further "
    "had has have having he her here hers herself him himself his how however i if in into is it its itself "
    "just least less may me might mine more most much must my myself neither no nor not now of off on once "
    "one only onto or other others our ours ourselves out over own per perhaps rather same she should since "
    "so some such than that the their theirs them themselves then there these they this those though through "
    "thus to together too toward under until up upon us very via was we well were what when where whether "
    "which while who whom whose why will with within without would yet you your yours yourself yourselves"
).split()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_identifier_prefix(c: Column | str) -> Column:
    """Record identifier to paper id."""
    return F.regexp_replace(_col(c), "^oai:arXiv\\.org:", "")


def strip_trailing_commas(c: Column | str) -> Column:
    """Drop every comma at the end of the text."""
    return F.rtrim(_col(c), F.lit(","))


def blank_to_null(c: Column | str) -> Column:
    """Trim; nothing left becomes NULL."""
    return F.nullif(F.trim(_col(c)), F.lit(""))


def empty_to_null(c: Column | str) -> Column:
    """Empty text becomes NULL, blanks are kept."""
    return F.nullif(_col(c), F.lit(""))


def normalize_suffix(c: Column | str) -> Column:
    """One spelling per generational suffix; others are trimmed, blanks become NULL."""
    trimmed = blank_to_null(c)
    upper = F.upper(trimmed)
    return (
        F.when(upper.isin(JUNIOR_SPELLINGS), F.lit("Jr."))
        .when(upper.isin(SENIOR_SPELLINGS), F.lit("Sr."))
        .when(upper.isin(ROMAN_SUFFIXES), upper)
        .otherwise(trimmed)
    )


def normalize_title(c: Column | str) -> Column:
    """Comparison form of a title: lower case, no version marks, preprint ids or punctuation."""
    word = "[\\p{L}\\p{N}_]"
    t = F.lower(F.coalesce(_col(c), F.lit("")))
    t = F.regexp_replace(t, f"(?<!{word})v\\p{{Nd}}+(?!{word})", "")
    t = F.regexp_replace(t, "arxiv:\\p{Nd}+\\.\\p{Nd}+", "")
    t = F.regexp_replace(t, "(?U)[^\\p{L}\\p{N}_\\s]", "")
    return F.trim(F.regexp_replace(t, "(?U)\\s+", " "))


def split_categories(c: Column | str) -> Column:
    """Space-separated category text to an array (a double space yields an empty entry)."""
    return F.split(_col(c), " ")


def primary_category(c: Column | str) -> Column:
    """First category of a space-separated list."""
    return F.trim(F.substring_index(_col(c), " ", 1))


def overlaps_categories(c: Column | str, wanted: Sequence[str] = TARGET_CATEGORIES) -> Column:
    """Whether a category array shares an entry with ``wanted``."""
    return F.arrays_overlap(_col(c), F.array(*[F.lit(w) for w in wanted]))


def author_display(keyname: Column | str, forenames: Column | str, suffix: Column | str) -> Column:
    """``Keyname, Forenames Suffix`` with the absent parts left out."""
    return F.concat(
        _col(keyname),
        F.coalesce(F.concat(F.lit(", "), _col(forenames)), F.lit("")),
        F.coalesce(F.concat(F.lit(" "), _col(suffix)), F.lit("")),
    )


def text_prefix(c: Column | str, n: int) -> Column:
    """First ``n`` characters, for display."""
    return F.left(_col(c), F.lit(n))


def preprint_doi(paper_id: Column | str) -> Column:
    """DOI under which a preprint is registered."""
    return F.concat(F.lit(DOI_PREFIX), _col(paper_id).cast("string"))


def resume_token(url: Column | str) -> Column:
    """Resume token inside a request address, percent-decoded; ``+`` stays as it is. NULL when absent."""
    raw = F.nullif(F.regexp_extract(_col(url), "resumptionToken=([^&]+)", 1), F.lit(""))
    return F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))


def version_number(c: Column | str) -> Column:
    """``v3`` to 3; a missing mark counts as version 1, anything else becomes NULL."""
    digits = F.regexp_replace(F.coalesce(_col(c), F.lit("v1")), "^v+", "")
    return digits.try_cast("int")


def parse_record_date(c: Column | str) -> Column:
    """``Mon, 1 Jan 2024 00:00:00 GMT`` to a timestamp; unreadable text becomes NULL."""
    return F.try_to_timestamp(F.substring_index(_col(c), ", ", -1), F.lit("d MMM yyyy HH:mm:ss z"))


def percent(part: Column, total: Column, digits: int = 1) -> Column:
    """Rounded percentage, NULL when the total is zero."""
    return F.round(F.try_divide(part * F.lit(100.0), total), digits)


def fixed_decimals(c: Column | str, digits: int = 2, missing: str = "N/A") -> Column:
    """Fixed-decimals text; NULL and zero both print as ``missing``."""
    value = _col(c)
    return F.when(F.coalesce(value, F.lit(0.0)) == 0, F.lit(missing)).otherwise(
        F.format_string(f"%.{digits}f", value.cast("double"))
    )


def count_tokens(c: Column | str) -> Column:
    """Default token counter: runs of non-blank characters."""
    return F.regexp_count(_col(c), F.lit("\\S+"))


def embedding_text(category: Column | str, title: Column | str, abstract: Column | str, prefix: bool = True) -> Column:
    """Text handed to the embedder. A missing part prints as ``None``."""
    none = F.lit("None")
    body = F.concat(F.coalesce(_col(title), none), F.lit("\n"), F.coalesce(_col(abstract), none))
    return F.concat(F.lit("Category: "), F.coalesce(_col(category), none), F.lit("\n"), body) if prefix else body


def cluster_display(label: Column | str, cluster_id: Column | str) -> Column:
    """Label of a cluster, or ``Cluster n`` when it has none."""
    return F.coalesce(empty_to_null(label), F.concat(F.lit("Cluster "), _col(cluster_id).cast("string")))


# A letter run with hyphens, from word border to word border. Borders are spelled out: asking the regex
# engine for Unicode borders is several times slower.
WORD = (
    "((?<![\\p{L}\\p{N}_])[a-z][a-z-]*(?:[a-z](?![\\p{L}\\p{N}_])|-(?=[\\p{L}\\p{N}_])))"
)


def words(c: Column | str, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Lower-case words of letters and hyphens, stop words removed, in text order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(WORD), F.lit(1))
    if not stop_words:
        return found
    return F.filter(found, lambda w: ~w.isin(list(stop_words)))


def words_and_pairs(tokens: Column) -> Column:
    """The tokens followed by every pair of neighbours."""

    def extended(t: Column) -> Column:
        rest = F.greatest(F.size(t) - 1, F.lit(0))
        pairs = F.zip_with(
            F.slice(t, F.lit(1), rest), F.slice(t, F.lit(2), rest), lambda a, b: F.concat(a, F.lit(" "), b)
        )
        return F.concat(t, pairs)

    # Wrapping binds the token list to a variable: it is computed once per row.
    return F.flatten(F.transform(F.array(tokens), extended))


def vector_bytes(c: Column | str) -> Column:
    """Size of a float32 vector in bytes."""
    return F.size(_col(c)) * 4
