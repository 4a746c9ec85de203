"""Column expressions over review text. All of them are native, so they also run on streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points Python treats as white space, the cut-offs and the labels of the answer text.
WS_RARE = r"\x{9}-\x{D}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS = f"[ {WS_RARE}]"
MIN_REVIEW_CHARS = 20
SEARCH_TEXT_CHARS = 500
ANSWER_EXCERPT_CHARS = 300
CARD_EXCERPT_CHARS = 400
PROMPT_EXCERPT_CHARS = 400
PREVIEW_CHARS = 500
MIN_QUERY_TERM_CHARS = 3
LABEL_CUISINE = "ประเภทอาหาร: "
LABEL_FOOD = "แนวอาหาร: "
LABEL_LOCATION = "ที่ตั้ง: "


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: Column | str) -> Column:
    """Every run of white space becomes one U+0020, and none is left at the ends.

    Single U+0020s, nearly all the white space there is, are not matched at all.
    """
    return F.trim(F.regexp_replace(as_column(c), f"[{WS_RARE}]{WS}*| {WS}+", " "))


def strip(c: Column | str) -> Column:
    """White space off both ends, the inside untouched."""
    return F.regexp_replace(as_column(c), f"^{WS}+|{WS}+$", "")


def blank_if_short(c: Column | str, min_chars: int = MIN_REVIEW_CHARS) -> Column:
    c = as_column(c)
    return F.when(F.length(c) >= min_chars, c).otherwise(F.lit(""))


def clean_review(c: Column | str, min_chars: int = MIN_REVIEW_CHARS) -> Column:
    """Null, and anything under ``min_chars`` after collapsing, becomes the empty string."""
    return blank_if_short(collapse(F.coalesce(as_column(c), F.lit(""))), min_chars)


def normalize_query(c: Column | str) -> Column:
    """Pipes separate the terms of a query line; they turn into single spaces."""
    return collapse(F.replace(as_column(c), F.lit("|"), F.lit(" ")))


def query_terms(c: Column | str, min_chars: int = MIN_QUERY_TERM_CHARS) -> Column:
    """Distinct lower-cased terms long enough to be looked up in reviews."""
    parts = F.split(F.lower(as_column(c)), WS + "+")
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) >= min_chars))


def excerpt(c: Column | str, n: int, *, stripped: bool = True, ellipsis: bool = True) -> Column:
    c = as_column(c)
    head = F.substring(c, 1, n)
    if stripped:
        head = strip(head)
    return F.when(F.length(c) > n, F.concat(head, F.lit("..."))).otherwise(head) if ellipsis else head


def stars(rating: Column | str) -> Column:
    return F.repeat(F.lit("*"), as_column(rating).cast("int"))


def star_slots(rating: Column | str, slots: int = 5) -> Column:
    r = as_column(rating).cast("int")
    return F.concat(F.repeat(F.lit("★"), r), F.repeat(F.lit("☆"), F.lit(slots) - r))


def percent(value: Column | str, decimals: int = 0) -> Column:
    """``0.885`` -> ``88%``: half to even, as Python formats.

    With no decimals this is exact. With decimals the tie is taken on the shortest decimal form of the number.
    """
    return F.format_string(f"%.{decimals}f%%", F.bround(as_column(value) * 100, decimals))


def signed_percent(value: Column | str, decimals: int = 1) -> Column:
    """``+1.5%`` from a value that is in percent already."""
    return F.format_string(f"%+.{decimals}f%%", F.bround(as_column(value), decimals))


def tag_list(c: Column | str) -> Column:
    return F.array_join(as_column(c), ", ")


def label_line(cuisine: Column | str, food: Column | str, location: Column | str) -> Column:
    """One line of labelled tags; facets without tags are left out."""

    def part(label: str, c: Column | str) -> Column:
        return F.when(F.size(as_column(c)) > 0, F.concat(F.lit(label), tag_list(c)))

    return F.concat_ws(
        " | ", part(LABEL_CUISINE, cuisine), part(LABEL_FOOD, food), part(LABEL_LOCATION, location)
    )


def search_text(
    review: Column | str,
    facets: list[Column | str],
    max_chars: int | None = None,
) -> Column:
    """Tags in front of the review, or of its first ``max_chars`` characters; without tags just the review."""
    tags = F.concat_ws(" ", *[F.nullif(tag_list(f), F.lit("")) for f in facets])
    whole = F.coalesce(as_column(review), F.lit(""))
    head = whole if max_chars is None else F.substring(whole, 1, max_chars)
    return F.when(tags != "", F.concat(tags, F.lit(": "), head)).otherwise(head)


def with_prefix(c: Column | str, prefix: str) -> Column:
    return F.concat(F.lit(prefix), as_column(c)) if prefix else as_column(c)


def has_metadata(cuisine: Column | str, food: Column | str, location: Column | str) -> Column:
    """1.0 when any of the three facets that count has a tag."""
    sizes = [F.size(as_column(c)) for c in (cuisine, food, location)]
    return ((sizes[0] + sizes[1] + sizes[2]) > 0).cast("double")


def words(c: Column | str) -> Column:
    """Lower-cased runs of letters, marks and digits."""
    spaced = F.trim(F.regexp_replace(F.lower(as_column(c)), r"[^\p{L}\p{M}\p{N}]+", " "))
    return F.filter(F.split(spaced, " "), lambda t: t != "")


def padded_words(c: Column | str) -> Column:
    """The words with one space around each: a keyword is a whole word of it if its own padded form is inside."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(as_column(c)), r"[^\p{L}\p{M}\p{N}]+", " ")), F.lit(" "))


def improvement_pct(tuned: Column | str, base: Column | str) -> Column:
    """Relative change in percent; a baseline of zero or less counts as 0 or 100."""
    t, b = as_column(tuned), as_column(base)
    return F.when(b > 0, (t - b) / F.when(b > 0, b) * 100).when(t == 0, F.lit(0.0)).otherwise(F.lit(100.0))
