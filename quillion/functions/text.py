"""Text functions as column expressions; all stay inside the JVM.

Words are runs of letters, digits and underscores in Unicode's sense (Java's ``\\w`` is ASCII), white space includes the
no-break space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
SPACE = r"[\s\p{Z}]+"


def _fold_pairs() -> tuple[str, str]:
    """Letters that decompose into a base letter and marks, and those base letters."""
    import unicodedata

    pairs = []
    for code in range(0xC0, 0x250):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if chr(code).islower() and len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _fold_pairs()


def squeeze(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, SPACE, " "))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def fold(x: Column) -> Column:
    """Lower case without accents, white space squeezed. Combining marks that stand alone go too."""
    return squeeze(F.regexp_replace(F.translate(F.lower(x), ACCENTED, PLAIN), r"\p{Mn}", ""))


def query_key(x: Column) -> Column:
    """A question as the cache compares it: folded, other marks than letters, digits and underscores as spaces."""
    return squeeze(F.regexp_replace(fold(x), r"[^\p{L}\p{N}_\s]", " "))


def words(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(WORD), F.lit(0))


def tokens(x: Column, longer_than: int = 2, stop: list[str] | None = None) -> Column:
    """Lower-case words of more than ``longer_than`` characters without stop words, in order, with repeats."""
    stop = stop or []
    return F.filter(words(x), lambda w: (F.length(w) > longer_than) & ~w.isin(stop) if stop else F.length(w) > longer_than)


def word_count(x: Column) -> Column:
    """White-space separated words; 0 for blank texts."""
    s = squeeze(x)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, " ")))


def spaced_words(x: Column) -> Column:
    return F.filter(F.split(squeeze(x), " "), lambda w: w != "")


def contains_any(folded: Column, keywords: list[str]) -> Column:
    """Whether a folded text holds any of the keywords, anywhere, as a substring."""
    out = F.lit(False)
    for k in keywords:
        out = out | folded.contains(k)
    return out


def sentences(x: Column, longer_than: int = 8, ends: str = r"[.!?;]+") -> Column:
    """Sentences: line by line without bullets, cut at sentence ends, stripped, of more than ``longer_than`` characters."""
    lines = F.transform(F.split(x, r"\r\n|\r|\n"), lambda s: strip(F.regexp_replace(s, r"^\s*[-*]\s*", "")))
    pieces = F.flatten(F.transform(lines, lambda s: F.split(s, ends)))
    return F.filter(F.transform(pieces, strip), lambda s: F.length(s) > longer_than)


def plain_sentences(x: Column, longer_than: int = 15) -> Column:
    """Sentences of the whole text, for the embedding verifier."""
    return F.filter(F.transform(F.split(x, r"[.!?]+"), strip), lambda s: F.length(s) > longer_than)


def sentence_number(x: Column) -> Column:
    return F.size(F.split(x, r"[.!?]", -1))


def windows(items: Column, size: int = 3, longer_than: int = 30) -> Column:
    """Every run of ``size`` items joined by spaces (shorter at the end), of more than ``longer_than`` characters."""
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda i: F.array_join(F.slice(items, i, size), " ")), lambda s: F.length(s) > longer_than)


def cut_at_sentence(x: Column, limit: Column) -> Column:
    """At most ``limit`` characters, cut after a last full stop beyond 70 % of them, with dots if anything was cut."""
    head = F.substring(x, F.lit(1), limit)
    dot = F.when(F.instr(F.reverse(head), ".") > 0, F.length(head) - F.instr(F.reverse(head), ".")).otherwise(-1)
    return F.when(F.length(x) > limit, F.concat(F.when(dot > limit * 0.7, F.substring(head, F.lit(1), dot + 1)).otherwise(head), F.lit("..."))).otherwise(x)


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def preview(x: Column, n: int = 200) -> Column:
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("..."))).otherwise(x)


def capitalised(x: Column) -> Column:
    return F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, 2, 2**31 - 1)))


def stable_id(*parts: Column) -> Column:
    """MD5 of the parts between bars; null, empty and zero parts are empty."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat_ws("|", *(F.when(t == "0", "").otherwise(t) for t in texts)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared items of two arrays by all their items; 0 if the first is empty."""
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))
