"""Text columns: normal forms, token sets, patterns, redaction, splitting. JVM expressions only."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ligatures and the letters they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ĳ": "ij"}

#: Function words left out of keyword lists.
STOPWORDS = ["about", "after", "and", "are", "but", "for", "from", "have", "her", "his", "its", "not", "that", "the", "their", "there", "they", "this", "was", "were", "which", "with", "you", "your"]


@functools.cache
def _folds() -> tuple[str, str]:
    """Lower-case characters whose compatibility decomposition (NFKD) without marks is one of a-z, 0-9, and what it is."""
    found = []
    for code in range(0x80, 0x10000):
        base = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0].isascii() and base[0].isalnum():
            found.append((chr(code), base[0].lower()))
    return "".join(c for c, _ in found), "".join(b for _, b in found)


def folded(text: Column) -> Column:
    """Lower case, decomposed (NFKD) and without marks, as far as the result is a-z, 0-9; other characters stay."""
    low = F.regexp_replace(F.lower(text), "\\p{M}+", "")
    for ligature, letters in LIGATURES.items():
        low = F.replace(low, F.lit(ligature), F.lit(letters))
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(low, *_folds())).otherwise(F.lower(text))


def plain(text: Column) -> Column:
    """Lower case without accents; other characters than a-z, 0-9 become single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(folded(text), "[^a-z0-9]+", " "))


def squeezed(text: Column) -> Column:
    """The plain form without separators."""
    return F.regexp_replace(folded(text), "[^a-z0-9]+", "")


def slug(text: Column, sep: str = "-", most: int = 60) -> Column:
    """Plain form with separators, at most ``most`` characters, no separator at the end."""
    return F.regexp_replace(F.substring(F.regexp_replace(plain(text), " ", sep), 1, most), f"{sep}+$", "")


def tokens(text: Column, least: int = 1) -> Column:
    """Distinct plain tokens of at least ``least`` characters."""
    return F.array_distinct(F.filter(F.split(plain(text), " "), lambda t: F.length(t) >= max(1, least)))


def distinctive(text: Column, common: list[str], least: int = 4) -> Column:
    """Distinct tokens of ``least`` characters or more that are not common words, sorted."""
    return F.array_sort(F.array_except(tokens(text, least), F.array(*[F.lit(c) for c in common])))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 where both are empty or one is null."""
    union = F.size(F.array_union(a, b))
    return F.coalesce(F.when(union > 0, F.size(F.array_intersect(a, b)) / union), F.lit(0.0))


def scrub(text: Column, phrases: dict[str, str]) -> Column:
    """Replaces phrases, case ignored, one after another, and then runs of spaces by one."""
    for phrase, new in phrases.items():
        text = F.regexp_replace(text, "(?i)" + "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in phrase), new)
    return F.trim(F.regexp_replace(text, " +", " "))


def strip_markup(html: Column) -> Column:
    """Visible text of simple HTML: comments, scripts and styles go with content, tags become spaces, entities are read."""
    for pattern in ("(?s)<!--.*?-->", "(?is)<(script|style)[^>]*>.*?</\\1>", "<[^>]*>"):
        html = F.regexp_replace(html, pattern, " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        html = F.replace(html, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(html, "[ \\t\\r\\n]+", " "))


#: Characters of emoji and what joins or colours them.
EMOJI = "[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{2B00}-\\x{2BFF}\\x{FE0F}\\x{200D}\\x{20E3}]"


#: What a voice does not read: fenced code, tags, emoji.
UNSPOKEN = "(?s)```.*?(?:```|$)|<[^<>]*>|" + EMOJI
#: What it reads the words of: images and links by their text, code by its content.
WORDED = {"!?\\[([^\\]]*)\\]\\([^()]*\\)": "$1", "`([^`]*)`": "$1"}
#: Marks without a sound: those that open a line, and those around words.
LINE_MARKS, WORD_MARKS = "(?m)^[ \\t]*(?:#{1,6}|>)[ \\t]+", "[*~]+|_{2,}|(?<![A-Za-z0-9])_|_(?![A-Za-z0-9])"


def spoken(text: Column) -> Column:
    """Text for a voice: without emoji, tags and code blocks, the words of links, images and code without their Markdown, at most one blank line and
    single spaces. Underscores inside a name stay; null reads as empty."""
    said = F.regexp_replace(F.coalesce(text, F.lit("")), UNSPOKEN, "")
    for whole, words in WORDED.items():
        said = F.regexp_replace(said, whole, words)
    said = F.regexp_replace(F.regexp_replace(said, LINE_MARKS, ""), WORD_MARKS, "")
    lines = F.transform(F.split(said, "\n"), lambda line: F.trim(F.regexp_replace(line, "[ \t\r]+", " ")))
    # a blank line counts once, and not at the ends
    kept = F.filter(lines, lambda line, i: (line != "") | (F.get(lines, i - 1) != ""))
    return F.regexp_replace(F.array_join(kept, "\n"), "^\n+|\n+$", "")


def redact(text: Column) -> Column:
    """Masks values of key-like query parameters, bearer tokens, and all long tokens in URL paths."""
    text = F.regexp_replace(text, "(?i)([?&](?:api_?key|key|token|access_token|secret|utm_source)=)[^&\\s\"'>]+", "$1***")
    text = F.regexp_replace(text, "(?i)(bearer\\s+)[A-Za-z0-9._-]+", "$1***")
    # each match goes on from the one before, so that every token of a path is met
    return F.regexp_replace(text, "((?:https?://|\\G(?!^))[^\\s?\"]*?/)[A-Za-z0-9_-]{24,}", "$1***")


def url_title(url: Column) -> Column:
    """Readable title of a URL's last path segment: no extension, percent-decoded, separators as spaces; the host where
    there is no path. A segment that does not decode is taken as it is."""
    path = F.regexp_extract(url, "^[a-z]+://[^/?#]+/?([^?#]*)", 1)
    last = F.regexp_replace(F.regexp_extract(path, "([^/]*)/?$", 1), "\\.[A-Za-z0-9]+$", "")
    last = F.coalesce(F.try_url_decode(last), last)
    host = F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1)
    return F.trim(F.regexp_replace(F.when(last != "", last).otherwise(host), "[-_+%. ]+", " "))


def slug_title(url: Column) -> Column:
    """Title of a listing page's slug: the last path segment with - and _ as spaces, nothing decoded; empty without a URL."""
    last = F.regexp_extract(F.regexp_replace(F.coalesce(url, F.lit("")), "/+$", ""), "([^/]*)$", 1)
    return F.trim(F.translate(last, "-_", "  "))


def quoted(value: Column) -> Column:
    """A value inside single quotes of a filter text: quotes doubled. Filters here are columns; this is for text sent elsewhere."""
    return F.replace(value, F.lit("'"), F.lit("''"))


def license_code(name: Column) -> Column:
    """cc-by-nc, cc-by-sa, cc-by, cc0, pd or '' of a free-text license name."""
    low = F.lower(name)
    rules = [("cc-by-nc", "cc[ -]by-nc"), ("cc-by-sa", "cc[ -]by-sa|sharealike"), ("cc-by", "cc[ -]by|creative commons attribution"), ("cc0", "cc0|cc-zero"), ("pd", "public domain")]
    return F.coalesce(*[F.when(low.rlike(p), F.lit(c)) for c, p in rules], F.lit(""))


def inline(text: Column) -> Column:
    """White space as single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(text, "[ \\t\\r\\n]+", " "))


def truncate(text: Column, most: int, least: int = 80) -> Column:
    """Inline form; one of more than ``most`` characters is cut there, at its last ". ", "; " or ", " if that stands
    ``least`` characters in or later, and gets three dots."""
    flat = inline(text)
    head = F.substring(flat, 1, most)
    # the longest beginning that one of the marks follows
    at = F.length(F.regexp_extract(head, "^(.*)[.;,] ", 1))
    found = head.rlike("[.;,] ") & (at >= least)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.trim(F.when(found, F.substring(head, F.lit(1), at)).otherwise(head)), F.lit("...")))


def phrase_of(summary: Column, others: list[Column], words: int = 12, most: int = 96) -> Column:
    """The first words of a summary, or where it is blank the other parts that are not, joined; truncated."""
    flat = inline(F.coalesce(summary, F.lit("")))
    first = F.array_join(F.slice(F.split(flat, " "), 1, words), " ")
    rest = F.array_join(F.filter(F.array(*[F.coalesce(o, F.lit("")) for o in others]), lambda o: o != ""), " ")
    return truncate(F.when(flat != "", first).otherwise(rest), most)


def sentences(text: Column) -> Column:
    """Sentences: split after . ! or ? followed by white space, and at line ends; blank ones go."""
    marked = F.regexp_replace(text, "([.!?])[ \\t\\r\\n]+", "$1\n")
    return F.filter(F.transform(F.split(marked, "\n"), lambda s: F.trim(s)), lambda s: s != "")


def pack(parts: Column, most: int, sep: str = " ") -> Column:
    """Greedy packing of parts to chunks of at most ``most`` characters; a longer part is a chunk of its own.

    One fold over the parts, without Python.
    """
    empty = F.struct(F.lit(None).cast("string").alias("open"), F.expr("cast(array() as array<string>)").alias("done"))

    def step(acc, x):
        fits = acc["open"].isNotNull() & (F.length(acc["open"]) + len(sep) + F.length(x) <= most)
        done = F.when(acc["open"].isNull() | fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        return F.struct(F.when(fits, F.concat(acc["open"], F.lit(sep), x)).otherwise(x).alias("open"), done.alias("done"))

    return F.aggregate(parts, empty, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


#: Ends of paragraphs, sentences, clauses and words: a text may be cut after one.
CUTS = ["(?<=\\n)(?=[ \\t\\r]*\\n)", "(?<=[.!?][ \\t\\r\\n])(?=\\S)", "(?<=[,;:][ \\t\\r\\n])(?=\\S)", "(?<=[ \\t\\r\\n])(?=\\S)"]


def split_within(text: Column, most: int) -> Column:
    """The text cut to pieces of at most ``most`` characters that make it up again when joined: packed paragraphs; a paragraph that is too long by
    sentences, a sentence by clauses, a clause by words, and a longer word anywhere. Null and empty texts have no pieces."""
    pieces = F.array(F.coalesce(text, F.lit("")))
    by = lambda cut: lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(F.split(p, cut))
    for cut in CUTS:
        pieces = F.flatten(F.transform(pieces, by(cut)))
    hard = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda i: F.substring(p, i * most + 1, F.lit(most)))
    pieces = F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(hard(p))))
    return pack(F.filter(pieces, lambda p: p != ""), most, "")


def capital_phrases(text: Column, joins: list[str]) -> Column:
    """Runs of capitalised words, joined words like "of" between two of them included, in order without repeats."""
    word, between = "\\p{Lu}[\\p{L}\\p{N}'-]*", "(?:" + "|".join(joins) + ")"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({word}(?:[ ](?:{between}[ ])*{word})*)"), F.lit(1)))


def labels(text: Column, rules: dict[str, str]) -> Column:
    """Sorted names of all rules whose pattern occurs."""
    return F.array_sort(F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in rules.items()])))


def first_label(text: Column, rules: dict[str, str], other: str) -> Column:
    """Name of the first rule whose pattern occurs, else ``other``."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(n)) for n, p in rules.items()], F.lit(other))


def contains_words(text: Column, phrase: Column) -> Column:
    """Whether the plain form of the text holds the plain phrase at word limits."""
    return F.concat(F.lit(" "), plain(text), F.lit(" ")).contains(F.concat(F.lit(" "), plain(phrase), F.lit(" ")))
