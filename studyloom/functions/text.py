"""String functions as column expressions. White space is Unicode white space, as in the texts' origin."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WS = r"(?U)\s"


def trim(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def collapse(x: Column) -> Column:
    return trim(F.regexp_replace(x, r"(?U)\s+", " "))


def normal_title(x: Column) -> Column:
    """Trimmed, lower case, inner white space collapsed."""
    return F.lower(collapse(x))


@lru_cache(maxsize=1)
def decomposed() -> tuple[dict[str, str], dict[str, str], dict[str, str], str]:
    """What NFKD makes of characters, as far as a-z and 0-9 come out: letters with marks behind, single letters and digits, longer
    strings; and the combining marks, as a character class."""
    marked, single, longer, marks = {}, {}, {}, []
    blocks = ((0x80, 0x3400), (0xA000, 0xAC00), (0xF900, 0x20000))  # ideographs and Hangul syllables between give none of it
    for c in (c for lo, hi in blocks for c in map(chr, range(lo, hi))):
        d = unicodedata.normalize("NFKD", c) if unicodedata.decomposition(c) else ""
        if unicodedata.combining(c) or (d and all(map(unicodedata.combining, d))):
            marks.append(ord(c))
            continue
        if not any("a" <= x <= "z" or "0" <= x <= "9" for x in d):
            continue
        if len(d) == 1:
            single[c] = d
        elif "a" <= d[0] <= "z" and all(unicodedata.combining(x) for x in d[1:]):
            marked[c] = d[0]
        else:
            longer[c] = re.sub("[A-Z]", " ", d)
    runs = [[marks[0], marks[0]]]
    for m in marks[1:]:
        runs[-1][1] = m if m == runs[-1][1] + 1 else runs[-1][1]
        if m != runs[-1][1]:
            runs.append([m, m])
    return marked, single, longer, "".join(rf"\x{{{lo:X}}}-\x{{{hi:X}}}" for lo, hi in runs)


PLAIN = r"[^\x00-\x7F]"


def compatible(low: Column, apart: bool) -> Column:
    """Lower-case text as NFKD has it, as far as a-z and 0-9 go: a letter's mark goes, or, where `apart`, is a blank. Spark has no
    normalisation; the tables follow from Unicode's."""
    marked, single, longer, combining = decomposed()
    named = "".join(rf"\x{{{ord(c):X}}}" for c in longer)
    table = F.create_map(*(F.lit(x) for kv in longer.items() for x in kv))
    pieces = F.regexp_extract_all(low, F.lit(f"[{named}]|[^{named}]+"), F.lit(0))
    long = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(table, p), p)), "")
    some = F.length(F.translate(low, "".join(longer), "")) < F.length(low)  # much cheaper than a class of so many characters
    text = F.when(some, long).otherwise(low)
    text = F.translate(text, "".join(single), "".join(single.values()))
    if not apart:
        return F.regexp_replace(F.translate(text, "".join(marked), "".join(marked.values())), f"[{combining}]", "")
    # No upper case is left in the text, so it can stand for "this letter and a blank" for a moment.
    upper = F.translate(text, "".join(marked), "".join(marked.values()).upper())
    return F.lower(F.regexp_replace(upper, "([A-Z])", "$1 "))


def identity_key(x: Column) -> Column:
    """Lower case, accents folded, everything but letters and digits one space."""
    low = F.lower(x)
    folded = F.when(low.rlike(PLAIN), compatible(low, apart=False)).otherwise(low)
    return F.trim(F.regexp_replace(folded, r"[^a-z0-9]+", " "))


def token_set(x: Column, least: int = 3) -> Column:
    """Distinct words of a-z and 0-9 of at least `least` characters, lower case. A letter's combining mark (after NFKD) parts
    words like any other character: `r\u00e9sum\u00e9` gives `sume`."""
    low = F.lower(x)
    split = F.when(low.rlike(PLAIN), compatible(low, apart=True)).otherwise(low)
    return F.filter(F.array_distinct(F.split(split, r"[^a-z0-9]+")), lambda w: F.length(w) >= least)


def fuzzy_score(tokens: Column, other: Column) -> Column:
    """Share of `tokens` that `other` holds; 0 for none."""
    n = F.size(tokens)
    return F.when(n > 0, F.size(F.array_intersect(tokens, other)) / n).otherwise(F.lit(0.0))


#: Ends of a line, and white space at a text's edges, as scripts of the web know them.
LINE_END, EDGE = r"\n\r\u2028\u2029", r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"


def hash_normal(x: Column) -> Column:
    """CR LF to LF (a lone CR stays), no blanks before the end of a line or text, at most one empty line in a row, and no
    Unicode white space at the edges."""
    y = F.regexp_replace(x, r"\r\n", "\n")
    y = F.regexp_replace(y, rf"[ \t]+(?=[{LINE_END}]|\z)", "")
    return F.regexp_replace(F.regexp_replace(y, r"\n{3,}", "\n\n"), rf"\A[{EDGE}]+|[{EDGE}]+\z", "")


def text_hash(x: Column) -> Column:
    return F.sha2(hash_normal(x), 256)


def chunk_identity(locator: Column, content: Column) -> Column:
    """sha256 of the locator, a newline and the normalised content."""
    return F.sha2(F.concat(locator, F.lit("\n"), hash_normal(content)), 256)


def token_estimate(x: Column) -> Column:
    """A quarter of the trimmed UTF-16 units (a character beyond U+FFFF is two), rounded up, at least 1."""
    t = F.regexp_replace(x, rf"\A[{EDGE}]+|[{EDGE}]+\z", "")
    units = F.length(t) + F.when(t.rlike(r"[\x{10000}-\x{10FFFF}]"), F.regexp_count(t, F.lit(r"[\x{10000}-\x{10FFFF}]"))).otherwise(0)
    return F.greatest(F.lit(1), F.ceil(units / 4)).cast("int")


def word_count(x: Column) -> Column:
    t = trim(x)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"(?U)\s+")))


def first_words(x: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(trim(x), r"(?U)\s+"), 1, n), " ")


def has_whole_word(x: Column, word: Column) -> Column:
    """Does x hold the word, not as a part of a longer one? Case does not count."""
    pattern = F.concat(F.lit(r"(?i)(?<![a-z0-9])\Q"), word, F.lit(r"\E(?![a-z0-9])"))
    return F.regexp_like(x, pattern)


def slug(x: Column) -> Column:
    """Letters and digits of the folded text, joined by hyphens, at most 60 characters; `topic` where there are none."""
    y = F.substring(F.regexp_replace(identity_key(x), " ", "-"), 1, 60)
    return F.when(y != "", y).otherwise("topic")


def safe_filename(x: Column, most: int = 200) -> Column:
    """Without control characters, slashes and percents as hyphens, no leading dots, trimmed; `upload` where nothing is left."""
    y = F.regexp_replace(x, r"[\x00-\x1F\x7F]", "")
    y = F.regexp_replace(F.regexp_replace(y, r"[/\\%]", "-"), r"^\.+", "")
    y = F.regexp_replace(y, rf"\A[{EDGE}]+|[{EDGE}]+\z", "")
    return F.when(y != "", F.substring(y, 1, most)).otherwise("upload")


def sentences(x: Column) -> Column:
    """Runs up to and with their closing marks, brackets and quotes; the rest at the end counts too."""
    found = F.regexp_extract_all(x, F.lit(r"""([^.!?]+[.!?]+[\])'"`’”]*\s*|[^.!?]+\z)"""), F.lit(1))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")


def byte_size_label(n: Column) -> Column:
    """Bytes in the largest unit that they reach, up to TB; one decimal below 10, none if it is 0."""
    d = n.cast("double")

    def shown(k: int, unit: str) -> Column:
        v = d / 1024**k
        some = F.regexp_replace(F.format_string("%.1f", F.floor(v * 10 + 0.5) / 10), r"\.0$", "")
        return F.concat(F.when(v >= 10, F.floor(v + 0.5).cast("string")).otherwise(some), F.lit(f" {unit}"))

    unknown = d.isNull() | F.isnan(d) | (d < 0) | (d == float("inf"))
    label = F.when(unknown, "an unknown size").when(d < 1024, F.concat(F.floor(d + 0.5).cast("string"), F.lit(" bytes")))
    for k, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        label = label.when(d < 1024 ** (k + 1), shown(k, unit))
    return label.otherwise(shown(4, "TB"))


@F.pandas_udf(StringType())
def canonical_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON without blanks, the keys of every object in order; null where the text is none. Spark sorts no keys."""

    def one(s: str | None) -> str | None:
        try:
            return None if s is None else json.dumps(json.loads(s), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    for x in batches:
        yield x.map(one)


def canonical_hash(x: Column) -> Column:
    """sha256 of a JSON text in canonical form, so that the order of keys doesn't count."""
    return F.sha2(canonical_json(x), 256)


def ago_label(ms: Column) -> Column:
    """How long ago something was synced, from milliseconds; null: never."""
    n = lambda size, unit: F.concat(F.floor(ms / size).cast("string"), F.lit(f"{unit} ago"))
    return F.when(ms.isNull(), "never synced").when(ms < 60_000, "just now").when(ms < 3_600_000, n(60_000, " min")).when(ms < 86_400_000, n(3_600_000, "h")).otherwise(n(86_400_000, "d"))


def due_label(days: Column) -> Column:
    """When something is due, from fractional days: hours within a day, whole days beyond."""
    hours, whole = F.abs(days) * 24, F.floor(F.abs(days))
    n = lambda x: F.floor(x).cast("string")
    late = F.when(hours < 1, "just now").when(hours < 24, F.concat(n(hours), F.lit("h ago"))).otherwise(F.concat(n(whole), F.when(whole == 1, " day ago").otherwise(" days ago")))
    ahead = F.when(hours < 1, "now").when(hours < 24, F.concat(F.lit("in "), n(hours), F.lit("h"))).when(whole == 1, "tomorrow").otherwise(F.concat(F.lit("in "), n(whole), F.lit(" days")))
    return F.when(days < 0, late).otherwise(ahead)


# Calendar summaries -------------------------------------------------------------------------------------------------

#: Patterns of rows that are not events, of descriptors in order of precedence, and of a title's noise.
PSEUDO_ROWS = (
    ("last_update", r"(?i)^\*\*\s*last update\b"),
    ("lms_course_shell", r"(?i)^[A-Z]{4,}\s+[A-Z]{3}-\d{4}[A-Z-]*\.[\dA-Z.]*\s*:"),
    ("proctoring_check", r"(?i)\bsmowl\b|\btest the (?:download|upload)\b|\bmultiattempt\b"),
)
DESCRIPTORS = (("retake", r"(?i)\b(?:retake|resit|convocatoria)\b"), ("final_exam", r"(?i)\bfinal\s+exam\b"), ("extra", r"(?i)\bextra\b"))
DESCRIPTOR_LABELS = {"regular": "Class", "extra": "Extra session", "retake": "Retake exam", "final_exam": "Final exam"}
SESSION = r"(?i)\(\s*ses\.?\s*(\d+)\s*(?:-\s*(\d+)\s*)?\)"
ROOM = r"(?i)\bT-\d{2}\.\d{2}[A-Z]?\b"
MODALITY = r"(?i)\b(?:asynchronous|live online|online|remote|on campus|ie tower)\b"
JUNK = r"(?i)(?:\s*(?:\||,\s*null\b))+"


def pseudo_row(summary: Column) -> Column:
    """The signature of a row that is not an event, or null."""
    return F.coalesce(*(F.when(trim(summary).rlike(pattern), name) for name, pattern in PSEUDO_ROWS))


def descriptor(remainder: Column) -> Column:
    return F.coalesce(*(F.when(remainder.rlike(pattern), name) for name, pattern in DESCRIPTORS), F.lit("regular"))


def session_range(summary: Column) -> tuple[Column, Column]:
    """First and last session of a `(Ses. 4-5)` mark, null without one; a reversed range is raised to its first."""
    first = F.nullif(F.regexp_extract(summary, SESSION, 1), F.lit("")).cast("int")
    last = F.nullif(F.regexp_extract(summary, SESSION, 2), F.lit("")).cast("int")
    return first, F.when(first.isNotNull(), F.greatest(first, F.coalesce(last, first)))


def strip_junk(x: Column) -> Column:
    """Runs of bars and `, null` to a space."""
    return collapse(F.regexp_replace(x, JUNK, " "))


def strip_echo(title: Column, location: Column) -> Column:
    """A title without the parts of its location (case doesn't count), room codes and modality words."""
    parts = F.filter(F.transform(F.split(F.coalesce(location, F.lit("")), r"\|"), trim), lambda p: p != "")

    def without(acc: Column, part: Column) -> Column:
        return F.regexp_replace(acc, F.concat(F.lit(r"(?i)\Q"), part, F.lit(r"\E")), F.lit(" "))

    bare = F.aggregate(parts, title, without)
    return collapse(F.regexp_replace(F.regexp_replace(bare, ROOM, " "), MODALITY, " "))


def normalize_summary(summary: Column, location: Column) -> list[Column]:
    """Columns course_name, title, session_from, session_to, descriptor, pseudo of a feed's raw summary."""
    fields = F.split(trim(summary), r"(?U)\s{2,}")
    rest = F.array_join(F.slice(fields, 2, F.greatest(F.size(fields) - 1, F.lit(1))), " ")
    first, last = session_range(summary)
    title = strip_echo(strip_junk(F.regexp_replace(rest, SESSION, " ")), location)
    return [
        strip_junk(fields[0]).alias("course_name"), title.alias("title"), first.alias("session_from"),
        last.alias("session_to"), descriptor(rest).alias("descriptor"), pseudo_row(summary).alias("pseudo"),
    ]


def occurrence_label(title: Column, first: Column, last: Column, kind: Column) -> Column:
    labels = F.create_map(*(F.lit(x) for kv in DESCRIPTOR_LABELS.items() for x in kv))
    sessions = F.when(last > first, F.concat(F.lit("Sessions "), first, F.lit("\u2013"), last)).when(first.isNotNull(), F.concat(F.lit("Session "), first))
    return F.coalesce(F.nullif(trim(F.coalesce(title, F.lit(""))), F.lit("")), sessions, labels[F.coalesce(kind, F.lit("regular"))])


DEADLINE_WORDS = r"(?i)\b(?:assignment|homework|test|quiz|exam|deadline|task)\b"


def item_kind(summary: Column, session: Column, kind: Column, known_course: Column, has_duration: Column, all_day: Column, categories: Column, repeats: Column) -> Column:
    """class, deadline or event, by six rules in order."""
    short = ~has_duration | all_day
    return (
        F.when(session.isNotNull() | (kind != "regular"), "class").when(known_course & has_duration, "class")
        .when(short & summary.rlike(r"(?i)\bdue\b"), "deadline").when(F.exists(categories, lambda c: c.rlike(DEADLINE_WORDS)), "deadline")
        .when(repeats & has_duration, "class").otherwise("event")
    )


def word_places(words: Column) -> Column:
    """array<struct<word, places array<int>>>: the distinct words of an array and where they stand, from 0, in order; by sorting, within
    the row, so that no shuffle gathers what lies in one text."""
    pairs = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))))
    # A function of an array of one binds its value: it's worked out once, not for each element.
    bind = lambda value, of: F.transform(F.array(value), of)[0]
    starts = lambda p: F.filter(F.transform(p, lambda x, i: F.when((i == 0) | (x["word"] != F.get(p, i - 1)["word"]), i)), lambda i: i.isNotNull())
    group = lambda p, s: F.transform(s, lambda at, k: F.struct(F.get(p, at)["word"].alias("word"), F.transform(F.slice(p, at + 1, F.coalesce(F.get(s, k + 1), F.size(p)) - at), lambda x: x["at"]).alias("places")))
    return bind(pairs, lambda p: bind(starts(p), lambda s: group(p, s)))
