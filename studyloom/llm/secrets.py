"""Secret scans with multipart credential linking, in DataFrame expressions only.

Strong candidates (an assignment to a secret's name, an access key id, a long run of hex digits) are always reported.
Weak candidates (a user or client name, a password-like value, an endpoint) alone mean nothing: they are reported only
when parts that complete them lie within the same scope, found by an interval join of all parts of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, replaced_text, table, whole_row

SCOPE, BUCKET = 256, 512
#: Kind, pattern, least length and the group it is measured on. The order of kinds breaks ties of start.
STRONG = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", r"AKIA[A-Z0-9]{16,}", 20, 0),
    ("hex", r"[0-9a-f]{24,}", 24, 0),
)
WEAK = (
    ("weak_id", r"""(?i:user_?(?:name|id)?|login|client_?id|account_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}""", 0, 0),
    ("weak_secret", r"""(?i:pass|pwd|private_?key|auth|credential|bearer)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/]{0,39}[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_-])""", 0, 0),
    ("endpoint", r"""[a-z][a-z0-9+]{1,9}://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]{4,}""", 0, 0),
)
KINDS = [k for k, *_ in (*STRONG, *WEAK)]
PART = "array<struct<s: int, k: int, e: int>>"


def found(text: str, kind: str, pattern: str, least: int, group: int) -> Column:
    """The spans of the leftmost non-overlapping matches: array of (start, kind's number, end), short ones dropped.

    A match's start is the length of all text before it: of the pieces between matches and of the matches.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    steps = F.arrays_zip(matches.alias("m"), pieces.alias("p"), kept.alias("g"))
    steps = F.filter(steps, lambda x: x["m"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast(PART).alias("out"))
    number = F.lit(KINDS.index(kind))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["p"])
        end = begin + F.length(x["m"])
        span = F.array(F.struct(begin.alias("s"), number.alias("k"), end.alias("e")))
        return F.struct(end.alias("at"), F.when(F.length(x["g"]) >= least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.when(F.col(text).rlike(pattern), F.aggregate(steps, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(PART))


def rendered(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def linked_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, text_hash, s, k, e) spans of all kinds -> the weak ones whose complementary parts lie within `scope` code points.

    A weak identifier needs a secret, a weak secret an identifier or an endpoint, an endpoint both an identifier and a
    secret. Weak spans that overlap a strong one are left out. The interval join meets spans in buckets of positions,
    so a document with very many of them is spread over tasks, and at most a bucket's spans meet.
    """
    kind = lambda *names: F.col("pk").isin(*(KINDS.index(n) for n in names))
    weak = parts.where(F.col("k") >= len(STRONG))
    slots = lambda lo, hi: F.explode(F.sequence(F.floor(lo / BUCKET), F.floor(hi / BUCKET)))
    left = weak.select("*", slots(F.col("s"), F.col("e")).alias("b"))
    right = parts.select(F.col("doc_id").alias("pd"), F.col("text_hash").alias("ph"), F.col("s").alias("ps"), F.col("k").alias("pk"), F.col("e").alias("pe"), slots(F.col("s") - scope, F.col("e") + scope).alias("pb"))
    near = F.col("doc_id").eqNullSafe(F.col("pd")) & (F.col("text_hash") == F.col("ph")) & (F.col("b") == F.col("pb"))
    pairs = left.join(right, near & (F.col("ps") < F.col("e") + scope) & (F.col("s") < F.col("pe") + scope))
    other = (F.col("ps") >= F.col("e")) | (F.col("s") >= F.col("pe"))
    judged = pairs.groupBy("doc_id", "text_hash", "s", "k", "e").agg(
        F.bool_or(other & kind("access", "weak_id")).alias("id"),
        F.bool_or(other & kind("assign", "hex", "weak_secret")).alias("secret"),
        F.bool_or(other & kind("endpoint")).alias("place"),
        F.bool_or(~other & (F.col("pk") < len(STRONG))).alias("covered"),
    )
    mine = lambda n: F.col("k") == KINDS.index(n)
    whole = (mine("weak_id") & F.col("secret")) | (mine("weak_secret") & (F.col("id") | F.col("place"))) | (mine("endpoint") & F.col("id") & F.col("secret"))
    return judged.where(whole & ~F.col("covered")).select("doc_id", "text_hash", F.struct("s", "k", "e").alias("span"))


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, text, ...) -> one row per input row: doc_id, text_hash, base and all spans (array of start, kind, end).

    Positions are code points, end exclusive; a null text is empty, a very long one is read whole. Repeated rows have equal
    spans; spans that tie in start are told apart by kind. An empty table gives an empty result; other columns are not read.
    Texts are read once: their candidates, strong and weak, are written as a table, from which both sides of the interval join
    and the result are taken.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    any_weak = F.col("t").rlike("|".join(f"(?:{x[1]})" for x in WEAK))
    strong, weak = (F.concat(*(found("t", *x) for x in kinds)) for kinds in (STRONG, WEAK))
    weak = F.when(any_weak, weak).otherwise(F.array().cast(PART))
    held = materialize(rows.select("doc_id", F.xxhash64("t").alias("text_hash"), strong.alias("base"), weak.alias("weak")), "candidates")
    # Only texts with a weak candidate can gain spans.
    parts = held.where(F.size("weak") > 0).select("doc_id", "text_hash", F.explode(F.concat("base", "weak")).alias("x")).select("doc_id", "text_hash", "x.s", "x.k", "x.e").distinct()
    more = linked_parts(parts, scope).groupBy("doc_id", "text_hash").agg(F.collect_list("span").alias("more"))
    more = more.select(F.col("doc_id").alias("md"), F.col("text_hash").alias("mh"), "more")
    out = held.join(more, F.col("doc_id").eqNullSafe(F.col("md")) & (F.col("text_hash") == F.col("mh")), "left")
    return out.select("doc_id", "text_hash", "base", F.concat("base", F.coalesce("more", F.array().cast(PART))).alias("spans"))


def redact(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """All columns of docs, each reported span of the text replaced by its kind in angle brackets; n_chars, where docs has it,
    follows.

    Overlapping spans are replaced as one. A null or empty text, and any without a span, stays as it is. Rows ride as one struct, so
    no column name clashes; repeated rows are each redacted; an empty table gives an empty result.
    """
    spans = scan_secrets(docs, scope).where(F.size("spans") > 0).groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.first("spans").alias("spans"))
    text = F.col("row.text").cast("string")
    rows = docs.select(whole_row(docs).alias("row"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"))
    both = rows.join(spans, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left")
    names = F.array(*(F.lit(f"<{k}>") for k in KINDS))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        between = F.substring(text, acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        mark = F.when(x["s"] >= acc["at"], F.concat(between, F.element_at(names, x["k"] + 1))).otherwise(F.lit(""))
        return F.struct(F.concat(acc["out"], mark).alias("out"), F.greatest(acc["at"], x["e"]).alias("at"))

    clean = F.aggregate(F.array_sort("spans"), begin, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return replaced_text(both.select("row", F.when(F.col("spans").isNotNull(), clean).alias("text")), docs.columns)


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    out = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *(count(k) for k, *_ in STRONG), F.sha2(rendered(F.col("base")), 256).alias("base_sha256"), rendered(F.col("spans")).alias("spans"))
