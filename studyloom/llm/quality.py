"""Line-first quality rules, in DataFrame expressions only.

Lines are judged first, by punctuation, navigation and boilerplate rules; failing lines are removed; a document that
loses too much of its text is rejected. Word-level counts of the whole text (symbols, repeated lines, repeated 8-word
windows) reject further documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, table

WINDOW = 8
#: Fixed values, by language: phrases that mark a line as boilerplate, and entries of menus.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "click here to", "subscribe to our newsletter", "lorem ipsum",
    "alle rechte vorbehalten", "cookie-richtlinie", "datenschutzerklärung", "nutzungsbedingungen", "javascript aktivieren", "klicken sie hier", "newsletter abonnieren",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "mentions légales", "activer javascript", "cliquez ici", "abonnez-vous à notre newsletter",
    "todos los derechos reservados", "política de cookies", "política de privacidad", "términos de uso", "aviso legal", "habilitar javascript", "haga clic aquí", "suscríbete a nuestro boletín",
)
NAVIGATION = (
    "home", "menu", "login", "log in", "sign in", "sign up", "register", "search", "next", "previous", "back to top", "share", "skip to content",
    "startseite", "menü", "anmelden", "abmelden", "registrieren", "suche", "weiter", "zurück", "nach oben", "teilen", "zum inhalt springen",
    "accueil", "connexion", "se connecter", "s'inscrire", "rechercher", "suivant", "précédent", "haut de page", "partager", "aller au contenu",
    "inicio", "menú", "iniciar sesión", "cerrar sesión", "registrarse", "buscar", "siguiente", "anterior", "volver arriba", "compartir", "ir al contenido",
)
#: A word of bars only, or one that ends in a run of symbols or marks; a line that may hold one; a word that closes a sentence.
MARKED, MAY_HOLD_MARKED = r"^[|»›>•·]+$|[#*$%&|<>!?~^=_]{3,}$", r"[|»›>•·]|[#*$%&<>!?~^=_]{3}"
CLOSING = r"""[.!?…:;。！？؟]['"”’»)\]]*(?:[\x20\x09-\x0D]|$)"""


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def line_verdict(line: Column, words: Column) -> Column:
    """The rule that a line of these words fails, or null where it stays.

    punctuation: at least 5 words, of which more than 40 % are bars or end in a run of 3 or more symbols or marks; navigation:
    at most 4 words that are a menu's entry; boilerplate: at most 20 words and a stock phrase; line end: at least 5 words,
    of which none closes a sentence. Blank lines fail no rule.
    """
    n = F.size(words)
    marked = F.when(line.rlike(MAY_HOLD_MARKED), F.size(F.filter(words, lambda w: w.rlike(MARKED)))).otherwise(0)
    low = F.lower(F.trim(line))
    return (
        F.when(n == 0, F.lit(None).cast("string"))
        .when((n >= 5) & (marked * 10 > n * 4), "punctuation")
        .when((n <= 4) & low.isin(*NAVIGATION), "navigation")
        .when((n <= 20) & F.exists(F.array(*map(F.lit, BOILERPLATE)), lambda p: F.contains(low, p)), "boilerplate")
        .when((n >= 5) & ~line.rlike(CLOSING), "line end")
    )


def quality_rules(docs: DataFrame, max_lost: float = 0.5, max_symbols: float = 0.1, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, text, ...) -> one row per input row: counts, base_failed, kept, cleaned text and n_removed_lines.

    keep names the columns of docs to carry, doc_id unless given; those named like an added one are not carried (carry a
    struct of them instead).

    Counts are over the whole text, null as empty, however long. kept is false where the base rules fail (under 20 words, or
    over 30 % of words in repeated windows), where the removed lines hold over max_lost of the word characters, or where over
    max_symbols of them are symbols. cleaned is the text without its failing lines, the text itself where none fails. Other
    columns are not read; repeated rows are judged each on its own; an empty table gives an empty result.
    """
    carried = [c for c in (keep or ["doc_id"])]
    whole = F.struct(*(F.col(c) for c in carried)).alias("_row")
    base = docs.select(whole, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    base = base.select("_row", "t", _words(F.col("t")).alias("w"), F.split("t", "\n").alias("l"))
    hashes = base.select("_row", "t", "l", F.size("w").alias("n_words"), F.length(F.array_join("w", "")).alias("word_chars"), F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    made = hashes.withColumn(
        "win",
        F.expr(f"CASE WHEN n_words >= {WINDOW} THEN transform(sequence(0, n_words - {WINDOW}), i -> xxhash64(" + ", ".join(f"h[i + {k}]" for k in range(WINDOW)) + ")) ELSE cast(array() AS array<bigint>) END"),
    ).drop("h")
    # Places of the windows that occur again, in order; each covers 8 words or as many as up to the next place.
    placed = made.withColumn(
        "p",
        F.expr(
            """CASE WHEN size(array_distinct(win)) = size(win) THEN cast(array() AS array<int>)
            ELSE aggregate(array(array_sort(transform(win, (x, i) -> struct(x AS x, i AS i)))), cast(array() AS array<int>),
                (acc, s) -> array_sort(transform(filter(transform(s, (e, k) -> struct(e.i AS i,
                    (k > 0 AND s[k - 1].x = e.x) OR (k < size(s) - 1 AND get(s, k + 1).x = e.x) AS again)), z -> z.again), z -> z.i))) END"""
        ),
    ).drop("win")
    # Words are split once a line: the inner struct is made before the verdict reads it several times.
    split = F.transform("l", lambda x: F.struct(x.alias("line"), _words(x).alias("words")))
    verdicts = F.transform(split, lambda x: F.struct(x["line"].alias("line"), (F.size(x["words"]) > 0).alias("filled"), line_verdict(x["line"], x["words"]).alias("fails")))
    out = placed.select(
        "_row", "n_words", "word_chars", "t",
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
        verdicts.alias("v"),
        F.expr(f"CASE WHEN size(p) = 0 THEN 0 ELSE {WINDOW} + aggregate(transform(slice(p, 2, size(p)), (x, k) -> least({WINDOW}, x - p[k])), 0, (a, x) -> a + x) END").alias("n_repeat_words"),
    )
    lines = F.transform(F.filter("v", lambda x: x["filled"]), lambda x: x["line"])
    out = out.withColumn("lw", lines)
    out = out.select(
        "_row",
        *(F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols")),
        (F.size("lw") - F.size(F.array_distinct("lw"))).cast("long").alias("n_dup_lines"),
        F.col("n_repeat_words").cast("long").alias("n_repeat_words"),
        F.size(F.filter("v", lambda x: x["fails"].isNotNull())).cast("long").alias("n_removed_lines"),
        F.array_join(F.transform(F.filter("v", lambda x: x["fails"].isNull()), lambda x: x["line"]), "\n").alias("cleaned"),
        F.length(F.regexp_replace(F.array_join(F.transform(F.filter("v", lambda x: x["fails"].isNotNull()), lambda x: x["line"]), ""), SPACES, "")).alias("lost"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    verdict = (F.col("lost") <= max_lost * F.col("word_chars")) & (F.col("n_symbols") <= max_symbols * F.col("word_chars"))
    made = out.select("*", failed.alias("base_failed"), (~failed & verdict).alias("kept")).drop("lost")
    added = set(made.columns)
    return made.select(*(F.col("_row")[c].alias(c) for c in carried if c not in added), *(c for c in made.columns if c != "_row"))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("cleaned")
