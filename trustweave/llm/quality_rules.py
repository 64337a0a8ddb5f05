"""Quality rules: line-first cleaning in DataFrame expressions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A line fails by punctuation when symbols are more than this share of its visible characters, or when one word in so many ends in
#: doubled exclamation or question marks.
SYMBOL_SHARE, SHOUTS = 0.15, 4
#: A line of so many words fails by repetition when it has no more distinct ones than one in so many.
REPEATS, DISTINCT = 8, 4
#: A text that loses more than this share of its visible characters is rejected.
LOSS_SHARE = 0.5

# Patterns of lines that carry no prose; navigation by separators between entries, menu words and stock phrases in
# English, German, French and Spanish.
WS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>~^=_{}\[\]\\+@!]"
SHOUT = r"[!?]{2,}"
NAVIGATION = (
    r"(\|[^|]*){3}|([»›>•·][^»›>•·]*){3}|^[^|.!?]{1,40} \| [^|.!?]{1,40}\.?$"
    r"|^ *(home|menu|search|login|log in|sign in|sign up|next|previous|back to top|startseite|suche|anmelden|weiter|zurück|nach oben|accueil|recherche|connexion|suivant|précédent|retour|inicio|menú|buscar|iniciar sesión|siguiente|anterior|volver)( *[|/>»-] *| *$)"
)
BOILERPLATE = (
    r"(javascript|cookies?) (is|are|must be) (disabled|enabled|required)|uses? cookies|privacy policy|terms of (use|service)|all rights reserved|click here|subscribe to our newsletter|lorem ipsum"
    r"|verwende[nt]? cookies|datenschutzerklärung|nutzungsbedingungen|alle rechte vorbehalten|hier klicken|newsletter abonnieren"
    r"|utilis(e|ons) des cookies|politique de confidentialité|conditions d'utilisation|tous droits réservés|cliquez ici|abonnez-vous"
    r"|utiliza(mos)? cookies|política de privacidad|condiciones de uso|todos los derechos reservados|haga clic aquí|suscríbete"
)


def rate_texts(docs: DataFrame) -> DataFrame:
    """Statistics and verdict for every whole text of ``docs`` (doc_id, text; other columns are ignored).

    Lines that fail a rule (punctuation: too many symbols or doubled marks, or no letter or digit; navigation: separators
    between entries, or a lone menu word; boilerplate: few words over and over, or a stock phrase) are removed; the text is rejected if
    more than half its visible characters go with them, or if it fails the base rules. Returns doc_id,
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_failed_lines and
    cleaned (the text without failed lines). Null, empty and blank texts have no words and fail the base
    rules; repeated rows are rated each; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    step = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), WS).alias("ws"),
        F.split(text, "\n").alias("lines"),
    )
    step = step.select(
        "doc_id",
        "text",
        F.when(F.get("ws", F.lit(0)) == "", F.array().cast("array<string>")).otherwise(F.col("ws")).alias("ws"),
        "lines",
        F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("full"),
        F.transform("lines", lambda x: F.struct(x.alias("line"), failed_line(x).alias("failed"))).alias("judged"),  # each line once
    )
    step = step.withColumn("failed", F.transform(F.filter("judged", lambda x: x["failed"]), lambda x: x["line"]))
    step = step.select(
        "doc_id",
        F.size("ws").cast("long").alias("n_words"),
        F.length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        F.transform("ws", lambda w: F.xxhash64(w)).alias("h"),
        F.size("failed").cast("long").alias("n_failed_lines"),
        F.length(F.regexp_replace(F.array_join("failed", ""), WS, "")).alias("lost"),
        F.array_join(F.transform(F.filter("judged", lambda x: ~x["failed"]), lambda x: x["line"]), "\n").alias("cleaned"),
    )
    windows = "transform(slice(h, 1, greatest(size(h) - 4, 0)), (x, i) -> xxhash64(x, h[i + 1], h[i + 2], h[i + 3], h[i + 4]))"
    step = step.withColumn("g", F.expr(windows))
    step = step.withColumn("sorted", F.expr("CASE WHEN size(array_distinct(g)) < size(g) THEN sort_array(transform(g, (x, i) -> struct(x AS h, i AS i))) END"))
    step = step.withColumn("hits", F.expr("sort_array(transform(filter(sorted, (s, i) -> coalesce(get(sorted, i - 1).h = s.h, false) OR coalesce(get(sorted, i + 1).h = s.h, false)), s -> s.i))"))
    covered = "aggregate(transform(hits, (p, i) -> least(5, coalesce(get(hits, i + 1), p + 5) - p)), 0L, (a, x) -> a + x)"
    step = step.withColumn("n_repeat_words", F.coalesce(F.expr(covered), F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return step.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("lost") <= LOSS_SHARE * F.col("word_chars"))).alias("kept"),
        "n_failed_lines", "cleaned",
    )


def failed_line(line):
    """Whether a line fails a rule; a line without a word never does."""
    seen = F.length(F.regexp_replace(line, WS, ""))
    symbols = F.length(line) - F.length(F.regexp_replace(line, SYMBOLS, ""))
    words = F.filter(F.split(line, WS), lambda w: w != "")
    shouts = F.size(F.split(line, SHOUT)) - 1
    few = (F.size(words) >= REPEATS) & (DISTINCT * F.size(F.array_distinct(words)) <= F.size(words))
    low = F.lower(line)
    return (seen > 0) & ((symbols > SYMBOL_SHARE * seen) | ((shouts > 1) & (SHOUTS * shouts > F.size(words))) | ~line.rlike(r"[\p{L}\p{N}]") | few | low.rlike(NAVIGATION) | low.rlike(BOILERPLATE))
