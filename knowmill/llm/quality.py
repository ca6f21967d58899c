"""Line-first quality rules, as DataFrame expressions only.

Each line is judged by itself: navigation (many separators), symbol noise, shouting, boilerplate phrases, missing end
punctuation (on a list-like line, or on one too long to be a heading or a wrapped line; the last line may be cut off), and
exact repeats of an earlier line. Lines that fail are removed, blank ones stay; a document that loses more than
``max_loss`` of its word characters, or fails the base rule, is rejected.

Null texts count as empty and are rejected (no words). Rows that repeat an id are judged each by itself; ids are not read. Extra
columns stay; the operators add only the columns they name, in place of columns of these names (the stage keeps those of
its input). All counts are taken over whole texts.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, WORD, beside, table, with_text

SYMBOL = r"[#*$%&|<>]"
#: Phrases that mark a line as boilerplate, by language.
BOILERPLATE = {
    "en": (
        "accept cookies", "accept all cookies", "all rights reserved", "back to top", "by continuing to use this site", "click here", "cookie policy", "cookie settings",
        "enable javascript", "follow us on", "forgot your password", "join our newsletter", "leave a comment", "log in to", "lorem ipsum", "my account", "next article",
        "page not found", "please enable cookies", "powered by wordpress", "previous article", "privacy policy", "read more", "related posts", "share on facebook", "share this",
        "sign up for", "skip to content", "skip to main", "subscribe to our", "terms and conditions", "terms of service", "terms of use", "this site uses cookies", "view all posts",
    ),
    "de": (
        "alle rechte vorbehalten", "cookies akzeptieren", "datenschutzerklärung", "diese website verwendet cookies", "hier klicken", "impressum und datenschutz", "javascript aktivieren",
        "newsletter abonnieren", "passwort vergessen", "seite teilen", "weiterlesen", "zum inhalt springen", "zur startseite",
    ),
    "fr": (
        "abonnez-vous à", "accepter les cookies", "aller au contenu", "ce site utilise des cookies", "cliquez ici", "conditions générales", "lire la suite", "mentions légales",
        "mot de passe oublié", "partager sur", "politique de confidentialité", "suivez-nous", "tous droits réservés",
    ),
    "es": (
        "aceptar cookies", "aviso legal", "compartir en", "este sitio utiliza cookies", "haga clic aquí", "ir al contenido", "leer más", "olvidó su contraseña",
        "política de cookies", "política de privacidad", "síguenos en", "suscríbete a", "todos los derechos reservados",
    ),
}
PHRASES = tuple(p for some in BOILERPLATE.values() for p in some)
#: Marks that may end a line.
ENDS = ".!?…:;,\"'»”’)]。！？"
#: Wrapped lines and headings are no longer than this.
WRAP = 120
#: Above so many repeated windows a sort finds their places instead of a scan of the list.
SCAN = 48


def _windows(words: Column) -> Column:
    """A 64-bit hash for each three consecutive words."""
    n = F.size(words) - 2
    return F.when(
        n > 0,
        F.transform(F.slice(words, F.lit(1), F.greatest(n, F.lit(1))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
    ).otherwise(F.array().cast("array<long>"))


def _covered(at: Column) -> Column:
    """Words that windows of three starting at the sorted places ``at`` cover."""
    steps = F.aggregate(F.transform(at, lambda p, i: F.least(F.get(at, i + 1) - p, F.lit(3))), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(3)))
    return steps.cast("long")


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text", "removed_chars"]


def line_fails(line: Column, marked: Column, last: Column) -> Column:
    """True if a line breaks a rule by itself. Cheap tests come first; marked: its text holds a symbol at all; last: the
    text's last line with a word."""
    n = F.regexp_count(line, F.lit(WORD))
    navigation = (n >= 4) & (F.regexp_count(line, F.lit(r"(?<= )[|>](?= )")) * 4 > n)
    noise = (n >= 3) & (F.regexp_count(line, F.lit(SYMBOL + "+")) * 3 > n)
    # Most letters must be capitals: a line in a script without case may name an acronym.
    capitals = F.regexp_count(line, F.lit(r"\p{Lu}")) * 2 > F.regexp_count(line, F.lit(r"\p{L}"))
    shouting = ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}{2}") & (n >= 3) & capitals
    ended = F.substring(F.rtrim(line), -1, 1).isin(*ENDS)
    listing = (F.regexp_count(line, F.lit(r"[|/•·›»,]")) * 3 > n) & (n >= 6)
    open_ended = (F.length(line) > WRAP) & (n >= 10) & (line != last)
    lower = F.lower(line)
    boilerplate = (F.length(line) <= WRAP) & reduce(or_, [lower.contains(x) for x in PHRASES])
    return (marked & (navigation | noise)) | shouting | (~ended & (listing | open_ended)) | boilerplate


def _first_ones(lines: Column) -> Column:
    """Lines without the later ones of equal lines that hold a word, in their order. lines: structs of line x and place i,
    sorted, so that equal lines stand together; the least place comes first."""
    first = F.filter(lines, lambda e, k: (k == 0) | ~e["x"].rlike(WORD) | (e["x"] != F.get(lines, F.greatest(k - 1, F.lit(0)))["x"]))
    return F.transform(F.sort_array(F.transform(first, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x")))), lambda e: e["x"])


def measure(df: DataFrame, text: str = "text", max_loss: float = 0.5) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept (boolean),
    clean_text (the lines that pass) and removed_chars (long)."""
    return beside(df, {"_text": text}, MEASURES, lambda x: _measure(x, max_loss))


def _measure(df: DataFrame, max_loss: float) -> DataFrame:
    t = F.coalesce(F.col("_text"), F.lit(""))
    df = df.withColumn("_t", t).withColumn("_w", F.regexp_extract_all("_t", F.lit(f"({WORD})"), F.lit(1)))
    df = df.withColumn("_h", _windows(F.col("_w"))).withColumn("n_words", F.size("_w").cast("long"))
    df = df.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long")).drop("_w")
    df = df.withColumn("n_symbols", F.regexp_count("_t", F.lit(SYMBOL)).cast("long"))
    df = df.withColumn("_all", F.split("_t", "\n", -1)).withColumn("_lines", F.filter("_all", lambda x: x.rlike(WORD)))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    df = df.withColumn("_last", F.get("_lines", F.size("_lines") - 1)).drop("_lines")
    df = df.withColumn("_v", F.when(F.col("n_dup_lines") > 0, F.sort_array(F.transform("_all", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    df = df.withColumn("_s", F.sort_array("_h"))
    df = df.withColumn("_d", F.array_distinct(F.filter("_s", lambda x, i: x == F.get("_s", i + 1)))).drop("_s")
    few = F.filter(F.sequence(F.lit(0), F.size("_h") - 1), lambda i: F.array_contains("_d", F.get("_h", i)))
    df = df.withColumn("_z", F.when(F.size("_d") > SCAN, F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    same = lambda x, y: x["x"] == y["x"]
    many = F.sort_array(F.transform(F.filter("_z", lambda x, i: same(x, F.get("_z", i + 1)) | ((i > 0) & same(x, F.get("_z", F.greatest(i - 1, F.lit(0)))))), lambda x: x["i"]))
    df = df.withColumn("_p", F.when(F.size("_d") == 0, F.array().cast("array<int>")).when(F.col("_z").isNull(), few).otherwise(many)).drop("_z", "_h", "_d")
    df = df.withColumn("n_repeat_words", _covered(F.col("_p"))).drop("_p")
    once = F.when(F.col("_v").isNull(), F.col("_all")).otherwise(_first_ones(F.col("_v")))
    df = df.withColumn("_good", F.filter(once, lambda x: ~x.rlike(WORD) | ~line_fails(x, F.col("n_symbols") > 0, F.col("_last"))))
    whole = F.size("_good") == F.size("_all")
    df = df.withColumn("clean_text", F.when(whole, F.col("_t")).otherwise(F.concat_ws("\n", "_good")))
    left = F.length(F.regexp_replace("clean_text", SPACE, ""))
    df = df.withColumn("removed_chars", F.when(whole, 0).otherwise(F.col("word_chars") - left).cast("long"))
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("removed_chars") <= max_loss * F.col("word_chars")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_chars"
    )


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with the failing lines taken out of their texts."""

    def clean(df: DataFrame) -> DataFrame:
        # The row number keeps the filter above the measures, whose expressions it would otherwise repeat many times.
        kept = measure(df).withColumn("_id", F.monotonically_increasing_id()).where("kept and _id >= 0")
        return kept.withColumn("text", F.col("clean_text"))

    return with_text(docs, clean)
