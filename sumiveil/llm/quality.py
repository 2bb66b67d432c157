"""Quality rules: line-first cleaning, in DataFrame functions alone.

Every line with a word is held against rules on punctuation, navigation and boilerplate; lines that
fail are removed, and a document that loses more than a share of its words this way is rejected.
Counts over the whole document (words, symbols, repeated lines and five-word windows) come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sumiveil.llm.common import SPACE, fresh, let, once, read_table

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MAX_LOSS = 0.5
#: Openings of menu lines and stock phrases, in the languages that the corpus has: English, German, French, Spanish.
NAVIGATION = (
    r"^(skip to|back to top|go to top|main menu|menu$|home$|next$|previous$|sign in|sign up|log ?in|log ?out|register|subscribe|share this|share on|follow us|read more|click here|tweet|print this|search$|site ?map|breadcrumb"
    r"|zum inhalt|nach oben|startseite$|weiterlesen|anmelden|abmelden|mehr lesen|weiter$|suche$|aller au contenu|haut de page|accueil$|lire la suite|se connecter|suivant$|recherche$|ir al contenido|volver arriba|inicio$|leer m[aá]s|iniciar sesi[oó]n|siguiente$|buscar$)"
)
BOILERPLATE = (
    r"(all rights reserved|terms of (use|service)|privacy (policy|notice)|cookie (policy|settings|preferences)|(accept|use|uses) cookies|enable javascript|javascript is (disabled|required)|lorem ipsum|powered by [a-z]"
    r"|alle rechte vorbehalten|datenschutz(erkl[aä]rung|hinweis)|allgemeine gesch[aä]ftsbedingungen|verwende[nt] cookies|tous droits r[eé]serv[eé]s|politique de confidentialit[eé]|mentions l[eé]gales|utilise des cookies"
    r"|todos los derechos reservados|pol[ií]tica de (privacidad|cookies)|aviso legal|utiliza(mos)? cookies)"
)
#: A word that is an address of the web.
LINK = r"(https?://|www\.)[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def line_fails(line: Column) -> Column:
    """Whether a line that has a word is to go; never null."""

    def judge(n: Column) -> Column:
        marked = line.rlike(r"[#*$%&|<>{}\\^~=_!?»›·]")  # most lines have none of these, and need no count
        return (
            # punctuation: symbols, shouting, or a long line without any
            (marked & (F.regexp_count(line, F.lit(r"[#*$%&|<>{}\\^~=_]")) * 10 > F.length(line)))
            | (marked & (F.regexp_count(line, F.lit(r"[!?]")) > F.greatest(F.lit(2), n / 2)))
            | ((n >= 40) & ~line.rlike(r"[.!?;:,。！？]"))
            # navigation: cells and crumbs, or a short line that opens like a menu
            | (marked & (F.regexp_count(line, F.lit(r"( \||\| | > | » | › | · )")) * 4 > n))
            | ((n <= 6) & line.rlike("(?iu)" + NAVIGATION))
            # or a line that is links for the most part
            | (F.contains(line, F.lit(".")) & (F.regexp_count(line, F.lit(LINK)) * 2 > n))
            # boilerplate: a short line with a stock phrase
            | ((n <= 25) & line.rlike("(?iu)" + BOILERPLATE))
        )

    return let(F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")), judge)


def repeat_words(w: Column) -> Column:
    """Words that stand in a window of five found at least twice, the first included, as an array of word columns."""
    hashed = let(w, lambda v: F.transform(v, lambda x, i: F.xxhash64(x, F.get(v, i + 1), F.get(v, i + 2), F.get(v, i + 3), F.get(v, i + 4))))
    return F.when(F.size(w) >= WINDOW, F.slice(hashed, F.lit(1), F.greatest(F.size(w) - (WINDOW - 1), F.lit(1)))).otherwise(F.array().cast("array<bigint>"))


def covered(windows: Column) -> Column:
    """Number of words under the windows whose hash occurs more than once.

    Windows are put next to their equals by sorting (hash, place); the places of repeated ones, in
    order, each add the words that the one before didn't cover.
    """
    sort = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = lambda s: F.transform(s, lambda x, j: F.when((F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), x["i"]))
    places = let(sort, lambda s: F.array_sort(F.array_compact(again(s))))
    steps = let(places, lambda p: F.transform(p, lambda x, j: F.least(F.lit(WINDOW), x - F.coalesce(F.get(p, j - 1), F.lit(-WINDOW)))))
    total = F.aggregate(steps, F.lit(0), lambda a, x: a + x)
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(total)


def measure(docs: DataFrame, text: str = "text", max_loss: float = MAX_LOSS, into: str = "quality") -> DataFrame:
    """``docs``, null texts made empty, with a struct column ``into``: the base counts, the lines' verdict and the cleaned text.

    Other columns stay as they are, whatever their names.  The exact 64-bit window hashes of one
    document are compared with each other only, so a clash among its n windows has a chance of
    n*n / 2**65.
    """
    count = lambda c: c.cast("long")
    tag = fresh(docs)
    col = lambda name: F.col(tag + name)
    add = lambda df, **columns: df.withColumns({tag + k: v for k, v in columns.items()})
    has_word = r"[^\x20\x09-\x0D]"
    # each step is fenced, so that what it makes is computed once however often the next ones read it
    one = docs.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    one = add(one, words=once(words(F.col(text))), lines=once(F.filter(F.split(text, "\n"), lambda x: x.rlike(has_word))))
    one = add(
        one,
        windows=once(repeat_words(col("words"))),
        chars=F.length(F.array_join(col("words"), "")),
        n=F.size(col("words")),
        bad=once(F.filter(col("lines"), line_fails)),
        repeated=F.size(col("lines")) - F.size(F.array_distinct(col("lines"))),
        n_lines=F.size(col("lines")),
    ).drop(tag + "words", tag + "lines")
    one = add(one, covered=once(covered(col("windows"))), lost=once(F.size(words(F.array_join(col("bad"), " "))))).drop(tag + "windows")
    failed = (col("n") < 10) | (100 * col("covered") > 20 * col("n"))
    clean = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~(x.rlike(has_word) & line_fails(x))), "\n")
    result = F.struct(
        count(col("n")).alias("n_words"),
        count(col("chars")).alias("word_chars"),
        count(F.regexp_count(text, F.lit(SYMBOLS))).alias("n_symbols"),
        count(col("repeated")).alias("n_dup_lines"),
        count(col("covered")).alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & (col("lost") <= max_loss * col("n"))).alias("kept"),
        count(col("n_lines")).alias("n_lines"),
        count(F.size(col("bad"))).alias("n_bad_lines"),
        count(col("lost")).alias("n_bad_words"),
        F.when(F.size(col("bad")) == 0, F.col(text)).otherwise(clean).alias("clean"),
    )
    made = ("bad", "n", "covered", "lost", "chars", "repeated", "n_lines")
    return one.withColumn(into, once(result)).drop(*(tag + x for x in made))


def quality_rules(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", max_loss: float = MAX_LOSS) -> DataFrame:
    """doc_id, the counts, base_failed, kept, the lines' counts and the cleaned text of every row.

    Null and empty texts have no words and fail; repeated rows are judged each; lines without a word
    are neither judged nor counted; an empty table gives no rows; no other column is read.
    """
    out = measure(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", max_loss)
    return out.select("doc_id", "quality.n_words", "quality.word_chars", "quality.n_symbols", "quality.n_dup_lines", "quality.n_repeat_words", "quality.base_failed", "quality.kept", "quality.n_lines", "quality.n_bad_lines", "quality.n_bad_words", F.col("quality.clean").alias("cleaned_text"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents")).drop("cleaned_text")
