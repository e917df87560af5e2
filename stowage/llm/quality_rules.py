"""Line-first cleaning, in DataFrame expressions only.

Every line of a document is judged alone by three rules; lines that fail are removed, and a document
that loses too much of its text with them is rejected.

* punctuation: a line is mostly symbols, shouts (``!!`` after most words), or is a long run of words
  without any closing mark;
* navigation: a line is a menu, that is pieces between separators, or a few menu words alone;
* boilerplate: a line holds a stock phrase of sites (cookies, terms, subscriptions, loaders).

Before that, a base check of the whole text drops documents that are too short or repeat themselves.

Defined cases: a null text has no words, no lines, and fails the base check; so does an empty one. Texts
of any length take ``n log n`` time in their own words, and so do lines: no pattern repeats a group. Other
columns pass through ``judge`` and ``clean`` untouched, whatever their names, but for those that are named like
an added one, which the added one replaces. Repeated rows are judged one by one. An empty table gives an
empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import SPACES, column, once, table, words

#: The counted symbols, the separators of menus, closing marks, menu words, stock phrases.
SYMBOLS = "#*$%&|<>"
SEPARATORS = r"[|»›·•>]"
CLOSING = r"[.!?…。！？]"
EDGE = r"[^\p{L}\p{N}]"
MENU_WORDS = (
    "home about contact login register menu search next previous back top share tweet print help faq sitemap news blog archive categories tags comments reply more about_us contact_us log_in sign_in sign_up read_more skip_to_content "
    "startseite kontakt impressum anmelden registrieren suche weiter zurück teilen drucken hilfe übersicht archiv kategorien kommentare antworten mehr über_uns nach_oben mehr_lesen "
    "accueil connexion inscription recherche suivant précédent retour partager imprimer aide actualités catégories commentaires répondre plus à_propos lire_la_suite plan_du_site "
    "inicio contacto acceder registrarse buscar siguiente anterior volver compartir imprimir ayuda noticias archivo categorías etiquetas comentarios responder más sobre_nosotros leer_más mapa_del_sitio"
).split()
STOCK_PHRASES = (
    *("cookie policy", "use of cookies", "uses cookies", "privacy policy", "terms of use", "terms of service", "terms and conditions", "all rights reserved", "enable javascript", "requires javascript", "subscribe to our newsletter", "sign up for our newsletter", "click here", "follow us on", "share this", "powered by", "lorem ipsum", "page not found", "back to top"),
    *("verwendet cookies", "verwendung von cookies", "datenschutzerklärung", "nutzungsbedingungen", "allgemeine geschäftsbedingungen", "alle rechte vorbehalten", "newsletter abonnieren", "hier klicken", "seite nicht gefunden"),
    *("utilise des cookies", "politique de confidentialité", "conditions d'utilisation", "conditions générales", "mentions légales", "tous droits réservés", "abonnez-vous à notre newsletter", "cliquez ici", "page introuvable"),
    *("utiliza cookies", "política de privacidad", "política de cookies", "términos y condiciones", "aviso legal", "todos los derechos reservados", "suscríbete a nuestro boletín", "haz clic aquí", "página no encontrada"),
)


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    symbol_share: float = 0.1
    shout_share: float = 0.5
    unclosed_words: int = 12
    menu_pieces: int = 3
    max_lost: float = 0.4


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) of every whole text.

    Three-word windows are told apart by 64-bit hashes within one document. They are sorted with their
    places only where a hash repeats at all.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = once(df, __w=words(text))
    df = once(df, __h=F.expr("CASE WHEN size(__w) > 2 THEN transform(sequence(0, size(__w) - 3), i -> xxhash64(__w[i], __w[i+1], __w[i+2])) ELSE array() END"))
    df = once(df, __s=F.expr("CASE WHEN size(array_distinct(__h)) < size(__h) THEN sort_array(transform(__h, (h, i) -> struct(h, i))) ELSE array() END"))
    at = "transform(filter(__s, (x, j) -> (j > 0 AND x.h = __s[j-1].h) OR (j + 1 < size(__s) AND x.h = __s[j+1].h)), x -> x.i)"
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = once(df, __l=lines, __p=F.expr(f"sort_array({at})"))
    covered = "aggregate(__p, named_struct('last', -3, 'n', 0), (a, p) -> named_struct('last', p, 'n', a.n + least(3, p - a.last)), a -> a.n)"
    return df.select(
        *[F.col(c) for c in df.columns if c not in ("__w", "__h", "__s", "__l", "__p")],
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).cast("long").alias("n_repeat_words"),
    )


def _longest_first(items: tuple[str, ...] | list[str]) -> str:
    """Alternatives of a pattern, longer ones first."""
    return "|".join(sorted({x.replace("_", " ") for x in items}, key=lambda x: (-len(x), x)))


def is_menu(line: Column) -> Column:
    """Whether a line is menu words and marks alone.

    Most lines are told by their first word. Of the others, words are set one blank apart, and all menu items are
    taken out, the longest first: no part of an item of several words that begins one is an item that leaves its rest an item.
    """
    items = _longest_first(MENU_WORDS)
    begins = F.regexp_like(line, F.lit(f"(?iu)^{EDGE}*(?:{items.replace(' ', EDGE + '+')})(?:{EDGE}|\\z)"))
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(line), f"{EDGE}+", " ")), F.lit(" "))
    return begins & (F.trim(F.regexp_replace(plain, f" (?:{items})(?= )", "")) == "")


def line_fails(line: Column, r: Rules = Rules()) -> Column:
    """The rule that a line fails ('punctuation', 'navigation', 'boilerplate'), or null. Blank lines pass."""
    n_words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    chars = F.length(line)
    symbols = F.regexp_count(line, F.lit(r"[#*$%&|<>]"))
    shouts = F.regexp_count(line, F.lit(r"!!([\x20\x09-\x0D]|\z)"))
    pieces = F.regexp_count(line, F.lit(SEPARATORS)) + 1
    stock = F.lit(f"(?iu)(?:^|{EDGE})(?:{_longest_first(STOCK_PHRASES)})(?:{EDGE}|\\z)")
    return (
        F.when((pieces >= r.menu_pieces) & (pieces * 6 >= n_words), F.lit("navigation"))
        .when(is_menu(line), F.lit("navigation"))
        .when(F.regexp_like(line, stock), F.lit("boilerplate"))
        .when(symbols > chars * r.symbol_share, F.lit("punctuation"))
        # words are counted last: most lines are decided without
        .when((shouts > 0) & (shouts > n_words * r.shout_share), F.lit("punctuation"))
        .when(~line.rlike(CLOSING) & (n_words >= r.unclosed_words), F.lit("punctuation"))
    )


def line_verdicts(df: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Add cleaned_text, lost_chars (long) and the count of lines that failed each rule."""
    judged = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.struct(x.alias("line"), line_fails(x, rules).alias("rule")))
    df = once(df, __j=judged)
    fails = lambda rule: F.size(F.filter("__j", lambda x: x["rule"] == rule)).cast("long")
    lost = F.aggregate(F.filter("__j", lambda x: x["rule"].isNotNull()), F.lit(0).cast("long"), lambda a, x: a + F.length(F.translate(x["line"], SPACES, "")))
    return df.select(
        *[F.col(c) for c in df.columns if c != "__j"],
        F.array_join(F.transform(F.filter("__j", lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n").alias("cleaned_text"),
        lost.alias("lost_chars"),
        *[fails(k).alias(f"{k}_lines") for k in ("punctuation", "navigation", "boilerplate")],
    )


ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "cleaned_text", "lost_chars", "punctuation_lines", "navigation_lines", "boilerplate_lines", "kept_chars", "base_failed", "kept")


def judge(df: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Add all counts, cleaned_text, base_failed and kept to every row of ``df``; nothing is dropped."""
    whole = df.select(F.struct(*[column(c) for c in df.columns]).alias("row"), column(text).alias("text"))
    whole = line_verdicts(base_counts(whole), rules=rules).withColumn("kept_chars", F.col("word_chars") - F.col("lost_chars"))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    whole = whole.withColumn("base_failed", failed)
    little = F.col("lost_chars") <= rules.max_lost * (F.col("lost_chars") + F.col("kept_chars"))
    whole = whole.withColumn("kept", ~F.col("base_failed") & little)
    return whole.select(*[F.col("row")[c].alias(c) for c in df.columns if c.lower() not in ADDED], *ADDED)


def clean(df: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with failed lines taken out of their text; the columns of ``df``.

    ``n_chars``, where there is such a column, counts the code points of the cleaned text.
    """
    whole = df.select(F.struct(*[column(c) for c in df.columns]).alias("row"), column(text).alias("text"))
    out = {c: F.col("row")[c].alias(c) for c in df.columns}
    out[text] = F.col("cleaned_text").alias(text)
    if "n_chars" in out and text != "n_chars":
        out["n_chars"] = F.length("cleaned_text").cast(df.schema["n_chars"].dataType).alias("n_chars")
    return judge(whole, rules=rules).filter("kept").select(*out.values())


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every row of ``documents`` with its counts and verdicts."""
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars", "lost_chars", "punctuation_lines", "navigation_lines", "boilerplate_lines")
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*columns)


def oracle(rules: Rules = Rules()) -> str:
    """The same rows in DuckDB's SQL, written from the contract and not from the expressions above."""
    space, quoted = r"[\x20\x09-\x0D]", CLOSING
    menu = f"(?i)^{EDGE}*({'|'.join(MENU_WORDS)})({EDGE}+({'|'.join(MENU_WORDS)}))*{EDGE}*$".replace("_", f"{EDGE}+")
    stock = f"(?i)(^|{EDGE})({'|'.join(STOCK_PHRASES)})({EDGE}|$)".replace("'", "''")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{space}+'), lambda x: x <> '') AS w FROM d),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i] || ' ' || w[i+1] || ' ' || w[i+2]) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, (VALUES (0), (1), (2)) AS s(k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
u AS (SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw,
    len(regexp_extract_all(line, '[#*$%&|<>]')) AS ns, len(regexp_extract_all(line, '!!({space}|\z)')) AS nb,
    len(regexp_extract_all(line, '{SEPARATORS}')) + 1 AS np, length(regexp_replace(line, '{space}', '', 'g')) AS chars FROM l),
v AS (SELECT doc_id, line, nw, chars, CASE
    WHEN np >= {rules.menu_pieces} AND np * 6 >= nw THEN 'navigation'
    WHEN regexp_matches(line, '{menu}') THEN 'navigation'
    WHEN regexp_matches(line, '{stock}') THEN 'boilerplate'
    WHEN ns > length(line) * {rules.symbol_share} THEN 'punctuation'
    WHEN nb > nw * {rules.shout_share} THEN 'punctuation'
    WHEN nw >= {rules.unclosed_words} AND NOT regexp_matches(line, '{quoted}') THEN 'punctuation' END AS rule FROM u),
s AS (SELECT doc_id, coalesce(sum(chars) FILTER (rule IS NULL), 0) AS kept_chars, coalesce(sum(chars) FILTER (rule IS NOT NULL), 0) AS lost_chars,
    count(*) FILTER (rule = 'punctuation') AS punctuation_lines, count(*) FILTER (rule = 'navigation') AS navigation_lines,
    count(*) FILTER (rule = 'boilerplate') AS boilerplate_lines,
    count(*) FILTER (nw > 0) - count(DISTINCT line) FILTER (nw > 0) AS n_dup_lines FROM v GROUP BY doc_id),
c AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '{space}', '', 'g')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    kept_chars, lost_chars, punctuation_lines, navigation_lines, boilerplate_lines
    FROM w JOIN s USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM c)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
    NOT base_failed AND lost_chars <= {rules.max_lost} * (lost_chars + kept_chars) AS kept,
    CAST(kept_chars AS BIGINT) AS kept_chars, CAST(lost_chars AS BIGINT) AS lost_chars, CAST(punctuation_lines AS BIGINT) AS punctuation_lines,
    CAST(navigation_lines AS BIGINT) AS navigation_lines, CAST(boilerplate_lines AS BIGINT) AS boilerplate_lines
FROM b
""".replace("\\\\", "\\")
