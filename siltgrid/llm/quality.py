"""Quality rules, line first.

Each line of a text is judged alone: does it end like a sentence, is it a navigation bar, is it
boilerplate. Lines that fail are taken out, and a document that loses more than half of its word
characters in this way is rejected, as is one that fails the base rules (too few words, or mostly
repeated three-word windows).

Nulls and texts without a word have zero counts and fail the base rules. Repeated rows are judged
one by one, texts of any length whole. Extra columns, whatever their names, are not read, or pass
through where whole rows are kept. An empty table gives no rows. The work is one pass over the
documents without a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
#: How a sentence ends: a mark, then closing quotes or brackets.
SENTENCE_END = re.compile(r"""[.!?:;…。！？]["'”’»)\]]*$""")
SEPARATORS = "|»›•·"
#: Phrases of notices, licences and site furniture, in English, French, German and Spanish.
BOILERPLATE_PHRASES = (
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "uses cookies",
    "accept cookies",
    "licensed under",
    "released under the",
    "general public license",
    "creative commons",
    "subscribe to our newsletter",
    "click here",
    "share on facebook",
    "follow us on",
    "skip to content",
    "lorem ipsum",
    "copyright (c)",
    "copyright ©",
    "terms and conditions",
    "we use cookies",
    "cookie settings",
    "manage cookies",
    "accept all",
    "sign up for our",
    "log in to your account",
    "create an account",
    "forgot your password",
    "add to cart",
    "add to basket",
    "back to top",
    "read more",
    "load more",
    "leave a comment",
    "post a comment",
    "share this",
    "tweet this",
    "share on twitter",
    "like us on",
    "join our mailing list",
    "powered by",
    "report this ad",
    "skip to main",
    "enable javascript",
    "mit license",
    "apache license",
    "without warranty of any kind",
    "tous droits réservés",
    "mentions légales",
    "conditions d'utilisation",
    "conditions générales",
    "politique de confidentialité",
    "utilise des cookies",
    "utilisons des cookies",
    "accepter les cookies",
    "tout accepter",
    "gérer les cookies",
    "abonnez-vous",
    "inscrivez-vous",
    "s'inscrire à la newsletter",
    "cliquez ici",
    "lire la suite",
    "en savoir plus",
    "partager sur",
    "suivez-nous",
    "mot de passe oublié",
    "ajouter au panier",
    "retour en haut",
    "aller au contenu",
    "laisser un commentaire",
    "plan du site",
    "propulsé par",
    "sous licence",
    "alle rechte vorbehalten",
    "allgemeine geschäftsbedingungen",
    "nutzungsbedingungen",
    "datenschutzerklärung",
    "datenschutzbestimmungen",
    "impressum",
    "verwendet cookies",
    "verwenden cookies",
    "cookies akzeptieren",
    "alle akzeptieren",
    "cookie-einstellungen",
    "newsletter abonnieren",
    "jetzt anmelden",
    "hier klicken",
    "klicken sie hier",
    "weiterlesen",
    "mehr erfahren",
    "teilen auf",
    "folgen sie uns",
    "passwort vergessen",
    "in den warenkorb",
    "nach oben",
    "zum inhalt springen",
    "kommentar schreiben",
    "unterstützt von",
    "lizenziert unter",
    "todos los derechos reservados",
    "aviso legal",
    "condiciones de uso",
    "términos y condiciones",
    "política de privacidad",
    "política de cookies",
    "utiliza cookies",
    "utilizamos cookies",
    "aceptar cookies",
    "aceptar todo",
    "configurar cookies",
    "suscríbete",
    "suscribirse al boletín",
    "regístrate",
    "haz clic aquí",
    "haga clic aquí",
    "leer más",
    "ver más",
    "compartir en",
    "síguenos",
    "olvidaste tu contraseña",
    "añadir al carrito",
    "volver arriba",
    "saltar al contenido",
    "deja un comentario",
    "mapa del sitio",
    "con la tecnología de",
    "bajo licencia",
)
BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE_PHRASES)))


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules and of the verdict on a document."""

    unpunctuated_words: int = 8  # a shorter line must end like a sentence
    separators: int = 3  # from so many separators a line can be navigation
    words_per_item: int = 4  # and is, with no more words than this for each separator
    boilerplate_words: int = 25  # a phrase makes boilerplate of a line up to this length
    lost_percent: int = 50  # a document that loses more is rejected
    min_words: int = 50
    repeat_percent: int = 50


PRODUCTION = LineRules()
#: Upper-case ASCII letters to lower case, as the phrases are matched.
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_fails(line: str, n_words: int, rules: LineRules = PRODUCTION) -> str | None:
    """The name of the first rule that a line with words fails, if any."""
    marks = sum(line.count(c) for c in SEPARATORS)
    if marks >= rules.separators and n_words <= rules.words_per_item * (marks + 1) + marks:
        return "navigation"
    if n_words <= rules.boilerplate_words and BOILERPLATE.search(line.translate(LOWER)):
        return "boilerplate"
    if n_words < rules.unpunctuated_words and not SENTENCE_END.search(line.rstrip("\t\v\f\r ")):
        return "punctuation"
    return None


def code_points(text: bytes) -> int:
    return len(text) - (0 if text.isascii() else len(text) - len(text.translate(None, CONTINUATION)))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window which occurs twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    pairs = ids[:-1] * len(seen) + ids[1:]
    if len(seen) > 1_000_000:  # three ids would not fit into 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    triples = pairs[:-1] * len(seen) + ids[2:]
    order = np.argsort(triples, kind="stable")
    ordered = triples[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(triples), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= twice
    return int(inside.sum())


def judge(text: bytes, rules: LineRules = PRODUCTION) -> tuple[int, int, int, int, int, bool, bool, bytes]:
    """Counts, base verdict, verdict and the text without its failed lines."""
    words = text.split()
    n_words = len(words)
    word_chars = code_points(text.translate(None, common.BLANKS))
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    n_repeat = repeated_words(words)
    n_dup, lost, left = 0, 0, []
    seen: set[bytes] = set()
    for line in text.split(b"\n"):
        own = line.split()
        if not own:
            left.append(line)
            continue
        again = line in seen
        n_dup += again
        seen.add(line)
        if again or line_fails(line.decode("utf-8", "replace"), len(own), rules):
            lost += code_points(line.translate(None, common.BLANKS))
        else:
            left.append(line)
    base_failed = n_words < rules.min_words or 100 * n_repeat > rules.repeat_percent * n_words
    kept = not base_failed and 100 * lost <= rules.lost_percent * word_chars
    return n_words, word_chars, n_symbols, n_dup, n_repeat, base_failed, kept, b"\n".join(left)


SCHEMA = "{key} long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def line_first(df: DataFrame, key: str = "doc_id", text: str = "text", rules: LineRules = PRODUCTION, cleaned: bool = False) -> DataFrame:
    """One row of counts and verdicts per document; with cleaned, also the text without failed lines."""
    types = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.string()] * cleaned
    names = [key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"] + ["cleaned"] * cleaned

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [judge(t.as_buffer().to_pybytes(), rules) for t in batch.column(1)]
        columns = [batch.column(0), *([r[i] for r in found] for i in range(7))]
        if cleaned:
            columns.append([r[7].decode("utf-8", "replace") for r in found])
        return pa.RecordBatch.from_arrays([c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return common.map_batches(common.byte_texts(df, key, text), run, SCHEMA.format(key=key) + ", cleaned string" * cleaned)


def keep_documents(df: DataFrame, key: str = "doc_id", text: str = "text", rules: LineRules = PRODUCTION) -> DataFrame:
    """The rows whose documents pass, with all their columns, and their texts without the lines that fail.

    The whole row goes through the pass, so that rows that share a key are judged one by one.
    """
    at = df.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [judge(t.as_buffer().to_pybytes(), rules) if t.is_valid else None for t in batch.column(at)]
        passed = [r is not None and r[6] for r in found]
        kept = pa.array([r[7].decode("utf-8", "replace") for r in found if r is not None and r[6]], batch.schema.field(at).type)
        return batch.filter(pa.array(passed, pa.bool_())).set_column(at, batch.schema.field(at), kept)

    return common.map_batches(df, run, df.schema)


def op7_line_rules(spark, sf_dir: str) -> DataFrame:
    return line_first(common.table(spark, sf_dir, "documents"))


def _sql() -> str:
    word = r"[^\x20\x09-\x0D]+"
    phrases = "|".join(p.replace("(", r"\(").replace(")", r"\)").replace("'", "''") for p in BOILERPLATE_PHRASES)
    r = PRODUCTION
    lower = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
lines0 AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs),
lines1 AS (SELECT rid, line, i, len(regexp_extract_all(line, '{word}')) AS n, length(array_to_string(regexp_extract_all(line, '{word}'), '')) AS chars,
  length(regexp_replace(line, '[^{SEPARATORS}]', '', 'g')) AS marks FROM lines0),
lines AS (SELECT *, row_number() OVER (PARTITION BY rid, line ORDER BY i) > 1 AS again FROM lines1 WHERE n > 0),
judged AS (SELECT rid, again, chars, again
  OR (marks >= {r.separators} AND n <= {r.words_per_item} * (marks + 1) + marks)
  OR (n <= {r.boilerplate_words} AND regexp_matches({lower}, '{phrases}'))
  OR (n < {r.unpunctuated_words} AND NOT regexp_matches(line, '[.!?:;…。！？]["''”’»)\]]*[\x20\x09\x0B-\x0D]*$')) AS fails FROM lines),
by_doc AS (SELECT rid, sum(chars) AS word_chars, sum(CASE WHEN again THEN 1 ELSE 0 END) AS dup, sum(CASE WHEN fails THEN chars ELSE 0 END) AS lost FROM judged GROUP BY rid),
words AS (SELECT rid, unnest(regexp_extract_all(text, '{word}')) AS w, generate_subscripts(regexp_extract_all(text, '{word}'), 1) AS i FROM docs),
grams AS (SELECT rid, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY rid ORDER BY i)),
counted AS (SELECT rid, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY rid, w, w2, w3) > 1 AS twice FROM grams),
inside AS (SELECT rid, twice OR coalesce(lag(twice) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS hit FROM counted WINDOW o AS (PARTITION BY rid ORDER BY i)),
rep AS (SELECT rid, count(*) AS n_words, sum(CASE WHEN hit THEN 1 ELSE 0 END) AS n_rep FROM inside GROUP BY rid),
base AS (SELECT d.rid, d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS dup, coalesce(n_rep, 0) AS n_rep, coalesce(lost, 0) AS lost
  FROM docs d LEFT JOIN by_doc USING (rid) LEFT JOIN rep USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines, n_rep::BIGINT AS n_repeat_words,
  (n_words < {r.min_words} OR 100 * n_rep > {r.repeat_percent} * n_words) AS base_failed,
  NOT (n_words < {r.min_words} OR 100 * n_rep > {r.repeat_percent} * n_words) AND 100 * lost <= {r.lost_percent} * word_chars AS kept
FROM base"""


QUERIES = {"op7_line_rules": op7_line_rules}
ORACLES = {"op7_line_rules": _sql()}
