"""URL filter: explicit host and path rules, then a weighted vocabulary.

A rule (allow or block) names a host and the start of a path; it fits the host and its subdomains,
and the longest fitting rule decides. Where none fits, one Aho-Corasick automaton finds all
vocabulary terms of the lower-cased url in a single scan. Percent escapes are decoded first: of
printable ASCII characters to these, of others to a blank, which no term holds. A hit counts where no
ASCII letter or digit stands directly before or after it. One strict hit blocks, and so do several
distinct soft terms.

A url that is null or has no "://" has an empty host and path, fits no rule, and is judged by its
text alone (null: allow). Urls are read whole, whatever their length; repeated rows are judged one by
one; other columns, whatever their names, are not read. An empty table gives no rows. The work is one
pass over one column, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Rules of the production query, as (verdict, host and start of path).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: One of these is enough: adult sites, piracy and attacks, in English, French, German and Spanish.
STRICT_TERMS = tuple(
    """porn porno porns pornos pornhub pornstar pornstars xxx xxxvideos hentai milf milfs gangbang bukkake creampie blowjob blowjobs handjob cumshot
    cumshots upskirt voyeur camgirl camgirls camsex sexcam sexcams livesex escort escorts callgirl callgirls stripper strippers fetish bdsm nsfw
    hookers swingers sextoy sextoys sexshop erotica warez phishing malware keylogger ransomware crackz serialz nulled carding fullz botnet
    filmx putes salope salopes sexe pornographie amateurx partouze libertinage
    nackt nacktbilder fickvideos ficken huren erotik sexkontakte pornofilme swingerclub
    putas follando desnudas desnudos pornografia sexogratis videosxxx zorras eroticos""".split()
)
#: Of these it takes several different ones: words of betting, dating, pills, loans and bait that clean urls use too.
SOFT_TERMS = tuple(
    """adult adults casino casinos bet bets betting bookmaker bookmakers poker slots slot roulette blackjack jackpot lottery lotto gambling wager
    dating singles flirt hookup sexy nude nudes naked hot babes babe teen teens girls cam cams webcam live chat lingerie
    torrent torrents magnet crack cracked keygen serial patch unlocked modded apk iptv
    viagra cialis levitra pharmacy pills steroids xanax tramadol
    loan loans payday lender forex crypto bitcoin investment profit cash money rich
    free win winner winners prize prizes bonus gift giveaway cheap replica discount deal deals
    gratuit gratuite gratuits gagner gagnant cadeau pari paris-sportifs rencontre rencontres coquine sexyfille pilules crédit credit argent
    kostenlos gratis gewinnen gewinn gewinnspiel wetten wette spielautomaten kredit kredite geld pillen potenzmittel partnersuche
    ganar ganador premio premios apuestas apuesta casino-online ruleta citas solteras pastillas préstamo prestamo prestamos dinero regalo""".split()
)
SOFT_HITS = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(UPPER, LOWER)
WORDY = frozenset(LOWER + "0123456789")
ESCAPE = re.compile("%([0-9A-Fa-f]{2})")


@lru_cache(maxsize=8)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for weight, terms in (("soft", soft), ("strict", strict)):
        for term in terms:
            found.add_word(term, (term, weight))
    found.make_automaton()
    return found


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.translate(TO_LOWER), slash + path


def decoded(url: str) -> str:
    """Lower-cased, with percent escapes decoded once."""
    return ESCAPE.sub(lambda m: chr(code) if 32 <= (code := int(m[1], 16)) < 127 else " ", url).translate(TO_LOWER)


def by_vocabulary(url: str | None, strict: tuple[str, ...] = STRICT_TERMS, soft: tuple[str, ...] = SOFT_TERMS, hits: int = SOFT_HITS) -> str:
    text = decoded(url or "")
    found = set()
    for end, (term, weight) in automaton(strict, soft).iter(text):
        start = end - len(term) + 1
        if (start and text[start - 1] in WORDY) or (end + 1 < len(text) and text[end + 1] in WORDY):
            continue
        if weight == "strict":
            return "block"
        found.add(term)
    return "block" if len(found) >= hits else "allow"


class RuleBook:
    """Rules by host; a url looks up its host and each parent domain."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host.translate(TO_LOWER), []).append((slash + path, rule, verdict))

    def longest(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = (None, None)
        while host:
            for start, rule, verdict in self.by_host.get(host, ()):
                if path.startswith(start) and (best[0] is None or len(rule) > len(best[0])):
                    best = (rule, verdict)
            host = host.partition(".")[2]
        return best


def judge_urls(df: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str]] = RULES, strict: tuple[str, ...] = STRICT_TERMS, soft: tuple[str, ...] = SOFT_TERMS, hits: int = SOFT_HITS) -> DataFrame:
    """(key, host, path, rule, verdict) for every row."""
    rules = tuple(rules)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        book, out = RuleBook(rules), []
        for text in batch.column(1).to_pylist():
            host, path = split_url(text)
            rule, verdict = book.longest(host, path)
            out.append((host, path, rule, verdict or by_vocabulary(text, strict, soft, hits)))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], pa.string()) for i in range(4))], [key, "host", "path", "rule", "verdict"])

    kind = df.schema[key].dataType.simpleString()
    return common.map_batches(df.select(key, url), run, f"{key} {kind}, host string, path string, rule string, verdict string")


def op3_url_vocabulary(spark, sf_dir: str) -> DataFrame:
    return judge_urls(common.table(spark, sf_dir, "pages"))


def _sql() -> str:
    strict = "|".join(STRICT_TERMS)
    soft = " + ".join(f"(CASE WHEN strpos(low, '{t}') > 0 AND regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN 1 ELSE 0 END)" for t in SOFT_TERMS)
    digit = "strpos('0123456789abcdef', lower(substr(p, {}, 1))) - 1"
    code = f"(16 * ({digit.format(1)}) + {digit.format(2)})::INT"
    escapes = f"CASE WHEN i = 1 THEN p WHEN regexp_matches(p, '^[0-9A-Fa-f]{{2}}') THEN CASE WHEN {code} BETWEEN 32 AND 126 THEN chr({code}) ELSE ' ' END || substr(p, 3) ELSE '%' || p END"
    plain = f"array_to_string(list_transform(string_split(coalesce(url, ''), '%'), lambda p, i: {escapes}), '')"
    fits = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)
    low = f"translate({{}}, '{UPPER}', '{LOWER}')"
    return f"""
WITH u AS (SELECT page_id, url, {low.format(plain)} AS low, strpos(coalesce(url, ''), '://') AS mark FROM pages),
r AS (SELECT page_id, low, CASE WHEN mark > 0 THEN regexp_extract(substr(url, mark + 3), '^[^?#]*') ELSE '' END AS rest FROM u),
p AS (SELECT page_id, low, {low.format("regexp_extract(rest, '^[^/]*')")} AS host, substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM r),
f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM p JOIN (VALUES {fits}) AS k(verdict, rule, rhost, rpath) ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT p.page_id, host, path, f.rule AS rule,
  coalesce(f.verdict, CASE WHEN regexp_matches(low, '(^|[^a-z0-9])({strict})([^a-z0-9]|$)') OR ({soft}) >= {SOFT_HITS} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN f ON f.page_id = p.page_id"""


QUERIES = {"op3_url_vocabulary": op3_url_vocabulary}
ORACLES = {"op3_url_vocabulary": _sql()}
