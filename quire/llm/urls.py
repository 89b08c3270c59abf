"""URL filter by a weighted vocabulary: an Aho-Corasick automaton counts strict and soft terms in one pass over the url.

A term counts where it stands between characters that are not letters or digits of A-Z, a-z, 0-9 (in either case).
A url is rejected on one strict term, or on SOFT_HITS different soft ones. Listed rules come before the vocabulary: a
rule is (host, path), fits its host and all subdomains if the url's path starts with the rule's, and the longest wins.

Defined cases: a null url, or one without "://", has an empty host and path, so no rule fits it; the vocabulary then
still looks at what there is (nothing for null), and allows it unless terms say otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import small_batches

#: Terms of which one rejects a url.
STRICT_TERMS = ("porn", "porno", "xxx", "hentai", "nsfw", "escorts", "camgirls", "sexcam", "warez", "keygen")
#: Terms of which several different ones reject a url.
SOFT_TERMS = ("adult", "sex", "nude", "casino", "poker", "betting", "viagra", "pills", "torrent", "crack", "dating", "cams", "jackpot", "loan")
SOFT_HITS = 2
#: (verdict, host with path), in the order in which ties are settled.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.substring_index(_after(url), "#", 1)
    return F.translate(F.substring_index(F.substring_index(rest, "?", 1), "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    rest = F.substring_index(F.substring_index(_after(url), "#", 1), "?", 1)
    at = F.instr(rest, "/")
    return F.when(at > 0, F.substring(rest, at, F.length(rest))).otherwise(F.lit(""))


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(verdict, rule) of the longest rule that fits, or null."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


@lru_cache(maxsize=4)
def term_counts(strict: tuple[str, ...], soft: tuple[str, ...]):
    """A function from a url to (occurrences of strict terms, different soft terms); a worker builds the automaton once."""
    automaton = ahocorasick.Automaton()
    for kind, terms in (("soft", soft), ("strict", strict)):
        for term in terms:
            automaton.add_word(term.lower(), (kind, term.lower()))
    automaton.make_automaton()

    def edge(c: str) -> bool:
        return not (c.isascii() and c.isalnum())

    def count(url: str) -> tuple[int, int]:
        low, hits, found = url.lower(), 0, set()
        for end, (kind, term) in automaton.iter(low):
            start = end - len(term) + 1
            if (start == 0 or edge(low[start - 1])) and (end + 1 == len(low) or edge(low[end + 1])):
                if kind == "strict":
                    hits += 1
                else:
                    found.add(term)
        return hits, len(found)

    return count


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, strict: Sequence[str] = STRICT_TERMS, soft: Sequence[str] = SOFT_TERMS, soft_hits: int = SOFT_HITS) -> DataFrame:
    """Per page: id, host, path, rule (or null), verdict, n_strict and n_soft. One pass without a shuffle; other columns are not read."""
    small_batches(pages.sparkSession)

    @F.pandas_udf("n_strict long, n_soft long")
    def terms(urls: pd.Series) -> pd.DataFrame:
        count = term_counts(tuple(strict), tuple(soft))
        return pd.DataFrame([count(u) if u else (0, 0) for u in urls], columns=["n_strict", "n_soft"])

    url = F.col("url")
    df = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    df = df.select("id", host_of(url).alias("host"), path_of(url).alias("path"), terms(F.coalesce(url, F.lit(""))).alias("t"))
    df = df.withColumn("r", rule_of(F.col("host"), F.col("path"), rules) if rules else F.lit(None).cast("struct<verdict:string,rule:string>"))
    own = F.when((F.col("t.n_strict") > 0) | (F.col("t.n_soft") >= soft_hits), F.lit("block")).otherwise(F.lit("allow"))
    return df.select(F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", own).alias("verdict"), "t.n_strict", "t.n_soft")
