"""Licence detection by ordered signature rules, in DataFrame functions only.

Rules come from ``LICENCES`` (name, keyword, how a text names it, address) crossed with forms of
mention: SPDX tag, address, grant with version, grant, full name. A text is looked at by a rule
only if it passes the common gate (all rules' keywords) and holds the rule's keyword; then every match becomes an
interval. Matches are swept by start: a match within another of at least its priority is
suppressed. Arrays grow in chunks, so a text of very many mentions costs little more than in proportion. All of it happens in the document's own row: no shuffle, no growth with other rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

LICENCE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that the base counts, and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: The same words before lower-casing.
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
V = r",?\s*(?:version|ver\.?|v\.?)?\s*"
L = r"\s+(?:public\s+)?licen[sc]e"
#: SPDX-like label, keywords (any of them, each without spaces, as patterns allow any), pattern of the name in prose, pattern of the address (lower case).
LICENCES: tuple[tuple[str, str, str, str], ...] = (
    ("apache-1.1", "apache", rf"apache(?:\s+software)?{L}{V}1\.1", r"apache\.org/licenses/license-1\.1"),
    ("apache-2.0", "apache", rf"apache(?:\s+software)?(?:{L})?{V}2(?:\.0)?\b", r"apache\.org/licenses/license-2\.0"),
    ("mit", "mit|expat", r"(?:\bmit|\bexpat)(?:\s+\(?expat\)?)?\s+licen[sc]e", r"opensource\.org/licen[sc]es?/mit"),
    ("mit-0", "mit", r"\bmit(?:\s+no\s+attribution|-0)(?:\s+licen[sc]e)?", r"opensource\.org/licen[sc]es?/mit-0"),
    ("x11", "x11", r"\bx11\s+licen[sc]e", r"spdx\.org/licenses/x11"),
    ("isc", "isc", r"\bisc\s+licen[sc]e", r"opensource\.org/licen[sc]es?/isc"),
    ("bsd-2-clause", "bsd", r"(?:(?:simplified|freebsd|2-clause|two-clause)\s+bsd|bsd[\s-]+2[\s-]+clause)(?:\s+licen[sc]e)?", r"opensource\.org/licen[sc]es?/bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:(?:new|modified|revised|3-clause|three-clause)\s+bsd|bsd[\s-]+3[\s-]+clause)(?:\s+licen[sc]e)?", r"opensource\.org/licen[sc]es?/bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"(?:(?:original|old|4-clause|four-clause)\s+bsd|bsd[\s-]+4[\s-]+clause)(?:\s+licen[sc]e)?", r"spdx\.org/licenses/bsd-4-clause"),
    ("bsd", "bsd", r"\bbsd\s+licen[sc]e", r"opensource\.org/licen[sc]es?/bsd-license"),
    ("0bsd", "bsd", r"(?:zero-clause\s+bsd|\b0bsd)(?:\s+licen[sc]e)?", r"opensource\.org/licen[sc]es?/0bsd"),
    ("gpl-1.0", "gnu|gpl", rf"(?:gnu\s+(?:general{L}|gpl)|\bgpl){V}1(?:\.0)?\b", r"gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0"),
    ("gpl-2.0", "gnu|gpl", rf"(?:gnu\s+(?:general{L}|gpl)|\bgpl){V}2(?:\.0)?\b", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", "gnu|gpl", rf"(?:gnu\s+(?:general{L}|gpl)|\bgpl){V}3(?:\.0)?\b", r"gnu\.org/licenses/gpl-3\.0"),
    ("gpl", "gnu", rf"gnu\s+(?:general{L}|gpl)", r"gnu\.org/(?:copyleft/gpl|licenses/gpl)\.html"),
    ("lgpl-2.0", "gnu|lgpl", rf"(?:gnu\s+library\s+general{L}|\blgpl){V}2(?:\.0)?\b", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0"),
    ("lgpl-2.1", "gnu|lgpl", rf"(?:gnu\s+lesser\s+general{L}|\blgpl){V}2\.1\b", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", "gnu|lgpl", rf"(?:gnu\s+lesser\s+general{L}|\blgpl){V}3(?:\.0)?\b", r"gnu\.org/licenses/lgpl-3\.0"),
    ("lgpl", "lesser", rf"gnu\s+lesser\s+general{L}", r"gnu\.org/licenses/lgpl\.html"),
    ("agpl-3.0", "affero", rf"(?:gnu\s+)?affero\s+general{L}(?:{V}3(?:\.0)?)?", r"gnu\.org/licenses/agpl-3\.0"),
    ("agpl", "agpl", rf"\bagpl(?:{V}3(?:\.0)?\b)?", r"gnu\.org/licenses/agpl\.html"),
    ("gfdl-1.1", "documentation", rf"gnu\s+free\s+documentation\s+licen[sc]e{V}1\.1", r"gnu\.org/licenses/(?:old-licenses/)?fdl-1\.1"),
    ("gfdl-1.2", "documentation", rf"gnu\s+free\s+documentation\s+licen[sc]e{V}1\.2", r"gnu\.org/licenses/(?:old-licenses/)?fdl-1\.2"),
    ("gfdl-1.3", "documentation", rf"gnu\s+free\s+documentation\s+licen[sc]e{V}1\.3", r"gnu\.org/licenses/fdl-1\.3"),
    ("gfdl", "documentation", r"gnu\s+free\s+documentation\s+licen[sc]e", r"gnu\.org/(?:copyleft|licenses)/fdl\.html"),
    ("mpl-1.0", "mozilla|mpl", rf"(?:mozilla{L}|\bmpl){V}1\.0", r"mozilla\.org/mpl/1\.0"),
    ("mpl-1.1", "mozilla|mpl", rf"(?:mozilla{L}|\bmpl){V}1\.1", r"mozilla\.org/mpl/1\.1"),
    ("mpl-2.0", "mozilla|mpl", rf"(?:mozilla{L}|\bmpl){V}2(?:\.0)?\b", r"mozilla\.org/mpl/2\.0"),
    ("epl-1.0", "eclipse|epl", rf"(?:eclipse{L}|\bepl){V}1\.0", r"eclipse\.org/(?:legal|org/documents)/epl-v10"),
    ("epl-2.0", "eclipse|epl", rf"(?:eclipse{L}|\bepl){V}2\.0", r"eclipse\.org/legal/epl-(?:2\.0|v20)"),
    ("eupl-1.1", "european|eupl", rf"(?:european\s+union{L}|\beupl){V}1\.1", r"spdx\.org/licenses/eupl-1\.1"),
    ("eupl-1.2", "european|eupl", rf"(?:european\s+union{L}|\beupl){V}1\.2", r"spdx\.org/licenses/eupl-1\.2"),
    ("cddl-1.0", "development|cddl", rf"(?:common\s+development\s+and\s+distribution\s+licen[sc]e|\bcddl){V}1\.0", r"opensource\.org/licen[sc]es?/cddl-1\.0"),
    ("cpl-1.0", "common", rf"common{L}{V}1\.0", r"opensource\.org/licen[sc]es?/cpl1\.0"),
    ("artistic-1.0", "artistic", rf"artistic\s+licen[sc]e{V}1(?:\.0)?\b", r"perlfoundation\.org/artistic_license_1_0"),
    ("artistic-2.0", "artistic", rf"artistic\s+licen[sc]e{V}2(?:\.0)?\b", r"perlfoundation\.org/artistic_license_2_0"),
    ("bsl-1.0", "boost", rf"boost\s+software\s+licen[sc]e(?:{V}1\.0)?", r"boost\.org/license_1_0"),
    ("busl-1.1", "business", rf"business\s+source\s+licen[sc]e(?:{V}1\.1)?", r"mariadb\.com/bsl11"),
    ("sspl-1.0", "server", rf"server\s+side{L}(?:{V}1)?", r"mongodb\.com/licensing/server-side-public-license"),
    ("elastic-2.0", "elastic", rf"elastic\s+licen[sc]e(?:{V}2(?:\.0)?)?", r"elastic\.co/licensing/elastic-license"),
    ("zlib", "zlib", r"\bzlib(?:/libpng)?\s+licen[sc]e", r"opensource\.org/licen[sc]es?/zlib"),
    ("libpng", "libpng", r"\blibpng\s+licen[sc]e", r"libpng\.org/pub/png/src/libpng-license"),
    ("openssl", "openssl", r"\bopenssl\s+licen[sc]e", r"openssl\.org/source/license"),
    ("php-3.01", "php", rf"\bphp\s+licen[sc]e{V}3\.01", r"php\.net/license/3_01"),
    ("python-2.0", "python|psf", r"python\s+software\s+foundation\s+licen[sc]e|\bpsf\s+licen[sc]e", r"python\.org/(?:psf/)?license"),
    ("ruby", "ruby", r"\bruby\s+licen[sc]e", r"ruby-lang\.org/en/about/license"),
    ("postgresql", "postgresql", r"postgresql\s+licen[sc]e", r"opensource\.org/licen[sc]es?/postgresql"),
    ("ofl-1.1", "font", rf"(?:sil\s+)?open\s+font\s+licen[sc]e(?:{V}1\.1)?", r"scripts\.sil\.org/ofl"),
    ("odbl-1.0", "database", rf"open\s+database\s+licen[sc]e(?:{V}1\.0)?", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by-1.0", "commons", rf"open\s+data\s+commons\s+attribution\s+licen[sc]e(?:{V}1\.0)?", r"opendatacommons\.org/licenses/by"),
    ("pddl-1.0", "dedication", r"public\s+domain\s+dedication\s+and\s+licen[sc]e", r"opendatacommons\.org/licenses/pddl"),
    ("unlicense", "unlicense", r"\bthe\s+unlicense\b|\bunlicense\b", r"unlicense\.org"),
    ("wtfpl", "wtfpl", r"\bwtfpl\b", r"wtfpl\.net"),
    ("cc0-1.0", "cc0", rf"\bcc0(?:{V}1\.0)?(?:\s+universal)?", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("ms-pl", "microsoft", rf"microsoft{L}", r"opensource\.org/licen[sc]es?/ms-pl"),
    ("ms-rl", "reciprocal", r"microsoft\s+reciprocal\s+licen[sc]e", r"opensource\.org/licen[sc]es?/ms-rl"),
    ("vim", "vim", r"\bvim\s+licen[sc]e", r"vimhelp\.org/uganda"),
    ("hpnd", "historical", r"historical\s+permission\s+notice\s+and\s+disclaimer", r"opensource\.org/licen[sc]es?/hpnd"),
    ("public-domain", "domain", r"(?:released|placed|dedicated)\s+(?:in)?to\s+the\s+public\s+domain", r"creativecommons\.org/licenses/publicdomain"),
    ("proprietary", "reserved", r"all\s+rights\s+reserved", r"end[\s-]+user\s+licen[sc]e\s+agreement"),
)
#: Creative Commons clauses and versions: each pair is one licence.
CC_CLAUSES = (("by", r"attribution"), ("by-sa", r"attribution[\s-]+share\s?alike"), ("by-nd", r"attribution[\s-]+no\s?deriv(?:ative)?s"), ("by-nc", r"attribution[\s-]+non\s?commercial"), ("by-nc-sa", r"attribution[\s-]+non\s?commercial[\s-]+share\s?alike"), ("by-nc-nd", r"attribution[\s-]+non\s?commercial[\s-]+no\s?deriv(?:ative)?s"))
#: All ways in which \bcc[\s-]by can be written, and the long form.
CC_KEYWORD = "|".join([*[f"cc{c}by" for c in " -\t\n\x0b\f\r"], "creative"])
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Form of mention: priority, pattern around the name {n}, the address {a} or the label {i}.
FORMS = (
    (5, r"spdx-license-identifier:\s*\(?\s*{i}(?:-only|-or-later|\+)?(?![a-z0-9.-])"),
    (4, r"(?:https?://)?(?:www\.)?{a}"),
    (3, r"(?:licen[sc]ed|released|distributed|available|published|provided|covered|made available)\s+(?:under|by)\s+(?:the\s+)?(?:terms\s+(?:and\s+conditions\s+)?of\s+(?:the\s+)?)?(?:{n})"),
    (2, r"(?:subject\s+to|governed\s+by|terms\s+of|under)\s+(?:the\s+)?(?:{n})"),
    (1, r"(?:{n})"),
)
LEVELS = len(FORMS)
PLACES = "array<struct<label:string,at:bigint>>"
MATCH, SPAN = "struct<start:int,stop:int,priority:int,label:string>", "struct<start:int,stop:int>"
MATCHES = f"array<{MATCH}>"


def catalogue() -> list[tuple[str, str, str, str]]:
    """All licences: LICENCES and every Creative Commons clause and version."""
    out = list(LICENCES)
    for clause, prose in CC_CLAUSES:
        for version in CC_VERSIONS:
            v = version.replace(".", r"\.")
            tag = clause.replace("-", r"[\s-]")
            out.append((f"cc-{clause}-{version}", CC_KEYWORD, rf"(?:\bcc[\s-]{tag}|creative\s+commons\s+{prose})(?:\s+licen[sc]e)?{V}{v}\b", rf"creativecommons\.org/licenses/{clause}/{v}"))
        out.append((f"cc-{clause}", CC_KEYWORD, rf"(?:\bcc[\s-]{tag}(?![\s-](?:nc|nd|sa)\b)|creative\s+commons\s+{prose})\b", rf"creativecommons\.org/licenses/{clause}/?(?![\d.a-z-])"))
    return out


def rules() -> list[tuple[str, str, int, str]]:
    """(label, keyword, priority, pattern), in order of priority, then of the catalogue."""
    found = []
    for label, keyword, name, address in catalogue():
        for priority, form in FORMS:
            text = form.replace("{n}", name).replace("{a}", address).replace("{i}", label.replace(".", r"\."))
            need = {5: "spdx", 4: "agreement" if label == "proprietary" else re.match("[a-z-]+", address)[0]}.get(priority, keyword)
            found.append((label, need, priority, text))
    return sorted(found, key=lambda r: -r[2])


def gate() -> list[str]:
    """Every rule's keywords: a text without any of these has no match (plain substrings of the lower-cased text)."""
    return sorted({w for _, keyword, _, _ in rules() for w in keyword.split("|")})


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LICENCE_WORD), F.lit(0))


def phrase_places(text: Column) -> Column:
    """array<struct<label, at>>: every place where a phrase's words stand consecutively. text: lower case."""
    words = words_of(text)  # bound once below
    firsts = sorted({p.split()[0] for p, _ in PHRASES})

    def places(w: Column) -> Column:
        starts = F.filter(F.transform(w, lambda x, i: F.when(x.isin(*firsts), i)), lambda i: i.isNotNull())

        def of(phrase: str, label: str) -> Column:
            fits = F.filter(starts, lambda i: _all([F.get(w, i + j) == p for j, p in enumerate(phrase.split())]))
            return F.transform(fits, lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("at")))

        return F.flatten(F.array(*[of(*p) for p in PHRASES]))

    return F.element_at(F.transform(F.array(words), places), 1)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return F.coalesce(out, F.lit(False))


#: Items that a fold appends to one array before it starts another.
CHUNK = 64


def folded(items: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Run step(state, item) -> (state, array of outputs) over an array and return all outputs in order.

    Outputs are gathered CHUNK items at a time, so that a text of many matches isn't copied once for each of them.
    """
    nothing = F.array().cast(f"array<{kind}>")
    begin = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))

    def inner(a: Column, x: Column) -> Column:
        state_, out = step(a["state"], x)
        return F.struct(state_.alias("state"), F.concat(a["out"], out).alias("out"))

    def chunk(a: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(a["state"].alias("state"), nothing.alias("out")), inner)
        return bound(done, lambda d: F.struct(d["state"].alias("state"), F.concat(a["out"], F.array(d["out"])).alias("out")))

    def whole(all_: Column) -> Column:
        last = F.ceil(F.size(all_) / CHUNK).cast("int")
        parts = F.transform(F.slice(F.sequence(F.lit(0), last), F.lit(1), last), lambda i: F.slice(all_, i * CHUNK + 1, F.lit(CHUNK)))
        return F.flatten(F.aggregate(parts, begin, chunk, lambda a: a["out"]))

    return bound(items, whole)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def signature_matches(low: Column) -> Column:
    """array<struct<start, stop, priority, label>> of all rules' matches, by start, longest first. low: lower case."""
    return bound(low, _matches)


def core(patterns: list[str]) -> str:
    """One pattern that finds something wherever one of these does."""
    return "|".join(f"(?:{p})" for p in patterns)


def _matches(text: Column) -> Column:
    by_keyword: dict[str, list[tuple[str, int, str]]] = {}
    for label, k, n, p in rules():
        by_keyword.setdefault(k, []).append((label, n, p))
    none = F.array().cast("array<struct<p:string,n:int,label:string>>")

    def group(keyword: str, own: list[tuple[str, int, str]]) -> Column:
        # a rule's pattern is compiled anew for every text, these two conditions once: few texts pass both
        listed = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(n).alias("n"), F.lit(label).alias("label")) for label, n, p in own])
        least = [p for label, n, p in own if n in (1, 4, 5)]  # the other forms hold the name, as form 1 does
        return F.when(_any([F.contains(text, F.lit(w)) for w in keyword.split("|")]) & F.rlike(text, F.lit(core(least))), listed).otherwise(none)

    def intervals(r: Column) -> Column:
        gaps = F.split(text, r["p"], -1)
        pairs = bound(F.regexp_extract_all(text, r["p"], F.lit(0)), lambda hits: F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("g"), h.alias("h"))))
        # a match starts after all gaps up to it and all matches before it
        spans = folded(pairs, F.lit(0), SPAN, lambda at, x: (at + F.length(x["g"]) + F.length(x["h"]), F.array(F.struct((at + F.length(x["g"])).alias("start"), (at + F.length(x["g"]) + F.length(x["h"])).alias("stop")))))
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("back"), (-r["n"]).alias("rank"), r["label"].alias("label")))

    gated = F.filter(F.flatten(F.array(*[group(k, own) for k, own in by_keyword.items()])), lambda r: F.rlike(text, r["p"]))
    found = F.sort_array(F.flatten(F.transform(gated, intervals)))
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), (-m["back"]).alias("stop"), (-m["rank"]).alias("priority"), m["label"].alias("label")))


def resolve(matches: Column) -> Column:
    """Drop each match that lies within another of at least its priority (of equal ones the first stays)."""

    def step(ends: Column, m: Column) -> tuple[Column, Column]:
        covered = F.element_at(ends, m["priority"]) >= m["stop"]
        further = F.transform(ends, lambda e, i: F.when(i < m["priority"], F.greatest(e, m["stop"])).otherwise(e))
        return F.when(covered, ends).otherwise(further), F.when(covered, F.array().cast(MATCHES)).otherwise(F.array(m))

    return folded(matches, F.array(*[F.lit(-1)] * (LEVELS + 1)), MATCH, step)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs, with n_words, places (base) and matches (resolved signature matches).

    Null text counts as empty: no words, no places, no matches. Repeated rows and other columns
    pass unchanged, but columns that have the new names are replaced; an empty table stays empty. Starts and stops are
    code points of the text.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    cheap = F.lower(whole)  # A-Z and more: whatever the ASCII form holds of the gate, this holds too
    mentions, phrases = [_any([F.contains(cheap, F.lit(g)) for g in words]) for words in (gate(), ("license", "cc"))]
    low = ascii_lower(whole)
    docs = docs.withColumn("n_words", F.regexp_count(whole, F.lit(ANY_WORD)).cast("long"))
    docs = docs.withColumn("places", F.when(phrases, phrase_places(low)).otherwise(F.array().cast(PLACES)))
    return docs.withColumn("matches", F.when(mentions, resolve(signature_matches(low))).otherwise(F.array().cast(MATCHES)))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document: base phrases and signature labels."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    at = F.transform("places", lambda p: p["at"])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    both = F.array_sort(F.array_union(base, F.array_distinct(F.transform("matches", lambda m: m["label"]))))
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["priority"])), F.lit(0)) / F.lit(float(LEVELS))
    score = F.greatest(best, F.when(F.size("places") > 0, F.lit(0.4)).otherwise(F.lit(0.0)))
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), F.array_join(base, ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), score.alias("score"), F.size("matches").cast("long").alias("n_matches"))
