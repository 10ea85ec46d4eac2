"""License scans by ordered signature rules.

A rule is a regular expression around a keyword: what must stand before it and
after it, in normalised words (`SEPARATOR` runs are one space, A-Z lower-case).
A text is first tested for any sign of a license; then only words that are a
keyword are looked at, and at each of them only that keyword's rules run, on
the `REACH` words to either side.  A match is an interval of words with the
rule's priority.  An interval within another of the same or a higher priority
is suppressed: of "licensed under the gnu lesser general public license" the
lesser license stays, and its "general public license" goes.

The rules: the three base phrases, sentences of licenses' own texts, names that
say enough alone, for each license of `LICENSES` the phrases of `TEMPLATES`, and
the names of `FULL_NAMES` that hold the keyword themselves, some 480 in all, tried
in that order.  The test for any sign (`hint`) is made
from the rules: it admits every text that a rule can match.

Only DataFrame functions run, and a row is scanned within itself: no shuffle.
Rules match whole words, and reach no further than `REACH` words, so that long
texts cost in proportion to their keywords.

Defined results.  Null text: as the empty text, no words and no labels.  Null
doc_id and repeated rows: one result each.  Other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.exprs import let

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same in a text that is not lower-cased yet.
RAW_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
REACH = 14
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The base phrases, split at their keyword, and their labels.
BASE_RULES = (
    ("mit", "under the mit", "license", ""),
    ("apache-2", "apache", "license", "version 2"),
    ("cc-by-nc", "", "cc", "by nc"),
)

# Label, and the words of its name (a regular expression over words).
LICENSES = (
    ("mit", "mit|x11|expat"),
    ("apache-1", "apache(?: software)?(?: license)?(?: version)? 1(?: [01])?"),
    ("apache-2", "apache(?: software)?(?: license)?(?: version)? 2(?: 0)?"),
    ("bsd-2-clause", "(?:2 clause|two clause|simplified|freebsd) bsd|bsd 2 clause"),
    ("bsd-3-clause", "(?:3 clause|three clause|new|revised|modified) bsd|bsd 3 clause"),
    ("bsd-4-clause", "(?:4 clause|four clause|original) bsd|bsd 4 clause"),
    ("bsd", "bsd"),
    ("0bsd", "zero clause bsd|0bsd"),
    ("isc", "isc"),
    ("gpl-1", "gnu (?:general public license|gpl)(?: v| version| v1)? ?1(?: 0)?"),
    ("gpl-2", "(?:gnu )?gpl ?v?2(?: 0)?|gnu (?:general public license|gpl) (?:v|version) ?2(?: 0)?"),
    ("gpl-3", "(?:gnu )?gpl ?v?3(?: 0)?|gnu (?:general public license|gpl) (?:v|version) ?3(?: 0)?"),
    ("gpl", "gnu general public license|gnu gpl|gpl"),
    ("lgpl-2.1", "(?:gnu )?lgpl ?v?2(?: [01])?|gnu (?:lesser|library) general public license (?:v|version) ?2(?: [01])?"),
    ("lgpl-3", "(?:gnu )?lgpl ?v?3(?: 0)?|gnu lesser general public license (?:v|version) ?3(?: 0)?"),
    ("lgpl", "gnu (?:lesser|library) general public license|gnu lgpl|lgpl"),
    ("agpl-3", "(?:gnu )?agpl ?v?3(?: 0)?|gnu affero general public license (?:v|version) ?3(?: 0)?"),
    ("agpl", "gnu affero general public license|affero general public license|agpl"),
    ("gfdl", "gnu free documentation license|gfdl"),
    ("mpl-1.1", "mozilla public license(?: version| v)? 1 1|mpl ?v?1 1"),
    ("mpl-2", "mozilla public license(?: version| v)? 2(?: 0)?|mpl ?v?2(?: 0)?"),
    ("mpl", "mozilla public license|mpl"),
    ("epl-1", "eclipse public license(?: version| v)? 1(?: 0)?|epl ?v?1(?: 0)?"),
    ("epl-2", "eclipse public license(?: version| v)? 2(?: 0)?|epl ?v?2(?: 0)?"),
    ("cddl", "common development and distribution license|cddl"),
    ("cpl", "common public license|cpl"),
    ("eupl", "european union public licen[cs]e|eupl"),
    ("artistic-2", "artistic license 2(?: 0)?|artistic 2(?: 0)?"),
    ("artistic", "artistic"),
    ("zlib", "zlib(?: libpng)?"),
    ("boost", "boost software|bsl 1 0|boost"),
    ("unlicense", "unlicense"),
    ("wtfpl", "do what the fuck you want to public|wtfpl"),
    ("python", "python software foundation|psf|python"),
    ("postgresql", "postgresql"),
    ("openssl", "openssl"),
    ("ofl", "sil open font|ofl(?: 1 1)?"),
    ("ms-pl", "microsoft public|ms pl"),
    ("odbl", "open database|odbl"),
    ("cc0", "cc0(?: 1 0)?|creative commons zero"),
    ("cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike|cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", "creative commons attribution non ?commercial|cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "creative commons attribution no ?deriv(?:ative)?s|cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "creative commons attribution share ?alike|cc by sa(?: [1-4] [05])?"),
    ("cc-by", "creative commons attribution|cc by(?: [1-4] [05])?"),
)

# SPDX ids that are not written like the label.
SPDX_IDS = {
    "mit": "mit|x11", "lgpl-2.1": "lgpl 2 [01]", "boost": "bsl 1 0", "python": "psf 2 0|python 2 0",
    "zlib": "zlib|libpng 2 0", "artistic": "artistic 1 0",
}

# Full names that hold the keyword "license": label, the words before it, and
# the major and minor numbers of its version, which follows or goes before.
FULL_NAMES = (
    ("apache-1", "apache(?: software)?", "1", "[01]"),
    ("apache-2", "apache(?: software)?", "2", "0"),
    ("gpl", "gnu general public", "", ""),
    ("gpl-1", "gnu general public", "1", "0"),
    ("gpl-2", "gnu general public", "2", "0"),
    ("gpl-3", "gnu general public", "3", "0"),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public", "", ""),
    ("lgpl-2.1", "(?:gnu )?(?:lesser|library) general public", "2", "[01]"),
    ("lgpl-3", "(?:gnu )?lesser general public", "3", "0"),
    ("agpl", "(?:gnu )?affero general public", "", ""),
    ("agpl-3", "(?:gnu )?affero general public", "3", "0"),
    ("gfdl", "gnu free documentation", "", ""),
    ("mpl", "mozilla public", "", ""),
    ("mpl-1.1", "mozilla public", "1 1", ""),
    ("mpl-2", "mozilla public", "2", "0"),
    ("epl", "eclipse public", "", ""),
    ("epl-1", "eclipse public", "1", "0"),
    ("epl-2", "eclipse public", "2", "0"),
    ("cddl", "common development and distribution", "", ""),
    ("cpl", "common public", "", ""),
    ("eupl", "european union public", "", ""),
    ("artistic-2", "artistic", "2", "0"),
)
# What may stand between a full name and its version.
PUBLISHED = "(?:as published by the free software foundation )?(?:either )?"

# Keyword, words before and after it ({} is the license's name), priority.
TEMPLATES = (
    ("spdx", "", "license identifier {}", 3, 1.0),
    ("licensed", "", "under (?:the )?(?:terms of )?(?:the )?(?:a )?(?:{})", 2, 0.95),
    ("released", "", "under (?:the )?(?:terms of )?(?:the )?(?:a )?(?:{})", 2, 0.9),
    ("distributed", "", "under (?:the )?(?:terms of )?(?:the )?(?:a )?(?:{})", 2, 0.9),
    ("available", "", "under (?:the )?(?:terms of )?(?:the )?(?:a )?(?:{})", 2, 0.9),
    ("license", "(?:{})", "", 1, 0.8),
    ("licence", "(?:{})", "", 1, 0.8),
)
# Names that are words of the language, too: after "under", only with a license.
COMMON_WORDS = {"artistic", "boost", "python"}
# A second license of the same sentence.  Of a lower priority, so that the
# interval does not suppress the first one's.
SECOND = ("licensed", "", "under (?:the )?(?:[0-9a-z]+ ){1,6}?(?:and|or) (?:the )?(?:{})", 1, 0.85)

# Sentences of the licenses' own texts, split at a rare word.
BODY_RULES = (
    ("mit", "permission is hereby granted free of", "charge", "to any person obtaining a copy of this software", 2, 0.95),
    ("boost", "permission is hereby granted free of", "charge", "to any person or organization obtaining a copy", 2, 0.95),
    ("isc", "permission to use copy modify and(?: or)?", "distribute", "this software for any purpose with or without fee", 2, 0.95),
    ("bsd", "redistribution and use in source and", "binary", "forms with or without modification are permitted", 2, 0.9),
    ("bsd-3-clause", "neither the name of(?: the)?(?: [0-9a-z]+){1,6} nor the names of its", "contributors", "may be used", 2, 0.9),
    ("zlib", "this software is provided as is without any", "express", "or implied warranty", 2, 0.8),
    ("as-is", "software is provided as is without", "warranty", "of any kind", 1, 0.6),
    ("as-is", "software is provided by the (?:[0-9a-z]+ ){1,6}as is and any express or implied", "warranties", "", 1, 0.6),
    ("unlicense", "this is free and", "unencumbered", "software released into the public domain", 2, 0.95),
    ("apache-2", "you may not use this file except in", "compliance", "with the license", 1, 0.7),
)
# Names that say enough alone: ids with their version, and joined ones.
BARE_RULES = (
    *((f"{name}-{label}", "", name, f"v? ?{number}(?: only| or later)?", 1, 0.8) for name, label, number in (
        ("gpl", "1", "1(?: 0)"), ("gpl", "2", "2(?: 0)?"), ("gpl", "3", "3(?: 0)?"), ("lgpl", "2.1", "2(?: [01])?"),
        ("lgpl", "3", "3(?: 0)?"), ("agpl", "3", "3(?: 0)?"), ("mpl", "1.1", "1 1"), ("mpl", "2", "2(?: 0)?"))),
    *((f"{name}-{label}", "", f"{name}v{label[0]}", "(?:[01])?(?: 0)?", 1, 0.8) for name, label in (
        ("gpl", "2"), ("gpl", "3"), ("lgpl", "2.1"), ("lgpl", "3"), ("agpl", "3"))),
    *((f"cc-by{kind.replace(' ', '-')}", "", "cc", f"by{kind} [1-4] [05]", 2, 0.9) for kind in ("", " nc", " nd", " sa", " nc sa", " nc nd")),
    ("cc0", "", "cc0", "(?:1 0)?(?: universal)?", 1, 0.9),
)
# Rules for texts that reserve all rights or give them up.
OTHER_RULES = (
    ("all-rights-reserved", "all", "rights", "reserved", 1, 0.7),
    ("proprietary", "confidential and", "proprietary", "", 1, 0.6),
    ("public-domain", "(?:in|into|to) the", "public", "domain", 1, 0.7),
    ("cc-by-nc", "", "cc", "by nc", 2, 0.95),
)

def _phrases() -> list[tuple[str, str, str, str, int, float, bool]]:
    """The ordered rules as written: label, keyword, before, after, priority, score, base."""
    made = [(label, word, before, after, 3, 1.0, True) for label, before, word, after in BASE_RULES]
    made += [(label, word, before, after, p, sure, False) for label, before, word, after, p, sure in (
        *OTHER_RULES, *BODY_RULES, *BARE_RULES)]
    for word, before, after, priority, sure in (*TEMPLATES, SECOND):
        for label, name in LICENSES:
            id_words = SPDX_IDS.get(label, label.replace("-", " ").replace(".", " "))
            fill = f"(?:(?:{id_words})(?: 0| only| or later| 0 only| 0 or later)?)" if word == "spdx" else name
            if after.startswith("under") and COMMON_WORDS & set(name.split("|")):
                fill = f"(?:{name})(?: software)? licen[cs]e"
            made.append((label, word, before.replace("{}", fill), after.replace("{}", fill), priority, sure, False))
    for word in ("license", "licence"):
        for label, name, major, minor in FULL_NAMES:
            if not major:
                made.append((label, word, name, "", 1, 0.8, False))
                continue
            point = f"(?: {minor})" if minor else ""
            marked = f"(?:version |v ?){major}{point and point + '?'}"
            made.append((label, word, name, f"{PUBLISHED}(?:{marked}|{major}{point})", 1, 0.8, False))
            made.append((label, word, f"(?:{marked}) (?:or later )?of the {name}", "", 1, 0.8, False))
    return made


def rules() -> list[tuple[int, str, str, str, str, int, float, bool]]:
    """The ordered rules: id, label, keyword, before, after, priority, score, base."""
    return [(i, label, word, f"(?:^| )(?:{before})$" if before else "", f"^(?:{after})(?: |$)" if after else "", *rest)
            for i, (label, word, before, after, *rest) in enumerate(_phrases())]


def hint() -> str:
    """A pattern that every text holds in which a rule can match: the rules'
    keywords, each with the plain word that has to stand next to it."""
    signs = set()
    for _, word, before, after, *_ in _phrases():
        ahead = re.search(r"(?:^| )([0-9a-z]+)$", before)
        then = re.match(r"([0-9a-z]+)(?: |$)", after)
        signs.add(" ".join([*(ahead.groups() if ahead else ()), word, *(then.groups() if then else ())]))
    least = [s for s in sorted(signs) if not any(t != s and t in s for t in signs)]
    return "(?i)" + "|".join(s.replace(" ", RAW_SEPARATOR) for s in least)


def _tables() -> tuple[Column, Column]:
    """The keywords, and the rules by keyword: fixed tables, as literals."""
    by_word: dict[str, list[str]] = {}
    quote = lambda s: "r'" + s + "'"  # noqa: E731 - rules hold no quotes
    for i, label, word, before, after, priority, sure, base in rules():
        by_word.setdefault(word, []).append(
            f"named_struct('id', {i}, 'label', '{label}', 'word', '{word}', 'before', {quote(before)}, "
            f"'after', {quote(after)}, 'priority', {priority}, 'sure', {sure}D, 'base', {str(base).lower()})")
    keywords = F.array(*[F.lit(w) for w in by_word])
    return keywords, F.expr("map(" + ", ".join(f"'{w}', array({', '.join(r)})" for w, r in by_word.items()) + ")")


def _words_of(text: Column) -> Column:
    """Normalised words; an empty array for a text without any."""
    plain = F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), SEPARATOR, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _count(matched: Column) -> Column:
    """Words of a matched string that may begin or end with a space."""
    t = F.trim(matched)
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1)


def _detections(words: Column) -> Column:
    """array<struct<start, _end, priority, id, label, sure, base>>, `_end` negative
    so that sorting puts the longer of two intervals first."""
    keywords, by_word = _tables()
    def at(p: Column) -> Column:
        left = F.array_join(F.slice(words, F.greatest(p - REACH, F.lit(1)), F.least(p - 1, F.lit(REACH))), " ")
        right = F.array_join(F.slice(words, p + 1, F.lit(REACH)), " ")
        def sides(s: Column) -> Column:
            fits = F.filter(by_word[s["word"]], lambda r: ((r["before"] == "") | F.rlike(s["left"], r["before"]))
                            & ((r["after"] == "") | F.rlike(s["right"], r["after"])))
            def interval(r: Column) -> Column:
                before = F.when(r["before"] == "", F.lit(0)).otherwise(_count(F.regexp_substr(s["left"], r["before"])))
                after = F.when(r["after"] == "", F.lit(0)).otherwise(_count(F.regexp_substr(s["right"], r["after"])))
                return F.struct((s["p"] - 1 - before).alias("start"), (-(s["p"] + after)).alias("_end"),
                                (-r["priority"]).alias("_priority"), r["id"].alias("id"), r["label"].alias("label"),
                                r["sure"].alias("sure"), r["base"].alias("base"))
            return F.transform(fits, interval)
        return let(F.struct(p.alias("p"), F.element_at(words, p).alias("word"), left.alias("left"), right.alias("right")), sides)
    places = F.filter(F.sequence(F.lit(1), F.size(words)), lambda p: F.array_contains(keywords, F.element_at(words, p)))
    found = F.flatten(F.transform(places, at))
    return F.when(F.size(words) > 0, F.array_sort(found))


def _surviving(found: Column) -> Column:
    """Detections that no interval before them (in order of start, then the
    longer, then the higher priority) of their priority or above contains."""
    levels = (3, 2, 1)
    start = F.struct(*[F.lit(-1).alias(f"p{k}") for k in levels],
                     F.array().cast("array<struct<label:string,sure:double>>").alias("out"))
    def step(acc: Column, d: Column) -> Column:
        end, priority = -d["_end"], -d["_priority"]
        reach = F.greatest(*[F.when(priority <= k, acc[f"p{k}"]).otherwise(F.lit(-1)) for k in levels])
        kept = F.array(F.struct(d["label"].alias("label"), d["sure"].alias("sure")))
        return F.struct(*[F.when(priority == k, F.greatest(acc[f"p{k}"], end)).otherwise(acc[f"p{k}"]).alias(f"p{k}")
                          for k in levels],
                        F.when(reach >= end, acc["out"]).otherwise(F.concat(acc["out"], kept)).alias("out"))
    return F.aggregate(found, start, step, lambda acc: acc["out"])


def scan(docs: DataFrame) -> DataFrame:
    """Per document: words, base places and labels, all labels, and a score."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hinted = docs.select(
        "doc_id", F.size(F.regexp_extract_all(text, F.lit(RAW_WORD), 0)).cast("long").alias("n_words"),
        F.when(text.rlike(hint()), let(_words_of(text), _detections)).alias("_found"))
    base = F.filter("_found", lambda d: d["base"])
    judged = hinted.select(
        "doc_id", "n_words", base.alias("_base"), F.when(F.size("_found") > 0, _surviving(F.col("_found"))).alias("_kept"))
    none = F.array().cast("array<string>")
    labels = lambda c: F.coalesce(F.transform(c, lambda d: d["label"]), none)
    text_of = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return judged.select(
        "doc_id", "n_words", F.coalesce(F.size("_base"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda d: d["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("_base", lambda d: d["start"])).cast("long").alias("last_word"),
        text_of(labels("_base")).alias("base_labels"),
        text_of(F.concat(labels("_base"), labels("_kept"))).alias("labels"),
        F.coalesce(F.array_max(F.transform("_kept", lambda d: d["sure"])), F.lit(0.0)).alias("score"))
