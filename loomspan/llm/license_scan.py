"""License scans with ordered signature rules, in DataFrame functions only.

Hundreds of hand-written regexes stand in ``RULES`` as ``priority|keyword|label|regex``. A rule runs on a
text only if the text holds its keyword, looked for in a copy whose runs of blanks, line ends and comment marks are
one blank each, so that a keyword wrapped or commented inside is found; a text without any keyword is done after plain
substring searches. The SQL looks for keywords in the text itself and takes runs of at most 9, so it misses such texts. Each match is an interval. An interval goes if another one contains it that is of higher
priority, or of equal priority and longer, or the same and of an earlier rule: as containment and rank
are transitive, one test against all intervals equals suppressing one after another.

Besides, four phrases are counted word by word; their labels always stay. Everything is one narrow
projection: texts are never shuffled, and no Python runs.

Defined cases: null text counts as empty; a text without words has ``n_words`` 0, null places, empty
labels and score 0; equal texts get equal rows; texts of any length are scanned whole (places of a rule's
matches and the containment test work by blocks, so thousands of matches in one text stay cheap); rows repeated
under one id are scanned each; a null id stays null; an empty table gives an empty result; other columns do not matter, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import ascii_lower

#: What separates words: ASCII characters that are neither digits nor lower-case letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that are counted as words, with their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
PHRASE_SCORE = 0.9
#: A blank in a rule stands for a run of blanks, line ends and comment marks.
BLANK = r"[ \t\r\n*#/]{1,9}"
#: The same of any length: what the scan takes.
WIDE = r"[ \t\r\n*#/]+"
#: Keywords that not every match of their rules holds, with what every match does hold.
HELD = {"beerware": "beer", "license": "licen", "responsible ai": "license"}
#: Matches are handled in blocks of this many.
STEP = 64

RULES = r"""
# tags: machine-readable identifiers
90|spdx|0bsd|spdx-license-identifier:[ \t]*0bsd
90|spdx|agpl-3.0|spdx-license-identifier:[ \t]*agpl-3\.0(?:-only|-or-later)?
90|spdx|apache-1.1|spdx-license-identifier:[ \t]*apache-1\.1
90|spdx|apache-2.0|spdx-license-identifier:[ \t]*apache-2\.0
90|spdx|artistic-2.0|spdx-license-identifier:[ \t]*artistic-2\.0
90|spdx|bsd-2-clause|spdx-license-identifier:[ \t]*bsd-2-clause
90|spdx|bsd-3-clause|spdx-license-identifier:[ \t]*bsd-3-clause
90|spdx|bsl-1.0|spdx-license-identifier:[ \t]*bsl-1\.0
90|spdx|cc-by-4.0|spdx-license-identifier:[ \t]*cc-by-4\.0
90|spdx|cc-by-sa-4.0|spdx-license-identifier:[ \t]*cc-by-sa-4\.0
90|spdx|cc-by-nc-4.0|spdx-license-identifier:[ \t]*cc-by-nc-4\.0
90|spdx|cc0-1.0|spdx-license-identifier:[ \t]*cc0-1\.0
90|spdx|cddl-1.0|spdx-license-identifier:[ \t]*cddl-1\.0
90|spdx|epl-1.0|spdx-license-identifier:[ \t]*epl-1\.0
90|spdx|epl-2.0|spdx-license-identifier:[ \t]*epl-2\.0
90|spdx|eupl-1.2|spdx-license-identifier:[ \t]*eupl-1\.2
90|spdx|gfdl-1.3|spdx-license-identifier:[ \t]*gfdl-1\.3
90|spdx|gpl-2.0|spdx-license-identifier:[ \t]*gpl-2\.0(?:-only|-or-later|\+)?
90|spdx|gpl-3.0|spdx-license-identifier:[ \t]*gpl-3\.0(?:-only|-or-later|\+)?
90|spdx|isc|spdx-license-identifier:[ \t]*isc
90|spdx|lgpl-2.1|spdx-license-identifier:[ \t]*lgpl-2\.1(?:-only|-or-later|\+)?
90|spdx|lgpl-3.0|spdx-license-identifier:[ \t]*lgpl-3\.0(?:-only|-or-later|\+)?
90|spdx|mit|spdx-license-identifier:[ \t]*mit
90|spdx|mpl-2.0|spdx-license-identifier:[ \t]*mpl-2\.0
90|spdx|ms-pl|spdx-license-identifier:[ \t]*ms-pl
90|spdx|odbl-1.0|spdx-license-identifier:[ \t]*odbl-1\.0
90|spdx|ofl-1.1|spdx-license-identifier:[ \t]*ofl-1\.1
90|spdx|unlicense|spdx-license-identifier:[ \t]*unlicense
90|spdx|upl-1.0|spdx-license-identifier:[ \t]*upl-1\.0
90|spdx|zlib|spdx-license-identifier:[ \t]*zlib
90|spdx|unknown-spdx|spdx-license-identifier:[ \t]*[a-z0-9.+-]+
# links
80|apache.org|apache-2.0|https?://(?:www\.)?apache\.org/licenses/license-2\.0
80|apache.org|apache-1.1|https?://(?:www\.)?apache\.org/licenses/license-1\.1
80|apache.org|apache|https?://(?:www\.)?apache\.org/licenses/?
80|creativecommons.org|cc-by-4.0|creativecommons\.org/licenses/by/4\.0
80|creativecommons.org|cc-by-3.0|creativecommons\.org/licenses/by/3\.0
80|creativecommons.org|cc-by-2.0|creativecommons\.org/licenses/by/2\.0
80|creativecommons.org|cc-by-sa-4.0|creativecommons\.org/licenses/by-sa/4\.0
80|creativecommons.org|cc-by-sa-3.0|creativecommons\.org/licenses/by-sa/3\.0
80|creativecommons.org|cc-by-nc-4.0|creativecommons\.org/licenses/by-nc/4\.0
80|creativecommons.org|cc-by-nc-3.0|creativecommons\.org/licenses/by-nc/3\.0
80|creativecommons.org|cc-by-nd-4.0|creativecommons\.org/licenses/by-nd/4\.0
80|creativecommons.org|cc-by-nc-sa-4.0|creativecommons\.org/licenses/by-nc-sa/4\.0
80|creativecommons.org|cc-by-nc-nd-4.0|creativecommons\.org/licenses/by-nc-nd/4\.0
80|creativecommons.org|cc0-1.0|creativecommons\.org/publicdomain/zero/1\.0
80|creativecommons.org|public-domain|creativecommons\.org/publicdomain/mark/1\.0
80|creativecommons.org|cc-by|creativecommons\.org/licenses/by[a-z-]*/[0-9.]+
80|gnu.org|gpl|https?://(?:www\.)?gnu\.org/licenses/gpl(?:\.html|\.txt)?
80|gnu.org|gpl-2.0|https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
80|gnu.org|gpl-3.0|https?://(?:www\.)?gnu\.org/licenses/gpl-3\.0
80|gnu.org|lgpl|https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?lgpl
80|gnu.org|agpl-3.0|https?://(?:www\.)?gnu\.org/licenses/agpl
80|gnu.org|gfdl|https?://(?:www\.)?gnu\.org/licenses/fdl
80|gnu.org|gpl|https?://(?:www\.)?gnu\.org/copyleft/gpl
80|opensource.org|mit|opensource\.org/licenses?/mit
80|opensource.org|bsd-2-clause|opensource\.org/licenses?/bsd-2-clause
80|opensource.org|bsd-3-clause|opensource\.org/licenses?/bsd-3-clause
80|opensource.org|isc|opensource\.org/licenses?/isc
80|opensource.org|apache-2.0|opensource\.org/licenses?/apache-2\.0
80|opensource.org|gpl-3.0|opensource\.org/licenses?/gpl-3\.0
80|opensource.org|artistic-2.0|opensource\.org/licenses?/artistic-2\.0
80|opensource.org|cddl-1.0|opensource\.org/licenses?/cddl-1\.0
80|mozilla.org|mpl-2.0|https?://(?:www\.)?mozilla\.org/mpl/2\.0
80|mozilla.org|mpl-1.1|https?://(?:www\.)?mozilla\.org/mpl/(?:mpl-)?1\.1
80|eclipse.org|epl-1.0|eclipse\.org/legal/epl-v10
80|eclipse.org|epl-2.0|eclipse\.org/legal/epl-(?:v20|2\.0)
80|unlicense.org|unlicense|https?://(?:www\.)?unlicense\.org
80|boost.org|bsl-1.0|boost\.org/license_1_0\.txt
80|scripts.sil.org|ofl-1.1|scripts\.sil\.org/ofl
80|opendatacommons.org|odbl-1.0|opendatacommons\.org/licenses/odbl
80|opendatacommons.org|pddl-1.0|opendatacommons\.org/licenses/pddl
80|opendatacommons.org|odc-by-1.0|opendatacommons\.org/licenses/by
80|wtfpl.net|wtfpl|https?://(?:www\.)?wtfpl\.net
80|eupl|eupl-1.2|joinup\.ec\.europa\.eu/[a-z0-9/_-]{0,40}eupl
# wording of the licence texts
70|permission is hereby granted|mit|permission is hereby granted, free of charge, to any person obtaining a copy
70|permission is hereby granted|bsl-1.0|permission is hereby granted, free of charge, to any person or organization
70|permission is hereby granted|x11|permission is hereby granted, without written agreement
70|permission to use, copy|isc|permission to use, copy, modify, and(?:/or)? distribute this software for any purpose
70|permission to use, copy|hpnd|permission to use, copy, modify,? and distribute this software and its documentation
70|the software is provided|mit|the software is provided "as is", without warranty of any kind
70|the software is provided|isc|the software is provided "as is" and the author disclaims all warranties
70|redistribution and use|bsd|redistribution and use in source and binary forms, with or without modification, are permitted
70|neither the name|bsd-3-clause|neither the name of [^\n]{1,80} nor the names of its contributors
70|advertising materials|bsd-4-clause|all advertising materials mentioning features or use of this software
70|this software is provided|bsd|this software is provided by the copyright holders and contributors "as is"
70|this software is provided|zlib|this software is provided 'as-is', without any express or implied warranty
70|altered source versions|zlib|altered source versions must be plainly marked as such
70|free software|gpl|this program is free software[;:,] you can redistribute it and/or modify
70|free software|lgpl|this library is free software[;:,] you can redistribute it and/or modify
70|either version|gpl-2.0|either version 2 of the license, or (?:\(at your option\) )?any later version
70|either version|gpl-3.0|either version 3 of the license, or (?:\(at your option\) )?any later version
70|either version|lgpl-2.1|either version 2\.1 of the license, or (?:\(at your option\) )?any later version
70|gnu general public license|gpl|(?:under|of) the terms of the gnu general public license
70|gnu general public license|gpl-3.0|gnu general public license,? (?:version|v\.?) ?3(?:\.0)?
70|gnu general public license|gpl-2.0|gnu general public license,? (?:version|v\.?) ?2(?:\.0)?
70|gnu general public license|gpl-1.0|gnu general public license,? (?:version|v\.?) ?1(?:\.0)?
70|gnu lesser general|lgpl-2.1|gnu lesser general public license,? (?:version|v\.?) ?2\.1
70|gnu lesser general|lgpl-3.0|gnu lesser general public license,? (?:version|v\.?) ?3(?:\.0)?
70|gnu lesser general|lgpl|gnu lesser general public license
70|gnu library general|lgpl-2.0|gnu library general public license
70|gnu affero|agpl-3.0|gnu affero general public license,? (?:version|v\.?) ?3(?:\.0)?
70|gnu affero|agpl|gnu affero general public license
70|gnu free documentation|gfdl-1.3|gnu free documentation license,? (?:version|v\.?) ?1\.3
70|gnu free documentation|gfdl-1.2|gnu free documentation license,? (?:version|v\.?) ?1\.2
70|gnu free documentation|gfdl|gnu free documentation license
70|apache license|apache-2.0|apache license,? (?:version|v\.?) ?2(?:\.0)?
70|apache license|apache-1.1|apache license,? (?:version|v\.?) ?1\.1
70|apache license|apache-1.0|apache license,? (?:version|v\.?) ?1\.0
70|apache software license|apache-2.0|apache software license,? (?:version|v\.?)? ?2(?:\.0)?
70|apache software license|apache-1.1|apache software license,? (?:version|v\.?)? ?1\.1
70|apache software license|apache|apache software license
70|unless required by applicable law|apache-2.0|unless required by applicable law or agreed to in writing, software distributed under the license
70|you may not use this file|apache-2.0|you may not use this file except in compliance with the license
70|mozilla public|mpl-2.0|mozilla public license,? (?:version|v\.?) ?2(?:\.0)?
70|mozilla public|mpl-1.1|mozilla public license,? (?:version|v\.?) ?1\.1
70|mozilla public|mpl|mozilla public license
70|source code form|mpl-2.0|this source code form is subject to the terms of the mozilla public license
70|eclipse public|epl-1.0|eclipse public license,? (?:-? ?v|version) ?1\.0
70|eclipse public|epl-2.0|eclipse public license,? (?:-? ?v|version) ?2\.0
70|eclipse public|epl|eclipse public license
70|european union public|eupl-1.2|european union public licen[cs]e,? (?:v\.?|version) ?1\.2
70|european union public|eupl-1.1|european union public licen[cs]e,? (?:v\.?|version) ?1\.1
70|european union public|eupl|european union public licen[cs]e
70|common development and|cddl-1.0|common development and distribution license,? (?:version )?1\.0
70|common development and|cddl|common development and distribution license
70|common public license|cpl-1.0|common public license
70|ibm public license|ipl-1.0|ibm public license
70|microsoft public|ms-pl|microsoft public license
70|microsoft reciprocal|ms-rl|microsoft reciprocal license
70|universal permissive|upl-1.0|universal permissive license
70|sil open font|ofl-1.1|sil open font license
70|open font license|ofl-1.1|open font license,? version 1\.1
70|boost software|bsl-1.0|boost software license
70|academic free|afl-3.0|academic free license
70|open software license|osl-3.0|open software license
70|artistic license|artistic-2.0|artistic license,? (?:version )?2(?:\.0)?
70|artistic license|artistic-1.0|artistic license,? (?:version )?1(?:\.0)?
70|artistic license|artistic|artistic license
70|python software foundation|psf-2.0|python software foundation license
70|php license|php-3.01|php license,? (?:version )?3(?:\.01)?
70|ruby license|ruby|ruby license
70|zope public|zpl-2.1|zope public license
70|w3c software|w3c|w3c software (?:notice and )?license
70|public domain|unlicense|this is free and unencumbered software released into the public domain
70|public domain|public-domain|(?:released|dedicated|placed) (?:in|in)?to the public domain
70|public domain|public-domain|(?:is|are) in the public domain
70|public domain|cc0-1.0|cc0 1\.0 universal[^\n]{0,20}public domain dedication
70|do what the fuck|wtfpl|do what the fuck you want to public license
70|beerware|beerware|the beer-?ware license
70|business source|busl-1.1|business source license,? (?:version )?1\.1
70|server side public|sspl-1.0|server side public license
70|elastic license|elastic-2.0|elastic license(?:,? (?:version )?2(?:\.0)?)?
70|commons clause|commons-clause|commons clause license condition
70|open database license|odbl-1.0|open database license
70|responsible ai|rail|(?:open)?rail(?:-m)? license|responsible ai license
70|llama|llama-community|llama [0-9.]{0,3} ?community license agreement
# creative commons by name
60|creative commons|cc-by-nc-nd|creative commons attribution-? ?noncommercial-? ?noderivatives
60|creative commons|cc-by-nc-sa|creative commons attribution-? ?noncommercial-? ?sharealike
60|creative commons|cc-by-nc|creative commons attribution-? ?noncommercial
60|creative commons|cc-by-nd|creative commons attribution-? ?noderivatives
60|creative commons|cc-by-sa|creative commons attribution-? ?sharealike
60|creative commons|cc-by|creative commons attribution
60|creative commons|cc0-1.0|creative commons zero
60|creative commons|cc|creative commons licen[cs]e
60|cc by|cc-by-nc-nd-4.0|cc by-nc-nd 4\.0
60|cc by|cc-by-nc-sa-4.0|cc by-nc-sa 4\.0
60|cc by|cc-by-nc-4.0|cc by-nc 4\.0
60|cc by|cc-by-nc-3.0|cc by-nc 3\.0
60|cc by|cc-by-nd-4.0|cc by-nd 4\.0
60|cc by|cc-by-sa-4.0|cc by-sa 4\.0
60|cc by|cc-by-sa-3.0|cc by-sa 3\.0
60|cc by|cc-by-4.0|cc by 4\.0
60|cc by|cc-by-3.0|cc by 3\.0
60|cc by|cc-by-nc|cc by-nc
60|cc by|cc-by-sa|cc by-sa
60|cc by|cc-by-nd|cc by-nd
60|cc-by|cc-by-nc-nd-4.0|cc-by-nc-nd-4\.0
60|cc-by|cc-by-nc-sa-4.0|cc-by-nc-sa-4\.0
60|cc-by|cc-by-nc-4.0|cc-by-nc-4\.0
60|cc-by|cc-by-sa-4.0|cc-by-sa-4\.0
60|cc-by|cc-by-4.0|cc-by-4\.0
60|cc-by|cc-by|cc-by(?:-(?:nc|nd|sa))*
60|cc0|cc0-1.0|cc0(?: 1\.0)?
# statements with a name
60|mit license|mit|(?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of the )?mit license
60|mit licen|mit|mit licen[cs]e
60|mit-licensed|mit|mit-licensed
60|expat license|mit|expat license
60|bsd|bsd-2-clause|(?:simplified bsd|bsd 2-clause|2-clause bsd|two-clause bsd) ?(?:licen[cs]e)?
60|bsd|bsd-3-clause|(?:new bsd|modified bsd|bsd 3-clause|3-clause bsd|three-clause bsd|revised bsd) ?(?:licen[cs]e)?
60|bsd|bsd-4-clause|(?:original bsd|bsd 4-clause|4-clause bsd|four-clause bsd) ?(?:licen[cs]e)?
60|bsd|0bsd|(?:zero-clause bsd|bsd zero clause) ?(?:licen[cs]e)?
60|bsd|bsd|bsd(?:-style)? licen[cs]e
60|isc licen|isc|isc licen[cs]e
60|zlib|zlib|zlib(?:/libpng)? licen[cs]e
60|x11 licen|x11|x11 licen[cs]e
60|openssl license|openssl|openssl license
60|apache license|apache|(?:licen[cs]ed|released|distributed|available) under (?:the )?apache license
60|apache-2.0|apache-2.0|apache-2\.0
60|gplv|gpl-3.0|gplv3\+?
60|gplv|gpl-2.0|gplv2\+?
60|gplv|lgpl-3.0|lgplv3\+?
60|gplv|agpl-3.0|agplv3\+?
60|gpl-|gpl-3.0|gpl-3(?:\.0)?
60|gpl-|gpl-2.0|gpl-2(?:\.0)?
60|gpl-|lgpl-2.1|lgpl-2\.1
60|gpl-|agpl-3.0|agpl-3(?:\.0)?
60|general public license|gpl|(?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?general public license
60|unlicense|unlicense|the unlicense
60|dual|dual-license|dual(?:ly|-| )licen[cs]ed
# weak clues
30|all rights reserved|proprietary|all rights reserved
30|copyright|copyright-notice|copyright (?:\(c\)|©)? ?[12][0-9]{3}
30|confidential|proprietary|(?:proprietary and confidential|confidential and proprietary)
30|license agreement|eula|end[- ]user license agreement
30|licensed under|unknown-license|licensed under (?:the )?[a-z]
30|license|unknown-license|see (?:the )?(?:accompanying )?license(?:\.txt|\.md)?(?: file)? for
30|license|unknown-license|subject to the (?:terms of the )?(?:following )?licen[cs]e
30|license|unknown-license|(?:open[- ]source|free software) licen[cs]e
30|not for redistribution|proprietary|not for redistribution
"""


def parse_rules(text: str = RULES) -> list[tuple[int, str, str, str]]:
    """``(priority, keyword, label, regex)`` in order; the regex with its blanks written out."""
    out = []
    for line in text.splitlines():
        if line and not line.startswith("#"):
            priority, keyword, label, regex = line.split("|", 3)
            out.append((int(priority), keyword, label, _write_out(regex)))
    return out


def scan_rules() -> list[tuple[int, str, str, str]]:
    """``parse_rules`` as scanned: a keyword that each match holds, blanks of any length."""
    return [(p, HELD.get(k, k), label, r.replace(BLANK, WIDE)) for p, k, label, r in parse_rules()]


def _write_out(regex: str) -> str:
    """Blanks outside character classes become ``BLANK``; an optional blank stays one, made optional."""
    out, inside, i = [], False, 0
    while i < len(regex):
        c = regex[i]
        if c == "\\":
            out.append(regex[i : i + 2])
            i += 2
            continue
        inside = (inside or c == "[") and c != "]"
        if c == " " and not inside:
            out.append(f"(?:{BLANK})" if regex[i + 1 : i + 2] == "?" else BLANK)
        else:
            out.append(c)
        i += 1
    return "".join(out)


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _blocks(items: Column, n: Column) -> Column:
    """``items`` in slices of ``STEP``."""
    return F.when(n == 0, F.slice(F.array(items), 1, 0)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / STEP).cast("int")), lambda b: F.slice(items, b * STEP + 1, F.lit(STEP))))


def _matches(text: Column, rule: Column) -> Column:
    """Intervals of one rule: what stands between the matches gives their places."""

    def lengths(x: Column) -> Column:
        return F.transform(x["hits"], lambda hit, i: F.length(F.get(x["pieces"], i)) + F.length(hit))

    def offsets(blocks: Column) -> Column:
        sums = F.transform(blocks, _total)
        return F.transform(sums, lambda _, g: _total(F.slice(sums, F.lit(1), g)))

    def intervals(x: Column, blocks: Column, known: Column) -> Column:
        def one(hit: Column, i: Column) -> Column:
            g, r = F.floor(i / STEP).cast("int"), (i % STEP).cast("int")
            stop = F.get(known, g) + _total(F.slice(F.get(blocks, g), F.lit(1), r + 1))
            return F.struct((stop - F.length(hit)).alias("start"), (-stop).alias("minus_stop"), (-rule["priority"]).alias("minus_priority"), rule["no"].alias("no"), rule["label"].alias("label"))

        return F.transform(x["hits"], one)

    found = F.struct(F.split(text, rule["regex"], -1).alias("pieces"), F.regexp_extract_all(text, rule["regex"], F.lit(0)).alias("hits"))
    return _bind(found, lambda x: _bind(_blocks(lengths(x), F.size(x["hits"])), lambda blocks: _bind(offsets(blocks), lambda known: intervals(x, blocks, known))))


def _undominated(intervals: Column) -> Column:
    """Intervals that no other one suppresses.

    In the order start, stop downwards, priority downwards, rule, whatever suppresses an interval stands
    before it, reaches as far and is of no less priority. Blocks that do not reach as far are skipped.
    """

    def test(blocks: Column, ordered: Column) -> Column:
        def suppresses(e: Column, d: Column) -> Column:
            return (e["minus_stop"] <= d["minus_stop"]) & (e["minus_priority"] <= d["minus_priority"])

        def stays(d: Column, i: Column) -> Column:
            g, r = F.floor(i / STEP).cast("int"), (i % STEP).cast("int")
            before = F.exists(F.slice(blocks, F.lit(1), g), lambda b: (b["far"] <= d["minus_stop"]) & F.exists(b["items"], lambda e: suppresses(e, d)))
            beside = F.exists(F.slice(F.get(blocks, g)["items"], F.lit(1), r), lambda e: suppresses(e, d))
            return ~(before | beside)

        return F.filter(ordered, stays)

    def blocked(ordered: Column) -> Column:
        far = F.transform(_blocks(ordered, F.size(ordered)), lambda b: F.struct(F.array_min(F.transform(b, lambda e: e["minus_stop"])).alias("far"), b.alias("items")))
        return _bind(far, lambda blocks: test(blocks, ordered))

    return _bind(F.array_sort(intervals), blocked)


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans`` for every row.

    ``spans``: the intervals that stay, as ``array<struct<start, stop, priority, rule, label>>`` in code points.
    """
    rules = scan_rules()
    # one constant, folded while planning, instead of a thousand literals
    listed = [dict(zip(("no", "priority", "keyword", "label", "regex"), (no, *rule))) for no, rule in enumerate(rules)]
    table = F.from_json(F.lit(json.dumps(listed)), "array<struct<no int, priority int, keyword string, label string, regex string>>")
    keywords = F.array(*[F.lit(k) for k in dict.fromkeys(k for _, k, _, _ in rules)])
    t = F.col("_t")

    def words(text: Column) -> Column:
        return F.regexp_count(text, F.lit(WORD)).cast("long")

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), ascii_lower(F.col(text_col)).alias("_t"))
    pieces = {}
    for no, (phrase, _) in enumerate(PHRASES):
        own = phrase.split(" ")
        regex = f"(?<!{WORD[:-1]})" + f"{GAP}+".join(own) + f"(?!{WORD[:-1]})"
        holds = F.contains(t, F.lit(own[0])) & F.contains(t, F.lit(own[-1]))
        pieces[f"_p{no}"] = F.when(holds, F.split(t, regex, -1))
    out = out.withColumns({"n_words": words(t), "_kw": _bind(F.regexp_replace(t, WIDE, " "), lambda plain: F.filter(keywords, lambda k: F.contains(plain, k))), **pieces})
    counts = [F.when(F.col(f"_p{no}").isNull(), F.lit(0)).otherwise(F.size(f"_p{no}") - 1).cast("long") for no in range(len(PHRASES))]
    firsts = [F.when(c > 0, words(F.get(F.col(f"_p{no}"), F.lit(0)))) for no, c in enumerate(counts)]
    lasts = [F.when(c > 0, F.col("n_words") - words(F.element_at(F.col(f"_p{no}"), -1)) - len(PHRASES[no][0].split(" "))) for no, c in enumerate(counts)]
    active = F.filter(table, lambda r: F.array_contains(F.col("_kw"), r["keyword"]) & F.regexp_like(t, r["regex"]))
    found = F.when(F.size("_kw") > 0, _undominated(F.flatten(F.transform(active, lambda r: _matches(t, r)))))
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(c > 0, F.lit(label)) for c, (_, label) in zip(counts, PHRASES)]))))
    out = out.withColumns({
        "n_base": sum(counts[1:], counts[0]),
        "first_word": F.array_min(F.array(*firsts)),
        "last_word": F.array_max(F.array(*lasts)),
        "_base": base,
        "_found": found,
    })
    spans = F.coalesce(F.transform("_found", lambda e: F.struct(e["start"].alias("start"), (-e["minus_stop"]).alias("stop"), (-e["minus_priority"]).alias("priority"), e["no"].alias("rule"), e["label"].alias("label"))), F.slice(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"), F.lit(0).alias("priority"), F.lit(0).alias("rule"), F.lit("").alias("label"))), 1, 0))
    out = out.withColumn("spans", spans)
    labels = F.array_sort(F.array_distinct(F.concat("_base", F.transform("spans", lambda e: e["label"]))))
    sure = F.greatest(F.when(F.col("n_base") > 0, F.lit(PHRASE_SCORE)).otherwise(F.lit(0.0)), F.coalesce(F.array_max(F.transform("spans", lambda e: e["priority"])) / F.lit(100.0), F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), sure.alias("score"), "spans")


def op3_license_scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every document."""
    return license_spans(docs).drop("spans")


def oracle_sql() -> str:
    """The same scan in DuckDB SQL, from the same rules."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    rules = ",\n".join(f"({no}, {p}, {quoted(k)}, {quoted(label)}, {quoted(r)})" for no, (p, k, label, r) in enumerate(parse_rules()))
    places = []
    for phrase, label in PHRASES:
        own = phrase.split(" ")
        test = " AND ".join(f"ws[i + {k + 1}] = {quoted(w)}" for k, w in enumerate(own))
        places.append(f"SELECT rid, {quoted(label)} AS label, unnest(list_filter(range(len(ws)), lambda i: {test})) AS pos FROM w")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH r(no, priority, keyword, label, regex) AS (VALUES {rules}),
t AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') AS t FROM documents),
w AS MATERIALIZED (SELECT rid, regexp_extract_all(t, '{WORD}') AS ws FROM t),
b AS ({" UNION ALL ".join(places)}),
bb AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list(DISTINCT label)) AS base FROM b GROUP BY rid),
h AS (SELECT rid, no, priority, label, string_split_regex(t, regex) AS pieces, regexp_extract_all(t, regex) AS hits FROM t JOIN r ON contains(t, keyword) AND regexp_matches(t, regex)),
m AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM h),
s AS MATERIALIZED (SELECT rid, no, priority, label, stop - length(hits[i]) AS start, stop FROM (SELECT *, list_sum(list_transform(pieces[1:i], lambda x: length(x))) + list_sum(list_transform(hits[1:i], lambda x: length(x))) AS stop FROM m)),
k AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s e WHERE e.rid = s.rid AND e.start <= s.start AND e.stop >= s.stop AND e.priority >= s.priority
        AND (e.priority > s.priority OR e.stop - e.start > s.stop - s.start OR e.no < s.no))),
kk AS (SELECT rid, list(DISTINCT label) AS labels, max(priority) AS best FROM k GROUP BY rid)
SELECT t.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(bb.n_base, 0)::BIGINT AS n_base, bb.first_word::BIGINT AS first_word, bb.last_word::BIGINT AS last_word,
       coalesce(array_to_string(bb.base, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bb.base, []), coalesce(kk.labels, [])))), ','), '') AS labels,
       greatest(CASE WHEN bb.n_base > 0 THEN {PHRASE_SCORE}::DOUBLE ELSE 0.0::DOUBLE END, coalesce(kk.best / 100.0::DOUBLE, 0.0::DOUBLE)) AS score
FROM t JOIN w USING (rid) LEFT JOIN bb USING (rid) LEFT JOIN kk USING (rid)
"""
