"""License scans by ordered signature rules, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.base import ascii_lower

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that every scan counts, with their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Signature rules.  A rule is (priority, label, keywords, pattern over space-joined words); a lower number goes first.
# Whatever a pattern matches holds one of the rule's keywords (parted by |) as a word.
# Sentences of the licenses themselves and of their notices, a line each: priority, label, keywords, pattern.
SENTENCES = r"""
1 mit hereby permission is hereby granted free of charge to any person obtaining a copy of this software(?: and associated documentation files)?
2 mit portions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
1 mit-0 attribution mit no attribution
1 x11 consortium except as contained in this notice the name of the x consortium shall not be used in advertising
1 isc permission permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
1 curl fee permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
1 bsd redistribution redistribution and use in source and binary forms with or without modification are permitted
2 bsd redistributions redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
2 bsd redistributions redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
2 bsd-3-clause endorse neither the name of (?:\S+ ){1,8}nor the names of its contributors may be used to endorse or promote products
2 bsd-3-clause endorse neither the name of (?:\S+ ){1,8}nor the names of its contributors may be used to endorse
2 bsd-3-clause-clear patent no express or implied licenses to any party s patent rights are granted by this license
2 bsd-4-clause advertising all advertising materials mentioning features or use of this software must display
1 sleepycat redistributions redistributions in any form must be accompanied by information on how to obtain complete source code
1 apache-2 apache licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
1 apache-2 apache you may obtain a copy of the license at (?:https? )?(?:www )?apache org licenses license 2 0
2 apache-2 apache apache org licenses license 2 0
2 apache-2 apache apache license version 2 0 january 2004
3 apache-2 compliance you may not use this file except in compliance with the license
3 apache-2 applicable unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
2 apache-1.1 apache this product includes software developed by the apache software foundation
1 gpl redistribute this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
1 gpl redistribute you can redistribute it and or modify it under the terms of the gnu general public license
2 gpl-2 option either version 2 of the license or at your option any later version
2 gpl-3 option either version 3 of the license or at your option any later version
2 gpl general you should have received a copy of the gnu general public license along with this program
1 gpl-1 general gnu general public license version 1 february 1989
1 gpl-2 general gnu general public license version 2 june 1991
1 gpl-3 general gnu general public license version 3 29 june 2007
2 gpl-2 gnu gnu org licenses (?:old licenses )?gpl 2 0
2 gpl-3 gnu gnu org licenses gpl 3 0
3 gnu-text verbatim everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
1 lgpl redistribute this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
2 lgpl general you should have received a copy of the gnu (?:lesser|library) general public license along with this library
1 lgpl-2 library gnu library general public license version 2 june 1991
1 lgpl-2.1 lesser gnu lesser general public license version 2 1 february 1999
1 lgpl-3 lesser gnu lesser general public license version 3 29 june 2007
2 lgpl gnu gnu org licenses lgpl [23] [01]
1 agpl-3 affero under the terms of the gnu affero general public license as published by the free software foundation
1 agpl-3 affero gnu affero general public license version 3 19 november 2007
2 agpl-3 gnu gnu org licenses agpl 3 0
1 gfdl document permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
2 gfdl documentation gnu free documentation license(?: version 1 [123])?
1 mpl-2 form this source code form is subject to the terms of the mozilla public license v 2 0
2 mpl-2 mpl if a copy of the mpl was not distributed with this file you can obtain one at
2 mpl-2 mozilla mozilla org mpl 2 0
1 mpl-1.1 mozilla the contents of this file are subject to the mozilla public license version 1 1
1 mpl-1 mozilla the contents of this file are subject to the mozilla public license version 1 0
1 epl eclipse this program and the accompanying materials are made available under the terms of the eclipse public license
2 epl-1 eclipse eclipse org legal epl v10
2 epl-2 eclipse eclipse org legal epl (?:v20|2 0)
1 cddl-1 development the contents of this file are subject to the terms of the common development and distribution license
1 ipl-1 ibm ibm public license version 1 0
1 artistic-1 package the intent of this document is to state the conditions under which a package may be copied
2 artistic-1 copying you may charge a reasonable copying fee for any distribution of this package
1 artistic-2 package this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
1 perl perl you can redistribute it and or modify it under the same terms as perl itself
2 perl perl under the same terms as perl(?: itself)?
1 bsl-1 organization permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
2 bsl-1 boost boost software license version 1 0(?: august 17th 2003)?
2 bsl-1 boost boost org license 1 0
2 zlib misrepresented the origin of this software must not be misrepresented you must not claim that you wrote the original software
2 zlib altered altered source versions must be plainly marked as such
2 zlib authors in no event will the authors be held liable for any damages arising from the use of this software
1 libpng libpng|png the png reference library is supplied as is|libpng versions? \S+ through \S+ are copyright
1 unlicense unencumbered this is free and unencumbered software released into the public domain
2 unlicense anyone anyone is free to copy modify publish use compile sell or distribute this software
2 unlicense unlicense unlicense org
1 wtfpl fuck do what the fuck you want to(?: public license)?
2 wtfpl verbatim everyone is permitted to copy and distribute verbatim or modified copies of this license document
1 cc0-1 extent to the extent possible under law (?:\S+ ){1,8}waived all copyright and related or neighboring rights
2 cc0-1 creativecommons creativecommons org publicdomain zero 1 0
3 public-domain creativecommons creativecommons org publicdomain mark 1 0
2 cc-by creativecommons creativecommons org licenses by [1-4] [05]
2 cc-by-sa creativecommons creativecommons org licenses by sa [1-4] [05]
2 cc-by-nd creativecommons creativecommons org licenses by nd [1-4] [05]
2 cc-by-nc creativecommons creativecommons org licenses by nc [1-4] [05]
2 cc-by-nc-sa creativecommons creativecommons org licenses by nc sa [1-4] [05]
2 cc-by-nc-nd creativecommons creativecommons org licenses by nc nd [1-4] [05]
1 cc-by-nc-sa creative creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?
1 cc-by-nc-nd creative creative commons attribution non ?commercial no ?deriv(?:atives|s)(?: [1-4] [05])?
1 ofl-1.1 font this font software is licensed under the sil open font license version 1 1
2 ofl-1.1 font the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself
3 ofl-1.1 reserved with reserved font name
1 openssl openssl this product includes software developed by the openssl project for use in the openssl toolkit
1 ssleay cryptographic this product includes cryptographic software written by eric young
1 php-3 php this product includes php software freely available from
2 php-3 php (?:the )?php license version 3(?: 01)?
1 psf-2 psf psf hereby grants licensee a nonexclusive royalty free world ?wide license
1 psf-2 cnri cnri hereby grants licensee a nonexclusive royalty free world ?wide license
1 ruby verbatim you may make and give away verbatim copies of the source form of the software without restriction
1 unicode unicode permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
1 icu icu icu license icu 1 8 1 and later
1 w3c w3c w3c software(?: and document)? notice and license
1 json evil the software shall be used for good not evil
1 beerware stuff as long as you retain this notice you can do whatever you want with this stuff
2 beerware beer you can buy me a beer in return
1 postgresql agreement permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
1 hpnd fee permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee
1 ntp documentation permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted
1 ncsa deal permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction
1 ms-pl accept this license governs use of the accompanying software if you use the software you accept this license
2 ms-rl reciprocal reciprocal grants for any file you distribute that contains code from the software
1 eupl-1.2 eupl licensed under the eupl
2 eupl-1.1 eupl licensed under the eupl version 1 1
1 cecill cecill governed by the cecill(?: [abc])? license under french law
1 ecl-2 educational educational community license version 2 0
1 lppl latex this work may be distributed and or modified under the conditions of the latex project public license
2 lppl latex latex project public license
1 qpl-1 q q public license(?: version)? 1 0
1 vim vim vim license|distributed under the vim license
1 watcom watcom sybase open watcom public license
1 apsl-2 apple apple public source license
1 nasa-1.3 nasa nasa open source agreement
1 oclc-2 oclc oclc research public license
1 rpl-1.5 reciprocal reciprocal public license
1 spl-1 sun sun public license
1 sissl sun sun industry standards source license
1 intel intel intel open source license
1 motosoto motosoto motosoto open source license
1 nokia nokia nokia open source license
1 ipa-font ipa ipa font license agreement
1 bitstream-vera bitstream bitstream vera fonts? copyright
1 ubuntu-font ubuntu ubuntu font licen[cs]e
1 mulan-2 mulan mulan psl v2|mulan permissive software license
1 blueoak-1 oak blue oak model license
1 parity-7 parity parity public license
1 hippocratic hippocratic hippocratic license
1 sspl-1 functionality if you make the functionality of the program or a modified version available to third parties as a service
1 busl-1.1 production the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
1 elastic-2 hosted you may not provide the software to third parties as a hosted or managed service
1 commons-clause sell the license does not include and the license does not grant to you the right to sell the software
1 confluent-1 confluent confluent community license
1 redis-source redis redis source available license
1 timescale timescale timescale license agreement
1 polyform polyform polyform (?:noncommercial|small business|shield|strict|perimeter|internal use|free trial)
1 openrail openrail|rail (?:bigscience|creativeml) (?:bloom )?open ?rail(?: m)?(?: license)?
1 openrail rail (?:bigscience|creativeml|responsible ai) (?:bloom )?open rail m
1 llama llama llama [23](?: [1-9])? community license(?: agreement)?
1 gemma gemma gemma terms of use
1 odbl-1 database this database is made available under the open database license
1 odc-by-1 data open data commons attribution license
1 pddl-1 data open data commons public domain dedication and license
1 cdla cdla|community (?:community data license agreement|cdla) (?:permissive|sharing)
1 ogl-uk sector contains public sector information licensed under the open government licence
2 ogl-uk government open government licence(?: v[123] 0)?
1 etalab-2 ouverte licence ouverte
1 data-de deutschland datenlizenz deutschland namensnennung
1 gpl-classpath classpath|exception as a special exception the copyright holders of this library give you permission to link this library|classpath exception
3 dual-license dual dual licensed under
3 dual-license option at your option under either of
4 license-file file (?:see|in) the (?:accompanying )?(?:license|licence|copying)(?: txt| md)? file
4 license-file distribution see the license (?:included )?(?:with|in) this distribution
3 public-domain domain (?:released|placed|dedicated|is) (?:in ?to|in|to) the public domain
3 public-domain domain has been (?:released|placed|dedicated) (?:in ?to|in|to) the public domain
3 public-domain domain (?:this is a )?public domain work
2 public-domain government as a work of the united states government this (?:\S+ ){1,3}is in the public domain
3 no-warranty warranty without warranty of any kind
3 no-warranty warranty without even the implied warranty of merchantability or fitness for a particular purpose
3 no-warranty merchantability warranties of merchantability fitness for a particular purpose and non ?infringement
3 no-warranty holders|holder|owner in no event shall the (?:authors or )?copyright (?:holders?|owner) (?:or contributors )?be liable
3 no-warranty contributors this software is provided by the copyright holders and contributors as is
4 proprietary rights all rights reserved
3 proprietary proprietary (?:confidential and proprietary|proprietary and confidential)
2 proprietary unauthorized unauthorized copying of this file via any medium is strictly prohibited
2 proprietary confidential this software is the confidential and proprietary information of
2 proprietary consent|permission no part of this (?:\S+ ){1,3}may be reproduced (?:\S+ ){1,20}without (?:the )?prior written (?:consent|permission)
3 proprietary eula|user end user license agreement|this eula
3 proprietary trade contains trade secrets
4 proprietary internal for internal use only
3 non-commercial commercial for non commercial (?:use|purposes) only
3 non-commercial noncommercial for noncommercial (?:use|purposes) only
3 academic-only academic for academic (?:use|purposes) only
3 research-only research for research (?:use|purposes) only
"""
# Families: label, keywords, the name as a pattern.
FAMILIES = (
    ("mit", "mit", r"mit"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?(?: version)? 1 1"),
    ("apache-2", "apache", r"apache(?: software)?(?: license)?(?: version)? v?2(?: 0)?"),
    ("gpl-1", "gpl", r"gpl(?: version)? v?1(?: 0)?"),
    ("gpl-2", "gpl", r"gpl(?: version)? v?2(?: 0)?"),
    ("gpl-3", "gpl", r"gpl(?: version)? v?3(?: 0)?"),
    ("gpl-2", "general", r"gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version)? v?2(?: 0)?"),
    ("gpl-3", "general", r"gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version)? v?3(?: 0)?"),
    ("gpl", "general", r"gnu general public license"),
    ("lgpl-2", "lgpl", r"lgpl(?: version)? v?2(?: 0)?"),
    ("lgpl-2.1", "lgpl", r"lgpl(?: version)? v?2 1"),
    ("lgpl-3", "lgpl", r"lgpl(?: version)? v?3(?: 0)?"),
    ("lgpl", "general", r"gnu (?:lesser|library) general public license"),
    ("agpl-3", "agpl", r"agpl(?: version)? v?3(?: 0)?"),
    ("agpl-3", "affero", r"gnu affero general public license(?: version)?(?: v?3)?"),
    ("bsd-2-clause", "bsd|freebsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("0bsd", "0bsd|bsd", r"(?:0bsd|zero clause bsd)"),
    ("mpl-1.1", "mozilla", r"mozilla public license(?: version)? v?1 1"),
    ("mpl-2", "mozilla", r"mozilla public license(?: version)? v?2(?: 0)?"),
    ("mpl-2", "mpl", r"mpl(?: version)? v?2(?: 0)?"),
    ("epl-1", "eclipse", r"eclipse public license(?: version)? v?1(?: 0)?"),
    ("epl-2", "eclipse", r"eclipse public license(?: version)? v?2(?: 0)?"),
    ("cddl-1", "cddl|common", r"(?:cddl|common development and distribution license)(?: version)?(?: 1 0)?"),
    ("cpl-1", "common", r"common public license(?: version)?(?: 1 0)?"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("libpng", "libpng", r"libpng"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("artistic-1", "artistic", r"artistic(?: license)? 1(?: 0)?"),
    ("artistic-2", "artistic", r"artistic(?: license)? 2(?: 0)?"),
    ("bsl-1", "boost", r"boost software license(?: version)?(?: 1 0)?"),
    ("psf-2", "python|psf", r"(?:python software foundation|psf)(?: license)?(?: version)?(?: 2)?"),
    ("ms-pl", "microsoft", r"microsoft public"),
    ("ms-rl", "microsoft", r"microsoft reciprocal"),
    ("eupl-1.2", "eupl|european", r"(?:eupl|european union public licence)(?: v?1 2)?"),
    ("ofl-1.1", "sil", r"sil open font license(?: version)?(?: 1 1)?"),
    ("afl-3", "academic", r"academic free license(?: version)?(?: v?3(?: 0)?)?"),
    ("osl-3", "open", r"open software license(?: version)?(?: v?3(?: 0)?)?"),
    ("upl-1", "universal", r"universal permissive license(?: version)?(?: 1 0)?"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?"),
    ("cc0-1", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by", "cc", r"cc by(?: [1-4] [05])?"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by", "creative", r"creative commons attribution(?: [1-4] [05])?(?: international)?"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?: [1-4] [05])?"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:atives|s)(?: [1-4] [05])?"),
    ("odbl-1", "odbl|open", r"(?:odbl|open database license)(?: v?1 0)?"),
    ("sspl-1", "server", r"server side public license(?: version)?(?: 1)?"),
    ("busl-1.1", "business", r"business source license(?: version)?(?: 1 1)?"),
    ("elastic-2", "elastic", r"elastic license(?: version)?(?: 2(?: 0)?)?"),
    ("commons-clause", "clause", r"commons clause"),
)
# Surroundings of a name: priority, pattern before it, pattern after it.
SETTINGS = (
    (1, r"spdx license identifier ", r"(?: or later| only)?"),
    (2, r"(?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of the )?", r"(?: licen[sc]e)?(?: or (?:any )?later(?: version)?)?"),
    (3, r"(?:under|see|license[ds]?|licen[sc]e is) (?:the )?", r" licen[sc]e(?: or (?:any )?later(?: version)?)?"),
    (4, r"", r" licen[sc]e"),
    (5, r"licen[sc]e ", r""),
)
#: Priorities are below this number.
PRIORITIES = 7
#: Detections that are folded together; more than these are folded in parts.
FOLD = 512


def rules() -> list[tuple[int, str, str, str]]:
    """All signature rules: the base phrases first, then the sentences, then every family in every setting."""
    out = [(0, label, phrase.split()[-1] if label != "cc-by-nc" else "cc", phrase) for phrase, label in BASE]
    lines = [line.split(" ", 3) for line in SENTENCES.strip().split("\n")]
    out += [(int(p), label, keywords, pattern) for p, label, keywords, pattern in lines]
    out += [(p, label, keyword, before + name + after) for p, before, after in SETTINGS for label, keyword, name in FAMILIES]
    # a bare Creative Commons code is a name of its own
    return out + [(6, label, keyword, name) for label, keyword, name in FAMILIES if label.startswith("cc")]


def over_numbers(pattern: str) -> str:
    """A rule's pattern over words that are each followed by \\x01 and their number."""
    inner = pattern.replace(r"\S+", r"[^\x01\x20]+").replace(" ?", "(?: )?").replace(" ", r"\x01[0-9]+ ")
    return rf"(?<= )(?:{inner})\x01[0-9]+(?= )"


def word_start(joined: Column, at: Column) -> Column:
    """Words before position ``at`` (from 1) of a string that holds a space before every word."""
    before = F.left(joined, at)
    return (F.length(before) - F.length(F.replace(before, F.lit(" "))) - 1).cast("long")


HIT = "struct<start_word:int,after:int,priority:int,rule:int,label:string>"


def unsuppressed(hits: Column) -> Column:
    """The hits that no other one suppresses, from hits (start_word, -end, priority, rule, label) in that order.

    Whatever holds a hit comes before it, so one pass that keeps the furthest end of each priority decides.  Arrays grow
    by copying, so the pass goes over parts of FOLD hits, each begun with the ends of all before it.
    """
    ends = F.array_repeat(F.lit(-1), F.lit(PRIORITIES))
    reached = lambda best, x: F.transform(best, lambda b, q: F.when(q >= x["priority"], F.greatest(b, -x["after"])).otherwise(b))
    held = lambda best, x: F.get(best, x["priority"]) >= -x["after"]
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / FOLD).cast("int")), lambda i: F.slice(hits, i * FOLD + 1, FOLD))
    none = F.array().cast(f"array<{HIT}>")
    begun = F.struct(ends.alias("best"), F.array().cast(f"array<struct<best:array<int>,part:array<{HIT}>>>").alias("parts"))
    parts = F.aggregate(
        parts, begun, lambda s, part: F.struct(F.aggregate(part, s["best"], reached).alias("best"), F.concat(s["parts"], F.array(F.struct(s["best"].alias("best"), part.alias("part")))).alias("parts")), lambda s: s["parts"]
    )
    step = lambda s, x: F.struct(reached(s["best"], x).alias("best"), F.when(held(s["best"], x), s["kept"]).otherwise(F.concat(s["kept"], F.array(x))).alias("kept"))
    return F.flatten(F.transform(parts, lambda p: F.aggregate(p["part"], F.struct(p["best"].alias("best"), none.alias("kept")), step, lambda s: s["kept"])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find license statements; a row for each row of ``docs``.

    Returns (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections).  Words are those of
    the A-Z lower-cased whole text, joined by single spaces.  Base phrases are counted at every place.  A text
    that holds some rule's keyword is tried on the rules of its keywords only, over its words with their numbers; a
    detection inside another one of a better or equal priority, or equal to one of a better rule, is suppressed.
    ``detections`` are structs (start_word, words, priority, label) in order of place; the score is the share of words they
    cover, at least 0.5 with a base label, up to 1.

    Null and empty texts have 0 words, no labels and score 0; null ids stay; repeated rows are scanned alike; of detections of
    one place and priority the earlier rule's stays; very long texts are scanned whole, in time in proportion to their length and detections; an
    empty table gives no rows; other columns are not used.  Everything runs in DataFrame functions.
    """
    every = rules()
    joined = F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), BREAKS, " ")), F.lit(" "))
    rows = docs.select(F.col(id_col).alias("doc_id"), joined.alias("_joined"))
    rows = rows.withColumn("_joined", F.when(F.col("_joined") == "  ", F.lit(" ")).otherwise(F.col("_joined")))
    text = F.col("_joined")
    n_words = (F.length(text) - F.length(F.replace(text, F.lit(" "))) - 1).cast("long")

    # base phrases: count every place, also where two share a space
    places = {label: F.when(F.contains(text, F.lit(f" {p} ")), F.regexp_count(text, F.lit(f" {p}(?= )"))).otherwise(F.lit(0)) for p, label in BASE}
    firsts = [F.when(F.col(f"_n_{i}") > 0, word_start(text, F.instr(text, f" {p} "))) for i, (p, _) in enumerate(BASE)]
    turned = F.reverse(text)
    lasts = []
    for i, (p, _) in enumerate(BASE):
        at = F.length(text) - (F.instr(turned, f" {p} "[::-1]) - 1) - (len(p) + 2) + 1
        lasts.append(F.when(F.col(f"_n_{i}") > 0, word_start(text, at)))
    rows = rows.withColumns({f"_n_{i}": places[label].cast("long") for i, (_, label) in enumerate(BASE)})
    base = F.array_sort(F.filter(F.array(*[F.when(F.col(f"_n_{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]), lambda x: x.isNotNull()))

    # keyword gate: the keywords of a text
    keywords = sorted({k for _, _, some, _ in every for k in some.split("|")})
    gate = r"(?<= )(?:[al]?gpl|" + "|".join(k for k in keywords if k not in ("gpl", "lgpl", "agpl")) + r")(?= )"
    found = F.when(F.rlike(text, F.lit(gate)), F.array_distinct(F.regexp_extract_all(text, F.lit(f"({gate})"), F.lit(1))))
    rows = rows.withColumns({
        "n_words": n_words,
        "n_base": sum((F.col(f"_n_{i}") for i in range(1, len(BASE))), F.col("_n_0")),
        "first_word": F.least(*firsts),
        "last_word": F.greatest(*lasts),
        "_base": base,
        "_keywords": found,
    })
    numbered = F.array_join(F.transform(F.split(F.trim(text), " "), lambda w, i: F.concat(w, F.lit("\x01"), i.cast("string"))), " ")
    rows = rows.withColumn("_numbered", F.when(F.col("_keywords").isNotNull(), F.concat(F.lit(" "), numbered, F.lit(" "))))

    # the rules of each set of keywords, as one expression that is left out for texts without these
    groups: dict[str, list[int]] = {}
    for i, (_, _, some, _) in enumerate(every):
        groups.setdefault(some, []).append(i)
    tried = []
    for some, of in groups.items():
        matches = ", ".join(f"named_struct('rule', {i}, 'found', regexp_extract_all(_numbered, r'{over_numbers(every[i][3])}', 0))" for i in of)
        held = " OR ".join(f"array_contains(_keywords, '{k}')" for k in some.split("|"))
        tried.append(f"CASE WHEN {held} THEN array({matches}) ELSE array() END")
    listed = lambda k: F.expr("array(" + ", ".join(repr(r[k]) for r in every) + ")")

    def hits_of(tried: Column) -> Column:
        rule, priorities, labels = tried["rule"], listed(0), listed(1)
        first = lambda m: F.regexp_extract(m, "\x01([0-9]+)", 1).cast("int")
        last = lambda m: F.substring_index(m, "\x01", -1).cast("int")
        return F.transform(tried["found"], lambda m: F.struct(first(m).alias("start_word"), (-last(m) - 1).alias("after"), F.get(priorities, rule).alias("priority"), rule.alias("rule"), F.get(labels, rule).alias("label")))

    matched = F.filter(F.expr("flatten(array(" + ",\n".join(tried) + "))"), lambda t: F.size(t["found"]) > 0)
    rows = rows.withColumn("_raw", F.when(F.col("_keywords").isNotNull(), F.array_sort(F.flatten(F.transform(matched, hits_of)))))
    shown = F.transform(unsuppressed(F.col("_raw")), lambda x: F.struct(x["start_word"].alias("start_word"), (-x["after"] - x["start_word"]).alias("words"), x["priority"].alias("priority"), x["label"].alias("label")))
    rows = rows.withColumn("detections", F.when(F.size("_raw") > 0, shown).otherwise(F.array().cast("array<struct<start_word:int,words:int,priority:int,label:string>>")))
    labels = F.array_sort(F.array_union(F.col("_base"), F.array_distinct(F.transform("detections", lambda x: x["label"]))))
    covered = F.aggregate("detections", F.lit(0), lambda a, x: a + x["words"])
    share = F.when(F.col("n_words") > 0, covered / F.col("n_words")).otherwise(F.lit(0.0))
    value = F.least(F.lit(1.0), F.greatest(share, F.when(F.col("n_base") > 0, F.lit(0.5)).otherwise(F.lit(0.0))))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("_base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), value.alias("score"), "detections",
    )
