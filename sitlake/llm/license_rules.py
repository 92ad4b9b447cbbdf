"""Ordered signature rules for licence mentions: hand-written patterns over lower-cased words.

Patterns see a text's words joined by single spaces, so punctuation and line breaks never matter:
"GPL-2.0-or-later" reads "gpl 2 0 or later".  A rule's keyword must stand in the text before its
pattern is tried.  Lower priority numbers win where detections overlap.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    #: A string that every match holds; the gate of the pattern.
    keyword: str
    pattern: str
    priority: int
    score: float


#: Priorities: whole grants and texts, then exact ids and versions, then names, then bare hints.
TEXT, EXACT, NAME, HINT = 1, 2, 3, 4

# Sentences of licence texts and of their usual notices.
_TEXTS = [
    ("mit", "free of charge to any person", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation"),
    ("mit", "substantial portions of the software", r"the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software"),
    ("mit", "without warranty of any kind", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit", "under the", r"(?:released|licensed|distributed|available|published) under the (?:terms of the )?(?:mit|expat) licen[sc]e"),
    ("mit-0", "mit no attribution", r"mit no attribution(?: licen[sc]e)?"),
    ("isc", "modify and or distribute this software", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "modify and distribute this software", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", "zero clause bsd", r"(?:bsd )?zero clause bsd(?: licen[sc]e)?|zero clause bsd"),
    ("bsd-2-clause", "redistributions in binary form", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer (?:2 )?redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse or promote products", r"neither the name of (?:[^ ]+ ){1,40}?(?:nor the names of its contributors )?may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising materials mentioning", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2.0", "apache license version 2 0", r"licensed under the apache license version 2 0(?: the license)?"),
    ("apache-2.0", "you may not use this file except", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "unless required by applicable law", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-1.1", "developed by the apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("gpl-2.0", "general public license as published", r"under the terms of the gnu general public license as published by the free software foundation (?:either )?version 2(?! 1)"),
    ("gpl-3.0", "general public license as published", r"under the terms of the gnu general public license as published by the free software foundation (?:either )?version 3"),
    ("lgpl-2.1", "lesser general public license as published", r"under the terms of the gnu lesser general public license as published by the free software foundation (?:either )?version 2 1"),
    ("lgpl-3.0", "lesser general public license as published", r"under the terms of the gnu lesser general public license as published by the free software foundation (?:either )?version 3"),
    ("agpl-3.0", "affero general public license", r"under the terms of the gnu affero general public license as published by the free software foundation"),
    ("gpl", "licensed under the gnu general public license", r"(?:this work is )?licensed under the gnu general public license"),
    ("gpl-3.0", "gnu general public license version 3", r"gnu general public license version 3(?: 0)?(?: or (?:any )?later)?"),
    ("gpl-2.0", "gnu general public license version 2", r"gnu general public license version 2(?: 0)?(?: or (?:any )?later)?"),
    ("gpl-1.0", "gnu general public license version 1", r"gnu general public license version 1(?: 0)?"),
    ("mpl-2.0", "mozilla public license v 2 0", r"subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "mozilla public license version 1 1", r"subject to the mozilla public license version 1 1"),
    ("mpl", "mozilla org mpl", r"you can obtain one at https? mozilla org mpl 2 0"),
    ("unlicense", "released into the public domain", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "do what the fuck you want", r"do what the fuck you want to public license"),
    ("zlib", "in no event will the authors be held liable", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such"),
    ("bsl-1.0", "boost software license", r"(?:distributed under the )?boost software license version 1 0"),
    ("artistic-2.0", "artistic license 2 0", r"(?:the )?artistic license 2 0"),
    ("cc0-1.0", "cc0 1 0 universal", r"(?:creative commons )?cc0 1 0 universal(?: public domain dedication)?"),
    ("public-domain", "dedicated to the public domain", r"(?:has been |is )?(?:hereby )?dedicated to the public domain"),
    ("public-domain", "placed in the public domain", r"(?:has been |is )?(?:hereby )?placed in the public domain"),
    ("ofl-1.1", "sil open font license", r"(?:this font software is licensed under the )?sil open font license(?: version 1 1)?"),
    ("proprietary", "confidential and proprietary all rights", r"confidential and proprietary all rights reserved"),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "proprietary and confidential", r"(?:this (?:software|document) is )?proprietary and confidential"),
    ("gfdl", "free documentation license", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("cc-by-sa", "text is available under", r"text is available under the creative commons attribution share ?alike licen[sc]e"),
    ("epl", "this program and the accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("openssl", "openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("json", "used for good not evil", r"the software shall be used for good not evil"),
    ("beerware", "buy me a beer", r"(?:if we meet some day and you think this stuff is worth it you can|you think this (?:stuff|software|code) is worth it you can) buy me a beer"),
]

# Short ids as they read in words, with the keyword that gates them.
_IDS = [
    ("afl-3.0", "afl", r"afl 3 0"), ("agpl-3.0", "agpl", r"agpl ?(?:v ?)?3(?: 0)?(?: only| or later)?"), ("agpl-1.0", "agpl", r"agpl 1 0(?: only| or later)?"),
    ("apache-2.0", "apache", r"apache 2(?: 0)?"), ("apache-1.1", "apache", r"apache 1 1"), ("apache-1.0", "apache", r"apache 1 0"), ("apsl-2.0", "apsl", r"apsl 2 0"),
    ("artistic-1.0", "artistic", r"artistic 1 0(?: perl| cl8)?"), ("artistic-2.0", "artistic", r"artistic 2 0"), ("0bsd", "0bsd", r"0bsd"),
    ("bsd-1-clause", "bsd", r"bsd 1 clause"), ("bsd-2-clause", "bsd", r"bsd 2 clause(?: patent| views)?"), ("bsd-3-clause", "bsd", r"bsd 3 clause(?: clear| lbnl| attribution)?"), ("bsd-4-clause", "bsd", r"bsd 4 clause(?: uc)?"),
    ("blueoak-1.0.0", "blueoak", r"blueoak 1 0 0"), ("bsl-1.0", "bsl", r"bsl 1 0"), ("busl-1.1", "busl", r"busl 1 1"), ("cal-1.0", "cal", r"cal 1 0"),
    ("cc-by-1.0", "cc by", r"cc by 1 0"), ("cc-by-2.0", "cc by", r"cc by 2 0"), ("cc-by-2.5", "cc by", r"cc by 2 5"), ("cc-by-3.0", "cc by", r"cc by 3 0"), ("cc-by-4.0", "cc by", r"cc by 4 0"),
    ("cc-by-sa-1.0", "cc by sa", r"cc by sa 1 0"), ("cc-by-sa-2.0", "cc by sa", r"cc by sa 2 0"), ("cc-by-sa-2.5", "cc by sa", r"cc by sa 2 5"), ("cc-by-sa-3.0", "cc by sa", r"cc by sa 3 0"), ("cc-by-sa-4.0", "cc by sa", r"cc by sa 4 0"),
    ("cc-by-nc-2.0", "cc by nc", r"cc by nc 2 0"), ("cc-by-nc-2.5", "cc by nc", r"cc by nc 2 5"), ("cc-by-nc-3.0", "cc by nc", r"cc by nc 3 0"), ("cc-by-nc-4.0", "cc by nc", r"cc by nc 4 0"),
    ("cc-by-nd-2.0", "cc by nd", r"cc by nd 2 0"), ("cc-by-nd-3.0", "cc by nd", r"cc by nd 3 0"), ("cc-by-nd-4.0", "cc by nd", r"cc by nd 4 0"),
    ("cc-by-nc-sa-2.0", "cc by nc sa", r"cc by nc sa 2 0"), ("cc-by-nc-sa-3.0", "cc by nc sa", r"cc by nc sa 3 0"), ("cc-by-nc-sa-4.0", "cc by nc sa", r"cc by nc sa 4 0"),
    ("cc-by-nc-nd-2.0", "cc by nc nd", r"cc by nc nd 2 0"), ("cc-by-nc-nd-3.0", "cc by nc nd", r"cc by nc nd 3 0"), ("cc-by-nc-nd-4.0", "cc by nc nd", r"cc by nc nd 4 0"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?"), ("cddl-1.0", "cddl", r"cddl 1 0"), ("cddl-1.1", "cddl", r"cddl 1 1"), ("cecill-2.1", "cecill", r"cecill 2 1"), ("cecill-b", "cecill", r"cecill b"), ("cecill-c", "cecill", r"cecill c"),
    ("cpl-1.0", "cpl", r"cpl 1 0"), ("curl", "curl", r"spdx licen[sc]e identifier curl"), ("ecl-2.0", "ecl", r"ecl 2 0"), ("efl-2.0", "efl", r"efl 2 0"), ("epl-1.0", "epl", r"epl 1 0"), ("epl-2.0", "epl", r"epl 2 0"),
    ("eupl-1.1", "eupl", r"eupl 1 1"), ("eupl-1.2", "eupl", r"eupl 1 2"), ("ftl", "ftl", r"spdx licen[sc]e identifier ftl"), ("gfdl-1.1", "gfdl", r"gfdl 1 1"), ("gfdl-1.2", "gfdl", r"gfdl 1 2"), ("gfdl-1.3", "gfdl", r"gfdl 1 3(?: only| or later)?"),
    ("gpl-1.0", "gpl", r"gpl 1 0(?: only| or later)?"), ("gpl-2.0", "gpl", r"gpl ?(?:v ?)?2(?: 0)?(?: only| or later)?(?! 1)"), ("gpl-3.0", "gpl", r"gpl ?(?:v ?)?3(?: 0)?(?: only| or later)?"),
    ("hpnd", "hpnd", r"hpnd"), ("icu", "icu", r"spdx licen[sc]e identifier icu"), ("imagemagick", "imagemagick", r"imagemagick licen[sc]e"), ("ipl-1.0", "ipl", r"ipl 1 0"), ("isc", "isc", r"spdx licen[sc]e identifier isc"),
    ("lgpl-2.0", "lgpl", r"lgpl 2 0(?: only| or later)?"), ("lgpl-2.1", "lgpl", r"lgpl ?(?:v ?)?2 1(?: only| or later)?"), ("lgpl-3.0", "lgpl", r"lgpl ?(?:v ?)?3(?: 0)?(?: only| or later)?"),
    ("lpl-1.02", "lpl", r"lpl 1 02"), ("lppl-1.3c", "lppl", r"lppl 1 3c"), ("mit-0", "mit 0", r"mit 0"), ("mit", "identifier mit", r"spdx licen[sc]e identifier mit"), ("mpl-1.0", "mpl", r"mpl 1 0"), ("mpl-1.1", "mpl", r"mpl 1 1"), ("mpl-2.0", "mpl", r"mpl 2 0"),
    ("ms-pl", "ms pl", r"ms pl"), ("ms-rl", "ms rl", r"ms rl"), ("mulanpsl-2.0", "mulanpsl", r"mulanpsl 2 0"), ("nasa-1.3", "nasa", r"nasa 1 3"), ("ncsa", "ncsa", r"spdx licen[sc]e identifier ncsa"), ("nposl-3.0", "nposl", r"nposl 3 0"),
    ("odbl-1.0", "odbl", r"odbl(?: 1 0)?"), ("odc-by-1.0", "odc by", r"odc by(?: 1 0)?"), ("pddl-1.0", "pddl", r"pddl(?: 1 0)?"), ("ofl-1.0", "ofl", r"ofl 1 0"), ("ofl-1.1", "ofl", r"ofl 1 1"), ("oldap-2.8", "oldap", r"oldap 2 8"),
    ("osl-1.0", "osl", r"osl 1 0"), ("osl-2.1", "osl", r"osl 2 1"), ("osl-3.0", "osl", r"osl 3 0"), ("php-3.0", "php", r"php 3 0 licen[sc]e"), ("php-3.01", "php", r"php 3 01"), ("postgresql", "identifier postgresql", r"spdx licen[sc]e identifier postgresql"),
    ("psf-2.0", "psf", r"psf 2 0"), ("python-2.0", "python", r"spdx licen[sc]e identifier python 2 0"), ("qpl-1.0", "qpl", r"qpl 1 0"), ("rpl-1.5", "rpl", r"rpl 1 5"), ("rpsl-1.0", "rpsl", r"rpsl 1 0"), ("sleepycat", "sleepycat", r"sleepycat licen[sc]e"),
    ("sspl-1.0", "sspl", r"sspl 1 0"), ("upl-1.0", "upl", r"upl 1 0"), ("unicode", "unicode", r"unicode dfs 201[56]"), ("vsl-1.0", "vsl", r"vsl 1 0"), ("w3c", "w3c", r"w3c software (?:notice and )?licen[sc]e"), ("x11", "identifier x11", r"spdx licen[sc]e identifier x11"),
    ("zpl-2.0", "zpl", r"zpl 2 0"), ("zpl-2.1", "zpl", r"zpl 2 1"), ("zlib", "identifier zlib", r"spdx licen[sc]e identifier zlib"), ("elastic-2.0", "elastic", r"elastic(?: licen[sc]e)? 2 0"), ("openrail", "openrail", r"(?:bigscience |creativeml )?openrail m?"),
]

# Names, as texts spell them out.
_NAMES = [
    ("academic-free", "academic free", r"academic free licen[sc]e"), ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e"), ("apache", "apache software licen", r"apache software licen[sc]e"), ("apache", "apache licence", r"apache licence"),
    ("apsl", "apple public source", r"apple public source licen[sc]e"), ("artistic", "artistic licen", r"artistic licen[sc]e"), ("bsd", "bsd licen", r"(?:new |modified |simplified |revised |original )?bsd licen[sc]e"), ("bsd", "bsd style", r"bsd style licen[sc]e"), ("bsl-1.0", "boost software licen", r"boost software licen[sc]e"),
    ("busl", "business source licen", r"business source licen[sc]e"), ("cc", "creative commons licen", r"creative commons licen[sc]e"), ("cc-by", "creative commons attribution", r"creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?"),
    ("cc-by-sa", "creative commons attribution share", r"creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?"), ("cc-by-nc", "creative commons attribution non", r"creative commons attribution non ?commercial(?: [1-4] [05])?"), ("cc-by-nd", "creative commons attribution no", r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creative commons attribution non", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"), ("cc-by-nc-nd", "creative commons attribution non", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] [05])?"),
    ("cc-by-nc", "cc by nc", r"cc by nc"), ("cc-by-sa", "cc by sa", r"cc by sa"), ("cc-by-nd", "cc by nd", r"cc by nd"), ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa"), ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd"), ("cc0-1.0", "cc zero", r"cc zero"),
    ("cddl", "common development and distribution", r"common development and distribution licen[sc]e"), ("cpl", "common public licen", r"common public licen[sc]e"), ("cpal", "common public attribution", r"common public attribution licen[sc]e"), ("cecill", "cecill", r"cecill(?: licen[sc]e)?"),
    ("community-data", "community data licen", r"community data licen[sc]e agreement(?: permissive| sharing)?"), ("ecl", "educational community", r"educational community licen[sc]e"), ("elastic", "elastic licen", r"elastic licen[sc]e"), ("epl", "eclipse public licen", r"eclipse public licen[sc]e"), ("edl", "eclipse distribution licen", r"eclipse distribution licen[sc]e"),
    ("eupl", "european union public", r"european union public licen[sc]e"), ("ftl", "freetype", r"freetype (?:project )?licen[sc]e"), ("gfdl", "free documentation licen", r"(?:gnu )?free documentation licen[sc]e"), ("gpl", "general public licence", r"(?:gnu )?general public licence"), ("gpl", "gnu gpl", r"gnu gpl"),
    ("hpnd", "historical permission notice", r"historical permission notice and disclaimer"), ("ijg", "independent jpeg group", r"independent jpeg group(?: licen[sc]e)?"), ("intel", "intel open source licen", r"intel open source licen[sc]e"), ("ipl", "ibm public licen", r"ibm public licen[sc]e"), ("isc", "isc licen", r"isc licen[sc]e"),
    ("jasper", "jasper licen", r"jasper licen[sc]e"), ("json", "json licen", r"json licen[sc]e"), ("lgpl", "lesser general public", r"(?:gnu )?lesser general public licen[sc]e"), ("lgpl", "library general public", r"(?:gnu )?library general public licen[sc]e"), ("lgpl", "gnu lgpl", r"gnu lgpl"),
    ("libpng", "libpng licen", r"(?:zlib )?libpng licen[sc]e"), ("lppl", "latex project public", r"latex project public licen[sc]e"), ("lucent", "lucent public licen", r"lucent public licen[sc]e"), ("mit", "expat licen", r"expat licen[sc]e"), ("mit", "mit licence", r"mit licence"), ("mit", "mit style", r"mit style licen[sc]e"), ("mit", "mit x11", r"mit x11(?: licen[sc]e)?"),
    ("mpl", "mozilla public licen", r"mozilla public licen[sc]e"), ("ms-pl", "microsoft public licen", r"microsoft public licen[sc]e"), ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[sc]e"), ("mulan", "mulan permissive", r"mulan permissive software licen[sc]e"), ("nasa", "nasa open source", r"nasa open source agreement"), ("ncsa", "university of illinois", r"university of illinois (?:ncsa )?open source licen[sc]e"),
    ("npl", "netscape public licen", r"netscape public licen[sc]e"), ("nokia", "nokia open source", r"nokia open source licen[sc]e"), ("odbl", "open database licen", r"open database licen[sc]e"), ("odc-by", "open data commons attribution", r"open data commons attribution licen[sc]e"), ("pddl", "public domain dedication and", r"(?:odc )?public domain dedication and licen[sc]e"), ("ofl", "open font licen", r"open font licen[sc]e"),
    ("ogl", "open government licen", r"open government licen[sc]e"), ("oldap", "openldap public", r"openldap public licen[sc]e"), ("openssl", "openssl licen", r"openssl licen[sc]e"), ("osl", "open software licen", r"open software licen[sc]e"), ("php", "php licen", r"php licen[sc]e"), ("postgresql", "postgresql licen", r"postgresql licen[sc]e"), ("psf", "python software foundation licen", r"python software foundation licen[sc]e"),
    ("polyform", "polyform", r"polyform (?:noncommercial|strict|shield|small business|internal use|perimeter)(?: licen[sc]e)?"), ("qpl", "q public licen", r"q public licen[sc]e"), ("rpl", "reciprocal public licen", r"reciprocal public licen[sc]e"), ("ruby", "ruby licen", r"ruby licen[sc]e"), ("sspl", "server side public", r"server side public licen[sc]e"), ("spl", "sun public licen", r"sun public licen[sc]e"),
    ("sil", "sil licen", r"sil licen[sc]e"), ("unlicense", "unlicense", r"(?:the )?unlicense"), ("upl", "universal permissive", r"universal permissive licen[sc]e"), ("vsl", "vovida software", r"vovida software licen[sc]e"), ("watcom", "sybase open watcom", r"sybase open watcom public licen[sc]e"), ("wtfpl", "wtfpl", r"wtfpl"), ("wxwindows", "wxwindows", r"wxwindows library licen[sc]e"),
    ("xfree86", "xfree86", r"xfree86 licen[sc]e"), ("zlib", "zlib licen", r"zlib licen[sc]e"), ("zpl", "zope public", r"zope public licen[sc]e"), ("llama", "community licen", r"llama (?:[0-9] (?:[0-9] )?)?community licen[sc]e"), ("gemma", "gemma terms", r"gemma terms of use"), ("rail", "responsible ai licen", r"(?:open )?responsible ai licen[sc]e"),
]

# Addresses of licence texts.
_LINKS = [
    ("apache-2.0", "apache org licenses", r"apache org licenses license 2 0"), ("cc-by-4.0", "creativecommons org", r"creativecommons org licenses by 4 0"), ("cc-by-3.0", "creativecommons org", r"creativecommons org licenses by 3 0"), ("cc-by-sa-4.0", "creativecommons org", r"creativecommons org licenses by sa 4 0"), ("cc-by-sa-3.0", "creativecommons org", r"creativecommons org licenses by sa 3 0"),
    ("cc-by-nc-4.0", "creativecommons org", r"creativecommons org licenses by nc 4 0"), ("cc-by-nc-3.0", "creativecommons org", r"creativecommons org licenses by nc 3 0"), ("cc-by-nd-4.0", "creativecommons org", r"creativecommons org licenses by nd 4 0"), ("cc-by-nc-sa-4.0", "creativecommons org", r"creativecommons org licenses by nc sa 4 0"), ("cc-by-nc-nd-4.0", "creativecommons org", r"creativecommons org licenses by nc nd 4 0"),
    ("cc0-1.0", "creativecommons org", r"creativecommons org publicdomain zero 1 0"), ("public-domain", "creativecommons org", r"creativecommons org publicdomain mark 1 0"), ("mit", "opensource org", r"opensource org licenses? mit"), ("bsd-2-clause", "opensource org", r"opensource org licenses? bsd 2 clause"), ("bsd-3-clause", "opensource org", r"opensource org licenses? bsd 3 clause"), ("isc", "opensource org", r"opensource org licenses? isc"),
    ("apache-2.0", "opensource org", r"opensource org licenses? apache 2 0"), ("gpl-2.0", "opensource org", r"opensource org licenses? gpl 2 0"), ("gpl-3.0", "opensource org", r"opensource org licenses? gpl 3 0"), ("lgpl-2.1", "opensource org", r"opensource org licenses? lgpl 2 1"), ("mpl-2.0", "opensource org", r"opensource org licenses? mpl 2 0"), ("gpl", "gnu org licenses", r"gnu org licenses (?:old licenses )?gpl(?: [123] 0)?"),
    ("lgpl", "gnu org licenses", r"gnu org licenses (?:old licenses )?lgpl(?: [23] [01])?"), ("agpl", "gnu org licenses", r"gnu org licenses agpl(?: 3 0)?"), ("gfdl", "gnu org licenses", r"gnu org licenses fdl(?: 1 [123])?"), ("mpl-2.0", "mozilla org mpl", r"mozilla org mpl 2 0"), ("epl", "eclipse org legal", r"eclipse org legal epl (?:v10|2 0)"), ("unlicense", "unlicense org", r"unlicense org"), ("wtfpl", "wtfpl net", r"wtfpl net"),
    ("ofl-1.1", "scripts sil org", r"scripts sil org ofl"), ("bsl-1.0", "boost org license", r"boost org license 1 0"), ("odbl", "opendatacommons org", r"opendatacommons org licenses odbl"), ("odc-by", "opendatacommons org", r"opendatacommons org licenses by"), ("pddl", "opendatacommons org", r"opendatacommons org licenses pddl"), ("eupl", "joinup ec europa", r"joinup ec europa eu collection eupl"), ("ogl", "nationalarchives gov uk", r"nationalarchives gov uk doc open government licence"),
]

# Notices that name no licence by themselves.
_HINTS = [
    ("rights", "rights reserved", r"(?:all|some|no) rights reserved"), ("beer", "buy me a beer", r"(?:you can )?buy me a beer"),
    ("notice", "licensed under", r"licensed under the terms of"), ("notice", "see the licen", r"see the licen[sc]e (?:file )?for"), ("notice", "the licen", r"(?:found in|see) the licen[sc]e file"), ("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}"), ("spdx", "spdx", r"spdx licen[sc]e identifier"),
]

#: Short ids that are a name and a version alone.
_PLAIN = re.compile(r"([a-z0-9 ]*[a-z][a-z0-9]*) ([0-9]+(?: [0-9]+)*)")


def _versioned(keyword: str, pattern: str) -> str:
    """An id with the ways in which texts join name and version: "name licence version 1.0", "name v1.0"."""
    plain = _PLAIN.fullmatch(pattern)
    return rf"{plain[1]} (?:licen[sc]e )?(?:v ?|version )?{plain[2]}" if plain and keyword in plain[1] else pattern


_IDS = [(label, keyword, _versioned(keyword, pattern)) for label, keyword, pattern in _IDS]

RULES: tuple[Rule, ...] = tuple(
    Rule(label, keyword, pattern, priority, score)
    for rows, priority, score in ((_TEXTS, TEXT, 1.0), (_IDS, EXACT, 0.95), (_LINKS, EXACT, 0.9), (_NAMES, NAME, 0.8), (_HINTS, HINT, 0.3))
    for label, keyword, pattern in rows
)

# The phrases of the contract and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
