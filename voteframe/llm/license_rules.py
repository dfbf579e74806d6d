"""Signature rules of licences: patterns over the words of a text, in order of their priority.

A pattern is a regular expression over words of a-z, digits and whatever is not ASCII: a blank
stands between two words, and a word is never matched in part. Other signs are not words, so
``GPL-3.0-or-later`` reads ``gpl 3 0 or later``. Each rule has a keyword, a text that every match of the rule
holds (with a blank for the edge of a word); where a document lacks it, the rule isn't tried.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    keyword: str
    pattern: str
    priority: int
    score: float


#: Label, keyword, the name in prose, and the words of its short identifier.
NAMES = [
    ("mit", " mit licen", "mit licen[sc]e", "mit"),
    ("mit", " expat licen", "expat licen[sc]e", None),
    ("mit-0", " mit ", "mit no attribution(?: licen[sc]e)?", "mit 0"),
    ("apache-2", " apache", "apache (?:software )?licen[sc]e (?:version )?(?:2|v2)(?: 0)?", "apache 2 0"),
    ("apache-2", " apache", "apache 2(?: 0)? licen[sc]e", None),
    ("apache-1.1", " apache", "apache (?:software )?licen[sc]e (?:version )?1 1", "apache 1 1"),
    ("apache-1.0", " apache", "apache (?:software )?licen[sc]e (?:version )?1 0", "apache 1 0"),
    ("apache", " apache", "apache (?:software )?licen[sc]e", None),
    ("gpl-1", " general public licen", "(?:gnu )?general public licen[sc]e (?:version )?(?:1|v1)(?: 0)?", "gpl 1 0(?: only| or later)?"),
    ("gpl-2", " general public licen", "(?:gnu )?general public licen[sc]e (?:version )?(?:2|v2)(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-2", " gplv2", "(?:gnu )?gplv2", None),
    ("gpl-2", " gpl ", "(?:gnu )?gpl (?:version )?(?:2|v2)(?: 0)?", None),
    ("gpl-3", " general public licen", "(?:gnu )?general public licen[sc]e (?:version )?(?:3|v3)(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("gpl-3", " gplv3", "(?:gnu )?gplv3", None),
    ("gpl-3", " gpl ", "(?:gnu )?gpl (?:version )?(?:3|v3)(?: 0)?", None),
    ("gpl", " general public licen", "(?:gnu )?general public licen[sc]e", None),
    ("gpl", " gnu gpl ", "gnu gpl", None),
    ("lgpl-2", " general public licen", "(?:gnu )?library general public licen[sc]e(?: (?:version )?(?:2|v2)(?: 0)?)?", "lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", " general public licen", "(?:gnu )?lesser general public licen[sc]e (?:version )?(?:2|v2) 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", " general public licen", "(?:gnu )?lesser general public licen[sc]e (?:version )?(?:3|v3)(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("lgpl-3", " lgplv3", "(?:gnu )?lgplv3", None),
    ("lgpl", " general public licen", "(?:gnu )?lesser general public licen[sc]e", None),
    ("lgpl", " lgpl ", "(?:gnu )?lgpl", None),
    ("agpl-3", " general public licen", "(?:gnu )?affero general public licen[sc]e (?:version )?(?:3|v3)(?: 0)?", "agpl 3 0(?: only| or later)?"),
    ("agpl-3", " agplv3", "(?:gnu )?agplv3", None),
    ("agpl", " affero", "(?:gnu )?affero (?:general public licen[sc]e|gpl)", None),
    ("agpl", " agpl ", "(?:gnu )?agpl", None),
    ("gfdl", " free documentation licen", "(?:gnu )?free documentation licen[sc]e(?: (?:version )?1 [123])?", "gfdl 1 [123](?: only| or later)?"),
    ("bsd-2", " bsd ", "(?:simplified bsd|freebsd|2 clause bsd|two clause bsd|bsd 2 clause)(?: licen[sc]e)?", "bsd 2 clause"),
    ("bsd-3", " bsd ", "(?:new bsd|modified bsd|revised bsd|3 clause bsd|three clause bsd|bsd 3 clause)(?: licen[sc]e)?", "bsd 3 clause"),
    ("bsd-4", " bsd ", "(?:original bsd|old bsd|4 clause bsd|bsd 4 clause)(?: licen[sc]e)?", "bsd 4 clause"),
    ("bsd", " bsd ", "bsd(?: style)? licen[sc]e", None),
    ("0bsd", "bsd ", "(?:0bsd|zero clause bsd)(?: licen[sc]e)?", "0bsd"),
    ("mpl-1.1", " mozilla public licen", "mozilla public licen[sc]e (?:version )?(?:1|v1) 1", "mpl 1 1"),
    ("mpl-2", " mozilla public licen", "mozilla public licen[sc]e (?:version )?(?:2|v2)(?: 0)?", "mpl 2 0"),
    ("mpl", " mozilla public licen", "mozilla public licen[sc]e", None),
    ("epl-1", " eclipse public licen", "eclipse public licen[sc]e (?:version )?(?:1|v1)(?: 0)?", "epl 1 0"),
    ("epl-2", " eclipse public licen", "eclipse public licen[sc]e (?:version )?(?:2|v2)(?: 0)?", "epl 2 0"),
    ("epl", " eclipse public licen", "eclipse public licen[sc]e", None),
    ("cddl", " common development and distribution licen", "common development and distribution licen[sc]e(?: (?:version )?1 [01])?", "cddl 1 [01]"),
    ("cpl", " common public licen", "common public licen[sc]e(?: (?:version )?1 0)?", "cpl 1 0"),
    ("eupl", " european union public licen", "european union public licen[sc]e(?: (?:version )?(?:v1|1) [0-2])?", "eupl 1 [0-2]"),
    ("artistic-2", " artistic licen", "artistic licen[sc]e (?:version )?2(?: 0)?", "artistic 2 0"),
    ("artistic", " artistic licen", "artistic licen[sc]e", "artistic 1 0"),
    ("zlib", " zlib ", "zlib(?: libpng)? licen[sc]e", "zlib"),
    ("libpng", " libpng ", "libpng licen[sc]e", "libpng"),
    ("isc", " isc ", "isc licen[sc]e", "isc"),
    ("unlicense", " unlicense ", "the unlicense", "unlicense"),
    ("wtfpl", " want to public licen", "do what the f[a-z]* you want to public licen[sc]e", "wtfpl"),
    ("boost", " boost software licen", "boost software licen[sc]e(?: (?:version )?1 0)?", "bsl 1 0"),
    ("psf", " python software foundation licen", "python software foundation licen[sc]e(?: version 2)?", "psf 2 0"),
    ("openssl", " openssl ", "openssl licen[sc]e", "openssl"),
    ("ofl", " open font licen", "(?:sil )?open font licen[sc]e(?: (?:version )?1 [01])?", "ofl 1 [01]"),
    ("odbl", " open database licen", "open database licen[sc]e(?: 1 0)?", "odbl 1 0"),
    ("odc-by", " open data commons attribution", "open data commons attribution licen[sc]e", "odc by 1 0"),
    ("pddl", " public domain dedication", "(?:open data commons )?public domain dedication and licen[sc]e", "pddl 1 0"),
    ("cc0", " cc0 ", "cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by", " cc by ", "cc by(?: [1-4] [05])?", "cc by [1-4] [05]"),
    ("cc-by-sa", " cc by sa ", "cc by sa(?: [1-4] [05])?", "cc by sa [1-4] [05]"),
    ("cc-by-nd", " cc by nd ", "cc by nd(?: [1-4] [05])?", "cc by nd [1-4] [05]"),
    ("cc-by-nc", " cc by nc ", "cc by nc(?: [1-4] [05])?", "cc by nc [1-4] [05]"),
    ("cc-by-nc-sa", " cc by nc sa ", "cc by nc sa(?: [1-4] [05])?", "cc by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", " cc by nc nd ", "cc by nc nd(?: [1-4] [05])?", "cc by nc nd [1-4] [05]"),
    ("cc-by", " creative commons ", "creative commons attribution(?: [1-4] [05])?", None),
    ("cc-by-sa", " creative commons ", "creative commons attribution share(?: )?alike(?: [1-4] [05])?", None),
    ("cc-by-nd", " creative commons ", "creative commons attribution no(?: )?deriv(?:s|atives|ative works)(?: [1-4] [05])?", None),
    ("cc-by-nc", " creative commons ", "creative commons attribution non(?: )?commercial(?: [1-4] [05])?", None),
    ("cc-by-nc-sa", " creative commons ", "creative commons attribution non(?: )?commercial share(?: )?alike(?: [1-4] [05])?", None),
    ("cc-by-nc-nd", " creative commons ", "creative commons attribution non(?: )?commercial no(?: )?deriv(?:s|atives|ative works)(?: [1-4] [05])?", None),
    ("cc", " creative commons ", "creative commons(?: public)? licen[sc]e", None),
    ("ms-pl", " microsoft public licen", "microsoft public licen[sc]e", "ms pl"),
    ("ms-rl", " microsoft reciprocal licen", "microsoft reciprocal licen[sc]e", "ms rl"),
    ("afl", " academic free licen", "academic free licen[sc]e(?: (?:version )?[123] [01])?", "afl [123] [01]"),
    ("osl", " open software licen", "open software licen[sc]e(?: (?:version )?[123] [01])?", "osl [123] [01]"),
    ("postgresql", " postgresql licen", "postgresql licen[sc]e", "postgresql"),
    ("ncsa", " ncsa ", "(?:university of illinois )?ncsa(?: open source)? licen[sc]e", "ncsa"),
    ("w3c", " w3c ", "w3c software(?: notice)?(?: and)? licen[sc]e", "w3c"),
    ("vim", " vim licen", "vim licen[sc]e", "vim"),
    ("ruby", " ruby licen", "ruby licen[sc]e", "ruby"),
    ("upl", " universal permissive licen", "universal permissive licen[sc]e(?: (?:version |v)?1 0)?", "upl 1 0"),
    ("cecill", " cecill", "cecill(?: [abc])?(?: free software)? licen[sc]e", "cecill 2 1"),
    ("mulan", " mulan ", "mulan (?:psl|permissive software licen[sc]e)(?: (?:version )?(?:2|v2))?", "mulanpsl 2 0"),
    ("busl", " business source licen", "business source licen[sc]e(?: (?:version )?1 1)?", "busl 1 1"),
    ("sspl", " server side public licen", "server side public licen[sc]e(?: (?:version )?(?:1|v1))?", "sspl 1 0"),
    ("elastic", " elastic licen", "elastic licen[sc]e(?: (?:version )?(?:2|v2)(?: 0)?)?", "elastic 2 0"),
    ("commons-clause", " commons clause ", "commons clause(?: licen[sc]e| restriction)?", None),
    ("polyform", " polyform ", "polyform (?:noncommercial|small business|shield|strict) licen[sc]e", None),
    ("openrail", " openrail ", "(?:creativeml )?openrail(?: m)?(?: licen[sc]e)?", None),
    ("hippocratic", " hippocratic licen", "hippocratic licen[sc]e", "hippocratic 2 1"),
    ("json", " json licen", "json licen[sc]e", "json"),
    ("beerware", " beer", "beer(?: )?ware licen[sc]e", "beerware"),
]
#: Ways to name a licence: priority, score, what stands before the name.
FORMS = [
    (2, 0.95, "(?:licensed|licenced|released|distributed|redistributed|published|available|provided|shared|covered) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:latest )?"),
    (3, 0.9, "(?:licen[sc]e|licensed|licensing) (?:is |as |type |name )?(?:the )?"),
    (4, 0.7, ""),
]
TAG = "spdx licen[sc]e identifier "
#: Label, keyword, wording of the licence itself or of its usual notice.
TEXTS = [
    ("mit", " permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", " deal in the software ", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute"),
    ("isc", " permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", " redistribution and use ", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", " endorse or promote ", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4", " advertising materials ", "all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment"),
    ("apache-2", " you may not use this file ", "you may not use this file except in compliance with the licen[sc]e"),
    ("apache-2", " without warranties or conditions ", "as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", " this program is free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("gpl-2", " either version 2 ", "either version 2 of the licen[sc]e or at your option any later version"),
    ("gpl-3", " either version 3 ", "either version 3 of the licen[sc]e or at your option any later version"),
    ("lgpl", " this library is free software", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e"),
    ("mpl-2", " this source code form ", "this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("zlib", " altered source versions ", "altered source versions must be plainly marked as such"),
    ("zlib", " origin of this software ", "the origin of this software must not be misrepresented"),
    ("unlicense", " released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("public-domain", " public domain ", "(?:is|are|placed|released|dedicated) (?:in|into|in to|to) the public domain"),
    ("all-rights-reserved", " all rights reserved ", "all rights reserved"),
    ("proprietary", " proprietary ", "proprietary and confidential"),
    ("proprietary", " unauthori", "unauthori[sz]ed copying of this (?:file|software|document)(?: via any medium)? is strictly prohibited"),
    ("non-commercial", " commercial use ", "(?:not for|no) commercial use|for non commercial use only"),
    ("no-redistribution", " be reproduced ", "may not be reproduced(?: or (?:distributed|transmitted))?(?: in any form)? without (?:the )?(?:prior )?written (?:permission|consent)"),
    ("boost", " machine executable object code", "machine executable object code generated by a source language processor"),
    ("wtfpl", " what the f", "you just do what the f[a-z]* you want to"),
    ("beerware", " buy me a beer ", "you can buy me a beer in return"),
    ("json", " shall be used for good ", "the software shall be used for good not evil"),
    ("ofl", " reserved font name", "no modified version of the font software may use the reserved font names?"),
    ("cc0", " related or neighboring rights ", "waived all copyright and related or neighboring rights"),
    ("artistic", " standard version ", "the standard version of the package"),
    ("psf", " licensed to psf ", "licensed to psf under a contributor agreement"),
]
#: Label, keyword, words of an address, or a name that counts only after what says that a licence follows.
LINKS = [
    ("mit", " under mit ", "(?:licensed|released|distributed|available) under mit"),
    ("mit", " license mit ", "license mit"),
    ("mit", " opensource org ", "opensource org licen[sc]es? mit(?: license)?(?: php)?"),
    ("apache-2", " apache org ", "apache org licenses license 2 0"),
    ("bsd-2", " opensource org ", "opensource org licen[sc]es? bsd 2 clause"),
    ("bsd-3", " opensource org ", "opensource org licen[sc]es? bsd 3 clause"),
    ("isc", " opensource org ", "opensource org licen[sc]es? isc"),
    ("zlib", " opensource org ", "opensource org licen[sc]es? zlib"),
    ("gpl-2", " gnu org ", "gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3", " gnu org ", "gnu org licenses gpl(?: 3 0)?"),
    ("lgpl-2.1", " gnu org ", "gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3", " gnu org ", "gnu org licenses lgpl(?: 3 0)?"),
    ("agpl-3", " gnu org ", "gnu org licenses agpl(?: 3 0)?"),
    ("gfdl", " gnu org ", "gnu org licenses fdl(?: 1 3)?"),
    ("mpl-2", " mozilla org ", "mozilla org (?:en us )?mpl 2 0"),
    ("epl-2", " eclipse org ", "eclipse org legal epl (?:v20|2 0)"),
    ("cc-by", " creativecommons org ", "creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", " creativecommons org ", "creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nd", " creativecommons org ", "creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc", " creativecommons org ", "creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nc-sa", " creativecommons org ", "creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", " creativecommons org ", "creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc0", " creativecommons org ", "creativecommons org publicdomain zero 1 0"),
    ("public-domain", " creativecommons org ", "creativecommons org publicdomain mark 1 0"),
    ("unlicense", " unlicense org ", "unlicense org"),
    ("ofl", " scripts sil org ", "scripts sil org ofl"),
    ("boost", " boost org ", "boost org license 1 0"),
]


def all_rules() -> list[Rule]:
    """The rules in order: identifiers and wordings, then addresses and grants, then names."""
    rules = [Rule(label, " identifier ", TAG + tag, 1, 1.0) for label, _, _, tag in NAMES if tag]
    rules += [Rule(label, keyword, text, 1, 1.0) for label, keyword, text in TEXTS]
    rules += [Rule(label, keyword, link, 2, 0.95) for label, keyword, link in LINKS]
    for priority, score, before in FORMS:
        rules += [Rule(label, keyword, before + name, priority, score) for label, keyword, name, _ in NAMES]
    return rules
