"""Signature rules for license notices, in order of priority.

A rule is a label, a keyword that every match contains, a regex over words (lower case,
single spaces between them, punctuation gone: "Version 2.0" reads ``version 2 0``) and a
confidence. Rules are built from hand-written names, tags, addresses and sentences: each
license is looked for as its own text, as an identifier tag, as a grant ("licensed under
..."), as an address and as a bare name, in this order, the more specific license first.
No match is longer than ``MAX_WORDS`` words.
"""

from __future__ import annotations

from typing import NamedTuple

MAX_WORDS = 64


class Rule(NamedTuple):
    label: str
    keyword: str
    regex: str
    confidence: float


_V = "(?: version| v)?"

# Label, identifier (as words), names as (keyword, regex), address; specific before general.
LICENSES: list[tuple[str, str | None, list[tuple[str, str]], str | None]] = [
    ("agpl-3.0", "agpl 3 0", [("affero general public license", f"(?:gnu )?affero general public license{_V} 3(?: 0)?"),
                              ("agplv3", "(?:gnu )?agplv3"), ("agpl", "(?:gnu )?agpl 3(?: 0)?")], "gnu org licenses agpl"),
    ("agpl", None, [("affero general public license", "(?:gnu )?affero general public license"), ("gnu agpl", "gnu agpl")], None),
    ("lgpl-3.0", "lgpl 3 0", [("lesser general public license", f"(?:gnu )?lesser general public license{_V} 3(?: 0)?"),
                              ("lgplv3", "(?:gnu )?lgplv3"), ("lgpl", "(?:gnu )?lgpl 3(?: 0)?")], "gnu org licenses lgpl 3 0"),
    ("lgpl-2.1", "lgpl 2 1", [("lesser general public license", f"(?:gnu )?lesser general public license{_V} 2 1"),
                              ("lgplv2", "(?:gnu )?lgplv2 1"), ("lgpl", "(?:gnu )?lgpl 2 1")], "gnu org licenses old licenses lgpl 2 1"),
    ("lgpl-2.0", "lgpl 2 0", [("library general public license", f"(?:gnu )?library general public license(?:{_V} 2(?: 0)?)?"),
                              ("lgplv2", "(?:gnu )?lgplv2"), ("lgpl", "(?:gnu )?lgpl 2(?: 0)?")], None),
    ("lgpl", None, [("lesser general public license", "(?:gnu )?lesser general public license"), ("gnu lgpl", "gnu lgpl")],
     "gnu org licenses lgpl"),
    ("gpl-3.0", "gpl 3 0", [("general public license", f"(?:gnu )?general public license{_V} 3(?: 0)?"),
                            ("gplv3", "(?:gnu )?gplv3"), ("gpl", "(?:gnu )?gpl 3(?: 0)?")], "gnu org licenses gpl 3 0"),
    ("gpl-2.0", "gpl 2 0", [("general public license", f"(?:gnu )?general public license{_V} 2(?: 0)?"),
                            ("gplv2", "(?:gnu )?gplv2"), ("gpl", "(?:gnu )?gpl 2(?: 0)?")], "gnu org licenses old licenses gpl 2 0"),
    ("gpl-1.0", "gpl 1 0", [("general public license", f"gnu general public license{_V} 1(?: 0)?"), ("gpl", "gnu gpl 1(?: 0)?")], None),
    ("gpl", None, [("general public license", "(?:gnu )?general public license"), ("gnu gpl", "gnu gpl")], "gnu org licenses gpl"),
    ("gfdl-1.3", "gfdl 1 3", [("free documentation license", f"(?:gnu )?free documentation license{_V} 1 3")], None),
    ("gfdl-1.2", "gfdl 1 2", [("free documentation license", f"(?:gnu )?free documentation license{_V} 1 2")], None),
    ("gfdl", "gfdl", [("free documentation license", "(?:gnu )?free documentation license")], "gnu org licenses fdl"),
    ("apache-2.0", "apache 2 0", [("apache license", f"apache license{_V} 2(?: 0)?"), ("apache software license", f"apache software license{_V} 2(?: 0)?"),
                                  ("apache 2 0", "apache 2 0(?: license)?"), ("asl 2 0", "asl 2 0")], "apache org licenses license 2 0"),
    ("apache-1.1", "apache 1 1", [("apache software license", f"apache software license{_V} 1 1"), ("apache license", f"apache license{_V} 1 1")],
     "apache org licenses license 1 1"),
    ("apache", None, [("apache license", "apache license"), ("apache software license", "apache software license")], "apache org licenses"),
    ("mit-0", "mit 0", [("mit no attribution", "mit no attribution(?: license)?")], None),
    ("mit", "mit", [("mit license", "mit license"), ("mit licence", "mit licence"), ("expat license", "expat license"),
                    ("mit x11 license", "mit x11 license")], "opensource org licenses mit"),
    ("x11", "x11", [("x11 license", "x11 license")], None),
    ("bsd-4-clause", "bsd 4 clause", [("bsd license", "(?:4 clause|four clause|original) bsd license"), ("bsd 4 clause", "bsd 4 clause(?: license)?")],
     "opensource org licenses bsd 4 clause"),
    ("bsd-3-clause", "bsd 3 clause", [("bsd license", "(?:3 clause|three clause|new|modified|revised) bsd license"),
                                      ("bsd 3 clause", "bsd 3 clause(?: license)?")], "opensource org licenses bsd 3 clause"),
    ("bsd-2-clause", "bsd 2 clause", [("bsd license", "(?:2 clause|two clause|simplified|freebsd) bsd license"),
                                      ("bsd 2 clause", "bsd 2 clause(?: license)?")], "opensource org licenses bsd 2 clause"),
    ("0bsd", "0bsd", [("bsd zero clause license", "bsd zero clause license"), ("zero clause bsd", "zero clause bsd(?: license)?")], None),
    ("bsd", None, [("bsd license", "bsd license"), ("bsd style license", "bsd style license")], "opensource org licenses bsd"),
    ("isc", "isc", [("isc license", "isc license")], "opensource org licenses isc"),
    ("zlib", "zlib", [("zlib license", "zlib license"), ("zlib libpng license", "zlib libpng license")], "opensource org licenses zlib"),
    ("bsl-1.0", "bsl 1 0", [("boost software license", f"boost software license(?:{_V} 1 0)?")], "boost org license 1 0"),
    ("busl-1.1", "busl 1 1", [("business source license", f"business source license(?:{_V} 1 1)?")], "mariadb com bsl11"),
    ("mpl-2.0", "mpl 2 0", [("mozilla public license", f"mozilla public license{_V} 2(?: 0)?"), ("mpl 2 0", "mpl 2 0")], "mozilla org mpl 2 0"),
    ("mpl-1.1", "mpl 1 1", [("mozilla public license", f"mozilla public license{_V} 1 1"), ("mpl 1 1", "mpl 1 1")], "mozilla org mpl 1 1"),
    ("mpl", None, [("mozilla public license", "mozilla public license")], "mozilla org mpl"),
    ("epl-2.0", "epl 2 0", [("eclipse public license", f"eclipse public license{_V} 2(?: 0)?"), ("epl 2 0", "epl 2 0")], "eclipse org legal epl 2 0"),
    ("epl-1.0", "epl 1 0", [("eclipse public license", f"eclipse public license{_V} 1(?: 0)?"), ("epl 1 0", "epl 1 0")], "eclipse org legal epl v10"),
    ("epl", None, [("eclipse public license", "eclipse public license")], None),
    ("edl-1.0", None, [("eclipse distribution license", f"eclipse distribution license(?:{_V} 1 0)?")], "eclipse org org documents edl v10"),
    ("cddl-1.1", "cddl 1 1", [("common development and distribution license", f"common development and distribution license{_V} 1 1")], None),
    ("cddl-1.0", "cddl 1 0", [("common development and distribution license", f"common development and distribution license(?:{_V} 1 0)?")],
     "opensource org licenses cddl1"),
    ("cpl-1.0", "cpl 1 0", [("common public license", f"common public license(?:{_V} 1 0)?")], None),
    ("eupl-1.2", "eupl 1 2", [("european union public licence", f"european union public licence(?:{_V} 1 2)?"), ("eupl 1 2", "eupl 1 2")], "eupl eu 1 2"),
    ("artistic-2.0", "artistic 2 0", [("artistic license", f"artistic license{_V} 2(?: 0)?")], "opensource org licenses artistic license 2 0"),
    ("artistic", "artistic 1 0", [("artistic license", f"artistic license(?:{_V} 1 0)?")], None),
    ("unlicense", "unlicense", [("the unlicense", "the unlicense")], "unlicense org"),
    ("wtfpl", "wtfpl", [("do what the fuck you want to public license", "do what the fuck you want to public license"), ("wtfpl", "wtfpl")], "wtfpl net"),
    ("beerware", "beerware", [("beer ware license", "beer ware license")], None),
    ("psf-2.0", "psf 2 0", [("python software foundation license", f"python software foundation license(?:{_V} 2)?"), ("psf license", "psf license")],
     "python org psf license"),
    ("php-3.01", "php 3 01", [("php license", f"php license(?:{_V} 3 01)?")], "php net license"),
    ("ruby", "ruby", [("ruby license", "ruby license"), ("same terms as ruby", "same terms as ruby")], None),
    ("perl", None, [("same terms as perl itself", "same terms as perl itself")], None),
    ("openssl", "openssl", [("openssl license", "openssl license")], None),
    ("postgresql", "postgresql", [("postgresql license", "postgresql license"), ("postgresql licence", "postgresql licence")], None),
    ("ofl-1.1", "ofl 1 1", [("open font license", f"(?:sil )?open font license(?:{_V} 1 1)?"), ("ofl 1 1", "ofl 1 1")], "scripts sil org ofl"),
    ("odbl-1.0", "odbl 1 0", [("open database license", "(?:odc )?open database license"), ("odbl", "odbl 1 0")], "opendatacommons org licenses odbl"),
    ("odc-by-1.0", "odc by 1 0", [("open data commons attribution license", "open data commons attribution license")], "opendatacommons org licenses by"),
    ("pddl-1.0", "pddl 1 0", [("public domain dedication and license", "public domain dedication and license")], "opendatacommons org licenses pddl"),
    ("ncsa", "ncsa", [("illinois ncsa open source license", "university of illinois ncsa open source license")], None),
    ("ms-pl", "ms pl", [("microsoft public license", "microsoft public license")], "opensource org licenses ms pl"),
    ("ms-rl", "ms rl", [("microsoft reciprocal license", "microsoft reciprocal license")], "opensource org licenses ms rl"),
    ("afl-3.0", "afl 3 0", [("academic free license", f"academic free license(?:{_V} 3 0)?")], None),
    ("osl-3.0", "osl 3 0", [("open software license", f"open software license(?:{_V} 3 0)?")], None),
    ("upl-1.0", "upl 1 0", [("universal permissive license", f"universal permissive license(?:{_V} 1 0)?")], "oss oracle com licenses upl"),
    ("mulanpsl-2.0", "mulanpsl 2 0", [("mulan psl", "mulan psl ?v?2")], "license coscl org cn mulanpsl2"),
    ("cecill-2.1", "cecill 2 1", [("cecill", f"cecill license(?:{_V} 2 1)?")], "cecill info"),
    ("json", "json", [("the json license", "the json license")], None),
    ("vim", "vim", [("vim license", "vim license")], None),
    ("w3c", "w3c", [("w3c software notice and license", "w3c software notice and license"), ("w3c software license", "w3c software license")], None),
    ("zpl-2.1", "zpl 2 1", [("zope public license", f"zope public license(?:{_V} 2 1)?")], None),
    ("sleepycat", "sleepycat", [("sleepycat license", "sleepycat license")], None),
    ("qpl-1.0", "qpl 1 0", [("q public license", f"q public license(?:{_V} 1 0)?")], None),
    ("sspl-1.0", "sspl 1 0", [("server side public license", f"server side public license(?:{_V} 1(?: 0)?)?")], None),
    ("elastic-2.0", "elastic 2 0", [("elastic license", f"elastic license(?:{_V} 2(?: 0)?)?")], "elastic co licensing elastic license"),
    ("openrail", None, [("openrail", "(?:bigscience )?openrail(?: m)?(?: license)?")], None),
    ("cc0-1.0", "cc0 1 0", [("cc0", "cc0(?: 1 0)?(?: universal)?"), ("creative commons zero", "creative commons zero(?: v1 0)?(?: universal)?")],
     "creativecommons org publicdomain zero 1 0"),
    ("cc-pdm-1.0", None, [("public domain mark", "public domain mark(?: 1 0)?")], "creativecommons org publicdomain mark"),
]

# Creative Commons: clauses as words of the short form and of the long one.
_CC_CLAUSES = [
    ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"),
    ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("by-nc", "by nc", "attribution non ?commercial"),
    ("by-nd", "by nd", "attribution no ?deriv(?:ative)?s"),
    ("by-sa", "by sa", "attribution share ?alike"),
    ("by", "by", "attribution"),
]
_CC_VERSIONS = ["4.0", "3.0", "2.5", "2.0", None]

# Sentences of license texts: label, keyword, regex.
TEXTS: list[tuple[str, str, str]] = [
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use copy modify and or distribute", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-4-clause", "all advertising materials mentioning features", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-3-clause", "may be used to endorse or promote products", "neither the names? of (?:[^ ]+ ){1,14}?may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-2-clause", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("apache-2.0", "you may not use this file except in compliance", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl-3.0", "either version 3 of the license", "gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2.0", "either version 2 of the license", "gnu general public license as published by the free software foundation either version 2 of the license"),
    ("lgpl-3.0", "either version 3 of the license", "gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl-2.1", "either version 2 1 of the license", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("agpl-3.0", "either version 3 of the license", "gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("gfdl", "permission is granted to copy distribute and or modify this document", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", "this source code form is subject to the terms", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-2.0", "this program and the accompanying materials are made available", "this program and the accompanying materials are made available under the terms of the eclipse public license(?: v)? 2 0"),
    ("epl-1.0", "this program and the accompanying materials are made available", "this program and the accompanying materials are made available under the terms of the eclipse public license(?: v)? 1 0"),
    ("bsl-1.0", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("zlib", "this software is provided as is without any express", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("unlicense", "free and unencumbered software released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "dedicated all copyright and related", "(?:has|have|hereby|and) dedicated all copyright and related(?: or| and) neighboring rights"),
    ("artistic", "the intent of this document is to state the conditions", "the intent of this document is to state the conditions under which a package may be copied"),
    ("wtfpl", "you just do what the fuck you want to", "you just do what the fuck you want to"),
    ("ofl-1.1", "this font software is licensed", "this font software is licensed under the sil open font license"),
    ("psf-2.0", "this license agreement is between the python software foundation", "this license agreement is between the python software foundation"),
    ("public-domain", "released into the public domain", "(?:is|are|been|hereby) released into the public domain"),
    ("public-domain", "dedicated to the public domain", "(?:is|are|been|hereby) dedicated to the public domain"),
    ("public-domain", "in the public domain", "(?:is|are) in the public domain"),
    ("all-rights-reserved", "all rights reserved", "copyright (?:[^ ]+ ){0,12}?all rights reserved"),
    ("proprietary", "proprietary and confidential", "proprietary and confidential"),
    ("proprietary", "unauthorized copying of this file", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("non-commercial", "non commercial use only", "for non commercial use only"),
    ("non-commercial", "noncommercial use only", "for noncommercial use only"),
    ("research-only", "research purposes only", "for research purposes only"),
]

_GRANT = (
    "(?:licensed|released|distributed|redistributed|available|published|provided|offered|covered|shared) (?:[^ ]+ ){0,3}?under "
    "(?:the |a |an )?(?:terms (?:and conditions )?of )?(?:the |a |an )?"
)


def _creative_commons() -> list[tuple[str, str, list[tuple[str, str]], str | None]]:
    out = []
    for version in _CC_VERSIONS:
        tail, words = ("", "") if version is None else (f"-{version}", " " + version.replace(".", " "))
        for clauses, short, long in _CC_CLAUSES:
            names = [
                (f"cc {short}{words}", f"cc {short}{words}"),
                ("creative commons attribution", f"creative commons {long}{words}(?: international| unported)?"),
            ]
            out.append((f"cc-{clauses}{tail}", f"cc {short}{words}", names, f"creativecommons org licenses {short}{words}"))
    return out


def license_rules() -> list[Rule]:
    """All rules, the one of highest priority first."""
    licenses = LICENSES + _creative_commons()
    rules = [Rule(label, keyword, regex, 1.0) for label, keyword, regex in TEXTS]
    rules += [
        Rule(label, f"spdx license identifier {tag}", f"spdx license identifier {tag}(?: only| or later)?", 1.0)
        for label, tag, _, _ in licenses
        if tag
    ]
    rules += [Rule(label, k, f"{_GRANT}(?:{r})(?: license)?", 0.95) for label, _, names, _ in licenses for k, r in names]
    rules += [Rule(label, address, address, 0.9) for label, _, _, address in licenses if address]
    rules += [Rule(label, k, r, 0.8) for label, _, names, _ in licenses for k, r in names]
    return rules
