"""Signature rules for licence detection, written on lower-case words.

Each label has patterns in order of priority (90, 80, ... at least 30). One space stands
between words; a pattern covers whole words. A literal stretch outside groups gates each
pattern, so none starts with alternatives only.
"""

from __future__ import annotations

import re

SIGNATURES: dict[str, list[str]] = {
    "mit": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "opensource org licenses mit(?: license)?(?: php)?", "(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?mit licen[cs]e", "spdx license identifier mit", "mit x11 licen[cs]e", "mit style licen[cs]e", "mit licen[cs]ed?", "licen[cs]e mit"],
    "expat": ["(?:under|of) (?:the )?expat licen[cs]e", "expat licen[cs]e"],
    "x11": ["x11 licen[cs]e", "spdx license identifier x11", "x consortium licen[cs]e"],
    "apache-2": ["licensed under the apache licen[cs]e version 2(?: 0)?", "www apache org licenses license 2 0", "spdx license identifier apache 2 0", "apache licen[cs]e v(?:ersion )?2(?: 0)?", "apache licen[cs]e version 2(?: 0)?", "apache software licen[cs]e version 2(?: 0)?", "apache 2(?: 0)? licen[cs]ed?", "apache licen[cs]e 2(?: 0)?"],
    "apache-1.1": ["apache software licen[cs]e version 1 1", "spdx license identifier apache 1 1", "apache licen[cs]e version 1 1"],
    "apache-1": ["apache licen[cs]e version 1 0", "spdx license identifier apache 1 0"],
    "apache": ["apache software licen[cs]e", "apache licen[cs]e"],
    "bsd-2": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "spdx license identifier bsd 2 clause", "bsd 2 clause(?: simplified)?", "simplified bsd licen[cs]e", "freebsd licen[cs]e", "2 clause bsd(?: licen[cs]e)?"],
    "bsd-3": ["neither the name of [^ ]+(?: [^ ]+){0,20} nor the names of its contributors may be used to endorse or promote products", "spdx license identifier bsd 3 clause", "bsd 3 clause(?: new)?", "new bsd licen[cs]e", "modified bsd licen[cs]e", "revised bsd licen[cs]e", "3 clause bsd(?: licen[cs]e)?"],
    "bsd-4": ["all advertising materials mentioning features or use of this software must display", "spdx license identifier bsd 4 clause", "original bsd licen[cs]e", "4 clause bsd(?: licen[cs]e)?"],
    "bsd-0": ["spdx license identifier 0bsd", "zero clause bsd(?: licen[cs]e)?", "bsd zero clause licen[cs]e"],
    "bsd": ["(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?bsd licen[cs]e", "bsd style licen[cs]e", "bsd licen[cs]ed?"],
    "gpl-1": ["gnu general public licen[cs]e version 1", "spdx license identifier gpl 1 0(?: only| or later)?", "gnu gpl v(?:ersion )?1"],
    "gpl-2": ["gnu general public licen[cs]e as published by the free software foundation(?: either)? version 2", "gnu general public licen[cs]e v(?:ersion )?2(?: 0)?", "spdx license identifier gpl 2 0(?: only| or later)?", "gnu general public licen[cs]e version 2(?: 0)?", "general public licen[cs]e version 2", "gnu gpl v(?:ersion )?2", "gpl v(?:ersion )?2", "gplv2(?: licen[cs]e)?", "www gnu org licenses gpl 2 0"],
    "gpl-3": ["gnu general public licen[cs]e as published by the free software foundation(?: either)? version 3", "gnu general public licen[cs]e v(?:ersion )?3(?: 0)?", "spdx license identifier gpl 3 0(?: only| or later)?", "gnu general public licen[cs]e version 3(?: 0)?", "general public licen[cs]e version 3", "gnu gpl v(?:ersion )?3", "gpl v(?:ersion )?3", "gplv3(?: licen[cs]e)?", "www gnu org licenses gpl 3 0"],
    "gpl": ["gnu general public licen[cs]e", "www gnu org licenses gpl", "gnu public licen[cs]e", "general public licen[cs]e", "gnu gpl", "gpl licen[cs]ed?"],
    "lgpl-2": ["gnu library general public licen[cs]e(?: version 2)?", "spdx license identifier lgpl 2 0(?: only| or later)?", "lgpl v(?:ersion )?2(?: 0)?"],
    "lgpl-2.1": ["gnu lesser general public licen[cs]e version 2 1", "spdx license identifier lgpl 2 1(?: only| or later)?", "lesser general public licen[cs]e version 2 1", "lgpl v(?:ersion )?2 1", "lgplv2 1", "www gnu org licenses lgpl 2 1"],
    "lgpl-3": ["gnu lesser general public licen[cs]e version 3", "spdx license identifier lgpl 3 0(?: only| or later)?", "lesser general public licen[cs]e version 3", "lgpl v(?:ersion )?3", "lgplv3"],
    "lgpl": ["gnu lesser general public licen[cs]e", "lesser general public licen[cs]e", "gnu lgpl", "lgpl licen[cs]ed?"],
    "agpl-3": ["gnu affero general public licen[cs]e version 3", "spdx license identifier agpl 3 0(?: only| or later)?", "affero general public licen[cs]e version 3", "agpl v(?:ersion )?3", "agplv3", "www gnu org licenses agpl 3 0"],
    "agpl": ["gnu affero general public licen[cs]e", "affero general public licen[cs]e", "gnu agpl", "agpl licen[cs]ed?"],
    "gfdl-1.1": ["gnu free documentation licen[cs]e version 1 1", "spdx license identifier gfdl 1 1"],
    "gfdl-1.2": ["gnu free documentation licen[cs]e version 1 2", "spdx license identifier gfdl 1 2"],
    "gfdl-1.3": ["gnu free documentation licen[cs]e version 1 3", "spdx license identifier gfdl 1 3"],
    "gfdl": ["gnu free documentation licen[cs]e", "free documentation licen[cs]e"],
    "mpl-1.0": ["mozilla public licen[cs]e version 1 0", "spdx license identifier mpl 1 0"],
    "mpl-1.1": ["mozilla public licen[cs]e version 1 1", "spdx license identifier mpl 1 1"],
    "mpl-2": ["subject to the terms of the mozilla public licen[cs]e v(?:ersion )?2 0", "mozilla public licen[cs]e version 2(?: 0)?", "spdx license identifier mpl 2 0", "mozilla org mpl 2 0", "mozilla public licen[cs]e v?2(?: 0)?"],
    "mpl": ["mozilla public licen[cs]e"],
    "epl-1": ["eclipse public licen[cs]e v(?:ersion )?1 0", "spdx license identifier epl 1 0", "eclipse public licen[cs]e version 1 0"],
    "epl-2": ["eclipse public licen[cs]e v(?:ersion )?2 0", "spdx license identifier epl 2 0", "eclipse public licen[cs]e version 2 0"],
    "epl": ["eclipse public licen[cs]e", "eclipse org legal epl"],
    "edl-1": ["eclipse distribution licen[cs]e(?: version 1 0)?"],
    "cddl-1.0": ["common development and distribution licen[cs]e version 1 0", "spdx license identifier cddl 1 0"],
    "cddl-1.1": ["common development and distribution licen[cs]e version 1 1", "spdx license identifier cddl 1 1"],
    "cddl": ["common development and distribution licen[cs]e", "cddl licen[cs]ed?"],
    "cpl-1": ["common public licen[cs]e version 1 0", "spdx license identifier cpl 1 0", "common public licen[cs]e"],
    "ibm-pl": ["ibm public licen[cs]e(?: version 1 0)?", "spdx license identifier ipl 1 0"],
    "cc0": ["creativecommons org publicdomain zero 1 0", "spdx license identifier cc0 1 0", "creative commons zero(?: v?1 0)?", "cc0 1 0 universal", "licen[cs]e cc0", "cc0 licen[cs]ed?"],
    "cc-by-4.0": ["creative commons attribution 4 0 international(?: licen[cs]e)?", "creativecommons org licenses by 4 0", "spdx license identifier cc by 4 0", "cc by 4 0"],
    "cc-by-3.0": ["creative commons attribution 3 0(?: unported)?(?: licen[cs]e)?", "creativecommons org licenses by 3 0", "spdx license identifier cc by 3 0", "cc by 3 0"],
    "cc-by-2.0": ["creative commons attribution 2 [05](?: generic)?(?: licen[cs]e)?", "creativecommons org licenses by 2 [05]", "cc by 2 [05]"],
    "cc-by-sa-4.0": ["creative commons attribution share ?alike 4 0 international(?: licen[cs]e)?", "creativecommons org licenses by sa 4 0", "spdx license identifier cc by sa 4 0", "cc by sa 4 0"],
    "cc-by-sa-3.0": ["creative commons attribution share ?alike 3 0(?: unported)?(?: licen[cs]e)?", "creativecommons org licenses by sa 3 0", "spdx license identifier cc by sa 3 0", "cc by sa 3 0"],
    "cc-by-sa": ["creative commons attribution share ?alike(?: licen[cs]e)?", "creativecommons org licenses by sa", "cc by sa"],
    "cc-by-nd": ["creative commons attribution no ?deriv(?:ative)?s?(?: \\d 0)?(?: licen[cs]e)?", "creativecommons org licenses by nd", "cc by nd(?: \\d 0)?"],
    "cc-by-nc": ["creative commons attribution non ?commercial(?: \\d 0)?(?: licen[cs]e)?", "creativecommons org licenses by nc", "spdx license identifier cc by nc \\d 0", "cc by nc(?: \\d 0)?"],
    "cc-by-nc-sa": ["creative commons attribution non ?commercial share ?alike(?: \\d 0)?(?: licen[cs]e)?", "creativecommons org licenses by nc sa", "cc by nc sa(?: \\d 0)?"],
    "cc-by-nc-nd": ["creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: \\d 0)?(?: licen[cs]e)?", "creativecommons org licenses by nc nd", "cc by nc nd(?: \\d 0)?"],
    "cc-by": ["creative commons attribution licen[cs]e", "creativecommons org licenses by", "cc by licen[cs]e"],
    "cc": ["(?:under|of) a creative commons licen[cs]e", "creative commons licen[cs]e"],
    "odbl": ["open data commons open database licen[cs]e", "spdx license identifier odbl 1 0", "open database licen[cs]e"],
    "odc-by": ["open data commons attribution licen[cs]e", "spdx license identifier odc by 1 0"],
    "pddl": ["public domain dedication and licen[cs]e", "spdx license identifier pddl 1 0"],
    "public-domain": ["(?:released|placed|dedicated) (?:in|into|to) the public domain", "is in the public domain", "public domain licen[cs]e"],
    "unlicense": ["this is free and unencumbered software released into the public domain", "spdx license identifier unlicense", "(?:under|of) the unlicense", "unlicense org"],
    "wtfpl": ["do what the fuck you want to public licen[cs]e", "spdx license identifier wtfpl", "wtfpl licen[cs]ed?", "wtfpl version 2"],
    "zlib": ["this software is provided as is without any express or implied warranty in no event will the authors be held liable", "spdx license identifier zlib", "zlib libpng licen[cs]e", "zlib licen[cs]ed?"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", "spdx license identifier isc", "internet systems consortium licen[cs]e", "isc licen[cs]ed?"],
    "boost": ["boost software licen[cs]e version 1 0", "spdx license identifier bsl 1 0", "boost org license 1 0", "boost software licen[cs]e", "boost licen[cs]e"],
    "busl": ["business source licen[cs]e 1 1", "spdx license identifier busl 1 1", "business source licen[cs]e"],
    "sspl": ["server side public licen[cs]e(?: version 1)?", "spdx license identifier sspl 1 0", "sspl licen[cs]ed?"],
    "elastic": ["elastic licen[cs]e 2 0", "spdx license identifier elastic 2 0", "elastic licen[cs]e"],
    "artistic-1": ["artistic licen[cs]e 1 0", "spdx license identifier artistic 1 0", "perl artistic licen[cs]e"],
    "artistic-2": ["artistic licen[cs]e 2 0", "spdx license identifier artistic 2 0", "artistic licen[cs]e version 2"],
    "artistic": ["(?:under|of) the artistic licen[cs]e", "artistic licen[cs]e"],
    "ms-pl": ["microsoft public licen[cs]e", "spdx license identifier ms pl"],
    "ms-rl": ["microsoft reciprocal licen[cs]e", "spdx license identifier ms rl"],
    "ofl-1.1": ["sil open font licen[cs]e version 1 1", "spdx license identifier ofl 1 1", "scripts sil org ofl", "open font licen[cs]e version 1 1"],
    "ofl": ["sil open font licen[cs]e", "open font licen[cs]e"],
    "python-2": ["python software foundation licen[cs]e(?: version 2)?", "spdx license identifier psf 2 0", "spdx license identifier python 2 0", "psf licen[cs]e"],
    "php-3": ["php licen[cs]e version 3 0?1?", "spdx license identifier php 3 01?", "php licen[cs]e"],
    "ruby": ["ruby licen[cs]e", "spdx license identifier ruby"],
    "postgresql": ["postgresql licen[cs]e", "spdx license identifier postgresql"],
    "openssl": ["openssl licen[cs]e", "spdx license identifier openssl", "original ssleay licen[cs]e"],
    "ncsa": ["university of illinois ncsa open source licen[cs]e", "spdx license identifier ncsa", "ncsa open source licen[cs]e"],
    "eupl-1.1": ["european union public licen[cs]e v(?:ersion )?1 1", "spdx license identifier eupl 1 1"],
    "eupl-1.2": ["european union public licen[cs]e v(?:ersion )?1 2", "spdx license identifier eupl 1 2"],
    "eupl": ["european union public licen[cs]e", "eupl licen[cs]ed?"],
    "osl-3": ["open software licen[cs]e(?: version)? 3 0", "spdx license identifier osl 3 0"],
    "afl-3": ["academic free licen[cs]e(?: version)? 3 0", "spdx license identifier afl 3 0"],
    "cecill": ["cecill licen[cs]e", "spdx license identifier cecill 2 [01]", "licence cecill"],
    "qpl": ["q public licen[cs]e(?: version 1 0)?", "spdx license identifier qpl 1 0"],
    "upl": ["universal permissive licen[cs]e(?: v 1 0)?", "spdx license identifier upl 1 0"],
    "vim": ["vim licen[cs]e", "spdx license identifier vim"],
    "w3c": ["w3c software notice and licen[cs]e", "spdx license identifier w3c"],
    "json": ["the software shall be used for good not evil", "spdx license identifier json"],
    "beerware": ["beer ?ware licen[cs]e", "spdx license identifier beerware"],
    "mulan": ["mulan permissive software licen[cs]e(?: v2)?", "spdx license identifier mulanpsl 2 0"],
    "openrail": ["responsible ai licen[cs]e", "openrail(?: m)? licen[cs]e", "spdx license identifier openrail"],
    "all-rights-reserved": ["copyright [^ ]+(?: [^ ]+){0,20} all rights reserved", "copyright all rights reserved"],
}

_GROUP = re.compile(r"\((?:[^()]|\([^()]*\))*\)(?:[?*+]|\{[^}]*\})?")


def keyword(pattern: str) -> str:
    """The longest stretch that every match must contain."""
    flat = _GROUP.sub("\0", pattern)
    flat = re.sub(r"\[[^\]]*\][?*+]?|\\[a-z][?*+]?", "\0", flat)
    flat = re.sub(r".[?*]|\{[^}]*\}", "\0", flat)
    return max((x.strip() for x in re.split("[\0+]", flat)), key=len)


def rules() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, pattern) with each word between spaces of its own."""
    out = []
    for label, patterns in SIGNATURES.items():
        for k, p in enumerate(patterns):
            wide = p.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?")
            out.append((label, max(30, 90 - 10 * k), keyword(p).replace(" ", "  "), f" {wide} "))
    return out


#: A text without any of these matches no pattern.
GATES = ("licen", "copyright", "gnu", "apache", "creative", "public", "permi", "redistribution", "cc ", "cc0", "bsd", "gpl", "software", "advertising", "wtfpl", "sil ", "unlicense", "neither", "agpl", "mozilla", "eclipse", "boost")
