"""Signature rules of the license scan (operator 12).

A rule is a regular expression over a text's words (lower case, one space
between words), with the words a text must hold for it to be tried, a label, a
priority (1 is strongest) and a weight. The licenses below are written by
hand; their rules follow from the forms in which a license is named: an
identifier tag, a notice, an address, its name, a family's name alone.
Expressions keep to what both Java and RE2 understand.
"""
from __future__ import annotations

from dataclasses import dataclass

#: License, words of its identifier, names (a word each holds, the name), address.
LICENSES = [
    ("mit", "mit", [("mit", "(?:the )?mit(?: x11| expat)? licen[cs]e"), ("expat", "expat licen[cs]e")], "opensource org licenses mit"),
    ("mit-0", "mit 0", [("mit", "mit (?:no attribution|0)(?: licen[cs]e)?")], "opensource org licenses mit 0"),
    ("x11", "x11", [("x11", "x11 licen[cs]e")], "spdx org licenses x11"),
    ("isc", "isc", [("isc", "isc licen[cs]e")], "opensource org licenses isc"),
    ("apache-1.0", "apache 1 0", [("apache", "apache(?: software)? licen[cs]e (?:version |v )?v?1 0")], "apache org licenses license 1 0"),
    ("apache-1.1", "apache 1 1", [("apache", "apache(?: software)? licen[cs]e (?:version |v )?v?1 1")], "apache org licenses license 1 1"),
    ("apache-2.0", "apache 2 0", [("apache", "apache(?: software)?(?: licen[cs]e)? (?:version |v )?v?2(?: 0)?"), ("asl", "asl 2 0")], "apache org licenses license 2 0"),
    ("bsd-1-clause", "bsd 1 clause", [("bsd", "(?:1|one) clause bsd(?: licen[cs]e)?"), ("bsd", "bsd 1 clause(?: licen[cs]e)?")], "spdx org licenses bsd 1 clause"),
    ("bsd-2-clause", "bsd 2 clause", [("bsd", "(?:(?:2|two) clause|simplified|freebsd) bsd(?: licen[cs]e)?"), ("bsd", "bsd 2 clause(?: licen[cs]e)?")], "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "bsd 3 clause", [("bsd", "(?:(?:3|three) clause|new|revised|modified) bsd(?: licen[cs]e)?"), ("bsd", "bsd 3 clause(?: licen[cs]e)?")], "opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", "bsd 4 clause", [("bsd", "(?:(?:4|four) clause|original|old) bsd(?: licen[cs]e)?"), ("bsd", "bsd 4 clause(?: licen[cs]e)?")], "spdx org licenses bsd 4 clause"),
    ("0bsd", "0bsd", [("bsd", "(?:zero clause|free public) bsd(?: licen[cs]e)?"), ("0bsd", "0bsd(?: licen[cs]e)?")], "opensource org licenses 0bsd"),
    ("gpl-1.0", "gpl 1 0", [("general", "(?:gnu )?general public licen[cs]e (?:version |v )?v?1(?: 0)?"), ("gpl", "(?:gnu )?gpl (?:version )?v?1(?: 0)?"), ("gplv1", "gplv1")], "gnu org licenses gpl 1 0"),
    ("gpl-2.0", "gpl 2 0", [("general", "(?:gnu )?general public licen[cs]e (?:version |v )?v?2(?: 0)?"), ("gpl", "(?:gnu )?gpl (?:version )?v?2(?: 0)?"), ("gplv2", "(?:gnu )?gplv2"), ("gpl2", "gpl2")], "gnu org licenses gpl 2 0"),
    ("gpl-3.0", "gpl 3 0", [("general", "(?:gnu )?general public licen[cs]e (?:version |v )?v?3(?: 0)?"), ("gpl", "(?:gnu )?gpl (?:version )?v?3(?: 0)?"), ("gplv3", "(?:gnu )?gplv3"), ("gpl3", "gpl3")], "gnu org licenses gpl 3 0"),
    ("lgpl-2.0", "lgpl 2 0", [("library", "(?:gnu )?library general public licen[cs]e (?:version |v )?v?2(?: 0)?"), ("lgpl", "(?:gnu )?lgpl (?:version )?v?2(?: 0)?")], "gnu org licenses lgpl 2 0"),
    ("lgpl-2.1", "lgpl 2 1", [("lesser", "(?:gnu )?lesser general public licen[cs]e (?:version |v )?v?2 1"), ("lgpl", "(?:gnu )?lgpl (?:version )?v?2 1"), ("lgplv2", "lgplv2 1")], "gnu org licenses lgpl 2 1"),
    ("lgpl-3.0", "lgpl 3 0", [("lesser", "(?:gnu )?lesser general public licen[cs]e (?:version |v )?v?3(?: 0)?"), ("lgpl", "(?:gnu )?lgpl (?:version )?v?3(?: 0)?"), ("lgplv3", "lgplv3")], "gnu org licenses lgpl 3 0"),
    ("agpl-3.0", "agpl 3 0", [("affero", "(?:gnu )?affero general public licen[cs]e (?:version |v )?v?3(?: 0)?"), ("agpl", "(?:gnu )?agpl (?:version )?v?3(?: 0)?"), ("agplv3", "agplv3")], "gnu org licenses agpl 3 0"),
    ("gfdl-1.1", "gfdl 1 1", [("documentation", "(?:gnu )?free documentation licen[cs]e (?:version |v )?1 1"), ("gfdl", "(?:gnu )?gfdl 1 1")], "gnu org licenses fdl 1 1"),
    ("gfdl-1.2", "gfdl 1 2", [("documentation", "(?:gnu )?free documentation licen[cs]e (?:version |v )?1 2"), ("gfdl", "(?:gnu )?gfdl 1 2")], "gnu org licenses fdl 1 2"),
    ("gfdl-1.3", "gfdl 1 3", [("documentation", "(?:gnu )?free documentation licen[cs]e (?:version |v )?1 3"), ("gfdl", "(?:gnu )?gfdl 1 3")], "gnu org licenses fdl 1 3"),
    ("mpl-1.0", "mpl 1 0", [("mozilla", "mozilla public licen[cs]e (?:version |v )?v?1 0"), ("mpl", "mpl (?:version )?v?1 0")], "mozilla org mpl 1 0"),
    ("mpl-1.1", "mpl 1 1", [("mozilla", "mozilla public licen[cs]e (?:version |v )?v?1 1"), ("mpl", "mpl (?:version )?v?1 1")], "mozilla org mpl 1 1"),
    ("mpl-2.0", "mpl 2 0", [("mozilla", "mozilla public licen[cs]e (?:version |v )?v?2(?: 0)?"), ("mpl", "mpl (?:version )?v?2(?: 0)?")], "mozilla org mpl 2 0"),
    ("epl-1.0", "epl 1 0", [("eclipse", "eclipse public licen[cs]e (?:version |v )?v?1(?: 0)?"), ("epl", "epl (?:version )?v?1(?: 0)?")], "eclipse org legal epl v10"),
    ("epl-2.0", "epl 2 0", [("eclipse", "eclipse public licen[cs]e (?:version |v )?v?2(?: 0)?"), ("epl", "epl (?:version )?v?2(?: 0)?")], "eclipse org legal epl 2 0"),
    ("eupl-1.1", "eupl 1 1", [("european", "european union public licen[cs]e (?:version |v )?v?1 1"), ("eupl", "eupl (?:version )?v?1 1")], "joinup ec europa eu eupl 1 1"),
    ("eupl-1.2", "eupl 1 2", [("european", "european union public licen[cs]e (?:version |v )?v?1 2"), ("eupl", "eupl (?:version )?v?1 2")], "joinup ec europa eu eupl 1 2"),
    ("cddl-1.0", "cddl 1 0", [("distribution", "common development and distribution licen[cs]e (?:version |v )?v?1 0"), ("cddl", "cddl (?:version )?v?1 0")], "opensource org licenses cddl 1 0"),
    ("cddl-1.1", "cddl 1 1", [("distribution", "common development and distribution licen[cs]e (?:version |v )?v?1 1"), ("cddl", "cddl (?:version )?v?1 1")], "spdx org licenses cddl 1 1"),
    ("cpl-1.0", "cpl 1 0", [("common", "common public licen[cs]e (?:version |v )?v?1 0"), ("cpl", "cpl (?:version )?v?1 0")], "opensource org licenses cpl 1 0"),
    ("artistic-1.0", "artistic 1 0", [("artistic", "artistic licen[cs]e (?:version |v )?v?1(?: 0)?")], "opensource org licenses artistic 1 0"),
    ("artistic-2.0", "artistic 2 0", [("artistic", "artistic licen[cs]e (?:version |v )?v?2(?: 0)?")], "opensource org licenses artistic 2 0"),
    ("bsl-1.0", "bsl 1 0", [("boost", "boost software licen[cs]e(?: (?:version |v )?v?1(?: 0)?)?"), ("bsl", "bsl 1 0")], "boost org license 1 0"),
    ("busl-1.1", "busl 1 1", [("business", "business source licen[cs]e(?: (?:version |v )?v?1 1)?"), ("busl", "busl 1 1")], "mariadb com bsl11"),
    ("zlib", "zlib", [("zlib", "zlib(?: libpng)? licen[cs]e")], "opensource org licenses zlib"),
    ("libpng", "libpng", [("libpng", "libpng licen[cs]e")], "libpng org pub png src libpng license"),
    ("unlicense", "unlicense", [("unlicense", "(?:the )?unlicense")], "unlicense org"),
    ("wtfpl", "wtfpl", [("wtfpl", "wtfpl(?: v?2)?"), ("fuck", "do what the fuck you want to public licen[cs]e")], "wtfpl net"),
    ("beerware", "beerware", [("beerware", "beerware licen[cs]e"), ("beer", "beer ware licen[cs]e")], "spdx org licenses beerware"),
    ("osl-3.0", "osl 3 0", [("open", "open software licen[cs]e (?:version |v )?v?3(?: 0)?"), ("osl", "osl 3 0")], "opensource org licenses osl 3 0"),
    ("afl-3.0", "afl 3 0", [("academic", "academic free licen[cs]e (?:version |v )?v?3(?: 0)?"), ("afl", "afl 3 0")], "opensource org licenses afl 3 0"),
    ("ms-pl", "ms pl", [("microsoft", "microsoft public licen[cs]e"), ("ms", "ms pl")], "opensource org licenses ms pl"),
    ("ms-rl", "ms rl", [("microsoft", "microsoft reciprocal licen[cs]e"), ("ms", "ms rl")], "opensource org licenses ms rl"),
    ("python-2.0", "python 2 0", [("python", "python(?: software foundation)? licen[cs]e(?: (?:version |v )?v?2(?: 0)?)?"), ("psf", "psf licen[cs]e")], "docs python org license"),
    ("ruby", "ruby", [("ruby", "ruby(?: s)? licen[cs]e")], "ruby lang org license"),
    ("php-3.01", "php 3 01", [("php", "php licen[cs]e (?:version |v )?v?3 01")], "php net license 3 01"),
    ("ofl-1.1", "ofl 1 1", [("font", "(?:sil )?open font licen[cs]e(?: (?:version |v )?v?1 1)?"), ("ofl", "(?:sil )?ofl(?: (?:version |v )?v?1 1)?")], "scripts sil org ofl"),
    ("odbl-1.0", "odbl 1 0", [("database", "open (?:data commons open )?database licen[cs]e"), ("odbl", "odbl(?: (?:v|version )?1 0)?")], "opendatacommons org licenses odbl"),
    ("odc-by-1.0", "odc by 1 0", [("commons", "open data commons attribution licen[cs]e"), ("odc", "odc by(?: 1 0)?")], "opendatacommons org licenses by"),
    ("pddl-1.0", "pddl 1 0", [("dedication", "public domain dedication and licen[cs]e"), ("pddl", "pddl(?: 1 0)?")], "opendatacommons org licenses pddl"),
    ("ncsa", "ncsa", [("ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[cs]e")], "opensource org licenses ncsa"),
    ("postgresql", "postgresql", [("postgresql", "postgresql licen[cs]e")], "opensource org licenses postgresql"),
    ("openssl", "openssl", [("openssl", "openssl(?: ssleay)? licen[cs]e")], "openssl org source license"),
    ("curl", "curl", [("curl", "curl licen[cs]e")], "curl se docs copyright"),
    ("vim", "vim", [("vim", "vim licen[cs]e")], "spdx org licenses vim"),
    ("upl-1.0", "upl 1 0", [("universal", "universal permissive licen[cs]e(?: (?:version |v )?v?1 0)?"), ("upl", "upl 1 0")], "opensource org licenses upl"),
    ("sspl-1.0", "sspl 1 0", [("server", "server side public licen[cs]e(?: (?:version |v )?v?1(?: 0)?)?"), ("sspl", "sspl(?: 1 0)?")], "mongodb com licensing server side public license"),
    ("elastic-2.0", "elastic 2 0", [("elastic", "elastic licen[cs]e (?:version |v )?v?2(?: 0)?"), ("elv2", "elv2")], "elastic co licensing elastic license"),
    ("cecill-2.1", "cecill 2 1", [("cecill", "cecill(?: free software)?(?: licen[cs]e)?(?: agreement)? (?:version |v )?v?2 1")], "cecill info licences licence cecill v2 1"),
    ("mulanpsl-2.0", "mulanpsl 2 0", [("mulan", "mulan permissive software licen[cs]e(?: (?:version |v )?v?2)?"), ("mulanpsl", "mulanpsl 2 0")], "license coscl org cn mulanpsl2"),
    ("json", "json", [("json", "json licen[cs]e")], "json org license"),
    ("unicode", "unicode 3 0", [("unicode", "unicode licen[cs]e(?: agreement)?")], "unicode org license"),
    ("w3c", "w3c", [("w3c", "w3c software(?: notice and)? licen[cs]e")], "w3 org consortium legal copyright software"),
    ("hpnd", "hpnd", [("historical", "historical permission notice and disclaimer")], "opensource org licenses hpnd"),
    ("llama-2", "llama 2", [("llama", "llama 2 community licen[cs]e(?: agreement)?")], "ai meta com llama license"),
    ("openrail-m", "openrail m", [("openrail", "(?:bigscience |creativeml )?openrail(?: m)?(?: licen[cs]e)?")], "huggingface co spaces bigscience license"),
    ("cc0-1.0", "cc0 1 0", [("cc0", "cc0(?: (?:v|version )?1 0)?(?: universal)?"), ("creative", "creative commons (?:zero|cc0)(?: v?1 0)?(?: universal)?")], "creativecommons org publicdomain zero 1 0"),
]

#: Parts of a Creative Commons license and their names; the combinations and versions that exist.
CC_PARTS = {"by": "attribution", "nc": "(?:noncommercial|non commercial)", "nd": "(?:noderivatives|noderivs|no derivatives|no derivs)", "sa": "(?:sharealike|share alike)"}
CC_KINDS = ["by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"]
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]

#: Families named without a version (label, a word of it, name).
FAMILIES = [
    ("apache", "apache", "apache(?: software)? licen[cs]e"), ("bsd", "bsd", "bsd(?: style)? licen[cs]e"), ("gpl", "general", "(?:gnu )?general public licen[cs]e"),
    ("gpl", "gpl", "(?:gnu )?gpl"), ("lgpl", "lesser", "(?:gnu )?lesser general public licen[cs]e"), ("lgpl", "lgpl", "(?:gnu )?lgpl"),
    ("agpl", "affero", "(?:gnu )?affero general public licen[cs]e"), ("agpl", "agpl", "(?:gnu )?agpl"), ("gfdl", "documentation", "(?:gnu )?free documentation licen[cs]e"),
    ("mpl", "mozilla", "mozilla public licen[cs]e"), ("epl", "eclipse", "eclipse public licen[cs]e"), ("eupl", "european", "european union public licen[cs]e"),
    ("artistic", "artistic", "artistic licen[cs]e"), ("cc", "creative", "creative commons(?: licen[cs]e)?"), ("public-domain", "domain", "(?:in|into|to) the public domain"),
    ("proprietary", "rights", "all rights reserved"), ("proprietary", "proprietary", "proprietary (?:and confidential|licen[cs]e|software)"),
    ("proprietary", "confidential", "strictly confidential"), ("proprietary", "tous", "tous droits réservés"), ("proprietary", "vorbehalten", "alle rechte vorbehalten"),
    ("proprietary", "reservados", "todos los derechos reservados"),
]

#: Sentences that stand in a license's own text (label, words they hold, sentence).
SENTENCES = [
    ("mit", ["permission", "granted"], "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", ["sublicense"], "to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("isc", ["permission", "fee"], "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("apache-2.0", ["apache", "compliance"], "you may not use this file except in compliance with the license"),
    ("apache-2.0", ["conditions", "warranties"], "distributed on an as is basis without warranties or conditions of any kind"),
    ("bsd", ["redistribution"], "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", ["endorse"], "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", ["advertising"], "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("gpl", ["redistribute", "general"], "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-3.0", ["convey"], "each time you convey a covered work the recipient automatically receives a license"),
    ("lgpl", ["redistribute", "lesser"], "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", ["redistribute", "affero"], "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("mpl-2.0", ["mozilla", "form"], "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("zlib", ["misrepresented"], "the origin of this software must not be misrepresented"),
    ("unlicense", ["unencumbered"], "this is free and unencumbered software released into the public domain"),
    ("wtfpl", ["fuck"], "you just do what the fuck you want to"),
    ("bsl-1.0", ["boost"], "distributed under the boost software license version 1 0"),
    ("ofl-1.1", ["font"], "this font software is licensed under the sil open font license"),
    ("cc0-1.0", ["cc0", "waived"], "has waived all copyright and related or neighboring rights"),
    ("epl-2.0", ["eclipse", "accompanying"], "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
]

LEAD = "(?:licensed|released|distributed|redistributed|published|provided|available|covered|offered|shared|governed|issued|lizenziert|veröffentlicht|publié|distribué|publicado|distribuido)"
UNDER = LEAD + " (?:[^ ]+ ){0,5}?(?:under|by|with|unter|sous|bajo) (?:[^ ]+ ){0,6}?"
LATER = "(?: only| or (?:any )?later(?: version)?)?"
TAG, NOTICE, ADDRESS, NAME, FAMILY = range(1, 6)
WEIGHTS = {TAG: 1.0, NOTICE: 0.95, ADDRESS: 0.9, NAME: 0.8, FAMILY: 0.6}
LEVELS = len(WEIGHTS)


@dataclass(frozen=True)
class Rule:
    label: str
    needs: tuple[str, ...]  # words without which the expression can't match
    expression: str
    priority: int

    @property
    def weight(self) -> float:
        return WEIGHTS[self.priority]


def _creative_commons() -> list[tuple]:
    out = []
    for kind in CC_KINDS:
        long = " ".join(CC_PARTS[p] for p in kind.split("-"))
        short = kind.replace("-", " ")
        for v in CC_VERSIONS:
            dots = v.replace(".", " ")
            out.append((f"cc-{kind}-{v}", f"cc {short} {dots}", [("cc", f"cc {short} v?{dots}"), ("creative", f"creative commons {long}(?: licen[cs]e)? (?:version |v )?{dots}(?: international| unported| generic)?")],
                        f"creativecommons org licenses {short} {dots}"))
    return out


def rules() -> list[Rule]:
    """All rules in order; the order is their number."""
    out = []
    for label, tag, names, address in LICENSES + _creative_commons():
        out.append(Rule(label, ("spdx", tag.split(" ")[0]), f"spdx licen[cs]e identifier {tag}{LATER}", TAG))
        out.extend(Rule(label, (word,), UNDER + name + LATER, NOTICE) for word, name in names)
        words = [w for w in address.split(" ") if len(w) > 2 and w not in ("org", "com")]
        out.append(Rule(label, (words[-1], words[0]), address, ADDRESS))
        out.extend(Rule(label, (word,), name + LATER, NAME) for word, name in names)
    out.extend(Rule(label, tuple(needs), sentence, TAG) for label, needs, sentence in SENTENCES)
    for label, word, name in FAMILIES:
        out.append(Rule(label, (word,), name, FAMILY))
    return out
