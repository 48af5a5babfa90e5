"""Signatures of licences, written by hand over words: digits, letters a-z and what lies beyond ASCII.

A pattern is matched against whole words, so `gpl v3` stands for "GPL-v3", "GPL, V3" and the like. A space
in a pattern stands for any border between two words.
"""

from __future__ import annotations

from typing import NamedTuple

#: What joins a version to a name.
V = r"(?:(?:version|ver|v) )?"
#: Words between a verb and "under", and those after it.
UNDER = r"(?:licen[cs]ed|released|distributed|available|published|covered|governed|provided|shared|offered|dual licen[cs]ed) (?:[0-9a-z]+ ){0,4}?under (?:the )?(?:terms of )?(?:the )?"

#: label, words of which a match has at least one, name, identifier, address. One licence a line; "-" for none.
LICENSES = r"""
mit | mit expat x11 | (?:mit|expat|mit x11|x11) licen[cs]e | (?:mit|x11) | opensource org licenses mit|mit license org
mit-0 | mit | mit no attribution(?: licen[cs]e)? | mit 0 | opensource org licenses mit 0|github com aws mit 0
apache-1 | apache | apache (?:software )?licen[cs]e V1 [01] | apache 1 [01] | apache org licenses license 1 [01]
apache-2 | apache asl asf al | (?:apache|asf) (?:software )?licen[cs]e V2(?: 0)? | (?:apache|asl|al) (?:v )?2(?: 0)? | apache org licenses license 2 0|opensource org licenses apache 2 0
bsd-2 | bsd freebsd simplified | (?:2|two) clause (?:simplified )?bsd(?: licen[cs]e)?|(?:simplified bsd|freebsd) licen[cs]e|bsd (?:2|two) clause(?: licen[cs]e)? | bsd 2 clause | opensource org licenses bsd 2 clause|opensource org license bsd 2 clause
bsd-3 | bsd | (?:3|three) clause (?:revised )?bsd(?: licen[cs]e)?|(?:new|revised|modified) bsd licen[cs]e|bsd (?:3|three) clause(?: licen[cs]e)? | bsd 3 clause(?: clear)? | opensource org licenses bsd 3 clause|opensource org license bsd 3 clause
bsd-4 | bsd | (?:4|four) clause bsd(?: licen[cs]e)?|(?:original|old) bsd licen[cs]e|bsd (?:4|four) clause(?: licen[cs]e)? | bsd 4 clause(?: uc)? | spdx org licenses bsd 4 clause
0bsd | 0bsd zero clause | (?:zero|0) clause bsd(?: licen[cs]e)?|bsd zero clause licen[cs]e | 0bsd | opensource org licenses 0bsd
isc | isc internet | isc licen[cs]e|internet (?:systems|software) consortium licen[cs]e | isc | opensource org licenses isc|isc org licenses
zlib | zlib | (?:zlib|zlib libpng) licen[cs]e | zlib(?: acknowledgement)? | opensource org licenses zlib|zlib net zlib license
libpng | libpng png | (?:libpng|png reference library) licen[cs]e | libpng(?: 2 0)? | libpng org pub png src libpng license
boost | boost bsl | boost software licen[cs]e(?: V1(?: 0)?)? | bsl 1 0 | boost org license 1 0|opensource org licenses bsl 1 0
unlicense | unlicense | (?:the )?unlicense(?: license)? | unlicense | unlicense org
wtfpl | wtfpl fuck | do what the fuck you want to public licen[cs]e|wtfpl(?: licen[cs]e)? | wtfpl | wtfpl net|sam zoy org wtfpl
beerware | beerware beer | beer ?ware licen[cs]e | beerware | people freebsd org phk
public-domain | domain | (?:dedicated|released|placed) (?:in)?to the public domain|in the public domain | licenseref public domain | creativecommons org publicdomain mark 1 0
cc0 | cc0 commons | cc0(?: 1 0)?(?: universal)?(?: licen[cs]e)?|creative commons zero(?: V1(?: 0)?)?(?: universal)? | cc0 1 0 | creativecommons org publicdomain zero 1 0
cc-by | cc commons | (?:cc by|creative commons attribution)(?: licen[cs]e)?(?: V[1-4](?: [05])?)?(?: (?:international|unported|generic))?(?: licen[cs]e)? | cc by [1-4] [05] | creativecommons org licenses by [1-4] [05]
cc-by-sa | cc commons | (?:cc by sa|creative commons attribution share ?alike)(?: V[1-4](?: [05])?)?(?: (?:international|unported|generic))?(?: licen[cs]e)? | cc by sa [1-4] [05] | creativecommons org licenses by sa [1-4] [05]
cc-by-nd | cc commons | (?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)(?: works)?(?: V[1-4](?: [05])?)?(?: (?:international|unported|generic))?(?: licen[cs]e)? | cc by nd [1-4] [05] | creativecommons org licenses by nd [1-4] [05]
cc-by-nc | cc commons | (?:cc by nc|creative commons attribution non ?commercial)(?: V[1-4](?: [05])?)?(?: (?:international|unported|generic))?(?: licen[cs]e)? | cc by nc [1-4] [05] | creativecommons org licenses by nc [1-4] [05]
cc-by-nc-sa | cc commons | (?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: V[1-4](?: [05])?)?(?: (?:international|unported|generic))?(?: licen[cs]e)? | cc by nc sa [1-4] [05] | creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd | cc commons | (?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?)(?: works)?(?: V[1-4](?: [05])?)?(?: (?:international|unported|generic))?(?: licen[cs]e)? | cc by nc nd [1-4] [05] | creativecommons org licenses by nc nd [1-4] [05]
gpl-1 | gpl gplv1 gpl1 general | (?:gnu )?general public licen[cs]e(?: gpl)? V1(?: 0)?|(?:gnu )?gpl ?v?1(?: 0)? | gpl 1 0(?: only| or later)? | gnu org licenses old licenses gpl 1 0
gpl-2 | gpl gplv2 gpl2 general | (?:gnu )?general public licen[cs]e(?: gpl)? V2(?: 0)?|(?:gnu )?gpl ?v?2(?: 0)? | gpl 2 0(?: only| or later)? | gnu org licenses old licenses gpl 2 0|opensource org licenses gpl 2 0
gpl-3 | gpl gplv3 gpl3 general | (?:gnu )?general public licen[cs]e(?: gpl)? V3(?: 0)?|(?:gnu )?gpl ?v?3(?: 0)? | gpl 3 0(?: only| or later)? | gnu org licenses gpl 3 0|opensource org licenses gpl 3 0
gpl | gnu gpl | gnu general public licen[cs]e|gnu gpl|gpl licen[cs]e | gpl | gnu org (?:licenses|copyleft) gpl
lgpl-2 | lgpl lgplv2 lgpl2 library | (?:gnu )?library general public licen[cs]e(?: V2(?: 0)?)?|(?:gnu )?lgpl ?v?2 0 | lgpl 2 0(?: only| or later)? | gnu org licenses old licenses lgpl 2 0
lgpl-2.1 | lgpl lgplv2 lgpl2 lesser | (?:gnu )?lesser general public licen[cs]e(?: lgpl)? V2 1|(?:gnu )?lgpl ?v?2 1 | lgpl 2 1(?: only| or later)? | gnu org licenses old licenses lgpl 2 1|opensource org licenses lgpl 2 1
lgpl-3 | lgpl lgplv3 lgpl3 lesser | (?:gnu )?lesser general public licen[cs]e(?: lgpl)? V3(?: 0)?|(?:gnu )?lgpl ?v?3(?: 0)? | lgpl 3 0(?: only| or later)? | gnu org licenses lgpl 3 0|opensource org licenses lgpl 3 0
lgpl | lgpl lesser | gnu lesser general public licen[cs]e|gnu lgpl|lgpl licen[cs]e | lgpl | gnu org (?:licenses|copyleft) l(?:gpl|esser)
agpl-3 | agpl agplv3 agpl3 affero | (?:gnu )?affero general public licen[cs]e(?: agpl)?(?: V3(?: 0)?)?|(?:gnu )?agpl ?v?3(?: 0)? | agpl 3 0(?: only| or later)? | gnu org licenses agpl 3 0|opensource org licenses agpl 3 0
gfdl | gfdl fdl documentation | (?:gnu )?free documentation licen[cs]e(?: V1(?: [123])?)?|gnu fdl | gfdl 1 [123](?: only| or later)? | gnu org (?:licenses|copyleft) fdl
mpl-1 | mpl mozilla | mozilla public licen[cs]e V1 [01] | mpl 1 [01] | mozilla org mpl mpl 1 [01]|opensource org licenses mpl 1 [01]
mpl-2 | mpl mozilla | mozilla public licen[cs]e V2(?: 0)? | mpl 2 0(?: no copyleft exception)? | mozilla org mpl 2 0|opensource org licenses mpl 2 0
epl-1 | epl eclipse | eclipse public licen[cs]e V1(?: 0)? | epl 1 0 | eclipse org legal epl v10|opensource org licenses eclipse 1 0
epl-2 | epl eclipse | eclipse public licen[cs]e V2(?: 0)? | epl 2 0 | eclipse org legal epl (?:2 0|v20)|opensource org licenses epl 2 0
edl-1 | edl eclipse | eclipse distribution licen[cs]e(?: V1(?: 0)?)? | edl 1 0 | eclipse org org documents edl v10
cddl-1 | cddl common | common development and distribution licen[cs]e(?: cddl)?(?: V1(?: [01])?)? | cddl 1 [01] | opensource org licenses cddl 1(?: 0)?|sun com cddl
cpl-1 | cpl common | common public licen[cs]e(?: V1(?: 0)?)? | cpl 1 0 | opensource org licenses cpl 1 0|ibm com developerworks library os cpl
cpal-1 | cpal common | common public attribution licen[cs]e(?: V1(?: 0)?)? | cpal 1 0 | opensource org licenses cpal 1 0
ibm-pl | ipl ibm | ibm public licen[cs]e(?: V1(?: 0)?)? | ipl 1 0 | opensource org licenses ibmpl
eupl | eupl european | european union public licen[cs]e(?: V1(?: [0-2])?)? | eupl 1 [0-2] | joinup ec europa eu software page eupl|eupl eu 1 [0-2]
cecill | cecill | cecill(?: [bc])?(?: free software)? licen[cs]e(?: agreement)?|licence cecill(?: [bc])? | cecill(?: [bc]| [12] [01])? | cecill info licences
artistic-1 | artistic | (?:clarified )?artistic licen[cs]e V1(?: 0)? | artistic 1 0(?: perl| cl8)? | opensource org licenses artistic license 1 0
artistic-2 | artistic | artistic licen[cs]e V2(?: 0)? | artistic 2 0 | opensource org licenses artistic license 2 0|perlfoundation org artistic license 2 0
perl | perl | same terms as perl(?: itself)? | licenseref perl | dev perl org licenses
php-3 | php | php licen[cs]e(?: V3(?: 0[01]?)?)? | php 3 0[01]? | php net license 3 0[01]?
python-2 | python psf | python software foundation licen[cs]e(?: V2(?: 0)?)?|psf licen[cs]e | (?:python|psf) 2 0 | docs python org 3 license|opensource org licenses python 2 0
ruby | ruby | ruby licen[cs]e|same (?:terms|licen[cs]e) as ruby | ruby | ruby lang org en license
ofl | ofl sil font | sil open font licen[cs]e(?: V1(?: [01])?)?|open font licen[cs]e V1 [01] | ofl 1 [01] | scripts sil org ofl|openfontlicense org
ncsa | ncsa illinois | university of illinois(?: ncsa)? open source licen[cs]e|ncsa open source licen[cs]e | ncsa | opensource org licenses (?:uoi )?ncsa
osl-3 | osl software | open software licen[cs]e(?: V[123](?: [01])?)? | osl [123] [01] | opensource org licenses osl 3 0
afl-3 | afl academic | academic free licen[cs]e(?: V[123](?: [01])?)? | afl [123] [01] | opensource org licenses afl 3 0
ecl-2 | ecl educational | educational community licen[cs]e(?: V[12](?: 0)?)? | ecl [12] 0 | opensource org licenses ecl 2 0
ms-pl | ms microsoft | microsoft public licen[cs]e|ms pl licen[cs]e | ms pl | opensource org licenses ms pl
ms-rl | ms microsoft | microsoft reciprocal licen[cs]e|ms rl licen[cs]e | ms rl | opensource org licenses ms rl
apsl-2 | apsl apple | apple public source licen[cs]e(?: V[12](?: [0-2])?)? | apsl [12] [0-2] | opensource org licenses apsl 2 0|opensource apple com apsl
openssl | openssl | openssl licen[cs]e|dual openssl ssleay licen[cs]e | openssl | openssl org source license
curl | curl | curl licen[cs]e | curl | curl se docs copyright|curl haxx se docs copyright
ijg | ijg jpeg | independent jpeg group(?: s)? licen[cs]e | ijg | ijg org files readme
w3c | w3c | w3c (?:software(?: notice)?(?: and)?(?: document)?) licen[cs]e | w3c(?: 20150513)? | w3 org consortium legal
unicode | unicode | unicode licen[cs]e(?: agreement)?(?: V3)? | unicode (?:3 0|dfs 201[56]|tou) | unicode org (?:copyright|license)
icu | icu | icu licen[cs]e | icu | source icu project org repos icu license
postgresql | postgresql | postgresql licen[cs]e | postgresql | opensource org licenses postgresql|postgresql org about licence
sleepycat | sleepycat | sleepycat(?: public)? licen[cs]e | sleepycat | opensource org licenses sleepycat
qpl | qpl q | q public licen[cs]e(?: V1(?: 0)?)? | qpl 1 0 | opensource org licenses qpl 1 0
upl | upl universal | universal permissive licen[cs]e(?: V1(?: 0)?)? | upl 1 0 | oss oracle com licenses upl|opensource org licenses upl
vim | vim | vim licen[cs]e | vim | vimdoc sourceforge net htmldoc uganda
tcl | tcl | tcl tk licen[cs]e|tcl licen[cs]e | tcl | tcl tk software tcltk license
zpl | zope zpl | zope public licen[cs]e(?: V[12](?: [01])?)? | zpl [12] [01] | opensource org licenses zpl 2 0
lppl | lppl latex | latex project public licen[cs]e(?: V1(?: [0-3])?)? | lppl 1 [0-3][ac]? | latex project org lppl
odbl | odbl database | open (?:data commons open )?database licen[cs]e(?: V1(?: 0)?)?|odbl licen[cs]e | odbl 1 0 | opendatacommons org licenses odbl
odc-by | odc commons | open data commons attribution licen[cs]e(?: V1(?: 0)?)? | odc by 1 0 | opendatacommons org licenses by
pddl | pddl dedication | (?:open data commons )?public domain dedication and licen[cs]e | pddl 1 0 | opendatacommons org licenses pddl
ogl-uk | ogl government | open government licen[cs]e(?: V[123](?: 0)?)? | ogl uk [123] 0 | nationalarchives gov uk doc open government licence
etalab | etalab ouverte | licence ouverte(?: etalab)?(?: V[12](?: 0)?)?|etalab open licen[cs]e | etalab 2 0 | etalab gouv fr licence ouverte
dl-de | datenlizenz dl | datenlizenz deutschland(?: (?:namensnennung|zero))?(?: V[12](?: 0)?)? | dl de by 2 0 | govdata de dl de
sspl-1 | sspl server | server side public licen[cs]e(?: sspl)?(?: V1(?: 0)?)? | sspl 1 0 | mongodb com licensing server side public license
busl-1.1 | busl bsl business | business source licen[cs]e(?: V1 1)? | busl 1 1 | mariadb com bsl11
elastic-2 | elastic | elastic licen[cs]e(?: V2(?: 0)?)? | elastic 2 0 | elastic co licensing elastic license
polyform | polyform | polyform (?:noncommercial|shield|strict|small business|perimeter|internal use) licen[cs]e(?: V1(?: 0){0,2})? | polyform (?:noncommercial|small business) 1 0 0 | polyformproject org licenses
commons-clause | commons | commons clause(?: licen[cs]e condition)?(?: V1(?: 0)?)? | licenseref commons clause | commonsclause com
openrail-m | openrail rail responsible | (?:creativeml |bigscience |bigcode )?open ?rail(?: m)?(?: licen[cs]e)?|responsible ai licen[cs]e | licenseref openrail | licenses ai
mulan-2 | mulan mulanpsl | mulan permissive software licen[cs]e(?: V[12](?: 0)?)? | mulanpsl [12] 0 | license coscl org cn mulanpsl2
"""

#: label, words a match has all of, pattern: sentences that only one licence (or one kind) has.
SENTENCES = r"""
mit | permission hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | above copyright notice portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit | warranty kind | the software is provided as is without warranty of any kind express or implied including but not limited to
isc | permission purpose hereby | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd | permission purpose granted | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
bsd-2 | redistributions binary copyright | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
bsd-3 | endorse promote contributors | neither the name of (?:[0-9a-z]+ ){1,8}nor the names of its contributors may be used to endorse or promote products
bsd-4 | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
apache-2 | compliance license | you may not use this (?:file|work|software) except in compliance with the license
apache-2 | obtain copy license apache | you may obtain a copy of the license at (?:https? )?(?:www )?apache org licenses license 2 0
apache-2 | limitations under license | see the license for the specific language governing permissions and limitations under the license
apache-2 | terms conditions reproduction | terms and conditions for use reproduction and distribution
gpl | redistribute modify general license | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
gpl-2 | either version later license | either version 2 of the license or at your option any later version
gpl-3 | either version later license | either version 3 of the license or at your option any later version
gpl | received copy general license | you should have received a copy of the gnu general public license along with
gpl | hope useful warranty | this program is distributed in the hope that it will be useful but without any warranty
lgpl | redistribute modify lesser license | you can redistribute it and or modify it under the terms of the gnu lesser general public license
lgpl | received copy lesser license | you should have received a copy of the gnu lesser general public license along with
agpl-3 | redistribute modify affero license | you can redistribute it and or modify it under the terms of the gnu affero general public license
agpl-3 | network interaction license | remote network interaction use with the gnu general public license
gfdl | permission copy documentation license | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2 | subject terms mozilla license | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1 | contents subject mozilla license | the contents of this file are subject to the mozilla public license version 1 [01]
epl-2 | accompanying materials eclipse license | this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
epl-1 | accompanying materials eclipse license | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
cddl-1 | contents subject common license | the contents of this file are subject to the terms of the common development and distribution license
zlib | altered misrepresented | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
boost | permission granted organization | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
unlicense | unencumbered public domain | this is free and unencumbered software released into the public domain
wtfpl | copy distribute verbatim license | everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed
beerware | retain notice stuff | as long as you retain this notice you can do whatever you want with this stuff
cc0 | waived copyright neighboring | to the extent possible under law (?:[0-9a-z]+ ){1,12}(?:has|have) waived all copyright and related or neighboring rights
cc-by | commons attribution license | this work is licensed under a creative commons attribution (?:[1-4] [05] )?(?:(?:international|unported|generic) )?license
cc-by-sa | commons sharealike licensed | this work is licensed under (?:a|the) creative commons attribution sharealike
cc-by-nc | commons noncommercial licensed | this work is licensed under (?:a|the) creative commons attribution noncommercial
cc-by-nd | commons noderivatives licensed | this work is licensed under (?:a|the) creative commons attribution noderivatives
ofl | sil font license | this font software is licensed under the sil open font license
artistic-2 | package license | this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
perl | perl software redistribute | this (?:library|program|module|software) is free software you (?:can|may) redistribute it and or modify it under the same terms as perl
openssl | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
ijg | jpeg independent | this software is based in part on the work of the independent jpeg group
postgresql | california liable | in no event shall the university of california be liable to any party
all-rights-reserved | rights reserved | all rights reserved
all-rights-reserved | tous droits | tous droits r[^ ]*serv[^ ]*s
all-rights-reserved | rechte vorbehalten | alle rechte vorbehalten
all-rights-reserved | derechos reservados | todos los derechos reservados
proprietary | proprietary confidential | (?:confidential and proprietary|proprietary and confidential)
proprietary | unauthorized copying | unauthorized copying of this (?:file|software|material) (?:via any medium )?is strictly prohibited
non-commercial | noncommercial | noncommercial (?:use|purposes) only
non-commercial | commercial | non commercial (?:use|purposes) only
research-only | research | for research (?:use|purposes) only
no-redistribution | redistribution | redistribution is (?:not|strictly) (?:permitted|prohibited|allowed)
copyright-notice | copyright | copyright (?:[^ ] )?(?:19|20)[0-9][0-9]
"""

#: Fixed phrases and their labels; every place counts.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Kinds in order of priority, and how sure a match of each makes its label.
KINDS = {"base": 1.0, "sentence": 1.0, "notice": 0.95, "tag": 0.95, "address": 0.9, "field": 0.8, "name": 0.7}


class Rule(NamedTuple):
    """A signature: lower numbers go first; of each group in `gates` a text with a match has at least one word."""

    number: int
    label: str
    kind: str
    confidence: float
    gates: list[list[str]]
    pattern: str


def spaced(pattern: str) -> str:
    """A pattern over words that stand between spaces of their own, two at each border."""
    return " (?:" + "(?:  )?".join(part.replace(" ", "  ") for part in pattern.split(" ?")) + ") "


def rows_of(table: str) -> list[list[str]]:
    return [[cell.strip(" ") for cell in line.split(" | ")] for line in table.strip().splitlines()]


def first_words(pattern: str) -> list[str]:
    """The first words of the alternatives of a pattern, groups not counted."""
    depth, out, start = 0, [], True
    for c in pattern:
        if start:
            out.append("")
        start = c == "|" and not depth
        depth += (c == "(") - (c == ")")
        if not start:
            out[-1] += c
    return sorted({part.split(" ")[0] for part in out})


def all_rules() -> list[Rule]:
    """The rules in order: by kind, and within a kind as they are listed."""
    found: list[tuple[str, str, list[list[str]], str]] = []
    for phrase, label in BASE.items():
        rare = [w for w in phrase.split() if len(w) > 2 and w not in ("the", "under", "version")]
        found.append((label, "base", [[w] for w in rare or ["nc"]], phrase))
    for label, words, pattern in rows_of(SENTENCES):
        found.append((label, "sentence", [[w] for w in words.split()], pattern))
    for label, words, name, own, address in rows_of(LICENSES):
        any_of = words.split()
        name = f"(?:{name.replace('V', V)})"
        found.append((label, "notice", [any_of, ["under"]], UNDER + name))
        found.append((label, "tag", [["spdx"]], f"spdx license identifier (?:{own})"))
        found.append((label, "field", [any_of, ["license", "licence"]], f"licen[cs]e (?:is )?(?:{own})"))
        found.append((label, "address", [first_words(address)], f"(?:https? )?(?:www )?(?:{address})"))
        found.append((label, "name", [any_of], name))
    order = list(KINDS)
    found.sort(key=lambda rule: order.index(rule[1]))
    return [
        Rule(number, label, kind, KINDS[kind], gates, spaced(pattern))
        for number, (label, kind, gates, pattern) in enumerate(found)
    ]
