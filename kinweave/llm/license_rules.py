"""The signature rules of the license scan, one a line: label | kind | keyword | regex.

Regexes are held against a text's words in lower case with one space between
them, and match from the start of a word to the end of one. Every match holds
its keyword, so a text without the keyword need not be searched. LIC stands for
both spellings of license, VER for optional words before a number (version 2, v2). Kinds go
from the strongest: notice (sentences of a license), tag, link, version (a name
with its version), name, and hint (words that only speak of some license).
Rules for tags are put together from the identifiers in TAGS; a group in a rule
is the part that counts as detected.
"""

from __future__ import annotations

#: Kinds in order of priority, with the confidence of a detection.
KINDS = {"notice": 1.0, "tag": 0.98, "link": 0.95, "version": 0.9, "name": 0.7, "hint": 0.3}

# The phrases that always count, with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

HAND_WRITTEN = """
mit|notice|free of charge|permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)?
mit|notice|copies or substantial portions|the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit|notice|copyright holders be liable|in no event shall the authors or copyright holders be liable for any claim damages or other liability
mit|notice|deal in the software|to deal in the software without restriction including without limitation the rights
mit|name|mit|mit LIC
mit|name|mit|(?:released|licensed|distributed|available|published) under (?:the )?mit(?: terms| LIC)?
mit|name|mit|mit (?:style|expat|x11) LIC
mit|link|opensource org|opensource org licenses mit(?: LIC)?(?: php| html)?
mit|link|choosealicense com|choosealicense com licenses mit
mit-0|name|attribution|mit no attribution(?: LIC)?
mit-0|version|mit 0|mit 0(?: LIC)?
mit-cmu|notice|without fee is hereby granted|permission to use copy modify and distribute this software and its associated documentation for any purpose and without fee is hereby granted
x11|name|x11|x11 LIC
x11|name|x consortium|(?:mit )?x consortium LIC
expat|name|expat|expat LIC
isc|notice|with or without fee is hereby granted|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc|name|isc|isc LIC
isc|link|opensource org|opensource org licenses isc(?: LIC)?
isc|name|internet systems consortium|internet systems consortium LIC
0bsd|name|0bsd|0bsd(?: LIC)?
0bsd|name|zero clause bsd|(?:bsd )?zero clause bsd(?: LIC)?
bsd|notice|redistribution and use|redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?
bsd|notice|redistributions of source code|redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd|notice|redistributions in binary form|redistributions in binary form must reproduce the above copyright notice
bsd-3-clause|notice|endorse or promote products|neither the names? of (?:[^ ]+ ){1,12}may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause|notice|advertising materials|all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd|name|bsd|bsd LIC
bsd|name|bsd|bsd style LIC
bsd|name|berkeley software distribution|berkeley software distribution LIC
bsd|link|opensource org|opensource org licenses bsd LIC(?: php)?
bsd-2-clause|version|bsd|bsd 2 clause(?: LIC)?
bsd-2-clause|version|bsd|(?:2|two) clause bsd(?: LIC)?
bsd-2-clause|name|simplified bsd|simplified bsd LIC
bsd-2-clause|name|freebsd|freebsd LIC
bsd-2-clause|link|opensource org|opensource org licenses bsd 2 clause
bsd-3-clause|version|bsd|bsd 3 clause(?: LIC)?
bsd-3-clause|version|bsd|(?:3|three) clause bsd(?: LIC)?
bsd-3-clause|name|revised bsd|revised bsd LIC
bsd-3-clause|name|new bsd|new bsd LIC
bsd-3-clause|name|modified bsd|modified bsd LIC
bsd-3-clause|link|opensource org|opensource org licenses bsd 3 clause
bsd-3-clause-clear|name|clear bsd|(?:3 clause )?clear bsd LIC
bsd-4-clause|version|bsd|(?:4|four) clause bsd(?: LIC)?
bsd-4-clause|version|bsd|bsd 4 clause(?: LIC)?
bsd-4-clause|name|original bsd|original bsd LIC
apache-2.0|notice|apache license version 2 0|licensed under the apache license version 2 0(?: the license)?
apache-2.0|notice|in compliance with the license|you may not use this file except in compliance with the license
apache-2.0|notice|as is basis|distributed under the license is distributed on an as is basis without warranties or conditions of any kind
apache-2.0|version|apache|apache (?:software )?LICVER 2(?: 0)?
apache-2.0|version|apache|apache 2(?: 0)? LIC
apache-2.0|version|apache|apache 2 0
apache-2.0|version|asl|asl 2 0
apache-2.0|link|apache org|apache org licenses LIC 2 0(?: txt| html)?
apache-2.0|link|opensource org|opensource org licenses apache 2 0
apache-1.1|version|apache|apache (?:software )?LICVER 1 1
apache-1.0|version|apache|apache (?:software )?LICVER 1 0
apache|name|apache|apache (?:software )?LIC
apache|name|apache|apache software foundation LIC
apache|name|apache|apache style LIC
gpl|notice|free software you can redistribute|this (?:program|library|software|file) is free software you can redistribute it and or modify it under the terms of the gnu general public LIC
gpl|notice|hope that it will be useful|(?:is )?distributed in the hope that it will be useful but without any warranty
gpl|notice|merchantability or fitness|without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public LIC
gpl|notice|received a copy of the gnu|you should have received a copy of the gnu general public LIC along with this (?:program|library|software)
gpl|notice|everyone is permitted to copy|everyone is permitted to copy and distribute verbatim copies of this LIC document but changing it is not allowed
gpl|name|gnu|gnu general public LIC
gpl|name|gpl|gnu gpl
gpl|name|gpl|gpl LIC
gpl|name|gpl|(?:released|licensed|distributed|available|published) under (?:the )?(?:gnu )?gpl
gpl|link|gnu org|gnu org licenses gpl(?: html| txt)?
gpl|link|gnu org|gnu org copyleft gpl(?: html)?
gpl-1.0|version|gnu|gnu general public LICVER 1(?: 0)?
gpl-2.0|version|gnu|gnu general public LICVER 2(?: 0)?
gpl-2.0|version|gpl|(?:gnu )?gplVER 2(?: 0)?
gpl-2.0|version|gplv2|(?:gnu )?gplv2
gpl-2.0|link|gnu org|gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
gpl-2.0|link|opensource org|opensource org licenses gpl 2 0
gpl-2.0-only|version|version 2|gnu general public LIC version 2 only
gpl-2.0-or-later|version|any later version|(?:gnu general public LIC|gpl)(?: as published by the free software foundation)?(?: either)?VER 2(?: 0)?(?: of the LIC)? or (?:at your option )?any later version
gpl-3.0|version|gnu|gnu general public LICVER 3(?: 0)?
gpl-3.0|version|gpl|(?:gnu )?gplVER 3(?: 0)?
gpl-3.0|version|gplv3|(?:gnu )?gplv3
gpl-3.0|link|gnu org|gnu org licenses gpl 3 0(?: html| txt)?
gpl-3.0|link|opensource org|opensource org licenses gpl 3 0
gpl-3.0-or-later|version|any later version|(?:gnu general public LIC|gpl)(?: as published by the free software foundation)?(?: either)?VER 3(?: 0)?(?: of the LIC)? or (?:at your option )?any later version
gpl-classpath|name|classpath exception|(?:gpl )?(?:with )?(?:the )?(?:gnu )?classpath exception
gpl-gcc-exception|name|gcc runtime library exception|gcc runtime library exception
lgpl|notice|gnu lesser general public|under the terms of the gnu lesser general public LIC as published by the free software foundation
lgpl|name|gnu|gnu (?:lesser|library) general public LIC
lgpl|name|lgpl|(?:gnu )?lgpl(?: LIC)?
lgpl|link|gnu org|gnu org licenses lgpl(?: html| txt)?
lgpl-2.0|version|library general public|gnu library general public LICVER 2(?: 0)?
lgpl-2.1|version|gnu|gnu lesser general public LICVER 2 1
lgpl-2.1|version|lgpl|(?:gnu )?lgplVER 2 1
lgpl-2.1|version|lgplv2|(?:gnu )?lgplv2(?: 1)?
lgpl-2.1|link|gnu org|gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt)?
lgpl-3.0|version|gnu|gnu lesser general public LICVER 3(?: 0)?
lgpl-3.0|version|lgpl|(?:gnu )?lgplVER 3(?: 0)?
lgpl-3.0|version|lgplv3|(?:gnu )?lgplv3
lgpl-3.0|link|gnu org|gnu org licenses lgpl 3 0(?: html| txt)?
agpl|name|affero|(?:gnu )?affero general public LIC
agpl|name|agpl|(?:gnu )?agpl(?: LIC)?
agpl-1.0|version|affero|affero general public LICVER 1(?: 0)?
agpl-3.0|version|affero|(?:gnu )?affero general public LICVER 3(?: 0)?
agpl-3.0|version|agpl|(?:gnu )?agplVER 3(?: 0)?
agpl-3.0|version|agplv3|(?:gnu )?agplv3
agpl-3.0|link|gnu org|gnu org licenses agpl(?: 3 0)?(?: html| txt)?
agpl-3.0|notice|affero|under the terms of the gnu affero general public LIC as published by the free software foundation
gfdl|name|gnu free documentation|gnu free documentation LIC
gfdl|name|gfdl|gfdl(?: LIC)?
gfdl-1.1|version|gnu free documentation|gnu free documentation LICVER 1 1
gfdl-1.2|version|gnu free documentation|gnu free documentation LICVER 1 2
gfdl-1.3|version|gnu free documentation|gnu free documentation LICVER 1 3
gfdl|link|gnu org|gnu org (?:licenses|copyleft) fdl(?: 1 [123])?(?: html| txt)?
gfdl|notice|no invariant sections|with no invariant sections no front cover texts and no back cover texts
mpl|name|mozilla public|mozilla public LIC
mpl-1.0|version|mozilla public|mozilla public LICVER 1 0
mpl-1.1|version|mozilla public|mozilla public LICVER 1 1
mpl-2.0|version|mozilla public|mozilla public LICVER 2(?: 0)?
mpl-1.1|version|mpl|mplVER 1 1
mpl-2.0|version|mpl|mplVER 2(?: 0)?
mpl-2.0|notice|source code form is subject|this source code form is subject to the terms of the mozilla public LIC v 2 0
mpl-1.1|notice|contents of this file are subject|the contents of this file are subject to the mozilla public LIC version 1 1
mpl-2.0|link|mozilla org|mozilla org mpl 2 0(?: index txt)?
mpl-1.1|link|mozilla org|mozilla org mpl mpl 1 1(?: html)?
npl|name|netscape public|netscape public LIC(?:VER 1 [01])?
epl|name|eclipse public|eclipse public LIC
epl-1.0|version|eclipse public|eclipse public LICVER 1 0
epl-2.0|version|eclipse public|eclipse public LICVER 2(?: 0)?
epl-1.0|version|epl|eplVER 1 0
epl-2.0|version|epl|eplVER 2 0
epl-1.0|link|eclipse org|eclipse org legal epl v10(?: html)?
epl-2.0|link|eclipse org|eclipse org legal epl (?:v20|2 0)(?: html)?
edl-1.0|name|eclipse distribution|eclipse distribution LIC(?:VER 1 0)?
cddl|name|common development and distribution|common development and distribution LIC
cddl-1.0|version|common development and distribution|common development and distribution LIC(?: cddl)?VER 1 0
cddl-1.1|version|common development and distribution|common development and distribution LIC(?: cddl)?VER 1 1
cddl-1.0|version|cddl|cddlVER 1 0
cpl-1.0|name|common public|common public LIC(?:VER 1 0)?
cpal-1.0|name|common public attribution|common public attribution LIC(?:VER 1 0)?
ipl-1.0|name|ibm public|ibm public LIC(?:VER 1 0)?
eupl|name|european union public|european union public LIC
eupl-1.1|version|european union public|european union public LICVER 1 1
eupl-1.2|version|european union public|european union public LICVER 1 2
eupl-1.2|version|eupl|euplVER 1 2
ms-pl|name|microsoft public|microsoft public LIC(?: ms pl)?
ms-rl|name|microsoft reciprocal|microsoft reciprocal LIC(?: ms rl)?
ms-eula|name|microsoft software|microsoft software LIC terms
artistic|name|artistic|(?:perl )?artistic LIC
artistic-1.0|version|artistic|artistic LICVER 1 0
artistic-2.0|version|artistic|artistic LICVER 2(?: 0)?
artistic|notice|same terms as perl|(?:redistribute it and or modify it )?under the same terms as perl(?: itself)?
zlib|name|zlib|zlib(?: libpng)? LIC
zlib|notice|this software is provided as is without any express|this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
libpng|name|libpng|libpng LIC(?:VER 2)?
bsl-1.0|name|boost|boost software LIC(?:VER 1 0)?
bsl-1.0|link|boost org|boost org LIC 1 0 txt
bsl-1.0|notice|boost|distributed under the boost software LIC version 1 0
unlicense|name|unlicense|unlicense
unlicense|link|unlicense org|unlicense org
unlicense|notice|unencumbered software|this is free and unencumbered software released into the public domain
wtfpl|name|wtfpl|wtfpl(?: LIC)?(?:VER 2)?
wtfpl|name|do what the|do what the [^ ]+ you want to public LIC
cc0-1.0|name|cc0|cc0(?: 1 0)?(?: universal)?(?: LIC)?
cc0-1.0|name|creative commons zero|creative commons zero(?:VER 1 0)?(?: universal)?(?: LIC)?
cc0-1.0|link|creativecommons org|creativecommons org publicdomain zero 1 0
cc0-1.0|notice|waived all copyright|has waived all copyright and related or neighboring rights
cc-pdm|link|creativecommons org|creativecommons org publicdomain mark 1 0
cc|name|creative commons|creative commons LIC
cc-by|name|cc by|cc by(?: LIC)?
cc-by|name|creative commons attribution|creative commons attribution LIC
cc-by-2.0|version|cc by|cc by 2 0
cc-by-2.5|version|cc by|cc by 2 5
cc-by-3.0|version|cc by|cc by 3 0(?: unported| us)?
cc-by-4.0|version|cc by|cc by 4 0(?: international)?
cc-by-3.0|version|creative commons attribution|creative commons attribution 3 0(?: unported)?(?: LIC)?
cc-by-4.0|version|creative commons attribution|creative commons attribution 4 0(?: international)?(?: LIC)?
cc-by-3.0|link|creativecommons org|creativecommons org licenses by 3 0
cc-by-4.0|link|creativecommons org|creativecommons org licenses by 4 0
cc-by-sa|name|cc by sa|cc by sa(?: LIC)?
cc-by-sa|name|share|(?:creative commons )?attribution share ?alike(?: LIC)?
cc-by-sa-2.5|version|cc by sa|cc by sa 2 5
cc-by-sa-3.0|version|cc by sa|cc by sa 3 0(?: unported)?
cc-by-sa-4.0|version|cc by sa|cc by sa 4 0(?: international)?
cc-by-sa-3.0|version|share|(?:creative commons )?attribution share ?alike 3 0(?: unported)?(?: LIC)?
cc-by-sa-4.0|version|share|(?:creative commons )?attribution share ?alike 4 0(?: international)?(?: LIC)?
cc-by-sa-3.0|link|creativecommons org|creativecommons org licenses by sa 3 0
cc-by-sa-4.0|link|creativecommons org|creativecommons org licenses by sa 4 0
cc-by-nc|name|cc by nc|cc by nc(?: LIC)?
cc-by-nc|name|noncommercial|(?:creative commons )?attribution noncommercial(?: LIC)?
cc-by-nc|name|non commercial|(?:creative commons )?attribution non commercial(?: LIC)?
cc-by-nc-3.0|version|cc by nc|cc by nc 3 0(?: unported)?
cc-by-nc-4.0|version|cc by nc|cc by nc 4 0(?: international)?
cc-by-nc-4.0|version|noncommercial|(?:creative commons )?attribution noncommercial 4 0(?: international)?(?: LIC)?
cc-by-nc-4.0|link|creativecommons org|creativecommons org licenses by nc 4 0
cc-by-nd|name|cc by nd|cc by nd(?: LIC)?
cc-by-nd-3.0|version|cc by nd|cc by nd 3 0(?: unported)?
cc-by-nd-4.0|version|cc by nd|cc by nd 4 0(?: international)?
cc-by-nd|name|noderiv|(?:creative commons )?attribution noderiv(?:ative)?s(?: LIC)?
cc-by-nd-4.0|link|creativecommons org|creativecommons org licenses by nd 4 0
cc-by-nc-sa|name|cc by nc sa|cc by nc sa(?: LIC)?
cc-by-nc-sa-3.0|version|cc by nc sa|cc by nc sa 3 0(?: unported)?
cc-by-nc-sa-4.0|version|cc by nc sa|cc by nc sa 4 0(?: international)?
cc-by-nc-sa-4.0|version|noncommercial|(?:creative commons )?attribution noncommercial share ?alike 4 0(?: international)?(?: LIC)?
cc-by-nc-sa-4.0|link|creativecommons org|creativecommons org licenses by nc sa 4 0
cc-by-nc-nd|name|cc by nc nd|cc by nc nd(?: LIC)?
cc-by-nc-nd-3.0|version|cc by nc nd|cc by nc nd 3 0(?: unported)?
cc-by-nc-nd-4.0|version|cc by nc nd|cc by nc nd 4 0(?: international)?
cc-by-nc-nd-4.0|version|noncommercial noderiv|(?:creative commons )?attribution noncommercial noderiv(?:ative)?s 4 0(?: international)?(?: LIC)?
cc-by-nc-nd-4.0|link|creativecommons org|creativecommons org licenses by nc nd 4 0
odbl|name|open database|open database LIC(?:VER 1 0)?
odbl|name|odbl|odbl(?:VER 1 0)?
odc-by|name|open data commons attribution|open data commons attribution LIC(?:VER 1 0)?
pddl|name|public domain dedication and|(?:open data commons )?public domain dedication and LIC
public-domain|name|public domain|(?:released|dedicated|placed|published) (?:in|to|into) the public domain
public-domain|name|public domain|(?:this (?:work|text|file|book) is )?in the public domain
ogl-3.0|name|open government|(?:uk )?open government LIC(?:VER 3(?: 0)?)?
etalab-2.0|name|ouverte|licence ouverte(?: etalab)?(?:VER 2(?: 0)?)?
cecill|name|cecill|(?:licence )?cecill(?: LIC)?(?: [abc])?
cecill-2.1|version|cecill|cecillVER 2 1
ofl-1.1|name|sil open font|sil open font LIC(?:VER 1 [01])?
ofl-1.1|link|scripts sil org|scripts sil org ofl
psf|name|python software foundation|python software foundation LIC(?:VER 2)?
psf|name|psf|psf LIC(?:VER 2)?
php-3.01|name|php|php LIC(?:VER 3 0(?:1)?)?
ruby|name|ruby|ruby LIC
openssl|name|openssl|openssl LIC
openldap|name|openldap|openldap public LIC(?:VER 2 8)?
postgresql|name|postgresql|postgresql LIC
vim|name|vim|vim LIC
curl|name|curl|curl LIC
ncsa|name|ncsa|(?:university of illinois )?ncsa(?: open source)? LIC
afl-3.0|name|academic free|academic free LIC(?:VER 3 0)?
osl-3.0|name|open software|open software LIC(?:VER 3 0)?
upl-1.0|name|universal permissive|universal permissive LIC(?:VER 1 0)?
blueoak-1.0.0|name|blue oak model|blue oak model LIC(?: 1 0 0)?
mulanpsl-2.0|name|mulan permissive|mulan permissive software LIC(?:VER 2)?
w3c|name|w3c|w3c software(?: notice)?(?: and document)?(?: notice)?(?: and)? LIC
sspl-1.0|name|server side public|server side public LIC(?:VER 1)?
busl-1.1|name|business source|business source LIC(?:VER 1 1)?
elastic-2.0|name|elastic|elastic LIC(?:VER 2 0)?
commons-clause|name|commons clause|commons clause(?: LIC condition)?(?: v?1 0)?
polyform-nc|name|polyform|polyform noncommercial LIC(?: 1 0 0)?
polyform|name|polyform|polyform (?:small business|internal use|shield|strict|perimeter) LIC(?: 1 0 0)?
openrail|name|rail|(?:creativeml |bigscience )?open ?rail(?: m| s)?(?: LIC)?
llama-community|name|llama|llama(?: 2| 3)? community LIC(?: agreement)?
json|notice|shall be used for good|the software shall be used for good not evil
beerware|name|beer|beer ?ware LIC
hippocratic|name|hippocratic|hippocratic LIC(?:VER 3(?: 0)?)?
copyleft-next|name|copyleft next|copyleft next(?: 0 3 [01])?
intel|name|intel open source|intel open source LIC
nasa-1.3|name|nasa open source|nasa open source agreement(?:VER 1 3)?
sun-bcl|name|binary code|(?:sun |oracle )?binary code LIC agreement
wordnet|name|wordnet|wordnet(?: 3 0)? LIC
unicode|name|unicode|unicode(?: data files and software| terms of use)? LIC
proprietary|name|proprietary|proprietary and confidential
proprietary|hint|all rights reserved|all rights reserved
license-notice|hint|ed under|licen[cs]ed under(?: the terms of)?
license-notice|hint|see the|see the LIC(?: file)? for (?:more )?(?:details|the specific language)
license-notice|hint| file|(?:see|in) the LIC file
license-notice|hint|lizenz|lizenziert unter (?:der |einer )?(?:[^ ]+ )?lizenz
license-notice|hint|licence|(?:sous|distribu[^ ]{1,4} sous) licence
license-notice|hint|licencia|(?:bajo|distribuido bajo) (?:la |una )?licencia
"""

#: Identifiers of license tags; their rules are made by `tag_rule`.
TAGS = """
0bsd afl-3.0 agpl-3.0-only agpl-3.0-or-later agpl-3.0 apache-1.1 apache-2.0 artistic-1.0 artistic-2.0 beerware
blueoak-1.0.0 bsd-2-clause bsd-3-clause bsd-4-clause bsl-1.0 busl-1.1 cc-by-3.0 cc-by-4.0 cc-by-nc-4.0 cc-by-nc-nd-4.0
cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 cpal-1.0 cpl-1.0
curl ecl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0-only gpl-2.0-or-later gpl-2.0 gpl-3.0-only
gpl-3.0-or-later gpl-3.0 isc lgpl-2.0 lgpl-2.1-only lgpl-2.1-or-later lgpl-2.1 lgpl-3.0-only lgpl-3.0-or-later lgpl-3.0
mit mit-0 mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0 ncsa odbl-1.0 ofl-1.1 openssl osl-3.0 php-3.01 postgresql psf-2.0
ruby sspl-1.0 unlicense upl-1.0 vim w3c wtfpl x11 zlib
"""


def tag_rule(tag: str) -> tuple[str, str, str, str]:
    """`SPDX-License-Identifier:` with the tag, alone or after others joined by or, and, with."""
    words = "".join(c if c.isalnum() else " " for c in tag)
    return tag, "tag", "spdx license identifier", f"spdx license identifier(?:(?: [^ ]+){{1,6}}? (?:or|and|with)){{0,3}} ({words})"


def rules() -> list[tuple[str, str, str, str]]:
    """(label, kind, keyword, regex), in order: of equal matches of one kind the first rule's counts."""
    out = []
    for line in HAND_WRITTEN.strip().splitlines():
        label, kind, keyword, regex = line.split("|", 3)
        regex = regex.replace("LIC", "licen[cs]e").replace("VER ", "(?: (?:version|ver|v))? v?")
        out.append((label, kind, keyword, regex))
    return out + [tag_rule(t) for t in TAGS.split()]
