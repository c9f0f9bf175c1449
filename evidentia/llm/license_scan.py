"""License scans: ordered signature regexes behind a keyword prefilter, then priority and containment suppression."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import doc_text, map_arrow

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Rule:
    """A regex over the words of a text, lower-case and joined by one space.  It is tried only where ``keyword`` stands."""

    label: str
    keyword: str
    pattern: str
    priority: int
    weight: float


def _rule_lines() -> list[tuple[int, float, str]]:
    """(priority, weight, lines of ``label | keyword | pattern``), from the most telling signatures to mere names."""
    return [
        (0, 1.0, "\n".join(f"{label} | spdx license identifier | spdx license identifier {words}" for label, words in SPDX.items())),
        (1, 0.95, GRANTS),
        (2, 0.9, NOTICES),
        (3, 0.7, TITLES),
        (4, 0.6, "\n".join(f"{label} | {site} | (?:https? )?(?:www )?{site}{path}" for label, site, path in LINKS)),
        (5, 0.4, NAMES),
        (6, 0.2, HINTS),
    ]


#: SPDX tags and the words that they become.
SPDX = {
    "mit": "mit", "mit-0": "mit 0", "apache-1.1": "apache 1 1", "apache-2.0": "apache 2 0", "gpl-1.0": r"gpl 1 0(?: only| or later)?", "gpl-2.0-only": r"gpl 2 0(?: only)?", "gpl-2.0-or-later": "gpl 2 0 or later",
    "gpl-3.0-only": r"gpl 3 0(?: only)?", "gpl-3.0-or-later": "gpl 3 0 or later", "lgpl-2.0": r"lgpl 2 0(?: only| or later)?", "lgpl-2.1": r"lgpl 2 1(?: only| or later)?", "lgpl-3.0": r"lgpl 3 0(?: only| or later)?",
    "agpl-3.0": r"agpl 3 0(?: only| or later)?", "bsd-1-clause": "bsd 1 clause", "bsd-2-clause": "bsd 2 clause", "bsd-3-clause": "bsd 3 clause", "bsd-4-clause": "bsd 4 clause", "0bsd": "0bsd", "isc": "isc",
    "mpl-1.1": "mpl 1 1", "mpl-2.0": "mpl 2 0", "epl-1.0": "epl 1 0", "epl-2.0": "epl 2 0", "cddl-1.0": "cddl 1 0", "cddl-1.1": "cddl 1 1", "cpl-1.0": "cpl 1 0", "eupl-1.1": "eupl 1 1", "eupl-1.2": "eupl 1 2",
    "artistic-1.0": "artistic 1 0", "artistic-2.0": "artistic 2 0", "bsl-1.0": "bsl 1 0", "cc0-1.0": "cc0 1 0", "cc-by-3.0": "cc by 3 0", "cc-by-4.0": "cc by 4 0", "cc-by-sa-3.0": "cc by sa 3 0", "cc-by-sa-4.0": "cc by sa 4 0",
    "cc-by-nc-4.0": "cc by nc 4 0", "cc-by-nd-4.0": "cc by nd 4 0", "cc-by-nc-sa-4.0": "cc by nc sa 4 0", "cc-by-nc-nd-4.0": "cc by nc nd 4 0", "unlicense": "unlicense", "wtfpl": "wtfpl", "zlib": "zlib", "libpng": "libpng",
    "ofl-1.0": "ofl 1 0", "ofl-1.1": "ofl 1 1", "openssl": "openssl", "python-2.0": "python 2 0", "psf-2.0": "psf 2 0", "php-3.01": "php 3 01", "ruby": "ruby", "postgresql": "postgresql", "ncsa": "ncsa", "x11": "x11",
    "ms-pl": "ms pl", "ms-rl": "ms rl", "osl-3.0": "osl 3 0", "afl-3.0": "afl 3 0", "ecl-2.0": "ecl 2 0", "upl-1.0": "upl 1 0", "vim": "vim", "w3c": "w3c", "unicode-dfs-2016": "unicode dfs 2016", "blueoak-1.0.0": "blueoak 1 0 0",
    "sspl-1.0": "sspl 1 0", "busl-1.1": "busl 1 1", "odbl-1.0": "odbl 1 0", "pddl-1.0": "pddl 1 0", "gfdl-1.2": "gfdl 1 2", "gfdl-1.3": "gfdl 1 3", "ftl": "ftl", "hpnd": "hpnd", "icu": "icu", "jasper-2.0": "jasper 2 0", "json": "json",
}

GRANTS = r"""
mit | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | the above copyright notice and this permission notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit-0 | permission is hereby granted free of charge | permission is hereby granted free of charge .{0,400}without restriction including without limitation the rights .{0,160}furnished to do so the software is provided
mit | deal in the software without restriction | (?:to )?deal in the software without restriction including without limitation
ofl-1.1 | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of the font software
boost | permission is hereby granted free of charge | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
apache-2.0 | you may not use this file except in compliance | licensed under the apache license version 2 0 .{0,80}you may not use this file except in compliance with the license
apache-2.0 | grants to you a perpetual worldwide | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent)? ?license
apache-2.0 | unless required by applicable law | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
gpl | free software you can redistribute it | this (?:program|library|file|software) is free software you can redistribute it and or modify it under the terms of the gnu general public license
lgpl | free software you can redistribute it | this (?:program|library|file|software) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
agpl | free software you can redistribute it | this (?:program|library|file|software) is free software you can redistribute it and or modify it under the terms of the gnu affero general public license
gpl-2.0-or-later | any later version | either version 2 of the license or at your option any later version
gpl-3.0-or-later | any later version | either version 3 of the license or at your option any later version
lgpl-2.1-or-later | any later version | either version 2 1 of the license or at your option any later version
gpl | without even the implied warranty | in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness
gpl | everyone is permitted to copy | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl | you should have received a copy | you should have received a copy of the gnu general public license
lgpl | you should have received a copy | you should have received a copy of the gnu (?:lesser|library) general public license
agpl | you should have received a copy | you should have received a copy of the gnu affero general public license
bsd | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause | redistributions in binary form | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
bsd-3-clause | endorse or promote products | neither the name .{0,120}may be used to endorse or promote products derived from this software
bsd-3-clause | endorse or promote products | the names? of .{0,80}may not be used to endorse or promote products derived from this software
bsd-4-clause | all advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
isc | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
hpnd | permission to use copy modify | permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted
zlib | this software is provided as is | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | the origin of this software | the origin of this software must not be misrepresented
mpl-2.0 | subject to the terms of the mozilla | this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0
mpl-1.1 | subject to the mozilla public license | the contents of this file are subject to the mozilla public license version 1 1
epl-1.0 | eclipse public license | accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2.0 | eclipse public license | accompanying materials are made available under the terms of the eclipse public license (?:v 2 0|v2 0|2 0)
cddl-1.0 | common development and distribution | subject to the terms of the common development and distribution license
unlicense | released into the public domain | this is free and unencumbered software released into the public domain
wtfpl | do what the fuck you want | you just do what the fuck you want to
cc0-1.0 | waived all copyright | (?:has|have) waived all copyright and related or neighboring rights
artistic-2.0 | artistic license | terms of the artistic license 2 0
boost | boost software license | distributed under the boost software license version 1 0
ofl-1.1 | sil open font license | licensed under the sil open font license version 1 1
python-2.0 | python software foundation | the python software foundation psf is making python available
ncsa | deal with the software without restriction | to deal with the software without restriction including without limitation
openssl | developed by the openssl project | this product includes software developed by the openssl project
php | this product includes php | this product includes php software freely available
postgresql | permission to use copy modify | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
busl-1.1 | business source license | terms of this business source license
sspl-1.0 | make the functionality of the program | make the functionality of the program .{0,60}available to third parties as a service
json | shall be used for good | the software shall be used for good not evil
mit | without restriction including without limitation | (?:use|deal in) the software without restriction including without limitation the rights to use copy modify
mit | the software is provided as is | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
apache-2.0 | you must retain in the source form | you must retain in the source form of any derivative works that you distribute all copyright patent trademark and attribution notices
apache-2.0 | for inclusion in the work | any contribution intentionally submitted (?:to licensor )?for inclusion in the work
apache-1.1 | apache software foundation | this product includes software developed by the apache software foundation
gpl-3.0 | installation information | installation information for a user product means any methods procedures authorization keys
gpl-3.0 | the gnu general public license is a free copyleft license | the gnu general public license is a free copyleft license for software and other kinds of works
gpl-2.0 | the licenses for most software | the licenses for most software are designed to take away your freedom to share and change it
lgpl | statically or dynamically with other modules | linking (?:this library|a covered work) statically or dynamically with other modules
lgpl-2.1 | such a work in isolation | such a work in isolation is (?:not a derivative work of the library|called a work that uses the library)
agpl-3.0 | interacting with it remotely | all users interacting with it remotely through a computer network
gpl-classpath | as a special exception | as a special exception the copyright holders of this library give you permission to link this library with independent modules
gpl-autoconf | as a special exception | as a special exception .{0,120}configuration script generated by autoconf
gpl-bison | as a special exception | as a special exception you may create a larger work that contains part or all of the bison parser skeleton
gcc-exception-3.1 | gcc runtime library exception | gcc runtime library exception version 3 1
llvm-exception | llvm exceptions | apache license v2 0 with llvm exceptions
bsd | this software is provided by the copyright holders | this software is provided by the copyright holders and contributors as is and any express or implied warranties
bsd | the regents of the university | copyright .{0,40}the regents of the university of california all rights reserved
bsd-1-clause | redistributions of source code must retain | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer this software is provided
bsd-patent | hereby grants to those receiving rights | hereby grants to those receiving rights under this license a perpetual worldwide non exclusive no charge royalty free irrevocable
isc | disclaims all warranties with regard | the software is provided as is and (?:isc|the author) disclaims all warranties with regard to this software
zlib | freely subject to the following restrictions | alter it and redistribute it freely subject to the following restrictions
libpng | contributing authors | the png reference library is supplied as is the contributing authors
mpl-2.0 | you can obtain one at | if a copy of the mpl was not distributed with this file you can obtain one at
epl-1.0 | this agreement | any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement
cc-by | you are free to share | you are free to share copy and redistribute the material in any medium or format
cc-by-sa | you must distribute your contributions | if you remix transform or build upon the material you must distribute your contributions under the same license
cc-by-nc | commercial purposes | you may not use the material for commercial purposes
cc-by-nd | distribute the modified material | if you remix transform or build upon the material you may not distribute the modified material
cc0-1.0 | the person who associated a work | the person who associated a work with this deed has dedicated the work to the public domain
gfdl | permission is granted to copy distribute | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
ofl-1.1 | reserved font name | no modified version of the font software may use the reserved font names?
ncsa | redistributions of source code must retain | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers
x11 | except as contained in this notice | except as contained in this notice the name of the x consortium shall not be used in advertising
curl | permission to use copy modify | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
tcl | the authors hereby grant permission | the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose
unicode | unicode data files | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
icu | obtaining a copy of this software and associated | obtaining a copy of this software and associated documentation files .{0,200}provided that the above copyright notices? and this permission notice appear in all copies
ruby | you may make and give away verbatim copies | you may make and give away verbatim copies of the source form of the software without restriction
artistic-1.0 | the intent of this document | the intent of this document is to state the conditions under which a package may be copied
openssl | eric young | this product includes cryptographic software written by eric young
afl-3.0 | academic free license | licensed under the academic free license version 3 0
osl-3.0 | open software license | licensed under the open software license version 3 0
upl-1.0 | subject to the condition set forth below | subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software
ms-pl | this license governs use | this license governs use of the accompanying software if you use the software you accept this license
elastic-2.0 | hosted or managed service | you may not provide the software to third parties as a hosted or managed service
polyform | polyform | polyform (?:noncommercial|small business|strict|shield|perimeter|free trial) license 1 0 0
llama | community license | licensed under the (?:meta )?llama(?: [23])?(?: [0-9])? community license
rail | use based restrictions | (?:the )?use based restrictions .{0,80}must be included as an enforceable provision
hippocratic | hippocratic license | hippocratic license(?: version)?(?: [123] [0-9])?
anti-996 | anti 996 | anti 996 license(?: version 1 0)?
parity | parity public license | parity public license(?: 7 0 0)?
cern-ohl | open hardware licence | cern open hardware licence(?: version 2| v1 2)?(?: (?:strongly|weakly) reciprocal| permissive)?
glwtpl | good luck with that | good luck with that public license
bsd-source-code | bsd source code attribution | bsd source code attribution
intel | intel open source license | intel open source license
sissl | sun industry standards | sun industry standards source license(?: version 1 [12])?
spl | sun public license | sun public license(?: version 1 0)?
lppl | latex project public license | latex project public license(?: version)?(?: 1 [0-3] ?[ac]?)?
rpl | reciprocal public license | reciprocal public license(?: version)?(?: 1 [15])?
cpal | common public attribution license | common public attribution license(?: version)?(?: 1 0)?
motosoto | motosoto open source license | motosoto open source license
nasa | nasa open source agreement | nasa open source agreement(?: version)?(?: 1 3)?
naumen | naumen public license | naumen public license
wxwindows | wxwindows library licen | wxwindows library licen[cs]e(?: version 3 1)?
beerware | as long as you retain this notice | as long as you retain this notice you can do whatever you want with this stuff
"""

NOTICES = "\n".join(
    f"{label} | {name} | (?:is |are )?{verb} under (?:the )?(?:terms of )?(?:the )?{name}"
    for label, name in (
        ("mit", "mit license"), ("apache", "apache license"), ("apache-2.0", "apache 2 0"), ("bsd", "bsd license"), ("gpl", "gnu general public license"), ("gpl", "gpl"), ("lgpl", "gnu lesser general public license"), ("lgpl", "lgpl"),
        ("agpl", "gnu affero general public license"), ("agpl", "agpl"), ("mpl", "mozilla public license"), ("epl", "eclipse public license"), ("cc", "creative commons"), ("isc", "isc license"), ("unlicense", "unlicense"), ("zlib", "zlib license"),
    )
    for verb in ("licen[sc]ed", "released", "distributed", "available", "published")
)

TITLES = r"""
mit | mit license | (?:the )?mit license(?: mit)? copyright
apache-2.0 | apache license | apache license version 2 0
apache-2.0 | apache license | apache license (?:v )?2 0
apache-1.1 | apache software license | apache software license version 1 1
apache-1.0 | apache license | apache license version 1 0
gpl-1.0 | general public license | gnu general public license version 1
gpl-2.0 | general public license | gnu general public license (?:version|v) 2
gpl-3.0 | general public license | gnu general public license (?:version|v) 3
gpl-2.0 | general public license | gnu general public license v2 0
gpl-3.0 | general public license | gnu general public license v3 0
lgpl-2.0 | library general public license | gnu library general public license (?:version|v) 2
lgpl-2.1 | lesser general public license | gnu lesser general public license (?:version|v) 2 1
lgpl-3.0 | lesser general public license | gnu lesser general public license (?:version|v) 3
agpl-3.0 | affero general public license | gnu affero general public license (?:version|v) 3
gfdl | free documentation license | gnu free documentation license(?: version 1 [123])?
mpl-1.0 | mozilla public license | mozilla public license (?:version|v) ?1 0
mpl-1.1 | mozilla public license | mozilla public license (?:version|v) ?1 1
mpl-2.0 | mozilla public license | mozilla public license (?:version|v) ?2 0
epl-1.0 | eclipse public license | eclipse public license (?:version |v )?1 0
epl-2.0 | eclipse public license | eclipse public license (?:version |v )?2 0
edl-1.0 | eclipse distribution license | eclipse distribution license (?:version |v )?1 0
cpl-1.0 | common public license | common public license (?:version |v )?1 0
cddl-1.0 | common development and distribution license | common development and distribution license (?:version )?1 0
cddl-1.1 | common development and distribution license | common development and distribution license (?:version )?1 1
eupl | european union public licen | european union public licen[cs]e(?: v(?:ersion)? ?1 [0-2])?
ofl | open font license | (?:sil )?open font license(?: version 1 [01])?
bsd-2-clause | clause bsd | (?:2|two) clause bsd(?: license)?
bsd-3-clause | clause bsd | (?:3|three) clause bsd(?: license)?
bsd-4-clause | clause bsd | (?:4|four) clause bsd(?: license)?
bsd-2-clause | simplified bsd | simplified bsd license
bsd-3-clause | bsd license | (?:new|revised|modified) bsd license
bsd-2-clause | freebsd license | freebsd license
cc-by | creative commons attribution | creative commons attribution (?:[1-4] [05]|international|unported|license)
cc-by-sa | creative commons attribution | creative commons attribution share ?alike
cc-by-nd | creative commons attribution | creative commons attribution no ?deriv(?:ative)?s
cc-by-nc | creative commons attribution | creative commons attribution non ?commercial
cc-by-nc-sa | creative commons attribution | creative commons attribution non ?commercial share ?alike
cc-by-nc-nd | creative commons attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s
cc0-1.0 | cc0 | cc0 1 0(?: universal)?
cc-pdm | public domain mark | creative commons public domain mark
artistic-1.0 | artistic license | artistic license 1 0
artistic-2.0 | artistic license | artistic license 2 0
boost | boost software license | boost software license(?: version)? 1 0
psf | python software foundation license | python software foundation license(?: version 2)?
zpl | zope public license | zope public license(?: version)?(?: [12] [01])?
osl-3.0 | open software license | open software license (?:version |v )?3 0
afl-3.0 | academic free license | academic free license (?:version |v )?3 0
ecl-2.0 | educational community license | educational community license(?: version)? 2 0
upl-1.0 | universal permissive license | universal permissive license(?: version)?(?: 1 0)?
ms-pl | microsoft public license | microsoft public license
ms-rl | microsoft reciprocal license | microsoft reciprocal license
qpl | q public license | q public license(?: version 1 0)?
ncsa | illinois ncsa | university of illinois ncsa open source license
w3c | w3c software | w3c software (?:notice and|and document notice and) license
ibm-pl | ibm public license | ibm public license(?: version 1 0)?
apsl | apple public source license | apple public source license(?: (?:version |v )?[12] [0-2])?
cecill | cecill | cecill(?: b| c)?(?: free software)?(?: license)?
mulan | mulan permissive software license | mulan permissive software license(?: v2)?
openssl | openssl license | openssl license
sleepycat | sleepycat license | sleepycat license
nokia | nokia open source license | nokia open source license
ruby | ruby license | ruby license
vim | vim license | vim license
x11 | x11 license | (?:mit )?x11 license
expat | expat license | expat license
tcl | tcl tk license | tcl tk license
php | php license | php license(?: version)?(?: 3 0?[01])?
postgresql | postgresql license | postgresql license
sspl-1.0 | server side public license | server side public license
busl-1.1 | business source license | business source license(?: 1 1)?
elastic-2.0 | elastic license | elastic license(?: 2 0)?
odbl | database license | open (?:data commons open )?database license
odc-by | open data commons attribution | open data commons attribution license
pddl | public domain dedication and license | public domain dedication and license
cdla | community data license agreement | community data license agreement(?: (?:permissive|sharing))?
ogl | open government licen | open government licen[cs]e(?: v?[123] 0)?
openrail | openrail | (?:creativeml |bigcode )?openrail(?: m)?
wtfpl | do what the fuck you want to public license | do what the fuck you want to public license
commons-clause | commons clause | commons clause(?: license condition)?
"""

#: Label, host words and path words of the pages that license notices point to.
LINKS = (
    ("apache-2.0", "apache org", " licenses license 2 0"), ("apache", "apache org", " licenses"), ("gpl", "gnu org", " licenses gpl"), ("gpl", "gnu org", " licenses"), ("lgpl", "gnu org", " licenses lgpl"), ("agpl", "gnu org", " licenses agpl"),
    ("gfdl", "gnu org", " licenses fdl"), ("mit", "opensource org", " licenses mit"), ("bsd-2-clause", "opensource org", " licenses bsd 2 clause"), ("bsd-3-clause", "opensource org", " licenses bsd 3 clause"), ("isc", "opensource org", " licenses isc"),
    ("apache-2.0", "opensource org", " licenses apache 2 0"), ("mpl-2.0", "mozilla org", " (?:en us )?mpl 2 0"), ("mpl", "mozilla org", " (?:en us )?mpl"), ("epl", "eclipse org", " legal epl"), ("cc-by", "creativecommons org", " licenses by [1-4]"),
    ("cc-by-sa", "creativecommons org", " licenses by sa"), ("cc-by-nc", "creativecommons org", " licenses by nc [1-4]"), ("cc-by-nd", "creativecommons org", " licenses by nd"), ("cc-by-nc-sa", "creativecommons org", " licenses by nc sa"),
    ("cc-by-nc-nd", "creativecommons org", " licenses by nc nd"), ("cc0-1.0", "creativecommons org", " publicdomain zero"), ("cc-pdm", "creativecommons org", " publicdomain mark"), ("boost", "boost org", " license 1 0"), ("ofl-1.1", "scripts sil org", " ofl"),
    ("unlicense", "unlicense org", ""), ("wtfpl", "wtfpl net", ""), ("choosealicense", "choosealicense com", " licenses"), ("spdx", "spdx org", " licenses"), ("php", "php net", " license"), ("postgresql", "postgresql org", " about licence"),
    ("ogl", "nationalarchives gov uk", " doc open government licence"), ("odbl", "opendatacommons org", " licenses odbl"), ("odc-by", "opendatacommons org", " licenses by"), ("pddl", "opendatacommons org", " licenses pddl"),
)

NAMES = r"""
mit | mit license | mit license
mit | mit licence | mit licence
mit | mit licensed | mit licensed
apache | apache license | apache license
apache | apache licence | apache licence
gpl | general public license | general public license
gpl | general public licence | general public licence
gpl | gnu gpl | gnu gpl(?: ?v? ?[123])?
gpl-2.0 | gplv2 | gplv2
gpl-3.0 | gplv3 | gplv3
lgpl | lesser general public license | lesser general public license
lgpl | gnu lgpl | gnu lgpl
lgpl-2.1 | lgplv2 | lgplv2(?: 1)?
lgpl-3.0 | lgplv3 | lgplv3
agpl | affero general public license | affero general public license
agpl-3.0 | agplv3 | agplv3
bsd | bsd license | bsd license
bsd | bsd licence | bsd licence
bsd | bsd style license | bsd style license
mpl | mozilla public license | mozilla public license
epl | eclipse public license | eclipse public license
isc | isc license | isc license
zlib | zlib license | zlib license
artistic | artistic license | artistic license
boost | boost software license | boost software license
cc | creative commons | creative commons(?: licen[cs]e)?
"""

HINTS = r"""
all-rights-reserved | all rights reserved | all rights reserved
public-domain | public domain | (?:in|into|to) the public domain
proprietary | proprietary and confidential | proprietary and confidential
commercial | commercial license | commercial license
evaluation | evaluation purposes only | for evaluation purposes only
no-redistribution | redistributed | may not be (?:copied or )?redistributed
non-commercial | non commercial use only | for non commercial use only
research-only | research purposes only | for research purposes only
trademark | registered trademark | (?:is a|are) registered trademarks? of
copyleft | copyleft | (?:strong |weak )?copyleft licen[cs]e
permissive | permissive | permissive (?:open source )?licen[cs]e
source-available | source available | source available licen[cs]e
royalty-free | royalty free | (?:worldwide )?royalty free licen[cs]e
contributor-agreement | contributor license agreement | contributor license agreement
dual | dual | dual licen[sc]ed
free-software | free software | free software licen[cs]e
open-source | open source | open source licen[cs]e
no-warranty | without warranty of any kind | without warranty of any kind(?: express or implied)?
as-is | provided as is | (?:is )?provided as is
patent | patent | patent licen[cs]e
redistribution | redistributions of source code | redistributions of source code must retain
eula | end user license agreement | end user license agreement
"""


def rules() -> list[Rule]:
    """All rules in order of priority; a repeated line counts once."""
    out: dict[Rule, None] = {}
    for priority, weight, lines in _rule_lines():
        for line in filter(None, map(str.strip, lines.split("\n"))):
            label, keyword, pattern = (x.strip() for x in line.split(" | "))
            out[Rule(label, keyword, pattern, priority, weight)] = None
    return list(out)


#: UTF-8 bytes to lower case, all that is in no word to a space.
_FOLD = bytes(32 if b < 0x30 or 0x3A <= b < 0x41 or 0x5B <= b < 0x61 or 0x7B <= b < 0x80 else b + 32 if 0x41 <= b < 0x5B else b for b in range(256))


def suppress(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Drop a detection (start, end, rule) that lies inside one of better priority, or of the same and at least as long.

    The kept ones that no other contains have rising starts and rising ends, so one search answers for each.
    """
    kept: list[tuple[int, int, Rule]] = []
    starts: list[int] = []
    ends: list[int] = []
    for one in sorted(found, key=lambda x: (x[2].priority, x[0] - x[1], x[0], x[2].label)):
        start, end, _ = one
        at = bisect_right(starts, start)
        if at and ends[at - 1] >= end:
            continue
        kept.append(one)
        first = bisect_left(starts, start)
        last = first
        while last < len(ends) and ends[last] <= end:
            last += 1
        starts[first:last], ends[first:last] = [start], [end]
    return sorted(kept, key=lambda x: (x[0], x[1], x[2].label))


def _scan(joined: str, automaton, compiled) -> list[tuple[int, int, Rule]]:
    hits = {i for _, ids in automaton.iter(joined) for i in ids}
    found = []
    for i in sorted(hits):
        rule, pattern = compiled[i]
        found += [(m.start(), m.end(), rule) for m in pattern.finditer(joined)]
    return suppress(found)


def scan_licenses(documents: DataFrame, extra_rules: tuple[Rule, ...] = ()) -> DataFrame:
    """Base phrase places, labels and score of each whole text.

    A null or empty text has no words, labels or places and scores 0; repeated rows stay.  ``labels`` joins the base
    labels and those of the detections that suppression leaves; ``detections`` lists these with their word spans.
    ``score`` is one less the product of (1 - weight) over labels.
    """
    listed = [*rules(), *extra_rules]

    def make():
        import ahocorasick

        automaton, by_keyword = ahocorasick.Automaton(), {}
        for i, rule in enumerate(listed):
            by_keyword.setdefault(rule.keyword, []).append(i)
        for keyword, ids in by_keyword.items():
            automaton.add_word(keyword, tuple(ids))
        automaton.make_automaton()
        return automaton, [(r, re.compile(f"(?<= )(?:{r.pattern})(?= )")) for r in listed]

    def run(batch: pa.RecordBatch, state) -> pa.RecordBatch:
        out = []
        for raw in batch.column("text").cast(pa.binary()).to_pylist():
            words = (raw or b"").translate(_FOLD).split(b" ")
            words = [w for w in words if w]
            joined = " " + b" ".join(words).decode("utf-8", "replace") + " "
            places, labels = [], {}
            for phrase, label in BASE.items():
                at = joined.find(f" {phrase} ")
                while at >= 0:
                    places.append(at)
                    labels[label] = max(labels.get(label, 0), 0.4)
                    at = joined.find(f" {phrase} ", at + 1)
            base = ",".join(sorted(labels))
            spans = _scan(joined, *state) if len(words) > 1 else []
            for _, _, rule in spans:
                labels[rule.label] = max(labels.get(rule.label, 0), rule.weight)
            rest = 1.0
            for label in sorted(labels):
                rest *= 1 - labels[label]
            first, last = (joined.count(" ", 0, min(places)), joined.count(" ", 0, max(places))) if places else (None, None)
            shown = [{"label": r.label, "first": joined.count(" ", 0, a) - 1, "last": joined.count(" ", 0, b) - 1} for a, b, r in spans]
            out.append((len(words), len(places), first, last, base, ",".join(sorted(labels)), round(1 - rest, 6), shown))
        columns = list(zip(*out, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())])))
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *names])

    shape = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, detections array<struct<label:string,first:bigint,last:bigint>>"
    return map_arrow(doc_text(documents).select("doc_id", F.col("text")), run, shape, make)
