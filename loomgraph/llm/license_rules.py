"""The hand-written signature rules of the license scan.

One rule a line: label, strength, regex over a text's words (lower-cased, one blank between words; digits and letters outside ASCII are
letters of words, all other characters part words, so "Apache-2.0" is "apache 2 0"). Sections give the priority, 0 first. A regex uses
literals, [..] of single letters, (?:..|..), and ? after a letter, blank or group. {v} stands for an optional "version", {later} for an
optional "or later" phrase.
"""

from __future__ import annotations

MACROS = {
    "{v}": "(?: version| v| ver)?",
    "{later}": "(?: only| or later| or(?: at your option)? any later version| and later)?",
}

RULES = """
# 0: SPDX identifiers
mit                  1.0   spdx license identifier mit
mit-0                1.0   spdx license identifier mit 0
isc                  1.0   spdx license identifier isc
apache-1.1           1.0   spdx license identifier apache 1 1
apache-2.0           1.0   spdx license identifier apache 2 0
gpl-1.0              1.0   spdx license identifier gpl 1 0(?: only| or later)?
gpl-2.0              1.0   spdx license identifier gpl 2 0(?: only| or later)?
gpl-3.0              1.0   spdx license identifier gpl 3 0(?: only| or later)?
lgpl-2.0             1.0   spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.1             1.0   spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3.0             1.0   spdx license identifier lgpl 3 0(?: only| or later)?
agpl-3.0             1.0   spdx license identifier agpl 3 0(?: only| or later)?
gfdl-1.3             1.0   spdx license identifier gfdl 1 3(?: only| or later)?
bsd-2-clause         1.0   spdx license identifier bsd 2 clause
bsd-3-clause         1.0   spdx license identifier bsd 3 clause
bsd-4-clause         1.0   spdx license identifier bsd 4 clause
0bsd                 1.0   spdx license identifier 0bsd
mpl-1.1              1.0   spdx license identifier mpl 1 1
mpl-2.0              1.0   spdx license identifier mpl 2 0
epl-1.0              1.0   spdx license identifier epl 1 0
epl-2.0              1.0   spdx license identifier epl 2 0
cddl-1.0             1.0   spdx license identifier cddl 1 0
eupl-1.2             1.0   spdx license identifier eupl 1 2
bsl-1.0              1.0   spdx license identifier bsl 1 0
busl-1.1             1.0   spdx license identifier busl 1 1
zlib                 1.0   spdx license identifier zlib
unlicense            1.0   spdx license identifier unlicense
wtfpl                1.0   spdx license identifier wtfpl
cc0-1.0              1.0   spdx license identifier cc0 1 0
cc-by-3.0            1.0   spdx license identifier cc by 3 0
cc-by-4.0            1.0   spdx license identifier cc by 4 0
cc-by-sa-3.0         1.0   spdx license identifier cc by sa 3 0
cc-by-sa-4.0         1.0   spdx license identifier cc by sa 4 0
artistic-2.0         1.0   spdx license identifier artistic 2 0
ofl-1.1              1.0   spdx license identifier ofl 1 1
python-2.0           1.0   spdx license identifier (?:python|psf) 2 0
# 1: statements of license
mit                  0.95  licensed under (?:the )?(?:terms of (?:the )?)?mit(?: x11| expat)?(?: licen[cs]e)?
mit                  0.9   released under (?:the )?(?:terms of (?:the )?)?mit(?: licen[cs]e)?
mit                  0.9   (?:distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?mit(?: licen[cs]e)
mit                  0.85  licen[cs]e mit(?: licen[cs]e)?
isc                  0.95  licensed under (?:the )?isc(?: licen[cs]e)?
apache-2.0           0.95  licensed under (?:the )?apache(?: software)?(?: licen[cs]e)?{v} 2(?: 0)?
apache-2.0           0.9   released under (?:the )?apache(?: software)?(?: licen[cs]e)?{v} 2(?: 0)?
apache-2.0           0.9   distributed under (?:the )?apache(?: software)?(?: licen[cs]e)?{v} 2(?: 0)?
apache-1.1           0.9   licensed under (?:the )?apache(?: software)?(?: licen[cs]e)?{v} 1 1
gpl-2.0              0.95  licensed under (?:the )?(?:terms of (?:the )?)?(?:gnu )?general public licen[cs]e{v} 2(?: 0)?{later}
gpl-3.0              0.95  licensed under (?:the )?(?:terms of (?:the )?)?(?:gnu )?general public licen[cs]e{v} 3(?: 0)?{later}
gpl-2.0              0.9   licensed under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl ?v?2(?: 0)?{later}
gpl-3.0              0.9   licensed under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl ?v?3(?: 0)?{later}
gpl-2.0              0.9   terms of the (?:gnu )?general public licen[cs]e(?: as published by the free software foundation)? (?:either )?version 2{later}
gpl-3.0              0.9   terms of the (?:gnu )?general public licen[cs]e(?: as published by the free software foundation)? (?:either )?version 3{later}
lgpl-2.1             0.9   terms of the (?:gnu )?lesser general public licen[cs]e(?: as published by the free software foundation)? (?:either )?version 2 1{later}
lgpl-3.0             0.9   terms of the (?:gnu )?lesser general public licen[cs]e(?: as published by the free software foundation)? (?:either )?version 3{later}
lgpl-2.0             0.9   terms of the (?:gnu )?library general public licen[cs]e(?: as published by the free software foundation)? (?:either )?version 2{later}
agpl-3.0             0.9   terms of the (?:gnu )?affero general public licen[cs]e(?: as published by the free software foundation)? (?:either )?version 3{later}
lgpl-2.1             0.9   licensed under (?:the )?(?:gnu )?lgpl ?v?2 1{later}
lgpl-3.0             0.9   licensed under (?:the )?(?:gnu )?lgpl ?v?3(?: 0)?{later}
agpl-3.0             0.9   licensed under (?:the )?(?:gnu )?agpl ?v?3(?: 0)?{later}
bsd-2-clause         0.95  licensed under (?:the |a )?(?:simplified bsd|bsd 2 clause|2 clause bsd)(?: licen[cs]e)?
bsd-3-clause         0.95  licensed under (?:the |a )?(?:new bsd|revised bsd|modified bsd|bsd 3 clause|3 clause bsd)(?: licen[cs]e)?
bsd-3-clause         0.9   distributed under (?:the |a )?(?:new bsd|bsd 3 clause|3 clause bsd)(?: licen[cs]e)?
bsd-unversioned      0.8   licensed under (?:the |a )?bsd(?: style)?(?: licen[cs]e)?
bsd-unversioned      0.8   governed by a bsd style licen[cs]e
mpl-2.0              0.95  subject to the terms of the mozilla public licen[cs]e{v} 2(?: 0)?
mpl-1.1              0.95  subject to the mozilla public licen[cs]e{v} 1 1
mpl-2.0              0.9   licensed under (?:the )?mpl ?v?2(?: 0)?
epl-2.0              0.9   made available under the terms of the eclipse public licen[cs]e{v} 2(?: 0)?
epl-1.0              0.9   made available under the terms of the eclipse public licen[cs]e{v} 1(?: 0)?
cddl-1.0             0.9   subject to the terms of the common development and distribution licen[cs]e
eupl-1.2             0.9   licensed under the eupl(?:{v} 1 2)?
bsl-1.0              0.9   distributed under the boost software licen[cs]e{v}(?: 1 0)?
cc-by-4.0            0.95  licensed under (?:a |the )?cc by 4 0
cc-by-3.0            0.95  licensed under (?:a |the )?cc by 3 0
cc-by-sa-4.0         0.95  licensed under (?:a |the )?cc by sa 4 0
cc-by-sa-3.0         0.95  licensed under (?:a |the )?cc by sa 3 0
cc-by-nd-4.0         0.95  licensed under (?:a |the )?cc by nd 4 0
cc-by-nc-4.0         0.95  licensed under (?:a |the )?cc by nc 4 0
cc-by-nc-sa-4.0      0.95  licensed under (?:a |the )?cc by nc sa 4 0
cc-by-nc-nd-4.0      0.95  licensed under (?:a |the )?cc by nc nd 4 0
cc-by                0.9   licensed under (?:a |the )?creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-sa             0.9   licensed under (?:a |the )?creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nc             0.9   licensed under (?:a |the )?creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
ofl-1.1              0.9   licensed under the sil open font licen[cs]e{v}(?: 1 1)?
artistic-1.0         0.8   same terms as perl(?: itself)?
unlicense            0.9   released into the public domain under the unlicense
# 2: names with their version or form
mit                  0.8   mit licen[cs]e
mit                  0.8   mit (?:x11|expat) licen[cs]e
mit                  0.7   (?:x11|expat) mit licen[cs]e
mit-0                0.8   mit no attribution(?: licen[cs]e)?
x11                  0.7   x11 licen[cs]e
expat                0.7   expat licen[cs]e
isc                  0.8   isc licen[cs]e
apache-1.0           0.8   apache(?: software)? licen[cs]e{v} 1 0
apache-1.1           0.8   apache(?: software)? licen[cs]e{v} 1 1
apache-2.0           0.8   apache(?: software)? licen[cs]e{v} 2(?: 0)?
apache-2.0           0.7   apache 2 0
apache-2.0           0.7   apachev2
apache-2.0           0.7   apache v2(?: 0)?(?: licen[cs]e)
gpl-1.0              0.8   (?:gnu )?general public licen[cs]e{v} 1(?: 0)?{later}
gpl-2.0              0.8   (?:gnu )?general public licen[cs]e{v} 2(?: 0)?{later}
gpl-3.0              0.8   (?:gnu )?general public licen[cs]e{v} 3(?: 0)?{later}
gpl-1.0              0.7   (?:gnu )?gpl ?v?1(?: 0)?{later}
gpl-2.0              0.7   (?:gnu )?gpl ?v?2(?: 0)?{later}
gpl-3.0              0.7   (?:gnu )?gpl ?v?3(?: 0)?{later}
gpl-2.0              0.7   gpl version 2{later}
gpl-3.0              0.7   gpl version 3{later}
lgpl-2.0             0.8   (?:gnu )?library general public licen[cs]e{v} 2(?: 0)?{later}
lgpl-2.0             0.7   (?:gnu )?lesser general public licen[cs]e{v} 2 0{later}
lgpl-2.1             0.8   (?:gnu )?lesser general public licen[cs]e{v} 2 1{later}
lgpl-3.0             0.8   (?:gnu )?lesser general public licen[cs]e{v} 3(?: 0)?{later}
lgpl-2.1             0.7   (?:gnu )?lgpl ?v?2 1{later}
lgpl-3.0             0.7   (?:gnu )?lgpl ?v?3(?: 0)?{later}
agpl-3.0             0.8   (?:gnu )?affero general public licen[cs]e{v} 3(?: 0)?{later}
agpl-3.0             0.7   (?:gnu )?agpl ?v?3(?: 0)?{later}
gfdl-1.2             0.8   (?:gnu )?free documentation licen[cs]e{v} 1 2{later}
gfdl-1.3             0.8   (?:gnu )?free documentation licen[cs]e{v} 1 3{later}
bsd-2-clause         0.8   bsd 2 clause(?: licen[cs]e)?
bsd-2-clause         0.8   2 clause bsd(?: licen[cs]e)?
bsd-2-clause         0.7   simplified bsd(?: licen[cs]e)?
bsd-2-clause         0.5   freebsd(?: licen[cs]e)?
bsd-3-clause         0.8   bsd 3 clause(?: licen[cs]e)?
bsd-3-clause         0.8   3 clause bsd(?: licen[cs]e)?
bsd-3-clause         0.7   (?:new|revised|modified) bsd(?: licen[cs]e)?
bsd-4-clause         0.8   bsd 4 clause(?: licen[cs]e)?
bsd-4-clause         0.8   4 clause bsd(?: licen[cs]e)?
bsd-4-clause         0.7   original bsd(?: licen[cs]e)?
0bsd                 0.8   zero clause bsd(?: licen[cs]e)?
0bsd                 0.8   bsd zero clause(?: licen[cs]e)?
0bsd                 0.7   0bsd
bsd-3-clause-clear   0.8   clear bsd(?: licen[cs]e)?
mpl-1.0              0.8   mozilla public licen[cs]e{v} 1 0
mpl-1.1              0.8   mozilla public licen[cs]e{v} 1 1
mpl-2.0              0.8   mozilla public licen[cs]e{v} 2(?: 0)?
mpl-2.0              0.7   mpl ?v?2(?: 0)?
epl-1.0              0.8   eclipse public licen[cs]e{v} 1(?: 0)?
epl-2.0              0.8   eclipse public licen[cs]e{v} 2(?: 0)?
cpl-1.0              0.8   common public licen[cs]e{v} 1 0
cddl-1.0             0.8   common development and distribution licen[cs]e{v} 1 0
cddl-1.1             0.8   common development and distribution licen[cs]e{v} 1 1
eupl-1.1             0.8   european union public licen[cs]e{v} 1 1
eupl-1.2             0.8   european union public licen[cs]e{v} 1 2
bsl-1.0              0.8   boost software licen[cs]e{v}(?: 1 0)?
zlib                 0.8   zlib(?: libpng)? licen[cs]e
libpng               0.8   libpng licen[cs]e
libpng-2.0           0.8   png reference library licen[cs]e{v} 2
artistic-1.0         0.8   artistic licen[cs]e{v} 1 0
artistic-2.0         0.8   artistic licen[cs]e{v} 2 0
ncsa                 0.8   (?:university of illinois )?ncsa(?: open source)? licen[cs]e
postgresql           0.8   postgresql licen[cs]e
python-2.0           0.8   python software foundation licen[cs]e{v}(?: 2(?: 0)?)?
python-2.0           0.7   python licen[cs]e{v}(?: 2(?: 0)?)?
php-3.0              0.8   php licen[cs]e{v} 3 0
php-3.01             0.8   php licen[cs]e{v} 3 01
ruby                 0.8   ruby licen[cs]e
unlicense            0.8   unlicense
wtfpl                0.8   do what the (?:fuck|f) you want to public licen[cs]e
wtfpl                0.7   wtfpl
cc0-1.0              0.8   cc0(?: 1 0)?(?: universal)?
cc0-1.0              0.7   creative commons zero(?: 1 0)?(?: universal)?
cc-by-2.0            0.8   cc by 2 0
cc-by-2.5            0.8   cc by 2 5
cc-by-3.0            0.8   cc by 3 0
cc-by-4.0            0.8   cc by 4 0
cc-by-sa-2.0         0.8   cc by sa 2 0
cc-by-sa-2.5         0.8   cc by sa 2 5
cc-by-sa-3.0         0.8   cc by sa 3 0
cc-by-sa-4.0         0.8   cc by sa 4 0
cc-by-nd-3.0         0.8   cc by nd 3 0
cc-by-nd-4.0         0.8   cc by nd 4 0
cc-by-nc-2.0         0.8   cc by nc 2 0
cc-by-nc-3.0         0.8   cc by nc 3 0
cc-by-nc-4.0         0.8   cc by nc 4 0
cc-by-nc-sa-3.0      0.8   cc by nc sa 3 0
cc-by-nc-sa-4.0      0.8   cc by nc sa 4 0
cc-by-nc-nd-3.0      0.8   cc by nc nd 3 0
cc-by-nc-nd-4.0      0.8   cc by nc nd 4 0
odbl-1.0             0.8   open (?:data commons )?(?:open )?database licen[cs]e{v}(?: 1 0)?
odc-by-1.0           0.8   open data commons attribution licen[cs]e{v}(?: 1 0)?
pddl-1.0             0.8   public domain dedication and licen[cs]e{v}(?: 1 0)?
ofl-1.1              0.8   (?:sil )?open font licen[cs]e{v}(?: 1 1)?
openssl              0.8   openssl licen[cs]e
ssleay               0.8   ssleay licen[cs]e
upl-1.0              0.8   universal permissive licen[cs]e{v}(?: 1 0)?
sspl-1.0             0.8   server side public licen[cs]e{v}(?: 1)?
busl-1.1             0.8   business source licen[cs]e{v}(?: 1 1)?
elastic-2.0          0.8   elastic licen[cs]e{v}(?: 2 0)?
commons-clause       0.8   commons clause(?: licen[cs]e)?
polyform-nc-1.0      0.8   polyform noncommercial licen[cs]e{v}(?: 1 0 0)?
mulan-psl-2.0        0.8   mulan (?:psl|permissive software licen[cs]e){v} ?v?2
afl-3.0              0.8   academic free licen[cs]e{v} 3 0
osl-3.0              0.8   open software licen[cs]e{v} 3 0
ms-pl                0.8   microsoft public licen[cs]e
ms-rl                0.8   microsoft reciprocal licen[cs]e
apsl-2.0             0.8   apple public source licen[cs]e{v} 2 0
ipl-1.0              0.8   ibm public licen[cs]e{v} 1 0
cecill-2.1           0.8   cecill(?: free software)? licen[cs]e(?:{v} 2 1)?
lppl-1.3             0.8   latex project public licen[cs]e{v}(?: 1 3c?)?
qpl-1.0              0.8   q public licen[cs]e{v}(?: 1 0)?
w3c                  0.8   w3c software(?: notice and)? licen[cs]e
unicode              0.8   unicode licen[cs]e(?: agreement)?
curl                 0.7   curl licen[cs]e
ecl-2.0              0.8   educational community licen[cs]e{v} 2 0
vim                  0.7   vim licen[cs]e
beerware             0.8   beer ?ware licen[cs]e
json                 0.7   json licen[cs]e
oldap-2.8            0.8   openldap public licen[cs]e{v}(?: 2 8)?
# 3: sentences of license texts
mit                  0.9   permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit                  0.6   the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
isc                  0.8   permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
bsd-unversioned      0.7   redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause         0.6   neither the name of (?:the )?(?:copyright holder|author|university) nor the names of its contributors
bsd-4-clause         0.6   all advertising materials mentioning features or use of this software must display
zlib                 0.8   this software is provided as is without any express or implied warranty
zlib                 0.7   altered source versions must be plainly marked as such
apache-2.0           0.8   you may not use this file except in compliance with the license
apache-2.0           0.7   unless required by applicable law or agreed to in writing software distributed under the license is distributed
gnu-gpl              0.7   this program is free software you can redistribute it and or modify
gnu-gpl              0.6   you should have received a copy of the gnu general public licen[cs]e
gnu-lgpl             0.6   you should have received a copy of the gnu lesser general public licen[cs]e
gnu-agpl             0.6   you should have received a copy of the gnu affero general public licen[cs]e
mpl-2.0              0.7   this source code form is subject to the terms of the mozilla public licen[cs]e
unlicense            0.8   this is free and unencumbered software released into the public domain
wtfpl                0.7   you just do what the (?:fuck|f) you want to
bsl-1.0              0.7   permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
gfdl-unversioned     0.6   permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e
cc0-1.0              0.7   has waived all copyright and related or neighboring rights
beerware             0.7   you can buy me a beer in return
# 4: names without a version
gnu-gpl              0.5   (?:gnu )?general public licen[cs]e
gnu-gpl              0.5   gnu gpl
gnu-lgpl             0.5   (?:gnu )?(?:lesser|library) general public licen[cs]e
gnu-lgpl             0.5   gnu lgpl
gnu-agpl             0.5   (?:gnu )?affero general public licen[cs]e
gfdl-unversioned     0.5   (?:gnu )?free documentation licen[cs]e
apache-unversioned   0.5   apache(?: software)? licen[cs]e
bsd-unversioned      0.5   bsd(?: style)? licen[cs]e
mpl-unversioned      0.5   mozilla public licen[cs]e
epl-unversioned      0.5   eclipse public licen[cs]e
cddl-unversioned     0.5   common development and distribution licen[cs]e
eupl-unversioned     0.5   european union public licen[cs]e
artistic-unversioned 0.5   artistic licen[cs]e
php-unversioned      0.5   php licen[cs]e
cc-by                0.5   creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-sa             0.5   creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nc             0.5   creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by                0.5   cc by
cc-by-sa             0.5   cc by sa
cc-by-nd             0.5   cc by nd
cc-by-nc             0.5   cc by nc
cc-by-nc-sa          0.5   cc by nc sa
cc-by-nc-nd          0.5   cc by nc nd
creative-commons     0.4   creative commons(?: licen[cs]e)?
# 5: notices
copyright-notice     0.5   copyright (?:c )?(?:© )?(?:19|20)[0-9][0-9]
copyright-notice     0.5   copyright ©(?:19|20)[0-9][0-9]
copyright-notice     0.5   © (?:19|20)[0-9][0-9]
copyright-notice     0.5   ©(?:19|20)[0-9][0-9]
all-rights-reserved  0.5   all rights reserved
all-rights-reserved  0.5   alle rechte vorbehalten
all-rights-reserved  0.5   tous droits réservés
all-rights-reserved  0.5   todos los derechos reservados
public-domain        0.7   (?:dedicated to|released into|placed in|in) the public domain
public-domain        0.6   public domain dedication
proprietary          0.7   proprietary and confidential
proprietary          0.7   confidential and proprietary
proprietary          0.6   unauthorized copying of this file
no-warranty          0.4   without warrant(?:y|ies)(?: or conditions)? of any kind
no-warranty          0.4   without any warranty
redistribution       0.6   redistribution and use in source and binary forms
permission-notice    0.6   permission is hereby granted free of charge
copyleft             0.4   copyleft
license-file         0.3   see (?:the )?(?:accompanying )?licen[cs]e(?: file)? for(?: more)? details
license-file         0.3   see the file (?:licen[cs]e|copying)
dual-license         0.4   dual licensed
eula                 0.4   end user licen[cs]e agreement
eula                 0.4   eula
"""


def parse() -> list[tuple[int, str, float, str]]:
    """(priority, label, strength, regex) of every line, macros written out."""
    out, priority = [], 0
    for line in RULES.strip().splitlines():
        if line.startswith("#"):
            priority = int(line[1 : line.index(":")])
            continue
        label, strength, regex = line.split(None, 2)
        for name, body in MACROS.items():
            regex = regex.replace(name, body)
        out.append((priority, label, float(strength), regex))
    return out
